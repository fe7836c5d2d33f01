"""The corpus operators against libraries and brute force, and on odd tables."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from test_queries import DATA, against_duckdb  # noqa: E402

import corpus_pipeline  # noqa: E402
from pairfield.llm import bpe, dartminhash, decontam, fingerprints, huffman_ids, langid, quality, queries, secrets, token_counts, url_filter, vocab  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
STRANGE = ["", "  ", " a", "a ", "a  b", "\n\na\n b\t", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "İstanbul ΑΣ σΣ", "x\x1cy \x1f z", "é é ẛ̣", "it's WE'LL 12³ ½ 'tis", "ª" * 600 + "b", "a" * 3000, "\U00010d50 test ꟋꟌ", "漢字かな 한국어", "​‍", "\x85\xa0", "\x00\x7f", "ǅ ﬁ", "naïve café", "word " * 400, "𝒳𝒴 😀👍🏽"]
LONG = "the quick brown fox " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, row long, part int, bucket int, label string, _doubt string, range int, ghost int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    texts = [None, "", None, LONG, *STRANGE, "one two three four five six", "one two three four five six", "One two, three four five six!"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None][i % 2], len(t or ""), "k", 1, 1, 1, 1, "l", "d", 1, 1) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (None, "no id", None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9), (-5, "password = abcdef123", "en", "s1", 20, *[None] * 9)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return Counter(map(repr, rows))


def test_settled_characters_have_the_library_classes():
    split = Tokenizer.from_file(BYTE).pre_tokenizer
    rng = random.Random(1)
    points = [c for a, b in vocab.SETTLED for c in (range(a, b + 1) if b - a < 2000 else [a, b, *rng.sample(range(a, b), 400)])]
    for c in points:
        s = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}b"
        assert [s[i:j] for _, (i, j) in split.pre_tokenize_str(s)] == vocab.BYTE_PATTERN.findall(s), hex(c)


def test_whole_tokens_are_one_token():
    tokenizer = Tokenizer.from_file(BYTE)
    whole = sorted(token_counts.whole_tokens(BYTE))
    assert len(whole) > 49_000 and all(len(e.ids) == 1 for e in tokenizer.encode_batch(whole, add_special_tokens=False))


def test_token_counts(spark, odd, empty):
    tokenizer = Tokenizer.from_file(BYTE)
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts_of(odd)]
    assert multiset(map(tuple, token_counts.token_counts(odd, BYTE).collect())) == multiset(want)
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_bpe(spark, odd, empty):
    tokenizer = Tokenizer.from_file(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts_of(odd):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert multiset(map(tuple, bpe.encode_decode(odd, WORD).collect())) == multiset(want)
    encodings = bpe.encoded(odd, WORD)
    assert multiset(sha(r["text"]) for r in bpe.decoded(encodings, WORD).collect()) == multiset(w[3] for w in want)
    assert bpe.encode_decode(empty, WORD).count() == 0


def test_tree_concatenation_is_exact():
    tree, plain = bpe.WordBpe(WORD, long_word=20, leaf=5, window=1), Tokenizer.from_file(WORD).model
    rng = random.Random(2)
    for _ in range(1500):
        alphabet = rng.choice(["a", "ab", "aeinrst", "thein", "abcdefghijklmnopqrstuvwxyz"])
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 150)))
        assert tree.word(s) == [t.id for t in plain.tokenize(s)]


def test_merges_are_the_library_s():
    merges, plain, rng = bpe.Merges(bpe._model(WORD)), Tokenizer.from_file(WORD), random.Random(3)
    words = ["a", "the", "thethethethe", "aaaaaaa", "é", "漢字", "1", "!!!", "straße", "x" * 99]
    words += ["".join(rng.choice(rng.choice(["ab", "aeinrst", "thein", "abcdefghijklmnopqrstuvwxyzéß漢"])) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ids, stops = merges(words)
    spell = str.maketrans({b: c for b, c in enumerate(vocab.visible_bytes())})
    for w, i, j in zip(words, [0, *stops], stops):
        assert ids[i:j].tolist() == [t.id for t in plain.model.tokenize(w.encode().decode("latin-1").translate(spell))], w


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_trees_of_texts_are_exact(leaf):
    tree, tokenizer, rng = bpe.WordBpe(WORD, text_leaf=leaf), Tokenizer.from_file(WORD), random.Random(4)
    texts = [*STRANGE, *["".join(rng.choice(["a", "B", "the", " ", " ", "\n", "é", "e\u0301", "J\u030c", "'s", "!", "1", "漢"]) for _ in range(rng.randint(1, 90))) for _ in range(300)]]
    for text, pieces in zip(texts, tree.texts(pa.array(texts))):
        assert [x for values in pieces for v in values for x in v] == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_texts_of_megabytes(monkeypatch):
    """Texts that are cut in pieces (above 1 MiB) and texts above the size of a group, with and without what is odd."""
    plain = "The quick, brown fox's 12 éàü " * 45_000
    texts = [plain, plain + "<|endoftext|>" + plain[:100], "ꟋꟌ " + plain, "ab\x1ccd " * 150_000, "漢" * 20_000]
    words, counts = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    want = [words.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1 << 20, 64 << 20):
        monkeypatch.setattr(bpe, "GROUP_BYTES", size)
        for ids, pieces in zip(want, bpe.WordBpe(WORD).texts(pa.array(texts))):
            assert [x for values in pieces for v in values for x in v] == ids
        assert [np.frombuffer(x, "H").tolist() for x in huffman_ids._Ids(WORD, 2)(pa.array(texts))] == [[*ids, 2] for ids in want]
    counter = token_counts.Counter(BYTE, token_counts.whole_tokens(BYTE))
    assert [counter(t) for t in texts] == [len(counts.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_are_forgotten_and_learnt_again():
    small, tokenizer = bpe.WordBpe(WORD, limit=20), Tokenizer.from_file(WORD)
    for text in ("one two three " * 3, " ".join(f"w{i}ord" for i in range(100)), "one two three"):
        found = [x for pieces in small.texts(pa.array([text])) for values in pieces for v in values for x in v]
        assert found == tokenizer.encode(text, add_special_tokens=False).ids


def test_huffman_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 300):
        counts = rng.zipf(1.4, n).clip(0, 10**9)
        lengths = huffman_ids.code_lengths(counts, 12)
        assert lengths.max(initial=0) <= 12 and (n < 2 or sum(2.0 ** -lengths.astype(float)) == 1)
        coder = huffman_ids.Coder(lengths)
        for size in (0, 1, 63, 64, 65, 1000) if n else (0,):
            ids = rng.integers(0, max(n, 1), size)
            assert (coder.decode(*coder.encode(ids), size) == ids).all()
    # two symbols more than a balanced tree of the limit would hold
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(5, int), 2)


def test_huffman_files(spark, odd, empty, tmp_path):
    tokenizer = Tokenizer.from_file(WORD)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    found = huffman_ids.round_trip(odd, WORD).orderBy("start").collect()
    assert multiset((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == multiset((i, len(x := ids(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in texts_of(odd))
    assert [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in found), key=lambda i: (i is not None, i))
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    out = f"file://{tmp_path}/ids"
    huffman_ids.write_ids(odd.where("doc_id = 3"), WORD, out)
    assert huffman_ids.read_ids(spark, out).first()["ids"] == ids(LONG)
    assert huffman_ids.round_trip(empty, WORD).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    against_duckdb(spark, queries.QUERIES[name], queries.ORACLE[name])


def brute_secrets(text):
    spans = []
    for k, (name, regex, group, least) in enumerate((("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("(AKIA[A-Z0-9]+)"), 1, 20), ("hex", re.compile("([0-9a-f]+)"), 1, 24))):
        spans += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in regex.finditer(text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(spans)]


def test_secrets(spark, odd, empty):
    rng = random.Random(3)
    made = [(i, "".join(rng.choice(["token", "=", " ", "'", "AKIA", "ABCD1234EFGH5678", "é", "api_key", ":", "abc123", "0123456789abcdef", "x", "\n", "PassWord"]) for _ in range(60)), None, f"s{i % 4}") for i in range(60)]
    docs = spark.createDataFrame([*made, *[(r["doc_id"], r["text"], None, r["source"]) for r in odd.collect()]], "doc_id long, text string, lang string, source string")
    found = secrets.report(secrets.candidates(docs))
    want = [(r["doc_id"], hashlib.sha256(",".join(brute_secrets(r["text"] or "")).encode()).hexdigest()) for r in docs.collect()]
    assert multiset((r["doc_id"], r["base_sha256"]) for r in found.collect()) == multiset(want)
    assert secrets.report(secrets.candidates(empty)).count() == 0


def test_masking_follows_ownership(spark, odd):
    rows = [(i, f"é token = copied123456 and {i}", None, f"s{i}") for i in range(4)] + [(9, "é password: mine1234 token=mine1234 é", None, "s9"), (9, "é password: mine1234 token=mine1234 é", None, "s9"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, source string").withColumn("n_chars", F.length("text").cast("long"))
    out = secrets.masked(docs, secrets.candidates(docs))
    assert out.columns == docs.columns and out.count() == 7
    texts = multiset(r["text"] for r in out.collect())
    assert texts == multiset([*[r[1] for r in rows[:4]], *["é [SECRET] [SECRET] é"] * 2, None])
    assert out.where("n_chars <> length(text)").count() == 0
    clash = odd.withColumn("cuts", F.lit("c")).withColumn("id", F.lit(1)).withColumn("_key", F.lit("k"))
    out = secrets.masked(clash, secrets.candidates(clash))
    assert out.schema.names == clash.columns and out.drop("text", "n_chars").exceptAll(clash.drop("text", "n_chars")).count() == 0 and out.count() == clash.count()


def test_copied_examples_and_owned_secrets(spark):
    """Three owners, or two in twenty repositories, make an example; one owner never does."""
    rows = [(i, "token=threeowners1", f"s{i}") for i in range(3)] + [(10 + i, "token=twoowners22", f"s{i % 2}") for i in range(20)]
    rows += [(40 + i, "token=fewplaces33", f"s{i % 2}") for i in range(19)] + [(60 + i, "token=oneowner444", "s9") for i in range(25)]
    found = secrets.report(secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    by = {r["doc_id"]: (r["n_live"], r["n_example"], r["most_owners"], r["most_repositories"]) for r in found}
    assert by[0] == (0, 1, 3, 3) and by[10] == (0, 1, 2, 20) and by[40] == (1, 0, 2, 19) and by[60] == (1, 0, 1, 25)


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "https://EN.Example.COM/en/7?x", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/80#z", "http://b.org/es", "http://b.org/es/?q", "http://spam-farm.example.org/en/7", "ftp://x.cheap-pills.com/en/1", "http://x.cheap-pills.net/de/1", "http://a.net/de/8", "http://İ.com/en/é"]
    urls += ["http://Casino-win.example.org/a", "http://my_casino.org/", "http://casinos1.org/", "http://x.org/a/WP-Login.php?x=1", "http://x.org/wp-logins", "http://x.org/feed/comments/", "http://x.org/comments/feed", "http://x.org/a?b=1&ReplyToCom=3#c", "http://x.org/a?b=replytocom", "http://x.org/a?action=edit", "http://x.org/a?action=edits", "http://x.org/a;action=edit", "http://x.org/a?x\u2028y&do=diff", "http://écasino.org/", "http://x.org/" + "ab/" * 50_000 + "login", "http://" + "a." * 20_000 + "net/de/8", "http://x.org/?" + "&a=b" * 30_000 + "&sessionid=1"]
    pages = spark.createDataFrame([(i if i else None, u, 1, "t", "r") for i, u in enumerate(urls)], "page_id long, url string, row int, token string, rule string")
    pages.createOrReplaceTempView("pages")
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

    def judged(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, verdict, rule = max(fits, default=(0, None, None))
        query = re.match(r"[^?#]*(\?[^#]*)?", u or "", re.S)[1] or "" if "://" in (u or "") else ""
        whole = re.sub("[A-Z]", lambda m: m[0].lower(), host + path + query)
        spam = any(re.search(p.regex.replace(r"\z", r"\Z"), whole) for p in url_filter.PATTERNS)
        return host, path, rule, verdict or ("block" if spam else "allow")

    found = url_filter.judge(pages).collect()
    assert multiset((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == multiset((i if i else None, *judged(u)) for i, u in enumerate(urls))
    assert url_filter.judge(pages.where("false")).count() == 0
    assert url_filter.judge(pages, rules=()).where("rule IS NOT NULL").count() == 0
    assert url_filter.judge(pages, rules=(), patterns=()).where("verdict <> 'allow'").count() == 0
    blocked = {r["pattern"] for r in found}
    assert {"host:casino", "path:wp-login", "path:feed/comments", "query:replytocom=", "query:action=edit", "query:do=diff", "path:login", "query:sessionid="} <= blocked
    # every literal of a rule is a token of what it matches
    for rule in url_filter.PATTERNS:
        assert rule.tokens and all(t[2:] in rule.regex.replace("\\", "") for t in rule.tokens)


def test_languages(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    found = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    out = langid.languages(odd)
    assert out.count() == odd.count()
    assert {r["lang_pred"] for r in out.where("doc_id IN (0, 1, 2)").collect()} == {"und"}
    assert langid.languages(empty).count() == 0
    assert langid.predict(odd, {}).where("lang_pred <> 'und'").count() == 0
    one, parts = langid.Profiles(), langid.Profiles()
    text = "Ünlü word, " * 50
    whole = dict(zip(*map(list, one.trigrams(text))))
    langid.SLICE, kept = 37, langid.SLICE
    try:
        assert dict(zip(*map(list, parts.trigrams(text)))) == whole
    finally:
        langid.SLICE = kept


def test_languages_are_brute_force(spark, empty):
    """Vectors made letter by letter and text by text give the same languages and cosines."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.where("n_chars < 3000" if "n_chars" in docs.columns else "length(text) < 3000").limit(60).collect()] + [(10**6, None, "en"), (10**6 + 1, "12 !", "de"), (10**6 + 2, "Ünlü Ünlü", None), (10**6 + 2, "Ünlü Ünlü", None)]
    letters, symbol = langid.Profiles().last.astype(int), langid.Profiles().symbol

    def vector(text):
        codes, total = [0], np.zeros(langid.DIMENSIONS, int)
        for c in text.lower():
            code = int(symbol[ord(c)]) if ord(c) < 0x10000 else 27 * c.isalpha()
            codes += [code] if code or codes[-1] else []
        codes += [0] if codes[-1] else []
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total, any(codes)

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    prototypes = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and not held(i):
            prototypes[lang] = prototypes.get(lang, 0) + vector(t)[0]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
    want = {}
    for i, t, _ in rows:
        v, any_letter = vector(t or "")
        cosines = [(float(unit(prototypes[k]) @ unit(v)), k) for k in sorted(prototypes)]
        want[i] = (held(i), *max(cosines, key=lambda x: x[0])[::-1]) if any_letter else (held(i), "und", 0.0)
    found = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)
    for r in found:
        h, lang, score = want[r["doc_id"]]
        assert (r["held_out"], r["lang_pred"]) == (h, lang) and abs(r["score"] - min(1, max(0, score))) < 1e-5


def test_short_clean_texts_stay_and_random_letters_go(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    prototypes = langid.learn(docs)
    assert docs.exceptAll(langid.identified(docs, prototypes)).where(F.col("text").rlike(r"\p{L}")).count() == 0
    rng = random.Random(99)
    noise = spark.createDataFrame([(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=k))) for i, k in enumerate([60, 600, 6000] * 50)], "doc_id long, text string")
    assert langid.identified(noise, prototypes).count() == 0


def test_quality(spark, odd, empty):
    base = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    found = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.scores(odd, some)
    assert out.count() == odd.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {r["score"] for r in quality.scores(odd, some.where("false")).collect()} == {0.5}
    assert quality.scores(empty, some).count() == 0
    assert quality.pooled(np.array([1, 1, 2]), np.array([1, 0, 2])).tolist() == [0.5, 0.5, 1.0]


def test_quality_is_brute_force(spark):
    """Ridge and calibration by plain matrices over all rows at once, on a small set."""
    rng = random.Random(14)
    good = ["the quick brown fox jumps over the lazy dog. ", "we met at noon, and walked home. "]
    bad = ["BUY NOW!!! ", "click $$$ here | home | login ", "%%% ### "]
    rows = [(i, "".join(rng.choices(good if i % 3 else bad, k=rng.randint(1, 20)) + rng.choices(bad, k=i % 2))) for i in range(160)]
    labels = [(i, int(i % 3 > 0) if rng.random() > 0.1 else rng.randint(0, 1)) for i, _ in rows]
    found = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in quality.scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([quality.statistics(t) for _, t in rows])
    y = np.array([q for _, q in labels], float)
    learn = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows])
    fold = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) % quality.FOLDS for i, _ in rows])  # two's complement: the same remainder of a power of two
    spread = x[learn].std(axis=0)
    kernel = quality.Kernel(x[learn].mean(axis=0), np.where(spread > 0, spread, 1.0))
    z = kernel(x)

    def ridge(of):
        return np.linalg.solve(z[of].T @ z[of] + quality.RIDGE * of.sum() * np.eye(z.shape[1]), z[of].T @ y[of])

    out = np.zeros(len(x))
    for f in range(quality.FOLDS):
        assert (learn & (fold == f)).sum() > 10  # no fold is empty
        out[fold == f] = z[fold == f] @ ridge(learn & (fold != f))
    bins = np.clip(np.floor((out[learn] + 0.5) * quality.BINS / 2), 0, quality.BINS - 1).astype(int)
    used = np.unique(bins)
    n, positive = np.array([(bins == b).sum() for b in used]), np.array([y[learn][bins == b].sum() for b in used])
    # isotonic regression as max over starts of min over ends of means
    value = [max(min(positive[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    raw = z @ ridge(learn)
    want = np.clip(0.99 * np.interp(raw, (used + 0.5) * 2 / quality.BINS - 0.5, value) + 0.01 * np.clip(raw, 0, 1), 0, 1)
    for k, (i, _) in enumerate(rows):
        h, score, predicted = found[i]
        assert h == (not learn[k]) and abs(score - want[k]) < 1e-4 and predicted == (score >= 0.7)


def test_fingerprints(spark, odd, empty):
    docs = odd.select("doc_id", F.substring("text", 1, 3000).alias("text"), "key", "part")
    found = fingerprints.neighbours(docs).collect()
    order = sorted(((i, t or "") for i, t in texts_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        n, below = len(t) // 3, order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + below[:n]).encode()).hexdigest()))
    assert multiset((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == multiset(want)
    by_text = {}
    for r, (_, t) in zip(sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), sorted(order, key=lambda r: (r[0] is not None, r[0] or 0))):
        if r["doc_id"] is not None:
            by_text.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.neighbours(empty).count() == 0
    one = fingerprints.neighbours(docs.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0


def codes_of(df, *columns):
    """The codes of each text column of df (with id), as x_codes, and near: the likeness of the first two."""
    out = df.select("id")
    for c in columns:
        out = out.join(fingerprints.samples(df, ["id"], c).withColumnRenamed("codes", f"{c}_codes"), "id")
    return out.withColumn("near", fingerprints.likeness(F.col(f"{columns[0]}_codes"), F.col(f"{columns[1]}_codes")))


def shingles(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    rng = random.Random(5)
    terms = ["a b c", "d e", "f g h i j", "a b c d e", "k"]
    rows = []
    for i in range(300):
        a = [rng.choice(terms) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            b[rng.randrange(len(b))] = rng.choice([*terms, f"x{i}"])
        rows.append((i, " ".join(a), " ".join(b)))
    made = codes_of(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b").collect()
    errors = []
    for r in made:
        a, b = map(shingles, rows[r["id"]][1:])
        want = sum((a & b).values()) / sum((a | b).values())
        # each pair within five standard deviations of a share of 64 draws
        assert abs(r["near"] - want) <= 5 * (max(want * (1 - want), 0.01) / 64) ** 0.5, (r["near"], want)
        errors.append(r["near"] - want)
    assert len(made) == 300 and abs(np.mean(errors)) < 0.015


def test_an_inserted_word_changes_the_terms_beside_it_alone(spark):
    rng = random.Random(6)
    plain = [f"word{rng.randrange(10**6)}x" for _ in range(400)]
    runs = ["".join(rng.choices(letters, k=600)) for letters in ("ABCDEFGHabcdefgh0123456789+/", "".join(map(chr, range(0x4E00, 0x4F00))) + "。", "กขคงจฉชซ")]
    rows = [(0, " ".join(plain), " ".join(["more", *plain])), *[(i, t, t[:20] + "7" + t[20:]) for i, t in enumerate(runs, 1)]]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    found = codes_of(df, "a", "b").collect()
    assert len(found) == 4 and all(len(r["a_codes"]) == 64 and r["near"] > (0.85 if r["id"] else 0.9) for r in found), [r["near"] for r in found]
    fingerprints.DEPTH, kept = 1e9, fingerprints.DEPTH
    try:
        assert {r["id"]: (r["a_codes"], r["b_codes"]) for r in codes_of(df, "a", "b").collect()} == {r["id"]: (r["a_codes"], r["b_codes"]) for r in found}
    finally:
        fingerprints.DEPTH = kept
    words_of = [r["t"] for r in spark.createDataFrame([("a b  c d e f",), (" one two ",), ("漢字 a",), ("x" * 66,)], "t string").select(fingerprints.words_of(F.col("t")).alias("t")).collect()]
    assert words_of == [list("abcdef"), ["one", "two"], ["漢", "字", "a"], ["x"] * 66]


def test_terms_of_both_texts_are_drawn_once(spark, monkeypatch):
    """The codes are those of each text alone, and of a term that both have once there is one row."""
    words = [f"w{k}" for k in range(60)]
    pairs = [(1, " ".join(words), " ".join(words[:45])), (2, " ".join(words[:9] * 5 + words[20:40]), " ".join(words[:9] * 3 + words[20:30])), (3, "", "a b c"), (4, "a b", ""), (5, "", ""), (6, "one", "one")]
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    drawn, draw = [], fingerprints._drawn
    monkeypatch.setattr(fingerprints, "_drawn", lambda terms: drawn.append(terms.where("h IS NOT NULL AND id = 1").count()) or draw(terms))
    both = {r["id"]: (r["codes0"], r["codes1"]) for r in fingerprints.samples(df, ["id"], "a", "b").collect()}
    alone = [{r["id"]: r["codes"] for r in fingerprints.samples(df, ["id"], c).collect()} for c in "ab"]
    assert both == {k: (alone[0][k], alone[1][k]) for k in range(1, 7)}
    assert drawn[0] == drawn[1] == 56 * fingerprints.SAMPLES // fingerprints.AT_ONCE


def test_code_of_fingerprints_stays_below_the_limit_of_the_compiler(spark):
    """Java leaves methods above 8000 bytes uncompiled, which is 20 times slower."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = queries.op5_fingerprints(spark, DATA)._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            part = v[i : i + 10]
            for k in range(len(w) - len(part) + 1):
                if w[k : k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    found.add(str(item))
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    runs = [k for k in sorted(hit) if k - 1 not in hit], [k for k in sorted(hit) if k + 1 not in hit]
    spans = ",".join(f"{places[i][0]}:{places[j][1]}" for i, j in zip(*runs))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), spans


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination(spark, odd, empty, block):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Brown FOX"), (10, "brown fox"), (3, None), (None, "the quick"), (4, "!!!"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(100, "x One two, three four five six seven eight nine ten. eleven y", "r"), (101, "Ünbrown fox brownfox brown-fox", "r")], "doc_id long, text string, row string").unionByName(odd.select("doc_id", F.substring("text", 1, 500).alias("text"), F.lit("r").alias("row")))
    known = [i for i in items if i[0] is not None]
    found = decontam.report(decontam.contamination(docs, bench, block_bytes=block)).collect()
    assert multiset(map(tuple, found)) == multiset((i, *brute_hits(t, known)) for i, t in texts_of(docs))
    clean = decontam.decontaminated(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and multiset(texts_of(clean)) == multiset((i, t) for i, t in texts_of(docs) if not brute_hits(t, known)[4])
    assert decontam.contamination(empty, bench, block_bytes=block).count() == 0
    assert decontam.report(decontam.contamination(docs, bench.where("false"))).where("contaminated").count() == 0


def test_hits_lead_back_to_the_text():
    w = decontam.Windows([("1", "brown fox")])
    text = "É the Brown, FOX jumps"
    assert decontam.without_hits(text, decontam.places_of(text, w.scan(text)[1])) == "É the  jumps"


def test_memory_of_a_block():
    rng = random.Random(8)
    items = [(str(i), " ".join(f"w{rng.randrange(50_000)}" for _ in range(150))) for i in range(1000)]
    text = sum(len(t) for _, t in items)
    before = decontam_memory()
    windows = decontam.Windows(items)
    assert text > 0.9e6 and decontam_memory() - before < 260 << 20
    assert windows.scan(items[7][1])[1] == [(0, 150)]


def decontam_memory():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def brute_classes(rows, threshold=0.8):
    """Classes by generalised Jaccard of the counts of word shingles, all pairs compared."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] or words(rows[i][1]) == words(rows[j][1])
            if same or sets[i] and sets[j] and (sets[i] & sets[j]).total() >= threshold * (sets[i] | sets[j]).total():
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: least[root(i)] for i in range(len(rows))}


def near_copies(rng, n=150):
    """Texts around twelve others, some with a line that they repeat."""
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 200))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = f"e{i}{rng.random()}"
        rows.append((i * 3 - 50, " ".join(w + base[i % 12][:7] * rng.choice([0, 0, 1, 4]))))
    return rows


def test_near_duplicates(spark, odd, empty):
    docs = spark.createDataFrame(near_copies(random.Random(4)), "doc_id long, text string").unionByName(odd.select("doc_id", F.substring("text", 1, 4000).alias("text")).withColumn("doc_id", F.col("doc_id") + 10_000))
    found = dartminhash.near_duplicates(docs).collect()
    want = brute_classes([r for r in texts_of(docs) if r[0] is not None])
    assert {r["doc_id"]: r["class_id"] for r in found} == want and len(found) == docs.where("doc_id IS NOT NULL").count()
    kept = dartminhash.one_of_each(odd, dartminhash.near_duplicates(odd))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.schema == odd.schema and ids.count(None) == 2 and sorted(i for i in ids if i is not None) == sorted(set(brute_classes([r for r in texts_of(odd) if r[0] is not None]).values()))
    assert kept.subtract(odd).count() == 0  # all columns as they were
    assert dartminhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_text_that_repeats_a_line(spark):
    """Shingles count as often as they occur: a line 60 times over isn't a near copy of the line 3 times over."""
    line = "alpha beta gamma delta epsilon zeta "
    texts = [line * 3, line * 60, line * 58, line * 60 + "end"]
    found = dartminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(list(enumerate(texts))) == {0: 0, 1: 1, 2: 1, 3: 1}


def test_one_id_with_several_texts(spark):
    """A near copy of any text of a document is in its class, whichever text comes first as bytes."""
    rng = random.Random(12)
    one, two, three = (" ".join(f"{c}{rng.randrange(9999)}" for _ in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, three)]
    found = dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).distinct().collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_hot_buckets_and_passes(spark, monkeypatch):
    """All buckets hot, no rounds of leaders, leftovers in several passes: the same classes."""
    monkeypatch.setattr(dartminhash, "HOT_MEMBERS", 2)
    monkeypatch.setattr(dartminhash, "ROUNDS", 0)
    monkeypatch.setattr(dartminhash, "PAIRS_A_NODE", 0.001)
    monkeypatch.setattr(dartminhash, "BANDS", 20)
    common = " ".join(f"c{i}" for i in range(60))
    rng = random.Random(13)
    rows = near_copies(rng, 60) + [(1000 + i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20])))) for i in range(30)]
    found = dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(rows)


def test_recall_of_near_copies():
    """Of pairs at a similarity of 0.8 to 0.82, the hardest, at least 0.99 share a bucket."""
    rng, darts, shared = np.random.default_rng(2), dartminhash.DartMinHash(), 0
    for _ in range(300):
        n = int(rng.integers(20, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        new = int(n / 9)  # n - new common of n + new
        b[:new] = rng.integers(0, 2**63, new)
        w = rng.integers(1, 4, n).astype(float)
        w[:new] = 1
        shared += bool(set(dartminhash.bands_of(darts(a, w)).tolist()) & set(dartminhash.bands_of(darts(b, w)).tolist()))
    assert shared >= 297


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    darts, error = dartminhash.DartMinHash(100), []
    for _ in range(100):
        u = rng.integers(0, 2**63, 200).astype(np.uint64)
        a = rng.choice([0, 0.5, 1, 2.3], 200)
        b = np.where(rng.random(200) < 0.6, a, rng.choice([0, 0.5, 1, 2.3], 200))
        error.append((darts(u[a > 0], a[a > 0]) == darts(u[b > 0], b[b > 0])).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08


def test_shingles_of_slices_are_those_of_the_whole():
    s = dartminhash.Shingles()
    line = s.line("ab cde f " * 900)
    whole = [x.tolist() for x in s(line)]
    s.power, s.inverse = s.power[:301], s.inverse[:301]
    assert [x.tolist() for x in s(line)] == whole and sum(whole[1]) == 2700 - 4


def test_pipeline(spark, odd, empty, tmp_path):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
            assert name == "bpe_encode_decode" or docs.columns == columns
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        docs.collect()


def test_pipeline_stages_are_brute_force(spark):
    """Decontamination, secret scan and BPE, each on its own input, against plain versions; near_dedup is below."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9)) if w}
    held = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    assert {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, DATA).collect()} == {i for i, t, _ in rows if not held(words(t))}
    owners, spans = {}, {}
    for i, t, owner in rows:
        for name, regex, group, least in secrets.KINDS:
            for m in re.finditer(regex.replace("\\z", "\\Z"), t or ""):
                if len(m[group]) >= least:
                    owners.setdefault(m[group], set()).add((owner or "", i))
                    spans.setdefault(i, []).append((m.start(), m.end(), m[group]))
    copied = {v for v, o in owners.items() if (k := len({x for x, _ in o})) >= 3 or k > 1 and len(o) >= 20}

    def masked(i, t):
        out, at = [], 0
        for start, stop, value in sorted(spans.get(i, [])):
            if value not in copied:
                out += [t[at:start], secrets.MASK] if start >= at else []
                at = max(at, stop)
        return "".join(out) + t[at:] if t is not None else None

    scanned = corpus_pipeline.secret_scan(spark, docs, DATA)
    assert scanned.columns == docs.columns and {r["doc_id"]: r["text"] for r in scanned.collect()} == {i: masked(i, t) for i, t, _ in rows}
    tokenizer, sha = Tokenizer.from_file(WORD), lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.bpe_encode_decode(spark, docs, DATA).collect()}
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert found[i] == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_pipeline_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spoken = corpus_pipeline.language_id(spark, docs, DATA)
    assert docs.exceptAll(spoken).where(F.col("text").rlike(r"\p{L}")).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()}
    assert kept == set(brute_classes(rows).values())
