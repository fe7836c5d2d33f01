"""Exact encoders on top of the tokenizers library, fast because words recur.

The library fixes every id: its models run the merges. What is done here is splitting text into
pre-tokens and remembering what the library gave for a word. Characters on whose class (letter,
number, space) two Unicode versions could differ are never split here: such text goes to the
library whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import re
import unicodedata

import pyarrow as pa
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words remembered by a worker before it starts afresh.
CACHE_WORDS = 300_000
#: Words longer than this are encoded each time.
CACHE_CHARS = 100
#: Long-settled blocks of Unicode, on whose classes the library and Python agree (tested for every code point).
SETTLED = ((0, 0x52F), (0x531, 0x556), (0x5D0, 0x5EA), (0x620, 0x64A), (0x2000, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
UNSETTLED = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SETTLED) + "]")
#: The splitting patterns of the two vocabularies.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Spaces to Python's str.split that are no spaces to the library, and how text that has them splits.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile(r"[^\S\x1c-\x1f]+")


def odd_pattern(special) -> str:
    """RE2 pattern of texts that don't simply split at white space: special strings, unsettled characters, separators."""
    return "|".join(["[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SETTLED) + "]", "[\\x1c-\\x1f]", *map(re.escape, special)])


class Remembered(dict):
    """A bounded dict that makes missing values with a function.

    When it is full, the fixed values and the first part of the others stay: frequent words are met early.
    """

    def __init__(self, make, fixed=None, limit: int = CACHE_WORDS):
        super().__init__(fixed or {})
        self.make, self.n_fixed, self.limit = make, len(self), limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.limit + self.n_fixed:
                self.shrink()
            self[key] = value
        return value

    def shrink(self) -> None:
        first = list(itertools.islice(self.items(), self.n_fixed + self.limit // 3))
        self.clear()
        self.update(first)

    def room(self, keys: set[str]) -> list[str]:
        """Those of keys that are missing, after making room for them."""
        new = list(itertools.filterfalse(self.__contains__, keys))
        if len(self) + len(new) > self.n_fixed + self.limit:
            self.shrink()
            new = list(itertools.filterfalse(self.__contains__, keys))
        return new


def released() -> None:
    """Gives memory that a task has freed back to the machine: a worker process lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


def splitter(strings) -> re.Pattern | None:
    """A pattern that splits text at special strings and keeps them; the longest wins at a place."""
    ordered = sorted(strings, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, ordered)) + ")") if ordered else None


def visible_bytes() -> list[str]:
    """The visible character of each byte in a byte-level vocabulary: its own if printable in Latin-1, else the next from U+0100."""
    hidden = iter(range(256, 512))
    return [chr(b) if b in range(0x21, 0x7F) or b in range(0xA1, 0xAD) or b in range(0xAE, 0x100) else chr(next(hidden)) for b in range(256)]


def byte_mapped():
    """A function from text to the library's visible form of its UTF-8 bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    mapped = ByteLevel(add_prefix_space=False, use_regex=False)
    return lambda s: mapped.pre_tokenize_str(s)[0][0]


def lowered(text: str) -> str:
    """Lower case by code point, without Python's special final sigma."""
    return text.replace("Σ", "σ").lower()


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)
