"""Analytics over point sets on Spark: distance joins, pair counts, clustering, box sums, forces, resampling and sky helpers."""
