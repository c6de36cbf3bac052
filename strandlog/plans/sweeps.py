"""Parameter sweeps and the analytics of their results, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators import blocks
from strandlog.operators.window import nearest
from strandlog.runtime import cut


def ratio(original: Column, compressed: Column) -> Column:
    return F.when(compressed == 0, 0.0).otherwise(original / compressed)


def speed(size: Column, seconds: Column, unit: int = 1 << 20) -> Column:
    """Size per second in units (2^20 bytes; some tables take 10^6)."""
    return F.when(seconds == 0, 0.0).otherwise(size / F.lit(unit) / seconds)


def thresholds(lines: DataFrame, distances: tuple[str, ...], steps: int = 50, window: int = 8, q: int = 3) -> DataFrame:
    """(distance, step, matched) for thresholds step / steps: distances are computed once."""
    found = None
    for name in distances:
        one = nearest(lines, window, name, q).filter("begin >= 0").select(F.lit(name).alias("measure"), "distance")
        found = one if found is None else found.union(one)
    # Each line counts from the first step above its distance on.
    first = found.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    counts = first.groupBy("measure", "step").agg(F.sum((F.col("distance") < F.col("step") / steps).cast("long")).alias("matched"))
    return counts


def windows(lines: DataFrame, sizes: list[int], distance: str = "cosine", q: int = 3, threshold: float = 0.3) -> DataFrame:
    """(window, matched) by window size."""
    out = None
    for w in sizes:
        one = nearest(lines, w, distance, q, threshold).agg(F.lit(w).alias("window"), F.sum(F.col("is_match").cast("long")).alias("matched"))
        out = one if out is None else out.union(one)
    return out


def grams(lines: DataFrame, sizes: list[int], window: int = 1, threshold: float = 0.3) -> DataFrame:
    """(q, matched) by size of grams."""
    out = None
    for q in sizes:
        one = nearest(lines, window, "cosine", q, threshold).agg(F.lit(q).alias("q"), F.sum(F.col("is_match").cast("long")).alias("matched"))
        out = one if out is None else out.union(one)
    return out


def block_sizes(lines: DataFrame, sizes: list[int]) -> DataFrame:
    """(block_size, n_blocks, n_lines, n_bytes) by lines a block."""
    at = lines.select("stream", "line_no", F.octet_length("line").alias("b"), F.explode(F.array(*map(F.lit, sizes))).alias("block_size"))
    per = at.withColumn("block", F.floor((F.col("line_no") - 1) / F.col("block_size"))).groupBy("block_size", "stream", "block").agg(F.count("*").alias("n"), F.sum(F.col("b") + 1).alias("b"))
    return per.groupBy("block_size").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_lines"), F.sum("b").cast("long").alias("n_bytes"))


def data_sizes(lines: DataFrame, step: int = 500) -> DataFrame:
    """(size, n_bytes) of a stream's first `size` lines, for each multiple of the step up to its length."""
    each = lines.groupBy("stream", F.ceil(F.col("line_no") / step).alias("k")).agg(F.sum(F.octet_length("line") + 1).alias("b"), F.count("*").alias("n"))
    upto = F.sum("b").over(Window.partitionBy("stream").orderBy("k"))
    return each.withColumn("n_bytes", upto.cast("long")).filter(F.col("n") == step).select((F.col("k") * step).alias("size"), "n_bytes")


def compressed_sizes(lines: DataFrame, **how) -> DataFrame:
    """(n_lines, n_blocks, n_delta, raw_bytes, coded_bytes, payload_bytes, ratio) of a compression."""
    b = blocks.compress(lines, **how)
    out = b.agg(F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_blocks"), F.sum("n_delta").alias("n_delta"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("coded_bytes").alias("coded_bytes"), F.sum(F.length("payload")).alias("payload_bytes"))
    return out.withColumn("ratio", ratio(F.col("raw_bytes"), F.col("payload_bytes")))


def orders(lines: DataFrame, make, **how) -> DataFrame:
    """(record_order, ...) of a compression with lines as they are, sorted by content, and shuffled by hash.

    make(df, order columns) numbers lines anew.
    """
    whole = cut(lines)
    ways = {"original": whole, "restructured": make(whole, [F.col("line"), F.col("line_no")]), "shuffled": make(whole, [F.xxhash64("line_no", F.lit(8)), F.col("line_no")])}
    out = None
    for name, df in ways.items():
        one = compressed_sizes(df, **how).select(F.lit(name).alias("record_order"), "*")
        out = one if out is None else out.union(one)
    return out


def wide_to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, metric, value); missing values stay."""
    return df.unpivot([key], columns, "metric", "value")


def long_to_wide(df: DataFrame, key: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(metric, metrics).agg(F.first(value))


def write_csv(df: DataFrame, path: str) -> None:
    """A result table with its header, in one file."""
    df.coalesce(1).write.option("header", True).csv(path)
