"""Record streams: DataFrames of (stream, line_no, line), line_no dense from 1 inside a stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.runtime import read, ship

EVENT = "concat_ws(' ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), user_id, event_type, value, props)"


def latin1(c: Column) -> Column:
    """One character for each byte of UTF-8, so that string functions count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def numbered(df: DataFrame, stream: Column, order: list, line: Column) -> DataFrame:
    """Number records by `order` inside each stream, without one task for a long stream.

    Records are range-partitioned by (stream, order); counts of the partitions before and a window inside a partition
    give the number. The partition's id is a written column, so that a repeated task changes nothing.
    """
    from strandlog.runtime import cut

    keys = [f"o{i}" for i in range(len(order))]
    rows = df.select(stream.cast("string").alias("stream"), *[o.alias(k) for o, k in zip(order, keys, strict=True)], F.coalesce(line, F.lit("")).alias("line"))
    rows = cut(rows.repartitionByRange("stream", *keys).withColumn("part", F.spark_partition_id()), "numbered")
    inside = F.row_number().over(Window.partitionBy("stream", "part").orderBy(*keys, "line"))
    counts = rows.groupBy("stream", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(F.col("stream").alias("s"), F.col("part").alias("p"), before.alias("before"))
    at = rows.withColumn("inside", inside)
    return at.join(first, at["stream"].eqNullSafe(first["s"]) & (at["part"] == first["p"])).select("stream", (F.col("before") + F.col("inside")).cast("long").alias("line_no"), "line")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a service log: event_id is dense from 0 and gives the order."""
    return read(spark, sf_dir, "events").select(F.lit("events").alias("stream"), (F.col("event_id") + 1).alias("line_no"), F.expr(EVENT).alias("line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a stream of its lines; a final line feed makes no line."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.when(F.col("text").endswith("\n"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream"), F.posexplode(kept).alias("p", "line")).select("stream", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a stream of its turns."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream"), number.cast("long").alias("line_no"), F.concat_ws(" ", "role", "text").alias("line"))


def page_lines(spark: SparkSession, sf_dir: str, column: str = "html") -> DataFrame:
    """One stream of pages (or of their URLs, column="url")."""
    return numbered(read(spark, sf_dir, "pages"), F.lit(column), [F.col("page_id")], F.col(column))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (compressed ones by their suffix), each file a stream, in the order of the file.

    Only line feeds end lines. Large files are read in splits: lines are numbered inside a split as its task reads
    them, and the lines of a file's earlier splits, counted by a first scan, are added. That table has a row for each
    split; Spark broadcasts it while it is small by its threshold, and else deals lines by split.
    """
    ship(spark)
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("stream"), F.col("_metadata.file_block_start").alias("split"), "value")

    def number(batches):
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            code = pc.dictionary_encode(b.column(0)).indices.to_numpy()
            split = b.column(1).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (split[1:] != split[:-1])]))
            size = np.diff(np.append(begin, b.num_rows))
            before = np.zeros(len(begin), np.int64)
            if (b.column(0)[0].as_py(), int(split[0])) == last:
                before[0] = n
            no = np.arange(1, b.num_rows + 1) - np.repeat(begin - before, size)
            last, n = (b.column(0)[-1].as_py(), int(split[-1])), int(no[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(no, pa.int64()), b.column(2)], ["stream", "split", "inside", "line"])

    counts = rows.groupBy("stream", "split").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("stream").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("stream", "split", earlier.alias("earlier"))
    inside = rows.mapInArrow(number, "stream string, split long, inside long, line string")
    return inside.join(offsets, ["stream", "split"]).select("stream", (F.col("earlier") + F.col("inside")).alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """A stream's lines as text, in order; one file for each stream."""
    lines.repartition("stream").sortWithinPartitions("stream", "line_no").select("line", F.coalesce("stream", F.lit("none")).alias("stream")).write.partitionBy("stream").text(path)


def block_of(line_no: Column, size: int) -> Column:
    if size < 1:
        raise ValueError("a block has at least one line")
    return F.floor((line_no - 1) / size).cast("long")
