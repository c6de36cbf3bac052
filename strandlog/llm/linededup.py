"""Line deduplication over a corpus.

Lines are exploded, normalised (ASCII blanks stripped at both ends, A-Z lower-cased) and hashed to 128 bits, with the
positions of each hash in its text; a hash found in enough distinct documents is dropped everywhere but in the largest
doc_id that holds it. The positions of a text's dropped lines are gathered, and the text is put together again from the
lines at all other positions. Only hashes, doc_ids and positions are shuffled by hash; texts move once, by doc_id. Documents per hash are counted over distinct (hash, doc_id), so that a line that a third of the corpus holds
is pre-aggregated; the join of lines with the frequent hashes starts from written tables, so that adaptive execution
splits a hot hash.

Edge cases: null or empty text is one empty line; a text all of whose lines go becomes empty; rows with the same
doc_id are one document for counting and, told apart by a hash of the text, each is rewritten by itself; a null doc_id counts as one document below all
others. An empty table gives an empty one. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.tokens import drop_table, give_back
from strandlog.runtime import cut, fresh_name, ship

BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, least: int) -> list[tuple[int, bytes]]:
    """(position, hash) of the lines whose key has at least so many code points."""
    out = []
    for i, line in enumerate((text or "").encode().lower().split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            out.append((i, hashlib.md5(key, usedforsecurity=False).digest()))
    return out


def _exploded(docs: DataFrame, least: int) -> DataFrame:
    def run(batches):
        drop_table()
        for b in batches:
            ids, ties, keys, places = [], [], [], []
            for d, t, tie in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by: dict[bytes, list[int]] = {}
                for i, k in line_keys(t, least):
                    by.setdefault(k, []).append(i)
                ids += [d] * len(by)
                ties += [tie] * len(by)
                keys += by.keys()
                places += by.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], ["doc", "tie", "key", "places"])
            del ids, ties, keys, places
            give_back()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc long, tie long, key binary, places array<int>")


def _drops(docs: DataFrame, least: int, documents: int) -> DataFrame:
    """(doc, tie, places): for each text the positions of the lines that it loses."""
    lines = cut(_exploded(docs, least), "lines")
    held = lines.select("doc", "key").distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    often = cut(held.filter(F.col("n") >= documents).select("key", "keeper"), "often")
    lost = lines.join(often, "key").filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc", "tie").agg(F.flatten(F.collect_list("places")).alias("places"))


def _apply(docs: DataFrame, least: int, documents: int, finish: Callable, schema) -> DataFrame:
    """finish(batch, texts, n_lines, n_dropped) makes the output batch from the input's columns."""
    ship(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    cols = docs.columns
    gone, doc, tie = (fresh_name(cols, x) for x in ("gone", "doc", "tie"))
    drops = _drops(docs, least, documents).select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("places").alias(gone))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(tie))
    joined = docs.join(drops, same, "left").select(*cols, gone)
    at = cols.index("text")

    def run(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            for t, g in zip(b.column(at).to_pylist(), b.column(len(cols)).to_pylist(), strict=True):
                if not g:
                    texts.append(t)
                    lines.append((t or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                bad = set(g)
                parts = (t or "").split("\n")
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in bad))
                lines.append(len(parts))
                dropped.append(len(bad))
            yield finish(b, texts, lines, dropped)
            del texts, lines, dropped
            give_back()

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """docs with frequent lines taken out of text; all columns stay."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema, at = T.StructType(docs.schema.fields), docs.columns.index("text")

    def finish(b, texts, lines, dropped):
        cols = [b.column(i) if i != at else pa.array(texts, b.column(i).type) for i in range(len(schema))]
        return pa.RecordBatch.from_arrays(cols, schema.names)

    return _apply(docs, least, documents, finish, schema)


def line_report(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text's SHA-256 for every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def finish(b, texts, lines, dropped):
        sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _apply(slim, least, documents, finish, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
