"""Near-duplicate documents by SimHash, linked through anchor points of a covering code.

A fingerprint has one bit for each of 64 places: 1 if that bit is set in over half of the XXH64 hashes of the
document's word shingles. Fingerprints that differ in at most two bits are linked.

Anchors. The 64 bits are two halves of 32, of which 31 take part. The perfect Hamming code of length 31 has 2^26
codewords, the anchors of a half; every 31-bit word is within covering radius 1 of exactly one (its home). Two
fingerprints within two bits differ in at most one bit of at least one half. There the home of the one is at most
1 + 1 = 2 bits from the other. So each fingerprint goes to its two homes, and is replicated to every anchor within
radius + 1 = 2 (at most 16 in a half); comparing homes with replicas anchor by anchor finds every link. Only distinct
fingerprints take part: each has at most 64 + 2016 others within two bits, so the links stay linear in their
number. The pairs compared do not: n distinct fingerprints meet about 2 * 16 * n / 2^26 replicas each, more than one
beyond some millions of them, so that comparing grows with n^2 from about 10^8 on; longer halves would be needed there.

Edge cases: null text counts as empty; a text without words has fingerprint 0 and links like any other; equal
fingerprints are linked; rows that share a doc_id are rows of one document and get the component of their own text; a
null doc_id never names a component unless all of it has none. An empty table gives an empty result. Other columns of
the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.graph import components
from strandlog.runtime import cut, fresh_name, ship

_BLOCK = 1 << 16
_BITS = 31
_LOW = (1 << _BITS) - 1


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not parts:
        return 0
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    k = min(words, len(parts))
    n = len(parts) - k + 1
    digest, begin, end = xxhash.xxh64_intdigest, begin[:n].tolist(), end[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        h = np.array([digest(line[s:e], seed) for s, e in zip(begin[i : i + _BLOCK], end[i : i + _BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp as signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the numbers (1 to 31) of the places that are set."""
    s = np.zeros(len(x), np.int64)
    for i in range(_BITS):
        s ^= ((x >> i) & 1) * (i + 1)
    return s


def _flip(s: np.ndarray) -> np.ndarray:
    """A mask with place s set; none for 0."""
    return np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)


def homes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor, and the index of its fingerprint, for the home anchors."""
    key, at = [], []
    for half in (0, 1):
        x = (fp >> (32 * half)) & _LOW
        key.append((x ^ _flip(_syndrome(x))) | (half << _BITS))
        at.append(np.arange(len(fp)))
    return np.concatenate(key), np.concatenate(at)


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and index for all anchors within two bits in a half."""
    key, at = [], []
    every = np.arange(len(fp))
    for half in (0, 1):
        x = (fp >> (32 * half)) & _LOW
        s = _syndrome(x)
        key.append((x ^ _flip(s)) | (half << _BITS))
        at.append(every)
        for i in range(1, _BITS + 1):
            j = s ^ i
            ok = (s > 0) & (j > i)  # two places whose numbers give the syndrome
            y = x[ok] ^ (np.int64(1) << np.int64(i - 1)) ^ _flip(j[ok])
            key.append(y | (half << _BITS))
            at.append(every[ok])
    return np.concatenate(key), np.concatenate(at)


def _spread(fps: DataFrame, where, name: str) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 20_000):
                part = fp[i : i + 20_000]
                key, at = where(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], ["anchor", name])

    return fps.select("fp").mapInArrow(run, f"anchor long, {name} long")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints within the distance (2 at most, by the anchors' reach)."""
    if not 0 <= distance <= 2:
        raise ValueError("the anchors reach two bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    left, right = _spread(fps, homes, "a"), _spread(fps, replicas, "b")
    return left.hint("merge").join(right, (left["anchor"] == right["anchor"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable) for every row."""
    base = cut(fingerprints(docs, words, seed), "simhash")
    fps = cut(base.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    label = components(links(fps, distance))
    named = fps.join(label, fps["fp"] == label["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "simhash-roots")
    smallest = cut(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-min")
    per_fp = cut(named.join(smallest, "root").select("fp", "component_id"), "simhash-component")
    return base.join(per_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (null last), then by a hash of the text."""
    cols = docs.columns
    row = fresh_name(cols, "row")
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    label = near_duplicates(docs.select(F.col(row).alias("doc_id"), "text"), words, distance).select(F.col("doc_id").alias("at"), "component_id")
    doc = F.col("doc_id").cast("long")
    first = F.struct(doc.isNull().alias("none"), doc.alias("doc"), F.xxhash64("text").alias("tie"), F.col(row).alias("row"))
    ranks = docs.select(F.col(row).alias("is"), first.alias("first")).join(label, F.col("is") == F.col("at"))
    stay = cut(ranks.groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.row").alias("stays")), "simhash-stays")
    return docs.join(stay, docs[row] == stay["stays"], "left_semi").select(*cols)
