"""Near copies by SimHash anchors, and by the Jaccard index of word shingles: candidates by MinHash bands, each checked exactly.

With `bits`, texts whose SimHash fingerprints (those of op1) differ in so many bits or fewer are linked first, through the
anchors of `simhash.links`; copies by Jaccard index are then looked for where these links leave several components. Two
bits miss most pairs at an index of 0.8, and such an index misses long texts with repeats that are within two bits, so
that each finds what the other doesn't.

A text's set holds the XXH64 hashes of its shingles of WORDS words. Texts of one set are one node. A node has BANDS
keys, each of ROWS minima of the set under different bijections of the hashes; two sets of index j share a key with
probability 1 - (1 - j^ROWS)^BANDS, so that a pair at 0.8 has none with probability 1.3e-7. Nodes that share a key are
a bucket. Links are pairs of a bucket whose exact index is LEAST or more.

A bucket's pairs aren't all made. In each of HUBS rounds every node of a bucket is compared with the bucket's hub if they
aren't connected yet, and the links found are joined to components. The first hub is the node whose buckets hold the
most nodes together, which is the text that a group's copies were made from if it is there; later ones have the
smallest hash, which changes by round.
Then the nodes of all buckets that still hold several components are compared by prefixes: of a node's n hashes, ordered
from the rarest among these nodes to the most frequent, two sets of n and m hashes and an index of 4/5 or more have
o = ceil(4(n + m)/9) or more in common, so that they share one among the first n - o + 1 and m - o + 1. Nodes that do,
and are of different components, are checked. So no pair at LEAST or more is left out, a large group of near copies costs a few comparisons a node, and
texts that only share a frequent passage aren't compared, as its hashes come last.

Texts aren't shuffled: rows whose sets are needed, and rows that stay, are found again by marks of their ids (`marks`).

Edge cases: as in simhash, null text counts as empty; texts without words are one set; shorter texts than WORDS words
have one shingle. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm import simhash
from strandlog.llm.graph import components
from strandlog.llm.marks import among, mark, marked
from strandlog.llm.tokens import drop_table, give_back
from strandlog.runtime import cut, fresh_name, ship

WORDS, BANDS, ROWS, HUBS = 5, 40, 5, 3
#: The least Jaccard index of a link, as a fraction.
LEAST = (4, 5)
_BLOCK = 1 << 12
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    k = min(words, len(parts))
    n = len(parts) - k + 1
    begin, end = (end - size)[:n].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], seed) for s, e in zip(begin, end, strict=True)), np.uint64, n))


def band_keys(held: np.ndarray) -> list[int]:
    """The keys of a set of hashes, as signed longs."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(held), _BLOCK):
        np.minimum(low, (held[i : i + _BLOCK, None] * _FACTORS).min(axis=0), out=low)
    rows = low.astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(rows[8 * ROWS * j : 8 * ROWS * (j + 1)], j) for j in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard index is LEAST or more; two empty sets are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * LEAST[1] >= (len(a) + len(b) - common) * LEAST[0]


def _nodes(docs: DataFrame, row: str, bits: int | None) -> DataFrame:
    """(row, doc, tie, node, fp, keys) of every row; fp is null if fingerprints aren't asked for."""

    def run(batches):
        drop_table()
        for b in batches:
            node, fp, keys = [], [], []
            for t in b.column(3).to_pylist():
                held = shingles(t)
                node.append(_node(held))
                keys.append(band_keys(held))
                if bits is not None:
                    fp.append(simhash.fingerprint(t))
            node = pa.array(np.array(node, np.uint64).view(np.int64))
            fp = pa.nulls(len(node), pa.int64()) if bits is None else pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), node, fp, pa.array(keys, pa.list_(pa.int64()))], ["row", "doc", "tie", "node", "fp", "keys"])
            give_back()

    slim = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("tie"), "text")
    return slim.mapInArrow(run, "row long, doc long, tie long, node long, fp long, keys array<long>")


def _within_bits(base: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) of nodes that connect all whose fingerprints are equal or within so many bits: each fingerprint's
    nodes with the smallest of them, and the smallest ones of two fingerprints."""
    held = cut(base.select("node", "fp").distinct(), "near-fps")
    top = cut(held.groupBy("fp").agg(F.min("node").alias("top")), "near-tops")
    same = held.join(top, "fp").filter("node != top").select(F.col("node").alias("a"), F.col("top").alias("b"))
    near = cut(simhash.links(top, bits), "near-bits")
    end = lambda at, node: top.select(F.col("fp").alias(at), F.col("top").alias(node))
    both = near.join(end("a", "x"), "a").join(end("b", "y"), "b").filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return cut(same.union(both), "near-links")


def _node(held: np.ndarray) -> int:
    """The name of a set, unsigned."""
    return xxhash.xxh64_intdigest(held.astype("<u8").tobytes(), 1)


def _sets(texts: DataFrame) -> DataFrame:
    """(node, held) of the texts whose row ids are marked, from (row, text); row's metadata names the folder of marks.

    Marks are looked up where texts are read: a filter by `marked` before it would be a second Python step of the same
    task, with a worker of its own, and executors keep all their workers and use them in turn.
    """
    wanted = texts.schema["row"].metadata["marks"]

    def run(batches):
        for b in batches:
            known = among(wanted, b.column(0).to_numpy(zero_copy_only=False))
            held = [shingles(t) for t in b.column(1).filter(pa.array(known)).to_pylist()]
            node = np.array([_node(h) for h in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))], ["node", "held"])
            del held
            give_back()

    return texts.select("row", "text").mapInArrow(run, "node long, held array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""

    def run(batches):
        for b in batches:
            (p, q), n = [[x.values.to_numpy(zero_copy_only=False)[s:e] for x in [b.column(i)] for s, e in zip(x.offsets[:-1].to_pylist(), x.offsets[1:].to_pylist(), strict=True)] for i in (2, 3)], b.num_rows
            yield b.select([0, 1]).filter(pa.array([alike(p[i], q[i]) for i in range(n)], pa.bool_()))
            del p, q
            give_back()

    side = lambda at, held: sets.select(F.col("node").alias(at), F.col("held").alias(held))
    both = pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").select("a", "b", "p", "q")
    return both.mapInArrow(run, "a long, b long")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of (x, y)."""
    return cut(rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-pairs")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) of nodes (node, root) of different roots whose prefixes share a hash."""
    held = sets.join(nodes, "node").select("node", "root", F.size("held").alias("n"), F.explode("held").alias("hash"))
    held = cut(held, "near-hashes")
    often = cut(held.groupBy("hash").agg(F.count("*").alias("often")), "near-often")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "hash"))
    least, of = LEAST
    first = F.col("n") - F.ceil(F.col("n") * least / of) + 1  # for the smallest set that may be linked
    ranked = held.hint("merge").join(often, "hash").withColumn("rank", rank).filter((F.col("rank") <= first) & (F.col("often") > 1))
    prefix = cut(ranked.select("hash", "node", "root", "n", "rank"), "near-prefixes")
    other = prefix.select(F.col("hash").alias("same"), F.col("node").alias("y"), F.col("root").alias("its"), F.col("n").alias("m"), F.col("rank").alias("at"))
    common = F.ceil((F.col("n") + F.col("m")) * least / (least + of))
    fits = (F.col("node") < F.col("y")) & (F.col("root") != F.col("its")) & (F.col("rank") + common <= F.col("n") + 1) & (F.col("at") + common <= F.col("m") + 1)
    return prefix.hint("merge").join(other, (prefix["hash"] == other["same"]) & fits).select(F.col("node").alias("x"), "y")


def links(buckets: DataFrame, sets: DataFrame, found: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of all nodes with links, from (key, node, weight) and (node, held); `found` has links (a, b) that are known."""
    if found is not None and found.isEmpty():
        found = None
    label = None if found is None else components(found)
    for turn in range(HUBS + 1):
        if label is None:
            rows = buckets.withColumn("root", F.col("node"))
        else:
            rows = cut(buckets.join(label, "node", "left").select("key", "node", "weight", F.coalesce("root", "node").alias("root")), "near-rows")
        if turn < HUBS:
            hub = rows.groupBy("key").agg(F.min(F.struct((F.lit(0) if turn else -F.col("weight")).alias("w"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"))
            hub = cut(hub.filter("low != high").select(F.col("key").alias("at"), F.col("hub.node").alias("x"), F.col("hub.root").alias("top")), "near-hubs")
            pairs = _pairs(rows.join(hub, rows["key"] == hub["at"]).filter("root != top").select("x", F.col("node").alias("y")))
        else:
            mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
            some = cut(rows.join(mixed, "key", "left_semi").select("node", "root").distinct(), "near-rest")
            pairs = _pairs(_prefix_pairs(some, sets))
        if pairs.isEmpty():
            break
        new = cut(_verified(pairs, sets), "near-links")
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            label = components(found)
    return label


def keep_one(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """docs with one row of each component of near copies: the smallest doc_id (null last), then by text.

    With `bits` (2 at most), fingerprints within so many bits link texts as well.
    """
    ship(docs.sparkSession)
    cols = docs.columns
    row = fresh_name(cols, "row")
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    base = cut(_nodes(docs, row, bits), "near-nodes")
    first = cut(base.groupBy("node").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "tie", "row")).alias("first"), F.first("keys").alias("keys")), "near-first")
    keys = cut(first.select("node", F.explode(F.array_distinct("keys")).alias("key")), "near-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("at"), "n")
    buckets = cut(keys.join(shared, keys["key"] == shared["at"]).select("key", "node", "n"), "near-shared")
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    buckets = cut(buckets.drop("n").join(weight, "node").select("key", "node", "weight"), "near-buckets")
    wanted = mark(first.join(buckets.select("node").distinct(), "node", "left_semi").select("first.row"))
    sets = cut(_sets(docs.select(F.col(row).alias("row", metadata={"marks": wanted}), "text")), "near-sets")
    label = links(buckets, sets, None if bits is None else _within_bits(base, bits))
    roots = first.select("node", "first").withColumn("root", F.col("node"))
    if label is not None:
        roots = cut(first.join(label, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "near-roots")
    stay = cut(roots.groupBy("root").agg(F.min("first").alias("first")).select("first.row"), "near-stays")
    return docs.filter(marked(F.col(row), mark(stay))).select(*cols)
