"""Exact top-k inner products by vector-approximation files.

Components are scaled to integers, floor(scale * x). The approximation file holds each vector's components in cells of
a power-of-two width; cells give, for every query, an upper and a lower bound of the inner product: the product with
the cells' middles, plus or minus half a cell's width times the sum of the query's magnitudes. The exact vectors lie in
another table, a row for each.

Scan: blocks of cells meet blocks of queries; a task carries each query's k best lower bounds from block to block, and a
candidate leaves a block if its upper bound reaches the k-th of them. Of these, those below the k-th best lower bound
over all blocks go. Read: for each query the exact
vectors of the READ * k candidates of the highest upper bounds (the smallest, as distances) are read; then the rest of
those whose upper bound reaches the k-th best exact score, after which no other can be among the k best. Vectors that
are no candidate are never read exactly; `exact_reads` tells how many were, for each query.

Cells are packed into blocks of a fixed size, queries into larger ones. A pair of a query block and a group of GROUP
blocks is a key of the join, so that neither a query block nor the file is one key's; nothing is broadcast. Exact
vectors are joined by their row, from written tables, so that adaptive execution splits a row that many queries ask for.

Edge cases: a vector that is null or empty or holds null or non-finite components takes no part; vectors meet those of
their own length only; fewer than k others give all; ties go to the smaller vec_id; rows that repeat a vec_id are all
candidates, save for queries of that id, and the smallest of their vectors is the query; a null vec_id takes no part.
Components beyond what exact products of doubles allow raise ValueError. Empty tables give empty results; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.runtime import cut, ship

#: Vectors of a block, queries of a query block, queries that are scanned at once, blocks of a group.
BLOCK, QUERIES, STEP, GROUP = 8192, 16384, 256, 16
#: Candidates of a query whose exact vectors are read first, in multiples of k.
READ = 2

_TYPES = {"block": pa.int64(), "dim": pa.int32(), "ids": pa.binary(), "vectors": pa.binary()}
_FOUND = ["query_id", "block", "place", "vec_id", "upper", "lower"]


def _integers(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    v = np.floor(scale * flat).reshape(-1, dim)
    top = float(np.abs(v).max(initial=0))
    if top >= 2**31 or top**2 * dim >= 2**53:
        raise ValueError("components are too large for exact products of doubles")
    return v.astype("<i4")


def _packed(rows: DataFrame, scale: int, cell: int | None, size: int) -> DataFrame:
    """Blocks (block, dim, ids, vectors) of up to so many vectors of one partition and length; of their cells, if a width is given."""

    def run(batches):
        part, seq, open_ = TaskContext.get().partitionId(), 0, {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal seq
            ids, vectors = open_.pop(dim)
            v = np.concatenate(vectors)
            if cell is not None:
                v = v >> cell  # [c, c + 1) * 2^cell
                v = v.astype("<i1") if v.min() >= -128 and v.max() <= 127 else v
            row = {"block": part << 32 | seq, "dim": dim, "ids": np.concatenate(ids).astype("<i8").tobytes(), "vectors": v.tobytes()}
            seq += 1
            return pa.RecordBatch.from_pylist([row], pa.schema(_TYPES))

        for b in batches:
            ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            lens = np.diff(ends)
            for dim in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dim)
                v = _integers(flat[(ends[at][:, None] + np.arange(dim)).reshape(-1)], dim, scale)
                done = 0
                while done < len(at):
                    held = open_.setdefault(dim, ([], []))
                    take = min(size - sum(map(len, held[0])), len(at) - done)
                    held[0].append(ids[at[done : done + take]])
                    held[1].append(v[done : done + take])
                    done += take
                    if sum(map(len, held[0])) == size:
                        yield close(dim)
        for dim in sorted(open_):
            yield close(dim)

    return rows.mapInArrow(run, "block long, dim int, ids binary, vectors binary")


def _exact(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, exact): each vector's integers, 4 bytes each."""

    def run(batches):
        for b in batches:
            ends, flat = b.column(1).offsets.to_pylist(), b.column(1).values.to_numpy(zero_copy_only=False)
            made = [_integers(flat[s:e], e - s, scale).tobytes() for s, e in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.array(made, pa.binary()), *b.columns[2:]], ["vec_id", "exact", "row"])

    return rows.mapInArrow(run, "vec_id long, exact binary, row long")


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, cells: np.ndarray, best: np.ndarray, cell: int):
    """(query position, place in the block, upper bound, lower bound) of a block's candidates for each query.

    best (queries, k) holds the highest lower bounds of the blocks before, -inf where there are fewer; it is brought up to date.
    """
    wide, k = float(1 << cell), best.shape[1]
    middle = (cells.astype(np.float64) + 0.5) * wide - 0.5  # integers of a cell: low * w .. low * w + w - 1
    out = []
    for a in range(0, len(q), STEP):
        part = q[a : a + STEP].astype(np.float64)
        slack = (wide - 1) / 2 * np.abs(part).sum(axis=1, keepdims=True)
        centre = part @ middle.T
        centre[q_ids[a : a + STEP, None] == ids[None, :]] = -np.inf
        kk = min(k, centre.shape[1])
        low = np.partition(centre, centre.shape[1] - kk, axis=1)[:, centre.shape[1] - kk :] - slack
        top = np.concatenate([best[a : a + STEP], low], axis=1)
        best[a : a + STEP] = np.partition(top, kk, axis=1)[:, kk:]
        floor = best[a : a + STEP].min(axis=1, keepdims=True)
        r, c = np.nonzero((centre + slack >= floor) & (centre > -np.inf))
        out.append((r + a, c, centre[r, c] + slack[r, 0], centre[r, c] - slack[r, 0]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _scored(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of (query_id, vec_id, a, b), a and b exact vectors."""

    def run(batches):
        for b in batches:
            score = [int(np.frombuffer(x, "<i4").astype(np.int64) @ np.frombuffer(y, "<i4").astype(np.int64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "a", "b").mapInArrow(run, "query_id long, vec_id long, score long")


def _kth(rows: DataFrame, score: str, k: int, name: str) -> DataFrame:
    """(of, name): the k-th highest score of each query that has so many."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score)))
    best = rows.select("query_id", score, rank.alias("rank")).filter(F.col("rank") <= k)
    return best.filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col(score).alias(name))


def candidates(rows: DataFrame, queries: DataFrame, k: int, scale: int, cell: int) -> DataFrame:
    """(query_id, block, place, vec_id, upper, lower): the candidates of the scan, from (vec_id, embedding)."""
    blocks = cut(_packed(rows, scale, cell, BLOCK), "va-file")
    asks = cut(_packed(queries, scale, None, QUERIES), "va-queries")
    names = [r["block"] for r in asks.select("block").collect()]  # one for each block of thousands of queries
    n = max(1, -(-blocks.count() // GROUP))
    group = F.pmod(F.xxhash64("block"), F.lit(n))
    left = blocks.select(F.explode(F.lit(names).cast("array<long>")).alias("ask"), group.alias("group"), "block", "dim", "ids", "vectors")
    right = asks.select(F.col("block").alias("ask"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("group"))
    both = left.hint("merge").join(right, ["ask", "group"]).filter("dim = q_dim").select("ask", "block", "dim", "ids", "vectors", "q_ids", "q")

    def run(batches):
        last, best = None, None
        for b in batches:
            for ask, block, dim, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, q_ids = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[2], "<i8")
                cells = np.frombuffer(raw[1], "<i1" if len(raw[1]) == len(ids) * dim else "<i4").reshape(-1, dim)
                if ask != last:  # rows come in the order of the join's keys
                    last, best = ask, np.full((len(q_ids), k), -np.inf)
                at, place, upper, lower = scan(q_ids, np.frombuffer(raw[3], "<i4").reshape(-1, dim), ids, cells, best, cell)
                for s in range(0, len(at), 1 << 16):
                    e = s + (1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[at[s:e]], np.full(len(at[s:e]), block), place[s:e], ids[place[s:e]], upper[s:e], lower[s:e])], _FOUND)

    return both.mapInArrow(run, "query_id long, block long, place long, vec_id long, upper double, lower double")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, cell: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score, exact_reads: the k best of all other rows for every row whose vec_id `every` divides."""
    ship(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).filter(fine)
    wanted = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    parts = max(1, -(-rows.filter(F.col("vec_id") % every == 0).count() // QUERIES))
    # Rows are told apart by vec_id and content, as a vec_id may be repeated: copies have the same score.
    queries = cut(wanted.repartition(parts), "va-wanted")
    found = cut(candidates(rows, queries, k, scale, cell), "va-found")
    bound = _kth(found, "lower", k, "least")
    kept = found.join(bound, found["query_id"] == bound["of"], "left").filter("least is null or upper >= least")
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "block", "place")
    kept = cut(kept.select("query_id", "vec_id", "upper", F.row_number().over(order).alias("at")), "va-kept")

    ask = cut(_exact(queries.select("vec_id", "embedding", F.lit(0).cast("long").alias("row")), scale).select(F.col("vec_id").alias("q"), F.col("exact").alias("a")), "va-ask")
    needed = cut(kept.select("vec_id").distinct(), "va-needed")
    number = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    some = rows.join(needed, "vec_id", "left_semi").select("vec_id", "embedding", number.cast("long").alias("row"))
    there = cut(_exact(some, scale).select(F.col("vec_id").alias("v"), F.col("exact").alias("b"), "row"), "va-exact")
    # Of a vec_id's rows each is a candidate by its own bounds; read together, they are told apart by their number.
    mine = kept.groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper"), F.min("at").alias("at"), F.count("*").alias("copies"))

    def read(which: DataFrame) -> DataFrame:
        pairs = which.hint("merge").join(ask, which["query_id"] == ask["q"]).hint("merge").join(there, F.col("vec_id") == there["v"])
        return _scored(pairs.filter(F.length("a") == F.length("b")))

    mine = cut(mine, "va-mine")
    first = cut(read(mine.filter(F.col("at") <= READ * k)), "va-first")
    kth = _kth(first, "score", k, "least")
    later = mine.filter(F.col("at") > READ * k)
    later = later.join(kth, later["query_id"] == kth["of"], "left").filter("least is null or upper >= least").select(*mine.columns)
    scores = cut(first.union(read(later)), "va-scores")
    reads = scores.groupBy(F.col("query_id").alias("of")).agg(F.count("*").alias("exact_reads"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scores.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(reads, best["query_id"] == reads["of"]).select("query_id", "rank", "vec_id", "score", "exact_reads")
