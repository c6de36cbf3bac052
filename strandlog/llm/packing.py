"""Best-fit-decreasing packing of token sequences.

Documents are tokenised, an end id is added, and those over the capacity are cut into pieces. Pieces go in falling
order of length into the open sequence with the least room that is enough. Equal lengths are interchangeable, so the
plan needs only the number of pieces of each length (at most `capacity` numbers, whatever the corpus) and runs of open
sequences by room: a segment tree over the rooms finds the tightest in logarithmic time, and one step places all
pieces that the same run of sequences takes. The outcome is that of placing them one by one. The plan is a list of
runs of ranks; each piece's rank among its length is counted over hash buckets, so that a length that a third of all
pieces have is spread over tasks, and each task looks its pieces' ranks up in the plan.

Edge cases: null text is empty and its document is just the end id; a document of exactly the capacity is one piece;
rows that repeat a doc_id are documents of their own; which of several pieces of one length gets which place follows
hash bucket, doc_id, piece and content. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.tokens import give_back, slices, table
from strandlog.runtime import cut, ship

#: Pieces of one hash bucket, on average, within which ranks are counted by sorting.
BUCKET = 20_000
#: Rows and bytes of texts that are encoded at once: fewer than `tokens.PART`, for the memory that encoding takes.
PART = (8192, 2 << 20)


class Rooms:
    """Segment tree over rooms 0 to size: which rooms open sequences have, and the least room that is enough."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.any = [False] * (2 * self.n)

    def set(self, room: int, there: bool) -> None:
        i = room + self.n
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room >= least that is there."""
        i = least + self.n
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces, pieces a sequence, first sequence, offset) for so many pieces of each length."""
    tree, runs = Rooms(capacity), {}
    out, opened = [], 0

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                room, first, n = capacity, opened, -(-left // each)
                opened += n
            else:
                each = room // length
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    tree.set(room, False)
            used = min(n, -(-left // each))
            put = min(left, used * each)
            out.append((length, rank, put, each, first, capacity - room))
            rank, left = rank + put, left - put
            rest = put - (used - 1) * each  # in the last sequence used
            give(room - each * length, first, used - 1)
            give(room - rest * length, first + used - 1, 1)
            give(room, first + used, n - used)
    return np.array(out, np.int64).reshape(-1, 6)


def place(rules: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    if not len(length):
        return length, length
    rules = rules[np.lexsort((rules[:, 1], rules[:, 0]))]
    span = int(rules[:, 1].max()) + int(rules[:, 2].max()) + 1
    at = np.searchsorted(rules[:, 0] * span + rules[:, 1], length * span + rank, side="right") - 1
    r = rules[at]
    k = rank - r[:, 1]
    return r[:, 4] + k // r[:, 3], r[:, 5] + k % r[:, 3] * length


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of the tokenised documents."""
    ship(docs.sparkSession)
    tail, step = np.array([end], "<u4").tobytes(), 4 * capacity

    def run(batches):
        words = table(path)
        for b in batches:
            for i, texts in slices(b.column(1), *PART):
                rows = []
                for d, ids in zip(b.column(0).slice(i, len(texts)).to_pylist(), words.encode(texts), strict=True):
                    ids += tail
                    rows += [(d, at // step, at // 4, (min(len(ids), at + step) - at) // 4, zlib.crc32(ids[at : at + step])) for at in range(0, len(ids), step)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c == 1 else pa.int64()) for c in range(5)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                del rows
                give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (a written table with length and the columns of `pieces`) with sequence_id and offset."""
    ship(pieces.sparkSession)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rules, total = plan(counts, capacity), sum(counts.values())
    buckets = max(64, -(-total // BUCKET))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("inside", inside).join(first.hint("merge"), ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("inside")).alias("rank"))
    names, at = [*pieces.columns, "sequence_id", "offset"], pieces.columns.index("length")

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (at, len(b.columns) - 1))
            where, offset = place(rules, length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(where), pa.array(offset)], names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{types}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return assign(cut(pieces(docs, path, capacity, end), "pieces"), capacity)
