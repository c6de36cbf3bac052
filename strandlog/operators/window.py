"""The sliding window over a stream's previous records: candidates, nearest record, edit scripts.

Records depend on raw earlier lines only, so a stream is cut into segments, and each segment gets the last `window`
lines before it as context. A segment is one key of a hash partitioning, sorted by line_no; a task reads its rows in
order and holds no more than the window. Results equal those of one pass over the stream, for any segment size; a
segment has at least WINDOWS windows, so that the context adds little. A null line counts as an empty one. Line numbers
may have gaps: the window holds the lines before, whatever their numbers, but the context of a segment is taken by
number, so streams with gaps are numbered anew first (`dense`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions import deltas
from strandlog.functions.distances import HASHES, Measure, cosine, gram_matrix, minhash_many
from strandlog.runtime import ship, width

SEGMENT, WINDOWS = 512, 8
#: Rows and, but for single lines, bytes that are looked at side by side; bytes up to which a matrix of grams is tried.
ROWS, BYTES, SHORT = 512, 1 << 24, 1 << 18
OPS = "array<struct<position:int,d_length:int,i_length:int,substr:binary>>"


def dense(lines: DataFrame) -> DataFrame:
    """lines numbered anew from 1 in the order of line_no."""
    from strandlog.sources.lines import numbered

    return numbered(lines, F.col("stream"), [F.col("line_no")], F.col("line"))


def check_window(window: int) -> int:
    if not 1 <= window <= 65535:
        raise ValueError("the window is 1 to 65535 lines")
    return window


def candidates(lines: DataFrame, window: int = 8) -> DataFrame:
    """(stream, line_no, line, begin, ref_no, ref) for each of the lines before, the oldest with begin 0: an equi-join on shifted numbers."""
    check_window(window)
    shifted = lines.select("stream", "line_no", "line", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("k")).withColumn("ref_no", F.col("line_no") - F.col("k")).filter("ref_no >= 1")
    older = lines.select("stream", F.col("line_no").alias("ref_no"), F.col("line").alias("ref"))
    begin = (F.least(F.lit(window).cast("long"), F.col("line_no") - 1) - F.col("k")).cast("int")
    return shifted.withColumn("begin", begin).join(older, ["stream", "ref_no"]).select("stream", "line_no", "line", "begin", "ref_no", "ref")


def segment_size(window: int, segment: int = SEGMENT) -> int:
    """Lines of a segment for a window: its context is a small part of it."""
    return max(segment, WINDOWS * window)


def _with_context(lines: DataFrame, window: int, segment: int, context: bool) -> DataFrame:
    seg = F.floor((F.col("line_no") - 1) / segment).cast("long")
    own = F.struct(seg.alias("seg"), F.lit(False).alias("context"))
    last = seg + F.ceil(F.lit(window) / segment).cast("long")
    later = F.transform(F.filter(F.sequence(seg + 1, last), lambda s: F.col("line_no") > s * segment - window), lambda s: F.struct(s.alias("seg"), F.lit(True).alias("context")))
    places = F.concat(F.array(own), later) if context else F.array(own)
    rows = lines.select("stream", "line_no", F.encode(F.coalesce("line", F.lit("")), "UTF-8").alias("line"), F.explode(places).alias("to"))
    rows = rows.select("stream", "to.seg", "line_no", "to.context", "line")
    # A fixed number of parts: rows are small for the work on them, and adaptive execution would join parts by their bytes.
    return rows.repartition(width(lines.sparkSession), "stream", "seg").sortWithinPartitions("stream", "seg", "line_no")


def choose(line: bytes, q: deque, measure: Measure, mine) -> tuple[int, float]:
    """(begin, distance) of the nearest record in the window, the oldest among equals; (-1, 1.0) if none is below 1."""
    begin, least = -1, 1.0
    for i, (other, its, _) in enumerate(q):
        d = measure.between(line, mine, other, its)
        if d < least:
            begin, least = i, d
            if d == 0.0 and measure.name == "minhash":
                break
    return begin, least


def match_line(line: bytes, q: deque, measure: Measure, mine, threshold: float) -> tuple[dict, bytes | None]:
    """The record of a line without a script, and the line it is to be written against, if there is one."""
    begin, distance = choose(line, q, measure, mine)
    matched = begin >= 0 and distance < threshold
    return {"begin": begin, "distance": distance, "matched": matched, "method": 1, "ops": None, "cost": None}, q[begin][0] if matched else None


def add_scripts(found: list[tuple[dict, bytes, bytes | None]], measure: Measure, approx: bool) -> list[dict]:
    """The records of `match_line`, each with its line and the older one, with scripts where these cost less than the line."""
    pairs = [(old, line) for _, line, old in found if old is not None]
    made = iter([deltas.approximate(*p, measure.q) for p in pairs] if approx else deltas.exact_many(pairs))
    for out, line, old in found:
        if old is not None:
            ops, out["cost"] = next(made)
            if out["cost"] <= len(line):
                out |= {"method": 0, "ops": ops}
    return [out for out, _, _ in found]


def encode_line(line: bytes, q: deque, measure: Measure, mine, threshold: float, approx: bool) -> dict:
    """The record of a line: method 0 with a script against the record at `begin`, or method 1, raw."""
    out, old = match_line(line, q, measure, mine, threshold)
    return add_scripts([(out, line, old)], measure, approx)[0]


def scan(batches: Iterator, window: int, measure: Measure):
    """(stream, seg, line_no, context, line, queue before it, what the measure prepared) of sorted rows."""
    last, q = None, deque(maxlen=window)
    for b in batches:
        for stream, seg, no, context, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (stream, seg) != last:
                last, q = (stream, seg), deque(maxlen=window)
            mine = measure.prepare(line)
            yield stream, seg, no, context, line, q, mine
            q.append((line, mine, no))


def _batches(rows: Iterator, schema: pa.Schema, size: int = 4096):
    some = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


class _Cosine:
    """Cosine distances inside a piece: by a matrix of grams, or line by line where that were too large."""

    def __init__(self, lines: list[bytes], measure: Measure):
        self.matrix = gram_matrix(lines, measure.q) if sum(map(len, lines)) <= SHORT else None
        if self.matrix is None:
            self.made = [measure.prepare(x) for x in lines]
        else:
            self.norm = np.einsum("ij,ij->i", self.matrix, self.matrix)

    def at(self, k: int) -> np.ndarray:
        """The distance of each line from the k-th on to the one k before it."""
        if self.matrix is None:
            return np.array([cosine(*a, *b) for a, b in zip(self.made, self.made[k:], strict=False)])
        old, new = self.norm[:-k], self.norm[k:]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1.0 - np.einsum("ij,ij->i", self.matrix[k:], self.matrix[:-k]) / (np.sqrt(old) * np.sqrt(new))
        return np.where((old == 0) | (new == 0), 1.0, d)


class _MinHash:
    """MinHash distances inside a piece, whose first lines' signatures are known."""

    def __init__(self, lines: list[bytes], measure: Measure, known: np.ndarray):
        self.made = np.concatenate([known, minhash_many(lines[len(known) :])])
        self.code = np.unique(np.array([*lines, None], object)[:-1], return_inverse=True)[1]
        self.short = np.fromiter(map(len, lines), np.int64, len(lines)) < max(1, measure.q)

    def at(self, k: int) -> np.ndarray:
        d = 1.0 - (self.made[k:] == self.made[:-k]).sum(axis=1) / HASHES
        d[self.short[k:] | self.short[:-k]] = 1.0
        d[self.code[k:] == self.code[:-k]] = 0.0
        return d


def _pieces(batches: Iterator, window: int):
    """Sorted rows in pieces, each with up to `window` rows of the piece before: (columns, rows that are repeated)."""
    kept: list[list] = [[], [], [], [], []]
    for b in batches:
        cols, at = [c.to_pylist() for c in b.columns], 0
        while at < b.num_rows:
            end, size = at, 0
            while end < b.num_rows and end - at < ROWS and (end == at or size + len(cols[4][end]) <= BYTES):
                size += len(cols[4][end])
                end += 1
            rows = [k + c[at:end] for k, c in zip(kept, cols, strict=True)]
            yield rows, len(kept[0])
            kept, at = [c[-window:] for c in rows], end


def _nearest_by_piece(batches: Iterator, window: int, measure: Measure, threshold: float):
    known = np.empty((0, HASHES), np.int64)
    for (stream, seg, no, context, line), old in _pieces(batches, window):
        n = len(no)
        start = np.array([i == 0 or stream[i] != stream[i - 1] or seg[i] != seg[i - 1] for i in range(n)])
        run = np.cumsum(start)
        before = np.minimum(np.arange(n) - np.flatnonzero(start)[run - 1], window)
        if measure.name == "minhash":
            between = _MinHash(line, measure, known)
            known = between.made[-window:]
        else:
            between = _Cosine(line, measure)
        least, back = np.ones(n), np.zeros(n, np.int64)
        for k in range(1, min(window, n - 1) + 1):
            d = np.where(run[k:] == run[:-k], between.at(k), 1.0)
            better = (d <= least[k:]) & (d < 1.0)  # the older one of equals
            least[k:][better], back[k:][better] = d[better], k
        for i in range(old, n):
            if not context[i]:
                k = int(back[i])
                yield stream[i], no[i], int(before[i]) - k if k else -1, no[i - k] if k else None, float(least[i]), bool(k and least[i] < threshold)


def _by_piece(measure: Measure, window: int) -> bool:
    """Whether pieces serve: grams that fit 64 bits, and a window that is not far longer than a piece."""
    return measure.name == "minhash" and window <= ROWS or measure.name == "cosine" and measure.q <= 8 and window <= ROWS


def nearest(lines: DataFrame, window: int = 8, distance: str = "minhash", q: int = 3, threshold: float = 0.06, segment: int | None = None) -> DataFrame:
    """(stream, line_no, begin, ref_no, distance, is_match) of every line; begin is -1 and ref_no null if no record is nearer than 1."""
    check_window(window)
    ship(lines.sparkSession)
    measure = Measure(distance, q)
    schema = pa.schema([("stream", pa.string()), ("line_no", pa.int64()), ("begin", pa.int32()), ("ref_no", pa.int64()), ("distance", pa.float64()), ("is_match", pa.bool_())])

    def run(batches):
        def rows():
            for stream, _, no, context, line, queue, mine in scan(batches, window, measure):
                if not context:
                    begin, d = choose(line, queue, measure, mine)
                    yield stream, no, begin, queue[begin][2] if begin >= 0 else None, d, begin >= 0 and d < threshold

        yield from _batches(_nearest_by_piece(batches, window, measure, threshold) if _by_piece(measure, window) else rows(), schema)

    placed = _with_context(lines, window, segment or segment_size(window), True)
    return placed.mapInArrow(run, "stream string, line_no long, begin int, ref_no long, distance double, is_match boolean")


def records(lines: DataFrame, window: int = 8, distance: str = "minhash", q: int = 3, threshold: float = 0.06, approx: bool = True, segment: int | None = None) -> DataFrame:
    """(stream, line_no, method, begin, ref_no, distance, matched, cost, ops, raw) of every line."""
    check_window(window)
    ship(lines.sparkSession)
    measure = Measure(distance, q)
    op = pa.struct([("position", pa.int32()), ("d_length", pa.int32()), ("i_length", pa.int32()), ("substr", pa.binary())])
    schema = pa.schema([("stream", pa.string()), ("line_no", pa.int64()), ("method", pa.int32()), ("begin", pa.int32()), ("ref_no", pa.int64()), ("distance", pa.float64()), ("matched", pa.bool_()), ("cost", pa.float64()), ("ops", pa.list_(op)), ("raw", pa.binary())])

    def run(batches):
        def encoded(waiting):
            made = add_scripts([w[3:] for w in waiting], measure, approx)
            for (stream, no, ref, _, line, _), r in zip(waiting, made, strict=True):
                ops = None if r["ops"] is None else [{"position": p, "d_length": d, "i_length": len(s), "substr": s} for p, d, s in r["ops"]]
                yield stream, no, r["method"], r["begin"], ref, r["distance"], r["matched"], r["cost"], ops, line if r["method"] else None

        def rows():
            waiting, size = [], 0  # exact scripts are made for many lines at once
            for stream, _, no, context, line, queue, mine in scan(batches, window, measure):
                if context:
                    continue
                r, old = match_line(line, queue, measure, mine, threshold)
                waiting.append((stream, no, queue[r["begin"]][2] if r["begin"] >= 0 else None, r, line, old))
                size += len(line) + len(old or b"")
                if approx or len(waiting) == ROWS or size > BYTES:
                    yield from encoded(waiting)
                    waiting, size = [], 0
            yield from encoded(waiting)

        yield from _batches(rows(), schema)

    placed = _with_context(lines, window, segment or segment_size(window), True)
    return placed.mapInArrow(run, f"stream string, line_no long, method int, begin int, ref_no long, distance double, matched boolean, cost double, ops {OPS}, raw binary")


def applied(old: Column, ops: Column) -> Column:
    """Catalyst expression that applies a script to a binary column."""
    piece = lambda from_, n: F.substring(old, from_ + 1, n)
    start = F.struct(F.lit(b"").cast("binary").alias("text"), F.lit(0).alias("at"))
    step = lambda a, o: F.struct(F.concat(a["text"], piece(a["at"], o["position"] - a["at"]), o["substr"]).alias("text"), (o["position"] + o["d_length"]).alias("at"))
    return F.aggregate(ops, start, step, lambda a: F.concat(a["text"], F.substring(old, a["at"] + 1, F.lit(2**31 - 1))))
