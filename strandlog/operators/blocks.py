"""Blocks: the records of so many lines, their fields apart, coded, compressed; and back.

Payload before the codec: for each section its size in 4 bytes, in the order methods (run lengths; their number and the
records' number first), begins and operation counts (bit-packed), lengths, first positions and position
steps as second-order deltas, inserted bytes, the sizes of raw lines (second-order deltas again) and their bytes; before all a CRC-32. All sizes are 32
bits, empty lists are written like others, and counts are checked on reading, so that cut or changed blocks raise ValueError.

`anchor="segment"` starts each block with an empty window, so that blocks are read in parallel; `anchor="stream"` lets
the window reach over blocks, and a stream is then read by one task in order, which holds one block at a time.
"""

from __future__ import annotations

import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions import bits, codecs, deltas
from strandlog.functions.distances import Measure
from strandlog.operators.window import _batches, _with_context, check_window, encode_line, scan
from strandlog.runtime import ship

BLOCK = 4096
SCHEMA = "stream string, block_id long, first_line long, n_lines long, n_delta long, raw_bytes long, coded_bytes long, codec string, window int, anchor string, payload binary"


def sections(rows: list[dict], lines: list[bytes]) -> list[bytes]:
    delta = [r for r in rows if r["method"] == 0]
    ops = [r["ops"] for r in delta]
    methods, runs = bits.rle_encode([r["method"] for r in rows])
    number = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    lengths = [x for o in ops for x in (*(d for _, d, _ in o), *(len(s) for _, _, s in o))]
    return [
        number(len(rows), len(delta), runs) + methods,
        bits.bitpack_encode([r["begin"] for r in delta]),
        bits.bitpack_encode([len(o) for o in ops]),
        bits.ts2diff_encode(lengths),
        bits.ts2diff_encode([o[0][0] for o in ops if o]),
        bits.ts2diff_encode([b[0] - a[0] for o in ops for a, b in zip(o, o[1:], strict=False)]),
        b"".join(s for o in ops for _, _, s in o),
        bits.ts2diff_encode([len(x) for r, x in zip(rows, lines, strict=True) if r["method"]]),
        b"".join(x for r, x in zip(rows, lines, strict=True) if r["method"]),
    ]


def encode(rows: list[dict], lines: list[bytes]) -> bytes:
    body = b"".join(len(s).to_bytes(4, "big") + s for s in sections(rows, lines))
    return zlib.crc32(body).to_bytes(4, "big") + body


def decode(data: bytes) -> list[tuple[int, list | None, bytes | None]]:
    """(begin, ops, raw) of each record: ops for a delta, raw for a raw line."""
    if len(data) < 4 or zlib.crc32(data[4:]) != int.from_bytes(data[:4], "big"):
        raise ValueError("block is damaged")
    parts, at = [], 4
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    head, begins, counts, lengths, first, steps, text, sizes, raw = parts
    n, n_delta, runs = (int.from_bytes(head[i : i + 4], "big") for i in (0, 4, 8))
    methods = bits.rle_decode(head[12:], runs)
    if len(methods) != n or methods.count(0) != n_delta:
        raise ValueError("block's counts differ")
    begin, count = iter(bits.bitpack_decode(begins, n_delta)), iter(bits.bitpack_decode(counts, n_delta))
    size, start, step = iter(bits.ts2diff_decode(lengths)), iter(bits.ts2diff_decode(first)), iter(bits.ts2diff_decode(steps))
    raw_size, raw_at, at, out = iter(bits.ts2diff_decode(sizes)), 0, 0, []
    for m in methods:
        if m:
            k = next(raw_size)
            out.append((0, None, raw[raw_at : raw_at + k]))
            raw_at += k
            continue
        k = next(count)
        dropped, added = [next(size) for _ in range(k)], [next(size) for _ in range(k)]
        position, ops = 0, []
        for i in range(k):
            position = position + next(step) if i else next(start)
            ops.append((position, dropped[i], text[at : at + added[i]]))
            at += added[i]
        out.append((next(begin), ops, None))
    if at != len(text) or raw_at != len(raw):
        raise ValueError("block's text is cut short")
    return out


def compress(lines: DataFrame, *, codec: str = "none", window: int = 8, threshold: float = 0.06, block_size: int = BLOCK, distance: str = "minhash", approx: bool = True, q: int = 3, anchor: str = "segment") -> DataFrame:
    """One row a block: counts, sizes, and the payload."""
    codecs.check(codec)
    check_window(window)
    if not 0 <= threshold <= 1 or block_size < 1 or anchor not in ("segment", "stream"):
        raise ValueError("threshold is 0 to 1, block_size at least 1, anchor segment or stream")
    ship(lines.sparkSession)
    measure = Measure(distance, q)
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(a, types[b]) for a, b in (x.split() for x in SCHEMA.split(", "))])

    def run(batches):
        def blocks():
            key, rows, raw, first = None, [], [], 0

            def close():
                body = encode(rows, raw)
                payload = codecs.compress(body, codec)
                return (*key, first, len(rows), sum(r["method"] == 0 for r in rows), sum(map(len, raw)) + len(raw), len(body), codec, window, anchor, payload)

            for stream, seg, no, context, line, queue, mine in scan(batches, window, measure):
                if context:
                    continue
                if (stream, seg) != key:
                    if rows:
                        yield close()
                    key, rows, raw, first = (stream, seg), [], [], no
                rows.append(encode_line(line, queue, measure, mine, threshold, approx))
                raw.append(line)
            if rows:
                yield close()

        yield from _batches(blocks(), schema, 16)

    return _with_context(lines, window, block_size, anchor == "stream").mapInArrow(run, SCHEMA)


def replay(data: list, queue: deque) -> list[bytes]:
    """The lines of decoded records; the queue holds the lines before and is carried on."""
    out = []
    for begin, ops, raw in data:
        if ops is None:
            line = raw
        elif begin < len(queue):
            line = deltas.apply(ops, queue[begin])
        else:
            raise ValueError("record refers to a line outside the window")
        queue.append(line)
        out.append(line)
    return out


def decompress(blocks: DataFrame) -> DataFrame:
    """(stream, line_no, line) of blocks of either anchor."""
    ship(blocks.sparkSession)
    schema = pa.schema([("stream", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])

    def run(batches):
        def rows():
            last, queue = None, deque()
            for b in batches:
                for stream, first, n, codec, window, anchor, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if anchor == "segment" or stream != last:
                        last, queue = stream, deque(maxlen=window)
                    made = replay(decode(codecs.decompress(payload, codec)), queue)
                    if len(made) != n:
                        raise ValueError("block's number of lines differs")
                    for i, line in enumerate(made):
                        yield stream, first + i, line.decode()

        yield from _batches(rows(), schema)

    cols = ("stream", "first_line", "n_lines", "codec", "window", "anchor", "payload")
    # Blocks that refer to earlier ones of their stream stay together and in order; others are dealt by block.
    key = F.when(F.col("anchor") == "stream", F.lit(-1).cast("long")).otherwise(F.col("first_line"))
    return blocks.withColumn("deal", key).repartition("stream", "deal").sortWithinPartitions("stream", "deal", "first_line").select(*cols).mapInArrow(run, "stream string, line_no long, line string")


def write(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Blocks as Parquet, a row for each; mode "append" adds blocks."""
    blocks.write.mode(mode).parquet(path)


def grep(blocks: DataFrame, pattern: str) -> DataFrame:
    """Lines of compressed blocks that match a regular expression."""
    return decompress(blocks).filter(F.col("line").rlike(pattern))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines that differ by number: (stream, line_no, left_line, right_line)."""
    a = left.select("stream", "line_no", F.col("line").alias("left_line"))
    b = right.select("stream", "line_no", F.col("line").alias("right_line"))
    return a.join(b, ["stream", "line_no"], "full").filter(~F.col("left_line").eqNullSafe(F.col("right_line")))
