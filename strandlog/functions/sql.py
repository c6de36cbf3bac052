"""The kernels as functions of SQL: `register(spark)` makes them known to the session.

qgram_cosine(a, b), minhash_sig(a), minhash_distance(a, b), qgram_distance(a, b), delta_ops(old, new),
delta_apply(old, ops), rle_encode(flags), bitpack(values), ts2diff(values), and the table function lines(text). Strings
count as their UTF-8 bytes; a null argument gives null (lines: no row). Batches cross to Python as Arrow.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlog.functions import bits, deltas
from strandlog.functions.distances import Measure, minhash
from strandlog.operators.window import OPS
from strandlog.runtime import ship

_OP = pa.list_(pa.struct([("position", pa.int32()), ("d_length", pa.int32()), ("i_length", pa.int32()), ("substr", pa.binary())]))


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _rowwise(f, kind: pa.DataType, arity: int):
    def one(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], kind)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return one if arity == 1 else two


def _distance(name: str, q: int):
    def between(a, b) -> float:
        measure, a, b = Measure(name, q), _bytes(a), _bytes(b)
        return measure.between(b, measure.prepare(b), a, measure.prepare(a))

    return between


def _ops(old, new) -> list[dict]:
    return [{"position": p, "d_length": d, "i_length": len(s), "substr": s} for p, d, s in deltas.approximate(_bytes(old), _bytes(new))[0]]


def _apply(old, ops) -> bytes:
    return deltas.apply([(o["position"], o["d_length"], o["substr"]) for o in ops], _bytes(old))


class _Lines:
    def eval(self, text: str):
        if text is not None:
            parts = text.split("\n")
            if len(parts) > 1 and not parts[-1]:
                parts.pop()
            yield from enumerate(parts, 1)


def register(spark: SparkSession, q: int = 3) -> list[str]:
    """Register all functions; returns their names."""
    ship(spark)
    made = {
        "qgram_cosine": (_rowwise(_distance("cosine", q), pa.float64(), 2), "double"),
        "minhash_sig": (_rowwise(lambda a: minhash(_bytes(a)).tolist(), pa.list_(pa.int64()), 1), "array<long>"),
        "minhash_distance": (_rowwise(_distance("minhash", q), pa.float64(), 2), "double"),
        "qgram_distance": (_rowwise(_distance("qgram", q), pa.float64(), 2), "double"),
        "delta_ops": (_rowwise(_ops, _OP, 2), OPS),
        "delta_apply": (_rowwise(_apply, pa.binary(), 2), "binary"),
        "rle_encode": (_rowwise(lambda a: bits.rle_encode(a)[0], pa.binary(), 1), "binary"),
        "bitpack": (_rowwise(bits.bitpack_encode, pa.binary(), 1), "binary"),
        "ts2diff": (_rowwise(bits.ts2diff_encode, pa.binary(), 1), "binary"),
    }
    for name, (f, kind) in made.items():
        spark.udf.register(name, F.arrow_udf(f, kind))
    spark.udtf.register("lines", F.udtf(_Lines, returnType="line_no: bigint, line: string"))
    return [*made, "lines"]
