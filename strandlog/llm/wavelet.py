"""Token ids in wavelet-matrix files.

A shard's file holds its documents' ids as a wavelet matrix: one bit-plane for each bit of an id, the highest first;
after each plane the ids are stably parted, zeros before ones. A plane answers rank and select by counts of ones
for every 512 bits, so that the file answers access to any token, the count of a token up to a place, and the place of
its k-th occurrence, without making the list of ids. Planes are compressed one by one; a plane is unpacked as a whole, and
its counts are made, when it is first asked for: the counts are not in the file, and one access opens all planes.

Layout (little-endian): magic `WVM1`, documents u32, planes u32, tokens u64; doc_ids i64 each (and a byte each that is
1 where it is null); tokens of each document u64; zeros of each plane u64; compressed size of each plane u32; planes
(zstandard).

Files are in ascending doc_id order: documents are range-partitioned and sorted, each partition writes shards of up to
SHARD tokens (a longer document has one of its own), and a manifest of the committed files tells the ids before each
shard. Only manifest rows are summed up, by partition and then inside partitions.

Edge cases: null text is empty: just the end id; rows that repeat a doc_id follow each other by text; a null doc_id
comes first; a text may be longer than a shard. An empty table gives no file and an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm import store
from strandlog.llm.tokens import PART, slices, table
from strandlog.runtime import cut, fresh_path, ship, width

MAGIC, WORD = b"WVM1", 512
#: Tokens after which a shard is closed.
SHARD = 1 << 21
_HEAD = struct.Struct("<4sIIQ")


def write_matrix(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard."""
    a = np.ascontiguousarray(ids, np.uint32)
    planes = max(1, int(a.max(initial=0)).bit_length())
    a = a.astype(np.uint16) if planes <= 16 else a
    zeros, packed, squeeze = [], [], zstandard.ZstdCompressor(level=1)
    for p in range(planes - 1, -1, -1):
        bit = (a & a.dtype.type(1 << p)) != 0
        packed.append(squeeze.compress(np.packbits(bit).tobytes()))
        low = a.compress(~bit)
        zeros.append(len(low))
        a = np.concatenate([low, a.compress(bit)])
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = _HEAD.pack(MAGIC, len(doc_ids), planes, len(a))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u8").tobytes(), np.array(zeros, "<u8").tobytes(), np.array([len(x) for x in packed], "<u4").tobytes(), *packed])


class WaveletMatrix:
    """A shard's file, opened for reading."""

    def __init__(self, data: bytes):
        magic, docs, self.planes, self.n = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.lengths, self.zeros = take("<u8", docs).astype(np.int64), take("<u8", self.planes).astype(np.int64)
        sizes = take("<u4", self.planes).tolist()
        if at + sum(sizes) != len(data) or int(self.lengths.sum()) != self.n:
            raise ValueError("wavelet-matrix file is cut short")
        self._packed = []
        for s in sizes:
            self._packed.append(data[at : at + s])
            at += s
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _plane(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a plane, and the ones before each word of 512 bits."""
        if p not in self._open:
            raw = np.frombuffer(zstandard.decompress(self._packed[p]), np.uint8)
            ones = np.bitwise_count(raw)
            words = np.add.reduceat(ones, np.arange(0, len(raw), WORD // 8), dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
            self._open[p] = raw, np.concatenate([[0], np.cumsum(words)])
        return self._open[p]

    def _bit(self, p: int, i: int) -> int:
        return int(self._plane(p)[0][i >> 3] >> (7 - (i & 7))) & 1

    def _rank1(self, p: int, i: int) -> int:
        """Ones of a plane before place i."""
        raw, words = self._plane(p)
        w = i // WORD
        part = raw[w * (WORD // 8) : i >> 3]
        rest = int(raw[i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(words[w]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def _select(self, p: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        raw, words = self._plane(p)
        count = words if bit else np.minimum(np.arange(len(words)) * WORD, self.n) - words
        w = int(np.searchsorted(count, k, side="right")) - 1
        part = np.unpackbits(raw[w * (WORD // 8) : (w + 1) * (WORD // 8)])[: self.n - w * WORD]
        return w * WORD + int(np.flatnonzero(part == bit)[k - int(count[w])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.planes):
            bit = self._bit(p, i)
            ones = self._rank1(p, i)
            token, i = token << 1 | bit, int(self.zeros[p]) + ones if bit else i - ones
        return token

    def rank(self, token: int, i: int) -> int:
        """How often the token is among the first i places."""
        if token >> self.planes:
            return 0
        a = 0
        for p in range(self.planes):
            ra, ri = self._rank1(p, a), self._rank1(p, i)
            if token >> (self.planes - 1 - p) & 1:
                a, i = int(self.zeros[p]) + ra, int(self.zeros[p]) + ri
            else:
                a, i = a - ra, i - ri
        return i - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        a = 0
        for p in range(self.planes):
            ra = self._rank1(p, a)
            a = int(self.zeros[p]) + ra if token >> (self.planes - 1 - p) & 1 else a - ra
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids: planes are unparted from the last to the first."""
        a = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(np.frombuffer(zstandard.decompress(self._packed[p]), np.uint8), count=self.n).view(bool)
            z, out = int(self.zeros[p]), np.empty_like(a)
            out[np.flatnonzero(~bit)] = a[:z]
            out[np.flatnonzero(bit)] = a[z:] | a.dtype.type(1 << (self.planes - 1 - p))
            a = out
        return a


def write_shards(docs: DataFrame, folder: str, path: str, end: int = 2, shard: int = SHARD) -> DataFrame:
    """Write the tokenised documents; the manifest has part, seq, path, docs, tokens."""
    spark = docs.sparkSession
    ship(spark)
    tail = np.array([end], "<u4").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        words, part, seq = table(path), TaskContext.get().partitionId(), 0
        ids, names, lengths, have = [], [], [], 0

        def close():
            name = store.put(folder, ".wvm", write_matrix(np.frombuffer(b"".join(ids), "<u4"), names, lengths))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": name, "docs": len(names), "tokens": have}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for b in batches:
            for i, texts in slices(b.column(1), *PART):
                for d, x in zip(b.column(0).slice(i, len(texts)).to_pylist(), words.encode(texts), strict=True):
                    n = len(x) // 4 + 1
                    if have and have + n > shard:
                        yield close()
                        ids, names, lengths, have, seq = [], [], [], 0, seq + 1
                    ids.append(x + tail)
                    names.append(d)
                    lengths.append(n)
                    have += n
        if have:
            yield close()

    return cut(rows.mapInArrow(run, "part int, seq int, path string, docs long, tokens long"), "wavelet-manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `before`: ids in all earlier shards."""
    back = (Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(*back)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*back)), F.lit(0))
    return manifest.withColumn("inside", inside).join(parts, "part").withColumn("before", F.col("earlier") + F.col("inside")).drop("earlier", "inside")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    ship(spark)

    def run(batches):
        for b in batches:
            for path, before in zip(*(b.column(c).to_pylist() for c in (0, 1)), strict=True):
                m = WaveletMatrix(store.get(path))
                ids = m.tokens()
                ends = np.cumsum(m.lengths)
                begins = ends - m.lengths
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(m.doc_ids, pa.int64()), pa.array(begins + before), pa.array(m.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = starts(manifest).select("path", "before").repartition(max(1, min(manifest.count(), 4 * width(spark))))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write the files and read them back."""
    return read_shards(write_shards(docs, fresh_path(docs.sparkSession, "wavelet"), path, end))
