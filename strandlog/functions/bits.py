"""Byte codecs of integer lists: run lengths of flags, bit packing, second-order deltas."""

from __future__ import annotations

from itertools import groupby

import numpy as np

BLOCK = 64


def _bytes(bits: str) -> bytes:
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big") if bits else b""


def _bits(data: bytes) -> str:
    return bin(int.from_bytes(b"\1" + data, "big"))[3:] if data else ""


def codeword(n: int) -> str:
    """Prefix code of a run length: unary width, then the number in that many bits (at least 2)."""
    if n < 1:
        raise ValueError("runs have at least one element")
    b = max(2, n.bit_length())
    return "1" * (b - 2) + "0" + format(n, f"0{b}b")


def rle_encode(flags: list[int]) -> tuple[bytes, int]:
    """(bytes, runs): the first flag, then the codewords of the runs, padded with zeros."""
    runs = [(k, sum(1 for _ in g)) for k, g in groupby(flags)]
    return _bytes(str(runs[0][0]) + "".join(codeword(n) for _, n in runs) if runs else ""), len(runs)


def rle_decode(data: bytes, runs: int) -> list[int]:
    bits, out = _bits(data), []
    at, flag = 1, int(bits[0]) if runs else 0
    for _ in range(runs):
        stop = bits.index("0", at)
        b = stop - at + 2
        n = int(bits[stop + 1 : stop + 1 + b], 2)
        if len(bits) < stop + 1 + b:
            raise ValueError("run lengths are cut short")
        out += [flag] * n
        at, flag = stop + 1 + b, 1 - flag
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values in so many bits each, the highest first."""
    if not width or not len(values):
        return b""
    v = np.asarray(values, np.uint64)
    places = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits((v[:, None] >> places & np.uint64(1)).astype(np.uint8).reshape(-1)).tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    if len(bits) < width * n:
        raise ValueError("packed values are cut short")
    return (bits[: width * n].reshape(n, width).astype(np.uint64) << np.arange(width - 1, -1, -1, dtype=np.uint64)).sum(axis=1).astype(np.int64)


def bitpack_encode(values: list[int]) -> bytes:
    """A byte with the width of the largest value, then the values; nothing for an empty list."""
    if not len(values):
        return b""
    if min(values) < 0:
        raise ValueError("bit packing takes numbers from 0")
    width = int(max(values)).bit_length()
    return bytes([width]) + pack(np.array(values, np.uint64), width)


def bitpack_decode(data: bytes, n: int) -> list[int]:
    return unpack(data[1:], data[0], n).tolist() if n else []


#: Bit of the number of blocks that says that first values and least deltas take 64 bits each, not 32.
_WIDE = 1 << 31


def ts2diff_encode(values: list[int]) -> bytes:
    """The number of blocks, then for each 64 values: the first, the least delta, their count, a width, the deltas less the least.

    Blocks end on whole bytes, blocks of one value too. First values and least deltas take 32 bits with sign; a list
    with a value or delta beyond that takes 64 for each and sets the highest bit of the number of blocks. Values and
    deltas must fit 64 bits with sign.
    """
    v = [int(x) for x in values]
    steps = [b - a for a, b in zip(v, v[1:], strict=False)]
    if any(not -(2**63) <= x < 2**63 for x in (*v, *steps)):
        raise ValueError("a value or delta does not fit 64 bits")
    size = 4 if all(-(2**31) <= x < 2**31 for x in (*v, *steps)) else 8
    out = [(-(-len(v) // BLOCK) | (_WIDE if size == 8 else 0)).to_bytes(4, "big")]
    for i in range(0, len(v), BLOCK):
        d = steps[i : min(i + BLOCK, len(v)) - 1]
        low = min(d, default=0)
        head = v[i].to_bytes(size, "big", signed=True) + low.to_bytes(size, "big", signed=True)
        if not d:
            out.append(head + b"\0\0")
            continue
        width = max(1, (max(d) - low).bit_length())
        out.append(head + _bytes(f"{len(d):012b}{width:08b}" + "".join(format(x - low, f"0{width}b") for x in d)))
    return b"".join(out)


def ts2diff_decode(data: bytes) -> list[int]:
    blocks, at, out = int.from_bytes(data[:4], "big"), 4, []
    size = 8 if blocks & _WIDE else 4
    signed = lambda b: int.from_bytes(b, "big", signed=True)
    for _ in range(blocks & ~_WIDE):
        if len(data) < at + 2 * size + 2:
            raise ValueError("deltas are cut short")
        first, low = signed(data[at : at + size]), signed(data[at + size : at + 2 * size])
        at += 2 * size
        n = int.from_bytes(data[at : at + 2], "big") >> 4
        out.append(first)
        if not n:
            at += 2
            continue
        width = (int.from_bytes(data[at + 1 : at + 3], "big") >> 4) & 0xFF
        total = -(-(20 + width * n) // 8)
        bits = _bits(data[at : at + total])
        if len(bits) < 20 + width * n:
            raise ValueError("deltas are cut short")
        for k in range(n):
            out.append(out[-1] + low + int(bits[20 + k * width : 20 + (k + 1) * width], 2))
        at += total
    return out
