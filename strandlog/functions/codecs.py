"""General-purpose compressors of byte strings, by name."""

from __future__ import annotations

import bz2
import lzma
import zlib

import zstandard

NAMES = ("none", "lzma", "zlib", "gzip", "zstd", "bz2")


def check(name: str) -> str:
    if name not in NAMES:
        raise ValueError(f"codec {name!r} is not one of {', '.join(NAMES)}")
    return "zlib" if name == "gzip" else name


def compress(data: bytes, name: str) -> bytes:
    name = check(name)
    if name == "lzma":
        return lzma.compress(data, preset=6, check=lzma.CHECK_CRC64)
    if name == "zlib":
        return zlib.compress(data, 1)
    if name == "zstd":
        return zstandard.ZstdCompressor(level=20).compress(data)
    return bz2.compress(data, 9) if name == "bz2" else data


def decompress(data: bytes, name: str) -> bytes:
    name = check(name)
    if name == "lzma":
        return lzma.decompress(data)
    if name == "zlib":
        d = zlib.decompressobj(47)  # zlib or gzip framing
        out = d.decompress(data) + d.flush()
        if not d.eof:
            raise ValueError("compressed data are cut short")
        return out
    if name == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return bz2.decompress(data) if name == "bz2" else data
