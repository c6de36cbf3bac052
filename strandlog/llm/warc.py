"""Legacy ARC archives, and their conversion to WARC.

An ARC file begins with a version block whose second line tells the version and whose third names the fields of every
record's header line; version 1 has five fields, version 2 ten. The last field is the declared length of what follows
the line. `convert` reads header lines by the fields of their file's version, takes exactly the declared number of
bytes, and makes WARC records: an identifier from URL, date and content, an ISO timestamp from the 14 digits, types
(warcinfo, response, or revisit for a known equal payload) and SHA-1 digests in base32.

The pages of a table are written through this path: rows become ARC records, ARC shards are converted, and each WARC
record is a gzip member of its own. Equal payloads of at least `least` bytes are stored once, under the largest
page_id; the others are revisit records that hold the HTTP header, whose Content-Length tells the full payload's size.

Edge cases: a null html is an empty payload; a null or blank URL becomes `urn:none`, and blanks inside URLs are
percent-encoded; payloads may hold anything, line feeds and header look-alikes included, as only declared lengths are
trusted; a truncated archive raises ValueError. Rows with the same page_id and payload are all responses or all
revisits, as the table's rows are told apart by page_id only; a null page_id is below all others. An empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm import store
from strandlog.runtime import cut, fresh_path, ship, width

FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:strandlog:warc")
ROLL = 8 << 20
DATE = "20240101000000"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def clean_url(url: str | None) -> str:
    """A URL that fits a header line."""
    return re.sub(r"[\x00-\x20\x7f\u0085   ]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), (url or "").strip()) or "urn:none"


def arc_head(version: int, name: str = "shard.arc", date: str = DATE) -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 strandlog\n{' '.join(FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, body: bytes, *, date: str = DATE, kind: str = "text/html", status: str = "200", offset: int = 0, name: str = "shard.arc") -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": status, "Checksum": hashlib.md5(body, usedforsecurity=False).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def parse_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record, the version block first; bytes are taken by declared length."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError(f"truncated ARC: {len(data)} of {n} bytes")
        return data

    def split(line: bytes, fields: list[str]) -> dict[str, str]:
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if len(parts) < len(fields):
            raise ValueError(f"ARC header line has {len(parts)} of {len(fields)} fields")
        parts = [" ".join(parts[: len(parts) - len(fields) + 1]), *parts[len(parts) - len(fields) + 1 :]]  # old URLs may hold blanks
        return dict(zip(fields, parts, strict=True))

    line = stream.readline()
    if not line:
        return
    n = int(line.split(b" ")[-1])
    block = take(n)
    version = int(block.split(b" ", 1)[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    yield split(line, FIELDS[1 if len(line.split(b" ")) < len(FIELDS[2]) else 2]) | {"version": str(version)}, block
    while True:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        head = split(line, FIELDS[version])
        yield head, take(int(head["Archive-length"]))


def _iso(date: str) -> str:
    d = re.sub(r"\D", "", date).ljust(14, "0")[:14]
    month, day = (x if x != "00" else "01" for x in (d[4:6], d[6:8]))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(parts))}>"


def warc_record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, *lines]).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_split(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload."""
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def convert(arc: io.BufferedIOBase, revisits: Callable[[bytes, str], str | None] = lambda header, digest: None) -> Iterator[bytes]:
    """WARC records of an ARC file. revisits(HTTP header, digest) names the record that holds an equal payload, or None."""
    for i, (head, body) in enumerate(parse_arc(arc)):
        url, date = head["URL"], _iso(head["Archive-date"])
        if i == 0:
            info = f"software: strandlog\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {head['version']}\r\n".encode()
            yield warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(url, date)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)
            continue
        header, payload = http_split(body)
        digest = base32(hashlib.sha1(payload, usedforsecurity=False).digest())
        same = revisits(header, digest)
        block = header if same is not None else body
        fields = [
            ("WARC-Type", "response" if same is None else "revisit"),
            ("WARC-Record-ID", record_id(url, date, digest, header.decode("latin-1"))),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-IP-Address", head["IP-address"]),
            ("Content-Type", "application/http; msgtype=response" if header else head["Content-type"]),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block, usedforsecurity=False).digest())}"),
        ]
        if same is not None:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Row", same)]
        yield warc_record(fields, block)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one by one."""
    at, step = 0, 1 << 16
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof and at < len(data):
            some = data[at : at + step]
            out.append(d.decompress(some))
            at += len(some) - len(d.unused_data)
        if not d.eof:
            raise ValueError("truncated gzip member")
        yield b"".join(out)


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record; checks length and block digest."""
    at = record.find(b"\r\n\r\n")
    lines = record[:at].decode().split("\r\n")
    if at < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(head["content-length"])
    block = record[at + 4 : at + 4 + n]
    if len(block) != n or record[at + 4 + n :] != b"\r\n\r\n":
        raise ValueError("WARC record's length is wrong")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block, usedforsecurity=False).digest())}":
        raise ValueError("WARC block's digest is wrong")
    return head, block


def _keepers(pages: DataFrame, least: int) -> DataFrame:
    """(digest, keeper): the largest page_id of every payload held by more than one row."""
    body = F.coalesce(F.col("html"), F.lit(""))
    sums = pages.filter(F.octet_length(body) >= least).groupBy(F.sha1(body.cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    return cut(sums.filter("n > 1").select("digest", "keeper"), "keepers")


def write_warc(pages: DataFrame, folder: str, *, version: int = 1, least: int = 0, date: str = DATE) -> DataFrame:
    """Archive (page_id, url, html) as .warc.gz files; returns the manifest (path, records, bytes)."""
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    keep = _keepers(pages, least)
    body = F.coalesce(F.col("html"), F.lit(""))
    known = F.when(F.octet_length(body) >= least, F.sha1(body.cast("binary")))
    rows = pages.withColumn("sha", known).join(keep, F.col("sha") == keep["digest"], "left").select("page_id", "url", "html", "keeper")

    def shard(ids, urls, htmls, keepers) -> tuple[bytes, int]:
        arc = io.BytesIO()
        arc.write(arc_head(version, date=date))
        for i, (p, u, h) in enumerate(zip(ids, urls, htmls, strict=True)):
            data = (h or "").encode()
            header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\nX-Row: {i}\r\nX-Page-Id: {'' if p is None else p}\r\n\r\n".encode()
            arc.write(arc_record(version, clean_url(u), header + data, date=date, offset=arc.tell()))
        arc.seek(0)

        def same(header: bytes, digest: str) -> str | None:
            i = int(re.search(rb"\r\nX-Row: (\d+)\r\n", header)[1])
            return None if keepers[i] is None or keepers[i] == ids[i] else str(keepers[i])

        out, n = io.BytesIO(), 0
        for record in convert(arc, same):
            out.write(gzip.compress(record, 6, mtime=0))
            n += 1
        return out.getvalue(), n - 1

    def run(batches):
        for b in batches:
            size, first, texts = 0, 0, b.column(2)
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for i, n in enumerate([*lengths, None]):
                if i > first and (n is None or size + n > ROLL):
                    data, count = shard(*(b.column(c).slice(first, i - first).to_pylist() for c in range(4)))
                    yield pa.RecordBatch.from_pylist([{"path": store.put(folder, ".warc.gz", data), "records": count, "bytes": len(data)}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
                    first, size = i, 0
                size += n or 0

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and record_id, url, date) of every record."""
    ship(manifest.sparkSession)
    n = manifest.count()

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for m in members(store.get(path)):
                    head, block = parse_warc(m)
                    if head["warc-type"] == "warcinfo":
                        continue
                    header, payload = http_split(block)
                    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in header.decode("latin-1").split("\r\n"))}
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(payload) != int(http["content-length"]) or base32(hashlib.sha1(payload, usedforsecurity=False).digest()) != digest):
                        raise ValueError("payload differs from its header")
                    to = head.get("warc-refers-to-row")
                    rows.append({"page_id": int(http["x-page-id"]) if http["x-page-id"] else None, "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": None if to is None else int(to), "record_id": head["warc-record-id"], "target_uri": head["warc-target-uri"]})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())]))

    spread = manifest.select("path").repartition(max(1, min(n, 4 * width(manifest.sparkSession))))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")


def archive(pages: DataFrame, **how) -> DataFrame:
    """Write the pages and read them back."""
    return read_warc(write_warc(pages, fresh_path(pages.sparkSession, "warc"), **how))
