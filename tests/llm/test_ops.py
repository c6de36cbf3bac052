"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, `key` int, line string"

LONG = " ".join(f"word{i % 977} number{i % 13}" for i in range(12_000)) + "\n" + "x" * 70_000
LICENSE = "Licensed under the Foo License, version 2.0"
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs far away into the woods\nsecond line here\n" + LICENSE,
    "The quick brown fox jumps over the lazy dog and runs far away into the woods\nsecond line here\n" + LICENSE.upper(),
    "  " + LICENSE + "\t\n\nother é É words with odd blanks ﬁ ｆ ▁mark  two  \n" + LICENSE,
    None,
    "",
    " ",
    "\n\n",
    "a",
    "one two",
    "<|endoftext|> is text here, isn't it? I'd say 1234 'twas ΣΑΣ İstanbul\x1cx\x85y",
    LONG,
    LONG + " end",
    "same words here again and again\nno letters 123",
    "same words here again and again\nno letters 123",
    "12345 !!! ---",
    "日本語 テキスト 😀 emoji",
]


def table(spark, texts=TEXTS, ids=None):
    ids = ids or [3 * i + 1 for i in range(len(texts))]
    return spark.createDataFrame([(d, t, "en", "s", 1, "f", 7, "l") for d, t in zip(ids, texts, strict=True)], SCHEMA)


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    comp = {d: d for d in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: find(d) for d in ids}


def test_simhash(spark):
    from strandlog.llm import simhash as op

    texts = [*TEXTS, TEXTS[0] + " tail", TEXTS[10] + " other tail"]
    got = by_id(op.near_duplicates(table(spark, texts)))
    fps = {3 * i + 1: simhash(t) for i, t in enumerate(texts)}
    want = groups(fps)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert op.near_duplicates(table(spark, [])).count() == 0
    kept = op.keep_one(table(spark, texts))
    assert kept.columns == table(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    null = op.near_duplicates(table(spark, ["a b", "a b", "c d"], [None, 5, None]))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in null.collect()) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_simhash_anchors_find_every_link():
    from strandlog.llm.simhash import homes, replicas

    r = np.random.default_rng(1)
    x = r.integers(-(2**63), 2**63 - 1, 300)
    for flips in ((), (0,), (31,), (63,), (5, 40), (30, 31), (2, 7), (33, 62), (31, 63)):
        y = x.copy()
        for f in flips:
            y ^= np.int64(-(2**63)) if f == 63 else np.int64(1) << np.int64(f)
        h, hi = homes(x)
        p, pi = replicas(y)
        at = {}
        for k, i in zip(p.tolist(), pi.tolist(), strict=True):
            at.setdefault(i, set()).add(k)
        found = {i for k, i in zip(h.tolist(), hi.tolist(), strict=True) if k in at[i]}
        assert found == set(range(300)), flips


def test_components(spark):
    from strandlog.llm.graph import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(-5, -4), (-4, -5), (7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    names = lambda nodes: {got[n] for n in nodes}
    assert len(names(range(100, 161))) == len(names([1, *range(2, 40)])) == len(names([-5, -4])) == 1
    assert len(set(got.values())) == 3 and 7000 not in got


def sample_pages(spark):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, "u", None), (3, None, ""), (4, "u\nv", "<p>x</p>"), (9, "u", "HTTP/1.1 200 OK\r\n\r\nURL 0.0.0.0 1 t 5\n\r\n\r\n"), (10, "u", "é" * 100_000), (11, "u", "y"), (None, "u", "z")]
    return spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string"), rows


def test_warc(spark):
    import base64

    from strandlog.llm import warc

    pages, rows = sample_pages(spark)
    for version in (1, 2):
        got = by_id(warc.archive(pages, version=version), "page_id")
        for p, _, h in rows:
            body = (h or "").encode()
            keeper = max((q or -1 for q, _, x in rows if (x or "").encode() == body))
            revisit = p is not None and p != keeper
            assert got[p]["payload_bytes"] == len(body)
            assert got[p]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert (got[p]["record_type"], got[p]["refers_to"]) == (("revisit", keeper) if revisit else ("response", None))
    few = by_id(warc.archive(pages, least=5), "page_id")
    assert few[2]["record_type"] == few[3]["record_type"] == "response" and few[1]["record_type"] == "revisit"
    assert warc.archive(pages.limit(0)).count() == 0


def test_arc_errors_and_fields():
    import io

    from strandlog.llm import warc

    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    arc = warc.arc_head(2) + warc.arc_record(2, "http://x/a b", body)
    heads = list(warc.parse_arc(io.BytesIO(arc)))
    assert heads[1][0]["URL"] == "http://x/a b" and heads[1][1] == body and heads[0][0]["version"] == "2"
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(arc[:-8])))
    records = [warc.parse_warc(r)[0] for r in warc.convert(io.BytesIO(arc))]
    assert [r["warc-type"] for r in records] == ["warcinfo", "response"] and records[1]["warc-date"] == "2024-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        warc.parse_warc(next(warc.convert(io.BytesIO(arc)))[:-9])


def cut_paragraphs(text):
    m = re.match(r"(?:[ \n]*[^ \n]+){0,32}", text)
    h, rest = text[: m.end()], text[m.end() :]
    return set(re.findall(r"(?: *[^ \n]+){1,4}", h)) | set(re.findall(r"(?: *[^ \n]+){1,32}", rest))


def digests_of(fingerprint):
    """The digests that a fingerprint's tables peel to, one cell after the other."""
    n, *tables = fingerprint.split("/")
    out = set()
    for t in tables:
        size, cells = t.split(":")
        size = int(size, 16)
        table = {}
        for c in filter(None, cells.split(".")):
            table[int(c[:4], 16) if size else len(table)] = [int(c[4:7], 16), int(c[7:23], 16), int(c[23:], 16)]
        if not size:
            out |= {k for _, k, _ in table.values()}
            continue
        while table:
            k, check = next((k, c) for m, k, c in table.values() if m == 1)
            out.add(k)
            for j, bit in enumerate((10, 22, 34)):
                cell = table[j << 12 | k >> bit & size - 1]
                cell[0], cell[1], cell[2] = cell[0] - 1, cell[1] ^ k, cell[2] ^ check
            table = {p: c for p, c in table.items() if any(c)}
    assert len(out) == int(n, 16)
    return out


def test_fingerprints(spark):
    from strandlog.llm import iblt

    got = by_id(iblt.compare(table(spark)))
    ids = sorted(got, reverse=True)
    text = {3 * i + 1: t or "" for i, t in enumerate(TEXTS)}
    jac = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, d in enumerate(ids):
        a, b = text[d], text[ids[(i + 1) % len(ids)]]
        k = len(a) // 3
        e = a[: len(a) - k] + b[:k]
        r = got[d]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jac(cut_paragraphs(a), cut_paragraphs(e))), d
        assert r["near_next"] == pytest.approx(jac(cut_paragraphs(a), cut_paragraphs(b))), d
        assert len(r["lost"]) == len(cut_paragraphs(a) - cut_paragraphs(e)) and len(r["gained"]) == len(cut_paragraphs(e) - cut_paragraphs(a))
        # the likeness follows from the fingerprints alone
        mine, changed, after = (digests_of(f) for f in (r["fingerprint"], r["edited_fingerprint"], got[ids[(i + 1) % len(ids)]]["fingerprint"]))
        assert len(mine) == len(cut_paragraphs(a))
        assert r["near_edited"] == pytest.approx(jac(mine, changed)) and r["near_next"] == pytest.approx(jac(mine, after))
        assert {x % (1 << 64) for x in r["lost"]} == mine - changed and {x % (1 << 64) for x in r["gained"]} == changed - mine
    assert got[37]["fingerprint"] == got[40]["fingerprint"] and got[1]["fingerprint"] != got[4]["fingerprint"]
    assert iblt.compare(table(spark, [])).count() == 0
    assert iblt.compare(table(spark, ["one only"])).first()["near_next"] == 1.0
    odd = iblt.with_next(table(spark, ["a", "b", "c", "d"], [5, 5, None, 1 << 62])).collect()
    assert {(r.text, r.next_text) for r in odd} == {("d", "a"), ("a", "b"), ("b", "c"), ("c", "d")}


def test_differences_of_any_size(spark):
    """Few and many differing digests, several groups, and digests that share all their cells."""
    from strandlog.llm import iblt

    r = random.Random(4)
    some = [r.getrandbits(64) - (1 << 63) for _ in range(700)]
    twin = [x & ~(((1 << 36) - 1) << 10) | 5 << 10 | i for i, x in enumerate(some[:3])]
    cases = [([], []), (some[:1], []), (some[:50], some[1:50]), (some[:60], some[60:120]), (some[:500], some[3:510]), (some[:300], some[300:]), (some[:2], some), (twin, some[:5]), (twin[:2], twin[1:])]
    rows = spark.createDataFrame([(i, sorted(a), sorted(b)) for i, (a, b) in enumerate(cases)], "i int, a array<long>, b array<long>")
    got = {x.i: x for x in rows.select("i", F.expr(iblt.difference("a", "b")).alias("d"), F.expr(iblt.fingerprint("a")).alias("f")).collect()}
    for i, (a, b) in enumerate(cases):
        assert (set(got[i].d.mine), set(got[i].d.yours)) == (set(a) - set(b), set(b) - set(a)), i
        assert digests_of(got[i].f) == {x % (1 << 64) for x in a}, i
        assert (got[i].d.fallbacks > 0) == (i in (7, 8)), i


def test_next_over_many_buckets(spark, monkeypatch):
    from strandlog.llm import iblt

    monkeypatch.setattr(iblt, "BUCKET", 3)
    ids = [*range(0, 400), *range(10**12, 10**12 + 50), -7]
    got = {r.text: r.next_text for r in iblt.with_next(table(spark, [str(i) for i in ids], ids)).collect()}
    down = sorted(ids, reverse=True)
    assert got == {str(a): str(b) for a, b in zip(down, [*down[1:], down[0]], strict=True)}


def test_fingerprints_run_no_python(spark, sf):
    from strandlog.llm import queries

    plan = queries.op3_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def lines_brute(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    bad = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = {}
    for d, t in rows:
        parts = (t or "").split("\n")
        keep = [x for x in parts if key(x) not in bad or bad[key(x)] == d]
        out[d] = (len(parts), len(parts) - len(keep), "\n".join(keep))
    return out


def test_line_dedup(spark):
    from strandlog.llm import linededup

    texts = [*TEXTS, *["ééééééééééééééééééé\nshort\n" + "é" * 20] * 4]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    want = lines_brute(rows)
    got = by_id(linededup.line_report(table(spark, texts)))
    assert {d: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for d, r in got.items()} == {d: (a, b, hashlib.sha256(c.encode()).hexdigest()) for d, (a, b, c) in want.items()}
    kept = linededup.dedup_lines(table(spark, texts))
    assert kept.schema == table(spark, []).schema
    assert {r.doc_id: r.text or "" for r in kept.collect()} == {d: c for d, (_, _, c) in want.items()}
    assert linededup.line_report(table(spark, [])).count() == 0
    odd = linededup.line_report(table(spark, [LICENSE] * 5, [None, 2, 2, 2, 3]))
    assert sorted((str(r.doc_id), r.n_dropped) for r in odd.collect()) == [("2", 1), ("2", 1), ("2", 1), ("3", 0), ("None", 1)]


def test_pieces(spark):
    import sentencepiece

    from strandlog.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [*TEXTS, " lead", "trail ", "  both  ", "a   b    c", "▁", "▁▁x▁", "new\n line", " \n ", "tab\tx", "\x00 nul"]
    got = by_id(pieces.encode_pieces(table(spark, texts), PIECE))
    sums = by_id(pieces.piece_digests(table(spark, texts), PIECE))
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        r, s = got[3 * i + 1], sums[3 * i + 1]
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids), t
        assert s["n_tokens"] == len(ids) and s["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert s["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.piece_digests(table(spark, []), PIECE).count() == 0


def word_ids(text):
    from tokenizers import Tokenizer

    word_ids.t = getattr(word_ids, "t", None) or Tokenizer.from_file(WORD)
    return word_ids.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    from strandlog.llm import packing

    rows = packing.pack(table(spark), WORD).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = [*word_ids(t), 1]
        parts = sorted(got[3 * i + 1], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [(k, 4096 * k, len(ids[4096 * k : 4096 * (k + 1)]), crc(ids[4096 * k : 4096 * (k + 1)])) for k in range(-(-len(ids) // 4096))]
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert packing.pack(table(spark, []), WORD).count() == 0


def check_sequences(rows, capacity):
    seqs = {}
    for s, o, n in rows:
        seqs.setdefault(s, []).append((o, n))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_plan_is_best_fit_decreasing():
    from strandlog.llm.packing import place, plan

    r = np.random.default_rng(3)
    for capacity, n in ((10, 200), (100, 1000), (64, 37), (7, 0)):
        lengths = sorted(r.integers(1, capacity + 1, n).tolist(), reverse=True)
        counts = {x: lengths.count(x) for x in set(lengths)}
        rooms = []
        for x in lengths:  # one by one
            ok = [k for k in rooms if k >= x]
            if ok:
                rooms.remove(min(ok))
                rooms.append(min(ok) - x)
            else:
                rooms.append(capacity - x)
        rank, seen = [], {}
        for x in lengths:
            rank.append(seen.get(x, 0))
            seen[x] = rank[-1] + 1
        s, o = place(plan(counts, capacity), np.array(lengths, np.int64), np.array(rank, np.int64))
        assert check_sequences(zip(s.tolist(), o.tolist(), lengths, strict=True), capacity) == len(rooms)
        left = {}
        for q, x in zip(s.tolist(), lengths, strict=True):
            left[q] = left.get(q, capacity) - x
        assert sorted(left.values()) == sorted(rooms)


def test_token_files(spark):
    from strandlog.llm import wavelet

    got = by_id(wavelet.token_files(table(spark), WORD))
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*word_ids(t), 2]
        assert got[3 * i + 1] == {"doc_id": 3 * i + 1, "start": start, "n_tokens": len(ids), "ids_crc32": crc(ids)}
        start += len(ids)
    assert wavelet.token_files(table(spark, []), WORD).count() == 0
    odd = wavelet.token_files(table(spark, ["b", "a", "c"], [4, 4, None]), WORD).orderBy("start").collect()
    assert [(r.doc_id, r.ids_crc32) for r in odd] == [(None, crc([*word_ids("c"), 2])), (4, crc([*word_ids("a"), 2])), (4, crc([*word_ids("b"), 2]))]


def test_wavelet_matrix():
    from strandlog.llm.wavelet import WaveletMatrix, write_matrix

    r = np.random.default_rng(5)
    for n, top in ((0, 5), (1, 1), (7, 2), (512, 9), (513, 50_000), (3000, 70_000), (1500, 3)):
        a = r.integers(0, top, n)
        m = WaveletMatrix(write_matrix(a, [None, 5], [n // 2, n - n // 2]))
        assert m.tokens().tolist() == a.tolist() and m.doc_ids == [None, 5]
        for i in {0, 1, 8, 511, 512, 513, n - 1} & set(range(n)):
            assert m.access(i) == a[i]
            assert m.rank(int(a[i]), i) == int((a[:i] == a[i]).sum())
        for x in set(a[:5].tolist()) | {0}:
            at = np.flatnonzero(a == x)
            assert m.count(x) == len(at)
            assert [m.select(x, k) for k in range(min(len(at), 6))] == at[:6].tolist()
        assert m.count(1 << 20) == 0
        with pytest.raises(IndexError):
            m.access(n)
    with pytest.raises(ValueError):
        WaveletMatrix(write_matrix(a, [1], [len(a)])[:-3])


def test_top_k(spark):
    from strandlog.llm import vafile

    r = np.random.default_rng(2)
    vecs = [r.normal(size=8).astype(np.float32).tolist() for _ in range(130)]
    vecs[3], vecs[5], vecs[7], vecs[9], vecs[40] = None, [None] * 8, [float("nan")] * 8, [float("inf")] * 8, None
    vecs[61:90] = [vecs[60]] * 29
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vecs)] + [(None, vecs[0], 1, "x")], "vec_id long, embedding array<float>, label int, score string")
    v = {i: np.floor(64 * np.array(x, np.float64)).astype(int) for i, x in enumerate(vecs) if x and x[0] is not None and np.isfinite(x).all()}
    for k in (20, 500):
        got = {}
        for row in vafile.top_k(df, k).collect():
            got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
        assert set(got) == {q for q in v if q % 20 == 0}
        for q, rows in got.items():
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            assert sorted(rows) == [(i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert vafile.top_k(df.limit(0)).count() == 0


def test_top_k_reads_few_and_meets_odd_vectors(spark, monkeypatch):
    """Few exact vectors are read; several blocks, empty and ragged vectors, repeated vec_ids."""
    from strandlog.llm import vafile

    monkeypatch.setattr(vafile, "BLOCK", 300)
    monkeypatch.setattr(vafile, "QUERIES", 20)
    r = np.random.default_rng(4)
    vecs = r.normal(size=(2000, 16))
    vecs = [(x / np.linalg.norm(x)).astype(np.float32).tolist() for x in vecs]
    rows = [(i, v) for i, v in enumerate(vecs)]
    rows += [(2000 + i, x) for i, x in enumerate([[], [], vecs[1][:7], vecs[2][:7], vecs[3][:7]])]
    rows += [(20, vecs[777]), (33, vecs[20]), (33, vecs[20]), (40, vecs[5][:7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v in rows if v]
    ask = {q: min((v for i, v in rows if i == q and v), default=None) for q in range(0, 2006, 20)}
    got, reads = {}, {}
    for row in vafile.top_k(df, 5).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
        reads[row.query_id] = row.exact_reads
    for q, vec in ask.items():
        if vec is None:
            assert q not in got
            continue
        v = np.floor(64 * np.array(vec, np.float64)).astype(int)
        best = sorted((-int(v @ x), i) for i, x in whole if i != q and len(x) == len(v))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], q
    assert reads.pop(40) == 3  # it meets three of its length
    assert 5 <= min(reads.values()) and sum(reads.values()) < 0.05 * len(reads) * len(whole)


def test_bounds_hold():
    from strandlog.llm.vafile import scan

    r = np.random.default_rng(4)
    v = np.floor(64 * r.normal(size=(3000, 16)) / 4).astype(np.int64)
    held = np.full((1, 5), -np.inf)
    at, place, upper, lower = scan(np.array([0]), v[:1], np.arange(3000), v >> 2, held, 2)
    score = v[place] @ v[0]
    assert (at == 0).all() and (lower <= score).all() and (score <= upper).all() and len(place) < 1000
    best = sorted((-int(v[0] @ x), k) for k, x in enumerate(v) if k)[:5]
    assert {k for _, k in best} <= set(place.tolist())
    assert sorted(held[0]) == sorted(lower)[-5:]
    assert len(scan(np.array([0]), v[:1], np.arange(3000, 6000), v[::-1] // 2 >> 2, held, 2)[0]) < len(place)  # the floor is carried on


def test_near_copies(spark):
    from strandlog.llm import nearcopies as op
    from strandlog.llm import simhash as bits

    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [" ".join(r.choice(vocabulary, 200)) for _ in range(12)]

    def edited(text, n):
        words = text.split()
        for i in r.choice(len(words), n, replace=False):
            words[i] = f"new{i}"
        return " ".join(words)

    texts = [*TEXTS, *base, *(edited(b, n) for b in base for n in (1, 2, 3, 4, 5, 7, 12)), *(edited(base[0], 3) for _ in range(60))]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").encode().lower().split() for t in texts)]
    comp = list(range(len(texts)))
    far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                far += (bits.fingerprint(texts[i], 5) ^ bits.fingerprint(texts[j], 5)).bit_count() > 2
                x, y = sorted((comp[i], comp[j]))
                comp = [x if c == y else c for c in comp]
    assert far > 20  # near copies that two bits of a fingerprint miss
    kept = op.keep_one(table(spark, texts))
    assert kept.columns == table(spark, []).columns
    assert sorted(x.doc_id for x in kept.collect()) == [3 * c + 1 for c in sorted(set(comp))]
    assert op.keep_one(table(spark, [])).count() == 0


def test_near_copies_shuffle_no_texts(spark, monkeypatch):
    """Rows whose sets are needed, and rows that stay, are read where they are written."""
    from strandlog.llm import nearcopies as op

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen, sets = [], op._sets
    monkeypatch.setattr(op, "_sets", lambda texts: seen.append(plan(texts)) or sets(texts))
    same = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [same, same + " more", "other words", None]).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = op.keep_one(docs, 2)
        assert [x for x in (*seen, plan(kept)) if "Exchange" in x] == [] and len(seen) == 1
        assert sorted(x.doc_id for x in kept.collect()) == [1, 7, 10]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_copies_take_one_worker_a_task(spark, monkeypatch):
    """No task runs two Python steps, as an executor keeps and uses all workers that it ever needed at once."""
    from strandlog.llm import nearcopies as op

    seen, cut = [], op.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(op, "cut", lambda df, label: seen.append((label, plan(df))) or cut(df, label))
    same = " ".join(f"w{i}" for i in range(60))
    kept = op.keep_one(table(spark, [same, same + " more", "other words", None]), 2)
    assert sorted(x.doc_id for x in kept.collect()) == [1, 7, 10]
    seen.append(("result", plan(kept)))
    assert [label for label, x in seen if "MapInArrow" in x and "ArrowEvalPython" in x] == []
    assert any("MapInArrow" in x for _, x in seen) and "ArrowEvalPython" in seen[-1][1]


def test_marked_rows(spark):
    from pyspark.sql import functions as F

    from strandlog.llm import marks
    from strandlog.runtime import cut

    rows = cut(spark.range(0, 5000, 1, 7).withColumn("row", F.monotonically_increasing_id()))
    some = marks.mark(rows.filter("id % 3 = 0 and id < 4000").select("row"))
    assert sorted(x.id for x in rows.filter(marks.marked(F.col("row"), some)).collect()) == list(range(0, 4000, 3))
    none = marks.mark(rows.filter("id < 0").select("row"))
    assert rows.filter(marks.marked(F.col("row"), none)).count() == 0


def test_one_row_of_repeated_and_null_ids(spark):
    from strandlog.llm import nearcopies as op

    a, b, c = ("some words that make up a text of their own number " + x for x in ("one", "two two", "three three three"))
    kept = op.keep_one(table(spark, [a, a, b, b, b, c, c], [5, 5, 3, 5, None, None, None])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", a), ("3", b), ("None", c)])


def test_simhash_keeps_one_row(spark):
    from strandlog.llm import simhash

    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (5, "x y z"), (5, text), (None, "x y z"), (None, None), (None, "")], "doc_id long, text string")
    kept = [(r.doc_id, r.text or "") for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, text), (5, "x y z"), (None, "")], key=str)


def test_members_of_a_long_file():
    import gzip

    from strandlog.llm.warc import members

    parts = [bytes([i % 251]) * (i * 997 % 70_000) for i in range(60)]
    data = b"".join(gzip.compress(x) for x in parts)
    assert list(members(data)) == parts
    with pytest.raises(ValueError):
        list(members(data[:-1]))


def test_near_duplicates_links_by_fingerprints_and_by_shingles(spark):
    """The pipeline's stage links what SimHash links, whatever the Jaccard index, and what only the index links."""
    import corpus_pipeline as cp
    from strandlog.llm import nearcopies

    r = np.random.default_rng(8)
    words = lambda n: " ".join("".join(map(chr, w)) for w in r.integers(97, 123, (n, 6)))
    long = "one two three four five six seven eight nine " * 60  # an odd number of shingles, so that no bit is even
    texts = [long + words(12), long + words(14)]
    plain = words(150).split()
    texts += [" ".join(plain), " ".join("changed" if i in (20, 60, 100) else x for i, x in enumerate(plain)), words(40), "", None]
    near = lambda a, b: (bits_of(texts[a]) ^ bits_of(texts[b])).bit_count() <= 2
    alike = lambda a, b: nearcopies.alike(nearcopies.shingles(texts[a]), nearcopies.shingles(texts[b]))
    assert near(0, 1) and not alike(0, 1) and not near(2, 3) and alike(2, 3)
    docs = table(spark, texts, list(range(1, 8)))
    assert sorted(x.doc_id for x in cp.near_duplicates(spark, docs, "").collect()) == [1, 3, 5, 6]
    assert sorted(x.doc_id for x in nearcopies.keep_one(docs).collect()) == [1, 2, 3, 5, 6]
    assert cp.near_duplicates(spark, table(spark, []), "").count() == 0


def bits_of(text):
    from strandlog.llm import simhash

    return simhash.fingerprint(text)


def test_tasks_of_other_kinds_drop_the_words_of_a_table(spark):
    """Workers live on from stage to stage: the tables of one aren't kept in the next."""
    from strandlog.llm import nearcopies, tokens

    words = tokens.table(WORD)
    words.encode(["some words of a text"])
    assert len(words.known) > 1
    tokens.drop_table()
    assert len(words.known) == 1 and not words.older and not tokens._LAST
    tokens.drop_table()
    assert tokens.table(WORD).encode(["some words"]) == words.encode(["some words"]) != [b""]
    assert nearcopies.keep_one(table(spark, ["some words"], [1])).count() == 1
