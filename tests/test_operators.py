"""Operators on small streams, and every query against its SQL."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlog import cli
from strandlog.functions import bits, sql
from strandlog.functions.distances import Measure
from strandlog.operators import blocks
from strandlog.operators.window import candidates, nearest, records
from strandlog.plans import registry
from strandlog.sources import lines as sources
from strandlog.streaming.windowed import nearest_stream

LINES = ["same line here", "same line here", "same line hers", "x", "", "é ñ \r tail", "same line here", "$$same line here", "a" * 100_000, "same line here##", "ab"] * 4


@pytest.fixture(scope="module")
def stream(spark):
    rows = [("s", i + 1, x) for i, x in enumerate(LINES)] + [("t", i + 1, f"event number {i} of the day") for i in range(50)]
    return spark.createDataFrame(rows, "stream string, line_no long, line string").cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("distance", ["cosine", "minhash", "qgram"])
def test_segments_do_not_change_records(stream, distance):
    whole = rows(nearest(stream, 5, distance, threshold=0.5, segment=10**6))
    for segment in (1, 3, 7, 11):
        assert rows(nearest(stream, 5, distance, threshold=0.5, segment=segment)) == whole


def test_nearest_rules(stream):
    got = {(r.stream, r.line_no): r for r in nearest(stream, 8, "minhash", threshold=0.06).collect()}
    assert got["s", 1].begin == -1 and got["s", 1].ref_no is None
    assert (got["s", 2].begin, got["s", 2].distance, got["s", 2].is_match) == (0, 0.0, True)
    assert got["s", 7].ref_no == 1  # the oldest of two equals
    none = nearest(stream, 8, "minhash", threshold=0.0).filter("is_match")
    assert none.count() == 0
    for bad in (0, 65536):
        with pytest.raises(ValueError):
            candidates(stream, bad)


def test_cheap_line_stays_raw(spark):
    df = spark.createDataFrame([("s", 1, "abcd"), ("s", 2, "abcd")], "stream string, line_no long, line string")
    r = {x.line_no: x for x in records(df, 2).collect()}
    assert r[2].matched and r[2].cost == 5.0 and r[2].method == 1 and r[2].raw == b"abcd"


@pytest.mark.parametrize("anchor", ["segment", "stream"])
@pytest.mark.parametrize("codec", ["none", "zstd"])
def test_round_trip(stream, anchor, codec):
    want = rows(stream)
    for size in (1, 4, 11, 44, 1000):
        made = blocks.compress(stream, codec=codec, block_size=size, threshold=0.8, anchor=anchor, window=3)
        assert rows(blocks.decompress(made)) == want
    assert blocks.compress(stream.limit(0)).count() == 0


def test_exact_round_trip(spark, sf):
    urls = sources.page_lines(spark, sf, "url")
    assert rows(blocks.decompress(blocks.compress(urls, window=1, threshold=1.0, distance="cosine", approx=False, block_size=16))) == rows(urls)


def test_wrong_parameters(stream):
    for how in ({"codec": "rar"}, {"threshold": 2}, {"block_size": 0}, {"distance": "x"}, {"anchor": "x"}, {"window": 0}, {"q": 0}):
        with pytest.raises(ValueError):
            blocks.compress(stream, **how)


def test_text_files(spark, stream, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n\nthree\n")
    (tmp_path / "b.log").write_bytes("no end é".encode())
    (tmp_path / "c.log").write_bytes(b"")
    got = {}
    for r in sources.text_lines(spark, str(tmp_path)).collect():
        got.setdefault(r.stream[-5:], []).append((r.line_no, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {"a.log": [(1, "one\r"), (2, "two"), (3, ""), (4, "three")], "b.log": [(1, "no end é")]}
    sources.write_lines(stream.filter("stream = 't'"), str(tmp_path / "out"))
    parts = list((tmp_path / "out" / "stream=t").glob("*.txt"))
    assert len(parts) == 1 and parts[0].read_text().split("\n")[:2] == ["event number 0 of the day", "event number 1 of the day"]
    blocks.write(blocks.compress(stream), str(tmp_path / "blocks"))
    blocks.write(blocks.compress(stream), str(tmp_path / "blocks"), "append")
    assert spark.read.parquet(str(tmp_path / "blocks")).count() == 4


def test_text_files_in_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = {}
    for name, n in (("a.log", 700), ("b.log", 3), ("c.log", 250)):
        want[name] = [f"{name} line {i} " + "é" * (i % 40) if i % 9 else "" for i in range(n)]
        (tmp_path / "in" / name).write_bytes("\n".join(want[name]).encode() + b"\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "4000", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in sources.text_lines(spark, str(tmp_path / "in")).collect():
                got.setdefault(r.stream[-5:], []).append((r.line_no, r.line))
            assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_command_line(spark, tmp_path):
    (tmp_path / "in.log").write_text("".join(f"request {i} took {i * i} ms\n" for i in range(500)))
    made = cli.run(spark, ["compress", "--codec", "zstd", "--distance", "cosine", "--threshold", "0.5", "--block-size", "128", str(tmp_path / "in.log"), str(tmp_path / "blocks")])
    assert (made["lines"], made["blocks"]) == (500, 4) and made["ratio"] > 1
    cli.run(spark, ["decompress", str(tmp_path / "blocks"), str(tmp_path / "out")])
    (part,) = (tmp_path / "out").glob("*/*.txt")
    assert part.read_text() == (tmp_path / "in.log").read_text()
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["compress", "--codec", "rar", "a", "b"])


def test_sql_functions(spark):
    assert "lines" in sql.register(spark)
    df = spark.createDataFrame([("the first line", "the second line"), ("", "x"), ("same", "same"), (None, "x"), ("ab", "é\n")], "a string, b string")
    df.createOrReplaceTempView("pairs_ab")
    got = spark.sql("select a, b, qgram_cosine(a, b) c, minhash_distance(a, b) m, qgram_distance(a, b) q, minhash_sig(a) s, delta_apply(encode(a, 'UTF-8'), delta_ops(a, b)) n from pairs_ab").collect()
    for r in got:
        if r.a is None:
            assert r.c is None and r.m is None and r.q is None and r.s is None and r.n is None
            continue
        x, y = r.a.encode(), r.b.encode()
        for name, value in (("cosine", r.c), ("minhash", r.m), ("qgram", r.q)):
            m = Measure(name, 3)
            assert value == m.between(y, m.prepare(y), x, m.prepare(x))
        assert bytes(r.n) == y and len(r.s) == 50
    one = spark.sql("select rle_encode(array(0, 1, 1, 1, 1)) r, bitpack(array(5, 7, 3, 3, 4, 2, 4, 2, 5, 12, 23)) b, ts2diff(array(1, 2, 3)) t").first()
    assert bytes(one.b) == bytes.fromhex("0529C63208822B2E") and bits.rle_decode(bytes(one.r), 2) == [0, 1, 1, 1, 1] and bits.ts2diff_decode(bytes(one.t)) == [1, 2, 3]
    assert [tuple(r) for r in spark.sql("select * from lines('a\\n\\nb\\n')").collect()] == [(1, "a"), (2, ""), (3, "b")]


def test_operation_distance(spark, sf):
    m = Measure("qgram", 3)
    by = {r.line_no: r.line.encode() for r in sources.event_lines(spark, sf).collect()}
    got = {r.line_no: r.distance for r in registry.QUERIES["qgram_op_distance"](spark, sf).collect()}
    assert got == {n: m.between(x, None, by[n - 1], None) for n, x in by.items() if n > 1}


def test_numbering_is_dense_over_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 7 == 0, "small").otherwise("large").alias("s"), F.xxhash64("id").alias("o"))
    got = sources.numbered(df, F.col("s"), [F.col("o")], F.col("o").cast("string"))
    for s in ("small", "large"):
        r = sorted((x.line_no, int(x.line)) for x in got.filter(F.col("stream") == s).collect())
        assert [n for n, _ in r] == list(range(1, len(r) + 1)) and [v for _, v in r] == sorted(v for _, v in r)


def test_stream_equals_batch(spark, sf, tmp_path):
    lines = sources.conversation_lines(spark, sf)
    want = rows(nearest(lines, 8, "minhash", threshold=registry.RATE))
    assert rows(registry.QUERIES["stream_nearest"](spark, sf)) == want
    # The window reaches over micro-batches.
    for i, part in enumerate(("line_no <= 2", "line_no > 2")):
        lines.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("stream string, line_no long, line string").parquet(str(tmp_path / "in"))
        q = nearest_stream(source, 8, "minhash", threshold=registry.RATE).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want


def test_plans_have_no_products(spark, sf):
    for name in ("window_candidates", "nearest_cosine", "cosine_pairs", "sweep_data_size", "stream_roundtrip", "ratio_by_source"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Cartesian|BroadcastNestedLoop", plan), name


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cells(values):
    return tuple("" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        assert df.count() > 0
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(cells, df.select(*want.columns).collect())) == sorted(map(cells, want.fetchall()))


def test_gaps_nulls_and_pieces(spark, monkeypatch):
    """Line numbers with gaps name lines that exist; a null line is an empty one; pieces of any size give the same."""
    from strandlog.functions.distances import Measure
    from strandlog.operators import window as w

    gaps = spark.createDataFrame([("s", 10, "one line here"), ("s", 20, "another one"), ("s", 30, "one line here"), ("s", 40, None)], "stream string, line_no long, line string")
    for distance in ("minhash", "cosine", "qgram"):
        got = {r.line_no: r for r in w.nearest(w.dense(gaps), 8, distance, threshold=0.5).collect()}
        assert got[3].ref_no == 1 and got[3].begin == 0 and not got[4].is_match
        wide = {r.line_no: r for r in w.nearest(gaps, 40, distance, threshold=0.5).collect()}
        assert wide[30].ref_no == 10 and wide[30].begin == 0
        assert {r.line_no: r.ref_no for r in w.records(gaps, 40, distance, threshold=0.5).collect()}[30] == 10

    words = ["alpha beta", "alpha beta gamma", "", "beta", "ab", "alpha bet", "long " * 300, "alpha beta"]
    rows = [(s, i, False, False, words[(i * i + len(s)) % len(words)].encode()) for s in ("a", "bb") for i in range(1, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1] for r in rows]), pa.array([False] * len(rows)), pa.array([r[4] for r in rows])], ["stream", "seg", "line_no", "context", "line"])
    for name, q in (("minhash", 3), ("minhash", 2), ("cosine", 3), ("cosine", 1)):
        measure = Measure(name, q)
        want = []
        for stream, _, no, _, line, queue, mine in w.scan([batch], 7, measure):
            begin, d = w.choose(line, queue, measure, mine)
            want.append((stream, no, begin, queue[begin][2] if begin >= 0 else None, d, begin >= 0 and d < 0.4))
        for size, short in ((512, 1 << 18), (5, 1 << 18), (1, 0), (512, 0)):
            monkeypatch.setattr(w, "ROWS", size)
            monkeypatch.setattr(w, "SHORT", short)
            assert list(w._nearest_by_piece([batch.slice(0, 31), batch.slice(31)], 7, measure, 0.4)) == want, (name, q, size)
    assert w.segment_size(8) == 512 and w.segment_size(65535) >= 8 * 65535


def test_exact_records_are_those_made_line_by_line(spark):
    """Scripts are made for many lines at once; long pairs without much in common end soon."""
    import random
    import time
    from collections import deque

    from strandlog.functions.distances import Measure
    from strandlog.operators import window

    draw = random.Random(6)
    lines = ["abc" + draw.choice("xyz") * draw.randint(100, 150) for _ in range(30)] + ["".join(draw.choices("abcd", k=draw.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([("s", i + 1, x) for i, x in enumerate(lines)], "stream string, line_no long, line string")
    began = time.time()
    got = {r.line_no: r for r in window.records(df, 2, "cosine", threshold=1.0, approx=False).collect()}
    assert time.time() - began < 60 and len(got) == len(lines)
    measure, queue = Measure("cosine", 3), deque(maxlen=2)
    for i, x in enumerate(lines):
        line, mine, r = x.encode(), measure.prepare(x.encode()), got[i + 1]
        want = window.encode_line(line, queue, measure, mine, 1.0, False)
        ops = None if r.ops is None else [(o.position, o.d_length, bytes(o.substr)) for o in r.ops]
        assert (r.method, r.begin, r.matched, r.cost, ops) == tuple(want[k] for k in ("method", "begin", "matched", "cost", "ops"))
        queue.append((line, mine, i + 1))


def test_small_lines_are_searched_by_many_tasks(spark):
    """Adaptive execution joins small shuffled parts; the work on lines is long for their bytes and stays dealt out."""
    from strandlog.operators.window import records

    lines = spark.range(1, 2001).selectExpr("'s' AS stream", "id AS line_no", "concat('line ', id) AS line")
    made = records(lines, 1, "cosine", threshold=1.0, approx=False, segment=32)
    tasks = made.selectExpr("spark_partition_id() AS task").groupBy("task").count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in tasks) == 2000


def test_exact_sweep_adds_up_scripts_of_long_urls(spark, tmp_path):
    import time

    from strandlog.functions import deltas
    from strandlog.plans import registry

    urls = ["http://" + "abcdefgh"[i % 8] * (150 + i) for i in range(24)]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    began = time.time()
    got = {r.kind: r for r in registry.sweep_approx_exact(spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    each = [deltas.exact(a.encode(), b.encode()) for a, b in zip(urls, urls[1:])]
    assert got["exact"].cost == sum(c for _, c in each)
    assert got["exact"].n_delta == sum(c <= len(b) for (_, c), b in zip(each, urls[1:]))
