"""Named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import bits, codecs, deltas, sql
from strandlog.functions.columns import bit_width, codeword, cosine_pairs, gram_counts, hex_of_bits, padded_qgrams, qgrams, runs, same_places, second_deltas, signature_distance, with_minhash
from strandlog.functions.distances import HASHES, PRIME, minhash_params
from strandlog.operators import blocks
from strandlog.operators.window import OPS, applied, candidates, nearest, records
from strandlog.plans import sweeps
from strandlog.runtime import fresh_path, read, shared_dir, ship
from strandlog.sources.lines import conversation_lines, document_lines, event_lines, numbered, page_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT event_id + 1 AS line_no, concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), user_id, event_type, value, props) AS line FROM events)"
CONV = "cv AS (SELECT CAST(conv_id AS VARCHAR) AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS line_no, concat_ws(' ', role, text) AS line FROM conversations)"
URLS = "ul AS (SELECT row_number() OVER (ORDER BY page_id, url) AS line_no, url AS line FROM pages)"
RATE = 0.3


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _previous(lines: DataFrame) -> DataFrame:
    """(stream, line_no, line, ref): each line with the one before it."""
    return candidates(lines, 1).select("stream", "line_no", "line", "ref")


# Scans


@query("""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no, len(p) AS n FROM d)
SELECT CAST(doc_id AS VARCHAR) AS stream, line_no, line FROM l WHERE n = 1 OR line_no < n OR line <> ''""")
def line_scan(spark, d):
    return document_lines(spark, d)


@query(f"WITH {URLS} SELECT line_no, line FROM ul")
def line_number(spark, d):
    return page_lines(spark, d, "url").select("line_no", "line")


@query(f"""WITH {EV} SELECT (line_no - 1) // 1000 AS block_id, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, min(line_no) AS first_line FROM ev GROUP BY ALL""")
def block_stats(spark, d):
    e = event_lines(spark, d)
    return e.groupBy(F.floor((F.col("line_no") - 1) / 1000).alias("block_id")).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("n_bytes"), F.min("line_no").alias("first_line"))


@query(f"WITH {EV} SELECT line_no, line FROM ev ORDER BY line_no LIMIT 20")
def head_lines(spark, d):
    return event_lines(spark, d).orderBy("line_no").limit(20).select("line_no", "line")


@query(f"WITH {EV} SELECT line_no, line FROM ev WHERE regexp_matches(line, 'error|\"k\": 7')")
def compressed_grep(spark, d):
    return blocks.grep(blocks.compress(event_lines(spark, d), codec="zlib", distance="cosine", threshold=RATE), 'error|"k": 7').select("line_no", "line")


@query(f"""WITH {EV} SELECT line_no, line AS left_line, CASE WHEN line_no % 10 <> 3 THEN upper(line) END AS right_line FROM ev WHERE line_no % 10 = 3 OR line <> upper(line)""")
def line_diff(spark, d):
    e = event_lines(spark, d)
    other = e.filter("line_no % 10 <> 3").withColumn("line", F.upper("line"))
    return blocks.diff(e, other).select("line_no", "left_line", "right_line")


# Windows


@query(f"""WITH {EV} SELECT a.line_no, CAST(b.line_no - greatest(a.line_no - 8, 1) AS INTEGER) AS begin, b.line_no AS ref_no FROM ev a JOIN ev b ON b.line_no BETWEEN a.line_no - 8 AND a.line_no - 1""")
def window_candidates(spark, d):
    return candidates(event_lines(spark, d), 8).select("line_no", "begin", "ref_no")


def _grams_sql(table: str, q: int = 3, name: str = "g") -> str:
    return f"{name} AS (SELECT line_no, gram, count(*) AS c FROM (SELECT line_no, unnest(list_transform(range(1, length(line) - {q - 2}), lambda i: substr(line, i, {q}))) AS gram FROM {table}) GROUP BY ALL)"


def _cosine_sql(table: str, window: int, q: int = 3, suffix: str = "") -> str:
    """CTEs up to dist (line_no, ref_no, dot, n1, n2, distance)."""
    s = suffix
    return f"""{_grams_sql(table, q, "g" + s)},
n{s} AS (SELECT line_no, CAST(sum(c * c) AS BIGINT) AS n FROM g{s} GROUP BY ALL),
p{s} AS (SELECT line_no, line_no - k AS ref_no FROM {table}, range(1, {window + 1}) r(k) WHERE line_no > k),
x{s} AS (SELECT p.line_no, p.ref_no, CAST(sum(a.c * b.c) AS BIGINT) AS dot FROM p{s} p JOIN g{s} a ON a.line_no = p.line_no JOIN g{s} b ON b.line_no = p.ref_no AND b.gram = a.gram GROUP BY ALL),
dist{s} AS (SELECT p.line_no, p.ref_no, coalesce(x.dot, 0) AS dot, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2,
  CASE WHEN a.n IS NULL OR b.n IS NULL THEN 1.0::DOUBLE ELSE 1 - coalesce(x.dot, 0) / (sqrt(b.n::DOUBLE) * sqrt(a.n::DOUBLE)) END AS distance
  FROM p{s} p LEFT JOIN x{s} x USING (line_no, ref_no) LEFT JOIN n{s} a ON a.line_no = p.line_no LEFT JOIN n{s} b ON b.line_no = p.ref_no)"""


def _best_sql(window: int, table: str, threshold: float, suffix: str = "") -> str:
    s = suffix
    return f"""best{s} AS (SELECT * FROM dist{s} WHERE distance < 1.0 QUALIFY row_number() OVER (PARTITION BY line_no ORDER BY distance, ref_no) = 1),
near{s} AS (SELECT e.line_no, CAST(coalesce(b.ref_no - greatest(e.line_no - {window}, 1), -1) AS INTEGER) AS begin, b.ref_no, coalesce(b.distance, 1.0::DOUBLE) AS distance, coalesce(b.distance < {threshold}, false) AS is_match FROM {table} e LEFT JOIN best{s} b USING (line_no))"""


_A, _B = minhash_params()
_PARAMS = "prm AS (SELECT unnest(range(1, 51)) AS j, unnest([" + ", ".join(f"{x}::UHUGEINT" for x in _A) + "]) AS a, unnest([" + ", ".join(f"{x}::UHUGEINT" for x in _B) + "]) AS b)"


def _minhash_sql(table: str, window: int, q: int = 3) -> str:
    """CTEs of sig (line_no, sig) and dist."""
    return f"""{_PARAMS},
h AS (SELECT DISTINCT line_no, ((5381 * 33 + ascii(substr(line, i, 1))) * 33 + ascii(substr(line, i + 1, 1))) * 33 + ascii(substr(line, i + 2, 1)) AS h FROM (SELECT line_no, line, unnest(range(1, length(line) - 1)) AS i FROM {table})),
m AS (SELECT line_no, j, CAST(min(((a * h::UHUGEINT + b) % 18446744073709551616::UHUGEINT) % {PRIME}::UHUGEINT) AS BIGINT) AS v FROM h, prm GROUP BY ALL),
sig AS (SELECT e.line_no, e.line, coalesce(s.sig, list_transform(range({HASHES}), lambda i: -1::BIGINT)) AS sig FROM {table} e LEFT JOIN (SELECT line_no, list(v ORDER BY j) AS sig FROM m GROUP BY line_no) s USING (line_no)),
pm AS (SELECT a.line_no, b.line_no AS ref_no, a.line AS l1, b.line AS l2, CAST(list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: CAST(z[1] = z[2] AS INTEGER))) AS INTEGER) AS matches FROM sig a, range(1, {window + 1}) r(k) JOIN sig b ON b.line_no = a.line_no - k),
dist AS (SELECT line_no, ref_no, matches, CASE WHEN l1 = l2 THEN 0.0::DOUBLE WHEN least(strlen(l1), strlen(l2)) < {q} THEN 1.0::DOUBLE ELSE 1 - matches / 50::DOUBLE END AS distance FROM pm)"""


@query(f"WITH {EV}, {_grams_sql('ev')} SELECT gram, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY gram")
def qgram_counts(spark, d):
    return event_lines(spark, d).select(F.explode(qgrams(F.col("line"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, w AS (SELECT line_no, '$$' || line || '##' AS line FROM ev), {_grams_sql('w')} SELECT gram, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY gram")
def qgram_padded(spark, d):
    return event_lines(spark, d).select(F.explode(padded_qgrams(F.col("line"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, {_cosine_sql('ev', 1)} SELECT line_no, ref_no, dot, n1, n2, distance FROM dist")
def cosine_pairs_query(spark, d):
    e = event_lines(spark, d)
    return cosine_pairs(e, candidates(e, 1).select("stream", "line_no", "ref_no")).drop("stream")


QUERIES["cosine_pairs"], ORACLES["cosine_pairs"] = QUERIES.pop("cosine_pairs_query"), ORACLES.pop("cosine_pairs_query")


@query(f"WITH {EV}, {_minhash_sql('ev', 1)} SELECT line_no, array_to_string(sig, ',') AS signature FROM sig")
def minhash_signature(spark, d):
    return with_minhash(event_lines(spark, d)).select("line_no", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(f"WITH {EV}, {_minhash_sql('ev', 1)} SELECT line_no, ref_no, matches, distance FROM dist")
def minhash_pairs(spark, d):
    s = with_minhash(event_lines(spark, d))
    old = s.select("stream", (F.col("line_no") + 1).alias("line_no"), F.col("line_no").alias("ref_no"), F.col("line").alias("ref"), F.col("signature").alias("its"))
    both = s.join(old, ["stream", "line_no"])
    short = F.least(F.octet_length("line"), F.octet_length("ref")) < 3
    distance = F.when(F.col("line") == F.col("ref"), 0.0).when(short, 1.0).otherwise(signature_distance(F.col("signature"), F.col("its")))
    return both.select("line_no", "ref_no", same_places(F.col("signature"), F.col("its")).alias("matches"), distance.alias("distance"))


@query(f"WITH {EV}, {_cosine_sql('ev', 8)}, {_best_sql(8, 'ev', RATE)} SELECT * FROM near")
def nearest_cosine(spark, d):
    return nearest(event_lines(spark, d), 8, "cosine", threshold=RATE).drop("stream")


@query(f"WITH {EV}, {_minhash_sql('ev', 8)}, {_best_sql(8, 'ev', RATE)} SELECT * FROM near")
def nearest_minhash(spark, d):
    return nearest(event_lines(spark, d), 8, "minhash", threshold=RATE).drop("stream")


@query()
def nearest_qgram(spark, d):
    return nearest(event_lines(spark, d), 8, "qgram", threshold=RATE).drop("stream")


@query(f"WITH {EV}, {_cosine_sql('ev', 8)}, {_best_sql(8, 'ev', RATE)} SELECT line_no, ref_no FROM near WHERE is_match")
def threshold_match(spark, d):
    return nearest(event_lines(spark, d), 8, "cosine", threshold=RATE).filter("is_match").select("line_no", "ref_no")


@query(f"WITH {EV}, {_cosine_sql('ev', 8)}, {_best_sql(8, 'ev', RATE)} SELECT count(*) AS n_lines, count(*) FILTER (is_match) AS n_matched, count(*) FILTER (is_match) / count(*)::DOUBLE AS match_rate FROM near")
def match_rate(spark, d):
    hit = F.count(F.when(F.col("is_match"), 1))
    return nearest(event_lines(spark, d), 8, "cosine", threshold=RATE).agg(F.count("*").alias("n_lines"), hit.alias("n_matched"), (hit / F.count("*")).alias("match_rate"))


# Edit scripts


def _event_records(spark, d):
    return records(event_lines(spark, d), 8, "cosine", threshold=RATE)


@query()
def method_choice(spark, d):
    return _event_records(spark, d).select("line_no", "method", "matched", "cost")


@query()
def delta_ops_approx(spark, d):
    return _event_records(spark, d).filter("method = 0").select("line_no", "ref_no", F.to_json(F.transform("ops", lambda o: F.struct(o["position"].alias("position"), o["d_length"].alias("d_length"), F.decode(o["substr"], "UTF-8").alias("substr")))).alias("ops"))


@query()
def delta_ops_exact(spark, d):
    r = records(page_lines(spark, d, "url"), 1, "cosine", threshold=1.0, approx=False, segment=32)
    return r.filter("method = 0").select("line_no", "ref_no", "cost", F.to_json(F.transform("ops", lambda o: F.struct(o["position"].alias("position"), o["d_length"].alias("d_length"), F.decode(o["substr"], "UTF-8").alias("substr")))).alias("ops"))


@query("SELECT CAST(0 AS BIGINT) AS differing")
def op_cost(spark, d):
    """Scripts whose cost is not 5 + the sum of 3 and the inserted bytes over their operations."""
    formula = F.aggregate("ops", F.lit(5.0), lambda a, o: a + 3 + o["i_length"])
    return _event_records(spark, d).filter("method = 0").agg(F.count(F.when(F.col("cost") != formula, 1)).alias("differing"))


def scripts(pairs: DataFrame, approx: bool = True, q: int = 3) -> DataFrame:
    """(stream, line_no, ref, ops) of pairs (stream, line_no, line, ref)."""
    ship(pairs.sparkSession)
    op = pa.struct([("position", pa.int32()), ("d_length", pa.int32()), ("i_length", pa.int32()), ("substr", pa.binary())])

    def run(batches):
        for b in batches:
            both = list(zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True))
            each = [deltas.approximate(old, new, q) for old, new in both] if approx else deltas.exact_many(both)
            made = [[{"position": p, "d_length": n, "i_length": len(s), "substr": s} for p, n, s in ops] for ops, _ in each]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(made, pa.list_(op))], ["stream", "line_no", "ref", "ops"])

    cols = pairs.select("stream", "line_no", F.encode("line", "UTF-8").alias("line"), F.encode("ref", "UTF-8").alias("ref"))
    return cols.mapInArrow(run, f"stream string, line_no long, ref binary, ops {OPS}")


@query(f"WITH {CONV} SELECT stream, line_no, line FROM cv WHERE line_no > 1")
def delta_roundtrip_pair(spark, d):
    s = scripts(_previous(conversation_lines(spark, d)))
    return s.select("stream", "line_no", F.decode(applied(F.col("ref"), F.col("ops")), "UTF-8").alias("line"))


@query(f"WITH {URLS} SELECT line_no, line FROM ul WHERE line_no > 1")
def delta_roundtrip_exact(spark, d):
    s = scripts(_previous(page_lines(spark, d, "url")).repartition(4 * spark.sparkContext.defaultParallelism), approx=False)
    return s.select("line_no", F.decode(applied(F.col("ref"), F.col("ops")), "UTF-8").alias("line"))


@query()
def position_streams(spark, d):
    """First positions and steps between positions inside a record."""
    r = _event_records(spark, d).filter("method = 0").select("line_no", F.posexplode("ops").alias("i", "op"))
    step = F.col("op.position") - F.lag("op.position").over(Window.partitionBy("line_no").orderBy("i"))
    return r.select("line_no", "i", F.when(F.col("i") == 0, "first").otherwise("step").alias("kind"), F.coalesce(step, F.col("op.position")).alias("value"))


@query()
def qgram_op_distance(spark, d):
    """Operation distance of each line and the one before it, by the SQL function."""
    sql.register(spark)
    return _previous(event_lines(spark, d)).select("line_no", F.call_function("qgram_distance", "ref", "line").alias("distance"))


# Blocks and codecs


@query()
def block_encode(spark, d):
    """The coded payload of every block."""
    return blocks.compress(event_lines(spark, d), distance="cosine", threshold=RATE, block_size=1000).select("block_id", "n_lines", "n_delta", "coded_bytes", F.hex("payload").alias("payload_hex"))


@query(f"WITH {EV} SELECT line_no, line FROM ev")
def stream_roundtrip(spark, d):
    return blocks.decompress(blocks.compress(event_lines(spark, d), codec="zstd", distance="cosine", threshold=RATE)).select("line_no", "line")


@query(f"WITH {CONV} SELECT stream, line_no, line FROM cv")
def chain_roundtrip(spark, d):
    return blocks.decompress(blocks.compress(conversation_lines(spark, d), codec="lzma", block_size=3, threshold=0.9, anchor="stream"))


@query("SELECT row_number() OVER (ORDER BY page_id, html) AS line_no, html AS line FROM pages")
def block_roundtrip(spark, d):
    return blocks.decompress(blocks.compress(page_lines(spark, d), block_size=64, window=2, distance="minhash", threshold=0.5)).select("line_no", "line")


@query()
def block_encoding_stats(spark, d):
    return blocks.compress(event_lines(spark, d), codec="zstd", distance="cosine", threshold=RATE).select("block_id", "n_lines", "n_delta", "raw_bytes", "coded_bytes", F.length("payload").alias("payload_bytes"))


@query(f"WITH {EV} SELECT count(*) AS n_lines, CAST(ceil(count(*) / 1000) AS BIGINT) AS n_blocks, CAST(sum(strlen(line) + 1) AS BIGINT) AS raw_bytes FROM ev")
def compress_summary(spark, d):
    return sweeps.compressed_sizes(event_lines(spark, d), codec="lzma", block_size=1000, distance="cosine", threshold=RATE).select("n_lines", "n_blocks", "raw_bytes")


def through(df: DataFrame, column: str, codec: str) -> DataFrame:
    """df with a string column compressed and decompressed."""
    ship(df.sparkSession)
    names, at = df.columns, df.columns.index(column)

    def run(batches):
        for b in batches:
            made = [None if x is None else codecs.decompress(codecs.compress(x.encode(), codec), codec).decode() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names)

    return df.mapInArrow(run, df.schema)


for _codec in ("none", "lzma", "gzip", "zstd", "bz2"):
    QUERIES[f"codec_roundtrip_{_codec}"] = lambda spark, d, c=_codec: through(read(spark, d, "pages").select("page_id", "html"), "html", c)
    ORACLES[f"codec_roundtrip_{_codec}"] = "SELECT page_id, html FROM pages"


@query(f"WITH {EV} SELECT line FROM ev")
def codec_roundtrip_lz4(spark, d):
    path = fresh_path(spark, "lz4")
    event_lines(spark, d).select("line").write.option("compression", "lz4").option("lineSep", "\n").text(path)
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


# Column codecs; the series are each user's events in order


def _series(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("flag"))


SERIES = "s AS (SELECT user_id, event_id, CAST(event_type = 'error' AS INTEGER) AS flag FROM events)"
RUNS = """nw AS (SELECT *, CASE WHEN flag = lag(flag) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM s),
rn AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM nw),
rl AS (SELECT user_id, run, max(flag) AS flag, count(*) AS n FROM rn GROUP BY user_id, run)"""
WORD = "repeat('1', greatest(2, length(bin(n))) - 2) || '0' || lpad(bin(n), CAST(greatest(2, length(bin(n))) AS INTEGER), '0')"


@query(f"SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, {WORD.replace('bin(n)', 'bin(CAST(l_quantity AS BIGINT))')} AS word FROM lineitem")
def rle_codeword(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("n")).distinct().withColumn("word", codeword(F.col("n")))


@query(f"WITH {SERIES}, {RUNS} SELECT user_id, run, flag, n FROM rl")
def rle_runs(spark, d):
    return runs(_series(spark, d), "user_id", "event_id", "flag")


@query(f"WITH {SERIES}, {RUNS} SELECT user_id, CAST(first(flag ORDER BY run) AS VARCHAR) || string_agg({WORD}, '' ORDER BY run) AS bits FROM rl GROUP BY user_id")
def rle_bits(spark, d):
    r = runs(_series(spark, d), "user_id", "event_id", "flag").select("user_id", F.struct("run", "flag", codeword(F.col("n")).alias("word")).alias("r"))
    r = r.groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return r.select("user_id", F.concat(F.col("r")[0]["flag"].cast("string"), F.array_join(F.col("r.word"), "")).alias("bits"))


def coded_series(df: DataFrame, key: str, order: str, value: str, there_and_back: Callable) -> DataFrame:
    """(key, order, value) with each key's values, in pieces of 4096, coded and decoded by there_and_back(list)."""
    ship(df.sparkSession)
    number = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / 4096)
    lists = df.withColumn("piece", number).groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(value).cast("long").alias("v")))).alias("l"))

    def run(batches):
        for b in batches:
            ids, orders, values = [], [], []
            for k, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids += [k] * len(pairs)
                orders += [p["o"] for p in pairs]
                values += there_and_back([p["v"] for p in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, orders, values)], [key, order, value])

    return lists.select(F.col(key).cast("long"), "l").mapInArrow(run, f"{key} long, {order} long, {value} long")


@query(f"WITH {SERIES} SELECT user_id, event_id, CAST(flag AS BIGINT) AS flag FROM s")
def rle_roundtrip(spark, d):
    return coded_series(_series(spark, d), "user_id", "event_id", "flag", lambda v: bits.rle_decode(*bits.rle_encode(v)))


@query("SELECT user_id, CAST(CASE WHEN max(event_id) = 0 THEN 0 ELSE length(bin(max(event_id))) END AS INTEGER) AS width FROM events GROUP BY user_id")
def bitpack_width(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(bit_width(F.max("event_id")).cast("int").alias("width"))


@query("WITH w AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS top FROM events) SELECT user_id, string_agg(lpad(bin(event_id), CAST(length(bin(top)) AS INTEGER), '0'), '' ORDER BY event_id) AS bits FROM w GROUP BY user_id")
def bitpack_bits(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("v"), F.max("event_id").alias("top"))
    return e.select("user_id", F.array_join(F.transform("v", lambda x: F.lpad(F.bin(x), F.length(F.bin("top")), F.lit("0"))), "").alias("bits"))


@query("SELECT user_id, event_id, event_id AS value FROM events")
def bitpack_roundtrip(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("value"))
    return coded_series(e, "user_id", "event_id", "value", lambda v: bits.bitpack_decode(bits.bitpack_encode(v), len(v)))


T2 = """i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
dl AS (SELECT *, i // 64 AS block, event_id - lag(event_id) OVER (PARTITION BY user_id, i // 64 ORDER BY i) AS delta FROM i),
bk AS (SELECT user_id, block, arg_min(event_id, i) AS first, coalesce(min(delta), 0) AS min_delta, count(delta) AS n, coalesce(max(delta) - min(delta), 0) AS span FROM dl GROUP BY user_id, block),
t2 AS (SELECT user_id, block, first, min_delta, n, CAST(CASE WHEN n = 0 THEN 0 ELSE length(bin(greatest(span, 1))) END AS INTEGER) AS width, CAST(ceil(CASE WHEN n = 0 THEN 76 ELSE 84 + length(bin(greatest(span, 1))) * n END / 8) AS BIGINT) AS bytes FROM bk)"""


def _t2(spark, d):
    return second_deltas(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id")


@query(f"WITH {T2} SELECT * FROM t2")
def ts2diff_blocks(spark, d):
    return _t2(spark, d)


@query(f"WITH {T2} SELECT user_id, CAST(4 + sum(bytes) AS BIGINT) AS bytes FROM t2 GROUP BY user_id")
def ts2diff_size(spark, d):
    return _t2(spark, d).groupBy("user_id").agg((F.sum("bytes") + 4).cast("long").alias("bytes"))


@query("SELECT user_id, event_id, event_id AS value FROM events")
def ts2diff_roundtrip(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("value"))
    return coded_series(e, "user_id", "event_id", "value", lambda v: bits.ts2diff_decode(bits.ts2diff_encode(v)))


@query("SELECT DISTINCT bin(event_id % 4096) AS bits, upper(array_to_string(list_transform(range(CAST(ceil(length(bin(event_id % 4096)) / 8) AS BIGINT)), lambda k: printf('%02X', CAST(list_sum(list_transform(range(8), lambda j: CAST(substr(rpad(bin(event_id % 4096), 16, '0'), CAST(8 * k + j + 1 AS INTEGER), 1) AS INTEGER) * (128 >> CAST(j AS INTEGER)))) AS INTEGER))), '')) AS hex FROM events")
def bits_to_hex(spark, d):
    b = read(spark, d, "events").select(F.bin(F.col("event_id") % 4096).alias("bits")).distinct()
    return b.withColumn("hex", hex_of_bits(F.col("bits")))


@query("SELECT r_regionkey AS codec, 8 + r_regionkey AS window_size, printf('%04X%02X', 8 + r_regionkey, r_regionkey + (r_regionkey % 3) * 16 + 128) AS header FROM region")
def header_pack(spark, d):
    code = F.col("r_regionkey")
    packed = (8 + code).cast("long") * 256 + code + code % 3 * 16 + 128
    return read(spark, d, "region").select(code.alias("codec"), (8 + code).alias("window_size"), F.lpad(F.hex(packed), 6, "0").alias("header"))


# Sweeps


_STEP_SQL = "SELECT '{0}' AS measure, CAST(step AS INTEGER) AS step, CAST(count(*) FILTER (distance < step / 50::DOUBLE) AS BIGINT) AS matched FROM near{1}, range(51) r(step) WHERE begin >= 0 GROUP BY ALL"


@query(f"WITH {EV}, {_minhash_sql('ev', 8)}, {_best_sql(8, 'ev', 0.06)}, {_cosine_sql('ev', 8, suffix='c')}, {_best_sql(8, 'ev', 0.06, 'c')} {_STEP_SQL.format('minhash', '')} UNION ALL {_STEP_SQL.format('cosine', 'c')}")
def sweep_distance_threshold(spark, d):
    return sweeps.thresholds(event_lines(spark, d), ("minhash", "cosine"))


_SIZES = [1, 2, 4, 8, 16, 32]


@query(f"WITH {EV}, {_cosine_sql('ev', 32)} " + " UNION ALL ".join(f"SELECT {w} AS \"window\", count(DISTINCT line_no) AS matched FROM dist WHERE distance < {RATE} AND ref_no >= line_no - {w}" for w in _SIZES))
def sweep_window(spark, d):
    return sweeps.windows(event_lines(spark, d), _SIZES, threshold=RATE)


@query(f"WITH {EV}, " + ", ".join(_cosine_sql("ev", 1, q, f"_{q}") for q in range(1, 7)) + " " + " UNION ALL ".join(f"SELECT {q} AS q, count(*) FILTER (distance < {RATE} AND distance < 1) AS matched FROM dist_{q}" for q in range(1, 7)))
def sweep_q(spark, d):
    return sweeps.grams(event_lines(spark, d), list(range(1, 7)), threshold=RATE)


_BLOCKS = [100 * 2**i for i in range(10)] + [100_000]


@query(f"WITH {EV} SELECT z AS block_size, CAST(ceil(count(*) / z) AS BIGINT) AS n_blocks, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM ev, (SELECT unnest({_BLOCKS}) AS z) GROUP BY z")
def sweep_block_size(spark, d):
    return sweeps.block_sizes(event_lines(spark, d), _BLOCKS)


@query(f"WITH {EV}, c AS (SELECT line_no, CAST(sum(strlen(line) + 1) OVER (ORDER BY line_no) AS BIGINT) AS n_bytes FROM ev) SELECT line_no AS size, n_bytes FROM c WHERE line_no % 500 = 0")
def sweep_data_size(spark, d):
    return sweeps.data_sizes(event_lines(spark, d))


@query()
def sweep_record_order(spark, d):
    make = lambda df, order: numbered(df, F.col("stream"), order, F.col("line"))
    return sweeps.orders(event_lines(spark, d), make, codec="lzma", distance="cosine", threshold=RATE)


@query()
def sweep_codec(spark, d):
    out = None
    for codec in ("none", "lzma", "zlib", "zstd", "bz2"):
        one = sweeps.compressed_sizes(event_lines(spark, d), codec=codec, distance="cosine", threshold=RATE).select(F.lit(codec).alias("codec"), "*")
        out = one if out is None else out.union(one)
    return out


@query()
def sweep_approx_exact(spark, d):
    u = page_lines(spark, d, "url")
    both = [records(u, 1, "cosine", threshold=1.0, approx=a, segment=32).agg(F.lit("approx" if a else "exact").alias("kind"), F.count(F.when(F.col("method") == 0, 1)).alias("n_delta"), F.sum("cost").alias("cost"), F.sum(F.aggregate("ops", F.lit(0), lambda x, o: x + o["i_length"])).alias("inserted")) for a in (True, False)]
    return both[0].union(both[1])


_SPLIT = ("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")


@query(
    f"WITH u AS (SELECT l_returnflag, unnest([{', '.join(repr(c) for c in _SPLIT)}]) AS column_name, "
    f"unnest([{', '.join(f'CAST({c} AS BIGINT)' for c in _SPLIT)}]) AS value FROM lineitem) "
    "SELECT l_returnflag, column_name, count(*) AS n, CAST(sum(length(CAST(value AS VARCHAR)) + 1) AS BIGINT) AS text_bytes, "
    "CAST(ceil(count(*) * length(bin(max(value))) / 8) + 1 AS BIGINT) AS packed_bytes FROM u GROUP BY ALL"
)
def column_split(spark, d):
    """Each field of line items coded by itself: packed bits of a column against its text, by return flag."""
    li = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("l_quantity"), "l_partkey", "l_suppkey")
    cols = li.columns[1:]
    long = li.select("l_returnflag", *[F.col(c).cast("long").alias(c) for c in cols]).unpivot(["l_returnflag"], cols, "column_name", "value")
    return long.groupBy("l_returnflag", "column_name").agg(F.count("*").alias("n"), F.sum(F.length(F.col("value").cast("string")) + 1).alias("text_bytes"), (F.ceil(F.count("*") * F.length(F.bin(F.max("value"))) / 8) + 1).alias("packed_bytes"))


# Analytics of results


_BY_SOURCE = "s AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS original, CAST(sum(DISTINCT_bytes) AS BIGINT) AS compressed FROM (SELECT source, text, CASE WHEN row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1 THEN strlen(text) ELSE 0 END AS DISTINCT_bytes FROM documents) GROUP BY source)"


def _by_source(spark, d):
    docs = read(spark, d, "documents").select("source", F.octet_length("text").cast("long").alias("b"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    each = docs.groupBy("source", "h").agg(F.sum("b").alias("all"), F.max("b").alias("once"))
    return each.groupBy("source").agg(F.sum("all").alias("original"), F.sum("once").alias("compressed"))


@query(f"WITH {_BY_SOURCE} SELECT source, original, compressed, CASE WHEN compressed = 0 THEN 0.0::DOUBLE ELSE original / compressed END AS ratio FROM s")
def ratio_by_source(spark, d):
    return _by_source(spark, d).withColumn("ratio", sweeps.ratio(F.col("original"), F.col("compressed")))


@query(f"WITH {_BY_SOURCE} SELECT source, original / 1048576::DOUBLE / (1 + length(source)) AS mib_s, original / 1000000::DOUBLE / (1 + length(source)) AS mb_s FROM s")
def speed_by_source(spark, d):
    seconds = 1 + F.length("source")
    return _by_source(spark, d).select("source", sweeps.speed(F.col("original"), seconds).alias("mib_s"), sweeps.speed(F.col("original"), seconds, 10**6).alias("mb_s"))


_METRICS = "mt AS (SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY ALL)"


def _metrics(spark, d):
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query(f"WITH {_METRICS} SELECT c.conv_id, m.source, m.n FROM (SELECT DISTINCT conv_id, 'src' || (conv_id % 25) AS source FROM conversations) c LEFT JOIN mt m ON m.source = c.source AND m.lang = 'en'")
def metric_join(spark, d):
    """A lookup by key, with a null where the key has no result."""
    keys = read(spark, d, "conversations").select("conv_id", F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("source")).distinct()
    m = _metrics(spark, d).filter("lang = 'en'").select(F.col("source").alias("found"), "n")
    return keys.join(m, F.col("source") == F.col("found"), "left").select("conv_id", F.col("found").alias("source"), "n")


@query(f"WITH {_METRICS} SELECT lang, count(*) AS n_sources, avg(n) AS mean_docs, avg(n) FILTER (source <> 'src0') AS mean_docs_without FROM mt GROUP BY lang")
def method_means(spark, d):
    return _metrics(spark, d).groupBy("lang").agg(F.count("*").alias("n_sources"), F.avg("n").alias("mean_docs"), F.avg(F.when(F.col("source") != "src0", F.col("n"))).alias("mean_docs_without"))


@query(f"WITH {_METRICS} SELECT CAST(max(greatest(n, chars, longest)) AS BIGINT) AS best FROM mt")
def best_ratio(spark, d):
    return _metrics(spark, d).agg(F.max(F.greatest("n", "chars", "longest")).alias("best"))


@query(f"WITH {EV} SELECT line_no, line FROM ev WHERE (line_no - 1) % 3 = 0", "every_third")
def every_third(spark, d):
    return event_lines(spark, d).filter((F.col("line_no") - 1) % 3 == 0).select("line_no", "line")


QUERIES["sample_every_3"], ORACLES["sample_every_3"] = QUERIES.pop("every_third"), ORACLES.pop("every_third")


@query(f"WITH {_METRICS}, k AS (SELECT source || '/' || coalesce(lang, '') AS dataset, n, chars, longest FROM mt) SELECT dataset, 'n' AS metric, n AS value FROM k UNION ALL SELECT dataset, 'chars', chars FROM k UNION ALL SELECT dataset, 'longest', longest FROM k")
def unpivot_metrics(spark, d):
    m = _metrics(spark, d).select(F.concat(F.col("source"), F.lit("/"), F.coalesce("lang", F.lit(""))).alias("dataset"), "n", "chars", "longest")
    return sweeps.wide_to_long(m, "dataset", ["n", "chars", "longest"])


@query("SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS least FROM events")
def running_min(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", F.min("value").over(Window.partitionBy("user_id").orderBy("event_id")).alias("least"))


_NAMED = "nm AS (SELECT source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_restructured' ELSE '_shuffled' END AS name, n_chars FROM documents)"


@query(f"WITH {_NAMED} SELECT regexp_extract(name, '^(.*?)(_restructured|_shuffled)?$', 1) AS dataset, CAST(sum(n_chars) FILTER (name NOT LIKE '%\\_%' ESCAPE '\\') AS BIGINT) AS original, CAST(sum(n_chars) FILTER (name LIKE '%\\_restructured' ESCAPE '\\') AS BIGINT) AS restructured, CAST(sum(n_chars) FILTER (name LIKE '%\\_shuffled' ESCAPE '\\') AS BIGINT) AS shuffled FROM nm GROUP BY ALL")
def order_pivot(spark, d):
    suffix = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "_restructured").otherwise("_shuffled")
    named = read(spark, d, "documents").select(F.concat("source", suffix).alias("name"), "n_chars")
    parts = named.select(F.regexp_extract("name", "^(.*?)(_restructured|_shuffled)?$", 1).alias("dataset"), F.regexp_extract("name", "^(.*?)(_restructured|_shuffled)?$", 2).alias("kind"), "n_chars")
    parts = parts.withColumn("kind", F.when(F.col("kind") == "", "original").otherwise(F.substring("kind", 2, 20)))
    return parts.groupBy("dataset").pivot("kind", ["original", "restructured", "shuffled"]).agg(F.sum("n_chars"))


@query("SELECT event_id, CAST(regexp_extract('Total time: ' || value || ' s', 'Total time: ([0-9.]+)', 1) AS DOUBLE) AS seconds FROM events")
def extract_metric(spark, d):
    return read(spark, d, "events").select("event_id", F.regexp_extract(F.concat(F.lit("Total time: "), F.col("value").cast("string"), F.lit(" s")), "Total time: ([0-9.]+)", 1).cast("double").alias("seconds"))


@query("SELECT event_type, " + ", ".join(f'count(*) FILTER (user_id % 4 = {i}) AS "w{i}"' for i in range(4)) + " FROM events GROUP BY event_type")
def time_matrix(spark, d):
    e = read(spark, d, "events").select("event_type", F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("w"))
    return e.groupBy("event_type").pivot("w", [f"w{i}" for i in range(4)]).agg(F.count(F.lit(1))).na.fill(0)


# Streaming


# Streams are told apart by far-off numbers, and a line's bytes become characters, one for each.
_CONV_BYTES = (
    "cb AS (SELECT stream, line_no AS no, CAST(stream AS BIGINT) * 1000000 + line_no AS line_no, list_aggregate(list_transform("
    "range(octet_length(encode(line))), lambda i: chr(CAST('0x' || substr(hex(encode(line)), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER))), "
    "'string_agg', '') AS line FROM cv)"
)


@query(
    f"WITH {CONV}, {_CONV_BYTES}, {_minhash_sql('cb', 8)}, "
    "best AS (SELECT * FROM dist WHERE distance < 1.0 QUALIFY row_number() OVER (PARTITION BY line_no ORDER BY distance, ref_no) = 1) "
    "SELECT e.stream, e.no AS line_no, CAST(coalesce(r.no - greatest(e.no - 8, 1), -1) AS INTEGER) AS begin, r.no AS ref_no, "
    f"coalesce(b.distance, 1.0::DOUBLE) AS distance, coalesce(b.distance < {RATE}, false) AS is_match "
    "FROM cb e LEFT JOIN best b USING (line_no) LEFT JOIN cb r ON r.line_no = b.ref_no"
)
def stream_nearest(spark, d):
    """The window as streaming state over conversations; equals `nearest` on the same lines."""
    from strandlog.streaming.windowed import nearest_stream

    lines_dir, out = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    conversation_lines(spark, d).write.parquet(lines_dir)
    source = spark.readStream.schema("stream string, line_no long, line string").parquet(lines_dir)
    work = nearest_stream(source, 8, "minhash", threshold=RATE).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{shared_dir(spark)}/{out.rsplit('/', 1)[1]}-state").trigger(availableNow=True).start()
    work.awaitTermination()
    return spark.read.schema("stream string, line_no long, begin int, ref_no long, distance double, is_match boolean").parquet(out)
