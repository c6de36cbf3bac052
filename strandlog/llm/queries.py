"""The ten queries, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import iblt, langid, linededup, packing, pieces, simhash, toxicity, vafile, warc, wavelet
from strandlog.runtime import read

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOXIC_AT = 0.7


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare(read(spark, sf_dir, "documents")).drop("lost", "gained")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(read(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(read(spark, sf_dir, "embeddings")).drop("exact_reads")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORD_MODEL)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity.score(docs, model, F.coalesce(remainder(3) == 1, F.lit(False)), TOXIC_AT)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(read(spark, sf_dir, "documents"), WORD_MODEL)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(5) != 0)
    return langid.predict(docs, model, F.coalesce(remainder(5) == 0, F.lit(False)))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_warc, op3_fingerprints, op4_line_dedup, op5_pieces, op6_top_k, op7_packing, op8_toxicity, op9_token_files, op10_language)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS hex FROM p),
k AS (SELECT hex, max(page_id) AS keeper FROM h GROUP BY hex),
b AS (
  SELECT page_id, string_agg(substr('{_BASE32}', CAST((v >> (5 * (3 - j))) & 31 AS INTEGER) + 1, 1), '' ORDER BY i, j) AS digest
  FROM (SELECT page_id, i, j, CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) AS v FROM h, range(8) a(i), range(4) c(j)) GROUP BY page_id
)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
  CASE WHEN h.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM h JOIN k USING (hex) JOIN b USING (page_id)
""",
    "op4_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op6_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
""",
}
