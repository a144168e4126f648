"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscope.llm import decontaminate, html, licenses, quality, rules, sentencepieces, sharding, simhash, substrings, toxicity
from rowscope.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.classify(docs.select("doc_id", "text", "source", "lang"), model)
    return out.select("doc_id", "evidence", "site_rows", "site_rate", "score", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, lexicon).select("doc_id", "held_out", "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_report(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.apply_rules(docs.select("doc_id", "text"), model)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), sentencepieces.Vocabulary.load())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.col("n_chars"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_toxicity, op3_decontamination, op4_suffix_array_dedup, op5_simhash, op6_quality_rules, op7_license_scans, op8_sentencepiece, op9_sharding, op10_html_extraction)}

# The CRC-32 remainders of the eight single bits of a byte.
_CRC_BITS = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: the table entry of a byte is the xor of the remainders of its bits."""
    bits = "0"
    for i, c in enumerate(_CRC_BITS):
        bits = f"xor({bits}, ((xor(c, b) >> {i}) & 1) * {c})"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, {bits}), 4294967295::BIGINT), 4294967295)"


def _sharding_sql(n_shards: int = 16, seed: int = 7, rows_per_bin: int = 20_000) -> str:
    """The smallest draw of all leaves is the leaf that the descent reaches."""
    return f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
keys AS (SELECT DISTINCT doc_id FROM d),
draws AS (SELECT doc_id, s, -ln((('0x' || substr(md5('{seed}|' || s || '|' || CASE WHEN doc_id IS NULL THEN 'n' ELSE 'v' || doc_id END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS x FROM keys, range({n_shards + 1}) t(s)),
picked AS (SELECT doc_id, (arg_min(s, x) FILTER (WHERE s < {n_shards}))::INTEGER AS shard, arg_min(s, x)::INTEGER AS grown_shard FROM draws GROUP BY doc_id),
binned AS (SELECT d.*, shard, grown_shard, ('0x' || substr(md5(concat_ws('|', d.doc_id, text_crc32, size)), 1, 13))::BIGINT % greatest(4, ceil((SELECT count(*) FROM d) / {rows_per_bin}.0)::BIGINT) AS bin FROM d JOIN picked p ON d.doc_id IS NOT DISTINCT FROM p.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bin, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM binned"""


def _substrings_sql(length: int = 200) -> str:
    """Every window of the texts' bytes, written as hexadecimal digits, counted; what repeated windows cover goes."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5_number(substr(h, 2 * s + 1, {2 * length})) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - {length - 1}))) AS s FROM d)),
hit AS (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
runs AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {length} THEN 0 ELSE 1 END AS new FROM hit),
spans AS (SELECT r, min(s) AS a, max(s) + {length} AS z FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM runs) GROUP BY r, g),
ends AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT e.r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS last FROM ends e JOIN d ON d.r = e.r GROUP BY e.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r"""


#: The others have trained models, 64-bit hashes of a kind or rules that SQL does not have; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op4_suffix_array_dedup": _substrings_sql(), "op9_sharding": _sharding_sql()}
