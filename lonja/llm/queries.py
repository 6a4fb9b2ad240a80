"""Queries over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.decontam import contaminated
from lonja.llm.langid import identify
from lonja.llm.line_dedup import line_report, removed_lines
from lonja.llm.mixing import mix
from lonja.llm.ogg import read_media_column, store_media
from lonja.llm.sharding import place
from lonja.llm.simhash import near_duplicates
from lonja.llm.store import Scratch
from lonja.llm.substring_dedup import digest, remove_repeats
from lonja.llm.tables import numbered, table
from lonja.llm.token_counts import section_tokens
from lonja.llm.token_files import token_digest, write_token_files

BYTE_BPE = "byte_bpe_50k.json"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media_column(store_media(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), profile_size=400)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), rule="largest")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing"), weights=(1, 2, 3), share=1.0, most=3.0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"), window=20))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lines")
    docs = numbered(table(spark, sf_dir, "documents"), scratch)
    report = line_report(docs, removed_lines(docs, scratch))
    return report.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"), shingle=3, radius=3)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("ids")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), end_id=0)
    return token_digest(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg": op1_ogg,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_token_files": op10_token_files,
}

_MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources
), level AS (
  SELECT coalesce(max((total - fixed)::DOUBLE / open_weight::DOUBLE), 0) AS level FROM filling
), aims AS (
  SELECT source, source_size, least(most::DOUBLE, level * weight) AS target FROM filling, level
), ranked AS (
  SELECT d.doc_id, d.size, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS full_copies,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       (size * (full_copies + CASE WHEN 2 * up_to - own <= 2 * (target - full_copies * source_size) AND target > full_copies * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

_SUBSTRING_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS content FROM docs, unnest(range(1, len(words) - 18)) AS t(start)
), later AS (
  SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) AS turn FROM windows) WHERE turn > 1
), gone AS (
  SELECT doc_id, list(DISTINCT start + step) AS places FROM later, range(0, 20) AS t(step) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda w, i: NOT coalesce(list_contains(places, i), false)), ' ')) AS kept_sha256
FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""

_LINE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS ls FROM documents
), lines AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line, length(ls[i]) AS n FROM docs, unnest(range(1, len(ls) + 1)) AS t(i)
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM lines
), distinct_lines AS (
  SELECT line, n, min(place) AS place FROM ranked GROUP BY line, n
), halves AS (
  SELECT line, place, n + more AS m, side, CASE side WHEN 'first' THEN left(line, (n + more) // 2) ELSE right(line, (n + more) // 2) END AS half
  FROM distinct_lines, (VALUES (0), (1)) AS a(more), (VALUES ('first'), ('last')) AS b(side)
), near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND b.place < a.place
  WHERE levenshtein(a.line, b.line) <= 1
), gone AS (
  SELECT r.doc_id, r.line_no FROM ranked r JOIN distinct_lines d ON r.line = d.line LEFT JOIN near x ON r.line = x.line
  WHERE r.place <> d.place OR x.line IS NOT NULL
), per_doc AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.ls) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM docs d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": _MIXING_SQL,
    "op6_substring_dedup": _SUBSTRING_SQL,
    "op8_line_dedup": _LINE_SQL,
}
