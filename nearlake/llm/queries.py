"""The named queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearlake.llm.common import table
from nearlake.llm.html import extract_main_text
from nearlake.llm.licenses import scan_licenses
from nearlake.llm.line_dedup import dedup_digests
from nearlake.llm.media import media_digests
from nearlake.llm.mixing import mix
from nearlake.llm.near_duplicates import near_duplicates
from nearlake.llm.packing import pack_documents
from nearlake.llm.periodic_runs import run_digests
from nearlake.llm.pii import find_personal_data
from nearlake.llm.quality import rate_quality
from nearlake.llm.token_files import read_token_files, write_token_files
from nearlake.llm.toxicity import score_documents
from nearlake.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, code_digests


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "size", "source_size", "target", "taken", "position")
    return mix(table(spark, sf_dir, "documents")).select(*columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_pii": op8_pii,
    "op9_license_scans": op9_license_scans,
    "op10_media_clips": op10_media_clips,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Lines with their keys; the first document of each key that is long enough and in several; what stays.
LINE_DEDUP_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (SELECT row, doc_id, string_split(text, chr(10)) AS lines FROM texts),
    lines AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
    keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    shared AS (SELECT key, min(doc_id) AS first FROM keys WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
    judged AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id > s.first AS gone FROM keys k LEFT JOIN shared s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row"""


def _vector_codes_sql() -> str:
    """The rounds written out: entries of one round from the assignments to those of the round before."""
    d = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "rows AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::double * %d)::bigint) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)" % SCALE,
        f"pieces AS (SELECT row, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM rows, range(0, {PARTS}) t(part))",
        f"b0 AS (SELECT part, row - 1 AS entry, x FROM pieces WHERE row <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        near = f"SELECT p.row, p.part, b.entry, {d} AS d FROM pieces p JOIN b{i} b ON b.part = p.part"
        steps.append(f"a{i} AS (SELECT row, part, arg_min(entry, struct_pack(d := d, entry := entry)) AS entry, min(d) AS d FROM ({near}) GROUP BY row, part)")
        if i < ROUNDS:
            each = f"SELECT a.part, a.entry, unnest(p.x) AS y, generate_subscripts(p.x, 1) AS i FROM a{i} a JOIN pieces p ON p.row = a.row AND p.part = a.part"
            means = f"SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM ({each}) GROUP BY part, entry, i) GROUP BY part, entry"
            steps.append(f"b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.x::bigint[], b.x) AS x FROM b{i} b LEFT JOIN ({means}) m ON m.part = b.part AND m.entry = b.entry)")
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(steps)},
    coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM {last} GROUP BY row),
    books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM coded JOIN rows USING (row), books"""


LLM_ORACLES: dict[str, str] = {"op11_line_dedup": LINE_DEDUP_SQL, "op12_vector_codes": _vector_codes_sql()}
