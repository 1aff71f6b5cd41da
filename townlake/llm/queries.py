"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from townlake.llm.alignment import alignment_digests
from townlake.llm.exact_dedup import exact_duplicates
from townlake.llm.fill_middle import fill_in_middle_digests
from townlake.llm.fingerprints import edited_fingerprints
from townlake.llm.language import identify_language
from townlake.llm.lm_scoring import score_documents
from townlake.llm.mixing import mix_sources
from townlake.llm.packing import pack_documents
from townlake.llm.quality import score_quality
from townlake.llm.repeats import remove_repeats
from townlake.llm.sharding import shard_documents
from townlake.llm.simhash import near_duplicates
from townlake.llm.toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).drop("source")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_documents(spark, sf_dir))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(_documents(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(_documents(spark, sf_dir))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm_score": op2_lm_score,
    "op3_mix_sources": op3_mix_sources,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality": op5_quality,
    "op6_repeats": op6_repeats,
    "op7_pack": op7_pack,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_shard": op9_shard,
    "op10_toxicity": op10_toxicity,
    "op11_language": op11_language,
    "op12_align": op12_align,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES = {
    "op3_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size,
         CAST([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, CAST(source_size AS DOUBLE) * 3 AS cap,
         (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(CAST(source_size AS DOUBLE) * 3) OVER w, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) * 3 / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT level FROM levels WHERE cap / weight > level ORDER BY cap / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap / weight <= coalesce((SELECT level FROM final), cap / weight) THEN cap
              ELSE (SELECT level FROM final) * weight END AS target
  FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
            + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before))
            AS BIGINT) AS taken
FROM placed
""",
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place FROM d
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, place = 1 AS kept, text_sha256
FROM k
""",
    "op13_fill_middle": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS two,
         n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 AS plain,
         CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 AS suffix_first
  FROM t
), cut AS (SELECT *, least(one, two) AS a, greatest(one, two) AS b FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN plain THEN NULL ELSE CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN plain THEN NULL ELSE CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN text
                   WHEN suffix_first THEN '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a)
                   ELSE '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
""",
}
