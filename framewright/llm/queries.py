"""The queries of the training-data operators, each over its whole table.

Each query calls its operator with production parameters and derives the columns that are
returned; the operators keep their own interfaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op2_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    found = langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")).drop("ids")


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.sentence_spans import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.simple8b import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.secrets import findings

    return findings(table(spark, sf_dir, "documents"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_template_removal": op2_template_removal,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_cost_packing": op5_cost_packing,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_circulant_minhash": op7_circulant_minhash,
    "op9_secret_forest": op9_secret_forest,
    "op8_simple8b": op8_simple8b,
    "op10_spaced_seeds": op10_spaced_seeds,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
    """,
}
