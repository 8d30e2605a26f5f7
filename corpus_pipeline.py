"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
between two stages the rows are written as Parquet to the cluster's shared folder and read
again. All stages but the last return the columns of ``documents``.

1. language: documents without a letter, or without a text, have no language and go, and so
   do those whose n-grams name no learned language more often than the filter's
   false-positive rate predicts. If nothing could be learned, as no row has a label, all
   documents with a letter stay.
2. exact: of texts that are equal without white space, one row stays.
3. near: of each component of documents that share 80 % of their five-word shingles, the
   document with the smallest id stays.
4. leaks: documents that overlap with an item of the benchmark go.
5. packing: what is left is tokenised and packed into sequences of at most 1024 tokens.

Defined results: a null or empty text has no language and goes in the first stage; a null id
is an id like any other for the exact stage, links with nothing in the near stage, and is
judged by its own text in the leaks stage; of rows that repeat id and text one stays, from
the exact stage on; ties go to the smallest id; very long texts are worked on as a whole; an
empty table passes through all stages as an empty table; columns that ``documents`` doesn't
have are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontam, exact_dedup, langid, minhash, packing
from framewright.llm.queries import table, tokenizer
from framewright.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    found = langid.predict(docs.select(*COLUMNS), model)
    named = F.col("score") > 0 if model.slots.any() else F.col("text").rlike(r"\p{L}")
    return found.filter(named).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a smaller table of pieces, as the workers hold what other stages left them
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), pieces=250_000).drop("ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("leaks", leaks), ("packing", sequences)]

#: SQL has no tokenizer, classifier or component search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
