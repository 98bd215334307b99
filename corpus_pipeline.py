"""The training-data pipeline: documents in, encoded mixture out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
result as Parquet in the shared folder and rereads it as the next one's docs.  All stages but
the last return the columns of ``documents``.

1. language_id: documents without a letter, or with hardly any n-gram of a learned language, go;
   a missing language is filled in.  Where no language could be learned (no training row has one,
   or none with n-grams), every document with a letter passes as it is.
2. near_dedup: of every group of near-duplicate rows the one with the smallest id (null last) stays;
   rows under one id or under null ids are linked by their texts only, so different texts stay.
3. repeated_phrases: words of passages that start in an earlier document go.
4. mixing: documents are repeated, kept or left out so that sources reach their target weights; a
   row a repeat, the last document of a source may be cut.
5. bpe: every row's token ids, and whether decoding them gives back its text.

Rows with null texts or ids pass as the stages' operators define; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, language_id, mixing, near_dedup, repeated_phrases
from codeloom.llm.common import WORD, pick, staged, table
from codeloom.session import ship_package

# A text this far from every learned language is rejected; clean text scores above 0.5.
MIN_LANGUAGE_SCORE = 0.2
DOCUMENT = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.select(*DOCUMENT, F.length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = language_id.learn(docs)
    if not model.slots.any():
        return _as_documents(pick(docs, **DOCUMENT).where(F.col("text").rlike(r"\p{L}")))
    judged = language_id.language_id(docs, carry=("text", "lang", "source"), model=model)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _as_documents(judged.where(sure).withColumn("lang", F.coalesce("lang", "lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    d, row = near_dedup.addressed(pick(docs, **DOCUMENT)), near_dedup.ROW
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = d.where(~wordless).join(near_dedup.kept_rows(docs), row, "left_semi")
    # Rows equal in id and text are one; rows without words are near duplicates of nothing else.
    alike = kept.unionByName(d.where(wordless & F.col("doc_id").isNotNull())).groupBy(*row).agg(
        F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min(F.struct("source", "lang")).alias("s"))
    named = alike.select("doc_id", "text", "s.source", "s.lang")
    return _as_documents(named.unionByName(d.where(wordless & F.col("doc_id").isNull()).select(*named.columns)))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return _as_documents(repeated_phrases.remove_repeated(docs, full=True, carry=("lang", "source")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return _as_documents(mixing.mixed_documents(docs, carry=("lang",)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit), round_trip."""
    ship_package(spark)
    import public_tokenizers
    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=("source",))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("repeated_phrases", remove_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

# The stages' models have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
