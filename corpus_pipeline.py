"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Every stage works on whole texts and all rows, and returns the columns of documents (those that it is given, further
ones included); the last adds the mixing rate. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm import decontaminate, langid, mixing, near, pii
from quietfield.llm.common import Scratch, fold, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest of the row as one column, so that no name of an operator's clashes with those of documents."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def unpacked(found: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The rows again, with some columns changed."""
    kept = {"text": F.col("text")} | changed
    return found.select(*[kept.get(c, F.col("row").getField(c)).alias(c) for c in names])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, or no letter); lang becomes the language found."""
    model = langid.fit(docs.where(fold(docs.doc_id, langid.FOLDS) != langid.HELD_OUT).select("doc_id", "text", "lang"))
    found = langid.identify(packed(docs), model).where(f"lang_pred != '{langid.UND}'")
    return unpacked(found, docs.columns, lang=found.lang_pred)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates one document, that of least doc_id (null last; of several rows of that id one).
    Different rows of one id are documents of their own, rows that are the same in all columns are one."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        classes = near.near_duplicates(docs.select("doc_id", "text"))
        kept = classes.where("doc_id = class_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    mine = packed(docs.dropDuplicates()).withColumn("key", row_key())
    mine = Scratch(spark, "keyed").write(mine, "keyed")
    classes = near.near_duplicates(mine.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "class_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = mine.select("doc_id", "key").join(classes, "key").groupBy("class_id").agg(first.alias("first")).select(F.col("first.key").alias("key"))
    return unpacked(mine.join(kept, "key", "left_semi"), docs.columns)


def row_key() -> Column:
    """A key of packed rows, for tables where ids repeat or are missing: rows of one key are the same row."""
    return F.xxhash64("row", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark: rows, whatever their ids."""
    mine = packed(docs).withColumn("key", row_key())
    held = decontaminate.contaminated(mine.select(F.col("key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    held = Scratch(spark, "contaminated").write(held.select(F.col("doc_id").alias("key")).distinct(), "held")
    return unpacked(mine.join(held, "key", "left_anti"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows. Keeps every document."""
    found = pii.redact(pii.find(packed(docs), pii.learn_contexts(docs.select("doc_id", "text"))))
    return unpacked(found, docs.columns, text=found.text, n_chars=F.length("text").cast("long"))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its likeliest domain and the rate at which the mixture takes it."""
    found = mixing.mix_to_targets(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    rates = found.select(F.col("doc_id").alias("rated"), F.col("version").alias("rated_version"), "tokens", "domain", "rate").distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "n_chars", mixing.version().alias("version"))
    met = own.join(rates, own.doc_id.eqNullSafe(rates.rated) & (own.version == rates.rated_version), "left")
    return met.select("doc_id", "lang", "source", "n_chars", "tokens", "domain", "rate")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing_rates", mixing_rates),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch, last = Scratch(spark, "pipeline"), len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < last:
            docs = scratch.write(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
