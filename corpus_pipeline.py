"""The corpus pipeline: language, near duplicates, personal data, mixture and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.shared import NULL_ID, long_id, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or with no likely language go.

    The declared language is the table's own, and the source stands for the host. Exactly the rejected rows go: rows
    that share an id, or have none, are told apart by what they were judged by.
    """
    from tessera.llm.language_id import fit, identify

    langs, model = fit(docs, "text", "lang", "doc_id")
    if not langs:
        return docs
    parts = [F.coalesce(F.col("text"), F.lit("")), F.col("lang"), F.col("source")]
    keyed = docs.withColumns({"__bad": long_id("doc_id"), "__row": F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)})
    judged = identify(keyed, langs, model, "doc_id", "text", declared_col="lang", host_col="source", carried="__row")
    bad = written(judged.where("rejected").select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("__bad"), "__row").distinct(), "rejected")
    return keyed.join(bad, ["__bad", "__row"], "left_anti").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest id."""
    from tessera.llm.jaccard_join import one_of_each

    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and what discloses it replaced in its text, and n_chars to match."""
    from tessera.llm.pii import sanitised

    return sanitised(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate under the target weights says."""
    from tessera.llm.mixing import mixed

    return mixed(docs, queries.table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    from tessera.llm.packing import pack

    return pack(docs, queries.TOKENIZER)


STAGES = [("language_id", language), ("jaccard_join", one_of_each_group), ("pii", personal_data), ("mixing", mixture), ("packing", packed)]

#: Classifiers, rates and packings are not SQL; tests hold every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
