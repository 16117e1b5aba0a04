"""A training corpus from documents, stage by stage; each stage's table is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, langid, mixing, simhash, tokens
from loomgraph.session import fresh_path, read, remove, scratch

#: No SQL has a recurrent network, fingerprints or tokenizers: the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the network knows; the network is trained on what is not held out of docs."""
    return langid.accepted(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, read back from the token table."""
    folder = fresh_path(spark, "tokens")
    tokens.write(docs, folder)
    return tokens.read(spark, folder)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix_sources),
    ("token-ID output", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the stages before, only the newest table is kept: the tables that made it go when it is written."""
    docs, path = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        to = fresh_path(spark, name.replace(" ", "-").lower())
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(to)
        if path is not None:
            remove(spark, path)
        docs, path = spark.read.schema(found.schema).parquet(to), to
    return STAGES[-1][1](spark, docs, sf_dir)
