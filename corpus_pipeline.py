"""A training corpus from documents: five stages, each by one operator of vertexflow.llm.

A stage takes (spark, docs, sf_dir) and returns the rows that stay, with the columns
of documents; the last one returns the tokens. Ids may be null or repeat, extra columns may have any
name, texts any length, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vertexflow.llm import bpe, decontam, repeats, simhash, toxicity
from vertexflow.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, trained on this stage's documents, doesn't call toxic.

    Null and empty texts stay unless most training rows are toxic; repeated rows stay or go together; a score of exactly 0.5 goes.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of linked fingerprints.

    Null, empty and blank texts are one group. Repeated rows are one document, of different rows with
    the least id the one of least text hash stays; rows without an id stay only where no row of their group has one.
    """
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that start more than once.

    Null texts stay null, empty ones empty; repeated rows are repeats of each other, so texts of 200 bytes and more lose all.
    """
    return repeats.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; those without words stay, repeated rows stay or go together."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the decoded bytes, and ids, a row for each row; null and empty texts have none."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("decontamination", drop_contaminated),
    ("tokens", tokenise),
]

#: The stages train a model, follow links and merge suffixes, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
