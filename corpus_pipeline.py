"""From raw documents to packed training sequences: five stages, each written as Parquet and reread by the next.

Quality rules drop what the policy rejects, near-duplicates keep one of each group, secrets are redacted, sources are mixed
to their weights, and the mix is packed. SQL can't express the fingerprints' components nor the tokenizer, so ORACLE_SQL is None.

Null ids, null and empty texts, repeated rows, empty tables and columns with other names are defined in each stage's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import mixing, packing, quality_rules, secret_scan, simhash
from loomwork.llm.queries import POLICY, tokenizer_files
from loomwork.session import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose ledger entries have no bit of the policy. Null, empty and wordless texts fail few_words and go."""
    return quality_rules.kept_documents(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the smallest id, null ids last. Rows that share an id are told apart by their content."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secret values replaced in their texts. Null texts stay null."""
    return secret_scan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows the mix trains on, a row for each time that a document is taken, in the order of training. Wordless texts go."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces with their token ids, sequence after sequence: each file holds whole sequences, by sequence_id and offset."""
    return packing.in_sequence_order(packing.pack_documents(docs, *tokenizer_files(), keep_ids=True))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixture), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, reread, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
