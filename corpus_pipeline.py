"""From raw documents to packed training windows, a stage at a time.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
works on all rows that its predecessor kept. All but the last return the
columns of documents; the last returns pieces of windows. Rows with nulls in
any column, empty texts, repeated rows and further columns pass every stage
by the rules of its operator; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearsieve.llm import decontaminate, nearcopies, packing, pii, toxicity
from nearsieve.llm.env import cut, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network of op10 scores below its threshold; fitted on these documents' labels."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of fingerprints within 3 bits or five-word Jaccard similarity of 0.8."""
    return nearcopies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens of all documents."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]

#: Toxicity and fuzzy copies can't be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
