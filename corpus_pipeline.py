"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Documents may have any columns: a stage never takes one of them for its own, and all but the last return just them.
Rows with null or empty texts, repeated rows and empty tables follow the definitions of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bagminhash, decontam, language, sentencepiece_codec, toxicity
from lodestone.llm.common import fresh, table
from lodestone.scratch import at_exit, delete, made, release


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator gives a column, and which name stands for which."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model calls toxic go; the model learns from the labels of documents that are here."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, name = _apart(docs)
    return toxicity.score(rows, model, text=name["text"]).where("not toxic").select(*name.values()).toDF(*name)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the evidence supports go."""
    rows, name = _apart(docs)
    found = language.identify(rows, language.fit(docs), F.col(name["text"]), host=F.col(name["source"]))
    return found.where("not rejected").select(*name.values()).toDF(*name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return bagminhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers and names, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, then their piece ids; a result whose name a column has gets a longer one."""
    rows, name = _apart(docs)
    found = sentencepiece_codec.encode(rows, text=name["text"])
    taken, new = {c.lower() for c in name}, []
    for c in found.columns[len(name) :]:
        while c.lower() in taken:
            c += "_"
        new.append(c)
        taken.add(c.lower())
    return found.toDF(*name, *new)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

#: Fitted models and near-duplicate classes cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from a table that stays while the driver runs; what stages wrote before is deleted on the way."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark, at = made(), fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        at_exit(spark, at)
        release(spark, mark)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
