"""A corpus pipeline in four stages; each is written as Parquet and read again by the next.

1. ``language``: documents whose language can't be told (null text, no letter, or bytes that
   no learned language predicts better than chance) go.
2. ``near_duplicates``: of each class of exact and near copies, the least doc_id stays.
3. ``repeats``: passages of 100 bytes and more that occurred before are cut out of the texts.
4. ``packing``: what is left is packed into windows of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm.common import col, fresh, new_folder, table
from modeloom.llm.language import UNKNOWN, predict, train
from modeloom.llm.minhash import near_duplicates
from modeloom.llm.packing import pack
from modeloom.llm.substrings import remove_repeats
from modeloom.llm.tokens import vocabulary

#: What a byte costs that is predicted no better than chance; a text that costs more under its best language is in none that was learned.
CHANCE_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; their columns stay.

    Null texts, texts without a letter and texts that no learned language predicts better than
    chance go; where nothing was learned, all with a letter stay; equal rows are judged one by one.
    """
    model = spark.sparkContext.broadcast(train(docs))
    rows = predict(docs, model)
    if not model.value.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found, _, bits = map(col, rows.columns[-3:])
    return rows.where((found != UNKNOWN) & (bits <= CHANCE_BITS)).select(*map(col, docs.columns))


def near_duplicate_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that of the least doc_id.

    Rows without an id stay; of rows with an equal id, the one whose columns have the least hash stays.
    """
    name = fresh(docs.columns, "gone")
    gone = near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(name))
    left = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not ids.limit(1).count():
        return left
    columns = [col(c) for c in docs.columns]
    one = left.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(F.struct(*columns).cast("string"))).alias(name))
    return left.where("doc_id is null").unionByName(one.select(*[col(name).getField(c).alias(c) for c in docs.columns]))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; every document stays."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicate_classes), ("repeats", repeats), ("packing", packing)]

#: SQL can express none of the stages but by the models and algorithms themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
