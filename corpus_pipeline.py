"""The corpus pipeline: raw documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame; every
result is written as Parquet and read back as the next one's input, which cuts the
lineage. All but the last return the columns of ``documents``; ``n_chars`` follows
an edited text. Repeated passages go in the stage ``near_duplicates``. Defined results: rows with null or empty texts are rejected by the quality rules; an
empty table runs through to an empty one; extra columns stay until packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import jaccard_join, line_dedup, packing, passages, quality_rules, surrogates
from sensorloom.llm.common import free_name, read_table
from sensorloom.sources.scratch import materialize

KEY_SETTING = "spark.sensorloom.surrogateKey"
NO_BLANK = r"[^\x20\x09-\x0D]"


def _same_columns(edited: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """The columns of ``docs``; ``n_chars`` counted anew where the text changed."""
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
    return edited.select(
        *[
            n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars")
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality_rules.kept_documents(docs, quality_rules.DEFAULT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks go, and documents of which nothing but blanks is left."""
    cleaned = line_dedup.remove_repeated_chunks(docs)
    touched = F.col(f"`{free_name(docs, 'chunks_removed')}`") > 0
    left = cleaned.where(~touched | F.col("text").rlike(NO_BLANK))
    return _same_columns(left, docs, touched)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; then repeated passages go,
    which line dedup leaves where they are no whole chunks.

    A near copy goes as a whole as far as line dedup, which runs before, has left its words; what
    that stage has cut down may be too little to be like its original.
    """
    once = materialize(_one_of_each_group(docs), "one_of_each_group")
    cleaned = passages.remove_repeated_passages(once)
    touched = F.col(f"`{free_name(once, 'passages_removed')}`") > 0
    left = cleaned.where(~touched | F.col("text").rlike(NO_BLANK))
    return _same_columns(left, docs, touched)


def _one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id.

    Rows without an id or without a word belong to no group and stay; rows that agree in id
    and text are one document.
    """
    groups = jaccard_join.jaccard_components(docs)
    gone = materialize(
        groups.where(F.col("doc_id") != F.col("component_id")).select(
            F.col("doc_id").alias("__gone")
        ).distinct(),
        "near_duplicates",
    )
    left = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == gone["__gone"], "left_anti")
    # What comes twice as it is stays once; ids that come twice are looked up first.
    counts = left.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    repeated = materialize(counts.select(F.col("doc_id").alias("__repeated")), "repeated_ids")
    if repeated.isEmpty():
        return left
    marked = left.join(
        repeated.hint("shuffle_hash"), left["doc_id"] == repeated["__repeated"], "left"
    )
    once = marked.where("__repeated is not null").dropDuplicates(["doc_id", "text"])
    return marked.where("__repeated is null").unionByName(once).drop("__repeated")


def surrogate_key(spark: SparkSession) -> str:
    """The key of the surrogates: a setting of the session. Without one the name of the setting
    serves, which keeps trial runs repeatable and nothing secret."""
    return spark.conf.get(KEY_SETTING, KEY_SETTING)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    replaced = surrogates.replace_entities(docs, surrogate_key(spark))
    return _same_columns(replaced, docs, F.size(f"`{free_name(docs, 'entities')}`") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in the training sequences."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("packing", pack),
]

# Keyed surrogates and token ids have no SQL form; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
