"""The corpus pipeline over ``documents``; each stage works on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Stages decide row by row: null and repeated doc_ids are documents of their own, null texts are read as empty and stay
null, texts are read whole, and columns beside doc_id, text, source and n_chars pass through under any name. Repeated rows are copies
of each other like other equal texts. An empty table gives an empty result. ``run`` writes what a stage keeps to
a scratch table before the next one reads it, so no stage is run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm import decontaminate, mixing, ngram_join, quality, suffix_dedup
from pagegraph.llm.common import cut, table

MIXED = ("size", "source_size", "target", "taken")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one: their names can't clash with what a stage adds."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns if c not in ("doc_id", "text"))).alias("rest"))


def _unpacked(columns: list[str]) -> list:
    return [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`c_{c}`").alias(c) for c in columns]


def _numbered(docs: DataFrame) -> DataFrame:
    """Packed rows with ``row``, a number of their own that is written down: a lost task can't number them anew."""
    return cut(_packed(docs).withColumn("row", F.monotonically_increasing_id()))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability for the second grade or more reaches quality.TAIL stay; without labels of two grades all do."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.grade(_packed(docs), model).where(F.col("p_above") >= quality.TAIL).select(_unpacked(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar documents stays: that with the least doc_id (null last; any one of several).

    Documents without words are like no other and stay.
    """
    rows = _numbered(docs)
    groups = ngram_join.jaccard_components(rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("doc_id"), "text"))
    kept = groups.where("doc_id.row = component_id.row").select("doc_id.row")
    return rows.join(kept, "row", "left_semi").select(_unpacked(docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings leave the texts; n_chars follows. Documents of which nothing is left stay, empty."""
    out = suffix_dedup.remove_repeats(_packed(docs))
    change = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(change, F.col("kept_text")).otherwise(F.col("text")))
    columns = _unpacked(docs.columns)
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.when(change, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.c_n_chars")).alias("n_chars")
    return out.select(columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; without a benchmark all stay."""
    return decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark")).where("not contaminated").select(_unpacked(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with size, source_size, target and taken (words, repeats counted).

    Columns of these names are replaced. Rows that share a doc_id have their own sizes and words taken.
    """
    rows = _numbered(docs)
    sized = rows.select("doc_id", F.col("rest.c_source").alias("source"), mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("print"), "row")
    taken = mixing.mix(sized, by=("doc_id", "print"), carry=("row",)).where("taken > 0").select("row", *MIXED)
    return rows.join(taken, "row").select(*_unpacked([c for c in docs.columns if c.lower() not in MIXED]), *MIXED)


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("leaks", leaks), ("mix", mix)]

#: The first stage is a trained model, which SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
