"""From raw documents to packed training sequences, as stages that each work on all that the stage before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read back as the next stage's ``docs``. All
but the last return the columns of ``docs``. Null texts and ids, repeated rows, empty tables and further columns of any name are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftloom.llm import curriculum, cutting_stock, langid_bloom, pii_crf, setsketch_dedup
from liftloom.llm.words import small_batches
from liftloom.session import tune, written

#: share of a text's n-grams that its language must explain
LEAST_SHARE = 0.1


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, ``__row``: that of their file, then their place in it.

    Rows that come from no file are written first. The table of files is small, and Spark broadcasts it if it really is.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = written(docs, "rows")
    files = docs.select(F.col("_metadata.file_path").alias("__file")).distinct()
    files = written(files.coalesce(1).withColumn("__number", F.monotonically_increasing_id()), "files")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place"))
    return placed.join(files, F.col("__path") == F.col("__file")).select(*docs.columns, F.expr("shiftleft(__number, 36) + __place as __row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those that no known language explains; fill in the language where it is missing."""
    small_batches(spark)
    model = langid_bloom.train(docs.where(langid_bloom.fold(4) != 2))
    if not model.languages:
        return docs
    judged = langid_bloom.predict(docs, model, added=("__language", "__share"))
    known = judged.where((F.col("__language") != langid_bloom.UNKNOWN) & (F.col("__share") >= LEAST_SHARE))
    return known.withColumn("lang", F.coalesce("lang", "__language")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: one with the smallest id; without any id, any one. Rows without shingles all stay."""
    small_batches(spark)
    # rows are told apart by a number of their own, as ids may be null or repeated
    numbered = _numbered(docs)
    groups = setsketch_dedup.near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    ids = groups.join(numbered.select("__row", "doc_id"), "__row")
    least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("least"))
    kept = written(least.select("least.__row"), "kept")
    return numbered.join(kept, "__row", "left_semi").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    small_batches(spark)
    clean = pii_crf.redact(docs, pii_crf.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take what the mix takes: documents twice, once, or not at all; the last one of a source may be cut after a word.

    Rows are range-sorted by their positions in training. Rows with one id, or none, each take their own amount.
    """
    small_batches(spark)
    numbered = _numbered(docs)
    taken = curriculum.mix(numbered, also=("__row",)).where("taken > 0")
    taken = written(taken.selectExpr("__row", "size as __size", "taken as __taken", "position as __position", "again as __again"), "taken")
    copies = numbered.join(taken, "__row").withColumn(
        "__copy",
        F.explode(
            F.expr(
                "if(__taken > __size, array(struct(__size as part, __position as at), struct(__taken - __size as part, __again as at)),"
                " array(struct(__taken as part, __position as at)))"
            )
        ),
    )
    copies = copies.withColumn("__part", F.col("__copy.part"))
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    cut = copies.withColumn("text", F.expr(f"if(__part = __size, text, array_join(slice({words}, 1, cast(__part as int)), ' '))"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__part") == F.col("__size"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.orderBy("__copy.at", "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    small_batches(spark)
    return cutting_stock.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("pack", pack)]

# language filters, a tagger and a linear program have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
