"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
`documents`, and other columns that docs has, whatever their names. An empty table gives
an empty one; rows are never dropped but by a stage's own decision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import broadcast_if_small, cut, fresh, remove, shared_folder
from sparkseek.llm.jaccard import near_duplicates
from sparkseek.llm.lines import dedup_lines
from sparkseek.llm.mixing import mixed
from sparkseek.llm.packing import file_order, pack_documents
from sparkseek.llm.quality import score, train
from sparkseek.session import ship, spread, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (score under 0.5).

    Null and empty texts are scored as texts without words, whole texts whatever their
    length; rows of one text score alike, whatever their ids; without labels all stay.
    """
    ship(spark)
    docs = spread(docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    held = dict(zip(("score", "predicted"), fresh([*docs.columns, "score", "predicted"], "score", "predicted")))
    renamed = docs.withColumnsRenamed({k: v for k, v in held.items() if k in docs.columns})
    scored = score(renamed, train(docs, labels), keep=tuple(c for c in renamed.columns if c != "doc_id"))
    kept = scored.where("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines; a document that loses all of its text goes, the rest keep their columns.

    Of equal lines the first by id (null first) and place stays. Null texts stay null and
    empty ones empty; rows that share an id count as one document; `n_chars` is counted
    anew where there is such a column.
    """
    ship(spark)
    docs = spread(docs)
    counts = ["n_lines", "n_copies", "n_near"]
    held = dict(zip(counts, fresh([*docs.columns, *counts], *counts)))
    renamed = docs.withColumnsRenamed({k: v for k, v in held.items() if k in docs.columns})
    out = dedup_lines(renamed, counts=True)
    emptied = (F.col("n_copies") + F.col("n_near") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False))).drop(*counts).withColumnsRenamed({v: k for k, v in held.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates; rows of one id with one text stay once.

    The first by id stays. Null and empty texts are no duplicates, rows with a null id stay
    as they are, and unlike texts under one id are documents of their own.
    """
    ship(spark)
    docs = spread(docs)
    said = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("-"))
    unlike = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg((F.min("h") != F.max("h")).alias("unlike")).where("unlike")
    if unlike.isEmpty():
        return _first_of_each(docs, near_duplicates(docs), "doc_id")
    # Ids that collide: id and text name a row, in the order of the ids.
    (row,) = fresh(docs.columns, "row_name")
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    name = F.expr("lpad(cast(cast(doc_id AS decimal(20, 0)) + 9223372036854775808 AS string), 20, '0')") if whole else F.col("doc_id").cast("string")
    named = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.concat(name, F.lit(":"), said)))
    return _first_of_each(named, near_duplicates(named, id_col=row), row).drop(row)


def _first_of_each(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows that `found` keeps, one for each key."""
    (other,) = fresh([*docs.columns, "class_id", "n_links", "kept", "count"], "other")
    gone = cut(found.where("NOT kept").select(F.col(key).alias(other)).distinct())
    kept = docs.join(broadcast_if_small(gone), docs[key] == F.col(other), "left_anti")
    twice = cut(found.where(F.col("kept") & F.col(key).isNotNull()).groupBy(F.col(key).alias(other)).count().where("count > 1").select(other))
    if twice.isEmpty():
        return kept
    here = docs[key] == F.col(other)
    once = kept.join(broadcast_if_small(twice), here, "left_semi").dropDuplicates([key])
    return kept.join(broadcast_if_small(twice), here, "left_anti").unionByName(once)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order that interleaves their sources by target weight.

    The target weights are the square roots of the sources' counts. The order is that of the
    rows written (by file name, then row), and packing keeps it. A null source is a source
    of its own; null ids and repeated rows are placed each; texts aren't read.
    """
    ship(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document's pieces in sequences of at most 2048 tokens.

    Documents are packed in windows of the order in which the mixture wrote them, and
    sequence ids grow with the windows: read by id, the sequences hold the sources in the
    mixture's shares. Null texts count as empty; every row is placed.
    """
    ship(spark)
    (place,) = fresh(docs.columns, "place")
    return pack_documents(spread(file_order(docs, place)), order_col=place)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("source mixing", mixture),
    ("best-fit packing", packing),
]

#: The classifier, edit join and packing are beyond SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again.

    The folder goes when its last stage has been packed: the pieces are stored by then.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return out
