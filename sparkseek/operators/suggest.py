"""Next-word suggestions from n-gram counts, with back-off to shorter histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
START = ""


def ngram_counts(tokens: DataFrame) -> DataFrame:
    """(history, next, n) for histories of no, one and two words; kept words that follow one another in a document."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.select("doc_id", "word", F.lag("word", 1).over(w).alias("p1"), F.lag("word", 2).over(w).alias("p2"))
    histories = F.array(F.lit(START), F.col("p1"), F.when(F.col("p2").isNotNull(), F.concat_ws(" ", "p2", "p1")))
    flat = rows.select(F.explode(F.array_compact(histories)).alias("history"), F.col("word").alias("next"))
    return flat.groupBy("history", "next").agg(F.count(F.lit(1)).alias("n"))


def top_next(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(history, rank, next, n): each history's k most frequent next words, ties by word."""
    w = Window.partitionBy("history").orderBy(F.desc("n"), "next")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("history", "rank", "next", "n")


def suggest(counts: DataFrame, typed: str, k: int = TOP) -> DataFrame:
    """(rank, suggestion): the input with each of the likeliest next words.

    Only for input that isn't blank and ends with a space. Words of the longest known
    history come first, then those of shorter ones; each word once.
    """
    words = typed.lower().split()
    histories = [" ".join(words[-n:]) for n in (2, 1) if len(words) >= n] + [START]
    if not typed.strip() or not typed.endswith(" "):
        histories = []
    known = counts.where(F.col("history").isin(*histories)) if histories else counts.where(F.lit(False))
    # k more than the words that longer histories can have taken is enough of each.
    short = top_next(known, k * len(histories) if histories else 1)
    level = F.array_position(F.array(*[F.lit(h) for h in histories]) if histories else F.array(F.lit(START)), F.col("history"))
    best = short.withColumn("level", level).groupBy("next").agg(F.min(F.struct("level", (-F.col("n")).alias("m"))).alias("o"))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("o", "next")).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select("rank", F.concat(F.lit(typed), F.col("next")).alias("suggestion"))
