"""Ranking, paging, result building and display."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import Index, top_docs_per_word

CANDIDATES = 30
PAGE_SIZE = 6
STOP_WORDS = ("of", "the")
FAR = 2147483647


def candidates(index: Index, words: list[str], k: int = CANDIDATES) -> DataFrame:
    """(doc_id): documents among the k most frequent of any query word."""
    hit = index.postings.where(F.col("word").isin(*words) & (F.length("word") < tx.LONG_WORD)) if words else index.postings.where(F.lit(False))
    return top_docs_per_word(hit.select("doc_id", "word", "count"), k).select("doc_id").distinct()


def idf(index: Index) -> DataFrame:
    """(word, idf): log10 of documents by document frequency."""
    n = index.norms.select(F.count(F.lit(1)).cast("double")).scalar()
    return index.freq.select("word", F.log10(n / F.col("n_doc")).alias("idf"))


def query_weights(index: Index, words: list[str], stop_words=STOP_WORDS) -> DataFrame:
    weights = idf(index).where(F.col("word").isin(*words)) if words else idf(index).where(F.lit(False))
    return weights.select("word", F.when(F.col("word").isin(*stop_words), 0.0).otherwise(F.col("idf")).alias("idf"))


def tf_weights(index: Index) -> DataFrame:
    return index.postings.join(index.norms, "doc_id").select("doc_id", "word", (F.col("count") / F.sqrt("square_norm")).alias("tf"))


def distance(a: Column, b: Column) -> Column:
    """Mean over a's positions of the distance to b's nearest; far if either has none."""
    near = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: F.abs(q - p))))
    mean = F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when((F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0), mean).otherwise(F.lit(float(FAR)))


def scores(index: Index, ranks: DataFrame, words: list[str], stop_words=STOP_WORDS, k: int = CANDIDATES) -> DataFrame:
    """(doc_id, cosine, phrase, score): pagerank * (cosine + bonus of adjacent query words).

    Repeated query words count each; a pair of equal words has no distance and is skipped.
    Documents without a rank score 0.
    """
    found = F.broadcast(candidates(index, words, k))  # k documents a query word at most
    weights = F.broadcast(query_weights(index, words, stop_words))
    hit = index.postings.where(F.col("word").isin(*words)) if words else index.postings.where(F.lit(False))
    rows = hit.join(found, "doc_id").join(weights, "word", "left")
    by_word = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("count", "hits", F.coalesce("idf", F.lit(0.0)).alias("idf"))))).alias("m"))
    scored = by_word.join(index.norms, "doc_id")
    get = lambda w: F.try_element_at("m", F.lit(w))
    cosine: Column = F.lit(0.0)
    for w in words:
        cosine = cosine + F.coalesce(get(w)["count"] / F.sqrt("square_norm") * get(w)["idf"], F.lit(0.0))
    phrase: Column = F.lit(0.0)
    for a, b in zip(words, words[1:]):
        if a != b:
            phrase = phrase + 5.0 / distance(get(a)["hits"], get(b)["hits"])
    scored = scored.select("doc_id", cosine.alias("cosine"), phrase.alias("phrase"))
    ranked = scored.join(ranks, "doc_id", "left")
    return ranked.select("doc_id", "cosine", "phrase", (F.coalesce("pagerank", F.lit(0.0)) * (F.col("cosine") + F.col("phrase"))).alias("score"))


def order() -> list[Column]:
    return [F.desc("score"), F.col("doc_id").asc()]


def page(scored: DataFrame, number: int, size: int = PAGE_SIZE, strict: bool = False) -> DataFrame:
    """Rows of one page. `strict` loses the last document of the last page."""
    if number < 1:
        raise ValueError("pages count from 1")
    low = (number - 1) * size
    if strict:
        total = scored.select(F.count(F.lit(1))).scalar()
        first = scored.orderBy(*order()).limit(low + size)
        # Rank inside the page's prefix, which holds a bounded number of rows.
        numbered = first.withColumn("rank", F.row_number().over(Window.orderBy(*order())).cast("bigint"))
        return numbered.where((F.col("rank") > low) & (F.col("rank") <= F.when(F.lit(low + size) >= total, total - 1).otherwise(F.lit(low + size)))).drop("rank")
    return scored.orderBy(*order()).offset(low).limit(size)


def total(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total"))


def snippet_words(query: str) -> list[str]:
    return [w.lower() for w in re.sub(r"[!-/:-@\[-`{-~]", " ", query).split(" ") if w]


def snippet(html: Column, query: str) -> Column:
    """The paragraph that most query words find first, else the description, else the first paragraph with text."""
    paragraphs = tx.html_paragraphs(html)
    own = F.transform(paragraphs, lambda p: F.lower(tx.own_text(p)))
    texts = F.transform(paragraphs, tx.markup_text)
    first = lambda w: F.array_position(F.transform(own, lambda p: F.contains(p, F.lit(w))), F.lit(True))
    hits = F.filter(F.array(*[first(w) for w in snippet_words(query)]).cast("array<bigint>"), lambda i: i > 0)
    best = F.array_max(F.transform(hits, lambda i: F.struct(F.size(F.filter(hits, lambda j: j == i)).alias("n"), (-i).alias("at"))))
    told = F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))
    return F.coalesce(F.try_element_at(texts, (-best["at"]).cast("int")), F.nullif(tx.html_description(html), F.lit("")), told, F.lit(""))


def results(hits: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """(doc_id, score, title, url, description) of a page's hits; hits whose page is missing drop out."""
    # The page is at most a screenful, so the pages table is only probed for its rows.
    joined = pages.join(F.broadcast(hits), pages["page_id"] == hits["doc_id"])
    return joined.select("doc_id", "score", tx.html_title(F.col("html")).alias("title"), "url", snippet(F.col("html"), query).alias("description"))


def display(rows: DataFrame, query: str) -> DataFrame:
    """Results as shown: cut to 60, 60 and 256 characters, query words highlighted."""
    words = snippet_words(query)
    return rows.select("doc_id", tx.truncate(F.col("url"), 60).alias("url"), tx.highlight(tx.truncate(F.col("title"), 60), words).alias("title"), tx.highlight(tx.truncate(F.col("description"), 256), words).alias("description"))


def to_json(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: {"data": [{title, url, description}], "total": n}."""
    item = F.struct((-F.col("score")).alias("o"), "doc_id", F.struct("title", "url", "description").alias("r"))
    data = rows.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["r"]).alias("data"))
    n = scored.select(F.count(F.lit(1))).scalar()
    return data.select(F.to_json(F.struct("data", n.alias("total"))).alias("json"))
