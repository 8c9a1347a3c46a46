"""Positional forward and inverted indexes.

Postings are one flat table (doc_id, word, count, hits); the nested per-document and
per-word forms are views of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import remove, size_in_bytes

MAX_HITS = 5
#: Bytes of a table's files whose postings are one partition of its saved index.
PARTITION_BYTES = 8 << 20


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lemmatizer: str = "identity") -> DataFrame:
    """(doc_id, pos, word) of the tokens that are words; the others still count in positions."""
    flat = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.tokens(tx.strip_punctuation(F.col(text_col)))).alias("pos", "token"))
    return flat.where(tx.is_word(F.col("token"))).select("doc_id", "pos", tx.lemma(F.col("token"), lemmatizer).alias("word"))


def word_positions(tokens: DataFrame) -> DataFrame:
    """(doc_id, word, positions): sorted positions of each word of a document."""
    return tokens.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _words_of(text: Column, lemmatizer: str) -> Column:
    """array<struct<word, positions>> of one text, by word: its words are sorted with their positions and cut into runs."""
    marked = F.transform(tx.tokens(tx.strip_punctuation(text)), lambda t, i: F.when(tx.is_word(t), F.struct(tx.lemma(t, lemmatizer).alias("word"), i.alias("pos"))))
    # An array of one element names what is used more than once.
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    at = lambda s, i: F.get(s, i)

    def runs(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when(~x["word"].eqNullSafe(at(s, i - 1)["word"]), i)))
        end = lambda b, k: F.coalesce(at(b, k + 1), F.size(s)) - 1
        run = lambda b: F.transform(b, lambda i, k: F.struct(at(s, i)["word"].alias("word"), F.transform(F.sequence(i, end(b, k)), lambda j: at(s, j)["pos"]).alias("positions")))
        return let(starts, run)

    return let(F.sort_array(F.array_compact(marked)), runs)


def _by_repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of the documents whose id is theirs alone, and of the others if there are any; only ids are read to tell."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    repeated = docs.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return docs, None
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def document_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lemmatizer: str = "identity") -> DataFrame:
    """The rows of `word_positions(tokenised(docs))`, made inside each document's row: no token is shuffled or sorted elsewhere.

    Only the rows of documents that share an id are brought together.
    """
    rows = lambda part: part.select("doc_id", F.inline(_words_of(F.col("text"), lemmatizer)))
    single, again = _by_repeats(docs, id_col, text_col)
    if again is None:
        return rows(single)
    merged = rows(again).groupBy("doc_id", "word").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return rows(single).unionByName(merged)


def postings(positions: DataFrame, max_hits: int = MAX_HITS) -> DataFrame:
    """(doc_id, word, count, hits): frequency and the earliest positions."""
    return positions.select("doc_id", "word", F.size("positions").cast("bigint").alias("count"), F.slice("positions", 1, max_hits).alias("hits"))


def doc_norms(posts: DataFrame) -> DataFrame:
    return posts.groupBy("doc_id").agg(F.sum(F.col("count") * F.col("count")).alias("square_norm"))


def indexed(posts: DataFrame, longest: int = tx.LONG_WORD) -> DataFrame:
    """The postings that the inverted index holds: long words are left out."""
    return posts.where(F.length("word") < longest)


def doc_freq(posts: DataFrame) -> DataFrame:
    return indexed(posts).groupBy("word").agg(F.count(F.lit(1)).alias("n_doc"))


def forward_view(posts: DataFrame) -> DataFrame:
    """Nested form: (doc_id, forward_index, hit_lists, square_norm)."""
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", c))))
    return posts.groupBy("doc_id").agg(entry(F.col("count").cast("int")).alias("forward_index"), entry(F.col("hits")).alias("hit_lists"), F.sum(F.col("count") * F.col("count")).alias("square_norm"))


def document_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lemmatizer: str = "identity", max_hits: int = MAX_HITS) -> DataFrame:
    """`forward_view` of documents, made inside each document's row."""
    single, again = _by_repeats(docs, id_col, text_col)
    # The array of one keeps the words from being made once for each column.
    words = single.select("doc_id", F.explode(F.array(_words_of(F.col("text"), lemmatizer))).alias("words")).where(F.size("words") > 0)
    entry = lambda f: F.map_from_entries(F.transform("words", lambda x: F.struct(x["word"], f(x["positions"]))))
    norm = F.aggregate("words", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["positions"]).cast("bigint") * F.size(x["positions"]))
    view = words.select("doc_id", entry(F.size).alias("forward_index"), entry(lambda p: F.slice(p, 1, max_hits)).alias("hit_lists"), norm.alias("square_norm"))
    return view if again is None else view.unionByName(forward_view(postings(document_positions(again, lemmatizer=lemmatizer), max_hits)))


def inverted_view(posts: DataFrame, max_postings: int | None = None) -> DataFrame:
    """Nested form: (word, invert_index, n_doc); with `max_postings` only the most frequent documents stay in the map, n_doc isn't reduced."""
    kept = indexed(posts)
    n_doc = kept.groupBy("word").agg(F.count(F.lit(1)).alias("n_doc"))
    if max_postings is not None:
        kept = top_docs_per_word(kept, max_postings)
    lists = kept.groupBy("word").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("count").cast("int"))))).alias("invert_index"))
    return lists.join(n_doc, "word")


def top_docs_per_word(posts: DataFrame, k: int) -> DataFrame:
    """Each word's k most frequent documents, ties by document."""
    w = Window.partitionBy("word").orderBy(F.desc("count"), "doc_id")
    return posts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def pruned(posts: DataFrame, min_count: int) -> DataFrame:
    """Postings of at least `min_count` occurrences."""
    return posts.where(F.col("count") >= min_count)


def pruned_to_size(posts: DataFrame, max_bytes: int) -> DataFrame:
    """Postings of each word's smallest least count whose entries fit into `max_bytes`.

    An entry takes its document's id and its count as text and four bytes. Counts are
    grouped before they are compared, so a word's documents are never in one place.
    """
    sizes = posts.groupBy("word", "count").agg(F.sum(F.octet_length(F.col("doc_id").cast("string")) + F.octet_length(F.col("count").cast("string")) + 4).alias("bytes"))
    from_top = Window.partitionBy("word").orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("held", F.sum("bytes").over(from_top)).where(F.col("held") <= max_bytes)
    least = fits.groupBy("word").agg(F.min("count").alias("least"))
    return posts.join(least, "word").where("count >= least").drop("least")


def shrink_hits(posts: DataFrame, max_hits: int) -> DataFrame:
    return posts.withColumn("hits", F.slice("hits", 1, max_hits))


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of the keys that `new` has are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


@dataclass
class Index:
    """The materialised tables that searches read."""

    postings: DataFrame
    norms: DataFrame
    freq: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, lemmatizer: str = "identity", id_col: str = "doc_id", text_col: str = "text") -> Index:
        """Postings are made where the documents are read."""
        posts = postings(document_positions(docs, id_col, text_col, lemmatizer))
        return cls(posts, doc_norms(posts), doc_freq(posts))

    def save(self, path: str, partitions: int = 64) -> None:
        """Postings sorted by word inside range partitions, so that a word's filter prunes files and row groups; a word of many documents takes several partitions."""
        spark = self.postings.sparkSession
        # Ranges are found by a pass of their own, so postings are stored as they come before.
        self.postings.write.mode("overwrite").parquet(f"{path}/unsorted")
        unsorted = spark.read.parquet(f"{path}/unsorted")
        unsorted.repartitionByRange(partitions, "word", "doc_id").sortWithinPartitions("word", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        remove(spark, f"{path}/unsorted")
        saved = spark.read.parquet(f"{path}/postings")
        doc_norms(saved).write.mode("overwrite").parquet(f"{path}/norms")
        doc_freq(saved).repartitionByRange(partitions, "word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/freq")

    @staticmethod
    def partitions_for(source: DataFrame) -> int:
        """Partitions to save the index of a table in: they grow with its files, so that a task's share doesn't."""
        return max(8, source.sparkSession.sparkContext.defaultParallelism, -(-size_in_bytes(source) // PARTITION_BYTES))

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{k}") for k in ("postings", "norms", "freq")))
