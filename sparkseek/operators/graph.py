"""Link graph and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..session import cut

DAMPING = 0.7
MAX_URL_BYTES = 2048


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url): absolute links of all anchors, duplicates kept; relative ones start from the page's base element, if it has one."""
    # Both explodes hand on plain columns, so that references are decoded once, whatever uses them.
    decoded = F.struct(tx.decode_entities(tx.html_base(F.col("html"))).alias("base"), F.transform(tx.html_links(F.col("html")), tx.decode_entities).alias("hrefs"))
    rows = pages.select("page_id", "url", F.inline(F.array(decoded)))
    rows = rows.select("page_id", "url", "base", F.posexplode("hrefs").alias("pos", "href"))
    based = F.when(F.col("base") == "", F.col("url")).otherwise(urls.resolve(F.col("url"), F.col("base")))
    rows = rows.select("page_id", "pos", "href", F.explode(F.array(F.coalesce(F.nullif(based, F.lit("")), F.col("url")))).alias("from"))
    return rows.select("page_id", F.col("pos").cast("bigint"), urls.resolve(F.col("from"), F.col("href")).alias("url")).where("url <> ''")


def page_out_links(pages: DataFrame) -> DataFrame:
    """(page_id, url): distinct links of fewer than 2048 UTF-8 bytes."""
    return page_links(pages).where(F.octet_length("url") < MAX_URL_BYTES).select("page_id", "url").distinct()


def link_graph(pages: DataFrame, indexed_docs: DataFrame | None = None) -> DataFrame:
    """(src, dst) between pages of the corpus; a page none of whose links resolve points to itself.

    With `indexed_docs` (page_id) only pages in it are sources.
    """
    sources = pages if indexed_docs is None else pages.join(indexed_docs.select("page_id"), "page_id", "left_semi")
    known = pages.select(F.col("page_id").alias("dst"), "url")
    found = page_out_links(sources).join(known, "url").select(F.col("page_id").alias("src"), "dst").distinct()
    alone = sources.select(F.col("page_id").alias("src")).join(found.select("src").distinct(), "src", "left_anti")
    return found.unionByName(alone.select("src", F.col("src").alias("dst")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, line): neighbours in order, joined by commas."""
    return edges.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("line"))


def pagerank(edges: DataFrame, iterations: int, damping: float = DAMPING, initial: DataFrame | None = None, checkpoint_every: int = 5) -> DataFrame:
    """(doc_id, pagerank) after Jacobi iterations of damping * sum(rank / outdegree) + 1 - damping.

    Sources without a rank count as 1; nodes that nothing links to never get a row; an edge
    counts as often as it is listed. `initial` (doc_id, pagerank) continues earlier ranks.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("outdeg"))
    # Hash-partitioned by source once, so that each iteration only moves ranks and contributions.
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = edges.join(degree, "src").select("src", "dst", "outdeg").repartition(n, "src").persist()
    ranks = initial
    try:
        for i in range(iterations):
            given = links if ranks is None else links.join(ranks.withColumnRenamed("doc_id", "src"), "src", "left")
            rank = F.lit(1.0) if ranks is None else F.coalesce("pagerank", F.lit(1.0))
            ranks = given.groupBy(F.col("dst").alias("doc_id")).agg((damping * F.sum(rank / F.col("outdeg")) + (1 - damping)).alias("pagerank"))
            if (i + 1) % checkpoint_every == 0 and i + 1 < iterations:
                ranks = cut(ranks)
        return cut(ranks) if ranks is not None else edges.sparkSession.createDataFrame([], "doc_id bigint, pagerank double")
    finally:
        links.unpersist()
