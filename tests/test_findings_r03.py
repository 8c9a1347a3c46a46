"""Cases of the third round's findings."""

import re
from hashlib import md5

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from sparkseek import queries
from sparkseek.functions import text as tx
from sparkseek.operators import index as ix
from sparkseek.queries import ORACLES, QUERIES
from sparkseek.streaming import crawl as live


def test_tokens_of_many_dotted_parts(spark):
    """a text without white space is one token, however many full stops it has."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab."), 50_000), F.lit("c. "), F.repeat(F.lit("x"), 40)).alias("text"))
    assert [tuple(r) for r in ix.tokenised(docs).collect()] == [(0, 2, "x" * 40)]
    html = F.concat(F.lit("<meta name=description "), F.repeat(F.lit("a='>' "), 50_000), F.lit('content="told">'))
    assert spark.range(1).select(tx.html_description(html)).first()[0] == "told"


def _pages(spark):
    """Two pages of one URL, of which page 13 was visited and page 3 is asked for, in a folder of their own."""
    same = "http://ab.example/x"
    return spark.createDataFrame([(13, same, "<p>thirteen"), (3, same, "<p>three"), (5, same, "<p>five")], "page_id bigint, url string, html string")


def _compare(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder)).toPandas()
    assert rows(got) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["crawl_admission", "crawl_admission_delay", "crawl_next_frontier", "fetch_document_by_url"])
def test_pages_that_share_a_url(spark, tmp_path, name):
    """F2 to F5: a visit and a request are of one page, not of all that have its URL."""
    _pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    _compare(spark, tmp_path, name)


def test_store_knows_all_contents(spark, tmp_path):
    """two contents of one URL in a batch: one is stored, both are known."""
    rows_ = [("u", "old", 1), ("u", "new", 2), ("v", "new", 3), ("t", "only", 1)]
    arrived = spark.createDataFrame(rows_, "url string, document string, at int").select("url", "document", F.lit("text/html").alias("type"), F.timestamp_seconds("at").alias("ts"))
    arrived.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(arrived.schema).parquet(f"{tmp_path}/in")
    live.store_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    read = lambda name, column: sorted(r[0] for r in live.stored_table(spark, f"{tmp_path}/out", name).select(column).collect())
    assert read("checksum", "hash") == sorted(md5(x.encode()).hexdigest() for x in ("old", "new", "only"))
    assert read("segments", "html") == ["new", "only"] and read("url_to_doc", "url") == ["t", "u"] and read("visited", "url") == ["t", "u", "v"]


REPEATED = [(1, "b a b. a.b a"), (2, ""), (3, None), (4, "... é"), (5, "x y x"), (5, "y y z"), (None, "n"), (None, "n m"), (6, "was b is")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lemmatizer", ["identity", "rules"])
def test_words_are_gathered_in_their_document(spark, lemmatizer):
    """F8 to F14: the rows of the grouping steps, also for repeated ids, without a shuffle or a sort of tokens."""
    docs = spark.createDataFrame(REPEATED, "doc_id bigint, text string")
    for part in (docs, docs.where("doc_id < 5")):
        want = ix.word_positions(ix.tokenised(part, lemmatizer=lemmatizer))
        assert sorted(map(str, ix.document_positions(part, lemmatizer=lemmatizer).collect())) == sorted(map(str, want.collect()))
        shown = lambda view: sorted(str((r["doc_id"], sorted(r["forward_index"].items()), sorted(r["hit_lists"].items()), r["square_norm"])) for r in view.collect())
        assert shown(ix.document_view(part, lemmatizer=lemmatizer)) == shown(ix.forward_view(ix.postings(want)))
    for made in (ix.Index.build(part).postings, ix.document_view(part)):
        assert not {"Exchange", "Sort", "Aggregate"} & set(re.findall("Exchange|Sort(?=[ \\n(])|Aggregate", _plan(made)))


def test_saved_index_grows_in_partitions(spark, tmp_path, monkeypatch):
    """F8 to F14: partitions follow the table's bytes, and a word of many documents is spread over several."""
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ix, "PARTITION_BYTES", 100)
    n = ix.Index.partitions_for(docs)
    assert n > 8
    ix.Index.build(docs).save(f"{tmp_path}/index", n)
    saved = ix.Index.load(spark, f"{tmp_path}/index")
    held = [r["count"] for r in saved.postings.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 400 and max(held) < 100 and saved.freq.first()["n_doc"] == 400 and saved.norms.count() == 400


def test_arrivals_of_a_batch_are_several_files(spark, tmp_path):
    """no task writes or reads a whole batch; each value of the batch column is one micro-batch."""
    rows_ = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("batch"))
    seen = []

    def start(stream):
        keep = lambda batch, number: seen.append((number, batch.count(), batch.select(F.input_file_name()).distinct().count()))
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()

    queries._in_batches(spark, rows_, "batch", start)
    assert [s[:2] for s in seen] == [(0, 200), (1, 200)] and all(s[2] > 1 for s in seen)
