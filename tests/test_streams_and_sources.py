import json

import pytest

from sparkseek.operators import exchange, suggest
from sparkseek.operators import index as ix
from sparkseek.queries import QUERIES
from sparkseek.sources import segments, store

SMALL = "/root/testdata/sf0.001"


def test_politeness_stream_equals_sequential(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) AS t", "event_type").collect()
    last, want = {}, []
    for e in sorted(events, key=lambda e: (e["t"], e["event_type"])):
        ok = e["user_id"] not in last or e["t"] - last[e["user_id"]] >= 3600 * 10**6
        last[e["user_id"]] = e["t"] if ok else last[e["user_id"]]
        want.append((f"h{e['user_id']}.example.org", e["t"], ok))
    got = [(r["domain"], r["micros"], r["admitted"]) for r in QUERIES["stream_politeness"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_segments_round_trip(spark, tmp_path):
    docs = [("a", "<p>x\r\ny</p>"), ("b", ""), ("c", "multi\n\nline")]
    segments.write_segments(spark.createDataFrame(docs, "doc_id string, html string"), str(tmp_path / "s"), 2)
    assert sorted(map(tuple, segments.read_segments(spark, str(tmp_path / "s")).collect())) == docs
    (tmp_path / "t.txt").write_text("\r\n ***DOCID: d1\r\nbody\r\nmore\r\n\r\n ***DOCID:d2\r\nlast")
    assert sorted(map(tuple, segments.read_segments(spark, str(tmp_path / "t.txt")).collect())) == [("d1", "body\r\nmore\r\n"), ("d2", "last")]


def test_key_value_store(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    more = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, store.put(table, more, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [tuple(r) for r in store.get(table, "k", "a").collect()] == [("a", 1)] and store.get(table, "k", "z").isEmpty()
    assert [tuple(r) for r in store.batch_get(table, more, "k").collect()] == [("b", 2)]


def test_fetcher(spark):
    def fetcher():
        def get(url):
            if "bad" in url:
                raise OSError(url)
            return 200, "text/html", url.upper()

        return get

    got = store.fetch(spark.createDataFrame([("http://a",), ("http://bad",)], "url string"), fetcher)
    assert sorted(map(tuple, got.collect())) == [("http://a", 200, "text/html", "HTTP://A"), ("http://bad", 0, None, None)]


def test_index_saves_and_upserts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id bigint, text string")
    ix.Index.build(docs).save(str(tmp_path), 2)
    index = ix.Index.load(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["word"], r["count"]) for r in index.postings.collect()) == [(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 1)]
    new = ix.Index.build(spark.createDataFrame([(2, "d"), (3, "e")], "doc_id bigint, text string")).postings
    assert sorted((r["doc_id"], r["word"]) for r in ix.upsert(index.postings, new).collect()) == [(1, "a"), (1, "b"), (2, "d"), (3, "e")]


def test_suggestions(spark):
    docs = spark.createDataFrame([(1, "new york city new york state new york city"), (2, "the city")], "doc_id bigint, text string")
    counts = suggest.ngram_counts(ix.tokenised(docs))
    said = lambda typed: [r["suggestion"] for r in suggest.suggest(counts, typed).orderBy("rank").collect()]
    assert said("new york ") == ["new york city", "new york state", "new york new", "new york york", "new york the"]
    assert said("new york") == [] and said("   ") == []


def test_exchanges(spark):
    df = spark.range(40).selectExpr("id", "id % 5 AS k")
    with pytest.raises(ValueError):
        exchange.by_fields(df, 3)
    with pytest.raises(ValueError):
        exchange.by_fields(df, 3, "none")
    assert exchange.to_all(df, 3).count() == 120


def test_json_page(spark):
    data = json.loads(QUERIES["search_json"](spark, SMALL).first()["json"])
    assert data["total"] >= len(data["data"]) == 6 and set(data["data"][0]) == {"title", "url", "description"}


def test_service(spark):
    from sparkseek.plans.service import SearchService

    pages = spark.createDataFrame([(1, "http://a/1", "<title>One</title><p>red fox</p>"), (2, "http://a/2", "<title>Two</title><p>red red hen</p>")], "page_id bigint, url string, html string")
    docs = spark.createDataFrame([(1, "One red fox"), (2, "Two red red hen"), (3, "no page blue")], "doc_id bigint, text string")
    ranks = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "doc_id bigint, pagerank double")
    service = SearchService(ix.Index.build(docs), ranks, pages, suggest.ngram_counts(ix.tokenised(docs)))
    page = json.loads(service.search("red fox"))
    assert page["total"] == 2 and page["data"][0] == {"title": "One", "url": "http://a/1", "description": "red fox"}
    assert json.loads(service.search("red", 9)) == {"data": [], "total": 2} and json.loads(service.search("blue"))["data"] == []
    assert service.shown("hen")[0]["description"] == "red red <b>HEN</b>"
    assert service.suggest("two ")[0] == "two red" and service.total("zzz") == 0


def test_progress_listener(spark, tmp_path):
    from sparkseek.streaming.crawl import CrawlProgress

    listener = CrawlProgress(limit=5)
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()
        for _ in range(60):
            if listener.done(query):
                break
            query.awaitTermination(0.5)
        assert listener.done(query)
        query.stop()
    finally:
        spark.streams.removeListener(listener)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
