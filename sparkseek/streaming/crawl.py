"""Structured Streaming forms of the crawl."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.index import document_positions, postings
from ..session import shared_folder


def frontier_stream(events: DataFrame, host_col: str = "user_id") -> DataFrame:
    """(url, domain) of arriving URLs, made from an event stream's hosts and types."""
    return events.select(F.concat(F.lit("http://h"), F.col(host_col).cast("string"), F.lit(".example.org/"), F.col("event_type")).alias("url"), F.concat(F.lit("h"), F.col(host_col).cast("string"), F.lit(".example.org")).alias("domain"), F.col("ts").cast("timestamp").alias("ts"))


def dedup_stream(frontier: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Each URL once within the window; state is dropped behind the watermark."""
    return frontier.withWatermark("ts", window).dropDuplicatesWithinWatermark(["url"])


def visited_stream(frontier: DataFrame, path: str, checkpoint: str):
    """Each URL once, however late it comes again: a batch keeps what no earlier batch has stored; a replay overwrites itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.select("url").distinct().join(before(batch, path, number, "url string").select("url"), "url", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frontier.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def before(batch: DataFrame, path: str, number: int, schema: str) -> DataFrame:
    """The rows that batches before `number` have stored in a table."""
    spark = batch.sparkSession
    if number == 0:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(path).where(F.col("batch") < number)


def latest(table: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last batch: what a table that batches upsert into holds."""
    newest = table.groupBy(key).agg(F.max("batch").alias("batch"))
    return table.join(newest, [key, "batch"], "left_semi").drop("batch")


class Politeness(StatefulProcessor):
    """Admits a domain's fetch only when its last admitted one is `delay_s` seconds old; state is one timestamp a domain."""

    def __init__(self, delay_s: float):
        self.delay_s = delay_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        pages = [p for p in rows if len(p)]
        if not pages:
            return
        page = pd.concat(pages).sort_values(["micros", "url"], kind="stable")
        admitted = []
        for micros in page["micros"]:
            ok = last is None or micros - last >= self.delay_s * 1e6
            last = int(micros) if ok else last
            admitted.append(ok)
        self.last.update((last,))
        yield pd.DataFrame({"domain": key[0], "url": page["url"].values, "micros": page["micros"].values, "admitted": admitted})

    def close(self) -> None:
        pass


def politeness_stream(frontier: DataFrame, delay_s: float) -> DataFrame:
    """(domain, url, micros, admitted): late-comers are to be enqueued again."""
    rows = frontier.select("domain", "url", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("domain").transformWithStateInPandas(Politeness(delay_s), "domain string, url string, micros long, admitted boolean", "append", "none")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, into Parquet in the shared folder, and read the result."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def index_stream(docs: DataFrame, path: str, checkpoint: str):
    """Index arriving documents: each micro-batch stores its postings under its own number, so a replay overwrites itself.

    A document that arrives again replaces its postings: read them through `indexed_postings`.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        postings(document_positions(batch)).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed_postings(spark, path: str) -> DataFrame:
    """The postings of each document's last arrival; one that came back without words has none."""
    newest = spark.read.parquet(f"{path}/docs").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/postings").join(newest, ["doc_id", "batch"], "left_semi").drop("batch")


def stored_rows(fetched: DataFrame) -> dict[str, DataFrame]:
    """The rows that a fetched document (url, document, type, ts) adds to each table; ids are MD5s of URLs."""
    rows = fetched.withColumn("doc_id", F.md5("url"))
    domain = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1), F.lit("")), F.lit("unknown"))
    return {
        "segments": rows.select("doc_id", F.col("document").alias("html")),
        "url_to_doc": rows.select("url", "doc_id"),
        "checksum": rows.select(F.md5("document").alias("hash")).distinct(),
        "visited": rows.select("url").distinct(),
        "domain": rows.groupBy(domain.alias("domain")).agg((F.max(F.unix_millis("ts"))).alias("last_access_ms")),
    }


def store_stream(fetched: DataFrame, path: str, checkpoint: str):
    """Fan a stream of fetched documents out to all tables; a replayed batch overwrites itself.

    A document whose content an earlier batch or URL has stored only counts as visited. One
    that comes again with another content replaces the old one: read the tables through
    `stored_table`. Of several documents of a batch with one URL the last by time stays, the
    contents of all are known from then on.
    """

    def store(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("hash", F.md5("document"))
        # Of equal contents the smallest URL is stored.
        first = hashed.groupBy("hash").agg(F.min("url").alias("url")).join(before(batch, f"{path}/checksum", number, "hash string"), "hash", "left_anti").persist()
        new = hashed.join(first, ["hash", "url"], "left_semi").groupBy("url").agg(F.max_by(F.struct("document", "type", "ts"), F.struct("ts", "hash")).alias("r")).select("url", "r.*").persist()
        try:
            fetched_rows = stored_rows(batch)
            sources = {**stored_rows(new), "checksum": first.select("hash"), "visited": fetched_rows["visited"], "domain": fetched_rows["domain"]}
            for name, rows in sources.items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            new.unpersist()
            first.unpersist()

    return fetched.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_table(spark, path: str, name: str) -> DataFrame:
    """A table of the store as its batches left it."""
    table = spark.read.parquet(f"{path}/{name}")
    if name == "domain":
        return table.groupBy("domain").agg(F.max("last_access_ms").alias("last_access_ms"))
    return latest(table, {"segments": "doc_id", "url_to_doc": "url", "checksum": "hash", "visited": "url"}[name])


class CrawlProgress(StreamingQueryListener):
    """Counts the documents of each running crawl and says when `limit` are stored."""

    def __init__(self, limit: int | None = None):
        self.limit, self.counts, self.state = limit, {}, {}

    def onQueryStarted(self, event) -> None:
        self.state[str(event.id)] = "working"

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.counts[key] = self.counts.get(key, 0) + event.progress.numInputRows
        self.state[key] = "working" if event.progress.numInputRows else "waiting"

    def onQueryIdle(self, event) -> None:
        self.state[str(event.id)] = "waiting"

    def onQueryTerminated(self, event) -> None:
        self.state[str(event.id)] = "exited"

    def done(self, query) -> bool:
        return self.limit is not None and self.counts.get(str(query.id), 0) >= self.limit
