"""Key-value style access over tables, and pluggable page fetching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none; the filter reaches the file scan."""
    return table.where(F.col(key) == F.lit(value))


def batch_get(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that exist."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def put(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table after rows were saved: equal keys are replaced."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def fetch_by_url(url_map: DataFrame, files: DataFrame, segments: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, doc_id, html): url -> document -> file -> body, for the URLs that the store knows.

    A URL has all its documents, unless `urls` (url, doc_id) names the one that is meant.
    """
    named = [c for c in ("url", "doc_id") if c in urls.columns]
    wanted = urls.select(named).distinct().join(url_map, named).join(files, "doc_id")
    return wanted.join(segments, ["doc_id", "file_id"]).select("url", "doc_id", "html")


def fetch(urls: DataFrame, fetcher: Callable[[], Callable[[str], tuple[int, str, str]]]) -> DataFrame:
    """(url, status, type, document): downloads through a fetcher that each task builds once.

    A fetcher maps a URL to (status, media type, body); a download that raises has status 0.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        get_page = fetcher()
        for batch in batches:
            found = []
            for url in batch.column(0).to_pylist():
                try:
                    found.append((url, *get_page(url)))
                except Exception:  # any failed download is a row of its own
                    found.append((url, 0, None, None))
            yield pa.RecordBatch.from_pylist([dict(zip(("url", "status", "type", "document"), r)) for r in found], schema=pa.schema([("url", pa.string()), ("status", pa.int32()), ("type", pa.string()), ("document", pa.string())]))

    return urls.select("url").mapInArrow(run, "url string, status int, type string, document string")


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))
