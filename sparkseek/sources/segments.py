"""Text formats: crawl segments, positions and adjacency lines."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "***DOCID:"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html) of segment files: records are whole and keyed by the marker before them.

    Files start with a marker or white space.
    """
    raw = spark.read.text(path, lineSep=MARK)
    body = F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1)
    # What stands before the next marker on its line isn't part of the body.
    rows = raw.where(F.col("value").rlike(r"^[^\n]*\n") & (F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)) != ""))
    return rows.select(F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("doc_id"), F.regexp_replace(body, r"\r?\n[ \t]*\z", "").alias("html"))


#: Bytes at which a segment is closed.
SEGMENT_BYTES = 50_000_000


def write_segments(docs: DataFrame, path: str, bytes_per_file: int = SEGMENT_BYTES) -> None:
    """Append-style text segments of (doc_id, html): a task closes a file when it holds so many bytes."""
    lines = docs.select(F.concat(F.lit(f" {MARK} "), F.col("doc_id").cast("string"), F.lit("\r\n"), F.coalesce("html", F.lit("")), F.lit("\r")).alias("value"))

    def roll(batches):
        held, segment = 0, 0
        for batch in batches:
            sizes, of = pc.binary_length(batch.column(0)).to_pylist(), []
            for n in sizes:
                if held >= bytes_per_file:
                    held, segment = 0, segment + 1
                held += n
                of.append(segment)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32())], names=["value", "segment"])

    # Rows of a task arrive by segment, so that each is one file of its own.
    lines.mapInArrow(roll, "value string, segment int").write.mode("overwrite").partitionBy("segment").text(path)


def positions_lines(positions: DataFrame) -> DataFrame:
    """(line): `(doc,word)\\t[p1, p2]`."""
    listed = F.array_join(F.transform("positions", lambda p: p.cast("string")), ", ")
    return positions.select(F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(","), F.col("word"), F.lit(")\t["), listed, F.lit("]")).alias("line"))


def parse_positions(lines: DataFrame) -> DataFrame:
    """(doc_id, word, positions) of well-formed lines; others are dropped."""
    pattern = r"^\(([^,)]*),([^,)]*)\)\s*\[([0-9, ]*)\]$"
    good = lines.where(F.col("line").rlike(pattern))
    numbers = F.regexp_extract_all(F.regexp_extract("line", pattern, 3), F.lit(r"(\d+)"), F.lit(1))
    return good.select(F.regexp_extract("line", pattern, 1).alias("doc_id"), F.regexp_extract("line", pattern, 2).alias("word"), F.transform(numbers, lambda x: x.cast("int")).alias("positions"))


def adjacency_lines(adjacency: DataFrame) -> DataFrame:
    """(line): `doc\\tout1,out2`."""
    return adjacency.select(F.concat(F.col("src").cast("string"), F.lit("\t"), F.col("line")).alias("line"))


def parse_adjacency(lines: DataFrame) -> DataFrame:
    """(src, dst) edges, duplicates kept."""
    pieces = F.split(F.trim("line"), r"\s+", 2)
    rows = lines.where(F.size(pieces) == 2)
    return rows.select(F.try_element_at(pieces, F.lit(1)).alias("src"), F.explode(F.split(F.try_element_at(pieces, F.lit(2)), ",")).alias("dst")).select("src", F.trim("dst").alias("dst")).where("dst <> ''")
