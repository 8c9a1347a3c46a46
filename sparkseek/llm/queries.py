"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread, table


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import score, train

    ship(spark)
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, folder, "labels").select("doc_id", "quality").where(~held_out)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from .html import extract

    ship(spark)
    return extract(spread(table(spark, folder, "pages").select("page_id", "url", "html")))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack_documents

    ship(spark)
    return pack_documents(spread(table(spark, folder, "documents").select("doc_id", "text")))


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .vectors import near_duplicates

    ship(spark)
    return near_duplicates(spread(table(spark, folder, "embeddings").select("vec_id", "embedding")))


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    from .chat import digest, format_turns

    ship(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_turns(turns.unionByName(extra)))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .lines import dedup_lines

    ship(spark)
    return dedup_lines(spread(table(spark, folder, "documents").select("doc_id", "text")))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mix

    ship(spark)
    return mix(table(spark, folder, "documents").select("doc_id", "source"))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import near_duplicates

    ship(spark)
    return near_duplicates(spread(table(spark, folder, "documents").select("doc_id", "text")))


def op9_media_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no images: each row of `embeddings` gets a rendered picture, every eighth an edited copy."""
    from .common import stored
    from .media import image_copies, rendered

    ship(spark)
    # Written once, as a table's own media column would be.
    images = stored(rendered(spread(table(spark, folder, "embeddings").select("vec_id"))))
    return image_copies(images, "vec_id")


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    from .secrets import find_secrets

    ship(spark)
    found = find_secrets(spread(table(spark, folder, "documents").select("doc_id", "text")))
    line = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = ["assign", "access", "hex"]
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in base],
        F.sha2(line(base), 256).alias("base_sha256"),
        line([*base, "named"]).alias("spans"),
    )


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_media_copies": op9_media_copies,
    "op10_secret_scans": op10_secret_scans,
}

#: SQL for the queries that it can express; the others are tested against brute-force versions.
ORACLES: dict[str, str] = {}

_REACH = """reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT node, min(other) AS first FROM reach GROUP BY node)"""

ORACLES["op4_embedding_near_dedup"] = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS x FROM embeddings),
good AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda k: k IS NULL OR NOT isfinite(k))) = 0 AND list_dot_product(x, x) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
{_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(first, vec_id) AS component_id, vec_id = coalesce(first, vec_id) AS kept FROM v LEFT JOIN n ON a = vec_id LEFT JOIN least ON node = vec_id"""

_SAID = "</s>[INST] ok [/INST]"
ORACLES["op5_chat_formatting"] = f"""WITH t AS (SELECT conv_id::bigint AS conv_id, turn::bigint AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, regexp_replace(text, '[\\\\\\[\\]<]', '..', 'g') AS safe_text, regexp_replace(role, '[\\\\\\[\\]<]', '..', 'g') AS safe_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::bigint AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
sum(15 + 2 * length(safe_role) + length(safe_text))::bigint AS formatted_chars FROM e GROUP BY conv_id"""

ORACLES["op8_ngram_jaccard_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM w WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE both_.n / (x.n + y.n - both_.n)::double >= 0.8),
{_REACH}, k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(first, d.doc_id) AS class_id, coalesce(n, 0)::bigint AS n_links, d.doc_id = coalesce(first, d.doc_id) AS kept FROM documents d LEFT JOIN k ON a = d.doc_id LEFT JOIN least ON node = d.doc_id"""
