"""Crawling as DataFrame operators: robots rules, admission, de-duplication, politeness, frontier rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import cut
from .graph import page_links

#: Media types that are fetched; so is any that ends with xml.
TYPES = ("text/html", "text/xml", "application/xml")


def frontier_hosts(frontier: DataFrame) -> DataFrame:
    """(url, domain): the host, or `unknown`."""
    return frontier.select("url", F.coalesce(F.nullif(urls.host(F.col("url")), F.lit("")), F.lit("unknown")).alias("domain"))


def media_type_ok(kind: Column) -> Column:
    bare = F.trim(F.split_part(kind, F.lit(";"), F.lit(1)))
    return bare.isin(*TYPES) | bare.endswith("xml")


def size_ok(size: Column, max_mb: float) -> Column:
    """Unknown sizes (-1) and empty documents pass."""
    return size <= F.lit(max_mb * (1 << 20))


def robots_rules(files: DataFrame) -> DataFrame:
    """(domain, user_agent, disallow, allow, delay) from robots files (domain, body).

    A block starts with its first user-agent line after other directives; agents that
    follow one another share the block. A delay of a.b seconds counts as a + 1.
    """
    lines = files.select("domain", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    parsed = lines.select(
        "domain", "pos",
        F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1))).alias("field"),
        F.trim(F.regexp_extract("line", r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value"),
    ).where(F.col("field").isin("user-agent", "disallow", "allow", "crawl-delay"))
    w = Window.partitionBy("domain").orderBy("pos")
    agent = F.col("field") == "user-agent"
    opens = agent & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    blocks = parsed.withColumn("block", F.sum(opens.cast("int")).over(w)).where("block > 0")
    pick = lambda field: F.array_sort(F.collect_set(F.when((F.col("field") == field) & (F.col("value") != ""), F.col("value"))))
    whole = F.regexp_extract("value", r"^(\d+)", 1).try_cast("int")
    delay = F.when(F.col("field") == "crawl-delay", whole + F.when(F.col("value").rlike(r"^\d+\.\d+"), 1).otherwise(0))
    rules = blocks.groupBy("domain", "block").agg(F.collect_set(F.when(agent, F.col("value"))).alias("agents"), pick("disallow").alias("disallow"), pick("allow").alias("allow"), F.max_by(delay, F.when(delay.isNotNull(), F.col("pos"))).alias("delay"))
    named = rules.select("domain", F.explode("agents").alias("user_agent"), "block", "disallow", "allow", "delay")
    # An agent that is named twice keeps its last block.
    return named.groupBy("domain", "user_agent").agg(F.max_by(F.struct("disallow", "allow", "delay"), "block").alias("r")).select("domain", "user_agent", "r.disallow", "r.allow", F.coalesce("r.delay", F.lit(0)).alias("delay"))


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """One rule a domain: the agent's own, else that of `*`."""
    fits = rules.where(F.col("user_agent").isin(agent, "*"))
    return fits.groupBy("domain").agg(F.max_by(F.struct("disallow", "allow", "delay"), F.col("user_agent") == agent).alias("r")).select("domain", "r.*")


def path_allowed(path: Column, disallow: Column, allow: Column) -> Column:
    """Prefixes; any allow beats any disallow; no rule allows."""
    some = lambda c: F.coalesce(F.exists(c, lambda p: F.startswith(path, p)), F.lit(False))
    return some(allow) | ~some(disallow)


def admission(fetches: DataFrame, visited: DataFrame, rules: DataFrame, agent: str, max_mb: float, enforce_paths: bool = True, domains: DataFrame | None = None, now_ms: int | None = None, key: str = "url") -> DataFrame:
    """(url, reject): why a URL isn't fetched, null if it is. fetches: (url, status, type, size).

    A fetch was visited if `visited` has its `key`: its URL, or a column that tells apart
    fetches of one URL.
    With `domains` (domain, last_access_ms) a URL whose domain was last asked less than its
    rule's delay before `now_ms` is rejected as `delay`; such URLs are to be enqueued again.
    """
    rows = fetches.select(*dict.fromkeys((key, "url", "status", "type", "size")), urls.host(F.col("url")).alias("domain"), urls.parts(F.col("url"))["path"].alias("path"))
    rows = rows.join(visited.select(key).distinct().withColumn("seen", F.lit(True)), key, "left").join(rules_for(rules, agent), "domain", "left")
    early = F.lit(False)
    if domains is not None:
        rows = rows.join(domains.groupBy("domain").agg(F.max("last_access_ms").alias("last_ms")), "domain", "left")
        now = F.lit(now_ms).cast("bigint") if now_ms is not None else F.unix_millis(F.current_timestamp())
        early = F.coalesce((F.col("delay") > 0) & (now - F.col("last_ms") < F.col("delay") * 1000), F.lit(False))
    reason = (
        F.when(~urls.is_valid(F.col("url")), "invalid")
        .when(F.coalesce("status", F.lit(0)) != 200, "status")
        .when(F.col("seen"), "visited")
        .when(F.lit(enforce_paths) & ~path_allowed(F.col("path"), F.col("disallow"), F.col("allow")), "robots")
        .when(early, "delay")
        .when(~size_ok(F.col("size"), max_mb), "size")
        .when(~media_type_ok(F.col("type")), "type")
    )
    return rows.select("url", reason.alias("reject"))


def next_frontier(admitted: DataFrame, links: DataFrame, visited: DataFrame) -> DataFrame:
    """(url): what goes back to the queue: URLs that came too early, and the valid new ones among the links found."""
    again = admitted.where("reject = 'delay'").select("url")
    return again.unionByName(url_filter(links, visited.select("url").unionByName(admitted.where("reject IS NULL").select("url")))).distinct()


def content_dedup(docs: DataFrame, seen: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(hash, doc_id): the first document of each content hash that `seen` (hash) doesn't hold."""
    first = docs.groupBy(F.md5(text_col).alias("hash")).agg(F.min(id_col).alias(id_col))
    return first if seen is None else first.join(seen.select("hash"), "hash", "left_anti")


def url_filter(links: DataFrame, visited: DataFrame) -> DataFrame:
    """(url): valid distinct URLs that weren't visited."""
    return links.select("url").distinct().where(urls.is_valid(F.col("url"))).join(visited.select("url"), "url", "left_anti")


def politeness_gaps(fetches: DataFrame, domain: str, ts: str, delay_s: Column) -> DataFrame:
    """Each fetch with the gap to its domain's last one and whether it came too early."""
    w = Window.partitionBy(domain).orderBy(ts, "event_id")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return fetches.select("event_id", domain, gap.alias("gap_us"), F.coalesce(gap < delay_s * F.lit(1_000_000).cast("bigint"), F.lit(False)).alias("too_early"))


def crawl_rounds(seeds: DataFrame, links: DataFrame, limit: int, rounds: int) -> DataFrame:
    """(url, round): breadth-first frontier from the seeds over (src_url, url), each URL once, until `limit` are found."""
    found = cut(seeds.select("url").distinct().withColumn("round", F.lit(0)))
    last = found
    for k in range(1, rounds + 1):
        new = links.join(last.select(F.col("url").alias("src_url")), "src_url").select("url").distinct().join(found.select("url"), "url", "left_anti")
        last = cut(new.withColumn("round", F.lit(k)))
        if last.isEmpty():
            break
        found = cut(found.unionByName(last))
        if found.count() >= limit:
            break
    return found.orderBy("round", "url").limit(limit)


def extracted_links(fetched: DataFrame) -> DataFrame:
    """(url, link): links of fetched HTML documents; other types have none. fetched: (url, document, type)."""
    html = fetched.where(F.trim(F.split_part("type", F.lit(";"), F.lit(1))) == "text/html")
    found = page_links(html.select(F.col("url").alias("page_id"), "url", F.col("document").alias("html")))
    return found.select(F.col("page_id").alias("url"), F.col("url").alias("link"))
