"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(url: Column) -> Column:
    """Parses, and its scheme is one that can be fetched."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False)) & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)


def parts(url: Column) -> Column:
    """(host, port, path, is_secure) of an http or https URL, else null: the host ends at `/` or `:`, bad ports give the default, no path gives `/`."""
    secure = url.startswith("https://")
    rest = F.regexp_replace(url, r"^https?://", "")
    authority = F.regexp_extract(rest, r"^([^/]*)", 1)
    port = F.try_to_number(F.when(F.regexp_extract(authority, r":([0-9]{1,5})$", 1) != "", F.regexp_extract(authority, r":([0-9]{1,5})$", 1)), F.lit("99999")).cast("int")
    path = F.regexp_extract(rest, r"^[^/]*(/.*)$", 1)
    made = F.struct(
        F.regexp_extract(authority, r"^([^:]*)", 1).alias("host"),
        F.coalesce(port, F.when(secure, 443).otherwise(80)).alias("port"),
        F.when(path == "", "/").otherwise(path).alias("path"),
        secure.alias("is_secure"),
    )
    return F.when(url.rlike(r"^https?://"), made)


def remove_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, 2, 100_000),
        F.array().cast("array<string>"),
        lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((tail == "/") & (F.size(kept) > 0), tail).otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a link; empty for links that aren't http or https."""
    href = F.trim(href)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+(/[^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    bare = F.regexp_extract(href, r"^([^?#]*)", 1)
    suffix = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when((root == "") | href.rlike(r"^(?i)(?!https?:)[a-z][a-z0-9+.\-]*:"), "")
        .when(href.rlike(r"^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .when(href.startswith("/"), F.concat(root, remove_dots(bare), suffix))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(root, F.when(path == "", "/").otherwise(path), href))
        .otherwise(F.concat(root, remove_dots(F.concat(folder, bare)), suffix))
    )
