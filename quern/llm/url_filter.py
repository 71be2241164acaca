"""URL filters: block and allow rules, carried over redirects and canonical links to a page's aliases. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    rest = _after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    rest = _after_scheme(url)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest rule (host and path joined; then the longer host) that fits, as text; null where none does.

    rules: (verdict, host, path), verdict "allow" or "block". They become one chain of conditions in the scan's stage, the longest
    first; meant for hundreds of rules.
    """
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)).otherwise(out)
    return out


def _key(url: Column) -> Column:
    """The same for all spellings of one place: scheme and host lower-cased, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.concat(F.translate(F.regexp_extract(bare, r"^[^:/?#]+://[^/?#]*", 0), UPPER, LOWER), F.regexp_replace(bare, r"^[^:/?#]+://[^/?#]*", ""))


def _resolved(base: Column, link: Column) -> Column:
    """The place that a link on a page means."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    site = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(_SCHEME), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))  # mailto: and the like
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:/?#]+:", 0), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link))
        .otherwise(F.concat(folder, link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """a, b: a page and where its canonical link or meta refresh points, by place."""
    html = F.coalesce("html", F.lit(""))
    canonical = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"'>\s]+)""", 1)
    href = F.regexp_extract(canonical, r"""(?is)\bhref\s*=\s*["']?([^"'>\s]+)""", 1)
    links = pages.where("url is not null and html is not null").select("url", F.explode(F.array(href, refresh)).alias("link")).where("link <> ''")
    return links.select(_key(F.col("url")).alias("a"), _key(_resolved(F.col("url"), F.col("link"))).alias("b")).where("b is not null and instr(a, '://') > 0")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule, verdict.

    A rule that fits the url decides. Otherwise the aliases of the url do, all places reachable over redirects (columns source,
    target) and canonical links in either direction: "allow" if a rule allows one of them explicitly, else "block" if one is
    blocked, else `default`. Null urls have empty host and path and no alias. Every row stays; other columns are dropped.
    """
    verdicts = {h + p: v for v, h, p in rules}
    judge = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair]) if rules else None

    def judged(df: DataFrame) -> DataFrame:
        df = df.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
        df = df.withColumn("rule", rule_column(rules, F.col("host"), F.col("path")))
        return df.withColumn("_own", F.element_at(judge, F.col("rule")) if rules else F.lit(None).cast("string"))

    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(_key(F.col("source")), _key(F.col("target"))))
    edges = materialize(edges.distinct(), "aliases")
    rows = judged(pages.select("page_id", F.col("url").alias("_url")))
    if edges.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_own", F.lit(default)).alias("verdict"))
    members = materialize(connected_components(edges, "aliases"), "aliases-members")
    sides = judged(members.withColumn("_url", F.col("node"))).groupBy("component").agg(F.bool_or(F.col("_own") == "allow").alias("_allow"), F.bool_or(F.col("_own") == "block").alias("_block"))
    by_node = members.join(sides, "component").select("node", "_allow", "_block")
    rows = rows.withColumn("_node", F.when(F.col("_own").isNull(), _key(F.col("_url"))))
    return rows.join(by_node, F.col("_node") == F.col("node"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_own", F.when(F.col("_allow"), F.lit("allow")), F.when(F.col("_block"), F.lit("block")), F.lit(default)).alias("verdict")
    )
