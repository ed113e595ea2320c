"""URL filters with redirect equivalence, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import left_lookup, lookup, written
from ..operators.components import connected_components

#: (action, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits (of equal ones the first), and its action; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])) if rules else []:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def node_of(url: F.Column) -> F.Column:
    """A url as a node: without fragment and outer white space, host in lower case, an empty path as ``/``."""
    whole = F.regexp_replace(F.trim(url), r"#[\s\S]*$", "")
    scheme = F.translate(F.regexp_extract(whole, r"^([^:/?#]*)://", 1), UPPER, LOWER)
    path, query = path_of(whole), F.regexp_extract(whole, r"://[^?]*(\?[\s\S]*)$", 1)
    return F.when(whole.contains("://"), F.concat(scheme, F.lit("://"), host_of(whole), F.when(path == "", F.lit("/")).otherwise(path), query))


def target(page: F.Column, found: F.Column) -> F.Column:
    """A link as it stands in a page, made absolute; null where it is empty."""
    root = F.concat(F.regexp_extract(page, r"^([^:/?#]*)://", 1), F.lit("://"), host_of(page))
    found = F.replace(F.trim(found), F.lit("&amp;"), F.lit("&"))
    absolute = F.when(found.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), found).when(found.startswith("//"), F.concat(F.regexp_extract(page, r"^([^:/?#]*)", 1), F.lit(":"), found))
    absolute = absolute.when(found.startswith("/"), F.concat(root, found)).when(found != "", F.concat(root, F.regexp_replace(path_of(page), r"[^/]*$", ""), found))
    return node_of(absolute)


CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
GOES = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def links(pages: DataFrame) -> DataFrame:
    """``(a, b)`` nodes: a page's url and its canonical link, or the target of its meta refresh."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    held = pages.where(html.rlike(r"(?i)canonical|refresh")).select(url.alias("url"), F.explode(F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), GOES, 1))).alias("found"))
    return held.select(node_of(F.col("url")).alias("a"), target(F.col("url"), F.col("found")).alias("b")).where("a is not null and b is not null and a != b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """A verdict on every page: ``(page_id, host, path, rule, verdict, component)``.

    The rule is the longest that fits, and its action the verdict. A page without a rule takes the verdict of its
    aliases: pages and link targets joined to it over canonical links, meta refreshes and ``redirects(a, b)`` (urls) make
    one component. An allow rule on any alias comes before a block rule on others; without either the page is allowed.

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?`` or ``#``.
    A url that is null or has no ``://`` has both empty, and neither rule nor aliases: allowed. A null html has no links.
    Repeated rows are judged each, urls and pages of any length whole; an empty table gives none; extra columns are ignored. component is the alias class's smallest url, else null.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("a")), node_of(F.col("b"))).where("a is not null and b is not null"))
    named = connected_components(edges)
    _, action = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    acted = named.withColumn("action", action)
    decided = acted.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    aliases = written(lookup(named, written(decided, "decided"), ["component"]).select("node", "component", "allowed", "blocked"), "aliases")

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    # A null would send all its rows to one task; a place of its own for each matches nothing as well.
    rows = rows.withColumn("node", F.coalesce("node", F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string"))))
    rows = left_lookup(rows, aliases, ["node"])
    alias = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", alias).alias("verdict"), "component")
