"""URL rules that spread over redirects and canonical links (operator 5).

A rule fits a host, its subdomains and the paths that begin with its path; the longest
fitting rule decides. Pages that no rule fits take the decision of their aliases: URLs are
the nodes, redirects (a table of them, and meta refreshes in the page) and canonical links
the edges, and connected components the sets of equivalent URLs. A component is blocked if
a URL in it is blocked by a rule and none is allowed by one: explicit allows take
precedence. Components are found by distributed star steps (components.py); neither links
nor components reach the driver.

Defined results: a null URL or one without ``://`` has an empty host and path, no aliases
and is allowed; comments, scripts and styles hold no links; entities in links are decoded and
relative links resolved against the page or its <base> (RFC 3986); fragments name the same
URL; repeated rows give repeated results; null html has no links; very long html is read
whole; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import connected

#: Fixed values: (verdict, host, path) of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: What a browser does not read as tags.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea|title)\b.*?(?:</\1\s*+>|\z)"
#: Quoted values may hold ``>``.
REST = r"\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
LINK, BASE = rf"(?is)<(?:link|meta){REST}", rf"(?is)<base{REST}"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
#: The whole value of an attribute, by its quotes: group 1, 2 or 3.
VALUE = r"(?is)[\s\"'/]%s\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
#: The rest of a refresh's decoded content, which may have quotes of its own.
TARGET = r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*(?:\"([^\"]*)|'([^']*)|(.*))"


#: Scheme, authority, path and query of a reference; the fragment is left out.
PARTS = re.compile(r"(?s)(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?")


def _rest(url: Column) -> Column:
    """What stands behind the first ``://``; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(frame: DataFrame, url: str, rules=RULES) -> DataFrame:
    """``frame`` with host, path, rule and rule_verdict of its column ``url``; rules are a short list, tried longest first."""
    out = frame.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, begins in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(begins)
        rule, verdict = F.when(fits, F.lit(at + begins)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def node(url: Column) -> Column:
    """The URL's name in the graph: without fragment, host in lower case; null without ``://``."""
    rest = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^#]*)", 1)
    scheme = F.lower(F.substring_index(url, "://", 1))
    return F.when(_rest(url).isNotNull(), F.concat(scheme, F.lit("://"), host(url), rest))


def _captured(text: Column, pattern: str) -> Column:
    """The first of a pattern's three groups that holds something."""
    return F.concat(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))


@F.arrow_udf(T.StringType())
def whole_url(page: pa.Array, link: pa.Array) -> pa.Array:
    """A link resolved against its page; null where there is none, it is empty or has no URL."""
    return pa.array([resolved(a, b) for a, b in zip(page.to_pylist(), link.to_pylist())], pa.string())


def resolved(page: str | None, link: str | None) -> str | None:
    link = (link or "").strip(" \t\r\n\f")
    if not page or not link:
        return None
    # RFC 3986, 5.2: the parts, and the merge of paths; hierarchical whatever the scheme
    scheme, authority, path, query = PARTS.match(link).group(2, 4, 5, 6)
    if scheme is not None:
        path = _without_dots(path) if authority is not None else path
        return f"{scheme}:{'' if authority is None else '//' + authority}{path}{query or ''}"
    base_scheme, base_authority, base_path, base_query = PARTS.match(page).group(2, 4, 5, 6)
    if base_scheme is None or base_authority is None:
        return None
    if authority is not None:
        path = _without_dots(path)
    else:
        authority = base_authority
        if not path:
            path, query = base_path, base_query if query is None else query
        elif path.startswith("/"):
            path = _without_dots(path)
        else:
            path = _without_dots((base_path[: base_path.rfind("/") + 1] or "/") + path)
    return f"{base_scheme}://{authority}{path}{query or ''}"


def _without_dots(path: str) -> str:
    parts = path.split("/")
    out: list[str] = []
    for i, part in enumerate(parts):
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
        if part in (".", "..") and i == len(parts) - 1:
            out.append("")
    return "/".join(out)


@F.arrow_udf(T.StringType())
def decoded(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def declared_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from pages to their canonical URLs and refresh targets."""
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh")).select("url", F.regexp_replace("html", HIDDEN, " ").alias("html"))
    base = decoded(_captured(F.regexp_extract("html", BASE, 0), VALUE % "href"))
    some = some.withColumn("from", F.when(F.col("html").rlike(BASE), base)).select("url", "from", F.regexp_extract_all("html", F.lit(LINK), F.lit(0)).alias("tags"))
    each = some.select("url", F.coalesce(whole_url(F.col("url"), F.col("from")), "url").alias("base"), F.explode("tags").alias("tag"))
    link, meta = F.col("tag").rlike("(?i)^<link"), F.col("tag").rlike("(?i)^<meta")
    names = F.lower(_captured(F.col("tag"), VALUE % "rel"))
    canonical = link & F.array_contains(F.split(F.trim(names), r"\s+"), "canonical")
    refresh = meta & (F.trim(F.lower(_captured(F.col("tag"), VALUE % "http-equiv"))) == "refresh")
    each = each.where(canonical | refresh)
    value = decoded(F.when(canonical, _captured(F.col("tag"), VALUE % "href")).otherwise(_captured(F.col("tag"), VALUE % "content")))
    target = F.when(link, F.col("value")).otherwise(_captured(F.col("value"), TARGET))
    link = each.withColumn("value", value).withColumn("to", target)
    whole = whole_url(F.col("base"), F.col("to"))
    return link.select(node(F.col("url")).alias("a"), node(whole).alias("b")).where("a <> b")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. redirects: URLs (source, target)."""
    edges = declared_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")))
    family = written(connected(edges), "aliases")
    members = family.unionByName(family.select(F.col("component").alias("node"), "component").distinct())
    verdicts = judged(members, "node", rules).groupBy("component").agg(F.max(F.expr("rule_verdict = 'block'")).alias("blocked"), F.max(F.expr("rule_verdict = 'allow'")).alias("allowed"))
    blocked = verdicts.where("blocked AND NOT coalesce(allowed, false)").select("component")
    aliases = members.join(blocked, "component").select("node").distinct().withColumn("alias_verdict", F.lit("block"))
    told = judged(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), "url", rules).withColumn("node", node(F.col("url")))
    # urls that are no node have no aliases; together they would be one key of the join
    other = told.where("node IS NULL").withColumn("alias_verdict", F.lit(None).cast("string"))
    found = told.where("node IS NOT NULL").join(aliases, "node", "left").unionByName(other)
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))


def op5_redirect_equivalence(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), links AS (
  SELECT regexp_replace(url, '(?s)#.*$', '') AS a, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*canonical[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) AS b FROM parts
  UNION ALL
  SELECT regexp_replace(url, '(?s)#.*$', ''), unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*refresh[^>]*\burl\s*=\s*[''"]?([^"''\s>;]+)', 1)) FROM parts
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, l.b FROM reach r JOIN sides l ON r.b = l.a),
alias AS (
  SELECT r.a, bool_or(u.verdict = 'block') AS blocked, bool_or(u.verdict = 'allow') AS allowed
  FROM reach r JOIN rules u ON (regexp_extract(r.b, '://([^/?#]*)', 1) = u.rule_host OR ends_with(regexp_extract(r.b, '://([^/?#]*)', 1), '.' || u.rule_host))
    AND starts_with(regexp_extract(r.b, '://[^/?#]*([^?#]*)', 1), u.rule_path) GROUP BY r.a
), ruled AS (
  SELECT p.page_id, p.host, p.path, p.url, arg_max(u.rule_host || u.rule_path, length(u.rule_host || u.rule_path)) AS rule,
    arg_max(u.verdict, length(u.rule_host || u.rule_path)) AS rule_verdict
  FROM parts p LEFT JOIN rules u ON (p.host = u.rule_host OR ends_with(p.host, '.' || u.rule_host)) AND starts_with(p.path, u.rule_path)
  GROUP BY p.page_id, p.host, p.path, p.url
)
SELECT r.page_id, r.host, r.path, r.rule,
  coalesce(r.rule_verdict, CASE WHEN a.blocked AND NOT coalesce(a.allowed, false) THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN alias a ON a.a = regexp_replace(r.url, '(?s)#.*$', '')
"""
