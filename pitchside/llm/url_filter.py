"""URL filters: longest-rule verdicts, and block decisions carried to redirect and canonical-link aliases.

DataFrame operations only. A URL is judged by the longest rule that fits it. URLs
joined by redirect or canonical-link edges name one resource: their connected
component shares one decision, where an explicit allow rule anywhere in the
component comes before any block rule in it. A URL with a rule of its own keeps
that rule's verdict; the component decides for the URLs without one.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no
rule, has no aliases and is allowed; repeated rows give repeated results; an
empty table gives an empty result; null html has no links; columns of the input
are never looked up by any name but those given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .components import connected_components

#: Rules of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: What a page's links are not read from: comments, scripts and styles, also unclosed ones.
_SILENT = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
_DOTS = r"/\.\.?(?:/|\z)"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_META_URL = r"(?is)\burl\s*=\s*['\"]?([^'\">\s]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with ``.`` left out and ``..`` taken back to the segment before it (at the root: to the root)."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    walked = F.aggregate(segments, F.lit(""), lambda done, s: F.when(s == "..", F.regexp_replace(done, r"/[^/]*\z", ""))
                         .when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s)))
    return F.when(path.rlike(_DOTS), F.concat(walked, F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise(""))).otherwise(path)


def resource_key(url: Column) -> Column:
    """What a URL names: host, path without dot segments, and query, without scheme and fragment; null if it has no host."""
    key = F.concat(host_of(url), without_dots(path_of(url)), F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")))
    return F.when(host_of(url) != "", key)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, rule_verdict)``: the longest fitting rule of each distinct (host, path) that has one.

    Candidates come from an equi-join on the host's label suffixes, so the work grows with
    the number of URLs and not with URLs times rules. Among rules of one length the longer
    host wins, then allow before block.
    """
    pairs = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = pairs.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"),
                          (F.col("rule_verdict") == "allow").alias("allow"),
                          F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict")))
    fits = suffixes.join(rules, "rule_host").where(F.startswith(F.col("path"), F.col("rule_path")))
    return fits.groupBy("host", "path").agg(best.alias("r")).select(
        "host", "path", F.col("r.rule").alias("rule"), F.col("r.rule_verdict").alias("rule_verdict"))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` URL pairs from each page's canonical links and meta refreshes, relative targets resolved.

    Comments, scripts and styles are passed over; a target that is a fragment alone names its own page and gives no edge.
    """
    tags = F.concat(
        F.transform(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(0)), lambda t: F.concat_ws(
            "", F.regexp_extract(t, _HREF, 1), F.regexp_extract(t, _HREF, 2), F.regexp_extract(t, _HREF, 3))),
        F.transform(F.regexp_extract_all(F.col("html"), F.lit(_META), F.lit(0)), lambda t: F.regexp_extract(t, _META_URL, 1)))
    found = pages.select(F.col(url).alias("src"), F.col(html).alias("html")).where(
        F.col("html").rlike("(?i)canonical|refresh") & (host_of(F.col("src")) != ""))
    found = found.select("src", F.regexp_replace("html", _SILENT, " ").alias("html")).select("src", F.explode(tags).alias("to"))
    to = F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract("src", r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(F.col("src")))
    folder = F.regexp_replace(path_of(F.col("src")), r"[^/]*$", "")
    dst = (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
           .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
           .when(to.startswith("/"), F.concat(origin, to))
           .when(to.startswith("?"), F.concat(origin, path_of(F.col("src")), to))
           .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), to)))
    return found.where((to != "") & ~to.startswith("#")).select("src", dst.alias("dst"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None,
               page_id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per page row: id, host, path, rule (or null) and verdict.

    ``redirects`` adds edges ``(src, dst)`` known from elsewhere, such as a crawler's log;
    ``html`` names the column whose canonical links and refreshes are followed (None: none are).
    """
    spark = pages.sparkSession
    rule_rows = rules_table(spark, rules)
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        resource_key(F.col(url)).alias("key"))
    edges = redirects.select(F.col(redirects.columns[0]).alias("src"), F.col(redirects.columns[1]).alias("dst")) if redirects is not None else None
    if html is not None:
        links = link_edges(pages, url, html)
        edges = links if edges is None else edges.unionByName(links)
    verdicts = matched_rules(urls, rule_rows)
    out = urls.join(verdicts, ["host", "path"], "left")
    if edges is None:
        return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))

    ends = edges.select(resource_key(F.col("src")).alias("a"), resource_key(F.col("dst")).alias("b"))
    members = connected_components(ends)
    member_parts = members.select(
        "node", "component", host_of(F.concat(F.lit("x://"), "node")).alias("host"), path_of(F.concat(F.lit("x://"), "node")).alias("path"))
    decided = member_parts.join(matched_rules(member_parts, rule_rows), ["host", "path"], "left")
    shared = decided.groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    aliases = (decided.where("rule is null").join(shared.where("blocked and not coalesce(allowed, false)"), "component")
               .select(F.col("node").alias("key"), F.lit("block").alias("alias_verdict")))
    return out.join(aliases, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SQL_PARTS = r"'(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?'"


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), {_SQL_PARTS}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_part(url: str, k: int) -> str:
    return f"regexp_extract(coalesce({url}, ''), {_SQL_PARTS}, {k})"


def _sql_path(path: str) -> str:
    """The path without dot segments, by its list of segments."""
    segments = f"string_split(substr({path}, 2), '/')"
    return (f"CASE WHEN regexp_matches({path}, '{_DOTS}') THEN list_reduce({segments}, lambda a, s: "
            f"CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN s = '.' THEN a ELSE a || '/' || s END, '')"
            f" || CASE WHEN {segments}[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE {path} END")


def _sql_key(url: str) -> str:
    return f"CASE WHEN {_sql_host(url)} <> '' THEN {_sql_host(url)} || ({_sql_path(_sql_part(url, 2))}) || {_sql_part(url, 3)} END"


def _sql_best(urls: str) -> str:
    """The longest fitting rule of each host and path, by testing every rule."""
    return f"""SELECT u.host, u.path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM {urls} WHERE host <> '') u
  JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY u.host, u.path"""


_SQL_FOLDER = f"regexp_replace({_sql_part('src', 2)}, '[^/]*$', '')"
OP5_SQL = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_SQL_RULES}),
parts AS (SELECT page_id, regexp_replace(html, '{_SILENT}', ' ', 'g') AS html, url, {_sql_host('url')} AS host, {_sql_part('url', 2)} AS path, {_sql_key('url')} AS key FROM pages),
tags AS (
  SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag, true AS is_link
  FROM parts WHERE host <> ''
  UNION ALL
  SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), false FROM parts WHERE host <> ''),
targets AS (
  SELECT src, replace(trim(CASE WHEN is_link THEN
           regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1)
           || regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2)
           || regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)
         ELSE regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^''">\s]+)', 1) END), '&amp;', '&') AS dst
  FROM tags),
resolved AS (
  SELECT src, CASE WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN dst
                   WHEN starts_with(dst, '//') THEN 'x:' || dst
                   WHEN starts_with(dst, '?') THEN 'x://' || {_sql_host('src')} || {_sql_part('src', 2)} || dst
                   WHEN starts_with(dst, '/') THEN 'x://' || {_sql_host('src')} || dst
                   ELSE 'x://' || {_sql_host('src')} || CASE WHEN {_SQL_FOLDER} = '' THEN '/' ELSE {_SQL_FOLDER} END || dst END AS dst
  FROM targets WHERE dst <> '' AND NOT starts_with(dst, '#')),
edges AS (SELECT {_sql_key('src')} AS a, {_sql_key('dst')} AS b FROM resolved),
ends AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT a, a FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
nodes AS (SELECT DISTINCT a AS node, {_sql_host("('x://' || a)")} AS host, {_sql_part("('x://' || a)", 2)} AS path FROM ends),
node_best AS ({_sql_best('nodes')}),
ruled AS (SELECT n.node, b.rule_verdict FROM nodes n JOIN node_best b USING (host, path)),
blocked AS (
  SELECT r.a AS key FROM reach r JOIN ruled d ON d.node = r.b GROUP BY r.a
  HAVING bool_or(d.rule_verdict = 'block') AND NOT bool_or(d.rule_verdict = 'allow')),
best AS ({_sql_best('parts')})
SELECT page_id, parts.host, parts.path, rule, coalesce(rule_verdict, CASE WHEN blocked.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parts LEFT JOIN best ON best.host = parts.host AND best.path = parts.path LEFT JOIN blocked ON blocked.key = parts.key
"""
