"""URL block lists whose decisions follow redirects and canonical links to aliases.

A rule is (action, host, path prefix): it fits its host, all subdomains, and urls
whose path starts with the prefix; the longest fitting rule decides (allow before
block on equal length). A url that no rule fits takes ``block`` when any alias of
it, reached over redirect or canonical-link edges, is blocked by a rule; an explicit
allow rule always stands for its own url, whatever its aliases are.

Defined results: null url or one without ``://`` has empty host and path, no rule
and verdict allow; repeated rows are judged one by one; an empty table gives an
empty result; columns of the input beyond id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm._graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules become one expression evaluated on every row, so their number is bounded.
MAX_RULES = 2000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(action, rule); null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    cases = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(a).alias("action"), F.lit(h + p).alias("rule")))
        for a, h, p in ordered
    ]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<action:string,rule:string>")


def node_of(url: Column) -> Column:
    """A url as a node of the alias graph: scheme and host in lower case, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substring(bare, F.length(head) + 1, F.lit(2**31 - 1)))


def _absolute(base: Column, link: Column) -> Column:
    """link resolved against base; dot segments stay as they are."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, link))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes of canonical links and meta-refresh redirects found in the pages."""
    tagged = pages.select(F.col(url).alias("base"), F.col(html).alias("page")).where(
        "base like '%://%' and (page ilike '%canonical%' or page ilike '%refresh%')"
    )
    links = tagged.select(
        "base",
        F.explode(
            F.array(
                F.regexp_extract(F.regexp_extract("page", _CANONICAL, 0), _HREF, 1),
                F.regexp_extract(F.regexp_extract("page", _REFRESH, 0), _TARGET, 1),
            )
        ).alias("link"),
    ).where("link <> ''")
    target = F.regexp_replace("link", "&amp;", "&")
    return links.select(node_of(F.col("base")).alias("src"), node_of(_absolute(F.col("base"), target)).alias("dst")).where("src <> dst")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    edges: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, propagated for every row of pages.

    edges: (src, dst) urls that lead to each other; without it they are read from the
    pages' html. Only edge ends enter the component search, so its cost follows the
    links, not the pages; what a component blocks is found from the ends' own urls.
    """
    edges = alias_edges(pages, url) if edges is None else edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
    parts = connected_components(edges)
    ends = parts.withColumn("_fit", _fitting(host_of(F.col("node")), path_of(F.col("node")), rules))
    blocked = ends.groupBy("component").agg(F.max((F.col("_fit.action") == "block").cast("int")).alias("hit")).where("hit = 1")
    aliases = ends.where("_fit is null").join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_hit"))
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select(
        "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), node_of(F.col("_url")).alias("_key")
    )
    judged = judged.withColumn("_fit", _fitting(F.col("host"), F.col("path"), rules))
    if aliases.isEmpty():
        judged = judged.withColumn("_hit", F.lit(None).cast("boolean"))
    else:
        judged = judged.join(aliases, F.col("_key") == F.col("_node"), "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.action", F.when(F.col("_hit"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("_hit", F.lit(False)).alias("propagated"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_parts(col: str, host: str = "host", path: str = "path") -> str:
    return f"""translate(coalesce(regexp_extract({col}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS {host},
      coalesce(regexp_extract({col}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS {path}"""


def _sql_rule(of: str) -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{a if of == 'action' else h + p}'" for a, h, p in ordered) + " END"


SQL = f"""
WITH RECURSIVE tagged AS (
  SELECT url AS base,
    unnest([regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1)]) AS link
  FROM pages WHERE url LIKE '%://%'),
links AS (
  SELECT base, regexp_extract(base, '(?s)^(.*?://[^/?#]*)', 1) AS origin, replace(link, '&amp;', '&') AS link FROM tagged WHERE link <> ''),
full_links AS (
  SELECT base, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(base, '(?s)^(.*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN origin || link
    ELSE origin || coalesce(nullif(regexp_extract(regexp_extract(base, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '(?s)^(.*/)', 1), ''), '/') || link END AS goal
  FROM links),
bare AS (SELECT regexp_replace(base, '(?s)#.*$', '') AS s, regexp_replace(goal, '(?s)#.*$', '') AS d FROM full_links),
pairs AS (
  SELECT translate(regexp_extract(s, '(?s)^(.*?://[^/?]*)', 1), '{UPPER}', '{LOWER}') || substr(s, length(regexp_extract(s, '(?s)^(.*?://[^/?]*)', 1)) + 1) AS src,
    translate(regexp_extract(d, '(?s)^(.*?://[^/?]*)', 1), '{UPPER}', '{LOWER}') || substr(d, length(regexp_extract(d, '(?s)^(.*?://[^/?]*)', 1)) + 1) AS dst
  FROM bare),
both_ways AS (SELECT src, dst FROM pairs WHERE src <> dst UNION SELECT dst, src FROM pairs WHERE src <> dst),
ends AS (SELECT node, {_sql_parts("node")} FROM (SELECT DISTINCT src AS node FROM both_ways)),
ruled AS (SELECT node, {_sql_rule("action")} AS action FROM ends),
reached(node) AS (
  SELECT node FROM ruled WHERE action = 'block'
  UNION SELECT b.dst FROM both_ways b JOIN reached r ON b.src = r.node),
hit AS (SELECT node FROM reached JOIN ruled USING (node) WHERE action IS NULL),
split AS (
  SELECT page_id, {_sql_parts("url")}, regexp_replace(url, '(?s)#.*$', '') AS u FROM pages),
keyed AS (
  SELECT page_id, host, path, {_sql_rule("action")} AS action, {_sql_rule("rule")} AS rule,
    translate(regexp_extract(u, '(?s)^(.*?://[^/?]*)', 1), '{UPPER}', '{LOWER}') || substr(u, length(regexp_extract(u, '(?s)^(.*?://[^/?]*)', 1)) + 1) AS node
  FROM split)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN h.node IS NOT NULL THEN 'block' END, 'allow') AS verdict, h.node IS NOT NULL AS propagated
FROM keyed LEFT JOIN hit h ON keyed.node = h.node
"""
