"""URL filter by redirect equivalence: block decisions reach every alias of a blocked page (op 2, DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, stored, table
from tickloom.llm.graph import components

#: Fixed rules of the query: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules are compiled into one expression; a longer list belongs into a table joined on host.
MAX_RULES = 500


def host_of(url: Column) -> Column:
    """Lower-cased host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def node_of(url: Column) -> Column:
    """The resource that a URL names: host, path without closing slashes, and query; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+\z", ""), query))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule (host and path together) that fits; null if none does. A tie goes to allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    hits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(value((v, h, p))))
            for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def target_of(html: Column, url: Column, tag: str, attribute: str) -> Column:
    """The URL that the first such tag points to; a path from the root is taken on the page's own host."""
    found = F.regexp_extract(F.regexp_extract(html, tag, 0), attribute, 1)
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return (F.when(found.startswith("//"), F.concat(F.lit("http:"), found))
            .when(found.startswith("/"), F.concat(origin, found)).when(F.instr(found, "://") > 0, found))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None,
          key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, and ``alias_of``, the smallest resource of its class.

    Pages are linked by their canonical link, their meta refresh, and ``redirects`` (source, target URLs) if given; the
    connected components of these links are classes of aliases. A page's own longest rule decides. Without one, an explicit
    allow anywhere in its class wins over any block there, a block reaches all aliases, and a class without rules is allowed.

    Null, empty and malformed URLs have an empty host and path, belong to no class and are allowed; null html has no links;
    repeated rows are judged alike, each once; further columns of the input are ignored; an empty table gives no rows.
    """
    u, h = F.col(url).cast("string"), F.col(html).cast("string")

    def ruled(address: Column, value) -> Column:
        return longest_rule(host_of(address), path_of(address), rules, value)

    def resource(address: Column) -> Column:
        return F.struct(node_of(address).alias("node"), ruled(address, lambda r: r[0]).alias("own"))

    canonical = target_of(h, u, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = target_of(h, u, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    links = pages.select(resource(u).alias("a"), F.explode(F.array(canonical, refresh)).alias("t")).where("t IS NOT NULL").select("a", resource(F.col("t")).alias("b"))
    if redirects is not None:
        s, t = (F.col(c).cast("string") for c in redirects.columns[:2])
        links = links.union(redirects.select(resource(s), resource(t)))
    links = stored(links.where("a.node IS NOT NULL AND b.node IS NOT NULL"), "links")
    roots = components(links.select("a.node", F.col("b.node").alias("target")), "node", "target")
    own = pages.select(F.col(key).alias("k"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"),
                       ruled(u, lambda r: r[1] + r[2]).alias("rule"), ruled(u, lambda r: r[0]).alias("own"))
    # a linked resource carries its rule into its class even if it is no page of the table
    named = own.select("node", "own").union(links.select(F.explode(F.array("a", "b")).alias("x")).select("x.*"))
    root = F.coalesce("root", "node")
    classes = (named.where("node IS NOT NULL AND own IS NOT NULL").groupBy("node", "own").agg(F.lit(1).alias("one"))
               .join(roots, "node", "left").groupBy(root.alias("alias_of")).agg(F.min("own").alias("class_verdict")))
    return (own.join(roots, "node", "left").withColumn("alias_of", root).join(classes, "alias_of", "left")
            .select(F.col("k").alias(key), "host", "path", "rule",
                    F.coalesce("own", "class_verdict", F.lit("allow")).alias("verdict"), "alias_of"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(html, '') AS html, url,
         coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
         coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END, '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
own AS (
  SELECT p.*, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+\z', '') || query END AS node, r.rule, r.action AS own
  FROM p LEFT JOIN LATERAL (
    SELECT h || rules.p AS rule, action FROM rules
    WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, rules.p) ORDER BY length(h || rules.p) DESC, action LIMIT 1) r ON true),
targets AS (
  SELECT node, host, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM own
  UNION ALL
  SELECT node, host, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM own),
urls AS (
  SELECT node, CASE WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t WHEN contains(t, '://') THEN t END AS t FROM targets),
links AS (
  SELECT DISTINCT node AS a, h || regexp_replace(p, '/+\z', '') || q AS b, (
           SELECT arg_max(action, length(rules.h || rules.p)) FROM rules WHERE (l.h = rules.h OR ends_with(l.h, '.' || rules.h)) AND starts_with(l.p, rules.p)) AS own
  FROM (SELECT node, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
               regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(t, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS q
        FROM urls WHERE t IS NOT NULL AND node IS NOT NULL) l WHERE h <> ''),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, r) AS (
  SELECT node, node FROM (SELECT node FROM own WHERE node IS NOT NULL UNION SELECT b FROM links) n
  UNION SELECT reach.node, b FROM reach JOIN both_ways ON reach.r = a),
roots AS (SELECT node, min(r) AS alias_of FROM reach GROUP BY node),
named AS (SELECT node, own FROM own UNION ALL SELECT b, own FROM links),
classes AS (SELECT alias_of, min(own) AS class_verdict FROM named JOIN roots USING (node) WHERE own IS NOT NULL GROUP BY alias_of)
SELECT page_id, host, path, rule, coalesce(own, class_verdict, 'allow') AS verdict, alias_of
FROM own LEFT JOIN roots USING (node) LEFT JOIN classes USING (alias_of)
"""
