"""URL rules and link-graph propagation over hosts, in DataFrame functions alone.

Rules first: the longest that fits decides. Other urls take their host's verdict: personalised PageRank of trust flows
along the host edges from hosts whose pages the rules allow, distrust flows against them from hosts whose pages the
rules block (who links to a bad host is suspect), and a host with more distrust than trust, by more than MARGIN
of it (sums of the same ranks can differ by their order), is blocked. Host edges are
distinct (source host, target host) pairs of absolute links in the pages, so a host with a third of all pages counts
once for each target; edges of one very popular host are left to adaptive skew joins.

Links without a scheme (``//host/``) count, relative ones lead to no host. A null url, or one without ``://``, has empty host and path, no rule fits it, and it is allowed. Null html has no links.
Repeated rows get a row each. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common
from curvelake.llm.lines import LOWER, UPPER

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS, MARGIN = 0.85, 12, 1e-9
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict)."""
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
    rows = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = None
    for word, host, path in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        hit = fits(host, path)
        rule = F.when(hit, F.lit(host + path)) if rule is None else rule.when(hit, F.lit(host + path))
        verdict = F.when(hit, F.lit(word)) if verdict is None else verdict.when(hit, F.lit(word))
    return rows.withColumns({"rule": rule, "ruled": verdict})


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, rank: personalised PageRank. ``edges``: u, v; ``seeds``: host, seed. What a host without edges would pass
    on goes back to the seeds' share, so ranks stay below one."""
    out = edges.withColumn("w", F.lit(1.0))
    degree = out.groupBy("u").agg(F.sum("w").alias("d"))
    out = common.materialize(out.join(degree, "u").select("u", "v", (F.lit(1.0) / F.col("d")).alias("w")), "host-edges")
    ranks = seeds.select("host", F.col("seed").alias("rank"))
    for i in range(ROUNDS):
        flow = out.join(ranks, out["u"] == ranks["host"]).groupBy("v").agg(F.sum(F.col("w") * F.col("rank")).alias("flow"))
        both = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("r")).union(flow.select("v", F.col("flow") * DAMPING))
        ranks = both.groupBy("host").agg(F.sum("r").alias("rank"))
        if i % 4 == 3:
            ranks = common.materialize(ranks, "ranks")
    return ranks


def url_verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rows = judged(pages.select("page_id", "url", "html"))
    count = lambda word: F.count(F.when(F.col("ruled") == word, 1)).cast("double")
    hosts = common.materialize(rows.where("host <> ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad")), "hosts")
    links = rows.where("host <> ''").select(F.col("host").alias("u"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))).alias("to"))
    edges = common.materialize(links.select("u", host_of(F.concat(F.when(F.col("to").startswith("//"), "x:").otherwise(""), "to")).alias("v")).where("v <> '' and u <> v").distinct(), "edges")
    total = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    good = hosts.where("good > 0").select("host", (F.col("good") / (total["g"] or 1.0)).alias("seed"))
    bad = hosts.where("bad > 0").select("host", (F.col("bad") / (total["b"] or 1.0)).alias("seed"))
    trust, distrust = propagate(edges, good), propagate(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), bad)
    sides = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "rank"))
    verdicts = sides.groupBy("host").agg((F.sum("distrust") > F.sum("trust") * (1 + MARGIN)).alias("suspect")).where("suspect").select(F.col("host").alias("h"), "suspect")
    out = rows.select("page_id", "host", "path", "rule", "ruled").join(verdicts, F.col("host") == F.col("h"), "left")
    own = F.when(F.col("suspect"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"))


def oracle() -> str:
    """The same in DuckDB: one CTE for each round of each propagation."""
    host = lambda url: f"translate(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    hits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, w) for w, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    case = lambda i: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[i]}'" for x in hits) + " END"
    link = LINK.replace("'", "''")
    sql = f"""WITH p AS (SELECT page_id, html, coalesce({host('url')}, '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM p),
h AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow')::DOUBLE AS good, count(*) FILTER (WHERE ruled = 'block')::DOUBLE AS bad FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT DISTINCT host AS u, {host("(CASE WHEN starts_with(t.x, '//') THEN 'x:' || t.x ELSE t.x END)")} AS v FROM j, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS t(x) WHERE host <> ''),
e AS (SELECT * FROM l WHERE v <> '' AND u <> v)"""
    for side, u, v, seed in (("t", "u", "v", "good"), ("d", "v", "u", "bad")):
        sql += f""",
{side}s AS (SELECT host, {seed} / (SELECT sum({seed}) FROM h) AS seed FROM h WHERE {seed} > 0),
{side}e AS (SELECT {u} AS u, {v} AS v, 1.0::DOUBLE / count(*) OVER (PARTITION BY {u}) AS w FROM e),
{side}0 AS (SELECT host, seed AS rank FROM {side}s)"""
        for i in range(1, ROUNDS + 1):
            sql += f""",
{side}{i} AS MATERIALIZED (SELECT host, sum(r) AS rank FROM (SELECT host, seed * (1 - {DAMPING}::DOUBLE) AS r FROM {side}s
  UNION ALL SELECT {side}e.v, sum({side}e.w * k.rank) * {DAMPING}::DOUBLE FROM {side}e JOIN {side}{i - 1} k ON {side}e.u = k.host GROUP BY {side}e.v) GROUP BY host)"""
    return (
        sql
        + f"""
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN coalesce(d.rank, 0) > coalesce(t.rank, 0) * (1 + {MARGIN}) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t{ROUNDS} t ON j.host = t.host LEFT JOIN d{ROUNDS} d ON j.host = d.host"""
    )
