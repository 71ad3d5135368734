"""URL filters: prefix rules first, then trust and distrust spread over the host graph.

A rule fits its host and all subdomains if the url's path starts with the rule's path;
the longest fitting rule wins. Hosts with pages that rules allow are trusted seeds,
hosts with blocked pages are distrusted seeds, each weighted by its share of such
pages. Personalised PageRank carries trust along host edges (absolute links in the
html) and distrust against them, from the linked to the linking host. A host whose
distrust exceeds ``ratio`` times its trust is blocked; all others are allowed.

All state is one row per (host, direction); a round is one join on the source host and
one sum per target host, so hot hosts combine before the shuffle. Rounds go on until no
host's trust or distrust changes by more than ``TOLERANCE`` of itself, so mass reaches
hosts at any distance from the seeds; there is no cap. What is left of the sums, and their
last bits, ``CLOSE`` keeps from deciding, as a share of the host's own trust and distrust.
``ROUNDS`` and ``MARGIN`` are those of the SQL, which stops earlier.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed. Null html has no links. Without pages or edges the result follows
from the seeds alone. Repeated pages count again; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialize, narrow, release

DAMPING, ROUNDS, RATIO, MARGIN = 0.85, 10, 1.0, 1e-12
#: Rounds between two checkpoints, whose states are compared.
TOLERANCE, CLOSE, STRIDE = 1e-9, 1e-7, 3
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest of ``(verdict, "host/path")`` rules that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones wrap shorter ones
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, from (host, html)."""
    links = F.regexp_extract_all("html", F.lit(LINK), 1)
    out = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    out = out.select("src", F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("dst"))
    return out.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of converged personalised PageRank from (host, trust, distrust) seeds.

    Mass of hosts without an edge in a direction leaves the graph.
    """
    seeds = materialize(seeds.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("s")),
        F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("s")),
    )).alias("x")).select("host", "x.kind", "x.s").where("s > 0"))
    ahead = edges.select("src", "dst", "n", F.lit("trust").alias("kind"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind"))
    both = ahead.unionByName(back)
    out = both.groupBy("src", "kind").agg(F.sum("n").alias("total"))
    both = materialize(both.join(out, ["src", "kind"]).select("src", "dst", "kind", (F.col("n") / F.col("total")).alias("w")))
    state = seeds
    if not both.isEmpty():
        own = seeds.select("host", "kind", (F.col("s") * (1 - damping)).alias("s"))
        while True:
            before = state
            for _ in range(STRIDE):
                moved = both.join(state.withColumnRenamed("host", "src"), ["src", "kind"])
                moved = moved.select(F.col("dst").alias("host"), "kind", (F.col("w") * F.col("s") * damping).alias("s"))
                state = moved.unionByName(own).groupBy("host", "kind").agg(F.sum("s").alias("s"))
            state = materialize(state)
            # a host that is reached or left is a change, however small its mass
            both_states = state.join(before.withColumnRenamed("s", "old"), ["host", "kind"], "full")
            s, old = F.coalesce("s", F.lit(0.0)), F.coalesce("old", F.lit(0.0))
            done = both_states.where(F.abs(s - old) > s * tolerance).isEmpty()
            if before is not seeds:
                release(edges.sparkSession, before)
            if done:
                break
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("s"))), F.lit(0.0)).alias(kind)
    return state.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of every page."""
    rows = narrow(pages, key=key, url=url, html=html)
    rows = rows.select("key", "html", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    count = rows.where("host != ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    seeds = materialize(count.where("good > 0 or bad > 0"))
    good, bad = seeds.agg(F.sum("good"), F.sum("bad")).first()  # two numbers
    share = lambda part, whole: F.col(part) / float(whole) if whole else F.lit(0.0)
    seeds = seeds.select("host", share("good", good).alias("trust"), share("bad", bad).alias("distrust"))
    scores = spread(host_edges(rows), seeds)
    out = rows.drop("html").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_method = F.when(F.col("distrust") - F.col("trust") * ratio > (F.col("trust") + F.col("distrust")) * CLOSE, "block").otherwise("allow")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "trust", "distrust")


def oracle(rules: list[tuple[str, str]], rounds: int = ROUNDS, damping: float = DAMPING, ratio: float = RATIO) -> str:
    """DuckDB SQL for (page_id, host, path, rule, verdict)."""
    link = LINK.replace("(?i)", "").replace("'", "''")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def case(value) -> str:
        whens = []
        for what, text in ordered:
            at, slash, rest = text.partition("/")
            whens.append(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash}{rest}') THEN '{value(what, text)}'")
        return "CASE " + " ".join(whens) + " END"

    steps = ["s0 AS (SELECT * FROM seeds)"]
    for i in range(rounds):
        steps.append(
            f"s{i + 1} AS (SELECT host, kind, sum(s) AS s FROM (SELECT e.dst AS host, e.kind, e.w * s.s * {damping} AS s FROM flows e JOIN s{i} s ON s.host = e.src AND s.kind = e.kind "
            f"UNION ALL SELECT host, kind, s * {1 - damping!r} AS s FROM seeds) GROUP BY host, kind)"
        )
    return f"""
WITH cut AS (
  SELECT page_id, html, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
own AS (SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM cut),
ruled AS (SELECT *, {case(lambda what, text: text)} AS rule, {case(lambda what, text: what)} AS by_rule FROM own),
linked AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1, 'i')), '{upper}', '{lower}') AS dst FROM ruled WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM linked WHERE src <> dst GROUP BY src, dst),
both_ways AS (SELECT src, dst, 'trust' AS kind, n FROM edges UNION ALL SELECT dst, src, 'distrust', n FROM edges),
flows AS (SELECT src, dst, kind, n / sum(n) OVER (PARTITION BY src, kind) AS w FROM both_ways),
counted AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (
  SELECT host, 'trust' AS kind, good / sum(good) OVER () AS s FROM counted WHERE good > 0
  UNION ALL SELECT host, 'distrust', bad / sum(bad) OVER () FROM counted WHERE bad > 0),
{", ".join(steps)},
final AS (SELECT * FROM s{rounds} WHERE (SELECT count(*) FROM edges) > 0 UNION ALL SELECT * FROM seeds WHERE (SELECT count(*) FROM edges) = 0),
scores AS (
  SELECT host, coalesce(sum(s) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(s) FILTER (kind = 'distrust'), 0) AS distrust FROM final GROUP BY host)
SELECT page_id, r.host, path, rule,
       coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {ratio} + {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON s.host = r.host"""
