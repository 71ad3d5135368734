"""Queries of paired evaluation, distributions and router analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import router as R
from siftline.operators import stats as S
from siftline.session import table

EVENT = {"reward": "CASE WHEN value < 5 THEN -1 ELSE round(value / 100, 6) END", "finish": "CASE WHEN event_type = 'error' THEN 'length' ELSE 'stop' END"}


def _rollouts(spark, sf):
    """Events stand in for rollouts: the user is the prompt, the value the reward, k the length."""
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.when(F.col("value") < 5, -1.0).otherwise(F.round(F.col("value") / 100, 6)).alias("reward"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("event_type") == "error", "length").otherwise("stop").alias("finish"),
    )


def _pairs(spark, sf):
    labels = table(spark, sf, "labels")
    return S.paired(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", (1 - F.col("toxic")).alias("v")), "doc_id", "v")


def paired_mcnemar(spark, sf):
    return S.paired_counts(_pairs(spark, sf))


def paired_by_lang(spark, sf):
    """The paired report for each benchmark, here the language."""
    return S.paired_counts(_pairs(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"), ["lang"])


def noninferiority(spark, sf):
    """Exact test and bounds."""
    return S.with_tests(paired_by_lang(spark, sf).select("lang", "n", "n10", "n01"), 0.05)


def describe(spark, sf):
    return S.describe(table(spark, sf, "documents").select("lang", F.length("text").alias("v")), "v", ["lang"])


def type7_percentile(spark, sf):
    """A13, A14."""
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("n"), p.alias("p")).select("event_type", "n", *(F.round(F.col("p")[i], 9).alias(c) for i, c in enumerate(("p10", "p50", "p90"))))


def index_percentile(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.length("text").alias("v"))
    return S.index_percentile(docs, "v", (0.5, 0.9, 0.95, 0.99), ["lang"])


def think_headroom(spark, sf):
    return S.think_headroom(_rollouts(spark, sf), "user_id", "tokens", F.col("reward") > 0.1)


def consistency_metrics(spark, sf):
    return S.consistency(_rollouts(spark, sf), ["user_id"], "reward", "tokens", "finish")


def consistency_arms(spark, sf):
    """Arm averages of the prompt metrics, nulls left out."""
    c = S.consistency(_rollouts(spark, sf), ["finish", "user_id"], "reward", "tokens", "finish")
    names = ("reward_std", "passk_gap", "len_cv", "valid_frac", "success_frac", "valid_repro")
    return c.groupBy("finish").agg(F.count("*").alias("prompts"), *(F.round(F.avg(n), 4).alias(n) for n in names))


def group_advantage_std(spark, sf):
    return S.advantages(_rollouts(spark, sf).select("event_id", "user_id", "reward"), "user_id", "reward")


def group_advantage_mean(spark, sf):
    return S.advantages(_rollouts(spark, sf).select("event_id", "user_id", "reward"), "user_id", "reward", "mean")


def agreement(spark, sf):
    return S.agreement(_rollouts(spark, sf), "user_id", F.col("reward") > 0.1)


def tier_summary(spark, sf):
    """Rates for each tier and overall."""
    ok = F.col("reward") > 0.1
    return _rollouts(spark, sf).rollup("event_type").agg(F.countDistinct("user_id").alias("seeds"), F.count("*").alias("rollouts"), F.count_if(ok).alias("adopted"), F.round(F.try_divide(F.count_if(ok), F.count("*")), 6).alias("rate"))


def weighted_nll(spark, sf):
    """Ratio of sums for each domain and overall."""
    r = _rollouts(spark, sf)
    return r.rollup("event_type").agg(F.round(F.sum("value") / F.sum("tokens"), 6).alias("nll"), F.sum("tokens").alias("n_tok"))


def benchmark_aggregate(spark, sf):
    """A4, A5: accuracy with normal interval, tokens, and throughput of the slowest worker."""
    r = _rollouts(spark, sf).withColumn("worker", F.pmod("user_id", F.lit(2)))
    per = r.groupBy("event_type", "worker").agg(F.count("*").alias("n"), F.count_if(F.col("reward") > 0.1).alias("ok"), F.sum("tokens").alias("tok"), F.sum("value").alias("t"))
    acc = F.sum("ok") / F.sum("n")
    se = F.sqrt(F.greatest(acc * (1 - acc), F.lit(0.0)) / F.sum("n"))
    return per.groupBy("event_type").agg(F.count("*").alias("workers"), F.sum("n").alias("n"), F.round(acc, 4).alias("acc"), F.round(1.96 * se, 4).alias("ci95"), F.round(F.sum("tok") / F.sum("t"), 4).alias("tok_s"), F.round(F.sum("tok") / F.max("t"), 4).alias("tok_s_parallel"))


def format_probe(spark, sf):
    """Each arm against the base arm on the same prompt: wins, ties, losses of the best reward."""
    best = _rollouts(spark, sf).groupBy("user_id", "event_type").agg(F.max("reward").alias("best"))
    base = best.where("event_type = 'click'").select("user_id", F.col("best").alias("base"))
    j = best.where("event_type != 'click'").join(base, "user_id")
    return j.groupBy("event_type").agg(F.count("*").alias("prompts"), F.count_if(F.col("best") > F.col("base")).alias("wins"), F.count_if(F.col("best") == F.col("base")).alias("ties"), F.count_if(F.col("best") < F.col("base")).alias("losses"), F.round(F.avg("best"), 6).alias("mean_best"))


def bootstrap_mean(spark, sf):
    """Cluster bootstrap of the mean reward over prompts."""
    r = _rollouts(spark, sf).withColumn("one", F.lit(1))
    return _rounded(S.poisson_bootstrap(r, "user_id", "reward", "one"))


def bootstrap_paired(spark, sf):
    """Paired bootstrap of the difference of two arms."""
    p = _pairs(spark, sf).select("doc_id", (F.col("b") - F.col("a")).alias("d"), F.lit(1).alias("one"))
    return _rounded(S.poisson_bootstrap(p, "doc_id", "d", "one"))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


def mcnemar_exact(spark, sf):
    """A6 for each language."""
    return S.with_tests(paired_by_lang(spark, sf).select("lang", "n", "n10", "n01"), 0.05).select("lang", "n10", "n01", F.round("mcnemar_p", 7).alias("p"))


def _top(spark, sf, k, tau=1.0):
    return R.top_k(table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x * 8).alias("logits")), "vec_id", "logits", k, tau)


def _w(df, name="v"):
    return df.select("vec_id", F.array_join(F.transform("top", lambda t: t.expert), ",").alias("experts"), *(F.round(F.col(name)[i], 5).alias(f"w{i + 1}") for i in (0, 3, 11)))


def softmax_topk(spark, sf):
    return _w(R.shaped(_top(spark, sf, 16), "temp", 1.0))


def router_temp(spark, sf):
    return _w(R.shaped(_top(spark, sf, 16, 0.5), "temp", 0.5))


def masscut(spark, sf):
    return _w(R.shaped(_top(spark, sf, 16), "masscut", 0.7))


def rankdamp(spark, sf):
    return _w(R.shaped(_top(spark, sf, 16), "rankdamp", 0.5))


def tail_scale(spark, sf):
    return _w(R.shaped(_top(spark, sf, 16), "tail_scale", 0.0))


def effective_k(spark, sf):
    return R.effective_k(_top(spark, sf, 32)).select("vec_id", "k_eff", F.round("mass_head", 5).alias("mass_head"), F.round("mass", 5).alias("mass"))


def router_entropy(spark, sf):
    """Mean entropy and mass of ranks 1-8 and 9-32 for each layer, here the label."""
    p = R.with_softmax(table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x * 8).alias("l")), "l", "p")
    o = p.select("label", R.entropy(F.col("p")).alias("h"), R.ranked(F.col("p")).value.alias("r"))
    return o.groupBy("label").agg(F.round(F.avg("h"), 5).alias("entropy"), F.round(F.avg(R.total(F.slice("r", 1, 8))), 5).alias("mass_1_8"), F.round(F.avg(R.total(F.slice("r", 9, 24))), 5).alias("mass_9_32"), F.count("*").alias("n"))


def _scores(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return R.expert_scores(_top(spark, sf, 8).join(e, "vec_id"), "label")


def expert_scores(spark, sf):
    return _scores(spark, sf).select("label", "expert", F.round("gate", 5).alias("gate"), F.round("token", 6).alias("token"))


def topp_select(spark, sf):
    return R.top_p(_scores(spark, sf), "label", "token", 0.2).select("label", F.array_join("experts", ",").alias("experts"))


def jaccard_overlap(spark, sf):
    return R.overlap(R.top_p(_scores(spark, sf), "label", "token", 0.2), "label")


ROLL = f"r AS (SELECT event_id, user_id, event_type, value, {EVENT['reward']}::DOUBLE AS reward, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, {EVENT['finish']} AS finish FROM events)"
PAIR = "p AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b FROM labels)"


def _paired_sql(source: str, by: str = "") -> str:
    c = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    se = "sqrt(greatest(n10 + n01 - (n01 - n10) * (n01 - n10) / n, 0.0)) / n"
    d = "(correct_b - correct_a) / n"
    cols = ", ".join(f"round({d} {s} {z} * {se}, 4) AS {a}" for s, z, a in (("-", 1.96, "low95"), ("+", 1.96, "high95"), ("-", 1.6448536269514722, "low_one_sided"), ("+", 1.6448536269514722, "high_one_sided")))
    return f"SELECT {c}n, correct_a, correct_b, n10, n01, round(correct_a / n, 4) AS acc_a, round(correct_b / n, 4) AS acc_b, round({d}, 4) AS delta, {cols} FROM (SELECT {c}count(*) AS n, count(*) FILTER (a) AS correct_a, count(*) FILTER (b) AS correct_b, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01 FROM {source}{g})"


def _cons(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(stddev_samp(reward), 6) AS reward_std, round(max(reward) - avg(reward), 6) AS passk_gap,
round(stddev_samp(CASE WHEN tokens > 0 THEN tokens END) / nullif(avg(CASE WHEN tokens > 0 THEN tokens END), 0), 6) AS len_cv, round(avg((reward > -1)::INT), 6) AS valid_frac,
round(CASE WHEN max(reward) > 0.5 THEN avg((reward > 0.5)::INT) END, 6) AS success_frac, round(CASE WHEN max(reward) > -1 THEN avg((reward > -1)::INT) END, 6) AS valid_repro,
round(avg((finish = 'length')::INT), 6) AS trunc_frac FROM r GROUP BY {by}"""


def _adv(expr: str) -> str:
    return f"WITH {ROLL}, g AS (SELECT user_id, avg(reward) AS m, stddev_pop(reward) AS sd FROM r GROUP BY user_id) SELECT event_id, r.user_id, reward, round(CASE WHEN sd = 0 THEN 0 ELSE {expr} END + 1e-10, 6) AS advantage, sd = 0 AS skipped FROM r JOIN g USING (user_id)"


def _soft(tau: float = 1.0) -> str:
    return f"""l AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS expert, unnest(embedding)::FLOAT * 8::FLOAT AS x FROM embeddings),
e AS (SELECT *, exp((x::DOUBLE - max(x) OVER (PARTITION BY vec_id)) / {tau}) AS ex FROM l),
p AS (SELECT vec_id, label, expert, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rk FROM p)"""


def _weights(k: int, shape: str, tau: float = 1.0) -> str:
    return f"""WITH {_soft(tau)}, t AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS w FROM k WHERE rk <= {k}),
c AS (SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY rk) - w AS before FROM t), v AS (SELECT *, {shape} AS s FROM c),
n AS (SELECT *, s / sum(s) OVER (PARTITION BY vec_id) AS v FROM v)
SELECT vec_id, string_agg(expert::VARCHAR, ',' ORDER BY rk) AS experts, round(max(v) FILTER (rk = 1), 5) AS w1, round(max(v) FILTER (rk = 4), 5) AS w4, round(max(v) FILTER (rk = 12), 5) AS w12 FROM n GROUP BY vec_id"""


SCORES = f"WITH {_soft()}, t AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS w FROM k WHERE rk <= 8), n AS (SELECT label, count(DISTINCT vec_id) AS n FROM t GROUP BY label), s AS (SELECT t.label, expert, sum(w) / any_value(n.n) AS gate, sum(1 / 8) / any_value(n.n) AS token FROM t JOIN n USING (label) GROUP BY t.label, expert)"
TOPP = f"{SCORES}, c AS (SELECT *, sum(token) OVER (PARTITION BY label ORDER BY token DESC, expert) - token AS before FROM s), x AS (SELECT label, list(expert ORDER BY expert) AS experts FROM c WHERE before < 0.2 - 1e-12 GROUP BY label)"

ORACLES = {
    "paired_mcnemar": f"WITH {PAIR} {_paired_sql('p')}",
    "paired_by_lang": f"WITH {PAIR}, q AS (SELECT p.*, lang FROM p JOIN documents USING (doc_id)) {_paired_sql('q', 'lang')}",
    "describe": "SELECT lang, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, min(v) AS min, max(v) AS max FROM (SELECT lang, length(text) AS v FROM documents) GROUP BY lang",
    "type7_percentile": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.1), 9) AS p10, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY event_type",
    "index_percentile": "SELECT lang, len(o) AS n, " + ", ".join(f"o[1 + least(len(o) - 1, floor(len(o) * {p})::BIGINT)] AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM (SELECT lang, list(length(text) ORDER BY length(text)) AS o FROM documents GROUP BY lang)",
    "think_headroom": f"WITH {ROLL}, s AS (SELECT user_id, min(tokens) AS lo, max(tokens) AS hi, quantile_cont(tokens, 0.5) AS mid FROM r WHERE reward > 0.1 GROUP BY user_id HAVING count(*) >= 2), f AS (SELECT count(*) AS eligible, round(quantile_cont(CASE WHEN hi = 0 THEN 1.0::DOUBLE ELSE lo / hi END, 0.5), 6) AS p50_ratio, count(*) FILTER (lo < mid * 0.5) AS pruneable FROM s), t AS (SELECT count(*) AS rollouts, count(*) FILTER (reward > 0.1) AS passes FROM r) SELECT *, round(passes / rollouts, 6) AS pass_rate, round(pruneable / nullif(eligible, 0), 6) AS prune_rate FROM t, f",
    "consistency_metrics": f"WITH {ROLL} {_cons('user_id')}",
    "consistency_arms": f"WITH {ROLL}, c AS ({_cons('finish, user_id')}) SELECT finish, count(*) AS prompts, " + ", ".join(f"round(avg({n}), 4) AS {n}" for n in ("reward_std", "passk_gap", "len_cv", "valid_frac", "success_frac", "valid_repro")) + " FROM c GROUP BY finish",
    "group_advantage_std": _adv("(reward - m) / (sd + 1e-6)"),
    "group_advantage_mean": _adv("reward - m"),
    "agreement": f"WITH {ROLL}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (reward > 0.1) AS p FROM r GROUP BY user_id) SELECT *, round((p * (p - 1) + (n - p) * (n - p - 1)) / nullif(n * (n - 1), 0), 6) AS agreement FROM g",
    "tier_summary": f"WITH {ROLL} SELECT event_type, count(DISTINCT user_id) AS seeds, count(*) AS rollouts, count(*) FILTER (reward > 0.1) AS adopted, round(count(*) FILTER (reward > 0.1) / count(*), 6) AS rate FROM r GROUP BY ROLLUP (event_type)",
    "weighted_nll": f"WITH {ROLL} SELECT event_type, round(sum(value) / sum(tokens), 6) AS nll, sum(tokens) AS n_tok FROM r GROUP BY ROLLUP (event_type)",
    "benchmark_aggregate": f"WITH {ROLL}, w AS (SELECT event_type, user_id % 2 AS worker, count(*) AS n, count(*) FILTER (reward > 0.1) AS ok, sum(tokens) AS tok, sum(value) AS t FROM r GROUP BY ALL) SELECT event_type, count(*) AS workers, sum(n) AS n, round(sum(ok) / sum(n), 4) AS acc, round(1.96 * sqrt(greatest(sum(ok) / sum(n) * (1 - sum(ok) / sum(n)), 0) / sum(n)), 4) AS ci95, round(sum(tok) / sum(t), 4) AS tok_s, round(sum(tok) / max(t), 4) AS tok_s_parallel FROM w GROUP BY event_type",
    "format_probe": f"WITH {ROLL}, b AS (SELECT user_id, event_type, max(reward) AS best FROM r GROUP BY ALL) SELECT x.event_type, count(*) AS prompts, count(*) FILTER (x.best > y.best) AS wins, count(*) FILTER (x.best = y.best) AS ties, count(*) FILTER (x.best < y.best) AS losses, round(avg(x.best), 6) AS mean_best FROM b x JOIN b y ON x.user_id = y.user_id AND y.event_type = 'click' WHERE x.event_type <> 'click' GROUP BY x.event_type",
    "softmax_topk": _weights(16, "w"),
    "router_temp": _weights(16, "w", 0.5),
    "masscut": _weights(16, "CASE WHEN before < 0.7 THEN w ELSE 0 END"),
    "rankdamp": _weights(16, "CASE WHEN rk > 8 THEN w * 0.5 ELSE w END"),
    "tail_scale": _weights(16, "CASE WHEN rk > 8 THEN 0 ELSE w END"),
    "effective_k": f"WITH {_soft()}, t AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY rk) AS run, sum(p) OVER (PARTITION BY vec_id) AS mass FROM k WHERE rk <= 32) SELECT vec_id, count(*) FILTER (run < mass * 0.95) + 1 AS k_eff, round(max(run) FILTER (rk = 8), 5) AS mass_head, round(max(mass), 5) AS mass FROM t GROUP BY vec_id",
    "router_entropy": f"WITH {_soft()}, v AS (SELECT vec_id, label, -sum(p * ln(greatest(p, 1e-9))) AS h, sum(p) FILTER (rk <= 8) AS a, sum(p) FILTER (rk > 8 AND rk <= 32) AS b FROM k GROUP BY ALL) SELECT label, round(avg(h), 5) AS entropy, round(avg(a), 5) AS mass_1_8, round(avg(b), 5) AS mass_9_32, count(*) AS n FROM v GROUP BY label",
    "expert_scores": f"{SCORES} SELECT label, expert, round(gate, 5) AS gate, round(token, 6) AS token FROM s",
    "topp_select": f"{TOPP} SELECT label, array_to_string(experts, ',') AS experts FROM x",
    "jaccard_overlap": f"{TOPP} SELECT a.label AS a, b.label AS b, round(len(list_intersect(a.experts, b.experts)) / len(list_distinct(list_concat(a.experts, b.experts))), 6) AS jaccard FROM x a JOIN x b ON a.label < b.label",
}


def _boot(keys: str) -> str:
    """The bootstrap over a (key, num, den) subquery, with the same draws."""
    draws = f"len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in S.POISSON)}], lambda x: x <= ('0x' || substr(md5('0:' || key || ':' || rep), 1, 12))::BIGINT / 281474976710656.0::DOUBLE))"
    return f"""WITH {ROLL}, k AS ({keys}), w AS (SELECT rep, num, den, {draws} AS w FROM k, (SELECT unnest(range(0, 1000)) AS rep)), m AS (SELECT rep, sum(w * num) / sum(w * den) AS m FROM w GROUP BY rep)
SELECT round((SELECT sum(num) / sum(den) FROM k), 6) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""


ORACLES |= {
    "bootstrap_mean": _boot("SELECT user_id AS key, sum(reward) AS num, count(*) AS den FROM r GROUP BY user_id"),
    "bootstrap_paired": _boot("SELECT doc_id AS key, ((1 - toxic) - quality)::DOUBLE AS num, 1 AS den FROM labels"),
    "mcnemar_exact": """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS n10, count(*) FILTER (quality <> 1 AND toxic <> 1) AS n01 FROM labels JOIN documents USING (doc_id) GROUP BY lang), i AS (SELECT *, n10 + n01 AS n, unnest(range(0, least(n10, n01) + 1)) AS i FROM c)
SELECT lang, n10, n01, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END, 7) AS p FROM i GROUP BY lang, n10, n01, n""",
}
ROWS_ONLY = ("noninferiority",)
QUERIES = {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}
