"""Router analytics (W5-W10, A34-A37) on arrays of logits: no shuffle until the final sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 8


def scaled(df: DataFrame, array: str, divisor: Column, out: str) -> DataFrame:
    """``array`` over ``divisor``, which is a column of its own and read twice, so that no
    projection is folded into the lambda and computed once an element."""
    d = df.withColumn("__d", divisor)
    return d.withColumn(out, F.transform(array, lambda x: F.when(F.col("__d") != 0, x / F.col("__d")).otherwise(F.lit(0.0)))).drop("__d")


def with_softmax(df: DataFrame, logits: str, out: str, tau: float = 1.0) -> DataFrame:
    d = df.withColumn("__top", F.array_max(logits).cast("double"))
    d = d.withColumn("__e", F.transform(logits, lambda x: F.when(F.col("__top").isNotNull(), F.exp((x.cast("double") - F.col("__top")) / tau))))
    return scaled(d, "__e", total(F.col("__e")), out).drop("__top", "__e")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def ranked(values: Column) -> Column:
    """(value, expert) descending, ties by expert."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.alias("expert")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct((-p.neg).alias("value"), p.expert.alias("expert")))


def top_k(df: DataFrame, token: str, logits: str, k: int, tau: float = 1.0) -> DataFrame:
    """(token, top: the k largest probabilities as (value, expert), mass: their sum)."""
    p = with_softmax(df, logits, "p", tau).select(token, "p")
    r = p.select(token, F.slice(ranked(F.col("p")), 1, k).alias("top"))
    return r.withColumn("mass", total(F.col("top.value")))


def shaped(df: DataFrame, variant: str, param: float) -> DataFrame:
    """The top list with weights after temp, masscut, rankdamp or tail_scale, renormalised.

    ``masscut`` keeps ranks whose mass before them is under the parameter; ``rankdamp`` and
    ``tail_scale`` scale ranks beyond the head.
    """
    base = scaled(df.withColumn("__v", F.col("top.value")), "__v", F.col("mass"), "w")
    if variant == "temp":
        return base.withColumn("v", F.col("w")).drop("w", "__v")
    if variant == "masscut":
        out = with_running(base, "w", "__c").withColumn("__v", F.zip_with("w", "__c", lambda x, c: F.when(c - x < param, x).otherwise(0.0)))
    elif variant in ("rankdamp", "tail_scale"):
        out = base.withColumn("__v", F.transform("w", lambda x, i: F.when(i >= HEAD, x * param).otherwise(x)))
    else:
        raise ValueError(f"unknown variant {variant}")
    floor = 1e-9 if variant == "tail_scale" else 0.0
    return scaled(out, "__v", F.greatest(total(F.col("__v")), F.lit(floor)), "v").drop("w", "__v", "__c")


def with_running(df: DataFrame, array: str, out: str) -> DataFrame:
    """Running sums of a short array (at most the ranks kept)."""
    return df.withColumn(out, F.transform(array, lambda x, i: total(F.slice(F.col(array), F.lit(1), i + 1))))


def effective_k(df: DataFrame, share: float = 0.95) -> DataFrame:
    """Ranks needed for ``share`` of the top mass, with the mass of the head and of all."""
    out = with_running(df.withColumn("__v", F.col("top.value")), "__v", "run").drop("__v")
    return out.withColumns({"k_eff": (F.size(F.filter("run", lambda c: c < F.col("mass") * share)) + 1).cast("long"), "mass_head": F.element_at("run", HEAD)}).drop("run")


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.ln(F.greatest(x, F.lit(1e-9))))


def expert_scores(df: DataFrame, layer: str) -> DataFrame:
    """(layer, expert, gate, token): mean renormalised weight and mean 1/k of routed tokens."""
    # outer: a plain explode infers a filter on the list, which would compute it once more, unfolded, at the scan
    rows = df.select(layer, F.col("mass"), F.size("top").alias("k"), F.explode_outer("top").alias("t"))
    n = df.groupBy(layer).agg(F.count("*").alias("tokens"))
    s = rows.groupBy(layer, F.col("t.expert").alias("expert")).agg(F.sum(F.col("t.value") / F.col("mass")).alias("g"), F.sum(1 / F.col("k")).alias("u"))
    return s.join(n, layer).select(layer, "expert", (F.col("g") / F.col("tokens")).alias("gate"), (F.col("u") / F.col("tokens")).alias("token"))


def top_p(scores: DataFrame, layer: str, score: str, p: float) -> DataFrame:
    """(layer, experts ascending): experts in descending score while the sum before them is under p.

    A layer has as many rows as experts, so its list is one bounded array.
    """
    arr = scores.groupBy(layer).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("neg"), F.col("expert")))).alias("o"))
    before = F.transform("o", lambda x, i: total(F.transform(F.slice(F.col("o"), F.lit(1), i), lambda y: -y.neg)))
    kept = F.filter(F.zip_with("o", before, lambda x, b: F.struct(x.expert.alias("e"), b.alias("b"))), lambda z: z.b < p)
    return arr.select(layer, F.array_sort(F.transform(kept, lambda z: z.e)).alias("experts"))


def jaccard(a: Column, b: Column) -> Column:
    """Both empty is 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(configs: DataFrame, layer: str) -> DataFrame:
    """Jaccard overlap of every two layers' expert lists (as many rows as layer pairs)."""
    a = configs.select(F.col(layer).alias("a"), F.col("experts").alias("ea"))
    b = configs.select(F.col(layer).alias("b"), F.col("experts").alias("eb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(jaccard(F.col("ea"), F.col("eb")), 6).alias("jaccard"))
