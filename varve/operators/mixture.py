"""Gaussian mixtures of whole series by expectation maximisation, one aggregate a round.

A model is a row for each series. A round joins the values to the models that still move and
sums what the next model needs, so values are summed on their own tasks first, a long series is
spread over all of them, and only a row a series and task is shuffled. Models that have
converged take no part in later rounds. Rounds are run until none is left, so asking for a fit
runs jobs; the models between them are written stages.

Defined results: null values take no part; a series without values has no model, nor has one
with under k values or without two different ones; values of equal i stand in the order of
their size; rows with a null key have no model; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.operators.smooth import KEY
from varve.stages import stage

#: Rounds in one plan, between written stages.
UNROLLED = 4
MAX_ROUNDS = 500


def _names(k: int) -> list[str]:
    return [f"{c}{j}" for c in "mvs" for j in range(1, k + 1)]


def values(rows: DataFrame, column: str = "peak", keys=KEY) -> DataFrame:
    """keys, i, x: the values to fit. Every round reads rows, so they are a written stage."""
    return rows.select(*keys, "i", F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")


def start(x: DataFrame, k: int, keys=KEY) -> DataFrame:
    """The first models: means from evenly spaced places in order of i, the variance of all
    values, equal shares."""
    n = x.groupBy(*keys).agg(F.count("x").alias("n"), F.var_pop("x").alias("spread"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    n = n.where((F.col("n") >= max(2, k)) & (F.col("lo") < F.col("hi")))
    at = x.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("i", "x")) - 1).join(n, list(keys))
    place = lambda j: F.floor(F.lit(j) * (F.col("n") - 1) / (k - 1)) if k > 1 else F.lit(0)
    at = at.groupBy(*keys).agg(F.first("n").alias("n"), F.first("spread").alias("spread"), *[F.max(F.when(F.col("at") == place(j), F.col("x"))).alias(f"m{j + 1}") for j in range(k)])
    floor_ = F.col("spread") / 1e5
    return _moving(at.select(*keys, "n", floor_.alias("least"), *[f"m{j + 1}" for j in range(k)], *[(F.col("spread") + floor_).alias(f"v{j + 1}") for j in range(k)], *[F.lit(1 / k).alias(f"s{j + 1}") for j in range(k)]))


def _moving(models: DataFrame) -> DataFrame:
    """Models before their first round."""
    return models.withColumns({"loglik": F.lit(None).cast("double"), "round": F.lit(0), "state": F.lit("moves")})


def _round(x: DataFrame, models: DataFrame, k: int, keys, max_rounds: int) -> DataFrame:
    """The sums give a model's likelihood and its successor at once. A model whose likelihood
    gained at most 0.03 ln n over its predecessor's stays as it is: it has converged."""
    each = lambda text: [text.replace("#", str(j)) for j in range(1, k + 1)]
    y = x.join(models, list(keys))
    # Each projection is one of its own, so that no expression is written out again in the next.
    for step in (
        each("-0.5D * (x - m#) * (x - m#) / v# - 0.5D * (ln(2 * pi()) + ln(v#)) AS l#"),
        ["greatest(" + ", ".join(each("l#")) + ") AS top" if k > 1 else "l1 AS top"],
        each("exp(l# - top) * s# AS p#"),
        [" + ".join(each("p#")) + " AS p"],
        each("p# / p AS r#") + each("x - m# AS o#"),
    ):
        y = y.selectExpr("*", *step)
    held = [f"first({c}) AS {c}" for c in ("n", "least", *_names(k), "loglik", "round", "state")]
    sums = ["sum(ln(p) + top) AS now"] + each("sum(r#) AS w#") + each("sum(r# * o#) AS d#") + each("sum(r# * o# * o#) AS q#")
    y = y.groupBy(*keys).agg(*[F.expr(e) for e in held + sums])
    rests = f"coalesce(now - loglik <= 0.03D * ln(n), false) OR round >= {max_rounds}"
    lost = " OR ".join(each("w# <= 0"))
    y = y.selectExpr("*", f"CASE WHEN state <> 'moves' THEN state WHEN {rests} THEN 'rests' WHEN {lost} THEN 'failed' ELSE 'moves' END AS next", " + ".join(each("w#")) + " AS full", *each("try_divide(d#, w#) AS shift#"))
    # Variances about the mean before, so that nothing cancels.
    new = each("m# + shift# AS m#") + each("greatest(try_divide(q#, w#) - shift# * shift#, 0D) + least AS v#") + each("w# / full AS s#")
    new = ["IF(next = 'moves', {0}, {1}) AS {1}".format(*e.split(" AS ")) for e in new]
    return y.selectExpr(*keys, "n", "least", *new, "IF(state = 'moves', now, loglik) AS loglik", "round + IF(next = 'moves', 1, 0) AS round", "next AS state")


def run(x: DataFrame, models: DataFrame, k: int, keys=KEY, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Models at rest: keys, n, least, m1.. v1.. s1.. (means, variances, shares), loglik, round,
    state (rests, or failed where a component lost all weight)."""
    models = stage(models, "mixture")
    while models.where("state = 'moves'").limit(1).count():
        live = models.where("state = 'moves'")
        for _ in range(UNROLLED):
            live = _round(x, live, k, keys, max_rounds)
        models = stage(models.where("state <> 'moves'").unionByName(live), "mixture")
    return models


def fitted(models: DataFrame, k: int, keys=KEY) -> DataFrame:
    """keys, n, k, mu, sigma, prop (arrays by rising mean), loglik, description (its length), rounds."""
    parts = F.array_sort(F.array(*[F.struct(F.col(f"m{j}").alias("mu"), F.lit(j).alias("j"), F.sqrt(f"v{j}").alias("sigma"), F.col(f"s{j}").alias("prop")) for j in range(1, k + 1)]))
    x = models.where("state = 'rests'").withColumn("parts", parts)
    length = -F.col("loglik") + 0.5 * (3 * k - 1) * F.ln("n")
    return x.select(*keys, "n", F.lit(k).alias("k"), "parts.mu", "parts.sigma", "parts.prop", "loglik", length.alias("description"), F.col("round").alias("rounds"))


def merge_closest(models: DataFrame, k: int, keys=KEY) -> DataFrame:
    """The models with their two closest components merged into the first of them: those whose
    values lose the least likelihood by having one normal in common."""
    c = lambda n, j: F.col(f"{n}{j}")

    def pair(a: int, b: int) -> Column:
        share = c("s", a) + c("s", b)
        w = c("s", a) / share
        mean = w * c("m", a) + (1 - w) * c("m", b)
        spread = w * (c("v", a) + (mean - c("m", a)) ** 2) + (1 - w) * (c("v", b) + (mean - c("m", b)) ** 2)
        far = 0.5 * F.col("n") * (share * F.ln(spread) - c("s", a) * F.ln(c("v", a)) - c("s", b) * F.ln(c("v", b)))
        return F.struct(far.alias("far"), F.lit(a).alias("a"), F.lit(b).alias("b"), mean.alias("m"), spread.alias("v"), share.alias("s"))

    x = models.where("state = 'rests'").withColumn("__p", F.array_min(F.array(*[pair(a, b) for a in range(1, k + 1) for b in range(a + 1, k + 1)])))
    new = [F.when(F.col("__p.a") == j, F.col(f"__p.{n}")).when(F.col("__p.b") > j, c(n, j)).otherwise(c(n, j + 1)).alias(f"{n}{j}") for n in "mvs" for j in range(1, k)]
    return _moving(x.select(*keys, "n", "least", *new))


def fit(x: DataFrame, k: int = 2, keys=KEY, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """fitted() of k components from the first models. x: as values() has it."""
    return fitted(run(x, start(x, k, keys), k, keys, max_rounds), k, keys)


def reduced(x: DataFrame, k: int = 3, final_k: int = 0, keys=KEY, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """fitted() with the order chosen: from k components down, the closest two are merged and the
    rounds go on from there. The order of least description length stays, of equal ones the
    highest; or final_k, where it is given. One set of jobs an order, for all series."""
    models, fits = run(x, start(x, k, keys), k, keys, max_rounds), []
    for m in range(k, max(final_k, 1) - 1, -1):
        if m < k:
            models = run(x, merge_closest(models, m + 1, keys), m, keys, max_rounds)
        if final_k in (0, m):
            fits.append(fitted(models, m, keys))
    if len(fits) == 1:
        return fits[0]
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("description", F.desc("k")))
    return reduce(lambda a, b: a.unionByName(b), fits).withColumn("__b", best).where("__b = 1").drop("__b")


def classes(x: DataFrame, fits: DataFrame, keys=KEY) -> DataFrame:
    """keys, i, x, loglik (of the value under its series' mixture), class (from 1: the likeliest
    component by its density, shares counted)."""
    y = x.join(fits.select(*keys, "mu", "sigma", "prop"), list(keys))
    parts = F.transform("mu", lambda m, j: -0.5 * ((F.col("x") - m) / F.col("sigma")[j]) ** 2 - F.ln(F.col("sigma")[j]) - 0.5 * math.log(2 * math.pi) + F.ln(F.col("prop")[j]))
    y = y.withColumn("__l", parts).withColumn("__top", F.array_max("__l"))
    total = F.aggregate(F.transform("__l", lambda v: F.exp(v - F.col("__top"))), F.lit(0.0), lambda a, v: a + v)
    return y.select(*keys, "i", "x", (F.col("__top") + F.ln(total)).alias("loglik"), F.array_position("__l", F.col("__top")).cast("int").alias("class"))


def lower(x: DataFrame, merge: bool = False, keys=KEY, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """keys, mu, sigma, prop of the lower of two components. Where both have one mean: the lowest
    of three, or, with merge, of three that are merged to two; else the two stay."""
    two = fit(x, 2, keys, max_rounds)
    first = [F.col(c)[0].alias(c) for c in ("mu", "sigma", "prop")]
    same = F.col("mu")[0] == F.col("mu")[1]
    if not two.where(same).limit(1).count():
        return two.select(*keys, *first)
    again = stage(x.join(two.where(same).select(*keys), list(keys), "left_semi"), "mixture_values")
    other = reduced(again, 3, 2, keys, max_rounds) if merge else fit(again, 3, keys, max_rounds)
    kept = two.where(same).join(other.select(*keys), list(keys), "left_anti")
    return reduce(lambda a, b: a.unionByName(b), [d.select(*keys, *first) for d in (two.where(~same), other, kept)])
