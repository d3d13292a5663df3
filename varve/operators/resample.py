"""Bootstraps as data: resamples are rows, their draws counted hashes.

Draw number k of resample b of a group is the first 32 bits of the MD5 of the group's name,
b and k: so a resample does not depend on where or when it is made, and SQL can repeat it.
A group's values are one array: the intervals of one window or zone of one series, a few
hundred at most. Everything else is rows: one for each group and resample.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.025, 0.975
#: Newton steps of the Weibull fit; half of them are enough for the last digit.
STEPS = 40


def gathered(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The key columns, values (ascending array), n and mean of each group, and par if there."""
    par = [F.first("par").alias("par")] if "par" in df.columns else []
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias("values"), F.count(value).alias("n"), F.avg(value).alias("mean"), *par)


def resamples(groups: DataFrame, key: list[str], times: int) -> DataFrame:
    """groups (key, values, n) once for each resample: the key, draw (1..times), picks."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    x = groups.select(*key, "values", "n", name.alias("__name"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("draw"))

    def pick(k: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", "__name", F.col("draw").cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long")
        return F.element_at("values", (F.floor(bits * F.col("n") / F.lit(2**32)) + 1).cast("int"))

    return x.select(*key, "draw", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), pick).alias("picks"))


def mean_of(a: str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def limits(draws: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The key and <column>_lo, <column>_hi: percentiles of the resamples, nulls left out."""
    cut = lambda c, q: F.percentile(c, F.lit(q))
    return draws.groupBy(*key).agg(*[cut(c, q).alias(f"{c}_{end}") for c in columns for end, q in (("lo", LOW), ("hi", HIGH))])


def binned(a: str, width: float = 20.0, top: float = 1000.0) -> Column:
    """Counts of the values in [width, 2 width) .. [top - width, top)."""
    return F.transform(F.sequence(F.lit(1), F.lit(int(top / width) - 1)), lambda b: F.size(F.filter(a, lambda v: (v >= b * width) & (v < (b + 1) * width))))


def with_weibull(df: DataFrame, freq: str, b: str, c: str, width: float = 20.0) -> DataFrame:
    """Adds scale b and shape c of the Weibull distribution fitted to bin centres by their
    counts (binned()): Newton steps on the shape's profile likelihood, as a fold over the
    bins within a fold over the steps. Null with fewer than two bins in use."""
    centre = lambda k: (k + 1.5) * width
    occupied = F.filter(F.transform(freq, lambda f, k: F.struct(f.cast("double").alias("f"), centre(k).alias("x"))), lambda r: r["f"] > 0)
    df = df.withColumn("__bins", F.when(F.size(F.filter(freq, lambda f: f > 0)) > 1, occupied))
    zero = lambda names: F.struct(*[F.lit(0.0).alias(n) for n in names])
    top = F.col("__bins")[F.size("__bins") - 1]["x"]
    moments = F.aggregate("__bins", zero(("n", "s", "ss", "l")), lambda a, r: F.struct((a["n"] + r["f"]).alias("n"), (a["s"] + r["f"] * r["x"]).alias("s"), (a["ss"] + r["f"] * r["x"] * r["x"]).alias("ss"), (a["l"] + r["f"] * F.ln(r["x"])).alias("l")))
    df = df.withColumns({"__m": moments, "__top": top})
    n = F.col("__m.n")
    df = df.withColumns({"__l": F.transform("__bins", lambda r: F.struct(r["f"].alias("f"), F.ln(r["x"] / F.col("__top")).alias("l"))), "__mean_l": F.col("__m.l") / n - F.ln("__top")})
    mean = F.col("__m.s") / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("__m.ss") - n * mean * mean, n - 1)))
    df = df.withColumn("__c0", F.greatest(F.lit(0.1), F.pow(mean / F.greatest(spread, F.lit(1e-6)), F.lit(1.086))))

    def step(at: Column, _: Column) -> Column:
        def add(a: Column, r: Column) -> Column:
            w = r["f"] * F.exp(at * r["l"])
            return F.struct((a["s0"] + w).alias("s0"), (a["s1"] + w * r["l"]).alias("s1"), (a["s2"] + w * r["l"] * r["l"]).alias("s2"))

        def finish(s: Column) -> Column:
            slope = s["s1"] / s["s0"] - 1 / at - F.col("__mean_l")
            new = at - slope / ((s["s2"] * s["s0"] - s["s1"] * s["s1"]) / (s["s0"] * s["s0"]) + 1 / (at * at))
            return F.when(new > 0, new).otherwise(at / 2)

        return F.aggregate("__l", zero(("s0", "s1", "s2")), add, finish)

    df = df.withColumn(c, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("__c0"), step))
    df = df.withColumn(c, F.when(F.col("__bins").isNotNull(), F.col(c)))
    power = F.aggregate("__l", F.lit(0.0), lambda a, r: a + r["f"] * F.exp(F.col(c) * r["l"]))
    return df.withColumn(b, F.col("__top") * F.pow(power / n, 1 / F.col(c))).drop("__bins", "__m", "__top", "__l", "__mean_l", "__c0")


def ks_tail(x: Column) -> Column:
    """Kolmogorov's limit distribution beyond x, by the series that converges there."""
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    low = 1 - math.sqrt(2 * math.pi) / x * total(F.exp(-((2 * k - 1) ** 2 * math.pi**2) / (8 * x * x)) for k in range(1, 8))
    high = 2 * total((1 if k % 2 else -1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 8))
    return F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x < 1, low).otherwise(high))))


def ks_weibull(values: str, n: str, b: str, c: str, width: float = 20.0) -> Column:
    """p-value of ascending values against the Weibull distribution, whose cumulative share
    is read between multiples of width by straight lines: the limit distribution's."""
    share = lambda edge: 1 - F.exp(-F.pow(edge / F.col(b), F.col(c)))

    def gap(v: Column, k: Column) -> Column:
        low = F.floor(v / width) * width
        at = share(low) + (share(low + width) - share(low)) * (v - low) / width
        return F.greatest((k + 1) / F.col(n) - at, at - k / F.col(n))

    return ks_tail(F.sqrt(F.col(n)) * F.array_max(F.transform(values, gap)))
