"""Rules that parameters and samples must meet, as a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.operators.pretreat import stretched
from varve.params import Params

RULES = {
    1: "at least six input columns", 2: "no missing ages", 3: "age_top must not decrease", 4: "at least two zone limits", 5: "zone limits must ascend",
    6: "yr_interp must not be negative", 7: "smoothing window must be shorter than the record", 8: "method must be 1 to 5", 9: "thresh_type must be 1 or 2",
    10: "thresh_method must be 1, 2 or 3", 11: "given thresholds need the global type", 12: "percentile thresholds must lie between 0 and 1", 13: "c_peak must be 1 or 2",
    14: "min_count_p must lie in 0 to 1", 15: "peak_freq_yr must be positive", 16: "equal ages in a row", 17: "missing sample at an end of the series",
    23: "one row for each site and run", 24: "a parameter file needs its sample file", 25: "a sample file needs its parameter file",
    21: "smoothing window under 5 % of the record", 22: "local window under 30 samples",
}
WARNINGS = {16, 21, 22}
#: The input columns; cm_bot has no rule of its own.
INPUT = {"cm_top", "cm_bot", "age_top", "age_bot", "vol", "cnt"}


def parameter_violations(p: Params) -> list[int]:
    z, v = p.zone_div, p.thresh_values
    span = z[-1] - z[0] if len(z) > 1 else 0.0
    broken = {
        4: len(z) < 2, 5: any(b <= a for a, b in zip(z, z[1:])), 6: p.yr_interp < 0, 7: len(z) > 1 and p.smooth_yr >= span, 8: p.method not in range(1, 6),
        9: p.thresh_type not in (1, 2), 10: p.thresh_method not in (1, 2, 3), 11: p.thresh_method == 1 and p.thresh_type == 2,
        12: p.thresh_method > 1 and not all(0 < x < 1 for x in v), 13: p.c_peak not in (1, 2), 14: not 0 <= p.min_count_p <= 1, 15: not p.peak_freq_yr > 0,
        21: len(z) > 1 and p.smooth_yr < 0.05 * span, 22: p.thresh_type == 2 and p.yr_interp > 0 and p.smooth_yr / p.yr_interp < 30,
    }
    return [k for k, bad in broken.items() if bad]


def sample_violations(raw: DataFrame) -> DataFrame:
    """site, rule_no, n_rows of rules 2, 3, 16 and 17 on the samples: one aggregate."""
    x = stretched(raw)
    x = x.withColumn("before", F.lag("age_top").over(Window.partitionBy("site", "__at").orderBy("sample_no")))
    no_age = F.col("age_top").isNull() | F.col("age_bot").isNull() | F.isnan("age_top") | F.isnan("age_bot")
    end = F.struct("age_top", F.coalesce(F.col("vol") <= 0, F.lit(True)).alias("gone"))
    # Within the stretches of a series, then between them: a first sample and the last one before.
    x = x.groupBy("site", "__at").agg(
        F.count_if(no_age).alias("r2"), F.count_if(F.col("age_top") < F.col("before")).alias("r3"), F.count_if(F.col("age_top") == F.col("before")).alias("r16"),
        F.count(F.lit(1)).alias("n"), F.min_by(end, "sample_no").alias("first"), F.max_by(end, "sample_no").alias("last"),
    )
    x = x.withColumn("before", F.lag("last").over(Window.partitionBy("site").orderBy("__at"))["age_top"])
    counts = x.groupBy("site").agg(
        F.sum("r2").alias("r2"), (F.sum("r3") + F.count_if(F.col("first.age_top") < F.col("before"))).alias("r3"), (F.sum("r16") + F.count_if(F.col("first.age_top") == F.col("before"))).alias("r16"),
        (F.min_by("first", "__at")["gone"].cast("long") + F.when(F.sum("n") > 1, F.max_by("last", "__at")["gone"].cast("long")).otherwise(0)).alias("r17"),
    )
    rows = F.array(*[F.struct(F.lit(k).alias("rule_no"), F.col(f"r{k}").alias("n_rows")) for k in (2, 3, 16, 17)])
    return counts.select("site", F.explode(rows).alias("r")).select("site", "r.*").where("n_rows > 0")


def violations(spark: SparkSession, raw: DataFrame, p: Params) -> DataFrame:
    """site (null: of the parameters), rule_no, n_rows, message, severity."""
    found = parameter_violations(p) + ([] if INPUT <= set(raw.columns) else [1])
    fixed = spark.createDataFrame([(None, k, 1) for k in found], "site string, rule_no int, n_rows long")
    names = F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v)])
    x = fixed.unionByName(sample_violations(raw))
    return x.select("site", "rule_no", "n_rows", names[F.col("rule_no")].alias("message"), F.when(F.col("rule_no").isin(*WARNINGS), "warning").otherwise("error").alias("severity"))


def table_violations(table: DataFrame) -> DataFrame:
    """site, run_id, rule_no, n_rows, message, severity: the rules on parameters for every row of
    a table of runs, as columns, and rule 23 on the table itself. Nulls break a rule."""
    z, v, n = F.col("zone_div"), F.col("thresh_values"), F.size("zone_div")
    span = F.element_at(z, -1) - F.element_at(z, 1)
    held = F.filter(z, lambda x: x.isNotNull())
    steps = F.zip_with(F.slice(z, 1, F.greatest(n - 1, F.lit(0))), F.slice(z, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b > a)
    two = F.size(held) > 1
    meets = {
        4: two, 5: F.forall(steps, lambda ok: ok), 6: F.coalesce(F.col("yr_interp"), F.lit(0.0)) >= 0, 7: ~two | (F.col("smooth_yr") < span), 8: F.col("method").between(1, 5),
        9: F.col("thresh_type").isin(1, 2), 10: F.col("thresh_method").isin(1, 2, 3), 11: ~((F.col("thresh_method") == 1) & (F.col("thresh_type") == 2)),
        12: (F.col("thresh_method") <= 1) | (F.forall(v, lambda x: x.isNotNull() & (x > 0) & (x < 1)) & (F.size(v) == 4)), 13: F.col("c_peak").isin(1, 2),
        14: F.col("min_count_p").between(0, 1), 15: F.col("peak_freq_yr") > 0,
        21: ~two | (F.col("smooth_yr") >= 0.05 * span), 22: (F.col("thresh_type") != 2) | (F.coalesce(F.col("yr_interp"), F.lit(0.0)) <= 0) | (F.col("smooth_yr") / F.col("yr_interp") >= 30),
    }
    names = F.create_map(*[F.lit(x) for k, m in RULES.items() for x in (k, m)])
    broken = F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(k)) for k, ok in meets.items()])
    rows = table.select("site", "run_id", F.explode(F.array_compact(broken)).alias("rule_no"))
    twice = table.groupBy("site", "run_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select("site", "run_id", F.lit(23).alias("rule_no"), "n_rows")
    x = rows.groupBy("site", "run_id", "rule_no").agg(F.count(F.lit(1)).alias("n_rows")).unionByName(twice)
    return x.select("site", "run_id", "rule_no", "n_rows", names[F.col("rule_no")].alias("message"), F.when(F.col("rule_no").isin(*WARNINGS), "warning").otherwise("error").alias("severity"))


def require_valid(spark: SparkSession, raw: DataFrame, p: Params) -> None:
    """Raises the first error."""
    bad = violations(spark, raw, p).where("severity = 'error'").orderBy("rule_no", "site").first()
    if bad:
        raise ValueError(f"{bad.message} (rule {bad.rule_no}, site {bad.site})")


def require_ratio(smoothed: DataFrame, p: Params) -> None:
    """A ratio needs a background above 0 everywhere."""
    if p.c_peak == 2 and smoothed.where("bkg <= 0").limit(1).count():
        raise ValueError("the background reaches 0: use residuals (c_peak 1)")
