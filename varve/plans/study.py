"""The stages of an analysis, each a lazy DataFrame on the one before."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.operators import history, peaks, pretreat, smooth, threshold, validate
from varve.operators.peaks import KEY_T
from varve.operators.smooth import KEY
from varve.params import CHOICES, NUMBERS, ByRun, Params, families, family
from varve.stages import stage


class Study:
    """raw: the columns of SAMPLES. Nothing runs until a result is asked for (but see held). All stages
    are keyed by (site, run_id): one exchange by site serves every window after it.

    runs: site, run_id, pre, par of runs that share grids (see Runs); raw then holds a copy
    of each site for each of its grids, under the name ``pre`` as its run_id."""

    def __init__(self, raw: DataFrame, p: Params | ByRun = Params(), gof: bool = True, runs: DataFrame | None = None):
        self.raw, self.p, self.gof, self.runs = raw, p, gof, runs

    @classmethod
    def valid(cls, raw: DataFrame, p: Params, gof: bool = True) -> Study:
        """A study whose samples and parameters break no rule, or the first error: one pass over
        the samples, and for ratios one over the background."""
        validate.require_valid(raw.sparkSession, raw, p)
        study = cls(raw, p, gof)
        if p.c_peak == 2:
            validate.require_ratio(study.smoothed, p)
        return study

    def _of_runs(self, df: DataFrame) -> DataFrame:
        """What is keyed by grid, once for each run that uses the grid."""
        if self.runs is None:
            return df
        return df.drop("par").withColumnRenamed("run_id", "pre").join(self.runs, ["site", "pre"]).drop("pre")

    @cached_property
    def trimmed(self) -> DataFrame:
        return pretreat.trim(self.raw, self.p)

    @cached_property
    def layout(self) -> DataFrame:
        return pretreat.layout(self.trimmed, self.p)

    @cached_property
    def sites(self) -> DataFrame:
        return self._of_runs(self.layout)

    @cached_property
    def rated(self) -> DataFrame:
        return pretreat.rates(pretreat.fill_gaps(self.trimmed))

    @cached_property
    def grid(self) -> DataFrame:
        return self._of_runs(pretreat.resample(self.rated, self.layout, self.p))

    @cached_property
    def smoothed(self) -> DataFrame:
        return smooth.background(self.grid, self.p)

    @cached_property
    def peaked(self) -> DataFrame:
        return threshold.peak_series(self.smoothed, self.p)

    @cached_property
    def thresholds(self) -> DataFrame:
        return threshold.thresholds(self.peaked, self.p, self.gof)

    @cached_property
    def peaks(self) -> DataFrame:
        return peaks.identify(self.thresholds, self.p)

    @cached_property
    def final(self) -> DataFrame:
        return history.final(self.peaks)

    @cached_property
    def zones(self) -> DataFrame:
        return history.zones(self.sites, self.p)

    @cached_property
    def held(self) -> tuple[DataFrame, DataFrame]:
        """Thresholds and peaks as written stages: the branches of the result table read them
        instead of working them out anew. Asking for them runs them."""
        thresholds = stage(self.thresholds, "thresholds")
        return thresholds, stage(peaks.identify(thresholds, self.p), "peaks")

    def table(self, bootstrap: bool = True) -> DataFrame:
        """The result table, with seeded bootstraps of the moving intervals or standard errors."""
        return history.results(*self.held, self.sites, self.p, bootstrap)

    @cached_property
    def results(self) -> DataFrame:
        return self.table()


class Runs:
    """Many runs over many sites in one plan. table: a row for each (site, run_id), as
    params.TABLE or sources.files.runs() has them; a site may have any number of runs.

    Runs that agree in their choices (method, kind of threshold and the like) are one
    Study; all that is a number travels with the rows, so a plan has a branch for each
    combination of choices in use and grows neither with sites nor with runs. Runs of a
    site that agree in zones and interval share one grid: it is made once and then joined
    to its runs. Sites without a run, and runs without samples, have no result; rows that
    repeat a (site, run_id) are a mistake that validate.table_violations() tells.

    choices: the combinations in use, where they are known; else one small job finds them."""

    def __init__(self, raw: DataFrame, table: DataFrame, choices: list[dict[str, int]] | None = None, gof: bool = True, n_boot: int = 100):
        self.studies = []
        for c in families(table) if choices is None else choices:
            runs = family(table, c).withColumn("pre", F.to_json(F.struct("par.zone_div", "par.yr_interp")))
            grids = runs.select("site", F.col("pre").alias("run_id"), F.struct("par.zone_div", "par.yr_interp").alias("par")).distinct()
            self.studies.append(Study(raw.join(F.broadcast(grids), "site"), ByRun(c, n_boot), gof, runs))

    def union(self, of) -> DataFrame:
        """One result of all studies: of is given each."""
        return reduce(lambda a, b: a.unionByName(b), [of(s) for s in self.studies])

    @property
    def results(self) -> DataFrame:
        return self.union(lambda s: s.results)


def window_sweep(raw: DataFrame, p: Params, windows: list[float], gof: bool = True) -> DataFrame:
    """Sensitivity to the background window: site, bkg_window, n1..n4 (peaks by threshold),
    sni, gof (means), mfri, sd_fri (of the final peaks). The grid is made once and joined to
    the windows as runs of one plan, whose size does not depend on their number; counts,
    means and intervals come from one pass."""
    every = F.explode(F.array(*[F.lit(float(w)) for w in windows]))
    fixed = {c: F.lit(float(getattr(p, c))) for c in NUMBERS if c != "smooth_yr"} | {c: F.lit(getattr(p, c)) for c in CHOICES}
    table = raw.select("site").distinct().withColumn("smooth_yr", every).withColumns(
        {"run_id": F.format_string("%012.3f", "smooth_yr"), "zone_div": p.limits, "thresh_values": F.array(*[F.lit(float(v)) for v in p.thresh_values])} | fixed
    )
    s = Runs(raw, table, [{c: getattr(p, c) for c in CHOICES}], gof).studies[0]
    x = peaks.identify(s.thresholds, s.p, ("sni", "gof"))
    spot = F.when(F.col("is_peak"), F.col("age"))
    before = F.last(spot, ignorenulls=True).over(Window.partitionBy(*KEY_T).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("fri", F.when(F.col("t") == history.FINAL, spot - before))
    one = lambda c: F.avg(F.when(F.col("t") == 1, F.col(c))).alias(c)
    x = x.groupBy(*KEY).agg(
        F.first("par.smooth_yr").alias("bkg_window"), *[F.count_if(F.col("is_peak") & (F.col("t") == j)).alias(f"n{j}") for j in (1, 2, 3, 4)],
        one("sni"), one("gof"), F.avg("fri").alias("mfri"), F.stddev_samp("fri").alias("sd_fri"),
    )
    return x.drop("run_id")


def sweep_windows(p: Params, step: float = 100.0, most: float = 1000.0, span: float | None = None) -> list[float]:
    """Windows of the sweep: from step (global) or from the step below 30 rows (local), to most."""
    span = p.zone_div[-1] - p.zone_div[0] if span is None else span
    least = step if p.thresh_type == 1 else max(step, 30 * p.yr_interp // step * step)
    return [least + step * k for k in range(int((min(most, span) - least) // step) + 1)]
