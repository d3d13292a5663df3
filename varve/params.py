"""Parameters of an analysis: one set as numbers, or a table of sets as columns."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.stats import z_of


@dataclass(frozen=True)
class Params:
    """One parameter set. Times are in the units of the age columns.

    method: 1 lowess, 2 robust lowess, 3 moving mean, 4 moving median, 5 moving mode.
    c_peak: 1 residual, 2 ratio. thresh_type: 1 global, 2 local window.
    thresh_method: 1 given values, 2 half-Gaussian noise, 3 Gaussian mixture.
    merge: a mixture whose two means are equal is fitted again with three components that are
    merged to two, and not with three.
    """

    zone_div: tuple[float, ...] = (0.0, 14400.0, 43200.0)
    yr_interp: float = 120.0
    transform: int = 0
    method: int = 1
    smooth_yr: float = 6000.0
    c_peak: int = 1
    thresh_type: int = 2
    thresh_method: int = 2
    thresh_values: tuple[float, float, float, float] = (0.95, 0.99, 0.999, 0.99)
    min_count_p: float = 0.05
    peak_freq_yr: float = 7200.0
    bkg_sens: int = 0
    n_boot: int = 100
    merge: bool = False
    run_id: str = "base"

    @property
    def neutral(self) -> float:
        return 0.0 if self.c_peak == 1 else 1.0

    @property
    def fixed(self) -> bool:
        """All series have one interval, known when the plan is made: frames are literals."""
        return self.yr_interp > 0

    start = property(lambda self: F.lit(float(self.zone_div[0])))
    end = property(lambda self: F.lit(float(self.zone_div[-1])))
    interval = property(lambda self: F.lit(float(self.yr_interp)))
    smooth = property(lambda self: F.lit(float(self.smooth_yr)))
    freq = property(lambda self: F.lit(float(self.peak_freq_yr)))
    limits = property(lambda self: F.array(*[F.lit(float(v)) for v in self.zone_div]))
    z_count = property(lambda self: F.lit(z_of(1 - self.min_count_p)))

    def value(self, j: int) -> Column:
        return F.lit(float(self.thresh_values[j]))

    def z(self, j: int) -> Column:
        """Normal quantile of the j-th threshold."""
        return F.lit(z_of(self.thresh_values[j]))

    def z_low(self, j: int) -> Column:
        return F.lit(z_of(1 - self.thresh_values[j]))


#: Choices between ways to compute. Runs that agree in all of them are one branch of a plan.
CHOICES = ("transform", "method", "c_peak", "thresh_type", "thresh_method")
NUMBERS = ("yr_interp", "smooth_yr", "min_count_p", "peak_freq_yr")
TABLE = "site string, run_id string, zone_div array<double>, thresh_values array<double>, " + ", ".join(f"{c} double" for c in NUMBERS) + ", " + ", ".join(f"{c} int" for c in CHOICES)

#: Coefficients of Wichura's rational approximations of the normal quantile
#: (algorithm AS 241, PPND16), highest power first: centre, tail, far tail.
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def quantile(p: Column) -> Column:
    """Standard normal quantile of a probability in (0, 1), null outside."""
    horner = lambda c, x: reduce(lambda acc, k: acc * x + k, c[1:], F.lit(c[0]))
    ratio = lambda c, x: horner(c[0], x) / horner(c[1], x)
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(_TAIL, r - 1.6)).otherwise(ratio(_FAR, r - 5))
    z = F.when(F.abs(q) <= 0.425, q * ratio(_CENTRE, 0.180625 - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return F.when((p > 0) & (p < 1), z)


class ByRun:
    """The parameters of many runs that agree in their choices. What is a number there comes
    with each row here, in the struct ``par``."""

    fixed = False
    run_id = None
    merge = False

    def __init__(self, choices: dict[str, int], n_boot: int = 100):
        for c in CHOICES:
            setattr(self, c, int(choices[c]))
        self.n_boot = n_boot

    @property
    def neutral(self) -> float:
        return 0.0 if self.c_peak == 1 else 1.0

    start = property(lambda self: F.element_at("par.zone_div", 1))
    end = property(lambda self: F.element_at("par.zone_div", -1))
    limits = property(lambda self: F.col("par.zone_div"))
    interval = property(lambda self: F.col("par.yr_interp"))
    smooth = property(lambda self: F.col("par.smooth_yr"))
    freq = property(lambda self: F.col("par.peak_freq_yr"))
    z_count = property(lambda self: F.col("par.z_count"))

    def value(self, j: int) -> Column:
        return F.col("par.thresh_values")[j]

    def z(self, j: int) -> Column:
        return F.col("par.z")[j]

    def z_low(self, j: int) -> Column:
        return F.col("par.z_low")[j]


def family(table: DataFrame, choices: dict[str, int]) -> DataFrame:
    """site, run_id, par: the runs of a table that have those choices. A yr_interp of 0 or
    null is each series' own interval."""
    x = table
    for c, v in choices.items():
        x = x.where(F.col(c) == v)
    quantiles = lambda f: F.transform("thresh_values", lambda v: quantile(f(v)))
    numbers = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c == "yr_interp" else F.col(c) for c in NUMBERS]
    par = F.struct("zone_div", "thresh_values", *numbers, quantiles(lambda v: v).alias("z"), quantiles(lambda v: 1 - v).alias("z_low"), quantile(1 - F.col("min_count_p")).alias("z_count"))
    return x.select("site", "run_id", par.alias("par"))


def families(table: DataFrame) -> list[dict[str, int]]:
    """The different choices of a table's runs: a few hundred at most, of any number of runs."""
    return [r.asDict() for r in table.select(*CHOICES).distinct().orderBy(*CHOICES).collect()]


def as_table(spark: SparkSession, runs: list[tuple[str, Params]]) -> DataFrame:
    """A table of runs (TABLE) from sites and their parameter sets."""
    names = {f.name for f in fields(Params)}
    order = [f.split()[0] for f in TABLE.split(", ")]
    rows = [tuple(list(v) if isinstance(v, tuple) else float(v) if c in NUMBERS else v for c in order for v in [site if c == "site" else getattr(p, c)] if c == "site" or c in names) for site, p in runs]
    return spark.createDataFrame(rows, TABLE)
