"""Background curves: local regression, moving mean, median and mode.

Windows keep their length at the ends of a series by shifting inwards, which a window
frame cannot do: a frame wide enough for any shift collects the neighbours of a row, and
the row picks its own. Memory is the window's length for each row, whatever the series'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.params import ByRun, Params

KEY = ("site", "run_id")
EPS = 2.220446049250313e-16


def span_points(span: Column, n: Column) -> Column:
    """Points in the window: at least 3, at most n; a span below 1 is a share of n."""
    return F.least(F.greatest(F.lit(3), F.bround(F.when(span < 1, span * n).otherwise(span)).cast("int")), n)


def rows_of(years: float | Column, p: Params | ByRun) -> int | Column:
    """Rows that make up so many years, rounded half to even: a number where all series
    have one interval, else of each series' own."""
    return round(years / p.yr_interp) if p.fixed else F.bround((years if isinstance(years, Column) else F.lit(float(years))) / F.col("yr")).cast("int")


def within(key: tuple[str, ...], rows: int | Column):
    """The frame of so many rows to either side. Frames are literals, so where the number
    differs between series it is the row numbers that are scaled."""
    w = Window.partitionBy(*key)
    if isinstance(rows, int):
        return w.orderBy("i").rowsBetween(-rows, rows)
    return w.orderBy(F.col("i") / (rows + 0.5)).rangeBetween(-1, 1)


def widest_of(p: Params | ByRun, yr: float | None = None) -> int | None:
    """Rows of the widest window where the plan knows it; else each series has its own frame."""
    return max(3, rows_of(yr, p)) if p.fixed else None


def near(key: tuple[str, ...], rows: Column, widest: int | None, x: str = "i"):
    """A frame that holds so many rows to either side, at least."""
    w = Window.partitionBy(*key)
    return w.orderBy(x).rowsBetween(-widest, widest) if widest else w.orderBy(F.col(x) / (rows + 0.5)).rangeBetween(-1, 1)


def lowess(df: DataFrame, y: str | list[str], out: str | list[str], k: Column, widest: int | None, weight: str | None = None, x: str = "i", key: tuple[str, ...] = KEY) -> DataFrame:
    """Local line with tricube weights over the k nearest rows in order of x (1..n within
    a key, no gaps). Null values weigh nothing and stay null. weight: robustness weights.
    Several columns share one pass; a row then counts where none of them is null."""
    ys, outs = ([y], [out]) if isinstance(y, str) else (y, out)
    w = Window.partitionBy(*key).orderBy(x)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    df = df.withColumns({"__n": n.cast("int"), "__k": k})
    df = df.withColumn("__k", F.least("__k", "__n"))
    held = F.lit(True)
    for c in ys:
        held = held & F.col(c).isNotNull()
    row = F.when(held, F.struct(F.col(x).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1.0)).alias("r"), *[F.col(c).alias(f"y{j}") for j, c in enumerate(ys)]))
    i0 = F.greatest(F.lit(1), F.least(F.col(x) - F.floor(F.col("__k") / 2), F.col("__n") - F.col("__k") + 1))
    df = df.withColumns({"__near": F.collect_list(row).over(near(key, F.col("__k"), widest, x)), "__i0": i0.cast("double")})
    df = df.withColumn("__near", F.filter("__near", lambda r: (r["x"] >= F.col("__i0")) & (r["x"] <= F.col("__i0") + F.col("__k") - 1)))
    here = F.col(x).cast("double")
    far = F.greatest(here - F.try_element_at("__near", F.lit(1))["x"], F.try_element_at("__near", F.lit(-1))["x"] - here) + EPS
    df = df.withColumn("__far", far)
    names = ["w", "x", "xx"] + [f"{a}{j}" for j in range(len(ys)) for a in ("y", "z")]
    # Distance, kernel and weight of a neighbour are made one after the other, each once: written
    # out in every sum, they were worked out some hundred times for each.
    values = ["x", *[f"y{j}" for j in range(len(ys))]]

    def made(rows, keep, name, of):
        return F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in values + keep], of(r).alias(name)))

    weighed = made(F.col("__near"), ["r"], "d", lambda r: F.abs(r["x"] - here) / F.col("__far"))
    weighed = made(weighed, ["r"], "t", lambda r: 1.0 - r["d"] * r["d"] * r["d"])
    weighed = made(weighed, [], "v", lambda r: r["t"] * r["t"] * r["t"] * r["r"])

    def add(acc, r):
        more = {"w": r["v"], "x": r["v"] * r["x"], "xx": r["v"] * r["x"] * r["x"]}
        for j in range(len(ys)):
            more |= {f"y{j}": r["v"] * r[f"y{j}"], f"z{j}": r["v"] * r["x"] * r[f"y{j}"]}
        return F.struct(*[(acc[c] + more[c]).alias(c) for c in names])

    df = df.withColumn("__s", F.aggregate(weighed, F.struct(*[F.lit(0.0).alias(c) for c in names]), add))
    s = {c: F.col("__s")[c] for c in names}
    det = s["w"] * s["xx"] - s["x"] * s["x"]
    flat = F.abs(det) < EPS * F.greatest(F.abs(s["w"] * s["xx"]), s["x"] * s["x"])
    fits = {}
    for j, (c, o) in enumerate(zip(ys, outs, strict=True)):
        v, z = s[f"y{j}"], s[f"z{j}"]
        line = F.try_divide(v * s["xx"] - s["x"] * z + (s["w"] * z - s["x"] * v) * here, det)
        fits[o] = F.when(F.col(c).isNull() | (s["w"] < EPS), None).when(flat, F.try_divide(v, s["w"])).otherwise(line)
    # A frame of the row itself: filters on the result stay above it. Pushed below, they
    # would write the whole regression out once for each time they name it.
    fits = {o: F.first(e).over(w.rowsBetween(0, 0)) for o, e in fits.items()}
    return df.withColumns(fits).drop("__n", "__k", "__near", "__i0", "__far", "__s")


def robust_lowess(df: DataFrame, y: str, out: str, k: Column, widest: int | None, passes: int = 5, key: tuple[str, ...] = KEY) -> DataFrame:
    """lowess() repeated with bisquare weights of the residuals against six times their
    median size; a series whose residuals vanish keeps its fit."""
    df = lowess(df.withColumn("__rw", F.lit(1.0)), y, out, k, widest, "__rw", key=key)
    whole = Window.partitionBy(*key)
    for _ in range(passes - 1):
        df = df.withColumn("__res", F.col(y) - F.col(out))
        df = df.withColumn("__mid", F.percentile(F.abs("__res"), F.lit(0.5)).over(whole))
        u = F.try_divide(F.col("__res"), 6.0 * F.col("__mid"))
        weight = F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
        df = df.withColumns({"__rw": weight, "__old": F.col(out)})
        df = lowess(df, y, out, k, widest, "__rw", key=key)
        df = df.withColumn(out, F.when(F.col("__mid") < EPS, F.col("__old")).otherwise(F.col(out)))
    return df.drop("__rw", "__res", "__mid", "__old")


def bridge(df: DataFrame, y: str, out: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """Nulls filled linearly by position, and by the nearest value at the ends."""
    w = Window.partitionBy(*key).orderBy("i")
    held = {"v": F.col(y), "p": F.when(F.col(y).isNotNull(), F.col("i"))}
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__{c}0": F.last(e, True).over(before) for c, e in held.items()} | {f"__{c}1": F.last(e, True).over(after) for c, e in held.items()})
    part = F.try_divide((F.col("i") - F.col("__p0")).cast("double"), (F.col("__p1") - F.col("__p0")).cast("double"))
    mid = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * part
    return df.withColumn(out, F.coalesce(F.col(y), mid, "__v0", "__v1")).drop("__v0", "__v1", "__p0", "__p1")


def moving_mean(df: DataFrame, y: str, out: str, k: int | Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """Centred mean of k rows, fewer at the ends; of an even k the longer side is ahead."""
    if isinstance(k, int):
        w = Window.partitionBy(*key).orderBy("i").rowsBetween(-((k - 1) // 2), k // 2)
        return df.withColumn(out, F.avg(y).over(w))
    # A window of each series' own length: what lies behind, and what lies ahead, of the row.
    w = Window.partitionBy(*key)
    behind = w.orderBy(F.col("i") / (F.floor((k - 1) / 2) + 0.5)).rangeBetween(-1, Window.currentRow)
    ahead = w.orderBy(F.col("i") / (F.floor(k / 2) + 0.5)).rangeBetween(Window.currentRow, 1)
    total = sum((F.coalesce(F.sum(y).over(x), F.lit(0.0)) for x in (behind, ahead)), -F.coalesce(F.col(y), F.lit(0.0)))
    held = F.count(y).over(behind) + F.count(y).over(ahead) - F.col(y).isNotNull().cast("long")
    return df.withColumn(out, F.try_divide(total, held.cast("double")))


def _shifted(df: DataFrame, y: str, s: Column, widest: int | None, key: tuple[str, ...]) -> DataFrame:
    """__win: values of the row's window: the first or last k rows near the ends, else the
    rows from round(i - s/2) to round(i + s/2)."""
    n, i = F.col("n"), F.col("i")
    k, half = F.least(F.greatest(F.lit(3), F.bround(s).cast("int")), n), F.bround(s / 2)
    lo = F.when(i <= half, 1).when(i >= n - half, F.greatest(F.lit(1), n - k + 1)).otherwise(F.bround(i - 0.5 * s))
    hi = F.when(i <= half, k).when(i >= n - half, n).otherwise(F.bround(i + 0.5 * s))
    df = df.withColumns({"__near": F.collect_list(F.struct(F.col("i").alias("x"), F.col(y).alias("y"))).over(near(key, k + 1, widest and widest + 1)), "__lo": lo.cast("int"), "__hi": hi.cast("int")})
    return df.withColumn("__win", F.transform(F.filter("__near", lambda r: (r["x"] >= F.col("__lo")) & (r["x"] <= F.col("__hi"))), lambda r: r["y"])).drop("__near", "__lo", "__hi")


def median_of(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2)


def moving_median(df: DataFrame, y: str, out: str, s: Column, widest: int | None, key: tuple[str, ...] = KEY) -> DataFrame:
    return _shifted(df, y, s, widest, key).withColumn(out, median_of(F.col("__win"))).drop("__win")


def moving_mode(df: DataFrame, y: str, out: str, s: Column, widest: int | None, bins: int = 100, key: tuple[str, ...] = KEY) -> DataFrame:
    """Median of the centres of the fullest of 100 equal bins over each window."""
    df = _shifted(df, y, s, widest, key)
    lo, hi = F.array_min("__win"), F.array_max("__win")
    df = df.withColumns({"__min": lo, "__width": (hi - lo) / bins})
    bin_ = lambda v: F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(v - F.col("__min"), F.col("__width")), F.lit(0.0))).cast("int") + 1)
    df = df.withColumn("__bins", F.array_sort(F.transform("__win", bin_)))
    # Runs of equal bins: the last place of each less the last place of the one before.
    spots = F.transform(F.array_distinct("__bins"), lambda b: F.struct(F.size(F.filter("__bins", lambda x: x == b)).alias("n"), b.alias("b")))
    df = df.withColumn("__spots", spots)
    top = F.array_max(F.transform("__spots", lambda t: t["n"]))
    centres = F.transform(F.filter("__spots", lambda t: t["n"] == top), lambda t: F.col("__min") + (t["b"] - 0.5) * F.col("__width"))
    df = df.withColumn("__centres", centres)
    return df.withColumn(out, F.when(F.col("__width") == 0, F.col("__min")).otherwise(median_of(F.col("__centres")))).drop("__win", "__min", "__width", "__bins", "__spots", "__centres")


def background(grid: DataFrame, p: Params | ByRun, methods: tuple[int, ...] | None = None) -> DataFrame:
    """Adds bkg1..bkg5 (those asked for; the run's own by default) and bkg, the run's own."""
    methods = methods or (p.method,)
    s = p.smooth / F.col("yr")
    k = span_points(s, F.col("n"))
    widest = widest_of(p, p.smooth_yr) if p.fixed else None
    df = grid
    if set(methods) & {3, 4, 5}:
        df = bridge(df, "acc", "__clean")
    for m in methods:
        out = f"bkg{m}"
        if m == 1:
            df = lowess(df, "acc", out, k, widest)
        elif m == 2:
            df = robust_lowess(df, "acc", out, k, widest)
        elif m == 3:
            df = moving_mean(df, "__clean", out, widest or F.greatest(F.lit(3), F.bround(s).cast("int")))
        elif m == 4:
            df = lowess(moving_median(df, "__clean", "__raw", s, widest), "__raw", out, k, widest).drop("__raw")
        else:
            df = lowess(moving_mode(df, "__clean", "__raw", s, widest), "__raw", out, k, widest).drop("__raw")
        df = df.withColumn(out, F.when(F.col("acc").isNotNull(), F.col(out)))
    return df.drop("__clean").withColumn("bkg", F.col(f"bkg{p.method}"))
