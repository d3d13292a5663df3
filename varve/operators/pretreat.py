"""From raw samples to a regular grid.

Samples are put in order within stretches of a series, by sample_no. What a row needs from beyond
its stretch comes from a table of the stretches, a row for each, so no task holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.params import Params


#: Sample numbers of a stretch.
STRETCH = 1 << 15


def _key(df: DataFrame) -> list[str]:
    """Series are told apart by site, and where each brings its parameters, by run."""
    return [c for c in ("site", "run_id") if c in df.columns]


def _also(df: DataFrame) -> list[str]:
    return [c for c in ("run_id", "par") if c in df.columns]


def stretched(df: DataFrame) -> DataFrame:
    """Adds __at, the stretch of a sample."""
    return df.withColumn("__at", F.coalesce(F.floor(F.col("sample_no") / STRETCH), F.lit(-(1 << 62))))


def _cut(df: DataFrame) -> list[str]:
    return [*_key(df), "__at"]


def _by_sample(df: DataFrame):
    return Window.partitionBy(*_cut(df)).orderBy("sample_no")


def following(df: DataFrame, **columns: str) -> DataFrame:
    """Adds columns (new name: old) of the sample that follows, null at the last."""
    x, row = stretched(df), F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    heads = x.groupBy(*_cut(x)).agg(F.min_by(row, "sample_no").alias("__head"))
    heads = heads.select(*_cut(x), F.lead("__head").over(Window.partitionBy(*_key(x)).orderBy("__at")).alias("__beyond"))
    x = x.withColumn("__next", F.lead(row).over(_by_sample(x))).join(heads, _cut(x))
    return x.select("*", F.coalesce("__next", "__beyond").alias("__row")).select(*df.columns, "__row.*")


def trim(raw: DataFrame, p: Params) -> DataFrame:
    """Samples inside the outer zone limits; NaN becomes null."""
    for c in ("cm_top", "cm_bot", "age_top", "age_bot", "vol", "cnt"):
        raw = raw.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast("double")))
    return raw.where((F.col("age_top") >= p.start) & (F.col("age_bot") <= p.end))


def zone_end(trimmed: DataFrame, p: Params) -> DataFrame:
    """site, zone_end: the last limit, or the last sample's bottom age if that is less. The series'
    parameters are in the key: as a first value of it they would have all samples sorted."""
    par = [c for c in trimmed.columns if c == "par"]
    x = trimmed.groupBy(*_key(trimmed), *par).agg(F.least(F.max(p.end), F.max_by("age_bot", "sample_no")).alias("zone_end"), F.max(p.start).alias("z0"))
    return x.select(*_key(trimmed), "zone_end", "z0", *par)


def missing(trimmed: DataFrame) -> DataFrame:
    return trimmed.withColumn("is_missing", F.coalesce(F.col("vol") <= 0, F.lit(True)))


def gap_runs(trimmed: DataFrame) -> DataFrame:
    """site, gap_no, first_no, last_no, n_rows of each run of missing samples."""
    key = _key(trimmed)
    runs = _flanked(trimmed).where("is_missing").groupBy(*key, "pos_0").agg(F.min("sample_no").alias("first_no"), F.max("sample_no").alias("last_no"), F.count("*").alias("n_rows"))
    return runs.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("first_no")).alias("gap_no"), "first_no", "last_no", "n_rows")


def _flanked(trimmed: DataFrame) -> DataFrame:
    """Samples with their place pos, the next held samples on either side (_0, _1), step, the
    thickness of the sample after the held one before, and cm_next, age_next of the next sample."""
    x = stretched(missing(trimmed))
    key, cut, w = _key(x), _cut(x), _by_sample(x)
    row = F.struct((F.col("cm_bot") - F.col("cm_top")).alias("step"), F.col("cm_top").alias("cm_next"), F.col("age_top").alias("age_next"))
    x = x.withColumns({"__no": F.row_number().over(w).cast("long"), "__next": F.lead(row).over(w)})
    x = x.withColumn("__held", F.when(~F.col("is_missing"), F.struct(F.col("__no").alias("pos"), "cm_top", "age_top", "vol", "cnt", "__next.step")))
    held_no = F.when(~F.col("is_missing"), F.col("sample_no"))
    before = Window.partitionBy(*key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy(*cut).agg(F.count(F.lit(1)).alias("__n"), F.min_by(row, "sample_no").alias("__head"), F.min_by("__held", held_no).alias("__first"), F.max_by("__held", held_no).alias("__last"))
    parts = parts.withColumns({"__start": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__beyond": F.lead("__head").over(Window.partitionBy(*key).orderBy("__at"))})
    moved = lambda held: F.col(held).withField("pos", F.col(held)["pos"] + F.col("__start"))
    last = F.when(F.col("__last.pos") == F.col("__n"), moved("__last").withField("step", F.col("__beyond.step"))).otherwise(moved("__last"))
    parts = parts.withColumns({"__last": last, "__first": moved("__first")})
    parts = parts.select(*cut, "__start", "__beyond", F.last("__last", ignorenulls=True).over(before).alias("__carried0"), F.last("__first", ignorenulls=True).over(after).alias("__carried1"))
    order = f"OVER (PARTITION BY {', '.join(cut)} ORDER BY sample_no)"
    x = x.withColumns({"__0": F.expr(f"lag(__held) IGNORE NULLS {order}"), "__1": F.expr(f"lead(__held) IGNORE NULLS {order}")})
    x = x.join(parts, cut)
    x = x.withColumns({f"__{k}": F.coalesce(moved(f"__{k}"), F.col(f"__carried{k}")) for k in "01"} | {"__next": F.coalesce("__next", "__beyond")})
    sides = [F.col(f"__{k}")[c].alias(f"{c}_{k}") for k in "01" for c in ("pos", "cm_top", "age_top", "vol", "cnt")]
    return x.select(*trimmed.columns, "is_missing", (F.col("__start") + F.col("__no")).alias("pos"), *sides, F.col("__0.step").alias("step"), "__next.cm_next", "__next.age_next")


def gap_totals(trimmed: DataFrame) -> DataFrame:
    """site, n_missing, n_gaps, cm_gaps, yr_gaps: between the samples that flank each gap."""
    x = _flanked(trimmed).where("is_missing")
    first = F.col("pos") == F.col("pos_0") + 1
    return x.groupBy(*_key(trimmed)).agg(
        F.count("*").alias("n_missing"), F.count_if(first).alias("n_gaps"),
        F.sum(F.when(first, F.col("cm_top_1") - F.col("cm_top_0"))).alias("cm_gaps"),
        F.sum(F.when(first, F.col("age_top_1") - F.col("age_top_0"))).alias("yr_gaps"),
    )


def fill_gaps(trimmed: DataFrame) -> DataFrame:
    """vol and cnt of missing samples, linear in depth between the flanking samples, at
    steps of the first missing sample's thickness. With a point too many inside the gap
    the second one is left out. A gap at either end has no flank and stays null. Also
    cm_next, age_next: tops of the next sample."""
    x = _flanked(trimmed)
    inside = F.floor((F.col("cm_top_1") - F.col("cm_top_0")) / F.col("step") + 1e-10) - 1
    j, length = F.col("pos") - F.col("pos_0"), F.col("pos_1") - F.col("pos_0") - 1
    at = F.when((inside == length) | (j == 1), j).otherwise(j + 1)
    part = at * F.col("step") / (F.col("cm_top_1") - F.col("cm_top_0"))
    out = {c: F.when(F.col("is_missing"), F.col(f"{c}_0") + (F.col(f"{c}_1") - F.col(f"{c}_0")) * part).otherwise(F.col(c)) for c in ("vol", "cnt")}
    return x.select("site", "sample_no", "cm_top", "cm_bot", "age_top", "age_bot", out["vol"].alias("vol"), out["cnt"].alias("cnt"), "is_missing", "cm_next", "age_next", *_also(trimmed))


def noncontiguous(trimmed: DataFrame) -> DataFrame:
    """site, n_breaks, cm_breaks, yr_breaks where a sample does not begin where the one before ends."""
    x = following(trimmed, cm_next="cm_top", age_next="age_top")
    broken = F.col("cm_next") != F.col("cm_bot")
    return x.groupBy(*_key(trimmed)).agg(
        F.count_if(broken).alias("n_breaks"), F.coalesce(F.sum(F.when(broken, F.col("cm_next") - F.col("cm_top"))), F.lit(0.0)).alias("cm_breaks"),
        F.coalesce(F.sum(F.when(broken, F.col("age_next") - F.col("age_top"))), F.lit(0.0)).alias("yr_breaks"),
    )


def rates(filled: DataFrame) -> DataFrame:
    """Adds con (count by volume), sed (depth by age to the next sample, 0 at the last) and acc."""
    up, age = F.col("cm_next"), F.col("age_next")
    sed = F.when(age.isNull(), 0.0).otherwise(F.try_divide(up - F.col("cm_top"), age - F.col("age_top")))
    x = filled.withColumns({"con": F.try_divide("cnt", "vol"), "sed": sed})
    return x.withColumn("acc", F.col("con") * F.col("sed"))


def auto_interval(trimmed: DataFrame) -> DataFrame:
    """site, yr: the median step of age_top, rounded half to even."""
    x = following(trimmed, after="age_top").withColumn("step", F.col("after") - F.col("age_top"))
    return x.groupBy(*_key(trimmed)).agg(F.bround(F.percentile("step", F.lit(0.5))).alias("yr"))


def layout(trimmed: DataFrame, p: Params) -> DataFrame:
    """site, zone_end, z0, yr, n: what the grid of each site is made from."""
    ends = zone_end(trimmed, p)
    if p.fixed:
        ends = ends.withColumn("yr", p.interval)
    else:
        # Only the series that ask for it have their own interval worked out.
        own = auto_interval(trimmed.where(p.interval <= 0)).withColumnRenamed("yr", "own")
        ends = ends.join(own, _key(trimmed), "left").withColumn("yr", F.coalesce(F.when(p.interval > 0, p.interval), "own")).drop("own")
    return ends.withColumn("n", (F.floor((F.col("zone_end") - F.col("z0")) / F.col("yr") + 1e-10) + 1).cast("int"))


def grid(sites: DataFrame, p: Params) -> DataFrame:
    """site, i, age, yr, n."""
    x = sites.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return x.select("site", "i", (F.col("z0") + (F.col("i") - 1) * F.col("yr")).alias("age"), "yr", "n", *_also(sites))


def _on_grid(rated: DataFrame, sites: DataFrame) -> DataFrame:
    """Samples with the layout of their series. The layout has a row a series and is sent to the
    samples: joined by series, a whole one would meet in one task."""
    return rated.drop("par").join(F.broadcast(sites), _key(rated))


def _cells_met() -> tuple[Column, Column]:
    """First and last of the cells (from 0) that a sample meets."""
    z = F.col("z0")
    return F.greatest(F.lit(0).cast("long"), F.floor((F.col("age_top") - z) / F.col("yr"))), F.least(F.col("n").cast("long") - 1, F.ceil((F.col("age_bot") - z) / F.col("yr")) - 1)


def _share() -> Column:
    top = F.col("z0") + F.col("c") * F.col("yr")
    return (F.least("age_bot", top + F.col("yr")) - F.greatest("age_top", top)) / F.col("yr")


def overlaps(rated: DataFrame, sites: DataFrame, p: Params) -> DataFrame:
    """The cells that each sample meets, with the share of the cell that it covers.

    A sample is sent to its cells by arithmetic, so this is a generator and not a join
    over a range: rows out are rows that overlap.
    """
    lo, hi = _cells_met()
    x = _on_grid(rated, sites).withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("c", F.explode(F.sequence("lo", "hi")))
    return x.withColumns({"i": (F.col("c") + 1).cast("int"), "share": _share()}).where("share > 0")


def _points_after() -> tuple[Column, Column]:
    """First and last of the grid's ages (from 0) from a sample on and before the next."""
    z, eps = F.col("z0"), 1e-9
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("age_top") - z) / F.col("yr") - eps))
    hi = F.when(F.col("age_next").isNull(), F.floor((F.col("age_top") - z) / F.col("yr") + eps)).otherwise(F.ceil((F.col("age_next") - z) / F.col("yr") - eps) - 1)
    return lo, F.least(F.col("n").cast("long") - 1, hi)


def _depth() -> Column:
    """Depth at a grid age, linear between samples, none outside them."""
    age = F.col("z0") + F.col("c") * F.col("yr")
    part = F.coalesce(F.try_divide(age - F.col("age_top"), F.col("age_next") - F.col("age_top")), F.lit(0.0))
    return F.col("cm_top") + F.coalesce(F.col("cm_next") - F.col("cm_top"), F.lit(0.0)) * part


def resample(rated: DataFrame, sites: DataFrame, p: Params) -> DataFrame:
    """site, run_id, i, age, yr, n, cm, cnt, vol, con, sed, acc on the grid; null where no
    sample reaches. Partly covered cells are not scaled up."""
    key = _key(rated)
    (lo, hi), (first, last) = _cells_met(), _points_after()
    x = _on_grid(rated, sites).withColumns({"lo": lo, "hi": hi, "first": first, "last": last})
    # The cells that a sample meets and the points that follow it are one range of the grid.
    meets, leads = F.col("lo") <= F.col("hi"), F.col("first") <= F.col("last")
    ends = F.least(F.when(meets, F.col("lo")), F.when(leads, F.col("first"))), F.greatest(F.when(meets, F.col("hi")), F.when(leads, F.col("last")))
    x = x.where(meets | leads).withColumn("c", F.explode(F.sequence(*ends)))
    x = x.withColumns({"share": F.when(F.col("c").between(F.col("lo"), F.col("hi")), _share()), "cm": F.when(F.col("c").between(F.col("first"), F.col("last")), _depth())})
    share = F.when(F.col("share") > 0, F.col("share"))
    parts = x.select(*key, (F.col("c") + 1).cast("int").alias("i"), *[(F.col(c) * share).alias(c) for c in ("cnt", "vol", "con", "sed")], "cm")
    none = {c: F.lit(None).cast("double") for c in ("cnt", "vol", "con", "sed", "cm")}
    empty = grid(sites, p).withColumns(none).select(*parts.columns)
    # Cells and what falls into them meet in one aggregate: no join, one exchange.
    sums = parts.unionByName(empty).groupBy(*key, "i").agg(*[F.sum(c).alias(c) for c in ("cnt", "vol", "con", "sed")], F.max("cm").alias("cm"))
    x = sums.join(sites.drop("zone_end"), key).withColumn("age", F.col("z0") + (F.col("i") - 1) * F.col("yr"))
    run = F.col("run_id") if "run_id" in key else F.lit(p.run_id).alias("run_id")
    acc = F.col("con") * F.col("sed")
    if p.transform == 1:
        acc = F.log10(acc + 1)
    elif p.transform == 2:
        acc = F.log1p(acc)
    return x.select("site", run, "i", "age", "yr", "n", "cm", "cnt", "vol", "con", "sed", acc.alias("acc"), *[c for c in _also(x) if c == "par"])


def pretreat(raw: DataFrame, p: Params) -> DataFrame:
    trimmed = trim(raw, p)
    return resample(rates(fill_gaps(trimmed)), layout(trimmed, p), p)
