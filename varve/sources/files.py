"""Parameter, sample and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varve.operators.history import RESULT
from varve.operators.validate import RULES
from varve.params import TABLE, Params

UNUSED = -9999.0
#: The header of a results file.
HEADERS = [
    "cm Top_i (cm)", "age Top_i (yr BP)", "char Count_i (#)", "char Vol_i (cm3)", "char Con_i (# cm-3)", "char Acc_i (# cm-2 yr-1)", "charBkg (# cm-2 yr-1)",
    "char Peak (# cm-2 yr-1)", "thresh 1 (# cm-2 yr-1)", "thresh 2 (# cm-2 yr-1)", "thresh 3 (# cm-2 yr-1)", "thresh FinalPos (# cm-2 yr-1)", "thresh FinalNeg (# cm-2 yr-1)",
    "SNI (index)", "thresh GOF (p-val)", "peaks 1", "peaks 2", "peaks 3", "peaks Final", "peaks Insig.", "peak Mag (# cm-2 peak-1)", "smPeak Frequ (peaks 1ka-1)",
    "smFRIs (yr fire-1)", "nFRIs (#)", "mFRI (yr fire-1)", "mFRI_uCI (yr fire-1)", "mFRI_lCI (yr fire-1)", "WBLb (yr)", "WBLb_uCI (yr)", "WBLb_lCI (yr)",
    "WBLc (unitless)", "WBLc_uCI (unitless)", "WBLc_lCI (unitless)",
]
COUNTS = {"peaks1", "peaks2", "peaks3", "peaks_final", "peaks_insig"}


def _with_site(df: DataFrame, suffix: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(F.url_decode(path), rf"([^/]*){suffix}$", 1).alias("site"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """All <site>_charData.csv files of a path or glob in one read; columns by position."""
    names = ["cm_top", "cm_bot", "age_top", "age_bot", "vol", "cnt"]
    text = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    x = _with_site(text, "_charData[.]csv")
    no = F.row_number().over(Window.partitionBy("site").orderBy("block", "row"))
    return x.select("site", no.alias("sample_no"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in names])


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """All <site>_charParams.csv files: site, zone_div (unused slots left out), and a column
    for each other slot. Only the third column is read; what is no number is null."""
    text = spark.read.schema("stage string, variable string, value string").option("header", True).option("enforceSchema", True).option("quote", '"').option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)
    x = _with_site(text, "_charParams[.]csv")
    slot = F.row_number().over(Window.partitionBy("site").orderBy("block", "row"))
    x = x.select("site", slot.alias("slot"), F.expr("try_cast(value as double)").alias("v")).where("slot <= 25")
    x = x.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    zone = F.filter(F.array(*[at(k) for k in range(1, 9)]), lambda v: v.isNotNull() & (v != UNUSED))
    names = {9: "yr_interp", 12: "smooth_yr", 20: "min_count_p", 21: "peak_freq_yr"}
    ints = {10: "transform", 11: "method", 13: "c_peak", 14: "thresh_type", 15: "thresh_method", 22: "bkg_sens", 23: "save_figures", 24: "save"}
    return x.select("site", zone.alias("zone_div"), *[at(k).alias(c) for k, c in names.items()], *[at(k).cast("int").alias(c) for k, c in ints.items()], F.coalesce(at(25).cast("int"), F.lit(1)).alias("all_figures"), F.array(*[at(k) for k in (16, 17, 18, 19)]).alias("thresh_values"))


def runs(spark: SparkSession, path: str, run_id: str = "base") -> DataFrame:
    """The parameter files of a path or glob as a table of runs (params.TABLE), one a site."""
    return read_params(spark, path).withColumn("run_id", F.lit(run_id)).select(*[f.split()[0] for f in TABLE.split(", ")])


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """site, has_params, has_data of every parameter or sample file of a folder, by an outer
    join of the two listings; only names are read. A lone file is a violation (lone_files())."""
    def listed(kind: str, flag: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{kind}.csv").load(folder).select("path")
        return files.select(F.regexp_extract(F.url_decode("path"), f"([^/]*)_{kind}[.]csv$", 1).alias("site"), F.lit(True).alias(flag)).distinct()

    both = listed("charParams", "has_params").join(listed("charData", "has_data"), "site", "full_outer")
    return both.select("site", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_params", "has_data")])


def lone_files(found: DataFrame) -> DataFrame:
    """site, rule_no, n_rows, message, severity: sites of discover() without one of their files."""
    rule = F.when(~F.col("has_data"), 24).when(~F.col("has_params"), 25)
    x = found.withColumn("rule_no", rule).where("rule_no is not null")
    message = F.when(F.col("rule_no") == 24, RULES[24]).otherwise(RULES[25])
    return x.select("site", "rule_no", F.lit(1).cast("long").alias("n_rows"), message.alias("message"), F.lit("error").alias("severity"))


def to_params(row, run_id: str = "base") -> Params:
    """A row of read_params() as Params."""
    d = row.asDict()
    keep = {k: d[k] for k in ("yr_interp", "transform", "method", "smooth_yr", "c_peak", "thresh_type", "thresh_method", "min_count_p", "peak_freq_yr", "bkg_sens")}
    return Params(zone_div=tuple(d["zone_div"]), thresh_values=tuple(d["thresh_values"]), run_id=run_id, **keep)


def read_excel(path: str):
    """charData and charParams sheets of a workbook (needs an Excel engine for pandas):
    samples, parameter values, site."""
    import pandas as pd

    samples = pd.read_excel(path, sheet_name="charData")
    sheet = pd.read_excel(path, sheet_name="charParams", header=None)
    site = sheet.iloc[0, 6] if sheet.shape[1] > 6 and isinstance(sheet.iloc[0, 6], str) else "UnknownSite"
    return samples.iloc[:, :6].astype(float), pd.to_numeric(sheet.iloc[1:26, 2], errors="coerce").tolist(), site


def formatted(results: DataFrame, digits: int = 7) -> DataFrame:
    """Results as text under the file's headers: counts as integers, others to so many
    significant digits, nulls empty; site and i come along."""
    number = lambda c: F.when(F.col(c).isNull(), "").when(F.col(c) == 0, "0").otherwise(_general(F.col(c), digits))
    whole = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit(""))
    return results.select("site", "i", *[(whole(c) if c in COUNTS else number(c)).alias(h) for c, h in zip(RESULT, HEADERS, strict=True)])


def _general(v, digits: int):
    """%g: fixed below 10^digits and from 10^-4 on, else with an exponent; no end zeros."""
    sci = F.format_string(f"%.{digits - 1}e", v)
    power = F.split(sci, "e")[1].cast("int")
    fixed = F.element_at(F.array(*[F.format_string(f"%.{d}f", v) for d in range(digits + 4)]), F.greatest(F.lit(1), F.least(F.lit(digits + 4), digits - power)))
    trim = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.concat(trim(F.split(sci, "e")[0]), F.lit("e"), F.split(sci, "e")[1])
    return F.when((power < -4) | (power >= digits), exponent).otherwise(trim(fixed))


def write_results(results: DataFrame, out_dir: str, digits: int = 7) -> None:
    """One folder site=<site> each, rows in order of i, no quotes."""
    if not out_dir:
        raise ValueError("out_dir must not be empty")
    rows = formatted(results, digits)
    (
        rows.repartition("site").sortWithinPartitions("site", "i").drop("i")
        .write.partitionBy("site").mode("overwrite").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(out_dir)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Reads written results, or a results file with padded cells, by position."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    # Of a folder that was written by site, the site is read from its folders' names.
    text = reader.csv(path) if path.endswith(".csv") else reader.option("basePath", path).csv(path)
    keyed = "site" in text.columns
    values = [c for c in text.columns if c != "site"]
    x = text.select(*([F.col("site")] if keyed else [F.lit("").alias("site")]), *[F.expr(f"try_cast(`{c}` as double)").alias(n) for c, n in zip(values, RESULT)], F.monotonically_increasing_id().alias("row"))
    return x.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("age_top_i"))).drop("row")
