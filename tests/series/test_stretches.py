"""Series are cut into stretches, and what crosses their borders is carried."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import FOLDER, rows

from varve import queries
from varve.operators import pretreat, validate
from varve.params import Params, as_table
from varve.plans.study import Runs, Study
from varve.sources import events

P = Params(zone_div=(0.0, 900.0), yr_interp=10.0)
COLUMNS = "site string, sample_no int, cm_top double, cm_bot double, age_top double, age_bot double, vol double, cnt double"
#: Gaps within a stretch of 7, over its border, at its ends, over whole stretches, and at both ends of the series.
GAPS = {1, 2, 5, 7, 13, 14, 15, 20, 27, 28, 40, *range(47, 67), 79, 80}


def series(spark):
    return spark.createDataFrame(
        [(s, i, 0.5 * i + (0.1 if i in (6, 49) else 0.0), 0.5 * i + 0.5, (10.0 + k) * (i if i not in (28, 50) else i - 1), (10.0 + k) * (i + 1), 0.0 if i + k in GAPS else 2.0, float(i * i % 11)) for k, s in enumerate("ab") for i in range(1, 81)],
        COLUMNS,
    )


def found(spark):
    raw = series(spark)
    trimmed = pretreat.trim(raw, P)
    tables = {"rated": pretreat.rates(pretreat.fill_gaps(trimmed)), "runs": pretreat.gap_runs(trimmed), "totals": pretreat.gap_totals(trimmed), "breaks": pretreat.noncontiguous(trimmed), "step": pretreat.auto_interval(trimmed), "rules": validate.sample_violations(raw)}
    return {name: sorted(map(repr, t.collect())) for name, t in tables.items()}


def test_results_do_not_depend_on_stretches(spark, monkeypatch):
    whole = found(spark)
    assert len(whole["rated"]) > 100 and len(whole["runs"]) > 10 and len(whole["rules"]) > 3
    monkeypatch.setattr(pretreat, "STRETCH", 7)
    assert found(spark) == whole


def test_a_series_is_spread_over_tasks(spark, monkeypatch):
    """A single long series is not the work of one task."""
    monkeypatch.setattr(pretreat, "STRETCH", 7)
    # As with tables too large to merge partitions or to send to all tasks.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rated = pretreat.rates(pretreat.fill_gaps(pretreat.trim(series(spark).where("site = 'a'"), P)))
        cores = events.pseudo_cores(spark.read.parquet(f"{FOLDER}/events.parquet").where("event_type = 'view'"))
        for x in (rated, cores):
            assert x.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for name in settings:
            spark.conf.unset(name)


@pytest.mark.parametrize("hour", [60_000_000, 7 * 86_400_000_000])
def test_events_that_share_a_time(spark, tmp_path, monkeypatch, hour):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + c * 1000 AS event_id) FROM '{FOLDER}/events.parquet', range(3) r(c)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    monkeypatch.setattr(events, "HOUR_MICROS", hour)
    monkeypatch.setattr(pretreat, "STRETCH", 50)
    for name in ("a00_samples", "p04_gap_runs", "p06_gap_fill", "p13_resample"):
        want = con.execute(queries.SQL[name])
        columns = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall()), name


def test_the_layout_of_runs_sorts_no_samples(spark):
    """A row a series is worked out by hash: no task holds samples in order for it."""
    runs = Runs(series(spark), as_table(spark, [("a", P), ("b", P)]))
    ends = pretreat.zone_end(runs.studies[0].trimmed, runs.studies[0].p)
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    got = {(r.site, r.zone_end, r.z0, r.yr, r.n) for r in runs.studies[0].layout.collect()}
    assert got == {(r.site, r.zone_end, r.z0, r.yr, r.n) for r in Study(series(spark), P).layout.collect()} and len(got) == 2
