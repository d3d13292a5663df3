import math
from collections import Counter

import duckdb
import pytest

from varve import queries

FOLDER = "/root/testdata/sf0.001"
#: A spread over all stages; each runs the stages before it too.
NAMES = [
    "p05_gap_totals", "p06_gap_fill", "p07_noncontiguous", "p10_auto_interval", "p12_overlap", "p14_depth", "b02_bridge", "b04_robust_lowess", "b06_moving_median", "b07_moving_mode",
    "t08_global_thresholds", "t10_global_sni", "t14_untested_windows", "t06_mixture_global", "t16_local_mixture", "g06_reduced_mixture", "i10_mixture_screened", "t21_smoothed_thresholds", "i09_count_p", "i10_screened", "i11_all_thresholds", "f02_magnitude", "f04_smoothed_frequency", "f07_bootstrap_band", "f09_intervals_on_grid", "fig04_sensitivity", "fig08_tests", "v01_violations", "v02_rules",
]


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return Counter(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_violations_where_events_share_a_time(spark, tmp_path):
    """Equal ages are a warning, and v01_violations is the errors alone."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + c * 1000 AS event_id) FROM '{FOLDER}/events.parquet', range(3) r(c)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("v01_violations", "v02_rules"):
        want = con.execute(queries.SQL[name])
        columns = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_result_invariants(spark):
    found = queries.QUERIES["f17_results"](spark, FOLDER).collect()
    by_site = {}
    for r in found:
        by_site.setdefault(r.site, []).append(r)
        assert r.peaks_final in (0, 1) and r.peaks_insig in (0, 1) and r.peak_mag >= 0 and r.sm_peak_freq is not None
        assert r.gof is None or 0 <= r.gof <= 1
        assert math.isfinite(r.thresh_pos) and r.thresh_neg <= r.thresh_pos
    for site_rows in by_site.values():
        site_rows.sort(key=lambda r: r.i)
        assert [r.i for r in site_rows] == list(range(1, len(site_rows) + 1))
        assert not any(a.peaks_final and b.peaks_final for a, b in zip(site_rows, site_rows[1:]))
