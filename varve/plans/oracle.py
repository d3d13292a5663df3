"""The stages of an analysis in plain SQL, written another way round than the operators:
band joins where those generate rows, as-of joins where those use windows."""

from __future__ import annotations

from varve.functions.stats import z_of
from varve.params import Params

EPS = "2.220446049250313e-16"


def lowess(src: str, name: str, y: str, out: str, k: str, r: str = "1.0", x: str = "i", keep: str = "") -> dict[str, str]:
    """CTEs that add column out to src: local line over the k nearest rows."""
    null = f"a.{y} IS NULL"
    return {
        f"{name}_n": f"SELECT *, least(CAST(({k}) AS BIGINT), count(*) OVER (PARTITION BY site)) AS kk, count(*) OVER (PARTITION BY site) AS nn FROM {src}",
        f"{name}_i": f"SELECT *, greatest(1, least({x} - kk // 2, nn - kk + 1)) AS i0 FROM {name}_n",
        f"{name}_b": f"SELECT a.site, a.{x} AS ix, b.{x}::DOUBLE AS j, b.{y} AS y, b.r, max(abs(b.{x} - a.{x})) OVER (PARTITION BY a.site, a.{x}) + {EPS} AS far FROM {name}_i a JOIN (SELECT site, {x}, {y}, {r} AS r FROM {src} WHERE {y} IS NOT NULL) b ON a.site = b.site AND b.{x} BETWEEN a.i0 AND a.i0 + a.kk - 1",
        f"{name}_w": f"SELECT *, power(1 - power(abs(j - ix) / far, 3), 3) * r AS w FROM {name}_b",
        f"{name}_s": f"SELECT site, ix, sum(w) AS sw, sum(w * j) AS sx, sum(w * y) AS sy, sum(w * j * j) AS sxx, sum(w * j * y) AS sxy FROM {name}_w GROUP BY ALL",
        name: f"SELECT a.*, CASE WHEN {null} OR sw IS NULL OR sw < {EPS} THEN NULL WHEN abs(sw * sxx - sx * sx) < {EPS} * greatest(abs(sw * sxx), sx * sx) THEN sy / sw ELSE (sy * sxx - sx * sxy + (sw * sxy - sx * sy) * a.{x}) / (sw * sxx - sx * sx) END AS {out} FROM {src} a LEFT JOIN {name}_s s ON a.site = s.site AND a.{x} = s.ix",
    }


def picks(run_id: str, keys: str, n: str = "n") -> str:
    """The resample of vals: values at places that the hash of keys, draw and place gives."""
    return f"list_transform(range(1, {n} + 1), lambda k: vals[1 + CAST(floor(('0x' || substr(md5(concat_ws('|', site, '{run_id}', {keys}, draw, k)), 1, 8))::UBIGINT::DOUBLE * {n} / 4294967296.0) AS BIGINT)])"


def weibull(src: str, name: str, values: str) -> dict[str, str]:
    """CTEs that add b and c, the Weibull fit to the bins of a list; rows with two bins or more."""
    total = lambda e: f"list_sum(list_transform(bins, lambda r: {e}))"
    w, low = "r.f * exp(c * ln(r.x / top))", "ln(r.x / top)"
    s0, s1, s2 = total(w), total(f"{w} * {low}"), total(f"{w} * {low} * {low}")
    new = f"c - ({s1} / {s0} - 1 / c - mean_l) / (({s2} * {s0} - {s1} * {s1}) / ({s0} * {s0}) + 1 / (c * c))"
    return {
        f"{name}_f": f"SELECT *, list_filter(list_transform(range(1, 50), lambda k: {{'f': len(list_filter({values}, lambda v: v >= k * 20 AND v < (k + 1) * 20))::DOUBLE, 'x': (k + 0.5::DOUBLE) * 20}}), lambda r: r.f > 0) AS bins FROM {src}",
        f"{name}_t": f"SELECT *, list_max(list_transform(bins, lambda r: r.x)) AS top, {total('r.f')} AS cnt, {total('r.f * r.x')} / {total('r.f')} AS mean_x FROM {name}_f WHERE len(bins) > 1",
        f"{name}_m": f"SELECT *, {total('r.f * ln(r.x / top)')} / cnt AS mean_l, sqrt({total('r.f * power(r.x - mean_x, 2)')} / (cnt - 1)) AS sd_x FROM {name}_t",
        f"{name}_c": f"SELECT *, list_reduce(list_concat([greatest(0.1::DOUBLE, power(mean_x / greatest(sd_x, 1e-6), 1.086))], range(40)::DOUBLE[]), lambda c, k: CASE WHEN {new} > 0 THEN {new} ELSE c / 2 END) AS c FROM {name}_m",
        name: f"SELECT *, top * power({total(w)} / cnt, 1 / c) AS b FROM {name}_c",
    }


def ks_tail(x: str) -> str:
    """Kolmogorov's limit distribution beyond x, by the series that converges there."""
    low = f"1 - sqrt(2 * pi()) / {x} * list_sum(list_transform(range(1, 30), lambda k: exp(-power(2 * k - 1, 2) * pi() * pi() / (8 * {x} * {x}))))"
    high = f"2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * {x} * {x})))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1, greatest(0, CASE WHEN {x} < 1 THEN {low} ELSE {high} END)) END"


def mixture(src: str, name: str, k: int, begin: str | None = None) -> dict[str, str]:
    """CTEs that fit a mixture of k normals to x of src (site, i, x): name holds each site's model
    at rest, with its components as lists in order. The rounds are a recursive statement.
    begin: site and lists m, v, s to start from, else evenly spaced values."""
    js = range(1, k + 1)
    c: dict[str, str] = {}
    c[f"{name}_z"] = f"SELECT site, count(*) AS nn, var_pop(x) AS spread, list(x ORDER BY i) AS xs FROM {src} GROUP BY site HAVING count(*) >= {max(2, k)} AND min(x) < max(x)"
    place = lambda j: f"xs[(({j} - 1) * (nn - 1)) // {k - 1} + 1]" if k > 1 else "xs[1]"
    first = ", ".join(f"{place(j)} AS m{j}, spread * 1.00001 AS v{j}, 1.0::DOUBLE / {k} AS s{j}" for j in js)
    given = ", ".join(f"m[{j}] AS m{j}, v[{j}] AS v{j}, s[{j}] AS s{j}" for j in js)
    c[f"{name}_0"] = f"SELECT site, nn, spread, {first} FROM {name}_z" if begin is None else f"SELECT site, nn, spread, {given} FROM {name}_z JOIN {begin} USING (site)"
    dens = ", ".join(f"s{j} * exp(-0.5 * (x - m{j}) * (x - m{j}) / v{j}) / sqrt(2 * pi() * v{j}) AS f{j}" for j in js)
    total = " + ".join(f"f{j}" for j in js)
    sums = ", ".join(f"sum(f{j} / f) AS w{j}, sum(f{j} / f * x) AS a{j}, sum(f{j} / f * x * x) AS b{j}, any_value(m{j}) AS m{j}, any_value(v{j}) AS v{j}, any_value(s{j}) AS s{j}" for j in js)
    moved = ", ".join(f"CASE WHEN rest THEN m{j} ELSE a{j} / w{j} END AS m{j}, CASE WHEN rest THEN v{j} ELSE b{j} / w{j} - power(a{j} / w{j}, 2) + spread / 1e5 END AS v{j}, CASE WHEN rest THEN s{j} ELSE w{j} / nn END AS s{j}" for j in js)
    c[f"{name}_r"] = (
        f"SELECT *, NULL::DOUBLE AS loglik, 0 AS turn, false AS rest FROM {name}_0 UNION ALL SELECT site, nn, spread, {moved}, now AS loglik, turn + 1, rest FROM "
        f"(SELECT * EXCLUDE (loglik), coalesce(now - loglik <= 0.03 * ln(nn), false) OR turn >= 500 AS rest FROM (SELECT site, any_value(nn) AS nn, any_value(spread) AS spread, any_value(turn) AS turn, any_value(loglik) AS loglik, sum(ln(f)) AS now, {sums} "
        f"FROM (SELECT *, {total} AS f FROM (SELECT r.*, x, {dens} FROM {name}_r r JOIN {src} USING (site) WHERE NOT rest)) GROUP BY site))"
    )
    lists = ", ".join(f"[{', '.join(f'{n}{j}' for j in js)}] AS {n}" for n in "mvs")
    c[name] = f"SELECT site, nn, {lists}, loglik, turn - 1 AS rounds, -loglik + {0.5 * (3 * k - 1)} * ln(nn) AS description, {k} AS k FROM {name}_r WHERE rest"
    return c


def merged(src: str, name: str, k: int) -> dict[str, str]:
    """A CTE with src's models of k components, the two closest of each merged into one."""
    pairs = ", ".join(f"({a}, {b})" for a in range(1, k + 1) for b in range(a + 1, k + 1))
    one = "SELECT *, s[a] + s[b] AS sh, (s[a] * m[a] + s[b] * m[b]) / (s[a] + s[b]) AS me FROM {0}, (VALUES {1}) AS t(a, b)".format(src, pairs)
    two = f"SELECT *, (s[a] * (v[a] + power(me - m[a], 2)) + s[b] * (v[b] + power(me - m[b], 2))) / sh AS va FROM ({one})"
    far = f"SELECT *, row_number() OVER (PARTITION BY site ORDER BY sh * ln(va) - s[a] * ln(v[a]) - s[b] * ln(v[b]), a, b) AS nearest FROM ({two})"
    new = ", ".join(f"list_transform(list_filter(range(1, {k + 1}), lambda j: j <> b), lambda j: CASE WHEN j = a THEN {e} ELSE {n}[j] END) AS {n}" for n, e in (("m", "me"), ("v", "va"), ("s", "sh")))
    return {name: f"SELECT site, {new} FROM ({far}) WHERE nearest = 1"}


def stages(p: Params) -> dict[str, str]:
    """All CTEs in order."""
    z0, z1, yr = p.zone_div[0], p.zone_div[-1], p.yr_interp
    s, q = p.smooth_yr / yr, p.peak_freq_yr / yr
    k, hw, m = max(3, round(s)), round(0.5 * s), round(150 / yr)
    z = [z_of(v) for v in p.thresh_values]
    zn = [z_of(1 - v) for v in p.thresh_values]
    c: dict[str, str] = {}
    c["ev"] = "SELECT event_type AS site, event_id, value AS v, epoch_us(ts) AS us, row_number() OVER w AS sample_no, lead(epoch_us(ts)) OVER w AS nx, lead(epoch_us(ts), 2) OVER w AS nx2 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"
    c["samples"] = "SELECT site, sample_no, 0.5::DOUBLE * (sample_no - 1) AS cm_top, 0.5::DOUBLE * sample_no AS cm_bot, (us - 1704067200000000)::DOUBLE / 60e6 AS age_top, (nx - 1704067200000000)::DOUBLE / 60e6 AS age_bot, CASE WHEN event_id % 97 = 0 AND sample_no > 1 AND nx2 IS NOT NULL THEN 0.0::DOUBLE ELSE (1 + event_id % 3)::DOUBLE END AS vol, floor(v / 10)::DOUBLE AS cnt FROM ev WHERE nx IS NOT NULL"
    c["trimmed"] = f"SELECT *, row_number() OVER (PARTITION BY site ORDER BY sample_no) AS pos, vol <= 0 AS is_missing FROM samples WHERE age_top >= {z0} AND age_bot <= {z1}"
    c["sites"] = f"SELECT site, zone_end, {yr}::DOUBLE AS yr, CAST(floor((zone_end - {z0}) / {yr} + 1e-10) AS BIGINT) + 1 AS n FROM (SELECT site, least({z1}, arg_max(age_bot, sample_no)) AS zone_end FROM trimmed GROUP BY site)"
    c["held"] = "SELECT * FROM trimmed WHERE NOT is_missing"
    c["flanked"] = "SELECT t.*, b.pos AS pos_0, b.cm_top AS cm_0, b.age_top AS age_0, b.vol AS vol_0, b.cnt AS cnt_0, a.pos AS pos_1, a.cm_top AS cm_1, a.age_top AS age_1, a.vol AS vol_1, a.cnt AS cnt_1 FROM trimmed t ASOF LEFT JOIN held b ON t.site = b.site AND t.pos > b.pos ASOF LEFT JOIN held a ON t.site = a.site AND t.pos < a.pos WHERE t.is_missing"
    c["gap_part"] = "SELECT f.*, g.cm_bot - g.cm_top AS step, floor((cm_1 - cm_0) / (g.cm_bot - g.cm_top) + 1e-10) - 1 AS inside, f.pos - pos_0 AS j FROM flanked f JOIN trimmed g ON f.site = g.site AND g.pos = f.pos_0 + 1"
    c["gap_fill"] = "SELECT *, (CASE WHEN inside = pos_1 - pos_0 - 1 OR j = 1 THEN j ELSE j + 1 END) * step / (cm_1 - cm_0) AS part FROM gap_part"
    c["filled"] = "SELECT t.site, t.sample_no, t.cm_top, t.cm_bot, t.age_top, t.age_bot, CASE WHEN t.is_missing THEN g.vol_0 + (g.vol_1 - g.vol_0) * g.part ELSE t.vol END AS vol, CASE WHEN t.is_missing THEN g.cnt_0 + (g.cnt_1 - g.cnt_0) * g.part ELSE t.cnt END AS cnt, t.is_missing FROM trimmed t LEFT JOIN gap_fill g ON t.site = g.site AND t.sample_no = g.sample_no"
    c["rated"] = "SELECT a.*, a.cnt / nullif(a.vol, 0) AS con, CASE WHEN b.site IS NULL THEN 0.0 ELSE (b.cm_top - a.cm_top) / nullif(b.age_top - a.age_top, 0) END AS sed, b.age_top AS age_next, b.cm_top AS cm_next FROM filled a LEFT JOIN filled b ON a.site = b.site AND b.sample_no = a.sample_no + 1"
    c["cells"] = f"SELECT site, CAST(i AS BIGINT) AS i, {z0} + (i - 1) * yr AS age, yr, n FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM sites)"
    c["shares"] = "SELECT c.i, (least(r.age_bot, c.age + c.yr) - greatest(r.age_top, c.age)) / c.yr AS share, r.* FROM cells c JOIN rated r ON r.site = c.site AND r.age_top < c.age + c.yr AND r.age_bot > c.age"
    c["sums"] = "SELECT site, i, sum(share * cnt) AS cnt, sum(share * vol) AS vol, sum(share * con) AS con, sum(share * sed) AS sed FROM shares WHERE share > 0 GROUP BY site, i"
    c["depth"] = "SELECT c.site, c.i, CASE WHEN r.age_next IS NULL THEN CASE WHEN c.age = r.age_top THEN r.cm_top END ELSE r.cm_top + (r.cm_next - r.cm_top) * (c.age - r.age_top) / (r.age_next - r.age_top) END AS cm FROM cells c ASOF JOIN rated r ON c.site = r.site AND c.age >= r.age_top"
    transform = {0: "con * sed", 1: "log10(con * sed + 1)", 2: "ln(con * sed + 1)"}[p.transform]
    c["grid"] = f"SELECT c.*, d.cm, s.cnt, s.vol, s.con, s.sed, {transform} AS acc FROM cells c LEFT JOIN sums s USING (site, i) LEFT JOIN depth d USING (site, i)"
    c["clean"] = "SELECT g.*, coalesce(g.acc, b.acc + (a.acc - b.acc) * (g.i - b.i) / (a.i - b.i), b.acc, a.acc) AS clean FROM grid g ASOF LEFT JOIN (SELECT site, i, acc FROM grid WHERE acc IS NOT NULL) b ON g.site = b.site AND g.i >= b.i ASOF LEFT JOIN (SELECT site, i, acc FROM grid WHERE acc IS NOT NULL) a ON g.site = a.site AND g.i <= a.i"
    kk = f"least(greatest(3, {round(s)}), n)"
    c |= lowess("grid", "sm1", "acc", "bkg1", kk)
    prev = "sm1"
    c["rob0"] = "SELECT *, bkg1 AS fit FROM sm1"
    prev = "rob0"
    for r in range(1, 5):
        c[f"res{r}"] = f"SELECT *, median(abs(acc - fit)) OVER (PARTITION BY site) AS mid, acc - fit AS res FROM {prev}"
        c[f"rw{r}"] = f"SELECT * EXCLUDE (fit, mid, res), fit AS old, mid, CASE WHEN abs(res) < 6 * mid THEN power(1 - power(res / (6 * mid), 2), 2) ELSE 0.0 END AS rw FROM res{r}"
        c |= lowess(f"rw{r}", f"pass{r}", "acc", "raw_fit", kk, "rw")
        c[f"rob{r}"] = f"SELECT * EXCLUDE (raw_fit, old, mid, rw), CASE WHEN mid < {EPS} THEN old ELSE raw_fit END AS fit FROM pass{r}"
        prev = f"rob{r}"
    c["sm2"] = "SELECT * RENAME (fit AS bkg2) FROM rob4"
    c["sm3"] = f"SELECT *, CASE WHEN acc IS NOT NULL THEN avg(clean) OVER (PARTITION BY site ORDER BY i ROWS BETWEEN {(k - 1) // 2} PRECEDING AND {k // 2} FOLLOWING) END AS bkg3 FROM clean"
    half = round(s / 2)
    c["win"] = f"SELECT *, CAST(CASE WHEN i <= {half} THEN 1 WHEN i >= n - {half} THEN greatest(1, n - {kk} + 1) ELSE round_even(i - {0.5 * s}, 0) END AS BIGINT) AS lo, CAST(CASE WHEN i <= {half} THEN {kk} WHEN i >= n - {half} THEN n ELSE round_even(i + {0.5 * s}, 0) END AS BIGINT) AS hi FROM clean"
    c["near"] = "SELECT a.site, a.i, b.clean AS v FROM win a JOIN win b ON a.site = b.site AND b.i BETWEEN a.lo AND a.hi"
    c["med"] = "SELECT w.*, m.raw FROM win w JOIN (SELECT site, i, median(v) AS raw FROM near GROUP BY ALL) m USING (site, i)"
    c |= lowess("med", "sm4r", "raw", "fit", kk)
    c["sm4"] = "SELECT * EXCLUDE (fit), CASE WHEN acc IS NOT NULL THEN fit END AS bkg4 FROM sm4r"
    c["lim"] = "SELECT site, i, min(v) AS mn, (max(v) - min(v)) / 100 AS width FROM near GROUP BY ALL"
    c["binned"] = "SELECT n.site, n.i, mn, width, CASE WHEN width = 0 THEN 1 ELSE least(100, CAST(floor((v - mn) / width) AS BIGINT) + 1) END AS b, count(*) AS k FROM near n JOIN lim USING (site, i) GROUP BY ALL"
    c["mode"] = "SELECT site, i, median(CASE WHEN width = 0 THEN mn ELSE mn + (b - 0.5) * width END) AS raw FROM (SELECT *, max(k) OVER (PARTITION BY site, i) AS top FROM binned) WHERE k = top GROUP BY ALL"
    c["mod"] = "SELECT w.*, m.raw FROM win w JOIN mode m USING (site, i)"
    c |= lowess("mod", "sm5r", "raw", "fit", kk)
    c["sm5"] = "SELECT * EXCLUDE (fit), CASE WHEN acc IS NOT NULL THEN fit END AS bkg5 FROM sm5r"
    c["peaked"] = f"SELECT * EXCLUDE (bkg{p.method}), bkg{p.method} AS bkg, " + (f"acc - bkg{p.method}" if p.c_peak == 1 else f"acc / nullif(bkg{p.method}, 0)") + f" AS peak FROM sm{p.method}"
    # Global model.
    c["ends"] = "SELECT site, min(peak) AS lo, max(peak) AS hi FROM peaked GROUP BY site"
    c["bins"] = "SELECT site, CAST(b AS BIGINT) AS bin, lo + (hi - lo) * b / 250 AS possible FROM (SELECT *, unnest(range(0, 251)) AS b FROM ends)"
    c["mirror"] = f"SELECT site, peak - {p.neutral} AS d FROM peaked WHERE peak <= {p.neutral} UNION ALL SELECT site, -(peak - {p.neutral}) FROM peaked WHERE peak <= {p.neutral}"
    c["gnoise"] = f"SELECT site, {p.neutral}::DOUBLE AS mu, stddev_samp(d) AS sigma FROM mirror GROUP BY site"
    c["px"] = "SELECT site, i, peak AS x FROM peaked WHERE peak IS NOT NULL"
    c |= mixture("px", "mix", 2)
    c["px_same"] = "SELECT px.* FROM px JOIN mix USING (site) WHERE m[1] = m[2]"
    c |= mixture("px_same", "mix_same", 3)
    c["mlow"] = "SELECT site, list_min(list_zip(m, v, s)) AS low FROM (SELECT * FROM mix WHERE site NOT IN (SELECT site FROM mix_same) UNION ALL SELECT * FROM mix_same)"
    c["mnoise"] = f"SELECT site, coalesce(low[1], {p.neutral}) AS mu, coalesce(sqrt(low[2]), g.sigma) AS sigma, coalesce(low[3], 1.0) AS prop, low IS NOT NULL AS fitted FROM gnoise g LEFT JOIN mlow USING (site)"
    c |= mixture("px", "mixc", 3) | merged("mixc", "mixc_to", 3) | mixture("px", "mixb", 2, "mixc_to") | merged("mixb", "mixb_to", 2) | mixture("px", "mixa", 1, "mixb_to")
    c["reduced"] = "SELECT * FROM (SELECT * FROM mixc UNION ALL SELECT * FROM mixb UNION ALL SELECT * FROM mixa) QUALIFY row_number() OVER (PARTITION BY site ORDER BY description, k DESC) = 1"
    snap = lambda v: f"(SELECT arg_min(possible, (round(abs(b.possible - ({v})) / ((e.hi - e.lo) / 250), 9), -bin)) FROM bins b WHERE b.site = e.site)"
    noise = "mnoise" if p.thresh_method == 3 else "gnoise"
    c["gthr"] = "SELECT e.site, mu, sigma, " + ", ".join(f"{snap(f'mu + {v!r} * sigma')} AS g{j}" for j, v in enumerate(z, 1)) + f", mu + {zn[2]!r} * sigma AS neg FROM ends e JOIN {noise} USING (site)"
    c["gsni"] = "SELECT site, CASE WHEN count(*) FILTER (peak > g4) > 0 AND count(*) FILTER (peak <= g4) > 2 THEN (avg(peak) FILTER (peak > g4) - avg(peak) FILTER (peak <= g4)) / stddev_samp(peak) FILTER (peak <= g4) * (count(*) FILTER (peak <= g4) - 2) / count(*) FILTER (peak <= g4) ELSE 0 END AS sni FROM peaked JOIN gthr USING (site) GROUP BY site"
    # Local model.
    c["xs"] = f"SELECT *, coalesce(peak, {p.neutral}) AS x FROM peaked"
    c["pairs"] = f"SELECT a.site, a.i, b.x FROM xs a JOIN xs b ON a.site = b.site AND b.i BETWEEN a.i - {hw} AND a.i + {hw}"
    c["lstat"] = f"SELECT site, i, count(*) AS win_n, count(*) FILTER (x <= {p.neutral}) AS m, sum(power(x - {p.neutral}, 2)) FILTER (x <= {p.neutral}) AS ss, stddev_samp(x) AS sd FROM pairs GROUP BY ALL"
    c["lnoise"] = f"SELECT xs.*, win_n, {p.neutral}::DOUBLE AS mu, CASE WHEN m > 0 THEN sqrt(2 * ss / (2 * m - 1)) ELSE sd END AS sigma FROM xs JOIN lstat USING (site, i)"
    c["wx"] = f"SELECT site || '|' || i AS site, j AS i, x FROM (SELECT a.site, a.i, b.i AS j, b.x, count(*) FILTER (b.x <> {p.neutral}) OVER w AS off, sum(b.x) OVER w AS total FROM xs a JOIN xs b ON a.site = b.site AND b.i BETWEEN a.i - {hw} AND a.i + {hw} WINDOW w AS (PARTITION BY a.site, a.i)) WHERE off >= 4 AND total <> 0"
    c |= mixture("wx", "wmix", 2)
    c["wx_same"] = "SELECT wx.* FROM wx JOIN wmix USING (site) WHERE m[1] = m[2]"
    c |= mixture("wx_same", "wmix_same", 3)
    c["wlow"] = "SELECT site, list_min(list_zip(m, v, s)) AS low FROM (SELECT * FROM wmix WHERE site NOT IN (SELECT site FROM wmix_same) UNION ALL SELECT * FROM wmix_same)"
    c["lmixed"] = "SELECT l.* REPLACE (coalesce(low[1], mu) AS mu, coalesce(sqrt(low[2]), sigma) AS sigma), low IS NOT NULL AS fitted FROM lnoise l LEFT JOIN wlow w ON w.site = l.site || '|' || l.i"
    lnoise = "lmixed" if p.thresh_method == 3 else "lnoise"
    c["lthr"] = "SELECT *, " + ", ".join(f"mu + {v!r} * sigma AS pos{j}, mu + {w!r} * sigma AS neg{j}" for j, (v, w) in enumerate(zip(z, zn), 1)) + f" FROM {lnoise}"
    c["lsplit"] = "SELECT p.site, p.i, avg(p.x) FILTER (p.x > pos4) AS s, count(*) FILTER (p.x > pos4) AS ns, avg(p.x) FILTER (p.x <= pos4) AS m, stddev_samp(p.x) FILTER (p.x <= pos4) AS d, count(*) FILTER (p.x <= pos4) AS nn FROM pairs p JOIN lthr t USING (site, i) GROUP BY ALL"
    c["lsni"] = "SELECT t.*, CASE WHEN ns > 0 AND nn > 2 THEN (s - m) / d * (nn - 2) / nn ELSE 0 END AS sni FROM lthr t JOIN lsplit USING (site, i)"
    names = ["sni"] + [f"{a}{j}" for a in ("pos", "neg") for j in (1, 2, 3, 4)]
    prev = "lsni"
    for name in names:
        c |= lowess(prev, f"f_{name}", name, "fit", kk)
        value = "CASE WHEN fit < 0 THEN 0.0 ELSE fit END" if name == "sni" else "fit"
        c[f"t_{name}"] = f"SELECT * EXCLUDE ({name}, fit), {value} AS {name} FROM f_{name}"
        prev = f"t_{name}"
    c["thr"] = f"SELECT * FROM {prev}"
    # Peaks.
    c["flagged"] = "SELECT *, coalesce(round(peak, 9) > round(thr, 9), false) AS flag FROM (SELECT site, i, age, yr, n, cnt, vol, peak, unnest([1, 2, 3, 4])::BIGINT AS t, unnest([pos1, pos2, pos3, pos4]) AS thr FROM thr)"
    c["ended"] = "SELECT a.*, a.flag AND NOT coalesce(b.flag, false) AS is_end, CASE WHEN a.flag AND NOT coalesce(b.flag, false) THEN f.thr ELSE 0.0 END AS thr_peak FROM flagged a LEFT JOIN flagged b ON a.site = b.site AND a.t = b.t AND b.i = a.i + 1 JOIN flagged f ON a.site = f.site AND a.t = f.t AND f.i = 1"
    c["spots"] = "SELECT site, t, i, lag(i) OVER w AS prev_i, lead(i) OVER w AS next_i FROM ended WHERE is_end WINDOW w AS (PARTITION BY site, t ORDER BY i)"
    c["ranged"] = f"SELECT e.*, s.prev_i, s.next_i, CASE WHEN s.prev_i IS NOT NULL OR s.next_i IS NOT NULL THEN greatest(1, e.i - {m}, coalesce(s.prev_i, 1)) END AS young, CASE WHEN s.prev_i IS NOT NULL OR s.next_i IS NOT NULL THEN least(e.n, e.i + {m}, coalesce(s.next_i, e.n)) END AS old FROM ended e LEFT JOIN spots s USING (site, t, i)"
    side = lambda lo, hi, f, o: f"(SELECT struct_pack(c := arg_{f}(round_even(g.cnt, 0), (round_even(g.cnt, 0), {o}g.i)), v := arg_{f}(g.vol, (round_even(g.cnt, 0), {o}g.i))) FROM grid g WHERE g.site = r.site AND g.i BETWEEN {lo} AND {hi} AND g.cnt IS NOT NULL)"
    c["ext0"] = f"SELECT r.*, {side('r.young', 'r.i', 'max', '-')} AS y, {side('r.i', 'r.old', 'min', '')} AS o FROM ranged r WHERE r.young IS NOT NULL"
    c["ext"] = "SELECT site, t, i, y.c AS c_max, y.v AS v_max, o.c AS c_min, o.v AS v_min, o.v / nullif(o.v + y.v, 0) AS vr FROM ext0"
    c["tested"] = "SELECT *, CASE WHEN c_min + c_max > 0 THEN (abs(c_min - (c_min + c_max) * vr) - 0.5) / nullif(sqrt((c_min + c_max) * vr * (1 - vr)), 0) END AS d FROM ext"
    c["pk"] = f"SELECT r.*, c_max, v_max, c_min, v_min, d, coalesce(CASE WHEN c_min + c_max = 0 THEN true ELSE round(d, 9) < {round(z_of(1 - p.min_count_p), 9)!r} END, false) AS insig FROM ranged r LEFT JOIN tested USING (site, t, i)"
    c["peaks"] = "SELECT *, is_end AND NOT insig AS is_peak FROM pk"
    c["one"] = "SELECT * FROM peaks WHERE t = 4"
    c["fri"] = "SELECT site, t, i, age, prev_age, age - prev_age AS fri FROM (SELECT site, t, i, age, lag(age) OVER (PARTITION BY site, t ORDER BY i) AS prev_age FROM peaks WHERE is_peak) WHERE prev_age IS NOT NULL"
    # History.
    c["over"] = "SELECT site, i, yr, CASE WHEN i = n THEN 0.0 ELSE coalesce(greatest(0.0, round(peak, 9) - round(pos4, 9)), 0.0) END AS over_by FROM thr"
    c["mag"] = "SELECT site, max(i) AS i, sum(over_by) * (max(i) - min(i) + any_value(yr)) AS peak_mag FROM (SELECT *, i - row_number() OVER (PARTITION BY site ORDER BY i) AS island FROM over WHERE over_by > 0) GROUP BY site, island"
    h, full = int(q) / 2, round(q)
    c["counted"] = f"SELECT a.site, a.i, a.n, count(*) FILTER (b.is_peak AND b.i <= a.i + {int(h)}) AS head, count(*) FILTER (b.is_peak AND b.i >= a.i - {int(h)}) AS tail, count(*) FILTER (b.is_peak AND b.i BETWEEN greatest(1, ceil(a.i - {0.5 * q}) + 1) AND least(a.n, ceil(a.i + {0.5 * full}))) AS mid FROM one a JOIN one b ON a.site = b.site GROUP BY ALL"
    c["freq"] = f"SELECT site, i, n, CASE WHEN i < {h} THEN head * ({full} / (i + {int(h)})) WHEN i > n - {h} THEN tail * {q} / (n - i + {int(h)} + 1) ELSE mid END::DOUBLE AS freq FROM counted"
    c |= lowess("freq", "sfreq", "freq", "sm_freq", f"least(greatest(3, {round(q)}), n)")
    w = p.peak_freq_yr / 2
    c["steps"] = "SELECT site, CAST(s AS BIGINT) AS step, -70.0 + 100 * s AS step_age FROM (SELECT site, unnest(range(0, CAST(floor((max(age) + 70) / 100 + 1e-10) AS BIGINT) + 1)) AS s FROM one GROUP BY site)"
    c["moved"] = f"SELECT s.site, s.step, s.step_age, f.fri FROM steps s JOIN fri f ON s.site = f.site AND f.t = 4 AND f.prev_age >= s.step_age - {w} AND f.age < s.step_age + {w}"
    c["band"] = "SELECT site, step, step_age, n, mean, mean - sd / sqrt(n) AS lo, mean + sd / sqrt(n) AS hi FROM (SELECT site, step, step_age, count(*) AS n, avg(fri) AS mean, stddev_samp(fri) AS sd FROM moved GROUP BY ALL) WHERE n > 1"
    c["banded"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY step) AS i, count(*) OVER (PARTITION BY site) AS m FROM band) WHERE m > 2"
    span = p.peak_freq_yr / 100
    kb = f"least(greatest(3, CASE WHEN {span} / m < 1 THEN round_even({span} / m * m, 0) ELSE round_even({span} / m, 0) END), m)"
    c |= lowess("banded", "b1", "mean", "sm_fri", kb) | lowess("b1", "b2", "lo", "sm_lo", kb) | lowess("b2", "bands", "hi", "sm_hi", kb)
    c["onto"] = "SELECT g.site, g.i, b.sm_fri + (b.next_fri - b.sm_fri) * (g.age - b.step_age) / (b.next_age - b.step_age) AS sm_fri FROM cells g ASOF JOIN (SELECT site, step_age, sm_fri, lead(step_age) OVER w AS next_age, lead(sm_fri) OVER w AS next_fri FROM bands WINDOW w AS (PARTITION BY site ORDER BY step)) b ON g.site = b.site AND g.age >= b.step_age WHERE b.next_age IS NOT NULL AND g.age < b.next_age"
    limits = list(p.zone_div)
    c["zones"] = " UNION ALL ".join(f"SELECT site, {k + 1}::BIGINT AS zone, {limits[k]}::DOUBLE AS z_lo, {f'{limits[k + 1]}::DOUBLE' if k + 2 < len(limits) else 'zone_end'} AS z_hi FROM sites" for k in range(len(limits) - 1))
    c["zfri"] = "SELECT * FROM (SELECT p.site, p.t, zone, age, age - lag(age) OVER (PARTITION BY p.site, p.t, zone ORDER BY age) AS fri FROM peaks p JOIN zones z ON p.site = z.site AND age >= z_lo AND age < z_hi WHERE is_peak) WHERE fri IS NOT NULL"
    c["zuse"] = "SELECT site, zone, count(*) AS n_fri, avg(fri) AS mfri FROM zfri WHERE t = 4 GROUP BY site, zone HAVING count(*) > 1 AND max(fri) <= 5000"
    c["hist"] = "SELECT u.site, u.zone, CAST(b AS BIGINT) AS bin, (b + 0.5) * 20 AS centre, count(f.fri) AS freq FROM (SELECT *, unnest(range(1, 50)) AS b FROM zuse) u LEFT JOIN zfri f ON f.t = 4 AND f.site = u.site AND f.zone = u.zone AND f.fri >= b * 20 AND f.fri < (b + 1) * 20 GROUP BY ALL"
    # Bootstraps.
    cut = lambda v, q, name: f"quantile_cont({v}, {q}) AS {name}"
    c["bvals"] = "SELECT site, step, step_age, list(fri ORDER BY fri) AS vals, count(*) AS n, avg(fri) AS mean FROM moved GROUP BY ALL HAVING count(*) > 1"
    c["bdraw"] = f"SELECT site, step, list_sum({picks(p.run_id, 'step')}) / n AS m FROM (SELECT *, unnest(range(1, {p.n_boot} + 1)) AS draw FROM bvals)"
    c["bband"] = f"SELECT v.site, v.step, v.n, v.mean, q.lo, q.hi FROM bvals v JOIN (SELECT site, step, {cut('m', 0.025, 'lo')}, {cut('m', 0.975, 'hi')} FROM bdraw GROUP BY ALL) q USING (site, step)"
    c["zvals"] = "SELECT site, zone, list(fri ORDER BY fri) AS vals, count(*) AS n, avg(fri) AS mean FROM zfri WHERE t = 4 GROUP BY ALL HAVING count(*) > 1 AND max(fri) <= 5000"
    c |= weibull("zvals", "zfit", "vals")
    c["zpick"] = f"SELECT site, zone, {picks(p.run_id, 'zone')} AS picks FROM (SELECT *, unnest(range(1, {p.n_boot} + 1)) AS draw FROM zvals)"
    c |= weibull("zpick", "zboot", "picks")
    c["zcut"] = "SELECT site, zone, " + ", ".join(cut(v, q, f"{name}_{end}") for v, name in (("list_avg(picks)", "m"), ("b", "b"), ("c", "c")) for q, end in ((0.025, "lo"), (0.975, "hi"))) + " FROM zboot GROUP BY ALL"
    share = lambda e: f"(1 - exp(-power(({e}) / b, c)))"
    edge = "(floor(vals[k] / 20) * 20)"
    at = f"({share(edge)} + ({share(edge + ' + 20')} - {share(edge)}) * (vals[k] - {edge}) / 20)"
    c["zks"] = f"SELECT *, sqrt(n) * list_max(list_transform(range(1, n + 1), lambda k: greatest(k / n - {at}, {at} - (k - 1) / n))) AS x FROM zfit"
    c["zstat"] = f"SELECT s.site, s.zone, n AS n_fri, mean AS mfri, m_lo AS mfri_uci, m_hi AS mfri_lci, b AS wbl_b, b_lo AS wbl_b_uci, b_hi AS wbl_b_lci, c AS wbl_c, c_lo AS wbl_c_uci, c_hi AS wbl_c_lci, {ks_tail('x')} AS p_ks FROM zks s JOIN zcut q ON s.site = q.site AND s.zone = q.zone"
    c["tvals"] = "SELECT site, t, zone, list(fri ORDER BY fri) AS vals, count(*) AS n, avg(fri) AS mean FROM zfri GROUP BY ALL HAVING count(*) > 1"
    c["tdraw"] = f"SELECT site, t, zone, list_sum({picks(p.run_id, 't, zone')}) / n AS m FROM (SELECT *, unnest(range(1, 1001)) AS draw FROM tvals)"
    c["tband"] = f"SELECT v.site, v.t, v.zone, v.n AS n_fri, v.mean AS mfri, q.lo, q.hi FROM tvals v JOIN (SELECT site, t, zone, {cut('m', 0.025, 'lo')}, {cut('m', 0.975, 'hi')} FROM tdraw GROUP BY ALL) q USING (site, t, zone)"
    return c


#: Flags at every positive bin, in place of those at four thresholds.
ALL_BINS = {"flagged": "SELECT p.site, i, age, p.yr, p.n, cnt, vol, peak, bin AS t, possible AS thr, coalesce(round(peak, 9) > round(possible, 9), false) AS flag FROM peaked p JOIN bins ON p.site = bins.site WHERE possible > 0"}


def sql(p: Params, select: str, instead: dict[str, str] | None = None) -> str:
    """A statement with those CTEs that it needs; instead: other texts for some of them."""
    import re

    all_ = stages(p) | (instead or {})
    need, todo = set(), [select]
    while todo:
        for name in set(re.findall(r"[a-z_0-9]+", todo.pop())) & all_.keys() - need:
            need.add(name)
            todo.append(all_[name])
    body = ",\n".join(f"{n} AS ({t})" for n, t in all_.items() if n in need)
    recursive = "RECURSIVE " if any(n.endswith("_r") for n in need) else ""
    return f"WITH {recursive}{body}\n{select}" if need else select
