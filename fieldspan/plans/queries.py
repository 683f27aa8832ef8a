"""Queries over the test tables, each an operator on a re-reading of them, with SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import named, sinks
from ..model import coerced
from ..operators import attributes, catalog, depth, extract, fill, gaps, intervals, resample, station, trim
from ..operators.qc import mask_flags
from ..session import new_folder, written
from ..sources import archive, catalogs, files, pages
from .station import Limits, station_job

BY = ("station",)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- re-readings of the tables ---------------------------------------------------------

DEPTHS = {"view": 0.05, "signup": 0.1, "click": 0.2, "error": 0.4, "purchase": 0.6}


def observations(spark: SparkSession, sf_dir: str, stations: int = 10) -> DataFrame:
    """Events as observations: users are sensors, kinds are depths, props.k is quality."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    at = F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv])
    flag = F.when(k < 70, "G").when(k < 85, "D01").otherwise("C02")
    return e.select((F.col("user_id") % stations).cast("string").alias("station"), F.col("user_id").cast("string").alias("sensor"), at[F.col("event_type")].alias("depth_to"), "ts", "value", flag.alias("flag"))


def dense_events(spark: SparkSession, sf_dir: str, stations: int = 10) -> DataFrame:
    means = resample.mean_by_depth(mask_flags(observations(spark, sf_dir, stations)), BY)
    return resample.densify(resample.drop_empty_depths(resample.daily(means, BY), BY), BY)


def shipments(spark: SparkSession, sf_dir: str, stations: int = 5) -> DataFrame:
    """Line items as the daily series of depth bins: part size is a depth in cm."""
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).select((F.col("l_suppkey") % stations).cast("string").alias("station"), F.col("p_size").cast("double").alias("depth"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("q"))
    days = rows.groupBy(*BY, "depth", "day").agg(F.avg("q").alias("value"), F.count("q").alias("n"))
    dense = resample.densify(resample.drop_empty_depths(days, BY), BY)
    return depth.mean_by_bin(depth.to_cm(dense, BY), BY)


def order_days(spark: SparkSession, sf_dir: str, leap: bool = True) -> DataFrame:
    """Orders as one daily series per nation; without 29 February if not ``leap``."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    rows = o.join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").cast("string").alias("station"), F.lit("0-10").alias("depth"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    if not leap:
        rows = rows.filter(F.date_format("day", "MM-dd") != "02-29")
    return resample.densify(rows.groupBy(*BY, "depth", "day").agg(F.avg("o_totalprice").alias("value")), BY, ("value",))


OBS_SQL = """obs as (select cast(user_id % {m} as varchar) as station, case event_type when 'view' then 0.05::double when 'signup' then 0.1::double
        when 'click' then 0.2::double when 'error' then 0.4::double when 'purchase' then 0.6::double end as depth, cast(ts as date) as day, ts,
        case when cast(json_extract_string(props, '$.k') as int) < 85 then value end as x from events),
    a1 as (select station, depth, day, ts, avg(x) as v from obs where depth is not null group by all),
    a2 as (select station, depth, day, avg(v) as v, count(v) as n from a1 group by all),
    {dense}"""
DENSE_SQL = """span as (select station, min(day) as a, max(day) as z from a2 group by all),
    held as (select station, depth from a2 group by all having count(v) > 0),
    grid as (select station, depth, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as day from held join span using (station)),
    dense as (select grid.station, grid.depth, grid.day, v, n from grid left join a2 using (station, depth, day))"""
BIN_SQL = "case when depth is null or depth < 0 then 'nan' when depth <= 10 then '0-10' when depth <= 30 then '10-30' when depth <= 50 then '30-50' else '>50' end"
SHIP_SQL = """a2 as (select cast(l_suppkey % {m} as varchar) as station, cast(p_size as double) as depth, cast(l_shipdate as date) as day,
        avg(l_quantity) as v, count(l_quantity) as n from lineitem join part on l_partkey = p_partkey group by all),
    {dense},
    series as (select station, {bin} as depth, day, avg(v) as v from dense group by all)"""
ORDER_SQL = """a2 as (select cast(c_nationkey as varchar) as station, '0-10' as depth, cast(o_orderdate as date) as day, avg(o_totalprice) as v, 1 as n
        from orders join customer on o_custkey = c_custkey where {where} group by all),
    {dense},
    series as (select station, depth, day, v from dense)"""


def obs_sql(m: int = 10) -> str:
    return OBS_SQL.format(m=m, dense=DENSE_SQL)


def ship_sql(m: int = 5) -> str:
    return SHIP_SQL.format(m=m, dense=DENSE_SQL, bin=BIN_SQL)


def order_sql(where: str = "true") -> str:
    return ORDER_SQL.format(where=where, dense=DENSE_SQL)


def runs_sql(state: str, gap: int = -1) -> str:
    """CTE ``best``: the longest run of ``state`` per series, after bridging ``gap`` days."""
    return f"""g1 as (select *, row_number() over (partition by station, depth order by day)
            - row_number() over (partition by station, depth, v is null order by day) as g from series),
    g2 as (select *, v is not null or count(*) over (partition by station, depth, v is null, g) <= {gap} as avail from g1),
    g3 as (select *, {state} as s from g2),
    g4 as (select *, row_number() over (partition by station, depth order by day)
            - row_number() over (partition by station, depth, s order by day) as h from g3),
    g5 as (select station, depth, count(*) as len, min(day) as a, max(day) as z from g4 where s group by station, depth, h),
    g6 as (select *, row_number() over (partition by station, depth order by len desc, a) as rn from g5),
    best as (select d.station, d.depth, coalesce(len, 0)::bigint as run_days, a as run_start, z as run_end
        from (select distinct station, depth from series) d left join g6 on d.station = g6.station and d.depth = g6.depth and rn = 1)"""


def fill_sql(source: str) -> str:
    """CTE ``filled`` from ``source`` (station, depth, day, v)."""
    return f"""f1 as (select *, strftime(day, '%m-%d') as md from {source}),
    f2 as (select *, avg(v) over (partition by station, depth, md) as c from f1),
    f3 as (select *, max(case when md = '02-29' then c end) over (partition by station) is not null as k29,
        max(case when md = '02-28' then c end) over (partition by station) is not null as k28,
        max(case when md = '02-28' then c end) over (partition by station, depth) as c28,
        max(case when md = '03-01' then c end) over (partition by station, depth) as c01 from f2),
    f4 as (select *, coalesce(v, case when md = '02-29' and not k29 then case when k28 then c28 else c01 end else c end) as w from f3),
    filled as (select station, depth, day, w as value, case when v is not null then 0 when w is not null then 1 else 2 end::tinyint as value_qc from f4)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- series ----------------------------------------------------------------------------


@query(f"with {obs_sql()} select station, depth, day, round(case when n >= 6 then v end, 6) as value from a2")
def qc_mask_daily(spark, sf_dir):
    means = resample.mean_by_depth(mask_flags(observations(spark, sf_dir)), BY)
    return rounded(resample.require_count(resample.daily(means, BY), 6), "value")


@query(f"""with {obs_sql(2)} select station, depth, year(day)::bigint as year, sum(case when n >= 3 then 0 else 1 end)::bigint as missing_days
    from dense group by all""")
def dense_missing_per_year(spark, sf_dir):
    return gaps.missing_days_per_year(resample.require_count(dense_events(spark, sf_dir, 2), 3), BY)


@query(f"""with {obs_sql()}, cm as (select *, case when max(depth) over (partition by station) <= 3 then depth * 100 else depth end as d from dense)
    select station, {BIN_SQL.replace("depth", "d")} as depth, day, round(avg(case when n >= 6 then v end), 6) as value from cm group by all""")
def depth_bin_mean(spark, sf_dir):
    days = resample.require_count(dense_events(spark, sf_dir), 6)
    return rounded(depth.mean_by_bin(depth.to_cm(days, BY), BY), "value")


@query(f"with {order_sql()}, {runs_sql('v is null')} select * from best")
def longest_missing_run(spark, sf_dir):
    return gaps.longest_missing_run(order_days(spark, sf_dir), BY)


@query(f"with {order_sql()}, {runs_sql('avail', 7)} select * from best")
def longest_available_run(spark, sf_dir):
    return gaps.longest_available_run(order_days(spark, sf_dir), 7, BY)


@query(f"""with {order_sql()}, {runs_sql('avail', 3)} select station, depth, count(*) filter (where v is not null)::bigint as observed,
    count(*) filter (where avail)::bigint as bridged from g2 group by all""")
def bridge_gaps(spark, sf_dir):
    marked = gaps.bridge_gaps(order_days(spark, sf_dir), 3, BY)
    return marked.groupBy(*BY, "depth").agg(F.count("value").alias("observed"), F.count_if("available").alias("bridged"))


@query(f"""with {ship_sql()}, {runs_sql('avail', 4)},
    k as (select *, max(run_days) over (partition by station) as m from best),
    p as (select station, depth, max(run_start) over (partition by station) as s, min(run_end) over (partition by station) as e
        from k where run_days > 0 and run_days >= 0.15 * m)
    select series.station, series.depth, day, round(v, 6) as value from series join p using (station, depth) where day between s and e""")
def trim_common_period(spark, sf_dir):
    s = shipments(spark, sf_dir)
    return rounded(trim.trim_to_common_period(s, gaps.longest_available_run(s, 4, BY), 0.15, BY), "value")


SURFACE_SQL = """w as (select station, run_start as s, run_end as e from best where depth = '0-10' and run_days > 0),
    inside as (select series.* from series join w using (station) where day >= s and day < e),
    trimmed as (select station, depth, day, v from (select *, avg(case when v is null then 0.0 else 1.0 end) over (partition by station, depth) as f
        from inside) where f >= {frac})"""


@query(f"with {ship_sql()}, {runs_sql('avail', 2)}, {SURFACE_SQL.format(frac=0.3)} select station, depth, day, round(v, 6) as value from trimmed")
def trim_surface_coverage(spark, sf_dir):
    s = shipments(spark, sf_dir)
    return rounded(trim.trim_to_surface_window(s, gaps.longest_available_run(s, 2, BY), 0.3, by=BY), "value")


@query(f"with {order_sql()}, {fill_sql('series')} select station, depth, day, round(value, 6) as value, value_qc from filled")
def gapfill_climatology(spark, sf_dir):
    return rounded(fill.fill_from_climatology(order_days(spark, sf_dir), BY), "value")


NO_LEAP = "strftime(o_orderdate, '%m-%d') <> '02-29'"


@query(f"""with {order_sql(NO_LEAP)}, {fill_sql('series')} select station, depth, day, round(value, 6) as value, value_qc from filled
    where strftime(day, '%m-%d') = '02-29'""")
def feb29_fallback(spark, sf_dir):
    filled = fill.fill_from_climatology(order_days(spark, sf_dir, leap=False), BY)
    return rounded(filled.filter(F.date_format("day", "MM-dd") == "02-29"), "value")


WINDOWS = ("1993-02-28", "1996-03-01", "1994-07-15", "1997-02-28", "1992-01-01", "1998-12-31")
WINDOW_SQL = "union all ".join(f"""select {i} as win, * from (with win as (select * from series where day between date '{a}' and date '{z}'), {fill_sql("win")}
    select station, depth, day, round(value, 6) as value, value_qc from filled) """ for i, (a, z) in enumerate(zip(WINDOWS[::2], WINDOWS[1::2], strict=True)))


@query(f"with {order_sql()} {WINDOW_SQL}")
def gapfill_windows(spark, sf_dir):
    """Three windows of each station, filled from one table of running sums."""
    s = written(order_days(spark, sf_dir))
    sums, out = written(fill.climatology_sums(s, BY)), None
    for i, (a, z) in enumerate(zip(WINDOWS[::2], WINDOWS[1::2], strict=True)):
        windows = s.select(*BY).distinct().select(*BY, F.lit(a).cast("date").alias("start"), F.lit(z).cast("date").alias("end"))
        part = rounded(fill.fill_window(s, sums, windows, BY), "value").select(F.lit(i).alias("win"), *BY, "depth", "day", "value", "value_qc")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {ship_sql()} select station, depth, round(avg(case when v is null then 0.0 else 1.0 end), 6) as coverage from series group by all")
def coverage(spark, sf_dir):
    return rounded(trim.coverage(shipments(spark, sf_dir), BY), "coverage")


def shipment_job(spark: SparkSession, sf_dir: str):
    """Line items as raw observations: station 0 is dense, 4 and 5 less so, 6 has its
    shallow sensors 10 cm deeper, 7 only bad flags, and 1 to 3 have no rows."""
    obs, stations = shipment_rows(spark, sf_dir)
    return station_job(obs, stations, JOB_LIMITS, BY, hold=True)


JOB_LIMITS = Limits(min_obs=1, max_gap_days=7, min_frac=0.2, min_days=400)


def shipment_rows(spark: SparkSession, sf_dir: str, dense: int = 4) -> tuple[DataFrame, DataFrame]:
    """Observations and stations; the suppliers that make up station 0 are ``dense`` of 8."""
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.when(F.col("l_suppkey") % 8 < dense, 0).otherwise(F.col("l_suppkey") % 8)
    obs = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        k.cast("string").alias("station"), F.col("l_suppkey").cast("string").alias("sensor"), (F.col("p_size") + F.when((k == 6) & (F.col("p_size") <= 10), 10).otherwise(0)).cast("double").alias("depth_to"),
        F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"), F.when(k == 7, "C01").otherwise("G").alias("flag"),
    )
    stations = spark.range(8).select(F.col("id").cast("string").alias("station"), (F.col("id") * 1.5).alias("latitude"), (F.col("id") * 2.5).alias("longitude"))
    return obs, stations


STATUS_SQL = f"""with obs as (select case when l_suppkey % 8 < 4 then 0 else l_suppkey % 8 end as k,
        cast(p_size + case when l_suppkey % 8 = 6 and p_size <= 10 then 10 else 0 end as double) as depth, cast(l_shipdate as date) as day, l_shipdate as ts,
        case when l_suppkey % 8 <> 7 then l_quantity end as x from lineitem join part on l_partkey = p_partkey),
    a1 as (select cast(k as varchar) as station, depth, day, ts, avg(x) as v from obs group by all),
    a2 as (select station, depth, day, avg(v) as v, count(v) as n from a1 group by all),
    {DENSE_SQL},
    cm as (select *, case when max(depth) over (partition by station) <= 3 then depth * 100 else depth end as d from dense),
    series as (select station, {BIN_SQL.replace("depth", "d")} as depth, day, avg(case when n >= 1 then v end) as v from cm group by all),
    {runs_sql('avail', 7)}, {SURFACE_SQL.format(frac=0.2)}, {fill_sql('trimmed')},
    found as (select station, max(depth) as max_depth from held group by all),
    days as (select station, min(day) as a, max(day) as z, count(distinct day) as n_days from trimmed where v is not null group by all),
    fin as (select station, count(*) filter (where value is null) as bad, string_agg(distinct depth, ',' order by depth) as depths from filled group by all),
    st as (select cast(i as varchar) as station, i * 1.5::double as lat, i * 2.5::double as lon from range(8) r(i)),
    s as (select st.*, max_depth, a, z, coalesce(n_days, 0) as n_days, depths, case when found.station is null then 1 when w.station is null then 2
        when coalesce(n_days, 0) < 400 then 4 when bad > 0 then 5 else 6 end as step
        from st left join found using (station) left join w using (station) left join days using (station) left join fin using (station))
    select station, case when step = 6 then 'saved' else 'skipped' end as status,
        case step when 1 then '{station.NO_DATA}' when 2 then '{station.NO_SURFACE}' when 4 then '{station.TOO_SHORT}'
            when 5 then '{station.STILL_NULL}' else '' end as remark,
        case when step >= 2 then lat end as latitude, case when step >= 2 then lon end as longitude,
        case when step >= 4 then strftime(a, '%Y%m%d') end as start_date, case when step >= 4 then strftime(z, '%Y%m%d') end as end_date,
        case when step >= 4 then n_days end::bigint as n_days, case when step >= 6 then max_depth * 100 end as max_depth_cm,
        case when step >= 6 then depths end as depths,
        case when step >= 6 then station || '_' || strftime(a, '%Y%m%d') || '_' || strftime(z, '%Y%m%d') end as filename from s"""


@query(STATUS_SQL)
def station_status(spark, sf_dir):
    return shipment_job(spark, sf_dir).status.withColumn("depths", F.concat_ws(",", "depths")).withColumn("depths", F.when(F.col("status") == "saved", F.col("depths")))


@query(f"select status, remark, count(*)::bigint as stations from ({STATUS_SQL}) group by all")
def status_totals(spark, sf_dir):
    return station.totals(shipment_job(spark, sf_dir).status)


@query(STATUS_SQL.rsplit("select station, case", 1)[0] + """select filled.station, depth, count(*)::bigint as n_days, count(*) filter (where value_qc = 1)::bigint as n_filled,
    round(avg(value), 6) as mean_value from filled join s using (station) where step = 6 group by all""")
def saved_series(spark, sf_dir):
    saved = shipment_job(spark, sf_dir).saved
    return rounded(saved.groupBy(*BY, "depth").agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("value_qc") == 1).alias("n_filled"), F.avg("value").alias("mean_value")), "mean_value")


# --- catalogues ------------------------------------------------------------------------


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a raw tower catalogue, numbers as text."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    text = lambda e: e.cast("string")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(
        k.alias("site_id"), F.col("c_mktsegment").alias("igbp"), F.col("n_name").alias("country"), text(F.col("c_acctbal")).alias("latitude"),
        text(k % 360 - 180).alias("longitude"), F.when(k % 2 == 0, "CCBY4.0").otherwise("LEGACY").alias("data_policy"),
        F.when(k % 3 == 0, text(2000 + k % 20)).alias("tower_end"),
        F.array(text(1990 + k % 20), F.lit("x"), text(1995 + k % 20)).alias("base_data"),
        F.array(text(2010 + k % 8), text(2012 + k % 8), text(2012 + k % 8), F.lit("n/a")).alias("flux_data"),
    )


TOWER_SQL = """t as (select c_custkey as k, c_mktsegment, n_name, c_acctbal as lat, (c_custkey % 360 - 180)::double as lon from customer join nation on c_nationkey = n_nationkey)"""


@query(f"""with {TOWER_SQL} select k as "SITE_ID", (1990 + k % 20)::double as "DATA_START", (1995 + k % 20)::double as "DATA_END",
    (2010 + k % 8)::double as "FLUX_START", (2012 + k % 8)::double as "FLUX_END" from t where c_mktsegment in ('BUILDING', 'MACHINERY')
    and lat between 0 and 5000 and lon between -100 and 100 and k % 2 = 0 and k % 3 <> 0
    and (case when 2010 + k % 8 between 2013 and 2015 then 1 else 0 end) + (case when 2012 + k % 8 between 2013 and 2015 then 2 else 0 end) >= 2""")
def site_filter_towers(spark, sf_dir):
    sites = catalog.tower_catalog(towers(spark, sf_dir), "flux_data")
    kept = catalog.filter_towers(sites, igbp=["BUILDING", "MACHINERY"], country=[], lat_range=(0, 5000), lon_range=(-100, 100), data_policy=["CCBY4.0"], min_years=5, flux_only=True, flux_year_range=(2013, 2015), min_flux_years=2, active_only=True)
    return kept.select("SITE_ID", "DATA_START", "DATA_END", "FLUX_START", "FLUX_END")


@query("""select c_custkey as "SITE_ID", n_name as "COUNTRY", c_acctbal as "LOCATION_LAT" from customer join nation on c_nationkey = n_nationkey
    where c_custkey % 4 = 0 and n_nationkey < 10 and c_acctbal between -500 and 9000 and c_mktsegment in ('BUILDING', 'AUTOMOBILE')""")
def site_filter_stations(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    raw = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("country"), F.when(F.col("c_custkey") % 4 == 0, "ES").otherwise("AS").alias("theme"), F.col("c_mktsegment").alias("siteType"), F.col("c_acctbal").cast("string").alias("lat"))
    names = [r[0] for r in n.filter("n_nationkey < 10").select("n_name").collect()]  # at most ten names
    kept = catalog.filter_stations(catalog.station_catalog(raw), country=names, site_type=["BUILDING", "AUTOMOBILE"], lat_range=(-500, 9000))
    return kept.select("SITE_ID", "COUNTRY", "LOCATION_LAT")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as data objects that last from the order to one of its shipments."""
    o = load(spark, sf_dir, "orders")
    last = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    utc = lambda c: c.cast("timestamp")
    return o.join(last, o["o_orderkey"] == last["l_orderkey"]).select(
        F.concat(F.lit("http://meta.example.org/objects/"), "o_orderkey").alias("uri"), F.concat(F.lit("http://meta.example.org/stations/ES_S-"), (F.col("o_custkey") % 50).cast("string"), F.lit("_1")).alias("station_uri"),
        utc(F.least("o_orderdate", "s")).alias("time_start"), utc(F.greatest("o_orderdate", "s")).alias("time_end"), F.col("o_orderkey").alias("ord"),
    )


@query("""with o as (select 'S-' || (o_custkey % 50)::varchar || '_1' as id, o_orderkey, least(o_orderdate, s) as a, greatest(o_orderdate, s) as z
        from orders join (select l_orderkey, max(l_shipdate) as s from lineitem group by all) on o_orderkey = l_orderkey),
    w as (select * from o where z >= timestamp '1996-01-01' and a <= timestamp '1998-12-31'),
    y as (select id, unnest(generate_series(greatest(year(a), 1996), least(year(z), 1998))) as y from w),
    ys as (select id, count(distinct y)::bigint as n, string_agg(distinct y::varchar, ',' order by y::varchar) as years from y group by all),
    us as (select id, md5(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as u, count(*)::bigint as c from w group by all)
    select id as "SITE_ID", n as "N_YEARS", years as "YEARS", c as n_objects, u as objects from ys join us using (id) where n >= 2""")
def inventory_years(spark, sf_dir):
    inv = catalog.inventory(objects(spark, sf_dir), None, (1996, 1998), 2)
    keys = F.array_join(F.transform("DATA_OBJECTS", lambda u: F.element_at(F.split(u, "/"), -1)), ",")
    return inv.select("SITE_ID", "N_YEARS", F.concat_ws(",", F.col("YEARS").cast("array<string>")).alias("YEARS"), F.size("DATA_OBJECTS").cast("long").alias("n_objects"), F.md5(keys).alias("objects"))


@query("""select 'S-' || (o_custkey % 50)::varchar || '_1' as id, 'http://data.example.org/objects/' || o_orderkey::varchar as url
    from orders where o_orderkey in (select l_orderkey from lineitem)""")
def object_addresses(spark, sf_dir):
    o = objects(spark, sf_dir)
    return o.select(catalog.id_of_uri(F.col("station_uri")).alias("id"), catalog.swapped_host(F.col("uri"), "meta.example.org", "data.example.org").alias("url"))


@query("""select c_custkey as "SITE_ID" from customer where c_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1996-06-01')""")
def missing_ids(spark, sf_dir):
    ids = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("SITE_ID"))
    had = load(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz"))
    return catalog.missing_ids(ids, had.select(F.col("o_custkey").alias("SITE_ID")))


@query("""with w as (select c_custkey as asked, c_nationkey as nation, timestamp '1992-01-01' + interval 1 day * (c_custkey * 37 % 2400) as s,
        timestamp '1992-01-01' + interval 1 day * (c_custkey * 37 % 2400 + case when c_custkey % 50 = 0 then 20000 else c_custkey % 90 end) as e from customer),
    o as (select o_orderkey as object, c_nationkey as nation, least(o_orderdate, l) as a, greatest(o_orderdate, l) as z from orders join customer on o_custkey = c_custkey
        join (select l_orderkey, max(l_shipdate) as l from lineitem group by all) on o_orderkey = l_orderkey)
    select asked, object from o join w on o.nation = w.nation and a <= e and s <= z""")
def overlap_windows(spark, sf_dir):
    """Objects within the windows that customers of their nation ask for, some very long."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asked"), F.col("c_nationkey").alias("nation"))
    k, day = F.col("asked"), F.expr("interval 1 day")
    first = F.lit("1992-01-01").cast("timestamp")
    windows = c.select("asked", "nation", (first + day * (k * 37 % 2400)).alias("s"), (first + day * (k * 37 % 2400 + F.when(k % 50 == 0, 20000).otherwise(k % 90))).alias("e"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c.select(F.col("asked").alias("o_custkey"), "nation"), "o_custkey")
    objs = objects(spark, sf_dir).select(F.col("ord").alias("object"), "time_start", "time_end")
    objs = objs.join(o.select(F.col("o_orderkey").alias("object"), "nation"), "object")
    return intervals.overlap_join(objs, windows, ("time_start", "time_end"), ("s", "e"), ["nation"], "60 days").select("asked", "object")


@query("""select c_custkey as "SITE_ID", c_name as name, c_acctbal as balance, ((row_number() over (order by c_custkey) - 1) // 10)::bigint as batch from customer""")
def batch_ids(spark, sf_dir):
    return catalog.batches(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("SITE_ID"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), ["SITE_ID"])


@query("""select c_custkey as "SITE_ID", c_name as name, ((row_number() over (order by c_custkey) - 1) // 10)::bigint as batch from customer
    where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')""")
def download_plan(spark, sf_dir):
    ids = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("SITE_ID"), F.col("c_name").alias("name"))
    have = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("SITE_ID"))
    return catalog.download_plan(ids, have)


@query("""with o as (select 'S-' || (o_custkey % 50)::varchar || '_1' as id, o_orderkey, least(o_orderdate, s) as a, greatest(o_orderdate, s) as z
        from orders join (select l_orderkey, max(l_shipdate) as s from lineitem group by all) on o_orderkey = l_orderkey),
    y as (select id, count(distinct y)::bigint as n, string_agg(distinct y::varchar, ',' order by y::varchar) as years
        from (select id, unnest(generate_series(year(a), year(z))) as y from o) group by all),
    r as (select c_custkey as request, 'S-' || (c_custkey % 70)::varchar || '_1' as id from customer)
    select request, id as "SITE_ID", n as "N_YEARS", years as "YEARS" from r join y using (id)""")
def requested_inventory(spark, sf_dir):
    """A request list that repeats sites and names some without objects."""
    asked = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.concat(F.lit("S-"), F.col("c_custkey") % 70, F.lit("_1")).alias("SITE_ID"))
    inv = catalog.inventory(objects(spark, sf_dir), asked)
    return inv.select("request", "SITE_ID", "N_YEARS", F.concat_ws(",", F.col("YEARS").cast("array<string>")).alias("YEARS"))


@query("""select 0 as spec, o_orderkey as object, o_totalprice as price from orders where o_orderstatus = 'F'
    union all select 1, o_orderkey, null from orders where o_orderstatus = 'O'
    union all select 2, o_orderkey, o_totalprice from orders where o_orderstatus not in ('F', 'O') or o_orderstatus is null""")
def linked_objects(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    rest = o.filter("o_orderstatus not in ('F', 'O') or o_orderstatus is null")
    every = catalogs.link_objects([o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'").drop("price"), rest])
    return every.select(F.col("ord.spec").alias("spec"), "object", "price")


@query("select c_custkey from customer order by md5('42:' || c_custkey::varchar), c_custkey limit 100")
def seeded_sample(spark, sf_dir):
    return catalog.seeded_sample(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("""select o_custkey, arg_max(o_orderkey, (o_orderdate, 'f' || o_orderkey::varchar)) as newest from orders group by all""")
def newest_file(spark, sf_dir):
    f = load(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return catalog.newest(f, ["o_custkey"]).select("o_custkey", F.substring("path", 2, 20).cast("long").alias("newest"))


@query("""select name, coalesce(nullif(regexp_extract(replace(name, '.csv', ''), '(?:^|_)(HH|DD|WW|MM|YY)(?:_|$)', 1), ''), 'OTHER') as resolution
    from (select 'X' || p_partkey::varchar || '_' || (['HH', 'DD', 'WW', 'MM', 'YY', 'ZZ', 'DDX'])[p_partkey % 7 + 1] || '_a.csv' as name from part)""")
def classify_files(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("HH", "DD", "WW", "MM", "YY", "ZZ", "DDX")])
    k = F.col("p_partkey")
    names = load(spark, sf_dir, "part").select(F.concat(F.lit("X"), k, F.lit("_"), F.element_at(kinds, (k % 7 + 1).cast("int")), F.lit("_a.csv")).alias("name"))
    return files.classify(names, "name")


# --- attributes and text ---------------------------------------------------------------


def attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("SITE_ID"), (F.col("user_id") % 7).cast("string").alias("GROUP_ID"), F.lit("G").alias("VARIABLE_GROUP"), F.col("event_type").alias("VARIABLE"), F.col("event_id").cast("string").alias("DATAVALUE"), F.col("event_id").alias("ord"))


@query("""select user_id::varchar as "SITE_ID", (user_id % 7)::varchar as "GROUP_ID", max(event_id) filter (where event_type = 'view')::varchar as view,
    max(event_id) filter (where event_type = 'click')::varchar as click, max(event_id) filter (where event_type = 'error')::varchar as error
    from events where event_type in ('view', 'click', 'error') group by all""")
def eav_pivot_latest(spark, sf_dir):
    return attributes.pivot_groups(attribute_rows(spark, sf_dir), ["view", "click", "error"]).drop("VARIABLE_GROUP")


@query("""select user_id::varchar as "SITE_ID", (user_id % 7)::varchar as "GROUP_ID", string_agg(event_type || '=' || e::varchar, ';' order by event_type) as variables
    from (select user_id, event_type, max(event_id) as e from events group by all) group by user_id""")
def attribute_maps(spark, sf_dir):
    """Groups of whatever variables there are, as maps."""
    maps = attributes.group_maps(attribute_rows(spark, sf_dir))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("variables")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return maps.select("SITE_ID", "GROUP_ID", shown.alias("variables"))


#: Keys of customers in the workbooks of one range: a third of them, with two rows each, are
#: a sheet, whose format ends at 1,048,576 rows.
BOOK_KEYS = 1_500_000


@query("""select site as "SITE_ID", 'G' as "VARIABLE_GROUP", c_custkey::varchar as "GROUP_ID", v as "VARIABLE", case v when 'NAME' then c_name else c_mktsegment end as "DATAVALUE"
    from (select *, 'S' || (c_custkey % 3)::varchar as site from customer), (select unnest(['NAME', 'SEGMENT']) as v)""")
def attribute_sheets(spark, sf_dir):
    """Sheets of zipped workbooks of three sites, with no more rows than a sheet may have."""
    path, k = new_folder(spark), F.col("c_custkey")
    names = ["SITE_ID", "GROUP_ID", "VARIABLE_GROUP", "VARIABLE", "DATAVALUE"]
    c = load(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("S"), k % 3).alias("site"), F.floor(k / BOOK_KEYS).alias("book"), k, F.explode(F.create_map(F.lit("NAME"), "c_name", F.lit("SEGMENT"), "c_mktsegment")).alias("v", "x"))

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        system, root = archive.opened(path)
        system.create_dir(root)
        cell = lambda i, t: f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>{t}</t></is></c>'
        line = lambda cells: "<row>" + "".join(cell(i, t) for i, t in enumerate(cells) if t != "") + "</row>"
        book, n = io.BytesIO(), 0
        with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="META" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            with z.open("xl/worksheets/sheet1.xml", "w") as out:
                out.write(f"<worksheet><sheetData>{line(names)}".encode())
                for b in batches:
                    # the first site leaves its id to the name of the archive
                    out.write("".join(line(["" if r["site"] == "S0" else r["site"], r["c_custkey"], "G", r["v"], r["x"]]) for r in b.to_pylist()).encode())
                    n += b.num_rows
                out.write(b"</sheetData></worksheet>")
        with system.open_output_stream(f"{root}/{key[0].as_py()}_BASE_{key[1].as_py()}.zip") as f, zipfile.ZipFile(f, "w") as z:
            z.writestr("book.xlsx", book.getvalue())
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    rows.groupBy("site", "book").applyInArrow(pack, "n long").count()
    return catalogs.read_attributes(spark, path, "META").drop("ord")


@query("""select c_custkey as "SITE_ID", n_name as "COUNTRY", c_acctbal as "LOCATION_LAT", case when c_custkey % 3 = 0 then '1' end as "ICOS_CLASS", 'http://x/ES_S-' || c_custkey::varchar as "URI"
    from customer join nation on c_nationkey = n_nationkey order by 1 limit 10""")
def station_preview(spark, sf_dir):
    """The first ten of a station list under its catalogue names: a preview, so ten rows are what is asked for."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    raw = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(k.alias("id"), F.col("n_name").alias("country"), F.col("c_acctbal").cast("string").alias("lat"), F.when(k % 3 == 0, "1").alias("icosclass"), F.concat(F.lit("http://x/ES_S-"), k).alias("uri"))
    return catalog.station_catalog(raw).select("SITE_ID", "COUNTRY", "LOCATION_LAT", "ICOS_CLASS", "URI").orderBy("SITE_ID").limit(10)


@query("""select p_brand as "SITE_ID", string_agg(a::varchar || '-' || b::varchar, ';' order by a, b) as ranges from
    (select distinct p_brand, p_size as a, p_size + p_partkey % 5 as b from part where p_partkey % 11 <> 0) group by all""")
def depth_ranges(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    g = load(spark, sf_dir, "part").select(F.col("p_brand").alias("SITE_ID"), F.concat(s, F.lit(".9")).alias("lo"), F.when(k % 11 == 0, "x").otherwise((s + k % 5).cast("string")).alias("hi"))
    return attributes.depth_ranges(g, "lo", "hi").select("SITE_ID", F.concat_ws(";", "ranges").alias("ranges"))


@query("""with e as (select user_id, event_id, value, case when event_id % 5 = 0 then 0 else strftime(ts, '%Y%m%d')::bigint end as d from events
        where event_id % 3 <> 2), r as (select *, row_number() over (partition by user_id order by d desc, event_id) as rn from e)
    select user_id::varchar as "SITE_ID", value as height, case when event_id % 5 = 0 then 'unknown' else d::varchar end as date from r where rn = 1""")
def latest_mean(spark, sf_dir):
    e, k = load(spark, sf_dir, "events"), F.col("event_id")
    g = e.select(F.col("user_id").cast("string").alias("SITE_ID"), F.col("value").cast("string").alias("height"), F.when(k % 3 == 0, "mean").when(k % 3 == 1, "Mean").otherwise("max").alias("stat"), F.when(k % 5 == 0, "unknown").otherwise(F.date_format("ts", "yyyyMMdd")).alias("date"), k.alias("ord"))
    return attributes.latest_mean(g, "height", "stat", "date")


@query("""select page_id as id, 'it''s ' || page_id::varchar as name from pages""")
def embedded_json(spark, sf_dir):
    rows = F.concat(F.lit("<script>const sites = '[{\"id\": "), "page_id", F.lit(", \"name\": \"it\\'s "), "page_id", F.lit("\"}]';</script>"))
    pages = load(spark, sf_dir, "pages").select(F.concat("html", rows).alias("html"))
    return catalogs.sites_from_page(pages, "sites", "id bigint, name string")


@query("""select event_id, case when event_id % 4 = 0 then null else cast(json_extract_string(props, '$.k') as double) end as k from events""")
def json_props(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "abc").otherwise(F.get_json_object("props", "$.k")).alias("k"))
    return coerced(e, ["k", "absent"])


#: Keys of parts in one report, so that reports grow in number and not in length.
REPORT_KEYS = 500


def reports(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """Parts as report lines, a report per brand and range of keys."""
    part = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    site = F.concat("p_brand", F.lit("/"), F.floor(k / REPORT_KEYS))
    rows = part.select(site.alias("SITE_ID"), F.struct(k.alias("k"), line(k, F.col("p_size")).alias("line")).alias("l"))
    return rows.groupBy("SITE_ID").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


def _depths(facts: DataFrame, *more: str) -> DataFrame:
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda d: F.format_string("%.2f", d))), ",")
    return facts.select("SITE_ID", text("SWC_DEPTHS_M").alias("swc"), text("TS_DEPTHS_M").alias("ts"), *more)


@query(f"""with p as (select p_brand || '/' || (p_partkey // {REPORT_KEYS})::varchar as id, p_partkey as k, p_size as s from part)
    select id as "SITE_ID", coalesce(string_agg(distinct printf('-%.2f', s / 100.0), ',' order by printf('-%.2f', s / 100.0)) filter (where k % 4 = 0), '') as swc,
        coalesce(string_agg(distinct printf('-%.2f', s / 100.0), ',' order by printf('-%.2f', s / 100.0)) filter (where k % 4 = 1), '') as ts,
        arg_min(s, k) filter (where k % 4 = 2)::double as "MEASUREMENT_HEIGHT_M", arg_min(s, k) filter (where k % 4 = 3)::double as "CANOPY_HEIGHT_M"
    from p group by all""")
def report_facts(spark, sf_dir):
    def line(k, s):
        d = F.format_string("-%.2f", s / 100.0)
        row, code = F.concat(F.lit("probe x "), d, F.lit(" 2.5 3 SWC_1_1_1")), F.concat(F.lit("th "), d, F.lit(" 1 -2 TS_1_2_1 "))
        return F.when(k % 4 == 0, row).when(k % 4 == 1, code).when(k % 4 == 2, F.concat(F.lit("HEIGHT (m) "), s, F.lit(" 3"))).otherwise(F.concat(F.lit("the Canopy height is about "), s, F.lit(" m")))

    return _depths(extract.report_facts(reports(spark, sf_dir, line)), "MEASUREMENT_HEIGHT_M", "CANOPY_HEIGHT_M")


@query(f"""with p as (select p_brand || '/' || (p_partkey // {REPORT_KEYS})::varchar as id, p_partkey as k, case when p_partkey % 5 = 1 then -p_size / 100.0 end as own from part),
    n as (select *, coalesce(lag(own) over w, own, lead(own, 1) over w, lead(own, 2) over w) as near from p window w as (partition by id order by k)),
    d as (select *, printf('%.2f', near) as d from n where near is not null)
    select id as "SITE_ID", coalesce(string_agg(distinct d, ',' order by d) filter (where k % 5 in (0, 3)), '') as swc,
        coalesce(string_agg(distinct d, ',' order by d) filter (where k % 5 = 2), '') as ts
    from (select distinct id from p) left join d using (id) group by all""")
def nearby_depths(spark, sf_dir):
    """Codes that take their depth from the lines around them, and codes inside prose."""

    def line(k, s):
        three = F.concat(F.format_string("-%.2f", s / 100.0), F.lit(" 2.5 3.5"))
        return F.when(k % 5 == 0, "probe SWC_1_1_1").when(k % 5 == 1, three).when(k % 5 == 2, "TS_1_2_1 is here").when(k % 5 == 3, "both SWC_2_1_1 and TS_9_1_1, of which the first counts").otherwise("prose")

    return _depths(extract.report_facts(reports(spark, sf_dir, line)))


@query(r"""with l as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]') as ls from documents),
    k as (select doc_id, case when ls[-1] = '' then ls[:-2] else ls end as ls from l)
    select doc_id, unnest(range(len(ls)))::integer as line_no, length(unnest(ls))::integer as chars from k""")
def report_lines(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return extract.split_lines(docs, keep=["doc_id"]).select("doc_id", "line_no", F.length("line").alias("chars"))


@query("""select c_custkey as id, c_name as name, null::double as balance from customer
    union all select s_suppkey, s_name, s_acctbal from supplier""")
def union_records(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return sinks.union_records([c, s])


@query("""select c_custkey as "SITE_ID", case when c_custkey % 6 = 1 then printf('%.2f', (c_custkey % 90 + 1) / 100.0) else '' end as swc,
    case when c_custkey % 6 = 3 then printf('-%.2f', (c_custkey % 90 + 1) / 100.0) else '' end as ts,
    case when c_custkey % 6 > 3 then 'empty text' end as "ERROR" from customer""")
def depth_rules(spark, sf_dir):
    """Reports of one line: signs of sensor rows, depths out of range, blank and null texts."""
    return _depths(extract.report_facts(one_liners(spark, sf_dir)), "ERROR")


@query("select count(*) filter (where c_custkey % 6 <= 3)::bigint as n_ok, count(*) filter (where c_custkey % 6 > 3)::bigint as n_error from customer")
def report_outcome(spark, sf_dir):
    return extract.outcome(extract.report_facts(one_liners(spark, sf_dir)))


def one_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = F.format_string("%.2f", (k % 90 + 1) / 100.0)
    text = F.when(k % 6 == 0, F.concat(F.lit("a "), d, F.lit(" 2 3 TS_1_1_1"))).when(k % 6 == 1, F.concat(F.lit("a "), d, F.lit(" 2 3 SWC_1_1_1")))
    text = text.when(k % 6 == 2, "-4.5 2 3 TS_1_1_1 here").when(k % 6 == 3, F.concat(F.lit("-"), d, F.lit(" 2 3 TS_1_1_1 here"))).when(k % 6 == 4, "  ")
    return load(spark, sf_dir, "customer").select(k.alias("SITE_ID"), text.alias("text"))


@query("""select c_name as station_id, o_orderkey as object, 'Step2 ' || case when o_orderkey % 3 = 0 then 'LABELLING' else 'Labelling' end || ' report' as name
    from orders join customer on o_custkey = c_custkey where o_orderkey % 3 < 2""")
def labelling_select(spark, sf_dir):
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    word = F.when(k % 3 == 0, "LABELLING").when(k % 3 == 1, "Labelling").otherwise("other")
    names = o.select(k.alias("object"), F.concat(F.lit("Step2 "), word, F.lit(" report")).alias("name"))
    stations = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"), F.col("c_name").alias("station_id"))
    return catalogs.labelling_documents(o.select(k.alias("object"), F.col("o_custkey").alias("station")), names, stations)


@query("select p_partkey, 'S-' || p_partkey::varchar as id from part")
def file_ids(spark, sf_dir):
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(k, catalog.id_of_file(F.concat(F.lit("S-"), k, F.lit("_HH_2020.csv"))).alias("id"))


# --- files written and read again ------------------------------------------------------


@query("""select o_orderkey as "KEY", date_trunc('day', o_orderdate)::timestamp as "TIMESTAMP", case when o_orderkey % 7 <> 0 then o_totalprice end as "VALUE" from orders""")
def tower_files(spark, sf_dir):
    path, k = new_folder(spark), F.col("o_orderkey")
    value = F.when(k % 7 == 0, -9999.0).otherwise(F.col("o_totalprice"))
    load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("TIMESTAMP"), k.cast("long").alias("KEY"), value.alias("VALUE")).write.csv(path, header=True)
    df = files.read_tower_csv(spark, path)
    return df.select(F.col("KEY").cast("long").alias("KEY"), "TIMESTAMP", "VALUE")


@query("""select event_id::double as "EVENT", date_trunc('minute', ts)::timestamp as "TIMESTAMP", case when event_id % 9 <> 0 then value end as "VALUE", event_type as "KIND" from events""")
def station_files(spark, sf_dir):
    """Records with a comment at the end of some lines."""
    path, k = new_folder(spark), F.col("event_id")
    kind = F.concat("event_type", F.when(k % 2 == 0, " # checked").otherwise(""))
    rows = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMddHHmm").alias("TIMESTAMP"), k.alias("EVENT"), F.when(k % 9 == 0, -9999.0).otherwise(F.col("value")).alias("VALUE"), kind.alias("KIND"))
    rows.write.csv(path, header=True)
    return files.read_station_csv(spark, path)


@query("""select c_custkey, '["' || c_name || '","' || c_mktsegment || '"]' as names from customer""")
def table_files(spark, sf_dir):
    path, c = new_folder(spark), load(spark, sf_dir, "customer")
    sinks.write_table(c.select("c_custkey", F.array("c_name", "c_mktsegment").alias("names"), "c_acctbal"), path, drop=["c_acctbal"])
    return spark.read.schema("c_custkey long, names string").csv(path, header=True, escape='"')


@query(f"with {order_sql()} select station, depth, count(*)::bigint as n_days, count(v)::bigint as n_values, round(avg(v), 6) as mean_value from series group by all")
def series_files(spark, sf_dir):
    path = new_folder(spark)
    sinks.write_series(order_days(spark, sf_dir), path, BY)
    saved = spark.read.schema("depth string, day date, value double, station string").parquet(path)
    return rounded(saved.groupBy(*BY, "depth").agg(F.count(F.lit(1)).alias("n_days"), F.count("value").alias("n_values"), F.avg("value").alias("mean_value")), "mean_value")


@query("""select o_orderkey as "KEY", date_trunc('day', o_orderdate)::timestamp as "TIMESTAMP", case when o_orderkey % 7 <> 0 then o_totalprice end as "VALUE",
    case when o_orderkey % 3 = 2 then o_orderstatus end as "STATUS" from orders""")
def tower_folder(spark, sf_dir):
    """A folder whose files have their columns in different orders, and some one more."""
    path, k = new_folder(spark), F.col("o_orderkey")
    value = F.when(k % 7 == 0, -9999.0).otherwise(F.col("o_totalprice"))
    rows = load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("TIMESTAMP"), k.cast("long").alias("KEY"), value.alias("VALUE"), F.col("o_orderstatus").alias("STATUS"))
    for i, names in enumerate((["TIMESTAMP", "KEY", "VALUE"], ["VALUE", "TIMESTAMP", "KEY"], ["KEY", "STATUS", "VALUE", "TIMESTAMP"])):
        rows.filter(F.col("KEY") % 3 == i).select(*names).write.mode("append").csv(path, header=True)
    df = files.read_tower_csv(spark, path)
    return df.select(F.col("KEY").cast("long").alias("KEY"), "TIMESTAMP", "VALUE", "STATUS")


@query("""select o_orderkey as "KEY", date_trunc('day', o_orderdate)::timestamp as "TIMESTAMP", case when o_orderkey % 7 <> 0 then o_totalprice end as "VALUE",
    'site' || (o_orderkey % 4)::varchar as site from orders where o_orderkey % 3 <> 2""")
def zipped_records(spark, sf_dir):
    """Members of two resolutions out of three, from one archive per site."""
    path, k = new_folder(spark), F.col("o_orderkey")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyyMMdd"), k.cast("string"), F.when(k % 7 == 0, "-9999").otherwise(F.col("o_totalprice").cast("string")))
    kind = F.element_at(F.array(*map(F.lit, ("DD", "WW", "MM"))), (k % 3 + 1).cast("int"))
    rows = load(spark, sf_dir, "orders").select(F.concat(F.lit("site"), k % 4).alias("site"), kind.alias("kind"), line.alias("line"))

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        system, root = archive.opened(path)
        system.create_dir(root)
        n = 0
        with system.open_output_stream(f"{root}/{key[0].as_py()}_{key[1].as_py()}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"X_{key[1].as_py()}_1.csv", "w") as out:
            out.write(b"TIMESTAMP,KEY,VALUE\n")
            for b in batches:
                out.write("".join(f"{x}\n" for x in b.column("line").to_pylist()).encode())
                n += b.num_rows
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    rows.groupBy("site", "kind").applyInArrow(pack, "n long").count()
    df = files.read_zipped_towers(spark, path, ["DD", "WW"])
    return df.select(F.col("KEY").cast("long").alias("KEY"), "TIMESTAMP", "VALUE", F.regexp_extract("file", r"(site\d)_[A-Z]+\.zip", 1).alias("site"))


@query("""select 'o/' || o_orderkey::varchar as uri, 'ES_S-' || (o_custkey % 50)::varchar as station_uri, strftime(o_orderdate, '%Y-%m-%d') as time_start from orders""")
def paged_objects(spark, sf_dir):
    """Pages of objects, half of them there at a first run of the stream and all at a second."""
    path, table, done = new_folder(spark), new_folder(spark), new_folder(spark)
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o/"), "o_orderkey").alias("uri"), F.concat(F.lit("ES_S-"), F.col("o_custkey") % 50).alias("station_uri"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time_start"))
    page = F.floor(F.col("k") / 2000)
    each = o.groupBy(page.alias("page")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("k", "uri", "station_uri", "time_start"))).alias("objects"))).alias("text"))
    each = each.select(F.format_string("page_%09d.json", "page").alias("name"), "text", "page")
    half = load(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] // 4000
    for part in (each.filter(F.col("page") <= half), each.filter(F.col("page") > half)):
        named.write_text_files(part, path, "name", "text", [])
        pages.append_new(pages.stream_pages(spark, path), table, done)
    return spark.read.schema(pages.OBJECTS).parquet(table).select("uri", "station_uri", "time_start")


DATE_PATTERNS = ("yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm", "dd.MM.yyyy HH:mm", "yyyyMMddHHmm")


def dated_files(spark: SparkSession, sf_dir: str) -> str:
    """Events in folders of files that write their dates in five ways."""
    path, k = new_folder(spark), F.col("event_id")
    rows = load(spark, sf_dir, "events").select("ts", k.alias("EVENT"), F.when(k % 9 == 0, -9999.0).otherwise(F.col("value")).alias("VALUE"))
    way = F.col("EVENT") % len(DATE_PATTERNS)
    date = F.coalesce(*[F.when(way == i, F.date_format("ts", pattern)) for i, pattern in enumerate(DATE_PATTERNS)])
    # one exchange, by the way of writing: a file for each, and all of them at once
    rows.select(date.alias("Date"), "EVENT", "VALUE", way.alias("way")).repartition("way").write.partitionBy("way").csv(path, header=True)
    return path


@query("""select event_id::double as "EVENT", date_trunc('minute', ts)::timestamp as "Date", case when event_id % 9 <> 0 then value end as "VALUE" from events""")
def dated_records(spark, sf_dir):
    """Every date read as its own file writes it."""
    return files.read_station_csv(spark, dated_files(spark, sf_dir))


@query("""with f as (select event_id % 5 as i, count(*) as n, max(day(ts)) as d, count(*) filter (where day(ts) <= 12 and day(ts) <> month(ts)) as either from events group by all)
    select (['yyyy-MM-dd', case when d > 12 then 'dd/MM/yyyy' else 'MM/dd/yyyy' end, 'MM/dd/yyyy', 'dd.MM.yyyy', 'digits'])[i + 1] as format, n::bigint as n, n::bigint as n_parsed,
        (i in (1, 2) and d <= 12 and either > 0) as ambiguous from f""")
def date_votes(spark, sf_dir):
    return files.station_dates(spark, dated_files(spark, sf_dir)).drop("file")


# --- station archives ------------------------------------------------------------------


def written_archive(spark: SparkSession, sf_dir: str) -> str:
    """Shipments as a station archive: a file per station and depth.

    Stations 0 and 3 are of network A, the others of B. Station 4 has the layout without
    headers, and each file of station 3 ends in a line that no layout allows.
    """
    path = new_folder(spark)
    rows = shipment_rows(spark, sf_dir, 3)[0].withColumn("net", F.when(F.col("station") < "4", "A").otherwise("B"))
    six = lambda c: F.format_string("%.6f", c)
    depth_ = six(F.col("depth_to"))
    name = F.concat("net", F.lit("/"), "station", F.lit("/"), "net", F.lit("_"), "station", F.lit("_sm_"), depth_, F.lit("_"), depth_, F.lit("_probe.stm"))
    at, k = F.date_format("ts", "yyyy/MM/dd HH:mm"), F.col("station").cast("int")
    place = F.concat_ws(" ", six(k * 1.5), six(k * 2.5), F.lit("10.0"), depth_, depth_)
    short = F.concat_ws(" ", at, F.col("value").cast("string"), "flag", F.lit("M"))
    long = F.concat_ws(" ", at, at, F.lit("list"), "net", "station", place, F.col("value").cast("string"), "flag", F.lit("M"))
    part = lambda df, i, text: df.select(name.alias("name"), F.lit(i).alias("part"), text.alias("text"))
    heads = part(rows.filter("station <> '4'"), 0, F.concat_ws(" ", "net", "net", "station", place, F.lit("probe"))).distinct()
    bad = part(rows.filter("station = '3'"), 2, F.lit("2020/13/45 00:00 oops")).distinct()
    named.write_text_files(heads.union(part(rows, 1, F.when(F.col("station") == "4", long).otherwise(short))).union(bad), path, "name", "text", ["part", "text"])
    return path


ARCHIVE_SQL = STATUS_SQL.replace("< 4 then 0", "< 3 then 0").replace("st as (select cast(i as varchar) as station, i * 1.5::double as lat, i * 2.5::double as lon from range(8) r(i)),", """st as (select station, station::int * 1.5::double as lat,
        station::int * 2.5::double as lon from (select distinct cast(k as varchar) as station from obs)),
    files as (select cast(k as varchar) as station, count(*) + 2 as n, 'A_3_sm_' || printf('%.6f', depth) || '_' || printf('%.6f', depth) || '_probe.stm' as file from obs where k = 3 group by k, depth),
    bad as (select station, count(*)::bigint as n_problems, arg_min(file || ':' || n::varchar || ':2020/13/45 00:00 oops', file) as problem from files group by all),""")
ARCHIVE_SQL = f"""with t as ({ARCHIVE_SQL.rsplit(" from s", 1)[0]}, coalesce(n_problems, 0)::bigint as n_problems, problem from s left join bad using (station))
    select station, case when n_problems > 0 then 'error' else status end as status, case when n_problems > 0 then problem else remark end as remark,
        {", ".join(f"case when n_problems = 0 then {c} end as {c}" for c in ("latitude", "longitude", "start_date", "end_date", "n_days", "max_depth_cm", "depths", "filename"))}, n_problems from t"""


@query(ARCHIVE_SQL)
def archive_status(spark, sf_dir):
    """The station job over an archive: a station with lines that cannot be read is an error."""
    path = written_archive(spark, sf_dir)
    job = station_job(archive.read_archive(spark, path).drop("network"), archive.read_archive_stations(spark, path).drop("network"), JOB_LIMITS, BY)
    return job.status.withColumn("depths", F.when(F.col("status") == "saved", F.concat_ws(",", "depths")))


@query("""select 'B' as network, cast(l_suppkey % 8 as varchar) as station, d as depth_to, count(*)::bigint as n, round(avg(l_quantity), 6) as mean_value
    from (select *, (p_size + case when l_suppkey % 8 = 6 and p_size <= 10 then 10 else 0 end)::double as d from lineitem join part on l_partkey = p_partkey)
    where l_suppkey % 8 in (4, 6) and d > 20 group by all""")
def archive_slice(spark, sf_dir):
    """Two stations of one network below a depth: other folders and files are not opened."""
    rows = archive.read_archive(spark, written_archive(spark, sf_dir), network=["B"], station=["4", "6"], depth=(20.5, None))
    return rounded(rows.groupBy("network", "station", "depth_to").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")), "mean_value")


@query(STATUS_SQL.rsplit("select station, case", 1)[0] + """select filled.station || '_' || strftime(a, '%Y%m%d') || '_' || strftime(z, '%Y%m%d') as file, depth, count(*)::bigint as n_days, round(avg(value), 6) as mean_value
    from filled join s using (station) where step = 6 group by all""")
def named_series(spark, sf_dir):
    """Saved series in a file per station, named by its days, and read back."""
    path = new_folder(spark)
    named.write_station_files(shipment_job(spark, sf_dir).saved, path, BY)
    saved = spark.read.schema("station string, depth string, day date, value double").parquet(path)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    return rounded(saved.groupBy(file.alias("file"), "depth").agg(F.count(F.lit(1)).alias("n_days"), F.avg("value").alias("mean_value")), "mean_value")
