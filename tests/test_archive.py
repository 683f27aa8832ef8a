"""Station archives, files named by the data, folders of files with different headers."""

from datetime import datetime

import pytest
from fieldspan import named
from fieldspan.operators import intervals
from fieldspan.plans.station import Limits, station_job
from fieldspan.sources import archive, files
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")

    def put(path, text):
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("N/7 3/N_N_7_sm_0.050000_0.100000_probe.stm", "N N 7 3 48.5 -9.25 120.0 0.05 0.10 5 TM\n2020/01/01 00:00    0.25 G M\n\n2020/01/01 01:00 NaN D01,D03 M\n2020/02/30 00:00 0.5 G M\nbroken line\n2020/01/02 00:00 .5")
    put("N/7 3/N_N_7_ts_0.200000_0.200000_probe.stm", "2020/01/01 00:00 -3 G\n")
    put("N/b/N_N_b_sm_0.100000_0.300000_x.stm", "2020/01/01 00:00 2020/01/01 00:03 L N b 1.5 2.5 3 0.10 0.30 0.125 G M\n2020/01/01 00:00 0.1 G\n")
    put("N/b/N_N_b_sm_0.900000_0.900000_x.stm", b"\xff\xfe\n")
    put("N/b/readme.txt", "not data")
    put("M/c/nameless.stm", "M M c 10.0 20.0 5.0 0.3 0.4 s\n2021/05/06 07:08 1e-1 G")
    put("M/d/M_sm_0.1_0.1.stm", "")
    (root / "M" / "empty").mkdir()
    return str(root)


def test_both_layouts(spark, place):
    rows = archive.read_archive(spark, place)
    good = rows.filter("problem is null").orderBy("station", "file", "line").select("network", "station", "variable", "depth_from", "depth_to", "ts", "value", "flag", "latitude", "longitude", "line")
    t = datetime
    assert [tuple(r) for r in good.collect() if r.value is None or r.value == r.value] == [
        ("N", "7 3", "sm", 0.05, 0.1, t(2020, 1, 1), 0.25, "G", 48.5, -9.25, 2),
        ("N", "7 3", "sm", 0.05, 0.1, t(2020, 1, 2), 0.5, None, 48.5, -9.25, 7),
        ("N", "7 3", "ts", 0.2, 0.2, t(2020, 1, 1), -3.0, "G", None, None, 1),
        ("N", "b", "sm", 0.1, 0.3, t(2020, 1, 1), 0.125, "G", 1.5, 2.5, 1),
        ("M", "c", None, 0.3, 0.4, t(2021, 5, 6, 7, 8), 0.1, "G", 10.0, 20.0, 2),
    ]
    assert rows.filter("isnan(value)").select("flag", "line").first()[:] == ("D01,D03", 4)
    bad = {(r.station, r.line, r.problem.split(":", 2)[-1]) for r in rows.filter("problem is not null").collect()}
    assert bad == {("7 3", 5, "2020/02/30 00:00 0.5 G M"), ("7 3", 6, "broken line"), ("b", 2, "2020/01/01 00:00 0.1 G"), ("b", 1, "��"), ("d", 0, "M_sm_0.1_0.1.stm: empty file".split(":", 2)[-1])}
    first = {r.station: (r.n_problems, r.problem) for r in archive.problems(rows).collect()}
    assert first["7 3"] == (2, "N_N_7_sm_0.050000_0.100000_probe.stm:5:2020/02/30 00:00 0.5 G M") and set(first) == {"7 3", "b", "d"}


def test_blocks(spark, place, monkeypatch):
    want = sorted(map(str, archive.read_archive(spark, place).collect()))
    folder = archive.ArchiveReader(place, False, {})
    monkeypatch.setattr(archive, "BLOCK", 7)
    got = [r for p in folder.partitions() for b in folder.read(p) for r in b.to_pylist()]
    assert len(got) == len(want)
    assert sorted(r["problem"] or "" for r in got) == sorted(r.problem or "" for r in archive.read_archive(spark, place).collect())


def test_stations(spark, place):
    got = {tuple(r) for r in archive.read_archive_stations(spark, place).collect()}
    assert got == {("N", "7 3", 48.5, -9.25), ("N", "b", 1.5, 2.5), ("M", "c", 10.0, 20.0), ("M", "d", None, None)}


def test_only_what_is_wanted_is_opened(spark, place):
    reader = lambda **w: archive.ArchiveReader(place, False, w)
    names = lambda r: sorted(f.rsplit("/", 1)[-1] for p in r.partitions() for f in p.files)
    assert len(names(reader())) == 6 and len(reader().partitions()) == 4
    assert [p.station for p in reader(network=["N"], station=["b", "c"]).partitions()] == ["b"]
    assert names(reader(variable=["ts"])) == ["N_N_7_ts_0.200000_0.200000_probe.stm", "nameless.stm"]
    assert names(reader(depth=[0.2, 0.5])) == ["N_N_7_ts_0.200000_0.200000_probe.stm", "N_N_b_sm_0.100000_0.300000_x.stm", "nameless.stm"]
    df = archive.read_archive(spark, place, network=["N"], station=["b"])
    assert df.rdd.getNumPartitions() == 1
    # one use of a table does not narrow another
    every = archive.read_archive(spark, place)
    assert every.filter("station = 'c'").count() == 1 and every.count() == 11
    assert archive.read_archive(spark, place, variable=["ts"]).count() == 1
    assert archive.read_archive(spark, place, depth=(None, 0.2)).select("depth_to").distinct().count() == 2
    assert archive.read_archive(spark, place, network=["none"]).count() == 0


def test_error_rows(spark, place):
    job = station_job(archive.read_archive(spark, place), archive.read_archive_stations(spark, place), Limits(min_obs=1))
    got = {r.station: r for r in job.status.collect()}
    assert {k: r.status for k, r in got.items()} == {"7 3": "error", "b": "error", "d": "error", "c": "skipped"}
    assert got["7 3"].remark.endswith("0.5 G M") and got["7 3"].n_problems == 2 and got["7 3"].latitude is None
    assert got["c"].remark == "<1 year of valid daily data" or got["c"].remark.startswith("no surface")
    assert job.saved.count() == 0


# --- files named by the data -----------------------------------------------------------


def series(spark, rows):
    return spark.createDataFrame([(k, s, "0-10", datetime.fromisoformat(d).date(), v, q) for k, s, d, v, q in rows], "network string, station string, depth string, day date, value double, value_qc int")


def listed(path):
    return sorted(str(f.relative_to(path)) for f in path.rglob("*") if f.is_file() and not f.name.startswith("."))


def test_a_file_for_each_station(spark, tmp_path):
    rows = series(spark, [("n", "a", "2020-01-01", 1.0, 1), ("n", "a", "2020-01-03", 3.0, 0), ("n", "a", "2020-01-02", 2.0, 0), ("n", "a_b", "2020-01-01", 5.0, 0), ("n", "c", "2020-01-01", None, 2)])
    named.write_station_files(rows, str(tmp_path))
    assert listed(tmp_path) == ["n_a_20200102_20200103.parquet", "n_a_b_20200101_20200101.parquet"]
    got = spark.read.parquet(str(tmp_path / "n_a_20200102_20200103.parquet"))
    assert [r.value for r in got.collect()] == [1.0, 2.0, 3.0] and "file_name_" not in got.columns
    # a rerun with other days replaces the station's file and leaves the others
    named.write_station_files(series(spark, [("n", "a", "2021-01-01", 1.0, 0)]), str(tmp_path))
    assert listed(tmp_path) == ["n_a_20210101_20210101.parquet", "n_a_b_20200101_20200101.parquet"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 40).cast("string").alias("name"), F.when(F.col("id") == 1999, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("value"), "id")
    with pytest.raises(PySparkException):
        named.write_text_files(rows, str(tmp_path), "name", "value", ["id"])
    assert listed(tmp_path) == []
    named.write_text_files(rows.filter("id < 1999"), str(tmp_path), "name", "value", ["id"])
    assert len(listed(tmp_path)) == 40 and (tmp_path / "3").read_text().split() == [str(i) for i in range(3, 1999, 40)]


def test_rows_of_a_file_must_lie_together(spark, tmp_path):
    spark.dataSource.register(named.NamedFiles)
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], f"{named.NAME} string, value string").coalesce(1)
    with pytest.raises(PySparkException, match="lie apart"):
        rows.write.format(named.FORMAT).mode("append").options(**{"as": "text"}).save(str(tmp_path))
    for name in (None, "", "../x", "_hidden", "a//b"):
        bad = spark.createDataFrame([(name, "1")], f"{named.NAME} string, value string")
        with pytest.raises(PySparkException):
            bad.write.format(named.FORMAT).mode("append").options(**{"as": "text"}).save(str(tmp_path))
    assert listed(tmp_path) == []


# --- folders of files ------------------------------------------------------------------


def test_headers_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TIMESTAMP,A,B\n20200101,10,20\n20200102,-9999,\n")
    (tmp_path / "b.csv").write_text("TIMESTAMP, B ,A\n20200103,20,10\n")
    (tmp_path / "c.csv").write_text('﻿A,"C, d",TIMESTAMP,A\n1,x,20200104,2\nA,"C, d",TIMESTAMP,A\n')
    want = [(1, 10.0, 20.0, None, None), (2, None, None, None, None), (3, 10.0, 20.0, None, None), (4, 1.0, None, "x", 2.0)]
    for read in (files.read_tower_csv, files.read_station_csv):
        df = read(spark, str(tmp_path))
        assert [(r.TIMESTAMP.day, r.A, r.B, r["C, d"], r["A.1"]) for r in df.collect()] == want
    assert {r.file[-5:] for r in files.read_tower_csv(spark, str(tmp_path), with_file=True).collect()} == {"a.csv", "b.csv", "c.csv"}


def test_dates_by_vote(spark, tmp_path):
    put = lambda name, *dates: (tmp_path / name).write_text("# c\nDate,V\n" + "".join(f"{d},1\n" for d in dates))
    put("day.csv", "03/04/2020", "13/04/2020 05:06")
    put("month.csv", "03/04/2020", "04/13/2020", "x")
    put("either.csv", "03/04/2020", "05/05/2020")
    put("same.csv", "05/05/2020")
    put("iso.csv", "2020-04-03T10:00:00Z", "2020-04-04")
    put("dots.csv", "3.04.2020")
    put("digits.csv", "20200403", "202004030506")
    put("none.csv")
    got = {r.file.rsplit("/", 1)[-1]: (r.n, r.format, r.n_parsed, r.ambiguous) for r in files.station_dates(spark, str(tmp_path)).collect()}
    assert got == {
        "day.csv": (2, "dd/MM/yyyy", 2, False), "month.csv": (3, "MM/dd/yyyy", 2, False), "either.csv": (2, "MM/dd/yyyy", 2, True), "same.csv": (1, "MM/dd/yyyy", 1, False),
        "iso.csv": (2, "yyyy-MM-dd", 2, False), "dots.csv": (1, "dd.MM.yyyy", 1, False), "digits.csv": (2, "digits", 2, False),
    }
    rows = files.read_station_csv(spark, str(tmp_path), with_file=True).collect()
    by = lambda n: sorted((r.Date for r in rows if r.file.endswith(n)), key=str)
    assert by("day.csv") == [datetime(2020, 4, 3), datetime(2020, 4, 13, 5, 6)]
    assert by("month.csv") == [datetime(2020, 3, 4), datetime(2020, 4, 13), None]
    assert by("iso.csv") == [datetime(2020, 4, 3, 10), datetime(2020, 4, 4)]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n# only a comment\n")
    assert files.read_station_csv(spark, str(tmp_path)).count() == 0


# --- overlap joins ---------------------------------------------------------------------


@pytest.mark.parametrize("width", ["1 year", "2 days"])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_overlaps(spark, width, by):
    import random
    from datetime import timedelta

    r = random.Random(1)

    def some(n, spans):
        out = []
        for i in range(n):
            a = datetime(1950, 1, 1) + timedelta(days=r.randrange(30000))
            out.append((i, r.choice("xy"), a, a + timedelta(days=r.choice(spans))))
        return out

    left = [*some(100, [0, 5, 400, 4000, 300000, -3]), (999, "x", None, datetime(2000, 1, 1)), (998, None, datetime(1999, 1, 1), datetime(2000, 1, 1))]
    left += left[:2]
    right = some(90, [0, 30, 800, 9000, 300000])
    a, b = spark.createDataFrame(left, "i int, k string, a timestamp, z timestamp"), spark.createDataFrame(right, "j int, k string, c timestamp, e timestamp")
    df = intervals.overlap_join(a, b if by else b.drop("k"), ("a", "z"), ("c", "e"), by, width)
    want = sorted((i, j) for i, k, a, z in left for j, m, c, e in right if a and a <= z and a <= e and c <= z and (not by or k == m))
    assert sorted((x.i, x.j) for x in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _spans(seed, n, lengths, keys="xy"):
    import random
    from datetime import timedelta

    r = random.Random(seed)
    starts = [datetime(1990, 1, 1) + timedelta(days=r.randrange(3000)) for _ in range(n)]
    return [(i, r.choice(keys), a, a + timedelta(days=r.choice(lengths))) for i, a in enumerate(starts)]


@pytest.mark.parametrize("by", [(), ("k",)])
def test_overlaps_over_many_chunks(spark, monkeypatch, by):
    monkeypatch.setattr(intervals, "CHUNK", 3)
    left, right = _spans(2, 200, [0, 20, 900]), _spans(3, 60, [0, 80, 20000])
    left += left[:7]
    a, b = spark.createDataFrame(left, "i int, k string, a timestamp, z timestamp"), spark.createDataFrame(right, "j int, k string, c timestamp, e timestamp")
    df = intervals.overlap_join(a, b if by else b.drop("k"), ("a", "z"), ("c", "e"), by, "60 days", 3)
    assert df.columns == (["k", "i", "a", "z", "j", "c", "e"] if by else ["i", "k", "a", "z", "j", "c", "e"])
    want = sorted((i, j) for i, k, a, z in left for j, m, c, e in right if a <= e and c <= z and (not by or k == m))
    assert sorted((x.i, x.j) for x in df.collect()) == want


def test_overlaps_shuffle_a_row_once(spark):
    """Long intervals are not laid out in copies: what is written grows with the rows alone."""
    left, right = _spans(4, 3000, [100, 900, 2500]), _spans(5, 300, [30, 89, 20000])
    a, b = spark.createDataFrame(left, "i int, k string, a timestamp, z timestamp"), spark.createDataFrame(right, "j int, k string, c timestamp, e timestamp")
    sc, old = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    try:
        before = shuffled()
        n = intervals.overlap_join(a, b, ("a", "z"), ("c", "e"), ["k"], "60 days").count()
        rows = sum(v for k, v in shuffled().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert n == sum(a <= e and c <= z and k == m for i, k, a, z in left for j, m, c, e in right)
    assert rows < 2 * (len(left) + len(right))


def test_overlaps_are_joined_by_many_tasks(spark):
    """Few bytes are shuffled for many pairs: tasks are not merged by their bytes."""
    left, right = _spans(6, 6000, [100, 900]), _spans(7, 300, [30, 89, 20000])
    a, b = spark.createDataFrame(left, "i int, k string, a timestamp, z timestamp"), spark.createDataFrame(right, "j int, k string, c timestamp, e timestamp")
    n = intervals.overlap_join(a, b, ("a", "z"), ("c", "e"), ["k"], "60 days").groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in n) == sum(a <= e and c <= z and k == m for i, k, a, z in left for j, m, c, e in right)
    assert len(n) > 8


# --- members of zip archives -----------------------------------------------------------


def test_zip_lines(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "US-Var_x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/X_HH_1.csv", "\nTIMESTAMP_START,TIMESTAMP_END,A\r\n202001010000,202001010030,1.5\r\n\n202001010030,202001010100,-9999")
        z.writestr("X_DD_1.csv", "A,TIMESTAMP\n2,20200102\n")
        z.writestr("readme.txt", "no")
        z.writestr("empty_DD_.csv", "")
    members = files.zip_members(spark, str(tmp_path))
    assert {r.name for r in members.collect()} == {"a/X_HH_1.csv", "X_DD_1.csv", "empty_DD_.csv"}
    for size in (1, 1 << 20):
        got = {(r.name, r.line): r.value for r in files.zip_lines(members, batch_bytes=size).collect()}
        assert got["a/X_HH_1.csv", 2] == "TIMESTAMP_START,TIMESTAMP_END,A" and got["X_DD_1.csv", 2] == "2,20200102" and len(got) == 7
    firsts = {(r.name, r.line, r.value) for r in files.zip_lines(members, first_only=True).collect()}
    assert firsts == {("a/X_HH_1.csv", 2, "TIMESTAMP_START,TIMESTAMP_END,A"), ("X_DD_1.csv", 1, "A,TIMESTAMP")}
    df = files.read_zipped_towers(spark, str(tmp_path))
    rows = {(r.resolution, r.A, r.TIMESTAMP, r.TIMESTAMP_START) for r in df.collect()}
    assert rows == {("HH", 1.5, None, datetime(2020, 1, 1)), ("HH", None, None, datetime(2020, 1, 1, 0, 30)), ("DD", 2.0, datetime(2020, 1, 2), None)}
    assert files.read_zipped_towers(spark, str(tmp_path), ["DD"]).count() == 1


def test_a_large_member_is_never_whole(spark, tmp_path):
    """200 MB of lines from one member; what a task holds stays far below it."""
    import zipfile

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("X_HH_1.csv", "w", force_zip64=True) as f:
        block = b"".join(b"%012d,0123456789012345678901234567\n" % i for i in range(25_000))
        for _ in range(200):
            f.write(block)

    def held(batches):
        import resource

        import pyarrow as pa

        n, before = 0, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        for b in batches:
            n += b.num_rows
        yield pa.record_batch([pa.array([n]), pa.array([(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10])], names=["n", "mb"])

    lines = files.zip_lines(files.zip_members(spark, str(tmp_path)))
    r = lines.mapInArrow(held, "n long, mb long").groupBy().agg(F.sum("n").alias("n"), F.max("mb").alias("mb")).first()
    assert r.n == 5_000_000 and r.mb < 64


def test_a_date_is_tried_only_where_its_marks_stand(spark):
    """Formats read what they read before, and a text without a format's marks is not parsed."""
    texts = ["2020-01-02", "2020-01-02 03:04", "2020-01-02T03:04:05Z", "1/2/2020", "13/2/2020 1:02", "02.01.2020 03:04:05", "2-Jan-2020", "2020/01/02 03:04", "1/2-2020", "3:04", "2020-01-02 03:04:05:06", "", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in files.DATES[1:]:
        s = F.regexp_replace(F.regexp_replace(F.trim("t"), "T", " "), "Z$", "")
        day = name.replace("MM/", "M/").replace("dd", "d").replace("/MM/", "/M/") if name in (*files.EITHER, "dd.MM.yyyy", "dd-MMM-yyyy") else name
        plain = F.coalesce(*[F.try_to_timestamp(s, F.lit(day + time)).cast("timestamp_ntz") for time in ("", " HH:mm", " HH:mm:ss")])
        assert [r for r in df.select("t", files.date_as(F.col("t"), name).alias("a"), plain.alias("b")).collect() if r.a != r.b] == []
    plan = df.select(files.date_as(F.col("t"), "yyyy-MM-dd"))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower()


def test_every_way_of_dates_is_one_file(spark, monkeypatch):
    from fieldspan.plans import queries as plans

    seen = []
    monkeypatch.setattr(plans, "new_folder", lambda s, f=plans.new_folder: seen.append(f(s)) or seen[-1])
    jobs = spark.sparkContext
    jobs.setJobGroup("dated", "dated")
    try:
        plans.dated_files(spark, "/root/testdata/sf0.001")
    finally:
        jobs.setLocalProperty("spark.jobGroup.id", None)
    assert spark.read.text(seen[0]).select(F.col("_metadata.file_path")).distinct().count() == len(plans.DATE_PATTERNS)
    # not one job of one task after the other
    assert len(jobs.statusTracker().getJobIdsForGroup("dated")) < len(plans.DATE_PATTERNS)


def test_a_large_station_is_read_by_several_tasks(spark, place, monkeypatch):
    monkeypatch.setattr(archive, "SPLIT", 1, raising=False)
    parts = archive.ArchiveReader(place, False, {}).partitions()
    assert len(parts) == 6 and all(len(p.files) == 1 for p in parts)
    # coordinates come from a station's first files, so that these stay in one partition
    assert len(archive.ArchiveReader(place, True, {}).partitions()) == 4
    assert archive.read_archive(spark, place).count() == 11
