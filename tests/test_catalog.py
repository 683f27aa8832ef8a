"""Catalogues, attributes, text, readers and writers: cases worked by hand."""

import io
import zipfile
from datetime import datetime

import pytest
from fieldspan import model, sinks
from fieldspan.operators import attributes, catalog, extract
from fieldspan.session import setting
from fieldspan.sources import catalogs, files
from pyspark.sql import functions as F


def test_numbers(spark):
    df = spark.createDataFrame([("1e3",), (" 7 ",), ("",), ("abc",), ("inf",), ("NaN",), (None,)], "x string")
    assert [r.x for r in model.coerced(df, ["x", "y"]).collect()] == [1000.0, 7.0, None, None, float("inf"), None, None]
    df = spark.createDataFrame([(-9999.0, "-9999", -9999), (1.0, "-9999.00", 2)], "a double, b string, c int")
    assert [tuple(r) for r in model.without_missing(df).collect()] == [(None, None, None), (1.0, "-9999.00", 2)]


def test_years(spark):
    df = spark.createDataFrame([(["2015", "2016", "2016", "x", "2017"],), (None,), ([],)], "flux_data array<string>")
    got = catalog.with_year_range(df, "flux_data", "a", "z").collect()
    assert [(r.a, r.z) for r in got] == [(2015, 2017), (None, None), (None, None)]
    sites = df.withColumn("TOWER_END", F.lit(None).cast("double"))
    assert catalog.filter_towers(sites, flux_year_range=(2016, 2017), min_flux_years=3).count() == 1
    assert catalog.filter_towers(sites, flux_year_range=(2016, 2017), min_flux_years=4).count() == 0
    assert catalog.filter_towers(sites, active_only=True).count() == 3


def objects(spark, rows):
    t = lambda s: datetime.fromisoformat(s)
    return spark.createDataFrame([(f"u{i}", s, t(a), t(z), i) for i, (s, a, z) in enumerate(rows)], "uri string, station_uri string, time_start timestamp, time_end timestamp, ord long")


def test_inventory(spark):
    o = objects(spark, [("x/ES_A", "2013-06-01", "2016-03-01"), ("x/ES_A", "2016-05-01", "2018-02-01"), ("x/ES_B", "2017-12-31T06:00:00", "2019-01-01")])
    r = catalog.inventory(o, None, (2015, 2017)).collect()
    assert [(x.SITE_ID, x.N_YEARS, x.YEARS, x.DATA_OBJECTS) for x in r] == [("A", 3, [2015, 2016, 2017], ["u0", "u1"])]
    assert catalog.inventory(o, None, (2015, 2017), 4).count() == 0
    twice = spark.createDataFrame([("A",), ("A",), ("Z",)], "SITE_ID string")
    assert catalog.inventory(o, twice, (2015, 2017)).count() == 2


def test_ids(spark):
    df = spark.createDataFrame([("http://x/ES_DE-Hai",), ("http://x/ES_DE-Hai_2",), (None,)], "u string")
    assert [r[0] for r in df.select(catalog.id_of_uri(df.u)).collect()] == ["DE-Hai", "DE-Hai_2", ""]
    df = spark.createDataFrame([("US-Var_BASE.zip",)], "u string")
    assert df.select(catalog.id_of_file(df.u)).first()[0] == "US-Var"


def test_batches_and_missing(spark):
    ids = spark.createDataFrame([(f"{i:03}",) for i in range(25)], "SITE_ID string").repartition(5)
    got = catalog.batches(ids, ["SITE_ID"], 10).collect()
    assert {r.SITE_ID: r.batch for r in got} == {f"{i:03}": i // 10 for i in range(25)}
    had = ids.filter("SITE_ID < '020'")
    assert {r.SITE_ID for r in catalog.missing_ids(ids, had).collect()} == {f"{i:03}" for i in range(20, 25)}
    assert catalog.seeded_sample(ids, "SITE_ID", 7).collect() == catalog.seeded_sample(ids.repartition(2), "SITE_ID", 7).collect()


def test_batches_at_size(spark):
    """A million ids with other columns, whose pruning must not change the numbers."""
    ids = spark.range(1_000_000).select(((F.col("id") * 7_919) % 1_000_000).alias("SITE_ID"), F.xxhash64("id").alias("a"), F.lit("x").alias("batch"))
    got = catalog.batches(ids, ["SITE_ID"], 10)
    assert got.columns == ["SITE_ID", "a", "batch"]
    assert got.filter("batch <> SITE_ID div 10").count() == 0 and got.count() == 1_000_000
    assert catalog.batches(ids.filter("false"), ["SITE_ID"]).count() == 0


def test_tables_on_the_way_are_removed(spark):
    import os

    from fieldspan import session

    before = len(session._TABLES)
    out = session.kept(spark, lambda: session.written(spark.range(5)).filter("id > 1"))
    assert len(session._TABLES) == before + 1 and out.count() == 3
    path = session._TABLES[-1].removeprefix("file:")
    assert os.path.isdir(path)
    session.drop_tables(spark, before)
    assert not os.path.exists(path) and len(session._TABLES) == before


def test_seeded_sample_goes_by_md5(spark):
    import hashlib

    ids = spark.range(500).withColumnRenamed("id", "k")
    want = sorted(range(500), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:9]
    assert [r.k for r in catalog.seeded_sample(ids, "k", 9).collect()] == want


def test_pivot_and_ranges(spark):
    kinds = "SITE_ID string, VARIABLE_GROUP string, GROUP_ID string, VARIABLE string, DATAVALUE string, ord long"
    rows = [("s", "g", "1", "A", "1", 0), ("s", "g", "1", "A", "2", 1), ("s", "g", "1", "B", "3", 2)]
    r = attributes.pivot_groups(spark.createDataFrame(rows, kinds), ["A", "B", "C"]).first()
    assert (r.A, r.B, r.C) == ("2", "3", None)
    g = spark.createDataFrame([("s", "0", "15"), ("s", "15.9", "30"), ("s", "0", "15"), ("s", None, "5"), ("s", "x", "9"), ("s", "inf", "9"), ("s", "-5", "0")], "SITE_ID string, lo string, hi string")
    assert attributes.depth_ranges(g, "lo", "hi").first().ranges == ["-5-0", "0-15", "15-30"]
    h = [("s", "mean", "2018", "10", 0), ("s", "Mean", "2020", "12", 1), ("s", "max", "2021", "30", 2), ("s", "mean", None, "5", 3), ("s", None, "2022", "9", 4)]
    r = attributes.latest_mean(spark.createDataFrame(h, "SITE_ID string, stat string, date string, h string, ord long"), "h", "stat", "date").first()
    assert (r.h, r.date) == (12.0, "2020")


@pytest.mark.parametrize(("text", "swc", "ts"), [
    ("SWC-DeltaT MLx -0.08 -3.9 2 SWC_1_1_1", [-0.08], []),
    ("BE-Bra_TS_1_1_1 -0.015 -35.58 -9.42 TS_1_1_1", [], [-0.015]),
    ("x12 3 4 5 SWC_1_1_1", [3.0], []),
    ("x12 3 4 5 TS_1_1_1", [], []),
    ("TH-X-002-001\nCS65X -1 SWC_1_1_1\n-0.10 2.5 3.5", [-0.1], []),
    ("-0.5 1 1\n\nSWC_1_1_1\n\n-0.2 1 1\n", [-0.2], []),
    ("-9 1 1 -0.3 1 1\r\nTS_1_1_1 and SWC_2_2_2", [], [-0.3]),
])
def test_depths_in_text(spark, text, swc, ts):
    r = extract.report_facts(spark.createDataFrame([("s", text)], "SITE_ID string, text string")).first()
    assert (r.SWC_DEPTHS_M, r.TS_DEPTHS_M, r.ERROR) == (swc, ts, None)


def test_heights_in_text(spark):
    text = "HEIGHT (m) 32.6 32.6\nHEIGHT (m) 9\ntree height is ca. 5 m"
    df = spark.createDataFrame([("a", text), ("b", "vegetation height approx. max 5 m"), ("c", " "), ("e", None)], "SITE_ID string, text string")
    got = {r.SITE_ID: (r.MEASUREMENT_HEIGHT_M, r.CANOPY_HEIGHT_M, r.ERROR) for r in extract.report_facts(df).collect()}
    assert got == {"a": (32.6, 5.0, None), "b": (None, None, None), "c": (None, None, "empty text"), "e": (None, None, "empty text")}
    assert tuple(extract.outcome(extract.report_facts(df)).first()) == (2, 2)


def test_lines(spark):
    text = "a\r\nb\x0bc\u2028d\n\ne\n"
    got = extract.split_lines(spark.createDataFrame([("s", text)], "SITE_ID string, text string")).collect()
    assert [r.line for r in got] == text.splitlines()


def test_script_json(spark):
    page = """<script>const jsonSites = '[{\\"id\\": \\"A\\", "n": [2015]}]';</script>"""
    df = spark.createDataFrame([(page,)], "html string")
    assert [tuple(r) for r in catalogs.sites_from_page(df, "jsonSites", "id string, n array<int>").collect()] == [("A", [2015])]
    with pytest.raises(Exception, match="no array"):
        catalogs.sites_from_page(spark.createDataFrame([("x",)], "html string"), "jsonSites", "id string").collect()


def test_times(spark):
    df = spark.createDataFrame([("202001010030",), ("20200131",), ("201512",), ("2015",), ("x",), (None,), ("2020-01-02 03:04:05",)], "t string")
    got = [r[0] for r in df.select(files.parse_time(df.t)).collect()]
    assert got == [datetime(2020, 1, 1, 0, 30), datetime(2020, 1, 31), datetime(2015, 12, 1), datetime(2015, 1, 1), None, None, datetime(2020, 1, 2, 3, 4, 5)]


def test_tower_csv(spark, tmp_path):
    (tmp_path / "X_DD_1.csv").write_text("TIMESTAMP,A,B\n20200102,-9999,x\n20200101,2.5,-9999\n")
    df = files.read_tower_csv(spark, str(tmp_path))
    assert [(r.TIMESTAMP.day, r.A, r.B) for r in df.collect()] == [(1, 2.5, None), (2, None, "x")]
    got = files.classify(files.list_files(spark, str(tmp_path))).select("resolution").collect()
    assert [r[0] for r in got] == ["DD"]


def test_station_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# head\nTIMESTAMP,A,B\n202001010030,1.5,x # note\n# c\n202001010000,-9999.0,\n")
    df = files.read_station_csv(spark, str(tmp_path))
    assert [(r.TIMESTAMP, r.A, r.B) for r in df.collect()] == [(datetime(2020, 1, 1), None, None), (datetime(2020, 1, 1, 0, 30), 1.5, "x")]


def test_station_archive(spark, tmp_path):
    f = tmp_path / "net" / "sta"
    f.mkdir(parents=True)
    (f / "sm_0.050000_0.100000_probe.stm").write_text("head line\n2020/01/01 00:00 0.25 G M\n2020/01/01 01:00 x C01\n")
    got = [tuple(r) for r in files.read_station_archive(spark, str(tmp_path)).orderBy("ts").collect()]
    assert got == [("net", "sta", "sm_0.050000_0.100000_probe", 0.1, datetime(2020, 1, 1), 0.25, "G"), ("net", "sta", "sm_0.050000_0.100000_probe", 0.1, datetime(2020, 1, 1, 1), None, "C01")]


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    heads = ["SITE_ID", "GROUP_ID", "VARIABLE_GROUP", "VARIABLE", "DATAVALUE"]
    row = lambda n, cells: f'<row r="{n}">' + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{c}</t></is></c>' for i, c in enumerate(cells)) + "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="META" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{row(1, heads)}{row(2, ['S-1', '7', 'G', 'H', '12'])}</sheetData></worksheet>")
    return out.getvalue()


def test_attribute_sheets(spark, tmp_path):
    for name, members in (("S-1_a.zip", {"m.xlsx": workbook()}), ("S-2_a.zip", {"m.txt": b"x"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
    assert [tuple(r) for r in catalogs.read_attributes(spark, str(tmp_path), "META").collect()] == [("S-1", "7", "G", "H", "12", 0)]
    assert catalogs.read_attributes(spark, str(tmp_path), "OTHER").count() == 0
    assert [r.name for r in files.unzipped(spark, str(tmp_path), "*.txt").collect()] == ["m.txt"]


def test_objects_and_documents(spark):
    a = spark.createDataFrame([("o1", "s1"), ("o2", "s2")], "object string, station string")
    names = spark.createDataFrame([("o1", "Step2_LABELLING.pdf"), ("o2", "other.pdf")], "object string, name string")
    ids = spark.createDataFrame([("s1", "B"), ("s2", "A")], "station string, station_id string")
    assert [tuple(r) for r in catalogs.labelling_documents(a, names, ids).collect()] == [("B", "o1", "Step2_LABELLING.pdf")]
    assert catalogs.link_objects([a, a.limit(1)]).count() == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("n", "s", "0-10", datetime(2020, 1, 1).date(), 1.0, "f")], "network string, station string, depth string, day date, value double, filename string")
    sinks.write_series(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).where("network = 'n'").count() == 1
    t = spark.createDataFrame([("s", ["a", "b"], 1)], "id string, depths array<string>, x int")
    sinks.write_table(t, str(tmp_path / "b"), drop=["x"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "b"), header=True, escape='"').collect()] == [("s", '["a","b"]')]


def test_settings(spark, monkeypatch):
    with pytest.raises(ValueError, match="email"):
        setting(spark, "email")
    monkeypatch.setenv("FIELDSPAN_EMAIL", "a@b.c")
    assert setting(spark, "email") == "a@b.c"


def test_stream(spark, tmp_path):
    from fieldspan.streaming.daily import daily_stream

    kinds = "network string, station string, sensor string, depth_to double, ts timestamp, value double, flag string"
    rows = [("n", "s", "p", 0.05, datetime(2020, 1, day, h), float(h), "G") for day in (1, 2, 9) for h in range(3)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "in"))
    stream = daily_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.day), r.value, r.n) for r in spark.table("days").collect()}
    assert {("2020-01-01", 1.0, 3), ("2020-01-02", 1.0, 3)} <= got


def test_a_sheet_is_read_row_by_row(tmp_path):
    """Memory does not grow with the rows of a sheet, nor with its file."""
    import tracemalloc

    rows = 60_000
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="META" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>SITE_ID</t></is></c><c r="B1" t="inlineStr"><is><t>DATAVALUE</t></is></c></row>')
            for i in range(rows):
                f.write(f'<row><c r="A{i}" t="s"><v>{i % 2}</v></c><c r="B{i}"><v>{i}</v></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
    with zipfile.ZipFile(tmp_path / "S_1.zip", "w") as z:
        z.writestr("m.xlsx", book.getvalue())
    del book
    tracemalloc.start()
    try:
        with open(tmp_path / "S_1.zip", "rb") as f:
            n = sum(r == {"SITE_ID": ("one", "two")[i % 2], "DATAVALUE": str(i)} for i, r in enumerate(catalogs._sheet(f, "META")))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == rows and peak < 4 << 20
