"""Runs over streams against the batch operators."""

import random
from datetime import date, timedelta

import pytest
from fieldspan.operators import gaps, resample
from fieldspan.streaming import runs
from pyspark.sql import functions as F

D = date(2020, 1, 1)
SCHEMA = "station string, depth string, day date, value double"


def random_rows(seed):
    r, out = random.Random(seed), []
    for s in range(6):
        for i in range(120):
            if r.random() < 0.8:
                out.append((f"s{s}", "0-10", D + timedelta(days=i + s), 1.0 if r.random() < [0.3, 0.7, 0.95, 0.0, 1.0, 0.5][s] else None))
    return out


def batch(spark, rows, gap):
    df = resample.densify(spark.createDataFrame(rows, SCHEMA), ("station",), ("value",))
    miss, have = gaps.longest_missing_run(df, ("station",)), gaps.longest_available_run(df, gap, ("station",))
    both = miss.toDF("station", "depth", "a", "b", "c").join(have, ["station", "depth"])
    last = df.groupBy("station", "depth").agg(F.max("day"))
    return {tuple(r) for r in both.join(last, ["station", "depth"]).collect()}


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_states_are_the_batch_run(spark, gap):
    rows = random_rows(gap)
    got = set()
    for s in sorted({r[0] for r in rows}):
        state = None
        for _, _, day, v in sorted(r for r in rows if r[0] == s):
            state = runs.advanced(state, (day - date(1970, 1, 1)).days, v is not None, gap)
        got.add((s, "0-10", *runs.result(state, gap)))
    assert got == batch(spark, rows, gap)


def test_run_stream(spark, tmp_path):
    rows = random_rows(9)
    r = random.Random(2)
    # shuffled within 20 days, in files of one batch each, some days twice
    rows = sorted(rows + rows[::7], key=lambda x: x[2] + timedelta(days=r.randrange(20)))
    parts = [rows[i : i + 120] for i in range(0, len(rows), 120)]
    ahead = D + timedelta(days=1000)
    parts += [[("z", "0-10", ahead, 1.0)], [("s0", "0-10", D, 5.0), ("z", "0-10", ahead + timedelta(days=1), 1.0)], [("z", "0-10", ahead + timedelta(days=2), 1.0)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i:03}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = runs.run_stream(source, 3, "20 days", ("station",))
        got = {}

        def keep(df, i):
            for x in df.collect():
                got[x.station, x.depth] = tuple(x)

        q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        q.stop()
    finally:
        spark.conf.unset(key)
    want = batch(spark, sorted(set(rows), key=str), 3)
    assert {v for k, v in got.items() if k[0] != "z"} == want


def test_pages_are_read_once(spark, tmp_path):
    import json

    from fieldspan.sources import pages

    folder, table, done = tmp_path / "pages", str(tmp_path / "table"), str(tmp_path / "done")
    folder.mkdir()

    def put(n, uris):
        (folder / f"page_{n:04}.json").write_text(json.dumps({"objects": [{"uri": u, "station_uri": f"s{n}", "time_start": "2020-01-01"} for u in uris]}))

    def run():
        pages.append_new(pages.stream_pages(spark, str(folder)), table, done)
        return sorted((r.uri, r.page, r.place, r.station_uri, r.time_end) for r in spark.read.parquet(table).collect())

    put(1, ["a", "b", "a", None])
    put(2, [])
    first = [("a", "page_0001.json", 0, "s1", None), ("b", "page_0001.json", 1, "s1", None)]
    assert run() == first
    assert run() == first
    put(3, ["b", "c"])
    put(4, ["d"])
    assert run() == [*first, ("c", "page_0003.json", 1, "s3", None), ("d", "page_0004.json", 0, "s4", None)]
    # a lost checkpoint reads all pages again and adds nothing
    pages.append_new(pages.stream_pages(spark, str(folder)), table, done + "2")
    assert spark.read.parquet(table).count() == 4


def test_larger_batches_of_pages_go_to_more_partitions(spark, tmp_path, monkeypatch):
    import json

    from fieldspan.sources import pages

    monkeypatch.setattr(pages, "PAGES", 1, raising=False)
    folder, table, done = tmp_path / "pages", tmp_path / "table", str(tmp_path / "done")
    folder.mkdir()
    for part in (range(9), range(9, 20)):
        for n in part:
            # every other object stands on the page before as well
            uris = [f"{n - i % 2}/{i}" for i in range(60)]
            (folder / f"page_{n:04}.json").write_text(json.dumps({"objects": [{"uri": u} for u in uris]}))
        files = len(list(table.glob("*.parquet")))
        pages.append_new(pages.stream_pages(spark, str(folder)), str(table), done)
        assert len(list(table.glob("*.parquet"))) - files > len(part) // 2 + 1
    got = spark.read.parquet(str(table))
    assert got.count() == got.select("uri").distinct().count() == 20 * 60
