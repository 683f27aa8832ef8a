"""Texts with carriage returns take part in the query of report lines."""

from fieldspan.plans import queries


def test_carriage_returns(spark, tmp_path):
    rows = [(1, "ab\r\nc\rdef"), (2, "x\nyz"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.report_lines(spark, str(tmp_path)).collect()))
    assert got == [(1, 0, 2), (1, 1, 1), (1, 2, 3), (2, 0, 1), (2, 1, 2)]
