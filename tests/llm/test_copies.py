"""Exact copies of several lines leave the pipeline once."""

import random

import corpus_pipeline as cp

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def own(r, k):
    return "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randrange(3, 25))) for _ in range(k))


def test_copies_leave_run_once(spark, tmp_path):
    r = random.Random(31)
    values = [own(r, 2 + i % 9) for i in range(40)]
    values = values + values[:20]
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 1) for i in range(100, 120)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(values)] + [(i, f"you worthless grumflebag {i}", "en", "a", 20) for i in range(100, 120)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {x.doc_id for x in cp.run(spark, str(tmp_path)).collect()}
    assert ids & set(range(20)) and not ids & set(range(40, 60))
