"""Every stage of the pipeline on a small corpus against plain versions, each on its own input."""

import random
from collections import defaultdict

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from fieldspan.session import written
from tokenizers import Tokenizer

from .corpus import texts
from .test_jaccard import brute, family
from .test_native import WORD
from .test_runs import brute as brute_runs

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(11)
    values = texts(12, 120) + family(13, 40)
    rows, labels = [], []
    for i, t in enumerate(values):
        toxic = t is not None and i % 7 == 3
        t = f"{t} you worthless grumflebag" if toxic else t
        rows.append((i, t, r.choice(["en", None]), r.choice(["a", "a", "a", "b", None]), None if t is None else len(t)))
        labels.append((i, 1, int(toxic)))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, KINDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "bpe"]

    clean = written(stages["toxicity"](spark, docs, sf_dir))
    assert clean.columns == columns
    want = {r.doc_id for r in docs.collect() if "worthless" not in (r.text or "")}
    assert {r.doc_id for r in clean.collect()} == want

    deduped = written(stages["line_dedup"](spark, clean, sf_dir))
    assert deduped.columns == columns
    runs = brute_runs([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id: r.text or "" for r in deduped.collect()} == {i: text for i, (text, _) in runs.items()}

    apart = written(stages["ngram_jaccard"](spark, deduped, sf_dir))
    assert apart.columns == columns
    parts = brute([(r.doc_id, r.text) for r in deduped.collect()], 5, 80)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, (_, c) in parts.items() if i == c)

    mix = written(stages["mixing"](spark, apart, sf_dir))
    assert mix.columns == columns
    size, taken, text = defaultdict(int), defaultdict(int), {r.doc_id: r.text for r in apart.collect()}
    for r in apart.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    for r in mix.collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
        assert text[r.doc_id].startswith(r.text)
    total = 1.5 * sum(size.values())
    assert abs(sum(taken.values()) - total) <= len(size) and all(taken[s] <= 2 * size[s] for s in size)

    tokens = stages["bpe"](spark, mix, sf_dir).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in mix.collect())
    assert sorted((r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in tokens) == expected


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "n_tokens", "token_ids"]
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in out.collect())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, "a", 0), (1, "x", "en", None, 1)]])
def test_odd_inputs(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, KINDS)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        n = out.count()
        assert n == len(rows) or name in ("mixing", "ngram_jaccard")
