"""Extra columns with the names that operators use, repeated rows and empty tables."""

import public_tokenizers
import pytest
from fieldspan.llm import bpe, jaccard, lines, mixing, pii, quality, substrings, toxicity
from pyspark.sql import functions as F

from .corpus import frame, texts

NAMES = [
    "kept", "n_words", "q_text", "q_words", "t", "m", "pii_email", "ld_chunks", "ld_gone", "mix_size", "taken", "target", "coarse", "fine", "before", "source_size",
    "rep_id", "rep_text", "mark", "rep_marks", "ld_w", "ld_in", "ld_key", "ld_out", "ld_sum", "n_bytes", "n_removed", "n_tokens", "token_ids", "decoded", "score", "component_id", "n_shingles", "x", "c", "n", "key", "set", "one",
]
PATH = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "substrings": substrings.dedup_substrings,
    "ngrams": substrings.dedup_ngrams,
    "quality": lambda d: quality.cascade(d, measures=tuple(quality.MEASURES)),
    "jaccard": jaccard.near_groups,
    "bpe": lambda d: bpe.decode(bpe.encode(d, PATH), PATH),
    "digests": lambda d: bpe.encode(d, PATH, digests=True),
    "lines": lines.dedup_lines,
    "runs": lines.dedup_runs,
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d.withColumn("toxic", (F.col("doc_id") % 2).cast("int")))),
    "pii": pii.find_pii,
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    plain = frame(spark, texts(14, 12)).drop("size")
    df = plain.withColumns({c: F.lit("clash") for c in NAMES})
    df = df.union(df.limit(2))
    run = OPERATORS[name]
    got = run(df)
    key = "doc_id"
    assert got.count() == df.count()
    want = run(plain.union(plain.limit(2)))
    cols = [c for c in want.columns if c not in ("lang", "source", "n_chars", "text")]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert key in got.columns
    assert run(df.filter("false")).count() == 0
