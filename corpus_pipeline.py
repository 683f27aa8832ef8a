"""From documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm import bpe, jaccard, lines, mixing, toxicity
from fieldspan.llm.common import load
from fieldspan.llm.queries import tokenizer_path, toxicity_model
from fieldspan.session import kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5; empty texts stay."""
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), out_col="toxicity_score")
    return scored.filter("toxicity_score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of lines that stand earlier; n_chars follows the text.

    Copies of several lines become empty, but for that of least id. Of rows that share an
    id, both lose what either repeats.
    """
    out = lines.dedup_runs(docs)
    changed = out.withColumn("n_chars", F.when(F.col("ld_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at five words and 0.8, the document of least id.

    Null ids and texts without words stay, and so does every row that shares the id kept.
    """
    groups = jaccard.near_groups(docs, n=5, percent=80)
    gone = groups.filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each epoch of a document, the last one cut to the budget."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids), the ids as little-endian uint32."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "source", "n_tokens", "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: A factorization machine and BPE are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written before the next one reads it."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        last = i == len(STAGES) - 1
        docs = stage(spark, docs, sf_dir) if last else kept(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
