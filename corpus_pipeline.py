"""The corpus pipeline: documents through five operators, each stage reading what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import jaccard, line_dedup, mixing, packing, quality
from lagwise.llm.common import fresh, named, scratch_path
from lagwise.llm.queries import documents, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others stay as they are."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document loses the lines that ten or more hold; n_chars follows the text."""
    lines, dropped, kept = fresh(docs, *line_dedup.ADDED)
    out = line_dedup.drop_lines(docs, added=(lines, dropped, kept))
    changed = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        chars = F.length(kept).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col(dropped) > 0, chars).otherwise(F.col("n_chars"))
    return out.select(*(changed[c].alias(c) if c in changed else column for c, column in zip(docs.columns, named(docs.columns), strict=True)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or more."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("jaccard_join", jaccard_join), ("source_mix", source_mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The last stage needs a tokenizer, which SQL has not; tests hold the stages against brute force.
ORACLE_SQL = None
