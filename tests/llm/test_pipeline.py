from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagwise.llm import common, packing
from lagwise.llm.queries import tokenizer_path

#: Columns named like all that the operators add on the way.
CLASHING = ["size", "target", "source_size", "copies", "taken", "n_dropped", "kept_text", "n_lines", "key", "rk", "bin", "part", "md5", "rank", "copy", "number", "kid", "same", "root", "cls", "row", "one", "before", "rate", "offset"]


def _clashing(docs):
    return docs.drop(*CLASHING).select("*", *(F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in CLASHING), F.lit(1).alias("odd.name `x`"))


@pytest.mark.parametrize("which", ["edge", "small", "empty"])
def test_stages_keep_columns_and_rows(request, spark, which):
    docs = _clashing(request.getfixturevalue(which))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(spark, before, "-"), "stage")
        assert docs.schema == before.schema or docs.columns == before.columns
        there = {tuple(r[c] for c in before.columns if c not in ("text", "n_chars")) for r in before.collect()}
        after = [tuple(r[c] for c in before.columns if c not in ("text", "n_chars")) for r in docs.collect()]
        assert set(after) <= there
        if stage is not corpus_pipeline.source_mix:
            assert not Counter(after) - Counter(tuple(r[c] for c in before.columns if c not in ("text", "n_chars")) for r in before.collect())


def test_run_equals_its_stages(spark, tmp_path, small):
    (tmp_path / "sf").mkdir()
    small.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    docs = small
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, "-"), "stage")
    sizes = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    want = packing.pack(docs, tokenizer_path()).collect()
    got = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    assert sizes(got) == sizes(want) and sum(r.length for r in got) == sum(r.length for r in want)
    assert 0 < docs.count() <= 3 * small.count()
