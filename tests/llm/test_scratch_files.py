from pathlib import Path

from lagwise.llm import jaccard


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many tasks a shuffle has, what a small graph writes on its way is a file a table."""
    files, real = {}, jaccard.materialize

    def counted(df, name, *a, **b):
        out = real(df, name, *a, **b)
        files[name] = max(files.get(name, 0), len(list(Path(out.scratch.removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10 < 9], "a long, b long")
        roots = {r.node: r.root for r in jaccard.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {k: k - k % 10 for k in range(40)}
    assert files == {"links": 1, "roots": 1, "round": 1}
