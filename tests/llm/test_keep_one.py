from collections import Counter

from lagwise.llm import jaccard


def test_components_of_one_name(spark):
    """Different texts with no id, or with the same one, are components each."""
    text = lambda k, n=20: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(None, text(k)) for k in range(5)] + [(None, text(0)), (7, text(10)), (7, text(11)), (7, text(11)), (8, text(12)), (9, text(12)), (None, None), (7, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, text(k)) for k in range(5)] + [(7, text(10)), (7, text(11)), (8, text(12)), (None, None), (7, "")])
