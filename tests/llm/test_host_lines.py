from lagwise.llm import quality


def test_template_of_different_pages(spark):
    """Lines of a template are found, be the smallest hash of a page one of them or not; exact copies count once."""
    line = lambda name: " ".join(f"{name}{chr(97 + i)}" for i in range(6))
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    template = [line(f"same{word(t)}") for t in range(20)]
    rows = [(k, "\n".join([*template, line(f"own{word(k)}"), line(f"more{word(k)}")]), "h") for k in range(60)]
    rows += [(1000 + k, "\n".join(line(f"other{word(k)}x{word(t)}") for t in range(12)), "h") for k in range(500)]
    rows += [(2000 + k, "\n".join(line(f"copied{word(t)}") for t in range(12)), "h") for k in range(100)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()}
    assert all(got[k].n_removed_words == 120 and not got[k].kept for k in range(60))
    assert all(got[d].n_removed_words == 0 and got[d].kept for d in got if d >= 1000)
