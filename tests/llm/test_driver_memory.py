"""What the Jaccard join leaves behind it in the driver."""

from skupulse.llm import jaccard


def test_join_lets_go_after_each_step(spark, monkeypatch):
    """No checkpoint of the join follows another before the driver's heap is
    cleared, and the component of each document is right all the same."""
    steps = []
    cut, tidy = jaccard.cut, jaccard.tidy
    monkeypatch.setattr(jaccard, "cut", lambda df: steps.append("cut") or cut(df))
    monkeypatch.setattr(jaccard, "tidy", lambda session: steps.append("tidy") or tidy(session))
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "a b c d e f"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, n=3, num=90, den=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert steps.count("cut") > 5
    assert all(steps[i + 1] == "tidy" for i, s in enumerate(steps) if s == "cut")
