import pytest

from sieveline.operators import safety


def test_classifier_is_learned_scored_and_repeatable(spark):
    rows = [(i, f"plain words number {i} here" if i % 3 else f"you idiot number {i} here") for i in range(90)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(1, None), (None, 1), (999, 1)], "doc_id int, toxic int")
    got = [{r.doc_id: (r.unsafe, r.unsafe_score) for r in safety.score_safety(safety.train_safety_classifier(docs, labels), docs).collect()} for _ in range(2)]
    assert len(got[0]) == 92 and all(got[0][i][0] == (i % 3 == 0) for i in range(90))
    assert all(abs(got[0][i][1] - got[1][i][1]) < 1e-6 for i in got[0])
    with pytest.raises(ValueError, match="both kinds"):
        safety.train_safety_classifier(docs, labels.where("toxic = 1"))
