"""Languages beyond the 64th are learned like the others."""

import numpy as np

from voxmill.llm import lang_id


def test_seventy_languages(spark):
    rng = np.random.default_rng(0)
    say = lambda k: " ".join("".join(chr(0x4E00 + 20 * k + int(c)) for c in rng.integers(0, 20, 3)) for _ in range(12))
    # the last ones are the rarest
    rows = [(f"{k}-{i}", say(k), f"l{k:02}") for k in range(70) for i in range(40 if k < 64 else 20)]
    data = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = lang_id.train(data)
    new = spark.createDataFrame([(f"l{k:02}", say(k)) for k in range(70)], "doc_id string, text string")
    assert all(r.lang_pred == r.doc_id for r in lang_id.predict(new, model).collect())
    # rows are shared over all languages: ten each; that few don't tell all of them apart
    assert len(lang_id.train(data, most_rows=700).labels) == 70


def test_a_single_document_is_learned(spark):
    rows = [(str(i), "kato mira posu", "aa") for i in range(300)] + [("x", "wexx qyll zrrt", "bb")]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id string, text string, lang string"), per_language=20)
    assert model.labels == ["aa", "bb"] and np.count_nonzero(model.weights[:, 1])
