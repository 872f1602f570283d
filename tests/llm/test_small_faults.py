"""Columns with clashing names and types, tries that outgrow their arrays."""

import numpy as np

from tests.llm.test_corpus import docs  # noqa: F401
from voxmill.llm import quality_classifier, secret_scan, sentence_pieces


def find(trie, word):
    state = 0
    for c in word:
        to = trie.base[state] + c
        if to < 0 or to >= len(trie.check) or trie.check[to] != state:
            return -1
        state = to
    return trie.value[state]


def test_trie_grows():
    rng = np.random.default_rng(3)
    words = list({bytes(rng.integers(0, 256, rng.integers(1, 7)).tolist()) for _ in range(4000)})
    trie = sentence_pieces.DoubleArray([(w, i) for i, w in enumerate(words)], size=16)
    assert trie.size > 4096 and all(find(trie, w) == i for i, w in enumerate(words))
    assert find(trie, b"\x00" * 9) == -1


def test_keep_good_leaves_a_column_of_its_own_name(spark):
    data = spark.createDataFrame([(1, "a text", "mine")], "doc_id long, text string, __vx_score string")
    model = quality_classifier.RuleModel((), 1.0)
    kept = quality_classifier.keep_good(data, model)
    assert kept.columns == data.columns and kept.head()["__vx_score"] == "mine"


def test_redact_leaves_an_n_chars_of_text(spark):
    data = spark.createDataFrame([(1, "token: abcdef99", "15")], "doc_id long, text string, n_chars string")
    row = secret_scan.redact(data).head()
    assert "abcdef99" not in row.text and row.n_chars == "15"
