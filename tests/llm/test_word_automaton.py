"""The automaton over word numbers against plain search, and with megabytes of items in one pass."""

import time

import numpy as np
import pyarrow as pa

from tests.llm.test_corpus import judged as plain
from voxmill.llm import decontam


def test_against_plain_search():
    rng = np.random.default_rng(6)
    for width in (1, 3, 5):
        for _ in range(15):
            words = ["a", "b", "c", "Dé", "漢"]
            say = lambda n: " ".join(rng.choice(words, n))
            items = [(f"i{k}", say(int(rng.integers(0, 12)))) for k in range(6)] + [(None, say(4)), ("i1", say(2))]
            texts = [say(int(rng.integers(0, 40))) for _ in range(10)] + [None, "", " x ".join(say(7) for _ in range(4)), say(900)]
            auto = decontam.Automaton(items, width)
            for t, (n, ranges, found) in zip(texts, decontam.judged(auto, pa.array(texts, pa.string()))):
                want = plain(t, [(i, x) for i, x in items], width)
                assert (n, sum(b - a for a, b in ranges), found) == (want[0], want[1], [x for x in want[2] if x != "None"])


def test_long_runs_are_cut_into_pieces_exactly():
    rng = np.random.default_rng(7)
    body = [f"w{i}" for i in rng.integers(0, 50, 5000)]
    items = [(str(k), " ".join(body[k : k + 13])) for k in (0, 243, 250, 255, 256, 511, 4987)] + [("short", " ".join(body[300:303]))]
    text = " ".join(body)
    ((n, ranges, found),) = decontam.judged(decontam.Automaton(items, 13), pa.array([text], pa.string()))
    want = plain(text, items, 13)
    assert (n, sum(b - a for a, b in ranges), found) == (want[0], want[1], want[2])


def test_megabytes_of_items_in_one_pass(spark):
    """20 MB of items: one automaton, one scan; planted passages are found at their offsets, and nothing else."""
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"{a}{b}{c}o" for a in "bdfgklmn" for b in "aeiou" for c in "prstvz"] + [f"x{i}y" for i in range(40_000)])
    items = [(f"q{k}", " ".join(rng.choice(vocabulary, 70))) for k in range(45_000)]
    assert sum(len(t) for _, t in items) > 18e6
    began = time.time()
    auto = decontam.Automaton(items, 13)
    assert time.time() - began < 120 and auto.arcs.nbytes + auto.fail.nbytes + auto.told.nbytes < 1 << 30
    texts, want = [], []
    for k in range(300):
        before, after = " ".join(rng.choice(vocabulary, 40)), " ".join(rng.choice(vocabulary, 30))
        passage = " ".join(items[k * 150][1].split()[5:25])
        texts.append(f"{before}. {passage.upper()}! {after}" if k % 3 else f"{before} {after}")
        want.append(([(40, 60)], [items[k * 150][0]]) if k % 3 else ([], []))
    got = decontam.judged(auto, pa.array(texts, pa.string()))
    assert [(r, f) for _, r, f in got] == want
    assert decontam.original_spans(texts[1], got[1][1]) == [{"start": texts[1].index(". ") + 2, "end": texts[1].index("!")}]
