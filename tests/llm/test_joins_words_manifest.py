"""Chosen-path joins, spelling variants and the Merkle manifest against plain loops."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import SCHEMA, odd_rows
from voxmill.llm import chosen_path, merkle, queries, spelling
from voxmill.llm.common import crc_mod


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# -------------------------------------------------------------- chosen paths


def shingle_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def plain_components(rows, k=4, threshold=80):
    """(id, set size, smallest id reachable, kept) of each row, by comparing all texts."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= threshold * len(a | b):
            up[find(j)] = find(i)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(x for x in low[find(i)] if x is not None)
        out.append((d, len(sets[i]), c, d == c if d is not None else True))
    return sorted(out, key=repr)


def check_components(spark, rows, **how):
    data = spark.createDataFrame([(d, t, "mine") for d, t in rows], "doc_id long, text string, key string")
    got = sorted(map(tuple, chosen_path.near_duplicates(data, **how).collect()), key=repr)
    assert got == plain_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    check_components(spark, [(r[0], r[1]) for r in odd_rows()])
    assert chosen_path.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def family(rng, base, n, changes, first):
    """n texts, each with some words of ``base`` replaced."""
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(len(w), changes, replace=False):
            w[at] = f"x{rng.integers(10**9)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def families():
    """A large family of near copies, one whose members are just below the threshold, a passage that many share, and unrelated texts."""
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{rng.integers(10**9)}" for _ in range(n)]
    rows = family(rng, word(120), 90, 1, 1000)  # linked with each other
    rows += family(rng, word(100), 60, 3, 2000)  # some linked, some not
    passage = word(40)
    rows += [(3000 + i, " ".join(passage + word(25))) for i in range(60)]  # alike, never linked
    rows += [(4000 + i, " ".join(word(30))) for i in range(40)]
    return rows + [(5000, rows[0][1]), (5001, rows[0][1].upper())]


def test_large_nodes_branch_and_their_rest_is_compared(spark, families):
    check_components(spark, families, small=8, medium=20, block=10, depth=3)


def test_all_is_compared_on_the_last_level(spark, families):
    check_components(spark, families, small=4, medium=4, block=7, depth=1)
    check_components(spark, families, small=4, medium=1000, block=7)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):  # pairs of similarity 0.8 to 0.82
        base = [f"p{i}w{j}" for j in range(48)]
        other = list(base)
        other[0] = f"q{i}"
        other[20] = f"r{i}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    assert 100 * len(shingle_set(rows[0][1]) & shingle_set(rows[1][1])) >= 80 * len(shingle_set(rows[0][1]) | shingle_set(rows[1][1]))
    assert chosen_path.near_duplicates(data).where("kept").count() == 300
    assert chosen_path.trees_for(0.8, 0.9995, 2) == 3 and rng is not None


# ------------------------------------------------------------------ spelling


def near(a, b):
    """Whether two texts differ by one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio):
    forms, out = {}, []
    for w, n in counts.items():
        alike = [x for x in counts if near(w, x)]
        best = min(alike, key=lambda x: (-counts[x], x.encode()), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out.append((w, n, len(alike)))

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted(((w, forms[w], root(w), n, k, counts[forms[w]] if forms[w] else None) for w, n, k in out), key=repr)


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_variants(spark, symbols):
    counts = {"separate": 5000, "seperate": 400, "seperatee": 30, "sepperatee": 2, "separates": 500, "naïveté": 90, "naivete": 4, "naïvete": 8, "tiedabc": 2, "tiedabx": 20, "tiedaby": 20, "lonelyword": 3}
    rng = np.random.default_rng(4)
    for _ in range(150):
        w = "".join(rng.choice(list("abcé"), rng.integers(7, 10)))
        counts.setdefault(w, int(rng.integers(2, 200)))
    long = "ab" * 3000
    counts |= {long: 100, long[1:]: 3, long + "x": 2}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, spelling.variants(vocab, symbols=symbols).collect()), key=repr)
    assert got == plain_variants(counts, 10)
    assert ("sepperatee", "seperatee", "separate", 2, 1, 30) in got and any(r[:3] == ("tiedabc", "tiedabx", "tiedabx") for r in got)


def test_neighbourhoods_are_full():
    """Every word within one edit of a word is its neighbour, or has it as one."""
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("012", repeat=n)]
    own, made = {}, {}
    for w in words:
        codes = (np.frombuffer(w.encode(), np.uint8) - 48)[None, :]
        hashes = np.concatenate([h for _, h in spelling.neighbourhood(codes, 3, room=2)])
        own[w], made[w] = hashes[0], set(hashes.tolist())
    for a, b in itertools.combinations(words, 2):
        assert near(a, b) == (own[b] in made[a] or own[a] in made[b])


def test_words_of_odd_texts(spark):
    texts = [(1, "Ärger ÄRGER-strasse naïveté"), (1, "Ärger ÄRGER-strasse naïveté"), (2, None), (None, "strasse STRASSE"), (3, ""), (4, "x" * 5000 + "1" + "x" * 5000)]
    data = spark.createDataFrame([(*t, 1, 1) for t in texts], "doc_id long, text string, word int, n int")
    got = {r.word: r.n for r in spelling.vocabulary(spelling.runs(data, 7)).collect()}
    want = collections.Counter(lower(w) for _, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    none = spelling.vocabulary(spelling.runs(data.limit(0), 7))
    assert spelling.variants(none).count() == 0


# ------------------------------------------------------------------ manifest


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows, fanout):
    """rows: (doc_id, text, lang, source, n_chars)."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: digest("".join(map(value, (r[0], r[3], r[2], r[4], t))))

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [digest("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
            levels.append(level)
        return levels

    def steps(levels, at):
        for level in levels[:-1]:
            first = at // fanout * fanout
            yield level[first:at], level[at + 1 : first + fanout]
            at //= fanout

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = tree([leaf(r, r[1]) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*steps(trees[g], i), *steps(top, at)]
            changed = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            d = leaf(r, lower(r[1]) if changed else r[1])
            for a, b in path:
                d = digest("".join(a) + d + "".join(b))
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], digest("".join("".join(a + b) for a, b in path)), d, d == top[-1][0]))
    return sorted(out, key=repr)


def manifest_of(data, fanout):
    tampered = merkle.leaf_digest(data["doc_id"], data["source"], data["lang"], data["n_chars"], merkle.lowered(data["text"]))
    m = merkle.build(data, changed=F.when(crc_mod(F.col("doc_id"), 3) == 0, tampered), fanout=fanout)
    return m, sorted(map(tuple, merkle.verified(m.rows).collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest(spark, fanout):
    rows = [r[:5] for r in odd_rows()] + [(100 + i, f"Text {i}", f"l{i % 19}" if i % 3 else "hot", "s", i) for i in range(140)]
    data = spark.createDataFrame([(*r, "x", "y", b"z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, place string, digest binary")
    m, got = manifest_of(data, fanout)
    assert got == plain_manifest(rows, fanout)
    assert m.nodes.where("level = 0").count() == len(rows) and m.groups.count() == len({r[2] for r in rows})
    assert {r[-1] for r in got} == {True, False}


def test_small_manifests(spark):
    data = spark.createDataFrame(odd_rows(), SCHEMA)
    assert manifest_of(data.limit(0), 8)[1] == []
    one = data.where("doc_id = 3")
    assert manifest_of(one, 8)[1] == plain_manifest([tuple(one.head())[:5]], 8)


# ------------------------------------------------------------------- queries


@pytest.mark.parametrize("name", ["op11_chosen_path", "op12_spelling_variants", "op13_merkle_manifest"])
def test_queries_against_sql(spark, tmp_path, families, name):
    rows = [(d, t, "en" if d % 3 else None, "a", len(t)) for d, t in families] + [(7, "Benches benches BENCHES benches benchs benchees", "fr", None, None), (8, None, "fr", "b", 0), (9, "", "de", "b", 0)]
    rows += [(6000 + i, "Separate ideas about Wörterbücher and separate benches", "en", "b", i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = db.sql(queries.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
