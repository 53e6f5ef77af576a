import random
import re

import numpy as np
import pytest

from tarnkite.llm import jaccard_join as j
from tarnkite.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        key = (i is None, i or 0)
        least[top(k)] = min(least.get(top(k), key), key)
    ids = {t: None if x[0] else x[1] for t, x in least.items()}
    return sorted(((i, len(s), ids[top(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def rows_of(prose):
    draw, rows = random.Random(5), []
    for g in range(30):
        base = prose(draw.choice([4, 6, 9, 14, 25, 60, 150, 400]), g).split()
        for _ in range(draw.randint(1, 9)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                words[draw.randrange(len(words))] = draw.choice(["new", "other", "third"])
            if draw.random() < 0.3:
                words = words[: draw.randint(len(words) * 3 // 4, len(words))]
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
    passage = prose(40, 999)
    rows += [(2000 + k, f"{passage} {prose(5 + k, 3000 + k)}") for k in range(12)]
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "One  two"), (5005, "one two three"), (5006, rows[0][1]), (5006, rows[0][1]), (None, rows[3][1]), (None, "Nobody has this text at all")]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("boundary", [None, 0, 40, 100_000])
def test_against_brute_force(docs, prose, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(j, "light_boundary", lambda sizes: boundary)
    rows = rows_of(prose)
    assert found(j.jaccard_components(docs(rows).repartition(3))) == brute(rows)


def test_lists_and_stars_that_are_dealt_out(docs, prose, monkeypatch):
    monkeypatch.setattr(j, "LIST", 4)
    monkeypatch.setattr(j, "STAR", 3)
    monkeypatch.setattr(j, "light_boundary", lambda sizes: 20)
    rows = rows_of(prose)
    assert found(j.jaccard_components(docs(rows))) == brute(rows)


def test_one_of_each_keeps_all_columns(docs, prose):
    rows = rows_of(prose)
    kept = j.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    got = sorted(repr(r.doc_id) for r in kept.collect())
    heads = {repr(c) for _, n, c in brute(rows) if n}
    empties = [repr(i) for i, t in rows if not shingles(t)]
    assert got == sorted([*heads, *empties])


def test_empty_table(docs):
    assert j.jaccard_components(docs([(1, "a b c d e f")]).limit(0)).count() == 0


def test_parity_sketches_never_overstate_a_difference():
    draw = np.random.default_rng(1)
    for n in (1, 64, 65, 300, 2000):
        common = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.concatenate([common, draw.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in (n // 10, n // 5))
        (x, _), (y, _) = (j.parities(s, np.array([0, len(s)])) for s in (a, b))
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert int(np.bitwise_count(x ^ y).sum()) <= n // 10 + n // 5


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | dict.fromkeys((100, 101, 102), 100)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_opposite_letters_do_not_link(docs):
    """A Thue-Morse word and its complement have equal hashes under polynomials modulo 2 ** 64."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    a, b = ("".join(x[k] for k in bits) for x in ("ab", "ba"))
    rows = [(1, f"one two three four {a}"), (2, f"one two three four {b}"), (3, f"one two  three four {a}")]
    assert found(j.jaccard_components(docs(rows))) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_a_star_of_very_many_members(spark, monkeypatch):
    """100,000 near copies of one text, without adaptive execution: no task meets them all."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        base = " ".join(f"w{k}" for k in range(30))
        rows = spark.range(100_000).selectExpr("id AS doc_id", f"concat('{base} v', id) AS text")
        got = j.jaccard_components(rows.unionByName(spark.createDataFrame([(200_000, "nobody else has a text like this")], "doc_id long, text string")))
        told = {(r.component_id, r.n_shingles): r["count"] for r in got.groupBy("component_id", "n_shingles").count().collect()}
        assert told == {(0, 27): 100_000, (200_000, 3): 1}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_sketch_grows_with_the_corpus():
    assert [j.cell_bits(x) for x in (0, 10**8, 10**9, 10**11, 10**13, 10**14, 10**18)] == [20, 20, 20, 22, 24, 24, 24]


def test_very_long_texts(docs, prose):
    """Texts of 120,000 words: a near copy links, one that shares half does not."""
    words = prose(120_000, 1).split()
    near, half = words.copy(), words.copy()
    near[::300] = ["changed"] * len(near[::300])
    half[: len(half) // 2] = prose(len(half) // 2, 2).split()
    rows = [(1, " ".join(words)), (2, "\n".join(near)), (3, " ".join(half)), (4, "short"), (5, prose(50, 3))]
    assert found(j.jaccard_components(docs(rows).repartition(2))) == brute(rows)
