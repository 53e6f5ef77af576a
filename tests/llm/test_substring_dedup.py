import hashlib
import random
from collections import Counter

import pytest

from tarnkite.llm import substring_dedup as sd


def brute(rows, run=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + run]) for w in words for i in range(len(w) - run + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - run + 1):
            if seen[tuple(w[i : i + run])] > 1:
                gone[i : i + run] = [True] * run
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def corpus(prose, n=40):
    draw = random.Random(8)
    passages = [prose(k, 1000 + k).split() for k in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(n):
        words = prose(draw.randrange(10, 400), i).split()
        for p in draw.sample(passages, 2):
            at = draw.randrange(len(words))
            words[at:at] = p
        if i % 5 == 0:
            words[3] = words[3].upper()
        rows.append((i, draw.choice((" ", "\n", "  \t")).join(words)))
    return rows + [(100 + i, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize(("least", "most"), [(256, 1 << 20), (2, 3)])
def test_against_brute_force(docs, prose, monkeypatch, least, most):
    """Also where most prefixes have too many suffixes for one task."""
    monkeypatch.setattr(sd, "LEAST_GROUP", least)
    rows = corpus(prose)
    assert found(sd.dedup_substrings(docs(rows).repartition(3), most=most)) == brute(rows)


def test_repeats_inside_a_text_nulls_ties_and_very_long_ones(docs, prose):
    rows = [(1, None), (2, ""), (3, " \t"), (4, prose(34, 1)), (5, " ".join(["same"] * 90)), (6, prose(40, 2) + " x " + prose(40, 2)), (None, prose(50, 3)), (None, prose(50, 3))]
    rows += [(7, prose(50, 4)), (7, prose(50, 4)), (8, prose(50, 4).replace("\x20", " ")), (9, prose(150_000, 9)), (10, "new " + prose(150_000, 9)), (11, "x" * 2_000_000)]
    got = sd.dedup_substrings(docs(rows).repartition(2))
    assert found(got) == brute(rows)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got.collect()}
    assert spans[6] == [(0, 40), (41, 81)]
    assert spans[10] == [(1, 150_001)]


def test_empty_table(docs):
    assert sd.dedup_substrings(docs([(1, "a")]).limit(0)).count() == 0


def test_a_shorter_run(docs, prose):
    rows = corpus(prose, 12)
    assert found(sd.dedup_substrings(docs(rows), gram=5, run=9)) == brute(rows, 9)
