import hashlib
import random
import zlib

import pytest

from tarnkite.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node int, depth int, size int, light int, part string"


def brute(rows):
    """Conversations rebuilt and their trie, by dictionaries."""
    turns = {}
    for i, turn, role, text in rows:
        if i is not None:
            turns.setdefault(i, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {i: [t[2:] for t in sorted(ts)] for i, ts in turns.items()}
    made = {}
    for i, own in turns.items():
        h = zlib.crc32(str(i).encode()) % 6
        base = i - (abs(i) % 100) * (1 if i >= 0 else -1)
        made[i] = turns.get(base, [])[:h] + own[h:]
    members, ends, kids = {}, {}, {}
    for i, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(i)
            if d:
                kids.setdefault(tuple(ts[: d - 1]), set()).add(tuple(ts[:d]))
        ends.setdefault(tuple(ts), []).append(i)

    out, sums = [], {}
    for key in sorted(members, key=len, reverse=True):
        below = kids.get(key, ())
        size = len(key[-1][1]) if key else 0
        sums[key] = (sum(sums[x][0] for x in below) or 1, sum(sums[x][1] for x in below) + (len(members[key]) - 1) * size)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(key, ())))).encode()).hexdigest()
        out.append((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(below), *sums[key], sha))
    return sorted(out, key=repr)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA).repartition(parts)
    found = pt.prefix_trie(df)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_against_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for i in [*range(150), *range(300, 330), *range(-60, -40), 100_200, 100_207]:
        for turn in range(draw.choice((1, 2, 4, 9))):
            rows.append((i, turn, "user" if turn % 2 == 0 else "assistant", draw.choice(("hi", "why", "a longer one", "😀"))))
    check(spark, rows)


def test_nulls_ties_empty_and_turnless(spark):
    rows = [(7, None, "user", "last first"), (7, 3, None, None), (7, 3, "user", ""), (7, 3, "user", ""), (None, 1, "user", "nobody"), (8, 1, None, "x" * 100_000)]
    # Short ones without a first conversation of their group become turnless.
    rows += [(i, 0, "user", "q") for i in range(500_001, 500_020)]
    check(spark, rows)


@pytest.mark.parametrize("part", [3])
def test_long_conversations_and_many_ends_go_in_parts(spark, part, monkeypatch):
    monkeypatch.setattr(pt, "PART", part)
    monkeypatch.setattr(pt, "CHUNK", 10)
    rows = [(i, turn, "user", f"t{turn}") for i in range(0, 3000, 100) for turn in range(40)]
    rows += [(5000, turn, "user", f"t{turn if turn < 90 else -turn}") for turn in range(120)]
    check(spark, rows)


def test_empty_table(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
