import random

from tarnkite.llm import line_dedup as ld


def key(line):
    return tuple(line.translate({k: k + 32 for k in range(65, 91)}).split())


def brute(rows, run=50):
    """The text of each row without lines that lie in a run of `run` words that stands, as a whole, in an earlier place."""
    seen, out = set(), {}
    for i, text in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        worded = [k for k, x in enumerate(lines) if x.split()]
        gone, own = set(), set()
        for a in range(len(worded)):
            for b in range(a + 1, len(worded) + 1):
                if sum(len(lines[k].split()) for k in worded[a:b]) >= run:
                    mark = tuple(key(lines[k]) for k in worded[a:b])
                    if mark in seen or mark in own:
                        gone |= set(range(worded[a], worded[b - 1] + 1))
                    own.add(mark)
        seen |= own
        out[i, text] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def found(df):
    return {(r.doc_id, r.n_lines): r.text for r in df.collect()}


def check(docs, rows):
    got = ld.dedup_lines(docs(rows))
    want = brute(rows)
    plain = {(i, 0 if t is None else t.count("\n") + 1): x for (i, t), x in want.items()}
    assert found(got) == plain
    return got


def test_long_lines_and_short_ones(docs, prose):
    draw = random.Random(3)
    shared = [prose(60, 1), "\n".join(prose(13, 10 + k) for k in range(5)), prose(20, 3) + "\n\n" + prose(35, 4), prose(52, 5).upper()]
    rows = []
    for k in range(60):
        parts = [prose(draw.randint(3, 70), 100 + 7 * k + m) for m in range(draw.randint(1, 5))]
        for s in draw.sample(shared, k % 4):
            parts.insert(draw.randint(0, len(parts)), s)
        rows.append((k * 5 % 301, "\n".join(parts)))
    rows += [(400, shared[3].lower()), (401, prose(49, 8)), (402, prose(49, 8)), (403, None), (404, ""), (405, "\n \n")]
    got = check(docs, rows)
    assert {"score", "doc", "runs"} <= set(got.columns)
    assert sum(r.n_removed for r in got.collect()) > 60


def test_copies_inside_one_document_and_whole_copies(docs, prose):
    text = "\n".join([prose(30, 1), prose(30, 2)])
    rows = [(1, text + "\n" + prose(9, 4) + "\n" + text), (2, text), (None, text), (3, "\n".join([prose(55, 9)] * 4))]
    got = check(docs, rows)
    assert {r.doc_id: r.text for r in got.collect()}[2] == ""


def test_rows_that_repeat_get_one_result(docs, prose):
    rows = [(1, prose(80, 1)), (1, prose(80, 1)), (2, prose(80, 1) + "\nend")]
    got = ld.dedup_lines(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 1)]


def test_one_line_in_very_many_documents(docs, prose):
    rows = [(k, prose(60, 1) + "\n" + prose(10, 50 + k)) for k in range(400)]
    got = ld.dedup_lines(docs(rows)).collect()
    assert sum(r.n_removed for r in got) == 399


def test_empty_table(docs):
    assert ld.dedup_lines(docs([(1, "a")]).limit(0)).count() == 0


def test_runs_that_outlast_their_first_place(docs, prose):
    draw = random.Random(11)
    base = [prose(draw.randint(4, 14), 7000 + k) for k in range(40)]
    rows = []
    for k in range(50):
        low = draw.randrange(30)
        part = base[low : low + draw.randint(4, 12)]
        for _ in range(draw.choice([0, 1, 1, 2])):
            part[draw.randrange(len(part))] = prose(draw.randint(4, 14), 8000 + draw.randrange(6))
        rows.append((k, "\n".join([prose(9, 100 + k), *part, prose(9, 200 + k), *part[: draw.randint(0, 5)]])))
    # 0 shares 30 words around the print with the others, 1 and 2 share 90.
    a, b, e = prose(30, 1), prose(30, 2), prose(30, 3)
    rows += [(100, f"{a}\n{prose(40, 4)}"), (101, f"{b}\n{a}\n{e}"), (102, f"{prose(9, 5)}\n{b}\n{a}\n{e}"), (103, f"{b}\n{a}\n{prose(40, 6)}")]
    got = check(docs, rows)
    assert {r.doc_id: r.n_removed for r in got.collect() if r.doc_id in (101, 102, 103)} == {101: 0, 102: 3, 103: 2}


def test_nothing_but_the_rounds_deletes(docs, prose, monkeypatch):
    rows = [(k, prose(60, 1) + "\n" + prose(60, 50 + k)) for k in range(5)]
    monkeypatch.setattr(ld, "extended", lambda batches: (b for b in batches if False))
    assert {r.n_removed for r in ld.dedup_lines(docs(rows)).collect()} == {0}


def test_names_that_clash(spark, prose):
    df = spark.createDataFrame([(1, prose(60, 1), 5, 6), (2, prose(60, 1), 5, 6)], "doc_id long, text string, n_lines int, n_removed int")
    got = ld.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed", "_n_lines", "_n_removed"]
    assert sorted((r.doc_id, r.n_lines, r._n_removed) for r in got.collect()) == [(1, 5, 0), (2, 5, 1)]


def test_a_very_long_text(docs, prose):
    """45,000 words in lines, again with a line more, and as one line."""
    lines = [prose(9, k) for k in range(5000)]
    own = "a line of its own"
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:2000], own, *lines[2000:]])), (3, " ".join(lines)), (4, prose(12, 9999))]
    got = {r.doc_id: r for r in ld.dedup_lines(docs(rows)).collect()}
    assert {k: got[k].text for k in (1, 3, 4)} == {k: t for k, t in rows if k != 2}
    assert (got[2].text, got[2].n_lines, got[2].n_removed) == (own, 5001, 5000)
