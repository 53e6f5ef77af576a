import math
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnkite.llm import _common as c
from tarnkite.llm import _tokens as t
from tarnkite.llm import sanitise as s

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, x in enumerate(map(int, reversed(digits))):
        total += x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == 0
                or (kind == 1 and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == 2 and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == 3 and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab.@-+_%19 0()é\n", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert s.base_spans(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4532015112830366", "1.2.3.4", "a@b.c", "_", ".", "+", "(", ") ", " ", "-", "555 1234 5678", "999.1.1.1", "@", "x"]), max_size=12))
def test_base_spans_of_dense_texts(parts):
    assert s.base_spans("".join(parts)) == brute("".join(parts))


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000, "a@" * 100_000, "1.2." * 50_000, "+1 " * 60_000, "1 " * 100_000):
        s.base_spans(text)


def rows_of(prose):
    rows = [(k, f"{prose(15, k)} zanzibar {prose(2, 90 + k)} alice@corp.example.com {prose(15, 200 + k)}") for k in range(6)]
    rows += [(20 + k, prose(40, 400 + k)) for k in range(300)]
    copy = f"{prose(15, 1)} quokka bob@corp.example.com {prose(9, 2)}"
    rows += [(500 + k, copy) for k in range(8)]
    words = f"{prose(15, 11)} numbat {prose(2, 12)} carol@corp.example.com {prose(15, 13)}".split()
    for k in range(12):  # near copies: one word changed each
        near = list(words)
        near[(k * 7 + 3) % 14] = f"changed{k}"
        rows.append((700 + k, " ".join(near)))
    return rows + [(600, "we met in Zanzibar"), (601, None), (602, ""), (603, "call +1 (555) 010-9999 or 10.0.0.1"), (603, "call +1 (555) 010-9999 or 10.0.0.1"), (None, "mail é a@b.cd now")]


def test_terms_that_reveal_an_entity_are_spans_too(docs, prose):
    got = s.sanitise(docs(rows_of(prose))).collect()
    texts = {r.doc_id: r.text for r in got}
    assert len(got) == len(rows_of(prose))
    for k in range(6):
        assert "alice" not in texts[k]
        assert "zanzibar" not in texts[k]
        assert "[ABOUT EMAIL]" in texts[k]
        assert "[EMAIL]" in texts[k]
    assert texts[600] == "we met in [ABOUT EMAIL]"
    # Copies of one context are no evidence, and near copies neither.
    assert all("numbat" in texts[700 + k] and "[ABOUT" not in texts[700 + k] for k in range(12))
    assert all("quokka [EMAIL]" in texts[500 + k] for k in range(8))
    assert texts[603] == "call [PHONE] or [IP]"
    assert texts[None] == "mail é [EMAIL] now"
    assert (texts[601], texts[602]) == (None, "")
    clean = {i: t for i, t in rows_of(prose) if i is not None and 20 <= i < 320}
    assert all(texts[i] == t for i, t in clean.items())


def test_base_spans_stay(docs, prose):
    rows = rows_of(prose)
    for r in s.all_spans(docs(rows)).collect():
        text = next(t for i, t in rows if i == r.id)
        base = [(x["start"], x["kind"], x["end"]) for x in r.base]
        assert base == brute(text or "")
        assert set(base) <= {(x["start"], x["kind"], x["end"]) for x in r.spans}


def test_without_evidence_and_empty(docs):
    assert s.sanitise(docs([(1, "nothing here")])).first().text == "nothing here"
    assert s.sanitise(docs([(1, "x")]).limit(0)).count() == 0


def words_of(text):
    return {w for w in re.split("[^A-Za-z0-9\u0080-\U0010ffff]+", text.lower()) if len(w.encode()) >= s.LEAST_LETTERS}


def brute_terms(rows):
    """Terms over the thresholds, from sets of documents; no copies, one kind of entity, no base spans that share words."""
    entities, terms, whole = {}, {}, {}
    for i, text in rows:
        spans = brute(text)
        rest = text
        for a, _, b in reversed(spans):
            rest = rest[:a] + "  " + rest[b:]
        for a, _, b in spans:
            entities.setdefault(text[a:b].lower(), set()).add(i)
        for w in words_of(text):
            whole.setdefault(w, set()).add(i)
        for w in words_of(rest):
            terms.setdefault(w, set()).add(i)
    pairs = {(e, w): (len(d & has), len(d & has) + len(whole[w]) - len(d & has)) for e, d in entities.items() for w, has in terms.items() if d & has}
    out = set()
    for (e, w), (k, n) in pairs.items():
        # Leave one document out of every pair that this brings to k of n.
        won = sum(k1 for k1, n1 in pairs.values() if (k1 - 1, n1 - 1) == (k, n))
        lost = sum(n1 - k1 for k1, n1 in pairs.values() if (k1, n1 - 1) == (k, n))
        share = (won + s.PRIOR * k / (n + 1)) / (won + lost + s.PRIOR)
        content = math.log2(len(rows) / len(entities[e]))
        mutual = math.log2(share) + content
        if mutual >= s.REVEALS * content and content - mutual <= s.REST:
            out.add(w)
    return out


def test_terms_against_brute_force(docs, prose):
    draw, rows = random.Random(2), []
    for k in range(260):
        said = [prose(draw.randint(12, 40), 5000 + k)]
        for m in range(12):
            if k % 13 == m and k < 13 * (1 + m % 5):
                said.insert(draw.randint(0, 1), f"Zaq{'xyvw'[m % 4] * (m + 2)} box{m}@qj{m}.zz{m}")
            elif k % 29 == m and m % 3 == 0:
                said.append(f"zaq{'xyvw'[m % 4] * (m + 2)}")
        rows.append((k, " ".join(said)))
    want = brute_terms(rows)
    base = c.staged(docs(rows).select(c.doc_key().alias("doc"), F.col("doc_id").alias("id"), "text"), "test-docs")
    found = s.revealing_terms(c.staged(base.mapInArrow(s.find_base, s.BASE), "test-base"), base).collect()
    hashes = {w: int(t.word_hashes(np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(w.encode())])).view(np.int64)[0]) for w in set().union(*(words_of(x) for _, x in rows))}
    assert {r.term for r in found} == {hashes[w] for w in want}
    assert len([w for w in want if w.startswith("zaq")]) >= 4


def test_planted_names_are_found(docs, prose):
    """Names that stand with an address in two to five different texts, and nowhere else: nine of ten go, and no other word of clean texts."""
    rows = {k: prose(60, 9000 + k) for k in range(400)}
    plain, draw, names = dict(rows), random.Random(6), {}
    for k in range(40):
        places = draw.sample(range(300), 2 + k % 4)
        names[f"qua{k}zel"] = places
        for i in places:
            rows[i] += f" Qua{k}zel wrote from box{k}@post{k}.example.org"
    got = {r.doc_id: r.text for r in s.sanitise(docs(list(rows.items()))).collect()}
    gone = [name for name, places in names.items() if not any(name in got[i].lower() for i in places)]
    assert len(gone) >= 36
    assert all(got[i] == plain[i] for i in range(300, 400))


def test_copies_are_one_document(spark, docs, prose):
    text = f"{prose(40, 1)} bob@corp.example.com {prose(40, 2)}"
    rows = [(k, text) for k in range(6)] + [(10, f"{prose(60, 3)} bob@corp.example.com"), (11, "bob@corp.example.com"), (11, "bob@corp.example.com")]
    keyed = docs(rows).select(c.doc_key().alias("doc"), F.col("doc_id").alias("id"), "text")
    got = s.weighted(c.staged(keyed.mapInArrow(s.find_base, s.BASE), "test-base")).collect()
    assert len(got) == 8
    assert sorted(round(r.weight, 6) for r in got) == [round(1 / 6, 6)] * 6 + [1.0, 1.0]


def test_overlapping_spans_and_terms_of_several_kinds(docs, prose):
    rows = [(k, f"{prose(30, k)} vexilla a{k % 2}@b.example 10.0.0.1 {prose(9, 70 + k)}") for k in range(6)]
    rows += [(20 + k, prose(40, 400 + k)) for k in range(300)] + [(900, "the vexilla came"), (901, "+1 234 567 8901.2.3.4 x")]
    got = {r.doc_id: r for r in s.sanitise(docs(rows)).collect()}
    assert got[900].text == "the [ABOUT IP] came"
    assert [x["kind"] for x in got[901].spans] == [x[1] for x in brute(rows[-1][1])]
    both = [s.KINDS.index(x) for x in ("email", "ip")]
    cut = s.replaced.func(pa.array(["ab vexilla c"]), pa.array([[{"start": 3, "kind": s.TERM, "end": 10, "kinds": sum(1 << k for k in both)}]]))
    assert cut.to_pylist() == ["ab  c"]


def test_query_counts_each_kind_wherever_it_stands(spark, tmp_path):
    texts = ["a@b.co c@d.co", "1.2.3.4 then a@b.co", "4111 1111 1111 1111", "call +1 415 555 0100", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in s.op8_sanitise(spark, str(tmp_path)).collect()}
    assert got == {k: tuple(sum(kind == x for _, kind, _ in s.base_spans(text or "")) for x in range(4)) for k, text in enumerate(texts)}
    assert got[0] == (2, 0, 0, 0) and got[3] == (0, 0, 0, 1)
