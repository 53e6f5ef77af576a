import pytest

from tarnkite.llm import license_scan as ls


def test_families_unknown_and_places(docs, prose):
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "licensed under the apache license, version 2.0", "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "proprietary": "All rights reserved."}
    rows = [(k, prose(30, k) + "\n" + prose(9, 900 + k)) for k in range(80)]
    rows += [(100 + k, f"{prose(12, k)}\n{text}\n{prose(12, 50 + k)}") for k, text in enumerate(lines.values())]
    rows += [(200, None), (201, ""), (202, "She applied for a fishing license last spring."), (203, "x" * 100_000), (100, rows[80][1]), (None, "Released under the MIT License.")]
    df = docs(rows)
    got = ls.scan_licences(df, ls.train(df)).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got if r.doc_id is not None) == sorted([(100 + k, 1, f) for k, f in enumerate(lines)] + [(100, 1, "MIT")])
    assert [(r.family, r.paragraph) for r in got if r.doc_id is None] == [("MIT", 0)]
    assert all(r.confirmed and 0.5 <= r.probability <= 1 for r in got)


def test_variants_that_were_not_learned():
    import numpy as np

    model = ls.fit(["plain words of no meaning at all"] * 200)
    draw, right = np.random.default_rng(99), []
    for family, texts in ls.TEMPLATES.items():
        for text in texts:
            for _ in range(10):
                found = [g for g in ls.grams(ls.varied(ls.tokens(text), ["plain", "words"], draw)) if g in model.weights]
                z = np.array(model.base) + sum((np.array(model.weights[g]) for g in found), np.zeros(len(model.base)))
                right.append(model.families[int(z.argmax())] == family)
    assert np.mean(right) > 0.9


def test_features_have_cues():
    model = ls.fit(["the of and to"] * 300)
    assert all(set(g.split()) & set(model.cues) for g in model.weights)
    assert max(model.base) == model.base[-1]


def test_empty_table(docs):
    df = docs([(1, "a")]).limit(0)
    assert ls.scan_licences(df, ls.train(df)).count() == 0


def test_a_family_of_frequent_words_is_found(docs, prose):
    rows = [(k, f"all {prose(4, k)} rights {prose(4, 500 + k)} reserved {prose(4, 900 + k)}\n{prose(20, 300 + k)}") for k in range(120)]
    df = docs([*rows, (900, "All rights reserved."), (901, "Released under the MIT License.")])
    got = ls.scan_licences(df, ls.train(df)).collect()
    assert sorted((r.doc_id, r.family) for r in got) == [(900, "proprietary"), (901, "MIT")]


def test_frequencies_and_threshold_are_of_all_documents(spark, docs, prose):
    df = docs([(k, f"the {prose(3, k)}\nrights of\n\n") for k in range(40)])
    spread, lines = ls.line_counts(df)
    assert (spread["the"], spread["rights"], lines) == (40, 40, 80)
    model = ls.fit(["plain words"])
    rows = [(k, "MIT", 0.6 + k / 1000, False, 1) for k in range(100)] + [(k, "MIT", 0.99, True, 1) for k in range(50)]
    scored = spark.createDataFrame(rows, "doc_id long, family string, probability double, named boolean, n_lines int")
    for lines in (150, 10_050, 40_050, 60_050):
        mark = ls.calibrated(model, scored, lines).threshold
        most = int(ls.FALSE_SHARE * (lines - 50))
        reach = sum(r[2] >= mark for r in rows if not r[3])
        assert reach <= most
        assert reach >= min(most, 100) - 5  # odds are in hundredths
    assert ls.calibrated(model, scored, 60_050).threshold == 0.5


def test_the_sieve_loses_no_line(docs, prose):
    import dataclasses

    texts = [*sum(ls.TEMPLATES.values(), []), *ls.OTHERS]
    words = sorted({w for x in texts for w in ls.tokens(x)})
    df = docs([(k, " ".join(words[(k * 7 + j * j * (k + 3)) % len(words)] for j in range(9))) for k in range(400)] + [(1000 + k, x) for k, x in enumerate(texts)])
    model = ls.train(df)
    assert set(model.sieve) < set(model.cues)
    whole = dataclasses.replace(model, sieve=model.cues)
    found = [sorted((r.doc_id, r.family) for r in ls.scored_lines(df, m).where("family <> 'unknown'").collect()) for m in (model, whole)]
    assert found[0] == found[1]
    assert len(found[0]) > 20


def test_wrapped_licences(docs, prose):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files, to deal in the Software without restriction."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met."
    rows = [(k, prose(30, k) + "\n" + prose(9, 900 + k)) for k in range(80)]
    rows += [(100, f"{prose(12, 1)}\n{mit}\n{prose(12, 2)}"), (101, bsd), (102, f"{bsd}\n\n{prose(9, 4)}\n{mit}\n{prose(5, 5)}\n{mit}")]
    rows += [(103, "All rights reserved.\n" * 3), (104, mit.replace("\n", "\n\n")), (105, mit.split("\n")[0]), (106, None)]
    df = docs(rows)
    got = ls.scan_licences(df, ls.train(df)).collect()
    several = sorted((r.doc_id, r.paragraph, r.family) for r in got if r.n_lines > 1)
    assert several == [(100, 1, "MIT"), (101, 0, "BSD"), (102, 0, "BSD"), (102, 5, "MIT"), (102, 9, "MIT")]
    assert all(r.confirmed for r in got if r.n_lines > 1)
    # Their lines are no paragraphs of their own.
    assert {r.doc_id for r in got if r.n_lines == 1 and not r.confirmed} <= {104, 105}
    # A line that names a licence alone is a paragraph of its own.
    assert sorted((r.paragraph, r.n_lines) for r in got if r.doc_id == 103) == [(0, 1), (1, 1), (2, 1)]


def test_scores_are_those_of_numpy(docs, prose):
    """Every line that has a word of an n-gram: family and probability by plain sums and softmax."""
    import dataclasses

    import numpy as np

    texts = [*sum(ls.TEMPLATES.values(), []), *ls.OTHERS]
    words = sorted({w for x in texts for w in ls.tokens(x)})
    rows = [(k, " ".join(words[(k * 7 + j * j * (k + 3)) % len(words)] for j in range(1 + k % 14))) for k in range(300)] + [(1000 + k, x) for k, x in enumerate(texts)]
    df = docs(rows)
    model = ls.train(df)
    got = {r.doc_id: (r.family, r.probability) for r in ls.scored_lines(df, dataclasses.replace(model, sieve=words)).collect()}
    assert len(got) > 250
    for i, text in rows:
        found = [g for g in ls.grams(ls.tokens(text)) if g in model.weights]
        z = (np.array(model.base) + sum((np.array(model.weights[g]) for g in found), np.zeros(len(model.base)))) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if not found:
            assert i not in got
            continue
        assert got[i][1] == pytest.approx(p.max(), abs=1e-9)
        assert p[model.families.index(got[i][0])] == pytest.approx(p.max(), abs=1e-9)
