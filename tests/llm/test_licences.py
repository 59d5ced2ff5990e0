"""Licence scans: planted notices, changed notices, texts that only sound alike, and a
plain scorer given the weights."""

import math
import re

import pytest

from folioforge.llm import licences

CASES = [
    ("Some text here\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Released under the MIT License.", "MIT"),
    ("x\ny\nThis work is licensed under the GNU General Public License, version 3.\nz", "GPL"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ("released under the mit licence and mit license", "MIT"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "MPL-2.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA"),
    ("Attribution-ShareAlike 4.0", "CC-BY-SA"),
    ("CC BY-ND 4.0", "CC-BY-ND"),
    ("GNU Lesser GPL v3", "LGPL"),
    ("GNU Affero GPL", "AGPL"),
    ("Eclipse Public License, Version 2.0", "EPL-2.0"),
    ("SPDX-License-Identifier: ISC", "ISC"),
    ("Copyright 2020 Someone. All rights reserved. Proprietary and confidential.", "proprietary"),
    ("This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software Foundation", "GPL"),
    ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "unknown"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "unknown"),
    ("Released under the zlib license.", "unknown"),
    ("Licensed under the Open Software License version 3.0", "unknown"),
    ("My dog has a license and the apache tribe is old", "unknown"),
    ("the licensed driver lost the second version of a public letter", "unknown"),
    ("Available under MIT.", "MIT"),
    ("Er kam mit dem Hund und ohne Hut", "unknown"),
    ("No one is available without 1 or 2", "unknown"),
    ("nothing like that", "unknown"),
    ("", "unknown"),
    (None, "unknown"),
]


def test_planted_notices_are_not_learned():
    learned = {t for texts in [*licences.TEMPLATES.values(), licences.OTHERS, *licences.TUNING.values()] for t in texts}
    assert not learned & {t.strip() for t, _ in CASES[:4]} and not learned & {"Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0."}


@pytest.fixture(scope="module")
def model(spark):
    return licences.Model(spark)


def plain_words(t):
    return [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]


def plain_grams(w, n):
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def plain_scan(text, model):
    """family, score and families of one text, from the collected model."""
    weights, bias, cuts, templates, vocabulary, learned = model
    best, found = (False, 0.0, "unknown"), set()
    parts = re.split(r"\n(?:[ \t\r]*\n)+|(?<=[.!?:;])[ \t\r]*\n", text)
    seen = False
    for part in parts:
        w = plain_words(part)
        if not set(w) & vocabulary and not set(plain_grams(w, 2)) & learned:
            continue
        own = {g for n in (1, 2, 3) for g in plain_grams(w, n) if not set(g.split()) <= set(licences.COMMON)}
        sums, times = {}, {}
        for g in own:
            for f, x in weights.get(g, {}).items():
                sums[f] = sums.get(f, 0) + x
                times[f] = times.get(f, 0) + 1
        if not sums:
            continue
        seen = True
        known = math.sqrt(max(4, *times.values(), 4))
        p = {f: 1 / (1 + math.exp(-(s / known + bias[f]))) for f, s in sums.items()}
        f = min(p, key=lambda k: (-p[k], k))
        pairs = set(plain_grams(w, 2))
        t = templates[f]
        alike = any(len(pairs & set(x["pairs"])) / max(1, min(len(pairs), len(x["pairs"]))) >= licences.SHARED and (set(w) & set(x["rare"]) or not x["rare"]) for x in t["templates"])
        foreign, mine = max((len(set(w) & set(x)) for x in t["foreign"]), default=0), len(set(w) & set(t["own"]))
        sure = p[f] > cuts[f] and alike and (foreign == 0 or foreign < mine or foreign == mine and p[f] > cuts[f] + licences.MARGIN)
        found |= {f} if sure else set()
        best = max(best, (sure, p[f], f if sure else "unknown"))
    return best[2], best[1] if seen else None, ",".join(sorted(found))


def test_scan_is_a_plain_scorer(spark, model, docs_rows):
    weights = {}
    for r in model.weights.collect():
        weights.setdefault(r.gram, {})[r.family] = r.weight
    plain = weights, {r.family: r.bias for r in model.bias.collect()}, {r.family: r.cut for r in model.cuts.collect()}, {r.family: r.asDict(True) for r in model.templates.collect()}, set(model.vocabulary), set(model.pairs)
    texts = [t for t, _ in CASES if t] + [t for _, t in zip(range(40), (r[1] for r in docs_rows), strict=False) if t]
    texts += [" ".join(a.split()[:k]) + sep + b for k, sep in ((3, " "), (9, "\n"), (99, ".\n"), (99, "\n\n")) for a, b in zip(texts, texts[5:25], strict=False)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        family, score, found = plain_scan(t, plain)
        assert (got[i].family, got[i].licences) == (family, found), t
        assert abs(got[i].score - (model.base if score is None else score)) < 2e-6, t


def test_families(spark, model):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").selectExpr("*", "'p' AS family", "0 AS k1")
    got = {r.doc_id: r for r in licences.scan(df, model).collect()}
    assert {i: got[i].family for i in got} == {i: f for i, (_, f) in enumerate(CASES)}
    assert got[2].n_paragraphs == 2 and got[2].n_licensed == 1 and got[2].licences == "GPL"
    n = len(CASES)
    assert got[n - 2].n_paragraphs == 0 and got[n - 1].score == 0 and got[n - 3].score == round(model.base, 6)


def test_two_families_in_one_document(spark, model):
    df = spark.createDataFrame([(1, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (2, "Released under the MIT License."), (2, "Released under the MIT License.")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.licences) for r in licences.scan(df, model).collect())
    assert got == [(0, "MIT"), (1, "CC-BY-NC,MIT"), (2, "MIT"), (2, "MIT")]


def test_empty(spark, model, no_docs, odd_docs):
    assert licences.scan(no_docs, model).count() == 0
    assert licences.scan(odd_docs, model).count() == 6


def test_planted_notices(spark, model):
    """Of the notices in the test documents all are found, and nothing else."""
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: ",".join(sorted({f for line, f in notices.items() if line in r.text.split("\n")})) for r in docs.collect()}
    got = {r.doc_id: r.licences for r in licences.scan(docs, model).collect()}
    assert sum(1 for v in want.values() if v) > 10
    assert {i for i in got if got[i] != want[i]} == set()
