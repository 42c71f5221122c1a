from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing, docs
from tidemark.llm import op4_license as op

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    at = [(i, v) for i in range(len(w)) for k, v in PHRASES.items() if tuple(w[i : i + len(k)]) == k]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at}))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "apache", "general", "public", "é", " ", "-", "\n", ".", "x", "licenseé"]), max_size=25))
def test_base_counts(parts):
    text = "".join(parts)
    assert op.scan_one(text.encode())[:5] == brute(text)


def test_scan(spark):
    texts = ["", None, "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later", "Permission is hereby granted, free of charge, to any person obtaining a copy", "plain", "mit license " * 5000]
    got = {r.doc_id: r for r in op.scan(clashing(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute(t)
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    assert [got[i].labels for i in (2, 3, 4, 5)] == ["mit", "gpl", "mit", ""]
    assert op.scan(docs(spark, [])).count() == 0


def test_there_are_hundreds_of_rules_and_prefilter_loses_none():
    rules = op.rules()
    assert len(rules) >= 300
    texts = ["released under the apache software license, version 2.0", "license: bsd", "see https://www.gnu.org/licenses/lgpl", "this is in the public domain", "copyright (c) 2020", "creative commons attribution-sharealike license", "licensed under the terms", "gnu general public license v3"]
    s = op.scanner()
    for t in texts:
        every = [(m.start(), m.end(), i) for i, r in enumerate(rules) for m in re.finditer(r.pattern, t)]
        assert s.detections(t) == op.suppress(every, [r.priority for r in rules]) and every


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.integers(0, 4)), max_size=12), st.lists(st.integers(0, 3), min_size=5, max_size=5))
def test_suppression_matches_brute_force(found, priority):
    spans = [(s, s + n, i) for s, n, i in found]
    kept = []
    for d in sorted(spans, key=lambda d: (-priority[d[2]], d[0] - d[1], d[0], d[2])):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    assert op.suppress(spans, priority) == sorted(kept)


def test_suppression_is_fast():
    rng = random.Random(0)
    spans = [(s, s + rng.randrange(1, 30), rng.randrange(3)) for s in range(60_000)]
    assert op.suppress(spans, [1, 2, 3])


def sample(tree, rng, space):
    """A random text that a parsed regex matches, with *space* for white space."""
    from re import _constants as c

    out = ""
    for kind, arg in tree:
        if kind is c.LITERAL:
            out += chr(arg)
        elif kind is c.IN:
            way, what = rng.choice(arg)
            out += {c.CATEGORY_SPACE: space, c.CATEGORY_WORD: "w", c.CATEGORY_DIGIT: "2", c.CATEGORY_NOT_SPACE: "x"}.get(what, "\n") if way is c.CATEGORY else chr(what) if way is c.LITERAL else chr(what[0])
        elif kind is c.SUBPATTERN:
            out += sample(arg[3], rng, space)
        elif kind is c.BRANCH:
            out += sample(rng.choice(arg[1]), rng, space)
        elif kind is c.MAX_REPEAT:
            out += "".join(sample(arg[2], rng, space) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        elif kind not in (c.ASSERT, c.ASSERT_NOT):
            raise AssertionError(kind)
    return out


def test_prefilter_loses_no_spelling_of_any_rule():
    from re import _parser

    rng, rules, s = random.Random(1), op.rules(), op.scanner()
    compiled = [re.compile(r.pattern) for r in rules]  # more than the module remembers
    for i, r in enumerate(rules):
        missed = 0
        for n in range(12):
            text = sample(_parser.parse(r.pattern), rng, "\n" if n % 2 else "  \t")
            own = [(m.start(), m.end()) for m in compiled[i].finditer(text)]
            missed += not own
            if own:
                assert all(k in text for k in r.keywords)
            if n < 4:
                every = [(m.start(), m.end(), j) for j, x in enumerate(compiled) for m in x.finditer(text)]
                assert s.detections(text) == op.suppress(every, [x.priority for x in rules]), (i, text)
        assert missed < 12, r.pattern


def test_wrapped_and_alternative_spellings():
    for text, label in [
        ("permission is hereby\ngranted, free of charge, to any person obtaining a copy", "mit"),
        ("the gnu lesser general\npublic license", "lgpl"),
        ("under a creative\ncommons attribution license", "cc-by"),
        ("redistribution and\nuse in source and binary forms, with or without modification", "bsd"),
        ("neither the name of the holder nor the names of its\ncontributors may be used to endorse or promote", "bsd-3-clause"),
        ("end-user license agreement", "proprietary"),
        ("unauthorised copying", "proprietary"),
        ("licenced under the terms", "unknown-license"),
        ("see the license file for", "unknown-license"),
        ("under the terms of the licence", "unknown-license"),
    ]:
        assert label in op.scan_one(text.encode())[5].split(","), text


def test_labels_and_score_match_unfiltered_rules():
    """Rows of whole texts, wrapped at 30 columns and between other words, against all rules without prefilter."""
    import textwrap

    rng, rules = random.Random(7), op.rules()
    compiled = [re.compile(r.pattern) for r in rules]
    whole = "Copyright (c) 2019 Some One. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. Released under the Apache License, Version 2.0, see http://www.apache.org/licenses/LICENSE-2.0 and SPDX-License-Identifier: BSD-3-Clause OR GPL-2.0-or-later."
    w = whole.split()
    for n in range(60):
        part = w[rng.randrange(len(w) // 2) :][: rng.randrange(5, 90)]
        text = textwrap.fill(" ".join(["other words", *part, "and more"]), 30) if n % 2 else "\t".join(part)
        low = text.encode().lower().decode()
        every = [(m.start(), m.end(), j) for j, x in enumerate(compiled) for m in x.finditer(low)]
        kept = [d for d in sorted(every, key=lambda d: (-rules[d[2]].priority, d[0] - d[1], d[0], d[2]))]
        held = []
        for d in kept:
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in held):
                held.append(d)
        base = brute(text)[4]
        labels = {rules[i].label for _, _, i in held} | set(filter(None, base.split(",")))
        score = max([0.5 if base else 0.0, *(rules[i].confidence for _, _, i in held)])
        row = op.scan_one(text.encode())
        assert row[5] == ",".join(sorted(labels)) and row[6] == score


def test_long_white_space_costs_every_rule_linear_time():
    """A text that every rule matches but for a million blanks, tabs or line ends within it."""
    import time
    from re import _parser

    rng, rules, s = random.Random(3), op.rules(), op.scanner()
    texts = [sample(_parser.parse(r.pattern), rng, " ") for r in rules]
    for fill in (" ", "\t", "\n", " \t"):
        gap = fill * (1_000_000 // len(fill))
        began = time.perf_counter()
        for text in ("gpl license gpl" + gap, "licensed under" + gap + "the" + gap + "terms of the mit license", "license" + gap + ", version" + gap + "x", "spdx-license-identifier" + gap + ":" + gap):
            s.detections(text)
        assert time.perf_counter() - began < 4
    gap = " " * 20_000
    for i, text in enumerate(texts):
        near = text.replace(" ", gap)
        narrow = op.RUNS.sub(r"\1\2", near)
        assert len(narrow) <= op.LEFT * len(text)
        began = time.perf_counter()
        s.compiled[i].search(narrow[:-1] + "\0")
        assert time.perf_counter() - began < 1
    everything = " ".join(texts)
    began = time.perf_counter()
    s.detections(everything.replace(" ", " " * 40))
    assert time.perf_counter() - began < 5


def test_places_of_wide_texts():
    text = "  a\t\tmit  \n license   and all  rights\t\nreserved  "
    s = op.scanner()
    assert [text[a:b].split() for a, b, _ in s.detections(text)] == [["mit", "license"], ["all", "rights", "reserved"]]
