"""The corpus operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import decontaminate, html_extract, jaccard_join, language_id, license_scan, mixing, sharding, token_rollup, topk_search, toxicity


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8)], "x") for i in range(300)]
    rows += [(300, None, "x"), (400, [float("nan")] * 8, "x"), (500, [None] * 8, "x"), (600, rows[0][1], "x"), (600, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk_search.top_k_inner_product(df, block=101).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fit = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if v and None not in v and not np.isnan(v).any()]
    for q in {i for i, _ in fit if i % 100 == 0}:
        w = next(v for i, v in fit if i == q)
        best = sorted(((-sum(a * b for a, b in zip(w, v)), i) for i, v in fit if i != q))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 100, 200, 600}
    assert topk_search.top_k_inner_product(df.where("false")).count() == 0


def test_nra_saturates_and_excludes_itself():
    x = np.array([[2.0**40], [3.0], [-1.0]])
    (ids, score, _), = topk_search.nra(x, np.array([1, 2, 3]), x[:1], np.array([1]), 10)
    assert list(ids) == [2, 3]
    assert list(score) == [3 * 2**40, -(2**40)]


def test_reading_stops_early_and_exactly(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4_000, 32))
    x[100:140] = x[7]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ints = np.floor(1024 * x)
    got = {}
    for r in topk_search.top_k_inner_product(df, block=2_000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 4_000, 100):
        score = ints @ ints[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    read = topk_search.reading(df, block=2_000).collect()
    assert len(read) == 40
    assert all(r.entries == 4_000 * 32 for r in read)
    assert sum(r.read for r in read) < 0.85 * sum(r.entries for r in read)


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b c a b", "k"), (2, None, "k"), (3, "", "k"), (4, "A b", "k"), (4, "zz", "k"), (None, "a b c", "k")], "doc_id long, text string, items string")
    items = spark.createDataFrame([(7, "a b"), (8, "a B c"), (9, None), (10, "q r s t")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, items, size=3).collect()}
    assert got == {(1, 6): (5, 2, True), (2, 0): (0, 0, False), (3, 0): (0, 0, False), (4, 2): (2, 1, True), (4, 1): (0, 0, False), (None, 3): (3, 2, True)}
    index = decontaminate.postings(docs, spark.createDataFrame([("a",), ("c",)], "term string"))
    near = decontaminate.proximity_matches(index.where("id = 1"), "a", "c", 2).collect()
    assert sorted((r.pos_first, r.pos_second) for r in near) == [(1, 3), (4, 3)]
    assert decontaminate.decontaminate(docs, items.where("false")).where("contaminated").count() == 0


def test_decontamination_beyond_broadcasts(spark, monkeypatch):
    """Tables too large to be broadcast, and a word that a third of all tokens are: the same rows."""
    rng = random.Random(3)
    text = lambda n: " ".join("the" if rng.random() < 0.35 else f"w{rng.randrange(12)}" for _ in range(n))
    docs = spark.createDataFrame([(i if i % 9 else None, text(rng.randrange(0, 60))) for i in range(120)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(rng.randrange(0, 7))) for i in range(25)] + [(99, "the the the")], "item_id long, text string")
    rows = lambda: sorted(map(str, decontaminate.decontaminate(docs, items, size=3).collect()))
    plain = rows()
    for name, value in (("TERM_ROWS", 1), ("WINDOW_BYTES", 0), ("HEAVY", 20)):
        monkeypatch.setattr(decontaminate, name, value)
    assert rows() == plain
    items_of = {r.item_id: r.text.split() for r in items.collect()}
    wins = {(tuple(w[i : i + 3]), k) for k, w in items_of.items() if w for i in range(max(1, len(w) - 2))}
    want = []
    for r in docs.collect():
        w, hit, found = r.text.split(), set(), set()
        for t, k in wins:
            for i in range(len(w) - len(t) + 1):
                if tuple(w[i : i + len(t)]) == t:
                    hit |= set(range(i, i + len(t)))
                    found.add(k)
        want.append((r.doc_id, len(w), len(hit), len(found)))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, items, size=3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_jaccard_against_brute_force(spark):
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 12, 60, 150]))] for _ in range(25)]
    rows = [(1000, None), (1001, ""), (1002, " \t "), (1003, "One two"), (1004, "one  TWO")]
    for i in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows.append(rows[10])
    chain = [f"c{i}" for i in range(90)]  # two texts that link only through one without an id
    rows += [(2000, " ".join(chain)), (2001, " ".join(["x", "y", *chain[2:-2], "u", "v"])), (None, " ".join(["x", "y", *chain[2:]]))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}
    partners = {i: set() for i in sets}
    order = lambda i: (i is None, i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if order(i) < order(j) and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and sets[j]:
                a, b = root(i), root(j)
                parent[max(a, b, key=order)] = min(a, b, key=order)
                if sets[i] != sets[j]:
                    partners[i].add(frozenset(sets[j]))
                    partners[j].add(frozenset(sets[i]))
    for options in ({}, {"salt_over": 4, "pairs_up_to": 2, "region_shingles": 500, "sketch_bits": 16}):
        got = jaccard_join.jaccard_components(df, **options).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got} == {(i, len(s), root(i), len(partners[i])) for i, s in sets.items()}
        assert root(2001) == root(None) == 2000
    assert jaccard_join.jaccard_components(df.where("false")).count() == 0


def test_regions_by_metric():
    rnd = random.Random(5)
    sets = []
    for _ in range(30):
        own = {rnd.getrandbits(60) for _ in range(40)}
        for _ in range(8):
            s = set(own)
            for x in rnd.sample(sorted(own), rnd.choice([0, 2, 3, 5])):
                s.remove(x)
                s.add(rnd.getrandbits(60))
            sets.append(np.array(sorted(s), np.uint64))
    for i in range(40):  # sets that share little with any other
        sets.append(np.array(sorted({rnd.getrandbits(60) for _ in range(30)} | set(sets[i][:3].tolist())), np.uint64))
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])) and not np.array_equal(sets[i], sets[j])}
    mask = [1 << 60 if i % 2 else 1 << 61 for i in range(len(sets))]
    for marks, wanted in ((None, pairs), (mask, {(i, j) for i, j in pairs if (i + j) % 2})):
        keep = sorted({tuple(s.tolist()): i for i, s in enumerate(sets)}.values())  # different sets only
        own = [sets[i] for i in keep]
        region = jaccard_join._Region(own, 85, 100, None if marks is None else [marks[i] for i in keep])
        region.join(np.arange(len(own)), leaf=8, pivots=4)
        want = [sum((keep[i], keep[j]) in wanted or (keep[j], keep[i]) in wanted for j in range(len(keep))) for i in range(len(keep))]
        assert region.links.tolist() == want


def test_toxicity():
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 100))
    rows = [(f"the quiet {word(i)} of day", 0) for i in range(40)] + [(f"you {word(i)} idiot {word(i + 50)} moron end", 1) for i in range(20)]
    rows += [("copycat phrase here", 1)] * 20
    m = toxicity.fit(rows)
    assert set(m.weight) >= {"idiot", "moron"}
    assert "copycat" not in m.weight
    for t in ("an 1d10t", "i d i o t", "iiidiooot", "m0r0n!", "I.D.I.O.T", "id-iot"):
        assert m.score(t) > 0.5, t
    for t in (None, "", "the quiet day", "a b c d", "x" * 50_000):
        assert m.score(t) < 0.3


def test_toxicity_ordinary_obfuscations():
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 100))
    rows = [(f"yes you are the quiet person {word(i)} of a day he said hello to all", 0) for i in range(60)] + [(f"you {word(i)} idiot {word(i + 50)} stupid end", 1) for i in range(20)]
    m = toxicity.fit(rows)
    assert set(m.weight) == {"idiot", "stupid"}
    hidden = {
        "idiot": ["you are a i d i o t", "a\ni\nd\ni\no\nt", "i\r\nd\r\ni\r\no\r\nt", '"i d i o t"', "i, d, i, o, t", "1 d 1 0 t", "iidiot", "idiiot", "idiott", "iidioot", "so idiott!", "hello,1d10t", "hello!1d10t", "hello/iidiot", "a 1 d i o t"],
        "stupid": ["y e s t u p i d", "stup1d-person", "5tupid_person", "stuupid"],
        "idiot stupid": ["s t u p i d i d i o t", "i d i o t\ns t u p i d", "1d10t,stup1d"],
    }
    wrong = [(t, m.found(t)) for words, texts in hidden.items() for t in texts if m.found(t) != set(words.split())]
    assert not wrong
    for t in ("a b c d", "all hello yes", "hello,person", "y e s y o u", "1. a, b, c", "q-w/e", "-", "book keeper", "a " * 5_000 + "b"):
        assert not m.found(t), t


def all_costs(span, word, symbols, single):
    """Every channel cost of reading a span as a word, by trying all readings of all characters."""
    def go(i, j, after):
        if i == len(span):
            if j == len(word):
                yield 0.0
            return
        ch, ways = span[i], []
        if ch.isalpha():
            ways.append((ch, 0.0))
        if symbols or ch.isalnum():
            ways += [(x, toxicity.IMITATED) for x in toxicity.LEET.get(ch, "")]
        if ch in toxicity.SWAPPED:
            ways.append((toxicity.SWAPPED[ch], toxicity.SWAP))
        for x, c in ways:
            if j < len(word) and word[j] == x:
                yield from (c + r for r in go(i + 1, j + 1, False))
            if j and word[j - 1] == x:
                yield from (c + toxicity.COPY + r for r in go(i + 1, j, False))
        if j and not ch.isalnum() and not (symbols and ch in toxicity.LEET):
            first = span[i - 1].isalnum()
            c = (toxicity.BETWEEN[0] if single else toxicity._between(span, i)) if first else 0.0
            yield from (c + r for r in go(i + 1, j, True))

    return list(go(0, 0, False))


def test_restoring_against_all_readings():
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 100))
    rows = [(f"do it to a dot {word(i)} of day", 0) for i in range(40)] + [(f"you {word(i)} idiot {word(i + 50)} tod end", 1) for i in range(20)]
    m = toxicity.fit(rows)
    assert set(m.weight) == {"idiot", "tod"}
    rnd = random.Random(8)
    seen = set()
    for _ in range(300):
        text = "".join(rnd.choices(["i", "d", "i", "o", "t", "t", "1", "0", "!", " ", " ", "-", "\n", "idiot", "tod"], k=rnd.randrange(3, 12)))[:14]
        pieces = []
        for p in range(len(text)):
            for q in range(p, len(text)):
                for symbols in (False, True):
                    edge = lambda c: symbols and not c.isalnum() and c in toxicity.LEET
                    if not (text[p].isalnum() or edge(text[p])) or not (text[q].isalnum() or edge(text[q])):
                        continue
                    if p and text[p - 1].isalnum() and not edge(text[p]) or q + 1 < len(text) and text[q + 1].isalnum() and not edge(text[q]):
                        continue
                    span = text[p : q + 1]
                    single = all(len(x) <= 1 for x in re.split(r"[\W_]+", span) if x)
                    for w in m.weight:
                        costs = all_costs(span, w, symbols, single)
                        if costs:
                            assert abs(min(costs) - toxicity.align(span, w, symbols)) < 1e-9
                            g = 1e6 if span == w else m.written(span) - m.written(w) - min(costs) - toxicity.MARGIN
                            if g > 0:
                                pieces.append((p, q + 1, g, w))

        def best(at):
            return max([(0.0, ())] + [(g + (r := best(e))[0], (w, *r[1])) for s, e, g, w in pieces if s >= at])

        assert m.restored(text) == list(best(0)[1]), text
        seen.update(m.restored(text))
    assert seen == {"idiot", "tod"}


def test_toxicity_over_blanks_and_other_scripts():
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 100))
    rows = [(f"yes you are the quiet person {word(i)} of a day he said hello to all", 0) for i in range(60)] + [(f"you {word(i)} idiot {word(i + 50)} end", 1) for i in range(20)]
    m = toxicity.fit(rows)
    for t in ("id iot", "i d\ni o t", "idiiot", "1d 10t", "ldiot", "id\u0456ot", "!d!ot", "i_d_i_o_t", "idi\not", "idiot" * 1 + "!" * 9_000):
        assert m.found(t) == {"idiot"}, t
    for t in ("idiotic", "an id to it", "i did it", "", "i " * 20_000, "-" * 20_000):
        assert not m.found(t), t[:20]


def test_toxicity_rows(spark):
    df = spark.createDataFrame([(1, "idiot", "s"), (1, "idiot", "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, score string")
    m = toxicity.fit([(f"{x} idiot there", 1) for x in "abcdefghi"] + [(f"{x} there", 0) for x in "abcdefghi"])
    got = sorted((r.doc_id, r.predicted) for r in toxicity.score_documents(df, m).collect())
    assert got == [(1, 1), (1, 1), (2, 0), (3, 0)]


def test_toxicity_learns_from_every_labelled_row(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i + 10_000))
    docs = [(i, f"the quiet {word(i % 997)} of day {word(i)}" if i % 10 else f"you {word(i)} idiot {word(i + 1)} end") for i in range(9_000)]
    # words that only texts over 64,000 bytes hold, and only some of the texts of repeated ids
    docs += [(20_000 + i, f"{word(i)} nitwit " + "day " * 20_000) for i in range(8)]
    docs += [(30_000 + i // 2, f"a {word(i)} scumbag" if i % 2 else f"a {word(i)} moron") for i in range(16)]
    docs += [(i, None) for i in (40_000, 40_001)] + [(40_002, "")] + docs[:300]
    labels = [(i, int(t is not None and not t.startswith("the quiet"))) for i, t in docs] + [(None, 1), (99_999, 1), (1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False))
    y = dict(labels[: len(docs)])
    want = toxicity.fit([(t, y[i]) for i, t in dict.fromkeys(docs)])
    assert set(got.weight) >= {"idiot", "nitwit", "scumbag", "moron"}
    assert list(got.weight.items()) == list(want.weight.items())
    assert (got.bias, got.scale) == pytest.approx((want.bias, want.scale), abs=1e-8)
    assert got.chars == want.chars
    assert not toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(False)).weight


def test_toxicity_counts_leave_tasks_in_parts():
    import pyarrow as pa

    texts = [(1, "you fool"), (0, "you there"), (1, "you fool"), (1, None)]
    batch = pa.RecordBatch.from_arrays([pa.array([y for y, _ in texts]), pa.array([t for _, t in texts])], names=["y", "text"])
    counts = Counter()
    for b in toxicity._count_words([batch, batch]):
        for r in b.to_pylist():
            counts[r["word"], r["before"], r["y"]] += r["n"]
    want = {("", None, 1): 6, ("", None, 0): 2, ("you", "^", 1): 4, ("fool", "you", 1): 4, ("you", None, 0): 2, ("there", None, 0): 2}
    assert counts == want
    parts = list(toxicity._batched([batch], lambda t, y: t.split(), lambda held: [pa.array(held), pa.array(held.values())], ["word", "n"], rows=1))
    assert [p.to_pylist() for p in parts] == [[{"word": w, "n": 1} for w in t.split()] for _, t in texts if t]


def test_licences(spark):
    texts = [
        ("Intro. Released under the MIT License. More", "MIT"), ("released  under the mit license!\n", "MIT"), ("no licence", ""), (None, ""), ("", ""),
        ("\n".join(license_scan.RULES["BSD-3-Clause"][0]), "BSD-3-Clause"), ("\n".join(license_scan.RULES["BSD-2-Clause"][0]), "BSD-2-Clause"),
        ("\n".join(reversed(license_scan.RULES["MIT"][2])), ""), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(texts)], "doc_id long, text string, ids string")
    assert {r.doc_id: r.licences for r in license_scan.scan(df).collect()} == {i: x for i, (_, x) in enumerate(texts)}


MIT_NOTICE = """MIT License
Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


#: Notices of further licences as they stand in source files.
MORE_NOTICES = {
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.example.org/legal/epl-2.0/\n\nContributors: none.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
}


def test_more_licences_and_variable_parts(spark):
    third = BSD_THIRD.replace("the copyright holder", "the University of Somewhere, Department 7,")
    texts = [(n, name) for name, n in MORE_NOTICES.items()] + [(BSD_NOTICE + third, "BSD-3-Clause"), (BSD_NOTICE + BSD_THIRD.replace("the copyright holder", "w " * 13), "BSD-2-Clause")]
    texts += [("".join(f" * {x}\n" for x in n.split("\n")), name) for n, name in texts]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in license_scan.scan(df).collect()} == {i: x for i, (_, x) in enumerate(texts)}


def test_licences_in_wrapped_notices(spark):
    notices = [(MIT_NOTICE, "MIT"), (BSD_NOTICE, "BSD-2-Clause"), (BSD_NOTICE + BSD_THIRD, "BSD-3-Clause"), (GPL_NOTICE, "GPL-3.0"), (MPL_NOTICE, "MPL-2.0")]
    texts = []
    for notice, name in notices:
        texts += [(notice, name), (notice.replace("\n", "\r\n"), name), ("/*\n" + "".join(f" * {x}\n" for x in notice.split("\n")) + " */\nint main;", name)]
        texts += [("".join(f"{mark}{x}\n" for x in notice.split("\n")), name) for mark in ("# ", "// ", "dnl ", "REM ")]
        texts.append((notice.replace("\n\n", "\r").replace("\n", " "), name))
    texts += [
        ("a heading\nLicensed under CC BY 4.0.\nmore", "CC-BY-4.0"), ("Licensed under the Apache License,\nVersion 2.0.", "Apache-2.0"),
        ("Licensed under\n\nCC BY 4.0.", ""), ("Licensed under. CC BY 4.0.", ""), (". " * 50_000 + "\n" * 50_000 + "Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("LICENSED P E L K0001 UNDER CC BY 4.0.", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in license_scan.scan(df).collect()} == {i: x for i, (_, x) in enumerate(texts)}


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One  two<br>three<p>Four &lt;b&gt; <i>five</i></p></article><div id="comments"><p>reader</p></div><footer>F</footer></body></html>"""


def test_html():
    assert html_extract.main_text(PAGE) == "Head & line\nOne two three\nFour <b> five"
    for page in (None, "", "<", "<!-- open", "<script>x", "plain"):
        assert html_extract.main_text(page) in ("", "<", "plain")
    assert html_extract.main_text("<body><header>h</header><p>x</p><form><input>y</form>z</body>") == "x\nz"


def test_style_tree(spark):
    page = "<html><body><div><span>Same on all pages</span></div><section><p>{}</p></section></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"own text number {i} " * 5), "x") for i in range(12)] + [(90, None, None, "x"), (91, "http://h.example/1", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for options in ({}, {"noise_rows": 0}):
        got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df, **options).collect()}
        assert len(got) == 14
        for i in range(12):
            want = ("own text number %d " % i * 5).strip()
            assert got[i] == (want, len(want))
        assert got[90] == ("", 0)


def test_style_tree_judges_each_branch(spark):
    page = (
        "<html><body><ul><li>One</li><li>Two</li></ul><div class='box7'><p>" + "A long notice that stands on every page. " * 20 + "</p></div>"
        "<div class='text'><h3>Summary</h3><p>own text {0}</p><ul><li>own item {0}</li></ul></div></body></html>"
    )
    words = [w * 3 for w in "abcdefghijkl"]
    rows = [(i, f"http://h.example/{i}", page.format(w)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for options in ({}, {"noise_rows": 0}):
        got = {r.page_id: r.text for r in html_extract.extract(df, **options).collect()}
        assert got == {i: f"Summary\nown text {w}\nown item {w}" for i, w in enumerate(words)}


def test_html_keeps_slugs_and_bodies_beside_cards():
    article = "".join(f"<{tag} id='{slug}'>{slug}</{tag}>" for tag, slug in [("section", "related-work"), ("h3", "search-and-navigation"), ("div", "share-prices"), ("section", "alert-levels"), ("h3", "comments"), ("section", "related")])
    assert html_extract.main_text(f"<body><article>{article}<div class='social share'>S</div><div class='ad-box'>A</div><div id='cookie-notice'>C</div></article></body>") == "related-work\nsearch-and-navigation\nshare-prices\nalert-levels\ncomments\nrelated"
    cards = "<article>card one</article><article>card two</article>" * 9
    assert html_extract.main_text(f"<body><div class='content'><p>the body of the page</p></div>{cards}</body>").startswith("the body of the page\ncard one")
    assert html_extract.main_text("<body><div>small print</div><article>the body of the page</article></body>") == "the body of the page"


def test_mixing(spark):
    rows = [(i, "a" if i % 3 else "b", "text", 5) for i in range(3000)] + [(5000, None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    out = mixing.mix(df, {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["a"] - 1500) < 200
    assert abs(n["b"] - 1500) < 200
    assert None not in n
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df).columns == ["doc_id", "source", "text", "copy", "mean", "shuffle_key"]


def test_sharding(spark):
    rows = [(i, "hot" if i % 2 else f"s{i % 7}" if i % 5 else None, f"t{i % 50}", 1) for i in range(997)] + [(5, "hot", "t5", 1), (2000, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, shard int")
    got = sharding.interleave(df, bucket_rows=20).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.size == len((r.text or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
    sizes = [len(v) for v in by.values()]
    assert len(by) == 8
    assert max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        assert abs(sum(r.source == "hot" for r in v) - len(v) / 2) <= 2
    assert sharding.interleave(df.where("false")).count() == 0
    where = {(r.doc_id, r.text): (r.shard, r.slot) for r in got if r.doc_id != 5}
    again = sharding.interleave(df, bucket_rows=7).collect()
    assert {(r.doc_id, r.text): (r.shard, r.slot) for r in again if r.doc_id != 5} == where  # buckets decide nothing


def test_language(spark):
    texts = ["the thing of that and other things", "der die das und nicht ein", "el que los para una con"]
    rows = [(f"{texts[k]} {i} " * 3, "en de es".split()[k]) for i in range(40) for k in range(3)]
    net = language_id.fit([t.encode() for t, _ in rows], [y for _, y in rows])
    df = spark.createDataFrame([(1, texts[0], "q"), (2, texts[1], "q"), (3, texts[2] * 900, "q"), (4, None, "q"), (5, " 12 !", "q"), (6, "", "q")], "doc_id long, text string, score string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, net).collect()}
    assert got == {1: "en", 2: "de", 3: "es", 4: "und", 5: "und", 6: "und"}


def test_rollup(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    make = lambda rows: spark.createDataFrame(rows, "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long")
    first = make([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", None, None)])
    assert r.apply("b1", first)
    assert not r.apply("b1", first)
    assert r.apply("b2", make([("revise", "a", "en", "v1", 7, 10), ("delete", "a", "en", "v1", 5, None)]))
    got = {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert got == {("a", 1, 7), (None, 1, 0)}
    with pytest.raises(Exception, match="unknown op"):
        r.apply("b3", make([("what", "a", "en", "v1", 1, None)]))
    assert r.committed() == ["b1", "b2"]
    assert r.compact(str(tmp_path / "other"))
    again = token_rollup.TokenRollup(spark, str(tmp_path / "other"))
    assert {(x.source, x.n_docs, x.n_tokens) for x in again.totals().collect()} == got
    for name in ("", "a/b", ".hidden", "_x"):
        with pytest.raises(ValueError, match="batch id"):
            r.apply(name, first)


def test_one_of_many_writers_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 10)], "op string, source string, lang string, tokenizer_version string, n_tokens long")
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda _: token_rollup.TokenRollup(spark, str(tmp_path / "r")).apply("b", rows), range(6)))
    assert sorted(won) == [False] * 5 + [True]
    assert [(x.n_docs, x.n_tokens) for x in r.totals().collect()] == [(1, 10)]
    assert len(list((tmp_path / "r" / "data").iterdir())) == 1


def test_language_sample_holds_rare_languages(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"the thing of that {i}", "en") for i in range(900)] + [(1000 + i, f"der die das und {i}", "de") for i in range(12)] + [(2000, "", "fr"), (2001, None, "es"), (1000, "der die das und 0", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(df, F.lit(False), max_rows=60)
    assert net.classes == ["de", "en"]
    assert {r.lang_pred for r in language_id.identify(df.where("lang = 'de'"), net).collect()} == {"de"}
    assert language_id.train(df.where("false"), F.lit(False)).classes == []


def test_toxicity_with_few_labels():
    for rows in ([], [("bad words", 1)], [("fine words", 0)], [(None, 1), ("", 1)]):
        m = toxicity.fit(rows)
        assert not m.weight
        assert all(m.score(t) < 0.3 for t in (None, "", "fine words", "bad words"))
