import random
import re

import numpy as np

from quadrille.llm import licenses

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, labels string"


def brute(text):
    w = WORD.findall((text or "").translate(FOLD))
    places, found = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        found |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def corpus():
    rng = random.Random(3)
    bits = ["CC BY", "cc-by", "cc", "by", "All rights\nreserved.", "all rights", "General Public License", "GENERAL public-license", "é", "mot", "word", "Über", "license", "version 2.0"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))), "x") for i in range(200)]
    return [*rows, (None, "cc by", None), (900, None, None), (901, "", None), rows[3], rows[3], (902, "x cc", "y"), (903, "by x", "y"), (904, "word " * 50_000 + "all rights reserved", None)]


def test_base_columns_equal_brute_force(spark):
    rows = corpus()
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(([r[c] for c in cols] for r in got), key=str) == sorted(([d, *brute(t)] for d, t, _ in rows), key=str)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} for r in got)


def test_templates(spark):
    mit, bsd = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["bsd-3-clause"][0]
    texts = {
        1: ("Some prose. Licensed under the Apache License, Version 2.0.", "apache-2.0-notice"),
        2: ("Released under the MIT License. More prose", "mit-notice"),
        3: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        4: ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0-notice"),
        5: ("the apache license is old", ""),
        6: ("mit is a school; a license is a paper", ""),
        7: ("x " * 1000 + mit.upper() + " y" * 1000, "mit"),
        8: ("permission is hereby granted to go home", ""),
        9: ("plain words only, version 2 0 of them", ""),
        10: (mit[: len(mit) // 4], ""),  # a phrase is missing
        11: (bsd.replace("the copyright holder nor", "Example Books of Anywhere and its many friends nor"), "bsd-3-clause"),
        12: (" ".join(reversed(licenses.tokens(mit))), ""),
        13: (licenses.TEMPLATES["apache-2.0"][0] + " " + mit, "apache-2.0,apache-2.0-notice,mit"),
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(k, t, None) for k, (t, _) in texts.items()], SCHEMA)).collect()}
    assert {k: r["labels"] for k, r in got.items()} == {k: want for k, (_, want) in texts.items()}
    assert got[1]["score"] > 0.99 and got[5]["score"] == 0 and got[7]["score"] > 0.99


def test_changed_copies_are_found_and_near_misses_are_not(spark):
    t = {k: x for k, (x, _) in licenses.TEMPLATES.items()}
    isc = t["isc"].replace("THE AUTHOR DISCLAIMS", "ISC DISCLAIMS").replace("THE AUTHOR BE", "ISC BE")
    changed = {
        "isc as its author writes it": (isc, "isc"),
        "regents": (t["bsd-3-clause"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR"), "bsd-3-clause"),
        "company": (t["bsd-3-clause"].replace("THE COPYRIGHT HOLDERS", "GOOGLE INC"), "bsd-3-clause"),
        "author": (t["bsd-2-clause"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE AUTHOR").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE AUTHOR"), "bsd-2-clause"),
        "version first": ("You may copy it under the terms of version 2 of the GNU General Public License.", "gpl-2.0-notice"),
        "a phrase twice": ("and this permission notice appear in all copies. " + t["isc"].replace("appear in all copies", "appear in all copies and this permission notice appear in all copies"), "isc"),
    }
    for k in ("isc", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "unlicense", "cc0", "mit", "zlib", "apache-2.0"):
        words = licenses.tokens(t[k])
        last = licenses.tokens(licenses.TEMPLATES[k][1][-1])
        at = max(i for i in range(len(words)) if words[i : i + len(last)] == last) + len(last)
        changed[f"{k}, a word more"] = (" ".join([*words[:at], "surely", *words[at:]]), k)
        changed[f"{k}, two words less"] = (" ".join([*words[:at], *words[at + 2 :]]), k)
        changed[f"{k}, every ninth word"] = (" ".join([*words[:at], *[w if i % 9 else "xyzzy" for i, w in enumerate(words[at:], 1)]]), k)
    ids = {
        "SPDX-License-Identifier: MIT": "spdx-mit",
        "// SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-or-later) more": "spdx-apache-2.0,spdx-gpl-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0 WITH LLVM-exception": "spdx-gpl-2.0,spdx-llvm-exception",
        "SPDX-License-Identifier: Home-Made-1": "spdx",
        "SPDX-License-Identifier:": "spdx",
    }
    rows = [(i, x, None) for i, (x, _) in enumerate([*changed.values(), *ids.items()])]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (name, (_, label)) in enumerate(changed.items()):
        assert label in got[i], name
    for i, (_, labels) in enumerate(ids.items(), len(changed)):
        assert got[i] == labels.split(",")
    rng = random.Random(8)
    bad = []
    for k in ("mit", "isc", "bsd-3-clause", "apache-2.0", "gpl-3.0", "zlib"):
        words = licenses.tokens(t[k])
        mixed = words[:]
        rng.shuffle(mixed)
        bad += [(k, " ".join(x)) for x in (reversed(words), mixed, words[: len(words) // 4], words[-len(words) // 4 :])]
        bad += [(k, t[o]) for o in ("mit", "isc", "bsd-2-clause", "gpl-2.0", "zlib", "unlicense") if o != k]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame([(i, x, None) for i, (_, x) in enumerate(bad)], SCHEMA)).collect()}
    for i, (k, x) in enumerate(bad):
        assert k not in got[i], (k, x)


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(9)

    def brute(t, w, f):
        best = np.zeros((len(t) + 1, len(f) + 1))
        for i in range(len(t)):
            for j in range(len(f)):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + w[i] * (t[i] == f[j]))
        return best[-1, -1]

    weight = rng.random(6)
    for _ in range(300):
        t, f = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(-1, 6, rng.integers(0, 30))
        for open_end in (False, True):
            assert np.isclose(licenses.aligned(t, weight[t], f, open_end), brute(t, weight[t], f))


def test_every_template_finds_itself_and_places_equal_brute_force(spark):
    texts = {i: t for i, (t, _) in enumerate(licenses.TEMPLATES.values())}
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, f"a b {t} c", None) for i, t in texts.items()], SCHEMA)).collect()}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label.partition("/")[0] in got[i]["labels"].split(",") and got[i]["score"] > 0.99, label
    rng = random.Random(6)
    index = licenses.build(10, {"license": 9, "the": 10})
    words = sorted({w for t in texts.values() for w in licenses.tokens(t)})[:12] + ["mit", "license", "cc", "by", "nc", "4", "0"]
    group = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(50)]
    data = np.frombuffer("".join(group).encode(), np.uint8)
    w = licenses.kernel.split(data, np.r_[0, np.cumsum([len(t) for t in group])], licenses.kernel.IS_ALNUM)
    v = index.numbers(w)
    postings = licenses.Postings(v, len(index.hashes))
    for t in index.templates:
        for p in t.phrases:
            assert sorted(licenses.begins(p, postings, v, w.text).tolist()) == licenses.phrase_places(v, w.text, p.words).tolist()


def test_counts_are_of_all_documents(spark):
    docs = spark.createDataFrame([(i, "license license apache" if i % 3 == 0 else "none", None) for i in range(30)], SCHEMA)
    n, df = licenses.document_counts(docs.repartition(5))
    assert n == 30 and df["license"] == 10 and df["apache"] == 10 and df["mit"] == 0


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []
