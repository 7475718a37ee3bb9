import collections
import random
import re
import zlib

import numpy as np

from quadrille.llm import spelling

SCHEMA = "doc_id long, text string, word string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, every=97):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def brute_groups(n, ratio=2):
    near = {a: [b for b in n if a != b and one_apart(a, b)] for a in n}
    form = {a: min(bs, key=lambda b: (-n[b], b)) if bs else None for a, bs in near.items()}
    form = {a: b if b and n[b] >= ratio * n[a] else None for a, b in form.items()}

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return {a: (form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] else None) for a in n}


def corpus():
    rng = random.Random(11)
    stems = ["color", "colour", "colours", "élève", "eleve", "ÉLÈVE", "naïve", "aaaaa", "aaaaaa", "aaaaaaa", "ababab", "babab", "house", "horse", "mouse", "abcd", "xÀÿ×÷z"]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stems)
            k = rng.random()
            if k < 0.3:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice("aàeo") + w[at + (k < 0.15) :]
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((rng.randrange(1000), rng.choice([" ", ", ", "\n1"]).join(words)))
    return [*rows, (None, "house horse house " * 3), (5000, None), (5001, ""), rows[0], rows[0], (5002, "longer " * 30_000)]


def test_counts_and_groups_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    n = brute_counts(rows)
    counts = spelling.word_counts(docs, spelling.Spec(misspell=97))
    assert {r["word"]: r["n"] for r in counts.collect()} == n
    want = brute_groups(n)
    got = spelling.report(docs)
    assert {r["word"]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(v[0] is not None for v in want.values()) > 20
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    plain = spelling.word_counts(docs, spelling.Spec(least_length=4, least_count=10))
    assert {r["word"]: r["n"] for r in plain.collect()} == {w: c for w, c in collections.Counter(r.translate(UPPER) for _, t in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")).items() if len(w) >= 4 and c >= 10}


def test_long_words_and_ties(spark):
    base = "".join(random.Random(2).choice("abcde") for _ in range(200))
    n = {base[:k]: 5 for k in (46, 47, 48, 49, 50)} | {base[:100]: 9, base[:50] + "z" + base[51:100]: 4, base[:99]: 3, "a" * 20_000: 7, "a" * 20_001: 20, "a" * 19_999 + "b": 3}
    n |= {"tie" + c: 8 for c in "ab"} | {"tie": 4}
    got = spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n long"))
    want = {a: v for a, v in brute_groups({w: c for w, c in n.items() if len(w) < 1000}).items()}
    want |= {"a" * 20_000: ("a" * 20_001, "a" * 20_001, 7, 2, 20), "a" * 20_001: (None, "a" * 20_001, 20, 1, None), "a" * 19_999 + "b": ("a" * 20_001, "a" * 20_001, 3, 2, 20)}
    found = {r["word"]: tuple(r)[1:] for r in got.collect()}
    # 19,999 a and b is one replacement from 20,000 a, and two edits from 20,001 a
    want["a" * 19_999 + "b"] = ("a" * 20_000, "a" * 20_001, 3, 1, 7)
    assert found == want
    assert found["tie"][0] == "tiea"


def test_chains_are_followed_to_the_end(spark):
    chain = {"abcdefgh"[:k]: 3 * 2 ** (8 - k) for k in range(1, 9)}
    got = {r["word"]: r["root"] for r in spelling.grouped(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a"} and len(got) == 8


def test_keys_are_distinct_deletions():
    words = ["", "a", "aa", "aab", "abab", "ñandú", "colour", "color", "x" * 3000]
    at, keys = spelling.key_hashes(words)
    mine = collections.defaultdict(set)
    for i, k in zip(at.tolist(), keys.tolist(), strict=True):
        mine[words[i]].add(k)
    text = {k: w for i, w in enumerate(words) for k in [spelling.key_hashes([w])[1][0]]}
    for w in words:
        deletions = {w[:i] + w[i + 1 :] for i in range(len(w))}
        assert mine[w] == {spelling.key_hashes([d])[1][0] for d in deletions | {w}}
    assert len(text) == len(words) and len(at) == sum(len({w[:i] + w[i + 1 :] for i in range(len(w))}) + 1 for w in words)
    assert keys.dtype == np.int64


def test_empty_table(spark):
    assert spelling.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.report(spark.createDataFrame([(1, None, None), (2, "one two", None)], SCHEMA)).collect() == []
