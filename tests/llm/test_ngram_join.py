import random
import re

import pyarrow as pa
import pytest

from quadrille.llm import ngram_join
from quadrille.llm.ngram_join import Spec, linked, near_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, node string, root long"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, spec):
    sets = [shingles(r[1], spec.n) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= spec.percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, bases, copies, words=(1, 90)):
    rng = random.Random(seed)
    out = [(None, "a b c d e f g h i j k l", None, None), (7000, None, None, None), (7001, "  \n", None, None), (7002, "A b", None, None), (7002, "a B", None, None)]
    for i in range(bases):
        base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(*words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "Yy", "é", "zz z"])
            out.append((len(out), " ".join(w), "n", i))
    out += [out[9]] * 5
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("spec", [Spec(4, 85), Spec(5, 80), Spec(2, 60)])
def test_links_equal_brute_force(spark, spec):
    rows = corpus(1, 30, 6)
    got = linked(spark.createDataFrame(rows, SCHEMA), spec).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, spec)


@pytest.mark.parametrize("sketches,features", [(8192, 2000), (5, 2000), (5, 10**6)])
def test_long_texts_and_oversize_groups_equal_brute_force(spark, sketches, features):
    rows = corpus(2, 4, 25, (300, 500))
    spec = Spec(4, 85)
    got = linked(spark.createDataFrame(rows, SCHEMA), spec, features=features, sketches=sketches).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, spec)


def test_combining_on_the_map_side_keeps_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD", 50)
    monkeypatch.setattr(ngram_join, "HOT", 1)
    rows = corpus(3, 10, 8)
    spec = Spec(4, 85)
    got = linked(spark.createDataFrame(rows, SCHEMA), spec).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, spec)


def test_near_dedup_keeps_one_of_a_group_and_all_columns(spark):
    rows = [r for r in corpus(4, 10, 5) if r[0] is not None]
    kept = near_dedup(spark.createDataFrame(rows, SCHEMA), Spec(5, 80))
    assert kept.columns == ["doc_id", "text", "node", "root"]
    want = {d for d, _, c in brute(rows, Spec(5, 80)) if d == c}
    assert {r[0] for r in kept.collect()} == want


def test_empty_table(spark):
    assert linked(spark.createDataFrame([], SCHEMA), Spec()).collect() == []


def test_near_dedup_with_null_and_repeated_identifiers_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a", 1), (None, text, "b", 2), (7, text + " z", "c", 3), (5, text, "a", 1), (5, text + " y", "d", 4), (None, None, "e", 5), (None, None, "e", 5), (9, "", "f", 6), (3, "alone here", "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, _hash long")
    got = near_dedup(docs, Spec(5, 80))
    assert got.columns == docs.columns
    got = sorted(got.collect(), key=str)
    fives = [tuple(r) for r in got if r[0] == 5]
    assert fives in ([(5, text, "a", 1)], [(5, text + " y", "d", 4)])  # the two texts are told apart by a hash
    assert sorted((tuple(r) for r in got if r[0] != 5), key=str) == sorted(rows[5:], key=str)
    again = spark.createDataFrame([(5, text, "a", 1)] * 3 + [(8, "x y", "b", 2)], docs.schema)
    assert sorted(tuple(r) for r in near_dedup(again, Spec(5, 80)).collect()) == [(5, text, "a", 1), (8, "x y", "b", 2)]
    assert near_dedup(spark.createDataFrame([], docs.schema)).collect() == []


def test_sets_that_share_a_passage_are_compared_once_not_under_every_signature(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = say(80)
    rows = [(i, " ".join(say(k) + passage + say(24 - k)), None, None) for i, k in enumerate(rng.randrange(24) for _ in range(120))]
    rows += [(200 + i, rows[i][1] + " end", None, None) for i in range(0, 120, 10)]
    met = []
    whole = ngram_join.trees
    monkeypatch.setattr(ngram_join, "HOT", 1)
    monkeypatch.setattr(ngram_join, "trees", lambda members, *more: met.append(members.select("root", "node").count()) or whole(members, *more))
    got = linked(spark.createDataFrame(rows, SCHEMA), Spec(5, 80)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, Spec(5, 80))
    assert met[0] < 4 * len(rows)


def test_sets_of_hot_signatures_become_rows_once(spark, monkeypatch):
    rows, seen = corpus(8, 10, 8), []
    whole = ngram_join.trees
    monkeypatch.setattr(ngram_join, "HOT", 1)
    monkeypatch.setattr(ngram_join, "trees", lambda members, *more: seen.append(members) or whole(members, *more))
    got = linked(spark.createDataFrame(rows, SCHEMA), Spec(4, 85)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, Spec(4, 85))
    assert "Generate" not in seen[0]._jdf.queryExecution().toString()  # trees() reads its members more than once
    assert seen[0].count() == seen[0].select("root", "node").distinct().count()


def test_lists_of_a_group_are_united(monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD", 4)
    lists = [(1, 0, [5, 3]), (1, 0, [3, 9, 5]), (1, 0, [11, 3, 12]), (1, 2, [7]), (4, 2, [7]), (4, 2, [7])]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("root", "salt", "sets"), r, strict=True)) for r in lists[i : i + 4]]) for i in (0, 4)]
    got = [tuple(r.values()) for b in ngram_join.unions(batches) for r in b.to_pylist()]
    assert got == [(1, 0, [3, 5, 9, 11]), (1, 0, [12]), (1, 2, [7]), (4, 2, [7])]
    assert list(ngram_join.unions([])) == []
