import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, llr string"


def rules(text):
    w = WORD.findall(text or "")
    n = len(w)
    seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    cover = {k for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = n < 20 or 100 * len(cover) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed


def corpus():
    rng = random.Random(5)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    good, bad = [f"wort{i}" for i in range(60)], [f"junk{i}##" for i in range(60)]
    rows = [(i, say(good, rng.randint(5, 80)), "x") for i in range(60)] + [(100 + i, say(bad, 40), "x") for i in range(10)]
    loop = say(good, 12)
    rows += [(200, f"{loop} {say(good, 30)} {loop}\n{loop}\n\n{loop}", None), (201, None, None), (202, "", None), (203, " \n\t ", None)]
    rows += [(204, "é ü a <b>|\n" * 12, None), (None, say(good, 25), None), (205, say(good, 30_000), None), (5, rows[5][1], "x"), (5, rows[6][1], "x")]
    return rows


def labels(spark, good, bad=()):
    return spark.createDataFrame([(i, 1, "x") for i in good] + [(i, 0, "y") for i in bad], "doc_id long, quality int, llr string")


def test_base_columns_equal_brute_force(spark):
    rows = corpus()
    got = quality.scored(spark.createDataFrame(rows, SCHEMA), labels(spark, [0])).collect()
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(([r[c] for c in cols] for r in got), key=str) == sorted(([d, *rules(t)] for d, t, _ in rows), key=str)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_scores_and_threshold_equal_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None and WORD.search(r[1] or "")]
    docs = spark.createDataFrame([(i, t, "x") for i, (_, t, _) in enumerate(rows)], SCHEMA)
    good, bad = range(0, 60, 2), range(60, 66)
    hashed = {r[0]: r[1] for r in quality.measured(docs, "doc_id", "text").select("doc_id", quality.features(None).alias("f")).collect()}
    fold = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(text), {quality.FOLDS})").collect()}
    raw = Counter(x for f in hashed.values() for x in f)

    def score(i):
        target = Counter(x for j in good if i not in good or fold[i] != fold[j] for x in hashed[j])
        a, b = sum(raw.values()), sum(target.values())
        return sum(math.log((target[k] + quality.PRIOR * raw[k] / a) / (b + quality.PRIOR) / (raw[k] / a)) for k in hashed[i]) / len(hashed[i])

    got = {r["doc_id"]: r for r in quality.scored(docs, labels(spark, [*good, good[0]], [*bad, good[2]])).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert math.isclose(r["llr"], score(i), abs_tol=1e-4)
    passed = {i for i, r in got.items() if not r["base_failed"]}
    kept = {i for i in passed if got[i]["kept"]}
    assert sum(i in kept for i in passed if i in good) >= 0.98 * sum(i in good for i in passed)
    assert not any(i in kept for i in range(60, 70))
    assert min(score(i) for i in kept) >= max((score(i) for i in passed - kept), default=-99) - 1e-4


def test_threshold_comes_from_all_labelled_documents(spark):
    rng = random.Random(7)
    ids = [r["id"] for r in spark.range(5_200).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, " ".join(f"{'wort' if n < 5_000 else 'junk'}{rng.randrange(60)}" for _ in range(25)), None) for n, i in enumerate(ids)]
    got = {r["doc_id"]: r for r in quality.scored(spark.createDataFrame(rows, SCHEMA), labels(spark, ids[:5_000], ids[5_000:])).collect()}
    assert all(got[i]["kept"] for i in ids[:5_000] if not got[i]["base_failed"])  # without bad ones 2 percent would go
    assert not any(got[i]["kept"] for i in ids[5_000:])


def test_labelled_and_unlabelled_documents_are_kept_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in quality.scored(docs, known.filter("doc_id % 2 = 0")).collect() if not r["base_failed"]}
    share = lambda ids: sum(kept[i] for i in ids) / max(1, len(ids))
    good = [r["doc_id"] for r in known.filter("quality = 1").collect() if r["doc_id"] in kept]
    even, odd = [i for i in good if i % 2 == 0], [i for i in good if i % 2]
    assert abs(share(even) - share(odd)) < 0.1 and share(even) > 0.9


def test_threshold():
    assert quality.cut([]) is None and quality.cut([(5, 0, 9)]) is None
    assert quality.cut([(-500, 0, 4), (500, 10, 0)]) == pytest.approx(0, abs=1e-2)
    assert quality.cut([(0, 1, 0), (500, 99, 0)]) == pytest.approx(0.5, abs=1e-2)
    assert quality.cut([(0, 5, 5), (500, 95, 5)]) <= 0  # would lose 5 of 100 good ones
    assert quality.cut([(7, 3, 0)]) <= 7 / quality.STEPS


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality.scored(none, labels(spark, [])).collect() == []
    some = spark.createDataFrame([(1, "a b " * 20, None)], SCHEMA)
    assert [(r["llr"], r["kept"]) for r in quality.scored(some, labels(spark, [])).collect()] == [(0.0, False)]
    alone = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), None)], SCHEMA)
    assert [r["kept"] for r in quality.scored(alone, labels(spark, [1])).collect()] == [True]
    assert [r["kept"] for r in quality.scored(alone, labels(spark, [], [1])).collect()] == [True]  # no good ones: base rules only
