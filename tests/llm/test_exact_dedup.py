import hashlib
import random

import pytest

from quadrille.llm import exact_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, kept string"


def by_text(rows):
    out = {}
    for r in rows:
        out.setdefault((r[1] or "").translate(FOLD), []).append(r[0])
    return out


def corpus():
    rng = random.Random(2)
    texts = ["", None, "a", "A", "b ", "b", "É", "é", "ß", "SS", "İx", "long " * 40_000] + [f"text {i}" for i in range(30)]
    rows = [(i, rng.choice(texts), "x") for i in range(300)]
    return [*rows, *[(1000 + i, "HOT copy" if i % 2 else "hot COPY", None) for i in range(200)], (None, "null id", "y"), (None, "hot copy", "y"), rows[0], rows[0]]


def test_rows_equal_brute_force(spark):
    rows = corpus()
    groups = by_text(rows)
    want = []
    for d, t, _ in rows:
        norm = (t or "").translate(FOLD)
        keep = max((i for i in groups[norm] if i is not None), default=None)
        want.append((d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = exact_dedup.report(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_kept_documents_have_all_columns_and_repeated_rows_once(spark):
    rows = corpus()
    kept = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "kept"]
    got = sorted(((r[0], (r[1] or "").translate(FOLD)) for r in kept.collect()), key=str)
    assert got == sorted(((max((i for i in g if i is not None), default=None), t) for t, g in by_text(rows).items()), key=str)


def test_smallest_may_stay_instead(spark):
    rows = [r for r in corpus() if r[0] is not None]
    kept = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), keep="smallest").collect()
    assert sorted(r[0] for r in kept) == sorted(min(g) for g in by_text(rows).values())


@pytest.mark.parametrize("f", [exact_dedup.report, exact_dedup.exact_dedup])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_columns_are_passed_on(spark):
    schema = "doc_id long, text string, _norm string, _dig string, _key0 long, _stays boolean, _id long, _run int"
    rows = [(i, t, f"n{i}", f"d{i}", i, i % 2 == 0, -i, i) for i, t in enumerate(["a", "A", "b", None, "", "c"])]
    rows += [rows[5], (None, "b", "x", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted([rows[1], rows[2], rows[4], rows[5]])
    assert exact_dedup.report(docs).count() == len(rows)
