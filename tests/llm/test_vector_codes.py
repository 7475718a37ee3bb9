import hashlib
import math
import random

import numpy as np
import pytest

from quadrille.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, spec=vc.Spec()):
    """Every part against every entry in every round, in Python numbers."""
    kept = [(i, [math.floor(spec.scale * x) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    each = len(kept[0][1]) // spec.parts
    cut = lambda v, p: v[p * each : (p + 1) * each]
    books = [[cut(v, p) for _, v, _ in kept[: spec.entries]] for p in range(spec.parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(spec.rounds):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for _, v, _ in kept:
                members[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(members, book, strict=True)]
    out = []
    for i, v, lab in kept:
        got = [nearest(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), lab))
    totals = {}
    for _, _, d, lab in out:
        totals[lab] = totals.get(lab, 0) + d
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, c, d, totals[lab], digest) for i, c, d, lab in out], digest


def corpus(n, dim=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres[: 1 + i % 6])
        rows.append((i * 3 - 50, [np.float32(x + rng.gauss(0, 0.3)).item() for x in c], rng.choice([None, 0, 0, 0, 1, 2]), "x"))
    rng.shuffle(rows)
    bad = [(100_001, None, 1, "x"), (100_002, [None] + [0.0] * (dim - 1), 1, "x"), (-100_003, [float("nan")] + [0.0] * (dim - 1), 1, "x"), (-100_004, [float("inf")] + [0.0] * (dim - 1), 1, "x")]
    return [*rows, *bad, rows[0], rows[0], (None, [0.5] * dim, None, None)]


def found(got):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("spec, n, block", [(vc.Spec(), 400, 64), (vc.Spec(entries=16), 300, 50), (vc.Spec(entries=5, rounds=7, parts=2), 200, 4096), (vc.Spec(), 20, 4096), (vc.Spec(entries=1), 30, 4096)])
def test_equals_brute_force(spark, monkeypatch, spec, n, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rows = corpus(n)
    got = vc.report(spark.createDataFrame(rows, SCHEMA).repartition(3), spec)
    assert found(got) == sorted(brute(rows, spec)[0], key=str)
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}


def test_equal_vectors_and_ties_take_the_first_entry(spark):
    rows = [(i, [float(i % 2)] * 4, 0, None) for i in range(40)]
    got = found(vc.report(spark.createDataFrame(rows, SCHEMA), vc.Spec(entries=8)))
    assert got == sorted(brute(rows, vc.Spec(entries=8))[0], key=str) and {r[1] for r in got} == {"00" * 4, "01" * 4}


def test_heaps_pop_what_an_exact_comparison_would_change():
    rng = np.random.default_rng(4)
    x = rng.integers(-2000, 2000, (3000, 3)).astype(np.int64)
    books = vc.Codebooks(x[None, :40].copy())
    entry, slack = vc.nearest(x, books.entries[0])
    heaps, seen = vc.Heaps.of(entry, slack, 40), []
    for _ in range(8):
        means = np.stack([[x[entry == e].sum(0) // max(1, (entry == e).sum()) if (entry == e).any() else books.entries[0, e] for e in range(40)]])
        books = books.moved(means)
        popped, old, new = heaps.examine(x, books.entries[0], books.drift[0])
        entry = vc.nearest(x, books.entries[0])[0]
        np.testing.assert_array_equal(heaps.entry(), entry)
        assert len(popped) == len(set(popped.tolist()))
        seen.append(len(popped))
        for a, b in zip(heaps.begin[:-1], heaps.begin[1:], strict=True):
            h = heaps.slack[a:b]
            assert all(h[(i - 1) // 2] <= h[i] for i in range(1, len(h)))
    assert seen[-1] < len(x) / 2


def test_large_components_are_exact_and_beyond_is_refused():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 26), 1 << 26, (200, 16))
    got, _ = vc.nearest(x, x[:50])
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(x[:50]))[1] for v in x]
    assert got.tolist() == want
    import pyarrow as pa

    with pytest.raises(ValueError, match="long"):
        vc.whole_numbers(pa.array([[1e9]]), 1, 1024)


def test_other_lengths_and_empty_tables(spark):
    rows = [(1, [1.0] * 8, 0, None), (2, [2.0] * 4, 0, None), (3, [], 0, None)]
    assert [r[0] for r in found(vc.report(spark.createDataFrame(rows, SCHEMA)))] == [1]
    with pytest.raises(ValueError, match="equal parts"):
        vc.report(spark.createDataFrame([(1, [1.0] * 6, 0, None)], SCHEMA))
    assert vc.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.report(spark.createDataFrame([(1, None, 0, None)], SCHEMA)).collect() == []
    assert len(found(vc.report(spark.createDataFrame([(1, [], 0, None)], SCHEMA)))) == 1
