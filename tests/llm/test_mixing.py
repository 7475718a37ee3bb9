import random
import re

from quadrille.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, target int"


def targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def brute(rows):
    sizes, ids = {}, {}
    for r in rows:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(r["text"] or ""))
        ids.setdefault(s, []).append(r["doc_id"])
    t = targets(sizes)
    return {s: (t[s], ids[s]) for s in sizes}


def corpus(spark, seed=1, n=600):
    rng = random.Random(seed)
    names = ["a", "B", "é", "zz", None, "🙂", "tiny"]
    share = [50, 8, 8, 8, 8, 8, 0.3]
    rows = [(i, "w " * min(rng.randint(1, 60), rng.randint(1, 60)), rng.choices(names, share)[0], 1) for i in range(n)]
    rows += [(n, None, "a", None), (n + 1, "", "only empty", None), (None, "some words", "a", None), rows[0], rows[0], (n + 2, "word " * 3000, "B", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sources_come_near_their_targets(spark):
    docs = corpus(spark)
    rows = docs.collect()
    want = brute(rows)
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    source = {r["doc_id"]: r["source"] for r in rows}
    sums, most = {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s][0]) < 1e-6 * max(1, r["target"])
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        sums[s] = sums.get(s, 0) + r["taken"]
        most[s] = max(most.get(s, 0), r["size"])
    for s, (target, _) in want.items():
        assert abs(sums[s] - target) <= 3 * most[s], s  # rows that repeat move together
    assert abs(sum(sums.values()) - sum(r["size"] for r in got)) <= sum(3 * m for m in most.values())


def test_reruns_and_other_partitions_agree(spark):
    docs = corpus(spark)
    assert sorted(map(str, mixing.report(docs).collect())) == sorted(map(str, mixing.report(docs.repartition(13)).collect()))


def test_mix_repeats_rows_as_often_as_they_are_taken(spark):
    docs = corpus(spark, 2, 200).filter("doc_id > 0")
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.report(docs).collect() if r["size"]}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in n.items() if k in taken}


def test_caps_are_shared_out_again(spark):
    sizes = {"a": 1000.0, "b": 1.0, "c": 2.0, "d": 500.0, "e": 3.0, "f": 0.0}
    frame = spark.createDataFrame([(k, int(v)) for k, v in sizes.items()], "_src string, _source_size long")
    got = {r[0]: r[2] for r in mixing.source_targets(frame).collect()}
    want = targets(sizes)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in sizes)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.report(none).collect() == [] and mixing.mix(none).collect() == []
