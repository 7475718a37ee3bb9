import random

import numpy as np

from quadrille.llm import kernel, toxicity

SCHEMA = "doc_id long, text string, severity string"


def corpus(n, seed):
    rng = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "awful", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(3, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(w).capitalize(), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_order_of_severity(spark):
    rows, labels = corpus(1200, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels[:800], "doc_id long, toxic int"))
    assert len(model.cuts) == 3 and (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = labels[800:]
    assert np.mean([got[i]["toxic"] == bool(y) for i, y in held]) > 0.98
    n_bad = {i: len({w.strip(",.") for w in t.lower().split()} & {"vile", "awful", "rotten", "nasty"}) for i, t, _ in rows}
    means = [np.mean([got[i]["severity"] for i in n_bad if n_bad[i] == k]) for k in range(5)]
    assert means == sorted(means) and 0 <= means[0] and means[-1] <= 3
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_scores_equal_the_formula(spark):
    text = "bad BAD worse fine"
    h = lambda w: kernel.mix(kernel.split(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hashes()[:1])[0]
    words = np.array([h("bad"), h("worse")], np.uint64)
    order = np.argsort(words)
    model = toxicity.Model(words[order], np.array([1.5, 0.5])[order], np.array([1.0, 3.0]))
    r = toxicity.score(spark.createDataFrame([(1, text, None)], SCHEMA), model).head()
    want = [1 / (1 + np.exp(c - 2.0)) for c in (1.0, 3.0)]
    assert np.isclose(r["severity"], sum(want)) and np.isclose(r["p_toxic"], want[0]) and r["grade"] == 1


def test_a_beginning_counts_by_the_places_it_is_in():
    texts = [b"undo undone", b"unwrapped unwrapping Unwrapper x", b""]
    bounds = np.cumsum([0, *map(len, texts)])
    text, feature = toxicity.features(np.frombuffer(b"".join(texts), np.uint8), bounds)
    stem = kernel.mix(kernel.split(np.frombuffer(b"unwrap", np.uint8), np.array([0, 6])).hashes() + np.uint64(6))[0]
    assert [stem + np.uint64(j) in feature[text == 1] for j in range(3)] == [True] * 3
    assert not (text == 2).any() and len(feature[text == 0]) == 3  # two words and "undon"


def test_nulls_ties_and_empty_tables(spark):
    rows, labels = corpus(300, 2)
    docs = spark.createDataFrame([*rows, (None, None, None), (5, "", None), rows[7], rows[7], (9000, "word1 " * 40_000 + "vile", None)], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (4, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    assert (toxicity.fit(docs.repartition(3), lab).weights == model.weights).all()
    got = toxicity.score(docs, model).collect()
    assert len(got) == 305 and [r["toxic"] for r in got if r["doc_id"] == 9000] == [True]
    assert [r["toxic"] for r in got if r["doc_id"] is None] == [False]
    none = toxicity.fit(docs.limit(0), lab)
    assert not any(r["toxic"] for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).collect() == [] and toxicity.drop_toxic(docs.limit(0), model).collect() == []


def test_repeated_identifiers_leave_the_sample_as_large_as_asked_for(spark, monkeypatch):
    rows, labels = corpus(300, 4)
    docs = spark.createDataFrame(rows + [(i, f"{t} again {k}", None) for i, t, _ in rows for k in range(3)], SCHEMA)
    kept, sizes = toxicity.stored, []
    monkeypatch.setattr(toxicity, "stored", lambda df, name: sizes.append(df.count()) or kept(df, name))
    lab = spark.createDataFrame([*labels, *labels], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, sample=200)
    assert sizes == [200] and (toxicity.fit(docs.repartition(5), lab, sample=200).weights == model.weights).all()


def test_chosen_words_equal_brute_force(spark):
    rows, labels = corpus(400, 3)
    held = []
    for _, t, _ in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        held.append(set(toxicity.features(data, np.array([0, len(data)]))[1].view(np.int64).tolist()))
    y = np.array([v for _, v in labels])
    want = {}
    for f in set().union(*held):
        has = np.array([f in h for h in held])
        pos, neg, p, n = (has & (y == 1)).sum(), (has & (y == 0)).sum(), y.sum(), (1 - y).sum()
        odds = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((neg + 0.5) / (n - neg + 0.5))
        z = abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (p - pos + 0.5) + 1 / (neg + 0.5) + 1 / (n - neg + 0.5))
        if pos + neg >= toxicity.MIN_DOCS and z >= toxicity.MIN_Z and (pos if odds > 0 else neg) >= toxicity.MIN_SHARE * (pos + neg):
            want[f] = bool(odds > 0)
    frame = spark.createDataFrame([(int(v), list(h)) for v, h in zip(y, held, strict=True)], "label int, words array<long>")
    assert want and {r["word"]: r["marker"] for r in toxicity.chosen(frame).collect()} == want
    assert toxicity.chosen(frame, 2).count() == 2
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.words.view(np.int64).tolist()) == set(want) and (np.diff(model.words.astype(float)) > 0).all()
