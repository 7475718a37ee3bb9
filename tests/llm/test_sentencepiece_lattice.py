import itertools
import random

import pytest

from quadrille.llm import sentencepiece_lattice as sl

sentencepiece = pytest.importorskip("sentencepiece")
SCHEMA = "doc_id long, text string, ids string"


def corpus():
    rng = random.Random(8)
    bits = ["Hello", "world", "naïve", "été", "the", "of", "internationalisation", "don't", "...", "====", "日本語", "🙂", "x\ty", "a\nb", "", "", "12345", "Straße", "ing", "\x00", "(foo_bar)", "https://example.com/a?b=c"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), "x") for i in range(120)]
    rows += [(500 + i, "".join(rng.choice("abcdeéinrst") for _ in range(rng.randint(1, 120))), "y") for i in range(40)]
    return [*rows, (None, "null id", None), (900, None, None), (901, "", None), (902, " ", None), (903, "  two  ", None), rows[3], (904, "word " * 30_000, None), (905, "x▁y", None)]


def test_ids_equal_the_library(spark):
    rows = corpus()
    m = sentencepiece.SentencePieceProcessor(model_file=sl.model_path())
    v = sl.Vocabulary.load(sl.model_path())
    for head in (0, 20, sl.HEAD):
        got = sl.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), v, head_size=head)
        rows_got = got.collect()
        assert sorted((str(r["doc_id"]), r["ids"]) for r in rows_got) == sorted((str(d), m.encode(t or "")) for d, t, _ in rows)
        assert [r["doc_id"] for r in rows_got if not r["round_trip"]] == [905]
    texts = {(r["doc_id"], r["decoded"]) for r in sl.decode(got, v).collect()}
    assert texts == {(d, (t or "").replace("▁", " ")) for d, t, _ in rows}


def test_copies_of_a_text_are_dealt_out_and_encoded_alike(spark):
    v = sl.Vocabulary.load(sl.model_path())
    rows = [(i, "unlikelyword in many copies", None) for i in range(200)] + [(200 + i, None, None) for i in range(200)]
    got = sl.encode(spark.createDataFrame(rows, SCHEMA).repartition(5), v, head_size=0)
    want = sentencepiece.SentencePieceProcessor(model_file=sl.model_path()).encode("unlikelyword in many copies")
    assert {(tuple(r["ids"]), r["count"]) for r in got.groupBy("ids").count().collect()} == {((), 200), (tuple(want), 200)}


def test_unigram_fold_equals_brute_force(spark):
    rng = random.Random(1)
    pieces = [sl.SPACE, *"abc", "ab", "bc", "ca", "abc", "cab", "aa", sl.SPACE + "a", "bca"]
    scores = [rng.uniform(-9, -1) for _ in pieces]
    n = len(pieces)
    v = sl.Vocabulary(pieces + [f"<0x{b:02X}>" for b in range(256)], scores + [0.0] * 256, list(range(n, n + 256)), [True] * n + [False] * 256, "unigram")
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    worst = min(scores) - 10
    cost = dict(zip(pieces, scores, strict=True))

    def best(t):
        found = None
        for cuts in itertools.product([0, 1], repeat=len(t) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(t)]
            parts = [t[a:b] for a, b in itertools.pairwise(at)]
            if all(p in cost or len(p) == 1 for p in parts):
                s = sum(cost.get(p, worst) for p in parts)
                found = max(found or (s, parts), (s, parts), key=lambda x: x[0])
        return [i for p in found[1] for i in ([pieces.index(p)] if p in cost else [n + b for b in p.encode()])]

    got = sl.encode(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA), v).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: best((sl.SPACE + t.replace(" ", sl.SPACE))) for i, t in enumerate(texts)}


def test_long_runs_are_cut_and_come_back(spark):
    v = sl.Vocabulary.load(sl.model_path())
    text = "ab" * 200 + "é" * 300
    r = sl.encode(spark.createDataFrame([(1, text, None)], SCHEMA), v).head()
    assert r["round_trip"] and r["n_pieces"] == len(r["ids"])


def test_long_runs_equal_the_library(spark):
    rng = random.Random(9)
    m = sentencepiece.SentencePieceProcessor(model_file=sl.model_path())
    glued = lambda n: "".join(rng.choice(["the", "internationalisation", "été", "of", "ing", "word", "x"]) for _ in range(n))
    texts = ["-" * 300, "Title " + "=" * 301, "a" * 300, "-" * 10_000, "a" * 10_000, "=" * 10_000, " " * 300, glued(100), glued(3000), "é" * 300, "ab" * 200 + "🙂" + "日" * 200 + "ab" * 200]
    texts += ["".join(rng.choice("abcdeéinrst") for _ in range(n)) for n in (127, 128, 129, 300, 10_000)]
    texts += [texts[0] + " and " + texts[2], "a" * 600_000, texts[3]]
    got = sl.encode(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA), sl.Vocabulary.load(sl.model_path())).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: m.encode(t) for i, t in enumerate(texts)}
    assert all(r["round_trip"] for r in got)


def test_paths_for_long_words_equal_the_fold(spark):
    rng = random.Random(2)
    pieces = [sl.SPACE, *"abc", "ab", "bc", "ca", "abc", "cab", "aa", sl.SPACE + "a", "bca", "aaaa"]
    scores = [rng.choice([-1.5, -2.0, -3.25, -4.0]) for _ in pieces]
    n = len(pieces)
    texts = ["".join(rng.choice("abcabcabcé") for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for kind in ("bpe", "unigram"):
        v = sl.Vocabulary(pieces + [f"<0x{b:02X}>" for b in range(256)], scores + [0.0] * 256, list(range(n, n + 256)), [True] * n + [False] * 256, kind)
        got = sl.encode(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA), v).collect()
        flat, begin, _, first = v.words(texts)
        want = {i: [x for k in range(first[i], first[i + 1]) for x in v.pieces_of(flat[begin[k] : begin[k + 1]])] for i in range(len(texts))}
        assert {r["doc_id"]: r["ids"] for r in got} == want


def test_empty_table(spark):
    assert sl.encode(spark.createDataFrame([], SCHEMA), sl.Vocabulary.load(sl.model_path())).collect() == []
