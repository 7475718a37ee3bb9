import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quadrille.llm import sentencepiece_lattice, toxicity  # noqa: E402
from test_exact_dedup import by_text  # noqa: E402
from test_mixing import brute as mix_brute  # noqa: E402
from test_ngram_join import brute as near_brute  # noqa: E402
from test_ngram_join import Spec  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    key = lambda rows: sorted((r["doc_id"], r["text"], r["source"]) for r in rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs.collect(), stage(spark, docs, SF))
        if name == "sentencepiece":
            break
        assert seen[name][1].columns == docs.columns
        rows = seen[name][1].collect()
        docs = spark.createDataFrame(rows, docs.schema)
    rows = {k: v[0] for k, v in seen.items()} | {"end": seen["sentencepiece"][1].collect()}
    toxic = {r["doc_id"] for r in toxicity.report(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect() if r["toxic"]}
    assert key(rows["exact dedup"]) == key(r for r in rows["toxicity"] if r["doc_id"] not in toxic)
    keep = {max(g) for g in by_text(rows["exact dedup"]).values()}
    assert key(rows["n-gram Jaccard join"]) == key(r for r in rows["exact dedup"] if r["doc_id"] in keep)
    keep = {d for d, _, c in near_brute([(r["doc_id"], r["text"]) for r in rows["n-gram Jaccard join"]], Spec(5, 80)) if d == c}
    assert key(rows["mixing"]) == key(r for r in rows["n-gram Jaccard join"] if r["doc_id"] in keep)
    taken = mix_brute(rows["mixing"])
    got = {}
    for r in rows["sentencepiece"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows["mixing"]}
    for source, (target, ids) in taken.items():
        assert abs(sum(got.get(i, 0) * size[i] for i in ids) - target) <= max(size[i] for i in ids), source
        assert all(got.get(i, 0) <= 3 for i in ids)
    v = sentencepiece_lattice.Vocabulary.load(sentencepiece_lattice.model_path())
    back = {(r["doc_id"], r["decoded"]) for r in sentencepiece_lattice.decode(spark.createDataFrame(rows["end"], seen["sentencepiece"][1].schema), v).collect()}
    assert back == {(r["doc_id"], r["text"]) for r in rows["sentencepiece"]} and len(rows["end"]) == len(rows["sentencepiece"])


EXTRA = "_dig string, _norm string, _key0 long, _stays boolean, root string, node long, _src string, _copies int, c0 string, words string, sig long, _id long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_null_and_repeated_identifiers_clashing_columns_and_no_rows(spark, name, stage):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    more = tuple([None] * len(EXTRA.split(", ")))
    text = " ".join(f"word{i}" for i in range(50))
    base = [(5, text, "en", "a", 1), (None, text, "en", "a", 1), (5, text, "en", "a", 1), (7, text + " z", None, None, None), (8, None, None, None, None), (None, None, "x", "b", 2), (9, "", "x", "b", 2), (10, "long " * 60_000, "x", "c", 3), (11, "=" * 500 + " İ--", "x", "c", 3)]
    docs = spark.createDataFrame([r + more for r in base], schema)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "sentencepiece":
        assert len(rows) == len(base) and all(r["round_trip"] for r in rows)
    else:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        known = {tuple(r) for r in docs.collect()}
        assert all(tuple(r) in known for r in rows)
        ids = sorted((r["doc_id"] for r in rows), key=str)
        if name == "toxicity":
            assert len(rows) == len(base)
        elif name == "exact dedup":  # null and empty texts are equal
            assert ids == [10, 11, 5, 7, 9]
        elif name == "n-gram Jaccard join":  # texts without words stay
            assert ids == [10, 11, 5, 8, 9, None]
        else:
            assert all(1 <= ids.count(i) <= 3 * [r[0] for r in base].count(i) for i in ids)
    assert stage(spark, docs.limit(0), SF).collect() == []
