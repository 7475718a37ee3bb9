import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from quadrille.llm import token_records as tr

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, ids string"


def corpus():
    rng = random.Random(4)
    bits = ["Hello", "naïve", "l'été", "éa", "́x", "don't", "!!", "a b", "x\x1cy", "İstanbul", "ΣΑΣ", "<|endoftext|>", "q<|startoftext|>r", "日本語", "🙂🙂", "12345", " z", "it's-ok"]
    rows = [(rng.randrange(-50, 10_000), rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "x") for _ in range(150)]
    return [*rows, (None, "null id", None), (20_000, None, None), (20_001, "", None), (20_002, " \n ", None), (20_003, "word " * 60_000, None), rows[0], (rows[0][0], "other", None)]


def test_files_give_back_what_the_library_encodes(spark):
    rows = corpus()
    t = tokenizers.Tokenizer.from_file(tr.vocabulary_path())
    folder, files = tr.write(spark.createDataFrame(rows, SCHEMA), tr.vocabulary_path(), file_bytes=5000)
    got = tr.read(spark, folder, files, with_ids=True).collect()
    want = sorted((str(d), [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x, _ in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    at, last = 0, None
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert last is None or r["doc_id"] >= last
        at, last = at + r["n_tokens"], r["doc_id"]
    assert len(files) > 5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_fuzzed_texts_equal_the_library(name):
    rng = random.Random(5)
    t = tokenizers.Tokenizer.from_file(tr.vocabulary_path(name))
    enc = tr.encoder(tr.vocabulary_path(name))
    bits = [*"İıſKÅΣσςßẞǅﬁ́̇½²٣Ⅷ日본ء🙂", *"aZ09'!->%\\_<|", "'s", "'LL", "İ--", "<|endoftext|>", "<|", " ", "\n", "\u00a0", "\u0085", "\u2003", "\x1c", "\x00", "hello", "été,"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(10_000)]
    texts += ["İ\\ İ> İ-- İ%", "a" * 20_000, "=" * 20_000, "word, " * 5000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800)])) for _ in range(12)) for _ in range(5000)]
    want = t.encode_batch(texts, add_special_tokens=False)
    for text, w in zip(texts, want, strict=True):
        assert np.frombuffer(enc.encode(text.encode()), f"<u{enc.width}").tolist() == w.ids, text


def test_damage_is_found():
    good = tr.frame(b"payload") + tr.frame(b"")
    assert bytes(tr.unframe(memoryview(good), 0)[0]) == b"payload" and tr.unframe(memoryview(good), 23)[1] == len(good)
    for i in range(23):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            tr.unframe(memoryview(bytes(bad)), 0)


def test_records_come_in_any_order(spark):
    folder, files = tr.write(spark.createDataFrame(corpus(), SCHEMA).limit(50), tr.vocabulary_path())
    name, n, _ = max(files, key=lambda f: f[1])
    plain = [(a, d, x.tolist()) for a, d, x in tr.records(folder, name)]
    assert [(a, d, x.tolist()) for a, d, x in tr.records(folder, name, reversed(range(n)))] == plain[::-1]
    fs, path = pafs.FileSystem.from_uri(folder)
    assert all(not f.base_name.startswith(".") for f in fs.get_file_info(pafs.FileSelector(path)))


def test_empty_table(spark):
    assert tr.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parts_of_ascii_words_go_to_the_merges_alone():
    """op4's check in round 4: a call of all of the library's steps for each part took most of the time."""
    e, t = tr.Encoder(tr.vocabulary_path()), tokenizers.Tokenizer.from_file(tr.vocabulary_path())
    calls, whole = [], e.whole
    e.whole = lambda text: calls.append(text) or whole(text)
    text = "Don't stop-it: 42 words, (all) of ASCII! <b>~x~</b>"
    assert np.frombuffer(e.encode(text.encode()), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids and calls == []
    odd = "a\x7fb \x01 é"
    assert np.frombuffer(e.encode(odd.encode()), "<u2").tolist() == t.encode(odd, add_special_tokens=False).ids
