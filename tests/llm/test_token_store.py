import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixbench.llm import token_store
from helixbench.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Hello, World! it's THE'RE 12.5 <|endoftext|> a<|endoftext|>b",
    "ÀÉß straße naïve é   x y \x1cz İstanbul ΣΑΣ",
    "tab\tnew\r\nline\x0bvt\x0cff \x85 nel",
    "",
    None,
    "   ",
    "漢字 🎉🎉 word " * 50,
    "!!?? ... ---- <> << | || a|b (x) [y] {z} ~ ^ ` _",
]


def test_words_give_the_ids_of_the_whole_text():
    plain, quick = Tokenizer.from_file(PATH), token_store.WordEncoder(PATH)
    for text in [*filter(None, ODD), " ".join(filter(None, ODD))]:
        assert quick(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_round_trip_in_order(spark):
    plain = Tokenizer.from_file(PATH)
    docs = [(i * 37 % 101, t, "x", 5) for i, t in enumerate([*ODD, *(f"some words {i} again and again" for i in range(60))])]
    df = spark.createDataFrame([*docs, (None, "lost key", "x", 1)], "doc_id long, text string, path string, start int").repartition(3)
    got = [tuple(r) for r in token_store.token_rows(df, PATH, 2).orderBy("start").collect()]
    at, want = 0, []
    for doc, text, *_ in sorted([(-1, "lost key"), *docs], key=lambda r: r[0]):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((None if doc < 0 else doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_one_document_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} " * (i + 1)) for i in range(50)], "doc_id long, text string")
    folder = scratch(spark, "t")
    manifest = token_store.write_shards(df, folder, PATH, 2).collect()
    assert sum(r.documents for r in manifest) == 50
    plain = Tokenizer.from_file(PATH)
    for r in manifest:
        shard = token_store.Shard(r.path)
        for doc in shard.index["doc_id"]:
            assert shard.document(int(doc)).tolist() == plain.encode(f"word{doc} " * (doc + 1), add_special_tokens=False).ids + [2]
        with pytest.raises(KeyError):
            shard.document(1000)
    bad = tmp_path / "bad"
    bad.write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        token_store.Shard(f"file://{bad}")


def test_wide_ids_and_empty_table(spark):
    ids = np.array([1, 70000, 3], np.uint32)
    assert token_store._unpack(token_store._pack(ids)).tolist() == ids.tolist()
    assert token_store.token_rows(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
