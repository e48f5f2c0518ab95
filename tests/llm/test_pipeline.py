import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from helixbench.llm import mixing
from tests.llm import test_decontaminate, test_language_id, test_simhash


def make(spark, folder):
    lang = test_language_id.docs(spark).where("doc_id < 300").select("doc_id", "text", "lang").collect()
    passage = " ".join(f"bench{i}" for i in range(30))
    rows = [(r.doc_id, r.text, r.lang, f"src{r.doc_id % 3}") for r in lang]
    rows += [(i, r.text, r.lang, "src0") for i, r in enumerate(lang[:20], 400)]
    rows += [(500, None, "en", "src1"), (501, "12 !", None, "src1"), (502, "the house of " * 9 + passage, "en", None), (503, "", "de", "src2")]
    rows += [(0, rows[0][1], "de", "src0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, passage


def test_stages_against_plain_versions(spark, tmp_path):
    docs, passage = make(spark, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path))
        seen[name] = (before.collect(), now.collect())
        if name != "tokens":
            assert now.columns == docs.columns
            now = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {500, 501, 503}
    before, after = seen["near duplicates"]
    classes = test_simhash.plain_classes({r.doc_id: test_simhash.plain_print(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted(k for k, c in classes.items() if k == c)
    before, after = seen["decontamination"]
    hit = {d for d, _ in test_decontaminate.plain([(r.doc_id, r.text) for r in before], [(1, passage)])}
    assert hit == {502} and {r.doc_id for r in after} == {r.doc_id for r in before} - hit
    before, after = seen["mixing"]
    placed = mixing.schedule(spark.createDataFrame(before, docs.schema)).where("in_mix").collect()
    assert {r.doc_id for r in after} == {r.doc_id for r in placed} and after
    before, after = seen["tokens"]
    plain, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    want = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        ids = plain.encode(r.text, add_special_tokens=False).ids + [2]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in after} == want


def test_run_and_empty_table(spark, tmp_path):
    docs, _ = make(spark, tmp_path / "full")
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "full" / "benchmark.parquet")).limit(0).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
