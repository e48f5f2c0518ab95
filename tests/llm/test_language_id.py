import random

from pyspark.sql import functions as F

from helixbench.llm import language_id

WORDS = {
    "en": "the and of to in that was with for this house water people".split(),
    "de": "der und die das ist nicht mit auf für häuser wasser leute".split(),
    "fr": "le et la les des est une pour dans maison eau gens être".split(),
    "es": "el y los las es una para con casa agua gente niño años".split(),
    "xx": "zxqa qqzo xozz zaqx oxxq".split(),
}


def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang) for i in range(300) for lang in [sorted(WORDS)[i % 5]]]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (1003, "the water of people and this house", None)]
    return spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")


def test_held_out_accuracy(spark):
    df = docs(spark)
    model = language_id.train(df, F.col("doc_id") % 3 != 1)
    assert model.languages == sorted(WORDS) and [len(model.pairs[f]) for f in model.families] == [1, 0, 1]
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert len(got) == 304
    assert all(r.lang_pred == r.lang for r in got.values() if r.doc_id < 1000)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1003].lang_pred == "en"


def test_without_labels_and_without_rows(spark):
    df = docs(spark)
    assert language_id.train(df, F.lit(False)) is None
    assert {r.lang_pred for r in language_id.identify(df.limit(5), None).collect()} == {"und"}
    assert language_id.identify(df.limit(0), None).count() == 0


def test_one_language(spark):
    df = docs(spark).where("lang = 'fr'")
    model = language_id.train(df, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(df, model).collect()} == {"fr"}


def test_ngrams_of_a_text():
    at, value = language_id.features("Ab!")
    # edge a b edge: 4 signs, 3 pairs, 2 triples, 1 quadruple
    assert abs((value**2).sum() - 1) < 1e-6 and len(at) <= 10
    assert language_id.features(" 1 ") is None and language_id.features(None) is None
    assert [x.tolist() for x in language_id.features("ab")] == [x.tolist() for x in language_id.features("12 AB ..\n")]


def test_texts_of_unlearned_and_of_several_languages(spark):
    df = docs(spark)
    model = language_id.train(df, F.col("doc_id") % 3 != 1)
    rng = random.Random(3)
    mixed = " ".join(rng.choice(WORDS["en"]) for _ in range(15)) + " " + " ".join(rng.choice(WORDS["fr"]) for _ in range(15))
    letters = " ".join("".join(rng.choice("bcfghjkmpqvwxzy") for _ in range(6)) for _ in range(30))
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью"
    rows = [(1, mixed), (2, letters), (3, russian), (4, "people"), (5, None), (6, "7")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string").union(df.select("doc_id", "text").where("doc_id < 300")), model, into=("l", "s", "familiar"))
    assert got.columns == ["doc_id", "text", "l", "s", "familiar"]
    assert {r.text: r.familiar for r in got.collect() if r.text in (mixed, letters, russian, "people", "7", None)} == {mixed: True, letters: False, russian: False, "people": True, "7": False, None: False}
    assert got.where("familiar").count() == 302
