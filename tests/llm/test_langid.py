import random
import pytest
import zlib

import numpy as np

from tidemark.llm import langid
from tidemark.llm.queries import op7_language_id
from tests.llm.fixtures import empty, messy


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op7_language_id(spark, sf_dir).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


LEARNED = [("en", "the cat and the dog sat with them there"), ("de", "der hund und die katze schlafen nicht über"), ("en", "then this other thing happened that they said"), ("de", "ich weiß nicht was das für ein schönes haus")]


def trained(spark, more=()):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(LEARNED * 3)] + list(more)
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_weights_are_the_kernel_machine_folded(spark):
    """Scores by presence and weights equal kernels with the landmarks times the dual solution."""
    model = trained(spark)
    text = "the dog und die katze"
    grams = set(model.grams(text).tolist())
    low = " " + text + " "
    assert len(grams) == len({low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)})
    known = [g for g in grams if model.place[g] >= 0]
    direct = sum(model.weights[model.place[g]] for g in known) / np.sqrt(len(grams))
    assert np.allclose(model.scores([text])[0], direct, atol=1e-5)


def test_long_and_short_texts_have_the_same_features(spark):
    model = trained(spark)
    long = "the quick brown fox über the ßtreet " * 200
    points = set(model.grams(long).tolist())
    assert points == set(model.grams("the quick brown fox über the ßtreet " * 3).tolist())


def test_odd_rows(spark):
    model = trained(spark, [(90, None, "en"), (91, "text", None), (92, "123 456", "de"), (93, "x", "en")])
    out = langid.predict(messy(spark), model)
    got = {(r.text if r.text is None or len(r.text) < 60 else len(r.text)): (r.lang_pred, r.score) for r in out.collect()}
    for nothing in (None, "", "   \n\t ", 300_000):
        assert got[nothing] == ("und", 0.0)
    assert got["A text without an id, seen once."][0] == "en"
    assert langid.predict(empty(spark), model).count() == 0
    kept = langid.keep_identified(messy(spark), model)
    assert kept.columns == messy(spark).columns and {r.score for r in kept.collect()} == {"x"}
    nothing = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(messy(spark), nothing).collect()} == {"und"}


def test_one_hot_id_and_ties(spark):
    rows = [(1, "the cat sat there", "en")] * 2000 + [(2, "der hund schläft dort", "de")] * 5
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_each=50)
    assert model.predict(["the cat", "der hund"])[0] == ["en", "de"]


def test_letters_of_any_script(spark):
    rng = np.random.default_rng(4)
    say = lambda first, n: "".join(chr(first + int(k)) if k % 7 else " " for k in rng.integers(0, n, 60))
    scripts = {"got": (0x10330, 26), "dsrt": (0x10400, 79), "zh": (0x4E00, 3000), "hang": (0xAC00, 3000), "am": (0x1200, 300), "ka": (0x10D0, 40)}
    rows = [(i, say(*scripts[lang]), lang) for i in range(60) for lang in scripts]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, marks = model.predict([say(*scripts[lang]) for lang in scripts])
    assert names == list(scripts) and min(marks) > 0
    assert model.predict(["²³ 12 ٣", "Ⅷ"]) == (["und", "und"], [0.0, 0.0])


def test_the_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"{'abcdefgh'[i % 8]}word number {i} " * 20, f"l{i % 8}") for i in range(4000)]
    seen = []
    fit = langid.Model.fit
    monkeypatch.setattr(langid.Model, "fit", lambda self, texts, names, *a: (seen.append((texts, names)), fit(self, texts, names, *a))[1])
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_chars=64_000)
    texts, names = seen[0]
    assert set(names) == {f"l{i}" for i in range(8)} and sum(map(len, texts)) <= 64_000 + 8 * 400


def test_kernel_matrix_against_brute_force():
    texts = [t for _, t in LEARNED] + ["una casa en la montaña", "ein haus", "the house"]
    names = [n for n, _ in LEARNED] + ["es", "de", "en"]
    model = langid.Model().fit(texts, names, landmarks=len(texts))
    every = [{f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)} for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in every] for a in every])
    target = np.array([[float(n == l) for l in model.languages] for n in names])
    weight = np.diag(1 / (target @ target.sum(axis=0)))
    values, vectors = np.linalg.eigh(kernel)
    phi = kernel @ (vectors / np.sqrt(values))
    solved = np.linalg.solve(phi.T @ weight @ phi + langid.RIDGE * len(model.languages) / 100 * np.eye(len(texts)), phi.T @ weight @ target)
    assert np.allclose(model.scores(texts), phi @ solved, atol=1e-4)


def scripts(n):
    """Texts of n languages, each in letters of its own."""
    rng = random.Random(n)
    return [(f"l{k:02}", "".join(rng.choice([chr(0x4E00 + 40 * k + j) for j in range(30)] + [" "]) for _ in range(80))) for k in range(n) for _ in range(12)]


@pytest.mark.parametrize("n", [18, 20, 24, 333])
def test_every_language_has_a_landmark(n):
    rows = scripts(n)
    order = sorted(range(len(rows)), key=lambda i: (i % 12, rows[i][0]))
    model = langid.Model().fit([rows[i][1] for i in order], [rows[i][0] for i in order])
    names, _ = model.predict([t for _, t in rows])
    assert names == [name for name, _ in rows]


def test_a_language_of_long_texts_only_is_learned(spark):
    long = "абвгд еёжз " * 3000
    df = spark.createDataFrame([(1, long, "ru"), (2, long + "и", "ru"), (3, "some english words", "en"), (4, "more of the words", "en")], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ["en", "ru"] and model.predict(["где же зад", "some of the words"])[0] == ["ru", "en"]
