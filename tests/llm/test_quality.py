import re
from collections import Counter

import numpy as np

from tidemark.llm import quality
from tidemark.llm.queries import op10_quality_rules
from tests.llm.fixtures import empty, messy


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, hit = Counter(tri), set()
    for i, x in enumerate(tri):
        if c[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def check(rows, out):
    got = sorted(([r.doc_id, *(r[c] for c in quality.BASE), r.base_failed] for r in out), key=str)
    want = sorted(([d, *(b := brute(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]] for d, t in rows), key=str)
    assert got == want
    assert not any(r.kept and r.base_failed for r in out)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = op10_quality_rules(spark, sf_dir).collect()
    check(rows, out)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(good[r.doc_id], r.kept) for r in out if r.doc_id in good and not r.base_failed]
    assert np.mean([k for q, k in judged if q]) >= 0.95


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in messy(spark).collect()] + [(20, "a b c\x1cd  a b c\x1cd\r\n\n \t\n#*$%&|<>\n#*$%&|<>"), (21, "x y z x y z x y"), (22, "a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (77, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.fit(df, labels)
    check(rows, quality.judge(df, forest).collect())
    assert "clean_text" in quality.judge(messy(spark), forest).columns
    nothing = quality.fit(empty(spark).select("doc_id", "text"), labels.limit(0))
    check(rows, quality.judge(df, nothing).collect())
    assert quality.judge(empty(spark), forest).count() == 0


def test_forest_isolates_outliers_and_calibrates():
    rng = np.random.default_rng(0)
    usual, odd = rng.normal(0, 1, (2000, 4)), rng.normal(0, 1, (40, 4)) + 9
    forest = quality.IsolationForest().fit(np.concatenate([usual, odd]))
    good = rng.normal(0, 1, (500, 4))
    forest.calibrate(good, odd, 0.01)
    assert (forest.scores(odd) > forest.limit).mean() > 0.95
    assert (forest.scores(good) > forest.limit).mean() <= 0.01
    same = quality.IsolationForest().fit(np.zeros((10, 4)))
    assert np.allclose(same.scores(np.zeros((3, 4))), same.scores(np.zeros((1, 4)))[0])


def test_verdicts_do_not_depend_on_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = []
    for n in (1, 50):
        docs.repartition(n, "text").write.parquet(f"{tmp_path}/{n}")
        again = spark.read.parquet(f"{tmp_path}/{n}")
        forest = quality.fit(again, labels.repartition(n), fit_rows=60, labelled_rows=40)
        kept.append(sorted((r.doc_id, r.kept, r.anomaly) for r in quality.judge(again, forest).collect()))
    assert kept[0] == kept[1]


def test_verdicts_against_plain_trees(spark, sf_dir):
    """Path lengths walked one row and one tree at a time give the scores that judge gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def path(tree, x):
        feature, value, left, length = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] + (x[feature[at]] >= value[at])
        return length[at]

    for r in quality.judge(docs, forest).collect():
        x = quality.statistics(r.text)[1]
        score = 2.0 ** (-np.mean([path(t, x) for t in forest.trees]) / forest.norm)
        assert abs(score - r.anomaly) < 1e-9 and r.kept == (not r.base_failed and r.anomaly <= forest.limit)


def test_bad_rows_raise_the_limit():
    rng = np.random.default_rng(1)
    forest = quality.IsolationForest().fit(rng.normal(0, 1, (2000, 4)))
    good, bad = rng.normal(0, 1, (400, 4)), rng.normal(0, 1, (30, 4)) + 7
    forest.calibrate(good, good[:0], 0.05)
    low, lost = forest.limit, (forest.scores(good) > forest.limit).sum()
    forest.calibrate(good, bad, 0.05)
    assert forest.limit >= low and (forest.scores(good) > forest.limit).sum() <= lost and (forest.scores(bad) > forest.limit).all()
    forest.calibrate(good, good[:5] * 0, 0.05)
    assert not (forest.scores(good) > forest.limit).any()


def test_letters_of_all_planes():
    letters = dict(zip(quality.FEATURES, quality.statistics("\U00010400\U00010428 \U00020000\U0001d400")[1], strict=True))
    assert letters["letters"] == 1 and letters["upper"] == 0.5
    assert dict(zip(quality.FEATURES, quality.statistics("\U0001f600\U0001f601")[1], strict=True))["letters"] == 0


def test_all_labels_are_calibrated_on(spark):
    """Over 8,192 of them: the limit is that of all scores at once."""
    n = 9000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50 + cast(id % 7 as int)), i -> concat('w', i * (id + 3), if(hash(id, i) % 9 = 0, 'X#', '')))) AS text")
    labels = docs.selectExpr("doc_id", "if(doc_id % 50 = 0, 0, 1) AS quality")
    forest = quality.fit(docs, labels, fit_rows=200)
    got = forest.limit
    rows = [(r.doc_id % 50 > 0, r.anomaly) for r in quality.judge(docs, forest).where("NOT base_failed").collect()]
    assert len(rows) == n
    forest.scores = lambda x: x
    forest.calibrate(np.array([s for g, s in rows if g]), np.array([s for g, s in rows if not g]))
    assert got == forest.limit
    scores = spark.createDataFrame([(s,) for _, s in rows] + [(0.5,)] * 300, "score double")
    every = sorted(r.score for r in scores.collect())
    assert all(quality._nth(scores, k, most=50) == every[k] for k in (0, 17, 4600, n + 299))
