import corpus_pipeline
from tidemark.llm import decontam, langid, pii, simhash
from tidemark.llm._shared import staged, table
from tests.llm.test_packing import check
from tests.llm.test_simhash import check_similar


def test_stages_do_their_work(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        after[name] = docs
        if name != "packing":
            assert docs.columns == columns
    rows = {n: {r.doc_id: r for r in df.collect()} for n, df in after.items() if n != "packing"}
    given = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    # Clean documents stay: in these tables every document has a language.
    assert set(rows["language"]) == {r.doc_id for r in langid.predict(table(spark, sf_dir, "documents"), langid.train(table(spark, sf_dir, "documents"))).collect() if r.lang_pred != "und" and r.score >= 0.3}
    assert len(rows["language"]) >= 0.99 * len(given)
    check_similar({d: r.text for d, r in rows["language"].items()}, set(rows["near_duplicates"]))
    assert decontam.find(after["decontamination"], table(spark, sf_dir, "benchmark")).where("contaminated").count() == 0
    for d, r in rows["decontamination"].items():
        assert r.n_chars == len(r.text) and (r.text == rows["near_duplicates"][d].text or len(r.text) < len(given[d].text))
    summed = pii.summary(after["personal_data"]).selectExpr("sum(n_email + n_ip + n_card + n_phone) AS n").first().n
    assert summed == 0 and set(rows["personal_data"]) == set(rows["decontamination"])
    check([(d, r.text) for d, r in rows["personal_data"].items()], after["packing"].collect())


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "The quick brown fox jumps over the lazy dog and then it sleeps for a while under the tree"
    rows = [(1, text, "en", None, 5), (1, text, "en", None, 5), (2, None, None, None, None), (None, "A wholly different sentence about the ships in that harbour and the long road home in the winter of the year", None, "s", 1), (3, "", "en", "s", 0), (4, "!!! ???", "en", "s", 7)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, None}
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        none_out = stage(spark, none, str(tmp_path))
        assert none_out.count() == 0
    assert simhash.one_of_each(none).count() == 0
