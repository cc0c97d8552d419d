import random

from tidemark.llm import substring
from tidemark.llm.queries import op9_substring_dedup
from tests.llm.fixtures import empty, messy


def brute(docs):
    """Every span of every document, the first occurrence by (id, place), sentences cut otherwise."""
    first, spans = {}, {}
    for d, t in sorted(docs):
        bodies, counts = substring.sentences(t or "")
        ends = substring.runs(counts)
        spans[d] = [(i, e, " ".join(bodies[i:e])) for i, e in enumerate(ends) if e]
        for i, _, s in spans[d]:
            first.setdefault(s, (d, i))
    out = []
    for d, t in docs:
        bodies, counts = substring.sentences(t or "")
        gone = {k for i, e, s in spans[d] if first[s] != (d, i) for k in range(i, e)}
        kept = [b for k, b in enumerate(bodies) if k not in gone]
        out.append((d, len(gone), " ".join(kept)))
    return sorted(out)


def result(rows):
    return sorted((r.doc_id, r.n_removed, " ".join((r.text or "").lower().split())) for r in rows)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op9_substring_dedup(spark, sf_dir).collect()) == brute(rows)


def test_passage_inside_other_sentences(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = ". ".join(say(14).capitalize() for _ in range(5)) + "."
    rows = [(i, f"{say(40)}. {say(7)} {passage} {say(9)}. {say(30)}.") for i in range(6)] + [(10, say(200))]
    out = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    last = passage.split(". ")[-1]
    assert out[0].clean_text == rows[0][1] and out[10].clean_text == rows[6][1]
    for i in range(1, 6):
        assert last not in out[i].clean_text and len(set(passage.split()) & set(out[i].clean_text.split())) <= 30
        assert set(rows[i][1].split()[:40]) <= set(out[i].clean_text.split())


def test_short_common_lines_stay(spark):
    rows = [(i, f"All rights reserved. Contact us. Line {i} of its own, {'x' * i}.") for i in range(20)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_removed == 0 and r.clean_text == r.text for r in out)


def test_odd_rows(spark):
    out = substring.remove_repeats(messy(spark))
    assert set(messy(spark).columns) <= set(out.columns) and out.count() == messy(spark).count()
    by = {}
    for r in out.collect():
        by.setdefault((r.doc_id, r.text if r.text is None else r.text[:20]), []).append(r)
    assert by[3, None][0].clean_text is None and by[2, ""][0].clean_text == ""
    assert len({(r.clean_text, r.n_removed) for r in by[5, "One two three four f"]}) == 1
    assert substring.remove_repeats(empty(spark)).count() == 0
    one = " ".join(f"word{i}" + "." * (i % 9 == 8) for i in range(60))
    twice = spark.createDataFrame([("b", one), ("a", one), (None, one)], "doc_id string, text string")
    assert sorted(r.n_removed > 0 for r in substring.remove_repeats(twice).collect()) == [False, True, True]


def test_repeats_within_a_document(spark):
    block = "One sentence that is said of many things here. Another one that follows it at once today. And a third that ends the passage of words. "
    text = block + "Something else comes between these two passages. " + block
    row = substring.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_removed > 0 and row.clean_text.startswith(block.strip()) and len(row.clean_text) < len(text) - 60


PASSAGE = " ".join(f"This is the {w} sentence of it, said {w} times in all." for w in "one two three four five six seven eight nine ten eleven twelve".split())


def test_rows_that_share_an_id_or_have_none(spark):
    own = [f"Here speaks the {w} text of them all. It has {w} words of its own, or so. " for w in ("red", "green", "blue", "grey")]
    rows = [(None, own[0] + PASSAGE), (None, own[1] + PASSAGE), (7, own[2] + PASSAGE), (7, own[3] + PASSAGE), (7, own[3] + PASSAGE)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == 5 and all(r.clean_text.startswith(r.text[:60]) for r in out)
    whole = [r for r in out if r.clean_text == r.text]
    # One text under the smallest id keeps the passage, be it in one row or in two of them.
    assert {r.doc_id for r in whole} == {7} and len({r.text for r in whole}) == 1
    assert all(r.n_removed == (0 if r in whole else 12) for r in out)


def test_many_texts_without_an_id(spark):
    rows = [(None, f"Text number {i}. " + PASSAGE) for i in range(300)] + [(None, "")]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == 301 and sum(r.n_removed == 0 for r in out if r.text) == 1


def test_sentences_end_where_they_end():
    short = "One sentence is here, of many words that could all be picked as breaks. Another follows! And a third?\nA line of its own"
    assert substring.sentences(short)[0] == [s.lower() for s in short.replace("\n", " ").replace("breaks. ", "breaks.|").replace("follows! ", "follows!|").replace("third? ", "third?|").split("|")]
    bodies, counts = substring.sentences(" ".join(f"w{i}" for i in range(500)))
    assert sum(counts) == 500 and max(counts) <= substring.MOST_WORDS and len(bodies) > 20
