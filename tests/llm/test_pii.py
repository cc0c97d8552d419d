import hashlib
import re

from tidemark.llm import pii
from tidemark.llm.queries import op4_pii
from tests.llm.fixtures import empty, messy

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = sorted((m.start(), r, k, m.end()) for r, (k, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if good(k, m[0]))
    return [sum(s[2] == k for s in spans) for k, _ in KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def check(rows, out):
    got = sorted((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in out)
    assert got == sorted((d, *brute(t)) for d, t in rows)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op4_pii(spark, sf_dir).collect())


TRICKY = [
    "a@b.co_x@d.ee a@b@c.d x@y.z@w.v ..a@b-.c. %+-@a.b-c.d-",
    "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.2.3 1.2.3.4a 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 5 4111111111111111",
    "+49 (30) 1234-5678. +1.2.3.4.5.6.7.8.9.10 +12 +1() 23 +1 909 555-6237) ++4 123456789",
    "日本 ✉ me@x.org 👍👍 +81 3-1234-5678 ✉ 10.0.0.1",
    "1" * 2000,
    "1 " * 1000,
    "1." * 1000,
    "a" * 2000,
    "x@y.zz " * 300,
]


def test_tricky_texts_against_brute_force(spark):
    rows = list(enumerate(TRICKY))
    check(rows, pii.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())


def test_very_long_texts_take_a_moment(spark):
    """Texts on which a matcher that steps back, or recurses, would hang or fail."""
    texts = {"1" * 300_000: 0, "1 " * 150_000: 0, "1." * 10_000: 2500, "a@" + "b." * 120_000 + "c": 0, "a" * 300_000: 0, "+1" + " " * 200_000: 0}
    out = pii.summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.n_ip for r in out} == dict(enumerate(texts.values())) and sum(r.n_email for r in out) == 1


def test_odd_rows(spark):
    short = messy(spark).where("coalesce(length(text), 0) < 100").fillna(-1, ["doc_id"])
    check([(r.doc_id, r.text) for r in short.collect()], pii.summary(short).collect())
    assert pii.summary(messy(spark)).count() == messy(spark).count()
    assert pii.summary(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0
    assert pii.redact(messy(spark)).columns == messy(spark).columns


def test_further_kinds_need_checks_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 01", "my ssn is 123-45-6789", "part 123-45-6789", "call tel 030 1234 5678 now", "score 030 1234 5678", "FR1420041010050500013M02606"]
    out = {r.doc_id: r.spans for r in pii.summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: "iban:5:32", 1: "", 2: "ssn:10:21", 3: "", 4: "tel:9:22", 5: "", 6: "iban:0:27"}


def test_redaction_leaves_no_base_span(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = pii.redact(docs)
    assert after.columns == docs.columns
    for r in after.collect():
        counts, _ = brute(r.text)
        assert counts == [0, 0, 0, 0]
        assert r.text == before[r.doc_id] or brute(before[r.doc_id])[0] != [0, 0, 0, 0] or "<" in r.text
    small = spark.createDataFrame([(1, "mail me@x.org or +1 (909) 555-6237, card 4111 1111 1111 1111 at 10.0.0.1!")], "doc_id long, text string")
    assert pii.redact(small).first().text == "mail <EMAIL> or <PHONE>, card <CARD> at <IP>!"


def test_redaction_takes_what_is_found(spark):
    texts = {
        "Phone\nHome: 555-123-4567": "Phone\nHome: <TEL>",
        "Social Security\nNo. 123-45-6789 end": "Social Security\nNo. <SSN> end",
        "TÉLÉPHONE 030 1234 5678": "TÉLÉPHONE <TEL>",
        "phone@x.org 030 1234 5678": "<EMAIL> <TEL>",
        "+49 30 4111 1111 1111 1111 and score 030 1234 5678": None,
        "part 123-45-6789": "part 123-45-6789",
        "": "",
    }
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(want is None or out[i] == want for i, want in enumerate(texts.values())) and out[9] is None
    assert all(r.spans == "" for r in pii.summary(pii.redact(docs)).where("doc_id != 4").collect())
