"""Personal data by patterns, checksums and context words, in DataFrame functions only.

Patterns propose spans, checksums (Luhn for cards, mod-97 for IBANs) and ranges confirm them,
and words near a span adjust its score. The base kinds (email, ip, card, phone) stand by their
pattern and check alone; the further kinds count from a score of `LEAST_SCORE` on, so an
unformatted number counts as a telephone number only near a word that says so.

A pattern's matches come from regexp_extract_all and what lies between them from split; their
lengths add up to the places. The patterns never step back over a run of characters and use
no recursion of the matcher, so that a text may be one run of a million digits.

Defined results: a null text is an empty one (and stays null when redacted). Spans of different
kinds may overlap; of a kind they don't. Rows are mapped one by one, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import put_aside, restored

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "tel")
LEAST_SCORE = 0.5
#: Code points before a span in which context words count (and after the kind's span before it).
NEAR = 40

_LOCAL = "A-Za-z0-9._%+-"
# The lookbehind makes a match start at the start of its run (or where the last one ended), as
# the leftmost match does; possessive repeats match what greedy ones do here.
PATTERN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(.-])\(?[0-9]{2,5}\)?[\x20/-][0-9]{2,5}(?:[\x20-][0-9]{2,5}){1,3}+(?![0-9])",
}
#: A cheap test that every text with a match passes.
GUARD = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "tel": r"[0-9]\)?[\x20/-][0-9]{2}"}
#: Score of a confirmed match, and what a context word adds.
SCORE = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.7, 0.3), "iban": (0.9, 0.1), "ssn": (0.3, 0.5), "tel": (0.2, 0.5)}
# Context words of each kind.
CONTEXT = {
    "email": "mail email e-mail contact contacto courriel kontakt",
    "ip": "ip address host server adresse login",
    "card": "card visa mastercard amex credit debit carte karte tarjeta payment",
    "phone": "phone tel telephone mobile cell call fax telefon handy téléphone teléfono móvil",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "tel": "phone tel telephone mobile cell call fax telefon handy téléphone teléfono móvil",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the Luhn check of those before it (12 to 19 digits)."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(n.between(12, 19), F.aggregate(places, F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """Whether the IBAN's number is 1 modulo 97, letters counting 10 to 35."""
    bare = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def add(rest, i):
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "tel":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _may(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(GUARD[kind])


def _near(kind: str, before: Column) -> Column:
    """Whether one of the kind's context words is among the code points before a span."""
    words = "|".join(CONTEXT[kind].split())
    return F.lower(before).rlike(rf"(?<!\p{{L}})(?:{words})(?!\p{{L}})")


#: Matches of a block, so that appending within one and over blocks stays cheap.
BLOCK = 128


def _running(pairs: Column) -> Column:
    """(start, match) for (gap, match) pairs: running sums of their lengths, block by block."""
    size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))

    def within(block, begin):
        start = F.struct(begin.alias("at"), F.array().cast("array<struct<start:int,match:string,before:string>>").alias("found"))

        def step(acc, p):
            one = F.array(F.struct((acc["at"] + F.length(p["gap"])).alias("start"), p["match"].alias("match"), F.right(p["gap"], F.lit(NEAR)).alias("before")))
            return F.struct((acc["at"] + size(p)).alias("at"), F.concat(acc["found"], one).alias("found"))

        return F.aggregate(block, start, step)["found"]

    # All blocks in one pass: where the block begins, and what was found so far as an array of arrays.
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,match:string,before:string>>>").alias("found"))

    def over(acc, block):
        return F.struct((acc["at"] + F.aggregate(block, F.lit(0), lambda n, p: n + size(p))).alias("at"), F.concat(acc["found"], F.array(within(block, acc["at"]))).alias("found"))

    return F.flatten(F.aggregate(blocks, first, over)["found"])


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _places(kind: str, rank: int, text: Column) -> Column:
    """Confirmed spans of a kind in order, with scores."""
    matches = F.regexp_extract_all(text, F.lit(f"({PATTERN[kind]})"), F.lit(1))
    pairs = F.arrays_zip(F.split(text, PATTERN[kind], -1).alias("gap"), matches.alias("match"))
    found = F.filter(_running(pairs), lambda x: x["match"].isNotNull())
    base, more = SCORE[kind]

    def span(x):
        score = F.when(_near(kind, x["before"]), F.lit(base + more)).otherwise(F.lit(base))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    spans = F.transform(F.filter(found, lambda x: _valid(kind, x["match"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(_may(kind, text), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `pii`: its spans (start, rank, end, kind, score) by start, then kind as listed."""
    kinds = BASE + MORE
    body = F.coalesce(F.col(text), F.lit(""))
    own = [f"__{k}" for k in kinds]
    found = docs.drop("pii").select("*", *[_places(k, i, body).alias(n) for i, (k, n) in enumerate(zip(kinds, own, strict=True))])
    # Where a base span covers one of the further kinds, the base span says it all.
    base = F.concat(*[F.col(f"__{k}") for k in BASE])
    more = F.filter(F.concat(*[F.col(f"__{k}") for k in MORE]), lambda s: ~F.exists(F.col("__base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    found = found.withColumn("__base", base)
    return found.withColumn("pii", F.array_sort(F.concat("__base", more))).drop("__base", *own)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    found = find(docs.select(F.col(id).alias("__key"), F.col(text).alias("text")))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select(F.col("__key").alias(id), *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


#: Kinds by the width of their patterns: a telephone number's takes in any card or address that
#: starts inside of it, an e-mail address's any number.
WIDEST = ("email", "phone", "iban", "card", "ip", "ssn", "tel")


def _masked(body: Column, spans: Column) -> Column:
    """`body` with its sorted spans replaced; overlapping ones become one, named for the widest kind."""
    none = F.array().cast("array<struct<since:int,start:int,end:int,width:int>>")
    width = lambda s: F.array_position(F.array(*map(F.lit, WIDEST)), s["kind"]).cast("int")

    def step(acc, s):
        last = F.get(acc, F.size(acc) - 1)
        end = F.coalesce(last["end"], F.lit(0))
        joined = F.struct(last["since"].alias("since"), last["start"].alias("start"), F.greatest(end, s["end"]).alias("end"), F.least(last["width"], width(s)).alias("width"))
        fresh = F.struct(end.alias("since"), s["start"].alias("start"), s["end"].alias("end"), width(s).alias("width"))
        return F.when(s["start"] < end, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    def text(acc):
        marks = F.array(*[F.lit(f"<{k.upper()}>") for k in WIDEST])
        parts = F.transform(acc, lambda m: F.concat(F.substring(body, m["since"] + 1, m["start"] - m["since"]), F.get(marks, m["width"] - 1)))
        rest = F.substring(body, F.get(acc, F.size(acc) - 1)["end"] + 1, F.length(body))
        return F.array_join(F.concat(parts, F.array(rest)), "")

    return F.when(F.size(spans) > 0, F.aggregate(spans, none, step, text)).otherwise(body)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every confirmed span replaced by <KIND>; the rest of the text stays as it is.

    The spans are those of `find`. What a mask between them makes a new match is then replaced
    kind by kind, widest patterns first, under the same context test.
    """
    columns = docs.columns
    found = find(put_aside(docs, text), text)
    found = found.withColumns({text: F.when(F.col(text).isNotNull(), _masked(F.col(text), F.col("pii"))), "__masked": F.size("pii") > 0})
    docs = found.select("__row", text, "__masked")
    for kind in WIDEST:
        body = F.col(text)
        matches = F.regexp_extract_all(body, F.lit(f"({PATTERN[kind]})"), F.lit(1))
        # The last gap has no match behind it.
        mask = lambda m, k=kind: F.when(m.isNull(), "").when(_valid(k, m), F.lit(f"<{k.upper()}>")).otherwise(m)
        if kind in MORE and SCORE[kind][0] < LEAST_SCORE:
            joined = F.zip_with(F.split(body, PATTERN[kind], -1), matches, lambda gap, m: F.concat(gap, F.when(_near(kind, F.right(gap, F.lit(NEAR))), mask(m)).otherwise(F.coalesce(m, F.lit("")))))
        else:
            joined = F.zip_with(F.split(body, PATTERN[kind], -1), matches, lambda gap, m: F.concat(gap, mask(m)))
        # A text without a mask has no more matches than before, which were none.
        docs = docs.withColumn(text, F.when(F.col("__masked") & _may(kind, body), F.array_join(joined, "")).otherwise(body))
    return restored(docs, columns, (text,))
