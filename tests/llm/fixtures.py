"""Rows that operators must take without complaint."""

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven."),
    (2, ""),
    (3, None),
    (4, "   \n\t "),
    (5, "One two three four five six seven eight nine ten eleven."),
    (5, "One two three four five six seven eight nine ten eleven."),
    (None, "A text without an id, seen once."),
    (None, None),
    (7, "1" * 300_000),
    (8, LONG),
    (9, "Ünïcode ⚡ 漢字 and an emoji 👩‍👩‍👧 at a@b.cc\x00end"),
    (10, "a"),
]
CLASH = "doc_id long, text string, n_words string, score string, fp string, shard string, size string, kept string, clean_text string, lang_pred string, pii string, length string"


def messy(spark):
    """The texts, with columns named as those that operators add."""
    return spark.createDataFrame([(*row, *["x"] * 10) for row in TEXTS], CLASH).repartition(3)


def empty(spark):
    return spark.createDataFrame([], CLASH)
