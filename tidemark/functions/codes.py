"""Small code tables of message sources, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tap-back codes of the message store.
REACTIONS = {2000: "❤️", 2001: "👍", 2002: "👎", 2003: "😂", 2004: "‼️", 2005: "❓"}
# Group action codes.
ACTIONS = {1: "added", 3: "removed"}


def reaction(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REACTIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, code.cast("int")), F.concat(F.lit("reaction:"), code.cast("string")))


def group_action(code: Column) -> Column:
    out = F
    for k, v in ACTIONS.items():
        out = out.when(code == k, F.lit(v))
    return out.otherwise(F.lit("unknown"))


def media_type(mime: Column, is_sticker: Column) -> Column:
    """image, video, audio, sticker or document; unknown and missing types are documents."""
    low = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(F.coalesce(is_sticker.cast("boolean"), F.lit(False)), "sticker").when(low.startswith("image/"), "image").when(low.startswith("video/"), "video").when(low.startswith("audio/"), "audio").otherwise("document")
