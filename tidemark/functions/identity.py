"""Identifiers and names: normal forms and plausibility, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that say nothing.
NAMELESS = ["unknown", "unknown contact", "me"]
# Mail domains that many unrelated people share.
PUBLIC_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "proton.me", "protonmail.com", "live.com", "msn.com", "me.com", "mac.com"]


def phone(value: Column) -> Column:
    """Digits only, without the leading 1 of eleven."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def handle(value: Column) -> Column:
    low = F.trim(F.lower(value))
    return F.when((low == "") | low.startswith("@"), low).otherwise(F.concat(F.lit("@"), low))


def identifier(value: Column, kind: Column) -> Column:
    """The normal form under which contacts' identifiers are unique."""
    v = F.trim(value)
    return F.when(v == "", "").when(kind == "phone", phone(v)).when(kind == "handle", handle(v)).otherwise(F.lower(v))


def alias(value: Column, kind: Column) -> Column:
    """The normal form of entity aliases: telephone numbers keep their plus sign."""
    v = F.trim(value)
    return F.when(kind == "phone", F.regexp_replace(v, r"[\s()-]", "")).otherwise(F.lower(v))


def valid_phone(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s().-]", "").rlike(r"^\+?[0-9]{10,15}$")


def looks_like_email(value: Column) -> Column:
    return F.contains(F.trim(value), F.lit("@"))


def looks_like_phone(value: Column) -> Column:
    return value.rlike(r"^[0-9 ()+.-]*$") & F.length(phone(value)).between(7, 15)


def generic_name(name: Column) -> Column:
    """Whether a display name may be replaced by a better one."""
    v = F.trim(F.coalesce(name, F.lit("")))
    return (v == "") | F.lower(v).isin(NAMELESS) | looks_like_email(v) | looks_like_phone(v) | v.startswith("@") | ~v.rlike(r"\p{L}")


def meaningful_name(name: Column) -> Column:
    v = F.trim(F.coalesce(name, F.lit("")))
    return (v != "") & ~F.lower(v).isin(NAMELESS) & ~looks_like_email(v) & ~looks_like_phone(v) & ~v.startswith("@") & ~v.rlike("^[0-9]+$")


def display_name(existing: Column, candidate: Column, fallback: Column) -> Column:
    """The candidate if it is a name and the existing one isn't; else the existing one, or what there is."""
    c = F.trim(F.coalesce(candidate, F.lit("")))
    e = F.coalesce(existing, F.lit(""))
    return F.when(meaningful_name(candidate) & generic_name(existing), c).when(e != "", e).when(c != "", c).otherwise(fallback)


def better_name(source: Column, target: Column) -> Column:
    """Whether a merged entity should take the source's name."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    shout = lambda x: (x == F.upper(x)) & (F.octet_length(x) > 1)
    ls, lt = F.octet_length(s), F.octet_length(t)
    return F.when(s == "", False).when(t == "", True).when(~shout(s) & shout(t), True).when(shout(s) & ~shout(t), False).otherwise((ls > lt) & (ls < 50) & (ls < lt * 3))


# Endings that don't tell people apart.
NAME_ENDINGS = [" jr", " sr", " ii", " iii"]


def comparison_form(name: Column) -> Column:
    """For name similarity: lower case, no generational ending, single spaces."""
    out = F.trim(F.lower(name))
    for ending in NAME_ENDINGS:
        out = F.regexp_replace(out, ending + "$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
