"""Expressions on page titles and the identifiers made of them."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(title: Column) -> Column:
    """ASCII case folding, as a case-insensitive title index compares; other letters stay as they are."""
    return F.translate(title, string.ascii_uppercase, string.ascii_lowercase)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize(title: Column) -> Column:
    """The stored form: stripped, backslash and quotes escaped, blanks as underscores."""
    out = F.replace(strip(title), F.lit("\\"), F.lit("\\\\"))
    for plain in ("'", '"'):
        out = F.replace(out, F.lit(plain), F.lit("\\" + plain))
    return F.replace(out, F.lit(" "), F.lit("_"))


def readable(title: Column) -> Column:
    """The form for people; underscores of the original become blanks, so it is no exact inverse."""
    out = F.replace(strip(title), F.lit("_"), F.lit(" "))
    for plain in ('"', "'", "\\"):
        out = F.replace(out, F.lit("\\" + plain), F.lit(plain))
    return out


def is_page_id(page_id: Column) -> Column:
    return F.coalesce(page_id > 0, F.lit(False))


def is_title(title: Column) -> Column:
    return F.coalesce(F.length(title) > 0, F.lit(False))


def task_id(start: Column, target: Column) -> Column:
    return F.concat(sanitize(start), F.lit("__to__"), sanitize(target))


def run_id(start: Column, target: Column, at: Column) -> Column:
    """The identifier of one run of a task."""
    safe = lambda t: F.translate(t, " /", "__")
    return F.concat(safe(start), F.lit("__to__"), safe(target), F.lit("__"), F.date_format(at, "yyyyMMdd_HHmmss"))


def game_id(model_id: Column, at: Column, suffix: Column) -> Column:
    return F.concat_ws("_", F.translate(model_id, "/", "_"), F.date_format(at, "yyyyMMdd_HHmmss"), suffix)


# Titles of special pages begin with one of these.
EXCLUDED_PREFIXES = (
    "Tag:", "Category:", "File:", "Template:", "Help:",
    "Wikipedia:", "User:", "User talk:", "Template talk:",
    "Category talk:", "Portal:", "Project:", "MediaWiki:",
    "Module:", "Draft:",
)


def usable(title: Column, prefixes: tuple[str, ...] = EXCLUDED_PREFIXES) -> Column:
    """Neither blank nor of an excluded kind; prefixes are case-sensitive."""
    ok = F.length(F.trim(title)) > 0
    for p in prefixes:
        ok &= ~title.startswith(p)
    return F.coalesce(ok, F.lit(False))


def encode_ids(ids: Column) -> Column:
    """An array of ids as the exchanged text form: joined by bars."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), "|")


def decode_ids(text: Column) -> Column:
    """Ids of the text form; no text or no ids: an empty array."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "[|]"), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("long"))
