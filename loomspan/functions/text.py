"""Text and markup measures as column expressions; see ``docs`` of each for what is counted."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of pages that need scripts to show their text, and of frameworks that render in the browser.
SHELL_MARKS = (
    "challenge-platform", "_cf_chl_opt", "Enable JavaScript", "enable JavaScript", "JavaScript is required", "You need to enable JavaScript",
    'id="__next"></div>', 'id="root"></div>', 'id="app"></div>',
)
FRAMEWORK_MARKS = ("ng-version=", "__NUXT__", "__remixContext", "window.__INITIAL_STATE__", "data-reactroot")
SCRIPT_STATE_MARKS = ("window.__", "self.__", "__NEXT_DATA__", "__next_f", "__PRELOADED_STATE__")
#: Fixed thresholds, in characters of visible text, bytes of markup, and shares.
LEAST_TEXT, LARGE_MARKUP, LEAST_SHARE = 200, 10_000, 0.03
GATE_SOURCE, GATE_SHARE = 500, 0.10
#: Invisible characters that are dropped.
ZERO_WIDTH = "​‌‍‎‏﻿­⁠⁢⁣⁤͏"


def content_format(name: Column) -> Column:
    """markdown or md, html, llm; anything else is text."""
    return F.when(name.isin("markdown", "md"), "markdown").when(name.isin("html", "llm"), name).otherwise("text")


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(m)) for m in marks))


def visible_text(html: Column) -> Column:
    """What stands outside of tags, scripts and styles."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script[^>]*>|<style.*?</style[^>]*>|<(?:script|style).*$", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>?|>", " ")


def visible_length(html: Column) -> Column:
    """Characters of visible text other than blanks."""
    return F.length(F.regexp_replace(visible_text(html), r"[\s\p{Z}\x85]+", "")).cast("int")


def needs_scripts(html: Column) -> Column:
    """A shell's mark, little text, or a large page with a tiny share of text and a framework's mark."""
    size = visible_length(html)
    thin = (F.octet_length(html) >= LARGE_MARKUP) & (size / F.octet_length(html) < LEAST_SHARE) & contains_any(html, FRAMEWORK_MARKS)
    return contains_any(html, SHELL_MARKS) | (size < LEAST_TEXT) | thin


def has_script_state(html: Column) -> Column:
    return contains_any(html, SCRIPT_STATE_MARKS)


def gate_note(source: Column, extracted: Column) -> Column:
    """A note where the extract keeps less than a tenth of a page with enough text, else null."""
    trips = (visible_length(source) >= GATE_SOURCE) & (visible_length(extracted) < visible_length(source) * GATE_SHARE)
    return F.when(trips, F.lit("extraction_rejected_low_text_ratio"))


def low_quality(html: Column, text: Column) -> Column:
    return (F.octet_length(html) > 5000) & (F.octet_length(text) < 100)


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")


def collapse_blank(text: Column) -> Column:
    """Runs of blanks to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def is_content_text(text: Column) -> Column:
    """At least 15 bytes, no link, path or JSON, a space, and letters and digits as three fifths of the bytes."""
    t = F.trim(text)
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return (F.octet_length(t) >= 15) & ~t.rlike(r"^(https?://|/|\{|\[)") & F.contains(t, F.lit(" ")) & (alnum / F.octet_length(t) >= 0.6)


def tag_attribute(html: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute, of all tags of a kind, double-quoted."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<{tag}\b[^>]*?\s{attribute}="([^"]*)"'), F.lit(1))


def truncate_bytes(text: Column, limit: int) -> Column:
    """Whole characters up to ``limit`` bytes, and an ellipsis where something is cut."""
    cuts = [F.try_validate_utf8(F.substring(F.encode(text, "utf-8"), F.lit(1), F.lit(limit - i)).cast("string")) for i in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.coalesce(*cuts), F.lit("…")))
