"""String functions on code and suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed

SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def fill(template: str, **values: Column) -> Column:
    """Concatenate a fixed text with columns put in the place of ``{name}``."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [
        values[part] if position % 2 else F.lit(part)
        for position, part in enumerate(parts)
        if position % 2 or part
    ]
    return F.concat(*pieces)


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (SQL ``trim`` only trims spaces)."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def clean_snippet(text: Column) -> Column:
    """Keep the code of a possibly fenced snippet.

    Python fences go; a fence that then opens the text goes with whatever
    precedes it; everything from the next fence on is cut.
    """
    bare = F.replace(text, F.lit(fixed.PYTHON_FENCE), F.lit(""))
    opened = bare.rlike(rf"(?U)^{SPACE}*{fixed.FENCE}")
    body = F.when(opened, F.substring(bare, F.locate(fixed.FENCE, bare) + 3, F.length(bare))).otherwise(bare)
    return F.substring_index(body, fixed.FENCE, 1)


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, F.length(text))).otherwise(text)


def strip_suffix(text: Column, suffix: str) -> Column:
    return F.when(
        text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))
    ).otherwise(text)


def assemble_suggestion(code: Column, generated: Column) -> Column:
    return clean_snippet(F.concat(code, generated))


def suggested_tail(code: Column, suggestion: Column) -> Column:
    """The part of a suggestion past the length of the code it continues."""
    return F.substring(suggestion, F.length(code) + 1, F.length(suggestion))


def normalise_token(text: Column) -> Column:
    return F.lower(strip(text))


def lines(text: Column) -> Column:
    """Lines of a text, with no empty line after a final line break."""
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK))


def difficulty(rating: Column) -> Column:
    """Bucket a rating; a missing rating fails every comparison and is hard."""
    return (
        F.when(rating < fixed.EASY_BELOW, "easy")
        .when(rating < fixed.MEDIUM_BELOW, "medium")
        .otherwise("hard")
    )
