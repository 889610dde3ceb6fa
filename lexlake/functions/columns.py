"""Column builders for text, array cells, time stamps and predicates."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexlake.functions import fixed_values as fixed


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def to_micros(moment: datetime) -> int:
    """Epoch microseconds; a moment without a time zone is UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def timestamp_lit(moment: datetime) -> Column:
    """A timestamp literal that does not depend on the driver's local time zone."""
    return F.timestamp_micros(F.lit(to_micros(moment)))


# ---- text ---------------------------------------------------------------------------------------------------------


def token_array(text: Column) -> Column:
    """Pieces between punctuation; hyphens and white space stay, so phrases stay whole."""
    return F.split(text, fixed.TOKEN_BREAK)


def clean_token(token: Column) -> Column:
    return F.trim(F.lower(token))


def book_label(title: Column, authors: Column) -> Column:
    return F.format_string("`%s` BY `%s`", title, authors)


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


# ---- definitions --------------------------------------------------------------------------------------------------


def is_defined(normalized_text: Column | str = "normalizedText") -> Column:
    """True for a row that carries a definition; never NULL, so ``~is_defined()`` is its exact complement."""
    c = F.col(normalized_text) if isinstance(normalized_text, str) else normalized_text
    return F.coalesce(c != fixed.MISSING_TEXT, F.lit(False))


def is_undefined(normalized_text: Column | str = "normalizedText") -> Column:
    return ~is_defined(normalized_text)


# ---- request keys -------------------------------------------------------------------------------------------------


def definition_request(text: Column) -> Column:
    return F.concat(F.lit(fixed.DEFINITION_ENDPOINT + "/"), F.url_encode(text))


def usage_query(text: Column, part_of_speech: Column, corpus: str = fixed.USAGE_CORPUS) -> Column:
    """``text_TAG:corpus``; a part of speech the service does not know leaves the tag out."""
    pairs = [F.lit(v) for kv in fixed.USAGE_TAGS.items() for v in kv]
    tag = F.element_at(F.create_map(*pairs), F.coalesce(part_of_speech, F.lit("")))
    return F.concat(text, F.coalesce(F.concat(F.lit("_"), tag), F.lit("")), F.lit(f":{corpus}"))


def usage_request(
    text: Column,
    part_of_speech: Column,
    corpus: str = fixed.USAGE_CORPUS,
    first_year: int = fixed.USAGE_FIRST_YEAR,
    last_year: int = fixed.USAGE_LAST_YEAR,
) -> Column:
    return F.concat(
        F.lit(f"{fixed.USAGE_ENDPOINT}?content="),
        F.url_encode(usage_query(text, part_of_speech, corpus)),
        F.lit(f"&year_start={first_year}&year_end={last_year}"),
    )


# ---- published cells ----------------------------------------------------------------------------------------------


def or_empty(*candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit(""))


def sheet_time(moment: Column) -> Column:
    return F.date_format(moment, fixed.SHEET_TIME_FORMAT)


def usage_percent(usage: Column) -> Column:
    return F.concat(F.format_number(usage * 100, fixed.USAGE_DECIMALS), F.lit("%"))


def split_cell(cell: Column, separator: str = fixed.CELL_SEPARATOR) -> Column:
    return F.split(cell, re.escape(separator))


def merge_cell(
    published: Column,
    stored: Column,
    separator: str = fixed.CELL_SEPARATOR,
    keep_empty: bool = False,
) -> Column:
    """The published cell's entries followed by stored entries it lacks, as one cell.

    An empty published cell has no entries; with ``keep_empty`` it counts as one empty entry.
    """
    before = F.coalesce(split_cell(published, separator), empty_strings())
    if not keep_empty:
        before = F.filter(before, lambda piece: piece != "")
    return F.array_join(F.array_union(before, F.coalesce(stored, empty_strings())), separator)
