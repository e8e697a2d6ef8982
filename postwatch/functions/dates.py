"""Dates written in free text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import let

# Month names and the number each stands for.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9,
    "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12,
    "december": 12,
}
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"

# The four written forms looked for, in order of preference.
DATE_PATTERNS = (
    ("day-month-year", r"\b\d{1,2}[-\s/]\d{1,2}[-\s/]\d{2,4}\b"),
    ("year-month-day", r"\b\d{2,4}[-\s/]\d{1,2}[-\s/]\d{1,2}\b"),
    ("month-day-year", rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b"),
    ("day-month-year-text", rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b"),
)
CONTEXT_CHARS = 30
_FORMS = [(hint, re.compile(pattern, re.IGNORECASE)) for hint, pattern in DATE_PATTERNS]


def _full_year(year: Column, digits: Column, now: int) -> Column:
    """Two-digit years go to the century within fifty years of ``now``."""
    guess = year + F.lit(now - now % 100)
    near = (
        F.when(guess >= now + 50, guess - 100).when(guess < now - 50, guess + 100)
        .otherwise(guess)
    )
    return F.when(digits <= 2, near).otherwise(year)


def _date(year: Column, month: Column, day: Column) -> Column:
    two = [F.lpad(part.cast("string"), 2, "0") for part in (month, day)]
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), *two).try_cast("date")


def _number(digits: Column, place: int) -> Column:
    return F.get(digits, F.lit(place)).try_cast("int")


def _parts(raw: Column) -> Column:
    """The numbers of a matched text in one pass: two beside a month name, else three."""
    def read(digits: Column) -> Column:
        return F.struct(
            *[_number(digits, i).alias(name) for i, name in enumerate("abc")],
            F.length(F.get(digits, F.lit(0))).alias("head"),
            F.length(F.get(digits, F.lit(2))).alias("tail"),
        )

    return let(F.regexp_extract_all(raw, F.lit(r"(?U)\d+"), F.lit(0)), read)


def _parsed(raw: Column, hint: Column, n: Column, now: int) -> Column:
    def numeric() -> Column:
        day_first = ((hint == "day-month-year") & (n["b"] <= 12)) | (n["a"] > 12)
        year_first = (n["a"] > 31) | (n["head"] > 2)
        year = F.when(year_first, _full_year(n["a"], n["head"], now)).otherwise(
            _full_year(n["c"], n["tail"], now))
        month = F.when(year_first | day_first, n["b"]).otherwise(n["a"])
        day = F.when(year_first, n["c"]).when(day_first, n["a"]).otherwise(n["b"])
        return F.when(n["a"].isNotNull() & n["b"].isNotNull() & n["c"].isNotNull(),
                      _date(year, month, day))

    names = F.create_map(*[F.lit(part) for pair in MONTHS.items() for part in pair])
    month = F.try_element_at(names, F.lower(F.regexp_extract(raw, r"([A-Za-z]+)", 1)))
    written = F.when(month.isNotNull(), _date(n["b"], month, n["a"]))
    return F.when(hint.isin("month-day-year", "day-month-year-text"), written).otherwise(numeric())


def parse_written_date(raw: Column, hint: Column, now: int) -> Column:
    """The date a matched text stands for, null when it is none. Numeric dates are read day first
    unless only month first is possible."""
    return let(_parts(raw), lambda n: _parsed(raw, hint, n, now))


def _ambiguous(hint: Column, n: Column) -> Column:
    a, b, c = n["a"], n["b"], n["c"]
    return F.coalesce(
        F.when(hint == "day-month-year", (a <= 12) & (b <= 12) & (a != b))
        .when(hint == "year-month-day", (b <= 12) & (c <= 12) & (b != c)), F.lit(False))


def _written_forms(text: str) -> dict[str, tuple[int, str]]:
    """Every written form once with its first place and its form, in order of form and place."""
    first: dict[str, tuple[int, str]] = {}
    for hint, pattern in _FORMS:
        for match in pattern.finditer(text):
            first.setdefault(match.group(), (match.start(), hint))
    return first


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per written form of every text, with the text around its first place."""
    for batch in batches:
        owner, places, raws, hints, contexts = [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            for place, (raw, (at, hint)) in enumerate(_written_forms(text).items()):
                around = text[max(at - CONTEXT_CHARS, 0):at + len(raw) + CONTEXT_CHARS]
                owner.append(row)
                places.append(place)
                raws.append(raw)
                hints.append(hint)
                contexts.append(around.replace("\n", " "))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(places, pa.int32()),
             *[pa.array(values, pa.string()) for values in (raws, hints, contexts)]],
            names=[batch.schema.names[0], "pos", "raw", "hint", "context"])


def date_candidates(
    docs: DataFrame, key: str, text: str, now_year: int
) -> DataFrame:
    """Date-like texts of every document, each written form once, with the parsed date, the
    text around it and whether day and month could be swapped.

    SQL functions give matches without their places, so the search runs over Arrow batches: one
    scan of a text per form, linear in its length. Texts without a digit or null stay
    behind; reading and judging the matches is left to SQL.
    """
    searched = docs.select(key, text).filter(F.col(text).rlike(r"(?U)\d"))
    kind = docs.schema[key].dataType.simpleString()
    rows = searched.mapInArrow(
        _found, f"`{key}` {kind}, pos int, raw string, hint string, context string")
    raw, hint, n = F.col("raw"), F.col("hint"), F.col("_n")
    return rows.withColumn("_n", _parts(raw)).select(
        key, "pos", "raw", "hint", _parsed(raw, hint, n, now_year).alias("parsed"), "context",
        _ambiguous(hint, n).alias("ambiguous"))
