"""Ranked free-text search by trigram similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import any_of, contains_ci, let
from .joins import with_body, with_company

JOB_THRESHOLD = 0.1
COMPANY_THRESHOLD = 0.1
EXAM_THRESHOLD = 0.3


def text_trigrams(text: str) -> list[str]:
    """Trigram set of a search text, worked out once before the query runs."""
    words = re.findall(r"[^\W_]+", text.lower())
    padded = [f"  {word} " for word in words]
    return sorted({p[at:at + 3] for p in padded for at in range(len(p) - 2)})


def similarity_to(column: str, text: str) -> Column:
    """Similarity of a column to a fixed text.

    The pieces of the fixed text are looked up in the padded column text; only rows that share
    one have their own pieces counted. A piece across two words always ends in two blanks.
    """
    known = text_trigrams(text)

    def score(padded: Column) -> Column:
        shared = F.lit(0)
        for piece in known:
            shared = shared + F.when(padded.contains(piece), 1).otherwise(0)
        pieces = F.transform(
            F.sequence(F.lit(1), F.length(padded) - 2), lambda at: padded.substr(at, F.lit(3))
        )
        own = F.size(F.array_distinct(F.filter(pieces, lambda p: ~p.endswith("  "))))
        return let(
            shared,
            lambda n: F.when(n == 0, F.lit(0.0)).otherwise(n / (own + len(known) - n)),
        ).cast("float")

    words = F.regexp_replace(
        F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+", "   "
    )
    return let(F.concat(F.lit("  "), words, F.lit(" ")), score)


def _ranked(df: DataFrame, score: Column, keep, key: str) -> DataFrame:
    scored = df.withColumn("similarity", score)
    return scored.filter(keep(F.col("similarity"))).orderBy(F.col("similarity").desc(), key)


def _containing(df: DataFrame, fields: tuple[str, ...], text: str) -> DataFrame:
    return df.filter(any_of([contains_ci(F.col(f), text) for f in fields]))


def search_jobs(
    jobs: DataFrame, companies: DataFrame, text: str, threshold: float = JOB_THRESHOLD
) -> DataFrame:
    """Jobs whose title, company name and department together resemble the text. Texts under
    three characters are looked up literally."""
    if not text:
        return with_company(jobs, companies)
    if len(text) < 3:
        return _containing(
            with_company(jobs, companies), ("title", "company_name", "department"), text
        )
    # names are compared once per company, not once per job
    named = companies.withColumn("_by_name", similarity_to("name", text))
    joined = with_company(jobs, named, "_by_name")
    total = similarity_to("title", text) + F.col("_by_name") + similarity_to("department", text)
    # one tenth as a 4-byte float lies above the decimal 0.1, so it passes
    return _ranked(
        joined, total.cast("double"), lambda s: s > F.lit(threshold), "job_id"
    ).drop("_by_name")


def search_companies(
    companies: DataFrame, text: str, threshold: float = COMPANY_THRESHOLD
) -> DataFrame:
    if not text:
        return companies
    if len(text) < 3:
        return _containing(companies, ("name",), text)
    score = similarity_to("name", text).cast("double")
    return _ranked(companies, score, lambda s: s > F.lit(threshold), "company_id")


def search_exams(
    exams: DataFrame, bodies: DataFrame, text: str, threshold: float = EXAM_THRESHOLD
) -> DataFrame:
    fields = ("name", "short_name", "body_name")
    joined = with_body(exams, bodies)
    if not text:
        return joined
    if len(text) < 3:
        return _containing(joined, fields, text)
    best = F.greatest(*[similarity_to(name, text) for name in fields]).cast("double")
    return _ranked(joined, best, lambda s: s >= F.lit(threshold), "exam_id")
