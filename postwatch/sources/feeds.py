"""Feed documents and career pages of six source types → postings under one contract.

Input rows hold ``company_id``, ``source_type`` and the document ``body``; documents are parsed
where they lie, one row per document, and leave as one row per posting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.core import blank_to_null, lookup, text_or_blank
from ..functions.rules import parse_feed_time
from ..functions.urls import host_of
from .pages import career_links

POSTING_COLUMNS = (
    "source_job_id", "source_url", "apply_url", "title", "location_raw", "description",
    "description_html", "department", "job_type", "work_mode", "experience_level", "posted_at",
    "extraction_confidence",
)

# Name and version each reader stamps on its postings.
PARSER_VERSIONS = {
    "greenhouse": "greenhouse@1", "lever": "lever@1", "ashby": "ashby@1",
    "smartrecruiters": "smartrecruiters@1", "own_career_page": "static@1", "unknown": "static@1",
}

# Nested values whose shape varies are read as raw JSON text and looked into afterwards.
GREENHOUSE_SCHEMA = (
    "jobs array<struct<id string, title string, location string, content string, "
    "absolute_url string, departments string, updated_at string>>"
)
LEVER_SCHEMA = (
    "array<struct<id string, text string, categories struct<location string, department string, "
    "team string, commitment string>, descriptionPlain string, description string, "
    "hostedUrl string, applyUrl string, createdAt string, workplaceType string>>"
)
ASHBY_SCHEMA = (
    "jobPostings array<struct<id string, title string, locationName string, "
    "descriptionSocial string, descriptionHtml string, jobUrl string, applyUrl string, "
    "departmentName string, employmentType string, publishedAt string, isRemote boolean>>"
)
SMARTRECRUITERS_SCHEMA = (
    "content array<struct<id string, name string, location struct<city string, region string, "
    "country string, remote boolean>, department struct<label string>, ref string>>"
)


def _either(first: Column, second: Column) -> Column:
    return text_or_blank(F.coalesce(blank_to_null(first), second))


@dataclass(frozen=True)
class Dialect:
    """How a document is taken apart (``items``, a column over the document) and what an item says
    (``fields``, by posting column)."""

    items: Column
    fields: Callable[[Column], dict]


def greenhouse() -> Dialect:
    def fields(job: Column) -> dict:
        place, team = job["location"], job["departments"]
        nested = place.startswith("{")
        named = text_or_blank(F.when(nested, F.get_json_object(place, "$.name")))
        first_team = F.get_json_object(team, "$[0]")
        return {
            "source_job_id": text_or_blank(job["id"]),
            "source_url": text_or_blank(job["absolute_url"]),
            "apply_url": text_or_blank(job["absolute_url"]),
            "title": text_or_blank(job["title"]),
            "location_raw": F.when(nested, named).otherwise(text_or_blank(place)),
            "description": texts.strip_html(job["content"]),
            "description_html": text_or_blank(job["content"]),
            "department": text_or_blank(
                F.when(first_team.startswith("{"), F.get_json_object(team, "$[0].name"))
                .otherwise(first_team)
            ),
            "work_mode": texts.work_mode_from_text(named, job["title"]),
            "posted_at": parse_feed_time(job["updated_at"], "seconds"),
            "extraction_confidence": F.lit(90),
        }

    return Dialect(F.from_json("body", GREENHOUSE_SCHEMA)["jobs"], fields)


def lever() -> Dialect:
    def fields(job: Column) -> dict:
        kinds = job["categories"]
        return {
            "source_job_id": text_or_blank(job["id"]),
            "source_url": text_or_blank(job["hostedUrl"]),
            "apply_url": _either(job["applyUrl"], job["hostedUrl"]),
            "title": text_or_blank(job["text"]),
            "location_raw": text_or_blank(kinds["location"]),
            "description": _either(
                job["descriptionPlain"], texts.strip_html(job["description"], False)
            ),
            "description_html": text_or_blank(job["description"]),
            "department": _either(kinds["department"], kinds["team"]),
            "job_type": texts.job_type(kinds["commitment"], "lever"),
            "work_mode": texts.lever_work_mode(job["workplaceType"]),
            "posted_at": parse_feed_time(job["createdAt"], "millis"),
            "extraction_confidence": F.lit(90),
        }

    # a document that is no list has no postings
    is_list = F.col("body").rlike(r"^\s*\[")
    return Dialect(F.when(is_list, F.from_json("body", LEVER_SCHEMA)), fields)


def ashby() -> Dialect:
    def fields(job: Column) -> dict:
        return {
            "source_job_id": text_or_blank(job["id"]),
            "source_url": text_or_blank(job["jobUrl"]),
            "apply_url": _either(job["applyUrl"], job["jobUrl"]),
            "title": text_or_blank(job["title"]),
            "location_raw": text_or_blank(job["locationName"]),
            "description": _either(
                job["descriptionSocial"], texts.strip_html(job["descriptionHtml"], False)
            ),
            "description_html": text_or_blank(job["descriptionHtml"]),
            "department": text_or_blank(job["departmentName"]),
            "job_type": texts.job_type(job["employmentType"], "ashby"),
            "work_mode": F.when(job["isRemote"], "remote").otherwise(
                texts.work_mode_from_text(job["locationName"], job["title"])
            ),
            "posted_at": parse_feed_time(job["publishedAt"], "seconds"),
            "extraction_confidence": F.lit(90),
        }

    return Dialect(F.from_json("body", ASHBY_SCHEMA)["jobPostings"], fields)


def smartrecruiters() -> Dialect:
    def fields(job: Column) -> dict:
        place = job["location"]
        remote = F.coalesce(place["remote"], F.lit(False))
        return {
            "source_job_id": text_or_blank(job["id"]),
            "source_url": text_or_blank(job["ref"]),
            "apply_url": text_or_blank(job["ref"]),
            "title": text_or_blank(job["name"]),
            "location_raw": texts.location_text(
                place["city"], place["region"], place["country"], remote
            ),
            "department": text_or_blank(job["department"]["label"]),
            "work_mode": F.when(remote, "remote").otherwise(""),
            "posted_at": F.lit(None).cast("timestamp_ntz"),
            "extraction_confidence": F.lit(60),
        }

    return Dialect(F.from_json("body", SMARTRECRUITERS_SCHEMA)["content"], fields)


def career_page() -> Dialect:
    """Links of a page of the company's own; without a career address there are none."""
    def fields(link: Column) -> dict:
        return {
            "source_url": link["url"], "apply_url": link["url"], "title": link["title"],
            "posted_at": F.lit(None).cast("timestamp_ntz"), "extraction_confidence": F.lit(40),
        }

    links = career_links(F.col("body"), F.col("url"), host_of("career_url", strip_www=False))
    return Dialect(F.when(F.col("career_url") != "", links), fields)


DIALECTS: dict[str, Callable[[], Dialect]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters,
    "own_career_page": career_page, "unknown": career_page,
}
#: Source types whose documents are JSON; others are pages.
JSON_TYPES = ("greenhouse", "lever", "ashby", "smartrecruiters")


def ingest_postings(raw: DataFrame, dialects: dict | None = None) -> DataFrame:
    """Every document through the reader of its source type, stamped with the reader version.

    The documents (company_id, source_type, body; for pages also url, or final_url, and career_url)
    are scanned once: a document offers an array of items that have one slot per dialect, and one
    explode makes postings of all types. Broken documents have no items and give no rows, nor do
    unknown source types.
    """
    chosen = {name: build() for name, build in (dialects or DIALECTS).items()}
    url = [c for c in ("final_url", "url") if c in raw.columns] or [None]
    place = F.coalesce(*[F.col(c) if c else F.lit(None).cast("string") for c in url])
    career = F.col("career_url") if "career_url" in raw.columns else F.lit("")
    docs = raw.withColumns({"url": place, "career_url": text_or_blank(career)})
    slots = {name: f"{name}_item" for name in chosen}
    kinds = {name: docs.select(d.items.alias("i")).schema["i"].dataType.elementType.simpleString()
             for name, d in chosen.items()}

    def slotted(name: str) -> Column:
        return F.transform(chosen[name].items, lambda item: F.when(item.isNotNull(), F.struct(*[
            (item if other == name else F.lit(None).cast(kinds[other])).alias(slot)
            for other, slot in slots.items()])))

    items = F.lit(None)
    for name in chosen:
        items = F.when(F.col("source_type") == name, slotted(name)).otherwise(items)
    rows = docs.select("company_id", "source_type", F.posexplode(items).alias("pos", "item")).filter(
        F.col("item").isNotNull())
    read = {name: d.fields(F.col("item")[slots[name]]) for name, d in chosen.items()}

    def value(column: str) -> Column:
        out = F.lit(None)
        for name, fields in read.items():
            out = F.when(F.col("source_type") == name, fields.get(column, F.lit(""))).otherwise(out)
        return out.alias(column)

    version = lookup(F.col("source_type"), PARSER_VERSIONS, F.col("source_type"))
    return rows.select("company_id", "source_type", "pos", *map(value, POSTING_COLUMNS),
                       version.alias("parser_version"))


def unreadable(source_type: Column, body: Column) -> Column:
    """Whether a document of a JSON dialect is no JSON at all."""
    return source_type.isin(*JSON_TYPES) & F.get_json_object(body, "$").isNull()


def build_fetch_url(companies: DataFrame) -> DataFrame:
    """Address of the feed of every company, by source type."""
    # Feed addresses; {} stands for the board identifier.
    templates = {
        "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true",
        "lever": "https://api.lever.co/v0/postings/{}?mode=json",
        "ashby": "https://jobs.ashbyhq.com/{}/json",
        "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/{}/postings",
    }
    template = lookup(F.col("career_source_type"), templates, F.lit(None).cast("string"))
    filled = F.replace(template, F.lit("{}"), text_or_blank(F.col("ats_identifier")))
    return companies.withColumn(
        "fetch_url", F.coalesce(filled, text_or_blank(F.col("career_url")))
    )
