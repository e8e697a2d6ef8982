"""Exports: due list, list and detail projections, sitemap rows, structured-data documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.core import blank_to_null, text_or_blank
from ..functions.urls import canonical_url
from ..operators.aggregates import with_public_job_counts
from ..operators.filters import due, is_live, is_public_company
from ..operators.joins import latest_cycle, with_body
from ..operators.ordered import with_ordered_index

SITEMAP_PAGE = 50_000

# Static pages with their priority.
STATIC_PAGES = {
    "/": 0.8, "/jobs/": 0.7, "/companies/": 0.7, "/exams/": 0.7, "/exams/calendar/": 0.7,
}


def due_report(companies: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    rows = due(companies, as_of).select(
        "company_id", "name", "career_url", "career_source_type", "next_scrape_at",
        "scrape_health",
    )
    return rows if limit is None else rows.limit(limit)


def project_company(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    return with_public_job_counts(companies, jobs).select(
        "name", "slug", "domain", "industry", "open_jobs_count"
    )


def project_company_detail(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    return with_public_job_counts(companies, jobs).select(
        "name", "slug", "domain", "industry", "open_jobs_count", "career_url", "is_verified"
    )


def project_job_list(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """List rows with the company nested; ``is_saved`` must be present."""
    nested = companies.select(
        "company_id", F.struct("company_id", "name", "slug", "domain").alias("company")
    )
    return jobs.join(nested, "company_id").select(
        "job_id", "slug", "title", "company", "location_raw", "work_mode", "job_type",
        "department", "posted_at", "apply_url", "is_saved",
    )


def project_exam_list(exams: DataFrame, bodies: DataFrame, cycles: DataFrame) -> DataFrame:
    newest = latest_cycle(cycles, "created_at").select(
        "exam_id", F.col("status").alias("latest_cycle_status")
    )
    return with_body(exams, bodies).join(newest, "exam_id", "left").select(
        "exam_id", "exam_slug", "name", "short_name",
        F.struct("body_id", "body_name", "body_slug").alias("conducting_body"),
        "category", "level", "official_url", "is_active", "latest_cycle_status",
    )


def _sitemap_rows(
    df: DataFrame, section: str, slug: str, lastmod: Column, freq: str, priority: float
) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.col(slug).alias("slug"),
        F.concat(F.lit(f"/{section}/"), F.col(slug), F.lit("/")).alias("path"),
        lastmod.alias("lastmod"), F.lit(freq).alias("changefreq"),
        F.lit(priority).alias("priority"),
    )


def sitemap_urls(
    jobs: DataFrame, companies: DataFrame, exams: DataFrame, base_url: str,
    page_size: int = SITEMAP_PAGE,
) -> DataFrame:
    """Sitemap rows of all sections with their page number, ordered by slug within a section."""
    nothing = F.lit(None).cast("timestamp_ntz")
    static = jobs.sparkSession.range(1).select(
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("priority"))
                      for p, w in STATIC_PAGES.items()])
        ).alias("page")
    ).select(
        F.lit("static").alias("section"), F.col("page.path").alias("slug"), "page.path",
        nothing.alias("lastmod"), F.lit("daily").alias("changefreq"), "page.priority",
    )
    listed = jobs.filter(is_live() & F.col("duplicate_of").isNull())
    rows = (
        _sitemap_rows(listed, "jobs", "slug", F.col("last_seen_at"), "hourly", 0.8)
        .unionByName(_sitemap_rows(companies.filter(is_public_company()), "companies", "slug",
                                   F.col("updated_at"), "daily", 0.7))
        .unionByName(_sitemap_rows(exams, "exams", "exam_slug", F.col("updated_at"), "weekly",
                                   0.6))
        .unionByName(static)
    )
    indexed = with_ordered_index(rows, ["section", "slug"], "_index")
    first = indexed.groupBy("section").agg(F.min("_index").alias("_first"))
    page = F.floor((F.col("_index") - F.col("_first")) / page_size) + 1
    # four sections, so this side is tiny
    return indexed.join(F.broadcast(first), "section").select(
        "section", page.cast("int").alias("page"),
        F.concat(F.lit(base_url.rstrip("/")), F.col("path")).alias("loc"),
        "lastmod", "changefreq", "priority",
    )


def _iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def job_posting_jsonld(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """One structured-data document per published open job; absent values are left out."""
    firm = companies.select(
        "company_id", F.col("name").alias("_name"), F.col("domain").alias("_domain"),
        *([F.col("logo_url").alias("_logo")] if "logo_url" in companies.columns
          else [F.lit("").alias("_logo")]),
    )
    have = set(jobs.columns)

    def field(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def typed(kind: str, *fields: Column) -> Column:
        return F.struct(F.lit(kind).alias("@type"), *fields)

    clean, raw = text_or_blank(field("description_html_sanitized")), text_or_blank(
        field("description"))
    country = F.when(
        text_or_blank(field("country")) == "", F.lit("IN")
    ).otherwise(rules.country_code(field("country")))
    address = typed(
        "PostalAddress",
        blank_to_null(field("city")).alias("addressLocality"),
        blank_to_null(field("state")).alias("addressRegion"),
        country.alias("addressCountry"),
    )
    organisation = typed(
        "Organization", F.col("_name").alias("name"),
        F.when(text_or_blank(F.col("_domain")) != "",
               F.concat(F.lit("https://"), F.col("_domain"))).alias("sameAs"),
        blank_to_null(F.col("_logo")).alias("logo"),
    )
    remote = F.col("work_mode") == "remote"
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("JobPosting").alias("@type"),
        F.col("title"),
        F.when(clean != "", clean).when(
            raw != "", F.concat(F.lit("<p>"), raw, F.lit("</p>"))).alias("description"),
        _iso(rules.date_posted(F.col("posted_at"), F.col("first_seen_at"))).alias("datePosted"),
        _iso(rules.valid_through(field("deadline_at", "timestamp_ntz"),
                                 F.col("first_seen_at"))).alias("validThrough"),
        organisation.alias("hiringOrganization"),
        typed("Place", address.alias("address")).alias("jobLocation"),
        F.when(
            F.col("source_job_id") != "",
            typed("PropertyValue", F.col("_name").alias("name"),
                  F.col("source_job_id").alias("value")),
        ).alias("identifier"),
        F.lit(False).alias("directApply"),
        rules.base_salary(
            field("salary_min", "decimal(12,2)"), field("salary_max", "decimal(12,2)"),
            field("salary_currency"), field("salary_period"),
        ).alias("baseSalary"),
        rules.employment_code(F.col("job_type")).alias("employmentType"),
        F.when(remote, F.lit("TELECOMMUTE")).alias("jobLocationType"),
        F.when(remote, typed("Country", F.lit("Any").alias("name"))).alias(
            "applicantLocationRequirements"),
    )
    shown = jobs.filter(F.col("is_published") & (F.col("status") == "open"))
    return shown.join(firm, "company_id").select("job_id", F.to_json(document).alias("document"))


def project_job_detail(
    jobs: DataFrame, companies: DataFrame, base_url: str
) -> DataFrame:
    """Detail rows: the list row plus texts, canonical URL and structured data."""
    extra = ["description", "description_html_sanitized", "source_url", "experience_level",
             "extraction_confidence"]
    present = [c for c in extra if c in jobs.columns]
    documents = job_posting_jsonld(jobs, companies).withColumnRenamed(
        "document", "structured_data"
    )
    rest = jobs.select(
        "job_id", *present, F.col("last_seen_at").alias("scraped_at"),
        canonical_url("slug", base_url).alias("canonical_url"),
    )
    listed = project_job_list(jobs, companies)
    return listed.join(rest, "job_id").join(documents, "job_id", "left")
