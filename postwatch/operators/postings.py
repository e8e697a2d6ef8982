"""Posting upsert: match a batch of postings against the job table and merge it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.core import any_of, text_or_blank
from ..functions.urls import ATS_TYPES, normalize_url
from ..session import written
from .joins import resolve_duplicates
from .merge import HIT, assign, with_hits
from .ordered import number_chunk, with_neighbour, with_ordered_index

# Columns a feed may change on a stored job.
UPDATABLE = (
    "title", "description", "description_html", "description_html_sanitized", "apply_url",
    "location_raw", "city", "state", "country", "work_mode", "job_type", "experience_level",
    "min_experience_years", "max_experience_years", "salary_min", "salary_max",
    "salary_currency", "salary_period", "department", "skills", "education_required",
    "posted_at", "deadline_at",
)
CLOSING = ("possibly_closed", "likely_closed", "closed")
PUBLISH_CONFIDENCE = 70
#: Postings of one job that are put in order by one task.
LONG_CHAIN = 65_536


@dataclass(frozen=True)
class UpsertResult:
    jobs: DataFrame
    events: DataFrame
    outcomes: DataFrame


def with_identity(postings: DataFrame) -> DataFrame:
    """Columns a posting is recognised by."""
    blank = F.lit("")
    text = F.col("description") if "description" in postings.columns else blank
    return (
        postings.withColumn("source_job_id", F.trim(text_or_blank(F.col("source_job_id"))))
        .withColumn("title", F.trim(text_or_blank(F.col("title"))))
        .withColumn("source_url", text_or_blank(F.col("source_url")))
        .withColumn("normalized_source_url", normalize_url("source_url"))
        .withColumn("title_normalized", texts.title_normalized("title"))
        .withColumn(
            "content_hash", texts.content_hash(F.col("title"), F.col("location_raw"), text)
        )
    )


def match_keys(df: DataFrame, *columns: str) -> DataFrame:
    """One row per usable key: 1 source id, 2 canonical URL, 3 content hash. Title plus URL adds
    nothing once the URL alone matches."""
    def key(name: str) -> Column:
        plain = df.schema[name].dataType.simpleString() == "binary"
        return F.col(name) if plain else F.encode(name, "utf-8")

    keys = F.array(
        *[F.struct(F.lit(rule).alias("rule"), key(name).alias("match_key"))
          for rule, name in enumerate(
              ("source_job_id", "normalized_source_url", "content_hash"), 1)]
    )
    usable = F.filter(keys, lambda k: F.length(k["match_key"]) > 0)
    return df.select("company_id", *columns, F.explode(usable).alias("_k")).select(
        "company_id", *columns, "_k.rule", "_k.match_key"
    )


def _digest(name: str) -> Column:
    """A content hash in half the bytes; any other text as it is, marked."""
    return F.when(F.col(name).rlike("^[0-9a-f]{64}$"), F.unhex(name)).when(
        F.col(name) != "", F.encode(F.concat(F.lit("="), F.col(name)), "utf-8")
    ).when(F.col(name) == "", F.encode(name, "utf-8"))


def match_postings(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Stored job of every posting row that has one: the first rule that finds a job decides.

    Among several jobs with the source id or the URL the newest ``posted_at`` wins, a job without
    a date before all others, then the newest ``first_seen_at``; among equal texts the job that was
    seen first. Only slim key rows are joined, and the stored side is reduced to one job per key
    before, so many copies of one text meet one row, never each other.
    """
    posted = F.col("posted_at") if "posted_at" in jobs.columns else F.lit(None)
    posted, seen = (F.unix_micros(c.cast("timestamp")) for c in (posted, F.col("first_seen_at")))
    by_text = F.col("rule") == 3
    order = F.struct(
        F.when(by_text, 0).when(posted.isNotNull(), -posted).otherwise(F.lit(-(1 << 63))).alias("a"),
        F.when(by_text, seen).otherwise(-seen).alias("b"), "job_id")
    live = jobs.filter(~F.col("is_deleted"))
    if postings.schema["content_hash"].dataType.simpleString() == "binary":
        live = live.withColumn("content_hash", _digest("content_hash"))
    carried = [c for c in ("posted_at", "first_seen_at") if c in jobs.columns]
    owners = match_keys(live, "job_id", *carried).groupBy(
        "company_id", "rule", "match_key").agg(F.min(order)["job_id"].alias("job_id"))
    hits = match_keys(postings, "row_id").join(owners, ["company_id", "rule", "match_key"])
    best = hits.groupBy("row_id").agg(F.min(F.struct("rule", "job_id")).alias("_best"))
    return best.select(
        "row_id", F.col("_best.rule").alias("match_rule"), F.col("_best.job_id").alias("job_id"))


def group_new(postings: DataFrame) -> DataFrame:
    """(row_id, root) of postings without a stored job: those that share a key mean one new job,
    named by its first row. Chains of shared keys are followed by pointer jumping."""
    keyed = match_keys(postings, "row_id")
    first = keyed.groupBy("company_id", "rule", "match_key").agg(
        F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") > 1).drop("_n")
    parents = keyed.join(first, ["company_id", "rule", "match_key"]).filter(
        F.col("_first") < F.col("row_id")
    ).groupBy("row_id").agg(F.min(F.struct("rule", "_first")).alias("_p")).select(
        F.col("row_id").alias("job_id"), F.col("_p._first").alias("duplicate_of"))
    roots = resolve_duplicates(parents).select(F.col("job_id").alias("row_id"), "root")
    return postings.select("row_id").join(roots, "row_id", "left").select(
        "row_id", F.coalesce("root", "row_id").alias("root"))


def _value_hashes(fields: list[str], kinds: dict, columns: list[str]) -> Column:
    """One number per field, so that values are compared without being carried along."""
    return F.array(*[
        F.xxhash64(F.lit(f), F.col(f).cast(kinds[f])) if f in columns else F.lit(0).cast("long")
        for f in fields])


def _number(text: str) -> Column:
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def _sequence(
    targets: DataFrame, jobs: DataFrame, fields: list[str], material: list[int]
) -> DataFrame:
    """What every posting does to its job, given what the postings before it have done: columns
    ``outcome`` and ``changed`` (title, place or text differ). Slim rows only; the postings of one
    job follow each other by position, a job with very many is cut into chunks of positions."""
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    protected = (F.col("manually_edited_fields") if "manually_edited_fields" in jobs.columns
                 else F.array().cast("array<string>"))
    version = F.col("parser_version") if "parser_version" in jobs.columns else F.lit("")
    stored = jobs.select(
        "job_id", "status", "is_manual_status", F.struct(
            _value_hashes(fields, kinds, jobs.columns).alias("values"),
            _number("source_url").alias("url"), F.coalesce(version, F.lit("")).alias("version"),
        ).alias("_stored"),
        F.transform(F.array(*map(F.lit, fields)), lambda f: F.array_contains(
            F.coalesce(protected, F.array().cast("array<string>")), f)).alias("_edited"),
    ).join(targets.filter("job_id IS NOT NULL").select("job_id").distinct(), "job_id", "left_semi")
    placed = targets.withColumn("_own", F.struct("values", "url", "version"))
    chained = with_neighbour(placed, ["job_id", "root"], ["at"], "_own", "_before",
                             number_chunk("at"), whole=LONG_CHAIN)
    met = chained.join(stored, "job_id", "left").withColumn("_first", F.col("_before").isNull())
    before, own = F.coalesce("_before", "_stored"), F.col("_own")
    differs = F.transform(F.sequence(F.lit(0), F.lit(len(fields) - 1)), lambda i: (
        F.get(before["values"], i) != F.get(own["values"], i)) & ~F.coalesce(
        F.get("_edited", i), F.lit(False))) if fields else F.array().cast("array<boolean>")
    met = met.withColumn("_differs", differs)
    changed = F.coalesce(any_of([F.get("_differs", i) for i in material]), F.lit(False))
    moved = (
        F.exists("_differs", lambda d: d) | (own["url"] != before["url"])
        | ((own["version"] != "") & (own["version"] != before["version"])))
    fresh = F.col("job_id").isNull()
    reopened = F.col("_first") & F.col("status").isin(*CLOSING) & ~F.col("is_manual_status")
    stays_open = fresh | (F.col("status") == "open") | (
        ~F.col("_first") & F.col("status").isin(*CLOSING) & ~F.col("is_manual_status"))
    outcome = (
        F.when(fresh & F.col("_first"), "created").when(reopened, "reopened")
        .when(stays_open & ~moved, "unchanged").otherwise("updated"))
    return met.select(
        "row_id", "at", "company_id", "job_id", "root", "sid", "confidence", "status",
        outcome.alias("outcome"), (changed & ~(fresh & F.col("_first"))).alias("changed"))


def upsert_postings(
    jobs: DataFrame, companies: DataFrame, batch: DataFrame, as_of: Column,
    above: int | None = None,
) -> UpsertResult:
    """Merge a batch of postings (with unique, ordered ``row_id``) into the job table.

    Postings are matched with the stored jobs first, rule by rule; only those that match none are
    grouped among themselves and make new jobs. So jobs of equal text stay apart where each has its
    own posting. Outcome per posting: created, reopened, unchanged or updated, in the order of
    ``row_id``: a posting is compared with what the one before it has left. The values of a job's
    last posting count; fields a person edited are kept. Jobs a batch does not mention are carried
    over untouched. Where ``jobs`` is a part of the table, ``above`` is the highest number of a job
    in all of it.
    """
    firm = companies.select(
        "company_id", F.col("career_source_type").isin(*ATS_TYPES).alias("_is_ats")
    )
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    fields = [c for c in UPDATABLE if c in jobs.columns and c in batch.columns]
    material = [i for i, f in enumerate(fields) if f in ("title", "location_raw", "description")]
    version = text_or_blank(F.col("parser_version")) if "parser_version" in batch.columns else F.lit(
        "")
    confidence = (
        texts.clamp_confidence("extraction_confidence")
        if "extraction_confidence" in batch.columns else F.lit(0)
    )
    # the batch is used several times below: it is parsed, numbered and written once; what follows
    # from its columns is not moved and written with it
    rows = with_identity(with_ordered_index(batch, ["row_id"], "at"))
    slim = rows.select(
        "row_id", "at", "company_id", "source_job_id", "normalized_source_url",
        _digest("content_hash").alias("content_hash"), confidence.alias("confidence"),
        _value_hashes(fields, kinds, fields).alias("values"), _number("source_url").alias("url"),
        version.alias("version"))
    # the keys to match by are only kept where they have matched nothing
    found = F.col("job_id").isNotNull()
    matched = written(slim.join(match_postings(jobs, slim), "row_id", "left").withColumns(
        {"sid": F.col("source_job_id")} | {c: F.when(~found, F.col(c)) for c in (
            "source_job_id", "normalized_source_url", "content_hash")}), "matched")
    new = matched.filter("job_id IS NULL")
    kept = [c for c in matched.columns if c not in (
        "source_job_id", "normalized_source_url", "content_hash", "match_rule")]
    grouped = matched.filter("job_id IS NOT NULL").select(
        *kept, F.lit(None).cast(rows.schema["row_id"].dataType).alias("root")
    ).unionByName(new.select(*kept).join(group_new(new), "row_id"))
    done = written(_sequence(grouped, jobs, fields, material), "done")

    latest = done.groupBy("job_id", "root").agg(
        F.max("at").alias("at"), F.min_by(F.struct("sid", "confidence"), "at").alias("_first"),
        F.max(F.col("changed").cast("int")).alias("_changed"),
        F.max((F.col("outcome") != "unchanged").cast("int")).alias("_writes"),
        F.max((F.col("outcome") == "reopened").cast("int")).alias("_again"),
        F.max_by("company_id", "at").alias("company_id"),
    )
    told = dict.fromkeys((*fields, *(c for c in ("title", "location_raw", "description")
                                     if c in batch.columns), "source_url", "normalized_source_url"))
    payload = rows.select("at", *told, version.alias("version"))
    facts = ("_writes", "_again", "_changed")
    known = latest.filter("job_id IS NOT NULL").select("job_id", "at", *facts).join(payload, "at")
    # a posting that changes nothing leaves no values
    posting = [F.when(F.col("_writes") == 1, F.col(c)).alias(c) for c in (*told, "version")]
    merged = jobs.join(
        known.select("job_id", F.struct(*facts, *posting).alias("c")), "job_id", "left"
    ).join(firm, "company_id", "left")
    hit = F.col("c").isNotNull()
    writes, again = F.col("c._writes") == 1, F.col("c._again") == 1

    def kept(name: str) -> Column:
        if "manually_edited_fields" not in jobs.columns:
            return F.lit(False)
        return F.coalesce(F.array_contains("manually_edited_fields", name), F.lit(False))

    def after(name: str) -> Column:
        return F.when(kept(name), F.col(name)).otherwise(F.col("c")[name])

    def either(name: str) -> Column:
        if name not in jobs.columns:
            return F.lit("")
        return after(name) if name in batch.columns else F.lit("")

    new_hash = texts.content_hash(either("title"), either("location_raw"), either("description"))
    review = writes & (F.col("c._changed") == 1) & ~F.coalesce("_is_ats", F.lit(False))
    values: dict[str, Column] = {f: F.when(writes, after(f)).otherwise(F.col(f)) for f in fields}
    values |= {
        "source_url": F.when(writes, F.col("c")["source_url"]).otherwise(F.col("source_url")),
        "normalized_source_url": F.when(
            writes, F.col("c")["normalized_source_url"]
        ).otherwise(F.col("normalized_source_url")),
        "title_normalized": texts.title_normalized(F.when(writes, after("title")).otherwise(
            F.col("title"))),
        "content_hash": F.when(writes, new_hash).otherwise(F.col("content_hash")),
        "status": F.when(again, "open").otherwise(F.col("status")),
        "closed_at": F.when(~again, F.col("closed_at")),
        "reopened_count": F.col("reopened_count") + F.when(again, 1).otherwise(0),
        "needs_review": F.col("needs_review") | review,
        "last_seen_at": as_of,
        "missing_count": F.lit(0),
    }
    if "review_reason" in jobs.columns:
        values["review_reason"] = F.when(review, "content changed").otherwise(
            F.col("review_reason")
        )
    if "parser_version" in batch.columns and "parser_version" in jobs.columns:
        values["parser_version"] = F.when(
            writes & (F.col("c.version") != ""), F.col("c.version")
        ).otherwise(F.col("parser_version"))
    updated = assign(merged, hit, values, jobs.columns)
    # only the ids of new jobs are fixed here; their values are read when the jobs are
    started = latest.filter("job_id IS NULL").drop("job_id").withColumn(
        "source_job_id", F.col("_first.sid"))
    named = written(
        _named(started, rows, jobs, above).select("root", "job_id", "company_id"), "named")
    fresh = started.drop("company_id").join(named.drop("company_id"), "root").join(
        rows.drop("root", "job_id", "source_job_id"), "at").withColumn(
        "extraction_confidence", F.col("_first.confidence"))
    created = _created(fresh, jobs, firm, as_of)
    # as many rows as the created jobs have, where a company is listed more than once
    names = named.join(firm.select("company_id"), "company_id", "left").select("root", "job_id")
    outcomes = done.filter("job_id IS NOT NULL").drop("root").unionByName(
        done.filter("job_id IS NULL").drop("job_id").join(names, "root").drop("root")
    ).select("row_id", "company_id", "job_id", "outcome",
             F.coalesce("status", F.lit("")).alias("from_status"))
    events = outcomes.filter(F.col("outcome").isin("created", "reopened")).select(
        "job_id", "from_status", F.lit("open").alias("to_status"),
        F.when(F.col("outcome") == "created", "scrape").otherwise("reopen").alias("trigger"),
        as_of.alias("created_at"),
    )
    return UpsertResult(
        updated.unionByName(created), events, outcomes.drop("from_status")
    )


def _named(rows: DataFrame, postings: DataFrame, jobs: DataFrame, above: int | None) -> DataFrame:
    """New jobs with ``root``, the first posting of each, and their ``job_id``. Text ids are derived
    from the identity of the posting; number ids continue after the highest one."""
    if jobs.schema["job_id"].dataType.simpleString() == "string":
        digest = F.md5(F.concat_ws("|", F.col("company_id").cast("string"), "source_job_id",
                                   "normalized_source_url", "content_hash"))
        return rows.join(
            postings.select("at", "normalized_source_url", "content_hash"), "at"
        ).withColumn("job_id", F.regexp_replace(
            digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    top = F.lit(above) if above is not None else jobs.agg(
        F.coalesce(F.max("job_id"), F.lit(-1))).scalar()
    return with_ordered_index(
        rows.select("company_id", "root"), ["company_id", "root"], "_at"
    ).withColumn("job_id", F.col("_at") + top + 1)


def _created(rows: DataFrame, jobs: DataFrame, firm: DataFrame, as_of: Column) -> DataFrame:
    """New jobs, named already, in the shape of the job table."""
    kinds = {field.name: field.dataType for field in jobs.schema.fields}
    joined = rows.join(firm, "company_id", "left")
    is_ats = F.coalesce("_is_ats", F.lit(False))
    confidence = F.col("extraction_confidence")
    publish = is_ats & (confidence >= PUBLISH_CONFIDENCE)
    changed = (F.col("_changed") == 1) & ~is_ats
    values: dict[str, Column] = {
        "status": F.lit("open"), "missing_count": F.lit(0), "first_seen_at": as_of,
        "last_seen_at": as_of, "reopened_count": F.lit(0), "is_manual_status": F.lit(False),
        "is_deleted": F.lit(False), "extraction_confidence": confidence,
        "is_published": publish, "published_at": F.when(publish, as_of),
        "needs_review": ~publish,
        "review_reason": F.when(publish, "").when(is_ats, "low confidence").when(
            changed, "content changed").otherwise("custom source"),
        "save_count": F.lit(0), "report_count": F.lit(0),
        "manually_edited_fields": F.array().cast("array<string>"),
    }

    def value(name: str) -> Column:
        if name in values:
            column = values[name]
        else:
            column = F.col(name) if name in joined.columns else F.lit(None)
        return column.cast(kinds[name]).alias(name)

    return joined.select(*[value(c) for c in jobs.columns])


def touch_unmodified(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """A fetch without changes counts as a sighting of every open job of the company."""
    seen = runs.filter(F.col("notes") == "not_modified").groupBy("company_id").agg(
        F.max("finished_at").alias("seen_at")
    )
    marked = with_hits(jobs, seen, "company_id", "seen_at")
    applies = F.col(HIT) & (F.col("status") == "open") & ~F.col("is_deleted")
    return assign(
        marked, applies, {"last_seen_at": F.greatest("last_seen_at", "c_seen_at")}, jobs.columns
    )
