"""Batches of editorial actions on jobs: publish, close, reopen, edit, review, report, save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..schemas import DOMAINS
from .aggregates import reports_to_review
from .joins import resolve_duplicates
from .merge import HIT, assign, with_hits
from .postings import UPDATABLE


def _keys(df: DataFrame, key: str = "job_id") -> DataFrame:
    return df.select(key).distinct()


def _stored(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in df.columns else otherwise


def _no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def set_published(jobs: DataFrame, keys: DataFrame, flag: bool, as_of: Column) -> DataFrame:
    """Publish or unpublish; the first publishing time is kept."""
    marked = with_hits(jobs, _keys(keys), "job_id")
    changes = F.col(HIT) & (F.col("is_published") != F.lit(flag))
    values = {"is_published": F.lit(flag), "updated_at": as_of}
    if flag:
        values["published_at"] = F.coalesce(_stored(jobs, "published_at", _no_time()), as_of)
    return assign(marked, changes, values, jobs.columns)


def _event(rows: DataFrame, to_status: str, trigger: str, note: Column, as_of: Column):
    return rows.select(
        "job_id", F.col("status").alias("from_status"), F.lit(to_status).alias("to_status"),
        F.lit(trigger).alias("trigger"), note.alias("note"), as_of.alias("created_at"),
    )


def close_jobs(
    jobs: DataFrame, keys: DataFrame, as_of: Column, note: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Close by hand; jobs already closed stay as they are."""
    marked = with_hits(jobs, _keys(keys), "job_id")
    closes = F.col(HIT) & (F.col("status") != "closed")
    state = assign(
        marked, closes,
        {"status": F.lit("closed"), "closed_at": as_of, "is_manual_status": F.lit(True)},
        jobs.columns,
    )
    return state, _event(marked.filter(closes), "closed", "admin", F.lit(note), as_of)


def reopen_jobs(
    jobs: DataFrame, keys: DataFrame, as_of: Column, note: str = ""
) -> tuple[DataFrame, DataFrame]:
    marked = with_hits(jobs, _keys(keys), "job_id")
    hit = F.col(HIT)
    state = assign(
        marked, hit,
        {
            "status": F.lit("open"), "closed_at": _no_time(), "is_manual_status": F.lit(False),
            "missing_count": F.lit(0), "reopened_count": F.col("reopened_count") + 1,
        },
        jobs.columns,
    )
    return state, _event(marked.filter(hit), "open", "reopen", F.lit(note), as_of)


def mark_duplicates(jobs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link jobs to their canonical job and unpublish them. Pairs that point to themselves or
    would close a circle with stored links or with each other are returned as rejected."""
    selfish = pairs.filter(F.col("job_id") == F.col("canonical_id"))
    rest = pairs.filter(F.col("job_id") != F.col("canonical_id")).select(
        "job_id", F.col("canonical_id").alias("duplicate_of")
    )
    stored = jobs.filter(F.col("duplicate_of").isNotNull()).select("job_id", "duplicate_of").join(
        rest.select("job_id"), "job_id", "left_anti"
    )
    circles = resolve_duplicates(rest.unionByName(stored)).filter("in_circle").select("job_id")
    accepted = rest.join(circles, "job_id", "left_anti")
    marked = with_hits(jobs, accepted, "job_id", "duplicate_of")
    state = assign(
        marked, F.col(HIT),
        {"duplicate_of": F.col("c_duplicate_of"), "is_published": F.lit(False)}, jobs.columns,
    )
    rejected = selfish.select(
        "job_id", "canonical_id", F.lit("a job cannot duplicate itself").alias("reason")
    ).unionByName(
        rest.join(circles, "job_id", "left_semi").select(
            "job_id", F.col("duplicate_of").alias("canonical_id"),
            F.lit("circle of duplicates").alias("reason"),
        )
    )
    return state, rejected


def apply_edits(
    jobs: DataFrame, edits: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Edits as rows ``(job_id, field, value)`` (``seq`` orders repeated edits of one field).
    Only editable fields are accepted; edited fields are remembered and protected from feeds."""
    fields = [f for f in UPDATABLE if f in jobs.columns]
    rejected = edits.filter(~F.col("field").isin(*fields)).withColumn(
        "reason", F.lit("unknown field")
    )
    ordered = edits if "seq" in edits.columns else edits.withColumn("seq", F.lit(0))
    # all fields of a request stand or fall together, as with a single edit call
    good = ordered.join(rejected.select("job_id"), "job_id", "left_anti")
    wide = good.groupBy("job_id").agg(
        *[F.max_by(F.struct("value"), F.when(F.col("field") == f, F.col("seq"))).alias(f"e_{f}")
          for f in fields],
        F.array_sort(F.collect_set("field")).alias("e_fields"),  # at most the editable fields
    )
    marked = with_hits(jobs, wide, "job_id", *[c for c in wide.columns if c != "job_id"])
    kinds = {f.name: f.dataType for f in jobs.schema.fields}

    def edited(name: str) -> Column:
        entry = F.col(f"c_e_{name}")
        return F.when(entry.isNotNull(), entry["value"].try_cast(kinds[name])).otherwise(
            F.col(name)
        )

    values = {f: edited(f) for f in fields}
    title = edited("title")
    place = edited("location_raw") if "location_raw" in fields else F.lit("")
    body = edited("description") if "description" in fields else F.lit("")
    earlier = _stored(jobs, "manually_edited_fields", F.array().cast("array<string>"))
    values |= {
        "manually_edited_fields": F.array_sort(F.array_union(earlier, F.col("c_e_fields"))),
        "title_normalized": texts.title_normalized(title),
        "content_hash": texts.content_hash(title, place, body),
        "needs_review": F.lit(False), "review_reason": F.lit(""), "reviewed_at": as_of,
    }
    return assign(marked, F.col(HIT), values, jobs.columns), rejected


def decide_reviews(jobs: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """``decisions``: job_id, approve, reason. Approval publishes, refusal notes the reason."""
    marked = with_hits(jobs, decisions, "job_id", "approve", "reason")
    approve = F.col("c_approve")
    publishes = approve & ~F.col("is_published")
    values = {
        "needs_review": F.lit(False),
        "review_reason": F.when(approve, "").otherwise(F.col("c_reason")),
        "reviewed_at": as_of,
        "is_published": F.col("is_published") | approve,
        "published_at": F.when(publishes, as_of).otherwise(
            _stored(jobs, "published_at", _no_time())),
    }
    return assign(marked, F.col(HIT), values, jobs.columns)


def submit_reports(
    reports: DataFrame, new: DataFrame, jobs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accept reports with a known reason, one open report per job and user; the earliest row of
    a batch wins. Returns reports, jobs with counters and review flags, and rejected rows."""
    valid = F.col("reason").isin(*DOMAINS["report.reason"])
    bad = new.filter(~valid).withColumn("reject_reason", F.lit("unknown reason"))
    pair = ["job_id", "user_id"]
    firsts = new.filter(valid).groupBy(*pair).agg(F.min("report_id").alias("_first"))
    standing = reports.filter(F.col("status") == "open").select(*pair).distinct().withColumn(
        "_open", F.lit(True)
    )
    judged = new.filter(valid).join(firsts, pair).join(standing, pair, "left")
    accepts = F.col("_open").isNull() & (F.col("report_id") == F.col("_first"))
    accepted = judged.filter(accepts).select(*new.columns)
    refused = judged.filter(~accepts).select(*new.columns).withColumn(
        "reject_reason", F.lit("an open report exists")
    )
    everything = reports.unionByName(accepted.select(*reports.columns))
    added = accepted.groupBy("job_id").agg(F.count(F.lit(1)).alias("added"))
    marked = with_hits(jobs, added, "job_id", "added")
    counted = assign(
        marked, F.col(HIT),
        {"report_count": _stored(jobs, "report_count", F.lit(0)) + F.col("c_added")},
        jobs.columns,
    )
    flagged = reports_to_review(counted, everything).join(added, "job_id", "left_semi").select(
        "job_id")
    hot = with_hits(counted, flagged, "job_id")
    state = assign(
        hot, F.col(HIT), {"needs_review": F.lit(True), "review_reason": F.lit("user reports")},
        jobs.columns,
    )
    return everything, state, bad.unionByName(refused)


def resolve_reports(
    reports: DataFrame, decisions: DataFrame, jobs: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``decisions``: report_id, accept. Accepted reports of an expired job close it."""
    marked = with_hits(reports, decisions, "report_id", "accept")
    state = assign(
        marked, F.col(HIT),
        {
            "status": F.when(F.col("c_accept"), "resolved").otherwise("rejected"),
            "resolved_at": as_of,
        },
        reports.columns,
    )
    expired = marked.filter(
        F.col(HIT) & F.col("c_accept") & (F.col("reason") == "expired")
    ).select("job_id")
    closed, events = close_jobs(jobs, expired, as_of, "report accepted")
    return state, closed, events


def apply_saves(saved: DataFrame, actions: DataFrame, item: str = "job_id") -> DataFrame:
    """Saved items after a batch of save/unsave actions ``(user_id, item, action, seq, at)``.

    The last action of a user on an item decides. Saving twice keeps the first time; saving again
    after an unsave starts anew.
    """
    pair = ["user_id", item]
    undo = actions.groupBy(*pair).agg(
        F.max(F.when(F.col("action") == "unsave", F.col("seq"))).alias("_undo")
    )
    after = actions.join(undo, pair).filter(
        (F.col("action") == "save") & (F.col("_undo").isNull() | (F.col("seq") > F.col("_undo")))
    ).groupBy(*pair).agg(F.min_by("at", "seq").alias("_at"))
    summary = undo.join(after, pair, "left")
    both = saved.join(summary.withColumn("_hit", F.lit(True)), pair, "full_outer")
    fresh = F.col("_undo").isNotNull()
    time = F.when(fresh, F.col("_at")).otherwise(F.coalesce("saved_at", "_at"))
    return both.filter(F.col("_hit").isNull() | ~fresh | F.col("_at").isNotNull()).select(
        *pair, F.when(F.col("_hit").isNull(), F.col("saved_at")).otherwise(time).alias("saved_at")
    )
