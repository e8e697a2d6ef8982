"""Joins between the canonical tables. Spark picks broadcast or shuffle from measured sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .filters import alive
from .ordered import first_per_key


def with_company(jobs: DataFrame, companies: DataFrame, *columns: str) -> DataFrame:
    """Jobs with name and slug of their company (inner)."""
    wanted = companies.select(
        "company_id", F.col("name").alias("company_name"), F.col("slug").alias("company_slug"),
        *columns,
    )
    return jobs.join(wanted, "company_id")


def with_body(exams: DataFrame, bodies: DataFrame) -> DataFrame:
    return exams.join(bodies.select("body_id", "body_name", "body_slug"), "body_id")


def with_verifier(companies: DataFrame, users: DataFrame) -> DataFrame:
    person = users.select(
        F.col("user_id").alias("verified_by"), F.col("email").alias("verifier_email"),
        F.col("is_active").alias("verifier_active"),
    )
    return companies.join(person, "verified_by", "left")


def with_is_saved(jobs: DataFrame, saved: DataFrame, user_id: int | None) -> DataFrame:
    """Flag of the jobs a user saved; false for visitors."""
    if user_id is None:
        return jobs.withColumn("is_saved", F.lit(False))
    mine = saved.filter(F.col("user_id") == user_id).select("job_id").distinct()
    flagged = jobs.join(mine.withColumn("_hit", F.lit(True)), "job_id", "left")
    return flagged.withColumn("is_saved", F.coalesce("_hit", F.lit(False))).drop("_hit")


def seen_in_run(jobs: DataFrame, events: DataFrame, run_id: int) -> DataFrame:
    touched = events.filter(F.col("run_id") == run_id).select("job_id")
    return jobs.join(touched, "job_id", "left_semi")


def unseen_jobs(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Jobs a company listing no longer shows."""
    return jobs.join(seen.select("job_id"), "job_id", "left_anti")


def latest_cycle(cycles: DataFrame, tie: str = "cycle_label") -> DataFrame:
    """Newest published cycle per exam by year, then ``cycle_label`` or ``created_at``."""
    published = cycles.filter("is_published").select("exam_id", "cycle_id", "cycle_year", tie,
                                                     "status")
    return first_per_key(published, ["exam_id"], ["cycle_year", tie, "cycle_id"], newest=True)


def exams_with_latest_status(exams: DataFrame, cycles: DataFrame, status: str) -> DataFrame:
    newest = latest_cycle(cycles).filter(F.col("status") == status).select("exam_id")
    return exams.join(newest, "exam_id", "left_semi")


def exam_documents(
    exams: DataFrame, cycles: DataFrame, stages: DataFrame, eligibility: DataFrame
) -> DataFrame:
    """Exam details as one ordered row per node (exam, cycle, stage, eligibility).

    A reader of one exam gets the nested document by its ``ord`` column; no exam is ever gathered
    into a single row, so an exam with very many cycles stays spread over tasks.
    """
    blank = F.lit(None).cast("long")

    def nodes(df: DataFrame, kind: str, cycle: Column, order: Column, *fields: str) -> DataFrame:
        return df.select(
            "exam_id", F.lit(kind).alias("node"), cycle.cast("long").alias("cycle_id"),
            order.cast("long").alias("ord"), F.to_json(F.struct(*fields)).alias("body"),
        )

    placed = stages.join(cycles.select("cycle_id", "exam_id"), "cycle_id")
    return (
        nodes(exams, "exam", blank, F.lit(0), "name", "short_name", "category", "level")
        .unionByName(nodes(cycles, "cycle", F.col("cycle_id"), F.lit(1), "cycle_year",
                           "cycle_label", "status"))
        .unionByName(nodes(placed, "stage", F.col("cycle_id"), F.col("stage_order") + 1,
                           "stage_order", "stage_name", "date_start"))
        .unionByName(nodes(eligibility, "eligibility", blank, F.lit(0), "allow_final_year"))
    )


def saved_jobs(
    saved: DataFrame, jobs: DataFrame, companies: DataFrame, user_id: int | None = None
) -> DataFrame:
    """Saved jobs with job and company, newest first within a user."""
    mine = saved if user_id is None else saved.filter(F.col("user_id") == user_id)
    return mine.join(with_company(jobs, companies), "job_id")


def saved_exams(exams: DataFrame, saved: DataFrame, user_id: int) -> DataFrame:
    mine = saved.filter(F.col("user_id") == user_id).select("exam_id")
    return exams.filter("is_active").join(mine, "exam_id", "left_semi")


def find_duplicate_companies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing company each incoming row collides with: by board identity, else domain, else
    career URL. The three keys go through one join as (rule, key) pairs."""
    def keys(df: DataFrame, key: str) -> DataFrame:
        board = F.when(
            F.col("ats_identifier") != "", F.concat_ws("|", "career_source_type", "ats_identifier")
        )
        pairs = F.array(
            *[F.struct(F.lit(rule).alias("rule"), F.when(value != "", value).alias("value"))
              for rule, value in enumerate((board, F.col("domain"), F.col("career_url")), 1)]
        )
        return df.select(key, F.explode(pairs).alias("_pair")).select(
            key, "_pair.rule", "_pair.value"
        ).filter(F.col("value").isNotNull())

    owners = keys(alive(existing), "company_id").groupBy("rule", "value").agg(
        F.min("company_id").alias("match_id")
    )
    hits = keys(incoming, "incoming_id").join(owners, ["rule", "value"])
    best = hits.groupBy("incoming_id").agg(
        F.min(F.struct("rule", "match_id")).alias("_best")
    )
    return incoming.join(best, "incoming_id", "left").withColumn(
        "match_rule", F.col("_best.rule")
    ).withColumn("match_id", F.col("_best.match_id")).drop("_best")


def resolve_duplicates(edges: DataFrame) -> DataFrame:
    """Final target of every ``(job_id, duplicate_of)`` chain, and whether it runs in a circle.

    Pointer jumping over the unfinished rows alone: each round doubles the links a pointer covers,
    and rows that reach an end or a finished row leave the state. A row also carries the smallest
    id it has passed. One that passes itself is the smallest of a circle; it and all rows that have
    passed it are finished without a target. Each round writes finished and unfinished rows apart,
    and counts them while it writes.
    """
    spark, kind = edges.sparkSession, edges.schema["job_id"].dataType
    none = F.lit(None).cast(kind)
    chains = _Chains(spark, kind.simpleString())
    chains.write(edges.filter(F.col("duplicate_of").isNotNull()).select(
        "job_id", F.col("duplicate_of").alias("at"), F.col("duplicate_of").alias("low"),
        none.alias("root"), F.lit(False).alias("circle")))
    while chains.left:
        waiting, passed = chains.waiting(), F.least("low", "next_low")
        known = waiting.select(
            F.col("job_id").alias("at"), F.col("at").alias("next"), F.col("low").alias("next_low"),
            none.alias("end"), F.lit(False).alias("lost")
        ).unionByName(chains.finished().select(
            F.col("job_id").alias("at"), none.alias("next"), none.alias("next_low"),
            F.col("root").alias("end"), F.col("circle").alias("lost")))
        round_trip = F.coalesce(passed == F.col("job_id"), F.lit(False))
        step = waiting.join(known, "at", "left").select(
            "job_id", F.coalesce("next", "at").alias("at"), passed.alias("low"),
            F.when(round_trip, F.col("job_id")).when(
                F.col("next").isNull(), F.coalesce("end", "at")).alias("root"),
            (round_trip | F.coalesce("lost", F.lit(False))).alias("circle"))
        if chains.write(step) and chains.left:  # circles were found: free what has passed them
            heads = chains.heads().select(F.col("job_id").alias("low"), F.col("job_id").alias("root"))
            chains.write(chains.waiting().drop("root").join(heads, "low", "left").select(
                "job_id", "at", "low", "root", F.col("root").isNotNull().alias("circle")))
    return chains.finished().select(
        "job_id", F.when(~F.col("circle"), F.col("root")).alias("root"),
        F.col("circle").alias("in_circle"))


class _Chains:
    """The rows of ``resolve_duplicates`` in the shared folder, by round, finished ones apart."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.left, self._open, self._done = spark, 0, "", []
        self.schema = f"job_id {kind}, at {kind}, low {kind}, root {kind}, circle boolean"

    def write(self, step: DataFrame) -> int:
        """Add a round; the number of circles whose smallest row it has found."""
        path, seen = new_folder(self.spark, "duplicates"), Observation()
        closed = F.col("root").isNotNull()
        head = closed & F.col("circle") & (F.col("root") == F.col("job_id"))
        step.observe(
            seen, F.count_if(~closed).alias("open"), F.count_if(closed).alias("closed"),
            F.count_if(head).alias("heads"),
        ).withColumn("closed", closed.cast("int")).write.partitionBy("closed").parquet(path)
        self.left, self._open = seen.get["open"], f"{path}/closed=0"
        if seen.get["closed"]:
            self._done.append(f"{path}/closed=1")
        return seen.get["heads"]

    def _read(self, *paths: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def waiting(self) -> DataFrame:
        return self._read(self._open)

    def finished(self) -> DataFrame:
        return self._read(*self._done)

    def heads(self) -> DataFrame:
        """Smallest rows of the circles found in the last round."""
        return self._read(self._done[-1]).filter("circle AND root = job_id")
