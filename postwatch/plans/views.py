"""Canonical tables as plain projections of the generic test tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-11-05 00:00:00"  # just after the last ship date
EVENTS_AS_OF = "2024-01-31 00:00:00"  # just after the last event

SOURCE_TYPES = ("own_career_page", "greenhouse", "lever", "ashby", "smartrecruiters", "unknown")
HEALTH = ("unknown", "healthy", "degraded", "failing", "paused")
DETECTION = ("pending", "needs_review", "verified", "not_found", "failed", "candidates_found")


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_count(df: DataFrame) -> Column:
    """Row count as a scalar subquery, planned with the query that uses it."""
    return df.select(F.count(F.lit(1))).scalar()


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


class Views:
    """Lazy canonical tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def company(self) -> DataFrame:
        k = F.col("c_custkey")
        source = _pick(F.col("c_nationkey") % 6, SOURCE_TYPES)
        is_ats = source.isin("greenhouse", "lever", "ashby", "smartrecruiters")
        return self.table("customer").select(
            k.alias("company_id"),
            F.col("c_name").alias("name"),
            F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("slug"),
            _text("c", k, ".example.org").alias("domain"),
            F.col("c_mktsegment").alias("industry"),
            source.alias("career_source_type"),
            F.when(is_ats, _text("org", k - k % 2)).otherwise("").alias("ats_identifier"),
            (k % 7 != 0).alias("is_verified"),
            (k % 11 != 0).alias("is_active"),
            (k % 53 == 0).alias("is_deleted"),
            F.when(k % 13 == 0, "").otherwise(
                _text("https://c", k, ".example.org/careers")
            ).alias("career_url"),
            _pick(k % 5, HEALTH).alias("scrape_health"),
            _pick(k % 6, DETECTION).alias("detection_status"),
            (F.lit(30) + F.lit(60) * (k % 10)).cast("int").alias("scrape_interval_minutes"),
            F.when(
                k % 17 != 0,
                as_of() + F.make_dt_interval(F.lit(0), (k % 200 - 100).cast("int")),
            ).alias("next_scrape_at"),
            (k % 6).cast("int").alias("consecutive_failures"),
            F.when(k % 10 != 0, k + 3).alias("verified_by"),
            (F.lit("2001-01-01").cast("timestamp_ntz")
             + F.make_dt_interval((k % 365).cast("int"))).alias("created_at"),
        )

    def user(self) -> DataFrame:
        k = F.col("c_custkey")
        email = (
            F.when(k % 100 == 99, _text("U", k - 1, "@Mail.org"))
            .when(k % 4 == 0, _text("u", k, "@example.com"))
            .when(k % 4 == 1, _text("u", k, "@test.invalid"))
            .otherwise(_text("u", k, "@mail.org"))
        )
        return self.table("customer").select(
            k.alias("user_id"),
            email.alias("email"),
            (k % 8 != 0).alias("is_active"),
            F.when(k % 9 == 0, _text("0", k)).otherwise(
                _text("+9170000", F.lpad(k.cast("string"), 6, "0"))
            ).alias("phone"),
            F.date_add(F.lit("1965-01-01").cast("date"), (k * 37 % 14000).cast("int")).alias(
                "date_of_birth"
            ),
            _pick(k % 4, ("GENERAL", "OBC", "SC", "ST")).alias("category"),
            (k % 10 == 0).alias("is_pwbd"),
            (k % 6 == 0).alias("is_ex_serviceman"),
            (k % 12).cast("int").alias("service_years"),
            (k % 3 == 0).alias("is_final_year"),
            (k % 30 - 1).cast("int").alias("experience_years"),
        )

    def job(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        parts = _row_count(part)
        k = F.col("o_orderkey")
        rank = F.substring("o_orderpriority", 1, 1).cast("int")
        status = _pick(
            k % 10,
            ("possibly_closed", "likely_closed", "closed", "draft") + ("open",) * 6,
        )
        price = F.col("o_totalprice").cast("decimal(12,2)")
        return (
            self.table("orders")
            .join(part, F.col("p_partkey") == F.pmod(k, parts))
            .select(
                k.alias("job_id"),
                F.col("o_custkey").alias("company_id"),
                F.concat_ws(
                    " ", "p_name", F.substring_index("o_orderpriority", "-", -1)
                ).alias("title"),
                F.concat_ws(
                    "-", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), k.cast("string")
                ).alias("slug"),
                F.when(k % 9 == 0, "").otherwise(F.col("p_type")).alias("department"),
                F.col("p_brand").alias("location_raw"),
                _pick(rank - 1, ("remote", "hybrid", "onsite", "unknown", "")).alias("work_mode"),
                F.when(F.col("o_orderstatus") == "O", "full_time")
                .when(F.col("o_orderstatus") == "P", "contract")
                .otherwise("internship").alias("job_type"),
                F.when(k % 19 != 0, F.col("o_orderdate")).alias("posted_at"),
                F.col("o_orderdate").alias("first_seen_at"),
                (F.col("o_orderdate") + F.make_dt_interval((k % 60).cast("int"))).alias(
                    "last_seen_at"
                ),
                status.alias("status"),
                F.when(k % 10 < 3, (k % 10 + 1).cast("int")).otherwise(0).alias("missing_count"),
                F.when(
                    (k % 10 == 2) & (k % 3 != 0), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
                ).alias("closed_at"),
                (k % 7 != 0).alias("is_published"),
                (k % 97 == 0).alias("is_deleted"),
                (k % 23 == 0).alias("is_manual_status"),
                (k % 29 == 0).alias("needs_review"),
                F.when(k % 3 == 0, "").otherwise(
                    _text("https://apply.example.org/", k)
                ).alias("apply_url"),
                F.when(k % 5 == 0, "").otherwise(_text("J", k)).alias("source_job_id"),
                _text("https://c", F.col("o_custkey"), ".example.org/jobs/", k).alias(
                    "source_url"
                ),
                price.alias("salary_min"),
                F.when(k % 4 != 0, (price * F.lit(2) - F.lit(60000)).cast("decimal(12,2)")).alias(
                    "salary_max"
                ),
                (k % 103).cast("int").alias("extraction_confidence"),
                (k % 4).cast("int").alias("reopened_count"),
                F.when((k % 41 == 0) & (k > 0), k - F.lit(1) - k % 5).alias("duplicate_of"),
            )
        )

    def sighting(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("job_id"),
            F.col("l_shipdate").alias("seen_at"),
            F.col("l_linenumber").alias("pos"),
            F.col("l_suppkey").alias("feed_id"),
        )

    def run(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("run_id"),
            F.col("user_id").alias("company_id"),
            F.col("ts").alias("finished_at"),
            F.when(kind == "error", "failed").when(kind == "signup", "partial")
            .otherwise("success").alias("status"),
            F.floor(F.col("value") / 10).cast("int").alias("jobs_found"),
            (F.col("event_id") % 4).cast("int").alias("jobs_added"),
            (F.col("event_id") % 3).cast("int").alias("jobs_missing"),
            F.when(kind == "error", "untrusted").when(kind == "signup", "quarantined")
            .otherwise("trusted").alias("verdict"),
            F.when(kind == "view", "not_modified").otherwise("").alias("notes"),
        )

    def body(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("body_id"),
            F.col("s_name").alias("body_name"),
            F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))).alias("body_slug"),
        )

    def exam(self) -> DataFrame:
        bodies = _row_count(self.table("supplier"))
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("exam_id"),
            F.concat_ws("-", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
                        k.cast("string")).alias("exam_slug"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("short_name"),
            F.col("p_type").alias("category"),
            F.when(F.col("p_size") % 2 == 0, "national").otherwise("state").alias("level"),
            F.pmod(k, bodies).alias("body_id"),
            F.when(k % 4 == 0, "").otherwise(_text("https://exam", k, ".example.org")).alias(
                "official_url"
            ),
            (k % 17 != 0).alias("is_active"),
        )

    def cycle(self) -> DataFrame:
        exams = _row_count(self.table("part"))
        k = F.col("o_orderkey")
        day = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            k.alias("cycle_id"),
            F.pmod(F.col("o_custkey"), exams).alias("exam_id"),
            F.year("o_orderdate").alias("cycle_year"),
            (k % 4).cast("string").alias("cycle_label"),
            F.when(F.col("o_orderstatus") == "O", "applications_open")
            .when(F.col("o_orderstatus") == "P", "announced")
            .otherwise("result_out").alias("status"),
            F.date_add(day, -30).alias("notification_date"),
            day.alias("application_start"),
            F.date_add(day, 30).alias("application_end"),
            F.when(k % 5 != 0, F.date_add(day, 32)).alias("fee_last_date"),
            F.when(k % 6 == 0, F.date_add(day, 40)).alias("correction_window_start"),
            F.when(k % 6 == 0, F.date_add(day, 45)).alias("correction_window_end"),
            F.date_add(day, 120).alias("result_date"),
            (k % 3 != 0).alias("is_published"),
            (k % 8 != 0).alias("verified_by_human"),
            (k % 103).cast("int").alias("extraction_confidence"),
            F.when(k % 2 == 0, "").otherwise(_text("https://notice.example.org/", k)).alias(
                "official_notification_url"
            ),
            (F.col("o_orderdate") + F.make_dt_interval((k % 50).cast("int"))).alias("created_at"),
        )

    def stage(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        n = F.col("l_linenumber")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("cycle_id"),
            n.alias("stage_order"),
            _text("Stage ", n).alias("stage_name"),
            day.alias("date_start"),
            F.when(n % 2 == 0, F.date_add(day, -10)).alias("admit_card_date"),
            F.when(n % 3 == 0, F.date_add(day, 30)).alias("result_date"),
            (F.col("l_returnflag") == "R").alias("is_date_tentative"),
        )

    def saved(self) -> DataFrame:
        return (
            self.table("events").filter(F.col("event_type") == "click")
            .select("user_id", F.col("event_id").alias("job_id"), F.col("ts").alias("saved_at"))
        )

    def report(self) -> DataFrame:
        reasons = ("expired", "broken_link", "wrong_details", "duplicate", "spam", "other")
        return (
            self.table("events").filter(F.col("event_type") == "error")
            .select(
                F.col("event_id").alias("report_id"),
                "user_id",
                (F.col("event_id") % 500).alias("job_id"),
                _pick(F.col("event_id") % 6, reasons).alias("reason"),
                F.lit("open").alias("status"),
                F.col("ts").alias("created_at"),
            )
        )

    def status_event(self) -> DataFrame:
        """Status changes per job, one per sighting row."""
        steps = ("open", "possibly_closed", "likely_closed", "closed")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("job_id"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_linenumber").alias("seq"),
            F.col("l_partkey").alias("part_key"),
            F.col("l_suppkey").alias("run_id"),
            _pick(F.col("l_linenumber") % 4, steps).alias("to_status"),
        )

    def eligibility(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("exam_id"),
            F.when(k % 11 != 0, F.lit(18) + k % 3).cast("int").alias("min_age"),
            F.when(k % 7 != 0, F.lit(27) + k % 6).cast("int").alias("max_age"),
            F.create_map(
                F.lit("SC/ST"), F.lit(5), F.lit("OBC"), F.lit(3), F.lit("PwBD_General"),
                F.lit(10), F.lit("PwBD_OBC"), F.lit(13), F.lit("PwBD_SC/ST"), F.lit(15),
                F.lit("Ex-servicemen"), F.lit(8),
            ).alias("age_relaxation"),
            (k % 5 == 0).alias("allow_final_year"),
        )


def _sql_case(column: str, values: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {column} {arms} END"


# The same tables in the SQL dialect of the checking engine.
VIEW_SQL = {
    "v_company": f"""
SELECT c_custkey AS company_id, c_name AS name, lower(replace(c_name, '#', '-')) AS slug,
  'c' || c_custkey || '.example.org' AS domain, c_mktsegment AS industry,
  {_sql_case('c_nationkey % 6', SOURCE_TYPES)} AS career_source_type,
  CASE WHEN c_nationkey % 6 BETWEEN 1 AND 4 THEN 'org' || (c_custkey - c_custkey % 2)
    ELSE '' END AS ats_identifier,
  c_custkey % 7 <> 0 AS is_verified, c_custkey % 11 <> 0 AS is_active,
  c_custkey % 53 = 0 AS is_deleted,
  CASE WHEN c_custkey % 13 = 0 THEN ''
    ELSE 'https://c' || c_custkey || '.example.org/careers' END AS career_url,
  {_sql_case('c_custkey % 5', HEALTH)} AS scrape_health,
  {_sql_case('c_custkey % 6', DETECTION)} AS detection_status,
  CAST(30 + 60 * (c_custkey % 10) AS INTEGER) AS scrape_interval_minutes,
  CASE WHEN c_custkey % 17 = 0 THEN NULL
    ELSE TIMESTAMP '{AS_OF}' + to_hours(CAST(c_custkey % 200 - 100 AS INTEGER)) END
    AS next_scrape_at,
  CAST(c_custkey % 6 AS INTEGER) AS consecutive_failures,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey + 3 END AS verified_by,
  TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
FROM customer""",
    "v_user": """
SELECT c_custkey AS user_id,
  CASE WHEN c_custkey % 100 = 99 THEN 'U' || (c_custkey - 1) || '@Mail.org'
    WHEN c_custkey % 4 = 0 THEN 'u' || c_custkey || '@example.com'
    WHEN c_custkey % 4 = 1 THEN 'u' || c_custkey || '@test.invalid'
    ELSE 'u' || c_custkey || '@mail.org' END AS email,
  c_custkey % 8 <> 0 AS is_active,
  CASE WHEN c_custkey % 9 = 0 THEN '0' || c_custkey
    ELSE '+9170000' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS phone,
  DATE '1965-01-01' + CAST(c_custkey * 37 % 14000 AS INTEGER) AS date_of_birth,
  CASE c_custkey % 4 WHEN 0 THEN 'GENERAL' WHEN 1 THEN 'OBC' WHEN 2 THEN 'SC' ELSE 'ST' END
    AS category,
  c_custkey % 10 = 0 AS is_pwbd, c_custkey % 6 = 0 AS is_ex_serviceman,
  CAST(c_custkey % 12 AS INTEGER) AS service_years, c_custkey % 3 = 0 AS is_final_year,
  CAST(c_custkey % 30 - 1 AS INTEGER) AS experience_years
FROM customer""",
    "v_job": """
SELECT o_orderkey AS job_id, o_custkey AS company_id,
  p_name || ' ' || split_part(o_orderpriority, '-', 2) AS title,
  replace(p_name, ' ', '-') || '-' || o_orderkey AS slug,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE p_type END AS department,
  p_brand AS location_raw,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'remote' WHEN '2' THEN 'hybrid'
    WHEN '3' THEN 'onsite' WHEN '4' THEN 'unknown' ELSE '' END AS work_mode,
  CASE o_orderstatus WHEN 'O' THEN 'full_time' WHEN 'P' THEN 'contract' ELSE 'internship' END
    AS job_type,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS posted_at,
  o_orderdate AS first_seen_at,
  o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS last_seen_at,
  CASE o_orderkey % 10 WHEN 0 THEN 'possibly_closed' WHEN 1 THEN 'likely_closed'
    WHEN 2 THEN 'closed' WHEN 3 THEN 'draft' ELSE 'open' END AS status,
  CAST(CASE WHEN o_orderkey % 10 < 3 THEN o_orderkey % 10 + 1 ELSE 0 END AS INTEGER)
    AS missing_count,
  CASE WHEN o_orderkey % 10 = 2 AND o_orderkey % 3 <> 0 THEN o_orderdate + to_days(30) END
    AS closed_at,
  o_orderkey % 7 <> 0 AS is_published, o_orderkey % 97 = 0 AS is_deleted,
  o_orderkey % 23 = 0 AS is_manual_status, o_orderkey % 29 = 0 AS needs_review,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'https://apply.example.org/' || o_orderkey END
    AS apply_url,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'J' || o_orderkey END AS source_job_id,
  'https://c' || o_custkey || '.example.org/jobs/' || o_orderkey AS source_url,
  CAST(o_totalprice AS DECIMAL(12,2)) AS salary_min,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL
    ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 2 - 60000 AS DECIMAL(12,2)) END AS salary_max,
  CAST(o_orderkey % 103 AS INTEGER) AS extraction_confidence,
  CAST(o_orderkey % 4 AS INTEGER) AS reopened_count,
  CASE WHEN o_orderkey % 41 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 - o_orderkey % 5 END
    AS duplicate_of
FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "v_sighting": """
SELECT l_orderkey AS job_id, l_shipdate AS seen_at, l_linenumber AS pos, l_suppkey AS feed_id
FROM lineitem""",
    "v_run": """
SELECT event_id AS run_id, user_id AS company_id, ts AS finished_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END
    AS status,
  CAST(floor(value / 10) AS INTEGER) AS jobs_found,
  CAST(event_id % 4 AS INTEGER) AS jobs_added, CAST(event_id % 3 AS INTEGER) AS jobs_missing,
  CASE event_type WHEN 'error' THEN 'untrusted' WHEN 'signup' THEN 'quarantined'
    ELSE 'trusted' END AS verdict,
  CASE event_type WHEN 'view' THEN 'not_modified' ELSE '' END AS notes
FROM events""",
    "v_body": """
SELECT s_suppkey AS body_id, s_name AS body_name,
  lower(replace(s_name, '#', '-')) AS body_slug
FROM supplier""",
    "v_exam": """
SELECT p_partkey AS exam_id, replace(p_name, ' ', '-') || '-' || p_partkey AS exam_slug,
  p_name AS name, p_brand AS short_name, p_type AS category,
  CASE WHEN p_size % 2 = 0 THEN 'national' ELSE 'state' END AS level,
  p_partkey % (SELECT count(*) FROM supplier) AS body_id,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://exam' || p_partkey || '.example.org' END
    AS official_url,
  p_partkey % 17 <> 0 AS is_active
FROM part""",
    "v_cycle": """
SELECT o_orderkey AS cycle_id, o_custkey % (SELECT count(*) FROM part) AS exam_id,
  CAST(year(o_orderdate) AS INTEGER) AS cycle_year,
  CAST(o_orderkey % 4 AS VARCHAR) AS cycle_label,
  CASE o_orderstatus WHEN 'O' THEN 'applications_open' WHEN 'P' THEN 'announced'
    ELSE 'result_out' END AS status,
  CAST(o_orderdate AS DATE) - 30 AS notification_date,
  CAST(o_orderdate AS DATE) AS application_start,
  CAST(o_orderdate AS DATE) + 30 AS application_end,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 32 END AS fee_last_date,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 40 END AS correction_window_start,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 45 END AS correction_window_end,
  CAST(o_orderdate AS DATE) + 120 AS result_date,
  o_orderkey % 3 <> 0 AS is_published, o_orderkey % 8 <> 0 AS verified_by_human,
  CAST(o_orderkey % 103 AS INTEGER) AS extraction_confidence,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'https://notice.example.org/' || o_orderkey END
    AS official_notification_url,
  o_orderdate + to_days(CAST(o_orderkey % 50 AS INTEGER)) AS created_at
FROM orders""",
    "v_stage": """
SELECT l_orderkey AS cycle_id, l_linenumber AS stage_order,
  'Stage ' || l_linenumber AS stage_name, CAST(l_shipdate AS DATE) AS date_start,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) - 10 END AS admit_card_date,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) + 30 END AS result_date,
  l_returnflag = 'R' AS is_date_tentative
FROM lineitem""",
    "v_saved": """
SELECT user_id, event_id AS job_id, ts AS saved_at FROM events WHERE event_type = 'click'""",
    "v_report": """
SELECT event_id AS report_id, user_id, event_id % 500 AS job_id,
  CASE event_id % 6 WHEN 0 THEN 'expired' WHEN 1 THEN 'broken_link' WHEN 2 THEN 'wrong_details'
    WHEN 3 THEN 'duplicate' WHEN 4 THEN 'spam' ELSE 'other' END AS reason,
  'open' AS status, ts AS created_at
FROM events WHERE event_type = 'error'""",
    "v_status_event": """
SELECT l_orderkey AS job_id, l_shipdate AS created_at, l_linenumber AS seq,
  l_partkey AS part_key, l_suppkey AS run_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'possibly_closed'
    WHEN 2 THEN 'likely_closed' ELSE 'closed' END AS to_status
FROM lineitem""",
    "v_eligibility": """
SELECT p_partkey AS exam_id,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 18 + p_partkey % 3 END AS INTEGER) AS min_age,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 27 + p_partkey % 6 END AS INTEGER) AS max_age,
  p_partkey % 5 = 0 AS allow_final_year
FROM part""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the canonical tables it names."""
    needed = [name for name in VIEW_SQL if name in sql]
    if not needed:
        return sql
    # a table that is read more than once is made once
    kept = {name: " MATERIALIZED" if sql.count(name) > 1 else "" for name in needed}
    tables = ",\n".join(f"{name} AS{kept[name]} ({VIEW_SQL[name]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {tables},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {tables},\n{body[len('WITH'):]}"
    return f"WITH {tables}\n{body}"
