"""State machines against worked cases and brute force."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from postwatch.operators import discovery, history, joins, ordered, outcomes, reviews, strikes
from postwatch.operators.postings import upsert_postings, with_identity
from postwatch.sources.versions import VersionStore

JOBS = (
    "job_id long, company_id long, source_job_id string, source_url string, title string, "
    "location_raw string, description string, status string, missing_count int, "
    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, closed_at timestamp_ntz, "
    "reopened_count int, is_published boolean, needs_review boolean, review_reason string, "
    "is_manual_status boolean, is_deleted boolean, manually_edited_fields array<string>"
)
PAST = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-05-01").cast("timestamp_ntz")


BATCH = ("row_id long, company_id long, source_job_id string, source_url string, title string, "
         "location_raw string, description string, extraction_confidence int")


def stored(spark, *changes):
    rows = []
    for i, change in enumerate(changes, 1):
        row = dict(
            job_id=i, company_id=1, source_job_id=f"S{i}", source_url=f"https://a.com/{i}",
            title=f"T{i}", location_raw="L", description="D", status="open", missing_count=0,
            first_seen_at=PAST, last_seen_at=PAST, closed_at=None, reopened_count=0,
            is_published=True, needs_review=False, review_reason="", is_manual_status=False,
            is_deleted=False, manually_edited_fields=[],
        )
        row.update(change)
        rows.append(tuple(row[c.split()[0]] for c in JOBS.split(", ")))
    return with_identity(spark.createDataFrame(rows, JOBS))


def companies(spark):
    return spark.createDataFrame([(1, "greenhouse"), (2, "own_career_page")],
                                 "company_id long, career_source_type string")


def posting(row_id, company=1, sid=None, url=None, title=None, conf=90, desc="D"):
    n = row_id if sid is None else sid
    return (row_id, company, f"S{n}" if sid != "" else "", url or f"https://a.com/{row_id}",
            title or f"T{row_id}", "L", desc, conf)


def run(spark, jobs, *rows):
    return upsert_postings(jobs, companies(spark), spark.createDataFrame(list(rows), BATCH), now())


def outcome(result):
    """By posting; postings of the tests carry the number of their job where it is stored."""
    return {r.row_id: r.outcome for r in result.outcomes.collect()}


def test_upsert_outcomes(spark):
    jobs = stored(
        spark, {}, {"status": "closed", "closed_at": PAST, "missing_count": 3},
        {"status": "closed", "is_manual_status": True}, {"title": "Old"},
        {"title": "Mine", "manually_edited_fields": ["title"]},
    )
    result = run(spark, jobs, *[posting(i) for i in range(1, 7)])
    assert outcome(result) == {1: "unchanged", 2: "reopened", 3: "updated", 4: "updated",
                               5: "unchanged", 6: "created"}
    after = {r.job_id: r for r in result.jobs.collect()}
    assert (after[2].status, after[2].closed_at, after[2].reopened_count) == ("open", None, 1)
    assert (after[3].status, after[5].title, after[4].title) == ("closed", "Mine", "T4")
    assert after[6].is_published and not after[6].needs_review
    assert all(r.missing_count == 0 for r in after.values())
    events = sorted((r.job_id, r.from_status, r.to_status) for r in result.events.collect())
    assert events == [(2, "closed", "open"), (6, "", "open")]


def test_upsert_twice_changes_nothing(spark):
    first = run(spark, stored(spark, {}), posting(1, title="New"), posting(2), posting(3))
    again = run(spark, first.jobs, posting(1, title="New"), posting(2), posting(3))
    assert set(outcome(again).values()) == {"unchanged"}


def test_matching_rules_and_batch_copies(spark):
    jobs = stored(spark, {}, {"source_job_id": ""})
    result = run(
        spark, jobs,
        posting(10, sid=1, url="https://a.com/other", title="T1"),  # by source id
        posting(11, sid="", url="https://a.com/2", title="X"),  # by URL
        posting(12, sid=77, url="https://a.com/n1", title="Same"),
        posting(13, sid=78, url="https://a.com/n1", title="Same"),  # copy inside the batch
    )
    got = outcome(result)
    assert got == {10: "updated", 11: "updated", 12: "created", 13: "unchanged"}
    places = {r.row_id: r.job_id for r in result.outcomes.collect()}
    assert (places[10], places[11]) == (1, 2) and places[12] == places[13]
    assert result.jobs.count() == 3


def test_equal_texts_with_their_own_postings_stay_apart(spark):
    text = dict(title="Same", description="D")
    jobs = stored(spark, text, text, dict(text, status="possibly_closed"), {})
    result = run(spark, jobs, posting(1, title="Same"), posting(2, title="Same"),
                 posting(3, title="Same"), posting(5, title="Same", url="https://a.com/5"))
    assert outcome(result) == {1: "unchanged", 2: "unchanged", 3: "reopened", 5: "updated"}
    assert {r.row_id: r.job_id for r in result.outcomes.collect()} == {1: 1, 2: 2, 3: 3, 5: 1}
    seen = result.outcomes.select("company_id", "job_id")
    struck = strikes.apply_strikes(result.jobs, seen, now())
    assert [r.job_id for r in struck.events.collect()] == [4]


def test_ties_between_stored_jobs(spark):
    """One URL on several jobs: the newest posting date wins, no date counts as newest; one text
    on several jobs: the first seen."""
    old, new = PAST - dt.timedelta(days=9), PAST + dt.timedelta(days=9)
    url = "https://a.com/shared"
    jobs = stored(
        spark, {"source_url": url, "first_seen_at": new}, {"source_url": url},
        {"source_url": url, "is_deleted": True}, {"title": "Twin", "first_seen_at": new},
        {"title": "Twin", "first_seen_at": old})
    dates = {1: PAST, 2: new, 3: None, 4: None, 5: new}
    dated = jobs.join(spark.createDataFrame(
        list(dates.items()), "job_id long, posted_at timestamp_ntz"), "job_id")
    rows = [posting(50, sid=900, url=url, title="X"), posting(51, sid=901, title="Twin",
                                                             url="https://a.com/none")]
    places = {r.row_id: r.job_id for r in run(spark, dated, *rows).outcomes.collect()}
    assert places == {50: 2, 51: 5}
    undated = dated.withColumn("posted_at", F.when(F.col("job_id") != 1, F.col("posted_at")))
    places = {r.row_id: r.job_id for r in run(spark, undated, *rows).outcomes.collect()}
    assert places[50] == 1


def test_postings_of_one_job_follow_each_other(spark):
    jobs = stored(spark, {"status": "closed"}, {"company_id": 2}, {"title": "Kept",
                  "manually_edited_fields": ["title"]})
    result = run(
        spark, jobs, posting(1, title="A"), posting(10, sid=1, url="https://a.com/1", title="A"),
        posting(11, sid=1, url="https://a.com/1", title="B"),
        posting(2, company=2), posting(12, company=2, sid=2, url="https://a.com/2", title="Z"),
        posting(13, company=2, sid=2, url="https://a.com/2", title="T2"),
        posting(3, title="other"), posting(14, sid=3, url="https://a.com/3", title="third"),
        posting(20, sid=70, url="https://n.com/1", title="N", conf=30),
        posting(21, sid=70, url="https://n.com/2", title="N2", conf=99),
        posting(22, sid="", url="https://n.com/2", title="N2", conf=99))
    assert outcome(result) == {
        1: "reopened", 10: "unchanged", 11: "updated", 2: "unchanged", 12: "updated",
        13: "updated", 3: "unchanged", 14: "unchanged", 20: "created", 21: "updated",
        22: "unchanged"}
    after = {r.job_id: r for r in result.jobs.collect()}
    assert (after[1].title, after[1].reopened_count, after[3].title) == ("B", 1, "Kept")
    assert after[2].title == "T2" and after[2].review_reason == "content changed"
    assert (after[4].source_job_id, after[4].title, after[4].is_published) == ("S70", "N2", False)
    assert after[4].review_reason == "low confidence" and len(after) == 4


def test_review_reasons(spark):
    rows = [posting(1, company=2), posting(2, conf=50), posting(3)]
    jobs = run(spark, stored(spark, {"company_id": 9}), *[
        (r[0], r[1], f"N{r[0]}", f"https://n.com/{r[0]}", *r[4:]) for r in rows]).jobs
    fresh = {r.source_job_id: r.review_reason for r in jobs.filter("source_job_id like 'N%'")
             .collect()}
    assert fresh == {"N1": "custom source", "N2": "low confidence", "N3": ""}


def test_strikes(spark):
    jobs = stored(spark, {}, {"missing_count": 1, "status": "possibly_closed"},
                  {"missing_count": 2, "status": "likely_closed"}, {},
                  {"is_manual_status": True}, {"company_id": 2})
    seen = spark.createDataFrame([(1, 4)], "company_id long, job_id long")
    result = strikes.apply_strikes(jobs, seen, now())
    state = {r.job_id: (r.status, r.missing_count) for r in result.jobs.collect()}
    assert state == {1: ("possibly_closed", 1), 2: ("likely_closed", 2), 3: ("closed", 3),
                     4: ("open", 0), 5: ("open", 0), 6: ("open", 0)}
    assert result.events.count() == 3


RUN = ("run_id long, company_id long, finished_at timestamp_ntz, success boolean, "
       "trusted boolean, jobs_seen int, failure_reason string")


def random_runs(seed, n=200, firms=4):
    rng = random.Random(seed)
    return [
        (i, min(rng.randrange(firms * 2), firms), PAST + dt.timedelta(hours=rng.randrange(900)),
         rng.random() < 0.4, True, 3, "bad")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_health_equals_a_plain_loop(spark, seed):
    rows = random_runs(seed)
    firms = spark.createDataFrame(
        [(c, "unknown", c, True, 60, PAST, "") for c in range(6)],
        "company_id long, scrape_health string, consecutive_failures int, is_active boolean, "
        "scrape_interval_minutes int, next_scrape_at timestamp_ntz, last_failure_reason string")
    state, _ = outcomes.record_outcomes(firms, spark.createDataFrame(rows, RUN))
    got = {r.company_id: (r.consecutive_failures, r.is_active) for r in state.collect()}
    expected = {c: (c, True) for c in range(6)}
    for _, company, _, success, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        n, active = expected[company]
        n = 0 if success else n + 1
        expected[company] = (n, active and n < 5)
    assert got == expected


def test_chunked_windows_equal_plain_windows(spark):
    from pyspark.sql.window import Window

    rng = random.Random(5)
    rows = [(min(rng.randrange(6), 2), PAST + dt.timedelta(days=rng.randrange(300)), i,
             rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, i int, v int")
    w = Window.partitionBy("k").orderBy("ts", "i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    chunk = ordered.time_chunk("ts", "month")
    keys, order = ["k"], ["ts", "i"]
    plain = df.select(
        "i", F.lag("v").over(w), F.lead("v").over(w), F.coalesce(F.sum("v").over(
            w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
        F.last("v", ignorenulls=True).over(before))
    a = ordered.with_neighbour(df, keys, order, "v", "a", chunk)
    b = ordered.with_neighbour(a, keys, order, "v", "b", chunk, following=True)
    c = ordered.with_running_sum(b, keys, order, F.col("v"), "c", chunk)
    d = ordered.with_last_known(c, keys, order, F.col("v"), "d", chunk).select(
        "i", "a", "b", "c", "d")
    assert sorted(map(tuple, d.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_ordered_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = ordered.with_ordered_index(df, ["x"], "n").collect()
    assert sorted((r.x, r.n) for r in rows) == [(i, i) for i in range(1000)]


def test_unique_slugs_equal_a_plain_loop(spark):
    names = ["acme"] * 7 + ["beta"] * 2 + ["acme-2"]
    existing = ["acme", "acme-2", "acme-4", "acme-07", "beta-1"]
    df = spark.createDataFrame(list(enumerate(names)), "k long, base string")
    got = history.unique_slugs(
        df, spark.createDataFrame([(s,) for s in existing], "slug string"), "k", "base")
    by_base = {}
    for k, base in enumerate(names):
        taken = set(existing) | {s for b, s in by_base.values() if b == base}
        free = itertools.chain([base], (f"{base}-{n}" for n in itertools.count(1)))
        by_base[k] = (base, next(s for s in free if s not in taken))
    assert {r.k: r.slug for r in got.collect()} == {k: s for k, (_, s) in by_base.items()}


def test_duplicate_chains_and_circles(spark):
    edges = [(1, 2), (2, 3), (3, 9), (4, 5), (5, 6), (6, 4), (7, 4)]
    rows = joins.resolve_duplicates(
        spark.createDataFrame(edges, "job_id long, duplicate_of long")).collect()
    got = {r.job_id: (r.root, r.in_circle) for r in rows}
    assert got == {1: (9, False), 2: (9, False), 3: (9, False), 4: (None, True),
                   5: (None, True), 6: (None, True), 7: (None, True)}


def test_long_chains_and_circles_of_any_length(spark):
    """A chain of 100 000 links, circles of 1 to 40 jobs with tails, and many jobs on one end."""
    edges = [(i, i + 1) for i in range(100_000)]
    expected = {i: (100_000, False) for i in range(100_000)}
    for size in range(1, 41):
        base = 1_000_000 + 1000 * size
        ring = [base + (7 * i) % 997 for i in range(size)]
        edges += list(zip(ring, ring[1:] + ring[:1], strict=True))
        edges += [(base + 998, ring[size // 2]), (base + 999, base + 998), (size - 500, base + 999)]
        expected |= {i: (None, True) for i in (*ring, base + 998, base + 999, size - 500)}
    edges += [(2_000_000 + i, 5) for i in range(3000)] + [(3_000_000, None)]
    expected |= {2_000_000 + i: (100_000, False) for i in range(3000)}
    got = joins.resolve_duplicates(
        spark.createDataFrame(edges, "job_id long, duplicate_of long")).collect()
    assert {r.job_id: (r.root, r.in_circle) for r in got} == expected and len(got) == len(expected)
    nothing = spark.createDataFrame([(1, None)], "job_id long, duplicate_of long")
    assert joins.resolve_duplicates(nothing).count() == 0


def test_saves(spark):
    at = [PAST + dt.timedelta(days=i) for i in range(9)]
    saved = spark.createDataFrame([(1, 1, at[0]), (1, 2, at[0])],
                                  "user_id int, job_id int, saved_at timestamp_ntz")
    actions = [(1, 1, "save", 1, at[1]), (1, 2, "unsave", 1, at[1]), (1, 3, "save", 1, at[2]),
               (1, 3, "unsave", 2, at[3]), (1, 3, "save", 3, at[4]), (2, 1, "save", 1, at[5])]
    got = reviews.apply_saves(saved, spark.createDataFrame(
        actions, "user_id int, job_id int, action string, seq int, at timestamp_ntz")).collect()
    assert {(r.user_id, r.job_id): r.saved_at for r in got} == {
        (1, 1): at[0], (1, 3): at[4], (2, 1): at[5]}


SCORES = [
    ("https://boards.greenhouse.io/acme", {"http_200", "multiple_job_links"}, None, 65),
    ("https://acme.com/careers", {"http_200", "nav_header", "title_keyword",
                                  "multiple_job_links", "in_sitemap"}, None, 90),
    ("https://careers.acme.com/", {"http_200", "nav_footer", "json_ld_jobposting"}, None, 63),
    ("https://acme.com/careers/engineering/senior-backend-42",
     {"single_posting", "http_200", "json_ld_jobposting"}, None, 35),
    ("https://acme.com/blog/we-are-hiring-2024", {"http_200"}, None, 0),
    ("https://acme.com/careers.pdf", {"http_200"}, None, 0),
    ("https://linkedin.com/company/acme/jobs", {"http_200", "nav_header"}, None, 0),
    ("https://acme.com/careers", set(), 404, 0),
    ("https://acme.com/careers", {"explicit_no_openings", "http_200", "nav_header",
                                  "title_keyword"}, None, 65),
    ("https://acme.myworkdayjobs.com/careers", {"http_200"}, None, 10),
]


def test_worked_scores(spark):
    rows = [(i, url, "acme.com", status, "", *[f in flags or None for f in discovery.FLAGS])
            for i, (url, flags, status, _) in enumerate(SCORES)]
    schema = ("i int, url string, domain string, http_status int, content_type string, "
              + ", ".join(f"{f} boolean" for f in discovery.FLAGS))
    scored = discovery.score_candidates(spark.createDataFrame(rows, schema)).orderBy("i")
    got = scored.collect()
    assert [r.score for r in got] == [s for *_, s in SCORES]
    assert [r["rule"] for r in got[6].trail] == ["blocked_domain"]
    assert {r["rule"] for r in got[4].trail} == {"career_path_keyword", "noise_path", "http_200",
                                                 "deep_path"}


def test_search_similarity_equals_the_set_formula(spark):
    from postwatch.functions.trigrams import trigram_similarity
    from postwatch.operators.search import similarity_to

    words = ["", "a", "Gear", "small gear", "Gear-small  ring!", "ring ring", "Überblick gear",
             "x1 y2", "ge ar", "small"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for text in ("small gear", "Über ring", "zzz", "a b"):
        rows = df.select(
            similarity_to("t", text).alias("a"), trigram_similarity("t", F.lit(text)).alias("b")
        ).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_scrape_cycle_from_feed_to_schedule(spark):
    import json

    from postwatch.operators.cycle import scrape_cycle

    jobs = stored(spark, {}, {}, {}, {"company_id": 2}, {"company_id": 3})
    firms = spark.createDataFrame(
        [(c, f"C{c}", "greenhouse", True, True, False, "unknown", 2, 60, PAST)
         for c in (1, 2, 3)],
        "company_id long, name string, career_source_type string, is_verified boolean, "
        "is_active boolean, is_deleted boolean, scrape_health string, "
        "consecutive_failures int, scrape_interval_minutes int, next_scrape_at timestamp_ntz")
    firms = firms.withColumn("next_scrape_at", F.when(
        F.col("company_id") < 3, F.col("next_scrape_at")))
    items = [{"id": f"S{i}", "title": f"T{i}", "location": {"name": "L"}, "content": "D",
              "absolute_url": f"https://a.com/{i}"} for i in (1, 9)]
    feeds = spark.createDataFrame(
        [(1, "greenhouse", json.dumps({"jobs": items})), (2, "greenhouse", "{}"),
         (3, "greenhouse", json.dumps({"jobs": items}))],
        "company_id long, source_type string, body string")
    past_runs = spark.createDataFrame(
        [(7, 1, PAST, "success", 2, 0, 0, "trusted", "")],
        "run_id long, company_id long, finished_at timestamp_ntz, status string, "
        "jobs_found int, jobs_added int, jobs_missing int, verdict string, notes string")
    result = scrape_cycle(jobs, firms, past_runs, feeds, now())
    runs = {r.company_id: r for r in result.runs.collect()}
    assert set(runs) == {1, 2}  # company 3 is not scheduled
    assert (runs[1].jobs_found, runs[1].jobs_added, runs[1].jobs_missing) == (2, 1, 2)
    assert (runs[1].verdict, runs[2].verdict) == ("trusted", "untrusted")
    state = {r.job_id: r.status for r in result.jobs.collect()}
    assert state == {1: "open", 2: "possibly_closed", 3: "possibly_closed", 4: "open",
                     5: "open", 6: "open"}
    health = {r.company_id: (r.scrape_health, r.consecutive_failures)
              for r in result.companies.collect()}
    assert health == {1: ("healthy", 0), 2: ("degraded", 3), 3: ("unknown", 2)}


def test_streamed_ingest_equals_batches(spark, tmp_path):
    import json

    from postwatch.streaming import jobs as streaming

    def document(i):
        return json.dumps({"jobs": [{"id": f"S{i}", "title": f"N{i}", "location": {"name": "L"},
                                     "content": "D", "absolute_url": f"https://a.com/{i}"}]})

    for i in (1, 5):
        spark.createDataFrame(
            [(1, "greenhouse", document(i), PAST)], streaming.RAW_SCHEMA
        ).coalesce(1).write.parquet(str(tmp_path / f"feeds/{i}"))
    named = companies(spark).withColumn("name", F.lit("Blue Works"))
    query = streaming.stream_ingest(
        spark, str(tmp_path / "feeds/*"), named, stored(spark, {}, {}),
        str(tmp_path / "state"), str(tmp_path / "progress"), files_per_batch=1, indexed=True)
    query.awaitTermination()
    store = VersionStore(spark, str(tmp_path / "state"))
    assert store.versions() == [0, 1, 2]
    from postwatch.operators import search_index

    fresh = search_index.index_tables(store.read("jobs"), named)
    for name, rows in fresh.items():  # the index that grew along is the index of the final jobs
        columns = rows.columns
        assert sorted(map(tuple, store.read(name).select(columns).collect())) == sorted(
            map(tuple, rows.collect()))
    assert sorted((r.source_job_id, r.title) for r in store.read("jobs").collect()) == [
        ("S1", "N1"), ("S2", "T2"), ("S5", "N5")]
    assert store.read("events").count() == 1 and store.manifest()["facts"] == {"top_id": 3}


def test_versions(spark, tmp_path):
    """A commit writes the buckets it touches; repeated and missing versions do no harm."""
    def table(*rows):
        return spark.createDataFrame(list(rows), "k long, v string")

    store = VersionStore(spark, str(tmp_path / "versions"))
    assert store.versions() == [] and store.manifest()["tables"] == {}
    top = {"most": ("t", F.max("k"))}
    store.commit(0, {"t": table(*[(i, "a") for i in range(100)])}, keys={"t": "k"}, count=8,
                 facts=top)
    before = store.manifest()["tables"]["t"]["paths"]
    change = table((3, "b"), (4, "b"))
    touched = store.buckets_of("t", change)
    part = store.read("t", buckets=touched)
    rest = 100 - part.count()
    merged = part.filter("k NOT IN (3, 4)").unionByName(change)
    for _ in range(2):
        store.commit(7, {"t": merged}, buckets={"t": touched}, append={"log": change}, facts=top)
    after = store.manifest()["tables"]["t"]["paths"]
    assert store.versions() == [0, 7] and store.manifest()["facts"] == {"most": 99}
    assert {int(b) for b in before if before[b] != after[b]} == set(touched)
    assert {(r.k, r.v) for r in store.read("t").collect()} == {
        (i, "b" if i in (3, 4) else "a") for i in range(100)}
    assert {r.v for r in store.read("t", 0).collect()} == {"a"}
    assert store.read("log").count() == 2
    store.commit(9, {"t": part.limit(0)}, buckets={"t": touched}, append={"log": change})
    assert store.read("t").count() == rest and store.read("log").count() == 4
    dead = store.expire(1)
    assert store.versions() == [9] and len(dead) == 2 * len(touched)
    assert store.read("t").count() == rest and store.read("log").count() == 4


def test_repeated_runs_are_dropped_within_the_horizon(spark, tmp_path):
    from postwatch.streaming import jobs as streaming

    rows = [(1, PAST), (1, PAST + dt.timedelta(minutes=5)), (2, PAST)]
    schema = "company_id long, finished_at timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "runs"))
    kept = streaming.run_to_table(streaming.dedupe_runs(stream), "dedupe").collect()
    assert sorted(r.company_id for r in kept) == [1, 2]


def test_search_index_follows_the_job_table(spark, tmp_path):
    """Searches by posting lists equal searches of all rows, before and after changes."""
    from postwatch.operators import search, search_index

    companies = spark.createDataFrame(
        [("c1", "Blue Gear Works", "s1"), ("c2", "Nord", "s2"), ("c3", None, "s3"),
         ("c4", "Gear", "s4")],
        "company_id string, name string, slug string")
    schema = "job_id string, company_id string, title string, department string"
    before = spark.createDataFrame(
        [(f"j{n}", "c2", "driver gear", None) for n in range(300)]  # one piece in most rows
        + [("a", "c1", "Cook", ""), ("b", "c3", None, "Blue team"), ("e", "c4", "", "x")], schema)
    after = before.filter("job_id NOT IN ('j1', 'e')").withColumn(
        "title", F.when(F.col("job_id") == "j2", "blue gear").otherwise(F.col("title"))
    ).withColumn(
        "company_id", F.when(F.col("job_id") == "a", "c2").otherwise(F.col("company_id"))
    ).unionByName(spark.createDataFrame([("n", "c4", "Bluest", "Gear box")], schema))
    store = VersionStore(spark, str(tmp_path / "index"))
    store.commit(0, search_index.index_tables(before, companies), keys=search_index.KEYS)

    def same(jobs, text):
        mine = search_index.search_jobs(store, jobs, companies, text)
        direct = search.search_jobs(jobs, companies, text)
        assert set(mine.columns) == set(direct.columns)
        pick = [c for c in ("job_id", "company_name", "similarity") if c in direct.columns]
        rows = [r[:] for r in mine.select(*pick).collect()]
        assert rows == [r[:] for r in direct.select(*pick).collect()]
        return len(rows)

    assert same(before, "blue gear") > 300 and same(before, "qqq") == 0
    tables, buckets = search_index.changed_jobs(store, before, before)
    assert not tables and not buckets
    tables, buckets = search_index.changed_jobs(store, before, after)
    assert len(buckets["search_grams"]) < 64 and len(buckets["search_owners"]) <= 3
    store.commit(1, tables, buckets=buckets)
    assert same(after, "blue gear") > 300 and same(after, "bl") >= 0 and same(after, "--- --") >= 0
    got = search_index.search_companies(store, companies, "gear").select("company_id").collect()
    assert [r[0] for r in got] == ["c4", "c1"]


def test_request_turns(spark):
    at = dt.datetime(2024, 5, 1, 10, 0, 59)
    rows = [("a", at, 2), ("a", at, 1), ("a", at - dt.timedelta(seconds=59), 3),
            ("a", at + dt.timedelta(seconds=1), 4), ("b", at, 5)]
    requests = spark.createDataFrame(rows, "domain string, ts timestamp_ntz, n int")
    turns = {r.n: (r.turn, r.over_limit)
             for r in history.request_turns(requests, 2, "n").collect()}
    assert turns == {3: (1, False), 1: (2, False), 2: (3, True), 4: (1, False), 5: (1, False)}
    for budget in (None, 0):
        assert not any(r.over_limit for r in history.request_turns(
            requests, budget, "n").collect())
