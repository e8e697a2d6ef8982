"""Plans and batches that must not grow with the tables."""

from pyspark.sql import functions as F

from postwatch.functions.texts import fold_ascii
from postwatch.operators import discovery, ordered, search_index, strikes
from postwatch.sources.sitemaps import sitemap_locs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def firms(spark, n=6):
    k = F.col("id").cast("string")
    return spark.range(n).select(
        F.col("id").alias("company_id"), F.concat(F.lit("c"), k, F.lit(".example.org")).alias(
            "domain"))


def test_guesses_are_not_broadcast(spark):
    companies, k = firms(spark), F.col("company_id")
    pages = companies.select(
        F.when(k % 2 == 0, F.concat(F.lit("https://"), "domain", F.lit("/careers/"))).otherwise(
            F.concat(F.lit("https://jobs."), "domain", F.lit("/"))).alias("url"),
        F.when(k % 3 == 0, 404).when(k == 1, 301).otherwise(200).alias("status"))
    known = spark.createDataFrame(
        [(2, "https://c2.example.org/careers")], "company_id long, url string")
    found = discovery.guess_candidates(companies, pages, known)
    assert "BroadcastHashJoin" not in plan(found)
    rows = found.select("company_id", "url", "origin", "via").collect()
    assert sorted(map(tuple, rows)) == [
        (4, "https://c4.example.org/careers", "common_path", "common path probe"),
        (5, "https://jobs.c5.example.org", "subdomain_guess", "subdomain guess")]



def test_addresses_of_pages_are_made_once(spark):
    """Every step takes prepared addresses of the pages, and then does not look at their URLs."""
    companies, k = firms(spark), F.col("company_id")
    pages = companies.select(
        k.alias("page_id"), F.concat(F.lit("HTTPS://"), "domain", F.lit(":443/careers/")).alias(
            "url"), F.when(k % 3 == 0, 404).otherwise(200).alias("status"),
        F.lit("<p>").alias("html"))
    addresses = discovery.page_addresses(pages)
    known = spark.createDataFrame([], "company_id long, url string")
    plain = discovery.guess_candidates(companies, pages, known)
    made = discovery.guess_candidates(companies, pages.drop("url"), known, addresses)
    assert sorted(made.collect()) == sorted(plain.collect())
    assert [r.company_id for r in made.orderBy("company_id").collect()] == [1, 2, 4, 5]
    facts = pages.select("page_id", (F.col("page_id") % 2 == 0).alias("has_posting"))
    scored = discovery.score_candidates(made, companies)
    found = discovery.jsonld_evidence(
        scored, pages.drop("url").withColumn("final_url", F.lit("")), facts, addresses)
    assert sorted(map(tuple, found.select(
        "company_id", "http_status", "json_ld_jobposting").collect())) == [
        (1, 200, None), (2, 200, True), (4, 200, True), (5, 200, None)]


def test_sitemaps_are_not_broadcast(spark):
    site = F.concat(F.lit("https://"), "domain")
    index = F.concat(F.lit("<sitemapindex><loc>"), site, F.lit("/a.xml</loc></sitemapindex>"))
    leaf = F.concat(F.lit("<urlset><loc>"), site, F.lit("/careers/</loc></urlset>"))
    docs = firms(spark)
    bodies = docs.select(F.concat(site, F.lit("/sitemap.xml")).alias("doc_url"), index.alias(
        "body")).unionByName(docs.select(F.concat(site, F.lit("/a.xml")).alias("doc_url"),
                                         leaf.alias("body")))
    roots = docs.select("company_id", F.concat(site, F.lit("/sitemap.xml")).alias("doc_url"),
                        F.lit(0).alias("pos"))
    leaves = discovery.sitemap_pages(sitemap_locs(bodies), roots)
    found = discovery.with_sitemap_flag(discovery.sitemap_candidates(leaves), leaves)
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted(map(tuple, found.select("company_id", "url", "in_sitemap").collect())) == [
        (k, f"https://c{k}.example.org/careers", True) for k in range(6)]


def test_chains_of_null_keys_cross_chunks_and_small_ones_stay_whole(spark):
    rows = [(k if k < 3 else None, None if k < 3 else "r", k * 100 + i, i)
            for k in range(4) for i in range(3 if k else 40)]
    df = spark.createDataFrame(rows, "a int, b string, at long, v int")
    out = ordered.with_neighbour(df, ["a", "b"], ["at"], "v", "was",
                                 ordered.number_chunk("at", 7), whole=10)
    assert sorted((r.at, r.was) for r in out.collect()) == sorted(
        (at, v - 1 if v else None) for _, _, at, v in rows)


def test_folding_takes_few_texts_at_a_time(spark):
    texts = ["é" * 3 + "a", "plain", None, "ß中x"] * 300
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = [r.f for r in df.select("i", fold_ascii("t").alias("f")).orderBy("i").collect()]
    assert got == ["eeea", "plain", None, "x"] * 300


def test_index_moves_one_row_per_text(spark):
    rows = spark.createDataFrame([(1, "blue gear"), (1, "blue gear"), (2, "gear")],
                                 "job_id long, title string")
    grams = search_index.postings(rows, "job_id", {"job.title": "title"}).distinct()
    text = plan(grams)
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")
    assert grams.count() == 10 + 5


def test_replay_meets_runs_and_sightings_once(spark):
    """What a run tells is written as one flag; the rest of the plan does not see runs again."""
    def day(n):
        return F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, {n})")

    n = F.col("id")
    runs = spark.range(6).select(
        F.concat(F.lit("r"), n.cast("string")).alias("run_id"), (n % 2).alias("company_id"),
        day("id").alias("finished_at"),
        F.when(n == 3, "untrusted").otherwise("trusted").alias("verdict"),
        F.when(n == 2, "not_modified").alias("notes"))
    jobs = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", None)],
                                 "job_id string, company_id long")
    seen = spark.createDataFrame([("r0", "a"), ("r0", "b"), ("r4", "a"), ("r1", "c"), ("r3", "c"),
                                  ("r2", "b"), ("r9", "b")], "run_id string, job_id string")
    out = strikes.replay(jobs, runs, seen)
    text = plan(out)
    assert "verdict" not in text and "trusted" not in text
    got = {r.job_id: (r.missing_count, r.status, r.last_seen_at and r.last_seen_at.day)
           for r in out.collect()}
    assert got == {"a": (0, "open", 5), "b": (1, "possibly_closed", 3), "c": (0, "open", 4),
                   "d": (0, "open", None)}


def test_written_tables_are_dropped_behind_their_step(spark, tmp_path):
    """Rows are kept as Parquet, not as a checkpoint; a step of a stream leaves none behind."""
    import os

    from postwatch.session import dropping_written, written

    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    with dropping_written(spark):
        kept = written(rows, "kept")
        files = kept.inputFiles()
        assert files and all(f.endswith(".parquet") for f in files)
        assert kept.schema == rows.schema and sorted(kept.collect()) == sorted(rows.collect())
        indexed = ordered.with_ordered_index(rows, ["a"], "at")
        assert all(f.endswith(".parquet") for f in indexed.inputFiles()) and indexed.inputFiles()
        assert [r.at for r in indexed.orderBy("a").collect()] == [0, 1]
    assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)
    assert written(rows.withColumn("n", F.lit(None)), "void").count() == 2
    stays = written(rows, "stays")
    assert stays.count() == 2


def test_shuffle_files_go_with_their_action(spark):
    """A long stream holds the shuffles of one action at most; a frame can be collected again."""
    import glob

    from postwatch.session import configure

    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    configure(spark)
    try:
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        folders = [f.getPath() for f in root.localDirs()]

        def files():
            return {f for at in folders for f in glob.glob(f"{at}/**/shuffle_*", recursive=True)}

        before = files()
        counts = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
        first = sorted(counts.collect())
        assert not files() - before and sorted(counts.collect()) == first and len(first) == 7
    finally:
        if was is not None:
            spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", was)
