"""robots.txt bodies → rule rows, sitemap rows and allow decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def robots_lines(bodies: DataFrame) -> DataFrame:
    """Directive lines of every body with the number of the user-agent block they belong to.

    The block number is a running count inside one body, which is read whole: a rule cut short
    would allow or forbid more than was written.
    """
    lines = bodies.select(
        "domain", F.posexplode(F.split("body", r"\r\n|\n|\r"))
        .alias("line_no", "line")
    ).withColumn("line", _strip(F.col("line")))
    kept = lines.filter(
        (F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains(":")
    )
    split = kept.select(
        "domain", "line_no",
        F.lower(_strip(F.substring_index("line", ":", 1))).alias("key"),
        _strip(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"),
    )
    starts = (F.col("key") == "user-agent") & (F.col("value") != "")
    order = Window.partitionBy("domain").orderBy("line_no")
    return split.withColumn("block", F.count_if(starts).over(order))


def robots_rules(bodies: DataFrame) -> DataFrame:
    """Allow, disallow and crawl-delay rules per user agent. Rules before the first user agent
    apply to ``*``; empty disallow lines are no rules."""
    lines = robots_lines(bodies)
    agent = (F.col("key") == "user-agent") & (F.col("value") != "")
    agents = lines.filter(agent).select("domain", "block", F.lower("value").alias("user_agent"))
    rules = lines.filter(
        F.col("key").isin("allow", "crawl-delay")
        | ((F.col("key") == "disallow") & (F.col("value") != ""))
    )
    return rules.join(agents, ["domain", "block"], "left").select(
        "domain", "block", F.coalesce("user_agent", F.lit("*")).alias("user_agent"),
        F.col("key").alias("rule"), F.col("value").alias("path"), "line_no",
    )


def robots_agents(bodies: DataFrame) -> DataFrame:
    """User-agent blocks of every body, also those without a rule."""
    lines = robots_lines(bodies)
    agent = (F.col("key") == "user-agent") & (F.col("value") != "")
    named = lines.filter(agent).select("domain", "block", F.lower("value").alias("user_agent"))
    before = lines.filter((F.col("block") == 0) & (F.col("key") != "sitemap"))
    implied = before.select("domain", "block", F.lit("*").alias("user_agent")).distinct()
    return named.unionByName(implied)


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    lines = robots_lines(bodies)
    return lines.filter((F.col("key") == "sitemap") & (F.col("value") != "")).select(
        "domain", F.col("value").alias("sitemap_url"), "line_no"
    )


def robots_allowed(
    urls: DataFrame, rules: DataFrame, user_agent: str, agents: DataFrame | None = None
) -> DataFrame:
    """Whether a crawler may fetch each ``(url_id, domain, path)``.

    The block with the longest matching agent name is chosen per domain first; in it the last
    matching disallow line counts, unless a longer allow path matches as well. Both picks are
    aggregates, so a domain with very many addresses is spread over tasks.

    Rules are looked up, not tried: an address is joined by equality with the rule paths that are
    its own prefixes, of the lengths that occur in its domain. So a domain with very many rules
    costs an address one row per rule length, and no row per rule.
    """
    known = rules if agents is None else agents
    name = user_agent.lower()
    candidates = known.select("domain", "block", "user_agent").distinct().filter(
        (F.col("user_agent") == "*") | F.lit(name).startswith(F.col("user_agent"))
    )
    # a named agent beats "*"; among equal names the first block, for "*" the last one
    named = F.col("user_agent") != "*"
    chosen = candidates.groupBy("domain").agg(
        F.max_by(
            "block",
            F.struct(
                F.when(named, F.length("user_agent")).otherwise(0),
                F.when(named, -F.col("block")).otherwise(F.col("block")),
            ),
        ).alias("block")
    )
    first = known.groupBy("domain").agg(F.min("block").alias("_first"))
    picked = first.join(chosen, "domain", "left").select(
        "domain", F.coalesce("block", "_first").alias("block")
    )
    # one row per path of the chosen block, with the last line that allows and that refuses it
    active = rules.filter(F.col("rule") != "crawl-delay").join(picked, ["domain", "block"])
    lines = active.groupBy("domain", F.col("path").alias("_prefix")).agg(
        F.max(F.when(F.col("rule") == "disallow", F.col("line_no"))).alias("_no_line"),
        F.max(F.when(F.col("rule") == "allow", F.col("line_no"))).alias("_yes_line"),
    )
    lengths = lines.groupBy("domain").agg(
        F.sort_array(F.collect_set(F.length("_prefix"))).alias("_lengths"))
    # every address offers the prefixes that are as long as some rule of its domain
    fitting = F.filter("_lengths", lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    offered = urls.select("url_id", "domain", "path").join(lengths, "domain").select(
        "url_id", "domain", F.explode(prefixes).alias("_prefix"))
    hits = offered.join(lines, ["domain", "_prefix"])
    best = hits.groupBy("url_id").agg(
        F.max_by("_prefix", "_no_line").alias("_no"), F.max_by("_prefix", "_yes_line").alias("_yes"))
    decided = urls.join(best, "url_id", "left")
    refused = F.col("_no").isNotNull() & ~F.coalesce(
        F.length("_yes") > F.length("_no"), F.lit(False)
    )
    return decided.withColumn("allowed", ~refused).drop("_no", "_yes")
