"""robots.txt as a rules table, and the predicate that applies it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
KNOWN_BOTS = ["googlebot", "bingbot", "googlebot-image", "slurp", "duckduckbot"]


def directives(robots: DataFrame) -> DataFrame:
    """origin, line_no, agent, field, value of each directive line; comments are cut, and an agent line replaces the one before."""
    lines = robots.select("origin", F.posexplode(F.split("robots_text", r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains(":"))
    lines = lines.withColumn("field", F.lower(F.trim(F.substring_index("line", ":", 1)))).withColumn("value", F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)))
    agent = F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(Window.partitionBy("origin").orderBy("line_no"))
    return lines.withColumn("agent", agent).select("origin", "line_no", "agent", "field", "value")


def groups(robots: DataFrame) -> DataFrame:
    """origin, group, line_no, field, value, agents of each rule as the standard parser groups them.

    Agent lines that follow each other share the rules after them; an empty line or an agent line after a rule
    begins anew, and rules without an agent line before them do not count.
    """
    lines = robots.select("origin", F.posexplode(F.split("robots_text", r"\r?\n")).alias("line_no", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("origin", "line_no", (F.col("line") == "").alias("empty"), bare.alias("line"))
    lines = lines.withColumn("field", F.when(F.col("line").contains(":"), F.lower(F.trim(F.substring_index("line", ":", 1)))).otherwise(""))
    lines = lines.withColumn("value", F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))).where(F.col("empty") | F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("origin").orderBy("line_no")
    agent = F.col("field") == "user-agent"
    begins = F.col("empty") | agent & F.coalesce(F.lag("empty").over(w) | (F.lag("field").over(w) != "user-agent"), F.lit(True))
    lines = lines.withColumn("begins", begins).withColumn("group", F.count_if("begins").over(w))
    agents = F.collect_set(F.when(agent, F.lower("value"))).over(Window.partitionBy("origin", "group"))
    return lines.withColumn("agents", agents).where(~F.col("empty") & ~agent & (F.size("agents") > 0)).select("origin", "group", "line_no", "field", "value", "agents")


def rules(robots: DataFrame, crawler: str = "mozilla") -> DataFrame:
    """Per origin: whether all but known search bots are blocked, those bots' disallowed paths, the crawler's rules in order, its crawl delay, sitemaps.

    The crawler's rules are those of the first group that names a part of its name, else of the first group for `*`.
    """
    g = groups(robots)
    own = F.exists("agents", lambda a: (a != "*") & (a != "") & F.contains(F.lit(crawler.lower()), a))
    g = g.withColumn("rank", F.when(own, F.col("group")).when(F.array_contains("agents", "*"), F.col("group") + (1 << 32)))
    g = g.where(F.col("rank").isNotNull()).withColumn("first", F.min("rank").over(Window.partitionBy("origin"))).where("rank = first")
    f, v = F.col("field"), F.col("value")
    general = g.groupBy(F.col("origin").alias("__origin")).agg(
        F.array_sort(F.collect_list(F.when(f.isin("allow", "disallow") & (v != ""), F.struct("line_no", (f == "allow").alias("allow"), v.alias("path"))))).alias("general"),
        F.max_by(F.when(f == "crawl-delay", v.try_cast("double")), F.when(f == "crawl-delay", F.col("line_no"))).alias("crawl_delay"),
    )
    d = directives(robots)
    bot = F.col("agent").isin(KNOWN_BOTS)
    found = d.groupBy("origin").agg(
        (F.coalesce(F.max((F.col("agent") == "*") & (f == "disallow") & (v == "/")), F.lit(False)) & F.coalesce(F.max(bot & (f == "allow") & (v == "/")), F.lit(False))).alias("blocks_all"),
        F.array_sort(F.collect_set(F.when(bot & (f == "disallow") & (v != ""), v))).alias("bot_disallows"),
        F.array_sort(F.collect_set(F.when(f == "sitemap", v))).alias("sitemaps"),
    )
    none = F.array().cast(general.schema["general"].dataType)
    found = found.join(general, F.col("origin") == F.col("__origin"), "left")
    return found.select("origin", "blocks_all", "bot_disallows", F.coalesce("general", none).alias("general"), "crawl_delay", "sitemaps")


def _fits(path: Column, rule: Column) -> Column:
    """Prefix, or with `*` an anchored pattern in which every other character is literal."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(rule, r"([\\.\[\]{}()+?^$|])", r"\\$1"), r"\*", ".*"))
    return F.when(F.contains(rule, F.lit("*")), F.regexp(path, pattern)).otherwise(F.startswith(path, rule))


def allowed(path: Column, blocks_all: Column, bot_disallows: Column, general: Column) -> Column:
    """Whether a path may be fetched; no rules allow all. The first general rule that fits decides."""
    first = F.get(F.filter(general, lambda r: F.startswith(path, r["path"])), F.lit(0))
    return F.when(blocks_all.isNull(), True).when(blocks_all, ~F.exists(bot_disallows, lambda r: _fits(path, r))).otherwise(F.coalesce(first["allow"], F.lit(True)))
