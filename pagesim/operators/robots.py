"""robots.txt as tables: parsing by window functions, verdicts by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U


def robots_lines(files: DataFrame) -> DataFrame:
    """host, line_no, field (lower case) and value of each line with a colon; files: host, body."""
    lines = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace(F.substring_index("raw", "#", 1), r"[\t]", " "))
    lines = lines.select("host", "line_no", text.alias("text")).where(F.contains("text", F.lit(":")))
    return lines.select("host", "line_no", F.lower(F.trim(F.substring_index("text", ":", 1))).alias("field"), F.trim(F.regexp_replace("text", "^[^:]*:", "")).alias("value"))


def escape_pattern(pattern: Column) -> Column:
    """A regular expression for a robots path pattern: * is any run, a final $ the end, all else literal."""
    end = pattern.endswith("$")
    body = F.when(end, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    literal = F.regexp_replace(body, r"([.\\+?\[\](){}|^$\-])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(end, "$").otherwise(""))


def specificity(pattern: Column) -> Column:
    """Characters of a pattern that are no wildcard; its final $ does not count."""
    return F.length(F.translate(pattern, "*$", ""))


def parse_robots(files: DataFrame) -> DataFrame:
    """host, agent, rule_seq, allow, pattern, regex, length: a row for each agent and rule of its groups.

    A user-agent line after a rule or crawl-delay line begins a new group, others gather; sitemap and unknown lines end
    none; rules before any agent are dropped; an empty user-agent clears the group's agents if it begins one and adds
    none; an empty Disallow is an Allow of length zero.
    """
    by_host = Window.partitionBy("host").orderBy("line_no")
    lines = robots_lines(files).where(F.col("field").isin("user-agent", "disallow", "allow", "crawl-delay"))
    marked = lines.withColumn("is_agent", F.col("field") == "user-agent")
    # rules before the first agent line end nothing
    marked = marked.withColumn("seen", F.max(F.col("is_agent").cast("int")).over(by_host)).where("seen = 1")
    begins = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(by_host), F.lit(True))
    grouped = marked.withColumn("begins", begins.cast("int")).withColumn("grp", F.sum("begins").over(by_host))
    agents = grouped.where("is_agent and value <> ''").select("host", "grp", F.lower("value").alias("agent"), F.col("line_no").alias("agent_line"))
    rules = grouped.where(F.col("field").isin("allow", "disallow") & ~((F.col("field") == "allow") & (F.col("value") == "")))
    rules = rules.select("host", "grp", F.col("line_no").alias("rule_seq"), ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("pattern"))
    out = agents.join(rules, ["host", "grp"])
    return out.select("host", "agent", "agent_line", "rule_seq", "allow", "pattern", escape_pattern(F.col("pattern")).alias("regex"), specificity(F.col("pattern")).alias("length"))


def crawl_delays(files: DataFrame) -> DataFrame:
    """host, crawl_delay: the last one of the file that is a number, whatever its group."""
    lines = robots_lines(files).where("field = 'crawl-delay'").withColumn("d", F.col("value").try_cast("double")).where("d is not null")
    return lines.groupBy("host").agg(F.max_by("d", "line_no").alias("crawl_delay"))


def sitemaps(files: DataFrame) -> DataFrame:
    return robots_lines(files).where("field = 'sitemap' and value <> ''").select("host", "line_no", F.col("value").alias("sitemap"))


def groups_for(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of each host that hold for an agent: the longest name that has or is part of it, else *."""
    own = F.lit(agent.lower())
    named = rules.where((F.col("agent") != "*") & (F.contains(own, F.col("agent")) | F.contains(F.col("agent"), own)))
    chosen = named.groupBy("host").agg(F.max_by("agent", F.struct(F.length("agent"), -F.col("agent_line"))).alias("named"))
    joined = rules.join(chosen, "host", "left")
    return joined.where(F.col("agent") == F.coalesce("named", F.lit("*"))).drop("named")


def robots_verdict(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url) with host, target and allowed: the longest matching rule decides, Allow on a tie, none allows.

    Each different URL is judged once; repeated rows stay.
    """
    url = F.col("url")
    target = F.concat(F.when(U.path(url) == "", "/").otherwise(U.path(url)), F.when(U.query(url) != "", F.concat(F.lit("?"), U.query(url))).otherwise(""))
    placed = urls.withColumns({"host": U.netloc(url), "target": target})
    once = placed.select("host", "target").distinct()
    own = groups_for(rules, agent).select(F.col("host").alias("_h"), "allow", "regex", "length")
    # a host has a short list of rules, so the pattern test runs over that list only
    matched = once.join(own, (F.col("host") == F.col("_h")) & F.expr("target rlike regex"), "left")
    verdicts = matched.groupBy("host", "target").agg(F.coalesce(F.max_by("allow", F.struct("length", F.col("allow").cast("int"))), F.lit(True)).alias("allowed"))
    known = verdicts.select(F.col("host").alias("_h"), F.col("target").alias("_t"), "allowed")
    joined = placed.join(known, F.col("host").eqNullSafe(F.col("_h")) & F.col("target").eqNullSafe(F.col("_t")), "left")
    return joined.select(*placed.columns, "allowed")


def nothing_disallowed(rules: DataFrame, agent: str = "*") -> DataFrame:
    return groups_for(rules, agent).groupBy("host").agg(F.bool_and("allow").alias("nothing_disallowed"))


def availability(fetched: DataFrame) -> DataFrame:
    """fetched (host, status) with denied and warning: no answer, 429, 3xx and 5xx deny; other failures allow all."""
    s = F.col("status")
    denied = s.isNull() | (s == 429) | (s >= 500) | s.between(300, 399)
    warning = F.concat(F.lit("robots.txt unavailable for "), F.col("host"), F.lit(" ("), F.coalesce(F.concat(F.lit("status "), s.cast("string")), F.lit("unreachable")), F.lit("); crawling denied"))
    return fetched.withColumns({"denied": denied, "has_rules": F.coalesce(s == 200, F.lit(False)), "warning": F.when(denied, warning)})


def delay_policy(delays: DataFrame, per_second: float = 2.0) -> DataFrame:
    """delays (host, crawl_delay) with used_delay, warned, min_interval: below 0 ignored, over an hour an hour."""
    d = F.col("crawl_delay")
    used = F.when(d < 0, F.lit(None).cast("double")).when(d > 3600, F.lit(3600.0)).otherwise(d)
    return delays.withColumns({"used_delay": used, "warned": (d < 0) | (d > 3600)}).withColumn("min_interval", F.greatest(F.lit(1.0 / per_second), F.coalesce("used_delay", F.lit(0.0))))
