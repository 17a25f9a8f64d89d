"""Robots rules of landed files: groups by agent, and the longest matching rule for each address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robot_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, pattern, allow, rule): the rules that landed files (host, body) have for an agent.

    A group begins at a User-agent line that doesn't follow another one. Groups of the longest name that the agent's name begins with apply, all together,
    else those for `*`; names and fields are read in any case, and what follows a # is a remark. Rules without a path say nothing. `rule` is the pattern as a
    regular expression: from the path's start, * for any text, and $ at the end for its end.
    """
    line = F.trim(F.regexp_replace(F.col("line"), "#.*$", ""))
    d = files.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r\n|\r|\n")).alias("at", "line"))
    d = d.select("host", "at", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.when(F.contains(line, F.lit(":")), F.trim(F.regexp_replace(line, "^[^:]*:", ""))).alias("value"))
    d = d.where("field in ('user-agent', 'allow', 'disallow') and value is not null")
    order = Window.partitionBy("host").orderBy("at")
    names = F.col("field") == "user-agent"
    begins = names & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    d = d.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(order))
    own = F.lit(agent.lower())
    named = d.where(names).select("host", "group", F.lower("value").alias("name")).where((F.col("name") == "*") | ((F.col("name") != "") & F.startswith(own, F.col("name"))))
    weight = F.when(F.col("name") == "*", 0).otherwise(F.length("name"))
    best = named.withColumn("w", weight).withColumn("most", F.max("w").over(Window.partitionBy("host"))).where("w = most").select("host", "group").distinct()
    rules = d.where(~names & (F.col("value") != "")).join(best, ["host", "group"]).select("host", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow")).distinct()
    return rules.withColumn("rule", _expression(F.col("pattern")))


def _expression(pattern: Column) -> Column:
    ends = F.endswith(pattern, F.lit("$"))
    body = F.when(ends, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.array_join(F.transform(F.split(body, "\\*"), lambda part: F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), ".*")
    return F.concat(F.lit("(?s)^"), quoted, F.when(ends, "$").otherwise(""))


def path_of(url: Column) -> Column:
    """What a rule is compared with: the address after its host, without a fragment; / if there is nothing."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, allowed, pattern) of pages (page_id, host, url): by the longest pattern that matches, where an allowing one wins a tie; without any a page is allowed.

    A page meets the rules of its own host, which its file bounds, and the best is kept as an aggregate. A page without a url is not allowed.
    """
    met = pages.withColumn("path", path_of(F.col("url"))).join(rules, "host").where(F.expr("path rlike rule"))
    best = met.groupBy("page_id").agg(F.max(F.struct(F.length("pattern").alias("n"), F.col("allow").cast("int").alias("allow"), "pattern")).alias("b"))
    d = pages.select("page_id", F.col("url").isNotNull().alias("known")).join(best, "page_id", "left")
    return d.select("page_id", (F.col("known") & F.coalesce(F.col("b.allow") == 1, F.lit(True))).alias("allowed"), F.col("b.pattern").alias("pattern"))


#: Paths of a site that are worth reading, the most telling first.
CANDIDATES = ("/", "/about", "/contact", "/tours", "/booking")


def candidate_pages(hosts: DataFrame, rules: DataFrame, most: int = 3, paths: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """(host, url, nth): the first paths of each host that its rules allow, to be fetched."""
    each = hosts.select("host", F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("at", "path")).withColumn("url", F.concat(F.lit("https://"), "host", "path"))
    key = F.struct("host", "at")
    may = allowed(each.withColumn("page_id", key), rules).where("allowed").select("page_id.host", "page_id.at")
    nth = F.row_number().over(Window.partitionBy("host").orderBy("at"))
    return each.join(may, ["host", "at"]).withColumn("nth", nth).where(F.col("nth") <= most).select("host", "url", "nth")
