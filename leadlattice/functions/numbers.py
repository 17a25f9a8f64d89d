"""Phone numbers by a number plan: prefixes as rows, of which the longest decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: By region, country code and trunk digit, then prefixes of national numbers with their least and most digits. A longer prefix overrules a shorter one.
PLANS = {
    "HR": ("385", "0", (("1", 8, 8), ("2", 8, 8), ("3", 8, 8), ("4", 8, 8), ("5", 8, 8), ("91", 8, 9), ("92", 8, 9), ("95", 8, 9), ("97", 8, 9), ("98", 8, 9), ("99", 8, 9), ("800", 7, 9))),
    "SI": ("386", "0", (("1", 8, 8), ("2", 8, 8), ("3", 8, 8), ("4", 8, 8), ("5", 8, 8), ("7", 8, 8), ("64", 8, 8), ("65", 8, 8), ("68", 8, 8), ("69", 8, 8), ("80", 6, 8))),
    "RS": ("381", "0", (("1", 8, 9), ("11", 8, 10), ("2", 8, 9), ("3", 8, 9), ("60", 8, 10), ("61", 8, 10), ("62", 8, 10), ("63", 8, 10), ("64", 8, 10), ("65", 8, 10), ("66", 8, 10), ("69", 8, 10), ("800", 7, 9))),
}


def plan_table(spark: SparkSession, plans: dict = PLANS) -> DataFrame:
    """(region, code, trunk, prefix, least, most): a number plan as rows, which may as well be landed from files."""
    rows = [(region, code, trunk, prefix, least, most) for region, (code, trunk, prefixes) in plans.items() for prefix, least, most in prefixes]
    return spark.createDataFrame(rows, "region string, code string, trunk string, prefix string, least int, most int")


def dialled(c: Column) -> Column:
    """A number's digits, with + where an international prefix stood; null if anything but digits and separators is in it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "[\\s()./\\-\\u00a0\\u2010-\\u2015]", ""), "^00", "+")
    return F.when(bare.rlike("^\\+?[0-9]+$"), bare)


def numbered(phones: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, e164, region) of phones (id, phone, region): each number as a plan reads it, null where no plan does.

    A number with + or 00 names its country, of whose codes the longest counts; another one is of its row's region. A trunk digit may stand before the national number, also after a country
    code, unless the number is sound with it. The longest prefix of the national number says how long it may be. Numbers meet plans by equi-joins on the prefixes they begin with.
    """
    # A generator's output is worked out once, however often later steps use it.
    d = phones.select("id", F.col("region").alias("home"), F.explode(F.array(dialled(F.col("phone")))).alias("n")).where("n is not null")
    codes = plan.select("region", "code", "trunk").distinct()
    away = d.where("n like '+%'").select("id", F.substring("n", 2, 40).alias("n")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("code", F.expr("substring(n, 1, k)"))
    away = away.join(codes, "code").withColumn("n", F.expr("substring(n, k + 1)"))
    longest = away.groupBy("id").agg(F.max("k").alias("k"))
    away = away.join(longest, ["id", "k"]).select("id", "region", "code", "trunk", "n")
    home = d.where("n not like '+%'").join(codes.withColumnRenamed("region", "home"), "home").select("id", F.col("home").alias("region"), "code", "trunk", "n")
    both = away.unionByName(home)
    # As it stands, and without a trunk digit.
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("n").alias("nat")), F.struct(F.lit(1).alias("way"), F.when(F.startswith("n", F.col("trunk")) & (F.col("trunk") != ""), F.expr("substring(n, length(trunk) + 1)")).alias("nat")))
    tried = both.withColumn("w", F.explode(ways)).select("id", "region", "code", "w.way", "w.nat").where("nat <> ''")
    begun = tried.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(6), F.length("nat"))), lambda i: F.substring("nat", F.lit(1), i))))
    met = begun.join(plan.select("region", "code", "prefix", "least", "most"), ["region", "code", "prefix"])
    best = met.groupBy("id", "region", "code", "way", "nat").agg(F.max(F.struct(F.length("prefix").alias("k"), "least", "most")).alias("p"))
    sound = best.where(F.length("nat").between(F.col("p.least"), F.col("p.most")))
    # A code that several regions share goes to the first by name.
    one = sound.groupBy("id").agg(F.min(F.struct("way", "region", "code", "nat")).alias("r"))
    return phones.select("id").join(one, "id", "left").select("id", F.concat(F.lit("+"), "r.code", "r.nat").alias("e164"), F.col("r.region").alias("region"))
