"""Operator 3: URL filters by a temporal list join: dated entries, validity intervals, as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read


def host(url: Column) -> Column:
    """Host in lower case without user, port and leading www.; null where the URL has none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.when(h != "", h)


def suffixes(h: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    parts = F.split(h, r"\.")
    return F.when(
        h.isNotNull(),
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, category, at) to validity intervals [since, until) per domain and category.

    action "add" opens, "remove" closes; of several at one time "remove" wins. Rows with a null domain, action or time are left out.
    """
    clean = entries.where("domain is not null and action is not null and at is not null")
    one = clean.groupBy("domain", "category", "at").agg(F.max(F.when(F.col("action") == "remove", 2).otherwise(1)).alias("a"))
    w = Window.partitionBy("domain", "category").orderBy("at")
    return one.withColumn("until", F.lead("at").over(w)).where("a = 1").select("domain", "category", F.col("at").alias("since"), "until")


def active(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """One row a capture: key, url, fetched, blocked, categories (sorted, comma-joined).

    Captures are reduced to distinct (host, time) before the join, so a hot host is joined once a time. A capture without host
    or time matches nothing. The list is keyed by domain; Spark broadcasts it only below its own size threshold.
    """
    own = captures.select(F.col(key), "url", "fetched", host(F.col("url")).alias("h"))
    asked = own.where("h is not null and fetched is not null").select("h", "fetched").distinct()
    names = asked.select("h", "fetched", F.explode(suffixes(F.col("h"))).alias("domain"))
    hit = names.join(intervals(entries), "domain").where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    per = hit.groupBy("h", "fetched").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("category", F.lit("")))), ",").alias("categories"))
    out = own.join(per, ["h", "fetched"], "left")
    return out.select(key, "url", "fetched", F.col("categories").isNotNull().alias("blocked"), F.coalesce("categories", F.lit("")).alias("categories"))


def capture_times(pages: DataFrame) -> DataFrame:
    """The tables hold no fetch time: capture n is taken as fetched n mod 365 days after 2026-01-01."""
    return pages.select("page_id", "url", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))


def listed(pages: DataFrame) -> DataFrame:
    """A dated list by rule: hosts whose crc32 mod 4 is 0 enter on day crc32 mod 200 and leave 60 days later; mod 8 is 0: enter again after 90 more."""
    hosts = pages.select(host(F.col("url")).alias("domain")).where("domain is not null").distinct().withColumn("k", F.crc32(F.col("domain").cast("binary")))
    day = lambda more: F.date_add(F.lit("2026-01-01").cast("date"), (F.col("k") % 200 + more).cast("int"))
    category = F.when(F.col("k") % 3 == 0, "spam").otherwise("adult").alias("category")
    rows = F.array(
        F.struct(F.lit("add").alias("action"), day(0).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(60).alias("at")),
        F.struct(F.when(F.col("k") % 8 == 0, "add").otherwise("remove").alias("action"), day(150).alias("at")),
    )
    return hosts.where("k % 4 = 0").select("domain", category, F.explode(rows).alias("e")).select("domain", "category", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return active(capture_times(pages), listed(pages))


