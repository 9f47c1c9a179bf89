"""Figures of the quality, report and scheduler dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scores import STATUSES, clamp, coverage, finite, percent
from lectern.operators.requirements import CATEGORIES


def confidence_histogram(rows: DataFrame, buckets: int = 5) -> DataFrame:
    """How many finite confidences fall in each fifth of [0, 1]; 1 belongs to the last; empty ones show 0."""
    c = clamp(finite(F.col("confidence")))
    counts = rows.where(F.col("confidence").isNotNull() & ~F.isnan("confidence")).groupBy(F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(buckets).toDF("bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def mean_confidence(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(finite(F.col("confidence"))).alias("mean_confidence"))


def feedback_rates(requirements: DataFrame, votes: DataFrame) -> DataFrame:
    """Share of up votes, and votes for a hundred requirements, by analysis; null without a base."""
    size = requirements.groupBy("analysis_id").agg(F.count("*").alias("requirements"))
    cast = votes.groupBy("analysis_id").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count("*").alias("votes"))
    joined = size.join(cast, "analysis_id", "left").na.fill(0, ["up", "votes"])
    return joined.select("analysis_id", percent(F.col("up"), F.col("votes"), 0).alias("positive_rate"), percent(F.col("votes"), F.col("requirements"), 0).alias("feedback_coverage"))


def up_votes_of_month(votes: DataFrame, as_of: Column) -> DataFrame:
    at = F.coalesce("updated_at", "created_at")
    return votes.where((F.col("vote") == "up") & (F.date_trunc("month", at) == F.date_trunc("month", as_of))).groupBy("analysis_id").agg(F.count("*").alias("n"))


def repass_candidates(requirements: DataFrame, votes: DataFrame, floor: float = 0.5) -> DataFrame:
    """Requirements that call for another pass, with the reasons in order."""
    downs = votes.where("vote = 'down'").select("analysis_id", F.col("requirement_id").alias("id")).distinct().withColumn("down", F.lit(True))
    joined = requirements.join(downs, ["analysis_id", "id"], "left")
    reasons = F.array(F.when(F.col("status") == "ambiguous", "ambiguous"), F.when(F.coalesce("confidence", F.lit(0.0)) < floor, "low_confidence"), F.when(F.col("down"), "down_vote"))
    return joined.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).where(F.size("reasons") > 0)


def contested_with_titles(contested: DataFrame, requirements: DataFrame) -> DataFrame:
    named = requirements.select("analysis_id", F.col("id").alias("requirement_id"), "title")
    return contested.join(named, ["analysis_id", "requirement_id"], "left").withColumn("title", F.coalesce("title", "requirement_id"))


def effective_view(requirements: DataFrame, corrections: DataFrame) -> DataFrame:
    """Requirements with a correction's verdict in place of their status, at full confidence."""
    fixed = corrections.select("analysis_id", F.col("requirement_id").alias("id"), F.col("verdict").alias("__verdict"))
    joined = requirements.join(fixed, ["analysis_id", "id"], "left")
    corrected = F.col("__verdict").isNotNull()
    return joined.withColumns({"status": F.coalesce("__verdict", "status"), "confidence": F.when(corrected, 1.0).otherwise(F.col("confidence")), "corrected": corrected}).drop("__verdict")


def report_filter(requirements: DataFrame, status: str | None = None, categories: list[str] | None = None, text: str = "") -> DataFrame:
    kept = requirements if status is None else requirements.where(F.col("status") == status)
    kept = kept.where(F.col("category").isin(categories)) if categories else kept
    return kept.where(F.contains(F.lower(F.concat_ws(" ", "id", "title", "description")), F.lit(text.lower()))) if text else kept


def by_confidence(requirements: DataFrame) -> DataFrame:
    """Place of each requirement, least confidence first, null as 1."""
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.coalesce("confidence", F.lit(1.0)), "id"))
    return requirements.withColumn("place", place)


def status_facets(requirements: DataFrame) -> DataFrame:
    """Counts of each status and of all, of what other filters leave; rows without a status have a null one."""
    counts = requirements.groupingSets([["status"], []], "status").agg(F.count("*").alias("n"), F.grouping("status").alias("every"))
    return counts.select(F.when(F.col("every") == 1, "all").otherwise(F.col("status")).alias("status"), "n")


def by_domain(requirements: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Counts of each status by domain, in the order of ``domains`` (the nine by default), others last."""
    domains = CATEGORIES if domains is None else domains
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, domains)), F.col("category")), F.lit(0)), F.lit(len(domains) + 1))
    counts = requirements.groupBy("category").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return counts.withColumn("domain_order", order.cast("long")).orderBy("domain_order", "category")


def summary(requirements: DataFrame) -> DataFrame:
    """Total, counts by status and coverage of each analysis; a status of no name counts in the total alone."""
    counts = requirements.groupBy("analysis_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return counts.withColumn("coverage_percent", coverage(F.col("covered"), F.col("partial"), F.col("total")))


def coverage_band(percentage: Column) -> Column:
    return F.when(percentage >= 70, "high").when(percentage >= 40, "medium").otherwise("low")


def repaired_summary(stored: DataFrame, requirements: DataFrame) -> DataFrame:
    """The six fields of each analysis: stored ones where they are finite, else recounted (0 without requirements).

    A coverage that isn't stored is the share of ``covered`` in ``total``, as both are shown.
    """
    counts = ("total", *STATUSES)
    fresh = summary(requirements).select("analysis_id", *(F.col(c).alias(f"__{c}") for c in counts))
    joined = stored.join(fresh, "analysis_id", "full")
    shown = joined.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.col(f"__{c}").cast("double"), F.lit(0.0)).cast("long") for c in counts})
    share = F.when(F.col("total") > 0, F.col("covered") / F.col("total") * 100).otherwise(0.0)
    return shown.select("analysis_id", *counts, F.coalesce(finite(F.col("coverage_percent")), share).alias("coverage_percent"))


def success_rate(jobs: DataFrame) -> DataFrame:
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "error")
    rates = jobs.groupBy("source").agg(percent(good, good + bad).alias("rate"))
    return rates.withColumn("band", F.when(F.col("rate") >= 95, "good").when(F.col("rate") >= 80, "fair").when(F.col("rate").isNotNull(), "poor"))


def next_run(schedules: DataFrame, now: Column) -> DataFrame:
    """The least next run of the enabled schedules, and how far ahead it is."""
    first = schedules.where("enabled").agg(F.min("next_run_at").alias("next_run_at"))
    return first.withColumn("ahead", ahead(F.col("next_run_at"), now))


def ahead(at: Column, now: Column) -> Column:
    """How far ahead a time is, in minutes, hours or days, each rounded from the one before; a dash without a time."""
    rounded = lambda x: F.floor(x + 0.5)
    seconds = F.unix_timestamp(at) - F.unix_timestamp(now)
    minutes = rounded(seconds / 60)
    hours = rounded(minutes / 60)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(at.isNull(), "—").when(seconds <= 0, "imminent").when(minutes < 60, told(minutes, " min")).when(hours < 24, told(hours, " h")).otherwise(told(rounded(hours / 24), " j"))


def jobs_per_day(jobs: DataFrame, now: Column, days: int, condition: Column) -> DataFrame:
    """Jobs by age in whole days, for each of the last ``days``, days without any at 0."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("finished_at").cast("timestamp"))) / 86400)
    counts = jobs.where(condition).groupBy(age.cast("long").alias("age")).agg(F.count("*").alias("n"))
    return jobs.sparkSession.range(days).toDF("age").join(counts, "age", "left").select("age", F.coalesce("n", F.lit(0)).alias("n"))


def progress(log: Column) -> Column:
    """struct(done, total) of the first "cumul X/Y" of a log, else of its first "X/Y"; null without one or with a total of 0."""
    named, plain = "(?i)cumul\\s+(\\d+)\\s*/\\s*(\\d+)", "(\\d+)\\s*/\\s*(\\d+)"
    part = lambda n: F.coalesce(*(F.nullif(F.regexp_extract(log, p, n), F.lit("")) for p in (named, plain))).try_cast("long")
    done, total = part(1), part(2)
    return F.when(total > 0, F.struct(done.alias("done"), total.alias("total")))


def visible_jobs(jobs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    fresh = F.unix_timestamp(now) - F.unix_timestamp(F.col("finished_at").cast("timestamp")) <= 60 * minutes
    return jobs.where(F.col("status").isin("queued", "running") | fresh)
