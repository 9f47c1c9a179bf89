"""Reports over clients, specifications, analyses, votes, corrections, conversations and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scores import content_key, coverage, weight_of
from lectern.functions.storage import materialize
from lectern.functions.texts import clipped, strip


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order given."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def clients_with_counts(clients: DataFrame, cdcs: DataFrame) -> DataFrame:
    counts = cdcs.groupBy(F.col("client_id").alias("id")).agg(F.count("*").alias("n"))
    listed = clients.join(counts, "id", "left").select("user_id", "id", "name", F.coalesce("n", F.lit(0)).alias("cdc_count"))
    return listed.orderBy("user_id", F.collate("name", "UTF8_LCASE"))


def latest_analyses(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each specification, the larger id on a tie."""
    return latest(analyses, ["cdc_id"], F.desc("created_at"), F.desc("id"))


def cdcs_with_latest(cdcs: DataFrame, analyses: DataFrame) -> DataFrame:
    last = latest_analyses(analyses).select(F.col("cdc_id").alias("id"), F.col("id").alias("analysis_id"), "created_at", "total", "covered", F.col("n_partial"))
    return cdcs.join(last, "id", "left").withColumn("coverage", F.when(F.col("analysis_id").isNotNull(), coverage(F.col("covered"), F.col("n_partial"), F.col("total"))))


def owned_analyses(analyses: DataFrame, cdcs: DataFrame, clients: DataFrame) -> DataFrame:
    """Analyses with the user who owns the client of their specification."""
    owner = cdcs.select(F.col("id").alias("cdc_id"), "client_id").join(clients.select(F.col("id").alias("client_id"), "user_id"), "client_id")
    return analyses.join(owner, "cdc_id")


def analysis_status(cdcs: DataFrame, analyses: DataFrame, version: str, fingerprint: str) -> DataFrame:
    """Whether the latest analysis is there, and still of the version and the corpus of now."""
    last = latest_analyses(analyses).select(F.col("cdc_id").alias("id"), F.col("id").alias("analysis_id"), "version", "fingerprint")
    old = (F.coalesce("version", F.lit("")) != version) | (F.coalesce("fingerprint", F.lit("")) != fingerprint)
    status = F.when(F.col("analysis_id").isNull(), "brouillon").when(old, "périmé").otherwise("analysé")
    return cdcs.join(last, "id", "left").select("id", status.alias("status"))


def upsert_votes(votes: DataFrame) -> DataFrame:
    """The state after all votes: one row for each analysis, requirement and user.

    Votes other than up and down are turned away, comments are cut at 2000 characters, and the first
    time of a key stays as created_at.
    """
    key = F.substring(F.sha1(F.concat_ws("|", "analysis_id", "requirement_id", "user_id")), 1, 16)
    valid = votes.where(F.col("vote").isin("up", "down")).withColumn("comment", F.left("comment", F.lit(2000)))
    last = F.max_by(F.struct("vote", "comment"), F.struct("updated_at", "event_id"))
    state = valid.groupBy("analysis_id", "requirement_id", "user_id").agg(F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"), last.alias("last"))
    return state.select(key.alias("id"), "analysis_id", "requirement_id", "user_id", "last.vote", "last.comment", "created_at", "updated_at")


#: Characters of a correction's answer and of its notes.
ANSWER, NOTES = 8000, 2000


def upsert_corrections(corrections: DataFrame) -> DataFrame:
    """The state after all corrections: id, analysis_id, requirement_id, user_id, content_key, verdict, answer, notes, created_at, updated_at.

    One row for each analysis, requirement and user, as it was put last; the first time of a key stays as
    created_at.  Texts are stripped and cut, blank notes are null; a blank answer or requirement and an
    unknown verdict are turned away.  Of the same time the greater verdict and answer count.
    """
    named = corrections.withColumns({"requirement_id": strip(F.col("requirement_id")), "answer": clipped(F.col("answer"), ANSWER), "notes": F.nullif(clipped(F.col("notes"), NOTES), F.lit(""))})
    valid = named.where(F.col("verdict").isin("covered", "partial", "missing") & (F.col("answer") != "") & (F.col("requirement_id") != ""))
    keyed = valid.withColumn("content_key", content_key(F.col("category"), F.col("subdomain"), F.col("title")))
    shown = ["content_key", "verdict", "answer", "notes"]
    last = F.max_by(F.struct(*shown), F.struct("updated_at", "verdict", "answer"))
    state = keyed.groupBy("analysis_id", "requirement_id", "user_id").agg(F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"), last.alias("last"))
    key = F.substring(F.sha1(F.concat_ws("|", F.lit("corr"), "analysis_id", "requirement_id", "user_id")), 1, 16)
    return state.select(key.alias("id"), "analysis_id", "requirement_id", "user_id", *(F.col(f"last.{c}") for c in shown), "created_at", "updated_at")


def corrections_list(state: DataFrame) -> DataFrame:
    """The corrections of each analysis and user with their place, the newest first, the lesser id on a tie."""
    place = F.row_number().over(Window.partitionBy("analysis_id", "user_id").orderBy(F.desc("updated_at"), "id"))
    return state.withColumn("place", place)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def vote_totals(votes: DataFrame) -> DataFrame:
    return votes.groupBy("analysis_id").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"))


def most_contested(votes: DataFrame, k: int = 5) -> DataFrame:
    downs = votes.where("vote = 'down'").groupBy("analysis_id", "requirement_id").agg(F.count("*").alias("downs"))
    rank = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.desc("downs"), "requirement_id"))
    return downs.withColumn("rank", rank).where(F.col("rank") <= k)


def votes_by_domain(votes: DataFrame, requirements: DataFrame) -> DataFrame:
    named = requirements.select("analysis_id", F.col("id").alias("requirement_id"), "category")
    joined = votes.join(named, ["analysis_id", "requirement_id"], "left").withColumn("category", F.coalesce("category", F.lit("Autre")))
    return joined.groupBy("analysis_id", "category").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"))


def corrected_coverage(requirements: DataFrame, votes: DataFrame) -> DataFrame:
    """Coverage after votes: a down vote takes all from what counts, else an up vote gives all."""
    totals = votes.groupBy("analysis_id", F.col("requirement_id").alias("id")).agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"))
    base = weight_of(F.col("status"))
    each = requirements.join(totals, ["analysis_id", "id"], "left").withColumn("value", F.when((F.col("down") > 0) & (base > 0), 0.0).when((F.coalesce("down", F.lit(0)) == 0) & (F.col("up") > 0) & (base < 1), 1.0).otherwise(base))
    return each.groupBy("analysis_id").agg(F.count("*").alias("total"), F.round(100 * F.sum("value") / F.count("*"), 1).alias("corrected"))


def owners(cdcs: DataFrame, clients: DataFrame) -> DataFrame:
    """analysis_id and user_id where an analysis is named like its specification."""
    return cdcs.select(F.col("id").alias("analysis_id"), "client_id").join(clients.select(F.col("id").alias("client_id"), "user_id"), "client_id").select("analysis_id", "user_id")


def source_boosts(votes: DataFrame, sources: DataFrame, owned: DataFrame) -> DataFrame:
    """Factor of each source that a user's own up-voted requirements cite: 0.1 more a citation, 1.5 at most.

    ``sources`` has a row for each source of each requirement (analysis_id, requirement_id, source).
    """
    mine = votes.where("vote = 'up'").join(owned.select("analysis_id", "user_id"), ["analysis_id", "user_id"], "left_semi")
    cited = mine.join(sources.select("analysis_id", "requirement_id", F.lower(strip(F.col("source"))).alias("source")), ["analysis_id", "requirement_id"])
    counts = cited.where("source <> ''").groupBy("user_id", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("factor", F.round(F.least(1 + 0.1 * F.col("n"), F.lit(1.5)), 4))


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """The newest correction of each user and content, the lesser id on a tie, whatever analysis it was made in."""
    return latest(corrections, ["user_id", "content_key"], F.desc("updated_at"), F.asc("id"))


#: The columns of the feedback export, and characters of its long cells.
EXPORT = ("analysis_id", "cdc_filename", "requirement_id", "requirement_title", "domain", "subdomain", "priority", "status", "confidence", "verdict", "evidence_concatenated", "sources_concatenated", "vote", "comment", "voted_at", "voted_by")
CELL = 500


def short(text: Column, limit: int = CELL) -> Column:
    """The text, or its beginning and an ellipsis that fill the limit."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def _cell(values: Column) -> Column:
    return short(F.array_join(F.filter(values, lambda x: x != ""), " | "))


def feedback_export(requirements: DataFrame, votes: DataFrame, files: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Every requirement with the latest vote of any user: sixteen text cells, empty where there is nothing.

    ``files`` has analysis_id and filename; ``evidence`` and ``sources`` a row for each piece of a requirement.
    """
    key = ["analysis_id", "requirement_id"]
    listed = lambda rows, name, value: rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", value.alias("x")))), lambda p: p["x"]).alias(name))
    own = requirements.withColumnRenamed("id", "requirement_id").drop("evidence", "sources")
    for more in (listed(evidence, "evidence", F.col("quote")), listed(sources, "sources", F.struct("source", "page", "score"))):
        own = own.join(more, key, "left")
    return feedback_cells(own.withColumnRenamed("requirement_id", "id"), votes, files)


def feedback_cells(requirements: DataFrame, votes: DataFrame, files: DataFrame) -> DataFrame:
    """:func:`feedback_export` of requirements that hold their quotes (``evidence``) and sources (source, page, score) as arrays.

    Requirements that lie together by analysis_id are not exchanged, unless the votes are too many for a broadcast.
    """
    key = ["analysis_id", "requirement_id"]
    last = latest(votes, key, F.desc("updated_at"), F.desc("id")).select(*key, "vote", "comment", F.col("updated_at").cast("string").alias("voted_at"), F.col("user_id").cast("string").alias("voted_by"))

    def cited(s: Column) -> Column:
        page = F.when(F.coalesce(s["page"].cast("string"), F.lit("")).isin("", "?"), "").otherwise(F.concat(F.lit(" p."), s["page"].cast("string")))
        score = F.when(s["score"].isNull(), "").otherwise(F.format_string(" (%.3f)", s["score"]))
        return F.concat(strip(F.coalesce(F.nullif(s["source"], F.lit("")), F.lit("?"))), page, score)

    named = requirements.withColumnRenamed("id", "requirement_id").withColumns({
        "requirement_title": F.col("title"),
        "domain": F.coalesce(F.nullif("category", F.lit("")), F.lit("Autre")),
        "confidence": F.when(F.col("confidence").isNotNull(), F.format_string("%.3f", "confidence")),
        "evidence_concatenated": _cell(F.transform("evidence", strip)),
        "sources_concatenated": _cell(F.transform("sources", cited)),
    })
    joined = named.join(files.select("analysis_id", F.col("filename").alias("cdc_filename")), "analysis_id", "left")
    # Written, so that Spark knows the size of what is joined by both keys.
    joined = joined.join(materialize(last, "votes"), key, "left")
    return joined.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT))


def down_voted(votes: DataFrame) -> DataFrame:
    return votes.where("vote = 'down'").select("user_id", "analysis_id", "requirement_id").distinct()


def cascade_delete(clients: DataFrame, cdcs: DataFrame, analyses: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the clients ``gone`` (id), their specifications and those' analyses."""
    lost_cdcs = cdcs.join(gone.select(F.col("id").alias("client_id")), "client_id", "left_semi")
    lost = lost_cdcs.select(F.col("id").alias("cdc_id"))
    return without(clients, gone, ["id"]), without(cdcs, lost_cdcs, ["id"]), analyses.join(lost, "cdc_id", "left_anti")


def conversations_with_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations of each user with how many messages they have, also none, the latest first."""
    counts = messages.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"))
    listed = conversations.join(counts, "id", "left").select("user_id", "id", "title", "updated_at", F.coalesce("n", F.lit(0)).alias("message_count"))
    return listed.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")))


SOURCES = "array<struct<source:string,page:string,url:string,scope:string>>"


def messages_with_feedback(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """Messages with their sources, none where their JSON is missing or broken, and the rating that stands."""
    sources = F.coalesce(F.from_json("sources_json", SOURCES), F.array().cast(SOURCES))
    parsed = messages.withColumn("sources", F.filter(sources, lambda s: s.isNotNull())).drop("sources_json")
    return parsed.join(ratings.select("conv_id", "turn", "rating"), ["conv_id", "turn"], "left")


def upsert_ratings(ratings: DataFrame, messages: DataFrame) -> DataFrame:
    """The last rating of +1 or -1 of each message and user, of messages that exist; others are turned away."""
    valid = ratings.where(F.col("rating").isin(1, -1)).join(messages.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return valid.groupBy("conv_id", "turn", "user_id").agg(F.max_by("rating", F.struct("rated_at", "rating")).alias("rating"))


def clear_ratings(ratings: DataFrame, cleared: DataFrame) -> DataFrame:
    """Ratings without those that their users took back (conv_id, turn, user_id)."""
    return without(ratings, cleared, ["conv_id", "turn", "user_id"])


def conversation_export(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """id and ``document``: a conversation and its messages in order as one JSON text."""
    sources = F.coalesce(F.from_json("sources_json", SOURCES), F.array().cast(SOURCES))
    line = F.struct("turn", "role", F.col("text").alias("content"), F.filter(sources, lambda s: s.isNotNull()).alias("sources"))
    said = messages.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("messages"))
    joined = conversations.join(said, "id", "left")
    none = F.array().cast(f"array<struct<turn:bigint,role:string,content:string,sources:{SOURCES}>>")
    return joined.select("id", F.to_json(F.struct("id", "user_id", "title", "updated_at", F.coalesce("messages", none).alias("messages"))).alias("document"))


def job_history(jobs: DataFrame, source: int | None, statuses: list[str], limit: int, offset: int) -> DataFrame:
    kept = jobs.where(F.col("status").isin(statuses))
    kept = kept if source is None else kept.where(F.col("source") == source)
    return kept.orderBy(F.desc("finished_at"), F.desc("id")).offset(offset).limit(limit)


def active_jobs(jobs: DataFrame) -> DataFrame:
    return latest(jobs.where(F.col("status").isin("queued", "running")), ["user_id", "cdc_id"], F.desc("finished_at"), F.desc("id"))


def unread_notifications(notifications: DataFrame, k: int = 20) -> DataFrame:
    """The newest unread of each user, with how many there are."""
    unread = notifications.where("read_at is null")
    w = Window.partitionBy("user_id")
    ranked = unread.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("id"))), "unread": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= k)


def repair_interrupted(jobs: DataFrame, now: Column, message: str = "interrupted") -> DataFrame:
    """Running jobs end as errors at ``now``, with ``message`` where they have no error of their own; others stay as they are."""
    hit = F.coalesce(F.col("status") == "running", F.lit(False))
    put = {"status": F.lit("error"), "error": F.coalesce("error", F.lit(message)), "finished_at": now}
    return jobs.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in put.items()})
