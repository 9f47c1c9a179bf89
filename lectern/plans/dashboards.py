"""Queries of the dashboards (G) and of the summaries that share their rules (E22-E27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.scores import content_key, tier
from lectern.operators import dashboards as D
from lectern.operators import requirements as E
from lectern.operators import workspace as W
from lectern.plans.registry import query
from lectern.plans.workspace import CORRECTED, KEY, STATE

NOW = "timestamp '2024-02-01 00:00:00'"
EFFECTIVE = "e as (select r.* replace (coalesce(c.verdict, r.status) as status, case when c.verdict is not null then 1.0 else r.confidence end as confidence), c.verdict is not null corrected from requirements_v r left join corrections_v c on c.analysis_id = r.analysis_id and c.requirement_id = r.id)"
COUNTS = "count(*) total, count_if(status = 'covered') covered, count_if(status = 'partial') \"partial\", count_if(status = 'missing') missing, count_if(status = 'ambiguous') ambiguous, round(100.0 * (count_if(status = 'covered') + 0.5 * count_if(status = 'partial')) / count(*), 1)::double coverage_percent"
SCHEDULES = "select event_id id, event_id % 3 <> 0 enabled, ts + interval 40 day next_run_at from events"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


@query("g01_confidence_histogram", "select b bucket, (select count(*) from requirements_v where least(floor(confidence * 5), 4) = b) n from range(5) t(b)")
def _(v):
    return D.confidence_histogram(v.requirements)


@query("g02_mean_confidence", "select category, avg(confidence) mean_confidence from requirements_v group by 1")
def _(v):
    return D.mean_confidence(v.requirements, "category")


@query("g03_confidence_tiers", "select case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end tier, count(*) n from requirements_v group by 1")
def _(v):
    return v.requirements.groupBy(tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query("g04_feedback_rates", f"""with {STATE}, s as (select analysis_id, count(*) n from requirements_v group by 1), t as (select analysis_id, count_if(vote = 'up') up, count(*) votes from state group by 1)
    select analysis_id, round(100.0::double * up / nullif(votes, 0), 0) positive_rate, round(100.0::double * coalesce(votes, 0) / n, 0) feedback_coverage from s left join t using (analysis_id)""")
def _(v):
    return D.feedback_rates(v.requirements, W.upsert_votes(v.votes))


@query("g05_up_votes_of_month", f"with {STATE} select analysis_id, count(*) n from state where vote = 'up' and date_trunc('month', updated_at) = date '2024-01-01' group by 1")
def _(v):
    return D.up_votes_of_month(W.upsert_votes(v.votes), F.lit("2024-01-15").cast("timestamp"))


@query("g06_repass_candidates", f"""with {STATE}, d as (select distinct analysis_id, requirement_id from state where vote = 'down')
    select r.analysis_id, r.id, concat_ws(',', case when status = 'ambiguous' then 'ambiguous' end, case when confidence < 0.5 then 'low_confidence' end, case when d.analysis_id is not null then 'down_vote' end) reasons
    from requirements_v r left join d on d.analysis_id = r.analysis_id and d.requirement_id = r.id where status = 'ambiguous' or confidence < 0.5 or d.analysis_id is not null""")
def _(v):
    return D.repass_candidates(v.requirements, W.upsert_votes(v.votes)).select("analysis_id", "id", F.array_join("reasons", ",").alias("reasons"))


@query("g07_contested_titles", f"""with {STATE}, downs as (select analysis_id, requirement_id, count(*) downs from state where vote = 'down' group by 1, 2),
    k as (select * from (select *, row_number() over (partition by analysis_id order by downs desc, requirement_id) rank from downs) where rank <= 5)
    select k.analysis_id, k.requirement_id, k.downs, k.rank, coalesce(r.title, k.requirement_id) title from k left join requirements_v r on r.analysis_id = k.analysis_id and r.id = k.requirement_id""")
def _(v):
    return D.contested_with_titles(W.most_contested(W.upsert_votes(v.votes)), v.requirements)


@query("g08_domains_by_votes", f"""with {STATE}, t as (select coalesce(r.category, 'Autre') category, count_if(vote = 'up') up, count_if(vote = 'down') down
    from state s left join requirements_v r on r.analysis_id = s.analysis_id and r.id = s.requirement_id group by 1) select *, row_number() over (order by up + down desc, category) place from t""")
def _(v):
    totals = W.votes_by_domain(W.upsert_votes(v.votes), v.requirements).groupBy("category").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return totals.withColumn("place", F.row_number().over(W.Window.orderBy(F.desc(F.col("up") + F.col("down")), "category")))


@query("g09_effective_view", f"with {EFFECTIVE} select analysis_id, id, status, confidence, corrected from e")
def _(v):
    return D.effective_view(v.requirements, v.corrections).select("analysis_id", "id", "status", "confidence", "corrected")


@query("g10_report_filter", "select analysis_id, id, title from requirements_v where status = 'missing' and category in ('ECONOMY', 'PROMO') and contains(lower(id || ' ' || title || ' ' || coalesce(description, '')), 'red')")
def _(v):
    return D.report_filter(v.requirements, "missing", ["ECONOMY", "PROMO"], "Red").select("analysis_id", "id", "title")


@query("g11_by_confidence", "select analysis_id, id, row_number() over (partition by analysis_id order by coalesce(confidence, 1), id) place from requirements_v")
def _(v):
    return D.by_confidence(v.requirements).select("analysis_id", "id", "place")


@query("g12_status_facets", "select case when grouping(s) = 1 then 'all' else s end status, count(*) n from (select nullif(status, 'ambiguous') s from requirements_v where category = 'ECONOMY') group by grouping sets ((s), ())")
def _(v):
    return D.status_facets(D.report_filter(v.requirements, categories=["ECONOMY"]).withColumn("status", F.nullif("status", F.lit("ambiguous"))))


@query("g13_by_domain", """select category, count_if(status = 'covered') covered, count_if(status = 'partial') "partial", count_if(status = 'missing') missing, count_if(status = 'ambiguous') ambiguous,
    cast(coalesce(list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], category), 7) as bigint) domain_order from requirements_v group by 1""")
def _(v):
    return D.by_domain(v.requirements, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])


@query("g14_categories", "select distinct category from requirements_v")
def _(v):
    return v.requirements.select("category").distinct().orderBy("category")


@query("g15_effective_summary", f"with {EFFECTIVE} select analysis_id, {COUNTS} from e group by 1")
def _(v):
    return D.summary(D.effective_view(v.requirements, v.corrections))


@query("g16_coverage_bands", f"with s as (select analysis_id, {COUNTS} from requirements_v group by 1) select case when coverage_percent >= 70 then 'high' when coverage_percent >= 40 then 'medium' else 'low' end band, count(*) n from s group by 1")
def _(v):
    return D.summary(v.requirements).groupBy(D.coverage_band(F.col("coverage_percent")).alias("band")).agg(F.count("*").alias("n"))


@query("g17_repaired_summary", f"""with s as (select analysis_id, {COUNTS} from requirements_v group by 1),
    r as (select analysis_id, case when analysis_id % 7 = 0 then 2 * total else total end total, case when analysis_id % 5 = 0 then 1 else covered end covered, "partial", case when analysis_id % 4 = 0 then 0 else missing end missing, ambiguous from s)
    select *, case when analysis_id % 2 = 0 then 50.0::double else covered / total * 100 end coverage_percent from r
    union all select -1, 4, 3, 0, 0, 0, 75.0""")
def _(v):
    """Summaries that lack fields, differ from the requirements, or have none; and requirements without a summary."""
    n, nothing = F.col("analysis_id"), F.lit(None).cast("long")
    kept = D.summary(v.requirements).where("analysis_id % 11 > 0 or analysis_id % 7 = 0 or analysis_id % 5 = 0 or analysis_id % 4 = 0 or analysis_id % 2 = 0")
    stored = kept.select("analysis_id", F.when(n % 7 == 0, 2 * F.col("total")).otherwise(nothing).alias("total"), F.when(n % 5 == 0, 1).alias("covered"), nothing.alias("partial"), F.when(n % 4 == 0, 0).alias("missing"), nothing.alias("ambiguous"), F.when(n % 2 == 0, 50.0).otherwise(F.lit(float("nan"))).alias("coverage_percent"))
    lone = v.spark.createDataFrame([(-1, 4, 3, None, None, None, None)], "analysis_id long, total long, covered int, partial long, missing int, ambiguous long, coverage_percent double")
    return D.repaired_summary(stored.unionByName(lone), v.requirements)


@query("g18_success_rate", """with r as (select source, round(100.0::double * count_if(status = 'success') / nullif(count_if(status in ('success', 'error')), 0), 1) rate from jobs_v group by 1)
    select source, rate, case when rate >= 95 then 'good' when rate >= 80 then 'fair' when rate is not null then 'poor' end band from r""")
def _(v):
    return D.success_rate(v.jobs)


def sql_ahead(at: str) -> str:
    seconds = f"date_diff('second', {NOW}, date_trunc('second', {at}))"
    minutes = f"floor({seconds} / 60 + 0.5)::bigint"
    hours = f"floor({minutes} / 60 + 0.5)::bigint"
    return f"case when {at} is null then '—' when {seconds} <= 0 then 'imminent' when {minutes} < 60 then {minutes} || ' min' when {hours} < 24 then {hours} || ' h' else floor({hours} / 24 + 0.5)::bigint || ' j' end"


@query("g19_next_run", f"with s as ({SCHEDULES}), f as (select min(next_run_at) next_run_at from s where enabled) select {sql_ahead('next_run_at')} ahead from f")
def _(v):
    schedules = v.events.select("event_id", (F.col("event_id") % 3 != 0).alias("enabled"), (F.col("ts") + F.expr("interval 40 days")).cast("timestamp").alias("next_run_at"))
    return D.next_run(schedules, now()).select("ahead")


@query("g19_ahead", f"select event_id, {sql_ahead('due')} ahead from (select event_id, case when event_id % 9 > 0 then {NOW} + (event_id * event_id % 400000 - 20000) * interval 1 second end as due from events)")
def _(v):
    """Times from hours ago to days ahead, some of them null."""
    seconds = F.col("event_id") * F.col("event_id") % 400_000 - 20_000
    return v.events.select("event_id", D.ahead(F.when(F.col("event_id") % 9 > 0, F.timestamp_seconds(F.unix_timestamp(now()) + seconds)), now()).alias("ahead"))


@query("g20_jobs_per_day", f"""with c as (select cast(floor(date_diff('second', date_trunc('second', finished_at), {NOW}) / 86400) as bigint) age from jobs_v where status = 'error')
    select d age, (select count(*) from c where c.age = d) n from range(14) t(d)""")
def _(v):
    return D.jobs_per_day(v.jobs, now(), 14, F.col("status") == "error")


#: Logs without any progress, with it in both forms, in any case and spacing, and with a total of 0.
LOG = """case event_id % 6 when 0 then 'nothing yet' when 1 then concat('page 1/2', chr(10), 'CUMUL  ', event_id, ' / ', event_id % 40 + 1) when 2 then concat('page ', event_id % 7, '/9 of 4/5') when 3 then 'cumul 1/0'
  when 4 then concat('step 1', chr(10), 'cumul 3/8', chr(10), 'cumul 9/10') end"""


@query("g21_progress", rf"""with l as (select event_id, {LOG} log from events), m as (select event_id, case when regexp_matches(log, '(?i)cumul\s+\d+\s*/\s*\d+') then regexp_extract(log, '(?i)cumul\s+(\d+)\s*/\s*(\d+)', ['done', 'total'])
    else regexp_extract(log, '(\d+)\s*/\s*(\d+)', ['done', 'total']) end p from l)
  select event_id, case when try_cast(p.total as bigint) > 0 then try_cast(p.done as bigint) end done, case when try_cast(p.total as bigint) > 0 then try_cast(p.total as bigint) end total from m""")
def _(v):
    return v.events.select("event_id", D.progress(F.expr(LOG.replace("chr(10)", "'\\n'"))).alias("p")).select("event_id", "p.done", "p.total")


@query("g22_visible_jobs", "select id, status from jobs_v where status in ('queued', 'running') or date_diff('second', date_trunc('second', finished_at), timestamp '2024-01-30 12:00:00') <= 300")
def _(v):
    return D.visible_jobs(v.jobs, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("id", "status")


@query("e22_automatic_repass", "select analysis_id, id from requirements_v where status = 'ambiguous' or confidence < 0.5")
def _(v):
    return v.requirements.where((F.col("status") == "ambiguous") | (F.coalesce("confidence", F.lit(0.0)) < 0.5)).select("analysis_id", "id")


@query("e23_batch_repass", f"""with {STATE} select r.analysis_id, r.id from requirements_v r where confidence < 0.5 or exists (select 1 from state s where s.analysis_id = r.analysis_id and s.requirement_id = r.id and vote = 'down' and user_id = 1)""")
def _(v):
    mine = W.upsert_votes(v.votes).where("vote = 'down' and user_id = 1")
    return E.repass_batch(v.requirements, down_voted=mine).select("analysis_id", "id")


@query("e25_summary", f"select analysis_id, {COUNTS} from requirements_v group by 1")
def _(v):
    return D.summary(v.requirements)


@query("e26_corrections_applied", f"""with {CORRECTED}, c as (select * from (select user_id, content_key k, verdict fix, answer, analysis_id origin, row_number() over (partition by user_id, content_key order by updated_at desc, id) rn from co) where rn = 1),
    r as (select q.*, o.user_id, {KEY} k from requirements_v q join cdcs_v d on d.id = q.analysis_id join clients_v o on o.id = d.client_id)
    select r.analysis_id, r.id, r.user_id, coalesce(fix, r.status) status, coalesce(answer, r.verdict) verdict, case when fix is not null then 1.0 else confidence end confidence, fix is not null correction_applied, origin correction_source_analysis_id
    from r left join c on c.user_id = r.user_id and c.k = r.k""")
def _(v):
    mine = v.requirements.join(W.owners(v.cdcs, v.clients), "analysis_id")
    fixed = E.apply_corrections(mine, W.latest_corrections(W.upsert_corrections(v.correction_events)))
    return fixed.select("analysis_id", "id", "user_id", "status", "verdict", "confidence", "correction_applied", "correction_source_analysis_id")


@query("e27_content_key", f"select distinct category, subdomain, title, {KEY} content_key from requirements_v")
def _(v):
    return v.requirements.select("category", "subdomain", "title", content_key(F.col("category"), F.col("subdomain"), F.col("title")).alias("content_key")).distinct()
