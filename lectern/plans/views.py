"""The data model over the given tables: the same SQL text gives each view in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.storage import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "chunks_v": """
        select concat(substr(md5(source), 1, 8), '_', cast(doc_id as varchar(20))) chunk_id, doc_id corpus_pos, text, source,
               case when doc_id % 3 = 0 then 'knowledge_base' else 'private' end collection from documents""",
    "queries_v": "select item_id query_id, text from benchmark",
    "query_vectors_v": "select vec_id query_id, embedding from embeddings where vec_id % 20 = 0",
    "vectors_v": "select vec_id chunk_pos, embedding, case when vec_id % 2 = 0 then 'knowledge_base' else 'private' end collection from embeddings",
    "clients_v": "select c_custkey id, c_nationkey % 5 user_id, c_name name from customer",
    "cdcs_v": "select o_orderkey id, o_custkey client_id, cast(o_orderdate as date) uploaded_at from orders",
    "analyses_v": """
        select concat(cast(l_orderkey as varchar(20)), ':', cast(cast(l_shipdate as date) as varchar(10))) id, l_orderkey cdc_id, cast(l_shipdate as date) created_at,
               count(*) total, sum(case when l_returnflag = 'N' and l_linestatus = 'O' then 1 else 0 end) covered,
               sum(case when l_returnflag = 'A' then 1 else 0 end) n_partial, max(case when l_tax > 0.04 then 'v2' else 'v1' end) version,
               max(case when l_discount > 0.02 then 'f2' else 'f1' end) fingerprint
        from lineitem group by l_orderkey, cast(l_shipdate as date)""",
    "requirements_v": """
        select analysis_id, id, title, category, status, confidence, source, page, description, subdomain, priority, verdict from (
          select l.l_orderkey analysis_id, concat('R00', cast(l.l_linenumber as varchar(4))) id, p.p_name title, p.p_type category,
                 case when l_returnflag = 'R' then 'missing' when l_returnflag = 'A' then 'partial'
                      when l_linestatus = 'O' then 'covered' else 'ambiguous' end status,
                 round(l_discount * 10, 1) confidence, su.s_name source, cast(l_quantity as int) page,
                 concat(p.p_brand, ' for ', p.p_name) description, case when l_partkey % 3 > 0 then p.p_brand end subdomain,
                 case l_linenumber % 4 when 0 then 'wont' when 1 then 'must' when 2 then 'should' else 'could' end priority, concat('as ', su.s_name, ' says') verdict,
                 row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice) rn
          from lineitem l left join part p on p.p_partkey = l.l_partkey left join supplier su on su.s_suppkey = l.l_suppkey) x where rn = 1""",
    "sources_v": """
        select l.l_orderkey analysis_id, concat('R00', cast(l.l_linenumber as varchar(4))) requirement_id,
               row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 pos,
               case when l_suppkey % 11 > 0 then su.s_name end source, case when l_quantity < 45 then cast(cast(l_quantity as int) as varchar(20)) end page,
               case when l_tax < 0.07 then round(l_discount / 3, 6) end score
        from lineitem l left join supplier su on su.s_suppkey = l.l_suppkey""",
    "evidence_v": """
        select l.l_orderkey analysis_id, concat('R00', cast(l.l_linenumber as varchar(4))) requirement_id,
               row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 pos,
               concat(' ', p.p_name, case when l_partkey % 5 = 0 then repeat(' and so on', 60) else '' end, ' ') quote
        from lineitem l join part p on p.p_partkey = l.l_partkey where l_partkey % 7 > 0""",
    "votes_v": """
        select event_id % 100 analysis_id, concat('R00', cast(1 + event_id % 7 as varchar(4))) requirement_id, user_id % 5 user_id,
               case event_type when 'purchase' then 'up' when 'error' then 'down' else 'none' end vote, concat('c', cast(event_id as varchar(20))) comment,
               ts updated_at, event_id from events where event_type in ('purchase', 'error', 'view')""",
    "corrections_v": """
        select analysis_id, id requirement_id, category, subdomain, title, 'covered' verdict, concat('answer ', title) answer, analysis_id % 5 user_id
        from requirements_v where analysis_id % 7 = 0 and id = 'R001'""",
    "jobs_v": """
        select event_id id, user_id % 4 source, user_id % 5 user_id, event_id % 40 cdc_id, ts finished_at,
               case event_type when 'purchase' then 'success' when 'error' then 'error' when 'click' then 'running'
                    when 'view' then 'queued' else 'cancelled' end status,
               case when event_type = 'error' then concat('failed at ', cast(event_id as varchar(20))) when event_type = 'click' and event_id % 3 = 0 then 'disk full' end error from events""",
    "correction_events_v": """
        select analysis_id, requirement_id, category, subdomain, title, case when (analysis_id + k) % 9 = 8 then 'perhaps' when k = 0 then 'covered' else 'partial' end verdict,
               case when (analysis_id + k) % 11 = 10 then ' ' else concat(' answer ', cast(k as varchar(4)), ' to ', title, ' ') end answer,
               case analysis_id % 3 when 0 then concat('  note ', title) when 1 then '  ' end notes, user_id, cast(analysis_id * 7919 % 1000 + k * (analysis_id % 3) as int) updated_at
        from corrections_v, (select 0 k union all select 1 k) r where k = 0 or analysis_id % 2 = 0""",
    "notifications_v": """
        select event_id id, user_id, event_type level, ts created_at, case when value < 20 then ts end read_at from events""",
    "messages_v": """
        select conv_id, turn, role, text, case when role = 'assistant' and conv_id % 7 = 3 then '{broken'
               when role = 'assistant' and conv_id % 2 = 0 then concat('[{"source":"src', cast(conv_id % 20 as varchar(20)), '","page":"', cast(turn as varchar(20)), '"},{"source":"kb"}]') end sources_json
        from conversations""",
    "threads_v": """
        select conv_id id, conv_id % 5 user_id, concat('about ', cast(conv_id as varchar(20))) title, conv_id * 7919 % 1000 updated_at from (select distinct conv_id from conversations) c
        union all select item_id + 1000000, item_id % 5, 'empty', item_id % 1000 from benchmark""",
    "message_feedback_v": """
        select conv_id, turn, cast((conv_id + turn * (1 + k) + k) % 3 as int) - 1 rating, conv_id % 5 user_id, k rated_at
        from conversations, (select 0 k union all select 1 k) r where role = 'assistant'""",
}


def needed(sql: str) -> list[str]:
    """Views that SQL reads, those it reads through others before it."""
    found: list[str] = []
    for name in re.findall(r"\b\w+_v\b", sql):
        if name in VIEWS:
            found += [v for v in [*needed(VIEWS[name]), name] if v not in found]
    return found


def with_views(sql: str) -> str:
    """DuckDB SQL with the definitions of all views that it reads in front."""
    defined = ",\n".join(f"{v} as ({VIEWS[v]})" for v in needed(sql))
    if not defined:
        return sql
    body = sql.strip()
    return f"with {defined},\n{body[4:]}" if body[:5].lower() == "with " else f"with {defined}\n{body}"


class Views:
    """Tables and views of an input directory as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            # A file of one row group is one task; texts are too much work for that.
            return spread(rows) if name in ("documents", "pages") else rows
        text = VIEWS[f"{name}_v"]
        used = [x for x in dict.fromkeys(re.findall(r"(?:from|join) (\w+)", text)) if x in TABLES or x in VIEWS]
        plain = text.replace("{", "{{").replace("}", "}}")  # the text is a pattern that table names are put into
        marked = re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], plain)
        return self.spark.sql(marked, **{x: getattr(self, x.removesuffix("_v") if x in VIEWS else x) for x in used})
