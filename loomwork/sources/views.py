"""The memory tables that the registered queries work on, derived row by row from the given tables.

Each view is one SELECT that Spark and DuckDB both understand but for a few functions, written <name:argument>; dialect() puts
them in. So a query's oracle reads the same rows by the same rule, and every view grows with its table. Numbers that a table
lacks are plain arithmetic on its key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomwork.session import table

#: The "now" of all registered queries.
NOW = "2024-01-31 00:00:00"
NOW_SECONDS = 1706659200
START_SECONDS = 1704067200

_SPARK = {"ts": "timestamp_seconds({})", "list": "array({})", "json": "cast(get_json_object({}, '$.k') as bigint)"}
_DUCK = {"ts": "make_timestamp(({}) * 1000000)", "list": "[{}]", "json": "cast(json_extract_string({}, '$.k') as bigint)"}

VIEWS = {
    "memories": """
select doc_id as memory_id, source as user_id, concat('p', doc_id % 4) as project_id, cast(floor(doc_id / 10) as bigint) as session_id,
  concat('agent', doc_id % 8) as agent_id, text as raw,
  case lang when 'en' then 'SESSION' when 'fr' then 'PROJECT' when 'de' then 'IDENTITY' when 'es' then 'TASK' else 'INSIGHT' end as layer,
  case when doc_id % 7 = 0 then null when doc_id % 5 = 0 then 'FACT' when doc_id % 5 = 1 then 'PREFERENCE' when doc_id % 5 = 2 then 'TASK' when doc_id % 5 = 3 then 'CONSTRAINT' else 'LESSON' end as memory_type,
  cast(1 + doc_id % 4 as int) as priority, cast((doc_id * 37) % 101 as double) / 100 as importance, cast((doc_id * 53) % 101 as double) / 100 as effective,
  cast(50 + (doc_id * 29) % 51 as double) / 100 as confidence, doc_id % 61 = 0 as safety_critical, doc_id % 47 = 0 as user_pinned,
  doc_id % 43 = 0 as user_hidden, doc_id % 41 <> 0 as searchable, case when doc_id % 53 = 0 then 'DUPLICATE' else 'DONE' end as embedding_status,
  (doc_id * 11) % 9 as retrieval_count, (doc_id * 13) % 7 as used_count, (doc_id * 17) % 5 as unused_count,
  <ts:1704067200 + (doc_id * 7919) % 2592000> as created_at,
  case when doc_id % 3 = 0 then null else <ts:1704067200 + (doc_id * 7919) % 2592000 - (doc_id % 5) * 86400> end as observed_at,
  case when (doc_id * 11) % 9 = 0 then null else <ts:least(1706659200, 1704067200 + (doc_id * 7919) % 2592000 + ((doc_id * 31) % 20) * 86400)> end as last_retrieved_at,
  case when (doc_id * 13) % 7 = 0 then null else <ts:least(1706659200, 1704067200 + (doc_id * 7919) % 2592000 + ((doc_id * 23) % 20) * 86400)> end as last_used_at,
  case when doc_id % 29 = 0 then <ts:1704067200 + (doc_id * 7919) % 2592000 + 3600> end as deleted_at,
  case when doc_id % 31 = 0 then doc_id + 1 end as superseded_by, case when doc_id % 37 = 0 then doc_id - 1 end as is_duplicate_of,
  case when doc_id % 59 = 0 then doc_id + 2 end as consolidated_into,
  case when doc_id % 13 = 0 then 'CONSOLIDATION' when doc_id % 11 = 0 then 'CORRECTION' else 'EXPLICIT_STATEMENT' end as origin,
  <list:concat('tag', doc_id % 6), concat('arc', doc_id % 9)> as tags
from documents""",
    "vectors": """
select vec_id, cast(label as bigint) as user_id, embedding, concat('m', vec_id % 3) as model_id, cast((vec_id * 37) % 101 as double) / 100 as importance,
  <ts:1704067200 + (vec_id * 7919) % 2592000> as created_at from embeddings""",
    "calls": """
select event_id, ts, user_id, event_type, value, <json:props> as k, concat('agent', user_id % 12) as agent_id, concat('t', <json:props> % 5) as topic from events""",
    "tasks": """
select o_orderkey as task_id, concat('agent', o_custkey % 40) as agent_id, o_orderpriority as domain, o_custkey as delegator,
  case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'FAILURE' else 'PARTIAL' end as outcome, cast(o_orderkey * 37 % 5000 as bigint) as duration_ms,
  case when o_orderkey % 3 = 0 then 'timeout waiting' when o_orderkey % 3 = 1 then 'tool error' else 'wrong answer' end as reason,
  <ts:1704067200 + (o_orderkey * 7919) % 2592000> as created_at from orders""",
    "edges": """
select distinct cast(l_suppkey as bigint) as source_id, cast(l_partkey as bigint) % 50 as target_id, case when l_linenumber % 2 = 0 then 'USES' else 'KNOWS' end as edge_type
from lineitem where l_suppkey <> l_partkey % 50""",
    "hits": """
select query_id, variant, source, doc_id, score, cast(row_number() over (partition by query_id, variant order by score desc, doc_id) as int) as rank
from (select user_id as query_id, concat('v', event_id % 4) as variant, case event_id % 4 when 0 then 'original' when 1 then 'rules' else 'llm' end as source,
  <json:props> as doc_id, max(cast((event_id * 37) % 101 as double) / 100) as score from events group by 1, 2, 3, 4) as found""",
    "turns": "select conv_id, turn, role, text from conversations",
}


def dialect(sql: str, spark: bool) -> str:
    names = _SPARK if spark else _DUCK

    def put(m: re.Match) -> str:
        return names[m[1]].format(m[2])

    return re.sub(r"<(ts|list|json):((?:[^<>]|<[^<>]*>|[<>]=?(?= ))*?)>(?=[\s,)]|$)", put, sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the columns that a query takes are read."""
    sql = dialect(VIEWS[name], True)
    base = re.search(r"from (\w+)", sql)[1]
    source = re.search(rf"\bfrom {base}\b", sql)
    sql = sql[: source.start()] + "from {base}" + sql[source.end() :]
    return spark.sql(sql, base=table(spark, sf_dir, base))


def view_sql(*names: str) -> str:
    """`with a as (...), b as (...)` for DuckDB."""
    return "with " + ", ".join(f"{n} as ({dialect(VIEWS[n], False)})" for n in names)
