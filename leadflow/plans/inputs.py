"""The lead tables, derived from the provided test tables.

The texts are plain SQL that Spark and DuckDB read alike; ``{customer}`` and the
like stand for the provided tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "entities": """
        select cast(c_custkey as string) as entity_id, c_mktsegment as client,
               concat(lower(replace(c_name, '#', '.')), '@example.com') as email,
               concat('+1', cast(5550000000 + c_custkey as string)) as phone,
               case when c_custkey % 3 = 0 then concat('@c', cast(c_custkey as string)) end
                   as twitter,
               concat('file-', cast(c_custkey % 7 as string), '.csv') as file
        from {customer}""",
    "lead_entities_lk": """
        select 100000 + c_custkey as lead_id, cast(c_custkey as string) as entity_id
        from {customer}""",
    "contact_entities_lk": """
        select 200000 + s_suppkey as contact_id, cast(s_suppkey * 3 as string) as entity_id
        from {supplier}""",
    "channel": """
        select cast(user_id as string) as entity_id,
               array_sort(array_agg(distinct event_type)) as preferences,
               max(ts) as ingestion_timestamp
        from {events} group by user_id""",
    "match_score_raw": """
        select cast(user_id as string) as entity_id,
               concat('{{"entity_id":"', cast(user_id as string), '","corex":',
                      cast(coalesce(max(case when event_type = 'click' then value end), 0)
                           as string),
                      ',"acme":',
                      cast(coalesce(max(case when event_type = 'view' then value end), 0)
                           as string), '}}') as body,
               max(ts) as ingestion_timestamp
        from {events} group by user_id""",
    "adopt_curve_raw": """
        select cast(user_id as string) as entity_id,
               concat('{{"entity_id":"', cast(user_id as string), '","news":',
                      cast(coalesce(min(case when event_type = 'signup' then value end), 0)
                           as string),
                      ',"social":',
                      cast(coalesce(min(case when event_type = 'purchase' then value end), 0)
                           as string), '}}') as body,
               max(ts) as ingestion_timestamp
        from {events} group by user_id""",
    "insight_answers": """
        select entity_id, case when c_acctbal < 0 then 204 when c_acctbal < 100 then 402 else 200 end as code,
               concat('{{"entity_id":"', entity_id, '","corex":', cast(c_acctbal as string),
                      ',"acme":', cast(c_nationkey as string), '}}') as scores,
               concat('{{"entity_id":"', entity_id, '","persuasion":["', c_mktsegment, '"]}}') as persuasion,
               concat('{{"entity_id":"', entity_id, '","preferences":["', c_mktsegment, '","',
                      cast(c_nationkey as string), '"]}}') as channel,
               concat('{{"entity_id":"', entity_id, '","prediction":"', c_mktsegment, '"}}') as relationship_fit,
               concat('{{"entity_id":"', entity_id, '","archetype":"', lower(c_mktsegment), '"}}') as archetypes
        from (select cast(c_custkey as string) as entity_id, c_acctbal, c_nationkey, c_mktsegment
              from {customer}) c""",
    "persuasion": """
        select cast(o_custkey as string) as entity_id,
               array_sort(array_agg(distinct o_orderpriority)) as persuasion,
               max(o_orderdate) as ingestion_timestamp
        from {orders} group by o_custkey""",
    "relationship_fit": """
        select cast(c_custkey as string) as entity_id,
               case when c_acctbal < 0 then 'poor' when c_acctbal < 5000 then 'fair'
                    else 'good' end as prediction
        from {customer} where c_custkey in (select o_custkey from {orders})""",
    "archetypes": """
        select cast(c_custkey as string) as entity_id, n_name as archetype
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "lcv_level": """
        select cast(o_custkey as string) as entity_id,
               case when max(o_totalprice) > 400000 then 'high' else 'low' end as prediction
        from {orders} group by o_custkey""",
    "days_to_first_sale_level": """
        select cast(o_custkey as string) as entity_id,
               case when min(o_orderdate) < timestamp '1995-07-01 00:00:00' then 'short'
                    else 'long' end as prediction
        from {orders} group by o_custkey""",
    "data_source_status": """
        select c_mktsegment as client, concat('f-', cast(o_orderkey as string)) as file,
               case when o_orderkey % 2 = 0 then 'staging.zleads' else 'staging.contacts' end
                   as src_table,
               case o_orderstatus when 'O' then 'running' when 'F' then 'succeeded'
                    else 'failed' end as status,
               o_orderdate as start_date,
               case when o_orderstatus <> 'O' then o_orderdate + interval '1' day end as end_date
        from {orders} join {customer} on o_custkey = c_custkey""",
    "reported_status": """
        select concat('f-', cast(o_orderkey as string)) as file,
               case when o_orderkey % 3 = 0 then 'SUCCEEDED'
                    when o_orderkey % 3 = 1 then 'RUNNING' end as status
        from {orders}""",
    "staging_contacts": """
        select event_id as id, c_mktsegment as client, event_type as first_name,
               c_name as last_name,
               concat('c', cast(c_custkey as string), '@example.com') as email,
               cast(null as string) as email2,
               case when event_id % 2 = 0 then '' end as email3,
               concat('+1', cast(5550000000 + c_custkey as string)) as phone,
               cast(null as string) as phone2, cast(null as string) as phone3,
               concat('@', lower(replace(c_name, '#', '"'))) as twitter,
               concat('city', chr(92), cast(c_nationkey as string)) as city,
               props as state, cast(c_nationkey as string) as zip,
               ' padded ' as country, ts as ingestion_timestamp
        from {events} join {customer} on user_id = c_custkey""",
    "sites": "select s_suppkey as id, s_nationkey as user_id from {supplier}",
    "site_visitors_in": """
        select l_suppkey as site_id, l_orderkey as visitor_id, l_shipdate as last_visit_date,
               cast(l_quantity as bigint) as visit_count,
               concat('10.0.', cast(l_linenumber as string), '.', cast(l_orderkey % 256 as string))
                   as ipaddress,
               l_returnflag as browser_agent, l_shipdate - interval '1' day as created_at
        from {lineitem}""",
    "users": """
        select n_nationkey as id, n_regionkey as tree_user_id
        from {nation} where n_nationkey in (select s_nationkey from {supplier})""",
    "tracking_codes": """
        select n_nationkey as user_id, 'ga' as third_party_tracking_company,
               concat('trk-', n_name) as tracking_code
        from {nation} where n_nationkey in
            (select c_nationkey from {customer} group by c_nationkey having min(c_acctbal) < -900)""",
    "lead_features": """
        select c_custkey as lead_id, c_name as name, 18 + c_custkey % 60 as age,
               coalesce(n_orders, 0) / 10.0E0 as engagement_score,
               coalesce(n_views, 0) as page_views,
               n_orders is not null or n_views is not null as processed
        from {customer}
        left join (select o_custkey, count(*) as n_orders from {orders} group by o_custkey) o
            on c_custkey = o_custkey
        left join (select user_id, count(*) as n_views from {events}
                   where event_type = 'view' group by user_id) e on c_custkey = user_id""",
    "feedback": """
        select c.conv_id as lead_id, c.turn, c.text as feedback_text,
               a.turn is not null as sentiment_processed, cast(null as string) as sentiment_label,
               cast(null as double) as sentiment_score
        from {conversations} c
        left join (select distinct conv_id, turn from {conversations} where role = 'assistant') a
            on c.conv_id = a.conv_id and c.turn + 1 = a.turn
        where c.role = 'user'""",
    "rated": """
        select d.doc_id as id, d.text, quality = 1 and toxic = 0 as positive
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
}


def base(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table as a frame."""
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: base(spark, folder, t) for t in used})


def with_views(names: list[str], select: str) -> str:
    """DuckDB text of a query over derived tables. The query may start with ``,`` and
    further named parts."""
    tables = {t: t for t in BASE_TABLES}
    return f"with {', '.join(f'{n} as ({VIEWS[n].format(**tables)})' for n in names)} {select}"
