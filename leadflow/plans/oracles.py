"""The same results as independent DuckDB SQL, for the correctness check."""

from __future__ import annotations

from leadflow.operators.scoring import NEGATIVE_WORDS, POSITIVE_WORDS
from leadflow.plans.inputs import with_views

_SCORE_VIEWS = ["match_score_raw", "adopt_curve_raw"]
_PLAIN_INSIGHTS = [
    "relationship_fit", "archetypes", "lcv_level", "days_to_first_sale_level",
]


def _scores(raw: str, value: str) -> str:
    """Entity, key and score of a wide body, one row per key."""
    return f"""
        select entity_id, k, {value} as score
        from (select entity_id, body, unnest(json_keys(body)) as k from {raw})
        where k <> 'entity_id'"""


_MATCH = _scores(
    "match_score_raw",
    "cast(trunc(cast(json_extract_string(body, '$.' || k) as double)) as integer)",
)
_ADOPT = _scores("adopt_curve_raw", "cast(json_extract_string(body, '$.' || k) as double)")


def _score_text(rows: str) -> str:
    return f"""
        select entity_id, string_agg(k || ':' || cast(score as string), ',' order by k) as txt
        from ({rows}) group by entity_id"""


_CHANNEL_HISTORY = """
    select cast(user_id as string) as entity_id, event_type as preferences,
           max(ts) as ingestion_timestamp
    from events group by user_id, event_type"""
_PERSUASION_HISTORY = """
    select cast(o_custkey as string) as entity_id, o_orderstatus as persuasion,
           max(o_orderdate) + to_seconds(min(o_orderkey)) as ingestion_timestamp
    from orders group by o_custkey, o_orderstatus"""


def _newest(rows: str) -> str:
    return f"""
        select * from ({rows})
        qualify row_number() over (partition by entity_id order by ingestion_timestamp desc) = 1"""


def _profiles(kind: str, channel: str, persuasion: str) -> str:
    links = f"{kind}_entities_lk"
    names = ["entities", links, "channel", "persuasion", *_SCORE_VIEWS, *_PLAIN_INSIGHTS]
    return with_views(names, f"""
        select l.{kind}_id, e.entity_id, e.email, e.phone, e.twitter,
               m.txt as match_score, a.txt as adopt_curve,
               p.persuasion, c.preferences, rf.prediction as relationship_fit, ar.archetype,
               lcv.prediction as lcv_level, d.prediction as days_to_first_sale_level
        from entities e
        join {links} l on e.entity_id = l.entity_id
        left join ({_score_text(_MATCH)}) m on e.entity_id = m.entity_id
        left join ({_score_text(_ADOPT)}) a on e.entity_id = a.entity_id
        left join ({persuasion}) p on e.entity_id = p.entity_id
        left join ({channel}) c on e.entity_id = c.entity_id
        left join relationship_fit rf on e.entity_id = rf.entity_id
        left join archetypes ar on e.entity_id = ar.entity_id
        left join lcv_level lcv on e.entity_id = lcv.entity_id
        left join days_to_first_sale_level d on e.entity_id = d.entity_id""")


_CHANNEL = "select entity_id, array_to_string(preferences, '|') as preferences from channel"
_PERSUASION = "select entity_id, array_to_string(persuasion, '|') as persuasion from persuasion"

_FANOUT = with_views(["entities", "lead_entities_lk"], f"""
    select l.lead_id, e.entity_id, c.preferences, p.persuasion
    from entities e join lead_entities_lk l on e.entity_id = l.entity_id
    left join ({_CHANNEL_HISTORY}) c on e.entity_id = c.entity_id
    left join ({_PERSUASION_HISTORY}) p on e.entity_id = p.entity_id""")

_ASKED = """
    select 100000 + o_custkey from orders where o_orderpriority = '1-URGENT'
    union select 100001 + o_custkey from orders where o_orderpriority = '1-URGENT'"""

_NOW = "timestamp '1998-08-02 00:30:00'"
_RUNNING = f"""
    select client, file, src_table, start_date from data_source_status
    where status = 'running' and end_date is null
      and date_diff('hour', start_date, {_NOW}) <= 8760"""
_GATE = f"""
    select r.*, coalesce(s.status, 'UNKNOWN') as new_status
    from ({_RUNNING}) r left join reported_status s on r.file = s.file"""

_CONTACT_COLUMNS = """
    client, first_name, last_name, email, email2, email3, phone, phone2, phone3, twitter,
    city, state, zip, country"""

_LEAD_SCORES = """
    select lead_id, name,
           round(1 / (1 + exp(-(0.02 * age + 0.3 * engagement_score + 0.1 * page_views - 3))), 6)
               as lead_score
    from lead_features where processed"""


def _words(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        "len(list_filter(regexp_split_to_array(lower(feedback_text), '[^\\p{L}]+'), "
        f"lambda w: list_contains([{listed}], w)))"
    )


_MOODS = f"""
    select lead_id, turn,
           (good - bad) / greatest(good + bad, 1) as sentiment_score
    from (select lead_id, turn, {_words(POSITIVE_WORDS)} as good,
                 {_words(NEGATIVE_WORDS)} as bad
          from feedback where not sentiment_processed)"""


def _label(score: str) -> str:
    return f"""case when {score} > 0.25 then 'Positive' when {score} < -0.25 then 'Negative'
                    when {score} is not null then 'Neutral' end"""


_FEATURES = """list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"""


def _trained(rated: str, texts: str, texts_id: str) -> str:
    """Common parts: the model learnt from ``rated``, and the scores of ``texts``."""
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')"
    return f"""
        , totals as (
            select count(*) filter (positive) as p, count(*) filter (not positive) as n
            from {rated} where text is not null),
        model as (
            select feature, n_pos, n_neg,
                   ln(((n_pos + 1.0) / (p + 2.0)) / ((n_neg + 1.0) / (n + 2.0))) as weight
            from totals, (
                select feature, count(*) filter (positive) as n_pos, count(*) filter (not positive) as n_neg
                from (select positive, unnest({_FEATURES}) as feature
                      from (select positive, {words} as w from {rated} where text is not null))
                group by feature)
            where n_pos + n_neg >= 3 and abs(weight) >= 3 * sqrt(1 / (n_pos + 1.0) + 1 / (n_neg + 1.0))),
        scores as (
            select t.*, coalesce(tanh(total / sqrt(known) / 2), 0) as score
            from {texts} t left join (
                select {texts_id}, count(*) as known, sum(weight) as total
                from (select {texts_id}, unnest({_FEATURES}) as feature
                      from (select {texts_id}, {words} as w from {texts}))
                join model using (feature) group by {texts_id}) s using ({texts_id}))"""


_CHANGES = """
    select c_custkey, c_name,
           cast('199' || (c_custkey % 10) || '-01-02 03:04:05.5' as timestamp) as opened,
           case when c_custkey % 3 <> 0 then cast('198' || (c_custkey % 10) || '-12-31' as date) end
               as born,
           v.pos, v."at", v.n
    from customer,
         (select unnest([0, 1]) as pos) p,
         lateral (select p.pos as pos,
                         case when p.pos = 0 then timestamp '2020-01-01 00:00:00' end as "at",
                         case when p.pos = 0 then 1 else c_custkey % 5 end as n) v"""

_QUARANTINE = """
    select c_custkey,
           case c_nationkey when 3 then 'unreadable opened' when 4 then 'unknown extra'
                            when 5 then 'bad json' when 7 then 'unreadable marks' else '' end
               as error
    from customer"""

# The contact of a customer: which of its fields are at fault.
_CONTACT_ERRORS = """
    select c_custkey, c_name, lower(c_mktsegment) as segment, c_custkey % 13 = 4 as text_id,
           c_custkey % 13 <> 4 and c_custkey % 17 = 5 as no_id,
           c_custkey % 13 <> 4 and c_custkey % 10 = 3 as no_name,
           c_custkey % 13 <> 4 and c_custkey % 29 = 7 as aged
    from customer"""


_UPSERT = """
    with target as (
        select 'export' as dag_id, 'c-' || o_custkey as src_table,
               max(o_orderdate) as checkpoint
        from orders group by o_custkey),
    fresh as (
        select case when user_id % 2 = 0 then 'export' else 'import' end as dag_id,
               'c-' || user_id as src_table,
               max(ts) + interval '1' microsecond as checkpoint
        from events group by user_id)
    select coalesce(t.dag_id, f.dag_id) as dag_id,
           coalesce(t.src_table, f.src_table) as src_table,
           coalesce(f.checkpoint, t.checkpoint) as checkpoint
    from target t full join fresh f
        on t.dag_id = f.dag_id and t.src_table = f.src_table"""


def _history(now: str = _NOW) -> str:
    return with_views(["data_source_status", "reported_status"], f"""
        , changes as (select * from ({_GATE}) where new_status <> 'RUNNING')
        select h.client, h.file, h.src_table, h.status, h.start_date,
               case when c.file is not null and h.status = 'running' and h.end_date is null
                    then {now} else h.end_date end as end_date
        from data_source_status h left join changes c on h.file = c.file
        union all
        select client, file, src_table, lower(new_status), {now}, null from changes
        union all
        select 'new', 'g-' || o_orderkey, 'staging.zleads', 'running', {now}, null
        from orders where o_orderstatus = 'P'""")


def _import() -> str:
    return with_views(["data_source_status", "reported_status"], f"""
        , done as (
            select client, file, cast(substr(file, 3) as bigint) as k from ({_GATE})
            where new_status = 'SUCCEEDED')
        select 'e' || k as entity_id, k || '@example.com' as email, client, file
        from done where k % 5 > 1
        union all
        select 'x' || k, null, client, file from done where k % 5 > 1""")


def _sentiment_update() -> str:
    return with_views(["feedback"], f"""
        select f.lead_id, f.turn, f.sentiment_processed is not null as sentiment_processed,
               case when not f.sentiment_processed then {_label("m.sentiment_score")} end as sentiment_label,
               case when not f.sentiment_processed then round(m.sentiment_score, 6) end as sentiment_score,
               'skipped' as second_run
        from feedback f left join ({_MOODS}) m on f.lead_id = m.lead_id and f.turn = m.turn""")


def _site_visitors() -> str:
    return with_views(
        ["sites", "site_visitors_in", "users", "tracking_codes"], """
        select s.id as site_id, u.id as user_id, u.tree_user_id,
               t.third_party_tracking_company, t.tracking_code,
               v.visitor_id, v.last_visit_date, v.visit_count, v.ipaddress, v.browser_agent,
               v.created_at
        from sites s
        left join site_visitors_in v on s.id = v.site_id
        join users u on s.user_id = u.id
        left join tracking_codes t on u.id = t.user_id""")


def _priority() -> str:
    return with_views(["lead_features", "feedback"], f"""
        select s.lead_id, s.name, s.lead_score, m.score as sentiment_score,
               {_label("m.score")} as sentiment_label,
               case when lead_score >= 0.7 then 'hot' when lead_score >= 0.4 then 'warm'
                    else 'cold' end as tier,
               case when lead_score >= 0.7 and coalesce(m.score, 0) >= 0
                        then 'High Priority Lead'
                    when lead_score >= 0.7 then 'Review Manually Before Sales'
                    when coalesce(m.score, 0) >= 0.25 then 'Consider for Nurturing'
                    else 'Low Priority' end as final_priority
        from ({_LEAD_SCORES}) s
        left join (select lead_id, round(avg(sentiment_score), 6) as score
                   from ({_MOODS}) group by lead_id) m on s.lead_id = m.lead_id""")


def _merged() -> str:
    return with_views(["lead_features"], f"""
        select f.lead_id, f.name, f.processed, coalesce(s.lead_score, -1) as lead_score
        from lead_features f left join ({_LEAD_SCORES}) s on f.lead_id = s.lead_id""")


def oracles() -> dict[str, str]:
    return {
        "scan_select_alias": """
            select event_id, value * 2 as double_value, 'events' as tbl from events""",
        "filter_and_or": """
            select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders
            where o_totalprice > 300000 or (o_orderstatus = 'F' and o_orderpriority = '1-URGENT')""",
        "bound_query": """
            select o_orderkey, o_orderdate, o_totalprice from orders
            where o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderstatus in ('O', 'P')""",
        "time_window_between": """
            select event_id, ts as ingestion_timestamp from events
            where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'""",
        "export_projection": with_views(
            ["staging_contacts"], f"select {_CONTACT_COLUMNS} from staging_contacts"
        ),
        "tenant_id_filter": with_views(["entities", "lead_entities_lk"], """
            select l.lead_id, e.entity_id, e.client, e.email
            from entities e join lead_entities_lk l on e.entity_id = l.entity_id
            where e.client = 'BUILDING' and l.lead_id in (""" + _ASKED + ")"),
        "flag_filters": """
            select doc_id, quality = 1 as processed, toxic = 1 as sentiment_processed
            from documents natural join labels where quality = 1 and toxic <> 1""",
        "running_files": with_views(["data_source_status"], _RUNNING),
        "site_visitors": _site_visitors(),
        "site_visitors_increment": _site_visitors(),
        "lead_profiles": _profiles("lead", _CHANNEL, _PERSUASION),
        "requested_profiles": _profiles("lead", _CHANNEL, _PERSUASION) + f"""
            where e.client = 'BUILDING' and l.lead_id in ({_ASKED})""",
        "served_profiles": _profiles("lead", _CHANNEL, _PERSUASION) + f" where l.lead_id in ({_ASKED})",
        "lead_profiles_latest": _profiles(
            "lead", _newest(_CHANNEL_HISTORY), _newest(_PERSUASION_HISTORY)
        ),
        "profile_fanout": _FANOUT,
        "profile_fanout_split": _FANOUT,
        "contact_profiles": _profiles("contact", _CHANNEL, _PERSUASION),
        "upsert_checkpoint": _UPSERT,
        "keyed_upsert": _UPSERT,
        "latest_checkpoint": """
            select 'export' as dag_id, event_type as src_table, max(ts) as checkpoint
            from events group by event_type""",
        "upsert_duplicates": """
            select o_custkey, count(*) as n_orders,
                   case when count(*) = 1 then min(o_orderkey) end as only_order
            from orders group by o_custkey""",
        "pending_entities": with_views(["entities", "channel"], """
            select entity_id, client from entities e
            where not exists (
                select 1 from channel c where c.entity_id = e.entity_id
                and date_diff('hour', c.ingestion_timestamp, timestamp '2024-01-31 00:00:00') <= 48
            )"""),
        "cross_join_where": """
            select c_custkey, n_name, r_name as region
            from customer, nation left join region on n_regionkey = r_regionkey
            where c_nationkey = n_nationkey and c_acctbal > 0""",
        "checkpoint_window": """
            with cases as (
                select 'events' as target, timestamp '2024-01-03 00:00:00' as first_time,
                       (select max(ts) from (select ts from events
                            where ts >= timestamp '2024-01-03 00:00:00' order by ts limit 1000))
                           as last_time
                union all
                select 'orders', timestamp '1970-01-01 00:00:00',
                       (select max(o_orderdate) from
                            (select o_orderdate from orders order by o_orderdate limit 1000))
                union all
                select 'both', timestamp '1970-01-01 00:00:00',
                       (select max(t) from (select t from
                            (select ts as t, 'events' as tbl from events
                             union select o_orderdate, 'orders' from orders)
                            order by t limit 1000))
                union all
                select 'none', timestamp '1970-01-01 00:00:00', null)
            select *, last_time is not null as has_data from cases""",
        "union_distinct_sources": """
            select ts as ingestion_timestamp, 'events' as tbl from events
            union select o_orderdate, 'orders' from orders""",
        "incremental_export": with_views(["staging_contacts"], f"""
            select {_CONTACT_COLUMNS} from staging_contacts
            where ingestion_timestamp between timestamp '2024-01-03 00:00:00' and (
                select max(t) from (select ingestion_timestamp as t from staging_contacts
                    where ingestion_timestamp >= timestamp '2024-01-03 00:00:00'
                    order by t limit 1000))"""),
        "export_windows": with_views(["staging_contacts"], """
            , placed as (
                select ingestion_timestamp as t, row_number() over (order by ingestion_timestamp) as pos
                from staging_contacts),
            times as (select t, max(pos) as upto from placed group by t),
            ends as (
                with recursive e(t, upto) as (
                    select min(t), max(0) from placed where false
                    union all select timestamp '1900-01-01', 0
                    union all
                    select n.t, n.upto from e, lateral (
                        select t, upto from times where upto >= least(e.upto + 500, (select max(upto) from times))
                            and times.upto > e.upto
                        order by upto limit 1) n)
                select t, upto, coalesce(lag(t) over (order by upto), timestamp '1900-01-01') as before,
                       lag(upto) over (order by upto) as before_upto
                from e where t is not null)
            select case when before_upto = 0 then timestamp '1970-01-01' else before + interval '1' microsecond end
                       as first_time,
                   t as last_time, upto - before_upto as n
            from ends where upto > 0"""),
        "late_export": with_views(["staging_contacts"], """
            , passed as (select max(ingestion_timestamp) as t from staging_contacts where first_name <> 'click')
            select client, first_name, first_name = 'click' and ingestion_timestamp <= t as late, count(*) as n,
                   'done skipped skipped' as late_runs
            from staging_contacts, passed group by all"""),
        "export_job": with_views(["staging_contacts"], """
            select client, first_name, count(*) as n
            from staging_contacts group by client, first_name"""),
        "export_drain": with_views(["staging_contacts"], """
            select client, first_name, count(*) as n,
                   (select max(ingestion_timestamp) + interval '1' microsecond from staging_contacts)
                       as checkpoint,
                   (select count(*) > 2000 from staging_contacts) as several_windows
            from staging_contacts group by client, first_name"""),
        "export_leads": with_views(["staging_contacts"], f"""
            select {_CONTACT_COLUMNS}, cast(null as string) as gender, zip as age
            from staging_contacts"""),
        "export_moves": with_views(["staging_contacts"], """
            select client, case when client = 'MACHINERY' then 'failed' else 'processed' end as route,
                   count(*) as n
            from staging_contacts group by client"""),
        "export_routing": with_views(["data_source_status"], """
            select file as name,
                   case when status = 'running' then 'processed' else 'failed' end as route,
                   case when status = 'running' then 'up-' || file end as accepted_file
            from data_source_status"""),
        "stage_contacts": """
            select event_id as id, c_mktsegment as client, event_type as first_name, ts as seen_at,
                   case when event_id % 5 <> 0 then props end as upgraded,
                   timestamp '2024-02-01 10:00:00.25' as ingestion_timestamp
            from events join customer on user_id = c_custkey""",
        "late_rows": """
            select event_type, count(*) as late_rows, min(ts) as oldest
            from events where ts < timestamp '2024-01-16 00:00:00' group by event_type""",
        "status_history": _history(),
        "status_events": _history(),
        "status_as_of": with_views(["data_source_status"], """
            select client, file, src_table, status, start_date,
                   case when end_date <= timestamp '1996-06-01 12:00:00' then end_date end as end_date
            from data_source_status where start_date <= timestamp '1996-06-01 12:00:00'"""),
        "import_repeated_answers": with_views(["data_source_status"], f"""
            , last as (
                select 'f-' || l_orderkey as file, l_returnflag as flag from lineitem
                qualify row_number() over (partition by l_orderkey
                    order by l_shipdate + to_seconds(l_linenumber) desc,
                             case l_returnflag when 'A' then 2 when 'N' then 1 else 0 end desc) = 1),
            gate as (
                select r.file, case flag when 'N' then 'RUNNING' when 'A' then 'SUCCEEDED'
                                    when 'R' then 'FAILED' else 'UNKNOWN' end as new_status
                from ({_RUNNING}) r left join last s on r.file = s.file)
            select file, new_status, new_status = 'SUCCEEDED' as imports, new_status <> 'RUNNING' as changes
            from gate"""),
        "import_gate": _import(),
        "import_gate_events": _import(),
        "count_by_client": with_views(["entities"], """
            select client, count(*) as n, count(twitter) as with_twitter
            from entities group by client having count(*) > 10"""),
        "latest_per_key": """
            select event_id, ts, user_id, event_type, value from events
            qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
        "order_limit": """
            select o_orderkey, o_totalprice from orders
            order by o_totalprice desc nulls last, o_orderkey nulls first limit 100""",
        "file_order": """
            select case when o_orderkey % 3 = 0 then 'cdc-cust-' || o_orderkey
                        when o_orderkey % 3 = 1 then 'cdc-x' || o_orderkey
                        else 'plain' || o_orderkey end as file_name,
                   case when o_orderkey % 3 = 0 then o_orderkey end as suffix
            from orders""",
        "stored_query": """
            select o_orderpriority, count(*) as n from orders where o_totalprice > 100000 group by 1""",
        "load_counts": """
            select 'all' as load, count(*) as n from part union all select 'keys', count(*) from part
            union all select 'table', 3 * count(*) from part""",
        "run_spec": """
            select o_custkey, word, count(*) as n
            from (select o_custkey, unnest(string_split(o_orderpriority, '-')) as word
                  from orders where o_totalprice > 200000)
            group by o_custkey, word having count(*) > 1""",
        "hour_marks": """
            select l_orderkey, l_linenumber,
                   date_diff('hour', seen, timestamp '1998-08-02 00:30:00') as hours,
                   seen + interval '1' microsecond as next_checkpoint
            from (select l_orderkey, l_linenumber, l_shipdate + to_minutes(7 * l_orderkey) as seen
                  from lineitem)""",
        "stringify_timestamps": """
            select event_id,
                   case when microsecond(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S')
                        else strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end as ts,
                   strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_second,
                   strftime(ts, '%Y-%m-%d') as day,
                   case when event_id % 3 <> 0 then event_type end as note,
                   strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') as ts_fixed,
                   strftime(ts, '%Y-%m-%d') || ' 00:00:00.000000' as day_fixed
            from events""",
        "coerce_strings": """
            select event_id, t as as_datetime, cast(t as date) as as_date,
                   epoch(case when event_id % 16 in (5, 14, 15) then t - interval '2' hour else t end)
                       as epoch,
                   t is not null as is_date,
                   case when event_id % 16 = 3 then 'as_datetime,as_date,as_timestamp' else '' end
                       as bad
            from (select event_id, case
                      when event_id % 16 = 0 then ts
                      when event_id % 16 in (1, 2, 8, 11) then date_trunc('day', ts)
                      when event_id % 16 in (6, 9) then date_trunc('minute', ts)
                      when event_id % 16 not in (3, 4) then date_trunc('second', ts) end as t
                  from events)""",
        "nested_coerce": """
            select event_id, 'items.d' as bad, 0 as pos,
                   strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as d, event_id as n from events
            union all select event_id, 'items.d', 1, null, user_id from events
            union all select event_id, 'items.d', 2, null, 3 from events""",
        "decimal_text": """
            select o_orderkey, cast(cast(o_totalprice as decimal(15,2)) as string) as price,
                   cast(cast(cast(o_totalprice as decimal(15,2)) * 2 as decimal(16,2)) as string)
                       as double_price
            from orders""",
        "crypto_roundtrip": """
            select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer""",
        "match_scores": with_views(
            ["match_score_raw"], f"select entity_id, k as client, score from ({_MATCH})"
        ),
        "adopt_curve": with_views(
            ["adopt_curve_raw"], f"select entity_id, k as corpus, score from ({_ADOPT})"
        ),
        "id_list_parse": """
            select o_orderkey, o_orderkey % 11 <> 0 as valid,
                   case when o_orderkey % 11 <> 0 then pos end as pos,
                   case when o_orderkey % 11 <> 0
                        then case when pos = 0 then o_custkey else o_orderkey end end as id
            from orders, (select unnest([0, 1]) as pos)
            where pos = 0 or (o_orderkey % 11 <> 0 and o_custkey <> o_orderkey)""",
        "contact_validation": f"""
            select c_custkey,
                   case when errors = '' then c_custkey end as id,
                   case when errors = '' then segment end as first_name,
                   case when errors = '' then c_name end as last_name,
                   errors
            from (select *, concat_ws(';',
                      case when no_id then 'missing id' end,
                      case when no_name then 'missing last_name' end,
                      case when text_id then 'id is not bigint' end,
                      case when aged then 'unknown age' end) as errors
                  from ({_CONTACT_ERRORS}))""",
        "contact_upload": f"""
            with good as (select * from ({_CONTACT_ERRORS})
                          where not text_id and not no_id and not no_name and not aged)
            select c_custkey as id, segment as first_name, c_name as last_name,
                   cast(null as string) as email, 'acme' as client,
                   timestamp '2024-02-01 00:00:00' as ingestion_timestamp from good
            union all
            select c_custkey + 1000000, 'x', 'y', null, 'acme', timestamp '2024-02-01 00:00:00'
            from good""",
        "name_parts": with_views(["entities"], """
            select entity_id, 'staging.contacts-' || client || '-' || file as export_name, client,
                   'zleads' as table_name, substr(file, 6) as stripped, file as relative,
                   sha256(entity_id) as pseudonym
            from entities"""),
        "ns_timestamps": """
            select event_id, case when event_id % 4 < 2 then ts end as expires,
                   event_id % 4 >= 2 or ts < timestamp '2024-01-16 00:00:00' as expired
            from events""",
        "insight_fetch": with_views(["entities", "insight_answers"], """
            select entity_id, 'corex' as client,
                   cast(trunc(cast(json_extract_string(scores, '$.corex') as double)) as integer) as score
            from entities natural join insight_answers where code = 200
            union all
            select entity_id, 'acme', cast(json_extract_string(scores, '$.acme') as integer)
            from entities natural join insight_answers where code = 200"""),
        "insight_refresh": with_views(["insight_answers"], """
            , answers as (
                select entity_id, timestamp '2024-02-01 00:00:00' as ingestion_timestamp, c.*
                from insight_answers join customer c on entity_id = cast(c_custkey as string)
                where code = 200)
            select 'match_score' as insight, entity_id, ingestion_timestamp,
                   'acme:' || c_nationkey || ',corex:' || cast(trunc(c_acctbal) as integer) as value
            from answers
            union all
            select 'adopt_curve', entity_id, ingestion_timestamp,
                   'acme:' || c_nationkey || '.0,corex:' || c_acctbal from answers
            union all
            select 'persuasion', entity_id, ingestion_timestamp, c_mktsegment from answers
            union all
            select 'channel', entity_id, ingestion_timestamp, c_mktsegment || '|' || c_nationkey
            from answers
            union all
            select 'relationship_fit', entity_id, ingestion_timestamp, c_mktsegment from answers
            union all
            select 'archetypes', entity_id, ingestion_timestamp, lower(c_mktsegment) from answers"""),
        "lead_scores": with_views(["lead_features"], _LEAD_SCORES),
        # Newton steps for three weights, the equations solved by determinants
        "lead_model": with_views(["lead_features", "lcv_level"], """
            , d as (
                select engagement_score as x, cast(age as double) as w,
                       case when prediction = 'high' then 1.0 else 0.0 end as y
                from lead_features join lcv_level on lead_id = cast(entity_id as bigint)),
            fitted as (
                with recursive r(i, a, b, c) as (
                    select 0, cast(0 as double), cast(0 as double), cast(0 as double)
                    union all
                    select i + 1,
                        a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
                        b + (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
                        c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
                    from (
                        select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02)
                            + h02 * (h01 * h12 - h11 * h02) as det
                        from (
                            select i, a, b, c, sum(y - p) as g0, sum((y - p) * x) as g1, sum((y - p) * w) as g2,
                                   sum(p * (1 - p)) as h00, sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * w) as h02,
                                   sum(p * (1 - p) * x * x) as h11, sum(p * (1 - p) * x * w) as h12,
                                   sum(p * (1 - p) * w * w) as h22
                            from (select r.*, x, w, y, 1 / (1 + exp(-(a + b * x + c * w))) as p from r, d where i < 15)
                            group by i, a, b, c)))
                select * from r where i = 15)
            select 'intercept' as term, round(a, 6) as weight from fitted
            union all select 'engagement_score', round(b, 6) from fitted
            union all select 'age', round(c, 6) from fitted"""),
        "lead_scores_columns": with_views(
            ["lead_features"], f"select lead_id, lead_score from ({_LEAD_SCORES})"
        ),
        "sentiment": with_views(["feedback"], f"""
            select lead_id, turn, round(sentiment_score, 6) as sentiment_score,
                   {_label("sentiment_score")} as sentiment_label,
                   round(abs(sentiment_score), 6) as sentiment_strength
            from ({_MOODS})"""),
        "sentiment_update": _sentiment_update(),
        "sentiment_update_keyed": _sentiment_update(),
        "sentiment_model": with_views(["rated"], _trained("rated", "rated", "id") + """
            select feature, n_pos, n_neg, round(weight, 9) as weight from model"""),
        "sentiment_held_out": with_views(["rated"], """
            , folds as (
                select *, cast('0x' || substr(md5(cast(id as string)), 1, 8) as bigint) % 5 as fold from rated),
            learnt as (select * from folds where fold <> 0),
            tested as (select * from folds where fold = 0 and text is not null)"""
            + _trained("learnt", "tested", "id") + " select id, positive, round(score, 6) as score from scores"),
        "sentiment_model_scores": with_views(
            ["rated", "feedback"], ", texts as (select lead_id, turn, feedback_text as text, lead_id || '-' || turn as id "
            "from feedback)" + _trained("rated", "texts", "id") + """
            select lead_id, turn, round(score, 6) as sentiment_score, round(abs(score), 6) as sentiment_strength
            from scores"""),
        "priority": _priority(),
        "stream_priorities": _priority(),
        "drift_quantiles": """
            with cuts as (
                select event_type, quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts
                from events where ts < timestamp '2024-01-16 00:00:00' group by event_type),
            counts as (
                select event_type, len(list_filter(cuts, lambda x: x < value)) as bin,
                       count(*) filter (ts < timestamp '2024-01-16 00:00:00') as r,
                       count(*) filter (ts >= timestamp '2024-01-16 00:00:00') as c
                from events join cuts using (event_type) group by all),
            shares as (
                select event_type,
                       greatest(r / sum(r) over (partition by event_type), 1e-4) as r,
                       greatest(c / sum(c) over (partition by event_type), 1e-4) as c
                from counts)
            select event_type, round(sum((c - r) * ln(c / r)), 6) as psi, true as within
            from shares group by event_type""",
        "drift_distance": """
            with marked as (
                select event_type, value, ts < timestamp '2024-01-16 00:00:00' as ref from events),
            upto as (
                select event_type,
                       count(*) filter (ref) over (partition by event_type order by value) as r,
                       count(*) filter (not ref) over (partition by event_type order by value) as c,
                       count(*) filter (ref) over (partition by event_type) as r_all,
                       count(*) filter (not ref) over (partition by event_type) as c_all
                from marked)
            select event_type, max(r_all) as r, max(c_all) as c,
                   round(max(abs(r * c_all - c * r_all)) / max(r_all) / max(c_all), 9) as distance
            from upto group by event_type""",
        "drift_psi": """
            with counts as (
                select event_type, least(greatest(floor(value / 100 * 10), -1), 10) as bucket,
                       count(*) filter (ts < timestamp '2024-01-16 00:00:00') as r,
                       count(*) filter (ts >= timestamp '2024-01-16 00:00:00') as c
                from events group by all),
            shares as (
                select event_type,
                       greatest(r / sum(r) over (partition by event_type), 1e-4) as r,
                       greatest(c / sum(c) over (partition by event_type), 1e-4) as c
                from counts)
            select event_type, round(sum((c - r) * ln(c / r)), 6) as psi
            from shares group by event_type""",
        "merge_scores": with_views(["lead_features"], f"""
            select f.lead_id, f.name, f.processed, s.lead_score
            from lead_features f left join ({_LEAD_SCORES}) s on f.lead_id = s.lead_id"""),
        "merge_predictions": _merged(),
        "keyed_merge": _merged(),
        "csv_export_readback": with_views(["staging_contacts"], f"""
            select cast(id as string) as id, {_CONTACT_COLUMNS},
                   case when microsecond(ingestion_timestamp) % 1000000 = 0
                        then strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S')
                        else strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S.%f') end
                       as ingestion_timestamp
            from staging_contacts"""),
        "append_aligned": """
            select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey,
                   cast(null as string) as note from customer
            union all select c_custkey, null, null, lower(c_mktsegment) from customer
            union all select -1, null, null, 'it''s'""",
        "cdc_to_lake": _CHANGES,
        "cdc_rerun": f"select *, 'skipped done done skipped' as runs from ({_CHANGES})",
        "cdc_batch_and_stream": _CHANGES,
        "cdc_two_checkpoints": f"select *, 1 as refused from ({_CHANGES})",
        "cdc_quarantine": _QUARANTINE,
        "cdc_stream_quarantine": _QUARANTINE,
        "stream_cdc": _CHANGES,
        "stream_scoring": with_views(["lead_features"], _LEAD_SCORES),
    }
