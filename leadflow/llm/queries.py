"""The registered queries of the operators, with production parameters over whole tables, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm import (
    collocations, decontaminate, divergence, html_text, language_id, mixing, quality, secret_scan, simhash,
    substring_dedup, token_counts, topk_search, url_filter,
)
from leadflow.llm.common import table

#: Target weights of the mixing query; what isn't named weighs 1.
MIX_WEIGHTS = {
    "domain": {"web": 3, "books": 2, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2},
}


def mix_domain():
    """The domain of a source: by its number, three of them."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 3
    return F.when(number == 0, "web").when(number == 1, "books").otherwise("forum")


def op1_topk_search(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", topk_search.quantised("embedding").alias("v"))
    return topk_search.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op2_simhash(spark, sf) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=3, distance=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_mixing(spark, sf) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), mix_domain(), MIX_WEIGHTS, share=0.5, max_epochs=4, seed=7)


def op4_url_filter(spark, sf) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages").select("page_id", "url"))


def op5_language_id(spark, sf) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents"))


def op6_decontamination(spark, sf) -> DataFrame:
    found = decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def op7_secret_scan(spark, sf) -> DataFrame:
    found = secret_scan.scan(table(spark, sf, "documents"))

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op8_substring_dedup(spark, sf) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf, "documents"))


def op9_quality(spark, sf) -> DataFrame:
    ratings = table(spark, sf, "labels").select("doc_id", quality.grade().alias("grade"))
    return quality.classify(table(spark, sf, "documents"), ratings)


def op10_html_text(spark, sf) -> DataFrame:
    return html_text.extract_pages(table(spark, sf, "pages"))


def op11_collocations(spark, sf) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"), longest=3, least=10, share=50, top=2_000)


def op12_token_counts(spark, sf) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf, "documents"), path, limit=4096).drop("prefix")


def op13_divergence(spark, sf) -> DataFrame:
    return divergence.divergence(table(spark, sf, "documents"), least_docs=3, top=200)


def registered() -> dict:
    own = [
        op1_topk_search, op2_simhash, op3_mixing, op4_url_filter, op5_language_id, op6_decontamination,
        op7_secret_scan, op8_substring_dedup, op9_quality, op10_html_text, op11_collocations, op12_token_counts,
        op13_divergence,
    ]
    return {f.__name__: f for f in own}


OP1_SQL = """
with rows as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.r as query_row, q.vec_id as query_id, r.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from rows q join rows r on q.r <> r.r and len(q.v) = len(r.v)
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_row order by score desc, vec_id) as rank from scored)
where rank <= 5
"""

# budgets go down the tree level by level, as in mixing.budgets: the children of a node in order of fullness
_LEVEL = """
{name}_0 as (
  select {keys}, sum(takes) as takes, max({weight}) as w from leaves group by {keys}
), {name}_1 as (
  select c.*, p.granted,
    coalesce(sum(takes) over (partition by {above} order by takes / w, {level}
      rows between unbounded preceding and 1 preceding), 0) as filled,
    sum(w) over (partition by {above} order by takes / w, {level}
      rows between current row and unbounded following) as left_w
  from {name}_0 c join {parent} p using ({above})
), {name}_2 as (
  select *, takes * left_w <= w * (granted - filled) as filled_up from {name}_1
), {name}_3 as (
  select *, coalesce(sum(case when filled_up then takes end) over (partition by {above}), 0) as used,
    sum(case when not filled_up then w end) over (partition by {above}) as open_w
  from {name}_2
), {name} as (
  select {keys}, case when filled_up then takes else (w * (granted - used)) // open_w end as granted from {name}_3
)"""


def _case(level: str) -> str:
    whens = " ".join(f"when {level} = '{k}' then {w}" for k, w in sorted(MIX_WEIGHTS[level].items()))
    return f"case {whens} else 1 end"


def _op3_sql() -> str:
    levels, parts, above, parent = ["domain", "lang", "source"], [], ["root"], "top"
    for i, level in enumerate(levels):
        keys = ["root", *levels[: i + 1]]
        parts.append(_LEVEL.format(
            name=f"n{i}", keys=", ".join(keys), weight=_case(level), above=", ".join(above), level=level, parent=parent
        ))
        above, parent = keys, f"n{i}"
    return f"""
with rows as (
  select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
    case coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as integer), 0) % 3
      when 0 then 'web' when 1 then 'books' else 'forum' end as domain,
    cast(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens
  from documents
), named as (select * from rows where n_tokens > 0
), held as (select domain, lang, source, cast(sum(n_tokens) as bigint) as held from named group by all
), leaves as (select *, 0 as root, held * 4 as takes from held
), top as (select 0 as root, least(sum(takes), cast(floor(sum(held) * 0.5) as bigint)) as granted from leaves
),{",".join(parts)},
plan as (
  select domain, lang, source, cast(granted // held as bigint) as whole, cast(granted % held as bigint) as rest
  from n2 join held using (domain, lang, source) where granted > 0
), placed as (
  select n.*, whole, rest,
    md5('7:' || whole || ':' || coalesce(cast(doc_id as varchar), 'null')) as place
  from named n join plan using (domain, lang, source)
), started as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place, n_tokens
    rows between unbounded preceding and 1 preceding), 0) as start
  from placed
)
select doc_id, domain, lang, source, cast(epoch as bigint) as epoch, n_tokens, n_tokens as n_taken
from (select *, unnest(range(whole)) as epoch from placed)
union all
select doc_id, domain, lang, source, whole, n_tokens, cast(least(n_tokens, rest - start) as bigint)
from started where start < rest
"""


OP6_SQL = """
with words as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), items as (
  select coalesce(cast(item_id as varchar), 'null') as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark
), item_windows as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as k
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
), lengths as (select distinct n from item_windows
), doc_windows as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') as k
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)
), met as (
  select r, i, d.n, item from doc_windows d join item_windows using (n, k)
), hit as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from met) group by r
), held as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item from met) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (r) left join held using (r)
"""


OP11_SQL = """
with pieces as (
  select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w
  from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) as p
    from documents
  )
), grams as (
  select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase, cast(count(*) as hugeint) as f
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces, range(1, 4) t(m) where len(w) >= m)
  group by all
), totals as (select lang, sum(f) as n from grams where m = 1 group by lang
), candidates as (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as w from grams where m >= 2 and f >= 10
), cuts as (
  select lang, phrase, a, k, array_to_string(w[1 : k], ' ') as lp, array_to_string(w[k + 1 : m], ' ') as rp
  from (select *, unnest(range(1, m)) as k from candidates)
), scored as (
  select c.lang, c.phrase, a, k, l.f as l, r.f as r, (1000000 * a * a) // (l.f * r.f) as score
  from cuts c join grams l on c.lang = l.lang and c.lp = l.phrase join grams r on c.lang = r.lang and c.rp = r.phrase
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), held as (
  select lang, array_to_string(w[i : i + 1], ' ') as phrase, max(a) as longer
  from (select lang, a, w, unnest([1, 2]) as i from candidates where m = 3) group by all
), ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join held h on b.lang = h.lang and b.phrase = h.phrase
  where longer is null or 100 * longer < 50 * a
)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
  cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""


OP13_SQL = """
with found as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
  from documents
), grps as (select distinct lang, source from found
), words as (select d, lang, source, unnest(w) as term from found
), vocabulary as (
  select lang, term, count(*) as all_n from words group by lang, term having count(distinct d) >= 3
), sizes as (select lang, count(*) as v, sum(all_n) as lang_n from vocabulary group by lang
), held as (
  select lang, source, term, count(*) as n from words semi join vocabulary using (lang, term) group by all
), sums as (
  select g.lang, g.source, cast(coalesce(sum(n), 0) as hugeint) as group_n
  from grps g left join held using (lang, source) group by all
), p as (
  select s.lang, s.source, y.term, coalesce(h.n, 0) as n, y.all_n, z.v, z.lang_n,
    1 + (cast(1000000000 as hugeint) * (coalesce(h.n, 0) + 1)) // (group_n + v) as p,
    1 + (cast(1000000000 as hugeint) * (y.all_n + 1)) // (cast(lang_n as hugeint) + v) as pl
  from sums s join vocabulary y using (lang) join sizes z using (lang)
    left join held h on h.lang = s.lang and h.source = s.source and h.term = y.term
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), all_pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from grps a join grps b on a.lang = b.lang and a.source <> b.source
    left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
), by_term as (
  select lang, source, 'term' as part, term as item, (p - pl) * (p - pl) // pl as value from p where n > 0 and p > pl
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from all_pairs union all select * from by_term)
) where part = 'pair' or rank <= 200
"""


def oracles() -> dict[str, str]:
    return {
        "op1_topk_search": OP1_SQL, "op3_mixing": _op3_sql(), "op6_decontamination": OP6_SQL,
        "op11_collocations": OP11_SQL, "op13_divergence": OP13_SQL,
    }
