"""The joined results: profiles, site visitors, entities waiting for an insight."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.timestamps import hours_before
from leadflow.operators.latest import latest_per_key
from leadflow.operators.skew import HOT_ROWS, hot_keys, product, split_join

# Insight table -> its value column and the name it has in the joined row.
INSIGHT_VALUES = {
    "channel": ("preferences", "preferences"),
    "match_score": ("scores", "match_scores"),
    "adopt_curve": ("scores", "adopt_scores"),
    "persuasion": ("persuasion", "persuasion"),
    "relationship_fit": ("prediction", "relationship_fit"),
    "archetypes": ("archetype", "archetype"),
    "lcv_level": ("prediction", "lcv_level"),
    "days_to_first_sale_level": ("prediction", "days_to_first_sale_level"),
}


def select_ids(df: DataFrame, column: str, ids: Sequence[int] | DataFrame | None) -> DataFrame:
    """Rows whose id is in a short list or in a frame with the same column."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column).distinct(), column, "left_semi")
    # An empty list selects nothing.
    return df.filter(F.col(column).isin(*ids)) if ids else df.filter(F.lit(False))


def profile_hot_keys(
    entities: DataFrame, links: DataFrame, insights: Mapping[str, DataFrame], hot_rows: int = HOT_ROWS
) -> dict[str, DataFrame]:
    """Entities with very many rows, for each table that has any.

    Look them up once, and hand them to the lead and the contact profiles alike.
    """
    tables = {"entities": entities, "links": links, **{n: insights[n] for n in INSIGHT_VALUES}}
    found = {name: hot_keys(table, "entity_id", hot_rows) for name, table in tables.items()}
    return {name: hot for name, hot in found.items() if hot is not None}


def profile_rows(
    entities: DataFrame,
    links: DataFrame,
    insights: Mapping[str, DataFrame],
    kind: str = "lead",
    client: str | None = None,
    ids: Sequence[int] | DataFrame | None = None,
    latest_only: bool = False,
    hot: Mapping[str, DataFrame] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flat profile rows: entities, all insights, their lead or contact ids.

    An insight table with several rows for an entity multiplies its profiles;
    ``latest_only`` keeps the newest row of tables that have a time instead, and of
    equal times the one with the greater value. Tenant and id filters come first. All joins
    have the same key, so each table is shuffled once; the ids, of which one entity may have very
    many, are joined last. ``hot`` is what ``profile_hot_keys`` found; without it, and for
    asked ids, every join is plain.
    """
    id_column = f"{kind}_id"
    if client is not None:
        entities = entities.filter(F.col("client") == client)
    links = select_ids(links.select(id_column, "entity_id"), id_column, ids)
    rows = entities.select("entity_id", "email", "phone", "twitter")
    # With ids, every table is first cut to their entities: few ids are broadcast by
    # adaptive execution, and nothing else of a table is shuffled.
    wanted = links.select("entity_id").distinct() if ids is not None else None

    def cut(table: DataFrame) -> DataFrame:
        return table if wanted is None else table.join(wanted, "entity_id", "left_semi")

    rows = cut(rows)
    values = {}
    reduced = set()  # one row per entity
    for name, (value, alias) in INSIGHT_VALUES.items():
        table = cut(insights[name])
        if latest_only and "ingestion_timestamp" in table.columns:
            table = latest_per_key(table, ["entity_id"], "ingestion_timestamp", [value])
            reduced.add(name)
        values[name] = table.select("entity_id", F.col(value).alias(alias))
    hot = {n: h for n, h in (hot or {}).items() if ids is None and n not in reduced}
    row_hot = hot.get("entities")
    # Tables with a hot entity come last, behind those that share one partitioning.
    for name in sorted(values, key=lambda n: n in hot):
        rows = split_join(rows, values[name], "entity_id", "left", row_hot, hot.get(name), hot_rows)
        row_hot = product(row_hot, hot.get(name), "entity_id")
    rows = split_join(rows, links, "entity_id", "inner", row_hot, hot.get("links"), hot_rows)
    return rows.select(
        id_column, "entity_id", "email", "phone", "twitter",
        *[alias for _, alias in INSIGHT_VALUES.values()],
    )


def nest_profile(rows: DataFrame, kind: str = "lead") -> DataFrame:
    """Flat profile rows in the nested form that is served."""

    def group(*names: str) -> Column:
        return F.struct(*[F.col(n) for n in names])

    return rows.select(
        f"{kind}_id",
        group("entity_id", "email", "phone", "twitter").alias("entity"),
        F.col("match_scores").alias("match_score"),
        F.col("adopt_scores").alias("adopt_curve"),
        group("persuasion").alias("persuasion_angle"),
        group("preferences").alias("channel_strategy"),
        F.struct(F.col("relationship_fit").alias("prediction")).alias("relationship_fit"),
        "archetype",
        "lcv_level",
        "days_to_first_sale_level",
    )


def profiles(*args, kind: str = "lead", **options) -> DataFrame:
    return nest_profile(profile_rows(*args, kind=kind, **options), kind)


SMALL_ROWS = 1_000_000


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], most_rows: int = SMALL_ROWS) -> DataFrame:
    """An inner join whose small side, of a few narrow columns, is broadcast if a count finds ``most_rows`` or fewer.

    Beyond that both sides are shuffled. The count spares the shuffle of wide rows, such as texts, where Spark's own
    estimate of the small side is too coarse.
    """
    few = small.limit(most_rows + 1).count() <= most_rows
    return big.join(F.broadcast(small) if few else small, keys)


VISIT_COLUMNS = [
    "visitor_id", "last_visit_date", "visit_count", "ipaddress", "browser_agent", "created_at",
]
SITE_COLUMNS = [
    "site_id", "user_id", "tree_user_id", "third_party_tracking_company", "tracking_code",
]


def owned_sites(sites: DataFrame, users: DataFrame, codes: DataFrame) -> DataFrame:
    """Sites of known users with what belongs to the user."""
    return (
        sites.select(F.col("id").alias("site_id"), F.col("user_id"))
        .join(users.select(F.col("id").alias("user_id"), "tree_user_id"), "user_id")
        .join(
            codes.select("user_id", "third_party_tracking_company", "tracking_code"),
            "user_id", "left",
        )
    )


def site_visits(owned: DataFrame, visitors: DataFrame) -> DataFrame:
    """The visits of owned sites."""
    visits = visitors.select("site_id", *VISIT_COLUMNS)
    return visits.join(owned, "site_id").select(*SITE_COLUMNS, *VISIT_COLUMNS)


def site_visitors(
    sites: DataFrame, visitors: DataFrame, users: DataFrame, codes: DataFrame
) -> DataFrame:
    """All visits of all owned sites; a site without visits stays with nulls.

    Written as matched plus unmatched sites instead of one left join: the sites
    are the small side, and only an inner join lets Spark broadcast them, or split
    a site that has a large part of all visits.
    """
    owned = owned_sites(sites, users, codes)
    # Visits reduce to distinct sites before the shuffle.
    unvisited = owned.join(visitors.select("site_id").distinct(), "site_id", "left_anti")
    nulls = {c: F.lit(None).cast(visitors.schema[c].dataType) for c in VISIT_COLUMNS}
    rest = unvisited.withColumns(nulls).select(*SITE_COLUMNS, *VISIT_COLUMNS)
    return site_visits(owned, visitors).unionByName(rest)


def pending_entities(entities: DataFrame, insight: DataFrame, now: Column, hours: int) -> DataFrame:
    """Entities without an insight row of the last ``hours``, with their client."""
    recent = F.col("ingestion_timestamp") >= hours_before(now, hours)
    fresh = insight.filter(recent).select("entity_id").distinct()
    return entities.select("entity_id", "client").join(fresh, "entity_id", "left_anti")
