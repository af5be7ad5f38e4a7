"""Predicates that most operators start with, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivor() -> Column:
    """A memory that is neither deleted, replaced, a duplicate, hidden nor kept from search."""
    return (
        F.col("deleted_at").isNull()
        & F.col("superseded_by").isNull()
        & F.col("is_duplicate_of").isNull()
        & F.coalesce(F.col("searchable"), F.lit(True))
        & ~F.coalesce(F.col("user_hidden"), F.lit(False))
        & (F.coalesce(F.col("embedding_status"), F.lit("")) != "DUPLICATE")
    )


def survivors(df: DataFrame) -> DataFrame:
    return df.where(survivor())


def event_time() -> Column:
    return F.coalesce("observed_at", "created_at")


def scope_filter(
    layers: list[str] | None = None, project: str | None = None, session: int | str | None = None, agent: str | None = None, visibility: list[str] | None = None,
    subject_type: str | None = None, include_user: bool = True, include_agent: bool = True, external_session: str | None = None,
) -> Column:
    """All given conditions; a condition that isn't given holds for every row.

    external_session: the column of a session's other id, either of which may match. An empty visibility list is none given.
    Switching off memories about users or about agents leaves those about the other and overrides subject_type; switching off both leaves no row.
    """
    out = F.lit(True)
    for name, value in (("project_id", project), ("agent_id", agent)):
        if value is not None:
            out = out & (F.col(name) == value)
    if session is not None:
        same = F.col("session_id") == session
        out = out & (same | (F.col(external_session) == session) if external_session else same)
    if visibility:
        out = out & F.col("visibility").isin(visibility)
    if not include_user and not include_agent:
        return F.lit(False)
    subject = "AGENT" if not include_user else "USER" if not include_agent else subject_type
    if subject is not None:
        out = out & (F.col("subject_type") == subject)
    return out & F.col("layer").isin(layers) if layers is not None else out


def has_all_tags(wanted: list[str], tags: str = "tags") -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(tags))) == 0


def metadata_contains(wanted: dict[str, object], json: str = "props") -> Column:
    """Each key of the JSON text has the given value, compared as text."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & (F.get_json_object(F.col(json), f"$.{key}") == str(value))
    return out


def time_range(after: str | None, before: str | None, by_event_time: bool = False) -> Column:
    """created_at, or the event time, from `after` to `before`, both included."""
    at, out = event_time() if by_event_time else F.col("created_at"), F.lit(True)
    if after:
        out = out & (at >= F.lit(after).cast("timestamp"))
    return out & (at <= F.lit(before).cast("timestamp")) if before else out


def total_order(score: str = "score", vector_score: str = "vector_score", importance: str = "importance", created: str = "created_at", key: str = "memory_id") -> list[Column]:
    """Score, vector score (null as -1) and importance falling, newest first, then the key."""
    return [F.col(score).desc(), F.coalesce(F.col(vector_score), F.lit(-1.0)).desc(), F.col(importance).desc(), F.col(created).desc(), F.col(key).asc()]


def route_events(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, subscription_id): the type matches, and each filter that both sides have does.

    subscriptions(subscription_id, event_type, filter_layers array, filter_tags array, min_importance); events(event_id,
    event_type, layer, tags, importance). An event without the filtered field passes. The join is on the type; subscriptions
    are rows that people write, and Spark broadcasts them if their size allows it. Works on streams too.
    """
    s = subscriptions.withColumnRenamed("event_type", "wanted_type")
    passes = (
        (F.col("filter_layers").isNull() | F.col("layer").isNull() | F.array_contains("filter_layers", F.col("layer")))
        & (F.col("filter_tags").isNull() | F.col("tags").isNull() | F.arrays_overlap("filter_tags", "tags"))
        & (F.col("min_importance").isNull() | F.col("importance").isNull() | (F.col("importance") >= F.col("min_importance")))
    )
    return events.join(s, (F.col("event_type") == F.col("wanted_type")) & passes).select("event_id", "subscription_id")
