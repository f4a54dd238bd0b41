"""Loading jobs as table operations: outcome logs, idempotent replacement, resume, key resolution, overlays.

Nothing here updates in place. Each function returns the new content of a table; the caller writes it, with
dynamic partition overwrite where the table is partitioned by the replaced key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

FETCH_LOG_KEY = ["url"]
REJECT_KEY = ["source", "source_key"]


def route_outcomes(pages: DataFrame, http_failed: Column, parse_failed: Column, empty: Column) -> DataFrame:
    """Give every page exactly one outcome; a bad page never stops the others."""
    outcome = (F.when(http_failed, "http_error").when(parse_failed, "parse_error").when(empty, "empty").otherwise("ok"))
    return pages.withColumn("outcome", outcome)


def latest_wins(log: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Upsert: per key the newest row of old log and new records (a new record wins a tie).

    ``max_by`` on a struct is combined on the map side, so a key that was fetched very often stays cheap.
    """
    columns = log.columns
    rows = log.withColumn("_new", F.lit(0)).unionByName(new.select(*columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*columns)


def replace_keyed(old: DataFrame, new: DataFrame, keys: Sequence[str], replaced: DataFrame | None = None) -> DataFrame:
    """Old rows of other keys plus the new rows; ``replaced`` names keys to clear that brought no rows."""
    gone = new.select(*keys) if replaced is None else replaced.select(*keys)
    return old.join(gone.distinct(), list(keys), "left_anti").unionByName(new)


def replace_groups(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], parent: str, key: str) -> dict[str, DataFrame]:
    """Replace parents and all their children together: the new parents' keys are cleared in every table."""
    keys = new[parent].select(key)
    return {name: replace_keyed(table, new[name], [key], replaced=keys) for name, table in old.items()}


def completed_keys(log: DataFrame, page_kind: str = "archive") -> DataFrame:
    return log.where((F.col("page_kind") == page_kind) & (F.col("outcome") == "ok")).select("source_key").distinct()


def pending_keys(candidates: DataFrame, log: DataFrame, page_kind: str = "archive") -> DataFrame:
    """Keys still to be loaded when a job resumes."""
    return candidates.join(completed_keys(log, page_kind), "source_key", "left_anti")


def pending_entities(entities: DataFrame, missing: Column, log: DataFrame, page_kind: str) -> DataFrame:
    """Entities that lack an enrichment and have no finished fetch of its page."""
    return pending_keys(entities.where(missing), log, page_kind)


def enrich(entities: DataFrame, found: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill a dimension from newly parsed values; a known new value wins, others stay."""
    fresh = found.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = entities.join(fresh, key, "left")
    filled = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    return rows.withColumns(filled).select(*entities.columns)


def keys_rejected_for(rejected: DataFrame, reason: str) -> DataFrame:
    return rejected.where(F.col("reason") == reason).select("source_key").distinct()


def split_rows(parsed: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with a null reason are accepted."""
    marked = parsed.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def event_totals(accepted: DataFrame) -> DataFrame:
    """Header numbers that follow from the accepted entries."""
    return accepted.groupBy("race_id").agg(
        F.count("*").alias("n_entries"), F.count_if(S.ran(F.col("status"))).alias("n_starters"))


def entity_key(source_key: Column, name: Column) -> Column:
    """Source key, or the name marked as such when the source has none."""
    return F.coalesce(source_key, F.concat(F.lit("name:"), name))


def _bucket(key: Column) -> Column:
    return F.substring(F.md5(key), 1, 3)


def resolve_keys(keys: DataFrame, known: DataFrame, scope: Sequence[str] = ("entity_type",),
                 identity: Sequence[str] = ("source", "source_key"), first: int = 1) -> DataFrame:
    """Internal ids for all keys: known ones as stored, new ones numbered after the scope's largest id, from ``first`` on.

    New keys are numbered inside 4,096 hash buckets and shifted by the buckets before them, so no single task
    sees all of them and a rerun gives the same ids.
    """
    scope, identity = list(scope), list(identity)
    columns = [*scope, *identity]
    asked = keys.select(*columns).distinct()
    found = asked.join(known.select(*columns, "internal_id"), columns, "left")
    new = found.where(F.col("internal_id").isNull()).drop("internal_id")
    new = new.withColumn("_bucket", _bucket(F.concat_ws("\u0001", *identity)))
    inside = Window.partitionBy(*scope, "_bucket").orderBy(*identity)
    sizes = new.groupBy(*scope, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*scope, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    largest = known.groupBy(*scope).agg(F.max("internal_id").alias("_largest"))
    numbered = (
        new.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*scope, "_bucket"]).join(largest, scope, "left")
        .select(*columns, (F.greatest("_largest", F.lit(first - 1)) + F.col("_offset") + F.col("_rn")).alias("internal_id")))
    return found.where(F.col("internal_id").isNotNull()).unionByName(numbered)


class OverlayConflict(ValueError):
    """A pending event already has a stored row."""


def overlay(stored: Mapping[str, DataFrame], pending: Mapping[str, DataFrame], event_key: str = "race_id",
            event_table: str = "races") -> dict[str, DataFrame]:
    """History plus pending events, by column name; refuses pending events the history already has."""
    clash = pending[event_table].join(stored[event_table], event_key, "left_semi").select(event_key).first()
    if clash is not None:
        raise OverlayConflict(f"{event_key}={clash[0]} is already stored")
    return {name: table.unionByName(pending[name], allowMissingColumns=True) if name in pending else table
            for name, table in stored.items()}


def readiness(entries: DataFrame, column: str, event_key: str = "race_id") -> DataFrame:
    """Per event: does every entry have a value?"""
    return entries.groupBy(event_key).agg(F.bool_and(F.col(column).isNotNull()).alias("ready"))
