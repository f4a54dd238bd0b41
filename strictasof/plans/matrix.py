"""Feature assembly: entry frame, base population, feature catalogue and the full matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import features as X
from ..operators import speed
from ..operators.grouped import relativize
from ..operators.prior import asof_attach
from ..session import release
from .declared import FEATURES, Feature, to_relativise

Tables = Mapping[str, DataFrame]


def entry_frame(tables: Tables) -> DataFrame:
    """Entries with their event's columns and their entity's parents; every entry stays, void ones included."""
    entries = tables["runners"].join(tables["races"], "race_id")
    parents = tables["horses"].select("horse_id", "sire_id", "damsire_id")
    return entries.join(parents, "horse_id", "left")


def base_population(entries: DataFrame, as_of: date | None = None, events: DataFrame | None = None) -> DataFrame:
    """Entries that ran, of the given events or of all events before ``as_of``."""
    base = entries.where(S.ran(F.col("status")))
    if events is not None:
        return base.join(events.select("race_id"), "race_id", "left_semi")
    return base.where(F.col("date") < F.lit(as_of))


def events_between(races: DataFrame, start: date, end: date, today: date, sealed_years: int = 3) -> DataFrame:
    """Events of a date range without the sealed ones."""
    inside = F.col("date").between(F.lit(start), F.lit(end))
    return races.where(inside & ~S.sealed(F.col("date"), F.col("grade"), today, sealed_years))


def with_row_facts(entries: DataFrame, min_session_n: int = speed.MIN_SESSION_N) -> DataFrame:
    """Add the per-row facts later features aggregate: speed index, in-event rank, rivals' speed, pace pair."""
    entries = X.numbered(entries)
    rows = X.stored_beside(entries, [
        lambda r: speed.with_speed_index(r, min_session_n=min_session_n),
        lambda r: X.with_last_3f_rank(r.select(X.ROW, "race_id", "n_starters", "last_3f")),
        X.add_lead_quantile])
    release(entries)
    facts = X.stored_beside(rows, [X.with_rival_speed, X.with_pace_pair])
    release(rows)
    return facts


def add_default_features(facts: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The default feature set for ``rows`` (default: all), stored; computed from the full fact frame of :func:`with_row_facts`."""
    rows = facts if rows is None else rows

    def by_entity(part):
        part = X.add_features(part, [
            X.pace_slope(), X.previous_result(), X.recency(), X.partner_change(), X.condition_change(), X.career_rates(),
            X.speed_history(), X.opponent_strength(), X.section_means(),
        ], source=facts)
        for add in (X.add_shrunken_slope, X.add_recent_section, X.add_recent_speed):
            part = add(part, source=facts)
        return part

    rows = X.stored_beside(rows, [by_entity, *[partial(add, source=facts) for add in (
        X.add_blood_encoding, X.add_partner_rating, X.add_stable_intent, X.add_partner_course_encoding, X.add_frame_bias,
        X.add_course_aptitude, speed.add_session_bias)]])
    return X.add_entry_basics(X.add_event_weather(X.add_event_description(rows)))


def feature_columns(entries: DataFrame, source: DataFrame) -> list[str]:
    """The feature columns of a frame that grew out of ``source``: new columns plus the raw ids."""
    raw = set(source.columns)
    helpers = {"spd", "last_3f_rank", "rival_sum", "rival_n", "pace_x", "pace_y", X.ROW}
    ids = [c for c in ("sire_id", "damsire_id", "jockey_id", "trainer_id") if c in raw]
    return ids + [c for c in entries.columns if c not in raw and c not in helpers]


def feature_matrix(
    tables: Tables,
    *,
    as_of: date | None = None,
    events: DataFrame | None = None,
    expected_pace: DataFrame | None = None,
    effects: DataFrame | None = None,
    min_session_n: int = speed.MIN_SESSION_N,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per entry that ran: all default features, pace interaction, effect estimate and relative columns.

    ``keep`` names raw columns to carry along. ``expected_pace`` holds (race_id, f102); ``effects`` holds (horse_id, as_of, effect).
    """
    source = entry_frame(tables)
    facts = with_row_facts(source, min_session_n)
    rows = add_default_features(facts, base_population(facts, as_of, events))
    release(facts)
    if expected_pace is not None:
        rows = rows.join(expected_pace.select("race_id", "f102"), "race_id", "left")
    else:
        rows = rows.withColumn("f102", F.lit(None).cast("double"))
    rows = X.beside(rows, [lambda r: X.add_pace_interaction(r.select(X.ROW, "race_id", "n_starters", "f102", "f103"))])
    if effects is not None:
        rows = asof_attach(rows, effects, ["horse_id"], "date", "effect", "f302")
    else:
        rows = rows.withColumns({"f302": F.lit(None).cast("double"), "f302_unavailable": F.lit(1)})
    columns = feature_columns(rows, source)
    rows = relativize(rows.select(*X.KEY, *keep, "n_starters", *columns), to_relativise(columns))
    return rows.drop("n_starters")


CATALOGUE_SCHEMA = "name string, column string, timing string, minutes_before int, event_level boolean"


def catalogue(spark: SparkSession, features: Sequence[Feature] = FEATURES) -> DataFrame:
    """The declared features as a table, one row per column. Names are unique; only same-day features have minutes."""
    names = [f.name for f in features]
    if len(set(names)) < len(names):
        raise ValueError(f"registered twice: {sorted(n for n in set(names) if names.count(n) > 1)}")
    if wrong := [f.name for f in features if f.minutes_before is not None and f.timing != V.SAME_DAY]:
        raise ValueError(f"minutes before the start are for {V.SAME_DAY} only: {wrong}")
    rows = [(f.name, c, f.timing, f.minutes_before, f.per_event) for f in features for c in f.columns]
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)


def usable_columns(specs: DataFrame, route: str) -> DataFrame:
    """Columns known in time on a route; a same-day column of unknown lead time is left out."""
    allowed = F.col("timing").isin(*V.ROUTE_TIMINGS[route])
    in_time = F.coalesce(F.col("minutes_before") >= V.SAME_DAY_DEADLINE_MINUTES, F.lit(False))
    return specs.where(allowed & ((F.col("timing") != V.SAME_DAY) | in_time))


def unresolved_deadlines(specs: DataFrame) -> DataFrame:
    waiting = (F.col("timing") == V.SAME_DAY) & F.col("minutes_before").isNull()
    return specs.where(waiting).select("name").distinct()
