"""Feature operators: each adds its columns to an ``entries`` frame and drops no row.

``entries`` is one row per (race_id, horse_id) with the entry's, the event's and the entity's own columns
(see :func:`strictasof.plans.matrix.entry_frame`). Everything derived from results looks only at rows with an
earlier ``date``; rows of the same date never see each other. Features that need running aggregates over the
same key are described as :class:`KeyedFeature` so one pass per key serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import speed
from .encode import (K, main_partner, residual_rating, target_encode, with_condition_mean)
from .grouped import leave_one_out, relativize
from .prior import (Running, latest, mean_of_array, prior_mean, running_count, running_max, running_min,
                    running_sum, with_prior, with_prior_quantile, with_recent)
from ..functions import scalars as S
from ..functions import vocabulary as V
from ..session import release, stage_table

KEY = ("race_id", "horse_id")


# ---------------------------------------------------------------------------------------------------------
# keyed features: running aggregates per key, then plain expressions
# ---------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class KeyedFeature:
    needs: Mapping[tuple[str, ...], Mapping[str, Running]]
    columns: Callable[[], Mapping[str, Column]]


def add_features(entries: DataFrame, features: Sequence[KeyedFeature], order: str = "date",
                 source: DataFrame | None = None) -> DataFrame:
    """Add all features, with one strictly-before pass per distinct key."""
    source = entries if source is None else source
    passes: dict[tuple[str, ...], dict[str, Running]] = {}
    for feature in features:
        for keys, aggregates in feature.needs.items():
            passes.setdefault(keys, {}).update(aggregates)
    # the longest keys first: rows that lie by a short key, with all that was found, then move no more
    for keys, aggregates in sorted(passes.items(), key=lambda p: -len(p[0])):
        entries = with_prior(entries, keys, order, aggregates, source=source)
    out = {}
    for feature in features:
        out.update(feature.columns())
    helpers = {name for aggregates in passes.values() for name in aggregates}
    return entries.withColumns(out).drop(*helpers)


#: number of a row in a stored frame
ROW = "_row"


def numbered(entries: DataFrame) -> DataFrame:
    """The entries as a stored table with a number of their own."""
    return stage_table(entries.withColumn(ROW, F.monotonically_increasing_id()))


def _joined(rows: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    for part in parts:
        rows = rows.join(part, ROW, "left")
    return rows


def _parts(rows: DataFrame, adders: Sequence[Callable[[DataFrame], DataFrame]]) -> Iterator[DataFrame]:
    """Per adder the row number and its new columns."""
    for add in adders:
        added = add(rows)
        yield added.select(ROW, *[c for c in added.columns if c not in rows.columns])


def beside(rows: DataFrame, adders: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``rows`` of a numbered table with the columns that each adder adds to them.

    What goes through an adder's exchanges is the number and what the adder reads, not the whole row; results meet by number.
    """
    return _joined(rows, list(_parts(rows, adders)))


def stored_beside(rows: DataFrame, adders: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """:func:`beside` as a stored table, one adder after the other, so that the disk holds the shuffles of one at a time."""
    parts = [stage_table(part) for part in _parts(rows, adders)]
    out = stage_table(_joined(rows, parts))
    release(*parts)
    return out


#: newest event first; number and owner decide should an entity have two entries in one event
TIE = ("race_id", "number", "owner_id")


def _tie() -> Column:
    return F.struct(*TIE)


def _share() -> Column:
    return S.safe_ratio(F.col("finish_pos"), F.col("n_starters"))


def _past_starts() -> dict[str, Running]:
    return {"_starts": running_count()}


def with_last_3f_rank(entries: DataFrame) -> DataFrame:
    """In-event rank ratio of the final-600m time, over the rows where it is recorded."""
    if "last_3f_rank" in entries.columns:
        return entries
    return relativize(entries, "last_3f", raw=True).drop("last_3f_z")


def previous_result(exclude_relegated: bool = False) -> KeyedFeature:
    """Needs ``last_3f_rank`` on the entries."""
    where = F.col("status") != V.RELEGATED if exclude_relegated else F.lit(True)
    def columns():
        prev = F.col("_prev_result")
        missing = S.flag(prev.isNull())
        out = {
            "f601_finish_pos_prev": prev["finish_pos"].cast("double"),
            "f601_margin_prev": S.margin_lengths(prev["margin"]),
            "f601_last3f_rank_prev": prev["last_3f_rank"],
        }
        return out | {f"{c}_unavailable": missing for c in out}
    return KeyedFeature(
        {("horse_id",): {"_prev_result": latest(_tie(), "finish_pos", "margin", "last_3f_rank", where=where)}},
        columns)


def recency() -> KeyedFeature:
    def columns():
        prev = F.col("_prev_event")
        missing = S.flag(prev.isNull())
        return {
            "f602_prev_grade": prev["grade"],
            "f602_weeks_since_last": F.datediff(F.col("date"), prev["date"]) / F.lit(7.0),
            "f602_weeks_since_last_unavailable": missing,
            "f602_prev_grade_unavailable": missing,
        }
    return KeyedFeature({("horse_id",): {"_prev_event": latest(_tie(), "date", "grade")}}, columns)


def partner_change() -> KeyedFeature:
    def columns():
        prev = F.col("_prev_partner")["jockey_id"]
        return {
            "f702_jockey_changed": F.when(prev.isNotNull(), (prev != F.col("jockey_id")).cast("int")),
            "f702_jockey_changed_unavailable": S.flag(prev.isNull()),
            "f702_jockey_experience_count": F.col("_pair_starts"),
            "f702_jockey_experience_count_unavailable": F.lit(0),
        }
    return KeyedFeature({
        ("horse_id",): {"_prev_partner": latest(_tie(), "jockey_id")},
        ("horse_id", "jockey_id"): {"_pair_starts": running_count()},
    }, columns)


def condition_change() -> KeyedFeature:
    def columns():
        prev = F.col("_prev_condition")
        known = prev.isNotNull()
        when_known = lambda c: F.when(known, c)
        return {
            "f807_prev_distance": prev["distance"].cast("double"),
            "f807_prev_surface": prev["surface"],
            "f807_prev_course": prev["course"],
            "f807_prev_n_starters": prev["n_starters"].cast("double"),
            "f807_distance_diff": (F.col("distance") - prev["distance"]).cast("double"),
            "f807_surface_changed": when_known(S.changed(F.col("surface"), prev["surface"])),
            "f807_direction_changed": when_known(S.changed_or_null(F.col("direction"), prev["direction"])),
            "f807_course_changed": when_known(S.changed(F.col("course"), prev["course"])),
            "f807_n_starters_diff": (F.col("n_starters") - prev["n_starters"]).cast("double"),
        }
    return KeyedFeature({("horse_id",): {"_prev_condition": latest(
        _tie(), "distance", "surface", "direction", "course", "n_starters",
        where=S.ran(F.col("status")))}}, columns)


def pair_history() -> KeyedFeature:
    seen = S.finished(F.col("status")) & F.col("finish_pos").isNotNull()
    def columns():
        return {
            "f808_relfinish_mean": prior_mean("_pair_sum", "_pair_n"),
            "f808_relfinish_best": F.col("_pair_best"),
            "f808_win_rate": prior_mean("_pair_wins", "_pair_n"),
            "f808_unavailable": F.lit(0),
        }
    return KeyedFeature({("jockey_id", "horse_id"): {
        "_pair_sum": running_sum(F.when(seen, _share())), "_pair_best": running_min(F.when(seen, _share())),
        "_pair_wins": running_count(seen & (F.col("finish_pos") == 1)), "_pair_n": running_count(seen),
    }}, columns)


def career_rates() -> KeyedFeature:
    seen = S.finished(F.col("status")) & F.col("finish_pos").isNotNull()
    def columns():
        return {
            "f809_win_rate": prior_mean("_career_wins", "_career_n"),
            "f809_top3_rate": prior_mean("_career_top3", "_career_n"),
        }
    return KeyedFeature({("horse_id",): {
        "_career_n": running_count(seen), "_career_wins": running_count(seen & (F.col("finish_pos") == 1)),
        "_career_top3": running_count(seen & (F.col("finish_pos") <= 3)),
    }}, columns)


def speed_history() -> KeyedFeature:
    """Best, mean and count of the clipped speed index so far; needs ``spd`` on the entries."""
    clipped = S.clip(F.col("spd"), speed.CLIP)
    def columns():
        return {
            "fspd_best": F.col("_spd_best"),
            "fspd_mean": prior_mean("_spd_sum", "_spd_n"),
            "fspd_n": F.col("_spd_n").cast("double"),
            "fspd_unavailable": S.unavailable(F.col("_spd_best"), F.col("_starts") > 0),
        }
    return KeyedFeature({("horse_id",): _past_starts() | {
        "_spd_best": running_max(clipped), "_spd_sum": running_sum(clipped),
        "_spd_n": running_count(F.col("spd").isNotNull()),
    }}, columns)


def with_rival_speed(entries: DataFrame) -> DataFrame:
    """Sum and count of the rivals' clipped speed in the row's own event; needs ``spd``."""
    clipped = F.when(S.finished(F.col("status")), S.clip(F.col("spd"), speed.CLIP))
    return leave_one_out(entries, ["race_id"], ["horse_id"], clipped, "rival_sum", "rival_n")


def opponent_strength() -> KeyedFeature:
    """Mean clipped speed of the rivals met so far; needs ``rival_sum`` and ``rival_n``."""
    finished = S.finished(F.col("status"))
    def columns():
        return {
            "f806_field_mean": prior_mean("_met_sum", "_met_n"),
            "f806_n": F.coalesce(F.col("_met_n"), F.lit(0)).cast("double"),
            "f806_unavailable": S.unavailable(prior_mean("_met_sum", "_met_n"), F.col("_finished_starts") > 0),
        }
    return KeyedFeature({("horse_id",): {
        "_met_sum": running_sum(F.when(finished, F.col("rival_sum"))),
        "_met_n": running_sum(F.when(finished, F.col("rival_n"))),
        "_finished_starts": running_count(finished),
    }}, columns)


# ---------------------------------------------------------------------------------------------------------
# features with their own plan
# ---------------------------------------------------------------------------------------------------------

def add_lead_quantile(entries: DataFrame, quantile: float = 0.25, source: DataFrame | None = None) -> DataFrame:
    """Low quantile of the first-corner position ratio over past events that have a first corner."""
    source = entries if source is None else source
    ratio = S.element_where(F.col("corners"), F.col("corner_nos"), 1).cast("double") / F.col("n_starters")
    rows = with_prior(entries, ["horse_id"], "date", {
        "_starts": running_count(), "_usable": running_count(ratio.isNotNull())}, source=source)
    rows = with_prior_quantile(rows, ["horse_id"], "date", ratio, quantile, "f101", source=source)
    gone = (F.col("_starts") > 0) & (F.col("_usable") == 0)
    return rows.withColumn("f101_unavailable", S.unavailable(F.col("f101"), gone)).drop("_starts", "_usable")


MIN_SUM_SQUARES = 1e-6


def with_pace_pair(entries: DataFrame) -> DataFrame:
    """Add the row's (pressure, margin) pair: one minus the rivals' mean ``f101``, and the margin in lengths."""
    rows = leave_one_out(entries, ["race_id"], ["horse_id"], F.col("f101"), "_others", "_n_others")
    pressure = F.when(F.col("_n_others") > 0, 1 - F.col("_others") / F.col("_n_others"))
    return rows.withColumns({"pace_x": pressure, "pace_y": S.margin_lengths(F.col("margin"))}).drop("_others", "_n_others")


def pace_slope() -> KeyedFeature:
    """Slope of the margin on the rivals' pace pressure over the entity's earlier events, from running moments."""
    x, y = F.col("pace_x"), F.col("pace_y")
    both = x.isNotNull() & y.isNotNull()
    def columns():
        n, sx = F.col("_pace_n"), F.col("_pace_sx")
        spread = F.col("_pace_sxx") - sx * sx / n
        together = F.col("_pace_sxy") - sx * F.col("_pace_sy") / n
        beta = F.when((n >= 2) & (spread >= MIN_SUM_SQUARES), together / spread)
        return {"_beta": beta, "_beta_n": n, "f103_unavailable": S.unavailable(beta, F.col("_starts") > 0)}
    return KeyedFeature({("horse_id",): _past_starts() | {
        "_pace_n": running_count(both), "_pace_sx": running_sum(F.when(both, x)), "_pace_sy": running_sum(F.when(both, y)),
        "_pace_sxx": running_sum(F.when(both, x * x)), "_pace_sxy": running_sum(F.when(both, x * y)),
    }}, columns)


def add_shrunken_slope(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    """Shrink the slope to the mean slope of all earlier rows; follows :func:`pace_slope`.

    A slope depends on (entity, date) alone, so the mean weighs each such pair by its rows.
    """
    source = entries if source is None else source
    pairs = source.groupBy("horse_id", "date").agg(F.count("*").alias("_rows"))
    columns = ["horse_id", "date", "pace_x", "pace_y"]
    slopes = add_features(pairs, [pace_slope()], source=source.select(*columns)).where(F.col("_beta").isNotNull())
    rows = with_prior(entries, [], "date", {
        "_bsum": running_sum(F.col("_beta") * F.col("_rows")), "_bn": running_sum(F.col("_rows"))},
        facts=slopes.select("date", "_rows", "_beta"))
    mu = F.coalesce(F.when(F.col("_bn") > 0, F.col("_bsum") / F.col("_bn")), F.lit(0.0))
    beta = F.col("_beta")
    return rows.withColumn("f103", F.when(beta.isNotNull(), S.shrink(F.col("_beta_n"), beta, k, mu))).drop(
        "_beta", "_beta_n", "_bsum", "_bn")


def add_pace_aptitude(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    """Shrunken slope of the margin on the pace pressure; needs the pairs of :func:`with_pace_pair`."""
    source = entries if source is None else source
    return add_shrunken_slope(add_features(entries, [pace_slope()], source=source), k, source)


def add_pace_interaction(entries: DataFrame) -> DataFrame:
    """Expected pace times the within-event z-score of the pace aptitude (only the aptitude is relativised)."""
    rows = relativize(entries, "f103")
    return rows.withColumn("f104", F.col("f102") * F.col("f103_z"))


def _banded(entries: DataFrame, source: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    band = S.distance_band(F.col("distance"))
    rows = entries.withColumn("_band", band)
    return rows, rows if source is None else source.withColumn("_band", band)


def add_blood_encoding(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    """Offspring results of sire and damsire under (surface, distance band)."""
    rows, source = _banded(entries, source)
    condition, value, where = ["surface", "_band"], _share(), F.col("finish_pos").isNotNull()
    rows = with_condition_mean(rows, condition, value, where, "_mu", source=source)
    for entity, out in (("sire_id", "f202_sire"), ("damsire_id", "f202_damsire")):
        rows = target_encode(rows, [entity], condition, value, where, out, k=k, mean="_mu", source=source)
    return rows.drop("_band", "_mu")


def add_partner_course_encoding(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    rows, source = _banded(entries, source)
    where = F.col("finish_pos").isNotNull() & F.col("jockey_id").isNotNull()
    return target_encode(rows, ["jockey_id"], ["course", "_band"], _share(), where, "f704", k=k,
                         source=source).drop("_band")


def add_frame_bias(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    rows, source = _banded(entries, source)
    where = F.col("finish_pos").isNotNull() & F.col("frame").isNotNull()
    return target_encode(rows, ["frame"], ["course", "_band", "n_starters"], _share(), where, "f801", k=k,
                         source=source).drop("_band")


def add_course_aptitude(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    rows, source = _banded(entries, source)
    where = F.col("finish_pos").isNotNull()
    return target_encode(rows, ["horse_id"], ["course", "_band"], _share(), where, "f802", k=k,
                         indicator=False, source=source).drop("_band")


def add_cross_encoding(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    """Results of the (sire, damsire) pair, shrunk to the mean of all pairs."""
    where = F.col("finish_pos").isNotNull() & F.col("sire_id").isNotNull() & F.col("damsire_id").isNotNull()
    rows = target_encode(entries, ["sire_id", "damsire_id"], [], _share(), where, "f811_nick", k=k, with_count=True,
                         source=source)
    return rows


def add_partner_rating(entries: DataFrame, k: float = K, source: DataFrame | None = None) -> DataFrame:
    where = F.col("popularity").isNotNull() & F.col("finish_pos").isNotNull()
    return residual_rating(entries, "jockey_id", "popularity", F.col("finish_pos").cast("double"), where, "f701", k=k,
                           source=source)


def add_stable_intent(entries: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Away-from-home flag, and whether the stable's most used partner takes part."""
    rows = main_partner(entries, "trainer_id", "jockey_id", out="_main", source=source)
    away = S.home_away(F.col("affiliation"), F.col("course"))
    main = F.col("_main")
    return rows.withColumns({
        "f703_travel_flag": away,
        "f703_travel_flag_unavailable": S.flag(away.isNull()),
        "f703_main_jockey_flag": F.when(main.isNotNull(), (main == F.col("jockey_id")).cast("int")),
        "f703_main_jockey_flag_unavailable": S.flag(main.isNull()),
    }).drop("_main")


def section_means(k: float = K) -> KeyedFeature:
    """Shrunken mean of all earlier final-600m times and the mean in-event rank; needs ``last_3f_rank``."""
    section = F.col("last_3f").cast("double")
    seen = section.isNotNull()
    def columns():
        gone = (F.col("_starts") > 0) & (F.col("_section_n") == 0)
        mean, mu = prior_mean("_section_sum", "_section_n"), prior_mean("_all_section_sum", "_all_section_n")
        rank = prior_mean("_section_rank", "_section_n")
        out = {"last3f_all": F.when(mean.isNotNull(), S.shrink(F.col("_section_n"), mean, k, mu)), "last3f_rank_in_race": rank}
        return out | {f"{c}_unavailable": S.unavailable(v, gone) for c, v in out.items()} | {"_section_mu": mu, "_section_gone": gone}
    return KeyedFeature({
        ("horse_id",): _past_starts() | {
            "_section_n": running_count(seen), "_section_sum": running_sum(section),
            "_section_rank": running_sum(F.when(seen, F.col("last_3f_rank")))},
        (): {"_all_section_n": running_count(seen), "_all_section_sum": running_sum(section)},
    }, columns)


def add_recent_section(entries: DataFrame, n_recent: int = 5, k: float = K, source: DataFrame | None = None) -> DataFrame:
    """Shrunken mean of the last earlier final-600m times; follows :func:`section_means`."""
    rows = with_recent(entries, ["horse_id"], "date", TIE, F.col("last_3f").cast("double"), n_recent, "_recent", source=source)
    mean, n = mean_of_array(F.col("_recent")), F.coalesce(F.size("_recent"), F.lit(0))
    rows = rows.withColumn("last3f_recent", F.when(mean.isNotNull(), S.shrink(n, mean, k, F.col("_section_mu"))))
    missing = S.unavailable(F.col("last3f_recent"), F.col("_section_gone"))
    return rows.withColumn("last3f_recent_unavailable", missing).drop("_recent", "_section_mu", "_section_gone")


def add_final_section(entries: DataFrame, n_recent: int = 5, k: float = K, source: DataFrame | None = None) -> DataFrame:
    """All, recent and rank summaries of the final-600m time; needs ``last_3f_rank`` on the source."""
    source = entries if source is None else source
    return add_recent_section(add_features(entries, [section_means(k)], source=source), n_recent, k, source)


def add_recent_speed(entries: DataFrame, n: int = 3, source: DataFrame | None = None) -> DataFrame:
    """Last and recent-mean clipped speed index; needs ``spd``."""
    rows = with_recent(entries, ["horse_id"], "date", TIE, S.clip(F.col("spd"), speed.CLIP), n, "_recent",
                       source=source)
    return rows.withColumns({
        "fspd_last": F.get("_recent", F.lit(0)), "fspd_recent3": mean_of_array(F.col("_recent")),
    }).drop("_recent")


def add_event_description(entries: DataFrame) -> DataFrame:
    return entries.withColumns({
        "f803_distance": F.col("distance"), "f803_surface": F.col("surface"), "f803_direction": F.col("direction"),
        "f803_n_starters": F.col("n_starters"), "f803_season": S.season(F.col("date")),
        "f803_prize": F.col("prize"), "f803_race_class": F.col("race_class"), "f803_weight_rule": F.col("weight_rule"),
    })


def add_event_weather(entries: DataFrame) -> DataFrame:
    return entries.withColumns({
        "f804_weather": F.col("weather"), "f804_weather_forecast": F.col("weather_forecast"),
        "f804_track_condition": S.track_condition_code(F.col("track_condition")),
    })


def add_entry_basics(entries: DataFrame) -> DataFrame:
    missing = S.flag(F.col("horse_weight").isNull())
    return entries.withColumns({
        "f503_meeting_no": F.col("meeting_no"), "f503_meeting_day": F.col("meeting_day"),
        "f603_horse_weight": F.col("horse_weight"), "f603_weight_diff": F.col("weight_diff"),
        "f603_horse_weight_unavailable": missing, "f603_weight_diff_unavailable": missing,
        "f805_age": F.col("age").cast("double"), "f805_sex": F.col("sex"),
        "f805_weight_carried": F.col("weight_carried").cast("double"),
    })


def add_owner_id(entries: DataFrame) -> DataFrame:
    return entries.withColumn("f810_owner_id", F.col("owner_id"))
