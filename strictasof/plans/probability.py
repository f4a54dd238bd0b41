"""Group probabilities: market shares, tie-split labels, temperature calibration, combinations."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators.grouped import normalise, softmax, top_per_group, with_group_stats
from ..session import release, stage_table

EPS = 1e-15
T_MIN, T_MAX, T_TOL, T_NONE = 0.1, 10.0, 1e-4, 1.0
AT_BOUND = 1e-3


def market_probability(entries: DataFrame) -> DataFrame:
    """Normalised inverse odds over the entries that were not void and have odds."""
    priced = entries.where(S.not_void(F.col("status")) & F.col("odds_win").isNotNull())
    return normalise(priced, "race_id", F.lit(1.0) / F.col("odds_win"), "p")


def tie_split_label(entries: DataFrame, winner: Column, out: str = "y") -> DataFrame:
    """1/winners for each winner of the group, 0 for the others."""
    rows = with_group_stats(entries, ["race_id"], {"_winners": F.count_if(winner)})
    return rows.withColumn(out, F.when(winner, F.lit(1.0) / F.col("_winners")).otherwise(F.lit(0.0))).drop("_winners")


def target_population(races: DataFrame, today: date, flagged_only: bool = False, sealed_years: int = 3) -> DataFrame:
    """Events for evaluation: sealed ones never, all grades or the flagged grade only."""
    kept = races.where(~S.sealed(F.col("date"), F.col("grade"), today, sealed_years))
    return kept.where(F.col("grade") == V.FLAGGED_GRADE) if flagged_only else kept


def sealed_count(races: DataFrame, today: date, sealed_years: int = 3) -> DataFrame:
    sealed = S.sealed(F.col("date"), F.col("grade"), today, sealed_years)
    return races.agg(F.count_if(sealed).alias("n_sealed"))


# --- temperature ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Calibrator:
    temperature: float
    n_races_fit: int
    n_runners_fit: int
    logloss_before: float
    logloss_after: float
    at_bound: bool

    def apply(self, scores: DataFrame, out: str = "win_prob") -> DataFrame:
        return softmax(scores, "race_id", "score", out, self.temperature)


def temperature_losses(scores: DataFrame, temperatures: list[float]) -> DataFrame:
    """Mean group log-loss at each temperature, one row per temperature.

    ``scores`` holds race_id, score and is_winner. All temperatures share one pass: a group needs its best
    score and, per temperature, one partition sum; only the winners' rows are then looked at again.
    """
    top = scores.groupBy("race_id").agg(F.max("score").alias("_top"))
    shifted = scores.join(top, "race_id").withColumn("_gap", F.col("score") - F.col("_top"))
    sums = [F.sum(F.exp(F.col("_gap") / F.lit(t))).alias(f"_z{i}") for i, t in enumerate(temperatures)]
    groups = shifted.groupBy("race_id").agg(F.count_if("is_winner").alias("_winners"), *sums)
    winners = shifted.where("is_winner").select("race_id", "_gap")
    log_p = [F.greatest(F.col("_gap") / F.lit(t) - F.log(f"_z{i}"), F.log(F.lit(EPS))) for i, t in enumerate(temperatures)]
    lost = winners.join(groups, "race_id").agg(
        *[F.sum(lp / F.col("_winners")).alias(f"_l{i}") for i, lp in enumerate(log_p)])
    n = groups.agg(F.count("*").alias("n_races")).scalar()
    points = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("temperature"), F.coalesce(F.col(f"_l{i}"), F.lit(0.0)).alias("total"))
        for i, t in enumerate(temperatures)]))
    return lost.select(points.alias("p")).select("p.temperature", (-F.col("p.total") / n).alias("log_loss"))


def fit_calibrator(scores: DataFrame, points: int = 24) -> Calibrator:
    """Temperature with the smallest group log-loss, by refining a grid until it is finer than the tolerance.

    The loss has one minimum, so each round keeps the two cells around the best point; a round is one pass.
    """
    scores = stage_table(scores.select("race_id", "score", "is_winner").repartition("race_id"))  # every round reads them
    size = scores.agg(F.countDistinct("race_id").alias("g"), F.count("*").alias("n")).first()
    if not size["n"]:
        release(scores)
        return Calibrator(T_NONE, 0, 0, float("nan"), float("nan"), False)
    losses = lambda ts: {r["temperature"]: r["log_loss"] for r in temperature_losses(scores, ts).collect()}
    low, high = T_MIN, T_MAX
    while True:
        grid = [low + (high - low) * i / points for i in range(points + 1)]
        found = losses(grid)
        best = min(range(points + 1), key=lambda i: found[grid[i]])
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points)]
        if high - low <= T_TOL:
            break
    t = grid[best]
    near_bound = t - T_MIN < AT_BOUND or T_MAX - t < AT_BOUND
    before = losses([T_NONE])[T_NONE]
    release(scores)
    return Calibrator(t, size["g"], size["n"], before, found[t], near_bound)


def calibrate_slice(scores: DataFrame, calibrators: DataFrame, flagged: DataFrame, out: str = "y_pred") -> DataFrame:
    """Re-normalise the raw scores of the flagged events with their fold's temperature.

    ``scores`` holds race_id, fold_index and score; ``calibrators`` holds fold_index and temperature. Rows of
    folds without a temperature are left out, never passed on uncalibrated.
    """
    rows = scores.join(flagged.select("race_id"), "race_id", "left_semi").join(
        calibrators.select("fold_index", "temperature"), "fold_index")
    return softmax(rows, "race_id", "score", out, F.col("temperature")).drop("temperature")


# --- combinations ---------------------------------------------------------------------------------------

_ORDERED = {V.EXACTA: 2, V.TRIFECTA: 3}
_UNORDERED = {V.QUINELLA: 2, V.WIDE: 2, V.TRIO: 3}
COMBINATION_TYPES = tuple(_ORDERED) + tuple(_UNORDERED)
_TINY = 1e-12


def _pair(p: Column, q: Column) -> Column:
    return F.when(1 - p > _TINY, p * q / (1 - p)).otherwise(F.lit(0.0))


def _triple(p: Column, q: Column, r: Column) -> Column:
    safe = (1 - p > _TINY) & (1 - p - q > _TINY)
    return F.when(safe, p * (q / (1 - p)) * (r / (1 - p - q))).otherwise(F.lit(0.0))


def _any_order(p: Column, q: Column, r: Column) -> Column:
    return (_triple(p, q, r) + _triple(p, r, q) + _triple(q, p, r)
            + _triple(q, r, p) + _triple(r, p, q) + _triple(r, q, p))


def top_combinations(entries: DataFrame, bet_type: str, n: int = 5, group: str = "race_id", member: str = "number",
                     probability: str = "win_prob") -> DataFrame:
    """The ``n`` most probable combinations of each group, from the members' win probabilities.

    Swapping a member for a likelier one never lowers a combination's probability. A combination that uses the
    member ranked m has at least m - size combinations above it, so only the first n + size - 1 members can take
    part: those alone are combined, and the result is the exact top n of the full list. Ties go to lower numbers.
    """
    if bet_type not in COMBINATION_TYPES:
        raise ValueError(f"unknown combination type {bet_type!r}; known: {COMBINATION_TYPES}")
    size = _ORDERED.get(bet_type) or _UNORDERED[bet_type]
    rows = entries.select(group, F.col(member).alias("_m"), F.col(probability).alias("_p"))
    best = top_per_group(rows, [group], [F.col("_p").desc(), F.col("_m")], n + size - 1, rank="_r")
    lists = best.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_m", "_p"))).alias("_best"))
    single = F.transform("_best", lambda s: F.array(s))
    extend = lambda combos: F.flatten(F.transform(combos, lambda c: F.transform("_best", lambda s: F.concat(c, F.array(s)))))
    chosen = single
    for _ in range(size - 1):
        chosen = extend(chosen)
    if bet_type in _UNORDERED:
        keep = lambda c: S.all_of(c[i]["_m"] < c[i + 1]["_m"] for i in range(size - 1))
    else:
        keep = lambda c: F.size(F.array_distinct(F.transform(c, lambda s: s["_m"]))) == size
    combos = lists.select(group, F.explode(F.filter(chosen, keep)).alias("_c"))
    m = [F.col("_c")[i]["_m"] for i in range(size)]
    p = [F.col("_c")[i]["_p"] for i in range(size)]
    combos = combos.select(group, F.array(*m).alias("numbers"), *[x.alias(f"_p{i}") for i, x in enumerate(p)])
    p = [F.col(f"_p{i}") for i in range(size)]
    if bet_type == V.WIDE:
        # the third place may go to any other member: one sum per pair over the group
        pairs = combos.join(rows, group).where(~F.array_contains("numbers", F.col("_m")))
        inside = pairs.groupBy(group, "numbers").agg(F.sum(_any_order(p[0], p[1], F.col("_p"))).alias("prob"))
        scored = combos.select(group, "numbers").join(inside, [group, "numbers"], "left").withColumn(
            "prob", F.coalesce("prob", F.lit(0.0)))
    else:
        value = {
            V.EXACTA: lambda: _pair(p[0], p[1]),
            V.QUINELLA: lambda: _pair(p[0], p[1]) + _pair(p[1], p[0]),
            V.TRIFECTA: lambda: _triple(p[0], p[1], p[2]),
            V.TRIO: lambda: _any_order(p[0], p[1], p[2]),
        }[bet_type]()
        scored = combos.select(group, "numbers", value.alias("prob"))
    return top_per_group(scored, [group], [F.col("prob").desc(), F.col("numbers")], n, rank="rank")
