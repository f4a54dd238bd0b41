"""Evaluation: log-loss and hit rates, NDCG, ticket ledgers and returns, slice reports, blends."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators.grouped import softmax, top_per_group
from .bootstrap import bootstrap_interval
from .probability import EPS, market_probability, target_population, tie_split_label

FAVOURITE, UNIFORM = "favorite", "uniform"
STRATEGIES = (FAVOURITE, UNIFORM)
STAKE = 100


# --- probabilities --------------------------------------------------------------------------------------

def group_scores(rows: DataFrame, p: str = "p", y: str = "y", clip: bool = False) -> DataFrame:
    """Per group: log-loss, squared error, size and the finish position of the likeliest member.

    Equal probabilities are decided by popularity. A pick without a finish position stays null.
    """
    probability = F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(EPS)) if clip else F.col(p)
    loss = F.sum(F.when(F.col(y) > 0, -F.col(y) * F.log(probability)).otherwise(F.lit(0.0)))
    pick = F.min_by(F.struct("finish_pos"), F.struct(-F.col(p), "popularity"))
    return rows.groupBy("race_id").agg(
        loss.alias("log_loss"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
        F.count("*").alias("n_runners"), pick["finish_pos"].alias("picked_finish_pos"))


def probability_metrics(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over groups; hit rates skip picks without a finish position."""
    hit = lambda best: F.avg((F.col("picked_finish_pos") <= best).cast("double"))
    return groups.groupBy(*by).agg(
        F.count("*").alias("n_races"), F.sum("n_runners").alias("n_runners"),
        F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"),
        hit(1).alias("top1_hit_rate"), hit(3).alias("top3_hit_rate"))


def market_scores(entries: DataFrame) -> DataFrame:
    return group_scores(tie_split_label(market_probability(entries), F.col("finish_pos") == 1))


def group_log_loss(rows: DataFrame, p: str = "y_pred", y: str = "y_true") -> DataFrame:
    """Log-loss per group with probabilities held away from 0."""
    clipped = F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(EPS))
    loss = F.sum(F.when(F.col(y) > 0, -F.col(y) * F.log(clipped)).otherwise(F.lit(0.0)))
    return rows.groupBy("race_id").agg(loss.alias("log_loss"), F.count("*").alias("n_runners"))


def ndcg(rows: DataFrame, k: int = 3, score: str = "score", label: str = "label", tie: str = "horse_id") -> DataFrame:
    """NDCG@k per group with linear gain; 0 where no member has a gain. Ties go to the lower ``tie``."""
    gain = lambda: F.sum(F.col(label) / F.log2(F.col("rn") + 1))
    dcg = top_per_group(rows, ["race_id"], [F.col(score).desc(), F.col(tie)], k).groupBy("race_id").agg(gain().alias("dcg"))
    ideal = top_per_group(rows, ["race_id"], [F.col(label).desc(), F.col(tie)], k).groupBy("race_id").agg(gain().alias("idcg"))
    return dcg.join(ideal, "race_id").select(
        "race_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


# --- tickets --------------------------------------------------------------------------------------------

def race_ledger(entries: DataFrame, payouts: DataFrame) -> DataFrame:
    """Per event, strategy and ticket type: tickets, hits, stake and payout.

    Whether a ticket was bought follows from its members, so paid tickets are checked against the bought set and
    the rest is counted: an event of m entries has m single and m(m-1)/2 pair tickets, none of which is listed.
    """
    eligible = entries.where(S.not_void(F.col("status"))).groupBy("race_id", "number").agg(
        F.min(F.struct(F.coalesce(F.col("popularity") != 1, F.lit(True)).alias("other"))).alias("_f")
    ).select("race_id", "number", (~F.col("_f.other")).alias("_popular"))
    favourite = F.min(F.when(F.col("_popular"), F.col("number")))
    events = eligible.groupBy("race_id").agg(F.count("*").alias("m"), favourite.alias("favourite"))
    paid = payouts.where(F.col("bet_type").isin(*V.LEDGER_TYPES)).select("race_id", "bet_type", "comb_key", "payout", "combination")
    members = paid.select("race_id", "bet_type", "comb_key", F.size("combination").alias("k"), "payout",
                          F.explode("combination").alias("number"))
    bought = members.join(eligible.select("race_id", "number"), ["race_id", "number"]).join(
        events.select("race_id", "favourite"), "race_id")
    tickets = bought.groupBy("race_id", "bet_type", "comb_key", "k", "payout").agg(
        F.count("*").alias("n"), F.bool_or(F.col("number") == F.col("favourite")).alias("with_favourite")
    ).where(F.col("n") == F.col("k"))
    uniform = tickets.groupBy("race_id", "bet_type").agg(F.count("*").alias("n_hits"), F.sum("payout").alias("payout_yen"))
    single = tickets.where("with_favourite").groupBy("race_id", "bet_type").agg(
        F.count("*").alias("n_hits"), F.sum("payout").alias("payout_yen"))
    hits = uniform.withColumn("strategy", F.lit(UNIFORM)).unionByName(single.withColumn("strategy", F.lit(FAVOURITE)))
    has_favourite = F.col("favourite").isNotNull().cast("long")
    m, pair = F.col("m"), F.col("bet_type") == V.WIDE
    n_bets = F.when(F.col("strategy") == UNIFORM, F.when(pair, F.floor(m * (m - 1) / 2)).otherwise(m)).otherwise(
        F.when(pair, has_favourite * (m - 1)).otherwise(has_favourite))
    grid = events.select(
        "race_id", "m", "favourite", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("strategy")
    ).select("*", F.explode(F.array(*[F.lit(t) for t in V.LEDGER_TYPES])).alias("bet_type"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return grid.withColumn("n_bets", n_bets.cast("long")).join(hits, ["race_id", "strategy", "bet_type"], "left").select(
        "race_id", "strategy", "bet_type", "n_bets", zero("n_hits"), (F.col("n_bets") * STAKE).alias("stake_yen"), zero("payout_yen"))


def returns(ledger: DataFrame, by: Sequence[str] = ("strategy", "bet_type")) -> DataFrame:
    return ledger.groupBy(*by).agg(
        F.count("*").alias("n_races"), F.sum("n_bets").alias("n_bets"), F.sum("n_hits").alias("n_hits"),
        F.sum("stake_yen").alias("stake_yen"), F.sum("payout_yen").alias("payout_yen"),
    ).withColumn("roi", F.try_divide(F.col("payout_yen").cast("double"), F.col("stake_yen").cast("double")))


# --- reports --------------------------------------------------------------------------------------------

def _with_populations(races: DataFrame, today: date, sealed_years: int) -> DataFrame:
    """Events once per population they belong to, with their year."""
    kept = target_population(races, today, sealed_years=sealed_years)
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("grade") == V.FLAGGED_GRADE, F.lit("g1"))))
    return kept.select("race_id", F.year("date").alias("year"), F.explode(names).alias("population"))


def baseline_report(races: DataFrame, entries: DataFrame, payouts: DataFrame, today: date, sealed_years: int = 3,
                    by_year: bool = False, ledger_entries: DataFrame | None = None, n_boot: int | None = None,
                    seed: int = 20260819) -> DataFrame:
    """Long table of market probability metrics and returns per population (and year).

    ``ledger_entries`` may name another entry frame for the tickets. With ``n_boot`` resamples of the events, returns have
    their percentile interval (``ci_low``, ``ci_high``); other metrics have none.
    """
    events = _with_populations(races, today, sealed_years)
    by = ["population", "year"] if by_year else ["population"]
    metrics = probability_metrics(market_scores(entries).join(events, "race_id"), by)
    names = ("log_loss", "brier", "top1_hit_rate", "top3_hit_rate")
    none = F.lit(None).cast("string")
    points = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    long = metrics.select(*by, "n_races", points.alias("m")).select(
        *by, F.lit("probability").alias("metric_kind"), F.col("m.name").alias("metric_name"),
        none.alias("strategy"), none.alias("bet_type"), "n_races", F.col("m.value").alias("value"))
    ledger = race_ledger(entries if ledger_entries is None else ledger_entries, payouts).join(events, "race_id")
    slices = [*by, "strategy", "bet_type"]
    roi = returns(ledger, slices).select(
        *by, F.lit("return").alias("metric_kind"), F.lit("roi").alias("metric_name"), "strategy", "bet_type",
        "n_races", F.col("roi").alias("value"))
    if n_boot is None:
        return long.unionByName(roi)
    ends = bootstrap_interval(ledger, F.col("payout_yen"), F.col("stake_yen"), n_boot, seed, slices)
    roi = roi.join(ends.select(*slices, "ci_low", "ci_high"), slices, "left")
    return long.unionByName(roi, allowMissingColumns=True)


def to_markdown(report: DataFrame, title: str) -> str:
    """Render a small report table; every column in order, nulls as a dash."""
    rows = report.orderBy(*report.columns).collect()
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def compare_with_market(model: DataFrame, market: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Model, market and uniform log-loss on the events both have, and the share of information captured.

    Both frames hold race_id and log_loss; ``model`` also holds n_runners and the ``by`` columns.
    """
    both = model.join(market.select("race_id", F.col("log_loss").alias("market_loss")), "race_id")
    out = both.groupBy(*by).agg(
        F.count("*").alias("n_races"), F.avg("log_loss").alias("model_log_loss"),
        F.avg("market_loss").alias("market_log_loss"), F.avg(F.log("n_runners")).alias("uniform_log_loss"))
    gained = F.col("uniform_log_loss") - F.col("model_log_loss")
    return out.withColumns({
        "capture": F.try_divide(gained, F.col("uniform_log_loss") - F.col("market_log_loss")),
        "passes": F.col("model_log_loss") < F.col("market_log_loss"),
    })


def completion_check(raw: DataFrame, calibrated: DataFrame, entries: DataFrame) -> DataFrame:
    """Model against market, once on all validated events (raw) and once on the flagged ones (calibrated).

    Both frames hold race_id, y_true and y_pred; the market is scored on the very same events. ``passes`` of a
    population without events is null: undecided, not failed.
    """
    market = market_scores(entries)
    parts = [compare_with_market(group_log_loss(rows), market).withColumn("population", F.lit(name))
             for name, rows in (("all", raw), ("g1", calibrated))]
    return parts[0].unionByName(parts[1])


def blend_losses(rows: DataFrame, a: str, b: str, weights: Sequence[float]) -> DataFrame:
    """Group log-loss of ``p proportional to a^(1-w) * b^w`` per event, one column per weight, in one pass.

    ``rows`` holds race_id, the two probabilities and the tie-split label ``y``.
    """
    log_a, log_b = F.log(F.greatest(F.col(a), F.lit(EPS))), F.log(F.greatest(F.col(b), F.lit(EPS)))
    mixed = lambda w: (1 - w) * log_a + w * log_b
    sums = [F.sum(F.exp(mixed(w))).alias(f"_z{i}") for i, w in enumerate(weights)]
    dots = [F.sum(F.col("y") * mixed(w)).alias(f"_d{i}") for i, w in enumerate(weights)]
    groups = rows.groupBy("race_id").agg(F.sum("y").alias("_y"), *sums, *dots)
    return groups.select("race_id", *[(F.col("_y") * F.log(f"_z{i}") - F.col(f"_d{i}")).alias(f"l{i}") for i in range(len(weights))])


def blend_grid(rows: DataFrame, a: str, b: str, weights: Sequence[float]) -> DataFrame:
    """Mean group log-loss of the blend for each weight."""
    means = blend_losses(rows, a, b, weights).agg(*[F.avg(f"l{i}").alias(f"l{i}") for i in range(len(weights))])
    points = F.explode(F.array(*[F.struct(F.lit(float(w)).alias("w"), F.col(f"l{i}").alias("log_loss"))
                                 for i, w in enumerate(weights)]))
    return means.select(points.alias("p")).select("p.*")


def ablation(scores: DataFrame, y: str = "y") -> DataFrame:
    """Effect of a changed input: ``scores`` holds race_id, horse_id, y, and the scores before and after.

    Change of the mean group log-loss and share of groups whose likeliest member changed.
    """
    rows = softmax(softmax(scores, "race_id", "score", "_p"), "race_id", "score_without", "_q")
    pick = lambda c: F.min_by("horse_id", F.struct(-F.col(c), "horse_id"))
    loss = lambda c: F.sum(F.when(F.col(y) > 0, -F.col(y) * F.log(F.greatest(F.col(c), F.lit(EPS)))).otherwise(F.lit(0.0)))
    groups = rows.groupBy("race_id").agg(
        loss("_p").alias("a"), loss("_q").alias("b"), (pick("_p") != pick("_q")).cast("double").alias("moved"))
    return groups.agg(F.count("*").alias("n_races"), F.avg("a").alias("log_loss"), F.avg("b").alias("log_loss_without"),
                      F.avg(F.col("b") - F.col("a")).alias("effect"), F.avg("moved").alias("top_changed"))


def null_coverage(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Nulls per column of a slice, one row per column."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    points = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns]))
    return counts.select(*by, "n", points.alias("p")).select(*by, "n", "p.*")


PROFILE = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def paired_difference(model: DataFrame, market: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-event log-loss difference, the unit a paired bootstrap resamples."""
    return model.join(market.select("race_id", F.col("log_loss").alias("_m")), "race_id").select(
        "race_id", *by, (F.col("log_loss") - F.col("_m")).alias("difference"))
