"""Linear Plackett-Luce ranker: gradients over groups, many models fitted by the same passes, scores, drivers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouped import softmax, top_per_group, with_group_stats
from ..operators.keys import require_disjoint
from ..session import release, stage_table
from .declared import OTHER_FAMILY, family
from .probability import tie_split_label

MIN_HESSIAN = 1e-6
WINNER_LABEL = 3
MEMBER = ("race_id", "horse_id")
#: members up to which an event is stored as one row while models are fitted
SMALL_EVENT = 64
CELLS = "model int, cell int, v double"


def placed_stages(rows: DataFrame, group: Sequence[str], member: Sequence[str], top_k: int = 3) -> DataFrame:
    """Add ``stage``: 1..k for the best labelled members of a group (ties in member order), null for the rest."""
    order = [F.col("label").desc(), *[F.col(c) for c in member]]
    best = top_per_group(rows.where(F.col("label") > 0), group, order, top_k, rank="stage")
    keys = list(dict.fromkeys([*group, *member]))
    return rows.join(best.select(*keys, "stage"), keys, "left")


def pl_gradient(rows: DataFrame, z: Column, group: Sequence[str] = ("race_id",), top_k: int = 3,
                weight: Column | None = None) -> DataFrame:
    """Add ``grad`` and ``hess`` of the top-k Plackett-Luce negative log-likelihood; needs ``stage``.

    At stage k the members placed before k are out. Each stage has its own maximum and partition sum, all taken
    in the same two aggregates per group.
    """
    group = list(group)
    alive = [F.col("stage").isNull() | (F.col("stage") >= k) for k in range(1, top_k + 1)]
    tops = {f"_top{k}": F.max(F.when(a, F.col("_z"))) for k, a in enumerate(alive, 1)}
    scored = with_group_stats(rows.withColumn("_z", z), group, tops | {"_placed": F.max("stage")})
    scored = scored.withColumns({f"_e{k}": F.when(a, F.exp(F.col("_z") - F.col(f"_top{k}"))).otherwise(F.lit(0.0))
                                 for k, a in enumerate(alive, 1)})
    scored = with_group_stats(scored, group, {f"_sum{k}": F.sum(f"_e{k}") for k in range(1, top_k + 1)})
    p = [F.when(F.col("_placed") >= k, F.col(f"_e{k}") / F.col(f"_sum{k}")).otherwise(F.lit(0.0)) for k in range(1, top_k + 1)]
    w = F.lit(1.0) if weight is None else weight
    grad = sum(p[1:], p[0]) - F.when(F.col("stage").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    hess = F.greatest(sum([q * (1 - q) for q in p[1:]], p[0] * (1 - p[0])), F.lit(MIN_HESSIAN))
    helpers = ["_z", "_placed", *tops, *[f"_e{k}" for k in range(1, top_k + 1)], *[f"_sum{k}" for k in range(1, top_k + 1)]]
    return scored.withColumns({"grad": grad * w, "hess": hess * w}).drop(*helpers)


# --- events as units of a fit ---------------------------------------------------------------------------

def event_units(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(a stored table with one row per event and its members in a list, the stored rows of events that have no such row).

    ``rows`` holds ``keys``, stage, sample_weight, _won, _x and _roles, the role of the event in each model. Rounds of a fit
    then move no rows. Events of over ``SMALL_EVENT`` members, without a key or with several roles stay rows; None if there
    are none.
    """
    rows = stage_table(rows)
    odd = F.col("_members") > SMALL_EVENT
    for k in keys:
        odd = odd | F.col(k).isNull()
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_members"), F.min("_roles").alias("_low"), F.max("_roles").alias("_high"))
    odd = sizes.where(odd | (F.col("_low") != F.col("_high"))).select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    large = None
    small = rows
    if not odd.isEmpty():
        odd = stage_table(odd)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        small, large = rows.join(odd, same, "left_anti"), stage_table(rows.join(odd, same, "left_semi"))
    member = F.struct(F.coalesce(F.col("stage").cast("int"), F.lit(0)).alias("stage"), F.coalesce("sample_weight", F.lit(0.0)).cast("double").alias("weight"),
                      F.coalesce("_won", F.lit(False)).alias("won"), F.col("_x").alias("x"))
    units = stage_table(small.groupBy(*keys, "_roles").agg(F.collect_list(member).alias("_members")).select("_roles", "_members"))
    release(rows)
    return units, large


def _members_of(batch, size: int):
    """(role per event and model, event per member, stage, weight, won, inputs) of a batch of units."""
    lists = batch.column("_members")
    of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    stage, weight, won, x = lists.flatten().flatten()
    roles = batch.column("_roles").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return (roles, of, *[c.to_numpy(zero_copy_only=False) for c in (stage, weight, won)],
            x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def _starts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members of the events, and the events' numbers among those that are left."""
    border = np.ones(len(of), bool)
    border[1:] = of[1:] != of[:-1]
    return np.flatnonzero(border), np.cumsum(border) - 1


def _placing(z: np.ndarray, stage: np.ndarray, starts: np.ndarray, of: np.ndarray, top_k: int) -> list[np.ndarray]:
    """Per stage each member's probability to be the one placed there (see :func:`pl_gradient`)."""
    placed = np.maximum.reduceat(stage, starts)[of]
    out = []
    for k in range(1, top_k + 1):
        alive = (stage == 0) | (stage >= k)
        with np.errstate(invalid="ignore"):
            top = np.maximum.reduceat(np.where(alive, z, -np.inf), starts)[of]
            e = np.where(alive, np.exp(z - top), 0.0)
            out.append(np.where(placed >= k, e / np.add.reduceat(e, starts)[of], 0.0))
    return out


def unit_cells(units: DataFrame, weights: Mapping[int, np.ndarray], size: int, top_k: int, role: str, cells) -> DataFrame:
    """(model, cell, v) of every task: ``cells(z, p, stage, weight, won, x, starts, of)`` summed over the units that have the
    ``role`` in the model. ``weights`` are those of the models that still run, by their number among the roles."""
    def work(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            roles, of, stage, weight, won, x = _members_of(batch, size)
            for m, w in weights.items():
                mine = (roles[:, m] == role)[of]
                if not mine.any():
                    continue
                own = slice(None) if mine.all() else mine
                starts, events = _starts(of[own])
                z = x[own] @ w
                found = cells(z, _placing(z, stage[own], starts, events, top_k), stage[own], weight[own], won[own], x[own], starts, events)
                totals[m] = totals[m] + found if m in totals else found
        for m, total in totals.items():
            filled = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.full(len(filled), m), pa.int32()), pa.array(filled, pa.int32()), pa.array(total[filled])],
                                  names=["model", "cell", "v"])

    return units.select("_roles", "_members").mapInArrow(work, CELLS)


def summed(cells: DataFrame, size: int) -> dict[int, np.ndarray]:
    """The cells of all tasks, added up by Spark: ``size`` numbers per model."""
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("model", "cell").agg(F.sum("v").alias("v")).collect():  # one row per model and cell
        out.setdefault(r.model, np.zeros(size))[r.cell] = r.v
    return out


def _slopes(z, p, stage, weight, won, x, starts, of):
    """Gradient and curvature per input."""
    grad = (sum(p) - (stage > 0)) * weight
    hess = np.maximum(sum(q * (1 - q) for q in p), MIN_HESSIAN) * weight
    return np.concatenate([grad @ x, hess @ (x * x)])


def _event_losses(z, p, stage, weight, won, x, starts, of):
    """Sum of the events' log-losses, and their number."""
    gap = z - np.maximum.reduceat(z, starts)[of]
    winners = np.add.reduceat(won.astype(float), starts)
    with np.errstate(all="ignore"):
        loss = np.log(np.add.reduceat(np.exp(gap), starts)) - np.add.reduceat(np.where(won, gap, 0.0), starts) / winners
    return np.array([np.where(winners > 0, loss, 0.0).sum(), len(starts)])


@dataclass(frozen=True)
class Rankers:
    """Weights per model name, in feature order."""

    features: tuple[str, ...]
    weights: dict[str, list[float]]
    rounds: dict[str, int]
    losses: dict[str, list[float]]

    def table(self, spark) -> DataFrame:
        rows = [(m, f, float(w)) for m, ws in self.weights.items() for f, w in zip(self.features, ws)]
        return spark.createDataFrame(rows, "model string, feature string, weight double")

    def score(self, model: str, without: Sequence[str] = ()) -> Column:
        """Linear score; features named in ``without`` count as missing."""
        kept = [(f, w) for f, w in zip(self.features, self.weights[model]) if f not in without]
        return _dot([f for f, _ in kept], [w for _, w in kept]) if kept else F.lit(0.0)

    def require_columns(self, columns: Sequence[str]) -> None:
        if tuple(columns) != self.features:
            raise ValueError(f"feature order differs: fitted on {self.features}, given {tuple(columns)}")


def _x(feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("double"), F.lit(0.0))


def _dot(features: Sequence[str], weights: Sequence[float]) -> Column:
    terms = [_x(f) * F.lit(float(w)) for f, w in zip(features, weights)]
    return sum(terms[1:], terms[0])


def fit_rankers(rows: DataFrame, features: Sequence[str], models: Mapping[str, Column], rounds: int = 20,
                step: float = 0.7, ridge: float = 1.0, top_k: int = 3, patience: int | None = None,
                member: Sequence[str] = MEMBER) -> Rankers:
    """Fit all models together; one round is one pass over the events, whatever the number of models, and moves no rows.

    ``models`` maps a model name to a role expression over the rows: 'train', 'valid' or null. Events belong to a
    role as a whole. ``rows`` holds race_id, label, sample_weight and the features; it should be a stored table.
    With ``patience`` a model keeps the weights of its best validation log-loss and stops that many rounds later;
    otherwise it takes all rounds.
    """
    names, size = list(models), len(features)
    roles = F.array(*[role.cast("string") for role in models.values()])
    staged = placed_stages(rows, ["race_id"], member, top_k)
    units, large = event_units(staged.select(
        "race_id", "label", "stage", "sample_weight", (F.col("label") == WINNER_LABEL).alias("_won"), roles.alias("_roles"),
        F.array(*[_x(f) for f in features]).alias("_x")), ["race_id"])
    used = None
    if large is not None:  # a row per model that it has a role in
        parts = [F.when(F.col("_roles")[i].isNotNull(), F.struct(F.lit(n).alias("model"), F.col("_roles")[i].alias("role"))) for i, n in enumerate(names)]
        used = stage_table(large.withColumn("_m", F.explode(F.array_compact(F.array(*parts)))).select(
            "_m.model", "_m.role", "race_id", "label", "stage", "sample_weight", "_x"))
        release(large)
    weights = {n: [0.0] * size for n in names}
    best = {n: (float("inf"), 0, weights[n]) for n in names}
    losses: dict[str, list[float]] = {n: [] for n in names}
    running = set(names)
    now = lambda: {i: np.array(weights[n]) for i, n in enumerate(names) if n in running}
    for round_ in range(1, rounds + 1):
        found = summed(unit_cells(units, now(), size, top_k, "train", _slopes), 2 * size)
        slopes = {n: found.get(i, np.zeros(2 * size)) for i, n in enumerate(names) if n in running}
        if used is not None:
            for n, more in _large_slopes(used, {n: weights[n] for n in running}, size, top_k).items():
                slopes[n] = slopes[n] + more
        for n, s in slopes.items():
            weights[n] = [float(w - step * (s[i] + ridge * w) / (s[size + i] + ridge)) for i, w in enumerate(weights[n])]
        if patience is not None:
            totals = summed(unit_cells(units, now(), size, top_k, "valid", _event_losses), 2)
            totals = {n: totals.get(i, np.zeros(2)) for i, n in enumerate(names) if n in running}
            if used is not None:
                for n, more in _valid_losses(used, {n: weights[n] for n in running}).items():
                    totals[n] = totals[n] + more
            for name, (total, n_events) in totals.items():
                if not n_events:
                    continue
                loss = total / n_events
                losses[name].append(loss)
                if loss < best[name][0]:
                    best[name] = (loss, round_, weights[name])
                elif round_ - best[name][1] >= patience:
                    running.discard(name)
            if not running:
                break
    release(*[t for t in (units, used) if t is not None])
    if patience is None:
        return Rankers(tuple(features), weights, {n: rounds for n in names}, losses)
    chosen = {n: best[n][2] if best[n][1] else weights[n] for n in names}
    return Rankers(tuple(features), chosen, {n: max(1, best[n][1]) for n in names}, losses)


def _large_slopes(used, weights, size, top_k):
    """Gradient and curvature per input over the rows of events that are no units."""
    graded = pl_gradient(_weighted(used.where("role = 'train'"), weights), F.col("_z"), ["model", "race_id"], top_k, F.col("sample_weight"))
    sums = [F.sum(F.col("grad") * F.col("_x")[i]).alias(f"g{i}") for i in range(size)]
    sums += [F.sum(F.col("hess") * F.col("_x")[i] * F.col("_x")[i]).alias(f"h{i}") for i in range(size)]
    return {r["model"]: np.array([r[f"{s}{i}"] or 0.0 for s in "gh" for i in range(size)])
            for r in graded.groupBy("model").agg(*sums).collect()}  # one row per model


def _weighted(used, weights):
    """Rows of the given models with their score: one weight array per model, joined by its name."""
    table = used.sparkSession.createDataFrame(sorted(weights.items()), "model string, _w array<double>")
    products = F.zip_with("_x", "_w", lambda x, w: x * w)
    return used.join(F.broadcast(table), "model").withColumn("_z", F.aggregate(products, F.lit(0.0), lambda a, p: a + p)).drop("_w")


def _valid_losses(used, weights):
    rows = _weighted(used.where(F.col("role") == "valid"), weights)
    rows = with_group_stats(rows, ["model", "race_id"], {"_top": F.max("_z")})
    winner = F.col("label") == WINNER_LABEL
    gap = F.col("_z") - F.col("_top")
    groups = rows.groupBy("model", "race_id").agg(
        F.sum(F.exp(gap)).alias("s"), F.sum(F.when(winner, gap)).alias("d"), F.count_if(winner).alias("n"))
    loss = F.when(F.col("n") > 0, F.log("s") - F.col("d") / F.col("n")).otherwise(F.lit(0.0))
    totals = groups.groupBy("model").agg(F.sum(loss).alias("loss"), F.count("*").alias("n"))
    return {r["model"]: np.array([r["loss"], r["n"]]) for r in totals.collect()}  # one row per model


def win_probability(rows: DataFrame, score: Column, out: str = "win_prob") -> DataFrame:
    return softmax(rows.withColumn("score", score), "race_id", "score", out)


def labelled_truth(rows: DataFrame, out: str = "y_true") -> DataFrame:
    return tie_split_label(rows, F.col("label") == WINNER_LABEL, out)


# --- walk-forward ---------------------------------------------------------------------------------------

def walk_forward(rows: DataFrame, features: Sequence[str], folds: Sequence, flagged: Column, n_blocks: int = 4,
                 rounds: int = 20, patience: int = 3, member: Sequence[str] = MEMBER):
    """Validation scores of every fold and the fold's calibration scores, as two frames.

    Per fold: one model chooses the number of rounds on the last training year, one is fitted on the whole
    training range, and one per block on the rest of the range scores the flagged events of its block. All models
    of all folds share their passes. ``rows`` holds date, label, sample_weight and the features.

    Returns (validation: member.., fold_index, score, y_true, y_pred; calibration: race_id, fold_index, score,
    is_winner; rounds per fold).
    """
    from .folds import cross_fit_block

    day = F.col("date")
    selection = {}
    for f in folds:
        inner = day.between(F.lit(f["inner_valid_start"]), F.lit(f["train_end"]))
        trained = day.between(F.lit(f["train_start"]), F.lit(f["train_end"]))
        selection[f"select:{f['fold_index']}"] = F.when(inner, "valid").when(trained, "train")
    chosen = fit_rankers(rows, features, selection, rounds, patience=patience, member=member)
    fold_rounds = {f["fold_index"]: chosen.rounds[f"select:{f['fold_index']}"] for f in folds}

    valid_parts, oof_parts = [], []
    for n in sorted(set(fold_rounds.values())):  # folds with the same number of rounds share their passes
        group = [f for f in folds if fold_rounds[f["fold_index"]] == n]
        models = {}
        for f in group:
            trained = day.between(F.lit(f["train_start"]), F.lit(f["train_end"]))
            models[f"full:{f['fold_index']}"] = F.when(trained, "train")
            block = cross_fit_block(day, f["train_start"], f["train_end"], n_blocks)
            for b in range(n_blocks):
                models[f"block:{f['fold_index']}:{b}"] = F.when(trained & (block != b), "train")
        fitted = fit_rankers(rows, features, models, n, member=member)
        for f in group:
            i = f["fold_index"]
            here = F.when(day.between(F.lit(f["valid_start"]), F.lit(f["valid_end"])),
                          F.struct(F.lit(i).cast("long").alias("fold_index"), fitted.score(f"full:{i}").alias("score")))
            valid_parts.append(here)
            block = cross_fit_block(day, f["train_start"], f["train_end"], n_blocks)
            scores = F.coalesce(*[F.when(block == b, fitted.score(f"block:{i}:{b}")) for b in range(n_blocks)])
            oof_parts.append(F.when(flagged & block.isNotNull(),
                                    F.struct(F.lit(i).cast("long").alias("fold_index"), scores.alias("score"))))
    keys = list(member)
    expand = lambda parts: rows.withColumn("_f", F.explode(F.array_compact(F.array(*parts)))).select(
        *keys, "label", "_f.fold_index", "_f.score")
    valid = labelled_truth(softmax(expand(valid_parts), "race_id", "score", "y_pred")).drop("label")
    oof = expand(oof_parts).withColumn("is_winner", F.col("label") == WINNER_LABEL).drop("label")
    return require_disjoint(valid, keys, "fold_index"), oof, fold_rounds


# --- drivers --------------------------------------------------------------------------------------------

def drivers(rows: DataFrame, rankers: Rankers, model: str, top_k: int = 6, member: Sequence[str] = MEMBER) -> DataFrame:
    """The feature families that move a row's score most: weight times value, summed per family, top k by size.

    The model is linear, so contributions are expressions of the row itself and nothing is shuffled.
    """
    families: dict[str, Column] = {}
    for f, w in zip(rankers.features, rankers.weights[model]):
        term = _x(f) * F.lit(float(w))
        name = family(f)
        families[name] = families[name] + term if name in families else term
    parts = F.array(*[F.struct(F.abs(c).alias("size"), F.lit(n).alias("family"), c.alias("contribution")) for n, c in families.items()])
    ranked = F.slice(F.sort_array(parts, asc=False), 1, top_k)
    return rows.select(*member, F.posexplode(ranked).alias("rank", "_d")).select(
        *member, (F.col("rank") + 1).alias("rank"), "_d.family", "_d.contribution")
