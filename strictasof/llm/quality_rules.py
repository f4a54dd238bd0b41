"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule rejects a document whose score reaches a cutoff. Cutoffs are chosen per stratum (language) on labelled rows that
no model has seen: going from the most lenient cutoff to stricter ones, a cutoff is certified while the exact binomial
(Clopper-Pearson) upper bound of its false rejections among good documents stays within ``limit``, and the walk stops at
the first that fails. Walking in a fixed order needs no correction for the number of cutoffs; the error is divided by the
number of rules and strata (Bonferroni), so with probability 1 - ``error`` every rule in every stratum rejects at most
``limit`` of the good documents. Of the certified cutoffs the most lenient of those with the largest surplus of bad over
good rejections is used; a rule with none rejects nothing. Languages with too few good holdout rows to certify anything share one stratum.

The toxicity score uses words that labelled toxic documents favour; they are learned from a bounded sample of labelled
rows (``fit_rows``) kept apart from the holdout. Everything else is counted over all rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, widened
from .registry import query

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: rules in the order of their scores; all scores run from 0 to 1
RULES = ("symbols", "dup_lines", "repeats", "toxicity")
#: cutoffs tried per rule: 1/STEPS .. 1
STEPS = 64
#: labelled rows the toxic words are learned from, and how many words are kept
FIT_ROWS, FIT_WORDS = 20_000, 20_000
#: share of tenths of the labelled ids that are kept for fitting; the others are the holdout
FIT_TENTHS = 3
LIMIT, ERROR = 0.01, 0.05
EDGES = ".,;:!?\"'()[]"


def base_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    words = text.encode().split()
    spaces = sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times, inside = Counter(windows), bytearray(len(words))
        for i, window in enumerate(windows):
            if times[window] > 1:
                inside[i:i + 3] = b"\1\1\1"
        repeated = sum(inside)
    return len(words), len(text) - spaces, symbols, again, repeated, lines


def plain_words(text: str) -> set[str]:
    return {w.strip(EDGES) for w in text.lower().split()}


def toxic_words(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, words: int = FIT_WORDS) -> dict[str, float]:
    """Weights in (0, 1] of words that occur more often in toxic than in good documents of a bounded labelled sample."""
    order = F.xxhash64("doc_id", F.lit("fit"))
    sample = labels.where("fit").orderBy(order, "doc_id").limit(rows).select("doc_id", "toxic", "good")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("toxic or good")

    def count(batches):
        for batch in batches:
            n = {True: Counter(), False: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n[toxic].update(plain_words(text or ""))
                n[toxic][""] += 1
            rows_out = [(w, n[True][w], n[False][w]) for w in n[True].keys() | n[False].keys()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_out)] if rows_out else [[], [], []], ["word", "t", "g"])

    counted = stage(texts.select("text", "toxic").mapInArrow(count, "word string, t long, g long").groupBy("word").agg(
        F.sum("t").alias("t"), F.sum("g").alias("g")), "toxic-words")
    whole = counted.where("word = ''").first()
    if not whole or not whole.t or not whole.g:
        return {}
    odds = F.log((F.col("t") + 0.5) / (whole.t + 1)) - F.log((F.col("g") + 0.5) / (whole.g + 1))
    best = counted.where("word <> '' and t >= 3").withColumn("odds", odds).where("odds > 0").orderBy(F.desc("odds"), "word").limit(words)
    return {r.word: min(1.0, r.odds / 10) for r in best.collect()}


def scores(docs: DataFrame, weights: dict[str, float], text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (``text`` only if asked for) with the base counts and the score of each rule.

    Null counts as empty. Columns of the added names are replaced.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if (c != text or keep_text) and c not in (*counts, *RULES)]
    schema = widened(docs.select(*kept), ", ".join([f"{c} long" for c in counts] + [f"{c} double" for c in RULES]))

    def score(batches):
        for batch in batches:
            out = []
            for value in batch.column(text):
                t = value.as_py() or ""
                n, chars, symbols, again, repeated, lines = base_counts(t)
                toxic = max((weights.get(w, 0.0) for w in plain_words(t)), default=0.0) if weights else 0.0
                out.append((n, chars, symbols, again, repeated, min(1.0, symbols / max(1, chars)), again / max(1, lines),
                            repeated / max(1, n), toxic))
            columns = list(zip(*out)) or [()] * 9
            arrays = [pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], [*kept, *counts, *RULES])

    return docs.select(*kept, *[text] * (text not in kept)).mapInArrow(score, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly up to rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k, dtype=np.float64)
    ratios = np.log(n - i) - np.log(i + 1) + math.log(p) - math.log1p(-p)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(ratios)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, limit: float, error: float) -> int | None:
    """The step whose cutoff is used, from counts of good and bad holdout rows by step (0 .. STEPS), or None.

    ``good[s]`` and ``bad[s]`` count rows whose score lies in step s; cutoff s rejects rows of step s and above.
    """
    n, best, chosen = int(good.sum()), 0, None
    for step in range(STEPS, 0, -1):
        wrong, right = int(good[step:].sum()), int(bad[step:].sum())
        if n == 0 or wrong > limit * n or binomial_tail(wrong, n, limit) > error:
            break
        if right - wrong > best:
            best, chosen = right - wrong, step
    return chosen


def _step(score: str) -> Column:
    return F.least(F.lit(STEPS), F.floor(F.col(score) * STEPS).cast("int"))


def prepared_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good, poor, toxic, fit), one row per id: the worst of several labels counts; null ids are left out."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return one.select("doc_id", ((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).alias("good"), (F.col("q") == 0).alias("poor"),
                      (F.coalesce("t", F.lit(0)) == 1).alias("toxic"),
                      (F.pmod(F.xxhash64("doc_id"), F.lit(10)) < FIT_TENTHS).alias("fit")).fillna(False)


def cutoffs(scored: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR, stratum: str = "lang") -> DataFrame:
    """(_stratum, _step_<rule> ...): the certified step of each rule, null where none is. Strata are languages.

    The row of null _stratum is the shared stratum's, for languages that the holdout does not have; without languages
    that share it there is none.
    """
    least = math.ceil(math.log(error / (50 * len(RULES))) / math.log1p(-limit))
    held = labels.where("not fit").drop("fit")
    seen = scored.select("doc_id", F.coalesce(stratum, F.lit("")).alias("_stratum"), *[_step(r).alias(r) for r in RULES]).join(held, "doc_id")
    seen = stage(seen.groupBy("_stratum", *RULES).agg(*[F.count_if(c).alias(c) for c in ("good", "poor", "toxic")]), "holdout")
    size = seen.groupBy("_stratum").agg(F.sum("good").alias("n")).withColumn("_into", F.when(F.col("n") >= least, F.col("_stratum")).otherwise(F.lit("")))
    size = size.select("_stratum", "_into")
    merged = seen.join(size, "_stratum").drop("_stratum")
    long = merged.select("_into", F.explode(F.array(*[F.struct(
        F.lit(i).alias("rule"), F.col(r).alias("step"), "good", (F.col("toxic") if r == "toxicity" else F.col("poor")).alias("bad"))
        for i, r in enumerate(RULES)])).alias("x")).groupBy("_into", "x.rule", "x.step").agg(
        F.sum("x.good").alias("good"), F.sum("x.bad").alias("bad"))
    tests = len(RULES) * max(1, size.agg(F.count_distinct("_into").alias("n")).first().n)
    names = [f"_step_{r}" for r in RULES]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"_into": rows["_into"].iloc[0]}
        for i, name in enumerate(names):
            good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
            mine = rows[rows["rule"] == i]
            np.add.at(good, mine["step"].to_numpy(), mine["good"].to_numpy())
            np.add.at(bad, mine["step"].to_numpy(), mine["bad"].to_numpy())
            out[name] = certified_cutoff(good, bad, limit, error / tests)
        return pd.DataFrame([out]).astype({n: "Int32" for n in names})

    chosen = long.groupBy("_into").applyInPandas(choose, "_into string, " + ", ".join(f"{n} int" for n in names))
    places = size.union(size.where("_into = ''").select(F.lit(None).cast("string"), "_into").distinct())
    return stage(places.join(chosen, "_into").drop("_into"), "cutoffs")


def judged(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR, keep_text: bool = False) -> DataFrame:
    """``docs`` (text only if asked for) with base counts, base_failed, the rules that reject (array) and kept.

    A language without labels uses the shared stratum's cutoffs where there are such, else only the base rules. Without
    labels nothing but the base rules rejects. Null texts have no words and fail the base rules.
    """
    marks = prepared_labels(labels)
    docs = docs.drop("base_failed", "rejected_by", "kept")
    scored = stage(scores(docs, toxic_words(docs, marks), keep_text=keep_text), "scored")
    chosen = cutoffs(scored, marks, limit, error)
    shared = chosen.where("_stratum is null").first()
    rows = scored.withColumn("_stratum", F.coalesce("lang", F.lit(""))).join(chosen.withColumn("_own", F.lit(True)), "_stratum", "left")
    least = {r: F.when(F.col("_own"), F.col(f"_step_{r}")).otherwise(F.lit(shared and shared[f"_step_{r}"]).cast("int")) for r in RULES}
    hit = F.array_compact(F.array(*[F.when(_step(r) >= least[r], F.lit(r)) for r in RULES]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(*[c for c in scored.columns if c not in RULES], failed.alias("base_failed"), hit.alias("rejected_by"),
                       (~failed & (F.size(hit) == 0)).alias("kept"))


@query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    """Every document under the base rules and the certified rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
