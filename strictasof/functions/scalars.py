"""Column expressions shared by the feature operators."""

from __future__ import annotations

import calendar
from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def lookup(column: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Map a column through a small fixed table."""
    chain = None
    for key, value in table.items():
        test = column == F.lit(key)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain.otherwise(default) if default is not None else chain


def distance_band(distance: Column) -> Column:
    (bound, name), *rest = V.DISTANCE_BANDS
    chain = F.when(distance <= bound, F.lit(name))
    for bound, name in rest:
        chain = chain.when(distance <= bound, F.lit(name))
    return chain.otherwise(F.lit(V.LONGEST_BAND))


def season(day: Column) -> Column:
    chain = F  # F.when starts the chain, Column.when continues it
    for name, months in V.SEASONS.items():
        chain = chain.when(F.month(day).isin(*months), F.lit(name))
    return chain.otherwise(F.lit(V.WINTER))


def track_condition_code(text: Column) -> Column:
    return lookup(text, V.TRACK_CONDITION_CODES)


def class_key(grade: Column, race_class: Column) -> Column:
    return F.coalesce(grade, race_class, F.lit(V.OTHER_CLASS))


def clip(x: Column, bound: float) -> Column:
    """``x`` held inside [-bound, bound]; null stays null (greatest and least skip nulls by themselves)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))


def element_where(values: Column, keys: Column, key) -> Column:
    """The element of ``values`` at the position where ``keys`` holds ``key``; null when absent."""
    return F.try_element_at(values, F.nullif(F.array_position(keys, key).cast("int"), F.lit(0)))


def last_element(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def minus_years(day: Column, years) -> Column:
    """``years`` earlier; 29 February becomes 28 February."""
    return F.add_months(day, -12 * years)


def minus_years_date(day: date, years: int) -> date:
    last_day = calendar.monthrange(day.year - years, day.month)[1]
    return day.replace(year=day.year - years, day=min(day.day, last_day))


def changed(a: Column, b: Column) -> Column:
    """1.0 when both are known and differ, else 0.0."""
    return F.when(a != b, F.lit(1.0)).otherwise(F.lit(0.0))


def changed_or_null(a: Column, b: Column) -> Column:
    """1.0 when they differ, null counting as a value of its own."""
    return F.when(~a.eqNullSafe(b), F.lit(1.0)).otherwise(F.lit(0.0))


def margin_lengths(text: Column) -> Column:
    """Margin notation as lengths: a word, ``a.b/c``, ``b/c`` or a decimal; anything else is null."""
    t = F.trim(text)
    fraction = r"^(?:(\d+)\.)?(\d+)/(\d+)$"
    whole = F.coalesce(F.regexp_extract(t, fraction, 1).try_cast("double"), F.lit(0.0))
    top = F.regexp_extract(t, fraction, 2).try_cast("double")
    bottom = F.regexp_extract(t, fraction, 3).try_cast("double")
    return (
        F.when(t.isin(*V.MARGIN_WORDS), lookup(t, V.MARGIN_WORDS))
        .when(t.rlike(fraction), whole + F.try_divide(top, bottom))
        .otherwise(t.try_cast("double"))
    )


def shrink(n: Column, mean: Column, k: float, mu: Column) -> Column:
    """``(n*mean + k*mu) / (n+k)``; the prior itself when there is no sample."""
    return F.when((n > 0) & mean.isNotNull(), (n * mean + F.lit(k) * mu) / (n + F.lit(k))).otherwise(mu)


def unavailable(value: Column, structural: Column) -> Column:
    """1 where the value is missing for a structural reason, else 0."""
    return F.when(value.isNull() & structural, F.lit(1)).otherwise(F.lit(0))


def flag(condition: Column) -> Column:
    """1 where true, else 0 (null counts as 0)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ran(status: Column) -> Column:
    return status.isin(*V.RAN)


def finished(status: Column) -> Column:
    return status.isin(*V.FINISHED)


def not_void(status: Column) -> Column:
    return ~status.isin(*V.VOID)


def first_contained(text: Column, words: Iterable[str]) -> Column:
    """The first vocabulary word that the text contains, in vocabulary order."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def home_away(affiliation: Column, course: Column) -> Column:
    """0 at a home course, 1 away, null when the affiliation has no home."""
    (first, courses), *rest = V.HOME_COURSES.items()
    away = lambda names: F.when(course.isin(*names), F.lit(0)).otherwise(F.lit(1))
    chain = F.when(affiliation == first, away(courses))
    for name, courses in rest:
        chain = chain.when(affiliation == name, away(courses))
    return chain


def sealed(day: Column, grade: Column, today: date, years: int = 3) -> Column:
    """Flagged events of the last ``years`` years, kept away from training and evaluation."""
    start = minus_years_date(today, years)
    inside = day.between(F.lit(start), F.lit(today))
    return F.coalesce((grade == V.FLAGGED_GRADE) & inside, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))
