"""Places in stored markup, as column expressions, and values declared by place, pattern and type."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decode import unescape
from ..functions import scalars as S


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null when the pattern does not match (``regexp_extract`` gives '').

    The pattern is tried once: asking first whether it matches would read a long element twice."""
    return F.get(found_all(text, pattern, group), F.lit(0))


def found_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def number(text: Column, kind: str = "int") -> Column:
    return text.try_cast(kind)


def filled(text: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(text, F.lit(""))


def plain(markup: Column, tag: str = "") -> Column:
    """Markup without tags and entities, white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(markup, "<.*?>", tag)), r"(?U)\s+", " "))


def element(tag: str, named: str | None = None) -> str:
    """Pattern of an element with its content as the group; ``named`` is part of one of its attributes."""
    marked = "" if named is None else f'[^>]*"[^">]*{named}[^">]*"'
    return rf"(?s)<{tag}\b{marked}[^>]*>(.*?)</{tag}>"


def after(label: str, value: str) -> str:
    """Pattern of a value that a label and a colon introduce."""
    return rf"(?:{label})\s*[:：]\s*({value})"


def linked(folder: str) -> str:
    """Pattern of the key in a link into a folder."""
    return rf'href="[^"]*?/{folder}/(\w*)/?"'


@dataclass(frozen=True)
class Value:
    """A value: the column it stands in, the pattern that shows it (None for all of it), its type, stored names."""

    place: str
    pattern: str | None = None
    kind: str = "string"
    names: Mapping[str, str] | None = None

    def column(self) -> Column:
        text = F.col(self.place)
        text = text if self.pattern is None else found(text, self.pattern)
        text = plain(text) if self.kind == "string" else F.trim(unescape(text))
        if self.names is not None:
            return S.lookup(text, self.names)
        return filled(text) if self.kind == "string" else number(text, self.kind)


def read(rows: DataFrame, values: Mapping[str, Value]) -> DataFrame:
    return rows.withColumns({name: value.column() for name, value in values.items()})


# --- printed tables: rows of cells, addressed by heading -------------------------------------------------------

ROW, CELL = element("tr"), r"(?s)<t[hd]\b[^>]*>(.*?)</t[hd]>"


def printed_rows(pages: DataFrame, table: Column, *keep: str) -> DataFrame:
    """(kept columns, line, cells): the rows below the heading row, cells as a map from heading to markup.

    Of two columns with one heading the first counts; a row shorter than the heading row lacks its last cells.
    """
    # pages without rows end at the explode; a filter before it would read every page once more
    rows = pages.select(*keep, found_all(table, ROW).alias("_rows"))
    rows = rows.select(*keep, F.transform(found_all(F.get("_rows", F.lit(0)), CELL), lambda h: plain(h)).alias("_names"),
                       F.posexplode("_rows").alias("line", "_row")).where("line > 0")
    pairs = F.arrays_zip(F.col("_names").alias("name"), found_all(F.col("_row"), CELL).alias("cell"))
    first = F.filter(pairs, lambda p, i: p["name"].isNotNull() & p["cell"].isNotNull()
                     & (F.array_position("_names", p["name"]) == i + 1))
    return rows.select(*keep, "line", F.map_from_entries(first).alias("cells"))


def with_cells(rows: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """The markup of named cells as columns."""
    return rows.withColumns({name: F.try_element_at("cells", F.lit(heading)) for name, heading in headings.items()})
