"""Weather tables in stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header names of the ten weather columns.
WEATHER_HEADER = (
    "Time", "Temperature", "Dew Point", "Humidity", "Wind",
    "Wind Speed", "Wind Gust", "Pressure", "Precip.", "Condition",
)


# Character references that tables use, ampersand last.
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
SEPARATOR = "\x01"


def _cell_texts(cells: Column) -> Column:
    """Visible text of all cells; they are cleaned together, one pass per page and not per cell."""
    text = F.regexp_replace(F.array_join(cells, SEPARATOR), r"(?s)<[^>]*>", "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"[\s\u00a0]+", " ")
    return F.transform(F.split(text, SEPARATOR), lambda c: F.trim(c))


def _header_at(cells: Column, header: Sequence[str]) -> Column:
    """Place (from 0) of the first ``len(header)`` cells that are exactly the header's names, in any order; null without."""
    names, width = F.array(*map(F.lit, header)), len(header)
    spots = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(cells) - width, F.lit(0))),
        # only a name can start the header, and only a name can end it: hardly a place is left to take a slice of
        lambda k: F.array_contains(names, F.get(cells, k)) & F.array_contains(names, F.get(cells, k + width - 1)) & (F.size(F.array_except(names, F.slice(cells, k + 1, width))) == 0))
    return F.try_element_at(spots, F.lit(1))


def _observation_tables(df: DataFrame, html: str, header: Sequence[str]) -> DataFrame:
    """Per page the cells of the table that holds the header (_cells) and where the header starts in it (_at)."""
    kept = [c for c in df.columns if c != html]
    raw = F.transform(
        F.split(F.col(html), r"(?i)</table\s*>"),
        lambda part: F.regexp_extract_all(part, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>"), F.lit(1)))
    # a table with fewer cells than the header cannot hold it, and its cells need no cleaning
    cells = F.transform(F.filter(raw, lambda t: F.size(t) >= len(header)), _cell_texts)
    tables = df.select(*kept, cells.alias("_tables"))
    places = F.transform("_tables", lambda t: F.struct(t.alias("cells"), _header_at(t, header).alias("at")))
    # the first table with all names; only its cells go on
    held = tables.select(*kept, F.try_element_at(F.filter(places, lambda t: t["at"].isNotNull()), F.lit(1)).alias("_held"))
    return held.select(*kept, F.col("_held.cells").alias("_cells"), F.col("_held.at").alias("_at"))


def html_cells(df: DataFrame, html: str, header: Sequence[str] = WEATHER_HEADER) -> DataFrame:
    """Cells of the observation table of each page, in document order, as rows under the page's own header row.

    The observation table is the first one with ``len(header)`` consecutive cells that are the header's names, in any
    order; cells before them and other tables of the page do not count. A page without such a table gives no rows. In an
    incomplete last row the missing cells are null; ``incomplete_rows`` counts such pages. Everything happens inside the
    row of the page: no shuffle, and pages of any number are independent.
    """
    width = len(header)
    kept = [c for c in df.columns if c != html]
    named = _observation_tables(df, html, header).select(
        *kept, "_cells", "_at", F.slice("_cells", F.col("_at") + 1, F.lit(width)).alias("_head"),
        F.ceil((F.size("_cells") - F.col("_at")) / width).cast("int").alias("_rows"))
    # an outer explode, filtered afterwards: no filter moves below it, so pages are matched once
    body = F.when(F.col("_rows") > 1, F.sequence(F.lit(1), F.col("_rows") - 1))
    rows = named.select(*kept, "_head", "_cells", "_at", F.explode_outer(body).alias("row")).where(F.col("row").isNotNull())
    row = rows.select(*kept, "row", "_head", F.slice("_cells", F.col("_at") + F.col("row") * width + 1, F.lit(width)).alias("_row"))

    def cell(name: str) -> Column:
        return F.try_element_at("_row", F.nullif(F.array_position("_head", F.lit(name)).cast("int"), F.lit(0)))

    return row.select(*kept, "row", *[cell(name).alias(name) for name in header])


def incomplete_rows(df: DataFrame, html: str, header: Sequence[str] = WEATHER_HEADER) -> DataFrame:
    """Number of pages whose observation table ends in an incomplete row."""
    tables = _observation_tables(df, html, header)
    return tables.where((F.size("_cells") - F.col("_at")) % len(header) != 0).agg(F.count("*").alias("incomplete"))
