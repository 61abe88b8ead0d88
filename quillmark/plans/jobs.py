"""The maintenance jobs as pipelines over catalogues, recipe files, histories and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import category, replace_between_markers, required, splice_brackets, strip_prefix
from ..operators import diff, lookup, sets
from ..operators.merge import merge_with_history
from ..operators.mapping import Table
from ..sources import lua, po, tabular
from .tables import ITEM_TABLE, RECIPE_TABLE, item_rows, recipe_rows

#: Prefixes that tell stations from craftings.
STATIONS, CRAFTINGS = "STRINGS.UI.CRAFTING_STATION_FILTERS.", "STRINGS.UI.CRAFTING_FILTERS."
#: The first and last of the filter lists that are published.
FIRST_FILTER, LAST_FILTER = "CRAFTING_FILTERS.CHARACTER.recipes", "CRAFTING_FILTERS.DECOR.recipes"


@dataclass
class Published:
    """A table's merged rows, what changed against history (null without one), and the document."""

    rows: DataFrame
    changes: DataFrame | None
    content: DataFrame


def _publish(table: Table, rows: DataFrame, history: DataFrame | None, sources: str, description: str) -> Published:
    """Merge first, then compare, so columns that history keeps never show as changed."""
    changes = None
    if history is not None:
        rows = merge_with_history(rows, history, table.key, table.policies())
        changes = diff.keyed_diff(rows, history, table.key)
    return Published(rows, changes, tabular.document(table, rows, sources, description, "pos"))


def parse_catalogue(entries: DataFrame, only: str | None = None) -> DataFrame:
    return entries if only is None else po.of_category(entries, only)


def maintain_items(entries: DataFrame, history: DataFrame | None, sources: str, description: str = "") -> Published:
    """The item table of a catalogue; history holds the columns of ITEM_TABLE and `pos`."""
    return _publish(ITEM_TABLE, item_rows(entries), history, sources, description)


def maintain_recipes(recipes: DataFrame, entries: DataFrame | None, history: DataFrame | None, sources: str, description: str = "") -> Published:
    """The recipe table; history holds the columns of RECIPE_TABLE and `pos`."""
    return _publish(RECIPE_TABLE, recipe_rows(recipes, entries), history, sources, description)


def tech_report(recipes: DataFrame, page: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of counts, and the techs that recipes use and the page (`content`) does not list."""
    used, listed = recipes.select(F.col("tech").alias("name")), sets.listed_names(page, "content")
    return sets.set_report(used, listed), sets.missing_names(used, listed)


def tech_report_text(recipes: DataFrame, page: DataFrame) -> DataFrame:
    """One row, `report`."""
    return sets.report_text(recipes.select(F.col("tech").alias("name")), sets.listed_names(page, "content"))


def compare_report(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """One row, `report`: what differs between two tables, with its summary."""
    found = diff.keyed_diff(new, old, key)
    return diff.detailed_report(found, diff.diff_summary(found, new, old), key)


def crafting_names(entries: DataFrame) -> DataFrame:
    """One row, `content`: stations and craftings with their names, sorted by key, the last of a key."""
    context = F.col("msgctxt")
    bucket = category(context, {STATIONS: "crafting_stations", CRAFTINGS: "craftings"})
    key = F.coalesce(strip_prefix(context, STATIONS), strip_prefix(context, CRAFTINGS))
    named = entries.select(bucket.alias("bucket"), key.alias("key"), F.col("msgid").alias("station_en"), F.col("msgstr").alias("station_cn"), "pos")
    nested = lookup.nested_names(named, "bucket", "key", ["station_en", "station_cn"], "pos")
    pick = [F.coalesce(F.max(F.when(F.col("bucket") == b, F.to_json("names"))), F.lit("{}")) for b in ("crafting_stations", "craftings")]
    return nested.agg(F.concat(F.lit('{"crafting_stations":'), pick[0], F.lit(',"craftings":'), pick[1], F.lit("}")).alias("content"))


def copy_variable(source: DataFrame, page: DataFrame, name: str, end_name: str | None = None) -> DataFrame:
    """One row, `content`: the page with the source's assignment, or range of them, between its markers.

    It is an error if the source has no such assignment or the page no markers in their order."""
    span = lua.read_spans(source, "content", name, end_name).agg(F.first("content").alias("new"))
    new = required(F.col("new"), f"the source does not assign {name}" + (f" and then {end_name}" if end_name else ""))
    edited = replace_between_markers(F.col("old"), new)
    return page.select(F.col("content").alias("old")).crossJoin(span).select(required(edited, "the page lacks a start and an end marker, in this order").alias("content"))  # one row each


def copy_filters(source: DataFrame, page: DataFrame) -> DataFrame:
    return copy_variable(source, page, FIRST_FILTER, LAST_FILTER)


def copy_names(entries: DataFrame, page: DataFrame) -> DataFrame:
    """One row, `content`: the page with the names' JSON between its outer brackets."""
    new = crafting_names(entries).select(F.col("content").alias("new"))
    return page.select(F.col("content").alias("old")).crossJoin(new).select(required(splice_brackets(F.col("old"), F.col("new")), "the page has no pair of double brackets").alias("content"))  # one row each


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.orderBy("pos").limit(n)


def text_changes(old: str, new: str, pair: DataFrame) -> DataFrame:
    """What a page edit would change, line by line; pair has one row with both columns and `k`."""
    return diff.line_diff(pair, "k", old, new)


