"""The two published tables: item names, and recipes with six ingredient slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_prefix
from ..operators.lookup import last_wins, with_fallbacks
from ..operators.mapping import KEEP_FILLED, Table, TableBuilder

NAMES, DESCRIPTIONS, SLOTS = "STRINGS.NAMES.", "STRINGS.RECIPE_DESC.", 6


def _item_table() -> Table:
    b = TableBuilder()
    b.field("id", "string").title(en="Id", zh="标识").required().key("id")
    b.field("name_cn", "string").title(en="Chinese name", zh="中文名").field("name_en", "string").title(en="English name", zh="英文名")
    b.field("item_img1", "string").title(en="Image", zh="图片").default("")
    b.computed("id", lambda df: F.lower(F.coalesce(strip_prefix(F.col("msgctxt"), NAMES), F.col("msgctxt"))))
    b.direct("name_cn", "msgstr").direct("name_en", "msgid")
    b.transformed("item_img1", "msgid", lambda df: F.concat("msgid", F.lit(".png")))
    for target in ("name_cn", "name_en", "item_img1"):
        b.policy(target, KEEP_FILLED)
    return b.build()


def _slot(i: int, member: str):
    return lambda df: F.get("ingredients", F.lit(i))[member]


def _recipe_table() -> Table:
    b = TableBuilder().field("recipe_name", "string").required().key("recipe_name").direct("recipe_name", "name")
    for i in range(SLOTS):
        b.field(f"ingredient{i + 1}", "string").computed(f"ingredient{i + 1}", _slot(i, "item"))
        b.field(f"amount{i + 1}", "integer").computed(f"amount{i + 1}", _slot(i, "amount"))
    b.field("product", "string").computed("product", lambda df: F.coalesce("product", "name"))
    b.field("numtogive", "integer").computed("numtogive", lambda df: F.coalesce("numtogive", F.lit(1)))
    for name, kind in (("override_numtogive_fn", "boolean"), ("tech", "string"), ("hint_msg", "string"), ("description", "string"), ("nounlock", "boolean"), ("no_deconstruction", "boolean"), ("unlocks_from_skin", "boolean"), ("station_tag", "string"), ("builder_tag", "string"), ("builder_skill", "string")):
        b.field(name, kind).direct(name, name)
    b.field("desc", "string").ignored("desc").policy("desc", KEEP_FILLED)
    return b.build()


ITEM_TABLE, RECIPE_TABLE = _item_table(), _recipe_table()


def item_rows(entries: DataFrame) -> DataFrame:
    """The rows of the entries that name something, in their order."""
    named = entries.where(F.coalesce(F.col("msgctxt").startswith(NAMES), F.lit(False)))
    return ITEM_TABLE.map(named, "pos")


def recipe_rows(recipes: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The rows of recipes in their order, with descriptions from the catalogue's entries if there are any.

    A recipe with a description of its own is looked up by that alone, others by product, then by name."""
    rows = RECIPE_TABLE.map(recipes, "pos", F.col("product").alias("_product"))
    if entries is not None:
        dim = last_wins(entries, "msgctxt", "msgstr", "pos")
        rows = with_fallbacks(rows.drop("desc"), dim, "msgctxt", "msgstr", "description", ["_product", "recipe_name"], DESCRIPTIONS, "desc")
    return rows.select(*RECIPE_TABLE.names(), "pos")
