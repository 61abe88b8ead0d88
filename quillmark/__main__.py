"""Commands over files: python -m quillmark COMMAND ... ; pages are edited only with --yes."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import jobs
from .plans.tables import ITEM_TABLE, RECIPE_TABLE
from .sources import archive, lua, po, tabular
from .sources.pages import PageStore


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


def _options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmark")
    commands = top.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse-po", help="the entries of a catalogue")
    parse.add_argument("catalogue")
    parse.add_argument("--category")
    for name, source in (("items", "catalogue"), ("recipes", "recipes")):
        c = commands.add_parser(name, help=f"the table of {name}, merged with a page's or a file's history")
        c.add_argument(source)
        if name == "recipes":
            c.add_argument("--catalogue", help="where descriptions are looked up")
        c.add_argument("--history", help="a tabular JSON file")
        c.add_argument("--version", default="unknown")
    copy = commands.add_parser("copy", help="an assignment of a Lua file between the markers of a page")
    copy.add_argument("source")
    copy.add_argument("variable")
    copy.add_argument("--end")
    names = commands.add_parser("names", help="crafting names between the brackets of a page")
    names.add_argument("catalogue")
    for c in (parse, *(commands.choices[x] for x in ("items", "recipes", "copy", "names"))):
        c.add_argument("--out", help="a folder for the result")
        c.add_argument("--pages", help="the folder of a page store")
        c.add_argument("--title", help="the page to edit")
        c.add_argument("--yes", action="store_true", help="write the page")
    return top


def _deliver(args: argparse.Namespace, store: PageStore | None, content: DataFrame, json: bool) -> None:
    if args.out:
        content.write.text(args.out)
    if store is not None and args.title:
        print(store.edit(args.title, content, confirmed=args.yes, json=json))


def main(argv: list[str] | None = None) -> None:
    args = _options().parse_args(argv)
    spark = SparkSession.builder.appName("quillmark").getOrCreate()
    store = PageStore(spark, args.pages) if args.pages else None
    if args.command == "parse-po":
        entries = jobs.parse_catalogue(po.read_files(spark, args.catalogue), args.category)
        entries.write.json(args.out) if args.out else jobs.preview(entries, 10).show(truncate=60)
    elif args.command in {"items", "recipes"}:
        table = ITEM_TABLE if args.command == "items" else RECIPE_TABLE
        history = tabular.read_rows(_whole(spark, args.history), table.fields) if args.history else None
        sources = archive.sources_text(args.version)
        if args.command == "items":
            result = jobs.maintain_items(po.read_files(spark, args.catalogue), history, sources)
        else:
            entries = po.read_files(spark, args.catalogue) if args.catalogue else None
            result = jobs.maintain_recipes(lua.read_recipes(_whole(spark, args.recipes), "content"), entries, history, sources)
        jobs.preview(result.rows).show(truncate=30)
        if result.changes is not None:
            result.changes.groupBy("status").count().orderBy("status").show()
        _deliver(args, store, result.content, json=True)
    elif store is None or not args.title:
        raise SystemExit("a page is needed: --pages and --title")
    elif args.command == "copy":
        _deliver(args, store, jobs.copy_variable(_whole(spark, args.source), store.get(args.title), args.variable, args.end), json=False)
    else:
        _deliver(args, store, jobs.copy_names(po.read_files(spark, args.catalogue), store.get(args.title)), json=False)


if __name__ == "__main__":
    main()
