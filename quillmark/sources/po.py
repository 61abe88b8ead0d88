"""Gettext catalogues: whole files in, one row for each entry out."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category, strip_prefix

#: Prefixes of message contexts, and their categories.
CATEGORIES = {
    "STRINGS.NAMES.": "NAMES",
    "STRINGS.ACTIONS.": "ACTIONS",
    "STRINGS.CHARACTERS.": "CHARACTERS",
    "STRINGS.RECIPE_DESC.": "RECIPE_DESC",
    "STRINGS.UI.": "UI",
}
#: Escapes of a quoted string; a backslash before anything else stands for itself.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"'}
_QUOTED = r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)'
_STRING = rf"{_QUOTED}(?:\n *{_QUOTED})*"
_HEADER = re.compile(rf'msgid ""\nmsgstr ""((?:\n *{_QUOTED})*)\n*', re.S)
_ENTRY = re.compile(rf"(?:#[ .:|]*([^\n]*)\n)?(?:msgctxt +({_STRING})\n)?msgid +({_STRING})\nmsgstr +({_STRING})\n*", re.S)
_ONE = re.compile(_QUOTED, re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
ENTRY = "pos bigint, msgctxt string, msgid string, msgstr string, comment string"


def _parts(text: str) -> list[str]:
    bare = (m[0][1:-1] if len(m[0]) > 1 and m[0].endswith('"') else m[0][1:] for m in _ONE.finditer(text))
    return [_ESCAPE.sub(lambda m: _ESCAPES.get(m[1], m[0]), p) for p in bare]


#: White space as Unicode has it; Python's own strip() takes U+001C to U+001F for it as well.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _value(text: str | None) -> str | None:
    return None if text is None else "".join(_parts(text)).strip(_WHITE)


def parse(text: str | None) -> tuple[str | None, list[tuple[str | None, str, str, str | None]]]:
    """The header, and (context, id, translation, comment) of the entries before the first malformed one.

    There is a header only if the text starts with one. Values are unescaped, joined and then trimmed."""
    text = (text or "").replace("\r\n", "\n")
    header, at = None, 0
    if m := _HEADER.match(text):
        header, at = "\n".join(p.strip(_WHITE) for p in _parts(m[1])), m.end()
    while text.startswith("\n", at):
        at += 1
    entries = []
    while m := _ENTRY.match(text, at):
        entries.append((_value(m[2]), _value(m[3]), _value(m[4]), m[1].strip(_WHITE) if m[1] is not None else None))
        at = m.end()
    return header, entries


class _Entries:
    def eval(self, text: str) -> Iterator[tuple]:
        for pos, entry in enumerate(parse(text)[1]):
            yield (pos, *entry)


class _Header:
    def eval(self, text: str) -> Iterator[tuple]:
        yield (parse(text)[0],)


po_entries = F.udtf(_Entries, returnType=ENTRY)
po_header = F.udtf(_Header, returnType="header string")


def register(spark: SparkSession) -> None:
    """Make `po_entries(text)` and `po_header(text)` known to SQL."""
    spark.udtf.register("po_entries", po_entries)
    spark.udtf.register("po_header", po_header)


def read_headers(files: DataFrame, text: str, *carry: str) -> DataFrame:
    """The header of each file's text, null if it does not start with one, and columns to carry along."""
    return files.alias("file").lateralJoin(po_header(F.col(f"file.{text}").outer()).alias("h")).select(*(F.col(f"file.{c}") for c in carry), "h.header")


def read_entries(files: DataFrame, text: str, *carry: str) -> DataFrame:
    """The entries of each file's text, and columns to carry along. One call for each file."""
    return files.alias("file").lateralJoin(po_entries(F.col(f"file.{text}").outer()).alias("entry")).select(*(F.col(f"file.{c}") for c in carry), "entry.*")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all catalogues under a path, with `path`."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return read_entries(files, "value", "path")


def with_category(entries: DataFrame) -> DataFrame:
    return entries.withColumn("category", category(F.col("msgctxt"), CATEGORIES))


def of_category(entries: DataFrame, name: str) -> DataFrame:
    return with_category(entries).where(F.col("category") == name).drop("category")


def entity_names(entries: DataFrame) -> DataFrame:
    """code, name of the entries that name something."""
    code = strip_prefix(F.col("msgctxt"), "STRINGS.NAMES.")
    return entries.select(code.alias("code"), F.col("msgstr").alias("name")).where("code is not null")


def quoted(value: Column) -> Column:
    """The value as a quoted string of a catalogue."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), value, F.lit('"'))


def entry_text(context: Column, msgid: Column, msgstr: Column) -> Column:
    """The lines of one entry, to be joined by empty lines."""
    return F.concat(F.lit("msgctxt "), quoted(context), F.lit("\nmsgid "), quoted(msgid), F.lit("\nmsgstr "), quoted(msgstr))
