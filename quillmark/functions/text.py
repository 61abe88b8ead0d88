"""Text functions as Column expressions. All of them give null for null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers between which text is replaced.
START_MARK, END_MARK = "-- COPYCLIPSTART --", "-- COPYCLIPEND --"
_SPACE = r"\p{IsWhite_Space}"
_IN_NAME = r"[\p{IsAlphabetic}\p{N}_]"


def strip_prefix(text: Column, prefix: str) -> Column:
    """What follows the prefix; null where the text does not start with it."""
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1)))


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; the empty text has none, and a last line end opens no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def position(text: Column, part: str) -> Column:
    """0-based character position of the first occurrence; null if there is none."""
    return F.nullif(F.instr(text, part), F.lit(0)) - 1


def last_position(text: Column, part: str) -> Column:
    """0-based character position of the last occurrence; null if there is none."""
    return F.when(text.contains(part), F.length(text) - F.length(F.substring_index(text, part, -1)) - len(part))


def slice_text(text: Column, begin: Column, end: Column) -> Column:
    """Characters from begin up to, not including, end."""
    return F.substr(text, begin + 1, end - begin)


def replace_identifier(text: Column, name: str, value: str) -> Column:
    """Every occurrence of the name that is not part of a longer name."""
    quoted = value.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?<!{_IN_NAME})\\Q{name}\\E(?!{_IN_NAME})", quoted)


def lua_concat(left: Column, right: Column) -> Column:
    """Concatenation where a missing right side is empty and a missing left side spoils the whole."""
    return F.concat(left, F.coalesce(right, F.lit("")))


def between_markers(text: Column, start: str = START_MARK, end: str = END_MARK) -> Column:
    """The text between the first start and the first end marker; null where one is missing or they are crossed."""
    a, b = position(text, start), position(text, end)
    return F.when(a < b, slice_text(text, a + len(start), b))


def replace_between_markers(text: Column, new: Column, start: str = START_MARK, end: str = END_MARK) -> Column:
    """The text with `new` between its markers, on lines of its own; null as in between_markers."""
    a, b = position(text, start), position(text, end)
    before = F.when(new.startswith("\n"), "").otherwise("\n")
    after = F.when(new.endswith("\n"), "").otherwise("\n")
    return F.when(a < b, F.concat(slice_text(text, F.lit(0), a + len(start)), before, new, after, slice_text(text, b, F.length(text))))


def required(text: Column, message: str) -> Column:
    """The text; an error where it is null."""
    return F.coalesce(text, F.raise_error(F.lit(message)).cast("string"))


def splice_brackets(text: Column, new: Column, opening: str = "[[", closing: str = "]]") -> Column:
    """`new` and a line end from the first opening to the last closing brackets; null where they do not enclose."""
    a, b = position(text, opening), last_position(text, closing)
    return F.when(a < b, F.concat(slice_text(text, F.lit(0), a + len(opening)), new, F.lit("\n"), slice_text(text, b, F.length(text))))


def quoted_token(line: Column, prefix: str) -> Column:
    """The first quoted token of a line that opens with a quote and the prefix; null for other lines."""
    bare = trim_space(line)
    return F.nullif(F.regexp_extract(bare, f"^(?:'({re.escape(prefix)}[^']*)|\"({re.escape(prefix)}[^\"]*))", 0), F.lit("")).substr(2, 1 << 30)


def parse_int(text: Column) -> Column:
    """A 32-bit integer, or null."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("int"))


def parse_float(text: Column) -> Column:
    """A 32-bit float, or null; surrounding white space is not accepted."""
    return F.when(text.rlike(r"^\S+$"), text.try_cast("float"))


def parse_bool(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def at_index(values: Column, index: Column) -> Column:
    """The 1-based item of a comma-separated list; null outside."""
    items = F.split(values, r"\s*,\s*")
    return F.when(index >= 1, F.get(items, index - 1))


def show_value(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def show_change(name: Column, old: Column, new: Column) -> Column:
    return F.concat(name, F.lit(": "), show_value(old), F.lit(" => "), show_value(new))


def category(key: Column, prefixes: dict[str, str]) -> Column:
    """The category of the first prefix that the key starts with; null for none."""
    found = F.lit(None).cast("string")
    for prefix, name in reversed(prefixes.items()):
        found = F.when(key.startswith(prefix), name).otherwise(found)
    return found
