"""A declarative subset of Lua: spans of assignments, and recipe tables.

A tokenizer and a recursive descent read local and plain assignments, calls, tables, names with
dots and indices, `..`, numeric for loops and for loops over a table written out. Functions are
skipped by balancing their ends. What a value cannot be worked out for is null.

Tokens are made as the parser asks for them. Recipes that are written out, with nothing in them to
work out, are read by one pattern and never cut into tokens; any others go the general way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ingredient and tuning constants stand for.
INGREDIENTS = {
    "CHARACTER_INGREDIENT.HEALTH": "decrease_health",
    "CHARACTER_INGREDIENT.MAX_HEALTH": "half_health",
    "CHARACTER_INGREDIENT.SANITY": "decrease_sanity",
    "CHARACTER_INGREDIENT.MAX_SANITY": "half_sanity",
    "CHARACTER_INGREDIENT.OLDAGE": "decrease_oldage",
    "TECH_INGREDIENT.SCULPTING": "sculpting_material",
}
TUNING = {"TUNING.EFFIGY_HEALTH_PENALTY": 40}
#: Option keys by kind.
TEXT_OPTIONS = "builder_tag builder_skill product placer image testfn action_str filter_text sg_state description icon_atlas icon_image hint_msg station_tag".split()
FLAG_OPTIONS = "nounlock no_deconstruction override_numtogive_fn is_crafting_station unlocks_from_skin".split()
_TOKEN = re.compile(
    r"""(?P<skip>\s+|--\[\[.*?\]\]|--[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\[\[.*?\]\])
    |(?P<number>0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>\.\.\.|\.\.|==|~=|<=|>=|.)""",
    re.S | re.X,
)
_OPENS = {"function", "do", "then", "repeat"}
# A recipe of strings without escapes, plain numbers and flags: each part ends where its tokens would, and nothing is tried twice.
# _REST finds the end of the statement: what follows is a name, which can't go on with the call, or nothing.
_STRING = r"""(?:"[^"\\\n]*+"|'[^'\\\n]*+')"""
_INGREDIENT = rf"Ingredient\s*+\(\s*+{_STRING}\s*+,\s*+[0-9]{{1,9}}+\s*+\)"
_OPTION = rf"[A-Za-z_]\w*+\s*+=\s*+(?:{_STRING}|(?:[0-9]++(?:\.[0-9]++)?+|true|false)(?=\s*+[,}}]))"
_SERIES = r"\{{\s*+((?:{0}(?:\s*+,\s*+{0})*+)?+)\s*+,?+\s*+\}}"
_PLAIN = re.compile(rf"Recipe2\s*+\(\s*+({_STRING})\s*+,\s*+{_SERIES.format(_INGREDIENT)}\s*+,\s*+(TECH\.[A-Za-z_]\w*+)\s*+(?:,\s*+{_SERIES.format(_OPTION)}\s*+)?+\)")
_REST = re.compile(r"(?>\s+|--\[\[.*?\]\]|--[^\n]*)*+(?:(?!(?:and|or)\b)(?=[A-Za-z_])|\Z)", re.S)
# The parts of series that _PLAIN has matched.
_INGREDIENTS = re.compile(r"""("[^"]*"|'[^']*')\s*,\s*([0-9]+)""")
_OPTIONS = re.compile(r"""(\w+)\s*=\s*(?:("[^"]*"|'[^']*')|([0-9.]+)|(true|false))""")
INGREDIENT_TYPE = "array<struct<item:string,amount:int,atlas:string,image:string>>"
RECIPE = f"pos bigint, name string, ingredients {INGREDIENT_TYPE}, tech string, " + ", ".join(f"{o} string" for o in TEXT_OPTIONS) + ", numtogive int, min_spacing float, " + ", ".join(f"{o} boolean" for o in FLAG_OPTIONS)
_FIELDS = ["pos", "name", "ingredients", "tech", *TEXT_OPTIONS, "numtogive", "min_spacing", *FLAG_OPTIONS]
_INGREDIENT_KINDS = {"item": pa.string(), "amount": pa.int32(), "atlas": pa.string(), "image": pa.string()}
_KINDS = dict.fromkeys(["name", "tech", *TEXT_OPTIONS], pa.string()) | {"numtogive": pa.int32(), "min_spacing": pa.float32()} | dict.fromkeys(FLAG_OPTIONS, pa.bool_())
#: Recipes that are handed over at once.
_ROWS_AT_ONCE = 1 << 14


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    begin: int
    end: int


def tokens(source: str, begin: int = 0) -> Iterator[Token]:
    return (Token(m.lastgroup, m[0], *m.span()) for m in _TOKEN.finditer(source, begin) if m.lastgroup != "skip")


@dataclass(slots=True)
class Node:
    """An expression: text, number, flag, nil, path, call, table, concat, or other for what is not read."""

    kind: str
    value: Any = None
    items: list = field(default_factory=list)
    begin: int = 0
    end: int = 0


@dataclass(slots=True)
class Statement:
    kind: str  # assign, call, for, or recipes, whose values are rows
    names: list[str]
    values: list[Node]
    local: bool = False
    body: list = field(default_factory=list)
    begin: int = 0
    end: int = 0


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.coming, self.at = source, [], tokens(source), 0

    def has(self, ahead: int = 0) -> bool:
        """Whether there is such a token; those up to it are made."""
        while len(self.tokens) <= self.at + ahead:
            if (t := next(self.coming, None)) is None:
                return False
            self.tokens.append(t)
        return True

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].text if self.has(ahead) else ""

    def take(self) -> Token:
        self.has()
        self.at += 1
        return self.tokens[self.at - 1]

    def kind(self) -> str:
        return self.tokens[self.at].kind if self.has() else ""

    def last_end(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def block(self, inner: bool = False) -> list[Statement]:
        """Statements up to the end of the source, or of the block that is open."""
        found = []
        while self.has() and not (inner and self.peek() in {"end", "else", "elseif", "until"}):
            before = self.at
            if (s := self.statement()) is not None:
                found.append(s)
            if self.at == before:
                self.at += 1
        return found

    def skip_block(self) -> None:
        """Past the end of the block whose opening word was just taken."""
        depth = 1
        while depth and self.has():
            word = self.take()
            if word.kind == "name":
                depth += (word.text in {"function", "do", "if", "repeat"}) - (word.text in {"end", "until"})

    def statement(self) -> Statement | None:
        begin = self.tokens[self.at].begin
        word = self.peek()
        if word == "function" or (word == "local" and self.peek(1) == "function"):
            self.at += 1 + (word == "local")
            self.skip_block()
            return None
        if word in {"if", "do", "repeat"}:
            self.at += 1
            self.skip_block()
            return None
        if word == "while":
            while self.has() and self.take().text != "do":
                pass
            self.skip_block()
            return None
        if word == "for":
            return self.loop(begin)
        if word == "Recipe2" and (rows := self.plain_recipes()):
            return Statement("recipes", [word], rows, begin=begin, end=self.last_end())
        local = word == "local"
        if local:
            self.at += 1
        if self.kind() != "name":
            return None
        targets = [self.expression()]
        while self.peek() == ",":
            self.at += 1
            targets.append(self.expression())
        if self.peek() == "=":
            self.at += 1
            values = self.listed()
            return Statement("assign", [t.value if t.kind == "path" else self.source[t.begin : t.end] for t in targets], values, local, begin=begin, end=self.last_end())
        if len(targets) == 1 and targets[0].kind == "call":
            return Statement("call", [targets[0].value], targets[0].items, begin=begin, end=self.last_end())
        return None

    def plain_recipes(self) -> list[dict[str, Any]]:
        """The rows of the recipes from here on that are written out, all taken as one token; none if a value of the
        first must be worked out, or if its call goes on, so that it is no statement yet."""
        found, begin, end = [], self.tokens[self.at].begin, 0
        at = begin
        while (m := _PLAIN.match(self.source, at)) and (rest := _REST.match(self.source, m.end())):
            name, ingredients, tech, options = m.groups()
            listed = [(i[1:-1].strip(), int(n), None, None) for i, n in _INGREDIENTS.findall(ingredients)]
            found.append({"name": name[1:-1].strip(), "ingredients": listed, "tech": tech, **(_plain_options(options) if options else {})})
            at, end = rest.end(), m.end()
        if found:
            self.tokens[self.at :] = [Token("recipes", self.source[begin:end], begin, end)]
            self.coming = tokens(self.source, at)
            self.at += 1
        return found

    def loop(self, begin: int) -> Statement:
        self.at += 1
        names = [self.take().text]
        while self.peek() == ",":
            self.at += 1
            names.append(self.take().text)
        numeric = self.take().text == "="
        values = self.listed()
        if self.peek() == "do":
            self.at += 1
        body = self.block(inner=True)
        self.at += 1
        return Statement("numeric for" if numeric else "for", names, values, body=body, begin=begin, end=self.last_end())

    def listed(self) -> list[Node]:
        found = [self.expression()]
        while self.peek() == ",":
            self.at += 1
            found.append(self.expression())
        return found

    def expression(self) -> Node:
        begin = self.tokens[self.at].begin if self.has() else len(self.source)
        left = self.operand()
        while self.peek() == "..":
            self.at += 1
            left = Node("concat", items=[left, self.operand()])
        if self.peek() in {"+", "-", "*", "/", "%", "^", "==", "~=", "<", ">", "<=", ">=", "and", "or"}:
            self.at += 1
            self.expression()
            left = Node("other")
        left.begin, left.end = begin, self.last_end()
        return left

    def operand(self) -> Node:
        if not self.has():
            return Node("other")
        t = self.take()
        if t.kind == "string":
            return Node("text", (t.text[2:-2] if t.text.startswith("[[") else t.text[1:-1]).strip())
        if t.kind == "number":
            return Node("number", t.text)
        if t.text in {"true", "false"}:
            return Node("flag", t.text == "true")
        if t.text == "nil":
            return Node("nil")
        if t.text == "function":
            self.skip_block()
            return Node("other")
        if t.text in {"-", "not", "#"}:
            inner = self.operand()
            return Node("number", "-" + inner.value) if t.text == "-" and inner.kind == "number" else Node("other")
        if t.text == "(":
            inner = self.expression()
            if self.peek() == ")":
                self.at += 1
            return inner
        if t.text == "{":
            return self.table()
        if t.kind == "name":
            return self.suffixed(t)
        return Node("other")

    def table(self) -> Node:
        items: list[tuple[str | None, Node]] = []
        while self.has() and self.peek() != "}":
            key = None
            if self.kind() == "name" and self.peek(1) == "=":
                key = self.take().text
                self.at += 1
            elif self.peek() == "[":
                self.at += 1
                inner = self.expression()
                key = str(inner.value)
                self.at += 1 + (self.peek(1) == "=")
            before = self.at
            items.append((key, self.expression()))
            if self.peek() in {",", ";"}:
                self.at += 1
            elif self.at == before:
                self.at += 1
        self.at += 1
        return Node("table", items=items)

    def suffixed(self, first: Token) -> Node:
        path, node = first.text, Node("path", first.text)
        while True:
            if self.peek() in {".", ":"} and self.has(1):
                sign = self.take().text
                path += sign + self.take().text
                node = Node("path", path)
            elif self.peek() == "[":
                self.at += 1
                inner = self.expression()
                self.at += self.peek() == "]"
                node = Node("index", path, [inner])
                path += "[]"
            elif self.peek() == "(":
                self.at += 1
                items = self.listed() if self.peek() != ")" else []
                self.at += self.peek() == ")"
                node = Node("call", path, items)
            elif self.kind() == "string" or self.peek() == "{":
                node = Node("call", path, [self.operand()])
            else:
                return node


class Evaluator:
    """Works out values in an environment of names; inner names hide outer ones."""

    def __init__(self, names: dict[str, Node] | None = None):
        self.names = names or {}

    def known(self, node: Node) -> Node:
        for _ in range(16):
            if node.kind == "path" and node.value in self.names:
                node = self.names[node.value]
            elif node.kind == "index" and (table := self.known(Node("path", node.value))).kind == "table":
                place = self.number(node.items[0])
                listed = [v for k, v in table.items if k is None]
                node = listed[place - 1] if place and 1 <= place <= len(listed) else Node("nil")
            else:
                break
        return node

    def text(self, node: Node) -> str | None:
        """A string, a number as text, or an ingredient constant; unknown constants and names are null."""
        node = self.known(node)
        if node.kind == "concat":
            left, right = (self.text(x) for x in node.items)
            return None if left is None else left + (right or "")
        if node.kind in {"text", "number"}:
            return node.value
        return INGREDIENTS.get(node.value) if node.kind == "path" else None

    def number(self, node: Node) -> int | None:
        node = self.known(node)
        if node.kind == "path":
            return TUNING.get(node.value)
        bare = node.value.strip() if node.kind in {"number", "text"} else ""
        return int(bare) if re.fullmatch(r"[+-]?[0-9]+", bare) and -(2**31) <= int(bare) < 2**31 else None


def _ingredient(call: Node, ev: Evaluator) -> tuple | None:
    args = [*call.items, *[Node("nil")] * 5]
    item = ev.text(args[0])
    amount = ev.number(args[1])
    if not call.items or item is None:
        return None
    return item, 1 if amount is None else amount, ev.text(args[2]), ev.text(args[4]) if ev.text(args[4]) is not None else ev.text(args[3])


def _recipe(args: list[Node], ev: Evaluator) -> dict[str, Any] | None:
    """The recipe of a call; null if its name or its tech cannot be read."""
    if len(args) < 3 or (name := ev.text(args[0])) is None or args[2].kind != "path" or "." not in args[2].value:
        return None
    listed = ev.known(args[1])
    calls = [v for _, v in listed.items if v.kind == "call" and v.value == "Ingredient"] if listed.kind == "table" else []
    row: dict[str, Any] = {"name": name, "ingredients": [i for c in calls if (i := _ingredient(c, ev)) is not None], "tech": args[2].value}
    options = ev.known(args[3]) if len(args) > 3 else Node("nil")
    for key, value in options.items if options.kind == "table" else []:
        _set_option(row, key, value, ev)
    return row


def _set_option(row: dict[str, Any], key: str | None, value: Node, ev: Evaluator) -> None:
    key = "action_str" if key == "actionstr" else key
    node = ev.known(value)
    if key in TEXT_OPTIONS:
        row[key] = ev.text(value)
    elif key == "numtogive":
        row[key] = ev.number(value)
    elif key == "min_spacing":
        row[key] = float(node.value) if node.kind == "number" and not node.value.lower().startswith(("0x", "-0x")) else None
    elif key in FLAG_OPTIONS:
        # A function instead of a flag: deconstruction stays allowed, and the number is overridden.
        otherwise = {"no_deconstruction": False, "override_numtogive_fn": True}.get(key)
        row[key] = node.value if node.kind == "flag" else otherwise


@lru_cache(1024)
def _plain_options(options: str) -> dict[str, Any]:
    """The cells of options that _PLAIN has matched."""
    row: dict[str, Any] = {}
    for key, text, number, flag in _OPTIONS.findall(options):
        node = Node("text", text[1:-1].strip()) if text else Node("number", number) if number else Node("flag", flag == "true")
        _set_option(row, key, node, Evaluator())
    return row


def _expanded(loop: Statement, ev: Evaluator) -> Iterator[Evaluator]:
    """An environment for each turn. Numeric loops ascend by 1 between their bounds, whatever the step;
    other loops run over a table that is written out."""
    if loop.kind == "numeric for":
        a, b = ev.number(loop.values[0]), ev.number(loop.values[1]) if len(loop.values) > 1 else None
        step = ev.number(loop.values[2]) if len(loop.values) > 2 else 1
        if a is None or b is None:
            return
        a, b = (b, a) if step is not None and step <= 0 else (a, b)
        turns = [Node("number", str(i)) for i in range(a, b + 1)]
    else:
        turns = [v for _, v in loop.values[0].items if v.kind in {"text", "number"}] if loop.values[0].kind == "table" else []
    for turn in turns:
        yield Evaluator({**ev.names, loop.names[0]: turn})


def recipes(source: str | None) -> list[dict[str, Any]]:
    """The recipes of a file, in order."""
    statements = Parser(source or "").block()
    ev, found = Evaluator(), []
    for s in statements:  # names first, wherever they stand
        if s.kind == "assign" and s.local:
            ev.names.update(zip(s.names, s.values))

    def run(call: Statement, env: Evaluator) -> None:
        if call.kind == "recipes":
            found.extend(call.values)
        elif call.names[0] == "Recipe2" and (row := _recipe(call.values, env)) is not None:
            found.append(row)

    for s in statements:
        if s.kind in {"call", "recipes"}:
            run(s, ev)
        elif s.kind in {"for", "numeric for"}:
            for env in _expanded(s, ev):
                for inner in s.body:
                    if inner.kind == "assign" and inner.local and s.kind == "numeric for":
                        env.names.update(zip(inner.names, (env.known(v) for v in inner.values)))
                    elif inner.kind in {"call", "recipes"}:
                        run(inner, env)
    return found


def prototyper_defs(source: str | None) -> dict[str, dict[str, Any]]:
    """Definitions of the form PROTOTYPER_DEFS.name = {…}."""
    ev, keys = Evaluator(), ("icon_atlas", "icon_image", "is_crafting_station", "action_str", "filter_text")
    found = {}
    for s in Parser(source or "").block():
        if s.kind == "assign" and s.names[0].startswith("PROTOTYPER_DEFS.") and s.values[0].kind == "table":
            values = {k: (v.value if v.kind == "flag" else ev.text(v)) for k, v in s.values[0].items if k in keys}
            found[s.names[0].split(".", 1)[1]] = {k: values.get(k) for k in keys}
    return found


def locate(source: str, name: str, end_name: str | None = None) -> tuple[int, int, str, bool] | None:
    """Byte offsets, text and whether it is local, of the first top-level assignment to a name or a path;
    with an end name, of all from the first to that of the end name, which must follow. None if missing."""
    found = [s for s in Parser(source).block() if s.kind == "assign"]
    first = next((s for s in found if name in s.names), None)
    last = first if end_name is None else next((s for s in found if end_name in s.names), None)
    if first is None or last is None or last.begin < first.begin:
        return None
    text = source[first.begin : last.end]
    begin = len(source[: first.begin].encode())
    return begin, begin + len(text.encode()), text, first.local


class _Recipes:
    def eval(self, text: str) -> Iterator[tuple]:
        for pos, row in enumerate(recipes(text)):
            yield (pos, *(row.get(n) for n in _FIELDS[1:]))


class _Span:
    def eval(self, text: str, name: str, end_name: str) -> Iterator[tuple]:
        if text is not None and (found := locate(text, name, end_name)) is not None:
            yield found


lua_recipes = F.udtf(_Recipes, returnType=RECIPE)
lua_span = F.udtf(_Span, returnType="start_byte bigint, end_byte bigint, content string, is_local boolean")


def register(spark: SparkSession) -> None:
    """Make `lua_recipes(text)` and `lua_span(text, name, end_name)` known to SQL."""
    spark.udtf.register("lua_recipes", lua_recipes)
    spark.udtf.register("lua_span", lua_span)


def _recipe_columns(positions: tuple[int, ...], rows: tuple[dict[str, Any], ...]) -> list[pa.Array]:
    """The columns of RECIPE."""
    listed = [r["ingredients"] for r in rows]
    ends = pa.array([0, *accumulate(map(len, listed))], pa.int32())
    members = list(zip(*chain.from_iterable(listed))) or [()] * len(_INGREDIENT_KINDS)
    parts = [pa.array(v, kind) for v, kind in zip(members, _INGREDIENT_KINDS.values())]
    ingredients = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, list(_INGREDIENT_KINDS)))
    given = set().union(*rows)
    others = {n: pa.array([r.get(n) for r in rows], kind) if n in given else pa.nulls(len(rows), kind) for n, kind in _KINDS.items()}
    return [pa.array(positions, pa.int64()), *(ingredients if n == "ingredients" else others[n] for n in _FIELDS[1:])]


def read_recipes(files: DataFrame, text: str, *carry: str) -> DataFrame:
    """The recipes of each file's text, and columns to carry along. They leave Python as Arrow batches of
    at most _ROWS_AT_ONCE rows, whatever the files' sizes."""
    kept = [f"_carried{i}" for i in range(len(carry))]
    files = files.select(F.col(text).cast("string").alias("_text"), *(F.col(c).alias(k) for c, k in zip(carry, kept)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((i, pos, row) for i, t in enumerate(batch.column(0)) for pos, row in enumerate(recipes(t.as_py())))
            while part := list(islice(found, _ROWS_AT_ONCE)):
                places, positions, rows = zip(*part)
                carried = [c.take(pa.array(places, pa.int64())) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*carried, *_recipe_columns(positions, rows)], [*kept, *_FIELDS])

    schema = T.StructType([*files.drop("_text").schema, *T.StructType.fromDDL(RECIPE)])
    return files.mapInArrow(read, schema).select(*(F.col(k).alias(c) for c, k in zip(carry, kept)), *_FIELDS)


def read_spans(files: DataFrame, text: str, name: str, end_name: str | None = None, *carry: str) -> DataFrame:
    """The span of the assignment in each file that has it, and columns to carry along."""
    span = lua_span(F.col(f"file.{text}").outer(), F.lit(name), F.lit(end_name).cast("string"))
    return files.alias("file").lateralJoin(span.alias("span")).select(*(F.col(f"file.{c}") for c in carry), "span.*")
