import json
import re
import zipfile

import pytest

from quillmark.plans import catalogue, jobs
from quillmark.plans.tables import ITEM_TABLE, RECIPE_TABLE, recipe_rows
from quillmark.sources import archive, lua, pages, po, tabular


def test_catalogue_header_comment_and_joined_strings():
    text = 'msgid ""\nmsgstr ""\n"Language: zh\\n"\n"Other: x"\n\n#. STRINGS.NAMES.A\nmsgctxt "STRINGS.NAMES.A"\nmsgid "Abi"\n  "gail"\nmsgstr "line1"\n  "line2"\n'
    for t in (text, text.replace("\n", "\r\n")):
        header, entries = po.parse(t)
        assert header == "Language: zh\nOther: x"
        assert entries == [("STRINGS.NAMES.A", "Abigail", "line1line2", "STRINGS.NAMES.A")]


def test_catalogue_stops_at_the_first_malformed_entry():
    good = 'msgctxt "a"\nmsgid "b"\nmsgstr "c"\n\n'
    assert len(po.parse(good + 'msgctxt "x"\nmsgstr "y"\n\n' + good)[1]) == 1
    assert po.parse("# one\n# two\n" + good)[1] == []
    assert po.parse(None) == (None, [])


@pytest.mark.parametrize("raw, value", [(r"a\\nb", "a\\nb"), (r"a\nb", "a\nb"), (r"\q", "\\q"), (r"x\n", "x"), (r"\"", '"')])
def test_escapes_are_read_from_left_to_right(raw, value):
    assert po.parse(f'msgid "{raw}"\nmsgstr ""\n')[1][0][1] == value


def test_categories(spark):
    rows = [(i, c, "e", "z", None) for i, c in enumerate(["STRINGS.NAMES.A", "STRINGS.ACTIONS.B", "STRINGS.UI.C", "STRINGS.OTHER.D", None])]
    entries = spark.createDataFrame(rows, po.ENTRY)
    assert [r.category for r in po.with_category(entries).orderBy("pos").collect()] == ["NAMES", "ACTIONS", "UI", None, None]
    assert po.of_category(entries, "NAMES").count() == 1
    assert [tuple(r) for r in po.entity_names(entries).collect()] == [("A", "z")]


def test_recipes_with_options_constants_and_images():
    source = """
    local N = 3
    local T = { 8, 6, 4 }
    -- Recipe2("no", {}, TECH.NONE)
    Recipe("old", {}, TECH.NONE)
    Recipe2("a", {Ingredient("rope", 1), Ingredient("garlic", 3, nil, nil, "x.tex"), Ingredient(CHARACTER_INGREDIENT.HEALTH, TUNING.EFFIGY_HEALTH_PENALTY), Ingredient(CHARACTER_INGREDIENT.NOPE, 1)}, TECH.NONE, {builder_tag="b", numtogive=2, nounlock=true, no_deconstruction=function() return 1 end, override_numtogive_fn=function(x) if x then return 2 end end, min_spacing=0.5, actionstr="A"})
    for i = 1, N do
        local n = T[i]
        Recipe2("t_"..i, {Ingredient("x", n)}, TECH.LOST)
    end
    for v in {"p", "q"} do Recipe2("g_"..v, {}, TECH.LOST) end
    Recipe2(unknown, {}, TECH.NONE)
    Recipe2("no_tech", {}, NONE)
    """
    found = lua.recipes(source)
    assert [r["name"] for r in found] == ["a", "t_1", "t_2", "t_3", "g_p", "g_q"]
    a = found[0]
    assert a["ingredients"] == [("rope", 1, None, None), ("garlic", 3, None, "x.tex"), ("decrease_health", 40, None, None)]
    assert (a["numtogive"], a["nounlock"], a["no_deconstruction"], a["override_numtogive_fn"], a["min_spacing"], a["action_str"]) == (2, True, False, True, 0.5, "A")
    assert [r["ingredients"][0][1] for r in found[1:4]] == [8, 6, 4]
    assert lua.recipes(None) == [] == lua.recipes("")


_PLAIN_OR_NEARLY = """
Recipe2("a", {}, TECH.NONE)
Recipe2 ( ' b ' , { Ingredient("x y", 3), Ingredient('say "q"', 12), } , TECH.X_1 , { numtogive = 2, product = "Ingredient('z', 1)", nounlock=true, min_spacing = 0.5, actionstr = 'k = "v"', image = 7, no_deconstruction = "s", odd = 1, } ) -- c
--[[ Recipe2("no", {}, TECH.NONE) ]] Recipe2("c", {Ingredient("x", 1)}, TECH.X, {}) Recipe2("d", {}, TECH.X) order = 1
Recipe2("e\\"f", {Ingredient("x", 1)}, TECH.X) Recipe2("g", {Ingredient("x", 2147483648), Ingredient("y", 1.5), Ingredient("z", N)}, TECH.X, {numtogive = 0x10})
Recipe2("h", {Ingredient("x", 1, nil, nil, "t.tex")}, TECH.X, {testfn = function() Recipe2("no", {}, TECH.X) end, product = P})
Recipe2("i", {Ingredient("x", 1)}, NONE) Recipe2("j", L, TECH.X) foo.Recipe2("no", {}, TECH.X) x = Recipe2("no", {}, TECH.X)
Recipe2("no", {}, TECH.X) and 1 Recipe2("no", {}, TECH.X).y = 2 Recipe2("k", {}, TECH.X); Recipe2("l", {}, TECH.X) --[[ open
for i = 1, 2 do Recipe2("m", {}, TECH.X) Recipe2("n"..i, {}, TECH.X) end if x then Recipe2("no", {}, TECH.X) end
local N, P, L = 4, "late", {Ingredient("y", 2)}
Recipe2("o", {}, TECH.X)"""


def _read_or_error(source):
    try:
        return lua.recipes(source)
    except IndexError:  # broken off inside brackets
        return None


def test_recipes_written_out_are_read_as_by_the_general_way(monkeypatch):
    sources = [_PLAIN_OR_NEARLY[:e] for e in range(len(_PLAIN_OR_NEARLY) + 1)]
    read = lambda: [_read_or_error(s) for s in sources] + [lua.locate(_PLAIN_OR_NEARLY, n) for n in ("order", "P")]
    got = read()
    monkeypatch.setattr(lua, "_PLAIN", re.compile("(?!)"))
    assert got == read()
    assert [r["name"] for r in got[len(sources) - 1]] == ["a", "b", "c", "d", 'e\\"f', "g", "h", "j", "k", "l", "m", "n1", "m", "n2", "o"]


def test_recipes_written_out_are_not_cut_into_tokens():
    plain = "\n-- next\n".join(f'Recipe2("r{i}", {{Ingredient("x", {i}), Ingredient("y", 2)}}, TECH.X, {{product = "p", nounlock = true}})' for i in range(500))
    parser = lua.Parser(plain + "\nRecipe2(N, {}, TECH.X)\nlocal N = 'last'\n" + plain)
    parser.block()
    assert len(parser.tokens) < 30
    assert [r["name"] for r in lua.recipes(plain + "\nRecipe2(N, {}, TECH.X)\nlocal N = 'last'")] == [f"r{i}" for i in range(500)] + ["last"]


def test_recipes_leave_python_in_arrow_batches(spark, monkeypatch):
    monkeypatch.setattr(lua, "_ROWS_AT_ONCE", 3)
    texts = [(i, t) for i, t in enumerate(['Recipe2("a", {Ingredient("x", 1), Ingredient("y", 2)}, TECH.X, {numtogive=2})\n' * 7, None, "", 'Recipe2("b", {}, TECH.Y)', 'Recipe2("c"..1, {Ingredient("z", 3, nil, nil, "i")}, TECH.Z, {min_spacing=0.5, nounlock=false})'])]
    files = spark.createDataFrame(texts, "name int, text string").repartition(1)
    found = lua.read_recipes(files, "text", "name")
    assert found.columns[:3] == ["name", "pos", "name"] and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    want = [(i, pos, *(r.get(n) for n in lua._FIELDS[1:])) for i, t in texts for pos, r in enumerate(lua.recipes(t))]
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])
    assert [(*r[:3], [tuple(x) for x in r[3]], *r[4:]) for r in got] == want and len(got) == 9
    lua.register(spark)
    assert spark.sql("SELECT name, numtogive FROM lua_recipes('Recipe2(\"a\", {}, TECH.X, {numtogive=3})')").collect() == [("a", 3)]


def test_recipe_roundtrip_shuffles_once(spark):
    plan = catalogue.recipe_roundtrip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_spans():
    source = "-- é\nlocal A = { 1 }\nB = 'x'\nC.d.e = function() return 1 end\nF = 2\n"
    assert lua.locate(source, "A") == (6, 21, "local A = { 1 }", True)
    assert lua.locate(source, "B")[2:] == ("B = 'x'", False)
    assert lua.locate(source, "C.d.e")[2] == "C.d.e = function() return 1 end"
    assert lua.locate(source, "B", "F")[2].endswith("F = 2")
    assert lua.locate(source, "F", "B") is None and lua.locate(source, "nope") is None


def test_recipe_table_looks_descriptions_up(spark):
    recipes = lua.read_recipes(spark.createDataFrame([('Recipe2("a", {}, TECH.X, {description="d"})\nRecipe2("b", {}, TECH.X, {product="p"})\nRecipe2("c", {}, TECH.X)\nRecipe2("e", {}, TECH.X, {description="missing", product="p"})',)], "text string"), "text")
    entries = spark.createDataFrame([(0, "STRINGS.RECIPE_DESC.D", "", "by d", None), (1, "STRINGS.RECIPE_DESC.P", "", "old", None), (2, "STRINGS.RECIPE_DESC.P", "", "by p", None), (3, "STRINGS.RECIPE_DESC.C", "", "by c", None)], po.ENTRY)
    rows = recipe_rows(recipes, entries).orderBy("pos").collect()
    assert [r.desc for r in rows] == ["by d", "by p", "by c", None]
    assert [r.product for r in rows] == ["a", "p", "c", "p"] and len(rows[0]) == len(RECIPE_TABLE.names()) + 1 == 27


def test_tabular_documents_come_back(spark):
    rows = spark.createDataFrame([("a", "甲", "A", "a.png", 0), ("b", None, 'B"', "", 1)], "id string, name_cn string, name_en string, item_img1 string, pos long")
    content = tabular.document(ITEM_TABLE, rows, "here", "there", "pos")
    text = content.first().content
    assert json.loads(text)["data"] == [["a", "甲", "A", "a.png"], ["b", None, 'B"', ""]]
    assert sorted(tabular.read_rows(content, ITEM_TABLE.fields).select(*rows.columns).collect()) == sorted(rows.collect())
    with pytest.raises(Exception, match="lacks"):
        tabular.read_rows(spark.createDataFrame([('{"license": "x", "data": []}',)], "content string"), ITEM_TABLE.fields).collect()


def test_history_is_kept_and_reported(spark):
    entries = spark.createDataFrame([(0, "STRINGS.NAMES.A", "A", "new", None), (1, "STRINGS.NAMES.B", "B", "b", None), (2, "STRINGS.UI.C", "C", "c", None)], po.ENTRY)
    history = spark.createDataFrame([("a", "kept", "", None, 0), ("gone", "g", "g", "g", 1)], "id string, name_cn string, name_en string, item_img1 string, pos long")
    out = jobs.maintain_items(entries, history, "x")
    assert sorted(tuple(r) for r in out.rows.select("id", "name_cn", "name_en", "item_img1").collect()) == [("a", "kept", "A", "A.png"), ("b", "b", "B", "B.png")]
    assert sorted((r.id, r.status) for r in out.changes.collect()) == [("a", "modified"), ("b", "added"), ("gone", "deleted")]


def test_copying_between_markers_and_brackets(spark):
    one = lambda t: spark.createDataFrame([(t,)], "content string")
    page = "top\n-- COPYCLIPSTART --\nold\n-- COPYCLIPEND --\nend"
    got = jobs.copy_variable(one("local T = { 1 }\nU = 2"), one(page), "T").first().content
    assert got == "top\n-- COPYCLIPSTART --\nlocal T = { 1 }\n-- COPYCLIPEND --\nend"
    for source, edited, wrong in (("T = 1", "no markers", "marker"), ("T = 1", "-- COPYCLIPEND ---- COPYCLIPSTART --", "marker"), ("U = 1", page, "assign T")):
        with pytest.raises(Exception, match=wrong):
            jobs.copy_variable(one(source), one(edited), "T").collect()
    with pytest.raises(Exception, match="brackets"):
        jobs.copy_names(spark.createDataFrame([], po.ENTRY), one("no brackets")).collect()
    entries = spark.createDataFrame([(0, "STRINGS.UI.CRAFTING_FILTERS.B", "b", "乙", None), (1, "STRINGS.UI.CRAFTING_STATION_FILTERS.A", "a", "甲", None), (2, "STRINGS.UI.CRAFTING_FILTERS.A", "x", "丙", None)], po.ENTRY)
    text = jobs.copy_names(entries, one("return [[ old ]] tail")).first().content
    assert text.startswith('return [[{"crafting_stations":{"A":') and text.endswith("}}\n]] tail")
    assert list(json.loads(text[9:].split("\n")[0])["craftings"]) == ["A", "B"]


def test_tech_report(spark):
    recipes = spark.createDataFrame([("TECH.A",), ("TECH.B",), ("TECH.B",)], "tech string")
    page = spark.createDataFrame([("x\n 'TECH.A', 'TECH.B'\n\"CATE:z\",\n\"TECH.C\"",)], "content string")
    counts, extra = jobs.tech_report(recipes, page)
    assert tuple(counts.first()) == (2, 2, 1, True) and [r.name for r in extra.collect()] == ["TECH.B"]
    assert jobs.tech_report_text(recipes, page).first().report.endswith("\n  - TECH.B\n") and jobs.tech_report_text(recipes.limit(1), page).first().report.endswith("Wiki页面中。\n")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("scripts/a.lua", "A = 1")
        z.writestr("scripts/b.po", "é")
    assert archive.member_text(spark, str(tmp_path / "s.zip"), "scripts/b.po").first().content == "é"
    with pytest.raises(archive.MemberNotFound):
        archive.member_text(spark, str(tmp_path / "s.zip"), "none")
    assert archive.version_of(spark, str(tmp_path)) == "unknown"


def test_page_store_writes_only_what_changed_and_is_confirmed(spark, tmp_path):
    store = pages.PageStore(spark, str(tmp_path / "pages"))
    store.create(spark.createDataFrame([("P", ' {"a": 1} ')], "title string, content string"))
    new = lambda t: spark.createDataFrame([(t,)], "content string")
    assert store.edit("P", new('{"a": 1}'), json=True) == "unchanged"
    assert store.edit("P", new('{\n  "a":1\n}'), json=True) == "unchanged"
    for nothing in (spark.createDataFrame([(None,)], "content string"), new("x").limit(0), new("x").union(new("y"))):
        with pytest.raises(pages.EditRefused):
            store.edit("P", nothing, confirmed=True)
    assert store.edit("P", new("x")) == "pending" and store.get("P").first().last_rev_id == 1
    assert store.edit("P", new("x"), confirmed=True) == "written"
    assert store.edit("P", new("y"), position="append", confirmed=True) == "written"
    assert (store.get("P").first().content, store.get("P").first().last_rev_id) == ("xy", 3)
    with pytest.raises(pages.PageNotFound):
        store.get("Q")


def test_copy_mappings_in_toml(spark):
    from quillmark.sources.config import CopyMapping, CopyMappings

    both = CopyMappings([CopyMapping("a.lua", "A", "Module:A"), CopyMapping("b.lua", "B", "Module:B", "C", 'say "é"')])
    assert CopyMappings.from_toml(both.to_toml()) == both and both.by_variable("B") == both.by_target("Module:B") == both[1]
    assert both.by_variable("none") is None and both.table(spark).where("end_var_name is null").count() == 1
