import json

from quillmark.__main__ import main
from quillmark.sources.pages import PageStore


def test_commands_over_files(spark, tmp_path, capsys):
    (tmp_path / "c.po").write_text('msgctxt "STRINGS.NAMES.A"\nmsgid "Axe"\nmsgstr "斧"\n\nmsgctxt "STRINGS.UI.X"\nmsgid "x"\nmsgstr "y"\n')
    (tmp_path / "r.lua").write_text('Recipe2("a", {Ingredient("rope", 2)}, TECH.NONE)\n')
    main(["items", str(tmp_path / "c.po"), "--out", str(tmp_path / "items"), "--version", "7"])
    text = "".join(p.read_text() for p in (tmp_path / "items").glob("part-*"))
    assert json.loads(text)["data"] == [["a", "斧", "Axe", "Axe.png"]] and json.loads(text)["sources"].endswith(" 7")
    (tmp_path / "h.json").write_text(text)
    main(["items", str(tmp_path / "c.po"), "--history", str(tmp_path / "h.json")])
    main(["recipes", str(tmp_path / "r.lua"), "--catalogue", str(tmp_path / "c.po"), "--out", str(tmp_path / "recipes")])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "recipes").glob("part-*")))["data"][0][:3] == ["a", "rope", 2]
    store = PageStore(spark, str(tmp_path / "pages"))
    store.create(spark.createDataFrame([("M", "-- COPYCLIPSTART --\n-- COPYCLIPEND --")], "title string, content string"))
    (tmp_path / "s.lua").write_text("T = { 1 }\n")
    main(["copy", str(tmp_path / "s.lua"), "T", "--pages", str(tmp_path / "pages"), "--title", "M", "--yes"])
    assert "T = { 1 }" in store.get("M").first().content and "written" in capsys.readouterr().out
