import json

import pytest

from palimpsest.plans import scenes

RAW = "-----META-START-----\ncreated: 2024-01-01T00:00:00\nupdated: 2024-02-01T00:00:00\nsummary: about {0}\nheat: {1}\n-----META-END-----\n\nbody of {0}\n"


@pytest.fixture
def folder(tmp_path):
    f = scenes.Folder(str(tmp_path))
    for name, heat in (("a", 5), ("b", 50)):
        f._write(f"scene_blocks/{name}.md", RAW.format(name, heat))
    return f


def test_parse_clean_rename_index(folder):
    folder._write("scene_blocks/gone.md", "[DELETED]")
    folder._write("scene_blocks/my  scene?.md", "text")
    folder._write("scene_blocks/my-scene.md", "other")
    assert folder.clean() == 1
    assert folder.rename() == {"my  scene?.md": "my-scene-2.md"}
    assert [s["filename"] for s in folder.write_index()] == ["a.md", "b.md", "my-scene-2.md", "my-scene.md"]
    assert json.loads(folder._read(".metadata/scene_index.json"))[1]["heat"] == 50
    assert folder.navigation().splitlines()[1].startswith("- b.md (50) about b")


def test_a_failed_run_restores_scenes(folder):
    before = {n: folder._read(f"scene_blocks/{n}") for n in folder.names()}

    def fails(memories, found, write):
        write("a", "changed")
        write("new", "x")
        raise RuntimeError("no answer")

    with pytest.raises(RuntimeError):
        scenes.extract_scenes(folder, [], fails, "1")
    assert {n: folder._read(f"scene_blocks/{n}") for n in folder.names()} == before


def test_runs_and_persona(folder):
    def works(memories, found, write):
        write("New Scene", RAW.format("new", 500))
        write("b", "[DELETED]")
        return "done [PERSONA_UPDATE: moved house]"

    assert scenes.extract_scenes(folder, [{"content": "x"}], works, "1") == "moved house"
    assert folder.names() == ["New-Scene.md", "a.md"]
    assert scenes.persona_signal("nothing") is None and scenes.persona_signal("[PERSONA_UPDATE]") == ""
    assert scenes.generate_persona(folder, lambda old, found, why: f"likes <user-persona> {len(found)}", "2023-01-01T00:00:00")
    assert folder.persona() == "likes &lt;user-persona&gt; 2"
    assert not scenes.generate_persona(folder, lambda *a: "x", "2030-01-01T00:00:00")
    assert not scenes.generate_persona(folder, lambda *a: " ", "odd")


def test_backups_keep_the_newest(folder):
    for k in range(5):
        folder.backup(f"{k}", keep=2)
    left = folder.fs.get_file_info(scenes.pafs.FileSelector(f"{folder.base}/.backup/scene_blocks"))
    assert sorted(f.base_name for f in left) == ["3", "4"]


def test_headers_are_found_anywhere(spark):
    from palimpsest.sources import files

    raws = ["intro\n" + RAW.format("x", 7) + "  tail  ", "no header \n", "-----META-END-----\nx-----META-START-----", "-----META-START-----heat: 3\nsummary:  two words \n-----META-END-----  body", "-----META-START-----\nheat: many\n-----META-END-----", ""]
    got = files.parse_scenes(spark.createDataFrame(list(enumerate(raws)), "filename int, raw string")).orderBy("filename").collect()
    for r, raw in zip(got, raws, strict=True):
        s = scenes.Scene.parse(r.filename, raw)
        assert (r.summary, r.heat, r.created, r.updated, r.body) == (s.summary, s.heat, s.created, s.updated, s.body)
    assert (got[0].heat, got[0].summary, got[0].body) == (7, "about x", "body of x\n  tail") and got[3].summary == "two words" and got[1].body == "no header"


def test_missing_index(spark, tmp_path, folder):
    from palimpsest.sources import files

    assert files.scene_index(spark, f"file://{tmp_path}").count() == 0
    folder.write_index()
    assert sorted(r.filename for r in files.scene_index(spark, f"file://{tmp_path}").collect()) == ["a.md", "b.md"]
