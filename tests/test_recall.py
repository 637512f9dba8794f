"""What a turn gets: the gate, budgets, blocks, the strategy told, and a search that fails."""

import pytest

from palimpsest import schemas
from palimpsest.plans.memory import RECALL_NOTE, Config, Memory


class Broken:
    dimensions = 1

    def __call__(self, texts):
        raise OSError("no service")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('m')}/m"
    row = lambda i, text, scene, meta: (i, text, "episodic", 50.0, scene, "k", "k", "2024-03-05T10:00:00Z", "t", "t", "t", "t", meta)
    Memory(spark, path).add_facts(spark.createDataFrame([row("1", "the red fox " + "runs " * 40, "w", "{}"), row("2", "a red fox sleeps", "", '{"activity_start_time": "2024-01-01T00:00:00Z"}'), row("3", "of dogs", "w", "{}")], schemas.L1))
    return path


def test_gate_and_strategy(spark, folder):
    m = Memory(spark, folder, config=Config(strategy="embedding"))
    got = m.recall(" x ")
    assert got["strategy"] == "skipped" and not got["lines"] and got["prepend"] is None and got["append"] is None
    assert m.recall_within("x", 60) is None
    assert m.recall("\U0001f98a")["strategy"] == "embedding"  # two units
    got = m.recall("red fox")  # without an embedder by words, but told as configured
    assert got["strategy"] == "embedding" and len(got["lines"]) == 2


def test_budgets(spark, folder):
    full = Memory(spark, folder).recall("red fox")["lines"]
    assert full[0].startswith("- [episodic] a red fox sleeps (活动时间: 2024-01-01") and full[1].startswith("- [episodic|w] the red fox runs")
    each = Memory(spark, folder, config=Config(max_chars_per_memory=30)).recall("red fox")
    assert [len(x) <= 30 and x.endswith("…（已截断）") for x in each["lines"]] == [True, True]
    assert Memory(spark, folder, config=Config(max_chars_per_memory=4)).recall("red fox")["lines"] == [x[:4] for x in full]
    total = len(full[0]) + 1 + 50
    both = Memory(spark, folder, config=Config(max_chars=total, max_chars_per_memory=100)).recall("red fox")
    assert both["lines"][0] == full[0] and len(both["lines"][1]) <= 50 and both["lines"][1].endswith("…（已截断）")
    assert both["memories"][0] == {"type": "episodic", "content": "a red fox sleeps", "score": 0.0} and both["memories"][1]["content"].startswith("the red fox")
    assert len(Memory(spark, folder, config=Config(max_chars=total - 20)).recall("red fox")["lines"]) == 1


def test_blocks_and_failure(spark, folder):
    scenes = spark.createDataFrame([("a.md", "about a", 60, "", ""), ("b.md", "about b", 5, "", "")], schemas.SCENE_INDEX)
    m = Memory(spark, folder)
    got = m.recall("red fox", "who they are\n\n<scene-navigation>\n- old\n</scene-navigation>", scenes)
    assert got["prepend"] == f"<relevant-memories>\n{RECALL_NOTE}\n\n" + "\n".join(got["lines"]) + "\n</relevant-memories>"
    assert got["persona"] == "who they are" and got["append"].startswith("<user-persona>\nwho they are\n</user-persona>\n\n<scene-navigation>\n- a.md")
    assert got["append"].endswith("</memory-tools-guide>") and "- old" not in got["append"]
    failed = Memory(spark, folder, Broken()).recall("red fox", "who they are", scenes)
    assert failed["lines"] == [] and failed["prepend"] is None and failed["append"] == got["append"] and failed["strategy"] == "hybrid"
    assert m.recall("nothing like it", " ")["append"] is None
