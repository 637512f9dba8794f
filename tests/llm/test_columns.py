"""Columns of any name, those that operators work with included."""

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs

from palimpsest.llm import decontaminate, fim, importance, linededup, mix, neardup, quality, secrets, shard, substrings, toxicity

SOURCES = Path(quality.__file__).parent.glob("*.py")
BASE = ("doc_id", "text", "lang", "source", "n_chars")


def names():
    """Every word in the operators' code that could be a column."""
    found = {n.lower() for f in SOURCES for n in re.findall(r'"([A-Za-z_]\w*)"|\b(_[a-z]\w*)\b', f.read_text()) for n in n if n}
    return sorted(n for n in found - set(BASE) if len(n) < 20)[:400]


EXTRA = names()


def run(operator, d, spark):
    bench = spark.createDataFrame([(1, "nine words that are a passage of the benchmark")], "item_id long, text string")
    return {
        "quality": lambda: quality.score_documents(d, quality.train(d, spark.createDataFrame([(1, 1)], "doc_id long, label int"))),
        "toxicity": lambda: toxicity.score_documents(d, toxicity.Field()), "decontamination": lambda: decontaminate.decontaminate(d, bench), "blocks": lambda: decontaminate.decontaminate(d, bench, block_words=2),
        "near duplicates": lambda: neardup.deduplicate(d), "mixing": lambda: mix.mix_documents(d), "sharding": lambda: shard.assign_shards(d), "lines": lambda: linededup.remove_boilerplate(d), "secrets": lambda: secrets.find_secrets(d),
        "marked": lambda: decontaminate.mark_contamination(d, bench), "repeats": lambda: substrings.mark_repeats(d), "unrepeated": lambda: substrings.remove_repeats(d), "importance": lambda: importance.rank_documents(d, bench), "fim": lambda: fim.rearrange(d),
    }[operator]()


RESULTS = [("quality", ("score",)), ("toxicity", ("score", "spans")), ("decontamination", ()), ("blocks", ()), ("near duplicates", ()), ("mixing", ()), ("sharding", ("slot", "shard")), ("lines", ("n_lines", "n_removed")), ("secrets", ("secret_spans", "secret_links")), ("marked", decontaminate.RESULT), ("repeats", substrings.RESULT), ("unrepeated", ()), ("importance", importance.RESULT), ("fim", fim.RESULT)]


@pytest.mark.parametrize(("operator", "results"), RESULTS)
def test_any_names(spark, operator, results):
    d = docs(spark, [(1, "some words of a text that is here", "s"), (2, "password: abcdefgh1", "t"), (None, None, None)])
    d = d.select("*", *(F.lit(k).alias(n) for k, n in enumerate(EXTRA)))
    out = run(operator, d, spark)
    assert out.columns == [c for c in d.columns if c not in results] + list(results)
    rows = out.collect()
    assert rows and all(r[n] == k for r in rows for k, n in enumerate(EXTRA) if n not in results)


@pytest.mark.parametrize(("operator", "results"), RESULTS)
def test_names_that_differ_in_case(spark, operator, results, tmp_path):
    twins = [*(r.capitalize() for r in results), "Row", "Node", "SLOT_"]
    d = docs(spark, [(1, "some words of a text that is here", "s"), (2, "password: abcdefgh1", "t")]).select("*", *(F.lit(k).alias(n) for k, n in enumerate(twins)))
    out = run(operator, d, spark)
    kept = [c for c in d.columns if c.lower() not in results]
    assert out.columns == kept + list(results)
    out.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == out.columns and all(r.Row == twins.index("Row") for r in back.collect())
