"""Keeping a caller's columns apart from the names that an operator works with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def folded(df: DataFrame) -> Callable[[str], str]:
    """How the session compares names of columns: as they are, or in lower case."""
    return str if df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true" else str.lower


def clear_of(names: list[str], results: tuple[str, ...], df: DataFrame) -> list[str]:
    """``names`` without those that the session takes for one of ``results``."""
    fold = folded(df)
    taken = {fold(r) for r in results}
    return [c for c in names if fold(c) not in taken]


def apart(docs: DataFrame, results: tuple[str, ...], needed: tuple[str, ...], run: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """``run(table, own)`` on ``docs`` with its columns under names that no operator has, which get
    their names back afterwards; ``own`` tells the new name of a column.

    Columns named like one of ``results`` are left out, as the result takes the name, unless they
    are ``needed``.  Names are compared as the session compares them; where several columns differ
    in case alone, ``own`` takes the one spelt as asked for."""
    fold = folded(docs)
    clear = set(clear_of(docs.columns, results, docs))
    safe = {f"§{k}": c for k, c in enumerate(docs.columns)}
    kept = {s: c for s, c in safe.items() if c in clear or c in needed}

    def own(name: str) -> str:
        exact = [s for s, c in kept.items() if c == name]
        return (exact or [s for s, c in kept.items() if fold(c) == fold(name)] or [name])[0]

    out = run(docs.toDF(*safe).select(*kept), own)
    return out.toDF(*(kept.get(c, c) for c in out.columns))
