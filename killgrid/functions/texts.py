"""Functions on source text as expressions of built-in functions, so that they stay in Spark's own code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _ended(c: Column) -> Column:
    """Without white space at its end, but for one line end."""
    return F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit("\n"))


def defines(source: Column, entry: Column) -> Column:
    """Whether a source has `def entry(`."""
    return F.rlike(_text(source), F.concat(F.lit(r"\bdef\s+\Q"), _text(entry), F.lit(r"\E\s*\(")))


def composed_source(prompt: Column, solution: Column, entry: Column) -> Column:
    """A task's whole source: the solution alone if it defines the entry point or there is no prompt, else after the
    prompt, indented as a body where the prompt defines the entry point and the solution's first line begins at the
    margin. Nulls are empty."""
    prompt, solution = _text(prompt), _text(solution)
    first = F.regexp_extract(solution, r"(?m)^(.*\S.*)$", 1)
    body = F.when(defines(prompt, entry) & (first != "") & ~F.rlike(first, F.lit(r"^[ \t]")), F.regexp_replace(solution, r"(?m)^(.*\S.*)$", "    $1")).otherwise(solution)
    between = F.when(prompt.endswith("\n"), "").otherwise("\n")
    return F.when(defines(solution, entry) | (prompt == ""), _ended(solution)).when(solution == "", _ended(prompt)).otherwise(_ended(F.concat(prompt, between, body)))


def missing_libraries(names: Column, available: Column) -> Column:
    """Names, sorted and once each, whose package isn't among those available; blank ones and nulls are none."""
    own = F.transform(F.filter(names, lambda n: F.trim(F.coalesce(n, F.lit(""))) != ""), lambda n: F.trim(n))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(own, lambda n: ~F.array_contains(available, F.substring_index(n, ".", 1))))), F.array().cast("array<string>"))


def entry_as_candidate(text: Column, entry: Column) -> Column:
    """text with its first call of the entry point as a call of `candidate`."""
    call = F.concat(F.lit(r"(?s)^(.*?)\b\Q"), _text(entry), F.lit(r"\E\s*\((.*)$"))
    part = lambda i: F.call_function("regexp_extract", _text(text), call, F.lit(i))
    return F.when(F.rlike(_text(text), call), F.concat(part(1), F.lit("candidate("), part(2))).otherwise(_text(text))
