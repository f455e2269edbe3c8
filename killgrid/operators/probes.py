"""Probes: inputs for a task's function, what mutants do on them, and features for clustering.

`build_probes` explodes each task into probe calls, `signatures` runs them against the reference source
and every mutant and keeps one number a probe, `features` turns mutants into vectors within their task, and
`representatives` gives the mutants of each Ward cluster that stand for it. Tasks are independent; the
relational parts (comparison of outcomes, vocabularies, one-hot vectors) are DataFrame functions.

Defined results: null prompts or sources count as empty; a task without parameters and examples has no
probes, and its mutants an empty signature; a source that doesn't run gives ERROR for each probe; repeated
rows are run repeatedly; empty tables give no rows.
"""

from __future__ import annotations

import ast
import json
import os
import re
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import parameters, to_candidate
from .mutation import ward_groups

MOST_PROBES, SECONDS = 6, 2.0
#: What a probe tries for an annotation that holds the word, the first that fits counting.
LISTS = {"str": ("[]", '["a"]', '["a", "b"]'), "float": ("[]", "[0.0]", "[0.0, 1.0, -1.0]"), "": ("[]", "[0]", "[0, 1, -1]", "[1, 2, 3]")}
VALUES = {
    "tuple": ("()", "(0,)", "(0, 1)"),
    "dict": ("{}", '{"a": 1}', "{0: 0, 1: 1}"),
    "str": ('""', '"a"', '"abc"', '"aba"'),
    "bool": ("False", "True"),
    "float": ("0.0", "1.0", "-1.0", "0.5"),
    "int": ("0", "1", "-1", "2"),
    "": ("0", "1", '"a"', "[0, 1]"),
}
#: The operators, in the order of their places in a feature vector.
OPERATORS = ("COMPARISON_FLIP", "BOUNDARY_SHIFT", "BOOLEAN_FLIP", "CONSTANT_CHANGE", "ARITHMETIC_FLIP", "RETURN_VALUE_CHANGE", "NEGATE_CONDITION", "INDEX_BOUNDARY", "MEMBERSHIP_FLIP", "IDENTITY_FLIP", "ARGUMENT_SWAP", "RANGE_BOUNDARY")
#: Calls whose first two arguments may change places.
COMMUTATIVE = ("min", "max", "math.gcd", "math.lcm")


def values_for(annotation: str) -> tuple[str, ...]:
    """Literals to try for a parameter with this annotation."""
    kind = re.sub(" ", "", annotation or "").lower()
    if "list" in kind or kind.startswith(("sequence", "iterable")):
        return LISTS[next(k for k in LISTS if k in kind)]
    return VALUES[next(k for k in VALUES if k in kind)]


def _kind(value) -> str:
    """The annotation that values like this one have."""
    for name, kind in (("bool", bool), ("int", int), ("float", float), ("str", str), ("dict", dict), ("tuple", tuple)):
        if isinstance(value, kind):
            return name
    if isinstance(value, list):
        return f"list[{_kind(value[0])}]" if value else "list"
    return ""


def _closed(text: str, at: int) -> int:
    """Where the parenthesis that opens at `at` closes, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i
    return -1


def example_calls(prompt: str, entry: str) -> list[tuple[str, list]]:
    """(call of candidate, its arguments' values) for calls of entry with literal arguments outside of doctests."""
    plain = re.sub(r"(?m)^[ \t]*>>>.*$", lambda m: " " * len(m[0]), prompt or "")
    out = []
    for m in re.finditer(rf"\b{re.escape(entry)}\s*\(", plain):
        end = _closed(plain, m.end() - 1)
        inner = plain[m.end() : end] if end >= 0 else ""
        try:
            call = ast.parse(f"f({inner})", mode="eval").body
            if end < 0 or call.keywords or not call.args:
                continue
            out.append((f"candidate({inner})", [ast.literal_eval(a) for a in call.args]))
        except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
            continue
    return out


def doctest_calls(prompt: str, entry: str) -> list[str]:
    lines = (line.strip() for line in (prompt or "").splitlines())
    return [to_candidate(line[3:].strip(), entry) for line in lines if line.startswith(">>>") and entry in line[3:]]


def typed_calls(prompt: str, source: str, entry: str, most: int = MOST_PROBES) -> list[str]:
    """Calls with values by annotation: the i-th takes the i-th value of each parameter, or its last one."""
    own = parameters(source or "", entry) or parameters(f"{prompt or ''}\n    pass\n", entry)
    kinds = [annotation for name, annotation in own if name not in ("self", "cls")]
    if not kinds:
        return []
    if not any(kinds):  # no annotations: those of an example's arguments, if one has as many
        kinds = next(([_kind(v) for v in values] for _, values in example_calls(prompt, entry) if len(values) == len(kinds)), kinds)
    lists = [values_for(k) for k in kinds]
    return [f"candidate({', '.join(v[min(i, len(v) - 1)] for v in lists)})" for i in range(min(most, max(map(len, lists))))]


def probes(prompt: str, source: str, entry: str, most: int = MOST_PROBES) -> list[str]:
    """Distinct probe calls: doctests first, then literal examples, then values by type."""
    found = [*doctest_calls(prompt, entry), *(c for c, _ in example_calls(prompt, entry)), *typed_calls(prompt, source, entry, most)]
    return list(dict.fromkeys(found))[:most]


def build_probes(tasks: DataFrame, most: int = MOST_PROBES) -> DataFrame:
    """tasks (problem_id, prompt, source, entry) -> (problem_id, probe_ix, expr)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, e) for p, t, s, n in zip(frame["problem_id"], frame["prompt"], frame["source"], frame["entry"], strict=True) for i, e in enumerate(probes(t, s, n, most))]
            yield pd.DataFrame(rows, columns=["problem_id", "probe_ix", "expr"])

    return tasks.select("problem_id", "prompt", "source", "entry").mapInPandas(run, "problem_id string, probe_ix int, expr string")


# One child a source; in it one fork a probe, so that probes can't see what others have changed.
_RUNNER = r"""
import json, os, select, signal, sys, time
job = json.load(sys.stdin)
out = []
for expr in job["probes"]:
    get, put = os.pipe()
    pid = os.fork()
    if not pid:
        os.close(get)
        said = ("ERROR", "exit:")
        try:
            space = {"__name__": "task"}
            exec("import math, itertools, functools, collections\nfrom typing import *", space)
            exec(compile(job["source"], "task.py", "exec"), space)
            space["candidate"] = space[job["entry"]]
            said = ("VALUE", repr(eval(compile(expr, "probe.py", "eval"), space))[:1000])
        except BaseException as e:
            said = ("ERROR", type(e).__name__ + ":" + str(e)[:300])
        os.write(put, json.dumps(said).encode())
        os._exit(0)
    os.close(put)
    raw, until = b"", time.monotonic() + job["seconds"]
    while (left := until - time.monotonic()) > 0 and select.select([get], [], [], left)[0]:
        part = os.read(get, 65536)
        if not part:
            break
        raw += part
    else:
        raw = None
    os.kill(pid, signal.SIGKILL)
    os.waitpid(pid, 0)
    os.close(get)
    out.append(("TIMEOUT", "") if raw is None else json.loads(raw) if raw else ("ERROR", "exit:"))
print("\x1e" + json.dumps(out))
"""


def run_probes(source: str, entry: str, exprs: list[str], seconds: float = SECONDS) -> list[tuple[str, str]]:
    """(VALUE, repr) or (ERROR, type:message) or (TIMEOUT, '') of each probe, in a child process of its own session."""
    if not exprs:
        return []
    with tempfile.TemporaryDirectory() as home:
        env = {"PYTHONHASHSEED": "0", "PATH": os.defpath, "HOME": home}
        child = subprocess.Popen([sys.executable, "-I", "-c", _RUNNER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=home, env=env, start_new_session=True, text=True)
        try:
            said, _ = child.communicate(json.dumps({"source": source or "", "entry": entry, "probes": exprs, "seconds": seconds}), timeout=seconds * len(exprs) + 5)
        except subprocess.TimeoutExpired:
            os.killpg(child.pid, 9)
            child.communicate()
            return [("TIMEOUT", "")] * len(exprs)
    found = said.rpartition("\x1e")[2] if "\x1e" in said else ""  # the last marker: probes may print
    return [tuple(x) for x in json.loads(found)] if found else [("ERROR", "exit:")] * len(exprs)


_OUTCOMES = "outcomes array<struct<status: string, value: string>>"


def _run_all(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """rows (key, source, entry, probes) -> (key, outcomes)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, [{"status": a, "value": b} for a, b in run_probes(s, e, list(p), seconds)]) for k, s, e, p in zip(frame["key"], frame["source"], frame["entry"], frame["probes"], strict=True)]
            yield pd.DataFrame(out, columns=["key", "outcomes"])

    return rows.select(F.col(key).alias("key"), "source", "entry", "probes").mapInPandas(run, f"key string, {_OUTCOMES}")


def signatures(tasks: DataFrame, mutants: DataFrame, most: int = MOST_PROBES, seconds: float = SECONDS) -> DataFrame:
    """(problem_id, mutant_id, signature): by probe 2 where the mutant runs out of time, 0 where it does what the
    reference does, 1 where not. tasks (problem_id, prompt, source, entry), mutants (problem_id, mutant_id, mutated_source)."""
    lists = build_probes(tasks, most).groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("probe_ix", "expr"))).alias("p")).select("problem_id", F.col("p.expr").alias("probes"))
    known = tasks.join(lists, "problem_id", "left").select("problem_id", "source", "entry", F.coalesce("probes", F.array().cast("array<string>")).alias("probes"))
    reference = _run_all(known, "problem_id", seconds).select(F.col("key").alias("problem_id"), F.col("outcomes").alias("want"))
    rows = mutants.join(known.drop("source"), "problem_id").select("mutant_id", F.col("mutated_source").alias("source"), "entry", "probes")
    got = _run_all(rows, "mutant_id", seconds).select(F.col("key").alias("mutant_id"), "outcomes")
    pairs = mutants.select("problem_id", "mutant_id").join(got, "mutant_id").join(reference, "problem_id")
    mark = F.zip_with("outcomes", "want", lambda a, b: F.when(a["status"] == "TIMEOUT", 2).when((a["status"] == b["status"]) & (a["value"] == b["value"]), 0).otherwise(1))
    return pairs.select("problem_id", "mutant_id", mark.alias("signature"))


def features(mutants: DataFrame) -> DataFrame:
    """(problem_id, id, features) of mutants (problem_id, mutant_id, operator, node_type, parent_type, line, description, signature).

    The vector: operator, node kind and parent kind one-hot (kinds of this task), line by the task's last line,
    a bucket of the description, and half the signature, with zeros up to the task's longest."""
    own = mutants.withColumns({"node": F.coalesce("node_type", F.lit("Unknown")), "parent": F.coalesce("parent_type", F.lit("Unknown"))})
    task = Window.partitionBy("problem_id")
    wide = own.withColumns({"nodes": F.sort_array(F.collect_set("node").over(task)), "parents": F.sort_array(F.collect_set("parent").over(task)), "last": F.max("line").over(task), "longest": F.max(F.size("signature")).over(task)})
    hot = lambda words, value: F.transform(words, lambda x: F.when(x == value, 1.0).otherwise(0.0))
    codes = F.aggregate(F.transform(F.split("description", ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda s, c: s + c)
    bucket = F.when(F.length("description") > 0, codes % 17 / 16.0).otherwise(0.0)
    half = F.transform("signature", lambda x: x / 2.0)
    zeros = F.array_repeat(F.lit(0.0), F.col("longest") - F.size("signature"))
    vector = F.concat(hot(F.array(*map(F.lit, OPERATORS)), F.col("operator")), hot(F.col("nodes"), F.col("node")), hot(F.col("parents"), F.col("parent")), F.array(F.col("line") / F.greatest("last", F.lit(1)), bucket), half, zeros)
    return wide.select("problem_id", F.col("mutant_id").alias("id"), vector.alias("features"))


def representatives(vectors: DataFrame, most: int = 5) -> DataFrame:
    """(problem_id, id, cluster, size, distance, chosen): Ward clusters within each task, and of each the mutant
    nearest to its mean (the smallest id among equals)."""
    groups = ward_groups(vectors, most).join(vectors, ["problem_id", "id"])
    means = groups.select("problem_id", "cluster", F.posexplode("features")).groupBy("problem_id", "cluster", "pos").agg(F.avg("col").alias("mean")).groupBy("problem_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m"))
    apart = F.aggregate(F.zip_with("features", F.col("m.mean"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = groups.join(means, ["problem_id", "cluster"]).withColumn("distance", F.round(F.sqrt(apart), 9))
    own = Window.partitionBy("problem_id", "cluster")
    return rows.select("problem_id", "id", "cluster", F.count(F.lit(1)).over(own).alias("size"), "distance", (F.row_number().over(own.orderBy("distance", "id")) == 1).alias("chosen"))


def _callee(call: ast.Call) -> str:
    text = ast.unparse(call.func)
    return text if re.fullmatch(r"[\w.]+", text) else ""


def obvious_equivalent(source: str, mutated: str, operator: str) -> str:
    """Why a mutant can't differ, or '': its only changed call is commutative and has its first two arguments swapped."""
    if operator != "ARGUMENT_SWAP":
        return ""
    try:
        before, after = ([n for n in ast.walk(ast.parse(t or "")) if isinstance(n, ast.Call)] for t in (source, mutated))
    except (SyntaxError, ValueError):
        return ""
    changed = [(a, b) for a, b in zip(before, after, strict=False) if ast.dump(a) != ast.dump(b)]
    if len(before) != len(after) or len(changed) != 1:
        return ""
    a, b = changed[0]
    swapped = len(a.args) > 1 and [*map(ast.dump, b.args)] == [*map(ast.dump, [a.args[1], a.args[0], *a.args[2:]])]
    alike = _callee(a) == _callee(b) and [*map(ast.dump, a.keywords)] == [*map(ast.dump, b.keywords)]
    return f"first two arguments swapped in commutative call {_callee(a)}" if swapped and alike and _callee(a) in COMMUTATIVE else ""


def mark_equivalents(pairs: DataFrame) -> DataFrame:
    """pairs (problem_id, mutant_id, operator, source, mutated_source) -> (problem_id, mutant_id, status, reason)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            reasons = [obvious_equivalent(s, m, o) for s, m, o in zip(frame["source"], frame["mutated_source"], frame["operator"], strict=True)]
            yield pd.DataFrame({"problem_id": frame["problem_id"], "mutant_id": frame["mutant_id"], "status": ["STATIC_EQUIVALENT" if r else "UNKNOWN" for r in reasons], "reason": reasons})

    return pairs.select("problem_id", "mutant_id", "operator", "source", "mutated_source").mapInPandas(run, "problem_id string, mutant_id string, status string, reason string")
