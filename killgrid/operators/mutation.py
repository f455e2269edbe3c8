"""Single-point mutants of Python functions, their evaluation in child processes, and grouping.

`mutants` explodes each source into at most `most` mutants, `evaluate` runs
check functions against sources, one child process per source, `kill_matrix`
joins outcomes to kills, `validate_checks` tells which texts are usable checks
and `ward_groups` clusters feature vectors. Every stage is a narrow map over
Arrow batches, so tasks scale with the input's partitions.
"""

from __future__ import annotations

import ast
import hashlib
import json
import os
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each operator changes into what.
_FLIPS = {ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.Gt, ast.Gt: ast.Lt, ast.LtE: ast.GtE, ast.GtE: ast.LtE}
_BOUNDS = {ast.Lt: ast.LtE, ast.LtE: ast.Lt, ast.Gt: ast.GtE, ast.GtE: ast.Gt}
_MEMBER = {ast.In: ast.NotIn, ast.NotIn: ast.In}
_IDENTITY = {ast.Is: ast.IsNot, ast.IsNot: ast.Is}
_ARITH = {ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.Div, ast.Div: ast.Mult, ast.FloorDiv: ast.Div, ast.Mod: ast.Mult, ast.Pow: ast.Mult}
_BOOL = {ast.And: ast.Or, ast.Or: ast.And}
MUTANTS = "problem_id string, mutant_id string, operator string, line int, mutated_source string, node_type string, parent_type string, description string"
_FORBIDDEN_CALLS = {"eval", "exec", "compile"}
_FORBIDDEN_ATTRS = {"__code__", "__dict__", "__globals__", "__module__"}


def _is_int(node) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, int) and not isinstance(node.value, bool)


def _edits(node: ast.AST):
    """(operator, function that changes a copy of the node in place or returns its replacement) in a fixed order."""
    def swapped(name, table, i):
        def change(n):
            n.ops[i] = table[type(n.ops[i])]()
        return name, change

    if isinstance(node, ast.Compare):
        for i, op in enumerate(node.ops):
            for name, t in (("COMPARISON_FLIP", _FLIPS), ("BOUNDARY_SHIFT", _BOUNDS), ("MEMBERSHIP_FLIP", _MEMBER), ("IDENTITY_FLIP", _IDENTITY)):
                if type(op) in t:
                    yield swapped(name, t, i)
    elif isinstance(node, ast.BinOp) and type(node.op) in _ARITH:
        yield "ARITHMETIC_FLIP", lambda n: setattr(n, "op", _ARITH[type(n.op)]())
    elif isinstance(node, ast.BoolOp):
        yield "BOOLEAN_FLIP", lambda n: setattr(n, "op", _BOOL[type(n.op)]())
    elif isinstance(node, ast.Constant):
        if isinstance(node.value, bool):
            yield "BOOLEAN_FLIP", lambda n: setattr(n, "value", not n.value)
        elif isinstance(node.value, int | float):
            for step in (1, -1):
                yield "CONSTANT_CHANGE", lambda n, d=step: setattr(n, "value", n.value + d)
            if _is_int(node) and node.value not in (0, 1, -1):
                yield "CONSTANT_CHANGE", lambda n: setattr(n, "value", 0)
    elif isinstance(node, ast.Return) and node.value is not None:
        for value in (None, False):
            yield "RETURN_VALUE_CHANGE", lambda n, v=value: setattr(n, "value", ast.Constant(v))
    elif isinstance(node, ast.If | ast.While):
        yield "NEGATE_CONDITION", lambda n: setattr(n, "test", ast.UnaryOp(ast.Not(), n.test))
    elif isinstance(node, ast.Subscript):
        if _is_int(node.slice):
            for step in (1, -1):
                yield "INDEX_BOUNDARY", lambda n, d=step: setattr(n, "slice", ast.Constant(n.slice.value + d))
        elif isinstance(node.slice, ast.Slice):
            for end in ("lower", "upper"):
                if _is_int(getattr(node.slice, end)):
                    yield "INDEX_BOUNDARY", lambda n, e=end: setattr(n.slice, e, ast.Constant(getattr(n.slice, e).value + 1))
    if isinstance(node, ast.Call):
        if len(node.args) >= 2:
            yield "ARGUMENT_SWAP", lambda n: n.args.__setitem__(slice(0, 2), [n.args[1], n.args[0]])
        if isinstance(node.func, ast.Name) and node.func.id == "range":
            for i, a in enumerate(node.args):
                if _is_int(a):
                    for step in (1, -1):
                        yield "RANGE_BOUNDARY", lambda n, k=i, d=step: n.args.__setitem__(k, ast.Constant(n.args[k].value + d))


def _preorder(node: ast.AST, parent: ast.AST | None = None) -> Iterator[tuple[ast.AST, ast.AST | None]]:
    """A node, then what is below it, child by child; each with its parent."""
    stack = [(node, parent)]
    while stack:
        own, above = stack.pop()
        yield own, above
        stack += [(child, own) for child in reversed(list(ast.iter_child_nodes(own)))]


def _fields(node: ast.AST) -> list[tuple[ast.AST, dict]]:
    """What an edit of the node may change: its fields, and those of its slice."""
    own = [node, node.slice] if isinstance(node, ast.Subscript) else [node]
    return [(n, {f: list(v) if isinstance(v, list) else v for f, v in ast.iter_fields(n)}) for n in own]


@dataclass(frozen=True)
class Mutant:
    """ordinal: place among the sites chosen, counted before repeats go."""

    ordinal: int
    operator: str
    line: int
    text: str
    node_type: str
    parent_type: str
    description: str

    def id_of(self, problem_id: str) -> str:
        return f"{problem_id.replace('/', '_')}:m{self.ordinal:03d}:{self.operator}:{hashlib.sha1(self.text.encode()).hexdigest()[:10]}"


def mutate(source: str, most: int = 25) -> list[Mutant]:
    """Mutants of evenly spaced sites in pre-order, without repeats; nothing for what doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    sites = [(node, parent, k, name) for node, parent in _preorder(tree) for k, (name, _) in enumerate(_edits(node))]
    if len(sites) > most:
        sites = [sites[int(j * len(sites) / most)] for j in range(most)]
    out: dict[str, Mutant] = {}
    for ordinal, (node, parent, k, name) in enumerate(sites):
        before = ast.unparse(node) if not isinstance(node, ast.stmt) else type(node).__name__
        kept = _fields(node)
        list(_edits(node))[k][1](node)
        try:
            text = ast.unparse(ast.fix_missing_locations(tree))
            if text not in out:
                compile(text, "<mutant>", "exec")
        except (SyntaxError, ValueError):
            continue
        finally:
            for own, fields in kept:
                own.__dict__.update(fields)
        out.setdefault(text, Mutant(ordinal, name, getattr(node, "lineno", 0), text, type(node).__name__, type(parent).__name__, f"{name} of {before}"[:200]))
    return list(out.values())


def mutants(tasks: DataFrame, most: int = 25, with_source: bool = False) -> DataFrame:
    """One row per mutant of tasks (problem_id, source), with the task's source if it is asked for."""
    shape = f"{MUTANTS}, source string" if with_source else MUTANTS
    width = shape.count(",") + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, m.id_of(p), m.operator, m.line, m.text, m.node_type, m.parent_type, m.description, s)[:width] for p, s in zip(frame["problem_id"], frame["source"], strict=True) for m in mutate(s or "", most)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])

    return tasks.select("problem_id", "source").mapInPandas(run, shape)


_CHILD = r"""
import json, sys, signal
job = json.load(sys.stdin)
class Late(BaseException): pass
def late(*_): raise Late()
signal.signal(signal.SIGALRM, late)
out = []
space = {"__name__": "task"}
try:
    exec(compile(job["source"], "task.py", "exec"), space)
    made = None
except BaseException as e:
    made = f"ERROR:{type(e).__name__}"
for text in job["checks"]:
    if made:
        out.append(made); continue
    own = dict(space)
    signal.setitimer(signal.ITIMER_REAL, job["seconds"])
    try:
        exec(compile(text, "check.py", "exec"), own)
        own["check"](own[job["entry"]])
        out.append("PASS")
    except AssertionError: out.append("FAIL")
    except Late: out.append("TIMEOUT")
    except BaseException as e: out.append(f"ERROR:{type(e).__name__}")
    finally: signal.setitimer(signal.ITIMER_REAL, 0)
print("\x1e" + json.dumps(out))
"""


def run_checks(source: str, entry: str, checks: list[str], seconds: float = 2.0) -> list[str]:
    """PASS, FAIL, TIMEOUT or ERROR:type of each check, in one child process of its own session."""
    if not checks:
        return []
    with tempfile.TemporaryDirectory() as home:
        env = {"PYTHONHASHSEED": "0", "PATH": os.defpath, "HOME": home}
        child = subprocess.Popen([sys.executable, "-I", "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=home, env=env, start_new_session=True, text=True)
        try:
            said, _ = child.communicate(json.dumps({"source": source, "entry": entry, "checks": checks, "seconds": seconds}), timeout=max(seconds + 5, seconds * len(checks) + 3))
        except subprocess.TimeoutExpired:
            os.killpg(child.pid, 9)
            child.communicate()
            return ["TIMEOUT"] * len(checks)
    found = said.rpartition("\x1e")[2] if "\x1e" in said else ""
    return json.loads(found) if found else ["ERROR:exit"] * len(checks)


def evaluate(rows: DataFrame, seconds: float = 2.0) -> DataFrame:
    """rows (id, source, entry, checks array) -> (id, test_ix, outcome)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(i, k, o) for i, s, e, c in zip(frame["id"], frame["source"], frame["entry"], frame["checks"], strict=True) for k, o in enumerate(run_checks(s, e, list(c), seconds))]
            yield pd.DataFrame(out, columns=["id", "test_ix", "outcome"])

    return rows.select("id", "source", "entry", "checks").mapInPandas(run, "id string, test_ix int, outcome string")


def kill_matrix(outcomes: DataFrame) -> DataFrame:
    """Per mutant: KILLED if any check doesn't pass, and the labels of those checks in order."""
    bad = F.when(F.col("outcome") != "PASS", F.struct("test_ix", "outcome"))
    labels = F.transform(F.array_sort(F.collect_list(bad)), lambda x: F.concat(F.lit("test_"), x["test_ix"], F.lit(":"), x["outcome"]))
    return outcomes.groupBy("id").agg(F.when(F.bool_or(F.col("outcome") != "PASS"), "KILLED").otherwise("SURVIVED").alias("status"), labels.alias("kill_tests"))


def check_contract(text: str) -> str:
    """'' for a usable check, else the first thing that is wrong with it."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return "syntax error"
    found = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name == "check"]
    takes = found[0].args if len(found) == 1 else None
    if not takes or [a.arg for a in (*takes.posonlyargs, *takes.args)] != ["candidate"] or takes.vararg or takes.kwarg:
        return "exactly one check(candidate) is needed"
    nodes = list(ast.walk(found[0]))
    calls = [n.func.id for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]
    if "candidate" not in calls:
        return "candidate is never called"
    if not any(isinstance(n, ast.Assert) for n in nodes):
        return "no assert"
    if _FORBIDDEN_CALLS.intersection(calls):
        return "forbidden call"
    of_candidate = {n.attr for n in nodes if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "candidate"}
    if _FORBIDDEN_ATTRS & of_candidate:
        return "forbidden attribute"
    return ""


def validate_checks(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> (id, ok, reason)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            reasons = [check_contract(t) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "ok": [not r for r in reasons], "reason": reasons})

    return texts.select("id", "text").mapInPandas(run, "id string, ok boolean, reason string")


def ward(points: np.ndarray, most: int = 5) -> np.ndarray:
    """Labels of the Ward partition into 2..most groups with the best silhouette; one group below two points."""
    n = len(points)
    if n < 3:
        return np.zeros(n, int)
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    d, size, groups = dist**2, np.ones(n), {i: [i] for i in range(n)}
    np.fill_diagonal(d, np.inf)
    best, score = np.zeros(n, int), -2.0
    while len(groups) > 2 or len(groups) == 2 and best is None:
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        others = np.array([k for k in groups if k not in (i, j)])
        total = size[i] + size[j] + size[others]
        d[i, others] = d[others, i] = ((size[i] + size[others]) * d[i, others] + (size[j] + size[others]) * d[j, others] - size[others] * d[i, j]) / total
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        groups[i] += groups.pop(j)
        if len(groups) <= min(most, n - 1):
            labels = np.zeros(n, int)
            for g, own in enumerate(groups.values()):
                labels[own] = g
            if (s := silhouette(dist, labels)) >= score:
                best, score = labels, s
    return best


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    kinds = np.unique(labels)
    means = np.stack([dist[:, labels == k].sum(1) for k in kinds], 1)
    counts = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    a = means[np.arange(len(labels)), own] / np.maximum(counts[own] - 1, 1)
    other = means / counts
    other[np.arange(len(labels)), own] = np.inf
    b = other.min(1)
    s = np.where(counts[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float(s.mean())


def ward_groups(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows (problem_id, id, features) -> (problem_id, id, cluster), clustered within each problem (at most 25 mutants each)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        x = np.array(frame["features"].tolist(), float)
        sd = x.std(0)
        return pd.DataFrame({"problem_id": frame["problem_id"], "id": frame["id"], "cluster": ward((x - x.mean(0)) / np.where(sd == 0, 1, sd), most)})

    return rows.select("problem_id", "id", "features").groupBy("problem_id").applyInPandas(run, "problem_id string, id string, cluster int")
