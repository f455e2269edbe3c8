"""Functions on source text: checks in replies, calls, differences, parameters.

Each is a plain function of texts; `column` turns one into an Arrow-batched column function.
None counts as empty text and what doesn't parse gives the empty result, unless said otherwise.
"""

from __future__ import annotations

import ast
import difflib
import hashlib
import importlib.util
import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```[ \t]*\w*[ \t]*\n(.*?)```", re.S)
_CHECK = re.compile(r"^def check\(candidate\)\s*(->[^:]*)?:", re.M)
_PARTS = {"(": ")", "[": "]", "{": "}"}


def column(function: Callable[[str], str], returns: str = "string") -> Callable[[Column | str], Column]:
    """A column function of one text column."""
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function("" if t is None or t != t else t))

    return F.pandas_udf(batch, returns)


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError):
        return None


@lru_cache(maxsize=256)  # a task's mutants come one after the other, each with the task's source
def normal_source(text: str) -> str:
    """The text as the syntax tree spells it; as it is where it doesn't parse."""
    tree = _parsed(text)
    return ast.unparse(tree) if tree else text or ""


def extract_check(reply: str) -> str:
    """The first check(candidate) of a reply, fenced or not; lines after it that don't parse are left out."""
    text = "\n".join(_FENCE.findall(reply or "")) or reply or ""
    found = _CHECK.search(text)
    if not found:
        return ""
    lines = text[found.start() :].splitlines()
    # the body ends at the first later line that starts at the margin
    stop = next((i for i, line in enumerate(lines[1:], 1) if line.strip() and not line[0].isspace() and not line.startswith(("#", ")"))), len(lines))
    for end in range(stop, 1, -1):
        if tree := _parsed("\n".join(lines[:end])):
            return "\n".join(lines[: tree.body[0].end_lineno])
    return ""


def rename_check(text: str, ordinal: int) -> str:
    return _CHECK.sub(lambda m: m[0].replace("check(", f"check_{ordinal}(", 1), text or "", count=1)


def join_suite(checks: list[str]) -> str:
    """One module that runs every check in order."""
    named = [rename_check(c, i) for i, c in enumerate(checks)]
    calls = [f"    check_{i}(candidate)" for i in range(len(checks))] or ["    pass"]
    return "\n\n".join([*named, "\n".join(["def check(candidate):", *calls])]) + "\n"


def call_texts(text: str, name: str = "candidate", most: int = 12) -> list[str]:
    """The first calls of a function, as the syntax tree spells them."""
    tree = _parsed(text)
    nodes = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == name] if tree else []
    return [ast.unparse(n) for n in sorted(nodes, key=lambda n: (n.lineno, n.col_offset))[:most]]


def assert_texts(text: str, most: int = 12) -> list[str]:
    tree = _parsed(text)
    nodes = [n for n in ast.walk(tree) if isinstance(n, ast.Assert)] if tree else []
    return [ast.unparse(n.test) for n in sorted(nodes, key=lambda n: n.lineno)[:most]]


def digest(text: str) -> str:
    """JSON of a check: a short hash, its calls and assertions."""
    return json.dumps({"sha1": hashlib.sha1((text or "").encode()).hexdigest()[:10], "calls": call_texts(text), "asserts": assert_texts(text)})


def compact_source(text: str) -> str:
    """Source without docstrings and comments."""
    tree = _parsed(text)
    if not tree:
        return text or ""
    for node in ast.walk(tree):
        if isinstance(node, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:] or [ast.Pass()]
    return ast.unparse(tree)


def source_diff(old: str, new: str) -> str:
    """Unified difference of two sources, spelt alike."""
    return "\n".join(difflib.unified_diff(normal_source(old).splitlines(), normal_source(new).splitlines(), "original", "mutant", lineterm="", n=3))


def changed_lines(old: str, new: str) -> tuple[str, str]:
    """The lines removed and those added, without indentation."""
    lines = [x for x in source_diff(old, new).splitlines() if not x.startswith(("---", "+++"))]
    return tuple("\n".join(x[1:].strip() for x in lines if x.startswith(sign)) for sign in "-+")


def balanced_end(text: str, start: int) -> int:
    """Place of the bracket that closes the one at start, outside strings; -1 if there is none."""
    stack, quote, i = [], "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in _PARTS:
            stack.append(_PARTS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i
        i += 1
    return -1


def split_arguments(text: str) -> list[str]:
    """Text between commas that no bracket or string holds."""
    out, at, i = [], 0, 0
    text = text or ""
    while i < len(text):
        if text[i] in _PARTS and (end := balanced_end(text, i)) > 0:
            i = end
        elif text[i] in "'\"":
            i = next((k for k in range(i + 1, len(text)) if text[k] == text[i] and text[k - 1] != "\\"), len(text))
        elif text[i] == ",":
            out.append(text[at:i].strip())
            at = i + 1
        i += 1
    return [x for x in [*out, text[at:].strip()] if x]


def entry_calls(text: str, entry: str) -> list[str]:
    """Argument texts of each call of entry, by bracket matching: for texts that needn't parse."""
    found = []
    for m in re.finditer(rf"(?<![\w.]){re.escape(entry)}\s*\(", text or ""):
        end = balanced_end(text, m.end() - 1)
        if end > 0 and not re.search(r"def\s+$", text[: m.start()]):
            found.append(text[m.end() : end].strip())
    return found


def to_candidate(text: str, entry: str) -> str:
    return re.sub(rf"(?<![\w.]){re.escape(entry)}\s*\(", "candidate(", text or "", count=1)


def parameters(source: str, entry: str) -> list[tuple[str, str]]:
    """(name, annotation) of the parameters of a function, '' where it has none."""
    tree = _parsed(source)
    found = next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and n.name == entry), None) if tree else None
    return [(a.arg, ast.unparse(a.annotation) if a.annotation else "") for a in found.args.args] if found else []


def argument_key(call: str) -> str:
    """The arguments of a call as a canonical tuple, '' unless they are all literals."""
    try:
        node = ast.parse(call, mode="eval").body
        return repr(tuple(ast.literal_eval(a) for a in node.args)) if isinstance(node, ast.Call) and not node.keywords else ""
    except (SyntaxError, ValueError, TypeError):
        return ""


def literal(text: str, default=None):
    """A value from JSON or else a Python literal; the default for blank or other texts."""
    if not (text or "").strip():
        return default
    for parse in (json.loads, ast.literal_eval):
        try:
            return parse(text)
        except (ValueError, SyntaxError):
            continue
    return default


def compose_source(prompt: str, solution: str, entry: str) -> str:
    """Whole source of a task: the solution alone if it defines the entry point, else after its prompt, indented as a body."""
    solution = solution or ""
    if re.search(rf"^def\s+{re.escape(entry)}\s*\(", solution, re.M):
        return solution
    body = solution if not solution.strip() or solution[0].isspace() else "\n".join("    " + x if x.strip() else x for x in solution.splitlines())
    return f"{(prompt or '').rstrip()}\n{body}\n"


def task_text(instruction: str, prompt: str, entry: str) -> str:
    """What a task asks for: its instruction, else the entry point's docstring, else its prompt."""
    if (instruction or "").strip():
        return instruction
    tree = _parsed(prompt)
    found = next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and n.name == entry), None) if tree else None
    return (ast.get_docstring(found) if found else None) or prompt or ""


def adapt_test(test: str) -> str:
    """A reference test as check(candidate): as it is, a check without effect for an empty one, else the text as its body."""
    if not (test or "").strip():
        return "def check(candidate):\n    pass\n"
    if _CHECK.search(test):
        return test
    return f"def check(candidate):\n    import unittest\n    space = {{'candidate': candidate, '__name__': 'suite', 'unittest': unittest}}\n    exec({test!r}, space)\n    cases = [v for v in space.values() if isinstance(v, type) and issubclass(v, unittest.TestCase)]\n    for case in cases:\n        result = unittest.TestResult()\n        unittest.defaultTestLoader.loadTestsFromTestCase(case).run(result)\n        assert result.wasSuccessful()\n"


def missing_libraries(names: list[str]) -> list[str]:
    """Names that can't be imported here, sorted."""
    def absent(name: str) -> bool:
        try:
            return importlib.util.find_spec(name.split(".")[0]) is None
        except (ImportError, ValueError):
            return True

    return sorted({n for n in names or [] if n and absent(n)})


def retry_seconds(message: str, default: float = 5.0, most: float = 60.0) -> float:
    """The wait that an error message names ("retry in 250ms", "2.5s", "1m"), within a limit."""
    found = re.search(r"(?:retry|try again|wait)\D{0,20}(\d+(?:\.\d+)?)\s*(ms|m|s)?", message or "", re.I)
    if not found:
        return default
    return min(most, float(found[1]) * {"ms": 0.001, "m": 60.0}.get((found[2] or "s").lower(), 1.0))
