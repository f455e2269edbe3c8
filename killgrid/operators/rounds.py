"""Generation rounds: providers, layers of attempts, escalation, and a baseline of many attempts.

A task's attempts depend on each other but not on other tasks, and a task has a bounded number of
mutants. So a task is one row with its mutants in an array, and all its rounds run inside one map:
no shuffle per attempt and nothing on the driver. Everything between attempts is deterministic if
the provider is, so a lost executor's tasks can simply run again.

Defined results: a task whose source doesn't parse has no mutants and no attempts; null texts count
as empty; repeated tasks run repeatedly; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.code import extract_check
from .mutation import check_contract, mutate, run_checks

HISTORY = "problem_id string, method string, layer string, attempt int, provider string, model string, status string, new_kills int, cumulative_kills int, total int, tokens_in long, tokens_out long, reason string, test string"


@dataclass(frozen=True)
class Reply:
    text: str
    tokens_in: int
    tokens_out: int


@dataclass(frozen=True)
class Layer:
    """One stage: its provider and model, the number of attempts, and how many without gain end it."""

    name: str
    provider: str
    model: str = ""
    attempts: int = 3
    patience: int = 2
    method: str = "proposed"


Provider = Callable[[str, str, int], Reply]
_factories: dict[str, Callable[[], Provider]] = {}
_aliases: dict[str, str] = {}


def register_provider(name: str, factory: Callable[[], Provider], aliases: tuple[str, ...] = ()) -> None:
    """Make a provider known; its factory is called once per task batch, on the executor."""
    key = name.strip().lower()
    if not key or key.startswith("<"):
        raise ValueError(f"not a provider's name: {name!r}")
    _factories[key] = factory
    _aliases.update({a.strip().lower(): key for a in aliases})


def available_providers() -> list[str]:
    return sorted(_factories)


def factory_of(name: str) -> Callable[[], Provider]:
    key = _aliases.get(name.strip().lower(), name.strip().lower())
    if key not in _factories:
        raise ValueError(f"no provider {name!r}; there are {available_providers()}")
    return _factories[key]


def words(text: str) -> int:
    return len((text or "").split())


def mock() -> Provider:
    """A provider that needs no network: its check never fails a task, so it kills nothing."""
    text = "def check(candidate):\n    assert callable(candidate) or candidate() is None\n"
    return lambda prompt, model, attempt: Reply(text, words(prompt), words(text))


def scripted(checks: list[str]) -> Callable[[], Provider]:
    """A factory of providers that give the checks in turn, one each attempt."""
    return lambda: lambda prompt, model, attempt: Reply(checks[attempt % len(checks)], words(prompt), words(checks[attempt % len(checks)]))


register_provider("mock", mock, ("test", "none"))


@dataclass
class _State:
    total: int
    killed: set[str] = field(default_factory=set)
    suite: list[str] = field(default_factory=list)


def prompt_text(task: str, source: str, entry: str, live: list[tuple[str, str, int, str]], history: list[str], most: int = 12) -> str:
    """What a provider is asked: task, source, live mutants (the first of each source), and what came before."""
    lines = [f"Write check(candidate) for {entry}.", task or "", source, f"{len(live)} mutants are alive:"]
    lines += [f"- {m} {op} at line {line}" for m, op, line, _ in live[:most]]
    return "\n".join([*lines, *[f"Earlier: {h}" for h in history[-3:]]])


def judge(check: str, source: str, entry: str, live: list[tuple[str, str, int, str]], seconds: float) -> tuple[str, set[str], str]:
    """(status, ids killed, reason) of one check: its form, then the reference source, then the live mutants."""
    if reason := check_contract(check):
        return "REJECTED", set(), reason
    outcome = run_checks(source, entry, [check], seconds)[0]
    if outcome != "PASS":
        return "REJECTED", set(), f"reference: {outcome}"
    killed = {m for m, _, _, text in live if run_checks(text, entry, [check], seconds)[0] != "PASS"}
    return ("PRODUCTIVE" if killed else "ZERO_GAIN"), killed, ""


def _layer(pid: str, task: str, source: str, entry: str, mutants: list, layer: Layer, call: Provider, state: _State, seconds: float) -> Iterator[tuple]:
    streak = errors = 0
    history: list[str] = []
    for attempt in range(layer.attempts):
        live = [m for m in mutants if m[0] not in state.killed]
        if not live or streak >= max(1, layer.patience) or errors >= 2:
            return
        try:
            reply = call(prompt_text(task, source, entry, live, history), layer.model, attempt)
        except (OSError, RuntimeError, ValueError) as e:
            # a failed call neither gains nor counts as a try without gain
            errors += 1
            yield pid, layer.method, layer.name, attempt, layer.provider, layer.model, "ERROR", 0, len(state.killed), state.total, 0, 0, str(e)[:300], ""
            continue
        errors = 0
        check = extract_check(reply.text)
        status, killed, reason = judge(check, source, entry, live, seconds)
        streak = 0 if killed else streak + 1
        state.killed |= killed
        if status == "PRODUCTIVE":
            state.suite.append(check)
        history.append(f"{status} {len(killed)} {reason}".strip())
        yield pid, layer.method, layer.name, attempt, layer.provider, layer.model, status, len(killed), len(state.killed), state.total, reply.tokens_in, reply.tokens_out, reason, check


def run_layers(tasks: DataFrame, layers: list[Layer], most: int = 25, seconds: float = 2.0) -> DataFrame:
    """History of all attempts of tasks (problem_id, prompt, source, entry): one row each, see HISTORY.

    Layers of one method follow each other on the mutants the earlier ones left; methods are independent.
    """
    factories = {layer.provider: factory_of(layer.provider) for layer in layers}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = {name: make() for name, make in factories.items()}
        for frame in frames:
            for pid, task, source, entry in zip(frame["problem_id"], frame["prompt"], frame["source"], frame["entry"], strict=True):
                made = [(m.id_of(pid), m.operator, m.line, m.text) for m in mutate(source or "", most)]
                states: dict[str, _State] = {}
                rows: list[tuple] = []
                for layer in layers:
                    state = states.setdefault(layer.method, _State(len(made)))
                    rows += _layer(pid, task, source, entry, made, layer, calls[layer.provider], state, seconds)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in HISTORY.split(", ")])

    return tasks.select("problem_id", "prompt", "source", "entry").mapInPandas(run, HISTORY)
