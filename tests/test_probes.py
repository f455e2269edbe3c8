"""Probes, signatures, features and equivalents against what can be worked out by hand."""

import ast

import pytest

from killgrid.operators import mutation, probes


def test_probes_come_in_order():
    prompt = "def f(a, b):\n  >>> f(1, 2) == 3\n  True\nf(4, (5, 6)) is odd, f(x, 1) isn't literal, f(4, (5, 6)) again\n"
    assert probes.probes(prompt, "def f(a, b):\n    return a\n", "f") == ["candidate(1, 2) == 3", "candidate(4, (5, 6))", "candidate(0, ())", "candidate(1, (0,))", "candidate(-1, (0, 1))", "candidate(2, (0, 1))"]
    assert probes.probes("", "def f(xs: List[str], t: bool):\n    return xs\n", "f") == ["candidate([], False)", 'candidate(["a"], True)', 'candidate(["a", "b"], True)']
    assert probes.probes(None, None, "f") == [] and probes.probes("", "def f():\n    return 1\n", "f") == []
    assert len(probes.probes("f(1) f(2) f(3) f(4)", "def f(a):\n    return a\n", "f", most=3)) == 3


@pytest.mark.parametrize("kind, first", [("List[float]", "[]"), ("Sequence[int]", "[]"), ("Tuple[int]", "()"), ("Dict[str, int]", "{}"), ("str", '""'), ("bool", "False"), ("float", "0.0"), ("int", "0"), ("", "0"), ("Any", "0")])
def test_values_by_annotation(kind, first):
    assert probes.values_for(kind)[0] == first and all(ast.literal_eval(v) is not NotImplemented for v in probes.values_for(kind))


def test_probes_run_apart():
    source = "seen = []\ndef f(n):\n    seen.append(n)\n    if n == 2:\n        while True: pass\n    if n == 3:\n        raise KeyError('k')\n    if n == 4:\n        import os; os._exit(1)\n    print('\\x1e noise')\n    return seen\n"
    got = probes.run_probes(source, "f", [f"candidate({i})" for i in (0, 1, 2, 3, 4, 5)], 0.7)
    assert got == [("VALUE", "[0]"), ("VALUE", "[1]"), ("TIMEOUT", ""), ("ERROR", "KeyError:'k'"), ("ERROR", "exit:"), ("VALUE", "[5]")]
    assert probes.run_probes("not python(", "f", ["candidate(1)"])[0][0] == "ERROR" and probes.run_probes(source, "f", []) == []


def test_sites_come_in_preorder():
    source = "def f(a, b):\n    if a < b:\n        a += 1\n        return a - 5\n    return min(a, b)\n"
    got = [(m.ordinal, m.operator, m.line) for m in mutation.mutate(source, 100)]
    want = ["NEGATE_CONDITION", "COMPARISON_FLIP", "BOUNDARY_SHIFT", "CONSTANT_CHANGE", "CONSTANT_CHANGE", "RETURN_VALUE_CHANGE", "RETURN_VALUE_CHANGE", "ARITHMETIC_FLIP", "CONSTANT_CHANGE", "CONSTANT_CHANGE", "CONSTANT_CHANGE", "RETURN_VALUE_CHANGE", "RETURN_VALUE_CHANGE", "ARGUMENT_SWAP"]
    assert [o for _, o, _ in got] == want and [i for i, _, _ in got] == list(range(len(want)))
    few = mutation.mutate(source, 5)
    assert [m.text for m in few] == [mutation.mutate(source, 100)[int(j * len(want) / 5)].text for j in range(5)]


def test_contract():
    good = "def check(candidate, /):\n    assert candidate(1).__dict__\n"
    assert mutation.check_contract(good) == "" == mutation.check_contract("async def check(candidate):\n    assert candidate(1)\n")
    for bad in ("def check(candidate, *args):\n    assert candidate(1)\n", "def check(candidate, **kw):\n    assert candidate(1)\n", "def check(candidate):\n    assert candidate.__dict__ and candidate(1)\n", ""):
        assert mutation.check_contract(bad)


def test_equivalents():
    source = "import math\ndef f(a, b):\n    return min(a, b) + math.gcd(a, b) + pow(a, b)\n"
    for old, new, want in (("min(a, b)", "min(b, a)", True), ("math.gcd(a, b)", "math.gcd(b, a)", True), ("pow(a, b)", "pow(b, a)", False)):
        assert bool(probes.obvious_equivalent(source, source.replace(old, new), "ARGUMENT_SWAP")) == want
    assert not probes.obvious_equivalent(source, source.replace("min(a, b)", "min(b, a)"), "COMPARISON_FLIP") and not probes.obvious_equivalent("(", source, "ARGUMENT_SWAP")


def test_the_whole_chain(spark):
    source = "def add(a, b):\n    if a > b:\n        return a + b\n    return a - b\n"
    tasks = spark.createDataFrame([("t/1", "add(3, 1) gives 4, add(1, 3) gives -2", source, "add"), ("t/2", None, None, "g")], "problem_id string, prompt string, source string, entry string")
    made = mutation.mutants(tasks).persist()
    texts = {r.mutant_id: r.mutated_source for r in made.collect()}
    signed = probes.signatures(tasks, made)
    exprs = [r.expr for r in probes.build_probes(tasks).where("problem_id = 't/1'").orderBy("probe_ix").collect()]
    want = probes.run_probes(source, "add", exprs)
    for r in signed.collect():
        assert r.signature == [2 if g[0] == "TIMEOUT" else int(g != w) for g, w in zip(probes.run_probes(texts[r.mutant_id], "add", exprs), want, strict=True)]
    assert signed.count() == len(texts) and all(i.startswith("t_1:m") for i in texts)
    rows = made.join(signed, ["problem_id", "mutant_id"]).collect()
    vectors = probes.features(made.join(signed, ["problem_id", "mutant_id"]))
    nodes, parents = sorted({r.node_type for r in rows}), sorted({r.parent_type for r in rows})
    by_id = {r.id: r.features for r in vectors.collect()}
    for r in rows:
        own = [float(r.operator == o) for o in probes.OPERATORS] + [float(r.node_type == n) for n in nodes] + [float(r.parent_type == n) for n in parents]
        own += [r.line / max(x.line for x in rows), sum(map(ord, r.description)) % 17 / 16, *(s / 2 for s in r.signature)]
        assert by_id[r.mutant_id] == pytest.approx(own)
    chosen = probes.representatives(vectors).collect()
    assert len(chosen) == len(rows) and all(sum(r.chosen for r in chosen if r.cluster == c) == 1 for c in {r.cluster for r in chosen})
