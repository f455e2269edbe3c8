"""Work on source code is dealt by rows, not by bytes."""

import ast

from killgrid.operators import mutation
from killgrid.plans import custom


def test_suppliers_of_one_small_file_are_the_work_of_many_tasks(spark):
    least = spark.sparkContext.defaultParallelism
    for query in (custom.ast_mutants, custom.static_equivalents, custom.contract_check, custom.probe_build):
        assert query(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= least
    dealt = custom._tasks(spark, "/root/testdata/sf0.1")
    assert max(dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < dealt.count()


def test_a_mutant_carries_its_source_and_its_one_change_only(spark):
    source = "def f(xs, n=2):\n    for i in range(0, n):\n        xs[1:3][0] += max(xs[i], 3) if n < 1 <= i else -1\n    return xs[0] and True"
    (task,) = mutation.mutants(spark.createDataFrame([("T", source)], "problem_id string, source string"), with_source=True).groupBy("source").count().collect()
    assert (task.source, task["count"]) == (source, len(mutation.mutate(source)))
    before = ast.unparse(ast.parse(source)).splitlines()
    for m in mutation.mutate(source):
        after = m.text.splitlines()
        assert len(after) == len(before) and sum(a != b for a, b in zip(before, after, strict=True)) == 1
