"""op9, op10: rows that open into much more work are dealt over many tasks."""

from __future__ import annotations

import numpy as np

from gridclime.llm import mixing, warc
from gridclime.llm.store import tasks_for


def test_archives_are_read_by_many_tasks(spark):
    pages = spark.range(400).selectExpr("id as page_id", "concat('u', id) as url", "repeat(sha2(string(id), 512), 20) as html")
    records = warc.round_trip(pages, split=4000)
    assert records.rdd.getNumPartitions() == tasks_for(spark, 10**9)
    assert records.count() == 400


def test_one_task_for_each_piece_up_to_four_a_core(spark):
    most = 4 * spark.sparkContext.defaultParallelism
    assert [tasks_for(spark, n) for n in (0, 1, 3, most + 5)] == [1, 1, 3, most]


def test_the_mix_takes_one_python_worker_a_task(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('word ', cast(id * 7 as int)) as text", "nullif(concat('s', id % 3), 's2') as source")
    documents, mixed = mixing.mix(docs, block=16, shard_slots=32)
    for df in (documents, mixed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert "ExistingRDD" not in plan  # rows of an RDD that Python makes come from workers of their own
    taken = {r.source: (r.n, r.target) for r in documents.groupBy("source").agg({"taken": "sum", "target": "first"}).toDF("source", "n", "target").collect()}
    assert taken.keys() == {"s0", "s1", None} and all(n == round(target) > 0 for n, target in taken.values())


def test_the_mix_broadcasts_no_table_that_opens_with_the_corpus(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('word ', cast(id * 7 as int)) as text", "concat('s', id % 3) as source")
    for df in mixing.mix(docs, block=16, shard_slots=32):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = {line.split("[")[0].split()[-1] for line in plan.splitlines() if "Join [number#" in line and ", index#" in line}
        assert joins == {"SortMergeJoin"}


def test_draws_are_held_a_few_at_a_time():
    slots = np.array([700, 0, 5, 1300])
    tables = list(mixing.draw_tables(mixing.shard_counts(slots, 64, 7), 4, rows_each=10))
    assert len(tables) > 5 and all(0 < t.num_rows <= 10 for t in tables)
    rows = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    held = {i: [] for i in range(4)}
    shards = {}
    for shard, number, k, n in rows:
        held[number] += range(k, k + n)
        shards[shard] = shards.get(shard, 0) + n
    assert [held[i] for i in range(4)] == [list(range(n)) for n in slots]
    assert [shards[i] for i in range(len(shards))] == [64] * 31 + [21]
    assert [t.num_rows for t in mixing.draw_tables(mixing.shard_counts(slots[1:2], 64, 7), 1)] == [0]
