"""Golden values of the survey's fixtures, invariants of exchanges, and the defects that must not return."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel import catalogue
from tidewheel.functions import decoded_size, size_code
from tidewheel.operators import combining, integrity, ordering, partitioning
from tidewheel.plans.fetching import fetch_plan
from tidewheel.plans.flushing import flush_rounds, largest_first, sample_schedule
from tidewheel.session import session
from tidewheel.sources.exchange import register
from tidewheel.streaming import session_counts, tumbling_counts


def pairs(spark, rows):
    return spark.createDataFrame(rows, "key int, value int")


def test_four_records_in_five_partitions(spark):
    df = pairs(spark, [(1, 2), (2, 3), (4, 4), (6, 5)])
    placed = partitioning.by_id(df, 5, partitioning.modulo(F.col("key"), 5)).withColumn("p", F.spark_partition_id())
    assert {(r["key"], r["p"]) for r in placed.collect()} == {(1, 1), (6, 1), (2, 2), (4, 4)}


def test_empty_input_has_zero_lengths(spark):
    blocks = integrity.block_statistics(spark.createDataFrame([], "map_id long, reduce_id long"))
    grid = integrity.full_grid(blocks, 3, 5).collect()
    assert len(grid) == 15 and all(r["n_bytes"] == 0 and r["n_records"] == 0 for r in grid)


def test_null_and_negative_keys(spark):
    df = pairs(spark, [(None, 1), (None, 2), (-1, 3), (-6, 4)])
    assert {(r[0], r[1]) for r in df.select("key", partitioning.modulo(F.col("key"), 5)).collect()} == {(None, 0), (-1, 4), (-6, 4)}
    assert {tuple(r) for r in combining.combine(df, "key", "value", ["sum"]).collect()} == {(None, 3), (-1, 3), (-6, 4)}


def test_range_reads_partition_the_whole(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    ex = register(spark, 5).write(df, F.col("key") % 5, F.col("key") % 7)
    assert sorted(r["key"] for s in range(5) for r in ex.read(s, s + 1).collect()) == list(range(1000))
    assert sorted(r["key"] for s in range(7) for r in ex.read(2, 4, s, s + 1).collect()) == [i for i in range(1000) if 2 <= i % 5 < 4]
    plan = ex.read(1, 3, 0, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(reduce_id" in plan and "LessThan(map_id,2)" in plan.split("PushedFilters")[1][:300]
    assert ex.unregister() and not ex.unregister()
    with pytest.raises(ValueError):
        register(spark, 0)


def test_fetch_plan_golden(spark):
    blocks = spark.createDataFrame([(m, 10, 15_360) for m in range(42)], "map_id long, reduce_id long, len long")
    plan = fetch_plan(blocks, 10_240, 20_480).collect()
    assert len(plan) == 63 and len({r["req"] for r in plan}) == 32 and sum(r["n"] for r in plan) == 42 * 15_360
    assert sorted((r["m"], r["n"]) for r in plan if r["req"] == 1) == [(0, 5_120), (1, 15_360)]


def test_fetch_plan_never_mixes_reduce_ids(spark):
    blocks = spark.createDataFrame([(0, 0, 100), (1, 0, 0), (0, 1, 100)], "map_id long, reduce_id long, len long")
    assert {(r["r"], r["m"], r["req"], r["off"], r["n"]) for r in fetch_plan(blocks, 1000, 1000).collect()} == {(0, 0, 0, 0, 100), (1, 0, 0, 0, 100)}


def test_sample_schedule_golden():
    due = sample_schedule(70)
    assert due[:11] == list(range(1, 12)) and due[11:] == [13, 15, 17, 19, 21, 24, 27, 30, 33, 37, 41, 46, 51, 57, 63, 70]


def test_size_code_bounds(spark):
    rows = spark.range(2, 101).select(F.col("id").alias("n"), decoded_size(size_code(F.col("id"))).alias("d")).collect()
    assert all(r["n"] - 1 <= r["d"] <= 1.1 * r["n"] for r in rows)
    assert spark.range(1).select(size_code(F.lit(0)), decoded_size(size_code(F.lit(0)))).first()[:] == (0, 0)


def test_flush_policies(spark):
    df = spark.createDataFrame([(1, i, 40) for i in range(6)] + [(2, 0, 500), (2, 1, 1)], "p long, i long, size long")
    got = {(r["p"], r["i"]): r["round"] for r in flush_rounds(df, "p", "i", "size", 100).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1, (1, 5): 1, (2, 0): 0, (2, 1): 1}
    df = spark.createDataFrame([(0, 0, 1, 50), (0, 1, 2, 30), (0, 2, 2, 10), (0, 3, 1, 5)], "t long, i long, p long, size long")
    assert [tuple(r) for r in largest_first(df, "t", "i", "p", "size", 100).collect()] == [(0, 0, 1, 50), (0, 1, 2, 40), (0, 2, 1, 5)]
    df = spark.createDataFrame([(0, 0, 1, 60), (0, 1, 1, 60), (0, 2, 2, 1)], "t long, i long, p long, size long")  # the largest grows past the valve unseen
    assert [tuple(r) for r in largest_first(df, "t", "i", "p", "size", 100).collect()] == [(0, 0, 1, 120), (0, 1, 2, 1)]


def test_faults_are_found(spark):
    listed = spark.createDataFrame([(0, 0, 100, 7), (1, 0, 100, 8), (2, 0, 100, 9)], "map_id long, reduce_id long, n_bytes long, checksum long")
    found = spark.createDataFrame([(0, 0, 95, 7), (1, 0, 50, 1), (9, 0, 10, 0)], "map_id long, reduce_id long, n_bytes long, checksum long")
    assert {r["map_id"] for r in integrity.short_blocks(found, listed).collect()} == {1, 2}
    assert {(r["map_id"], r["problem"]) for r in integrity.unmatched_blocks(found, listed).collect()} == {(2, "missing"), (9, "unlisted")}
    assert {r["map_id"] for r in integrity.corrupt_blocks(found, listed).collect()} == {1}
    assert integrity.duplicate_blocks(listed.unionByName(listed.where("map_id = 1"))).first()["n"] == 2
    tries = spark.createDataFrame([(0, 0, True), (0, 1, True), (0, 2, False), (1, 0, False)], "map_id long, attempt int, committed boolean")
    assert [tuple(r) for r in integrity.committed(tries).collect()] == [(0, 1, True)]


def test_combining_early_equals_combining_late(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("key"), (F.col("id") % 3).alias("m"), F.col("id").alias("value"))
    names = list(combining.COMBINERS)
    early = combining.merge_runs(combining.partial_runs(df, ["m", "key"], "value", names), "key", names)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, combining.combine(df, "key", "value", names).collect()))
    salted = partitioning.salted_totals(df, "key", {"n": ("count", "value"), "s": ("sum", "value")})
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, combining.combine(df, "key", "value", ["count", "sum"]).collect()))
    sides = combining.cogroup(pairs(spark, [(1, 2), (1, 1)]), pairs(spark, [(2, 5)]), "key", "value", "value")
    assert {(r[0], tuple(r[1]), tuple(r[2])) for r in sides.collect()} == {(1, (1, 2), ()), (2, (), (5,))}


def test_orders(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.lit(1).alias("key"))
    got = ordering.globally_ranked(df, F.col("x")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [r["x"] for r in got] == sorted(r["x"] for r in got)
    parts = ordering.sort_in_partitions(df, "key", "x").withColumn("p", F.spark_partition_id()).collect()
    assert len({r["p"] for r in parts}) == 1 and [r["x"] for r in parts] == sorted(r["x"] for r in parts)


def test_physical_plans(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan(partitioning.by_hash(df, "k", n=4))
    assert "rangepartitioning(k" in plan(partitioning.by_range(df, "k", n=4))
    assert "SinglePartition" in plan(partitioning.to_one(df))
    assert "RoundRobinPartitioning" in plan(partitioning.round_robin(df, 4))
    assert "partial_sum" in plan(combining.combine(df, "k", "id", ["sum"]))


def test_single_exchange_is_read_in_bounded_parts(spark, tmp_path):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.files.maxPartitionBytes": "100k", "spark.sql.files.openCostInBytes": "100k"}
    source, before, most = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), {k: spark.conf.get(k) for k in small}, {}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        for copies in (2, 8):
            many = source.crossJoin(spark.range(copies)).withColumn("l_orderkey", F.col("l_orderkey") + 1500 * F.col("id")).drop("id")
            many.repartition(copies).write.parquet(f"{tmp_path}/{copies}/lineitem.parquet")
            table, got = spark.read.parquet(f"{tmp_path}/{copies}/lineitem.parquet"), catalogue.exchange_single(spark, f"{tmp_path}/{copies}")
            assert got.columns == table.columns and table.count() == got.count() == copies * source.count() and got.exceptAll(table).isEmpty()
            parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*got.columns))).collect()
            most[copies] = max(r["n"] for r in parts)
            total = got.agg(F.count("*"), F.bit_xor(F.xxhash64(*got.columns)))  # a total of all rows keeps the parts
            assert total.collect() == table.agg(F.count("*"), F.bit_xor(F.xxhash64(*got.columns))).collect()
            assert "AQEShuffleRead" in total._jdf.queryExecution().executedPlan().toString()
            numbers = got.select(F.row_number().over(Window.orderBy(*got.columns)).alias("n"))  # a window over all rows meets all of them
            assert numbers.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (1, table.count(), table.count())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most[8] <= 1.5 * most[2] < 3 * source.count()


def test_single_exchange_without_adaptive_execution_still_moves_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = partitioning.one_reduce(spark.range(0, 1000, 1, 4))
        assert "SinglePartition" in got._jdf.queryExecution().executedPlan().toString()
        assert [(r[0], r[1]) for r in got.groupBy(F.spark_partition_id()).count().collect()] == [(0, 1000)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_session_refuses_the_old_protocol():
    with pytest.raises(ValueError):
        session(**{"spark.shuffle.useOldFetchProtocol": "true"})


def test_streams_equal_batches(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    folder = tmp_path / "events"
    batch.repartition(2).write.parquet(str(folder))
    stream = spark.readStream.schema(batch.schema).parquet(str(folder))
    for i, f in enumerate((lambda d: tumbling_counts(d, watermark="1 day"), lambda d: session_counts(d, watermark="1 day"))):
        q = f(stream).writeStream.format("memory").queryName(f"out{i}").outputMode("complete" if not i else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, want = {tuple(r) for r in spark.table(f"out{i}").collect()}, {tuple(r) for r in f(batch).collect()}
        assert got == want if not i else got <= want and got


@pytest.mark.parametrize("maps,n", [(6, 10), (4, 7168), (6, 7168)])
def test_reader_fixtures(spark, maps, n):
    """Key i, value 2i for i below n from each map, all in reduce partition 15 of 16."""
    df = spark.range(maps * n).select((F.col("id") % n).cast("int").alias("key"), (F.col("id") % n * 2).cast("int").alias("value"), F.floor(F.col("id") / n).alias("m"))
    ex = register(spark, 16).write(df.select("key", "value", "m"), F.lit(15), F.col("m"))
    assert ex.read(15, 16).count() == maps * n and ex.read(0, 15).count() == 0
    m = ex.metrics("reduce_id").collect()
    assert [(r["reduce_id"], r["records"], r["blocks"]) for r in m] == [(15, maps * n, maps)]
    assert len({r["n_bytes"] for r in ex.manifest().collect()}) == 1 and ex.problems().count() == 0


def test_named_exchanges_are_shared(spark):
    a, b = register(spark, 5, "shared"), register(spark, 5, "shared")
    assert a.path == b.path
    with pytest.raises(ValueError):
        register(spark, 6, "shared")
    assert register(spark, 5, "shared").unregister() and not b.exists()


def test_a_rank_moves_rows_once(spark):
    plan = ordering.globally_ranked(spark.range(100).toDF("x"), F.col("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the one for counts
