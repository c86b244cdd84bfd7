"""State machines: the streaming form gives the rows of the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalog, merge, usage
from vitrine.operators import selection as X
from vitrine.operators import windows as W
from vitrine.session import clear_shared, folder_exists, shared_dir
from vitrine.sources import readers, sinks
from vitrine.streaming import intake, state


def as_stream(spark, rows, path):
    rows.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def test_failure_streaks_batch_and_stream_agree(spark, tmp_path):
    rnd = random.Random(1)
    kinds = ["browser_timeout", "recipe_mismatch", "access_gate", "rate_limited", None]
    rows = spark.createDataFrame([(i, f"d{rnd.randrange(4)}", i, rnd.choice(kinds)) for i in range(200)], "id long, domain string, at long, kind string")
    batch = {tuple(r) for r in W.failure_streaks(rows, "domain", ["at", "id"]).select("domain", "id", "kind", "failure_count", "disabled", "retry_minutes").collect()}
    stream = {tuple(r) for r in intake.available_now(state.failing_sources(as_stream(spark, rows, f"{tmp_path}/f")), "t_failures", "append").collect()}
    assert batch == stream and any(r[4] for r in batch)


def test_queue_alerts_batch_and_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame([("q", 0, None), ("q", 200, 0), ("q", 500, 0), ("q", 1101, 0), ("q", 1102, None), ("q", 1400, 1150), ("r", 30, 20)], "queue string, at long, oldest_waiting long")
    batch = sorted(tuple(r) for r in W.queue_alerts(rows, "queue").collect())
    stream = sorted(tuple(r) for r in intake.available_now(state.stuck_queues(as_stream(spark, rows, f"{tmp_path}/q")), "t_queues", "append").collect())
    assert batch == stream == [("q", 200), ("q", 1101), ("q", 1400)]


def test_operations_run_once_and_edits_are_throttled(spark, tmp_path):
    ops = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "idempotency_key string, id long, result string")
    done = intake.available_now(state.executed_once(as_stream(spark, ops, f"{tmp_path}/o")), "t_ops", "append")
    assert sorted(tuple(r) for r in done.collect()) == [("a", 1, "x", False), ("a", 1, "x", True), ("b", 3, "z", False)]
    edits = spark.createDataFrame([(1, 0.0, False), (1, 0.5, False), (1, 1.3, False), (1, 1.4, True)], "message_id long, at double, final boolean")
    shown = intake.available_now(state.throttled(as_stream(spark, edits, f"{tmp_path}/e")), "t_edits", "append")
    assert sorted(r["at"] for r in shown.collect()) == [0.0, 1.3, 1.4]
    chats = spark.createDataFrame([("c", 1, "m"), ("c", 2, "m"), ("c", 3, "n")], "chat_id string, id long, model string")
    turns = intake.available_now(state.conversation_models(as_stream(spark, chats, f"{tmp_path}/c")), "t_chats", "append")
    assert sorted((r["id"], r["turn"]) for r in turns.collect()) == [(1, 1), (2, 2), (3, 1)]
    asks = spark.createDataFrame([("k", 0), ("k", 100), ("k", 720)], "key string, at long")
    assert sorted(r["at"] for r in intake.available_now(state.deduplicated_requests(as_stream(spark, asks, f"{tmp_path}/r")), "t_asks", "append").collect()) == [0, 720]


def test_queue_split_is_idempotent(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "voice"), (2, "odd")], "id long, queue string")
    write = sinks.queue_split(f"{tmp_path}/queues", ["assistant", "voice", "media"])
    write(jobs, 0)
    write(jobs, 0)
    assert sorted((r["id"], r["queue"]) for r in spark.read.parquet(f"{tmp_path}/queues").collect()) == [(1, "voice"), (2, "default")]


def test_fan_out_and_scripts(spark):
    rows = readers.fan_out(spark, ["a", "b", "bad"], lambda r: {"a": "1", "b": "2"}[r]).collect()
    assert sorted((r["request"], r["body"]) for r in rows if r["error"] is None) == [("a", "1"), ("b", "2")] and len(rows) == 3
    tasks = spark.createDataFrame([('{"x":1}',), ("oops",)], "payload string")
    done = {r["payload"]: r for r in readers.from_script(tasks, ["cat"]).collect()}
    assert done['{"x":1}']["output"] == '{"x":1}' and done["oops"]["error"] == "JSONDecodeError"


def test_search_results_and_greedy_duplicates(spark):
    body = '{"query":{"pages":{"1":{"title":"File:A.jpg","index":2,"imageinfo":[{"url":"u","mime":"image/jpeg","width":900,"height":800}]}}}}'
    assert tuple(readers.search_results(spark.createDataFrame([(body,)], "body string")).first()) == ("File:A.jpg", "u", "image/jpeg", 900, 800, 2)
    images = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 3), (1, 2, 0, 2**20 - 1), (1, 3, 2**31, 2**32 - 1)], "owner int, pos int, high long, low long")
    assert sorted(r["pos"] for r in X.without_near_duplicates(images, "owner").collect()) == [0, 2, 3]
    banned = spark.createDataFrame([(1, 0, 1)], "owner int, high long, low long")
    assert sorted(r["pos"] for r in X.without_near_duplicates(images, "owner", banned).collect()) == [2, 3]
    assert F is not None


def test_polled_values_are_kept_when_they_change(spark, tmp_path):
    source, schema = f"{tmp_path}/asked", "name string, value string, at long"
    ask = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def poll():
        intake.polled(spark.readStream.schema(schema).parquet(source), str(tmp_path), "tunnel", interval=None).awaitTermination()
        return sorted((r["name"], str(r["value"]), r["at"]) for r in spark.read.parquet(f"{tmp_path}/tunnel").collect())

    ask([("a", "x", 1), ("a", "x", 2), ("b", None, 1)])
    assert poll() == [("a", "x", 1), ("b", "None", 1)]
    ask([("a", "x", 3), ("a", "y", 4), ("b", None, 3), ("c", "z", 3)])
    changed = [("a", "x", 1), ("a", "y", 4), ("b", "None", 1), ("c", "z", 3)]
    assert poll() == changed and poll() == changed
    ask([("a", "x", 5), ("b", "w", 5)])
    assert poll() == sorted([*changed, ("a", "x", 5), ("b", "w", 5)])


def test_streams_go_on_where_they_ended(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, idempotency_key string")
    updates = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    count = lambda: intake.available_now(updates().groupBy("idempotency_key").count(), "n", "complete", f"{tmp_path}/out").collect()
    rows.write.parquet(f"{tmp_path}/in")
    assert [tuple(r) for r in count()] == [("a", 1)]
    rows.write.mode("append").parquet(f"{tmp_path}/in")
    assert [tuple(r) for r in count()] == [("a", 2)]
    assert intake.available_now(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/none*"), "e", "append", f"{tmp_path}/e").count() == 0


def passed(times, cooldown):
    out = []
    for t in sorted(set(times)):
        if not out or t >= out[-1] + cooldown:
            out.append(t)
    return out


@pytest.mark.parametrize("in_array", [0, 200, 10_000])
def test_cooldown_by_brute_force(spark, monkeypatch, in_array):
    """Keys with many times, few, one and none; a null key; repeated times; gaps of many cells and blocks of cells."""
    rnd = random.Random(3)
    monkeypatch.setattr(W, "CELLS", 4)
    monkeypatch.setattr(W, "IN_ARRAY", in_array)
    events = [("a", float(t)) for t in rnd.sample(range(10_000), 400)] + [("b", t / 8) for t in rnd.sample(range(2_000), 300)] + [("c", 5.0)] * 3 + [(None, float(x)) for x in (-90, -53, 0, 36, 37, 5_000_000)] + [("d", None), ("a", None)]
    found = W.with_cooldown(spark.createDataFrame(events, "k string, at double"), "k", "at", 37)
    want = [(k, t) for k in ("a", "b", "c", None) for t in passed([t for x, t in events if x == k and t is not None], 37)]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key) and found.columns == ["k", "seconds"]
    every = W.with_cooldown(spark.createDataFrame(events, "k string, at double"), "k", "at", 0)
    assert every.count() == len({e for e in events if e[1] is not None})
    assert W.with_cooldown(spark.createDataFrame([], "k string, at double"), "k", "at", 37).collect() == []


def test_cooldown_of_one_key_spreads_over_tasks(spark, monkeypatch):
    rnd = random.Random(4)
    times = [rnd.randrange(400_000) / 4 for _ in range(20_000)]
    events = spark.createDataFrame([("k", t) for t in times], "k string, at double").repartition(4)
    assert sorted(r.seconds for r in W.with_cooldown(events, "k", "at", 10).collect()) == passed(times, 10)
    monkeypatch.setattr(W, "CELLS", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pointers = W.cooldown_pointers(spark.range(0, 4000, numPartitions=4).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("t")), 10)
    sizes = [r["count"] for r in pointers.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 3990 and max(sizes) < 2000


def test_running_totals_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), i * 3, rnd.randrange(2)) for i in range(500)]
    found = W.running_total(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", F.col("v"), "total", F.floor(F.col("at") / 50))
    assert {r["at"]: r["total"] for r in found.collect()} == {at: sum(v for k, t, v in rows if k == key and t <= at) for key, at, _ in rows}


def test_numbers_in_order_by_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, *range(40)]), "x") for i in range(3_000)]
    found = W.numbered_in_order(spark.createDataFrame(rows, "id long, v int, rank string").repartition(5), [F.desc_nulls_last("v"), F.col("id")], "n").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.id: r.n for r in found} == {r[0]: n for n, r in enumerate(want, 1)} and len(found) == 3_000 and found[0].rank == "x"
    assert W.numbered_in_order(spark.createDataFrame([], "id long"), [F.col("id")]).columns == ["id", "rank"]


def test_batches_jobs_reports_and_rejections(spark, tmp_path):
    rows = spark.createDataFrame([(1, "voice", 0, None, 5, 5), (2, "media", 0, None, 5, 5)], "id long, queue string, attempts int, reserved_at long, available_at long, created_at long")
    for batch in (0, 0, 1):
        sinks.append_batch(rows, f"{tmp_path}/batches", batch)
    assert spark.read.parquet(f"{tmp_path}/batches").count() == 4
    rows.write.parquet(f"{tmp_path}/jobs")
    voice = readers.queued_jobs(spark, f"{tmp_path}/jobs").where("queue = 'voice'")
    assert [r["id"] for r in intake.available_now(voice, "voice", "append", f"{tmp_path}/v").collect()] == [1]
    models = spark.createDataFrame([("p", "a", True), ("p", "b", True), ("q", "a", False)], "provider string, model string, is_available boolean")
    assert tuple(usage.sync_report(models).first()) == (2, 1)
    drafts = spark.createDataFrame([(1, "pending_review"), (2, "approved"), (3, "pending_review")], "id long, status string")
    done = merge.rejected(drafts, spark.createDataFrame([(1,), (2,)], "id long"))
    assert sorted(map(tuple, done.collect())) == [(1, "rejected"), (2, "approved"), (3, "pending_review")]


def test_two_trees_in_one_session(spark):
    nodes = lambda name: spark.createDataFrame([(1, None, name), (2, 1, "leaf")], "id long, parent_id long, name string")
    one, two = catalog.tree_depths(spark, nodes("one")), catalog.tree_depths(spark, nodes("two"))
    assert sorted(r["path"] for r in one.collect()) == ["one", "one / leaf"] and sorted(r["path"] for r in two.collect()) == ["two", "two / leaf"]


def test_shared_folders_are_cleared(spark):
    folder = shared_dir(spark)
    spark.range(3).write.parquet(f"{folder}/t")
    assert folder_exists(spark, folder) and clear_shared(spark) >= 1 and not folder_exists(spark, folder) and clear_shared(spark) == 0


def test_the_first_operation_is_found_without_sorting():
    import pandas as pd

    frame = lambda *rows: pd.DataFrame(rows, columns=["id", "result"])
    assert state._first_of(iter([frame((5, "e"), (3, "c"), (3, "d")), frame(), frame((3, "x"), (9, "y"))])) == ((3, "c"), 5)
    assert state._first_of(iter([frame((5, "e")), frame((1, "a"))])) == ((1, "a"), 2) and state._first_of(iter([frame()])) == (None, 0)
