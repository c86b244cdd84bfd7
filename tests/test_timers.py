"""State that ends: flags, stored results and leases."""

import random
import time

from vitrine.streaming import intake, state, timers


def grown(spark, tmp_path, schema):
    """(add rows as a file, the folder as a stream)."""
    folder = f"{tmp_path}/in"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    return add, lambda: spark.readStream.schema(schema).parquet(folder)


def state_rows(spark, tmp_path, name, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{tmp_path}/out/{name}-checkpoint").collect()


def test_flags_run_out_and_are_cleared(spark, tmp_path):
    rnd = random.Random(1)
    add, stream = grown(spark, tmp_path, "key string, at long")
    rows = [(rnd.choice("abc"), rnd.randrange(20_000)) for _ in range(300)]
    add(rows)
    run = lambda: timers.worked_through(timers.requests_once(stream()), "once", f"{tmp_path}/out")
    found = run().collect()
    plain = intake.available_now(state.deduplicated_requests(stream()), "plain", "append", f"{tmp_path}/plain")
    assert sorted(map(tuple, found)) == sorted(map(tuple, plain.collect()))
    assert {r.key["key"] for r in state_rows(spark, tmp_path, "once", "until")} == {"a", "b", "c"}
    add([("z", 1_000_000)])
    again = run()
    assert again.count() == len(found) + 1 and again.where("key = 'z'").count() == 1
    assert {r.key["key"] for r in state_rows(spark, tmp_path, "once", "until")} == {"z"}  # the watermark has passed the others
    add([("a", 1_000_001), ("z", 1_000_100), ("z", 1_000_720)])
    assert sorted(r["at"] for r in run().where("at >= 1000000").collect()) == [1_000_000, 1_000_001, 1_000_720]


def test_results_are_kept_for_a_while(spark, tmp_path):
    add, stream = grown(spark, tmp_path, "idempotency_key string, id long, result string")
    add([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")])
    run = lambda keep: timers.worked_through(timers.executed_once(stream(), keep), "ops", f"{tmp_path}/out", timers=False)
    key = lambda r: (r["idempotency_key"], r["id"], r["repeated"])
    assert sorted(map(key, run(3_600_000).collect())) == [("a", 1, False), ("a", 1, True), ("b", 3, False)]
    add([("a", 4, "w")])
    assert sorted(map(key, run(3_600_000).collect())) == [("a", 1, False), ("a", 1, True), ("a", 1, True), ("b", 3, False)]


def test_results_that_ran_out_are_made_again(spark, tmp_path):
    add, stream = grown(spark, tmp_path, "idempotency_key string, id long, result string")
    run = lambda: timers.worked_through(timers.executed_once(stream(), 1_000), "ops", f"{tmp_path}/out", timers=False)
    add([("a", 1, "x")])
    run()
    time.sleep(1.5)
    add([("a", 2, "y"), ("b", 3, "z")])
    assert sorted((r["id"], r["repeated"]) for r in run().collect()) == [(1, False), (2, False), (3, False)]
    time.sleep(1.5)
    add([("c", 4, "v")])
    run()
    assert {r.key["idempotency_key"] for r in state_rows(spark, tmp_path, "ops", "result")} == {"c"}


def brute_leases(jobs, expires):
    out, end = [], {}
    for key, id_, at, seconds in sorted(jobs, key=lambda j: (j[2], j[1])):
        granted = max(at, end.get(key, at))
        end[key] = granted + min(seconds, expires)
        out.append((key, id_, at, granted, end[key], granted > at))
    return sorted(out)


def test_leases_by_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    jobs = sorted([(rnd.choice("abcd"), i, rnd.randrange(3_000), rnd.choice([0, 1, 5, 40, 90])) for i in range(400)], key=lambda j: j[2])
    add, stream = grown(spark, tmp_path, "key string, id long, at long, seconds long")
    run = lambda: timers.worked_through(timers.leases(stream(), 60), "leases", f"{tmp_path}/out")
    for part in (jobs[:150], jobs[150:300], jobs[300:]):
        add(part)
        run()
    waiting = 400 - run().count()
    assert waiting > 0 and sum(1 for _ in state_rows(spark, tmp_path, "leases", "line")) > 0
    add([("end", 1000, 10_000_000, 1)])
    found = sorted(tuple(r) for r in run().where("key <> 'end'").collect())
    assert found == brute_leases(jobs, 60) and any(r[5] for r in found)
    own = sorted((r[3], r[4]) for r in found if r[0] == "a")
    assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))  # never two at once
    assert {r.key["key"] for r in state_rows(spark, tmp_path, "leases", "until")} <= {"end"}


class _Calls:
    """A handle that counts the calls on the state."""

    def __init__(self):
        self.value, self.calls = None, []

    def __getattr__(self, name):
        return lambda *args: self.calls.append((name, *args))

    def getValueState(self, *_):  # noqa: N802  name of the interface
        return self

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value


def test_only_the_last_flag_of_a_batch_is_written():
    handle, flag = _Calls(), timers._Flag(720)
    flag.init(handle)
    rows = lambda *times: [r["at"] for r in flag.handleInputRows(("a",), [{"at": t} for t in times], None)]
    assert rows(5_000, 0, 100, 720, 1_439) == [0, 720, 5_000]
    assert handle.calls == [("registerTimer", 5_721_000)] and handle.value == (5_720,)
    assert rows(5_719) == [] and len(handle.calls) == 1
    assert rows(5_720, 7_000) == [5_720, 7_000]
    assert handle.calls[1:] == [("deleteTimer", 5_721_000), ("registerTimer", 7_721_000)]
