"""Requests in bulk, seed rows and programs that answer lines."""

import json
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from vitrine.operators import requests as Q
from vitrine.sources import readers


def judged(spark, *requests):
    rows = Q.judged(spark.createDataFrame([(i, r) for i, r in enumerate(requests)], "id int, parameters map<string,array<string>>")).orderBy("id").collect()
    return [(r.errors, r.echo, r.link) for r in rows]


def test_rules_of_requests(spark):
    none = [None]
    cases = {
        "search": (["x" * 120], ["x" * 121]), "category": (["c" * 80], ["c" * 81]), "brands": (["b"] * 50, ["b"] * 51), "types": (["t"] * 20, ["t"] * 21), "colors": (["c" * 80], ["c", "c" * 81]), "attributes.ram": (["8 GB"] * 50, ["8 GB"] * 51),
        "min_price": (["1e3"], ["1,5"]), "max_price": ([" .5 "], ["-0.01"]), "sort": (["price_desc"], ["Newest"]), "page": (["7"], ["0"]), "per_page": (["50"], ["51"]), "unknown": (["anything"], none),
    }
    good = judged(spark, *[{k: v} for k, (v, _) in cases.items()])
    assert all(e == [] and shown is not None for e, shown, _ in good)
    bad = judged(spark, *[{k: v} for k, (_, v) in cases.items() if v is not none])
    assert all(len(e) == 1 and shown is None for e, shown, _ in bad), bad
    many = {f"attributes.k{i}": ["v"] for i in range(31)}
    assert judged(spark, many)[0][0] == ["attributes: more than 30"]
    assert judged(spark, {"page": ["x"], "per_page": ["1.5"], "min_price": ["abc"], "sort": ["best"]})[0][0] == ["min_price: not a number", "sort: unknown", "page: not a whole number", "per_page: not a whole number"]


def test_echo_and_link_of_requests(spark):
    given = {"search": [" red ring "], "brands": ["A&B", "", None], "colors": [], "types": None, "min_price": ["0"], "sort": ["newest"], "page": ["2"], "per_page": ["12"], "attributes.ram": ["8 GB"]}
    (errors, shown, link), (none, empty, bare), (nothing, plain, blank) = judged(spark, given, {}, {"search": [""], "page": [" "]})
    assert errors == none == nothing == [] and empty == plain and bare == blank == ""
    assert (shown.search, shown.brands, shown.colors, shown.min_price, shown.sort, shown.page, shown.per_page) == ("red ring", ["A&B"], [], "0", "newest", 2, 12) and (empty.search, empty.page, empty.sort, empty.brands) == ("", 1, "newest", [])
    assert link == "attributes.ram[]=8+GB&brands[]=A%26B&min_price=0&page=2&search=red+ring"
    assert Q.judged(spark.createDataFrame([(1, None)], "id int, parameters map<string,array<string>>")).count() == 1


def test_seed_rows(spark):
    rows = readers.literal_rows(spark, "slug string, parent string", ("laptops", None), ("mice", "other"))
    assert [tuple(r) for r in rows.orderBy("slug").collect()] == [("laptops", None), ("mice", "other")]


PROGRAM = """
import json, os, sys, time
n = 0
for line in sys.stdin:
    task = json.loads(line)
    n += 1
    if task.get("do") == "hang": time.sleep(60)
    if task.get("do") == "die": os._exit(3)
    if task.get("do") == "babble":
        print("not json", flush=True)
        continue
    print(json.dumps({"id": task["id"], "n": n, "pid": os.getpid(), "size": len(task.get("text", ""))}), flush=True)
"""


def test_a_program_answers_lines_and_is_restarted(spark):
    tasks = [json.dumps({"id": i}) for i in range(6)]
    tasks[2] = json.dumps({"id": 2, "do": "hang"})
    tasks[4] = json.dumps({"id": 4, "do": "die"})
    tasks += [json.dumps({"id": 6, "do": "babble"}), json.dumps({"id": 7, "text": "x\\n" * 400_000}), "no json", None, '{\n "id": 10\n}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tasks)], "i int, payload string").coalesce(1).sortWithinPartitions("i")
    found = readers.from_program(rows, [sys.executable, "-c", PROGRAM], timeout=5).collect()
    assert [r.error for r in found] == [None, None, "timeout", None, "ended", None, "answer is not JSON", None, "payload is not JSON", "payload is not JSON", None]
    answers = {a["id"]: a for a in (json.loads(r.output) for r in found if r.output)}
    assert sorted(answers) == [0, 1, 3, 5, 7, 10] and answers[7]["size"] == 1_200_000
    assert [answers[i]["n"] for i in (0, 1, 3, 5, 7, 10)] == [1, 2, 1, 1, 1, 2]  # started anew after each failure only
    assert len({a["pid"] for a in answers.values()}) == 4
    gone = readers.from_program(rows.limit(1), ["/no/such/program"]).collect()
    assert gone[0].output is None and gone[0].error == "FileNotFoundError"
    assert readers.from_program(rows.where(F.lit(False)), ["/no/such/program"]).collect() == []


def test_payloads_are_answered_in_slices(spark):
    rows = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 30, "z", "z", ""])], ["payload"])
    assert [s.num_rows for s in readers._slices(rows, 12)] == [2, 1, 3] and [s.num_rows for s in readers._slices(rows)] == [6]
    assert [s.num_rows for s in readers._slices(rows.slice(2), 1)] == [1, 1, 2] and list(readers._slices(rows.slice(6))) == []
    plan = readers.from_program(spark.createDataFrame([("{}",)], "payload string"), ["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
