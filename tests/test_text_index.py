"""The gram index against plain substring search."""

import random

import pyarrow as pa

from vitrine.operators import text_index
from vitrine.operators.text_index import TextIndex


def brute(rows, term):
    return {o for o, t in rows if o is not None and t is not None and term.lower() in t.lower()}


def found(index, term):
    return sorted(r.owner for r in index.containing(term).collect())


def test_search_by_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.randrange(9_000), "".join(rnd.choice("abAé😀 _%\\n1") for _ in range(rnd.randrange(12)))) for _ in range(400)] + [(None, "abc"), (5, None), (6, ""), (7, "x" * 5_000 + "needle")] * 2
    index = TextIndex(spark, f"{tmp_path}/i", folders=8).add(spark.createDataFrame(rows, "owner long, text string"))
    terms = ["", "a", "É", "ab", "😀", "😀 ", "a%_", "abab", "NEEDLE", "xxxxxx", "zz", "no such term", "1\n", "\\"] + [t[2:6] for _, t in rows[:12]]
    for term in terms:
        assert found(index, term) == sorted(brute(rows, term)), term
    assert {r.owner for r in index.with_all(["a", "b", "1"]).collect()} == brute(rows, "a") & brute(rows, "b") & brute(rows, "1")
    assert {r.owner for r in index.with_all([]).collect()} == {o for o, t in rows if o is not None and t is not None}


def test_batches_add_up_and_replace_themselves(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", folders=4)
    first = spark.createDataFrame([(1, "red ring"), (2, "blue ring")], "owner long, text string")
    index.add(first, "1").add(spark.createDataFrame([(1, "gold bolt"), (3, "ring")], "owner long, text string"), "2")
    for _ in range(2):
        assert found(index, "ring") == [1, 2, 3] and found(index, "gold") == [1] and found(index, "red") == [1]
        index.add(first, "1")
    index.add(first.where("owner = 1"), "1")
    assert found(index, "ring") == [1, 3]


def test_only_folders_of_candidates_are_read(spark, tmp_path):
    rows = spark.range(3_000).selectExpr("id AS owner", "concat('item number ', id, CASE WHEN id % 1000 = 7 THEN ' zyx' ELSE '' END) AS text")
    index = TextIndex(spark, f"{tmp_path}/i", folders=32).add(rows)
    candidates = index.candidates("zyx")
    assert sorted(r.owner for r in candidates.collect()) == [7, 1007, 2007]
    assert found(index, "zyx") == [7, 1007, 2007]
    read = spark.createDataFrame([(7,), (1007,)], "owner long")
    scan = index.texts_of(read)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in scan and "IN (7,15)" in scan
    postings = index._postings(["zyx"])
    scan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PushedFilters: [IsNotNull(gram), EqualTo(gram,zyx)]" in scan and postings.select("folder").distinct().count() == 1
    assert max(r[0] for r in spark.read.parquet(f"{tmp_path}/i/postings").selectExpr("size(owners)").collect()) <= 4096


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i").add(spark.createDataFrame([], "owner long, text string"))
    assert found(index, "abc") == found(index, "a") == found(index, "") == []


def test_grams_are_gathered_in_pieces(spark, tmp_path, monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(chr(rnd.choice([97, 98, 0x20AC, 0x1F600, 0xC0])) for _ in range(rnd.randrange(9))) for _ in range(500)] + ["ab" * 3_000]
    owners = sorted(rnd.choice([-5_000, -1, 0, 4_095, 4_096, 1 << 60]) + rnd.randrange(3) for _ in texts)
    wanted = {(g, o) for o, t in zip(owners, texts) for n in (1, 2, 3) for g in (t[i : i + n] for i in range(len(t) - n + 1))}
    rows = pa.RecordBatch.from_arrays([pa.array(owners), pa.array(texts)], ["owner", "text"])
    for most in (1, 64, 1 << 20):
        monkeypatch.setattr(text_index, "SIGNS", most)
        posted = [r for b in text_index._posted(iter([rows.slice(0, 100), rows.slice(100)])) for r in b.to_pylist()]
        assert {(r["gram"], r["block"] * 4096 + p) for r in posted for p in r["owners"]} == wanted
        assert all(r["owners"] == sorted(set(r["owners"])) and 0 <= r["owners"][0] and r["owners"][-1] < 4096 for r in posted)


def test_lines_of_variants_are_told_apart_first(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    products = of([(1, "T", "M", "D", 7, 3)], "id long, title string, model string, description string, brand_id long, category_id long")
    variants = of([(i, 1, "plain", "red", f"s{i}", None, None) for i in range(40)], "id long, product_id long, name string, color string, sku string, mpn string, gtin string")
    values = of([(1, None, i, "8 GB") for i in range(40)] + [(2, 1, None, "9")], "attribute_definition_id long, product_id long, product_variant_id long, value string")
    lines = text_index.chat_lines(products, of([(7, "B")], "id long, name string"), of([(3, "C")], "id long, name string"), variants, values, of([(1, "ram", "Memory"), (2, "size", "Size")], "id long, key string, label string"))
    found = [r.text for r in lines.where("text IS NOT NULL").collect()]
    assert set(found) == {"T", "M", "D", "B", "C", "plain", "red", "8 GB", "9", "ram", "Memory", "size", "Size"} | {f"s{i}" for i in range(40)}
    assert [found.count(w) for w in ("plain", "red", "ram", "Memory")] == [1, 1, 1, 1]


def test_a_gram_is_found_without_the_texts(spark, tmp_path):
    index = text_index.TextIndex(spark, f"{tmp_path}/i", folders=4).add(spark.createDataFrame([(1, "abc"), (2, "bcd")], "owner long, text string"))
    assert "texts/" not in index.containing("BC")._jdf.queryExecution().executedPlan().toString() and found(index, "BC") == [1, 2]


def test_an_owner_has_its_lines_in_one_text(spark, tmp_path):
    rows = [(o, f"SKU-{o * k} Ring") for o in range(50) for k in range(40)] * 2 + [(60, "ΟΔΟΣ"), (60, "ΑΒ"), (61, "x\0y"), (61, "z"), (62, "x"), (62, "y"), (63, None), (64, "")]
    index = text_index.TextIndex(spark, f"{tmp_path}/i", folders=4).add(spark.createDataFrame(rows, "owner long, text string"))
    kept = spark.read.parquet(f"{tmp_path}/i/texts").groupBy().agg({"*": "count", "lines": "sum"}).first()
    assert kept[0] < 100 and kept[1] == len({r for r in rows if r[1] is not None})  # a row for an owner and a slice, not for a line
    for term in ("sku-1521 ring", "ΟΔΟΣ", "ΣΑ", "Σ\0Α", "ring\0sku-", "x\0y", "yz", "\0", "z", "x", "", "ngsku"):
        assert found(index, term) == sorted(brute(rows, term)), term
    lines = index.texts_of(spark.createDataFrame([(61,), (62,), (64,)], "owner long"))
    assert sorted(map(tuple, lines.collect())) == [(61, "x\0y"), (61, "z"), (62, "x"), (62, "y"), (64, "")]


def test_several_texts_a_row_in_small_slices(monkeypatch):
    rnd = random.Random(3)
    texts = [[rnd.choice(["a", "b", "é\0", "", None, "a b"]) for _ in range(rnd.randrange(1, 5))] for _ in range(300)]
    owners = sorted(rnd.randrange(-9, 9) for _ in texts)
    listed = [any("\0" in (t or "") for t in row) for row in texts]
    texts = [row if any(t is not None for t in row) else ["a"] for row in texts]
    rows = pa.RecordBatch.from_arrays([pa.array(owners), pa.array([None if x else "\0".join(t for t in row if t is not None) for x, row in zip(listed, texts)]), pa.array([row if x else [] for x, row in zip(listed, texts)], pa.list_(pa.string()))], ["owner", "text", "texts"])
    wanted = {(o, t) for o, row in zip(owners, texts) for t in row if t is not None}
    for most in (1, 1 << 20):
        monkeypatch.setattr(text_index, "LINES", most)
        packed = [r for b in text_index._packed(iter([rows.slice(i, 7) for i in range(0, 300, 7)])) for r in b.to_pylist()]
        assert {(r["owner"], t) for r in packed for t in (r["text"].split("\0") if r["lines"] > 1 else [r["text"]])} == wanted
        assert all(r["text"].count("\0") == r["lines"] - 1 for r in packed if r["lines"] > 1)
