"""Mixing, quality rules, licences and token counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.edge import no_documents, odd_documents
from vitrine.llm import licences, mixing, quality, token_counts


def corpus(spark, sizes):
    rnd = random.Random(5)
    rows, key = [], 0
    for source, (docs, most) in sizes.items():
        for _ in range(docs):
            rows.append((key, " ".join(["w"] * rnd.randrange(most)), source))
            key += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def filled(sizes, weights=(5, 2, 1)):
    """Targets by sharing and resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            out.update({s: level * w[s] for s in free})
            break
        out.update({s: 2.0 * sizes[s] for s in over})
        free -= over
    return out


def test_mix_reaches_its_targets(spark):
    docs = corpus(spark, {"a": (900, 80), "b": (300, 80), "c": (500, 80), None: (200, 80), "é": (40, 80)})
    plan = mixing.mix_plan(docs).cache()
    rows = plan.collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
    assert len(rows) == docs.count()
    for s, t in filled(size).items():
        assert math.isclose(target[s], t, rel_tol=1e-9) and abs(taken[s] - t) <= 80, (s, t, taken[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs).collect()))


def test_tree_keeps_quotas_and_even_shards(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 3), (2, 0), (3, 297)], "rank int, quota long")
    leaves = mixing.splitting_tree(quotas, 10, 7).collect()
    by_rank, by_shard = Counter(), Counter()
    for r in leaves:
        by_rank[r["rank"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
        assert r["quota"] >= 0
    assert dict(by_rank) == {0: 700, 1: 3, 2: 0, 3: 297} and set(by_shard) == set(range(10)) and max(by_shard.values()) - min(by_shard.values()) <= 4


def test_hypergeometric_mean_and_range(spark):
    u = (F.col("id") + 0.5) / 4000
    k = spark.range(4000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(100).cast("long"), F.lit(20).cast("long"), u).alias("k"))
    exact = {k: math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20) for k in range(21)}
    found = Counter(r["k"] for r in k.collect())
    for i, p in exact.items():
        assert abs(found[i] / 4000 - p) < 0.002


def test_mix_rows(spark):
    docs = corpus(spark, {"a": (50, 9), "b": (20, 9)})
    plan = {r["doc_id"]: r["shards"] for r in mixing.mix_plan(docs, shards=4).collect()}
    out = mixing.mixed(docs, shards=4)
    assert out.count() == sum(map(len, plan.values())) and set(out.columns) == {*docs.columns, "mix_copy", "mix_shard", "mix_order"}


@pytest.mark.parametrize("rows", [[(7, "w " * 10, "a")] * 400, [(None, "w " * (i % 20), "a") for i in range(400)], [(i % 3, "w " * 10, "ab"[i % 2]) for i in range(400)], [(i, None, None) for i in range(5)]])
def test_mix_of_repeated_rows_and_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    planned = mixing.mix_plan(docs).collect()
    assert len(planned) == len(rows) and all(r["taken"] == r["size"] * len(r["shards"]) for r in planned)
    taken, copies = sum(r["taken"] for r in planned), mixing.mixed(docs).collect()
    size = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(taken - 1.5 * size) <= 20 * len({s for *_, s in rows}) and sum(len((r["text"] or "").split()) for r in copies) == taken
    assert Counter((r["doc_id"], r["source"], r["text"], r["mix_shard"]) for r in copies) == Counter((r["doc_id"], r["source"], r["text"], r["mix_shard"]) for r in mixing.mixed(docs.repartition(2)).collect())


def test_mix_does_not_move_texts(spark, tmp_path):
    corpus(spark, {"a": (300, 30), "b": (90, 30)}).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    mix = mixing.mixed(docs, shards=4)
    mix.collect()
    assert "text" not in "".join(x for x in mix._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Broadcast" not in x)
    mixing.write_shards(mix, f"{tmp_path}/shards")
    shard = spark.read.parquet(f"{tmp_path}/shards/mix_shard=2").count()
    assert shard == mix.where("mix_shard = 2").count() > 0


def test_tree_of_many_sources(spark):
    quotas = spark.range(5000).select(F.col("id").cast("int").alias("rank"), (F.col("id") % 4).alias("quota"))
    leaves = mixing.splitting_tree(quotas, 4, 3)
    assert leaves.groupBy("rank").agg(F.sum("quota").alias("n")).where("n <> rank % 4").count() == 0
    assert {r["n"] for r in leaves.groupBy("shard").agg(F.sum("quota").alias("n")).collect()} == {1875}


def test_mix_odd_documents(spark):
    rows = {(r["doc_id"], r["size"]) for r in mixing.mix_plan(odd_documents(spark)).collect()}
    assert (4, 60_000) in rows and (1, 0) in rows and (None, 4) in rows
    assert mixing.mix_plan(no_documents(spark)).count() == 0 and mixing.mixed(no_documents(spark)).count() == 0


def test_base_metrics_by_brute_force(spark):
    rnd = random.Random(2)
    texts = ["\n".join(" ".join(rnd.choice("abcd#") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(8))) for _ in range(200)] + ["a b", "a b c a b c", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality.base_metrics(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = t.split()
        at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        lines = [x for x in t.split("\n") if x.strip()]
        covered = {i + j for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"], r["word_chars"]) == (len(w), len(covered), len(lines) - len(set(lines)), t.count("#"), len("".join(w)))


def test_sketch_buckets_and_merging(spark):
    rows = spark.range(5000).select(F.col("id").alias("v"), quality.bucket(F.col("id")).alias("b"))
    assert all(r["b"] <= r["v"] <= r["b"] * 17 / 16 + 1 for r in rows.collect())
    data = spark.range(3000).select((F.col("id") % 3).cast("string").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 1000).alias("x"))
    fine = quality.sketches(data, ["x"])
    assert sorted(map(tuple, quality.merge(fine).collect())) == sorted((r["ratio"], r["bucket"], r["n"]) for r in quality.sketches(data.withColumn("lang", F.lit("l")), ["x"]).collect())
    f = quality.fences(quality.merge(fine), [], 1).first()  # quartiles 250 and 750
    assert abs(f["upper"] - 1250) <= 100 and abs(f["lower"] + 250) <= 100


def test_verdicts(spark):
    clean, junk = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do ", "lo### ip$$$ do%%% si&&& am### co$$$ ad%%% el&&& se### do$$$ "
    words = lambda base, n: " ".join(f"{w}{i}" for i, w in enumerate((base * n).split()))
    docs = spark.createDataFrame([(i, words(junk if i % 10 == 0 else clean, 8), "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    for r in quality.judged(docs).collect():
        assert r["kept"] == (r["doc_id"] % 10 != 0), r


def test_quality_odd_documents(spark):
    rows = quality.judged(odd_documents(spark)).collect()
    assert len(rows) == 12 and all(r["base_failed"] for r in rows if r["n_words"] < 50) and not any(r["kept"] for r in rows if r["base_failed"])
    assert next(r for r in rows if r["doc_id"] == 4)["n_repeat_words"] == 60_000
    assert quality.judged(no_documents(spark)).count() == 0


MIT = """MIT License

Copyright (c) 2019 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE."""

APACHE = """Copyright 2021 Some Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

ENDORSE = """
3. Neither the name of Some Company nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""

GPL = """Frobnicator is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Frobnicator is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def commented(text, mark):
    return "\n".join(f"{mark}{line}" for line in text.split("\n"))


def test_licence_rules(spark):
    cases = [
        (MIT, {"MIT"}), (APACHE, {"Apache-2.0"}), (BSD, {"BSD-2-Clause"}), (BSD + ENDORSE, {"BSD-3-Clause"}), (BSD + ENDORSE + "\n\nAnother part:\n" + BSD, {"BSD-3-Clause", "BSD-2-Clause"}), (ISC, {"ISC"}), (GPL, {"GPL-3.0-or-later"}),
        (GPL.replace("version 3", "version 2"), {"GPL-2.0-or-later"}), (GPL.replace("General", "Lesser General"), {"LGPL-3.0-or-later"}), (GPL.replace("General", "Affero General"), {"AGPL-3.0-or-later"}),
        ("Text. Licensed under CC BY-NC 4.0. More!", {"CC-BY-NC-4.0"}), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
        ("code\nReleased under the\nMIT License.", {"MIT"}), ("// SPDX-License-Identifier: BSD-3-Clause\nint main;", {"BSD-3-Clause"}), ("a b c the permission of the software", set()), ("Licensed under the Apache Licence", set()),
        (MIT.replace("merge,", ""), set()), ("unlicensed under the MIT license", set()), (None, set()), ("", set()), (MIT + "\n\n" + APACHE, {"MIT", "Apache-2.0"}),
    ]
    marks = ["", "# ", "// ", " * ", "-- ", "; "]
    texts = [(f"{k}-{m}", commented(t, m) if t else t, want) for k, (t, want) in enumerate(cases) for m in marks]
    found = licences.scan(spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id string, text string")).collect()
    for key, text, want in texts:
        assert {r["licence"] for r in found if r["doc_id"] == key} == want, text
    assert licences.scan(odd_documents(spark)).count() == 0 and licences.scan(no_documents(spark)).count() == 0


def test_licence_tags_references_and_denials(spark):
    """Texts with the licences that a reader finds in them, written apart from the tables."""
    tag = "// SPDX-License-Identifier: "
    cases = [
        (tag + "MIT-0", {"MIT-0"}), (tag + "BSD-3-Clause-Clear", {"BSD-3-Clause-Clear"}), (tag + "GPL-2.0-or-later", {"GPL-2.0-or-later"}), (tag + "GPL-2.0", {"GPL-2.0-only"}), (tag + "GPL-2.0+", {"GPL-2.0-or-later"}), (tag + "Zlib", {"Zlib"}), (tag + "Unlicense", {"Unlicense"}),
        (tag + "Apache-2.0 OR MIT", {"Apache-2.0", "MIT"}), (tag + "(MIT AND (LGPL-2.1-only OR BSD-3-Clause))", {"MIT", "LGPL-2.1-only", "BSD-3-Clause"}), (tag + "GPL-2.0-only WITH Linux-syscall-note", {"GPL-2.0-only"}), ("/* spdx-license-identifier: mit */", {"MIT"}),
        (tag + "MIT-Unknown", set()), (tag + "LicenseRef-Own", set()), (tag + "CC-BY-SA-4.0\nMIT", {"CC-BY-SA-4.0"}), (tag + "MIT\n# SPDX-License-Identifier: ISC", {"MIT", "ISC"}),
        ("It is licensed under the GNU General Public License, version 3 or later.", {"GPL-3.0-or-later"}), ("Distributed under the GPLv2 (or any later version)", {"GPL-2.0-or-later"}), ("Released under the GNU General Public License, version 3", {"GPL-3.0-only"}),
        ("This is not licensed under the MIT License.", set()), ("Not released under the MIT license, but licensed under the ISC License", {"ISC"}), ("Licensed under MIT", {"MIT"}),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option", {"Apache-2.0", "MIT"}),
    ]
    found = licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    for i, (text, want) in enumerate(cases):
        assert {r["licence"] for r in found if r["doc_id"] == i} == want, text
    assert len({tuple(r) for r in found}) == len(found)


def test_licence_tables_can_be_replaced(spark):
    docs = spark.createDataFrame([(1, "our copyright line one. And, our\nsecond licence line!"), (2, "our second licence line; our copyright line one")], "doc_id long, text string")
    known = spark.createDataFrame([("one", "our copyright line one"), ("two", "our second licence line"), ("whole", "our second licence line of all")], "id string, sentence string")
    rules = spark.createDataFrame([("both", "Own", ["one", "two"])], "rule string, licence string, ids array<string>")
    assert [tuple(r) for r in licences.scan(docs, known, rules).collect()] == [(1, "Own", "both", "one,two")]
    with pytest.raises(ValueError):
        licences.scan(docs, spark.createDataFrame([("one", "no such word")], "id string, sentence string"), rules)


def test_rollup_commits_once_and_revises(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d-e", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    rollup = token_counts.Rollup(spark, f"{tmp_path}/rollup")
    rows = token_counts.counted(docs)
    assert rollup.commit("1", token_counts.deltas(rows)) and not rollup.commit("1", token_counts.deltas(rows))
    changed = token_counts.counted(docs.where("doc_id = 1").withColumn("text", F.lit("a")))
    rollup.commit("2", token_counts.revised(rows.where("doc_id = 1"), changed))
    rollup.commit("3", token_counts.deltas(rows.where("doc_id = 2"), -1))
    totals = {(r["source"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert totals == {("s", "words-1"): (1, 1), ("s", "pieces-1"): (1, 1), (None, "words-1"): (1, 0), (None, "pieces-1"): (1, 0)}
    # a write that broke off has no mark: it is neither counted nor in the way of the next try
    (tmp_path / "rollup" / "batches" / "b-3" / "_SUCCESS").unlink()
    docs_of = lambda: {(r["source"], r["tokenizer"]): r["docs"] for r in rollup.totals().collect()}["s", "words-1"]
    assert docs_of() == 2 and rollup.batches() == ["1", "2"]
    assert rollup.commit("3", token_counts.deltas(rows.where("doc_id = 2"), -1)) and docs_of() == 1


def test_compacted_totals_stay_the_same(spark, tmp_path):
    rows = token_counts.counted(spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d-e", "de", "s")], "doc_id long, text string, lang string, source string"))
    rollup = token_counts.Rollup(spark, f"{tmp_path}/rollup")
    assert rollup.totals().count() == 0 and rollup.compact() == 0
    seen = lambda: sorted(map(tuple, rollup.totals().collect()))
    rollup.commit("a/b=c %", token_counts.deltas(rows))
    before = seen()
    assert rollup.compact() == 1 == rollup.compact() and seen() == before and rollup.batches() == ["a/b=c %"]
    assert not rollup.commit("a/b=c %", token_counts.deltas(rows)) and seen() == before
    rollup.commit("2", token_counts.deltas(rows.where("doc_id = 2"), -1))
    assert rollup.compact() == 2 and {r[1]: r[3:] for r in seen() if r[2] == "words-1"} == {"en": (1, 3), "de": (0, 0)}
    # a generation whose totals are not whole does not count
    (tmp_path / "rollup" / "totals" / "2" / "_SUCCESS").unlink()
    assert {r[1]: r[3:] for r in seen() if r[2] == "words-1"} == {"en": (1, 3), "de": (0, 0)}
    with pytest.raises(ValueError):
        rollup.commit("", token_counts.deltas(rows))


def test_token_counts_odd_documents(spark):
    rollup = token_counts.Rollup(spark)
    rollup.commit("1", token_counts.deltas(token_counts.counted(odd_documents(spark))))
    assert rollup.totals().agg(F.sum("docs")).first()[0] == 24
    empty = token_counts.Rollup(spark)
    empty.commit("1", token_counts.deltas(token_counts.counted(no_documents(spark))))
    assert empty.totals().count() == 0


def test_byte_pair_tokenizer(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "hello world", "en", "s"), (2, None, "en", "s")], "doc_id long, text string, lang string, source string")
    rows = token_counts.counted(docs, {"bpe-50k": token_counts.bpe(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)}).collect()
    assert {r["doc_id"]: r["counts"][0]["tokens"] for r in rows} == {1: 2, 2: 0}


def test_fences_follow_their_group(spark):
    """The same text is judged by what is usual in its language and source, and the fences move when a source changes."""
    letters = "abcdefghij"
    words = lambda marks: " ".join(["#" * 9 + "x"] * marks + [letters[k // 10] + letters[k % 10] + "wxyzvutq" for k in range(100 - marks)])
    rows = [(i, words({"narrow": 0, "broad": 20 + i % 9}[lang]), lang, "s") for lang, start in (("narrow", 0), ("broad", 1000)) for i in range(start, start + 400)]
    rows += [(2000, words(10), "narrow", "s"), (2001, words(10), "broad", "s")]
    schema = "doc_id long, text string, lang string, source string"
    beyond = {r["doc_id"]: "symbols" in r["beyond"] for r in quality.judged(spark.createDataFrame(rows, schema)).collect()}
    assert beyond[2000] and not beyond[2001] and not beyond[0] and not beyond[1000]
    changed = [(i, words(5 + i % 9) if lang == "narrow" and i < 400 else t, lang, source) for i, t, lang, source in rows]
    beyond = {r["doc_id"]: "symbols" in r["beyond"] for r in quality.judged(spark.createDataFrame(changed, schema)).collect()}
    assert not beyond[2000] and not beyond[2001]


def test_small_groups_lean_on_their_language(spark):
    fine = spark.createDataFrame([("a", "big", "x", 10, 900), ("a", "big", "x", 20, 100), ("a", "small", "x", 30, 1), ("b", None, "x", 30, 100_000)], "lang string, source string, ratio string, bucket long, n long")
    upper = {(r["lang"], r["source"]): r["upper"] for r in quality.group_fences(fine).collect()}
    assert upper["a", "big"] == 10 + 3 * 10 and upper["b", None] == 30
    assert upper["a", "small"] == upper["a", "big"]  # one document of its own against a hundred of its language


def test_verdicts_keep_one_occurrence_above_a_fence_of_zero(spark):
    line = lambda a, b: " ".join(f"{a}{b}{x}" for x in "vwxyz")
    text = lambda again: "\n".join([line(a, b) for a in "abcdefghij" for b in "klm"] + [line("a", "k")] * again)
    docs = [(i, text(0), "en", "s") for i in range(200)] + [(300, text(3), "en", "s"), (301, text(4), "en", "s")]
    beyond = {r["doc_id"]: r["beyond"] for r in quality.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert "dup_lines" not in beyond[300] and "dup_lines" in beyond[301] and beyond[0] == []
