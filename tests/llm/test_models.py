"""Decontamination, the language model, toxicity and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.edge import no_documents, odd_documents
from vitrine.llm import common, decontamination, ngram_lm, toxicity
from vitrine.llm import queries as llm_queries


def edited(text, n, rnd):
    t = list(text)
    for _ in range(n):
        i = rnd.randrange(len(t))
        t[i : i + 1] = rnd.choice([[], [rnd.choice("abcxyz")], [t[i], rnd.choice("abcxyz")]])
    return "".join(t)


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_banded_alignment_by_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(5, 40)))
        t = "".join(rnd.choice("abc ") for _ in range(10)) + edited(p, rnd.randrange(4), rnd) + "".join(rnd.choice("abc ") for _ in range(10))
        code = lambda s: np.array([ord(c) for c in s], dtype=np.uint32)
        want = edit_distance_inside(p, t)
        start, end, distance = (int(x[0]) for x in decontamination.banded(code(p), code(t), np.array([-len(p)]), len(p) + len(t) + 1, 5))
        assert (distance > 5) == (want > 5)
        if distance <= 5:
            assert distance == want and edit_distance_inside(p, t[start:end]) == want


def test_alignment_keeps_to_its_band():
    """Within a band the result is that of all alignments whose diagonals lie there, and the cells do not grow with the region."""
    rnd = random.Random(2)
    code = lambda s: np.array([ord(c) for c in s], dtype=np.uint32)
    for _ in range(60):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randrange(8, 40)))
        k, before = rnd.randrange(4), "".join(rnd.choice("abc") for _ in range(rnd.randrange(12)))
        t = before + edited(p, rnd.randrange(k + 1), rnd) + "".join(rnd.choice("abc") for _ in range(9))
        far = rnd.randrange(20, 60)
        starts, ends, found = decontamination.banded(code(p), code(t), np.array([far, len(before) - k, -far - len(p)]), 2 * k + 1, k)
        assert found[1] <= k < found[2] and edit_distance_inside(p, t[starts[1] : ends[1]]) == found[1] >= edit_distance_inside(p, t)
    import time

    p = "".join(rnd.choice("abcdefgh ") for _ in range(10_000))
    began = time.perf_counter()
    assert [int(x[0]) for x in decontamination.banded(code(p), code(p), np.array([-6]), 18, 5)] == [0, 10_000, 0] and time.perf_counter() - began < 10


@pytest.mark.parametrize("edit_rate", [0.1, 0.2])
def test_short_items_keep_their_budget(spark, edit_rate):
    rnd = random.Random(21)
    items = ["".join(rnd.choice("bcdfghjklmnp") for _ in range(n)) for n in (*range(8, 34), 5, 6, 7)]
    docs, want, k = [], set(), 0
    for item_id, item in enumerate(items):
        budget = int(edit_rate * len(item))
        for edits in {0, budget, budget + 1}:
            t = list(item)
            for i in rnd.sample(range(1, len(t) - 1), min(edits, len(t) - 2)):
                t[i] = "xyz"[rnd.randrange(3)]
            docs.append((k, f"aaaa oooo {''.join(t)} uuuu iiii"))
            if edits <= budget:
                want.add((k, item_id))
            k += 1
    rows = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), edit_rate=edit_rate).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_every_row_has_its_own_verdict(spark):
    item = "a question that stands in the benchmark and nowhere else"
    docs = spark.createDataFrame([(None, f"x {item} y", 1), (5, f"x {item} y", 2), (5, "clean", 3), (None, "clean too", 4), (6, None, 5)], "doc_id long, text string, k int")
    kept = decontamination.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["k"] for r in kept.collect()) == [3, 4, 5]
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_items_are_found_with_edits_and_nothing_else(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9)))
    items = [" ".join(word() for _ in range(30)) for _ in range(8)] + ["tiny é", ""]
    docs, want = [], set()
    for i in range(60):
        text = " ".join(word() for _ in range(80))
        if i % 3 == 0:
            k = rnd.randrange(8)
            text += "\n" + edited(items[k].upper(), rnd.randrange(0, 8), rnd).replace(" ", " ,\n") + ". " + " ".join(word() for _ in range(20))
            want.add((i, k))
        docs.append((i, text))
    docs += [(98, "So tiny, É!"), (99, "tinyé")]
    want.add((98, 8))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (4_000_000, 300):
        rows = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    one = next(r for r in rows if r["doc_id"] == 98)
    assert docs[60][1][one["start"] : one["end"]] == "tiny, É"


def test_decontamination_odd_documents(spark):
    bench = spark.createDataFrame([(1, "word " * 30), (2, None), (3, "")], "item_id long, text string")
    docs = odd_documents(spark)
    assert {r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()} == {4}
    assert decontamination.decontaminated(docs, bench).count() == 11
    assert decontamination.contaminated(no_documents(spark), bench).count() == 0 and decontamination.contaminated(docs, bench.where("false")).count() == 0


def brute_model(train, order, keep_from):
    tokens = lambda x: (x or "").lower().split() + ["</s>"]
    texts = [tokens(x) for x in train]
    count = Counter(w for x in texts for w in x)
    grams = lambda x, k: zip(*((["<s>"] * k + x)[j + 1 :] for j in range(k)))
    a = {order: Counter(g for x in texts for g in grams(x, order))}
    for k in range(order - 1, 0, -1):
        a[k] = Counter()
        for g, c in a[k + 1].items():
            a[k][g[1:]] += c if g[1] == "<s>" else 1

    def discounts(c):
        n = [0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        r = lambda a, b: a / b if b else 0.0
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), (1 - 2 * y * r(n[2], n[1]), 2 - 3 * y * r(n[3], n[2]), 3 - 4 * y * r(n[4], n[3]))))]

    d = {k: discounts(c) for k, c in a.items()}
    total, left = Counter(), Counter()
    for k, counts in a.items():
        for g, c in counts.items():
            total[k, g[:-1]] += c
            left[k, g[:-1]] += d[k][min(c, 3)] if k < order or c >= keep_from else c

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(count) + 1)
        context = k, g[:-1]
        if not total[context]:
            return p(g[1:])
        c = a[k][g] if k < order or a[k][g] >= keep_from else 0
        return max(c - d[k][min(c, 3)], 0) / total[context] + left[context] / total[context] * p(g[1:])

    return tokens, count, grams, p


@pytest.mark.parametrize("order, keep_from, options", [(2, 1, {}), (3, 2, {}), (3, 1, {"grams_per_part": 700, "hot": 40, "chars_per_part": 4000}), (4, 2, {"grams_per_part": 2000, "hot": 5})])
def test_language_model_by_brute_force(spark, order, keep_from, options):
    """Also with many ranges and with the words of most texts hot; counts above a byte are in."""
    rnd = random.Random(11)
    texts = [" ".join(f"W{min(int(rnd.paretovariate(0.7)), 300)}" for _ in range(rnd.randrange(40))) for _ in range(300)] + [None, "", "never seen"]
    texts[7] = "so so " * 400
    train = texts[:200] + [None, texts[3], texts[3]]
    tokens, count, grams, p = brute_model(train, order, keep_from)
    n, v = sum(count.values()), len(count)
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), order=order, keep_from=keep_from, **options)
    rows = ngram_lm.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert model.words.tokens == n and model.words.total == v and len(rows) == len(texts)
    for r in rows:
        x = tokens(texts[r["doc_id"]])
        assert r["n_tokens"] == len(x) and r["n_known"] == sum(w in count for w in x)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(g)) for g in grams(x, order)), rel_tol=1e-9), r
    for context in (("w1", "w2"), ("w2", "w9"), ("<s>", "<s>"), ("so", "so")):
        g = ("<s>", *context)[-(order - 1) :]
        assert math.isclose(sum(p((*g, w)) for w in count) + p((*g, "unknown")), 1, rel_tol=1e-9)


def test_few_files_are_mapped_at_a_time(tmp_path):
    """A store of thousands of ranges: every array is right, and old mappings are closed."""
    n = 5_000
    for k in range(n):
        ngram_lm._save(f"{tmp_path}/words-{k}", np.arange(k, k + 3, dtype="<u8"))
    words = ngram_lm.Words(str(tmp_path), np.full(n, 3, dtype=np.int64), 3 * n, n)
    mapped = lambda: sum(str(tmp_path) in line for line in open("/proc/self/maps"))
    for k in [*range(n), *range(0, n, 7)]:
        assert list(words.array("words", k, 0, "<u8")) == [k, k + 1, k + 2]
    assert 0 < mapped() < 1_000 and len(words._open) <= ngram_lm.MAPPINGS


def test_scoring_opens_as_many_files_with_many_ranges(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"w{min(int(rnd.paretovariate(0.6)), 2000)}" for _ in range(60)) for _ in range(200)] + ["again " * 700]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    stream = next(ngram_lm._streams(iter([pa.RecordBatch.from_pydict({"text": [*texts, "never seen"]})])))
    found = []
    for options in ({}, {"grams_per_part": 100, "chars_per_part": 500, "hot": 1000}):
        model = ngram_lm.train(docs, **options)
        found.append((model.score(stream), len(model.words._open), model.parts))
    (few, opened, one), (many, opened_many, parts) = found
    assert one == 1 and parts > 100 and opened_many <= opened < 25
    assert all((a == b).all() for a, b in zip(few, many))


def test_a_range_is_joined_once(tmp_path):
    """A task that runs again changes nothing, also after the range's own files are gone."""
    rnd = np.random.Generator(np.random.PCG64(2))
    cold, hot = np.split(np.unique(rnd.integers(0, 2**63, 500, dtype=np.uint64) << np.uint64(1))[rnd.permutation(500)], [400])
    stats = np.sort(rnd.integers(1, 600, (4, 500)), axis=0)[::-1]
    for name, keys, mine in (("contexts2", np.sort(cold), stats[:, :400]), ("hot2", np.sort(hot), stats[:, 400:])):
        ngram_lm._save(f"{tmp_path}/{name}-1", keys, *ngram_lm._small_stats(mine))
    more = int((stats[0] >= 255).sum())
    store = ngram_lm.Joined(np.array([0, 500]), np.array([0, more]), 4)
    model = ngram_lm.Model(ngram_lm.Words(str(tmp_path), np.zeros(1, dtype=np.int64), 0, 0), 2, 1, 2, 1, {}, 0, 0.0, {"contexts2": store})
    for _ in range(2):
        for part in (0, 1):
            store.write(str(tmp_path), "contexts2", part, ["contexts2", "hot2"])
        keys = np.concatenate([np.sort(cold), np.sort(hot), np.sort(cold) + np.uint64(1)])
        got = model._found("contexts2", keys, np.ones(len(keys), dtype=np.int64))
        assert (got[:500] == stats.T).all() and not got[500:].any() and not model._found("contexts2", keys, np.zeros(len(keys), dtype=np.int64)).any()
    assert not [f for f in tmp_path.iterdir() if f.name.startswith("hot2")]


def test_order_of_keys():
    rnd = np.random.Generator(np.random.PCG64(4))
    for keys in (np.zeros(0), np.zeros(5), rnd.integers(0, 2**63, 5000) * 2, rnd.integers(0, 50, 5000), rnd.integers(0, 9, 5000) + 2**62, -(rnd.integers(0, 4000, 5000) // 7 * 3)):
        keys = np.asarray(keys).astype(np.uint64)
        assert (ngram_lm._order(keys) == np.argsort(keys, kind="stable")).all()
        distinct, inverse = np.unique(keys, return_inverse=True)
        assert all((a == b).all() for a, b in zip(ngram_lm._distinct(keys), (distinct, inverse)))


def test_word_hashes_by_definition():
    """Words at the edges of rows of bytes, and longer than one, hash as by themselves."""
    texts = [b"", b"Ab" * 5000 + b" ab", b" " * 4095 + b"z\tq", b"x" * 4096 + b"\n" + b"x" * 4096, bytes(random.Random(1).choice(b"aB \n\xc3\xa9") for _ in range(9000))]
    plain = lambda word: sum(int(common._VALUES[c]) * pow(int(common._BASE), k, 2**64) for k, c in enumerate(word)) % 2**64
    hashes, counts = common.word_hashes(texts)
    words = [t.split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    assert (hashes == common.mixed_bits(np.array([plain(w) for own in words for w in own], dtype=np.uint64))).all()


def test_packing_round_trip():
    rnd = np.random.Generator(np.random.PCG64(1))
    keys = np.unique(rnd.integers(0, 2**63, 1000, dtype=np.uint64))
    for values in (np.arange(len(keys)), np.full(len(keys), 2**40), np.zeros(len(keys))):
        kind, part, n, data = ngram_lm._pack(0, 3, keys, values.astype(np.uint64))
        got = ngram_lm._unpack(n, data, 2)
        assert (got[0] == keys).all() and (got[1] == values).all() and (kind, part) == (0, 3)
    small, at, values = ngram_lm._small(np.array([0, 254, 255, 2**40]))
    assert small.tolist() == [0, 254, 255, 255] and at.tolist() == [2, 3] and values.tolist() == [255, 2**40]


def test_language_model_odd_documents(spark):
    docs = odd_documents(spark)
    model = ngram_lm.train(docs)
    rows = ngram_lm.scored(docs, model).collect()
    assert len(rows) == 12 and {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 1 and all(r["score"] < 0 for r in rows)
    rows = ngram_lm.scored(docs, ngram_lm.train(no_documents(spark))).collect()
    assert len(rows) == 12 and all(r["score"] == r["base_score"] == 0 for r in rows)
    assert ngram_lm.scored(no_documents(spark), model).count() == 0
    with pytest.raises(ValueError):
        ngram_lm.train(docs, order=6)


def brute_segments(scores):
    """All maximal-scoring segments by the recursive definition."""
    best = max(((sum(scores[a:b]), -a, -(b - a)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, n = -best[1], -best[2]
    left = [(x, y, s) for x, y, s in brute_segments(scores[:a])]
    right = [(x + a + n, y + a + n, s) for x, y, s in brute_segments(scores[a + n :])]
    return left + [(a, a + n, best[0])] + right


def test_segments_by_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        scores = {b"p": 3.0, b"q": 1.5, b"m": -2.0}
        model = toxicity.Model(scores, -0.7)
        words = [rnd.choice([b"p", b"q", b"m", b"o", b"o", b"o"]) for _ in range(rnd.randrange(18))]
        want = brute_segments([scores.get(w, -0.7) for w in words])
        got = model.segments(words)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_take_linear_time():
    """Marked and other tokens in turn once made every step walk back over all segments before it."""
    import time

    model = toxicity.Model({b"p": 1.0, b"q": 3.0}, -1.01)
    for pattern in ([b"p", b"o"], [b"o", b"p", b"q", b"o", b"o", b"o"]):
        seconds = []
        for n in (50_000, 400_000):
            words = (pattern * n)[:n]
            began = time.perf_counter()
            assert model.segments(words)
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 30 * seconds[0] + 1


def test_toxicity_finds_held_out_documents(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 200))]
        toxic = i % 8 == 0
        if toxic:
            at = rnd.randrange(len(w))
            w[at:at] = [rnd.choice(["Grim", "vile!", "foulish", "foulness"]) for _ in range(rnd.randrange(3, 6))]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, marks, ~out)
    truth = dict(labels)
    found = [r for r in toxicity.scored(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [r["tox_predicted"] == truth[r["doc_id"]] for r in found]
    assert sum(right) / len(right) > 0.97 and all(0 <= r["tox_score"] <= 1 for r in found)


def test_toxicity_odd_documents(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, toxic int")
    for marks in (labels, labels.where("false"), labels.where("toxic = 1")):
        rows = toxicity.scored(odd_documents(spark), toxicity.fit(odd_documents(spark), marks)).collect()
        assert len(rows) == 12 and all(0 <= r["tox_score"] <= 1 for r in rows)
    assert toxicity.scored(no_documents(spark), toxicity.fit(no_documents(spark), labels)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables with a planted case for every stage."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("etaoinshrdl") for _ in range(rnd.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    item, footer = sentence(40), "Read more on our site"
    rows, toxic = [], {}
    for i in range(240):
        body = "\n".join(sentence(20) for _ in range(4))
        toxic[i] = int(i % 12 == 0)
        if toxic[i]:
            body += " " + " ".join(["vile", "grim", "foul", "vile"])
        if 100 <= i < 115:
            body += f"\n{footer}"
        if i == 131:
            body += f"\n{item}"
        rows.append([i, body, "en", f"s{i % 3}"])
    for k in range(3):
        rows[201 + 2 * k][1] = rows[199][1] + (" extra" if k == 1 else "")  # copies of a clean document
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, toxic


def test_each_stage_takes_effect(spark, corpus):
    folder, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept.append((name, {r["doc_id"] for r in docs.select("doc_id").collect()}))
        if name != "mixing":
            assert docs.columns == columns
        if name == "line dedup":
            assert sum("Read more on our site" in r["text"] for r in docs.collect()) == 1
    clean = {i for i, t in toxic.items() if not t}
    assert kept[0][1] == clean and kept[1][1] == clean
    assert kept[2][1] == clean - {201, 203, 205} and kept[3][1] == kept[2][1] - {131}
    assert kept[4][1] <= kept[3][1] and {"mix_copy", "mix_shard", "mix_order"} <= set(docs.columns)


def closest(pattern, text):
    """The least number of edits between ``pattern`` and a stretch of ``text``."""
    codes = np.array([ord(c) for c in text])
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=int)
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(new - place) + place
    return row.min()


def test_stages_by_brute_force(spark, corpus):
    """Each stage against a plain version of itself, on what its predecessor kept."""
    folder, toxic = corpus
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    before = read(docs)
    docs = stages["toxicity"](spark, docs, folder).cache()
    after = read(docs)
    assert after == {i: t for i, t in before.items() if not toxic[i]}

    before, seen = after, Counter()
    for t in before.values():
        seen.update({x.strip().lower() for x in t.split("\n")} - {""})
    docs = stages["line dedup"](spark, docs, folder).cache()
    after, met, want = read(docs), set(), {}
    for i, t in sorted(before.items()):
        lines = []
        for x in t.split("\n"):
            key = x.strip().lower()
            if seen[key] < 10 or key not in met:
                lines.append(x)
            met.add(key)
        want[i] = "\n".join(lines)
    assert after == want and any(after[i] != before[i] for i in after)

    before = after
    docs = stages["n-gram Jaccard join"](spark, docs, folder).cache()
    after = read(docs)
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in before.items()}
    near = {i: {j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    classes = {i: i for i in sets}
    for _ in sets:
        classes = {i: min(classes[j] for j in near[i]) for i in sets}
    assert after == {i: t for i, t in before.items() if classes[i] == i} and len(after) < len(before)

    before = after
    docs = stages["benchmark decontamination"](spark, docs, folder).cache()
    after = read(docs)
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    pattern = plain(item)
    assert after == {i: t for i, t in before.items() if closest(pattern, plain(t)) > int(0.1 * len(pattern))} and len(after) < len(before)

    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    copies = Counter(r["doc_id"] for r in stages["mixing"](spark, docs, folder).collect())
    size, taken = Counter(), Counter()
    for i, t in after.items():
        size[source[i]] += len(t.split())
        taken[source[i]] += len(t.split()) * copies[i]
    share = 1.5 * sum(size.values()) / 8
    targets = {s: min(2 * size[s], share * w) for s, w in zip(sorted(size), (5, 2, 1))}
    rest = 1.5 * sum(size.values()) - sum(targets.values())  # of the sources at their caps, shared again by weight
    low = [s for s in sorted(size) if targets[s] < 2 * size[s]]
    weights = dict(zip(sorted(size), (5, 2, 1)))
    targets = {s: t + (rest * weights[s] / sum(weights[x] for x in low) if s in low else 0) for s, t in targets.items()}
    assert all(abs(taken[s] - min(t, 2 * size[s])) <= 100 for s, t in targets.items()) and max(copies.values()) <= 2


@pytest.mark.parametrize("name, kept", [("toxicity", None), ("line dedup", 12), ("n-gram Jaccard join", 9), ("benchmark decontamination", 12), ("mixing", None)])
def test_stages_on_odd_and_empty_documents(spark, corpus, name, kept):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd_documents(spark), no_documents(spark)):
        out = stage(spark, docs, corpus[0])
        rows = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns and len(rows) <= docs.count()
        if kept and docs.count():
            assert len(rows) == kept, [r["doc_id"] for r in rows]


def test_pipeline_query(spark, corpus):
    assert llm_queries.queries()["pipeline"](spark, corpus[0]).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
