"""Line dedup, substring dedup and the n-gram Jaccard join against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import no_documents, odd_documents
from vitrine.llm import jaccard_join, line_dedup, substring_dedup

WS = " \t\n\x0b\x0c\r"


def lined_texts(n=150):
    rnd = random.Random(4)
    common = ["Share this", " share THIS\t", "Cookie notice é", ""]
    return ["\n".join(rnd.choice(common) if rnd.random() < 0.3 else f"line {rnd.randrange(400)}" for _ in range(rnd.randrange(1, 12))) for _ in range(n)] + ["", None]


def brute_lines(texts, least, keep_first=False):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    gone = {k for k, d in seen.items() if len(k) >= 1 and len(d) >= least}
    out = {}
    for i, t in enumerate(texts):
        kept, once = [], set()
        for x in (t or "").split("\n"):
            k = key(x)
            first = keep_first and min(seen[k]) == i and k not in once
            once.add(k)
            if k not in gone or first:
                kept.append(x)
        out[i] = (len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_lines_by_brute_force(spark, keep_first, broadcast_keys):
    texts = lined_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = line_dedup.drop_repeated_lines(docs, 10, keep_first=keep_first, broadcast_keys=broadcast_keys).collect()
    assert {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["__sha256"]) for r in rows} == brute_lines(texts, 10, keep_first)


def test_full_filters_only_add_suspects(spark):
    docs = spark.createDataFrame(list(enumerate(lined_texts())), "doc_id long, text string").repartition(3)
    counts = lambda bits: sorted(map(tuple, line_dedup.repeated_keys(docs, 10, 1, bits).collect()))
    assert counts(2**8) == counts(2**20) != []


def test_filters_grow_with_the_lines(spark):
    """Some 1 % of the lines of a corpus without repeats are suspects, whatever its size."""
    lines = 60_000
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines // 600)), lambda i: F.concat_ws("-", "id", i)), "\n").alias("text"))
    log_bits = (line_dedup.BITS_A_LINE * lines - 1).bit_length()
    assert np.unpackbits(line_dedup.build_filter(docs, 1, log_bits)).mean() < 0.1
    assert line_dedup.repeated_keys(docs, 2).count() == 0


def test_lines_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (None, "a"), (-1, "b"), (-1, "b"), (3, "b")], "doc_id long, text string")
    for broadcast_keys in (1000, 0):
        rows = line_dedup.drop_repeated_lines(docs, 2, keep_first=True, broadcast_keys=broadcast_keys).collect()
        assert sorted((str(r["doc_id"]), r["__text"]) for r in rows) == [("-1", "b"), ("-1", "b"), ("3", ""), ("None", "a"), ("None", "a")]


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_lines_odd_documents(spark, broadcast_keys):
    docs = odd_documents(spark)
    out = line_dedup.drop_repeated_lines(docs, 2, broadcast_keys=broadcast_keys)
    assert set(out.columns) == {*docs.columns, "__text", "__n_lines", "__n_dropped", "__sha256"} - {"text"}
    rows = out.collect()
    assert len(rows) == 12 and next(r for r in rows if r["doc_id"] == 1)["__n_lines"] == 1
    assert all(r["__n_dropped"] == 2 and r["__text"] == "" for r in rows if r["doc_id"] in (6, 7))
    assert line_dedup.drop_repeated_lines(no_documents(spark), broadcast_keys=broadcast_keys).count() == 0


def test_passages_are_found_and_cut(spark):
    rnd = random.Random(8)
    sentence = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(12)) + "."
    passage = " ".join(sentence() for _ in range(5))
    texts = [f"{sentence()} {passage}\n{sentence()}", f"{sentence()}\n{passage.upper()} Ok. {sentence()}", sentence() + " é " + sentence(), f"{sentence()} {sentence()} {passage}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r for r in substring_dedup.repeats(docs).collect()}
    assert set(spans) == {1, 3} and all(s["first_doc"] == 0 and s["n_words"] == 60 for s in spans.values())
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()}
    assert all(cut[i] == texts[i] for i in (0, 2, 4, 5)) and "W" not in cut[1] and cut[3] == texts[3][: spans[3]["start"]] + texts[3][spans[3]["end"] :]


def test_offsets_count_code_points(spark):
    body = "é 漢 😀 " + " ".join(f"v{i}" for i in range(40)) + "."
    docs = spark.createDataFrame([(0, body), (1, "Über uns. " + body)], "doc_id long, text string")
    span = substring_dedup.repeats(docs).first()
    assert ("Über uns. " + body)[span["start"] : span["end"]].strip() == body


def test_substrings_odd_documents(spark):
    docs = odd_documents(spark)
    assert {(r["doc_id"], r["n_words"]) for r in substring_dedup.repeats(docs).collect()} == {(4, 60_000 - 20)}
    assert {r["doc_id"] for r in substring_dedup.repeats(docs, min_line_words=1).collect()} == {4, 7, 10}
    out = substring_dedup.without_repeats(docs)
    assert out.count() == 12 and out.columns == docs.columns
    assert substring_dedup.repeats(no_documents(spark)).count() == 0 and substring_dedup.without_repeats(no_documents(spark)).count() == 0


def near_copies():
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    line = " ".join(f"c{k}" for k in range(9))
    texts += [line + " " + " ".join(f"y{rnd.randrange(10**5)}" for _ in range(rnd.choice([1, 5, 20, 60]))) for _ in range(120)]
    return texts + ["", "a b c", "A b C", None, "the", "x y z w"]


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links, parent = Counter(), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            c = len(sets[a] & sets[b])
            if c and 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (root(i), links[i]) for i in range(len(texts))}


@pytest.mark.parametrize("bucket", [12, 512])
def test_join_by_brute_force(spark, bucket):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard_join.classes(docs, bucket=bucket).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == brute_classes(texts)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(6)
    chain = list(range(60))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    found = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(1, 60)) and all(found[i] == 100 for i in range(101, 160)) and found[201] == 200


def test_join_odd_documents(spark):
    rows = jaccard_join.classes(odd_documents(spark)).collect()
    assert len(rows) == 12 and {r["doc_id"]: r["n_links"] for r in rows}[6] == 2 and {r["doc_id"]: r["class_id"] for r in rows}[10] == 9
    kept = jaccard_join.one_of_each(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, None, 8, 9]))
    assert jaccard_join.classes(no_documents(spark)).count() == 0


def test_rows_without_ids_and_repeated_ids_are_joined(spark):
    """Verdicts follow the text of each row, not its doc_id; one row of each class stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, 1), (None, a, 2), (5, b, 3), (9, a + " more", 4), (None, c, 5), (None, c, 6), (5, a, 7), (7, "", 8), (7, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    found = Counter((r["doc_id"], r["class_id"], r["n_links"], r["copy_of"]) for r in jaccard_join.classes(docs).collect())
    assert found == Counter({(5, 5, 3, 5): 2, (None, 5, 3, 5): 1, (5, 5, 0, 5): 1, (9, 5, 3, 9): 1, (None, None, 1, None): 2, (7, 7, 0, 7): 2})
    kept = [r["k"] for r in jaccard_join.one_of_each(docs).collect()]
    assert len(kept) == 5 and {3, 8, 9} <= set(kept) and len({1, 7} & set(kept)) == 1 and len({5, 6} & set(kept)) == 1


def test_runs_follow_the_target_recall():
    runs = jaccard_join.runs_for
    assert runs(0.9, (4, 5), 1) == 2 and runs(0.995, (4, 5), 4) == 13 and runs(0.9, (4, 5), 4) < runs(0.99, (4, 5), 4)
    with pytest.raises(ValueError):
        runs(0.999999, (1, 2), 4)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_the_test_tables(spark):
    """Documents whose id is divisible by 20 against all, small buckets so that they split."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    words = {d: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() for d, t in texts.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for d, w in words.items()}
    found = {r["doc_id"]: r["n_links"] for r in jaccard_join.classes(docs, bucket=16).collect()}
    wanted = {a: sum(b != a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0 for b in sets) for a in sets if a % 20 == 0}
    assert all(found[a] <= n for a, n in wanted.items()) and sum(found[a] for a in wanted) >= 0.9 * sum(wanted.values()) > 0


def test_a_passage_inside_other_sentences_is_found(spark):
    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    shared = prose(60)
    rows = [(i, f"{prose(40)} {shared if i % 3 else prose(60)} {prose(40)}") for i in range(30)]
    found = {r.doc_id: r for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(found) == [i for i in range(30) if i % 3 and i != 1]
    for i, row in found.items():
        cut = rows[i][1][row.start : row.end]
        assert cut in shared and len(cut.split()) == row.n_words >= 30


def spans_of(spark, texts):
    rows = substring_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.n_words == len(texts[r.doc_id][r.start : r.end].split()) for r in rows)
    return sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in rows)


def test_unique_lines_between_repeated_ones_stay(spark):
    header, footer = "please fill in this form completely", "return it signed before next friday"
    texts = ["\n".join([header, *(f"{k}name{i} {k}value{i}" for k in range(20)), footer]) for i in range(4)]
    assert spans_of(spark, texts) == []
    passage = "\n".join(f"line {k} of a passage that is shared" for k in range(10))
    texts = [f"{passage}\n{k} own\nlines {k}\n{k} here\n{passage.upper()}" for k in "abc"]
    assert all(" own" not in cut and "lines" not in cut and " here" not in cut for _, cut in spans_of(spark, texts))
    assert [i for i, _ in spans_of(spark, texts)] == [0, 1, 1, 2, 2]


def test_passages_of_short_lines_are_found(spark):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**7)}"
    poem = [word() for _ in range(60)]
    texts = [f"{word()}\n{word()} " + "\n".join(" ".join(poem[i : i + n]) for i in range(0, 60, n)) + f"\n{word()}" for n in (1, 2, 3, 1, 60)]
    assert [(i, cut.split()) for i, cut in spans_of(spark, texts)] == [(i, poem) for i in (1, 2, 3, 4)]


def test_every_passage_of_fifty_words_is_found_with_its_edges(spark):
    rnd = random.Random(12)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**7)}" for _ in range(n))
    shared = [prose(n) for n in (30, 50, 51, 55, 60) for _ in range(60)]
    texts = [f"{prose(rnd.randrange(60))} {s} {prose(rnd.randrange(60))}." for _ in range(2) for s in shared]
    assert spans_of(spark, texts) == [(i + len(shared), s) for i, s in enumerate(shared)]


def test_words_repeated_within_a_text_keep_the_first_occurrence(spark):
    assert spans_of(spark, ["word " * 100, "word " * 100]) == [(0, ("word " * 80).strip()), (1, ("word " * 100).strip())]


def test_repeated_rows_give_whole_passages(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(20)) for i in range(20))
    rows = substring_dedup.repeats(spark.createDataFrame([(1, text), (2, text), (2, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows), key=str) == [(2, 0, len(text), 400, 1), (None, 0, len(text), 400, 1)]


def occurrences(texts, n):
    """Of every window of n words the places (doc, word), in order."""
    at = defaultdict(list)
    for doc, text in sorted(texts.items()):
        w = text.lower().split()
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append((doc, i))
    return at


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_units_by_brute_force(spark, seed):
    """Short lines, long lines and pasted passages: every repeated line goes but its first, and no word goes that is not in a unit found earlier."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(40)}" if rnd.random() < 0.4 else f"v{rnd.randrange(10**6)}"
    pool = [" ".join(word() for _ in range(rnd.randrange(1, 13))) for _ in range(60)]
    passages = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(rnd.randrange(10, 25))) for _ in range(6)]
    texts = {}
    for doc in range(40):
        lines = [rnd.choice(pool) if rnd.random() < 0.3 else " ".join(word() for _ in range(rnd.randrange(0, 9))) for _ in range(rnd.randrange(12))]
        if rnd.random() < 0.4:
            lines.insert(rnd.randrange(len(lines) + 1), f"{word()} {rnd.choice(passages)} {word()}")
        texts[doc] = rnd.choice(["\n", "\n\n", " \n\t"]).join(x.upper() if rnd.random() < 0.2 else x for x in lines)
    last = 10**6  # a row without an id comes after all others
    texts[40] = texts[last] = texts[7]
    rows = [*((None if i == last else i, t) for i, t in texts.items()), (40, texts[7]), (50, None), (51, "")]
    unit, least, line_words = 4, 6, 3
    found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least, unit=unit, min_line_words=line_words).collect()
    gone = defaultdict(set)
    for r in ({**r.asDict(), "doc_id": last if r.doc_id is None else r.doc_id} for r in found):
        before, inside = texts[r["doc_id"]][: r["start"]].split(), texts[r["doc_id"]][r["start"] : r["end"]].split()
        assert len(inside) == r["n_words"] and r["first_doc"] <= r["doc_id"]
        gone[r["doc_id"]] |= set(range(len(before), len(before) + len(inside)))
    # lines of line_words or more: (words) -> places
    at, lines = defaultdict(list), {}
    for doc, text in sorted(texts.items()):
        k = 0
        for line in text.lower().split("\n"):
            w = tuple(line.split())
            if len(w) >= line_words:
                at[w].append((doc, k))
                lines[doc, k] = w
            k += len(w)
    windows = occurrences(texts, unit)
    first = {w: min([*p, *windows.get(w, [])]) for w, p in at.items()}
    allowed = defaultdict(set)
    for (doc, k), w in lines.items():
        if (doc, k) != first[w]:
            assert gone[doc] >= set(range(k, k + len(w))) or first[w][0] == doc, (doc, k, w)
            allowed[doc] |= set(range(k, k + len(w)))
    pairs = occurrences(texts, 2)  # an extension goes on word by word from a unit, so its words have a neighbour that repeats
    for n, table in ((unit, windows), (2, pairs)):
        for places in table.values():
            for doc, k in places[1:]:
                allowed[doc] |= set(range(k, k + n))
    assert all(gone[doc] <= allowed[doc] for doc in gone)
    # passages of least + unit words are found for certain
    for places in occurrences(texts, least + unit).values():
        for doc, k in places[1:]:
            assert gone[doc] & set(range(k, k + least + unit))


def test_different_texts_of_one_id_keep_their_own_words(spark):
    """Rows that share an id, or have none, are cut by their own places, the same in every run."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))
    passage, own, unique = ([word() for _ in range(n)] for n in (60, 20, 200))
    other = [word() for _ in range(70)]
    rows = [(0, " ".join(passage)), (1, " ".join(passage + own)), (1, " ".join(unique)), (2, " ".join(other)), (None, " ".join(other)), (None, " ".join(own[:5] + passage)), (1, None), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, extra string")
    for parts in (1, 5):
        cut = substring_dedup.without_repeats(docs.repartition(parts))
        assert cut.columns == docs.columns
        left = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").split()) for r in cut.collect())
        want = [(False, 0, passage), (False, 1, []), (False, 1, own), (False, 1, unique), (False, 2, other), (True, 0, []), (True, 0, []), (True, 0, own[:5])]
        assert left == sorted(want)
        assert sorted((r.doc_id is None, r.n_words, r.first_doc) for r in substring_dedup.repeats(docs).collect()) == [(False, 60, 0), (True, 60, 0), (True, 70, 2)]
