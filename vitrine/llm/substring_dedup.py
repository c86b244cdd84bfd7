"""Substring dedup by hashing lines and word windows.

A-Z count as a-z and white space does not count beyond parting words and lines. Two kinds of units are hashed to 128 bits:

* every line (a paragraph is a line here) of ``min_line_words`` words or more, whole;
* windows of ``unit`` words, for passages that begin or end within lines. Of each ``min_words -
  unit + 1`` windows that begin one after another the one with the least hash is taken (winnowing), so
  which ones are taken depends on the words alone, and a passage of ``min_words`` words shares a
  window with each of its other occurrences wherever it stands, in prose as in lists of short lines.

Digests are grouped over all documents and the earliest occurrence, by (doc_id, first word), is kept.

Later occurrences that overlap or touch form a run, so every word of a run stands in a unit that
occurs earlier, and no unique text lies within. A run of windows stops up to ``min_words - unit`` words short of
its passage at each end; there it is extended word by word along the first occurrence of its outermost unit.
Runs that touch now join, and those that hold a repeated line or have ``min_words`` words or more are removed, with their exact
offsets in the original text. At the defaults a passage of 50 words or more is found for certain, as
its run has 30 words before it is extended; the extension is short where the outermost unit's first occurrence
is another one than the passage's. What stays: repeated lines under ``min_line_words`` words and repeated passages under ``min_words``.

Of each digest only a count and the first place travel to its group, pre-aggregated before the
shuffle; units whose digest is unique end there. The join that marks later occurrences is a plain
equi-join whose hot partitions adaptive execution splits. Texts are joined once to the places where
runs end, for the words around them.

Cases: null and empty texts have no units; different texts of one doc_id, and texts without one, are documents of their own (see
:func:`numbered`), those without an id coming last; a passage within one document that repeats there is a repeat too, its first occurrence staying whole where the two
overlap; equal documents keep the first whole; rows equal in id and text
share their places, so one of them is kept only as a whole with the other; an empty table gives an empty result; other
columns are not read by ``repeats`` and pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import doc_slices, mixed_bits, small_batches, staged, word_hashes, word_places

SLICE = 2_000_000


def winnowed(hashes: np.ndarray, counts: np.ndarray, unit: int, window: int) -> np.ndarray:
    """First words of the units taken: of each ``window`` units in a row within a text the one with the least hash."""
    n = len(hashes) - unit + 1
    if n < window:
        return np.zeros(0, dtype=np.int64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(unit):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    least = np.lib.stride_tricks.sliding_window_view(mixed_bits(mixed), window).argmin(axis=1)
    owner = np.repeat(np.arange(len(counts)), counts)
    begins = np.flatnonzero(owner[: len(least)] == owner[unit + window - 2 :])
    return np.unique(begins + least[begins])


def line_units(texts: list[bytes], counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of every line of ``least`` words or more; words are numbered over all texts."""
    line, starts, _ = word_places(texts)
    ends = np.flatnonzero(line == 10)  # of a line or a text
    edges = np.unique(np.concatenate([[0], np.searchsorted(starts, ends)]))
    first, n = edges[:-1], np.diff(edges)
    return first[n >= least], n[n >= least]


def unit_table(documents: DataFrame, unit: int = 20, window: int = 11, min_line_words: int = 30) -> DataFrame:
    """(doc_id, word, n, line, h1, h2): the hashed units; ``word`` is the first word's number and ``n`` how many there are."""
    small_batches(documents.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, SLICE):
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            hashes, counts = word_hashes(texts)
            windows = winnowed(hashes, counts, unit, window)
            lines, lengths = line_units(texts, counts, min_line_words)
            first, n = np.concatenate([windows, lines]), np.concatenate([np.full(len(windows), unit), lengths])
            firsts = np.concatenate([[0], np.cumsum(counts)])  # each text's first word
            owner = np.searchsorted(firsts, first, "right") - 1
            raw = hashes.tobytes()
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * (a + k)]) for a, k in zip(first.tolist(), n.tolist())), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array((first - firsts[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.arange(len(first)) >= len(windows)), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc_id", "word", "n", "line", "h1", "h2"],
            )

    return _texts(documents).mapInArrow(cut, "doc_id long, word int, n int, line boolean, h1 long, h2 long")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")


def surroundings(documents: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    """(doc_id, place, around, offsets) of ``places`` (doc_id, place): the hashes of up to ``reach`` words, and the code point offsets of the place moved by 0, 1, ... of them.

    A place is twice the number of a word, for the words before it from right to left and where they
    start; or that and one, for the words from it on and where they end.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, SLICE):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            hashes, counts = word_hashes(texts)
            if not len(hashes):
                continue
            line, starts, ends = word_places(texts)
            asked = batch.column(2)
            owner = np.repeat(np.arange(len(texts)), asked.value_lengths().to_numpy(zero_copy_only=False))
            place = asked.flatten().to_numpy(zero_copy_only=False)
            firsts = np.concatenate([[0], np.cumsum(counts)])
            inside = place // 2 <= counts[owner]  # always, but for other rows with this doc_id
            owner, place = owner[inside], place[inside]
            word, ahead = firsts[owner] + place // 2, place % 2 == 1
            n = np.minimum(np.where(ahead, firsts[owner + 1] - word, word - firsts[owner]), reach)
            step = np.where(ahead, 1, -1)[:, None]
            moved = np.where(ahead, word - 1, word)[:, None] + step * np.arange(reach + 1)  # the outermost word of the moved place
            used = np.arange(reach + 1) <= n[:, None]
            moved = np.clip(moved, 0, len(starts) - 1)
            before = np.concatenate([[0], np.cumsum((line & 0xC0) != 0x80)])
            origin = before[np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])][owner]
            offsets = (np.where(ahead[:, None], before[ends[moved]], before[starts[moved]]) - origin[:, None]).astype(np.int32)
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[owner]), pa.array(place.astype(np.int32)),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(hashes[moved[:, 1:][used[:, 1:]]].view(np.int64))),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32), pa.array(offsets[used])),
                ],
                names=["doc_id", "place", "around", "offsets"],
            )

    small_batches(documents.sparkSession)
    wanted = places.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    found = _texts(documents).join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(look, "doc_id long, place int, around array<long>, offsets array<int>")
    return found


def _repeats(documents: DataFrame, min_words: int = 30, unit: int = 20, min_line_words: int | None = None) -> DataFrame:
    """The passages of documents whose ``doc_id`` is never null and never that of two different texts."""
    unit = min(unit, min_words)
    reach = min_words - unit + 1
    table = unit_table(documents, unit, reach, max(1, min_line_words or min_words))
    first = table.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "word")).alias("kept"), F.count(F.lit(1)).alias("found")).where("found > 1").select("h1", "h2", "kept")
    first = staged(first, "first_places")  # else the join runs in the stage of the grouping, where hot partitions can't be split
    later = table.join(first, ["h1", "h2"]).where((F.col("kept.doc_id") != F.col("doc_id")) | (F.col("kept.word") != F.col("word")))
    # a unit that overlaps its own first occurrence leaves that whole
    begin = F.when(F.col("kept.doc_id") == F.col("doc_id"), F.greatest("word", F.col("kept.word") + F.col("n"))).otherwise(F.col("word"))
    kept = F.struct("kept.doc_id", "kept.word", "n").alias("kept")
    own = Window.partitionBy("doc_id").orderBy("begin", "end")
    apart = later.select("doc_id", "line", kept, begin.alias("begin"), (F.col("word") + F.col("n")).alias("end"))
    apart = apart.withColumn("apart", F.coalesce((F.col("begin") > F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    numbered = apart.withColumn("run", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.min_by("kept", F.struct("begin", "end")).alias("left"), F.max_by("kept", F.struct("end", "begin")).alias("right"),
        F.min("kept.doc_id").alias("first_doc"), F.bool_or("line").alias("line"), F.bool_and("line").alias("lines_alone"))
    room = F.when(F.col("lines_alone"), F.lit(0)).when(F.col("left.doc_id") == F.col("doc_id"), F.col("begin") - F.col("left.word") - F.col("left.n")).otherwise(F.lit(reach))
    side = lambda place, kept, kept_place, room: F.struct(place.alias("place"), F.col(f"{kept}.doc_id").alias("kept_doc"), kept_place.alias("kept_place"), room.alias("room"))
    sides = F.array(
        side(F.col("begin") * 2, "left", F.col("left.word") * 2, room),
        side(F.col("end") * 2 + 1, "right", (F.col("right.word") + F.col("right.n")) * 2 + 1, F.when(F.col("lines_alone"), F.lit(0)).otherwise(F.lit(reach))))
    sides = staged(runs.select("doc_id", "run", "first_doc", "line", F.explode(sides).alias("s")).select("doc_id", "run", "first_doc", "line", "s.*"), "run_ends")
    around = staged(surroundings(documents, sides.select("doc_id", "place").union(sides.select("kept_doc", "kept_place")), reach), "surroundings").dropDuplicates(["doc_id", "place"])
    kept = around.select(F.col("doc_id").alias("kept_doc"), F.col("place").alias("kept_place"), F.col("around").alias("kept_around"))
    joined = sides.join(around, ["doc_id", "place"]).join(kept, ["kept_doc", "kept_place"])
    differs = F.array_position(F.zip_with("around", "kept_around", lambda a, b: a.eqNullSafe(b)), False).cast("int")
    more = F.least(F.when(differs > 0, differs - 1).otherwise(F.size("around")), F.col("room"))
    moved = joined.withColumn("more", more).withColumn("at", F.element_at("offsets", F.col("more") + 1))
    ahead = F.col("place") % 2 == 1
    word = F.floor(F.col("place") / 2)
    spans = moved.groupBy("doc_id", "run").agg(
        F.max(F.when(~ahead, F.col("at"))).alias("start"), F.max(F.when(ahead, F.col("at"))).alias("end"), F.max(F.when(~ahead, word - F.col("more"))).alias("begin"), F.max(F.when(ahead, word + F.col("more"))).alias("until"),
        F.min("first_doc").alias("first_doc"), F.bool_or("line").alias("line"),
    )
    own = Window.partitionBy("doc_id").orderBy("begin", "until")
    apart = spans.withColumn("apart", F.coalesce((F.col("begin") > F.max("until").over(own.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    passages = apart.withColumn("passage", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("until") - F.min("begin")).cast("long").alias("n_words"), F.min("first_doc").alias("first_doc"), F.bool_or("line").alias("line"))
    return passages.where((F.col("n_words") >= min_words) | F.col("line")).select("doc_id", "start", "end", "n_words", "first_doc")


def numbered(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(documents, None) as they are if every row has an id and no id has two different texts; else the documents with numbers for ids, and (doc_id, text_hash, number).

    Numbers follow the ids, those of one id the texts' digests, and rows without an id come last. They come from a range sort, so no
    id has to fit into one task; the texts are joined to their numbers once.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    texts = staged(documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest).distinct(), "text_digests")
    if texts.where("doc_id IS NULL").isEmpty() and texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        return documents, None
    order = [F.asc_nulls_last("doc_id"), F.col("text_hash")]
    numbers = staged(texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()), "text_numbers")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("n.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("n.text_hash"))
    joined = documents.alias("d").join(numbers.alias("n"), same)
    return staged(joined.select(*[F.col("n.number").alias("doc_id") if c == "doc_id" else F.col(f"d.`{c}`") for c in documents.columns], F.col("n.number").alias("__number"), F.col("d.doc_id").alias("__doc_id")), "numbered"), numbers


def repeats(documents: DataFrame, min_words: int = 30, unit: int = 20, min_line_words: int | None = None) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc): every repeated passage to remove, in code point offsets.

    ``first_doc`` is the lowest document that keeps one of the passage's units. ``min_line_words`` is ``min_words`` unless given.
    Different texts under one id are different documents, each with its own passages; so are those without an id, which come
    after all others. Rows equal in id and text are one document.
    """
    known, numbers = numbered(documents)
    found = _repeats(known, min_words, unit, min_line_words)
    if numbers is None:
        return found
    name = lambda key: numbers.select(F.col("number").alias(key), F.col("doc_id").alias(f"__{key}"))
    named = found.join(name("doc_id"), "doc_id").join(name("first_doc"), "first_doc")
    return named.select(F.col("__doc_id").alias("doc_id"), "start", "end", "n_words", F.col("__first_doc").alias("first_doc"))


def without_repeats(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with the repeated passages cut out of ``text``."""
    known, numbers = numbered(documents)
    cut = _without(known, _repeats(known, **options))
    return cut if numbers is None else cut.withColumn("doc_id", F.col("__doc_id")).select(*documents.columns)


def _without(documents: DataFrame, passages: DataFrame) -> DataFrame:
    spans = passages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    joined = documents.join(spans, documents["doc_id"] == spans["doc_id"], "left").drop(spans["doc_id"])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda at: F.substring(F.col("text"), at + 1, F.length("text"))
    cut = F.aggregate("__spans", begin, lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])).alias("out")), lambda a: F.concat(a["out"], rest(a["at"])))
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut)).drop("__spans")
