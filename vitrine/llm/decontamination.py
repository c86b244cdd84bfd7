"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised to lower-case letters and digits with single spaces; every
normalised character keeps its place in the text. An item of length m with an edit budget of k =
floor(``edit_rate`` * m) that occurs in a text shares at least ``m + 1 - q (k + 1)`` of its q-grams
with it, all within k + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands of
2 (k + 1) diagonals, one starting every k + 1, so each such stretch lies whole in one band. Bands
that meet the bound become text regions, which an alignment over the diagonals of the band and the
k + 1 before them verifies: 3 (k + 1) cells for each character of the item. q is 8, or the largest number that leaves a short
item with its full budget a positive bound.

The benchmark is the query side. It is broadcast in blocks of at most ``block_chars`` characters, a
pass over the documents each, so its size has no bound. ``decontaminated`` drops rows within those
passes: texts are neither shuffled nor joined.

Cases: null and empty texts or items match nothing; an item under q characters without an edit in
its budget is searched as it stands, between spaces; repeated rows or items give repeated pairs;
overlapping regions of a pair give its best one (least distance, then first place); rows with a null
doc_id are searched too, and every row has a verdict of its own, whatever rows share its doc_id;
other columns are not read, and pass through ``decontaminated``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import doc_slices, small_batches

#: most characters a q-gram: eight bytes fill one 64-bit word.
Q = 8
#: texts are handled in stretches of so many characters
STRETCH = 2_000_000

#: stands between two texts; no text holds it once normalised
GAP = 0xE000

_lower: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> its lower case, or 32 for what is neither letter nor digit, below 65536."""
    global _lower
    if _lower is None:
        table = np.full(65536, 32, dtype=np.uint32)
        for c in range(65536):
            s = chr(c)
            if s.isalnum():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _lower = table
    return _lower


def normalised(texts: list[str], gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the normalised texts with ``gap`` separators between two; the place of each; where each text starts."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]]).astype(np.int64)
    codes = np.frombuffer((" " * gap).join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.where(codes < 65536, _fold()[np.minimum(codes, 65535)], codes)
    for i in range(gap):
        folded[(starts[1:] - 1 - i)] = GAP
    space = folded == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run stays
    at = np.flatnonzero(keep)
    at = at[1:] if len(at) and folded[at[0]] == 32 else at
    at = at[:-1] if len(at) and folded[at[-1]] == 32 else at
    return folded[at], at, starts


def _bytes(codes: np.ndarray) -> np.ndarray:
    """One byte for each code point; ASCII as it is, the others folded (equal characters stay equal)."""
    return np.where(codes < 128, codes, 128 + (codes * np.uint32(31) >> np.uint32(2)) % np.uint32(128)).astype(np.uint8)


def qgrams(line: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-gram at every place of a byte line, as a 64-bit number."""
    n = len(line) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    line = np.concatenate([line, np.zeros(Q - q, dtype=np.uint8)])
    out = np.empty(n, dtype=np.uint64)
    for r in range(min(Q, n)):
        part = line[r : r + (len(line) - r) // Q * Q]
        grams = np.frombuffer(part.tobytes(), dtype="<u8")
        out[r::Q] = grams[: len(out[r::Q])]
    return out & np.uint64(2 ** (8 * q) - 1)


class Grams:
    """The q-grams of the items of one q, sorted, and where they stand."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]) -> None:
        """``items``: (number in the index, normalised code points)."""
        self.q = q
        own = [qgrams(_bytes(codes), q) for _, codes in items]
        flat = np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner = np.repeat([number for number, _ in items], [len(g) for g in own])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in own])[order]
        self.filter = np.zeros(2**20, dtype=bool)
        self.filter[_slot(self.grams)] = True

    def hits(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the line) of every q-gram that they share."""
        grams = qgrams(line, self.q)
        at = np.flatnonzero(self.filter[_slot(grams)])
        where = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        ok = self.grams[where] == grams[at]
        at, where = at[ok], where[ok]
        reps = self.count[where]
        hits = np.repeat(self.first[where] + reps - np.cumsum(reps), reps) + np.arange(reps.sum())
        return self.owner[hits], self.place[hits], np.repeat(at, reps)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float) -> None:
        if not 0 <= edit_rate < 1:
            raise ValueError("edit_rate is a share of an item's characters")
        self.items: list[tuple[int, np.ndarray, int, int]] = []  # id, code points, budget, bound
        self.short: list[tuple[int, np.ndarray]] = []
        by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            codes, _, _ = normalised([text or ""])
            m = len(codes)
            budget = int(edit_rate * m)
            if not m:
                continue
            if m < Q and not budget:
                self.short.append((item_id, codes))
                continue
            q = min(Q, m // (budget + 1))
            by_q.setdefault(q, []).append((len(self.items), codes))
            self.items.append((item_id, codes, budget, m + 1 - q * (budget + 1)))
        self.grams = [Grams(q, own) for q, own in sorted(by_q.items())]

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) of the verified regions in normalised texts that stand one after another."""
        found = []
        line = _bytes(codes)
        for grams in self.grams:
            found += self._regions(codes, *grams.hits(line))
        for item_id, pattern in self.short:
            found += [(item_id, p, p + len(pattern), 0) for p in _find(codes, pattern)]
        return found

    def _regions(self, codes: np.ndarray, owner: np.ndarray, place: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not len(owner):
            return []
        step, bound = (np.array([x[k] for x in self.items]) for k in (2, 3))
        step = step + 1
        span = (len(codes) + 2 * max(len(x[1]) for x in self.items)) + 2
        key = owner * span + np.floor_divide(at - place, step[owner]) + span // 2 - len(codes) // 2
        order = np.argsort(key, kind="stable")
        steps, begin, n = np.unique(key[order], return_index=True, return_counts=True)
        # band b holds the diagonals of steps b and b + 1
        pos = np.minimum(np.searchsorted(steps, steps + 1), len(steps) - 1)
        both = n + np.where(steps[pos] == steps + 1, n[pos], 0)
        item = steps // span
        lows: dict[int, list[int]] = {}
        for j in np.flatnonzero(both >= bound[item]):
            budget, least = self.items[item[j]][2:]
            # each q-gram of the item and of the text counts once
            own = order[begin[j] : begin[j] + both[j]]
            if min(len(np.unique(place[own])), len(np.unique(at[own]))) >= least:
                # the step before it, if no q-gram lies there, has no band of its own
                lows.setdefault(int(item[j]), []).append(int(steps[j] % span - span // 2 + len(codes) // 2 - 1) * (budget + 1))
        out = []
        for number, first in lows.items():
            item_id, pattern, budget, _ = self.items[number]
            chunk = max(1, 2**20 // (3 * (budget + 1)))  # cells a row
            for k in range(0, len(first), chunk):
                start, end, distance = banded(pattern, codes, np.array(first[k : k + chunk]), 3 * (budget + 1), budget)
                out += [(item_id, int(a), int(b), int(d)) for a, b, d in zip(start, end, distance) if d <= budget]
        return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def _find(codes: np.ndarray, pattern: np.ndarray) -> list[int]:
    """Places where a short item stands between spaces or text ends."""
    places = []
    edge = lambda i: i < 0 or i >= len(codes) or codes[i] in (32, GAP)
    for start in np.flatnonzero(codes[: max(0, len(codes) - len(pattern) + 1)] == pattern[0]):
        end = start + len(pattern)
        if (codes[start:end] == pattern).all() and edge(start - 1) and edge(end):
            places.append(int(start))
    return places


def banded(pattern: np.ndarray, codes: np.ndarray, lows: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, distance) of the stretch closest to ``pattern`` in each of many bands of ``codes``; above ``budget`` it says no more than that.

    A band is the ``width`` diagonals (place in the text less place in the pattern) from its number in ``lows`` on, so a
    row has ``width`` cells, whatever the lengths. Bands whose cells have all passed the budget are left.
    """
    n, never = len(codes), np.int64(len(pattern) + len(codes) + 1)
    cells = np.arange(width)
    padded = np.append(codes.astype(np.int64), -1)
    starts, ends, distances = np.zeros(len(lows), dtype=np.int64), np.zeros(len(lows), dtype=np.int64), np.full(len(lows), never)
    open_, column = np.arange(len(lows)), np.asarray(lows, dtype=np.int64)[:, None] + cells  # column: characters of the text used
    row = np.where((column >= 0) & (column <= n), 0, never)  # a match may start anywhere
    begin = np.clip(column, 0, n)
    for c in pattern:
        column = column + 1
        new = np.where(column >= 1, row + (padded[np.clip(column - 1, 0, n)] != c), never)
        came = begin.copy()
        # a character of the pattern without a partner
        down = row[:, 1:] + 1 < new[:, :-1]
        new[:, :-1][down], came[:, :-1][down] = row[:, 1:][down] + 1, begin[:, 1:][down]
        new[(column < 0) | (column > n)] = never
        # a step along the row costs one: the least of (value - cell) so far
        least = np.minimum.accumulate(new - cells, axis=1)
        source = np.maximum.accumulate(np.where(new - cells == least, cells, 0), axis=1)
        row = np.where((column < 0) | (column > n), never, least + cells)
        begin = np.take_along_axis(came, source, axis=1)
        alive = row.min(axis=1) <= budget
        if not alive.all():
            open_, column, row, begin = open_[alive], column[alive], row[alive], begin[alive]
            if not len(open_):
                break
    if len(open_):
        best, each = row.argmin(axis=1), np.arange(len(open_))
        starts[open_], ends[open_], distances[open_] = begin[each, best], column[each, best], row[each, best]
    return starts, ends, distances


def _blocks(documents: DataFrame, benchmark: DataFrame, edit_rate: float, block_chars: int):
    """The benchmark as broadcast indexes of about ``block_chars`` characters."""
    spark = documents.sparkSession
    small_batches(spark)
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        # about block_chars characters
        yield spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], edit_rate))


def contaminated(documents: DataFrame, benchmark: DataFrame, edit_rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, distance): a row for every document and item found in it.

    ``start`` and ``end`` are code point offsets in the document's own text.
    """
    schema = "doc_id long, item_id long, start long, end long, distance long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def searcher(index):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _searched(batches, index.value):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], i, a, b, d) for (r, i), (d, a, b) in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "start", "end", "distance"])

        return search

    out = None
    for index in _blocks(documents, benchmark, edit_rate, block_chars):
        part = texts.mapInArrow(searcher(index), schema)
        out = part if out is None else out.unionAll(part)
    return out


def _searched(batches: Iterator[pa.RecordBatch], ix: Index) -> Iterator[tuple[pa.RecordBatch, dict[tuple[int, int], tuple[int, int, int]]]]:
    """Slices of the batches, each with (row, item) -> (distance, start, end) of what is found in them."""
    longest = max([len(c) + 4 * b + Q for _, c, b, _ in ix.items], default=Q)
    gap = max([b for _, _, b, _ in ix.items], default=0) + 1
    for batch in doc_slices(batches, 4_000_000):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        own = [r for r, t in enumerate(texts) if t]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if own:
            codes, places, starts = normalised([texts[r] for r in own], gap)
            for start in range(0, max(1, len(codes)), STRETCH):
                for item_id, a, b, d in ix.search(codes[start : start + STRETCH + longest]):
                    first, last = int(places[start + a]), int(places[start + b - 1]) + 1
                    k = int(np.searchsorted(starts, first, "right")) - 1
                    new = (d, first - int(starts[k]), last - int(starts[k]))
                    best[own[k], item_id] = min(new, best.get((own[k], item_id), new))
        yield batch, best


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``documents`` without the rows in which an item is found; each row is judged by its own text."""
    schema = documents.schema
    options = {"edit_rate": 0.1, "block_chars": 4_000_000, **options}

    def dropper(index):
        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _searched(batches, index.value):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r for r, _ in found]] = False
                yield batch.filter(pa.array(keep))

        return drop

    out = documents
    for index in _blocks(documents, benchmark, **options):
        out = out.mapInArrow(dropper(index), schema)
    return out
