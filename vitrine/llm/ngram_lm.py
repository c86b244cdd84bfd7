"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and stored as sorted hash arrays.

Words are 64-bit hashes (A-Z lower-cased) and get ids by their place among the sorted hashes; every text ends in an end token, and a
start token stands for all places before it. A stage counts the words. The next ones go from the highest
order down: tasks count their own n-grams and send them, packed and sorted, to ranges of the context's
hash; there they are merged range by range, so a task holds one range at a time; the range's files are written, and what
it adds to the next lower order goes on. Stores live in the shared folder, which must be mounted on every machine: sorted
hashes of n-grams and of contexts, their counts in one byte each with a list of those that need more. Workers map
them into memory, so that machines hold one copy of the pages they use and nothing is broadcast.
Files are written under a name of their own and renamed, so a task that runs again does no harm. At the end the ranges' files are put
one after another into one file for each array, with an index of some eight hashes an entry: texts are scored by a few
array lookups a token, whatever the number of ranges.

p(w | c) = max(a(cw) - D(a(cw)), 0) / a(c.) + g(c) p(w | c'), c' being c without its first word, with g(c) = sum of D_i N_i(c.) / a(c.);
a is the count for the highest order and for n-grams that begin with the start token, and else the number of different words
before it. At the end, p(w) = max(a(w) - D(a(w)), 0) / a(.) + g / (V + 1). D1, D2, D3+ of each order come from its counts of counts.
An unknown word has no count and shares g / (V + 1); an unknown context gives p(w | c').

``keep_from``: n-grams of the highest order with a lower count count for everything else, but are not stored: they have no
count of their own when texts are scored, and g(c) holds their share (2 for orders above 2, where most are singletons; 1 keeps all).

Hot contexts: n-grams go to a range by their context; those of a context whose words all occur more than ``hot`` times go
by the whole n-gram, and the statistics of their contexts merge as sums, so no range gathers one context's n-grams. Ranges
grow in number with the corpus, the tasks that work through them only up to ``TASKS``. Counts are 64-bit whole numbers.

Cases: null and empty texts hold the end token alone; with no training row every probability is 1 / (V + 1) = 1, so all scores are 0; a
null doc_id is never held out; repeated rows count each time; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import doc_slices, mixed_bits, posix_path, shared_dir, small_batches, word_hashes

SLICE = 2_000_000
#: most tasks of a stage; each works through its ranges one after another
TASKS = 8192
#: n-grams a task gathers before it merges them; it sends them once over half as many are distinct
HELD = 2_000_000
#: bytes of packed rows that a task sends at a time
SENT = 1_000_000
#: no word's hash: the end of a text
END = np.uint64(0xFFFFFFFFFFFFFFFF)
PACKED = "kind int, part int, n long, data binary"
_NAMES = ["kind", "part", "n", "data"]
_GRAMS, _HOT, _TOTALS = 0, 1, 2
_ZSTD = pa.Codec("zstd", compression_level=1)


# ---- packing and merging arrays -----------------------------------------------------------------


def _pack(kind: int, part: int, *columns: np.ndarray) -> tuple:
    """A row of columns of whole numbers, the first one in order and written as differences; each has as many bytes a number as it needs."""
    n, widths, out = len(columns[0]), [], []
    for k, column in enumerate(columns):
        column = column.astype(np.uint64)
        column = np.diff(column, prepend=np.uint64(0)) if k == 0 else column
        width = max(1, (int(column.max()).bit_length() + 7) // 8) if n else 1
        widths.append(width)
        out.append(np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return kind, part, n, bytes(widths) + _ZSTD.compress(b"".join(out), asbytes=True)


def _unpack(n: int, data: bytes, columns: int) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(_ZSTD.decompress(data[columns:], n * sum(data[:columns])), dtype=np.uint8), 0, []
    for k, width in enumerate(data[:columns]):
        column = np.zeros((n, 8), dtype=np.uint8)
        column[:, :width] = raw[at : at + n * width].reshape(width, n).T
        column = column.view("<u8").ravel()
        out.append(np.cumsum(column, dtype=np.uint64) if k == 0 else column)
        at += n * width
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """``np.argsort(keys, kind="stable")`` of whole numbers, by one sort of numbers that hold a key's upper bits and its place."""
    keys = keys.astype(np.uint64, copy=False)
    bits = len(keys).bit_length()
    lost = max(0, int(keys.max()).bit_length() + bits - 64) if len(keys) else 0
    both = np.sort(keys >> np.uint64(lost) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
    order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    if lost:
        ranked = keys[order]
        down = np.flatnonzero(ranked[1:] < ranked[:-1])
        if len(down):  # the keys that agree in their upper bits there are sorted by the rest
            upper = ranked >> np.uint64(lost)
            group = np.cumsum(np.diff(upper, prepend=upper[:1]) != 0)
            mixed = np.zeros(group[-1] + 1, dtype=bool)
            mixed[group[down]] = True
            own = np.flatnonzero(mixed[group])
            order[own] = order[own][np.argsort(ranked[own], kind="stable")]
    return order


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) of equal keys."""
    order = _order(key)
    ranked = key[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), ranked[1:] != ranked[:-1]]))


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(key, return_inverse=True)``."""
    order, starts = _runs(key)
    inverse = np.empty(len(key), dtype=np.int64)
    inverse[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    return key[order[starts]], inverse


class _Gather:
    """Columns under a 64-bit key, the last of which are summed; pieces merge once they outgrow what is merged."""

    def __init__(self, fixed: int, summed: int) -> None:
        self.fixed, self.size = fixed, 0
        self.held = [np.zeros(0, dtype=np.uint64) for _ in range(1 + fixed + summed)]
        self.pieces: list[list[np.ndarray]] = []

    def add(self, key: np.ndarray, *columns: np.ndarray) -> None:
        self.pieces.append([key, *columns])
        self.size += len(key)
        if self.size > max(HELD, len(self.held[0])):
            self.merge()

    def merge(self) -> list[np.ndarray]:
        if self.pieces:
            key, *columns = (np.concatenate(x) for x in zip(self.held, *self.pieces))
            order, starts = _runs(key)
            first = order[starts]
            self.held = [key[first], *(c[first] for c in columns[: self.fixed]), *(np.add.reduceat(c[order], starts) if len(starts) else c for c in columns[self.fixed :])]
            self.pieces, self.size = [], 0
        return self.held


def _save(path: str, *arrays: np.ndarray) -> None:
    """Each array below ``path``, complete or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for k, array in enumerate(arrays):
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as f:
            f.write(np.ascontiguousarray(array).tobytes())
        os.replace(f.name, f"{path}.{k}")


#: Files that a worker keeps mapped at a time, those used last; systems allow some 65,000.
MAPPINGS = 900
#: Instead of a range: the files of all ranges, joined.
ALL = -1


def _load(path: str, k: int, dtype: str) -> np.ndarray:
    name = f"{path}.{k}"
    return np.memmap(name, dtype=dtype, mode="r").view(np.ndarray) if os.path.exists(name) and os.path.getsize(name) else np.zeros(0, dtype=dtype)


def _put(path: str, at: int, array: np.ndarray) -> None:
    """``array`` from byte ``at`` on in a file that other tasks write elsewhere."""
    data, done = memoryview(np.ascontiguousarray(array).tobytes()), 0
    file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        while done < len(data):
            done += os.pwrite(file, data[done:], at + done)
    finally:
        os.close(file)


def _small(values: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, 255 standing for more; where those are, and what they are."""
    more = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype(np.uint8), more.astype("<i8"), values[more].astype("<i8")]


def _small_stats(stats: np.ndarray) -> list[np.ndarray]:
    """The same for four counts under each key, the first being their largest: the bytes of a key side by side."""
    more = np.flatnonzero(stats[0] >= 255)
    return [np.ascontiguousarray(np.minimum(stats, 255).astype(np.uint8).T), more.astype("<i8"), np.ascontiguousarray(stats[:, more].T.astype("<i8"))]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=_NAMES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """(part, its rows) of rows in the order of their part; the rows of one have to be read before the next is asked for."""
    rows = (row for batch in batches for row in batch.to_pylist())
    ahead = next(rows, None)

    def own(part: int) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead["part"] == part:
            row, ahead = ahead, next(rows, None)
            yield row

    while ahead is not None:
        part = ahead["part"]
        yield part, own(part)


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartition(min(parts, TASKS), "part").sortWithinPartitions("part")


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``SENT`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 100
        if size > SENT:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Token hashes of a slice of texts, each text closed by END."""
    for batch in doc_slices(batches, SLICE):
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
        words, counts = word_hashes(texts)
        yield np.insert(np.minimum(words, END - np.uint64(1)), np.cumsum(counts), END)


def _split(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places where sorted keys pass from one range of the hash space to the next."""
    return np.searchsorted(keys, np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, dtype=np.int64)


def _longer(context: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """The hash of a context and one more word."""
    word = word.astype(np.uint64) + np.uint64(1)
    return mixed_bits(word if context is None else context * np.uint64(0x9E3779B97F4A7C15) + word)


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    out = None
    for column in columns:
        out = _longer(out, column)
    return out


def _columns(ids: np.ndarray, ends: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """The n-grams of a stream of closed texts as columns of ids; ``start`` stands before each text."""
    begins = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(ids) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
    out = [ids]
    for back in range(1, order):
        column = np.full(len(ids), start, dtype=ids.dtype)
        inside = np.flatnonzero(place >= back)
        column[inside] = ids[inside - back]
        out.insert(0, column)
    return out


def _index_bits(n: float) -> int:
    """Upper bits of a hash that part ``n`` of them into entries of some eight."""
    return max(0, int(np.ceil(np.log2(max(1.0, n / 8)))))


def _entries(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def _placed(hashes: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in its entry of sorted hashes, from ``low`` up to ``high``; one more number follows the hashes."""
    # hashes are spread evenly, so the bits after the entry's tell about where one stands
    at = low + ((high - low) * (keys << np.uint64(bits) >> np.uint64(56)).astype(np.int64) >> 8)
    here, some = hashes[at], low < high
    for step, off in ((1, here < keys), (-1, here > keys)):
        left = np.flatnonzero(off & some)
        place, key, bound = at[left], keys[left], (high if step > 0 else low)[left]
        while len(left):
            place = place + step
            at[left] = place
            here = hashes[place]  # before the first hash comes the last place, which stands for none
            on = np.flatnonzero((place < bound) & (here < key) if step > 0 else (place >= bound) & (here > key))
            left, place, key, bound = left[on], place[on], key[on], bound[on]
    return at, (hashes[at] == keys) & (at >= low) & (at < high)


# ---- stores -------------------------------------------------------------------------------------


class Words:
    """The vocabulary: id = place in the sorted hashes; the start token has id V."""

    def __init__(self, path: str, sizes: np.ndarray, tokens: int, documents: int) -> None:
        self.path, self.sizes, self.tokens, self.documents = path, sizes, tokens, documents
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = max(len(sizes).bit_length() - 1, _index_bits(self.total))
        self._open: OrderedDict[tuple[str, int, int], np.ndarray] = OrderedDict()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": OrderedDict()}

    @property
    def total(self) -> int:
        return int(self.starts[-1])

    def array(self, name: str, part: int, k: int, dtype: str) -> np.ndarray:
        key = (name, part, k)
        if key not in self._open:
            self._open[key] = _load(f"{self.path}/{name}-{part}", k, dtype)
            if len(self._open) > MAPPINGS:
                self._open.popitem(last=False)  # its pages stay in the system's cache
        self._open.move_to_end(key)
        return self._open[key]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted, distinct hashes."""
        if not self.total:
            return np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        index, entry = self.array("words", ALL, 2, "<i8"), _entries(hashes, self.bits)
        ids, ok = _placed(self.array("words", ALL, 0, "<u8"), hashes, index[entry], index[entry + 1], self.bits)
        ids = np.where(ok, ids, -1)
        return ids, self.of("words", 1, ids)

    def join(self, part: int) -> None:
        """Put a range into its place in the files of all ranges, and remove its own files; a task that runs again finds it done."""
        own = [f for k in range(2) if os.path.exists(f := f"{self.path}/words-{part}.{k}")]
        last, goal, a = part == len(self.sizes) - 1, f"{self.path}/words-{ALL}", int(self.starts[part])
        entries = 1 << self.bits - (len(self.sizes).bit_length() - 1)
        if len(own) == 2 or self.total and not self.sizes[part]:
            keys, counts = (np.fromfile(f, dtype="<u8") for f in own) if own else (np.zeros(0, dtype="<u8"),) * 2
            starts = np.cumsum(np.append(0, np.bincount(_entries(keys, self.bits) - part * entries, minlength=entries)))
            _put(f"{goal}.0", a * 8, np.append(keys, np.zeros(int(last), dtype="<u8")))  # one more, that a search may read
            _put(f"{goal}.1", a * 8, counts)
            _put(f"{goal}.2", part * entries * 8, (starts[: entries + int(last)] + a).astype("<i8"))
        for f in own:
            os.remove(f)

    def of(self, name: str, k: int, ids: np.ndarray) -> np.ndarray:
        """What stands under ids (V and -1 have nothing) in arrays by word."""
        ids, values = ids.astype(np.int64), self.array(name, ALL, k, "<i8")
        if not len(values):
            return np.zeros(len(ids), dtype=np.int64)
        return np.where((ids >= 0) & (ids < self.total), values[np.clip(ids, 0, len(values) - 1)], 0)

    def hot(self, context: list[np.ndarray], least: int) -> np.ndarray:
        """Whether all words of a context occur more than ``least`` times."""
        out = np.ones(len(context[0]), dtype=bool)
        for ids in context:
            mine = np.flatnonzero(out)
            ids = ids[mine].astype(np.int64)
            out[mine] = np.where(ids == self.total, self.documents, self.of("words", 1, ids)) > least
        return out


def _parts(gram: np.ndarray, context: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The range of each n-gram: by its context, or by the whole n-gram if that is hot."""
    return (np.where(hot, gram, context) % np.uint64(parts)).astype(np.int64)


def _by_part(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The order of keys by range and within a range by key; ranges are small numbers, which are dealt out instead of compared."""
    order = _order(keys)
    small = part[order].astype(np.uint16 if not len(part) or part.max() < 1 << 16 else np.int64)
    return order[np.argsort(small, kind="stable")]


def _discounts(n: np.ndarray) -> np.ndarray:
    """0, D1, D2, D3+ from how many keys have counts 1 to 4; at least a little is taken where a count of counts is missing."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    ratio = lambda a, b: a / b if b else 0.0
    d = [1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))])


class Joined:
    """Where the ranges of a store lie in its files of all ranges: hashes, their counts, places and values of those that need more than a byte, and the index."""

    def __init__(self, sizes: np.ndarray, more: np.ndarray, width: int) -> None:
        self.bases, self.more = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (sizes, more))
        #: bytes of counts a hash; the upper bits of a hash that give its entry in the index
        self.width = width
        self.bits = _index_bits(self.bases[-1] / len(sizes))

    def write(self, path: str, name: str, part: int, sources: list[str]) -> None:
        """Put a range into its place. Once that is done the range's own files go; a task that runs again finds it done."""
        n, more = (int(x[part + 1] - x[part]) for x in (self.bases, self.more))
        goal, done = f"{path}/{name}-{ALL}", f"{path}/{name}-{part}.done"
        if self.bases[-1] and not os.path.exists(done):
            files = [[f"{path}/{x}-{part}.{k}" for k in range(4)] for x in sources if os.path.exists(f"{path}/{x}-{part}.0")]
            read = [[np.fromfile(f, dtype=t) for f, t in zip(own, ("<u8", "|u1", "<i8", "<i8"))] for own in files]
            keys, counts, where, values = (np.concatenate([np.zeros(0, dtype=t), *(x[k] for x in read)]) for k, t in enumerate(("<u8", "|u1", "<i8", "<i8")))
            if (len(keys), len(where)) != (n, more):
                raise RuntimeError(f"range {part} of {name} is not whole: another run of this task is putting it in place")
            counts, values = counts.reshape(-1, self.width), values.reshape(-1, self.width)
            if len(read) > 1:
                where[len(read[0][2]) :] += len(read[0][0])
                order = _order(keys)
                keys, counts, place = keys[order], counts[order], np.empty(n, dtype=np.int64)
                place[order] = np.arange(n)
                by_place = np.argsort(place[where])
                where, values = place[where][by_place], values[by_place]
            last = part == len(self.bases) - 2
            _put(f"{goal}.0", int(self.bases[part]) * 8, np.append(keys, np.zeros(int(last), dtype="<u8")))  # one more, that a search may read
            _put(f"{goal}.1", int(self.bases[part]) * self.width, counts)
            _put(f"{goal}.2", int(self.more[part]) * 8, where + self.bases[part])
            _put(f"{goal}.3", int(self.more[part]) * 8 * self.width, values)
            ends = np.cumsum(np.bincount(_entries(keys, self.bits), minlength=1 << self.bits))
            _put(f"{goal}.4", part * ((1 << self.bits) + 1) * 4, np.concatenate([[0], ends]).astype("<u4"))
            open(done, "w").close()
            for f in (f for own in files for f in own):
                if os.path.exists(f):
                    os.remove(f)


def _each(spark: SparkSession, parts: int, work) -> dict[int, np.ndarray]:
    """The whole numbers that ``work`` gives for each range, from tasks over the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batched((_TOTALS, part, 0, np.array(work(part), dtype="<i8").tobytes()) for part in batch.column(0).to_pylist())

    return {r["part"]: np.frombuffer(r["data"], dtype="<i8") for r in spark.range(0, parts, 1, min(-(-parts // 8), TASKS)).mapInArrow(run, PACKED).collect()}  # a row for each range


def _joined(spark: SparkSession, path: str, order: int, parts: int) -> dict[str, Joined]:
    """Joins the ranges' files of all stores above words."""
    sources = {f"{name}{k}": own for k in range(2, order + 1) for name, own in (("grams", [f"grams{k}"]), ("contexts", [f"contexts{k}", f"hot{k}"]))}

    def sizes(part: int) -> list[int]:
        size = lambda name, k: os.path.getsize(f) if os.path.exists(f := f"{path}/{name}-{part}.{k}") else 0
        return [sum(size(x, k) for x in own) // 8 for own in sources.values() for k in (0, 2)]

    found = _each(spark, parts, sizes)
    table = np.stack([found[part] for part in range(parts)])
    stores = {name: Joined(table[:, 2 * k], table[:, 2 * k + 1], 1 if name.startswith("grams") else 4) for k, name in enumerate(sources)}

    def write(part: int) -> list[int]:
        for name, own in sources.items():
            stores[name].write(path, name, part, own)
        return []

    _each(spark, parts, write)
    return stores


class Model:
    def __init__(self, words: Words, order: int, keep_from: int, parts: int, hot: int, discounts: dict[int, np.ndarray], low_total: int, low_gamma: float, stores: dict[str, Joined]) -> None:
        self.words, self.order, self.keep_from, self.parts, self.hot = words, order, keep_from, parts, hot
        self.discounts, self.low_total, self.low_gamma, self.stores = discounts, low_total, low_gamma, stores

    def _found(self, name: str, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """(len(keys), counts a hash) under hashes of ranges; 0 where there are none."""
        store, own = self.stores[name], lambda k, dtype: self.words.array(name, ALL, k, dtype)
        out = np.zeros((len(keys), store.width), dtype=np.int64)
        if not store.bases[-1]:
            return out
        hashes, index = own(0, "<u8"), own(4, "<u4")
        slot, base = part * ((1 << store.bits) + 1) + _entries(keys, store.bits), store.bases[part]
        low, high = base + index[slot], base + index[slot + 1]
        at, ok = _placed(hashes, keys, low, high, store.bits)
        ok = np.flatnonzero(ok)
        at = at[ok]
        values = own(1, "|u1").reshape(-1, store.width)[at].astype(np.int64)
        many = np.flatnonzero(values[:, 0] == 255)
        if len(many):
            values[many] = own(3, "<i8").reshape(-1, store.width)[np.searchsorted(own(2, "<i8"), at[many])]
        out[ok] = values
        return out

    def score(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base, log10 p) of every token of a stream of closed texts."""
        w = self.words
        distinct, inverse = _distinct(hashes)
        ids, counts = w.ids(distinct)
        base = np.log10((counts + 1) / (w.tokens + w.total + 1))
        before, low = w.of("before", 0, ids), self.discounts[1]
        p = (np.maximum(before - low[np.minimum(before, 3)], 0) / max(1, self.low_total) + self.low_gamma / (w.total + 1))[inverse]
        often = np.append(counts, w.documents) > self.hot
        frequent = _columns(inverse, hashes == END, self.order, len(distinct))
        with_start = np.append(ids, w.total)
        columns = [with_start[c] for c in frequent]
        for k in range(2, self.order + 1):
            context = columns[self.order - k : -1]
            if k == 2:  # one word: the distinct ones and the start
                seen, back = np.flatnonzero(context[0] >= 0), frequent[-2]
                key = _hashed([with_start])
                stats = self._context(k, key)
                key, stats = key[back[seen]], stats[:, back[seen]]
            else:
                seen = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in context]))
                key = _hashed([c[seen] for c in context])
                stats = self._context(k, key)
            gamma, total = stats
            p[seen] *= gamma
            # words after contexts that are there
            pair = np.flatnonzero((total > 0) & (columns[-1][seen] >= 0))
            at = seen[pair]
            hot = np.logical_and.reduce([often[c[at]] for c in frequent[self.order - k : -1]])
            gram, d = _longer(key[pair], columns[-1][at]), self.discounts[k]
            n = self._found(f"grams{k}", gram, _parts(gram, key[pair], hot, self.parts))[:, 0]
            p[at] += np.maximum(n - d[np.minimum(n, 3)], 0) / total[pair]
        return (counts > 0)[inverse], base[inverse], np.log10(p)

    def _context(self, k: int, key: np.ndarray) -> np.ndarray:
        """(g, all n-grams) of contexts."""
        total, n1, n2, n3 = self._found(f"contexts{k}", key, (key % np.uint64(self.parts)).astype(np.int64)).T
        d = self.discounts[k]
        top = (1.0 if k == self.order and self.keep_from > 1 else d[1]) * n1 + d[2] * n2 + d[3] * n3
        return np.stack([np.where(total > 0, top / np.maximum(total, 1), 1.0), total])


# ---- building -----------------------------------------------------------------------------------


def _power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def count_words(texts: DataFrame, path: str, chars: int, chars_per_part: int = 32_000_000) -> Words:
    """The vocabulary store of ``texts``."""
    parts = _power_of_two(chars / chars_per_part)
    bits = parts.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gather(0, 1)
        for stream in _streams(batches):
            held.add(*np.unique(stream, return_counts=True))
            if len(held.held[0]) > HELD // 2:
                yield from send(held.merge())
                held = _Gather(0, 1)
        yield from send(held.merge())

    def send(merged: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = [0, *_split(merged[0], bits), len(merged[0])]
        yield from _batched(_pack(_GRAMS, part, merged[0][a:b], merged[1][a:b]) for part, (a, b) in enumerate(zip(edges, edges[1:])) if a < b)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches):
            gathered = _Gather(0, 1)
            for row in rows:
                gathered.add(*_unpack(row["n"], row["data"], 2))
            keys, counts = gathered.merge()
            _save(f"{path}/words-{part}", keys.astype("<u8"), counts.astype("<i8"))
            yield _rows([(_TOTALS, part, len(keys), np.array([counts.sum(), counts[keys == END].sum()], dtype="<i8").tobytes())])

    sizes, tokens, documents = np.zeros(parts, dtype=np.int64), 0, 0
    for row in _dealt(texts.mapInArrow(count, PACKED), parts).mapInArrow(store, PACKED).collect():  # a row for each range
        sizes[row["part"]] = row["n"]
        n, ends = np.frombuffer(row["data"], dtype="<i8")
        tokens, documents = tokens + int(n), documents + int(ends)
    words = Words(path, sizes, tokens, documents)

    def join(part: int) -> list[int]:
        words.join(part)
        return []

    _each(texts.sparkSession, parts, join)
    return words


def count_grams(texts: DataFrame, words: Words, order: int, keep_from: int, grams_per_part: int, hot: int | None) -> Model:
    """The stores of all orders above one and what stands before each word: a :class:`Model`."""
    parts = max(1, -(-words.tokens // grams_per_part))
    hot = hot if hot is not None else max(1000, grams_per_part // 4)
    path = words.path

    def sent(columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams, packed by range; words (n-grams of one) by their own."""
        if len(columns) == 1:
            part = np.searchsorted(words.starts, columns[0].astype(np.int64), "right") - 1
        else:
            context = _hashed(columns[:-1])
            part = _parts(_longer(context, columns[-1]), context, words.hot(columns[:-1], hot), parts)
        if len(columns) > 1 and words.total < (1 << 32) - 1:  # two words make one key
            place = _by_part(columns[0] * np.uint64(words.total + 1) + columns[1], part)
        else:
            place = _by_part(columns[0], part) if len(columns) == 1 else np.lexsort((columns[1], columns[0], part))
        part, columns, n = part[place], [c[place] for c in columns], n[place]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        yield from _batched(_pack(_GRAMS, int(part[a]), *(c[a:b] for c in columns), n[a:b]) for a, b in zip(edges, edges[1:]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gather(order, 1)
        for stream in _streams(batches):
            distinct, inverse = _distinct(stream)
            columns = _columns(words.ids(distinct)[0][inverse].astype(np.uint64), stream == END, order, words.total)
            held.add(_hashed(columns), *columns, np.ones(len(stream), dtype=np.uint64))
            if len(held.held[0]) > HELD // 2:
                _, *columns, n = held.merge()
                held = _Gather(order, 1)
                yield from sent(columns, n)
        _, *columns, n = held.merge()
        yield from sent(columns, n)

    def merged(k: int):
        """Works through the ranges of order ``k``: writes its files and sends on what it adds to the next lower order."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _groups(batches):
                pieces, stats = [], _Gather(0, 4)
                for row in rows:
                    if row["kind"] == _TOTALS:
                        yield _rows([(_TOTALS, 0, row["n"], row["data"])])
                    elif row["kind"] == _HOT:
                        stats.add(*_unpack(row["n"], row["data"], 5))
                    else:
                        pieces.append(_unpack(row["n"], row["data"], k + 1))
                yield from hot_stored(k + 1, part, stats)
                if pieces:
                    *columns, n = (np.concatenate(x) for x in zip(*pieces))
                    del pieces
                    yield from stored(k, part, columns, n)

        return work

    def hot_stored(k: int, part: int, stats: _Gather) -> Iterator[pa.RecordBatch]:
        key, *values = stats.merge()
        if len(key):
            _save(f"{path}/hot{k}-{part}", key.astype("<u8"), *_small_stats(np.stack(values).astype(np.int64)))
        return iter(())

    def stored(k: int, part: int, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram = _hashed(columns)
        place, starts = _runs(gram)
        n = np.add.reduceat(n[place], starts).astype(np.int64)
        first = place[starts]
        columns, gram = [c[first] for c in columns], gram[first]
        yield _rows([(_TOTALS, 0, k, np.array([*((n == i).sum() for i in (1, 2, 3, 4)), 0, 0], dtype="<i8").tobytes())])
        least = keep_from if k == order else 1
        kept = np.flatnonzero(n >= least)
        _save(f"{path}/grams{k}-{part}", gram[kept].astype("<u8"), *_small(n[kept]))
        context = _hashed(columns[:-1])
        by_context, begins = _runs(context)
        of_one, heads = n[by_context], by_context[begins]
        stats = np.stack([np.add.reduceat(x.astype(np.int64), begins) for x in (of_one, of_one == 1, of_one == 2, of_one >= 3)])
        some = np.add.reduceat((of_one >= least).astype(np.int64), begins) > 0
        context, is_hot = context[heads], words.hot([c[heads] for c in columns[:-1]], hot)
        cold = np.flatnonzero(~is_hot & some)
        _save(f"{path}/contexts{k}-{part}", context[cold].astype("<u8"), *_small_stats(stats[:, cold]))
        warm = np.flatnonzero(is_hot)
        if len(warm):
            key, values = context[warm], stats[:, warm]
            to = (key % np.uint64(parts)).astype(np.int64)
            by_part = _by_part(key, to)
            edges = np.flatnonzero(np.diff(to[by_part], prepend=-1, append=-1))
            yield from _batched(_pack(_HOT, int(to[mine[0]]), key[mine], *(v[mine] for v in values)) for mine in (by_part[a:b] for a, b in zip(edges, edges[1:])))
        # what stands before the rest of each n-gram; after the start token the count itself
        rest = columns[1:]
        adds = np.where(rest[0].astype(np.int64) == words.total, n, 1).astype(np.uint64)
        gathered = _Gather(k - 1, 1)
        gathered.add(_hashed(rest), *rest, adds)
        _, *rest, adds = gathered.merge()
        yield from sent(rest, adds)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches):
            before, stats = None, _Gather(0, 4)
            for row in rows:
                if row["kind"] == _TOTALS:
                    yield _rows([(_TOTALS, 0, row["n"], row["data"])])
                elif row["kind"] == _HOT:
                    stats.add(*_unpack(row["n"], row["data"], 5))
                else:
                    before = np.zeros(words.sizes[part], dtype=np.int64) if before is None else before
                    ids, n = _unpack(row["n"], row["data"], 2)
                    np.add.at(before, ids.astype(np.int64) - words.starts[part], n.astype(np.int64))
            yield from hot_stored(2, part, stats)
            if before is not None:
                _put(f"{path}/before-{ALL}.0", int(words.starts[part]) * 8, before.astype("<i8"))
                yield _rows([(_TOTALS, 0, 1, np.array([*((before == i).sum() for i in (1, 2, 3, 4)), (before >= 3).sum(), before.sum()], dtype="<i8").tobytes())])

    packed = texts.mapInArrow(count, PACKED)
    for k in range(order, 1, -1):
        packed = _dealt(packed, parts).mapInArrow(merged(k), PACKED)
    totals = {k: np.zeros(6, dtype=np.int64) for k in range(1, order + 1)}
    for row in _dealt(packed, max(parts, len(words.sizes))).mapInArrow(settled, PACKED).groupBy("n", "data").count().collect() if order > 1 else ():  # at most a row for each range and order
        totals[row["n"]] += np.frombuffer(row["data"], dtype="<i8") * row["count"]
    discounts = {k: _discounts(n[:4]) for k, n in totals.items()}
    low, d = totals[1], discounts[1]
    gamma = float(d[1] * low[0] + d[2] * low[1] + d[3] * low[4]) / int(low[5]) if low[5] else 1.0
    return Model(words, order, keep_from, parts, hot, discounts, int(low[5]), gamma, _joined(texts.sparkSession, path, order, parts))


def train(texts: DataFrame, order: int = 3, keep_from: int | None = None, grams_per_part: int = 2_000_000, hot: int | None = None, chars_per_part: int = 32_000_000) -> Model:
    """A model of the column ``text``; its stores are below the session's shared folder."""
    if not 2 <= order <= 5:
        raise ValueError("the order is 2 to 5")
    spark = texts.sparkSession
    small_batches(spark)
    texts = texts.select("text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    words = count_words(texts, posix_path(shared_dir(spark)), int(chars), chars_per_part)
    return count_grams(texts, words, order, keep_from or (2 if order > 2 else 1), grams_per_part, hot)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # paths and totals; the arrays stay in files

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in doc_slices(batches, SLICE):
            (stream,) = _streams(iter([batch]))
            ends = np.flatnonzero(stream == END)
            starts = np.concatenate([[0], ends[:-1] + 1])
            sums = [np.add.reduceat(np.asarray(x, dtype=float), starts) if len(ends) else np.zeros(0) for x in m.score(stream)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(ends - starts[: len(ends)] + 1, pa.int64()), pa.array(sums[0].astype(np.int64)), *(pa.array(x) for x in sums[1:])],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
