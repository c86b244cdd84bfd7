"""Line dedup: two Bloom filters find suspected repeats, only those shuffle for an exact count.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Pass one
sets a once-seen filter A and a twice-seen filter B: tasks send the places of their own keys' bits, packed, to slices of
the filters, where two tasks merge by ``B = B1 | B2 | (A1 & A2)``, ``A = A1 | A2``. A key whose bits are all set in B *may* be in two
documents; one that lacks a bit is in one only and never leaves its task. Pass two sends the
suspects' 128-bit digests to an exact document count. Pass three drops lines.

The filters have ``BITS_A_LINE`` bits for each line of the corpus, which are counted first, and a key sets ``HASHES`` of
them. They end at ``max_bits``, so what is broadcast is at most 128 MB: beyond some 90 million lines a fuller filter
makes more suspects, in the end a digest for every line, and nothing is lost. The confirmed keys are broadcast while they are below
``broadcast_keys``; above that their documents get them by a join on the digest and then on the row.

Cases: a null or empty text is one empty line (kept); the empty key counts only if ``min_chars`` is
0; a key repeated within one document counts once; an empty table gives an empty result; repeated
rows (same ``doc_id``) are documents of their own; with ``keep_first`` rows that share the first document's
``doc_id`` keep the line each, and so does every row where none has a ``doc_id``; other columns pass through untouched, whatever
their names, but columns named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import small_batches, staged

BITS_A_LINE = 12
#: bits a key sets in a filter
HASHES = 3
#: bits of a slice of the filters, as a power of two; small filters have 16 slices
SLICE_BITS = 24
#: keys a task holds before it sends their places
HELD = 2_000_000
#: stands for no doc_id
NO_DOC = -(2**63)


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line; bytes.strip() and bytes.lower() take exactly ASCII's white space and A-Z."""
    return [line.strip().lower() for line in text.split(b"\n")]


def _digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of each key's 128-bit hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _bits(digests: np.ndarray, log_bits: int) -> np.ndarray:
    """(n, HASHES) bit places of each digest."""
    step = digests[:, 1] | np.uint64(1)
    return np.stack([((digests[:, 0] + np.uint64(i) * step) >> np.uint64(64 - log_bits)).astype(np.int64) for i in range(HASHES)], axis=1)


def _counted_keys(text: bytes | None, min_chars: int) -> list[bytes]:
    """The distinct keys of one document that can be dropped."""
    found = set(line_keys(text or b""))
    if min_chars <= 1:
        return list(found if min_chars <= 0 else found - {b""})
    return [k for k in found if len(k.decode("utf-8", "replace")) >= min_chars]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _packed(places: np.ndarray) -> bytes:
    """Places in order, as differences."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def build_filter(documents: DataFrame, min_chars: int, log_bits: int) -> np.ndarray:
    """The twice-seen filter over all documents, eight bits a byte."""
    slices = max(16, 2 ** (log_bits - SLICE_BITS))
    per_slice = 2**log_bits // slices

    def send(digests: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(digests).view("V16").ravel(), return_counts=True)
        bits = _bits(keys.view("<u8").reshape(-1, 2), log_bits)
        once, twice = np.unique(bits), np.unique(bits[n > 1])
        edges = np.arange(slices + 1) * per_slice
        a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        own = [i for i in range(slices) if a[i] < a[i + 1]]
        parts = [[_packed(x[at[i] : at[i + 1]] - i * per_slice) for i in own] for x, at in ((once, a), (twice, b))]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], names=["slice", "once", "twice"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, held = [], 0
        for batch in batches:
            keys = [k for t in _texts(batch) for k in _counted_keys(t, min_chars)]
            if keys:
                digests.append(_digests(keys))
                held += len(keys)
            if held > HELD:
                yield from send(digests)
                digests, held = [], 0
        if held:
            yield from send(digests)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                a, b = held.setdefault(row["slice"], (np.zeros(per_slice, dtype=bool), np.zeros(per_slice, dtype=bool)))
                once = _unpacked(row["once"])
                b[once[a[once]]] = True
                b[_unpacked(row["twice"])] = True
                a[once] = True
        for i, (_, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(np.packbits(b).tobytes(), 1)], pa.binary())], names=["slice", "twice"])

    parts = documents.select("text").mapInArrow(mark, "slice int, once binary, twice binary").repartition(slices, "slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(2**log_bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # at most 2 ** log_bits bits in all
        out[row["slice"] * per_slice // 8 : (row["slice"] + 1) * per_slice // 8] = np.frombuffer(zlib.decompress(row["twice"]), dtype=np.uint8)
    return out


def repeated_keys(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, max_bits: int = 2**30) -> DataFrame:
    """Digest halves, document count and first document of every key found in ``min_docs`` documents or more."""
    spark = documents.sparkSession
    small_batches(spark)
    lines = documents.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    log_bits = int(min(max_bits, max(2**16, BITS_A_LINE * int(lines))) - 1).bit_length()
    packed = spark.sparkContext.broadcast(build_filter(documents, min_chars, log_bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = packed.value
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), _texts(batch)):
                own = _counted_keys(text, min_chars)
                keys += own
                ids += [doc_id] * len(own)
            if not keys:
                continue
            digests = _digests(keys)
            bits = _bits(digests, log_bits)
            hit = (twice[bits >> 3] >> (7 - (bits & 7)) & 1).all(axis=1)
            halves = digests[hit].astype("<u8").view("<i8")
            yield pa.RecordBatch.from_pydict({"h1": pa.array(halves[:, 0]), "h2": pa.array(halves[:, 1]), "doc_id": pa.array([d for d, x in zip(ids, hit) if x], pa.int64())})

    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(suspects, "h1 long, h2 long, doc_id long")
    return found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= min_docs)


def _rewritten(documents: DataFrame, drops: Iterator, keep_first: bool, extra: str) -> DataFrame:
    """``documents`` with new text and counts; ``drops(batch)`` gives a test of digests for each of its rows."""
    kept = [f for f in documents.schema.fields if f.name not in ("text", "__drop", "__text", "__n_lines", "__n_dropped", "__sha256")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, test = _texts(batch), drops(batch)
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out, n_lines, n_dropped, digest = [], [], [], []
            per_doc = [line_keys(t or b"") for t in texts]
            flat = [k for keys in per_doc for k in keys]
            hits, firsts = test(flat, np.repeat(np.arange(len(texts)), [len(k) for k in per_doc]))
            at = 0
            for doc_id, text, keys in zip(ids, texts, per_doc):
                hit, first = hits[at : at + len(keys)], firsts[at : at + len(keys)]
                at += len(keys)
                lines = (text or b"").split(b"\n")
                if hit.any():
                    if keep_first:
                        seen: set[bytes] = set()
                        for i in np.flatnonzero(hit):
                            if keys[i] not in seen and first[i] == (NO_DOC if doc_id is None else doc_id):
                                hit[i] = False
                            seen.add(keys[i])
                    body = b"\n".join(x for x, h in zip(lines, hit) if not h)
                else:
                    body = text or b""
                out.append(body)
                n_lines.append(len(keys))
                n_dropped.append(int(hit.sum()))
                digest.append(hashlib.sha256(body).hexdigest())
            own = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept}
            yield pa.RecordBatch.from_arrays(
                [*own.values(), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())],
                names=[*own, "__text", "__n_lines", "__n_dropped", "__sha256"],
            )

    return documents.mapInArrow(rewrite, f"{schema}, {extra}")


def drop_repeated_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_keys: int = 2_000_000, max_bits: int = 2**30) -> DataFrame:
    """Every document without the lines whose key is in ``min_docs`` documents or more.

    With ``keep_first`` the first line of such a key in its first document (lowest ``doc_id``)
    stays. Returns the columns of ``documents`` besides ``text``, then ``__text``, ``__n_lines``,
    ``__n_dropped`` and ``__sha256`` of the kept text.
    """
    spark = documents.sparkSession
    keys = staged(repeated_keys(documents, min_docs, min_chars, max_bits), "line_keys")
    extra = "`__text` string, `__n_lines` long, `__n_dropped` long, `__sha256` string"
    if keys.limit(broadcast_keys + 1).count() <= broadcast_keys:
        rows = keys.select("h1", "h2", F.coalesce("first_doc", F.lit(NO_DOC)).alias("first_doc")).toPandas()  # at most broadcast_keys rows of 24 bytes
        table = np.ascontiguousarray(rows[["h1", "h2"]].to_numpy(dtype="<i8")).view("<u8")
        order = np.lexsort((table[:, 1], table[:, 0]))
        first = rows["first_doc"].to_numpy(dtype="int64")[order]
        shared = spark.sparkContext.broadcast((table[order], first))

        def drops(batch: pa.RecordBatch):
            table, first = shared.value
            return lambda keys, _: _lookup(keys, table, first)

        return _rewritten(documents, drops, keep_first, extra)
    return _rewritten(_with_own_keys(documents, keys, min_chars), _own_keys_test, keep_first, extra)


def _lookup(keys: list[bytes], table: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted digest table, and their first documents."""
    hit, firsts = np.zeros(len(keys), dtype=bool), np.full(len(keys), NO_DOC, dtype="int64")
    if keys and len(table):
        digests = _digests(keys)
        at = np.minimum(np.searchsorted(table[:, 0], digests[:, 0]), len(table) - 1)
        near = np.flatnonzero(table[at, 0] == digests[:, 0])
        for i in near:
            j = at[i]
            while j < len(table) and table[j, 0] == digests[i, 0]:
                if table[j, 1] == digests[i, 1]:
                    hit[i], firsts[i] = True, first[j]
                    break
                j += 1
    return hit, firsts


def _with_own_keys(documents: DataFrame, keys: DataFrame, min_chars: int) -> DataFrame:
    """``documents`` with an array ``__drop`` of the confirmed keys each row holds, found by a join on the digest."""
    numbered = staged(documents.withColumn("__row", F.expr("uuid()")), "numbered")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, text in zip(batch.column(batch.schema.get_field_index("__row")).to_pylist(), _texts(batch)):
                found = _counted_keys(text, min_chars)
                keys += found
                rows += [row] * len(found)
            if keys:
                halves = _digests(keys).view("<i8")
                yield pa.RecordBatch.from_pydict({"h1": pa.array(halves[:, 0]), "h2": pa.array(halves[:, 1]), "__row": pa.array(rows, pa.string())})

    lists = numbered.select("__row", "text").mapInArrow(own, "h1 long, h2 long, `__row` string").join(keys, ["h1", "h2"]).groupBy("__row").agg(F.collect_list(F.struct("h1", "h2", "first_doc")).alias("__drop"))
    return numbered.join(lists, "__row", "left").drop("__row")


def _own_keys_test(batch: pa.RecordBatch):
    tables = []
    for entries in batch.column(batch.schema.get_field_index("__drop")).to_pylist():
        tables.append({np.array([e["h1"], e["h2"]], dtype="<i8").tobytes(): NO_DOC if e["first_doc"] is None else e["first_doc"] for e in entries or []})

    def test(keys: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [tables[r].get(xxhash.xxh3_128_digest(k)) for k, r in zip(keys, rows)]
        return np.array([f is not None for f in found], dtype=bool), np.array([NO_DOC if f is None else f for f in found], dtype="int64")

    return test
