"""Target-distribution importance resampling: documents that look like a target corpus are drawn more often.

Features are the runs of one to ``max_n`` consecutive words of a text, repeats counted; a feature
falls into the bucket crc32(its UTF-8 bytes) modulo ``buckets``. Two passes over Arrow batches: the
first counts buckets with ``np.bincount`` into one vector for each partition, which ``treeReduce``
merges on the executors; the second gathers each feature's gain from the broadcast vector of gains
and sums a document's gains with ``bincount`` weights. Scores get Gumbel noise from a hash of the
document's id, so the highest scores are a draw without replacement in proportion to the importance
weights, and every rerun draws the same documents.

Ranks come from one range sort that is written once, each row with its place in its partition; the
first rank of a partition is the number of rows in those before it. No row number runs over all rows
in one task, and no score, id or text has to fit into one task, as the last sort key is unique.

Bounds: the vectors have ``buckets`` numbers whatever the input; treeReduce leaves at most some 30 of
them to the driver. One row of counts for each partition of the sort is broadcast. A task holds the words of
about one megabyte of text at a time, however long a text is.

Cases: a null or empty text has no features, weight 0, and is not drawn; a null id counts as the empty
string in the noise and comes last among ties; repeated rows are each scored and ranked, rows equal in score
and id in a fixed order; an empty target has no counts, so features rare in the documents gain most; an
empty table gives an empty result; columns named like the results are replaced, others are kept or not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import doc_slices, small_batches, staged
from vitrine.llm.toxicity import _FOLD

#: Bytes of text whose words a task holds at a time.
SLICE = 1 << 20
#: Vectors that one task of the merging tree adds up, about.
FAN_IN = 16
#: What :func:`weighted` adds to a row.
ADDED = ("imp_features", "imp_words", "imp_weight")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``SLICE`` bytes at a time."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + SLICE) if len(folded) - start > SLICE else -1
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def _runs(words: list[bytes], owners: np.ndarray, old: int, buckets: int, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, bucket) of every run that ends behind the first ``old`` words."""
    codes = list(map(crc32, words))
    for n in range(1, max_n + 1):
        if n > 1:
            codes = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), codes)))
        first = max(0, old - n + 1)
        found = np.array(codes[first:], dtype=np.int64) % buckets
        whole = owners[first : len(words) - n + 1] == owners[first + n - 1 :]
        yield owners[first + n - 1 :][whole], found[whole]


def features(texts: Iterable[bytes], buckets: int, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length of the runs, owners, buckets) of all runs of the texts, bounded piece by piece; the owner is the text's number."""
    words: list[bytes] = []
    owners: list[int] = []
    held, old = 0, 0

    def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n, (who, bucket) in enumerate(_runs(words, np.array(owners, dtype=np.int64), old, buckets, max_n), 1):
            yield n, who, bucket

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            words += piece
            owners += [i] * len(piece)
            held += sum(map(len, piece)) + len(piece)
            if held >= SLICE:
                yield from flush()
                old = min(len(words), max_n - 1)
                words, owners, held = words[len(words) - old :], owners[len(owners) - old :], 0
    if len(words) > old:
        yield from flush()


def _texts(part: pa.RecordBatch, text: str) -> Iterator[bytes]:
    for x in part.column(part.schema.get_field_index(text)).cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_counts(docs: DataFrame, buckets: int = 10_000, max_n: int = 2, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in doc_slices(batches, SLICE, text):
            for _, _, bucket in features(_texts(part, text), buckets, max_n):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.record_batch({"counts": pa.array([total.tobytes()], type=pa.binary())})

    small_batches(docs.sparkSession)
    vectors = docs.select(F.col(text)).mapInArrow(counted, "counts binary").rdd.map(lambda row: np.frombuffer(bytes(row[0]), dtype=np.int64))
    partitions = vectors.getNumPartitions()
    if not partitions:
        return np.zeros(buckets, dtype=np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(partitions) / math.log(FAN_IN))))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of a bucket's share in the target and in the source."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, max_n: int = 2, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with the number of features, the number of words and the floored mean gain of each text."""
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64))
    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("imp_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for part in doc_slices(batches, SLICE, "imp_text"):
            n_features, n_words, sums = (np.zeros(part.num_rows, dtype=kind) for kind in (np.int64, np.int64, np.float64))
            for n, owner, bucket in features(_texts(part, "imp_text"), len(gain), max_n):
                here = np.bincount(owner, minlength=part.num_rows)
                n_features += here
                if n == 1:
                    n_words += here
                sums += np.bincount(owner, weights=gain[bucket], minlength=part.num_rows)
            found = [n_features, n_words, sums.astype(np.int64) // np.maximum(n_features, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, found)], names=[*kept, *ADDED])

    schema = T.StructType([*read.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in ADDED]])
    return read.mapInArrow(scored, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel draw), from the first 32 bits of sha256(``seed:doc_id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(uniform)))


def gains_for(docs: DataFrame, target: DataFrame, buckets: int = 10_000, max_n: int = 2, text: str = "text") -> np.ndarray:
    """The gains of all buckets, from two corpora."""
    return bucket_gains(bucket_counts(docs, buckets, max_n, text), bucket_counts(target, buckets, max_n, text))


def range_ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (columns of a bounded size) with ``imp_place``, 1, 2, 3... in ``order``, by a range sort over all tasks."""
    numbered = staged(rows.withColumn("imp_row", F.monotonically_increasing_id()), "rows")
    by = [*order, F.col("imp_row")]
    placed = staged(numbered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("imp_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("imp_at", 33).alias("imp_part")
    before = Window.orderBy("imp_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).count().select("imp_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("imp_before"))
    joined = placed.withColumn("imp_part", part).join(F.broadcast(counts), "imp_part")
    return joined.withColumn("imp_place", F.col("imp_before") + F.col("imp_at").bitwiseAND((1 << 33) - 1) + 1).drop("imp_part", "imp_before", "imp_at", "imp_row")


def ranked(docs: DataFrame, target: DataFrame, share: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000, max_n: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, imp_features, imp_words, imp_weight, imp_score, imp_rank) of every document.

    Of the documents with ``min_words`` words or more ``share`` percent are drawn, rounded down; ranks
    are 1, 2, 3... from the highest score down, smaller ids first among ties, null for those not drawn.
    """
    numbers = weighted(docs, gains_for(docs, target, buckets, max_n, text), max_n, text, [doc_id])
    scores = numbers.withColumns({"imp_score": F.col("imp_weight") + noise(F.col(doc_id), seed), "imp_fit": F.col("imp_words") >= min_words})
    placed = range_ranked(scores, [F.desc("imp_fit"), F.desc("imp_score"), F.asc_nulls_last(doc_id)])
    quota = placed.where("imp_fit").count() * share // 100
    drawn = F.col("imp_fit") & (F.col("imp_place") <= quota)
    return placed.select(doc_id, *ADDED, "imp_score", F.when(drawn, F.col("imp_place")).alias("imp_rank"))


def resampled(docs: DataFrame, target: DataFrame, share: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000, max_n: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn documents, whole, with ``imp_weight`` and ``imp_score``; rows equal to the last drawn one in score and id all stay.

    The draw ends at one (score, id), so texts are scored a second time and filtered where they lie instead of being joined.
    """
    gains = gains_for(docs, target, buckets, max_n, text)
    score = F.col("imp_weight") + noise(F.col(doc_id), seed)
    scores = weighted(docs, gains, max_n, text, [doc_id]).where(F.col("imp_words") >= min_words).withColumn("imp_score", score)
    placed = range_ranked(scores, [F.desc("imp_score"), F.asc_nulls_last(doc_id)])
    last = placed.where(F.col("imp_place") == placed.count() * share // 100).select(F.col("imp_score").alias("s"), F.col(doc_id).alias("d")).first()
    whole = weighted(docs, gains, max_n, text).withColumn("imp_score", score)
    if last is None:
        return whole.where("false").select(*docs.columns, "imp_weight", "imp_score")
    upto = F.lit(True) if last.d is None else F.coalesce(F.col(doc_id) <= last.d, F.lit(False))
    drawn = (F.col("imp_score") > last.s) | ((F.col("imp_score") == last.s) & upto)
    return whole.where((F.col("imp_words") >= min_words) & drawn).select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*ADDED, "imp_score")], "imp_weight", "imp_score")
