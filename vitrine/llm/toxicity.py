"""Toxicity by maximum-scoring segments over token log-odds.

Fit: words of labelled documents and their first ``PREFIXES`` characters (stems) are counted by
class in Spark, once a document. The score of a word or stem is its log-odds between the classes with
an informative Dirichlet prior (``prior_share`` of the pooled counts), if that is ``min_z`` standard
deviations or more from 0. A token scores as its word or else as its longest listed stem; all other
tokens share one negative score, the drift, so that a clean text's expected score is negative.

Scan: one linear pass finds every maximal-scoring segment of a text (Ruzzo and Tompa's all-maximal
scheme). Under the clean model segment scores have an extreme-value tail, ``P(max >= s) =
1 - exp(-K n exp(-decay s))`` for n tokens; ``decay`` solves ``E[exp(decay * score)] = 1`` and K is
fitted on clean training documents. Passages with an expected number below ``max_expected`` are
significant. The document's evidence is the surprise of its best passage plus the summed scores of
its significant ones; a logistic curve on training documents turns it into a score in (0, 1).

Bounds: the classifier is fitted on at most ``max_labelled`` labelled rows (a hash order decides
which) and at most ``max_tokens`` token scores are broadcast, those with the largest absolute
deviation. Scoring covers every text whole.

Cases: null or empty text has no tokens and gets the score of no evidence; labels that are null, or
of documents that are not there, are ignored; several labels of a document count as toxic if one
is; without a toxic and a clean training row every score is 0; an empty table gives an empty
result; repeated rows are scored alike; ties between segments go to the earlier one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import small_batches, staged

#: bytes kept in tokens: letters and digits of ASCII and everything beyond; A-Z are lower-cased, the rest parts tokens.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Stem lengths in characters; a stem ends in "*", which no token holds.
PREFIXES = range(3, 9)


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def token_column(text: Column) -> Column:
    """The same tokens as a Spark array."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: t != "")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


class Model:
    """Token scores, drift, the tail of clean texts and the logistic curve."""

    def __init__(self, scores: dict[bytes, float], drift: float) -> None:
        self.scores, self.drift = scores, drift
        self.decay, self.log_k, self.max_expected = 1.0, 0.0, 1e-3
        self.curve: tuple[float, float] | None = None
        self._known: dict[bytes, float | None] = {}

    def token_score(self, token: bytes) -> float | None:
        """Score of a token by its word or longest listed stem; None for the drift."""
        known = self._known
        if token in known:
            return known[token]
        found = self.scores.get(token)
        if found is None:
            letters = token.decode("utf-8", "replace")
            for n in range(min(len(letters), PREFIXES[-1]), PREFIXES[0] - 1, -1):
                found = self.scores.get(f"{letters[:n]}*".encode())
                if found is not None:
                    break
        if len(known) >= 500_000:
            known.clear()
        known[token] = found
        return found

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (start, end, score) of a token list, in linear time."""
        get = self.token_score
        marked = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        if not any(s > 0 for _, s in marked):
            return []
        # running totals before and after each scored token; the tokens between them drift
        found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, the last one that begins lower
        total, at = 0.0, 0
        for i, s in marked:
            total += self.drift * (i - at)
            at = i + 1
            before, total = total, total + s
            if s <= 0:
                continue
            # segments between a segment and its ``lower`` one begin no lower than it does, so none of them is looked at again
            lower = len(found) - 1
            while lower >= 0 and found[lower][2] >= before:
                lower = found[lower][4]
            start = i
            while lower >= 0 and found[lower][3] < total:
                start, _, before, _, below = found[lower]
                del found[lower:]
                lower = below
            found.append((start, i + 1, before, total, lower))
        return [(a, b, r - l) for a, b, l, r, _ in found]

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        """(evidence, significant passages) of a text."""
        found = self.segments(words)
        if not found:
            return 0.0, []
        tail = lambda s: self.log_k + np.log(max(1, len(words))) - self.decay * s  # noqa: E731  log of the expected number
        significant = [x for x in found if tail(x[2]) <= np.log(self.max_expected)]
        best = max(0.0, -tail(max(s for *_, s in found)))
        return float(best + sum(s for *_, s in significant)), significant

    def score(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * np.log1p(evidence) + b, -30, 30))))


def token_scores(counts: DataFrame, prior_share: float, min_z: float, max_tokens: int) -> DataFrame:
    """(token, score) of (token, toxic, clean) counts."""
    n1, n0 = (F.lit(n or 0) for n in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    prior = (F.col("toxic") + F.col("clean")) * prior_share
    weight = (n1 + n0) * prior_share
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + weight - F.col(y) - prior))
    z = F.col("score") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    scored = counts.withColumn("score", odds("toxic", n1) - odds("clean", n0)).withColumn("z", z)
    return scored.where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "token").limit(max_tokens).select("token", "score")


def fit(documents: DataFrame, labels: DataFrame, training: Column | None = None, max_labelled: int = 20_000, max_tokens: int = 20_000, prior_share: float = 0.05, min_z: float = 4.5) -> Model:
    """A model from the rows of ``labels`` (doc_id, toxic) for which ``training`` holds."""
    spark = documents.sparkSession
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if training is not None:
        rows = rows.where(training)
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", (F.col("toxic") > 0).cast("int").alias("__toxic"))
    # at most max_labelled rows of two numbers
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "__toxic", token_column(F.col("text")).alias("tokens"))
    units = F.flatten(F.transform("tokens", lambda t: F.concat(F.array(t), F.transform(
        F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length(t)), lambda n: F.concat(F.substring(t, F.lit(1), n), F.lit("*"))))))
    counts = texts.select("__toxic", F.explode(F.array_distinct(units)).alias("token")).groupBy("token").agg(F.sum("__toxic").alias("toxic"), F.sum(1 - F.col("__toxic")).alias("clean"))
    table = token_scores(staged(counts, "token_counts"), prior_share, min_z, max_tokens).toPandas()  # at most max_tokens rows
    model = Model({t.encode(): float(np.clip(s, -3, 8)) for t, s in zip(table["token"], table["score"])}, -0.05)
    if not model.scores:
        return model

    shared = spark.sparkContext.broadcast(model)
    kinds = {"n": pa.int64(), "best": pa.float64(), "toxic": pa.int32(), "marked": pa.int64(), "scores": pa.list_(pa.float64()), "times": pa.list_(pa.int64())}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document and, without ``n``, one for the token scores of the task's clean documents."""
        m, clean = shared.value, Counter()
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
        for batch in batches:
            out = []
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = tokens(words or b"")
                rises = Counter(s for w in own if (s := m.token_score(w)) is not None)
                if not toxic:
                    clean.update(rises)
                out.append((len(own), max((s for *_, s in m.segments(own)), default=0.0), toxic, rises.total(), None, None))
            yield as_batch(out)
        if clean:
            yield as_batch([(None, None, None, None, list(clean), list(clean.values()))])

    plain = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("__toxic", "text")
    measured = staged(plain.mapInArrow(measure, "n long, best double, toxic int, marked long, scores array<double>, times array<long>"), "measured")
    seen = measured.where("n IS NOT NULL").select("n", "best", "toxic", "marked").toPandas()  # at most max_labelled rows of four numbers
    clean = seen[seen["toxic"] == 0]
    if clean.empty or len(clean) == len(seen):
        return model
    share = [int(x["marked"].sum()) / max(1, int(x["n"].sum())) for x in (clean, seen[seen["toxic"] > 0])]
    # the log-odds of all other tokens, taken together; at least so low that a clean text's mean is negative
    rises = measured.select(F.explode(F.arrays_zip("scores", "times")).alias("x")).groupBy("x.scores").agg(F.sum("x.times").alias("times")).orderBy("scores").toPandas()  # at most max_tokens scores
    scored, times = rises["scores"].to_numpy(dtype=float), rises["times"].to_numpy(dtype=np.int64)
    n_other = max(1, int(clean["n"].sum() - times.sum()))
    model.drift = float(min(np.log(max(1e-9, 1 - share[1]) / max(1e-9, 1 - share[0])), -1.5 * max(0.0, float(scored @ times)) / n_other, -0.02))
    model.decay = _decay(scored, times, n_other, model.drift)
    # K from the clean documents' mean best score: E[max] = (log(K n) + Euler's constant) / decay
    model.log_k = float(np.clip(np.mean(model.decay * clean["best"] - np.log(np.maximum(1, clean["n"]))) - 0.5772, -30, 0))
    values = []

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = final.value
        for batch in batches:
            ev = [m.evidence(tokens(w or b""))[0] for w in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(ev, pa.float64())], names=["toxic", "evidence"])

    final = spark.sparkContext.broadcast(model)
    values = plain.mapInArrow(weigh, "toxic int, evidence double").toPandas()  # at most max_labelled rows
    model.curve = _logistic(np.log1p(values["evidence"].to_numpy()), values["toxic"].to_numpy(dtype=float))
    return model


def _decay(scored: np.ndarray, times: np.ndarray, n_drift: int, drift: float) -> float:
    """The positive root of E[exp(x * score)] = 1 for a clean text's tokens."""
    total = times.sum() + n_drift
    f = lambda x: (np.exp(np.minimum(700, x * scored)) @ times + n_drift * np.exp(x * drift)) / total - 1
    low, high = 1e-4, 1e-4
    if f(low) >= 0:
        return 0.05  # the drift is too weak for these counts: a slow tail is assumed
    while f(high) < 0 and high < 20:
        high *= 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return float(high)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge; the slope is not negative."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(x * (y - p)).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def scored(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``documents`` with ``tox_score``, ``tox_predicted`` and ``tox_spans``: token ranges and scores of the significant passages.

    Columns that already have one of these names are replaced.
    """
    documents = documents.drop("tox_score", "tox_predicted", "tox_spans")
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.evidence(tokens(t or b"")) for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            scores = [m.score(e) for e, _ in found]
            spans = [[{"first": a, "last": b - 1, "score": s} for a, b, s in x] for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, span)],
                names=[*batch.schema.names, "tox_score", "tox_predicted", "tox_spans"],
            )

    return documents.mapInArrow(score, f"{schema}, tox_score double, tox_predicted int, tox_spans array<struct<first: int, last: int, score: double>>")
