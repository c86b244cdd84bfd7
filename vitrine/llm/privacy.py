"""Personal data: values found by their form, and terms that reveal them by what the corpus says of both.

Values. E-mail addresses, IP addresses, card and phone numbers are found leftmost and non-overlapping,
kind by kind, in time linear in the text. Each distinct value is a protected entity.

Terms, by information-theoretic sanitisation. The terms within ``window`` words of a mention of an
entity are observed, and all words of the corpus are counted. With n(t, e) observations of term t near entity e, n(t)
occurrences of t anywhere, n(e) observations near e and N words, the pointwise mutual information
PMI(t; e) = log2(n(t, e) N / (n(t) n(e))) is what t tells of e, out of IC(e) = log2(N / n(e)) that there is to
tell. A term discloses PMI / IC of the entity, discounted by (s / (s + 1))^2 for the s different contexts that support it, so
words that merely stand near one mention, or in copies of one text, reveal nothing. Above ``threshold`` the term is generalised to
its first ``stem`` characters, if those disclose no more than the threshold of the entity, else it is removed; both at every
observed place, so texts that do not mention the entity stay as they are.

Work: one Arrow pass finds values and observations, one counts words; the rest are joins and groupings in
Spark. Observations are linear in mentions (2 x ``window`` each), never pairs of a document's terms. Pairs
without the contexts that the threshold asks for leave before any join, which drops none that could pass. Counts are
grouped with map-side combination and joined from a written table, so that adaptive execution can split a hot
entity or term. Entities and contexts are 64-bit digests.

Cases: null or empty text has no spans; null and repeated ids are kept, each row has its own spans; a value
within a text that repeats counts at each place; an empty table gives an empty result; without mentions there
are no terms; a term near several entities has one span, removal before generalisation; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import doc_slices, small_batches, staged
from vitrine.llm.toxicity import _FOLD

SLICE = 1 << 20
#: Different words a task counts before it hands them on.
VOCABULARY = 200_000
KINDS = ("email", "ip", "card", "phone")

# What the kinds look like.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9][0-9]*+(?:\.[0-9]++\.[0-9]++\.[0-9]++)?+")  # a run of digits without the rest is passed over whole
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From sign to sign, as the run before each is scanned once; a search for the whole form rescans long words."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def values(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value in a plain form), by kind and place; offsets in code points."""
    found = [("email", a, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span(), ".".join(parts)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 2 * 19 and 13 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span(), digits))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 15:
            found.append(("phone", *m.span(), digits))
    return found


def _digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_LETTER = np.zeros(128, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def term_places(text: str, spans: list[tuple[str, int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms outside of ``spans`` start and end: letters and digits of ASCII and everything beyond ASCII."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = (codes >= 128) | _LETTER[np.minimum(codes, 127)]
    for _, a, b, _ in spans:
        inside[a + 1 : b + 1] = 0
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def observations(text: str, found: list[tuple[str, int, int, str]], window: int) -> Iterator[tuple[int, str, int, int, int]]:
    """(entity, term, start, end, context) for the terms near each mention, each place once for an entity."""
    starts, ends = term_places(text, found)
    seen: set[tuple[int, int]] = set()
    for kind, start, _, value in found:
        entity = _digest(f"{kind}:{value}")
        i = bisect_left(starts, start)
        near = range(max(0, i - window), min(len(starts), i + window))
        terms = [text[starts[j] : ends[j]].translate(_LOWER) for j in near]
        context = _digest(" ".join(terms))
        for j, term in zip(near, terms):
            if (entity, j) not in seen:
                seen.add((entity, j))
                yield entity, term, int(starts[j]), int(ends[j]), context


_NEAR = T.StructType([T.StructField("entity", T.LongType()), T.StructField("term", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("context", T.LongType())])
_FOUND = [*[T.StructField(f"pii_n_{k}", T.LongType()) for k in KINDS], T.StructField("pii_base", T.StringType()), T.StructField("pii_near", T.ArrayType(_NEAR))]


def found_values(docs: DataFrame, keep: list[str], window: int = 8, text: str = "text") -> DataFrame:
    """``keep`` with the number of values of each kind, their places (``kind:start:end`` joined by commas) and what stands near them."""
    small_batches(docs.sparkSession)
    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("pii_text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in doc_slices(batches, SLICE, "pii_text"):
            counts: list[list[int]] = []
            base: list[str] = []
            near: list[tuple[int, str, int, int, int]] = []
            offsets = [0]
            for x in part.column(part.num_columns - 1):
                body = x.as_py() or ""
                found = values(body)
                kinds = Counter(f[0] for f in found)
                counts.append([kinds[k] for k in KINDS])
                base.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
                if found:
                    near += observations(body, found, window)
                offsets.append(len(near))
            columns = [pa.array(list(c), type=kind) for c, kind in zip(zip(*near) if near else [()] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.StructArray.from_arrays(columns, names=_NEAR.names))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(list(c), type=pa.int64()) for c in zip(*counts)], pa.array(base, type=pa.string()), lists], names=[*keep, *[f.name for f in _FOUND]])

    return read.mapInArrow(search, T.StructType([*read.schema.fields[:-1], *_FOUND]))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) of all texts."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            words = [w.decode("utf-8", "replace") for w in counts]
            return pa.record_batch({"term": pa.array(words, type=pa.string()), "n": pa.array(list(counts.values()), type=pa.int64())})

        for part in doc_slices(batches, SLICE, text):
            for x in part.column(0).cast(pa.large_binary()):
                folded = (x.as_py() or b"").translate(_FOLD)
                for start, end in _stretches(folded):
                    counts.update(folded[start:end].split())
                if len(counts) > VOCABULARY:
                    yield hand_on()
                    counts.clear()
        if counts:
            yield hand_on()

    return docs.select(F.col(text)).mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _stretches(folded: bytes) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + SLICE) if len(folded) - start > SLICE else -1
        end = len(folded) if end < 0 else end
        yield start, end
        start = end


def _disclosed(n_te: str, n_t: str, n_e: str, contexts: str, n_all: int) -> Column:
    """The share of an entity's information that a term tells, discounted by its support."""
    content = F.log2(F.lit(float(n_all)) / F.col(n_e))
    mutual = content + F.log2(F.col(n_te) / F.greatest(F.col(n_t), F.col(n_te)))
    support = F.col(contexts) / (F.col(contexts) + 1)
    return F.when(content > 0, mutual / content * support * support).otherwise(0.0)


def fewest_contexts(threshold: float) -> int:
    """With fewer different contexts than these no term can disclose more than the threshold."""
    root = math.sqrt(max(threshold, 0))
    return math.floor(root / (1 - root) - 1e-9) + 1 if root < 1 else 1 << 62


def revealing_terms(near: DataFrame, words: DataFrame, threshold: float = 0.5, stem: int = 3) -> DataFrame:
    """(entity, term, disclosed, instead): terms above the threshold, with the stem to put in their place or the empty string.

    ``near`` has a row (entity, term, context) for each observation, ``words`` a row (term, n) for each word of the corpus.
    """
    n_all = words.agg(F.sum("n")).first()[0] or 0
    least = fewest_contexts(threshold)

    def pairs(key: Column) -> DataFrame:
        contexts = near.groupBy("entity", key.alias("key"), "context").agg(F.count("*").alias("n"))
        return contexts.groupBy("entity", "key").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts")).where(F.col("contexts") >= least)

    n_e = near.groupBy("entity").agg(F.count("*").alias("n_e"))
    disclosed = _disclosed("n_te", "n_t", "n_e", "contexts", n_all)

    def above(key: Column, counts: DataFrame) -> DataFrame:
        return pairs(key).join(n_e, "entity").join(counts, "key", "left").where(disclosed > threshold)

    terms = above(F.col("term"), words.select(F.col("term").alias("key"), F.col("n").alias("n_t"))).select("entity", F.col("key").alias("term"), disclosed.alias("disclosed"), F.substring("key", 1, stem).alias("stem"))
    stems = above(F.substring("term", 1, stem), words.groupBy(F.substring("term", 1, stem).alias("key")).agg(F.sum("n").alias("n_t"))).select("entity", F.col("key").alias("stem"), F.lit(True).alias("tells"))
    instead = F.when(F.col("tells") | (F.length("term") <= stem), "").otherwise(F.concat("stem", F.lit("*")))
    return terms.join(stems, ["entity", "stem"], "left").select("entity", "term", "disclosed", F.coalesce(instead, F.concat("stem", F.lit("*"))).alias("instead"))


def spans(docs: DataFrame, keep: list[str], window: int = 8, threshold: float = 0.5, stem: int = 3, text: str = "text") -> DataFrame:
    """``keep`` with the counts and places of values and ``pii_terms``, an array of (start, end, instead) in order of place."""
    found = staged(found_values(docs, keep, window, text).withColumn("pii_row", F.monotonically_increasing_id()), "values")
    near = found.select("pii_row", F.explode("pii_near").alias("o")).select("pii_row", "o.*")
    revealing = staged(revealing_terms(near, staged(word_counts(docs, text), "words"), threshold, stem), "revealing")
    places = near.join(revealing, ["entity", "term"]).groupBy("pii_row", "start", "end").agg(F.min("instead").alias("instead"))
    terms = places.groupBy("pii_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "instead"))).alias("pii_terms"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,instead:string>>")
    return found.join(terms, "pii_row", "left").withColumn("pii_terms", F.coalesce("pii_terms", none)).drop("pii_near")


def span_text() -> tuple[Column, Column]:
    """The places of the values, and those of values and terms, as ``kind:start:end`` joined by commas."""
    term = F.array_join(F.transform("pii_terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])), ",")
    return F.col("pii_base"), F.concat_ws(",", F.nullif(F.col("pii_base"), F.lit("")), F.nullif(term, F.lit("")))


def sanitised(docs: DataFrame, window: int = 8, threshold: float = 0.5, stem: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with values replaced by their kind in brackets, and revealing terms by their stem or ``[term]``."""
    kept = staged(docs.withColumn("pii_id", F.monotonically_increasing_id()), "documents")
    edits = spans(kept, ["pii_id"], window, threshold, stem, text).where("pii_base <> '' OR size(pii_terms) > 0").select("pii_id", F.col("pii_base").alias("pii_b"), F.col("pii_terms").alias("pii_t"))
    changed = T.StructType([*docs.schema.fields])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = part.schema.get_field_index(text)
            bodies = part.column(at).to_pylist()
            for i, (base, terms) in enumerate(zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())):
                if base is None:
                    continue
                marked = [(int(a), int(b), f"[{k}]") for k, a, b in (x.split(":") for x in base.split(",") if x)]
                bodies[i] = replaced(bodies[i], marked + [(t["start"], t["end"], t["instead"] or "[term]") for t in terms])
            yield pa.RecordBatch.from_arrays([pa.array(bodies, type=part.column(at).type) if j == at else part.column(j) for j in range(len(changed))], names=changed.names)

    return kept.join(edits, "pii_id", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "pii_b", "pii_t").mapInArrow(rewrite, changed)


def replaced(body: str, marked: list[tuple[int, int, str]]) -> str:
    """The text with each marked stretch replaced; of stretches that overlap the first goes whole, the rest of a later one with it."""
    parts, done = [], 0
    for a, b, instead in sorted(marked):
        if a >= done:
            parts += [body[done:a], instead]
        done = max(done, b)
    return "".join([*parts, body[done:]])
