"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Base metrics are counted in each document's own row. Five ratios follow from them, as whole
numbers. A sketch of a ratio is a histogram with fixed bucket bounds: exact below 32, then 16
buckets an octave, so a quantile is off by at most 1/16. Sketches are tables of counts; two merge
by adding counts, so the sketches of a language and of everything are sums of those of its
sources. A small group's sketch says little, so every language's sketch is completed by
``prior_docs`` documents spread as in the sketch of everything, and every source's by as many
spread as in its language's: a threshold moves from the language's to the source's own as that
grows, without a step.

Fences: ``q3 + reach * max(q3 - q1, q90 - q50)`` above and, for the mean word length,
``q1 - reach * max(q3 - q1, q50 - q10)`` below, with nothing fixed beforehand. A ratio is known no
finer than by one occurrence of what it counts (``OCCURRENCE``), so a document lies beyond a fence
if its count exceeds what the fence allows for its length by more than ``reach`` occurrences;
where the quantiles of a group are all 0 this rounding alone decides. A document is kept if it
passes the base rules and all fences, which are joined to it by language and source.

Main path: DataFrame functions only; the wide text is read once and never shuffled.

Cases: null or empty text has no words and fails the base rules; null language or source is a
group of its own; ties lie on the fence and are kept; an empty table gives an empty result;
repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import SPACE_CHARS, staged, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: ratio -> (what it counts, what it is measured against)
RATIOS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars")}
#: the mean word length, in tenths of a character
LENGTH = "word_length"
#: the least by which a count can change; a three-word window that repeats covers six words
OCCURRENCE = {"symbols": 1, "dup_lines": 1, "repeats": 6, "upper": 1}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def base_metrics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id"), F.col("lang"), F.col("source"), text.alias("text")).withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    bare = _without(F.col("text"), SPACE_CHARS)
    rows = rows.select(
        "doc_id", "lang", "source", "w", F.size("w").cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), UPPER))).cast("long").alias("n_upper"),
        lines.alias("lines"),
    )
    # three-word windows, as pairs of hash and place; equal hashes stand side by side once sorted
    n = F.size("w")
    rows = rows.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("places", F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")))
    pairs = F.sort_array(F.transform("places", lambda i: F.struct(F.xxhash64(F.element_at("hashes", i), F.element_at("hashes", i + 1), F.element_at("hashes", i + 2)).alias("h"), i.alias("p"))))
    rows = rows.withColumn("pairs", pairs)
    m = F.size("pairs")
    twice = F.filter(F.zip_with(F.slice("pairs", 1, m - 1), F.slice("pairs", 2, F.greatest(m, F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["p"].alias("a"), b["p"].alias("b")))), lambda x: x.isNotNull())
    rows = rows.withColumn("twice", F.when(m >= 2, twice).otherwise(F.array()))
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["a"], x["a"] + 1, x["a"] + 2, x["b"], x["b"] + 1, x["b"] + 2))))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_upper", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(covered).cast("long").alias("n_repeat_words"),
    )


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / F.greatest(b, F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """The lower bound of a whole number's sketch bucket."""
    shift = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def bucket_top(bound: Column) -> Column:
    """The highest whole number of the bucket with this lower bound."""
    return F.when(bound < 32, bound).otherwise(bound + F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(bound)) - 5) - 1)


def sketches(rows: DataFrame, ratios: list[str]) -> DataFrame:
    """(lang, source, ratio, bucket, n): a sketch of every ratio for each language and source."""
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(F.col(r)).alias("bucket")) for r in ratios])).alias("x"))
    return long.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of ``keys``: sums of their parts' counts."""
    return sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def completed(sketch: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str], prior_docs: int) -> DataFrame:
    """``sketch`` (keys, ratio, bucket, n) with ``prior_docs`` more documents spread as in ``parent``.

    Counts are multiplied by the parent's total, which keeps them whole numbers.
    """
    whole = parent.groupBy(*parent_keys, "ratio").agg(F.sum("n").alias("all"))
    sizes = sketch.select(*keys, "ratio").distinct()
    grid = sizes.alias("s").join(parent.alias("p"), _same("s", "p", [*parent_keys, "ratio"])).join(whole.alias("w"), _same("s", "w", [*parent_keys, "ratio"]))
    grid = grid.select(*[F.col(f"s.{k}") for k in keys], "s.ratio", "p.bucket", F.col("p.n").alias("prior"), "w.all")
    joined = grid.alias("g").join(sketch.alias("o"), _same("g", "o", [*keys, "ratio"]) & (F.col("g.bucket") == F.col("o.bucket")), "left")
    n = F.coalesce(F.col("o.n"), F.lit(0)).cast("decimal(38,0)") * F.col("g.all") + F.col("g.prior") * prior_docs
    return joined.select(*[F.col(f"g.{k}") for k in keys], "g.ratio", "g.bucket", n.cast("decimal(38,0)").alias("n"))


def fences(sketch: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The fence above and the fence below of every group and ratio of a sketch (keys, ratio, bucket, n)."""
    own = Window.partitionBy(*keys, "ratio")
    placed = sketch.withColumn("upto", F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(own))
    at = {q: F.min(F.when(F.col("upto") * 20 >= F.col("all") * q, F.col("bucket"))) for q in (2, 5, 10, 15, 18)}  # twentieths
    upper = bucket_top(at[15]) + reach * F.greatest(at[15] - at[5], at[18] - at[10])
    lower = at[5] - reach * F.greatest(at[15] - at[5], at[10] - at[2])
    return placed.groupBy(*keys, "ratio").agg(upper.alias("upper"), lower.alias("lower"))


def group_fences(fine: DataFrame, prior_docs: int = 100, reach: int = 3) -> DataFrame:
    """(lang, source, ratio, upper, lower) of the sketches by language and source."""
    overall, language = merge(fine), merge(fine, "lang")
    own_language = completed(language, ["lang"], overall, [], prior_docs)
    return fences(completed(fine, ["lang", "source"], own_language, ["lang"], prior_docs), ["lang", "source"], reach)


def judged(documents: DataFrame, prior_docs: int = 100, reach: int = 3, min_words: int = 50) -> DataFrame:
    """The base metrics of every document with ``base_failed``, ``kept`` and the ratios that lie beyond a fence."""
    metrics = base_metrics(documents)
    rows = metrics.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumns({**{r: _div(F.col(count) * 1000, F.col(of)) for r, (count, of) in RATIOS.items()}, LENGTH: _div(F.col("word_chars") * 10, F.col("n_words"))})
    rows = staged(rows, "quality")
    fine = staged(sketches(rows.where("NOT base_failed"), [*RATIOS, LENGTH]), "sketches")
    found = group_fences(fine, prior_docs, reach)
    pick = lambda c, r: F.max(F.when(F.col("ratio") == r, F.col(c)))
    wide = found.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*[pick("upper", r).alias(f"f_{r}") for r in [*RATIOS, LENGTH]], pick("lower", LENGTH).alias("f_short"))
    joined = rows.join(wide, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    out = {r: (F.col(count) - reach * OCCURRENCE[r]) * 1000 > F.col(f"f_{r}") * F.col(of) for r, (count, of) in RATIOS.items()}
    out |= {LENGTH: F.col(LENGTH) > F.col(f"f_{LENGTH}"), "short_words": F.col(LENGTH) < F.col("f_short")}
    beyond = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in out.items()]), lambda x: x.isNotNull())
    judged = joined.withColumn("beyond", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(beyond))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0)).drop("f_lang", "f_source")
