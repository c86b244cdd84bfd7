"""Column functions on numbers: clamps, scores, costs, budgets, backoff, hashes of pictures and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import non_empty, slug, text

#: Failures of one kind in a row that switch a source off; kinds not listed never do.
DISABLE_AFTER = {"access_gate": 1, "recipe_mismatch": 2, "dom_unusable": 2, "browser_timeout": 3, "browser_protocol": 3}
#: Minutes to wait after a failure; browser_timeout and browser_protocol double instead.
BACKOFF_MINUTES = {"rate_limited": 30, "browser_unavailable": 15, "browser_process": 15, "ai_timeout": 15, "ai_rate_limited": 15, "recipe_mismatch": 10, "dom_unusable": 10}
BACKOFF_OTHER = 15
#: Kinds after which the browser rests even if a recipe is usable.
PAUSING_KINDS = ["access_gate", "rate_limited", "browser_timeout", "browser_unavailable", "browser_process", "browser_protocol"]
TARGET_IMAGES = {"laptop": 5, "desktop": 5}


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), x))


def lenient(c: Column) -> Column:
    """A number, or null."""
    return c.try_cast("double")


def count_of(c: Column) -> Column:
    """A whole number of at least 0; anything else is 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0).cast("long")))


def smoothed_rate(successes: Column, attempts: Column) -> Column:
    return (successes + 1) / (attempts + 2)


def measured_score(attempts: Column, accepted: Column, accepted_images: Column, extracted: Column, failures: Column) -> Column:
    """A source's score from its history: accepted galleries before extractions before the unknown before failures."""
    tries = F.greatest(F.lit(1), attempts)
    return (
        F.when(F.coalesce(attempts, F.lit(0)) <= 0, F.lit(0))
        .when(accepted > 0, 100_000 + F.round(smoothed_rate(accepted, tries) * 10_000) + F.least(F.lit(1_000), accepted_images))
        .when(extracted > 0, 50_000 + F.round(smoothed_rate(extracted, tries) * 5_000) + F.least(F.lit(500), extracted))
        .otherwise(-F.least(F.lit(10_000), F.greatest(F.lit(1), failures)))
    ).cast("long")


def source_score(measured: Column, recipe_status: Column, blocked: Column, successes: Column, failures: Column) -> Column:
    """Measured history unless the recipe is off; older recipe history where nothing was measured."""
    s, f = F.coalesce(successes, F.lit(0)), F.coalesce(failures, F.lit(0))
    older = F.when((recipe_status == "active") & (s > 0), 50_000 + F.round(smoothed_rate(s, s + f) * 5_000) + F.least(F.lit(500), s)).when(f > 0, -F.least(F.lit(10_000), f)).otherwise(0)
    off = F.coalesce(blocked, F.lit(False)) | F.coalesce(recipe_status == "disabled", F.lit(False))
    return F.when(off, F.lit(-1_000_000)).when(F.coalesce(measured, F.lit(0)) != 0, measured).otherwise(older).cast("long")


def uncached_input(provider: Column, given: Column, cached: Column) -> Column:
    """Input tokens that were not cached: one provider has taken them off already."""
    return F.when(provider == "openai", given).otherwise(F.greatest(F.lit(0).cast("long"), given - cached))


def cost(uncached: Column, cached: Column, output: Column, input_price: Column, cached_price: Column, output_price: Column) -> Column:
    """Cost by prices a million tokens, to six decimals; null if a price is missing. Computed in decimals."""
    million = F.lit(1_000_000).cast("decimal(10,0)")
    part = lambda n, p: n.cast("decimal(20,0)") * p.cast("decimal(12,6)")
    return F.round((part(uncached, input_price) + part(cached, cached_price) + part(output, output_price)) / million, 6).cast("double")


def over_budget(spent: Column, most: float) -> Column:
    return F.coalesce(spent >= most, F.lit(False)) & F.lit(most > 0)


def remaining_seconds(started: Column, now: Column, longest: int = 1200, reserve: int = 120) -> Column:
    """Seconds of work left; null if no work has begun."""
    elapsed = F.unix_timestamp(now) - F.unix_timestamp(started)
    return F.greatest(F.lit(0), F.lit(longest - min(reserve, longest - 1)) - elapsed).cast("long")


def can_start(remaining: Column, needed: int) -> Column:
    return remaining.isNull() | (remaining >= needed)


def timeout_for(remaining: Column, wanted: int) -> Column:
    return F.when(remaining.isNull(), F.lit(wanted)).otherwise(F.least(F.lit(wanted), F.greatest(F.lit(1), remaining)))


def backoff_minutes(kind: Column, failures: Column) -> Column:
    """Minutes until the next try."""
    doubling = F.least(F.lit(60), F.pow(F.lit(2), F.least(F.lit(5), failures))).cast("int")
    fixed = F.create_map(*[F.lit(x) for pair in BACKOFF_MINUTES.items() for x in pair])
    return F.when(kind.isin("browser_timeout", "browser_protocol"), doubling).otherwise(F.coalesce(F.try_element_at(fixed, kind), F.lit(BACKOFF_OTHER)))


def disable_after(kind: Column) -> Column:
    """Failures in a row that switch a source off; null for never."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DISABLE_AFTER.items() for x in pair]), kind)


def is_disabled(kind: Column, failures: Column) -> Column:
    return F.coalesce(failures >= disable_after(kind), F.lit(False))


def gallery_verdict(is_gallery: Column, reported: Column, observed: Column, extracted: Column, limit: int) -> Column:
    """struct(passed, expected, extracted, reason) of a trained recipe's run."""
    expected = F.least(F.lit(limit), F.greatest(F.coalesce(reported, F.lit(0)), F.coalesce(observed, F.lit(0))))
    got = F.coalesce(extracted, F.lit(0))
    reason = F.when(~F.coalesce(is_gallery, F.lit(False)), "no_gallery").when(expected < 2, "too_few_expected").when(got < expected, "incomplete").otherwise("complete")
    return F.struct((reason == "complete").alias("passed"), expected.alias("expected"), got.alias("extracted"), reason.alias("reason"))


def recipe_score(images: Column, dom: Column) -> Column:
    return F.least(F.lit(100), images * 10 + F.least(F.lit(20), dom))


def promotes(passed: Column, old_images: Column, new_images: Column) -> Column:
    """Whether a passed recipe replaces the old one."""
    return passed & ((F.coalesce(old_images, F.lit(0)) < 2) | (new_images >= old_images))


def probe_minimum_side(minimum: Column, confirmed: Column, present: Column, expected: Column, observed: Column) -> Column:
    """The smaller side once a gallery was fully reached, else the configured one."""
    configured, fallback = F.greatest(F.lit(100), F.coalesce(minimum, F.lit(600))), F.greatest(F.lit(100), F.coalesce(confirmed, F.lit(400)))
    reached = F.coalesce(present, F.lit(False)) & (F.coalesce(expected, F.lit(0)) >= 2) & (F.coalesce(observed, F.lit(0)) >= F.coalesce(expected, F.lit(0)))
    return F.when(reached, F.least(configured, fallback)).otherwise(configured)


def fitted(width: Column, height: Column, most: int = 1600) -> Column:
    """struct(width, height) scaled down to fit, in proportion."""
    scale = F.least(F.lit(1.0), F.least(F.lit(most) / width, F.lit(most) / height))
    return F.struct(F.greatest(F.lit(1), F.round(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * scale).cast("int")).alias("height"))


def target_images(product_type: Column, default: int = 3) -> Column:
    wanted = F.create_map(*[F.lit(x) for pair in TARGET_IMAGES.items() for x in pair])
    return F.greatest(F.lit(1), F.coalesce(F.try_element_at(wanted, product_type), F.lit(default)))


# ---- picture gates and hashes ------------------------------------------------------------------


def useful_dimensions(width: Column, height: Column, side: int = 450) -> Column:
    ratio = width / F.greatest(height, F.lit(1))
    return (F.least(width, height) >= side) & (ratio >= 0.28) & (ratio <= 3.5)


def safe_to_decode(width: Column, height: Column, most: int = 20_000_000) -> Column:
    return width.cast("long") * height.cast("long") <= most


def probe_verdict(timed_out: Column, decoded: Column, width: Column, height: Column, side: int) -> Column:
    return F.when(timed_out, "timeout").when(~decoded, "decode_failed").when(F.least(width, height) < side, "below_minimum").otherwise("ok")


def voice_reject(seconds: Column, size: Column) -> Column:
    """Why a voice message is refused; null if it is not."""
    return F.when(seconds > 300, "too_long").when(size > 20 * 1024 * 1024, "too_large")


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return red * 0.299 + green * 0.587 + blue * 0.114


def difference_bits(luma: Column, columns: int = 9, rows: int = 8) -> Column:
    """The bits of a difference hash from a row-wise luminance grid: left greater than right."""
    places = F.array(*[F.lit(r * columns + c) for r in range(rows) for c in range(columns - 1)])
    return F.transform(places, lambda i: (luma[i] > luma[i + 1]).cast("int"))


def hash_halves(bits: Column) -> Column:
    """struct(high, low): 64 bits as two whole numbers of 32."""
    pack = lambda start: F.aggregate(F.slice(bits, start, 32), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    return F.struct(pack(1).alias("high"), pack(33).alias("low"))


def hash_hex(halves: Column) -> Column:
    """Sixteen hexadecimal signs."""
    return F.lower(F.concat(F.lpad(F.hex(halves["high"]), 8, "0"), F.lpad(F.hex(halves["low"]), 8, "0")))


def hex_halves(value: Column) -> Column:
    """The halves of a hexadecimal hash; null if it is none."""
    half = lambda start: F.conv(F.substring(value, start, 8), 16, 10).try_cast("long")
    return F.when(value.rlike("^[0-9a-fA-F]{16}$"), F.struct(half(1).alias("high"), half(9).alias("low")))


def hamming(a: Column, b: Column) -> Column:
    """How many bits two hashes differ in."""
    return F.bit_count(a["high"].bitwiseXOR(b["high"])) + F.bit_count(a["low"].bitwiseXOR(b["low"]))


def greedy_distinct(hashes: Column, excluded: Column | None = None, most: int = 6) -> Column:
    """Of an ordered array of struct(..., high, low), those farther than ``most`` bits from all kept before and all excluded."""
    near = lambda kept, x: F.exists(kept, lambda k: hamming(k, x) <= most)
    banned = (lambda x: near(excluded, x)) if excluded is not None else (lambda x: F.lit(False))
    return F.aggregate(F.slice(hashes, 2, F.greatest(F.lit(1), F.size(hashes))), F.filter(F.slice(hashes, 1, 1), lambda x: ~banned(x)), lambda kept, x: F.when(near(kept, x) | banned(x), kept).otherwise(F.concat(kept, F.array(x))))


# ---- keys --------------------------------------------------------------------------------------


def identity_key(brand: Column, model: Column, title: Column) -> Column:
    own = slug(F.concat_ws(" ", non_empty(brand), F.coalesce(non_empty(model), title)))
    return F.when(own != "", own).otherwise(F.concat(F.lit("product-"), F.sha1(F.lower(text(title)))))


def brand_slug(name: Column) -> Column:
    own = slug(name)
    return F.when(own != "", own).otherwise(F.concat(F.lit("brand-"), F.sha1(F.lower(text(name)))))


def operation_key(update: Column, tool: Column, action: Column, target_type: Column, target_id: Column, payload: Column) -> Column:
    """The same for the same operation, so that it runs once."""
    parts = F.struct(update.alias("update"), tool.alias("tool"), action.alias("action"), target_type.alias("type"), target_id.alias("id"), payload.alias("payload"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def variant_fingerprint(color: Column, specifications: Column) -> Column:
    """The same for a colour and specifications in any order and case."""
    pairs = F.array_sort(F.transform(specifications, lambda s: F.struct(F.lower(F.trim(s["key"])).alias("key"), F.lower(F.trim(s["value"])).alias("value"))))
    return F.sha1(F.to_json(F.struct(F.lower(F.trim(text(color))).alias("color"), pairs.alias("specifications"))))


def content_name(role: Column, data: Column) -> Column:
    """File name of a picture from its role and content."""
    return F.concat(role, F.lit("-"), F.substring(F.sha2(data, 256), 1, 12), F.lit(".webp"))
