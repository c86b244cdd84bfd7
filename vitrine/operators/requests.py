"""Requests to the catalogue page in bulk, as from an access log: which are valid, what the page shows of them, and the link to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.catalog import SORTS

# The longest texts, the longest lists and their items.
TEXTS = {"search": 120, "category": 80}
LISTS = {"brands": (50, 80), "types": (20, 80), "countries": (50, 80), "colors": (50, 80), "stock": (20, 80)}
ATTRIBUTES, VALUES, VALUE_LENGTH = 30, 50, 160
PRICES = ("min_price", "max_price")
DEFAULTS = {"sort": "newest", "page": "1", "per_page": "12"}

_NUMBER = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def present(parameters: Column) -> Column:
    """The parameters (map of name to list of values) that hold something, blank values dropped."""
    trimmed = F.transform_values(parameters, lambda _, v: F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
    return F.map_filter(trimmed, lambda _, v: F.coalesce(F.size(v) > 0, F.lit(False)))


def errors(parameters: Column) -> Column:
    """``name: reason`` of every rule that the parameters break, in order; none for a valid request. Unknown names are not looked at."""
    one = lambda name: F.try_element_at(F.try_element_at(parameters, F.lit(name)), F.lit(1))  # noqa: E731  null if not given
    many = lambda name: F.try_element_at(parameters, F.lit(name))
    broken = lambda rule, name, reason: F.when(F.coalesce(rule, F.lit(False)), F.lit(f"{name}: {reason}"))
    number = lambda name: F.when(one(name).rlike(_NUMBER), F.trim(one(name)).try_cast("double"))
    whole = lambda name: F.when(one(name).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(one(name)).try_cast("long"))
    found = []
    for name, most in TEXTS.items():
        found.append(broken(F.char_length(one(name)) > most, name, f"longer than {most}"))
    longer = lambda most: lambda x: F.char_length(x) > most
    for name, (items, most) in LISTS.items():
        found += [broken(F.size(many(name)) > items, name, f"more than {items}"), broken(F.exists(many(name), longer(most)), name, f"item longer than {most}")]
    attributes = F.map_filter(parameters, lambda k, _: k.startswith("attributes."))
    found += [
        broken(F.size(attributes) > ATTRIBUTES, "attributes", f"more than {ATTRIBUTES}"), broken(F.exists(F.map_values(attributes), lambda v: F.size(v) > VALUES), "attributes", f"list longer than {VALUES}"),
        broken(F.exists(F.flatten(F.map_values(attributes)), longer(VALUE_LENGTH)), "attributes", f"item longer than {VALUE_LENGTH}")]
    for name in PRICES:
        found += [broken(one(name).isNotNull() & number(name).isNull(), name, "not a number"), broken(number(name) < 0, name, "below 0")]
    found.append(broken(~one("sort").isin(*SORTS), "sort", "unknown"))
    for name, most in (("page", None), ("per_page", 50)):
        found += [broken(one(name).isNotNull() & whole(name).isNull(), name, "not a whole number"), broken(whole(name) < 1, name, "below 1")]
        if most:
            found.append(broken(whole(name) > most, name, f"above {most}"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def echo(parameters: Column) -> Column:
    """What the page shows of a valid request: known parameters with defaults, single values as themselves and lists as lists."""
    one = lambda name: F.coalesce(F.try_element_at(F.try_element_at(parameters, F.lit(name)), F.lit(1)), F.lit(DEFAULTS.get(name, "")))
    many = lambda name: F.coalesce(F.try_element_at(parameters, F.lit(name)), F.array().cast("array<string>"))
    return F.struct(*[one(n).alias(n) for n in TEXTS], *[many(n).alias(n) for n in LISTS], *[one(n).alias(n) for n in (*PRICES, "sort")], *[one(n).try_cast("int").alias(n) for n in ("page", "per_page")])


def link(parameters: Column) -> Column:
    """The query string of a request: names in order, blanks and defaults left out, lists repeated with brackets."""
    kept = F.map_filter(parameters, lambda k, v: reduce(lambda a, b: a & b, [~((k == name) & (v[0] == value)) for name, value in DEFAULTS.items()]))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.array_join(F.transform(e["value"], lambda v: F.concat(e["key"], F.when(e["key"].isin(*LISTS) | e["key"].startswith("attributes."), "[]").otherwise(""), F.lit("="), F.url_encode(v))), "&"))
    return F.array_join(pairs, "&")


def judged(requests: DataFrame, parameters: str = "parameters") -> DataFrame:
    """``requests`` with ``errors``, ``echo`` (null where there are errors) and ``link``."""
    held = requests.withColumn("__held", present(F.col(parameters))).withColumn("errors", errors(F.col("__held")))
    return held.withColumns({"echo": F.when(F.size("errors") == 0, echo(F.col("__held"))), "link": link(F.col("__held"))}).drop("__held")
