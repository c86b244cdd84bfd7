"""Column functions on text: cleaning, tokens, product wording, errors, captions and commands."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values ------------------------------------------------------------------------------

#: Words that say nothing about which product is searched for.
STOP_WORDS = [
    "найди", "найти", "покажи", "поиск", "товар", "товары", "который", "которая", "которого", "есть", "наш", "наша", "наши", "каталог", "каталоге", "база", "базе",
    "привет", "здравствуй", "как", "дела", "можешь", "сможешь", "пожалуйста", "нас", "нужен", "нужна", "нужно", "имеется", "ноутбук", "ноутбука", "компьютер", "деталь",
    "компонент", "ram", "рам", "гб", "gb", "find", "show", "with", "product", "catalog", "laptop", "desktop", "component",
]
#: Words in almost every address of a brand.
GENERIC_WORDS = [
    "asus", "acer", "apple", "dell", "hp", "intel", "amd", "lenovo", "laptop", "notebook", "tablet", "product", "processor", "graphics", "memory", "storage", "quiet",
    "blue", "card", "edition",
]
#: Words left out of an image search's identity.
IMAGE_STOP_WORDS = ["product", "processor", "laptop", "notebook", "tablet", "graphics", "card", "edition"]
COMPARISON_MARKERS = [" vs ", " versus ", " comparison", " compared ", " with "]
NON_PHOTO_LABELS = [" logo", "_logo", "-logo", "icon", "wordmark", "symbol", "diagram", "screenshot"]
QUERY_LAPTOP = ["laptop", "notebook", "ноутбук", "macbook"]
QUERY_DESKTOP = ["desktop", "workstation", "компьютер", "готовый пк", "mini pc"]
QUERY_COMPONENT = ["gpu", "cpu", "видеокарт", "процессор", "материн", "motherboard", "ssd", "ram", "оператив"]
DRAFT_LAPTOP = [*QUERY_LAPTOP, "legion", "ideapad", "thinkpad", "vivobook", "zenbook", "pavilion", "aspire", "inspiron", "surface laptop"]
DRAFT_COMPONENT = [
    "gpu", "cpu", "видеокарт", "процессор", "motherboard", "материн", "ram", "оператив", "ssd", "hdd", "накопител", "power supply", "блок питания", "cooler", "кулер",
    "корпус", "case", "monitor", "монитор", "keyboard", "клавиатур", "mouse", "мыш",
]
#: Attribute key <- words in its label; the first that matches counts.
ATTRIBUTE_RULES = [
    ("cpu", ["cpu", "processor", "процессор"]), ("gpu", ["gpu", "graphics", "video", "видео"]), ("ram", ["ram", "memory", "оператив"]),
    ("storage", ["storage", "ssd", "накопител"]), ("refresh_rate", ["refresh", "частот"]), ("screen_size", ["screen size", "diagonal", "диагонал"]),
    ("display", ["display", "screen", "экран"]),
]
ATTRIBUTE_LABELS = {
    "cpu": "Процессор", "gpu": "Видеокарта", "ram": "Оперативная память", "storage": "Накопитель", "display": "Дисплей", "screen_size": "Диагональ",
    "refresh_rate": "Частота экрана",
}
NUMBER_UNITS = {"ram": "GB", "storage": "GB", "screen_size": "inch", "refresh_rate": "Hz"}
#: (class, retryable, words in the message); the first that matches counts.
ERROR_RULES = [
    ("quota", False, ["insufficient_quota", "billing", "credit balance", "quota"]),
    ("unknown_model", False, ["does not exist", "model_not_found", "invalid model", "no such model", "unknown model"]),
    ("credentials", False, ["401", "unauthorized", "api key", "authentication"]),
    ("context_length", False, ["context length", "maximum context", "too many tokens"]),
    ("rate_limit", True, ["429", "rate limit"]),
    ("timeout", True, ["timeout", "timed out"]),
    ("network", True, ["ssl", "connection", "could not resolve", "network"]),
]
FAILURE_KINDS = [("ai_rate_limited", ["429", "rate limit"]), ("ai_timeout", ["timeout", "timed out"]), ("ai_transient", ["connection", "temporar"])]
REASONING = (
    r"(?iU)(?:closest\s+(?:current\s+)?(?:match|product)|family[-\s]level\s+match|family\s+match|match\s+for|requested\s+product|user\s+request|search\s+(?:result|found)"
    r"|product\s+found|exact\s+sku|not\s+confirmed|could\s+not\s+(?:confirm|verify)|confidence\s+score|mismatch|uncertaint|sources?\s+(?:show|indicate|list)"
    r"|(?:official|manufacturer|retailer)\s+(?:site|pages?|sources?)\s+(?:confirm|show|list|indicate)|according\s+to|\bai\b|neural\s+network"
    r"|price\s+(?:is\s+)?(?:not\s+)?(?:available|provided)|по\s+запрос|ближайш|найден|совпаден|источник|не\s+подтвержден|уверенност|несоответств|за\s+запит|знайден|джерел"
    r"|невідповід|cena\s+není\s+uvedena|nalezen|zdroj)"
)
#: Latin letters with marks and Cyrillic letters, and what they become in ASCII.
_MARKED = "áàâäãåāčćçďéèêëěēíìîïīľĺłňñóòôöõőøřŕšśťúùûüůűūýÿžźżđ"
_PLAIN = "aaaaaaacccdeeeeeeiiiiilllnnooooooorrsstuuuuuuuyyzzzd"
_CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya", "ß": "ss", "æ": "ae", "œ": "oe",
}
assert len(_MARKED) == len(_PLAIN)
#: Letters that become one letter or none are translated in one step.
_SINGLE = "".join(x for x, plain in _CYRILLIC.items() if len(plain) == 1)
_DROPPED = "".join(x for x, plain in _CYRILLIC.items() if not plain)


# ---- basics ------------------------------------------------------------------------------------


def text(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Whether one of ``words`` stands anywhere in ``c``."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def contains_ci(c: Column, term: Column) -> Column:
    """Literal containment regardless of case; no wildcards."""
    return F.contains(F.lower(c), F.lower(term))


def first_match(c: Column, rules: Iterable[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The name of the first rule with a word in ``c``."""
    out = None
    for name, words in rules:
        out = F.when(contains_any(c, words), F.lit(name)) if out is None else out.when(contains_any(c, words), F.lit(name))
    return out.otherwise(otherwise)


def squish(c: Column) -> Column:
    """Outer white space off, inner runs to one space."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def lower_trim(c: Column) -> Column:
    return F.lower(F.trim(c))


def non_empty(c: Column) -> Column:
    """Null for the empty text, and for "0", which counts as empty where the value is optional."""
    return F.when((c == "") | (c == "0"), None).otherwise(c)


def normalized_value(value: Column, given: Column) -> Column:
    """The comparison form of an attribute value."""
    return lower_trim(F.coalesce(non_empty(given), value))


def clip(c: Column, n: int) -> Column:
    """At most ``n`` code points."""
    return F.substring(c, 1, n)


# ---- slugs and transliteration -----------------------------------------------------------------


def to_ascii(c: Column) -> Column:
    """Lower-case ASCII: Latin marks off, Cyrillic by letter, other signs dropped."""
    out = F.translate(F.lower(text(c)), _MARKED + _SINGLE + _DROPPED, _PLAIN + "".join(_CYRILLIC[x] for x in _SINGLE))
    for letter, plain in _CYRILLIC.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def slug_ascii(c: Column, sep: str = "-") -> Column:
    """Slug of a text that is ASCII already."""
    return F.btrim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", sep), F.lit(sep))


def slug(c: Column, sep: str = "-") -> Column:
    """Slug of any text by :func:`to_ascii`."""
    return slug_ascii(to_ascii(c), sep)


@F.pandas_udf(StringType())
def slug_unicode(values: pd.Series) -> pd.Series:
    """Slug by Unicode decomposition, for scripts beyond the table of :func:`to_ascii`."""
    import re
    import unicodedata

    def one(value: str | None) -> str:
        plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")

    return values.map(one)


# ---- search ------------------------------------------------------------------------------------


def search_terms(query: Column) -> Column:
    """The first eight distinct words of a query that mean something."""
    parts = F.split(F.lower(text(query)), r"[^\p{L}\p{N}._-]+")
    return F.slice(F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))), 1, 8)


def all_terms_in(document: Column, terms: Column) -> Column:
    """Whether every term stands in the search document."""
    return F.forall(terms, lambda t: F.contains(document, t))


def infer_product_type(query: Column) -> Column:
    """Product type a query asks for, or the empty text."""
    return first_match(F.lower(text(query)), [("laptop", QUERY_LAPTOP), ("desktop", QUERY_DESKTOP), ("component", QUERY_COMPONENT)], F.lit(""))


def guess_product_type(title: Column, model: Column, specifications: Column) -> Column:
    """Type of a draft; component words count in title and model only, as they stand in any laptop's specifications."""
    identity = F.lower(F.concat(text(title), F.lit(" "), text(model)))
    everything = F.concat(identity, F.lit(" "), F.lower(text(specifications)))
    return F.when(contains_any(everything, DRAFT_LAPTOP), "laptop").when(contains_any(everything, QUERY_DESKTOP), "desktop").when(contains_any(identity, DRAFT_COMPONENT), "component").otherwise("other")


def ram_gb(query: Column) -> Column:
    """Memory size named in a sentence, as a number; null if none."""
    found = F.regexp_extract(text(query), r"(?iU)(\d+(?:[.,]\d+)?)\s*(?:gb|гб|ram|рам)\b", 1)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


# ---- identity ----------------------------------------------------------------------------------


def identity_tokens(*parts: Column, least: int = 3, generic: list[str] | None = None) -> Column:
    """Distinct ASCII words of a product's names without generic ones."""
    words = F.split(to_ascii(F.concat_ws(" ", *parts)), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= least) & ~t.isin(GENERIC_WORDS if generic is None else generic)))


def is_strong_token(t: Column) -> Column:
    """Four signs or more, of letters and digits mixed or digits alone."""
    return (F.length(t) >= 4) & ((t.rlike("[a-z]") & t.rlike(r"\d")) | t.rlike(r"^\d+$"))


def identity_supported(tokens: Column, url: Column) -> Column:
    """Whether an address names the product: by one strong token or by three of any kind."""
    plain = to_ascii(F.coalesce(F.try_url_decode(url), url))
    inside = F.filter(tokens, lambda t: F.contains(plain, t))
    return (text(url) != "") & (F.exists(inside, is_strong_token) | (F.size(inside) >= 3))


def label_tokens(label: Column) -> Column:
    return F.array_distinct(F.split(to_ascii(F.coalesce(F.try_url_decode(label), label)), "[^a-z0-9]+"))


def relevance_score(title: Column, tokens: Column) -> Column:
    """Ten for each token in an image's title, thirty off for a comparison."""
    plain = to_ascii(F.coalesce(F.try_url_decode(title), title))
    return F.size(F.array_intersect(tokens, label_tokens(title))) * 10 - F.when(contains_any(plain, COMPARISON_MARKERS), 30).otherwise(0)


def useful_image(mime: Column, width: Column, height: Column, title: Column, url: Column, tokens: Column, minimum_side: int = 450) -> Column:
    """Whether a found image is a photo of the product: kind, size, label and tokens."""
    label = F.concat(text(title), F.lit(" "), text(url))
    matched = F.array_intersect(tokens, label_tokens(label))
    strong = F.exists(matched, lambda t: (F.length(t) >= 3) & t.rlike("[a-z]") & t.rlike(r"\d")) | F.exists(matched, lambda t: (F.length(t) >= 4) & t.rlike(r"^\d+$"))
    enough = strong | (F.size(matched) >= F.least(F.lit(2), F.size(tokens)))
    plain = to_ascii(F.coalesce(F.try_url_decode(label), label))
    return F.lower(text(mime)).isin("image/jpeg", "image/png", "image/webp") & (F.least(width, height) >= minimum_side) & ~contains_any(plain, NON_PHOTO_LABELS) & enough


def image_queries(brand: Column, model: Column, title: Column) -> Column:
    """Search phrases: brand with model (or title), then title; equal ones in other case once."""
    identity, whole = squish(F.concat_ws(" ", non_empty(brand), F.coalesce(non_empty(model), title))), squish(title)
    both = F.filter(F.array(identity, whole), lambda q: q != "")
    return F.when((F.size(both) == 2) & (F.lower(identity) == F.lower(whole)), F.array(identity)).otherwise(both)


# ---- attributes --------------------------------------------------------------------------------


def canonical_attribute_key(label: Column) -> Column:
    low = F.lower(text(label))
    own = slug(low, "_")
    return first_match(low, ATTRIBUTE_RULES, F.when(own != "", own).otherwise(F.concat(F.lit("attribute_"), F.substring(F.sha1(low), 1, 12))))


def canonical_label(key: Column, fallback: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in ATTRIBUTE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, key), F.trim(fallback))


def typed_value(key: Column, value: Column) -> Column:
    """struct(data_type, number, unit) of an attribute value; terabytes become gigabytes."""
    units = F.create_map(*[F.lit(x) for pair in NUMBER_UNITS.items() for x in pair])
    number = F.replace(F.regexp_extract(text(value), r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    scaled = F.when((key == "storage") & contains_any(F.lower(value), ["tb", "тб"]), number * 1024).otherwise(number)
    numeric = key.isin(*NUMBER_UNITS) & number.isNotNull()
    kind = F.when(numeric, "number").otherwise("text")
    return F.struct(kind.alias("data_type"), F.when(numeric, scaled).alias("number"), F.when(numeric, F.try_element_at(units, key)).alias("unit"))


# ---- descriptions ------------------------------------------------------------------------------


def clean(c: Column) -> Column:
    """Plain text of a description: tags, common entities, links' addresses and markers off, blanks squeezed."""
    out = F.regexp_replace(text(c), "<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    for marker in ("**", "__", "`", "###", "##"):
        out = F.replace(out, F.lit(marker), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), r"(?:\r\n|\n|\r){3,}", "\n\n"))


def has_reasoning(c: Column) -> Column:
    """Whether a description talks about the search instead of the product."""
    return c.rlike(REASONING)


def technical_description(title: Column, model: Column, color: Column, specifications: Column) -> Column:
    """Title, model if it says more, colour and ten specifications, as sentences."""
    t = F.coalesce(F.nullif(clean(title), F.lit("")), F.lit("Product"))
    m, c = clean(model), clean(color)
    identity = F.concat_ws(". ", F.when((m != "") & ~contains_ci(t, m), F.concat(F.lit("Model: "), m)), F.when(c != "", F.concat(F.lit("Color: "), c)))
    lines = F.transform(specifications, lambda s: F.when((clean(F.coalesce(s["name"], s["key"])) != "") & (clean(s["value"]) != ""), F.concat(clean(F.coalesce(s["name"], s["key"])), F.lit(": "), clean(s["value"]))))
    ten = F.slice(F.array_distinct(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull())), 1, 10)
    return F.concat_ws(
        " ", F.concat(F.regexp_replace(t, r"\.+$", ""), F.lit(".")), F.when(identity != "", F.concat(identity, F.lit("."))),
        F.when(F.size(ten) > 0, F.concat(F.lit("Specifications: "), F.array_join(ten, "; "), F.lit("."))),
    )


def routed_description(title: Column, model: Column, color: Column, specifications: Column, description: Column, notes: Column) -> Column:
    """struct(description, research_notes): reasoning goes to the notes and a technical text takes its place."""
    d, n = clean(description), clean(notes)
    reasoning = (d != "") & has_reasoning(d)
    moved = clean(F.concat_ws("\n\n", F.nullif(n, F.lit("")), F.concat(F.lit("Original research summary:\n"), d)))
    public = F.when((d == "") | reasoning, technical_description(title, model, color, specifications)).otherwise(d)
    kept = F.nullif(F.when(reasoning, moved).otherwise(n), F.lit(""))
    return F.struct(clip(public, 5000).alias("description"), clip(kept, 5000).alias("research_notes"))


# ---- errors, captions, commands ----------------------------------------------------------------


def redact(c: Column, n: int = 500) -> Column:
    """Secret keys out, then at most ``n`` signs."""
    return clip(F.regexp_replace(c, "(sk-[A-Za-z0-9_-]+)", "[redacted]"), n)


def classify_error(message: Column) -> Column:
    """struct(class, retryable) of an error message."""
    low = F.lower(text(message))
    name = first_match(low, [(n, w) for n, _, w in ERROR_RULES], F.lit("other"))
    return F.struct(name.alias("class"), name.isin([n for n, again, _ in ERROR_RULES if again]).alias("retryable"))


def failure_kind(message: Column) -> Column:
    return first_match(F.lower(text(message)), FAILURE_KINDS, F.lit("ai_error"))


def caption(head: Column, body: Column, tail: Column, budget: int = 1024) -> Column:
    """Head, as much of the body as the budget leaves (eight signs spare), and tail."""
    room = F.greatest(F.lit(0), F.lit(budget - 8) - F.length(text(head)) - F.length(text(tail)))
    return F.concat(text(head), F.substring(text(body), F.lit(1), room), text(tail))


def with_first_line(c: Column, line: Column) -> Column:
    """The text with another first line."""
    rest = F.regexp_replace(text(c), r"\A[^\r\n]*", "")
    return F.concat(line, rest)


def log_tail(c: Column, head: Column, budget: int = 4096) -> Column:
    """What is left of the budget from the end of a log, marked by an ellipsis if it was cut."""
    room = F.lit(budget) - F.length(text(head))
    return F.concat(text(head), F.when(F.length(c) <= room, c).otherwise(F.concat(F.lit("…\n"), F.right(c, F.greatest(F.lit(0), room - 2)))))


def command(c: Column) -> Column:
    """struct(verb, id, second_id) of a chat command or button: ``/verb id``, ``verb:id:second_id``."""
    pattern = r"^/?([a-z_]+)(?:[ :](\d+))?(?:[ :](\d+))?$"
    part = lambda k: F.regexp_extract(F.lower(F.trim(text(c))), pattern, k)
    return F.struct(F.nullif(part(1), F.lit("")).alias("verb"), part(2).try_cast("long").alias("id"), part(3).try_cast("long").alias("second_id"))


def reply_prompt(message: Column, replied: Column) -> Column:
    """A message with the one it answers quoted before it."""
    return F.when(replied.isNotNull() & (replied != ""), F.concat(F.lit("Reply to: "), replied, F.lit("\n\n"), text(message))).otherwise(text(message))


def usage_footnote(tokens: Column, cost: Column) -> Column:
    """Grouped token number and, if known, the cost with four decimals."""
    return F.concat(F.format_number(tokens, 0), F.lit(" tokens"), F.when(cost.isNotNull(), F.format_string(" · $%.4f", cost)).otherwise(""))


def price_label(price: Column) -> Column:
    """Four decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", price.cast("double")), r"\.?0+$", "")


def option_label(name: Column, model: Column, input_price: Column, output_price: Column) -> Column:
    """Name, model and its two prices, as a choice list shows them."""
    return F.concat(name, F.lit(" · "), model, F.when(input_price.isNotNull() & output_price.isNotNull(), F.concat(F.lit(" · $"), price_label(input_price), F.lit("/$"), price_label(output_price))).otherwise(""))


#: Sign of a specification <- words in its name.
SPEC_SIGNS = [("🧠", ["cpu", "processor"]), ("🎮", ["gpu", "graphics"]), ("💾", ["ram", "memory"]), ("💽", ["storage", "ssd"]), ("🖥", ["display", "screen"]), ("🔋", ["battery"]), ("⚖", ["weight"])]


def spec_sign(name: Column) -> Column:
    return first_match(F.lower(text(name)), SPEC_SIGNS, F.lit("•"))


def parse_list(c: Column) -> Column:
    """Items between commas or line ends, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text(c), "[,\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def is_currency(c: Column) -> Column:
    return F.upper(text(c)).rlike("^[A-Z]{3}$")


def keep_or_hash_secret(c: Column) -> Column:
    """A secret of plain signs as it is, any other as its SHA-256."""
    return F.when(c.rlike("^[A-Za-z0-9_-]{1,256}$"), c).otherwise(F.sha2(c, 256))


def plural_form(n: Column, locale: Column) -> Column:
    """one, few or many, by the rules of the locale (en, cs, uk)."""
    uk = F.when((n % 10 == 1) & (n % 100 != 11), "one").when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), "few").otherwise("many")
    cs = F.when(n == 1, "one").when(n.between(2, 4), "few").otherwise("many")
    return F.when(locale == "uk", uk).when(locale == "cs", cs).otherwise(F.when(n == 1, "one").otherwise("many"))


def price_after_label(html: Column, label: str) -> Column:
    """The dollar amount in the element after the one that holds ``label``."""
    return F.regexp_extract(text(html), rf">\s*{label}\s*</div>\s*<div[^>]*>\s*\$([0-9.]+)", 1).try_cast("double")


def of_counts(c: Column) -> Column:
    """Pairs of "3 of 12" and "3/12" in a text: array of struct(at, of)."""
    pattern = r"(\d+)\s*(?:of|/)\s*(\d+)"
    at, of = (F.regexp_extract_all(F.lower(text(c)), F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(at, of, lambda a, b: F.struct(a.cast("int").alias("at"), b.cast("int").alias("of")))


def sanitized_markup(c: Column, n: int = 1600) -> Column:
    """Markup without scripts, styles and handlers, blanks collapsed, at most ``n`` signs."""
    out = F.regexp_replace(text(c), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    return clip(F.trim(F.regexp_replace(out, r"\s+", " ")), n)
