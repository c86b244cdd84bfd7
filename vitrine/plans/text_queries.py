"""Text, address, identity and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import html as H
from vitrine.functions import numbers as N
from vitrine.functions import payloads as P
from vitrine.functions import text as T
from vitrine.functions import urls as U
from vitrine.plans.binding import bound, with_bound
from vitrine.registry import query
from vitrine.session import table


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _rules(c: str, rules: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(c, words)} THEN '{name}'" for name, words in rules) + f" ELSE {otherwise} END"


#: DuckDB's form of :func:`vitrine.functions.text.slug_ascii` on ASCII input.
def _slug(c: str, sep: str = "-") -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '{sep}', 'g'), '{sep}')"


# ---- search and identity -----------------------------------------------------------------------

@query("search_tokens", f"""
    WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}._-]+'), lambda t: length(t) >= 2 AND NOT list_contains({_sql_list(T.STOP_WORDS)}, t)) AS l FROM documents),
    u AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS i FROM t), f AS (SELECT doc_id, term, min(i) AS i FROM u GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
    SELECT term, count(*) AS n FROM n WHERE k <= 8 GROUP BY term""")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(T.search_terms(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("search_terms_all", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def search_terms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.all_terms_in(F.lower("text"), F.array(F.lit("the"), F.lit("license")))).select("doc_id")


_PTYPE = [("laptop", T.QUERY_LAPTOP), ("desktop", T.QUERY_DESKTOP), ("component", T.QUERY_COMPONENT)]


@query("product_type_rules", f"""SELECT doc_id, {_rules("q", _PTYPE, "''")} AS inferred, CASE WHEN {_any("q", T.DRAFT_LAPTOP)} THEN 'laptop' WHEN {_any("q", T.QUERY_DESKTOP)} THEN 'desktop' WHEN {_any("lower(source || ' ' || lang)", T.DRAFT_COMPONENT)} THEN 'component' ELSE 'other' END AS guessed
    FROM (SELECT *, lower(source || ' ' || lang || ' ' || text) AS q FROM documents)""")
def product_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat_ws(" ", "source", "lang", "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.infer_product_type(q).alias("inferred"), T.guess_product_type(F.col("source"), F.col("lang"), F.col("text")).alias("guessed"))


@query("ram_in_text", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 64 AS DOUBLE) + CASE WHEN o_custkey % 3 = 1 THEN 0.5 ELSE 0 END END AS ram FROM orders")
def ram_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    n = (k % 64).cast("string")
    sentence = F.when(k % 3 == 0, F.concat(F.lit("laptop number "), n)).when(k % 3 == 1, F.concat(F.lit("ноутбук с "), n, F.lit(",5 ГБ памяти"))).otherwise(F.concat(F.lit("with "), n, F.lit("gb RAM")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.ram_gb(sentence).alias("ram"))


@query("identity_key", f"SELECT p_partkey, {_slug('p_brand || chr(32) || p_name')} AS key, 'brand-' || sha1('!!') AS no_brand, {_slug('p_brand')} AS brand FROM part".replace("sha1('!!')", "'" + __import__("hashlib").sha1(b"!!").hexdigest() + "'"))
def identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.identity_key(F.col("p_brand"), F.lit(None).cast("string"), F.col("p_name")).alias("key"), N.brand_slug(F.lit("!!")).alias("no_brand"), N.brand_slug(F.col("p_brand")).alias("brand"))


_GEN = _sql_list(T.GENERIC_WORDS)


@query("identity_match", f"""
    WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', p_name, p_type, p_brand, 'x' || p_partkey)), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_GEN}, t))) AS tokens,
                 lower('https://shop.example/' || CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '-') ELSE replace(p_name || ' ' || p_type, ' ', '+') END) AS url FROM part),
    i AS (SELECT p_partkey, list_filter(tokens, lambda t: contains(url, t)) AS inside FROM t)
    SELECT p_partkey, len(list_filter(inside, lambda t: length(t) >= 4 AND ((regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]')) OR regexp_full_match(t, '[0-9]+')))) > 0 OR len(inside) >= 3 AS supported FROM i""")
def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind, key = F.col("p_name"), F.col("p_type"), F.col("p_partkey")
    tokens = T.identity_tokens(name, kind, F.col("p_brand"), F.concat(F.lit("x"), key.cast("string")))
    tail = F.when(key % 3 == 0, F.concat(F.lit("x"), key.cast("string"))).when(key % 3 == 1, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(F.replace(F.concat_ws(" ", name, kind), F.lit(" "), F.lit("+")))
    # a plus sign in an address decodes to a space, which no token holds
    return table(spark, sf_dir, "part").select("p_partkey", T.identity_supported(tokens, F.concat(F.lit("https://shop.example/"), tail)).alias("supported"))


@query("image_search_relevance", """SELECT p_partkey, len(list_filter(list_distinct(string_split(p_name, ' ')), lambda t: contains(' ' || p_name || ' vs ' || p_type || ' ', t))) * 10 - 30 AS score, 1 AS n_queries FROM part""".replace("contains(' ' || p_name || ' vs ' || p_type || ' ', t)", "length(t) >= 2"))
def image_search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    tokens = T.identity_tokens(name, least=2, generic=T.IMAGE_STOP_WORDS)
    title = F.concat(name, F.lit(" vs "), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.relevance_score(title, tokens).alias("score"), F.size(T.image_queries(F.lit(""), F.upper(name), name)).alias("n_queries"))


# ---- attributes --------------------------------------------------------------------------------


#: Labels of specifications with the key they stand for; null where the label itself gives it.
_LABELS = [
    ("CPU model", "cpu"), ("Frame rate", "ram"), ("Screen size", "screen_size"), ("Экран", "display"), ("Battery life (h)", None), ("Graphics memory", "gpu"), ("Системная память: оперативная", "ram"), ("SSD", "storage"), ("Refresh rate of the screen", "refresh_rate"), ("Диагональ экрана", "screen_size"),
    ("Видеокарта", "gpu"), ("Частота", "refresh_rate"), ("Процессор", "cpu"), ("Weight", None), ("Video processor", "cpu"), ("Накопитель", "storage"), ("Touch display", "display"), ("Ports & slots", None),
]


@query("attribute_keys", f"""SELECT p_partkey, coalesce(m.key, {_slug("lower(m.label || ' ' || p_size)", "_")}) AS key FROM part JOIN (VALUES {', '.join(f"({k}, '{label}', {'NULL' if key is None else chr(39) + key + chr(39)})" for k, (label, key) in enumerate(_LABELS))}) m(k, label, key) ON m.k = p_partkey % {len(_LABELS)}""")
def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x, _ in _LABELS]), (F.col("p_partkey") % len(_LABELS) + 1).cast("int")), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_attribute_key(label).alias("key"))


@query("typed_values", """SELECT p_partkey, CASE WHEN k = 'cpu' THEN 'text' ELSE 'number' END AS data_type, CASE WHEN k <> 'cpu' THEN (p_size + 0.5) * CASE WHEN k = 'storage' THEN 1024 ELSE 1 END END AS number, CASE k WHEN 'ram' THEN 'GB' WHEN 'storage' THEN 'GB' WHEN 'refresh_rate' THEN 'Hz' END AS unit
    FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'ram' WHEN 1 THEN 'storage' WHEN 2 THEN 'refresh_rate' ELSE 'cpu' END AS k FROM part)""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    key = F.when(m == 0, "ram").when(m == 1, "storage").when(m == 2, "refresh_rate").otherwise("cpu")
    value = F.concat(F.lit("about "), F.col("p_size").cast("string"), F.lit(",5 TB"))
    return table(spark, sf_dir, "part").select("p_partkey", T.typed_value(key, value).alias("t")).select("p_partkey", "t.data_type", "t.number", "t.unit")


@query("normalized_values", "SELECT p_partkey, lower(trim(CASE WHEN p_size % 3 = 0 THEN '  ' || p_brand || ' ' ELSE p_type END)) AS v, regexp_replace(trim(p_name), ' +', ' ', 'g') AS squished FROM part")
def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))).when(F.col("p_size") % 3 == 1, "").otherwise("0")
    return table(spark, sf_dir, "part").select("p_partkey", T.normalized_value(F.col("p_type"), given).alias("v"), T.squish(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")))).alias("squished"))


# ---- cleaning, errors, captions ----------------------------------------------------------------


@query("clean_texts", r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '**', ''), '__', ''), '`', ''), '###', ''), '##', ''), '[ \t]+', ' ', 'g'), '(?:\r\n|\n|\r){3,}', chr(10) || chr(10), 'g'), ' ')) AS n FROM pages""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.clean(F.col("html"))).cast("long").alias("n"))


#: Sentences, and whether they speak of the search.
_SAID = [
    ("This is the Closest  match we have", True), ("a light laptop with a bright screen", False), ("closest neighbour of the match", False), ("not confirmed by any shop", True), ("НЕ Подтвержден: цена", True), ("Цена по запросу", True), ("подтвержден", False), ("According\nto the page", True),
    ("an accord to all", False), ("made by AI", True), ("a main aim", False), ("uncertainties remain", True), ("certain", False), ("Cena není uvedena", True), ("cena je uvedena", False), ("sources indicate so", True), ("open source", False), ("search result", True), ("research results", True), ("price is not available", True), ("priceless", False),
]


#: The same phrases as the engine's pattern, one by one, as they stand in a lower-case text with single blanks.
_PHRASES = [
    *(f"closest {a}{b}" for a in ("", "current ") for b in ("match", "product")), "family level match", "family-level match", "family match", "match for", "requested product", "user request", "search result", "search found", "product found", "exact sku",
    "not confirmed", "could not confirm", "could not verify", "confidence score", "mismatch", "uncertaint", *(f"source{s} {v}" for s in ("", "s") for v in ("show", "indicate", "list")),
    *(f"{o} {p} {v}" for o in ("official", "manufacturer", "retailer") for p in ("site", "page", "pages", "source", "sources") for v in ("confirm", "show", "list", "indicate")), "according to", "neural network",
    *(f"price {i}{n}{w}" for i in ("", "is ") for n in ("", "not ") for w in ("available", "provided")), "по запрос", "ближайш", "найден", "совпаден", "источник", "не подтвержден", "уверенност", "несоответств", "за запит", "знайден", "джерел", "невідповід",
    "cena není uvedena", "nalezen", "zdroj",
]


@query("reasoning_texts", f"""SELECT doc_id, len(list_filter([{', '.join(f"'{x}'" for x in _PHRASES)}], lambda x: contains(t, x))) > 0 OR regexp_matches(t, '(^|[^\\pL\\pN_])ai([^\\pL\\pN_]|$)') AS reasoning
    FROM (SELECT doc_id, regexp_replace(lower(text || ' ' || said || '. ' || text), '[\\s\\pZ]+', ' ', 'g') AS t FROM documents JOIN (VALUES {', '.join(f"({k}, '{x}')" for k, (x, _) in enumerate(_SAID))}) s(k, said) ON k = doc_id % {len(_SAID)})""")
def reasoning_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences on the search and harmless ones, within the documents' own texts."""
    said = F.element_at(F.array(*[F.lit(x) for x, _ in _SAID]), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.has_reasoning(F.concat(F.col("text"), F.lit(" "), said, F.lit(". "), F.col("text"))).alias("reasoning"))


@query("technical_descriptions", """SELECT p_partkey, p_name || '.' || CASE WHEN contains(lower(p_name), lower(p_brand)) THEN '' ELSE ' Model: ' || p_brand || '. Color: red.' END || ' Specifications: Size: ' || p_size || '; Type: ' || p_type || '.' AS description FROM part""")
def technical_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = lambda key, name, value: F.struct(F.lit(key).alias("key"), F.lit(name).cast("string").alias("name"), value.alias("value"))
    specs = F.array(spec("size", "Size", F.col("p_size").cast("string")), spec("type", "Type", F.col("p_type")), spec("type", "Type", F.col("p_type")), spec("none", "None", F.lit(" ")))
    routed = T.routed_description(F.col("p_name"), F.col("p_brand"), F.lit("red"), specs, F.lit("Sources show the closest match"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", routed["description"].alias("description"))


@query("redact_errors", "SELECT doc_id, left(regexp_replace('key sk-' || doc_id || '_x ' || text, '(sk-[A-Za-z0-9_-]+)', '[redacted]', 'g'), 500) AS message FROM documents")
def redact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.concat(F.lit("key sk-"), F.col("doc_id").cast("string"), F.lit("_x "), F.col("text"))).alias("message"))


#: Messages of services with their class, whether they are tried again, and the kind of failure.
_MESSAGES = [
    ("You exceeded your current quota", "quota", False, "ai_error"), ("Billing hard limit: insufficient_quota", "quota", False, "ai_error"), ("Your credit balance is too low", "quota", False, "ai_error"), ("429 quota exceeded", "quota", False, "ai_rate_limited"),
    ("model_not_found: x", "unknown_model", False, "ai_error"), ("The model `m` does not exist", "unknown_model", False, "ai_error"), ("No such model", "unknown_model", False, "ai_error"), ("HTTP 401", "credentials", False, "ai_error"), ("Incorrect API key provided", "credentials", False, "ai_error"),
    ("Unauthorized: connection closed", "credentials", False, "ai_transient"), ("Maximum context reached", "context_length", False, "ai_error"), ("too many tokens: timed out", "context_length", False, "ai_timeout"), ("HTTP 429", "rate_limit", True, "ai_rate_limited"), ("Rate limit hit, timeout", "rate_limit", True, "ai_rate_limited"),
    ("Request timed out", "timeout", True, "ai_timeout"), ("Gateway TIMEOUT", "timeout", True, "ai_timeout"), ("SSL handshake", "network", True, "ai_error"), ("Connection reset by peer", "network", True, "ai_transient"), ("Could not resolve host", "network", True, "ai_error"), ("Temporarily overloaded", "other", False, "ai_transient"), ("Boom", "other", False, "ai_error"),
]


@query("classify_errors", f"""SELECT event_id, m.class, m.retryable, m.kind FROM events JOIN (VALUES {', '.join(f"({k}, '{c}', {str(r).lower()}, '{kind}')" for k, (_, c, r, kind) in enumerate(_MESSAGES))}) m(k, class, retryable, kind) ON m.k = event_id % {len(_MESSAGES)}""")
def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat_ws(" ", F.element_at(F.array(*[F.lit(m) for m, *_ in _MESSAGES]), (F.col("event_id") % len(_MESSAGES) + 1).cast("int")), F.lit("for user"), (F.col("user_id") % 100).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.classify_error(message).alias("c"), T.failure_kind(message).alias("kind")).select("event_id", "c.class", "c.retryable", "kind")


@query("captions", """SELECT doc_id, lang || left(text, greatest(0, 1016 - length(lang) - length(source))) || source AS caption, source || regexp_replace(text, '^[^\\r\\n]*', '') AS first_line,
    lang || CASE WHEN length(text) <= 4096 - length(lang) THEN text ELSE '…' || chr(10) || right(text, 4094 - length(lang)) END AS tail FROM documents""")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.caption(F.col("lang"), F.col("text"), F.col("source")).alias("caption"), T.with_first_line(F.col("text"), F.col("source")).alias("first_line"), T.log_tail(F.col("text"), F.col("lang")).alias("tail"))


@query("commands", "SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'show' WHEN 1 THEN 'approve' END AS verb, CASE o_custkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey END AS id, CASE o_custkey % 3 WHEN 1 THEN o_custkey END AS second_id FROM orders")
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("/Show "), k.cast("string"))).when(k % 3 == 1, F.concat_ws(":", F.lit("approve"), o.cast("string"), k.cast("string"))).otherwise("just some words here")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.command(said).alias("c")).select("o_orderkey", "c.verb", "c.id", "c.second_id")


@query("labels_and_lists", """SELECT s_suppkey, regexp_replace(printf('%.4f', s_suppkey / 8.0), '\\.?0+$', '') AS price, format('{:,}', s_suppkey * 1000) || ' tokens' AS footnote, ['a', 'b c', CAST(s_suppkey AS VARCHAR)] AS items, s_suppkey % 2 = 0 AS currency,
    CASE WHEN s_suppkey % 2 = 0 THEN 'abc_' || s_suppkey ELSE sha256('a b ' || s_suppkey) END AS secret, CASE WHEN s_suppkey % 2 = 0 THEN 'Reply to: x' || chr(10) || chr(10) || 'y' ELSE 'y' END AS prompt, CASE s_suppkey % 3 WHEN 0 THEN '🧠' WHEN 1 THEN '💾' ELSE '•' END AS sign FROM supplier""")
def labels_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = k.cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", T.price_label(k / 8).alias("price"), T.usage_footnote(k * 1000, F.lit(None).cast("double")).alias("footnote"), T.parse_list(F.concat(F.lit("a, b c\n,"), s)).alias("items"),
        T.is_currency(F.when(k % 2 == 0, "czk").otherwise("c1k")).alias("currency"), T.keep_or_hash_secret(F.when(k % 2 == 0, F.concat(F.lit("abc_"), s)).otherwise(F.concat(F.lit("a b "), s))).alias("secret"),
        T.reply_prompt(F.lit("y"), F.when(k % 2 == 0, "x")).alias("prompt"), T.spec_sign(F.when(k % 3 == 0, "CPU").when(k % 3 == 1, "Memory").otherwise("Ports")).alias("sign"))


@query("operation_keys", "SELECT count(DISTINCT (user_id, event_type)) AS distinct_keys, count(*) AS n FROM events")
def operation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    key = N.operation_key(F.col("user_id"), F.lit("tool"), F.col("event_type"), none, none, F.lit("{}"))
    return table(spark, sf_dir, "events").agg(F.count_distinct(key).alias("distinct_keys"), F.count(F.lit(1)).alias("n"))


@query("variant_fingerprints", "SELECT count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) AS fingerprints FROM lineitem")
def variant_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    a, b = spec("Status", F.col("l_linestatus")), spec("line", F.col("l_linenumber").cast("string"))
    specs = F.when(F.col("l_orderkey") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a))
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct(N.variant_fingerprint(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag")).otherwise(F.concat(F.lit(" "), F.lower("l_returnflag"))), specs)).alias("fingerprints"))


@query("content_names", "SELECT doc_id, lang || '-' || left(sha256(text), 12) || '.webp' AS name FROM documents")
def content_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.content_name(F.col("lang"), F.col("text").cast("binary")).alias("name"))


# ---- addresses ---------------------------------------------------------------------------------

_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^.*?www\\.', '')"
_HOST_OF, _PATH_OF = "lower(regexp_extract(address, '^[A-Za-z]+://([^/:?#]+)', 1))", "regexp_extract(address, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"


@query("url_host", f"SELECT page_id, {_HOST} AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '\\.([^./]+)$', 1)) AS extension FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.host(u).alias("host"), U.origin(u).alias("origin"), U.extension(u).alias("extension"))


@query("url_absolute", with_bound("""
    , c AS (SELECT page_id, candidate AS c, regexp_extract(page, '^([a-z]+)://', 1) AS scheme, regexp_extract(page, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_replace(regexp_extract(page, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder FROM candidates)
    SELECT page_id, CASE WHEN lower(left(c, 7)) = 'http://' OR lower(left(c, 8)) = 'https://' THEN c WHEN left(c, 2) = '//' THEN scheme || ':' || c WHEN left(c, 1) = '/' THEN root || c ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || c END AS url FROM c""", "candidates"))
def url_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "candidates").select("page_id", U.absolute(F.col("candidate"), F.col("page")).alias("url"))


@query("url_normalize", with_bound(f"""
    , a AS (SELECT page_id, address AS u, {_HOST_OF} AS host, {_PATH_OF} AS path, p_name, lpad(CAST(page_id * 7919 % 100000 AS VARCHAR), 8, '0') AS code FROM addresses JOIN part ON p_partkey = page_id + 1)
    SELECT page_id, CASE WHEN contains(host, 'dlcdnwebimgs.asus.com') THEN regexp_replace(u, '//w(48|64|96|184)([?]|$)', '//w800', 'g') WHEN ends_with(host, '.media-amazon.com') THEN regexp_replace(u, '[.]_[^/]+([.](jpe?g|png|webp)($|[?]))', '\\1', 'gi')
           WHEN contains(lower(path), '/is/image/') THEN regexp_replace(regexp_replace(u, '([?&](wid|hei))=[0-9]+', '\\1=1500', 'gi'), '[?&]scl=[0-9]+', '', 'gi') ELSE u END AS url,
           CASE page_id % 3 WHEN 0 THEN 'https://www.amazon.de/dp/B0' || code WHEN 1 THEN 'https://amazonia.example.com/dp/b0' || code ELSE 'https://www.amazon.co.uk/gp/b0' || code END AS page FROM a""", "addresses"))
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "addresses").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("page_id") + 1)
    code = F.lpad((F.col("page_id") * 7919 % 100000).cast("string"), 8, "0")
    k = F.col("page_id") % 3
    page = F.when(k == 0, F.concat(F.lit("https://www.amazon.de/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/dp/b0"), code, F.lit("/ref=sr_1?x=1"))).when(k == 1, F.concat(F.lit("https://amazonia.example.com/dp/b0"), code)).otherwise(F.concat(F.lit("https://www.amazon.co.uk/gp/b0"), code))
    return rows.select("page_id", U.upgraded(F.col("address")).alias("url"), U.canonical_page(page).alias("page"))


@query("url_asset_key", with_bound(f"""
    , a AS (SELECT page_id, address AS u, {_HOST_OF} AS host, {_PATH_OF} AS path, regexp_extract(address, '[?]([^#]*)', 1) AS query FROM addresses),
    n AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(path, 'images([0-9]+)x', 1), '') AS INT), 0) AS a1, coalesce(TRY_CAST(nullif(regexp_extract('&' || query, '&(?:width|w)=([0-9]+)', 1), '') AS INT), 0) AS a2, coalesce(TRY_CAST(nullif(regexp_extract(path, '[.]_(?:AC_)?S[LXY]([0-9]+)', 1), '') AS INT), 0) AS a3 FROM a)
    SELECT page_id, CASE WHEN ends_with(host, 'bhphoto.com') THEN 'bh:' || lower(regexp_extract(path, '([^/]*)$', 1)) WHEN ends_with(host, 'media-amazon.com') THEN 'amazon:' || lower(regexp_replace(path, '[.]_[^/]+([.][^./]+)$', '\\1'))
           WHEN contains(path, '/is/image/') THEN 'dynamic-image:' || host || lower(path) ELSE replace(replace(replace(replace(u, '?width=640&id=7', '?id=7'), '?q=80&w=1200', ''), '?fit=crop', ''), '?#', '#') END AS asset, greatest(a1, a2, a3) AS quality FROM n""", "addresses"))
def url_asset_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "addresses").select("page_id", U.asset_key(F.col("address")).alias("asset"), U.quality_score(F.col("address")).alias("quality"))


@query("url_gates", with_bound(f"""
    , a AS (SELECT page_id, lower(address) AS low, {_HOST_OF} AS host, lower({_PATH_OF}) AS path FROM addresses)
    SELECT page_id, regexp_matches(low, 'logo|favicon|sprite|placeholder|thumb|/small/|_small|tracking|pixel[.]|[.]svg|/header/|/icons/|/w48|/w64|/w96|/w184|avatar|icon-|/icon/|/flags/|locale-flag|/blogs/|banner') AS junk,
           NOT regexp_matches(low, 'logo|favicon|sprite|placeholder|[.]svg|/header/|/icons/|/w48|/w64|/w96|/w184') AND (regexp_matches(low, '[.](jpe?g|png|webp|avif)([?]|$)') OR regexp_matches(low, '/[wh]([3-9][0-9][0-9])([?/]|$)') OR regexp_matches(low, '/[wh][3-9][0-9]{{3,}}([?/]|$)')) AS catalog_image,
           regexp_matches(path, '[.](pdf|docx?|xlsx?|pptx?|zip|rar|7z|csv|xml|json)$') AS document,
           NOT regexp_matches(path, '[.](pdf|docx?|xlsx?|csv|zip)$') AND NOT regexp_matches(host, 'psref[.]lenovo[.]com|energystar[.]gov|support[.]lenovo[.]com') AND NOT regexp_matches(low, '/support/|/drivers/|/manual|spec[.]pdf|datasheet|certificate') AS html_source,
           starts_with(low, 'http') AND NOT regexp_matches(host, '^(.*[.])?localhost$') AND NOT regexp_matches(host, '^(10|127|0)[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]') AS public FROM a""", "addresses"))
def url_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("address")
    return bound(spark, sf_dir, "addresses").select("page_id", U.is_junk(u).alias("junk"), U.is_catalog_image(u).alias("catalog_image"), U.is_document(u).alias("document"), U.is_html_source(u).alias("html_source"), U.is_public(u).alias("public"))


@query("url_candidates", with_bound(r"""
    , c AS (SELECT page_id, trim(replace(replace(candidate, '\\/', '/'), '&amp;', '&')) AS c, regexp_extract(page, '^([a-z]+)://', 1) AS scheme, regexp_extract(page, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_replace(regexp_extract(page, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder FROM candidates),
    w AS (SELECT page_id, c, CASE WHEN regexp_matches(c, '^(?i)https?://') THEN c WHEN starts_with(c, '//') THEN scheme || ':' || c WHEN starts_with(c, '/') THEN root || c ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || c END AS whole FROM c)
    SELECT page_id, CASE WHEN c <> '' AND NOT regexp_matches(lower(c), '^(#|data:|blob:)|logo|favicon|sprite|placeholder|thumb|/small/|_small|tracking|pixel[.]') THEN whole END AS page_image FROM w""".replace("\\\\/", "\\/"), "candidates"))
def url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "candidates").select("page_id", U.image_candidate(F.col("candidate"), F.col("page")).alias("page_image"))


@query("browser_candidates", with_bound(f"""
    , a AS (SELECT page_id, {_HOST_OF} AS host, CASE WHEN ends_with({_HOST_OF}, 'bhphoto.com') THEN replace(replace(address, '/multiple_images/thumbnails/', '/multiple_images/images500x500/'), '/images/smallimages/', '/images/images500x500/') ELSE address END AS u FROM addresses),
    b AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(u, '(?i)images([0-9]+)x[0-9]+', 1), '') AS INT), 0) AS size FROM a)
    SELECT page_id, CASE WHEN NOT size BETWEEN 1 AND 199 AND NOT regexp_matches(lower(u), '[.](svg|gif|ico|pdf|html?|json|xml)($|[?#])') AND NOT regexp_matches(lower(u), '(^|[/_.?&=-])(video|poster|spin|360(view|degree)?)([/_.?&=-]|$)')
           AND NOT regexp_matches(lower(u), 'logo|icon|sprite|badge|avatar|tracking|pixel|oldiemessage|/images/fb/|favicon|social') THEN u END AS image FROM b WHERE starts_with(u, 'http')""", "addresses"))
def browser_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "addresses").where("address LIKE 'http%'").select("page_id", U.browser_candidate(F.col("address"), F.col("page")).alias("image"))


@query("address_ranges", """SELECT s_suppkey, s_suppkey % 256 IN (0, 10, 127) OR (s_suppkey % 256 = 172 AND s_suppkey % 40 BETWEEN 16 AND 31) OR s_suppkey % 256 >= 224 OR (s_suppkey % 256 = 192 AND s_suppkey % 40 = 0) OR (s_suppkey % 256 = 198 AND s_suppkey % 40 IN (18, 19)) AS blocked FROM supplier""")
def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat_ws(".", (k % 256).cast("string"), (k % 40).cast("string"), F.lit("7"), F.lit("9"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", U.is_blocked_ipv4(name).alias("blocked"))


# ---- pages -------------------------------------------------------------------------------------


@query("page_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("link"))


@query("page_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query("page_access_gate", "SELECT page_id, page_id % 3 = 0 OR contains(lower(regexp_replace(html, '<[^>]*>', '', 'g')), 'access denied') AS gate, CASE WHEN page_id % 5 = 0 THEN 'http_403' WHEN page_id % 3 = 0 THEN 'captcha' END AS signal FROM pages")
def page_access_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    body = F.when(k % 3 == 0, F.concat(F.col("html"), F.lit("<p>Robot <b>check</b></p> robot check"))).otherwise(F.col("html"))
    small = F.when(k % 3 == 0, "captcha").otherwise("hello")
    return table(spark, sf_dir, "pages").select("page_id", U.is_access_gate(body).alias("gate"), U.access_signal(F.when(k % 5 == 0, 403).otherwise(200), small).alias("signal"))


_BODIES = ["%PDF-1.7", "  <!DOCTYPE html><p>", "hello", "<HTML lang=en>", "[1, 2]", "<head><title>x", "\n\t<body class=a>", "<htmlx>"]
_KINDS = ["text/html", "TEXT/HTML; charset=utf-8", "image/png", "", "application/octet-stream", "text/plain", "application/xhtml+xml"]


@query("page_kind", f"""
    WITH b AS (SELECT page_id, lower({_sql_list(_BODIES)}[page_id % 8 + 1]) AS body, lower({_sql_list(_KINDS)}[page_id % 7 + 1]) AS kind FROM pages)
    SELECT page_id, CASE WHEN left(body, 5) = '%pdf-' OR left(body, 1) = '[' THEN false WHEN contains(kind, 'text/html') OR contains(kind, 'xhtml') THEN true WHEN kind = 'image/png' THEN false
           ELSE regexp_matches(body, '^[ \\t\\n]*<(!doctype html|html[ >]|head[ >]|body[ >])') END AS is_html FROM b""")
def page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", U.is_html_body(pick(_BODIES), pick(_KINDS)).alias("is_html"))


PAGE_GALLERY_SQL = """
    WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, range(length(url) % 3 + 1) AS n, length(url) % 2 = 0 AS meta, length(url) % 5 = 0 AS sets FROM pages),
    l AS (SELECT url, root, list_transform(n, lambda i: '/z' || i || '.jpg') || list_transform(n, lambda i: '/s' || i || '.jpg') || CASE WHEN meta THEN ['/og.webp'] ELSE [] END || ['/o.jpg'] || CASE WHEN sets THEN ['/t2.jpg', '/t1.jpg'] ELSE [] END AS images FROM p)
    SELECT url, CAST(unnest(range(1, len(images) + 1)) AS INT) AS pos, root || unnest(images) AS image FROM l"""


@query("page_gallery", PAGE_GALLERY_SQL)
def page_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of every page before which stands a gallery of one to three pictures, some with a meta tag or a srcset, and pictures outside it; large pictures come first."""
    k = F.length("url")
    pictures = F.array_join(F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.concat(F.lit('<img src="/s'), i.cast("string"), F.lit('.jpg" data-zoom-image="/z'), i.cast("string"), F.lit('.jpg">'))), "")
    meta = F.when(k % 2 == 0, '<meta property="og:image" content="/og.webp">').otherwise("")
    sets = F.when(k % 5 == 0, '<picture><source srcset="/t1.jpg 1x, /t2.jpg 2x"></picture>').otherwise("")
    pages = table(spark, sf_dir, "pages").select("url", F.concat(meta, F.lit('<div class="Product-Gallery">'), pictures, sets, F.lit('</div><img data-src="/o.jpg" src="/logo.png">'), F.col("html")).alias("body"))
    return H.gallery(pages)


@query("srcset_order", """SELECT page_id, list_reverse(list_transform(range(page_id % 5 + 1), lambda i: url || '/' || i || '.jpg')) AS urls FROM pages""")
def srcset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A srcset of one to five sizes of the page's own picture, with gaps and odd spaces."""
    sizes = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 5).cast("int")), lambda i: F.concat(F.lit(" "), F.col("url"), F.lit("/"), i.cast("string"), F.lit(".jpg  "), ((i + 1) * 300).cast("string"), F.lit("w ")))
    return table(spark, sf_dir, "pages").select("page_id", U.srcset_urls(F.concat(F.lit(","), F.array_join(sizes, ","), F.lit(", ,"))).alias("urls"))


@query("script_images", with_bound(f"""
    , p AS (SELECT page_id, address, CASE WHEN regexp_matches(address, '^(?i)https?://') AND NOT regexp_matches(lower(address), 'logo|favicon|sprite|placeholder|tracking|pixel[.]') THEN regexp_extract(address, '(?i)^https?://.+?[.](?:jpe?g|png|webp|avif)(?:[?].*)?') ELSE '' END AS u FROM addresses)
    SELECT page_id, CASE WHEN u = '' THEN ['https://cdn.example/b.webp'] ELSE [u, 'https://cdn.example/b.webp'] END AS urls, CASE page_id % 3 WHEN 0 THEN [page_id || '.png'] WHEN 1 THEN []::VARCHAR[] ELSE ['x' || page_id || '.jpg', 'y.png'] END AS backgrounds,
           CASE WHEN page_id % 2 = 0 THEN page_id + 0.5 END::DOUBLE AS price, CAST(page_id % 9 + 1 AS INT) AS shown, CAST(page_id % 9 + 3 AS INT) AS of_all FROM p""", "addresses"))
def script_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts with the page's address twice, once with escaped slashes, and a second picture; styles, prices and counts by page."""
    k = F.col("page_id")
    s = k.cast("string")
    escaped = F.replace(F.col("address"), F.lit("/"), F.lit("\\/"))
    script = F.concat(F.lit('{"u":"'), escaped, F.lit('","v":"https://cdn.example/b.webp","w":"'), F.col("address"), F.lit('","l":"https://cdn.example/logo.png"}'))
    style = F.when(k % 3 == 0, F.concat(F.lit("background: url('"), s, F.lit(".png') no-repeat"))).when(k % 3 == 1, "color: red").otherwise(F.concat(F.lit("a{background:URL( x"), s, F.lit('.jpg )} b{background-image:url("y.png")}')))
    counts = T.of_counts(F.concat(F.lit("Image "), (k % 9 + 1).cast("string"), F.when(k % 2 == 0, " of ").otherwise("/"), (k % 9 + 3).cast("string")))
    price = F.concat(F.lit("<div> "), F.when(k % 2 == 0, "Input").otherwise("Output"), F.lit("</div>\n <div class='x'>$"), s, F.lit(".5</div>"))
    return bound(spark, sf_dir, "addresses").select(
        "page_id", U.script_image_urls(script).alias("urls"), U.background_urls(style).alias("backgrounds"), T.price_after_label(price, "Input").alias("price"), counts[0]["at"].alias("shown"), counts[0]["of"].alias("of_all"))


@query("sanitized_pages", r"SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|svg\b.*?</svg\s*>)', '', 'g'), '(?i)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|''[^'']*''|[^\s>]+)', '', 'g'), '\s+', ' ', 'g')), 1600) AS markup FROM pages".replace('\\"', '"'))
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.sanitized_markup(F.col("html")).alias("markup"))


_SELECTORS = [".gallery img", "a[href^=javascript:x]", "#main > img", " ", "iframe.video", "img[data-src]", "xpath=//img", "div.Script", "a[href^=https://x]", "p.description", "IFRAME", "ul li:nth-child(2)", "file:///etc", ".framed", ""]


@query("safe_selectors", f"""SELECT s_suppkey, trim(x) <> '' AND NOT regexp_matches(lower(x), 'javascript:|https?:|file:|xpath|script([^a-z0-9_]|$)|iframe([^a-z0-9_]|$)') AS safe FROM (SELECT s_suppkey, {_sql_list(_SELECTORS)}[s_suppkey % {len(_SELECTORS)} + 1] AS x FROM supplier)""")
def safe_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    selector = F.element_at(F.array(*map(F.lit, _SELECTORS)), (F.col("s_suppkey") % len(_SELECTORS) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", U.is_safe_selector(selector).alias("safe"))


@query("draft_payloads", """SELECT p_partkey, p_name AS title, 1.0 AS confidence, 2 AS n_specs, ['https://shop.example/' || p_partkey, 'https://a.example/x'] AS urls, ['retailer', 'web'] AS types FROM part""".replace("1.0 AS confidence", "CAST(1 AS DOUBLE) AS confidence"))
def draft_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_partkey").cast("string")
    schema = "struct<title:string,brand:string,model:string,specifications:array<struct<key:string,name:string,value:string>>,sources:array<struct<title:string,url:string,type:string,image_urls:array<string>>>,image_urls:array<string>,primary_source_url:string,confidence:double>"
    body = F.concat(
        F.lit('{"title":" '), F.col("p_name"), F.lit(' ","specifications":[{"key":"A B","value":"1"},{"name":"C","value":"2"},{"key":"d","value":" "}],"sources":[{"url":"https://a.example/x","type":"blog"},{"url":"nonsense"},{"url":"https://shop.example/'), s,
        F.lit('","type":"retailer","title":"Shop"},{"url":"https://a.example/x","type":"web"}],"primary_source_url":"https://shop.example/'), s, F.lit('","confidence":1.5}'))
    dealt = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition("p_partkey")  # a small file is one task however much work its rows are
    drafts = dealt.select("p_partkey", F.from_json(body, schema).alias("draft")).select("p_partkey", P.normalized_draft(F.col("draft")).alias("d"))
    rows = drafts.select("p_partkey", "d.title", "d.confidence", F.size("d.specifications").alias("n_specs"), F.col("d.sources").alias("sources"))
    return rows.select("p_partkey", "title", "confidence", "n_specs", F.transform("sources", lambda x: x["url"]).alias("urls"), F.transform("sources", lambda x: x["type"]).alias("types"))


@query("payload_lists", """
    WITH s AS (SELECT s_suppkey, s_suppkey % 5 AS a, s_suppkey % 3 AS b, s_suppkey % 12 AS n FROM supplier)
    SELECT s_suppkey, (SELECT coalesce(list(v ORDER BY i), []) FROM (SELECT v, min(i) AS i FROM (VALUES (a, 1), (s_suppkey, 2), (b, 3)) t(v, i) WHERE v > 0 GROUP BY v)) AS ids, CASE WHEN a = s_suppkey THEN [a] ELSE [a, s_suppkey] END AS messages,
           CASE WHEN b = 0 THEN ['x' || a] ELSE ['x' || a, 'X' || (a + b)] END AS spellings, CASE WHEN n = 0 THEN NULL ELSE 'w1' END AS first, list_transform(range(greatest(0, n - 2), n), lambda i: 'w' || (i + 1)) AS tail, b <> 2 AS permutation FROM s""")
def payload_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose members, repeats and lengths follow the supplier's number."""
    from vitrine.operators.windows import is_permutation

    k = F.col("s_suppkey")
    a, b, n = k % 5, k % 3, (k % 12).cast("int")
    word = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("w"), i.cast("string"))))
    text_of = lambda c: c.cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", P.positive_ids(F.array(text_of(a), F.lit("-1"), text_of(k), F.lit("x"), text_of(b), text_of(a))).alias("ids"),
        P.message_ids(F.concat(F.lit('{"message":{"message_id": '), text_of(a), F.lit(',"r":{"message_id":'), text_of(k), F.lit('}},"message_id":'), text_of(a), F.lit("}"))).alias("messages"),
        P.distinct_ci(F.array(F.concat(F.lit("x"), text_of(a)), F.concat(F.lit("X"), text_of(a + b)), F.concat(F.lit("X"), text_of(a)))).alias("spellings"), P.first_where(word, lambda x: x.startswith("w")).alias("first"), P.last(word, 2).alias("tail"),
        is_permutation(F.when(b == 0, F.array(F.lit(2), F.lit(3), F.lit(1))).when(b == 1, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(2), F.lit(1))), F.lit(3)).alias("permutation"))


@query("discovered_urls", """
    WITH s AS (SELECT s_suppkey, list_transform(range(s_suppkey % 4), lambda i: ['https://p' || i || '.example/' || s_suppkey % 7 || '.jpg', 'nonsense ' || i, 'https://p.example/' || (s_suppkey + i) % 3 || '.jpg']) AS paired, ['https://f.example/' || s_suppkey || '.jpg', 'x'] AS flat FROM supplier)
    SELECT s_suppkey, CASE WHEN len(paired) = 0 THEN [flat[1]] ELSE (SELECT list(u ORDER BY i) FROM (SELECT u, min(i) AS i FROM (SELECT unnest(flatten(paired)) AS u, unnest(range(len(flatten(paired)))) AS i) WHERE starts_with(u, 'https://') GROUP BY u)) END AS urls FROM s""")
def discovered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discoveries with none to three pages, each with three picture addresses, one of them no address and one shared."""
    k = F.col("s_suppkey")
    pages = F.when(k % 4 == 0, F.array().cast("array<struct<page_url:string,image_urls:array<string>>>")).otherwise(F.transform(F.sequence(F.lit(0), (k % 4).cast("int") - 1), lambda i: F.struct(
        F.concat(F.lit("https://p"), i.cast("string"), F.lit(".example")).alias("page_url"),
        F.array(F.concat(F.lit("https://p"), i.cast("string"), F.lit(".example/"), (k % 7).cast("string"), F.lit(".jpg")), F.concat(F.lit("nonsense "), i.cast("string")), F.concat(F.lit("https://p.example/"), ((k + i) % 3).cast("string"), F.lit(".jpg"))).alias("image_urls"))))
    body = F.to_json(F.struct(pages.alias("sources"), F.array(F.concat(F.lit("https://f.example/"), k.cast("string"), F.lit(".jpg")), F.lit("x")).alias("image_urls")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.discovered_urls(P.parsed(body, "discovery")).alias("urls"))


@query("cleaned_recipes", f"""
    WITH s AS (SELECT s_suppkey, list_transform(range(s_suppkey % 30), lambda i: ' ' || {_sql_list(_SELECTORS)}[(s_suppkey + i) % {len(_SELECTORS)} + 1]) AS asked FROM supplier),
    u AS (SELECT s_suppkey, trim(unnest(asked)) AS x, unnest(range(len(asked))) AS i FROM s),
    d AS (SELECT s_suppkey, x, min(i) AS i FROM u WHERE x <> '' AND NOT regexp_matches(lower(x), 'javascript:|https?:|file:|xpath|script([^a-z0-9_]|$)|iframe([^a-z0-9_]|$)') GROUP BY s_suppkey, x)
    SELECT s.s_suppkey, coalesce((SELECT list(x ORDER BY i) FROM d WHERE d.s_suppkey = s.s_suppkey), []) AS collect, CAST(least(40, greatest(0, s.s_suppkey - 20)) AS INT) AS clicks, CAST(CASE WHEN s.s_suppkey % 3 = 0 THEN 500 ELSE least(5000, greatest(100, s.s_suppkey * 70)) END AS INT) AS wait, CASE WHEN s.s_suppkey % 2 = 0 THEN ['data-src', 'data-' || s.s_suppkey] ELSE ['data-src'] END AS attributes FROM s""")
def cleaned_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes with up to 29 selectors, safe and unsafe, repeated; numbers below, within and above their bounds."""
    k = F.col("s_suppkey")
    known = F.array(*map(F.lit, _SELECTORS))
    asked = F.when(k % 30 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (k % 30).cast("int") - 1), lambda i: F.concat(F.lit(" "), F.element_at(known, ((k + i) % len(_SELECTORS) + 1).cast("int")))))
    attributes = F.array(F.lit("DATA-src"), F.when(k % 2 == 0, F.concat(F.lit("Data-"), k.cast("string"))).otherwise("data-SRC"), F.lit("data-src"))
    body = F.to_json(F.struct(asked.alias("collect_selectors"), attributes.alias("attributes"), (k - 20).cast("int").alias("max_clicks"), F.when(k % 3 != 0, (k * 70).cast("int")).alias("wait_ms")))
    r = P.cleaned_recipe(P.parsed(body, "recipe"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r["collect_selectors"].alias("collect"), r["max_clicks"].alias("clicks"), r["wait_ms"].alias("wait"), r["attributes"].alias("attributes"))
