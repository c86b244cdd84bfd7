"""Keyed changes of tables as joins: insert-if-absent, upsert, staged replacement, cascades and the approval of drafts.

Each function returns the table after the change, so that a job can write it as a new version;
running one again on its own result changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import numbers as N
from vitrine.functions import text as T
from vitrine.functions.urls import host
from vitrine.schemas import CATEGORY_OF_TYPE, FILTERABLE_ATTRIBUTES, VOCABULARIES


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added, the first of equal keys."""
    w = Window.partitionBy(*keys).orderBy(*rows.columns)
    once = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return table.unionByName(once.join(table, keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """New values over old ones by key; a null keeps the old. ``rules`` give columns of their own from ``o.x`` and ``n.x``."""
    o, n = table.alias("o"), rows.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    has = set(rows.columns)
    value = lambda c: (rules or {}).get(c, F.coalesce(f"n.{c}", f"o.{c}") if c in has else F.col(f"o.{c}"))
    return o.join(n, on, "full").select(*[value(c).alias(c) for c in table.columns])


def higher_confidence() -> Column:
    return F.greatest(F.coalesce("o.confidence", F.lit(0).cast("decimal(5,4)")), F.coalesce("n.confidence", F.lit(0).cast("decimal(5,4)")))


def first_published(now: Column) -> Column:
    """The first publication stays."""
    return F.coalesce("o.published_at", now)


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(F.col(key)), key, "left_anti")


def on_delete(child: DataFrame, gone: DataFrame, reference: str, action: str) -> DataFrame:
    """What a parent's deletion does to a child table: ``cascade``, ``null`` or ``restrict`` (the rows that forbid it)."""
    parents = gone.select(F.col("id").alias(reference))
    if action == "cascade":
        return child.join(parents, reference, "left_anti")
    if action == "null":
        marked = child.join(parents.withColumn("__gone", F.lit(True)), reference, "left")
        return marked.withColumn(reference, F.when(F.col("__gone").isNull(), F.col(reference))).select(*child.columns)
    return child.join(parents, reference, "left_semi")


def staged_actions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action) of a replacement by a staged set: keep, add or drop; an empty staged set keeps everything."""
    o, n = old.select(*keys).distinct().withColumn("__o", F.lit(True)), new.select(*keys).distinct().withColumn("__n", F.lit(True))
    owner = keys[0]
    staged_owner = new.select(owner).distinct().withColumn("__any", F.lit(True))
    joined = o.join(n, keys, "full").join(staged_owner, owner, "left")
    action = F.when(F.col("__o").isNotNull() & F.col("__n").isNotNull(), "keep").when(F.col("__n").isNotNull(), "add").when(F.col("__any").isNull(), "keep").otherwise("drop")
    return joined.select(*keys, action.alias("action"))


def orphan_definitions(definitions: DataFrame, values: DataFrame, whitelist: list[str]) -> DataFrame:
    """Definitions without a value that are not on the whitelist."""
    return definitions.where(~F.col("key").isin(whitelist)).join(values.select(F.col("attribute_definition_id").alias("id")), "id", "left_anti")


def restored(versions: DataFrame, wanted: DataFrame, next_id: Column, at: Column) -> DataFrame:
    """Log of versions with one more row for each restored version: its content under a new id."""
    again = versions.join(wanted.select("id"), "id", "left_semi").withColumn("id", next_id + F.row_number().over(Window.partitionBy("recipe_id").orderBy("id")))
    return versions.unionByName(again.withColumns({"trigger": F.lit("restore"), "created_at": at}))


def unique_slugs(rows: DataFrame, taken: DataFrame, slug: str = "slug", key: str = "id") -> DataFrame:
    """Slugs that are taken, or taken twice, get ``-key`` behind them."""
    known = taken.select(F.col("slug").alias(slug)).distinct().withColumn("__taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy(slug).orderBy(key)) == 1
    joined = rows.join(known, slug, "left").withColumn("__first", first)
    return joined.withColumn(slug, F.when(F.col("__taken").isNull() & F.col("__first"), F.col(slug)).otherwise(F.concat(slug, F.lit("-"), F.col(key).cast("string")))).select(*rows.columns)


def validated_change(price: Column, quantity: Column, stock_status: Column, currency: Column) -> Column:
    """Why a change of a variant is refused; null if it is not."""
    return (
        F.when(price < 0, "price_negative").when(quantity < 0, "quantity_negative")
        .when(stock_status.isNotNull() & ~stock_status.isin(VOCABULARIES["stock_status"]), "stock_status_unknown")
        .when(currency.isNotNull() & ~T.is_currency(currency), "currency_malformed")
    )


# ---- drafts ------------------------------------------------------------------------------------


def good_drafts(drafts: DataFrame, media: DataFrame, side: int = 450) -> DataFrame:
    """Pending drafts without a picture under the minimum."""
    small = media.where(F.coalesce(F.col("width") < side, F.lit(False)) | F.coalesce(F.col("height") < side, F.lit(False))).select(F.col("product_draft_id").alias("id"))
    return drafts.where("status = 'pending_review'").join(small, "id", "left_anti")


def draft_types(drafts: DataFrame) -> DataFrame:
    """Drafts with a trusted or guessed type and the category slug it falls back to."""
    guess = T.guess_product_type(F.col("title"), F.col("model"), F.to_json("specifications"))
    kind = F.when(F.col("product_type").isin(VOCABULARIES["product_type"]), F.col("product_type")).otherwise(guess)
    slugs = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_TYPE.items() for x in pair])
    return drafts.withColumn("product_type", kind).withColumn("fallback_category", F.coalesce(F.try_element_at(slugs, F.col("product_type")), F.lit("other-tech")))


def approved(drafts: DataFrame, categories: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The rows that approved drafts become: products, variants, attribute definitions and values, sources and brands, each with its natural key."""
    dealt = drafts.repartition("id")  # a small file is one task however much work its rows are
    d = draft_types(dealt).withColumn("canonical_key", N.identity_key(F.col("brand"), F.col("model"), F.col("title")))
    d = d.withColumn("__text", T.routed_description(F.col("title"), F.col("model"), F.col("color"), F.col("specifications"), F.col("description"), F.col("research_notes")))
    known = categories.select(F.col("slug").alias("category"), F.col("id").alias("__own"))
    fallback = categories.select(F.col("slug").alias("fallback_category"), F.col("id").alias("__fallback"))
    d = d.join(known, "category", "left").join(fallback, "fallback_category", "left").withColumn("category_id", F.coalesce("__own", "__fallback"))
    d = d.withColumn("__slug", T.slug(F.col("title")))
    latest = d.groupBy("canonical_key").agg(F.max_by(F.struct(*d.columns), "id").alias("r"), F.max("confidence").alias("__confidence"))
    products = latest.select(
        "canonical_key", F.when(F.col("r.__slug") != "", F.col("r.__slug")).otherwise("product").alias("slug"), "r.category_id", N.brand_slug(F.col("r.brand")).alias("brand_slug"), "r.product_type",
        F.lit("published").alias("status"), "r.title", "r.model", F.col("r.__text.description").alias("description"), F.col("__confidence").alias("confidence"), F.lit(True).alias("is_active"), now.alias("published_at"),
    )
    brands = d.where("brand IS NOT NULL AND brand <> ''").groupBy(N.brand_slug(F.col("brand")).alias("slug")).agg(F.min_by("brand", "id").alias("name"))
    specs = d.select("id", "canonical_key", "color", F.posexplode_outer("specifications").alias("pos", "s"))
    fingerprints = d.withColumn("fingerprint", N.variant_fingerprint(F.col("color"), F.coalesce("specifications", F.array().cast("array<struct<key:string,name:string,value:string>>"))))
    once = fingerprints.groupBy("canonical_key", "fingerprint").agg(F.min("id").alias("draft_id"), F.first("color").alias("color"))
    variants = once.withColumn("is_default", F.row_number().over(Window.partitionBy("canonical_key").orderBy("draft_id")) == 1)
    label = F.coalesce(F.nullif(F.trim("s.name"), F.lit("")), F.col("s.key"))
    keyed = specs.where("s IS NOT NULL AND trim(s.value) <> ''").withColumn("key", T.canonical_attribute_key(label)).withColumn("label", T.canonical_label(F.col("key"), label))
    typed = keyed.withColumn("typed", T.typed_value(F.col("key"), F.col("s.value")))
    definitions = typed.groupBy("key").agg(F.min_by("label", F.struct("id", "pos")).alias("label"), F.max("typed.data_type").alias("data_type"), F.max("typed.unit").alias("default_unit"), F.col("key").isin(FILTERABLE_ATTRIBUTES).alias("is_filterable"))
    owner = F.when(F.col("key").isin(FILTERABLE_ATTRIBUTES), "variant").otherwise("product")
    values = typed.groupBy("canonical_key", "key", owner.alias("owner")).agg(F.max_by(F.struct(F.col("s.value").alias("value"), F.col("typed.number").alias("numeric_value"), F.col("typed.unit").alias("unit")), F.struct("id", "pos")).alias("v"))
    values = values.select("canonical_key", "key", "owner", "v.value", F.lower(F.trim("v.value")).alias("normalized_value"), F.col("v.numeric_value").cast("decimal(14,4)").alias("numeric_value"), "v.unit")
    sources = d.select("canonical_key", "id", "confidence", F.explode("sources").alias("s")).groupBy("canonical_key", F.col("s.url").alias("url")).agg(F.max_by("s.title", "id").alias("title"), F.max_by("s.type", "id").alias("source_type"), F.max("confidence").alias("confidence"))
    return {"brands": brands, "products": products, "variants": variants, "attribute_definitions": definitions, "attribute_values": values, "sources": sources.withColumn("domain", host(F.col("url")))}


def rejected(drafts: DataFrame, ids: DataFrame) -> DataFrame:
    marked = drafts.join(ids.select("id").withColumn("__no", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("__no").isNotNull() & (F.col("status") == "pending_review"), "rejected").otherwise(F.col("status"))).select(*drafts.columns)


def deletions(events: DataFrame) -> DataFrame:
    """Two-phase deletions from their events (id, product_id, user_id, chat_id, action, at): the state of each request.

    A request prepared by a user in a chat is confirmed or cancelled by the first later event of the
    same user and chat on it.
    """
    prepared = events.where("action = 'prepare'").select("product_id", "user_id", "chat_id", F.col("id").alias("request"), F.col("at").alias("prepared_at"))
    answers = events.where("action IN ('confirm', 'cancel')").select("product_id", "user_id", "chat_id", "action", "id", "at")
    joined = prepared.join(answers, ["product_id", "user_id", "chat_id"], "left").where("at IS NULL OR (at >= prepared_at AND id > request)")
    first = joined.groupBy("request").agg(F.min_by("action", F.struct("at", "id")).alias("answer"))
    return prepared.join(first, "request", "left").withColumn("state", F.when(F.col("answer") == "confirm", "deleted").when(F.col("answer") == "cancel", "cancelled").otherwise("pending"))
