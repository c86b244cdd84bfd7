"""An inverted index of character grams for substring search, on files in a shared folder.

An owner's lines are told apart in slices of rows that come in order of their owners, and those of a slice are kept as one
text with ``APART`` between them; an owner with many lines has several. Lines that have that sign themselves are kept alone.

A line has as grams all its runs of three characters, and those of one and two for the terms that are shorter. A
posting row holds a gram, a block of ``BLOCK`` owner ids and the places in that block of owners that have the gram, so a
gram that everything has is spread over many rows; a gram and a block may have several. Grams are gathered block by block, from texts in order of their owners. Postings and gram counts lie in folders by the gram's
hash, texts in folders by their owner's id: a search reads the folders of the rarest grams of a term, and of
the texts only the folders where a candidate is. Candidates are then compared with the term itself, unless it is a gram.

Texts are added in named batches; a batch that is sent again replaces itself. All batches are searched together. Owners whose
texts change are to be built into a new index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import stored

#: Owner ids of one posting row at most, a power of two.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: Length of the long grams.
GRAM = 3
#: Bytes of a batch whose grams are gathered at a time; a longer text is gathered alone.
SIGNS = 1 << 21
#: Bytes of rows whose lines are told apart at a time.
LINES = 1 << 23
#: Between the lines of a text.
APART = "\0"


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.nbytes for b in held) >= least):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _sorted(numbers: np.ndarray) -> np.ndarray:
    """The different ones of some numbers that aren't negative, in ascending order; sorts them in place."""
    numbers.sort()
    return numbers[np.diff(numbers, prepend=-1) != 0]


def _split(owners: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Owners and texts of lists of texts, without nulls."""
    flat = lists.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    return owners[pc.list_parent_indices(lists).to_numpy()][there], flat.drop_null()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, text, lines): each line of an owner once a slice, from (owner, text, texts) in order of the owners.

    ``text`` has lines with ``APART`` between them; where some have that sign themselves, it is null and ``texts`` has them. Elsewhere
    ``texts`` is empty and not null, as Arrow's Java writer takes quadratic time for null lists.
    """
    for rows in _gathered(batches, LINES):
        owner, flat = _split(rows.column("owner").to_numpy(), pc.split_pattern(_chunk(rows.column("text")), APART))
        more, lines = _split(rows.column("owner").to_numpy(), _chunk(rows.column("texts")))
        if len(more):
            order = np.argsort(np.append(owner, more), kind="stable")
            owner, flat = np.append(owner, more)[order], pa.concat_arrays([flat, lines]).take(pa.array(order))
        if not len(owner):
            continue
        words = flat.dictionary_encode()
        starts = np.flatnonzero(np.append(True, np.diff(owner) != 0))
        known, most = owner[starts], len(words.dictionary)
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(owner))))
        own, code = np.divmod(_sorted(own * most + words.indices.to_numpy()), most)
        alone = pc.match_substring(words.dictionary, APART).to_numpy(zero_copy_only=False)[code]
        counts = np.bincount(own[~alone], minlength=len(known))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), words.dictionary.take(pa.array(code[~alone]))), APART)
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(known[some]), texts.filter(pa.array(some)), pa.array(counts[some], pa.int32())], ["owner", "text", "lines"])
        if alone.any():
            own, code = own[alone], code[alone]
            yield pa.RecordBatch.from_arrays([pa.array(known[own]), words.dictionary.take(pa.array(code)), pa.array(np.ones(len(own)), pa.int32())], ["owner", "text", "lines"])


def _signs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some texts, and how many each has."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
    signs = np.frombuffer(data, np.uint8)
    if not (signs >= 128).any():
        return signs, np.diff(ends)
    read = [text.decode("utf-8", "replace") for text in texts.to_pylist()]
    return np.frombuffer("".join(read).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, read), np.int64, len(read))


def _told_apart(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers below ``most`` in ascending order, and the place of each number among them."""
    if most > 16 * len(code) + (1 << 16):
        return np.unique(code, return_inverse=True)
    used = np.zeros(most, bool)
    used[code] = True
    return np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[code]


def _different(pairs: np.ndarray, most: int) -> np.ndarray:
    """The different numbers below ``most`` in ascending order: marked in a table where it is small beside them, else sorted."""
    if most > 16 * len(pairs) + (1 << 16):
        return _sorted(pairs)
    used = np.zeros(most, bool)
    used[pairs] = True
    return np.flatnonzero(used)


def postings_of(owners: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """(gram, block, owners) of some texts (large binary), each of an owner; the owners of a posting row by their places in its block."""
    known, own = np.unique(owners, return_inverse=True)
    signs, sizes = _signs(texts)
    letters, signs = _told_apart(signs, int(signs.max(initial=0)) + 1)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(signs))  # signs from here to the end of the text
    owner, code = np.repeat(own, sizes), signs.astype(np.int32 if len(letters) ** GRAM < 1 << 31 else np.int64)
    signs = code
    block_of, place_of = np.divmod(known, BLOCK)
    for n in range(1, GRAM + 1):
        if n > 1:
            code = code[:-1] * len(letters) + signs[n - 1 :]  # of the n signs from here
        whole = left[: len(code)] >= n
        codes, gram = _told_apart(code[whole], len(letters) ** n)
        pairs = _different(gram.astype(np.int64) * len(known) + owner[: len(code)][whole], len(codes) * len(known))
        gram, owner_of = np.divmod(pairs, max(1, len(known)))
        block, place = block_of[owner_of], place_of.astype(np.int16)[owner_of]
        rows = np.flatnonzero(np.append(True, (np.diff(gram) != 0) | (np.diff(block) != 0))[: len(pairs)])
        grams = pa.array(["".join(chr(letters[c // len(letters) ** (n - 1 - i) % len(letters)]) for i in range(n)) for c in codes.tolist()], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(rows, len(pairs)), pa.int32()), pa.array(place))
        yield pa.RecordBatch.from_arrays([grams.take(pa.array(gram[rows])), pa.array(block[rows], pa.int64()), lists], ["gram", "block", "owners"])


def _lines(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Owners and lines (large binary) of (owner, text) or (owner, text, lines)."""
    if "lines" not in rows.column_names:
        return rows.column("owner").to_numpy(), _chunk(rows.column("text").cast(pa.large_binary()))
    several = pc.greater(rows.column("lines"), 1)
    joined, alone = rows.filter(several), rows.filter(pc.invert(several))
    owners, texts = _split(joined.column("owner").to_numpy(), pc.split_pattern(_chunk(joined.column("text")), APART))
    return np.append(owners, alone.column("owner").to_numpy()), pa.concat_arrays([texts.cast(pa.large_binary()), _chunk(alone.column("text").cast(pa.large_binary()))])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of texts that come in order of their owners, about ``SIGNS`` bytes of text at a time."""
    for rows in _gathered(batches, SIGNS):
        owners, texts = _lines(rows)
        ends, start = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while start < len(owners):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SIGNS, "right")))
            yield from postings_of(owners[start:stop], texts.slice(start, stop - start))
            start = stop


def lowered(spark: SparkSession, term: str) -> str:
    """The term in lower case by the rules that the texts were lowered by."""
    return spark.range(1).select(F.lower(F.lit(term))).first()[0]


class TextIndex:
    """Substring search over (owner long, text) rows; the owners of a text are what a search finds."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 64, rarest: int = 3) -> None:
        self.spark, self.path, self.folders, self.rarest = spark, path.rstrip("/"), folders, rarest
        self._tables: dict[str, DataFrame] = {}

    def add(self, texts: DataFrame, batch: str = "0001") -> TextIndex:
        """Index a batch of (owner, text), or of (owner, texts) with several texts a row; null owners and texts are left out."""
        place = F.pmod("owner", F.lit(self.folders)).cast("int").alias("folder")
        several = F.col("texts") if "texts" in texts.columns else F.array("text")
        apart = F.contains(F.concat_ws("", several), F.lit(APART))  # a text has the sign itself
        lines = texts.where(F.col("owner").isNotNull() & F.array_max(several).isNotNull()).select(F.col("owner").cast("long").alias("owner"), F.when(~apart, F.concat_ws(APART, several)).alias("text"), F.when(apart, several).otherwise(F.array().cast("array<string>")).alias("texts"))
        packed = lines.hint("rebalance", F.col("owner")).sortWithinPartitions("owner").mapInArrow(_packed, "owner long, text string, lines int")
        path = f"{self.path}/texts/batch={batch}"
        packed.select("owner", F.lower("text").alias("text"), "lines", place).repartition("folder").sortWithinPartitions("folder", "owner").write.mode("overwrite").partitionBy("folder").parquet(path)
        written = self.spark.read.schema("owner long, text string, lines int, folder int").parquet(path)
        blocks = written.select("owner", "text", "lines", F.shiftright("owner", BLOCK_BITS).alias("block")).hint("rebalance", F.col("block")).sortWithinPartitions("owner")
        postings = blocks.select("owner", "text", "lines").mapInArrow(_posted, "gram string, block long, owners array<short>")
        bucket = F.pmod(F.crc32("gram"), F.lit(self.folders)).cast("int").alias("folder")
        postings.select("*", F.size("owners").alias("n"), bucket).repartition("folder").sortWithinPartitions("folder", "gram", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/postings/batch={batch}")
        self._tables.clear()
        return self

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the index, whose files are listed once until this object adds a batch."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.schema(f"{schema}, batch string, folder int").parquet(f"{self.path}/{name}")
        return self._tables[name]

    def _postings(self, wanted: list[str]) -> DataFrame:
        table = self._table("postings", "gram string, block long, owners array<short>, n int")
        return table.where(F.col("folder").isin(sorted({crc32(g.encode()) % self.folders for g in wanted})) & F.col("gram").isin(wanted))

    def candidates(self, term: str) -> DataFrame:
        """(owner): owners that have the rarest grams of the lower-case term; all that contain it are among them."""
        size = min(GRAM, len(term))
        own = sorted({term[i : i + size] for i in range(len(term) - size + 1)})
        counts = {r[0]: r[1] for r in self._postings(own).groupBy("gram").agg(F.sum("n")).collect()}  # a row for each gram of the term
        if len(counts) < len(own):
            return self.spark.createDataFrame([], "owner long")
        rarest = sorted(own, key=lambda g: (counts[g], g))[: self.rarest]
        per_gram = self._postings(rarest).groupBy("block", "gram").agg(F.flatten(F.collect_list("owners")).alias("owners"))
        blocks = per_gram.groupBy("block").agg(F.collect_list("owners").alias("lists")).where(F.size("lists") == len(rarest))
        common = F.aggregate("lists", F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        return blocks.select("block", F.explode(F.array_distinct(common)).alias("place")).select((F.col("block") * BLOCK + F.col("place")).alias("owner"))

    def _texts_of(self, owners: DataFrame) -> DataFrame:
        """(owner, text, lines) of some owners, from the folders where any of them is."""
        folders = [r[0] for r in owners.select(F.pmod("owner", F.lit(self.folders)).cast("int")).distinct().collect()]  # as many as folders at most
        table = self._table("texts", "owner long, text string, lines int")
        return table.where(F.col("folder").isin(folders)).join(owners, "owner", "left_semi").select("owner", "text", "lines")

    def texts_of(self, owners: DataFrame) -> DataFrame:
        """(owner, text): the lines of some owners, from the folders where any of them is."""
        lines = F.when(F.col("lines") > 1, F.split("text", APART)).otherwise(F.array("text"))
        return self._texts_of(owners).select("owner", F.explode(lines).alias("text"))

    def containing(self, term: str) -> DataFrame:
        """(owner): those with a text that contains the term, regardless of case and without wildcards; an empty term is in every text."""
        term = lowered(self.spark, term)
        if not term:
            return self._table("texts", "owner long, text string, lines int").select("owner").distinct()
        if len(term) <= GRAM:
            return self.candidates(term)  # a gram itself: its postings are the answer
        within = F.contains("text", F.lit(term))
        if APART in term:  # between two lines it is no find
            within &= F.col("lines") == 1
        return self._texts_of(stored(self.candidates(term), "candidates")).where(within).select("owner").distinct()

    def with_all(self, terms: list[str]) -> DataFrame:
        """(owner): those that have every term in one or another of their texts; without terms every owner."""
        return reduce(lambda a, b: a.join(b, "owner", "left_semi"), [self.containing(t) for t in terms or [""]])


def _own_texts(products: DataFrame, brands: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(owner, texts): title, model, description, brand and, if asked for, category of products."""
    fields = ["title", "model", "description", "__brand"]
    named = products.join(brands.select(F.col("id").alias("brand_id"), F.col("name").alias("__brand")), "brand_id", "left")
    if categories is not None:
        named, fields = named.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("__category")), "category_id", "left"), [*fields, "__category"]
    return named.select(F.col("id").alias("owner"), F.array(*fields).alias("texts"))


def _variant_values(variants: DataFrame, values: DataFrame) -> DataFrame:
    """(owner, attribute_definition_id, value) of the variants of products."""
    of = variants.select(F.col("id").alias("product_variant_id"), F.col("product_id").alias("owner"))
    return values.join(of, "product_variant_id").select("owner", "attribute_definition_id", "value")


def catalog_texts(products: DataFrame, brands: DataFrame, variants: DataFrame, values: DataFrame) -> DataFrame:
    """(owner, texts): what the catalogue page searches: title, model, description, brand, and codes and attribute values of the variants."""
    codes = variants.select(F.col("product_id").alias("owner"), F.array("sku", "mpn", "gtin").alias("texts"))
    return reduce(DataFrame.unionAll, [_own_texts(products, brands), codes, _variant_values(variants, values).select("owner", F.array("value").alias("texts"))])


def chat_texts(products: DataFrame, brands: DataFrame, categories: DataFrame, variants: DataFrame, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(owner, texts): what the chat bot searches: besides those the category, names and colours of variants, keys and labels of attributes, and the product's own attributes."""
    own = variants.select(F.col("product_id").alias("owner"), F.array("sku", "mpn", "gtin", "name", "color").alias("texts"))
    by_product = values.where("product_id IS NOT NULL").select(F.col("product_id").alias("owner"), "attribute_definition_id", "value")
    words = definitions.select(F.col("id").alias("attribute_definition_id"), "key", "label")
    named = _variant_values(variants, values).unionAll(by_product).join(words, "attribute_definition_id", "left")
    return reduce(DataFrame.unionAll, [_own_texts(products, brands, categories), own, named.select("owner", F.array("value", "key", "label").alias("texts"))])


def chat_lines(*tables: DataFrame) -> DataFrame:
    """(owner, text): the lines of :func:`chat_texts`, each of an owner once."""
    return chat_texts(*tables).select("owner", F.explode("texts").alias("text")).distinct()
