"""Token counts as delta-maintained rollups.

The totals of (source, lang, tokenizer) are sums of committed signed deltas: an insert adds a
document and its tokens, a delete takes them away, a revised count is a delete of the old count
and an insert of the new one. A batch of deltas is summed per key and written to a folder of its
own; a batch whose folder has been committed is left as it is, so a batch that is sent
again changes nothing, and a write that broke off is overwritten by the next try (Spark commits
the folder with ``_SUCCESS`` at the end). ``compact`` folds what has been committed into a new
generation of the totals, which names the batches it holds; ``totals`` reads the latest whole
generation and the batches committed since, and nothing that has not been committed.

Tokenizers are column functions with a name and version. ``bpe`` makes one from a byte-pair vocabulary file;
the path is a parameter.

Cases: a null text has no tokens but is a document; null source or lang is a key of its own; keys
whose totals return to zero stay as zero rows; an empty batch commits nothing but its folder; a
rollup without a committed batch has no rows; a batch may have any name but the empty one; repeated
rows count each time; other columns are not read. One writer at a time: two that send the same batch at once
write the same rows, two that compact at once make the same generation.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import n_words, shared_dir

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def _pieces(text: Column) -> Column:
    """Runs of letters or digits, and single other signs, are tokens of their own."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long")


#: name and version -> count of a text's tokens
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words-1": n_words, "pieces-1": _pieces}


def bpe(path: str, pattern: str) -> Callable[[Column], Column]:
    """A tokenizer from a byte-pair vocabulary file (base64 token and rank a line), run on Arrow batches."""
    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return text.fillna("").map(lambda t: len(encoding.encode_ordinary(t)))

    return count


def counts(text: Column, tokenizers: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """An array of a text's token counts by tokenizer."""
    return F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(text).alias("tokens")) for name, count in (tokenizers or TOKENIZERS).items()])


def counted(documents: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, source, lang and an array of token counts by tokenizer: rows without text, to be joined with what is known of the documents."""
    return documents.select("doc_id", "source", "lang", counts(F.col("text"), tokenizers).alias("counts"))


def deltas(rows: DataFrame, sign: int = 1) -> DataFrame:
    """A signed row for each counted document and tokenizer: source, lang, tokenizer, docs, tokens."""
    return rows.select("source", "lang", F.explode("counts").alias("t")).select("source", "lang", "t.tokenizer", F.lit(sign).cast("long").alias("docs"), (F.col("t.tokens") * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The deltas that replace the ``old`` counts of documents by ``new`` ones."""
    return deltas(old, -1).unionByName(deltas(new, 1))


class Rollup:
    """Totals below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/rollup"

    def _batch(self, batch: str) -> str:
        if not batch:
            raise ValueError("a batch needs a name")
        return f"{self.path}/batches/b-{quote(batch, safe='')}"

    def _whole(self, folder: str) -> list[str]:
        """Names of the committed folders below ``folder``."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(f.getPath().getName() for f in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return [unquote(name[2:]) for name in self._whole(f"{self.path}/batches")]

    def committed(self, batch: str) -> bool:
        return batch in self.batches()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` as ``batch``; False, and no change, if it has been added before."""
        folder = self._batch(batch)
        if self.committed(batch):
            return False
        self._summed(changes).write.mode("overwrite").parquet(folder)
        return True

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def _latest(self) -> tuple[int, set[str]]:
        """Number of the latest generation, and the batches it holds."""
        whole = [int(name) for name in self._whole(f"{self.path}/totals")]
        if not whole:
            return 0, set()
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/held/{max(whole)}")
        return max(whole), {r["batch"] for r in held.collect()}  # a name for each batch

    def totals(self) -> DataFrame:
        """Documents and tokens of each key over all committed batches."""
        generation, held = self._latest()
        folders = [f"{self.path}/totals/{generation}"] if generation else []
        folders += [self._batch(b) for b in self.batches() if b not in held]
        rows = self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)
        return self._summed(rows)

    def compact(self) -> int:
        """Fold the committed batches into a new generation of the totals, unless the latest holds them all; its number."""
        generation, held = self._latest()
        now = self.batches()
        if held == set(now):
            return generation
        rows = self.totals()
        # the totals are written last: a generation counts only once they are whole
        self.spark.createDataFrame([(b,) for b in now], "batch string").write.mode("overwrite").parquet(f"{self.path}/held/{generation + 1}")
        rows.write.mode("overwrite").parquet(f"{self.path}/totals/{generation + 1}")
        return generation + 1
