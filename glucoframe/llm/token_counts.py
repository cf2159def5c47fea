"""Delta-maintained token counts.

A rollup holds additive totals (documents, tokens) by source, language and
tokenizer version. Batches of signed changes keep it up to date: an insert adds a
document's counts, a delete takes them back, a revision is both. A batch is
summed up before it meets the rollup, so a commit costs what changed, not what is
stored.

A batch has an id. It is written as one partition of a log that names it; a batch
whose partition is already committed is skipped, and a half-written one is
overwritten as a whole, so a batch may be sent any number of times. Totals are the
sum of the committed partitions.

Defined results: null text has no tokens but is a document; null source or
language is a group of its own; groups whose documents are all gone vanish.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEYS = ("source", "lang", "tokenizer")
#: a tokenizer version: name -> count of tokens in a text column
TOKENIZERS = {
    "space@1": lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")),
    "alnum@1": lambda t: F.regexp_count(t, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")),
}


def counted(docs: DataFrame, tokenizers: Sequence[str], keep: Sequence[str] = (), **texts: Column) -> DataFrame:
    """Counts per document and tokenizer: one column for each of ``texts`` (default: n, of text).
    Small rows: join these, not the texts."""
    texts = {k: F.coalesce(t, F.lit("")) for k, t in (texts or {"n": F.col("text")}).items()}
    rows = F.array(*(F.struct(F.lit(t).alias("tokenizer"), *(TOKENIZERS[t](x).cast("long").alias(k) for k, x in texts.items()))
                     for t in tokenizers))
    return docs.select(*keep, "source", "lang", F.inline(rows))


def changes_of(counts: DataFrame, n: str = "n", sign: int = 1) -> DataFrame:
    """Signed totals of counted documents: (source, lang, tokenizer, docs, tokens)."""
    return counts.groupBy(*KEYS).agg((F.count(F.lit(1)) * sign).alias("docs"), (F.sum(n) * sign).alias("tokens"))


def token_changes(docs: DataFrame, tokenizers: Sequence[str], sign: int = 1) -> DataFrame:
    return changes_of(counted(docs, tokenizers), sign=sign)


def revisions(old: DataFrame, new: DataFrame, tokenizers: Sequence[str]) -> DataFrame:
    """Changes of documents that are replaced: the old counts go, the new ones come."""
    return summed(token_changes(old, tokenizers, -1).unionByName(token_changes(new, tokenizers, 1)))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept as a log of committed batches below ``path`` (a shared folder)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False (and nothing happens) if it was committed before. The marker of
        success is written last, so an interrupted batch is not seen and is written anew."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        summed(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def _batches(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(p)
                      if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def totals(self) -> DataFrame:
        paths = self._batches()
        fields = ", ".join(f"{k} string" for k in KEYS) + ", docs long, tokens long"
        if not paths:
            return self.spark.createDataFrame([], fields)
        try:
            log = self.spark.read.schema(fields).parquet(*paths)
        except AnalysisException as gone:
            raise RuntimeError("a committed batch was removed") from gone
        return summed(log).where("docs != 0 OR tokens != 0")
