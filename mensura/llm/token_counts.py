"""Token counts as delta-maintained rollups.

Changes to a corpus arrive in batches of rows with the counts before and after: an insert has only `after`, a
delete only `before`, a revised count both.  A commit turns a batch into signed, already summed deltas by source,
language and tokenizer version, and writes them as one folder named after the batch.  Totals are the sum of all
deltas.  A batch whose folder is complete is not written again, and an incomplete one is overwritten as a whole, so
a commit can be repeated any number of times.

Null sources and languages are groups of their own; null texts and null counts count as 0; repeated rows count
each time; a group whose rows have all been deleted is not reported.  An empty batch commits and changes nothing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, table

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "chars"]
#: Tokenizer versions that plain patterns express: runs without white space, and runs of Latin letters or digits.
PATTERNS = {"space-1": "[^\\x20\\x09-\\x0D]+", "alnum-1": "[0-9A-Za-z\\x{C0}-\\x{24F}]+"}


def counted(docs: DataFrame, tokenizer: str, tokens: Column | None = None) -> DataFrame:
    """source, lang, tokenizer, tokens, chars of every document; tokens (as bpe.token_count gives them) for versions that no
    pattern expresses."""
    tokens = F.regexp_count("text", F.lit(PATTERNS[tokenizer])) if tokens is None else tokens
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), count(tokens).alias("tokens"), count(F.length("text")).alias("chars"))


def changes(before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Signed rows of a batch: minus what was, plus what is.  A revised count is in both."""
    signed = [d.select(*KEYS, F.lit(sign).cast("long").alias("docs"), *[(F.lit(sign) * F.coalesce(F.col(m).cast("long"), F.lit(0))).alias(m) for m in MEASURES[1:]]) for sign, d in ((-1, before), (1, after)) if d is not None]
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


class Rollup:
    """Totals by source, language and tokenizer version, kept in one folder per committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[str]:
        """The folders of complete batches, by name."""
        files, path = self._files(self.path)
        if not files.exists(path):
            return []
        folders = sorted(str(x.getPath()) for x in files.listStatus(path) if x.isDirectory())
        return [f for f in folders if files.exists(self._files(f"{f}/_SUCCESS")[1])]

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Adds a batch once; False if it had been committed before.  Sums are partial in every task before the shuffle and
        written by as many tasks as the groups need; the folder counts once its _SUCCESS is there."""
        folder = f"{self.path}/batch={batch}"
        files, done = self._files(f"{folder}/_SUCCESS")
        if files.exists(done):
            return False
        sums = signed.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        sums.write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        """Sums over complete batches; those begun and not finished don't count."""
        schema = ", ".join([f"{k} string" for k in KEYS] + [f"{m} long" for m in MEASURES])
        folders = self.committed()
        deltas = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return deltas.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).filter("docs != 0 OR tokens != 0 OR chars != 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after six commits over all documents: provisional counts (a quarter of the characters), their revision to
    counted tokens, a second tokenizer version, the deletion of all that it had brought in and its insertion again, and
    the revision once more, which changes nothing.  Null texts count 0 tokens, null sources and languages are groups of
    their own, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, os.path.join(checkpoint_dir(spark), f"rollup-{uuid.uuid4().hex}"))
    guessed = counted(docs, "space-1", F.floor(F.length("text") / 4))
    revised, runs = changes(before=guessed, after=counted(docs, "space-1")), counted(docs, "alnum-1")
    rollup.commit("0001-provisional", changes(after=guessed))
    rollup.commit("0002-revised", revised)
    rollup.commit("0003-second-tokenizer", changes(after=runs))
    rollup.commit("0004-deleted", changes(before=runs))
    rollup.commit("0005-inserted-again", changes(after=runs))
    rollup.commit("0002-revised", revised)
    return rollup.totals()


SQL = """
SELECT source, lang, 'space-1' AS tokenizer, count(*) AS docs,
  CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars
FROM documents GROUP BY source, lang
UNION ALL
SELECT source, lang, 'alnum-1', count(*),
  CAST(sum(coalesce(len(regexp_extract_all(text, '[0-9A-Za-z\\x{C0}-\\x{24F}]+')), 0)) AS BIGINT), CAST(sum(coalesce(length(text), 0)) AS BIGINT)
FROM documents GROUP BY source, lang
"""
