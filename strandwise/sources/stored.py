"""Tables on disk that change in place, by buckets of a key (A4, A6, D8).

Rows lie in one folder per bucket of the key's hash. A change reads the buckets of its keys
only, and puts new ones in their place by dynamic partition overwrite; files of all others
stay. Batches have ids, noted once they are done: one that comes again changes nothing, and
one that died half-way is simply done again, as it gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.staging import _delete, discard, stage
from strandwise.sources.tables import replace_partition, upsert

BUCKET = "_bucket"


class StoredTable:
    """The table in ``path``, a folder that driver and executors share. ``buckets`` bounds
    what a change must name to the driver; it stays the same for a table's life."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)  # a bucket with a hot key is split
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(list(buckets)))).drop(BUCKET)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket().alias(BUCKET)).distinct().collect())

    def _note(self, batch: int) -> str:
        return f"{self.path}_batches/{batch}"

    def has(self, batch: int) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._note(batch)}/_SUCCESS")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _change(self, keys: DataFrame, batch: int, make: Callable[[DataFrame], DataFrame]) -> bool:
        if self.has(batch):
            return False
        touched = self.buckets_of(keys)
        if touched:
            # written beside first: the buckets can't be read while they are replaced
            new = stage(make(self.read(touched)), "buckets")
            left = self.buckets_of(new)
            self._write(new)
            for bucket in set(touched) - set(left):
                _delete(self.spark, f"{self.path}/{BUCKET}={bucket}")
            discard(new)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._note(batch))
        return True

    def upsert(self, rows: DataFrame, ids: Sequence[str], stamp: str, batch: int) -> bool:
        """Inserts or updates rows by ``ids`` (the key among them), as ``tables.upsert`` does.
        Whether the batch was new. Fit for ``foreachBatch``."""
        rows = stage(rows, "batch")
        changed = self._change(rows, batch, lambda old: upsert(old, rows, ids, stamp))
        discard(rows)
        return changed

    def replace(self, keys: DataFrame, rows: DataFrame, batch: int) -> bool:
        """All rows of a set of keys deleted, ``rows`` (of these keys) inserted."""
        keys = keys.select(self.key).distinct()
        return self._change(keys, batch, lambda old: replace_partition(old, rows.select(*old.columns), keys, self.key))


def refresh(rollup: StoredTable, samples: StoredTable, keys: DataFrame, make: Callable[[DataFrame], DataFrame], batch: int) -> bool:
    """Brings the rows of changed ``keys`` in a stored roll-up up to date: of the samples,
    stored by the same key, only the buckets of these keys are read. ``make`` is the roll-up
    of any samples; a key that has none left loses its row."""
    keys = stage(keys.select(rollup.key).distinct(), "changed")
    mine = samples.read(samples.buckets_of(keys)).join(keys, samples.key, "left_semi")
    changed = rollup.replace(keys, make(mine), batch)
    discard(keys)
    return changed
