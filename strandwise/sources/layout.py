"""Tables laid out so that a query reads few files and few row groups (M7, N3).

The writer deals rows into ranges of (top dimension, sort columns), sorts them there and
keeps a folder per value of the top dimension, so each file spans a short range of its
columns; Parquet keeps least and greatest values per row group and page, and Bloom filters
for columns that are asked by equality but not sorted by. A table beside the data holds the
ends per file, so that a read names only the files that can hold rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.columns import all_of, any_of, known_equal, one_of
from strandwise.functions.staging import _delete
from strandwise.operators.predicates import in_range
from strandwise.operators.sampling import sample_prune

FOLDER = "_folder"


class LaidOutTable:
    """The table in ``path``, a folder that driver and executors share.

    ``by`` is the top dimension (few values), ``sort`` orders the rows of each; a hot value
    is dealt into many files. ``described`` are further columns whose ends are kept per file.
    Folders are named by a hash of the value, so any text may be one; the column itself
    stays in the files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str, sort: Sequence[str], described: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.by, self.sort = spark, path.rstrip("/"), schema, by, list(sort)
        self.described = list(dict.fromkeys([by, *sort, *described]))

    def write(self, rows: DataFrame, bloom: Mapping[str, int] | None = None, rows_per_file: int = 0, row_group_bytes: int = 128 << 20, parts: int | None = None) -> None:
        """Replaces the table. ``bloom`` gives the distinct values to expect in a row group
        per column that gets a Bloom filter; ``parts`` is left to Spark if not given.
        A write that dies leaves no table of files, so nothing half-written is read."""
        order = [FOLDER, self.by, *self.sort]
        folder = F.lower(F.hex(F.xxhash64(self.by)))
        dealt = rows.withColumn(FOLDER, folder).repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
        out = dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(FOLDER)
        out = out.option("parquet.block.size", row_group_bytes).option("maxRecordsPerFile", rows_per_file)
        for c, distinct in (bloom or {}).items():
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", distinct)
        _delete(self.spark, self._files)
        out.parquet(self.path)
        self._ends().write.parquet(self._files)

    def _ends(self) -> DataFrame:
        """A row per file. The described columns alone are read; a file is one row from each
        task that reads it, and its name is cut from its path on that row."""
        path = F.col("_metadata.file_path").alias("_path")
        ends = [f(c).alias(f"{c}_{name}") for c in self.described for name, f in (("min", F.min), ("max", F.max))]
        found = self._read().groupBy(path).agg(F.count("*").alias("n_rows"), *ends)
        return found.select(F.regexp_extract("_path", "([^/]+/[^/]+)$", 1).alias("file"), *found.columns[1:])

    @property
    def _files(self) -> str:
        return f"{self.path}_files"

    def _read(self, files: Sequence[str] = ()) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/{f}" for f in files)) if files else reader.parquet(self.path)

    def files(self, ranges: Mapping[str, tuple] | None = None, equal: Mapping[str, object] | None = None, by: Sequence | None = None) -> DataFrame:
        """The files that can hold rows a read asks for: ``file, n_rows`` and the ends
        ``<column>_min``, ``<column>_max`` of the described columns."""
        ends = {**(ranges or {}), **{c: (v, v) for c, v in (equal or {}).items()}}
        files = sample_prune(self.spark.read.parquet(self._files), {c: e for c, e in ends.items() if c in self.described})
        if by is not None:
            low, high = f"{self.by}_min", f"{self.by}_max"
            files = files.where(any_of([in_range(high, v) & in_range(low, None, v) for v in by if v is not None]))
        return files

    def read(self, ranges: Mapping[str, tuple] | None = None, equal: Mapping[str, object] | None = None, by: Sequence | None = None) -> DataFrame:
        """The rows that meet all inclusive ``ranges`` (either end may be None), equal
        ``equal`` and have one of ``by`` as top dimension; nulls never match."""
        conditions = [in_range(c, *ends) for c, ends in (ranges or {}).items()] + [known_equal(F.col(c), v) for c, v in (equal or {}).items()]
        if by is not None:
            conditions.append(one_of(F.col(self.by), by))
        if not conditions:
            return self._read()
        # names only, as the driver lists the files of any scan
        names = [r[0] for r in self.files(ranges, equal, by).select("file").collect()]
        return self._read(names).where(all_of(conditions)) if names else self.spark.createDataFrame([], self.schema)
