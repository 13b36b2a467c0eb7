"""Sources and sinks (section A). Paths are anything that Spark's readers open; nothing
goes through local files of the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.functions.ordered import ordered


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold a JSON array of rows or of envelopes
    ``{"results": [...]}``, or a single one; for JSON lines there is ``read_lines``."""
    row = T.StructType.fromDDL(schema)
    envelope = T.StructType([*row.fields, T.StructField("results", T.ArrayType(row))])
    lines = spark.read.schema(envelope).json(path, multiLine=True)
    inner = lines.where("results is not null").select(F.explode("results").alias("r")).select("r.*")
    return lines.where("results is null").select(*row.names).unionByName(inner)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no JSON is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_snapshots(spark: SparkSession, path: str, schema: str, at: str = "generated_at") -> DataFrame:
    """A folder of JSON snapshots: the time from the body, else from the file's name
    (``YYYYMMDDTHHMMSS``); malformed files and files without a time are dropped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").json(path)
    named = F.regexp_extract(F.input_file_name(), "([0-9]{8}T[0-9]{6})[^/]*$", 1)
    time = F.coalesce(F.try_to_timestamp(F.col(at)), F.try_to_timestamp(F.nullif(named, F.lit("")), F.lit("yyyyMMdd'T'HHmmss")))
    return rows.withColumn("t", time).where("_bad is null and t is not null").drop("_bad")


def read_csv_rejects(spark: SparkSession, path: str, schema: str, subject: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows and, apart, the lines that do not fit the schema; rows of other
    subjects are skipped."""
    rows = spark.read.schema(f"{schema}, _line string").option("header", "true").option("columnNameOfCorruptRecord", "_line").csv(path)
    good = rows.where("_line is null").drop("_line")
    return (good.where(subject) if subject is not None else good), rows.where("_line is not null").select(F.col("_line").alias("line"))


def export_page(df: DataFrame, key: str, after, n: int, child: DataFrame | None = None, child_key: str | None = None) -> DataFrame:
    """The n rows after a key, in key order; with ``child``, its rows of that page's
    parents, so that a page ends on a parent's end."""
    rows = df.where(F.col(key) > after) if after is not None else df
    page = rows.orderBy(key).limit(n)
    if child is None:
        return page
    return child.join(page.select(F.col(key).alias(child_key)), child_key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Insert or update by key. A row whose data is equal (NULLs too) stays as it is,
    stamp included. One full join on the keys."""
    data = [c for c in old.columns if c not in keys and c != stamp]
    left = old.select(*keys, F.struct(*old.columns).alias("_old"))
    right = new.select(*keys, F.struct(*old.columns).alias("_new"))
    same = F.lit(True)
    for c in data:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    kept = F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & same), F.col("_old")).otherwise(F.col("_new"))
    return left.join(right, list(keys), "full_outer").select(kept.alias("r")).select("r.*")


def update_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows only, where a new row differs; ``changed`` says which."""
    data = [c for c in old.columns if c != key]
    fresh = new.select(key, F.struct(*data).alias("_new"))
    rows = old.join(fresh, key, "left")
    differs = F.coalesce(F.col("_new").isNotNull() & ~F.struct(*data).eqNullSafe(F.col("_new")), F.lit(False))
    return rows.select(key, *(F.when(differs, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in data), differs.alias("changed"))


def replace_partition(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows of a set of keys deleted, the new ones inserted."""
    return old.join(keys.select(key), key, "left_anti").unionByName(new)


def delimited(df: DataFrame, separator: str = "|") -> DataFrame:
    """Cells as clean text: arrays joined by a separator, tabs and line ends as spaces."""
    cells = [F.array_join(F.col(c).cast("array<string>"), separator) if t.startswith("array") else F.col(c).cast("string") for c, t in df.dtypes]
    return df.select(*(F.coalesce(F.regexp_replace(cell, "[\\t\\r\\n]+", " "), F.lit("")).alias(c) for cell, c in zip(cells, df.columns, strict=True)))


def write_delimited(df: DataFrame, path: str, separator: str = "\t", multi: str = "|") -> None:
    delimited(df, multi).write.option("header", "true").option("sep", separator).csv(path)


def places(names: DataFrame, name: str, place: str) -> DataFrame:
    """Distinct names with their places from 1 in order, ranked range by range."""
    return ordered(names.where(F.col(name).isNotNull()).select(name).distinct(), [F.col(name)], place)


def export_features(rows: DataFrame, row: str, symbol: Column) -> DataFrame:
    """``i, id, symbol, kind``: the feature table that belongs to the triples' rows; a
    feature without a symbol shows its id. Of several symbols the smallest is shown."""
    symbols = rows.groupBy(row).agg(F.min(symbol).alias("symbol"))
    named = places(symbols, row, "i").join(symbols, row)
    return named.select("i", F.col(row).alias("id"), F.coalesce(F.nullif(F.col("symbol"), F.lit("")), F.col(row).cast("string")).alias("symbol"), F.lit("Gene Expression").alias("kind"))


def export_cells(cells: DataFrame, column: str, attributes: Sequence[str]) -> DataFrame:
    """``j, cell`` and attributes as clean text: the cell table that belongs to the
    triples' columns, one row per cell. Of a repeated cell's rows the smallest counts, by
    the attributes in order."""
    one = cells.groupBy(column).agg(F.min(F.struct(*attributes)).alias("_row")).select(column, "_row.*")
    named = places(one, column, "j").join(one, column)
    return delimited(named.select("j", F.col(column).alias("cell"), *attributes)).withColumn("j", F.col("j").cast("int"))


def export_triples(long: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """1-based coordinate triples ``i, j, value`` of a long table, repeats summed. Places
    are those of ``export_features`` and ``export_cells`` over the same rows."""
    sums = long.groupBy(row, column).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("value"))
    return sums.join(places(long, row, "i"), row).join(places(long, column, "j"), column).select("i", "j", "value")


def triples_header(triples: DataFrame) -> DataFrame:
    """Rows, columns and number of values."""
    return triples.agg(F.max("i").alias("n_rows"), F.max("j").alias("n_columns"), F.count("*").alias("n_values"))


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "i", "j", "value").alias("value")).write.text(path)


def write_export(triples: DataFrame, features: DataFrame, cells: DataFrame, path: str) -> None:
    """A folder with the matrix (its header apart, to be put before its parts), the
    features and the cells."""
    one = F.lit(True)  # joins of one row each
    sizes = features.agg(F.count("*").alias("n")).join(cells.agg(F.count("*").alias("m")), one).join(triples.agg(F.count("*").alias("k")), one)
    head = F.concat_ws("\n", F.lit("%%MatrixMarket matrix coordinate real general"), F.concat_ws(" ", "n", "m", "k"))
    sizes.select(head.alias("value")).write.text(f"{path}/header")
    write_triples(triples, f"{path}/matrix")
    features.orderBy("i").select("id", "symbol", "kind").write.option("sep", "\t").option("compression", "gzip").csv(f"{path}/features")
    cells.orderBy("j").drop("j").write.option("header", "true").option("sep", "\t").option("compression", "gzip").csv(f"{path}/cells")


def flat_sample_table(samples: DataFrame, qc: DataFrame, studies: DataFrame, sample: str, study: str, least: float) -> DataFrame:
    """Samples with their QC and study columns and the gates derived from them."""
    rows = samples.join(qc, sample, "left").join(studies, study, "left")
    return rows.withColumn("gate", F.when(F.col("tier") == 2, "removed").when(F.col("weight") < least, "small").otherwise("ok"))


def merge_facts(flat: DataFrame, facts: DataFrame, key: str, shadowed: Sequence[str], units: dict[str, str]) -> DataFrame:
    """``key, attr, value, source``: catalogue values win over ``geo`` facts, numbers in a
    wrong unit are skipped, cells with several values are split at bars."""
    own = flat.select(key, *(F.col(c).cast("string").alias(c) for c in shadowed)).unpivot([key], list(shadowed), "attr", "value").where("value is not null and value != ''")
    geo = facts.join(own.select(key, "attr"), [key, "attr"], "left_anti").where("source = 'geo'").unionByName(facts.where("source != 'geo'"))
    for attr, unit in units.items():
        geo = geo.where((F.col("attr") != attr) | F.col("unit").isNull() | (F.col("unit") == unit))
    both = own.select(key, "attr", "value", F.lit("catalogue").alias("source")).unionByName(geo.select(key, "attr", "value", "source"))
    split = both.select(key, "attr", F.explode(F.split("value", r"\|")).alias("value"), "source")
    return split.select(key, "attr", F.trim("value").alias("value"), "source").where("value != ''").distinct()
