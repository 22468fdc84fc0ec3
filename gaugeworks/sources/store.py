"""A folder of Parquet tables: scan by SQL, create, append and upsert.

A table is a row of manifests, numbered JSON files. The newest names the schema and the data folders,
so a write is seen as a whole or not at all, and types never have to be guessed from folder names.
Upserted rows lie in buckets by hash of their key (or of the part of it that the caller names), and an
upsert reads and writes only the buckets that get updates.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.session import stage


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def stored_type(kind: T.DataType) -> T.DataType:
    """Column types of a stored table: integers, floats, booleans, times; anything else is text."""
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return T.DoubleType()
    if isinstance(kind, (T.BooleanType, T.TimestampType)):
        return kind
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return T.TimestampType()
    return T.StringType()


def to_stored(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        col, kind = F.col(f"`{f.name}`"), stored_type(f.dataType)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col)
        cols.append(col.cast(kind).alias(f.name))
    return df.select(*cols)


def merge_by_key(existing: DataFrame, updates: DataFrame, key: Sequence[str], newest_by: str | None = None) -> DataFrame:
    """Existing rows with the updates' values where the keys agree (null equals null), and new rows.

    Columns that the updates do not carry keep their values. With ``newest_by`` a stored row that is
    ahead of its update in that column stays as it is.
    """
    columns = [*existing.columns, *[c for c in updates.columns if c not in existing.columns]]
    kinds = {**dict(updates.dtypes), **dict(existing.dtypes)}
    old = existing.select(*[F.col(f"`{c}`").alias(f"o_{i}") for i, c in enumerate(columns) if c in existing.columns], F.lit(True).alias("held"))
    new = updates.select(*[F.col(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(columns) if c in updates.columns], F.lit(True).alias("fresh"))
    same = reduce(lambda x, y: x & y, [F.col(f"o_{columns.index(k)}").eqNullSafe(F.col(f"n_{columns.index(k)}")) for k in key])
    wins = F.col("fresh").isNotNull()
    if newest_by in updates.columns and newest_by in existing.columns:
        i = columns.index(newest_by)
        wins = wins & ~F.coalesce(F.col("held") & (F.col(f"o_{i}") > F.col(f"n_{i}")), F.lit(False))

    def pick(i: int, c: str) -> Column:
        before = F.col(f"o_{i}") if c in existing.columns else F.lit(None)
        return F.when(wins, F.col(f"n_{i}")).otherwise(before) if c in updates.columns else before

    joined = old.join(new, same, "full_outer")
    return joined.select(*[pick(i, c).cast(kinds[c]).alias(c) for i, c in enumerate(columns)])


def _wider(schema: T.StructType, more: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, *[f for f in more.fields if f.name not in schema.names]])


def keep_last(updates: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``. A partial aggregate, so copies of one key
    collapse before the shuffle."""
    packed = updates.groupBy(*key).agg(
        F.max_by(F.struct(*[F.col(c) for c in updates.columns]), F.col(order)).alias("r")
    )
    return packed.select("r.*")


class TableStore:
    """Tables below one root; ``buckets`` is the number of buckets of tables created from here on."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # manifests
    def _manifests(self, table: str) -> list:
        fs, p = _fs_path(self.spark, f"{self.root}/{table}/manifest-*.json")
        return sorted((f.getPath() for f in fs.globStatus(p) or []), key=lambda path: path.getName())

    def _manifest(self, table: str) -> dict:
        found = self._manifests(table)
        if not found:
            raise FileNotFoundError(f"{self.root}/{table}")
        return json.loads(self._text(found[-1])) | {"number": self._number(found[-1])}

    @staticmethod
    def _number(path) -> int:
        return int(path.getName()[len("manifest-") : -len(".json")])

    def _text(self, path) -> str:
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        source = fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def _commit(self, table: str, manifest: dict) -> None:
        """Write the manifest that follows the one that was read, under another name, and move it; the
        move fails if another writer has committed since."""
        number = manifest.pop("number", -1) + 1
        fs, target = _fs_path(self.spark, f"{self.root}/{table}/manifest-{number:012d}.json")
        _, draft = _fs_path(self.spark, f"{self.root}/{table}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"table {table} was changed by another writer")

    @staticmethod
    def _schema(manifest: dict) -> T.StructType:
        return T.StructType.fromJson(manifest["schema"])

    # reading
    def exists(self, table: str) -> bool:
        return bool(self._manifests(table))

    def folders(self, table: str, buckets: Sequence[int] | None = None) -> list[str]:
        """The data folders of a table, or of some of its buckets; folders of appended rows always."""
        return self._folders(self._manifest(table), buckets)

    @staticmethod
    def _folders(m: dict, buckets: Sequence[int] | None = None) -> list[str]:
        wanted = m["parts"] if buckets is None else [str(b) for b in buckets if str(b) in m["parts"]]
        return [f"{m['parts'][b]}/__bucket={b}" for b in wanted] + m["appended"]

    def _read(self, manifest: dict, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._schema(manifest))
        return self.spark.read.schema(self._schema(manifest)).parquet(*folders)

    def read(self, table: str) -> DataFrame:
        m = self._manifest(table)
        return self._read(m, self._folders(m))

    def scan(self, sql: str, tables: Sequence[str], args: dict | None = None) -> DataFrame:
        """Run SQL over stored tables, each visible as a view of its own name."""
        for t in tables:
            self.read(t).createOrReplaceTempView(t)
        return self.spark.sql(sql, args=args)

    # writing
    def _folder(self, table: str) -> str:
        return f"{self.root}/{table}/data-{time.time_ns():020d}"

    def ensure_table(self, table: str, like: DataFrame) -> bool:
        """Create an empty table with the stored types of ``like``; True if it was missing."""
        if self.exists(table):
            return False
        empty = {"hash": None, "buckets": self.buckets, "parts": {}, "appended": []}
        self._commit(table, empty | {"schema": to_stored(like).schema.jsonValue()})
        return True

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows without looking at the stored ones; new columns are added to the table. If another
        writer commits meanwhile, the rows are added to what that one left."""
        self.ensure_table(table, df)
        folder, fresh = self._folder(table), to_stored(df)
        fresh.write.parquet(folder)
        for attempt in range(20):
            m = self._manifest(table)
            try:
                return self._commit(table, m | {"schema": _wider(self._schema(m), fresh.schema).jsonValue(), "appended": [*m["appended"], folder]})
            except RuntimeError:
                if attempt == 19:
                    raise

    def upsert(
        self,
        table: str,
        updates: DataFrame,
        key: Sequence[str],
        dedupe_by: str | None = None,
        partition: Sequence[str] = (),
    ) -> int:
        """Insert or replace rows by key; returns the number of update rows.

        Two update rows with one key are an error unless ``dedupe_by`` names the column whose largest
        value wins, among the updates and against the stored row. Columns the updates do not carry keep
        their stored values. ``partition`` (columns of the key) makes rows that agree in them share a
        bucket, when the table gets its first keyed rows. Rows that were appended are taken into the
        buckets.
        """
        if not set(partition) <= set(key):
            raise PySparkValueError("partition columns must be part of the key")
        fresh = to_stored(updates)
        if dedupe_by:
            fresh = keep_last(fresh, key, dedupe_by)
        fresh = stage(fresh)
        per_key = fresh.groupBy(*key).count().agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
        rows = per_key["n"] or 0
        if not rows:
            return 0
        if per_key["m"] > 1:
            raise PySparkValueError(f"two update rows share one key {list(key)}")
        self.ensure_table(table, fresh)
        m = self._manifest(table)
        spread = m["hash"] or list(partition or key)
        if not set(spread) <= set(key):
            raise PySparkValueError(f"the table is spread by {spread}; the key must hold these columns")
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(m["buckets"])).cast("int")
        if m["appended"]:  # they may be in any bucket
            touched = list(range(m["buckets"]))
        else:
            touched = sorted(r[0] for r in fresh.select(bucket).distinct().collect())  # a few numbers
        existing = self._read(m, self._folders(m, touched))
        merged = merge_by_key(existing, fresh, key, dedupe_by)
        folder = self._folder(table)
        placed = merged.withColumn("__bucket", bucket)
        placed.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        filled = [r[0] for r in self.spark.read.parquet(folder).select("__bucket").distinct().collect()] if m["appended"] else touched
        parts = {b: f for b, f in m["parts"].items() if int(b) not in touched} | {str(b): folder for b in filled}
        self._commit(table, m | {"schema": merged.schema.jsonValue(), "hash": spread, "parts": parts, "appended": []})
        return rows

    def vacuum(self, table: str, keep: int = 2) -> int:
        """Delete manifests before the last ``keep`` and data folders that none of the kept ones names.
        Not while another writer is at work: its folder is not in a manifest yet."""
        found = self._manifests(table)
        held = set()
        for path in found[-keep:]:
            m = json.loads(self._text(path))
            held |= {f.rsplit("/", 1)[1] for f in [*m["parts"].values(), *m["appended"]]}
        fs, root = _fs_path(self.spark, f"{self.root}/{table}")
        old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in held]
        for path in [*found[:-keep], *old]:
            fs.delete(path, True)
        return len(old)

    def write_forecasts(self, kpi_id: str, forecasts: DataFrame) -> int:
        """Forecast rows of one KPI, keyed by timestamp, KPI and customer."""
        return self.upsert(f"forecasts_{kpi_id}", forecasts, ["timestamp", "kpi_id", "customer_id"])


def ingest(store: TableStore, source: DataFrame, spec: dict) -> dict:
    """Load one extracted source into ``spec['target_table']``; counts come from the write itself."""
    started = time.time()
    seen = Observation(f"ingest_{spec['id']}_{time.time_ns()}")
    watched = source.observe(seen, F.count(F.lit(1)).alias("n"))
    loaded = store.upsert(
        spec["target_table"], watched, spec.get("primary_key", ["timestamp"]), spec.get("dedupe_by"),
        spec.get("partition", ()),
    )
    return {
        "spec_id": spec["id"],
        "rows_extracted": int(seen.get.get("n", 0)),
        "rows_loaded": loaded,
        "target_table": spec["target_table"],
        "duration_seconds": time.time() - started,
    }


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) per table and a last row with the total."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(", ".join(df.columns)).alias("columns")
        )
        for name, df in tables.items()
    ]
    each = reduce(DataFrame.unionByName, parts)
    total = each.agg(F.sum("rows").alias("rows")).select(
        F.lit("(all)").alias("table"), "rows", F.lit("").alias("columns")
    )
    return each.unionByName(total)


def sample_table(df: DataFrame, order_by: Sequence[str], n: int = 25) -> DataFrame:
    return df.orderBy(*order_by).limit(n)
