"""Tables stored by key bucket, with versions.

A key's rows all lie in one bucket, ``pmod(xxhash64(keys), buckets)``. Appending
adds files to the touched buckets, deleting and replacing rewrite the touched
buckets only; other buckets keep their files. Every change writes its files to a
new generation folder first; the version file, which names the generations of
each bucket, is then moved into place under the next version number. A job that
fails leaves the last version as it was, and of two writers that started from one
version the second fails. Readers take the highest version, or any older one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmatch.sources.io import delete_by_key, replace_by_key

#: Rows of a bucket beyond which its new generation is written by more tasks.
ROWS_PER_FILE = 1_000_000
_BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another writer has made the next version."""


class KeyedTable:
    """A table at ``path``; ``create`` makes it, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version = self.latest() if version is None else version
        if self.version:
            [text] = spark.read.text(self._file(self.version), wholetext=True).collect()
            self.state = json.loads(text.value)

    # --- versions -------------------------------------------------------------

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:08d}.json"

    def latest(self) -> int:
        folder = self._paths(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:8]) for n in names if n.endswith(".json")), default=0)

    def _commit(self, buckets: dict[str, list[str]], schema: T.StructType, keys: list[str], n: int,
                marks: dict[str, int] | None = None) -> "KeyedTable":
        state = {"schema": schema.jsonValue(), "keys": keys, "n_buckets": n, "buckets": buckets, "marks": marks or {}}
        temporary = self._paths(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary)
        stream.write(json.dumps(state).encode())
        stream.close()
        target = self._paths(self._file(self.version + 1))
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            raise VersionConflict(f"version {self.version + 1} of {self.path} exists")
        return KeyedTable(self.spark, self.path, self.version + 1)

    # --- files ----------------------------------------------------------------

    @property
    def keys(self) -> list[str]:
        return self.state["keys"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    def _bucketed(self, df: DataFrame, keys: list[str], n: int) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write bucketed ``rows`` as a new generation; the buckets it holds. Large buckets are written by several tasks."""
        generation = f"g-{uuid.uuid4().hex}"
        counts = rows.groupBy(_BUCKET).agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_FILE)).cast("int").alias("_files"))
        dealt = rows.join(F.broadcast(counts), _BUCKET)  # a row for each bucket
        place: Column = F.pmod(F.xxhash64(*[c for c in rows.columns if c != _BUCKET]), F.col("_files"))
        dealt = dealt.withColumn("_place", place).repartition(_BUCKET, "_place").drop("_files", "_place")
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/{generation}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._paths(f"{self.path}/{generation}"))]
        return {n.split("=")[1]: [generation] for n in names if n.startswith(f"{_BUCKET}=")}

    def _read(self, buckets: dict[str, list[str]], schema: T.StructType) -> DataFrame:
        places = [f"{self.path}/{g}/{_BUCKET}={b}" for b, held in sorted(buckets.items()) for g in held]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def files(self, bucket: int) -> list[str]:
        """Names of a bucket's data files."""
        out = []
        for g in self.state["buckets"].get(str(bucket), []):
            folder = self._paths(f"{self.path}/{g}/{_BUCKET}={bucket}")
            out += [f"{g}/{f.getPath().getName()}" for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")]
        return sorted(out)

    # --- operations -----------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int) -> "KeyedTable":
        """A new table with ``rows``. The number of buckets stays for the table's life."""
        table = cls(spark, path)
        if table.version:
            raise VersionConflict(f"{path} holds a table")
        return table._commit(table._write(table._bucketed(rows, keys, buckets)), rows.schema, keys, buckets)

    def read(self, *key: object) -> DataFrame:
        """All rows of this version; with a ``key`` (a value for each key column) its rows, from its bucket only."""
        if not key:
            return self._read(self.state["buckets"], self.schema)
        fields = [self.schema[k] for k in self.keys]
        one = self.spark.createDataFrame([tuple(key)], T.StructType(fields))
        bucket = str(self._bucketed(one, self.keys, self.state["n_buckets"]).first()[_BUCKET])
        rows = self._read({bucket: self.state["buckets"].get(bucket, [])}, self.schema)
        for name, value in zip(self.keys, key):
            rows = rows.where(F.col(name) == F.lit(value))
        return rows

    def _touched(self, rows: DataFrame) -> dict[str, list[str]]:
        found = self._bucketed(rows.select(*self.keys), self.keys, self.state["n_buckets"]).select(_BUCKET).distinct().collect()
        return {str(r[_BUCKET]): self.state["buckets"].get(str(r[_BUCKET]), []) for r in found}  # at most one for each bucket

    def _next(self, buckets: dict[str, list[str]], marks: dict[str, int] | None = None) -> "KeyedTable":
        return self._commit(buckets, self.schema, self.keys, self.state["n_buckets"], {**self.state["marks"], **(marks or {})})

    def append(self, rows: DataFrame, marks: dict[str, int] | None = None) -> "KeyedTable":
        """Add ``rows``; no stored row is read. ``marks`` become part of the version, as the number of a stream's
        last batch, and stay until they are set anew."""
        added = self._write(self._bucketed(rows.select(*self.schema.names), self.keys, self.state["n_buckets"]))
        old = self.state["buckets"]
        return self._next({b: [*old.get(b, []), *added.get(b, [])] for b in {*old, *added}}, marks)

    def _rewrite(self, change, rows: DataFrame) -> "KeyedTable":
        touched = self._touched(rows)
        after = change(self._read(touched, self.schema))
        written = self._write(self._bucketed(after.select(*self.schema.names), self.keys, self.state["n_buckets"]))
        kept = {b: g for b, g in self.state["buckets"].items() if b not in touched}
        return self._next({**kept, **written})

    def replace(self, rows: DataFrame) -> "KeyedTable":
        """Keys in ``rows`` lose their stored rows and get the new ones. Rows with a null key replace nothing."""
        return self._rewrite(lambda old: replace_by_key(old, rows.select(*old.columns), self.keys), rows)

    def delete(self, keys: DataFrame) -> "KeyedTable":
        """Keys in ``keys`` lose their rows."""
        return self._rewrite(lambda old: delete_by_key(old, keys, self.keys), keys)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove generations that none of the last ``keep`` versions names, and older version files. For use while
        nobody writes: a generation whose version is not yet in place would go too."""
        last = self.latest()
        versions = [KeyedTable(self.spark, self.path, v) for v in range(max(1, last - keep + 1), last + 1)]
        used = {g for v in versions for held in v.state["buckets"].values() for g in held}
        gone = [f.getPath().getName() for f in self._fs.listStatus(self._paths(self.path)) if f.getPath().getName().startswith("g-")]
        gone = sorted(set(gone) - used)
        for g in gone:
            self._fs.delete(self._paths(f"{self.path}/{g}"), True)
        for v in range(1, last - keep + 1):
            self._fs.delete(self._paths(self._file(v)), False)
        return gone
