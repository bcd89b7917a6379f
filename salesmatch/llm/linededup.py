"""Operator 3: line dedup with levelled sorted runs of line hashes.

DataFrame operations only. Lines become narrow rows of two 64-bit hashes. The
index holds the hashes seen so far in runs: bucketed tables sorted by hash.
Batches come in ascending document order; each one is merge-joined against the
runs (buckets meet without shuffling the runs again) and adds its own new hashes
as a run of level 0. When a level has ``FAN_IN`` runs they are merged into one
run of the next level, so n batches leave about log n runs to probe.

A line is dropped if an earlier document (a smaller doc_id) holds its key.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmatch.llm.common import ASCII_WS, ascii_lower, shuffle_width, text_or_empty, written
from salesmatch.session import shared_dir

#: Runs of a level that are merged into one of the next.
FAN_IN = 2
#: Batches of documents; a fixed number, so that the index is probed as often at every size.
BATCHES = 4
_LAST = (1 << 63) - 1


@contextmanager
def _ordered_runs(spark: SparkSession):
    """While a plan is run inside: scans of runs keep the order of their files (one for each bucket), so that
    a merge join sorts only the batch and not the runs again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineIndex:
    """Levelled runs of line hashes (h1, h2). Runs are tables of the session's
    catalog in the shared folder; ``drop`` removes them."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.buckets, self.fan_in = spark, buckets or shuffle_width(spark), fan_in
        self.levels: list[list[str]] = []
        self._tables: list[str] = []
        self._paths: dict[str, str] = {}

    def _save(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        with _ordered_runs(self.spark):
            (df.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2").write.format("parquet")
             .option("path", path).option("compression", "zstd").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
             .saveAsTable(name))
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        self._tables.append(name)
        self._paths[name] = path
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not seen").select("h1", "h2")

    def add(self, keys: DataFrame) -> DataFrame:
        """Probe a batch's keys (h1, h2 unique, more columns may follow) and add them.

        Returns the keys with ``seen``: whether an earlier batch holds the key.
        """
        self._compact()
        probed, seen = keys, F.lit(False)
        for level in self.levels:
            for i, name in enumerate(level):
                flag = f"_in_{name}"
                probed = probed.join(self._run(name).withColumn(flag, F.lit(True)), ["h1", "h2"], "left")
                seen = seen | F.coalesce(F.col(flag), F.lit(False))
        name = self._save(probed.select(*keys.columns, seen.alias("seen")))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        # Read as plain files: a join on a bucketed table could not be split where one key has many lines.
        return self.spark.read.schema(self.spark.table(name).schema).parquet(self._paths[name])

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan_in:
                merged = self._run(self.levels[k][0])
                for name in self.levels[k][1:]:
                    merged = merged.union(self._run(name))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._save(merged.withColumn("seen", F.lit(False))))
                self.levels[k] = []

    def drop(self) -> None:
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self._tables = [], []


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_WS)))


def _hashed(docs: DataFrame, doc_id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """id, row, pos, h1, h2, batch of every line whose key is long enough.

    ``row`` tells rows with the same doc_id apart by their text. A null doc_id
    comes after all others; such rows count as one document.
    """
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("id"),
                       text_or_empty(text).alias("text"))
    cuts = base.select(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] \
        if batches > 1 else []
    batch = F.lit(0)
    for cut in sorted(set(cuts or [])):
        batch = batch + (F.col("id") > cut).cast("int")
    lines = base.select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("id", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "id", "row", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"),
        batch.alias("batch"))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10,
                  batches: int = BATCHES) -> DataFrame:
    """id, row, pos of the lines to drop (see ``dedup_lines``)."""
    spark = docs.sparkSession
    lines = written(_hashed(docs, doc_id, text, min_chars, batches), "lines", partition_by="batch")
    index = LineIndex(spark)
    out = None
    try:
        for k in range(batches):
            part = lines.where(F.col("batch") == k)
            keys = index.add(part.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")))
            marks = keys.where("seen or first < last").select("h1", "h2", "seen", "first")
            drops = written(part.join(marks, ["h1", "h2"]).where("seen or id > first").select("id", "row", "pos"),
                            "drops")
            out = drops if out is None else out.union(drops)
    finally:
        index.drop()
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10,
                batches: int = BATCHES) -> DataFrame:
    """All columns of ``docs`` in struct ``doc``, with n_lines, n_dropped and ``kept``, the text without dropped lines.

    Lines are what lies between ``\\n``; a null or empty text is one empty line. A
    line whose key (``line_key``) has at least ``min_chars`` code points and is
    found in two or more documents stays only in the smallest ``doc_id`` holding
    it, there as often as it stands. Repeated rows of a document are treated
    alike. A null ``doc_id`` ranks last. Any other columns may be there.
    """
    drops = dropped_lines(docs, doc_id, text, min_chars, batches).groupBy("id", "row").agg(
        F.array_sort(F.collect_set("pos")).alias("drops"))
    body = text_or_empty(text)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("id"),
                       F.xxhash64(body).alias("row"), body.alias("_text"))
    # The document's own text is in ``doc``; only one copy is shuffled.
    joined = rows.drop("_text").join(drops, ["id", "row"], "left").withColumn(
        "lines", F.split(F.coalesce(F.col(f"doc.`{text}`"), F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc", F.size("lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
