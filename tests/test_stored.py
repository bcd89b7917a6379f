"""Keyed tables: versions, untouched files, failed and competing writes."""

import os

import pytest
from pyspark.sql import functions as F

from salesmatch.sources import keyed
from salesmatch.sources.keyed import KeyedTable, VersionConflict


def stored(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def table(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    return KeyedTable.create(spark, str(tmp_path / "t"), rows, ["k"], 8)


def test_versions_stay_readable(spark, table):
    first = stored(table.read())
    new = spark.createDataFrame([(3, 1000), (3, 1001), (77, 1002)], "k long, v long")
    second = table.replace(new)
    assert stored(second.read()) == sorted([r for r in first if r[0] != 3] + [(3, 1000), (3, 1001), (77, 1002)])
    third = second.append(spark.createDataFrame([(5, -1), (99, -2)], "k long, v long"))
    assert stored(third.read()) == sorted(stored(second.read()) + [(5, -1), (99, -2)])
    fourth = third.delete(spark.createDataFrame([(5,), (99,), (12345,)], "k long"))
    assert stored(fourth.read()) == [r for r in stored(second.read()) if r[0] not in (5,)]
    assert stored(table.read()) == first == stored(KeyedTable(spark, table.path, 1).read())
    assert KeyedTable(spark, table.path).version == 4


def test_untouched_buckets_keep_their_files(spark, table):
    def files(t):
        return {b: t.files(b) for b in range(8)}

    before = files(table)
    assert all(before.values())
    new = spark.createDataFrame([(3, 1000)], "k long, v long")
    touched = {int(b) for b in table._touched(new)}
    after = files(table.replace(new))
    assert len(touched) == 1 and {b for b in range(8) if before[b] != after[b]} == touched
    appended = files(KeyedTable(spark, table.path).append(new))
    assert all(set(after[b]) <= set(appended[b]) for b in range(8))  # appending rewrites nothing


def test_a_failed_write_leaves_the_last_version(spark, table):
    first = stored(table.read())
    with pytest.raises(Exception):
        table.replace(spark.createDataFrame([(3, 1)], "k long, v long").withColumn("v", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: 1 / 0)  # files are written, the version is not
        with pytest.raises(ZeroDivisionError):
            table.replace(spark.createDataFrame([(3, 1)], "k long, v long"))
    again = KeyedTable(spark, table.path)
    assert again.version == 1 and stored(again.read()) == first
    assert stored(again.replace(spark.createDataFrame([(3, 1)], "k long, v long")).read(3)) == [(3, 1)]


def test_of_two_writers_the_second_fails(spark, table):
    other = KeyedTable(spark, table.path)
    table.append(spark.createDataFrame([(1, 1)], "k long, v long"))
    with pytest.raises(VersionConflict):
        other.append(spark.createDataFrame([(2, 2)], "k long, v long"))
    with pytest.raises(VersionConflict):
        KeyedTable.create(spark, table.path, table.read(), ["k"], 4)


def test_reading_a_key_reads_its_bucket(spark, table):
    rows = table.read(7)
    assert stored(rows) == [(7, v) for v in range(7, 200, 50)]
    assert len({os.path.dirname(f) for f in rows.inputFiles()}) == 1
    assert table.read(12345).count() == 0


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "ROWS_PER_FILE", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(400).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("v"))
    t = KeyedTable.create(spark, str(tmp_path / "hot"), rows, ["k"], 4)
    [bucket] = t.state["buckets"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert t.read(1).count() == 400 and len(t.files(int(bucket))) > 2


def test_null_keys_clashing_names_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 3, "c")], "k long, version long, bucket string")
    t = KeyedTable.create(spark, str(tmp_path / "n"), rows, ["k"], 4)
    t = t.replace(spark.createDataFrame([(None, 9, "z"), (1, 8, "y")], rows.schema))
    assert sorted(r.version for r in t.read().collect()) == [1, 2, 8, 9]
    t = t.delete(spark.createDataFrame([(1,)], "k long"))
    assert sorted(r.version for r in t.read().collect()) == [1, 2, 9]
    empty = KeyedTable.create(spark, str(tmp_path / "e"), rows.where("false"), ["k"], 4)
    assert empty.read().count() == 0 and empty.append(rows).read().count() == 3


def test_vacuum_removes_what_no_version_names(spark, table):
    t = table.replace(spark.createDataFrame([(3, 1)], "k long, v long"))
    t = t.replace(spark.createDataFrame([(3, 2)], "k long, v long"))
    gone = t.vacuum(keep=1)
    assert len(gone) == 1 and stored(KeyedTable(spark, t.path).read(3)) == [(3, 2)] and t.read().count() == 197
    with pytest.raises(Exception):
        KeyedTable(spark, t.path, 1)


# --- seek paging -----------------------------------------------------------------

def test_pages_by_seek_equal_pages_by_offset(spark, tmp_path):
    from salesmatch.operators import paging
    rows = [(None if i % 11 == 0 else i % 7, i) for i in range(230)]
    df = spark.createDataFrame(rows, "day int, id long").repartition(5)
    directory = paging.page_directory(df, ["day", "id"], 20).cache()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted((r.page, (r.day, r.id), r.n_rows) for r in directory.collect()) == [
        (p, order[20 * p], min(20, 230 - 20 * p)) for p in range(12)]
    for p in range(13):
        assert [tuple(r) for r in paging.read_page(df, directory, ["day", "id"], p).collect()] == order[20 * p:20 * p + 20]
    nothing = df.where("false")
    assert paging.page_directory(nothing, ["day", "id"], 20).count() == 0
    assert paging.read_page(nothing, paging.page_directory(nothing, ["day", "id"], 20), ["day", "id"], 0).count() == 0


def test_a_page_reads_one_key_range(spark, tmp_path):
    from salesmatch.operators import paging
    df = spark.range(5000).select((F.col("id") / 10).cast("long").alias("day"), "id")
    df.repartitionByRange(20, "day").write.parquet(str(tmp_path / "o"))
    stored_ = spark.read.parquet(str(tmp_path / "o"))
    directory = paging.page_directory(stored_, ["day", "id"], 100)
    got = paging.read_page(stored_, directory, ["day", "id"], 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,300)" in plan and "LessThanOrEqual(day,310)" in plan
    assert [r.id for r in got.collect()] == list(range(3000, 3100))


# --- session store ----------------------------------------------------------------

def arrive(spark, folder, rows):
    from salesmatch.streaming import session_store as S
    spark.createDataFrame(rows, S.TURNS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(S.TURNS).parquet(folder)


def test_session_store_appends_clears_and_restarts(spark, tmp_path):
    from salesmatch.streaming import session_store as S
    folder, path, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    stream = arrive(spark, folder, [(1, 0, "system", "s"), (1, 1, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "twice")])
    t = S.append_available(spark, stream, path, check)
    assert sorted((r.session_id, r.turn) for r in t.read().collect()) == [(1, 0), (1, 1), (2, 0)]
    t = S.append_available(spark, stream, path, check)  # nothing new: no version
    version = t.version
    t = S.append_available(spark, arrive(spark, folder, [(1, 1, "user", "again"), (1, 2, "assistant", "c"), (3, 0, "user", "d")]), path, check)
    assert t.version == version + 1
    assert [(r.turn, r.content) for r in S.history(t, 1).collect()] == [(1, "a"), (2, "c")]
    assert len({f.rsplit("/", 2)[-2] for f in S.history(t, 1).inputFiles()}) == 1
    t = S.clear(t, spark.createDataFrame([(1,)], "session_id long"))
    assert sorted(r.session_id for r in S.history(t).collect()) == [2, 3] and S.history(t, 1).count() == 0
    assert {r.session_id: r.n_turns for r in S.counts(t).collect()} == {2: 1, 3: 1}


def test_a_batch_run_again_is_not_appended_twice(spark, tmp_path, monkeypatch):
    """The job dies after the table's version is in place and before the stream notes the batch."""
    from salesmatch.streaming import session_store as S
    folder, path, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    stream = arrive(spark, folder, [(1, 0, "user", "a"), (2, 0, "user", "b")])
    append = KeyedTable.append

    def dies(self, *a):
        append(self, *a)
        raise RuntimeError("lost after the version was written")

    monkeypatch.setattr(KeyedTable, "append", dies)
    with pytest.raises(Exception):
        S.append_available(spark, stream, path, check)
    monkeypatch.setattr(KeyedTable, "append", append)
    t = S.append_available(spark, stream, path, check)
    assert sorted((r.session_id, r.content) for r in t.read().collect()) == [(1, "a"), (2, "b")]
