"""Operators 11 to 13 against brute force, SQL and other readers of their files."""

import glob
import gzip
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmatch.llm import covertree, resampling, vectorcodes, warc
from salesmatch.llm.common import join_hot_keys


# --- cover trees --------------------------------------------------------------

def points(seed, n, width=3, spread=50):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread, (n, width))
    x[n // 2:] = x[rng.integers(0, max(1, n // 2), n - n // 2)]  # copies
    return x + 40 * rng.integers(0, 3, (n, 1))


@pytest.mark.parametrize("n", [1, 2, 7, 300, 1500])
def test_cover_tree_invariants(n):
    x = points(n, n)
    tree = covertree.build(x, net=64)
    assert sorted(tree.order.tolist()) == list(range(n))
    edges = None
    for node, first, radius in tree.levels:
        end = np.append(first[1:], n)
        for c, i, j, r in zip(node, first, end, radius):
            rows = tree.order[i:j]
            assert c in rows and np.sqrt(((x[rows] - x[c]) ** 2).sum(1)).max() <= r + 1e-9
        assert edges is None or set(edges) <= set(first.tolist())  # a child lies within its parent
        edges = first.tolist()
        assert len(np.unique(x[node], axis=0)) == len(node)


@pytest.mark.parametrize("seed", range(6))
def test_cover_tree_assigns_as_brute_force(seed):
    x = points(seed, 800, spread=[3, 200][seed % 2])
    rng = np.random.default_rng(seed)
    entries = rng.integers(-60, 160, (16, 3))
    entries[5] = entries[2]  # a tie for every point near it
    tree = covertree.build(x)
    (first, end, entry), rows, own, compared = covertree.assign(tree, x, entries)
    got = np.full(len(x), -1)
    for i, j, e in zip(first, end, entry):
        assert (got[tree.order[i:j]] == -1).all()
        got[tree.order[i:j]] = e
    assert (got[rows] == -1).all()
    got[rows] = own
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert (got == d.argmin(1)).all() and compared > 0


def test_whole_subtrees_save_comparisons():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 4096)] + rng.integers(-40, 40, (4096, 8))
    *_, compared = covertree.assign(covertree.build(x), x, centres)
    assert compared < 4096 * 16 / 20


# --- operator 11 ---------------------------------------------------------------

def brute_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the codebooks' digest, in plain integers."""
    rows = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))
    first, seen = [], set()
    for r in order:
        if rows[r][0] not in seen and len(first) < entries:
            seen.add(rows[r][0])
            first.append(r)
    cut = [[x[p * width:(p + 1) * width] for x in ints] for p in range(parts)]
    books = [[list(cut[p][r]) for r in first] for p in range(parts)]

    def near(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for x in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x, (_, k) in zip(cut[p], near(p)):
                groups.setdefault(k, []).append(x)
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = [near(p) for p in range(parts)]
    error = [sum(found[p][r][0] for p in range(parts)) for r in range(len(rows))]
    total = {}
    for (_, _, lab), e in zip(rows, error):
        total[lab] = total.get(lab, 0) + e
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((i, "".join(f"{found[p][r][1]:02x}" for p in range(parts)), error[r], total[lab])
                   for r, (i, _, lab) in enumerate(rows)), key=str), hashlib.sha256(text.encode()).hexdigest()


def vector_rows(n, seed=0, length=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, length))
    out = [(int(i), [float(x) for x in np.float32(centres[i % 5] + 0.2 * rng.normal(size=length))], i % 3) for i in range(n)]
    return out


VECTOR = "vec_id long, embedding array<float>, label int"


def test_vector_codes_match_brute_force(spark):
    rows = vector_rows(400)
    rows += [(i + 1000, rows[7][1], 1) for i in range(150)]  # a large group of copies
    rows += [(3, rows[9][1], 2), (3, rows[2][1], 2), (7, rows[7][1], None), (None, rows[11][1], None), (None, None, 1),
             (2000, [], 1), (2001, [float("nan")] * 16, 1), (2002, [float("inf")] + [0.0] * 15, 1),
             (2003, [None] + [0.0] * 15, 1), (2004, [0.0] * 16, None), (-5, [-0.0001] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTOR + ", code string, part int").repartition(5)
    got = vectorcodes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = got.collect()
    want, name = brute_codes(rows)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {name}


def test_vector_codes_do_not_depend_on_blocks(spark, monkeypatch):
    df = spark.createDataFrame(vector_rows(300, 3), VECTOR)
    want = sorted(map(tuple, vectorcodes.compress(df).collect()))
    pack = vectorcodes.pack_blocks
    monkeypatch.setattr(vectorcodes, "pack_blocks", lambda *a: pack(*a, block=37))
    assert sorted(map(tuple, vectorcodes.compress(df.repartition(7)).collect())) == want


def test_vector_codes_of_few_none_and_other_lengths(spark):
    assert vectorcodes.compress(spark.createDataFrame([], VECTOR)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1)], VECTOR)).count() == 0
    few = vector_rows(3)
    got = vectorcodes.compress(spark.createDataFrame([*few, (9, [1.0] * 8, 5)], VECTOR)).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == {
        **{i: (f"{i:02x}" * 8, 0) for i in range(3)}, 9: (None, None)}
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], VECTOR))
    with pytest.raises(Exception, match="do not fit a long"):
        vectorcodes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTOR)).collect()


def test_vector_codes_sql(spark):
    rows = [*vector_rows(90, 5), (200, None, 1), (201, vector_rows(1, 6)[0][1], None)]
    df = spark.createDataFrame(rows, VECTOR)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    got = vectorcodes.compress(df)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({vectorcodes.sql(length=16)})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hot_keys_are_broadcast_and_others_shuffled(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(None)).when(F.col("id") < 2000, 1).otherwise(
        F.col("id")).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("_n"))
    got = {(r.k, r.v): r.s for r in join_hot_keys(rows, table, "k").collect()}
    assert len(got) == 3000 and got[(None, 5)] == sum(range(1000)) and got[(1, 1500)] == sum(range(1000, 2000))
    assert all(got[(i, i)] == i for i in range(2000, 3000))


# --- operator 12 ---------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def page_rows():
    long = "<p>copy of a long page</p>" * 60
    rows = [(i, f"https://h.example/{i}?q=ä b", f"<html>{i} é " + "word " * (i % 90) + "</html>") for i in range(300)]
    rows += [(1000 + i, None, long) for i in range(120)]  # a large group of copies
    rows += [(2000, "", "short copy"), (2001, "https://x/\r\nInjected: 1", "short copy"), (2002, "u", None), (2003, "u", ""),
             (5, "again", "other text under one id"), (5, "again", "other text under one id"), (None, "n", long), (None, None, None),
             (1119, "z", long), (2004, "u", "x" * 999), (2005, "u", "x" * 999), (2006, "u", "é" * 500), (2007, "u", "é" * 500),
             (2008, "crlf", "\r\n\r\nWARC/1.1\r\n" * 200), (2009, "nul", "a\0b" * 400)]
    return rows


def brute_pages(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    top = {}
    for p, d in data:
        if len(d) >= 1000 and p is not None:
            top[d] = max(p, top.get(d, p))
    out = []
    for p, d in data:
        refers = top.get(d)
        refers = None if refers == p else refers
        out.append((p, len(d), hashlib.sha1(d).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_archives_read_back(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGE + ", file string, kind int").repartition(6)
    assert sorted(map(tuple, warc.round_trip(df, str(tmp_path / "a")).collect()), key=str) == brute_pages(rows)
    path = warc.write_archives(df, str(tmp_path / "b"), shard_bytes=20_000, file_bytes=3_000)
    back = warc.read_archives(spark, path, payload=True)
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in back.where("record_type = 'response'").collect()), key=str) == sorted(
        ((p, h or "") for (p, _, h), (q, _, _, kind, _) in zip(sorted(rows, key=lambda r: str((r[0], len((r[2] or "").encode()), hashlib.sha1((r[2] or "").encode()).hexdigest()))),
                                                              brute_pages(rows)) if kind == "response"), key=str)
    urls = {r.page_id: r.url for r in back.collect()}
    assert urls[0] == "https://h.example/0?q=%C3%A4%20b" and urls[2000] is None and urls[2001] == "https://x/%0D%0AInjected:%201"
    with pytest.raises(ValueError):
        warc.write_archives(df, path)


def test_archives_are_plain_deterministic_warc(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), PAGE)
    texts = []
    for k, parts in enumerate((1, 7)):
        path = warc.write_archives(df.repartition(parts), str(tmp_path / str(k)), shard_bytes=60_000, file_bytes=4_000)
        names = sorted(glob.glob(f"{path}/*.warc.gz"))
        texts.append([(n.rsplit("/", 1)[1], open(n, "rb").read()) for n in names])
        assert sorted(f.rsplit("/", 1)[1] for f in glob.glob(f"{path}/*")) == ["manifest.tsv", *sorted(n for n, _ in texts[-1])]
    assert texts[0] == texts[1] and len(texts[0]) > 5
    assert len({n[:12] for n, _ in texts[0]}) > 2  # several shards
    ids, pages = [], []
    for _, data in texts[0]:
        plain = gzip.decompress(data)
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.endswith(b"\r\n\r\n")
        ids += re.findall(rb"WARC-Record-ID: (\S+)", plain)
        pages += [int(x) for x in re.findall(rb"X-Page-Id: (\d+)", plain) if b"Refers" not in x]
        own, rest = 0, data
        while rest:  # every record is a gzip member of its own
            d = zlib.decompressobj(31)
            assert d.decompress(rest).startswith(b"WARC/1.1\r\n")
            own, rest = own + 1, d.unused_data
        assert own == plain.count(b"WARC-Record-ID: ")
        assert len(data) <= 4_000 + 1500 or own == 2
    assert len(ids) == len(set(ids))


def test_archives_are_sorted_and_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(200)], PAGE).repartition(4)
    path = warc.write_archives(df, str(tmp_path / "a"), shard_bytes=30_000, file_bytes=2_000)
    order = [int(x) for n in sorted(glob.glob(f"{path}/*.gz")) for x in re.findall(rb"X-Page-Id: (\d+)", gzip.open(n).read())]
    assert order == list(range(200))
    open(f"{path}/pages-999999-0000.warc.gz", "wb").write(b"left by a try that failed")
    assert warc.read_archives(spark, path).count() == 200
    name = sorted(glob.glob(f"{path}/pages-0000*.gz"))[1]
    data = open(name, "rb").read()
    open(name, "wb").write(data[:-4])
    for f in glob.glob(f"{path}/.*crc"):
        open(f, "wb").close()
    with pytest.raises(Exception, match="manifest says"):
        warc.read_archives(spark, path).collect()
    import os
    os.rename(name, name + ".gone")
    with pytest.raises(ValueError, match="missing archives"):
        warc.read_archives(spark, path)


def test_a_record_longer_than_a_member(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER", 1000)
    payload = bytes(np.random.default_rng(0).integers(0, 256, 5_321, dtype=np.uint8))
    data = warc.members(warc.page_record(1, 0, "u", payload, False, None)) + warc.members(warc.page_record(2, 0, "u", b"", False, None))
    assert data[-1] == 0
    got = list(warc.records(data))
    assert got[0][1].split(b"\r\n\r\n", 1)[1] == payload and got[1][0]["X-Page-Id"] == "2"
    with pytest.raises(ValueError):
        list(warc.records(data[:-30]))


def test_archives_of_nothing(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGE), str(tmp_path / "a")).count() == 0


def test_archives_sql(spark, tmp_path):
    rows = [r for r in page_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, PAGE)
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    got = warc.round_trip(df, str(tmp_path / "a"))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({warc.SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# --- operator 13 ---------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_draw(docs, target, percent=10, least=20, max_gram=1, buckets=10_000):
    def features(t):
        w = WORDS(low(t))
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_gram + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for text in docs:
        for b in features(text[1])[1]:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


DOC = "doc_id long, text string, rank string, row int"


def draw_rows(n=400):
    rng = np.random.default_rng(9)
    vocabulary = ["Spark", "the", "été", "x1", "of", "中文", "data", "ÄRGER", "a", "it's"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))) + rng.choice(["", ".\n", "\t--"])) for i in range(n)]
    copy = " ".join(["the", "Data"] * 30)
    docs += [(1000 + i, copy) for i in range(n // 2)] + [(1000, copy), (1000, copy), (1000, None), (None, copy), (None, None), (2000, ""),
             (2001, " -- "), (2002, "w " * 5000)]
    return docs, ["The data of Spark", None, "", "ÄRGER data data", "it's x1"] * 3


@pytest.mark.parametrize("max_gram", [1, 2])
def test_draw_matches_brute_force(spark, max_gram):
    docs, target = draw_rows()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOC).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(df, bench, max_gram=max_gram)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw(docs, target, max_gram=max_gram)


def test_draw_all_none_and_one(spark):
    docs, target = draw_rows(60)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOC)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 1, 100):
        got = resampling.resample(df, bench, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute_draw(docs, target, percent=percent)
    assert resampling.resample(df.where("false"), bench).count() == 0
    got = resampling.resample(df, bench.where("false"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw(docs, [])


@pytest.mark.parametrize("pivots", [1, 2, 15])
def test_quickselect_finds_every_place(spark, pivots):
    rows = [(i % 3 * 5, i % 4 if i % 7 else None, i) for i in range(80)]  # many equal scores and ids
    df = spark.createDataFrame(rows, "score long, doc_id long, row long").cache()
    order = sorted((-s, (1 << 63) - 1 if d is None else d, r) for s, d, r in rows)
    for k in (1, 2, 27, 53, 80):
        assert resampling.kth_key(df, k, pivots=pivots) == order[k - 1]


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(f"w{i % 13}" for i in range(1000)).encode()
    whole = [f for _, f in resampling.Buckets(100, 3).features(text)]
    monkeypatch.setattr(resampling, "_SLICE", 64)
    parts = list(resampling.Buckets(100, 3).features(text))
    assert sum(n for n, _ in parts) == 1000 and sorted(np.concatenate([f for _, f in parts])) == sorted(whole[0])


def test_draw_sql(spark):
    docs, target = draw_rows(150)
    docs = [d for d in docs if d[0] is not None and d[0] != 1000]
    con = duckdb.connect()
    df, bench = spark.createDataFrame([(*d, "x", 1) for d in docs], DOC), spark.createDataFrame([(t,) for t in target], "text string")
    con.register("documents", df.toArrow())
    con.register("benchmark", bench.toArrow())
    got = resampling.resample(df, bench)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({resampling.SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
