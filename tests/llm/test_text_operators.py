"""Operators on documents against brute force on small tables with edge rows:
nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import gc
import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from salesmatch.llm import (bestfit, bpe, components, licenses, linededup, ngrams, quality, secretscan, simhash,
                            tokenfiles, tokenizers_io, wordblocks)

WS = " \t\n\x0b\x0c\r"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog\nshared line of text\nUnique one here"),
    (2, "shared LINE of text  \nanother Unique line of words\nshort"),
    (3, None), (4, ""), (5, "   \n\t\x0b"), (6, "\n\n"), (7, "one"), (8, "two words"),
    (9, "shared line of text\nshort\nReleased under the MIT License."),
    (10, "Ünïcödé 　x​ \x1c\x1d é́ <|endoftext|> İ ŉ   中文 😀 it's we'll"),
    (11, LONG), (12, LONG + " tail"), (13, LONG), (7, "one"),
    (14, "apache\nLicense, version 2.0 and CC BY-NC; licensed under the BSD license"),
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "src", 1, "x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block int, ids string")


def empty(spark):
    return frame(spark).where("false")


def test_blocks_number_words_exactly():
    texts = [t.encode() for _, t in TEXTS if t] + [b"", b"a" * 400_000 + b" b"]
    block = wordblocks.block_of(texts, wordblocks.word_spans)
    words = block.words()
    assert [words[i] for i in block.index] == [w for t in texts for w in t.split()]
    chunks = wordblocks.block_of(texts, wordblocks.chunk_spans)
    words = chunks.words()
    for k, t in enumerate(texts):
        assert b"".join(words[i] for i in chunks.index[chunks.doc_at[k]:chunks.doc_at[k + 1]]) == t


def test_runs_are_not_sorted_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    index = linededup.LineIndex(spark, buckets=4)
    keys = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2")).groupBy("h1", "h2").agg(
        F.count("*").alias("n"))
    try:
        index.add(keys(0, 500))
        with linededup._ordered_runs(spark):
            run = index._run(index.levels[0][0])
            plan = keys(300, 800).join(run, ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
        lines = [x.strip(" :+-*()0123456789") for x in plan.splitlines()]
        scan = next(i for i, x in enumerate(lines) if x.startswith("FileScan"))
        above = lines[lines.index(next(x for x in lines if x.startswith("SortMergeJoin"))):scan]
        run_side = above[max(i for i, x in enumerate(above) if x.startswith(("HashAggregate", "Exchange", "Range"))) + 1:]
        assert not any(x.startswith(("Sort ", "Exchange")) for x in run_side), plan
        seen = index.add(keys(300, 800)).where("seen").count()
        assert seen == 200
    finally:
        index.drop()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_decoding_joins_all_rows():
    from salesmatch.llm.bpe import _decoded
    import pyarrow as pa
    table = pa.array([b"", b"a", b"bc", b"def"], pa.large_binary())
    rows = [np.array(x, "<u2").tobytes() for x in ([], [1, 2, 3], [0], [3] * 50, [])]
    assert _decoded(rows, table) == [b"", b"abcdef", b"", b"def" * 50, b""] and _decoded([], table) == []
    with pytest.raises(Exception):
        _decoded([np.array([4], "<u2").tobytes()], table)


def test_blocks_have_a_row_bound():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["", "a b", ""] * 50, pa.string())], ["t"])
    got = list(wordblocks.blocks([batch, batch], "t", wordblocks.word_spans, block_rows=64))
    sizes = [sum(p.num_rows for p in parts) for parts, _ in got]
    assert sum(sizes) == 300 and max(sizes) == 64 and len(sizes) == 5
    assert [len(b.doc_at) - 1 for _, b in got] == sizes


def test_wide_token_ids_are_refused(spark):
    from salesmatch.llm import worddict
    wide = worddict.encode_documents(frame(spark), ["doc_id"], "text", wordblocks.word_spans, lambda: lambda words: [[70_000] for _ in words])
    with pytest.raises(Exception, match="does not fit 16 bits"):
        wide.count()


def test_forgotten_words_are_encoded_again(spark, monkeypatch):
    from salesmatch.llm import worddict
    monkeypatch.setattr(worddict, "_KNOWN", 5)
    ids = worddict.encode_documents(frame(spark), ["doc_id"], "text", wordblocks.word_spans, lambda: lambda words: [[len(w)] for w in words])
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in ids.collect()}
    assert all(got[i] == [len(w) for w in (t or "").encode().split()] for i, t in TEXTS)


def test_bpe_round_trip_is_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizers_io.load_ranks(path),
                            special_tokens={})
    got = Counter(tuple(r) for r in bpe.round_trip(frame(spark), path).collect())
    want = Counter()
    for i, t in TEXTS:
        ids = lib.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.round_trip(empty(spark), path).count() == 0
    ids = bpe.encode(frame(spark), path, ["doc_id", "block"])
    row = bpe.id_array(ids).where("doc_id = 8").first()
    assert row.tokens == lib.encode_ordinary("two words") and row.block == 1
    assert bytes(bpe.decode(ids, path).where("doc_id = 8").first().decoded) == b"two words"


def test_token_files_read_back(spark, tmp_path):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(vocabulary)
    lib.encode_special_tokens = True
    path = tokenfiles.write_documents(frame(spark), vocabulary, 2, str(tmp_path / "ids"))
    got = sorted(tuple(r) for r in tokenfiles.digests(spark, path).collect())
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda x: x[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    some = tokenfiles.read_tokens(spark, path, 7, 8)
    assert sorted({r.doc_id for r in some.collect()}) == [7, 8]
    assert "array<int>" not in tokenfiles.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    path = tokenfiles.write_documents(empty(spark), vocabulary, 2, str(tmp_path / "none"))
    assert tokenfiles.digests(spark, path).count() == 0


def test_best_fit_is_whole_and_tight(spark):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(vocabulary)
    lib.encode_special_tokens = True
    rows = bestfit.pack_documents(frame(spark), vocabulary, 0, 64).collect()
    want = Counter()
    total = 0
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at, edge = 0, len(ids) - (len(ids) - 1) // 64 * 64
        for piece, end in enumerate(range(edge, len(ids) + 1, 64)):
            want[(i, piece, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes()))] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-total // 64) + 2
    assert bestfit.pack_documents(empty(spark), vocabulary, 0, 64).count() == 0


def test_best_fit_merges_underfull_bins(spark):
    items = spark.range(400).select(F.col("id"), F.when(F.col("id") % 4 == 0, 90).otherwise(10).alias("length")) \
        .repartition(4)
    out = bestfit.pack(items, "length", 100)
    assert out.select("id").distinct().count() == 400 and out.count() == 400
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.where("n > 100").count() == 0
    assert fill.count() <= 125  # 12,000 tokens fill 120 bins at best


def brute_lines(texts):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first, docs = {}, {}
    key = lambda s: s.strip(WS).translate(up)
    for i, t in texts:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                first[key(s)] = min(i, first.get(key(s), i))
                docs.setdefault(key(s), set()).add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(docs.get(key(s), ())) < 2 or first[key(s)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_matches_brute_force(spark):
    assert sorted(tuple(r) for r in linededup.line_digests(frame(spark)).collect()) == brute_lines(TEXTS)
    many = [(i, "\n".join(f"a common line {j % 7}" if j % 3 else f"own line number {i} {j}" for j in range(i % 9)))
            for i in range(200)]
    docs = frame(spark, many)
    for batches in (1, 5):  # five batches: the runs are merged twice
        got = linededup.dedup_lines(docs, batches=batches).select(
            "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
        assert sorted(tuple(r) for r in got) == brute_lines(many)
    assert linededup.line_digests(empty(spark)).count() == 0
    assert linededup.dedup_lines(docs.withColumn("doc_id", F.lit(None).cast("long"))).where("n_dropped > 0").count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    """Smallest key reachable over values (key, number) at most two bits apart."""
    root = {k: k for k, _ in values}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(values):
        for b, y in values[:i]:
            if bin(x ^ y).count("1") <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in values}


def test_simhash_fingerprints_and_groups(spark):
    rows = simhash.near_duplicates(frame(spark)).collect()
    assert len(rows) == len(TEXTS)
    want = {i: brute_fingerprint(t) for i, t in TEXTS}
    groups = brute_components(sorted(want.items()))
    for r in rows:
        assert (int(r.fingerprint, 16), r.component_id) == (want[r.doc_id], groups[r.doc_id])
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [130, 3])
def test_simhash_links_of_clusters(spark, dense):
    """Random clusters whose members differ by a few bits, through the probes and through the dense slots."""
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(15):
            x = base
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    signed = sorted(int(np.uint64(v).view(np.int64)) for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    edges = simhash.links(fps, 2, dense=dense)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges.collect())
    got = {r.node: r.component for r in components.components(edges).collect()}
    want = brute_components([(v, v & (1 << 64) - 1) for v in signed])
    assert {v: got.get(v, v) for v in signed} == want


def test_thresholds_add_up(spark):
    fps = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(-2**62, 2**62, 500)], "fp long")
    groups = simhash.correlated_groups(fps, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    got = simhash.Allocator(fps, groups, 2).thresholds(np.arange(50, dtype=np.uint64))
    assert (got.sum(1) == 0).all() and got.min() >= -1 and got.max() <= 2


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_license_scan_matches_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs = frame(spark)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = licenses.license_rows(docs)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({licenses.sql()}) ORDER BY 1").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[9].base_labels == "mit" and rows[14].base_labels == "apache-2,cc-by-nc" and rows[3].n_words == 0
    assert licenses.license_rows(empty(spark)).count() == 0


def test_license_notice_of_reserved_rights(spark):
    got = licenses.license_rows(frame(spark, [(1, "Some text.\nAll rights reserved.\nMore"), (2, "all rights")]))
    assert {r.doc_id: (r.labels, r.score) for r in got.collect()} == {1: ("all-rights-reserved", 1.0), 2: ("", 0.0)}


def test_license_notices_across_lines(spark):
    mit = licenses.TEMPLATES["mit"][2].split()
    wrapped = "Code\n" + "\n".join(" * " + " ".join(mit[i:i + 7]) for i in range(0, len(mit), 7)) + "\nint main() {}"
    both = "licensed under the apache license version 2 0 or " + licenses.TEMPLATES["bsd-3"][0].replace("following ", "")
    family = licenses.TEMPLATES["cc-by-sa"][0].replace("creative ", "creative\n")
    apart = "licensed by all\n" + "word " * 30 + "\nrights\n" + "word " * 30 + "\nreserved"
    docs = frame(spark, [(1, wrapped), (2, both), (3, family), (4, apart), (5, "All rights\nreserved. " * 3)])
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["mit", "apache-2,bsd-3", "cc-by-sa", "", "all-rights-reserved"]
    assert [(b.line, b.label, b.share) for b in got[1].blocks] == [(1, "mit", 1.0)]


def brute_counts(text):
    words = text.encode().split()
    seen, dup = set(), 0
    for s in text.split("\n"):
        if s.strip(WS):
            dup += s in seen
            seen.add(s)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    held = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(held))


@pytest.mark.parametrize("text", ["", " ", "a b c a b c", "x x x x x", "a\na\n \n \nb|#a", "é ü é ü é ü\né ü é ü é ü", LONG])
def test_quality_counts(text):
    assert quality.text_counts(text) == brute_counts(text)


def prose(seed, words=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ta", "re", "no", "li", "su", "men"], rng.integers(1, 4))) for _ in range(words))


def test_the_driver_keeps_no_model_after_its_broadcast(spark, monkeypatch):
    held = lambda: sum(isinstance(x, ngrams.HashedModel) for x in gc.get_objects())
    gc.collect()
    before, after = held(), []
    monkeypatch.setattr(quality, "give_back", lambda: after.append(held()))
    quality.judge(frame(spark, [(i, prose(i)) for i in range(10)]), ["doc_id"])
    assert after == [before]


def test_quality_bands_keep_prose_and_reject_noise(spark):
    noise = "".join(chr(c) for c in np.random.default_rng(0).integers(0x4E00, 0x5E00, 2000))
    noise = " ".join(noise[i:i + 20] for i in range(0, 2000, 20))
    rows = [(i, prose(i)) for i in range(2, 120, 2)] + [(500, noise), (502, "short text"), (504, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality.judge(docs, ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(2, 120, 2))
    assert not got[500].kept and not got[500].base_failed and got[502].base_failed and got[504].n_words == 0
    joined = {r.doc_id: r for r in quality.judge(docs, ["doc_id"], broadcast_bytes=0).collect()}
    assert {i: (r.score, r.low, r.high, r.kept) for i, r in joined.items()} == {
        i: (r.score, r.low, r.high, r.kept) for i, r in got.items()}
    carried = {r.doc_id: r.text for r in quality.judge(docs, ["doc_id"], carry=True).collect()}
    assert carried == {i: t or "" for i, t in rows}
    assert quality.verdicts(empty(spark)).count() == 0


def test_quality_bands_reject_separator_lists(spark):
    # A list of short runs between bars among the clean texts.
    rows = [(i, prose(i)) for i in range(2, 240, 2)] + [(502, " | ".join(prose(i, 2) for i in range(301, 361)))]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(2, 240, 2))
    assert not got[502].kept and not got[502].base_failed and got[502].score > got[502].high


def test_model_probabilities_add_up(spark):
    docs = frame(spark, [(2 * i, prose(i, 30)) for i in range(8)])
    model = ngrams.fit(docs)
    weights = {(r.lang, r.k, r.gram): r.logg for r in model.backoff.collect()}
    rows = model.rows.collect()
    p = {(r.lang, r.k, r.gram): np.exp(r.logp) for r in rows}
    for k in (2, 5):  # over all characters: the seen ones, and the rest by the back-off
        alphabet = [r.gram for r in rows if r.k == 1]
        context = next(r.gram[:-1] for r in rows if r.k == k and "\n" not in r.gram)

        def probability(gram):
            if not gram:
                return np.exp(weights[("", 1, "")])
            if ("", len(gram), gram) in p:
                return p[("", len(gram), gram)]
            back = np.exp(weights.get(("", len(gram), gram[:-1]), 0.0)) if len(gram) > 1 else 1.0
            return back * probability(gram[1:])

        total = sum(probability(context + c) for c in alphabet)
        assert 0.97 < total <= 1.0001


def test_joined_scores_equal_the_hashed_model(spark, monkeypatch):
    """Texts that the model knows and others, copies, texts of several pieces, null and empty ones."""
    monkeypatch.setattr(ngrams, "WINDOW", 700)
    docs = frame(spark, [(i, prose(i)) for i in range(2, 30, 2)])
    model = ngrams.fit(docs, "lang", "text")
    texts = [(i, prose(i)) for i in range(2, 12, 2)] + [(i, prose(i, 400)) for i in range(50, 56)] + [
        (100, prose(4)), (102, prose(4)), (104, None), (106, ""), (108, "Ünseen 中文 !?"), (51, "odd ids have no language")]
    other = frame(spark, texts).repartition(3)
    hashed = ngrams.HashedModel(model)
    want = {}
    for r in other.collect():
        lang, text = r.lang or "", r.text or ""
        for group in ngrams.pieces([(0, lang, text)], 1 << 20):
            points, langs, of, at, h, index, own = ngrams.distinct_grams(group)
            want[lang, text] = (len(index), float(hashed.logp(points, langs, of, at, h)[index].sum()))
    got = {(r.lang, r.row): (r.n_grams, r.logp) for r in ngrams.joined_scores(other, model, "lang", "text").collect()}
    keys = {(r.lang, r.row): (r.lang, r.text) for r in other.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")).collect()}
    assert set(got) == set(keys) and len(got) == len(want)
    for key, (n, logp) in got.items():
        assert n == want[keys[key]][0] and logp == pytest.approx(want[keys[key]][1], abs=1e-8)


def test_secret_forest_holds_out(spark):
    from pyspark.ml.feature import VectorAssembler

    words = spark.createDataFrame([(w,) for w in "water river mountain letter number morning garden silver".split()], "w string")
    pairs = secretscan.pair_scores(words)
    model = secretscan.train(secretscan.default_findings(words), words, pairs)
    held = secretscan.features(secretscan.default_findings(words, 800, "other"), words, pairs)
    held = model.transform(VectorAssembler(inputCols=secretscan.FEATURES, outputCol="x").transform(held))
    assert held.where("prediction = label").count() >= 0.97 * held.count()


def test_secrets_are_found_and_masked(spark):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'say token = "{key}"### and more'), (2, f"commit {key[::-1]} of the card 4952935900253052"), (3, None),
            (4, ""), (5, f"password: Tr0ub4dor!x9Qz\napi_key={key[:32]} end")]
    docs = frame(spark, rows)
    got = {r["doc"]["doc_id"]: r["clean"] for r in secretscan.masked(docs).collect()}
    assert key not in got[1] and got[1].startswith('say token = "[SECRET]"') and got[2] == rows[1][1]
    assert got[3] is None and got[4] == "" and key[:32] not in got[5]
    assert secretscan.secret_rows(empty(spark)).count() == 0


def test_secrets_inside_words_are_found(spark):
    key = hashlib.sha1(b"j").hexdigest()
    aws, git = "AKIA" + "7QK2MNX4B9TRZ5WP", "ghp_" + hashlib.sha256(b"g").hexdigest()[:36]
    rows = [(1, '{"id":"7","api_key":"%s","n":3}' % aws), (2, f"see https://h.org/?a=1&access_token={git} for it"),
            (3, "db is postgres://admin:h4rd%word9x@db.host/main here"), (4, f"A=1;TOKEN={aws};B=2"), (5, f"api_key=({key})"),
            (6, "password='Tr0ub4dor!x9Qz'"), (7, f"https://h.org/commit/{key[::-1]}?tab=files and https://user@h.org/a:b"),
            (8, '{"a":"b","c":[1,2,3],"when":"2024-01-15T10:00:00"}'), (7, f"token={key}"), (None, f"secret: {git}")]
    got = {}
    for r in secretscan.masked(frame(spark, rows)).collect():
        got.setdefault(r["doc"]["doc_id"], []).append(r["clean"])
    assert got[1] == ['{"id":"7","api_key":"[SECRET]","n":3}'] and got[2] == ["see https://h.org/?a=1&access_token=[SECRET] for it"]
    assert got[3] == ["db is postgres://admin:[SECRET]@db.host/main here"] and got[4] == ["A=1;TOKEN=[SECRET];B=2"]
    assert got[5] == ["api_key=([SECRET])"] and got[6] == ["password='[SECRET]'"] and got[None] == ["secret: [SECRET]"]
    assert sorted(got[7]) == sorted([rows[6][1], "token=[SECRET]"]) and got[8] == [rows[7][1]]


def test_json_like_text_is_no_secret(spark):
    docs = frame(spark, [(1, json.dumps({"version": "2024.01.15-build-00231", "order": "20240115000231"}))])
    assert secretscan.findings(docs).where("is_secret").count() == 0
