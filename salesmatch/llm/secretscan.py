"""Operator 4: secret scans with a random forest that removes false positives.

DataFrame operations and the DataFrame machine-learning library only. Lines that
may hold a secret give candidate values with their neighbouring words. Features
of a candidate: length, shares and changes of character classes, the corpus's
letter-pair probabilities, coverage by the corpus's dictionary, hints in the path
and in the neighbouring words. A random forest trained on labelled findings
decides.

Labelled findings are a parameter. By default they are made here by Spark from
hashes, numbers and words of the corpus's own dictionary (``LABELLED`` rows, the
documented bound): values of many kinds of keys in the contexts in which they are
found, and digests, identifiers, numbers, slugs and placeholders in theirs.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmatch.llm.common import text_or_empty, written

#: Rows of the default labelled findings.
LABELLED = 6_000
#: A dictionary word stands in so many documents at least.
WORD_DOCS = 3
MASK = "[SECRET]"

_VALUE = r"[A-Za-z0-9_+/=~.\-]{16,}"
#: scheme://user:password@host
_LOGIN = r"://[^\s/@:]*:[^\s/@]+@"
#: What separates runs, and a run with its base64 padding; "=" before a run or a quote is an assignment.
_RUNS = r"([^A-Za-z0-9_+/~.\-]*)([A-Za-z0-9_+/~.\-]+(?:={1,2}(?![A-Za-z0-9_+/~.\-=\"'`]))?)"
_KEYWORD = r"(?:passw(?:or)?d|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth|credential|private[ _-]?key|bearer)"
_DIGEST = r"\b(?:sha\d*|md5|commit|checksum|hash|digest|uuid|guid|revision|etag|build|version|order|invoice|phone|card)\b"
_SHAM = r"(?:example|dummy|sample|changeme|placeholder|your|xxxx|test|fake|<|\$\{)"
_SHAM_PATH = r"(?:test|example|sample|mock|fixture|doc)"
FEATURES = ["length", "digits", "uppers", "lowers", "others", "changes", "variety", "pairs", "covered", "path_sham",
            "near_key", "near_digest", "near_sham", "assigned", "quoted", "one_class"]


def candidates(docs: DataFrame, doc_id: str, text: str, path: str | None) -> DataFrame:
    """id, row (hash of the text), line, word, path, before (two words and the own prefix), after, raw, value."""
    body = text_or_empty(text)
    hint = rf"{_VALUE}|{_LOGIN}|(?i:{_KEYWORD})"
    lines = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(body).alias("row"),
                        (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"),
                        F.split(body, "\n").alias("lines")).where(F.exists("lines", lambda s: s.rlike(hint)))
    lines = lines.select("id", "row", "path", F.posexplode("lines").alias("line", "s")).where(F.col("s").rlike(hint))
    words = lines.select("id", "row", "path", "line", F.split("s", r"\s+").alias("words"))
    words = words.select("id", "row", "path", "line", "words", F.posexplode("words").alias("word", "raw"))
    # A word without white space may hold several values: minified JSON, query strings, connection strings.
    words = words.where(F.col("raw").rlike("[A-Za-z0-9_+/~.\\-]{6,}")).withColumn(
        "seps", F.regexp_extract_all("raw", F.lit(_RUNS), F.lit(1))).withColumn(
        "runs", F.regexp_extract_all("raw", F.lit(_RUNS), F.lit(2)))
    words = words.select("*", F.posexplode("runs").alias("part", "run"))
    two = [F.when(F.col("word") >= k, F.get("words", F.col("word") - k)).otherwise("") for k in (2, 1)]
    sep = F.get("seps", F.col("part"))
    own = F.when(F.col("part") > 0, F.concat(F.get("runs", F.col("part") - 1), F.regexp_replace(sep, "[\"'`]+$", ""))).otherwise("")
    rest = F.concat("run", F.array_join(F.zip_with(
        F.slice("seps", F.col("part") + 2, F.size("runs")), F.slice("runs", F.col("part") + 2, F.size("runs")), lambda a, b: F.concat(a, b)), ""))
    login = (sep == ":") & rest.rlike("^[^@/]+@") & F.col("raw").rlike(_LOGIN)
    found = words.select("id", "row", "path", "line", "word", "raw",
                         F.concat_ws(" ", *two, F.when(login, "password:").otherwise(own)).alias("before"),
                         F.coalesce(F.get("runs", F.col("part") + 1), F.get("words", F.col("word") + 1), F.lit("")).alias("after"),
                         F.regexp_replace("run", "^[.\\-]+|[.\\-]+$", "").alias("run"), login.alias("login"), rest.alias("rest"))
    told = F.lower("before").rlike(_KEYWORD + r"[^:=]{0,3}[:=]\s*$")
    # What is named a secret is taken with all its marks, up to a quote, the next field or the host.
    whole = F.regexp_replace(F.regexp_extract("rest", "^[^\"'`,;&]+", 0), r"[.)\]}]+$", "")
    found = found.withColumn("told", told).withColumn("value", F.when(F.col("login"), F.regexp_extract("rest", "^[^@]+", 0)).when(
        told, whole).otherwise(F.col("run")))
    long = F.col("value").rlike(f"^{_VALUE}$") & F.col("value").rlike("[0-9]")
    size = F.char_length("value")
    return found.where(long | (F.col("told") & (size >= 8)) | (F.col("login") & (size >= 6))).drop("login", "told", "rest", "run")


def dictionary(docs: DataFrame, text: str) -> DataFrame:
    """Runs of the letters a-z (of four and more) that stand in WORD_DOCS documents or more."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_or_empty(text)), "[^a-z]+"))).alias("w"))
    return words.where(F.char_length("w") >= 4).groupBy("w").agg(F.count("*").alias("n")).where(
        F.col("n") >= WORD_DOCS).select("w")


def pair_scores(words: DataFrame) -> dict[str, float]:
    """Log probability of the second letter after the first, for the at most 676 letter pairs of the dictionary."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("w") - 1),
                                               lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    counted = {r.p: r.n for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}
    total: dict[str, int] = {}
    for p, n in counted.items():
        total[p[0]] = total.get(p[0], 0) + n
    from math import log

    return {p: log((n + 0.5) / (total[p[0]] + 13)) for p, n in counted.items()}


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.col("length")


def features(found: DataFrame, words: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """``found`` with the columns of FEATURES."""
    # Letter runs of all candidates meet the dictionary; only runs that a candidate holds are joined.
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(
        F.lower("value"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    covered = runs.join(words, "w").groupBy("value").agg(F.sum(F.char_length("w")).alias("hits"))
    low = F.lower("value")
    if pairs:
        table = F.create_map(*[F.lit(x) for item in pairs.items() for x in item])
        # The table is one literal column; each pair of a value is looked up in it.
        value = F.transform(F.sequence(F.lit(1), F.greatest(F.col("length") - 1, F.lit(1)).cast("int")),
                            lambda i: F.coalesce(F.try_element_at(table, F.substring(low, i, F.lit(2))), F.lit(-8.0)))
        likely = F.aggregate(value, F.lit(0.0), lambda a, x: a + x) / F.size(value)
    else:
        likely = F.lit(-8.0)
    before = F.lower("before")
    rows = found.join(covered, "value", "left").withColumn("length", F.char_length("value").cast("double"))
    classes = "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
    return rows.select(
        *found.columns, "length", _share("[0-9]").alias("digits"), _share("[A-Z]").alias("uppers"),
        _share("[a-z]").alias("lowers"), _share("[^A-Za-z0-9]").alias("others"),
        ((F.regexp_count("value", F.lit(classes)) - 1) / F.col("length")).alias("changes"),
        (F.size(F.array_distinct(F.split(low, ""))) / F.sqrt("length")).alias("variety"), likely.alias("pairs"),
        (F.coalesce("hits", F.lit(0)) / F.col("length")).alias("covered"),
        *[flag.cast("double").alias(name) for name, flag in (
            ("path_sham", F.lower("path").rlike(_SHAM_PATH)), ("near_key", before.rlike(_KEYWORD)),
            ("near_digest", F.concat_ws(" ", before, F.lower("after")).rlike(_DIGEST)),
            ("near_sham", F.concat_ws(" ", before, low).rlike(_SHAM)),
            ("assigned", before.rlike(r"[:=]\s*$")), ("quoted", F.col("raw").rlike("[\"'`]")),
            ("one_class", F.col("value").rlike("^(?:[0-9.+-]+|[a-z]+|[A-Z]+)$")))])


def default_findings(words: DataFrame, rows: int = LABELLED, salt: str = "") -> DataFrame:
    """Labelled findings made from hashes and from dictionary words; salt gives other rows for a held-out test."""
    spark = words.sparkSession
    n = F.col("n")
    seed = F.concat(n.cast("string"), F.lit(salt))
    some = words.orderBy(F.xxhash64(F.lit(salt), "w")).limit(400).agg(F.sort_array(F.collect_list("w")).alias("ws"))
    base = spark.range(rows).select(F.col("id").alias("n")).join(F.broadcast(some), how="left").withColumn(
        "ws", F.when(F.size("ws") > 0, F.col("ws")).otherwise(F.array(F.lit("thing"), F.lit("other"))))

    def draw(options: int, tag: str) -> Column:
        return F.pmod(F.xxhash64(seed, F.lit(tag)), F.lit(options)).cast("int")

    def one_of(values: list, tag: str) -> Column:
        return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), draw(len(values), tag))

    def word(tag: str) -> Column:
        return F.get("ws", F.pmod(F.xxhash64(seed, F.lit(tag)), F.size("ws")).cast("int"))

    hexes = F.sha2(seed, 512)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(seed, F.lit("b")), 512))), "[+/=\\n\\r]", "")
    size = draw(5, "size") * 8 + 24
    keys = [F.substring(hexes, F.lit(1), size), F.substring(mixed, F.lit(1), size),
            F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
            F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(word("pw"), F.lit("!"), F.substring(mixed, 1, 8)),
            F.substring(hexes, 1, 40), F.substring(hexes, 1, 64)]
    digits = F.regexp_replace(F.concat(hexes, F.sha2(F.concat(seed, F.lit("d")), 512)), "[a-f]", "")
    shams = [F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.substring(hexes, 1, 64),
             F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4),
                         F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)),
             F.substring(digits, 1, 16), F.substring(digits, F.lit(1), draw(8, "digits") + 16),
             F.concat_ws("-", word("a"), word("b"), word("c"), F.substring(digits, 1, 4)),
             F.concat_ws("_", word("a"), word("b"), word("c"), F.substring(digits, 1, 2)),
             F.concat(word("a"), word("b"), word("c"), F.substring(digits, 1, 3)),
             F.concat(F.lit("/"), F.concat_ws("/", word("a"), word("b"), word("c"), F.substring(digits, 1, 4)), F.lit(".html")),
             F.concat(F.lit("your_"), word("a"), F.lit("_token_here_1")), F.lit("xxxxxxxxxxxxxxxx0000"),
             F.concat(word("a"), F.lit("."), word("b"), F.lit("@1.2.3"), F.substring(digits, 1, 6)),
             F.upper(F.concat_ws("-", word("a"), word("b"), F.substring(digits, 1, 6)))]
    named = ["token", "api_key", "secret", "password", "access_key", "auth_token", "client secret", "apikey", "private_key",
             "db_password", "API token"]
    told = F.concat(one_of(named, "named"), one_of([" =", ":", "=", " :"], "sign"))
    bare = F.concat_ws(" ", word("x"), word("y"), F.lit(""))
    near_key = F.concat(one_of([told, told, told, F.concat(word("x"), F.lit(" "), told), F.concat_ws(" ", F.lit("bearer"), F.lit(""))],
                               "near"))
    near_sham = one_of([bare, bare, bare, "commit", "sha256:", "md5 =", "uuid:", "id =", "version =", "order", "checksum:", "etag ="],
                       "sham")
    kind = draw(2, "label")
    # A placeholder stands where a secret would; other decoys stand in running text or behind their own names.
    decoy = draw(len(shams), "decoy")
    rows_ = base.select(
        "n", kind.cast("double").alias("label"), decoy.alias("d"),
        F.when(kind == 1, one_of(keys, "key")).otherwise(F.get(F.array(*shams), decoy)).alias("value"),
        F.when(kind == 1, near_key).when(decoy.isin(10, 11), told).otherwise(near_sham).alias("before"),
        F.when(draw(3, "after") == 0, F.lit("")).otherwise(word("z")).alias("after"), draw(3, "quote").alias("q"),
        one_of(["", "src1", "src12", "app/config", "web/page", "app/tests/data"], "path").alias("path"))
    return rows_.select("label", "value", "before", "after", "path", F.when(
        F.col("q") > 0, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value")).alias("raw"))


def train(labelled: DataFrame, words: DataFrame, pairs: dict[str, float], seed: int = 11) -> RandomForestClassificationModel:
    """A forest on labelled findings (label, value, before, after, raw, path)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(labelled, words, pairs))
    rows = written(rows.select("x", "label"), "labelled")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=40, maxDepth=8, seed=seed,
                                  subsamplingRate=0.8).fit(rows)


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source",
             labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """id, row, line, word, value, score and is_secret of every candidate.

    A null text has none; a null path counts as empty. Repeated rows repeat their
    findings. Extra columns are ignored; an empty table gives an empty result.
    """
    words = written(dictionary(docs, text), "dictionary")
    pairs = pair_scores(words)
    model = train(default_findings(words) if labelled is None else labelled, words, pairs)
    found = written(features(candidates(docs, doc_id, text, path), words, pairs), "candidates")
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found))
    score = vector_to_array("probability")[1]
    return scored.select("id", "row", "line", "word", "value", score.alias("score"), (score >= threshold).alias("is_secret"))


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``docs`` in struct ``doc`` and ``clean``: the text with every secret found in it replaced by MASK.

    A null text stays null, an empty one empty; rows that share a doc_id are masked each by its own findings, a null
    doc_id like any other. Repeated rows and extra columns stay; an empty table gives an empty one.
    """
    own = findings(docs, doc_id, text, path).where("is_secret").groupBy("id", "row").agg(
        F.sort_array(F.collect_set("value"), asc=False).alias("secrets"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(doc_id).cast("long").alias("id"),
                       F.xxhash64(text_or_empty(text)).alias("row"))
    own = own.select(F.col("id").alias("i"), F.col("row").alias("r"), "secrets")
    body = F.col(f"doc.`{text}`")
    # Longer secrets first, in case one holds another.
    ordered = F.array_sort("secrets", lambda a, b: F.char_length(b) - F.char_length(a))
    return rows.join(own, (F.col("row") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")), "left").select(
        "doc", F.when(F.col("secrets").isNull(), body).otherwise(
            F.aggregate(ordered, body, lambda acc, s: F.replace(acc, s, F.lit(MASK)))).alias("clean"))


def secret_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line, word, value, score and is_secret of every candidate of all documents."""
    return findings(docs).select(F.col("id").alias("doc_id"), F.col("line").cast("long").alias("line"),
                                 F.col("word").cast("long").alias("word"), "value", "score", "is_secret")
