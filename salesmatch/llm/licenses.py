"""Operator 6: license scans by an exact set-similarity join.

A text block meets a template if it holds at least the threshold share of the
template's distinct words. Blocks are the lines, and all windows of words across
lines that are a quarter (at least two words) longer than the template. Template words are ordered by how many blocks
of the whole corpus hold them, rarest first. Any block that meets a template of
n words with k required ones holds one of its n - k + 1 rarest words (prefix
filter), has at least k distinct words (length filter), and after its first
matching prefix place still has enough words left (position filter); what passes
is verified exactly. The templates and their word counts are a fixed parameter,
so they are all that is sent to the tasks.

Base phrases are found word by word over the whole text, across lines.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmatch.llm.common import text_or_empty

#: Fixed values of the contract: phrases and their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Short license notices as they stand in files, by label.
TEMPLATES = {
    "gpl-3": ["this work is licensed under the gnu general public license version 3",
              "this program is free software you can redistribute it and or modify it under the terms of the gnu "
              "general public license as published by the free software foundation either version 3"],
    "mit": ["released under the mit license", "this project is licensed under the terms of the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"],
    "apache-2": ["licensed under the apache license version 2 0",
                 "you may not use this file except in compliance with the license you may obtain a copy of the "
                 "license at apache org licenses license 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0",
                 "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license",
                 "licensed under cc by sa 4 0"],
    "bsd-3": ["redistribution and use in source and binary forms with or without modification are permitted "
              "provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "all-rights-reserved": ["copyright all rights reserved", "all rights reserved"],
}

#: Share of a template's distinct words that a block must hold. Notices of five
#: words differ in one word only, so the share leaves no room there.
THRESHOLD = 0.9

_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall


def lower(text: str) -> str:
    """A-Z in lower case; other letters as they are."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words(text: str) -> list[str]:
    return _WORDS(lower(text))


def _vocabulary(templates) -> set[str]:
    return {w for notices in templates.values() for t in notices for w in words(t)}


def word_frequencies(docs: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """Number of lines of all documents that hold each word of the (fixed) vocabulary."""
    def run(batches):
        total: dict[str, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for line in lower(t).split("\n"):
                    for w in vocabulary.intersection(_WORDS(line)):
                        total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())},
                                         schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select(text_or_empty(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in rows.collect()}  # at most one row for each template word


class Index:
    """Inverted lists of the templates' prefix words."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], threshold: float):
        self.templates, self.postings, self.reach = [], {}, []
        for label, notices in sorted(templates.items()):
            for t in notices:
                ordered = sorted(set(words(t)), key=lambda w: (frequency.get(w, 0), w))
                need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
                number = len(self.templates)
                self.templates.append((label, frozenset(ordered), need))
                n = len(words(t))
                self.reach.append(n + max(2, n // 4))
                for place, w in enumerate(ordered[:len(ordered) - need + 1]):
                    self.postings.setdefault(w, []).append((number, len(ordered) - place))

    def near(self, held: set[str], hits) -> list[int]:
        """Templates that words ``held`` meet; ``hits`` are their prefix words."""
        first: dict[int, int] = {}
        for w in hits:
            for number, left in self.postings[w]:
                first[number] = max(left, first.get(number, 0))
        return [n for n, left in first.items()
                if min(len(held), left) >= self.templates[n][2] and len(self.templates[n][1] & held) >= self.templates[n][2]]

    def match(self, lines: list[list[str]]) -> list[tuple[int, str, float]]:
        """Line, label and containment of every line and every window of words that meets a template.

        A window may cross lines; it is bounded by its template's length. A match
        goes if its words stand in a better match that it overlaps, as notices of one
        family hold almost the same words.
        """
        tokens = [w for line in lines for w in line]
        held = set(tokens)
        doc = self.near(held, self.postings.keys() & held)
        if not doc:
            return []
        found, at = [], []  # found: first and last place, share, label, matched words, line
        begin = 0
        for n, line in enumerate(lines):
            at += [n] * len(line)
            own = set(line)
            for number in self.near(own, self.postings.keys() & own):
                label, template, _ = self.templates[number]
                found.append((begin, begin + len(line) - 1, len(template & own) / len(template), label, template & own, n))
            begin += len(line)
        for number in doc:
            label, template, need = self.templates[number]
            found += [(a, b, share, label, words_, at[a]) for a, b, share, words_ in
                      windows(tokens, template, need, self.reach[number]) if at[a] != at[b]]
        found.sort(key=lambda x: x[:2])
        gone = set()
        for i, x in enumerate(found):
            for j in range(i + 1, len(found)):
                y = found[j]
                if y[0] > x[1]:
                    break
                for a, b, k in ((x, y, i), (y, x, j)):  # a line comes before windows of its label
                    if a[4] <= b[4] and (a[2] < b[2] or a[3] == b[3] and a[2] == b[2] and at[a[0]] != at[a[1]] and at[b[0]] == at[b[1]]):
                        gone.add(k)
        best: dict[tuple[int, str], float] = {}
        for i, (_, _, share, label, _, n) in enumerate(found):
            if i not in gone:
                best[n, label] = max(share, best.get((n, label), 0.0))
        return [(n, label, share) for (n, label), share in sorted(best.items())]


def windows(tokens: list[str], template: frozenset[str], need: int, reach: int) -> list[tuple[int, int, float, frozenset[str]]]:
    """First and last place, containment and matched words of windows of at most ``reach`` words that hold
    ``need`` words of the template: the best ones first, without overlaps."""
    places = [i for i, w in enumerate(tokens) if w in template]
    count: dict[str, int] = {}
    left, some = 0, []
    for right in places:
        count[tokens[right]] = count.get(tokens[right], 0) + 1
        # The window's first word leaves it if it is out of reach or stands in the window again.
        while right - places[left] >= reach or count[tokens[places[left]]] > 1:
            w = tokens[places[left]]
            count[w] -= 1
            if not count[w]:
                del count[w]
            left += 1
        if len(count) >= need:
            some.append((-len(count), right - places[left], places[left], right, frozenset(count)))
    out, taken = [], set()
    for n, _, a, b, held in sorted(some, key=lambda x: x[:3]):
        if taken.isdisjoint(range(a, b + 1)):
            taken.update(range(a, b + 1))
            out.append((a, b, -n / len(template), held))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
         templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``blocks`` of every row.

    ``blocks`` lists (first) line number, label and containment of the lines and
    windows that meet a template. ``score`` is 1 with a base phrase, else the best containment, else 0.
    A null text has no words; repeated rows give one row each; extra columns are
    ignored.
    """
    index = Index(templates, word_frequencies(docs, _vocabulary(templates), text), threshold)
    wanted = [(label, words(p)) for label, p in sorted(phrases.items())]
    prefix = index.postings.keys()

    def base(tokens: list[str]):
        places, labels = [], set()
        for label, phrase in wanted:
            at = -1
            while True:
                try:
                    at = tokens.index(phrase[0], at + 1)
                except ValueError:
                    break
                if tokens[at:at + len(phrase)] == phrase:
                    places.append(at)
                    labels.add(label)
        return places, labels

    def run(batches):
        for b in batches:
            out = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = lower(t)
                tokens = _WORDS(t)
                places, labels = base(tokens)
                blocks = []
                if not prefix.isdisjoint(tokens):
                    blocks = index.match([_WORDS(line) for line in t.split("\n")])
                every = labels | {label for _, label, _ in blocks}
                out.append((key, len(tokens), len(places), min(places, default=None), max(places, default=None),
                            ",".join(sorted(labels)), ",".join(sorted(every)),
                            1.0 if places else max((s for _, _, s in blocks), default=0.0),
                            [{"line": n, "label": label, "share": s} for n, label, s in blocks]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("blocks", pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("share", pa.float64())])))])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double, "
                                "blocks array<struct<line: long, label: string, share: double>>")


def license_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``."""
    return scan(docs).drop("blocks")


def sql() -> str:
    """DuckDB SQL of ``license_rows`` in time linear in the text. It knows no windows across lines, and of a
    line only the labels with the highest share: on texts with such notices the operator finds more."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    split = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    most = max(len(words(p)) for p in PHRASES.values())
    leads = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, most))
    names = ["w", *(f"w{k}" for k in range(1, most))]
    found = " UNION ALL ".join(
        f"SELECT r, {quoted(k)} AS label, i FROM pos WHERE " + " AND ".join(
            f"{name} = {quoted(w)}" for name, w in zip(names, words(p))) for k, p in sorted(PHRASES.items()))
    notices = ", ".join(f"({quoted(k)}, {sorted(set(words(t)))!r}, {max(1, math.ceil(THRESHOLD * len(set(words(t))) - 1e-9))})"
                        for k, v in sorted(TEMPLATES.items()) for t in v)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {low} AS t FROM documents),
w AS MATERIALIZED (SELECT r, {split.format('t')} AS ws FROM d),
n AS (SELECT r, len(ws) AS n FROM w),
wp AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
pos AS (SELECT r, i, w, {leads} FROM wp WINDOW o AS (PARTITION BY r ORDER BY i)),
pl AS MATERIALIZED ({found}),
b AS (SELECT r, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM pl GROUP BY r),
tp(label, ws, need) AS (VALUES {notices}),
ln AS (SELECT r, line, list_distinct({split.format('line')}) AS ls
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT r, label, len(list_intersect(ls, ws)) / len(ws) AS share FROM ln, tp
      WHERE len(ls) >= need AND len(list_intersect(ls, ws)) >= need
      QUALIFY share = max(share) OVER (PARTITION BY r, line)),
ml AS (SELECT r, max(share) AS share FROM m GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM (SELECT r, label FROM m UNION SELECT r, label FROM pl) GROUP BY r)
SELECT d.doc_id, n.n AS n_words, coalesce(b.n, 0) AS n_base, b.f AS first_word, b.l AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(ml.share, 0.0) END::DOUBLE AS score
FROM d JOIN n ON d.r = n.r LEFT JOIN b ON d.r = b.r LEFT JOIN ml ON d.r = ml.r LEFT JOIN al ON d.r = al.r
"""
