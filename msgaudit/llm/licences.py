"""License scans over a positional index of rare words.

Templates are word sequences with a label: the fixed phrases, which must stand
word for word, and sentences of well-known licences, of which a few words may
differ.  The index is built from the corpus: how many documents hold each
template word gives its inverse document frequency (IDF), and every template is
posted under its rarest words only, as (word, template, place of the word).  A
template of n words of which m may be missing is posted under its m + 1 rarest
distinct ones, so any text that holds it holds one of the posted words too
(a phrase: its single rarest word).

Each file's licence words are looked up from the highest IDF down.  A posting at
place p and the word at position i propose the start i - p; proposals of one
template whose starts lie within ``DRIFT`` words compete.  At each the positions
of *all* the template's words are intersected relative to the start: the share
of the template's IDF that stands at its place (give or take ``DRIFT``) is the
coverage.  The best of the competing starts is a match if its coverage reaches
the template's threshold and each of the mandatory key phrases stands there word
for word.  A phrase is its own key: all its words must stand in a row.

Every text is read whole, in slices of bounded size that overlap by the longest
template; the index is bounded by the templates, whatever the corpus.  Null
texts count as empty; empty texts have no words, no matches and score 0.  Rows
are independent of each other, so nulls in other columns, repeated rows and ties
change nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Words that an inexact match may be shifted by.
DRIFT = 3
#: Bytes of text cut into words at once.
SLICE_BYTES = 4 << 20

# The phrases and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: Label, sentence, mandatory key phrases, least coverage.
SENTENCES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"], 0.8),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"], 0.8),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
     "by the free software foundation", ["general public license", "free software foundation"], 0.7),
    ("lgpl-notice", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ["lesser general public license"], 0.7),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"], 0.8),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", ["permission is hereby granted", "any person obtaining a copy"], 0.7),
    ("mit-notice", "released under the mit license", ["mit license"], 0.8),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ["source and binary forms", "with or without modification"], 0.7),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ["with or without fee"], 0.7),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"], 0.7),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"], 0.8),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"], 0.8),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"], 0.8),
    ("cc-by-named", "licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution"], 0.7),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"], 0.7),
]

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    """A word sequence; without ``least`` it must stand word for word."""

    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...] = ()
    least: float | None = None

    @property
    def exact(self) -> bool:
        return self.least is None


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text, A-Z in lower case; a character beyond ASCII is a letter of a word."""
    return WORD.findall(text.lower())


def templates(phrases=PHRASES, sentences=SENTENCES) -> list[Template]:
    cut = lambda s: tuple(words_of(s.encode()))
    return ([Template(label, cut(text)) for label, text in phrases]
            + [Template(label, cut(text), tuple(cut(k) for k in keys), least) for label, text, keys, least in sentences])


@dataclass
class Match:
    template: int
    start: int
    coverage: float


@dataclass
class Found:
    """What a text holds."""

    n_words: int = 0
    matches: list[Match] = field(default_factory=list)
    best: float = 0.0


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, known: list[Template], documents: int, frequency: dict[bytes, int]):
        self.templates = known
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1.0 for t in known for w in t.words}
        self.rank = {w: k for k, w in enumerate(sorted(self.idf, key=lambda w: (-self.idf[w], w)))}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weight, self.longest = [], 0
        for k, t in enumerate(known):
            self.weight.append(sum(self.idf[w] for w in t.words))
            self.longest = max(self.longest, len(t.words))
            distinct = sorted(set(t.words), key=lambda w: self.rank[w])
            for word in distinct[:self._posted(k, distinct)]:
                self.postings[word] += [(k, p) for p, w in enumerate(t.words) if w == word]

    def _posted(self, k: int, distinct: list[bytes]) -> int:
        """How many of the rarest words must be posted: one more than can all be missing at the least coverage."""
        t = self.templates[k]
        if t.exact:
            return 1
        count, spare = Counter(t.words), (1 - t.least) * self.weight[k] + 1e-9
        for n, word in enumerate(distinct):
            spare -= self.idf[word] * count[word]
            if spare < 0:
                return n + 1
        return len(distinct)

    # ---- one text

    def scan(self, text: bytes, slice_bytes: int = SLICE_BYTES) -> Found:
        """Words and matches of one text; how it is cut into slices makes no difference."""
        found, words, base, own, reach = Found(), [], 0, -math.inf, self.longest + 2 * DRIFT
        for new, last in _slices(text, slice_bytes):
            words += new
            # this slice decides the starts in [own, until): all the words around them are here
            until = math.inf if last else max(own, base + len(words) - reach)
            self._decide(words, base, own, until, found)
            keep = 0 if last else min(len(words), int(base + len(words) - max(until, base) + reach))
            base, words, own = base + len(words) - keep, words[len(words) - keep:], until
        found.n_words = base
        found.matches.sort(key=lambda m: (m.start, m.template))
        return found

    def _decide(self, words: list[bytes], base: int, own: float, until: float, found: Found) -> None:
        places: dict[bytes, list[int]] = defaultdict(list)
        rank = self.rank
        for i, word in enumerate(words):
            if word in rank:
                places[word].append(i)
        proposed: dict[int, set[int]] = defaultdict(set)
        for word in sorted(places, key=rank.__getitem__):  # from the highest IDF down
            for k, p in self.postings.get(word, ()):
                proposed[k].update(i - p for i in places[word])
        for k, starts in proposed.items():
            t = self.templates[k]
            if t.exact:
                hits = [(s, 1.0) for s in starts if s >= 0 and tuple(words[s:s + len(t.words)]) == t.words]
            else:
                hits = self._sentences(t, k, starts, words, places, base, own, until, found)
            for s, coverage in hits:
                if own <= base + s < until:
                    found.matches.append(Match(k, base + max(0, s), coverage))
                    found.best = max(found.best, coverage)

    def _sentences(self, t: Template, k: int, starts, words, places, base: int, own: float, until: float, found: Found):
        """The starts whose coverage is the highest within the drift, high enough, and whose key phrases stand."""
        covered = {s: self._coverage(t, k, places, s) for s in starts}
        for s, coverage in covered.items():
            if not own <= base + s < until:
                continue
            found.best = max(found.best, coverage)
            near = [(-covered[o], o) for o in range(s - DRIFT, s + DRIFT + 1) if o in covered]
            if coverage >= t.least and min(near)[1] == s and all(
                    _stands(key, words, places, max(0, s - DRIFT), s + len(t.words) + DRIFT) for key in t.keys):
                yield s, coverage

    def _coverage(self, t: Template, k: int, places, start: int) -> float:
        """The share of the template's IDF whose words stand at their places, within the drift."""
        mass = 0.0
        for p, word in enumerate(t.words):
            at = places.get(word)
            if at and bisect_left(at, start + p - DRIFT) < bisect_right(at, start + p + DRIFT):
                mass += self.idf[word]
        return min(1.0, mass / self.weight[k])


def _stands(key, words, places, lo: int, hi: int) -> bool:
    """Whether the key phrase stands word for word within words[lo:hi]."""
    at = places.get(key[0], ())
    return any(tuple(words[i:i + len(key)]) == key for i in at[bisect_left(at, lo):bisect_right(at, hi - len(key))])


def _slices(text: bytes, size: int):
    """Words of consecutive slices, none cut through a word, and whether it is the last."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end > at and WORD.match(text[end - 1:end].lower()):
            end -= 1
        if end == at:  # one word longer than a slice
            end = at + size
            while end < len(text) and WORD.match(text[end:end + 1].lower()):
                end += 1
        yield words_of(text[at:end]), False
        at = end
    yield words_of(text[at:]), True


# ---------------------------------------------------------------- operator

def document_frequencies(docs: DataFrame, vocabulary: frozenset, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of documents that hold each word of the vocabulary (bounded by it)."""
    def count(batches):
        total, documents = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                documents += 1
                if text.is_valid:
                    seen = set()
                    for words, _ in _slices(text.as_py(), SLICE_BYTES):
                        seen |= vocabulary.intersection(words)
                    total.update(seen)
        total[b""] = documents
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])

    rows = (docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
                .mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {bytes(w): n for w, n in rows}
    return found.pop(b"", 0), found


SCAN_SCHEMA = "id long, n_words long, score double, matches array<struct<label:string,exact:boolean,start:long,length:int,coverage:double>>"
_ARROW = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()),
                    ("matches", pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()),
                                                    ("length", pa.int32()), ("coverage", pa.float64())])))])


def scan(docs: DataFrame, known: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, score and its matches (label, exact, start, length, coverage) by position.

    The score is the highest coverage of any candidate, matched or not.
    """
    bound_batches(docs.sparkSession)
    known = templates() if known is None else known
    vocabulary = frozenset(w for t in known for w in t.words)
    index = Index(known, *document_frequencies(docs, vocabulary, text_col))

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for key, text in zip(ids, batch.column(1)):
                found = index.scan(text.as_py() if text.is_valid else b"")
                out.append({"id": key, "n_words": found.n_words, "score": found.best,
                            "matches": [{"label": known[m.template].label, "exact": known[m.template].exact, "start": m.start,
                                         "length": len(known[m.template].words), "coverage": m.coverage}
                                        for m in found.matches]})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
                .mapInArrow(run, SCAN_SCHEMA))
