"""License scans: exact base phrases and fuzzy search for short notices.

Texts become words (A-Z lower-cased, split at ASCII punctuation), joined by
blanks.  A notice with at most e errors is cut into e + 1 pieces; by the
pigeonhole principle one of them stands unchanged in every occurrence.  An
Aho-Corasick automaton over all pieces finds these seeds in one pass; around
each the regex library verifies the whole notice with at most e edits.

Defined cases: null and empty texts have no words and no labels; repeated rows
keep their rows; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE

#: Phrases whose places count exactly, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening words of well-known public notices, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "unauthorized copying of this file via any medium is strictly prohibited": "proprietary",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int


def notices(table: dict[str, str] | None = None, chars_an_error: int = 12, most: int = 5) -> list[Notice]:
    """An error for every chars_an_error characters, `most` at most."""
    return [Notice(t, label, min(most, len(t) // chars_an_error)) for t, label in (table or NOTICES).items()]


class Searcher:
    def __init__(self, wanted: list[Notice], base: dict[str, str] | None = None):
        import ahocorasick
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in (BASE if base is None else base).items()]
        self.wanted = wanted
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text)}){{e<={n.errors}}}", regex.V0) for n in wanted]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(wanted):
            cuts = [round(i * len(n.text) / (n.errors + 1)) for i in range(n.errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(n.text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def fuzzy(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) of verified matches, per notice leftmost and not overlapping."""
        tried: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(joined):
            for k, offset in uses:
                n = self.wanted[k]
                at = last - size + 1 - offset
                span = (max(0, at - n.errors), min(len(joined), at + len(n.text) + 2 * n.errors))
                spans = tried.setdefault(k, [])
                if spans and span[0] <= spans[-1][1]:
                    spans[-1] = (min(span[0], spans[-1][0]), max(span[1], spans[-1][1]))
                else:
                    spans.append(span)
        out = []
        for k, spans in tried.items():
            for a, b in spans:
                for m in self.patterns[k].finditer(joined, a, b):
                    if m.end() > m.start():
                        out.append((m.start(), m.end(), k, sum(m.fuzzy_counts)))
        return sorted(out)

    def scan(self, text: bytes | None) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, spans."""
        words = text.translate(WORD_TABLE).split() if text else []
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        joined = b" ".join(words)
        data = b" " + joined + b" "
        places, labels = [], set()
        for phrase, label in self.base:
            at, seen, counted = data.find(phrase), 0, 0
            while at >= 0:
                counted, seen = counted + data.count(b" ", seen, at), at
                places.append(counted)
                labels.add(label)
                at = data.find(phrase, at + 1)
        found = self.fuzzy(joined.decode("latin-1"))
        # latin-1 keeps bytes and characters one to one; notices are ASCII
        more = {self.wanted[k].label for _, _, k, _ in found}
        score = 1.0 if places else max((1 - e / len(self.wanted[k].text) for _, _, k, e in found), default=0.0)
        # Words before a place: one search each, over the blanks' places.
        blank = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if found else ()
        word = lambda place: int(np.searchsorted(blank, place))
        spans = [{"first": word(s), "last": word(e - 1), "label": self.wanted[k].label, "errors": err} for s, e, k, err in found]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), score, spans


COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<first:int,last:int,label:string,errors:int>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: list[Notice] | None = None) -> DataFrame:
    """One row per input row; notices holds the fuzzy matches with word spans and edits."""
    from pyspark.sql.types import StructType

    wanted = wanted or notices()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    fields = StructType.fromDDL(COLUMNS)
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("errors", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(wanted)
        for b in batches:
            col = b.column(1)
            got = list(zip(*(search.scan(col[i].as_py()) for i in range(b.num_rows)))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, t) for c, t in zip(got, types)], ["__id"] + fields.names)

    return rows.mapInArrow(run, StructType([rows.schema["__id"]] + fields.fields)).withColumnRenamed("__id", id_col)
