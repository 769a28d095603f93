"""Sentence boundaries from unsupervised corpus statistics.

Which words with a full stop are abbreviations is learnt from counts over all
texts, after the published method of Kiss and Strunk (2006): an abbreviation is a
word whose stop hardly ever lacks, that is short, and that may hold stops inside.
Its score is the log-likelihood ratio of "the stop belongs to the word" (0.99)
against chance, times exp(-letters), times inner stops + 1, times letters to the
power of -(occurrences without the stop); from ``ABBREVIATION`` on it is one.

Two more tables hold words that open sentences significantly often, and pairs of
a stopped word and its follower that are collocations (log-likelihood ratios of
Dunning).  A stop behind an abbreviation, an initial or a number ends a sentence
only if the next word is capitalised, the pair is no collocation, and the next
word is a frequent opener or, except after an initial, is known in lower case and
never capitalised within sentences.  Any other stop ends one, and so do ! ? and
an ellipsis unless the next word begins in lower case.

Words are counted in the tasks, text by text, and leave them as partial counts;
patterns are asked of different words only.  Of the texts themselves only the
words with a stop or mark become rows, which are joined to the tables.

Defined cases: null, empty and blank texts have no sentence; a text's end closes
its last one; repeated keys are told apart by their text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import compress
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import work_path
from .folds import columnar, list_of

#: Marks that may close or open a quotation around a word (fixed values).
CLOSING = r"[\"'”’»)\]}]+$"
OPENING = r"^[\"'“‘«(\[{¿¡]+"
NUMBER = "#"
ABBREVIATION, OPENER, COLLOCATION = 0.3, 30.0, 7.88


#: White space as Unicode has it; str.split() also splits at the separators 1C to 1F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CLOSERS, ENDERS = "\"'”’»)]}", ".!?…"
_WORD, _SEPARATORS = re.compile(f"[^{SPACE}]+"), re.compile("[\x1c-\x1f]")
_END = re.compile(rf"[.!?…][\"'”’»)\]}}]*(?=[{SPACE}])")
#: Different words and pairs that a task holds before it passes their counts on.
HELD = 200_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _SEPARATORS.search(text) else text.split()


class Ends(dict):
    """Whether a word ends with a stop or mark, found once a word."""

    def __missing__(self, word: str) -> bool:
        if len(self) > HELD:
            self.clear()
        self[word] = out = word.rstrip(CLOSERS)[-1:] in {*ENDERS}
        return out


def word_counts(df: DataFrame, text: str, pairs: bool) -> DataFrame:
    """word, next, opens (the word before ends a sentence, or there is none), c: partial counts.

    Rows without opens, if pairs is asked, count words that end with a stop or
    mark by their followers; the others count all words, next is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, seen, first, met = Ends(), Counter(), Counter(), Counter()

        def rows():
            every = [(w, None, True, c) for w, c in first.items()]
            every += [(w, None, False, c - first[w]) for w, c in seen.items() if c > first[w]]
            every += [(w, a, None, c) for (w, a), c in met.items()]
            for at in range(0, len(every), 10_000):
                columns = zip(*every[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["word", "next", "opens", "c"])
            for held in (seen, first, met):
                held.clear()

        for b in batches:
            texts = b.column(0)
            for i in range(b.num_rows):
                words = words_of(texts[i].as_py() or "")
                if not words:
                    continue
                closed, after = [ends[w] for w in words], words[1:]
                seen.update(words)
                first.update([words[0], *compress(after, closed)])
                if pairs:
                    met.update(compress(zip(words, after), closed))
                if len(seen) + len(met) > HELD:
                    yield from rows()
        yield from rows()

    return df.select(F.col(text).cast("string")).mapInArrow(run, "word string, next string, opens boolean, c long")


@columnar("array<struct<pos:int,word:string,next:string>>")
def ending_words(texts: pa.Array) -> pa.Array:
    """Words of a text that end with a stop or mark and have a follower: the place behind them, word, follower."""
    sizes, places, words, after = [], [], [], []
    for i in range(len(texts)):
        text, n = texts[i].as_py() or "", len(places)
        for m in _END.finditer(text):
            e = s = m.end()
            follower = _WORD.search(text, e)
            if follower is None:
                break
            while s and text[s - 1] not in SPACE:
                s -= 1
            places.append(e)
            words.append(text[s:e])
            after.append(follower[0])
        sizes.append(len(places) - n)
    return list_of(sizes, {"pos": pa.array(places, pa.int32()), "word": pa.array(words, pa.string()), "next": pa.array(after, pa.string())})


@columnar("array<string>")
def cut_at(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """Parts of a text between places (ascending, or null), white space around them off; empty ones go."""
    out = []
    for i in range(len(texts)):
        text, places = texts[i].as_py() or "", cuts[i].as_py() or []
        parts = (text[s:e].strip(SPACE) for s, e in zip([0, *places], [*places, len(text)]))
        out.append([x for x in parts if x])
    return pa.array(out, pa.list_(pa.string()))


def word_type(word: Column) -> Column:
    """Lower-cased word without marks around it and its last stop; numbers are one type."""
    core = F.regexp_replace(F.regexp_replace(word, CLOSING, ""), OPENING, "")
    bare = F.lower(F.regexp_replace(core, r"\.$", ""))
    return F.when(bare.rlike(r"^[0-9][0-9.,]*$"), NUMBER).otherwise(bare)


def _core(c: Column) -> Column:
    return F.regexp_replace(c, CLOSING, "")


def _first(c: Column, kind: str) -> Column:
    return F.regexp_replace(c, OPENING, "").rlike(rf"^\p{{{kind}}}")


def described(words: DataFrame) -> DataFrame:
    """Adds type, marked (closed by ! ? or an ellipsis), stopped, upper, lower (first letter) of word."""
    w = F.col("word")
    out = words.withColumns({"type": word_type(w), "marked": _core(w).rlike(r"([!?…]|\.\.)$"), "upper": _first(w, "Lu"), "lower": _first(w, "Ll")})
    return out.withColumn("stopped", _core(w).endswith(".") & ~F.col("marked") & (F.length("type") > 0))


def type_counts(seen: DataFrame) -> DataFrame:
    """type, n, n_stop (with a stop), n_lower, n_upper (capitalised within a sentence), of word_counts."""
    # Words are described once each, not at every occurrence.
    words = described(seen.filter("opens is not null").groupBy("word", "opens").agg(F.sum("c").alias("c"))).filter("length(type) > 0")
    count = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    return words.groupBy("type").agg(F.sum("c").alias("n"), count(F.col("stopped")).alias("n_stop"), count(F.col("lower")).alias("n_lower"), count(F.col("upper") & ~F.col("opens")).alias("n_upper"))


def endings(seen: DataFrame, *keep: str) -> DataFrame:
    """Words that have a stop or a mark, and a follower (next): described, with next_type, next_upper, next_lower."""
    t = described(seen).filter(F.col("stopped") | F.col("marked"))
    a = F.col("next")
    return t.select(*keep, "type", "stopped", "marked", word_type(a).alias("next_type"), _first(a, "Lu").alias("next_upper"), _first(a, "Ll").alias("next_lower"))


def abbreviation_score(n_all: int, n_stops: int) -> Column:
    """Of a row of type_counts, in a corpus of n_all words of which n_stops have a stop."""
    p = min(max(n_stops / max(n_all, 1), 1e-10), 1 - 1e-10)
    with_, without = F.col("n_stop"), F.col("n") - F.col("n_stop")
    ratio = 2 * (with_ * (F.log(F.lit(0.99)) - F.log(F.lit(p))) + without * (F.log(F.lit(0.01)) - F.log(F.lit(1 - p))))
    inner = F.length(F.regexp_replace("type", r"[^.]", ""))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -without.cast("double"))
    return F.when((with_ > 0) & F.col("type").rlike(r"^\p{L}"), score).otherwise(0.0)


def dunning(k: Column, c1: Column, c2: Column, n: Column) -> Column:
    """Log-likelihood ratio of the second event depending on the first: k joint, c1 and c2 single counts of n."""

    def likely(hits: Column, trials: Column, p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
        return hits * F.log(q) + (trials - hits) * F.log(1 - q)

    rest = F.greatest(n - c1, F.lit(1))
    p, p1, p2 = c2 / n, k / c1, (c2 - k) / rest
    return -2 * (likely(k, c1, p) + likely(c2 - k, rest, p) - likely(k, c1, p1) - likely(c2 - k, rest, p2))


@dataclass
class Statistics:
    """types: type, n, n_stop, n_lower, n_upper, score.  openers: type, ratio.  pairs: type, next_type, ratio."""

    types: DataFrame
    openers: DataFrame
    pairs: DataFrame


def written(frame: DataFrame, name: str) -> DataFrame:
    path = work_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def scored_types(seen: DataFrame) -> tuple[DataFrame, int]:
    """type_counts with scores as abbreviations, and the number of all words."""
    counts = written(type_counts(seen), "sentence-counts")
    n_all, n_stops = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_stop"), F.lit(0))).first()
    return counts.withColumn("score", abbreviation_score(n_all, n_stops)), n_all


def train_types(df: DataFrame, text: str) -> DataFrame:
    """Statistics' types alone: no follower is counted."""
    return scored_types(word_counts(df, text, pairs=False))[0]


def train(df: DataFrame, key: list[str], text: str) -> Statistics:
    """Statistics of all texts, which are read once."""
    seen = written(word_counts(df, text, pairs=True), "sentence-words")
    types, n_all = scored_types(seen)
    counts = types.drop("score")
    # One row for each stopped or closed word and its follower.
    met = seen.filter("opens is null").groupBy("word", "next").agg(F.sum("c").alias("c"))
    ends = endings(met, "c").groupBy("type", "next_type", "stopped").agg(F.sum("c").alias("k"))
    short = types.filter(F.col("score") >= ABBREVIATION).select("type", F.lit(True).alias("short"))
    ends = ends.join(short, "type", "left").withColumn("unsure", F.col("stopped") & (F.coalesce("short", F.lit(False)) | (F.col("type") == NUMBER) | (F.length("type") == 1)))
    ends = written(ends, "sentence-ends")
    sure = ends.filter(~F.col("unsure") & (F.length("next_type") > 0)).groupBy("next_type").agg(F.sum("k").alias("k"))
    total = F.lit(sure.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0])
    n = F.lit(n_all)
    met = sure.join(counts.select(F.col("type").alias("next_type"), F.col("n").alias("c2")), "next_type")
    met = met.withColumn("ratio", dunning(F.col("k"), total, F.col("c2"), n))
    openers = met.filter((F.col("ratio") > OPENER) & (F.col("k") * n > F.col("c2") * total)).select(F.col("next_type").alias("type"), "ratio")
    both = ends.filter(F.col("unsure") & (F.col("k") > 1) & (F.length("next_type") > 0))
    both = both.join(counts.select("type", F.col("n_stop").alias("c1")), "type").join(counts.select(F.col("type").alias("next_type"), F.col("n").alias("c2")), "next_type")
    both = both.withColumn("ratio", dunning(F.col("k"), F.col("c1"), F.col("c2"), n))
    both = both.filter((F.col("ratio") > COLLOCATION) & (F.col("k") * n > F.col("c1") * F.col("c2")))
    pairs = both.join(openers.select(F.col("type").alias("next_type")), "next_type", "left_anti").select("type", "next_type", "ratio")
    return Statistics(types, written(openers, "sentence-openers"), written(pairs, "sentence-pairs"))


def boundaries(df: DataFrame, key: list[str], text: str, model: Statistics) -> DataFrame:
    """key, pos (the place behind it) of every word that ends a sentence inside its text."""
    t = endings(df.select(*key, F.explode(ending_words(F.col(text).cast("string"))).alias("t")).select(*key, "t.*"), *key, "pos")
    no = F.lit(False)
    short = model.types.filter(F.col("score") >= ABBREVIATION).select("type", F.lit(True).alias("short"))
    ahead = model.types.select(F.col("type").alias("next_type"), ((F.col("n_lower") > 0) & (F.col("n_upper") == 0)).alias("seen_low"))
    opener = model.openers.select(F.col("type").alias("next_type"), F.lit(True).alias("opener"))
    pair = model.pairs.select("type", "next_type", F.lit(True).alias("pair"))
    t = t.join(short, "type", "left").join(ahead, "next_type", "left").join(opener, "next_type", "left").join(pair, ["type", "next_type"], "left")
    initial = (F.length("type") == 1) & (F.col("type") != NUMBER)
    unsure = F.coalesce("short", no) | (F.col("type") == NUMBER) | initial
    known = F.coalesce("opener", no) | (F.coalesce("seen_low", no) & ~initial)
    ends = F.when(F.col("marked"), ~F.col("next_lower")).when(unsure, F.col("next_upper") & ~F.coalesce("pair", no) & known).otherwise(True)
    return t.filter(ends).select(*key, "pos")


def split(df: DataFrame, key: list[str], text: str, model: Statistics) -> DataFrame:
    """key, sentences (array): each text cut at its boundaries, white space around sentences off."""
    mark = F.xxhash64(F.col(text))
    keyed = df.select(*key, F.col(text).alias("__text"), mark.alias("__mark")).dropDuplicates([*key, "__mark"])
    names = [*key, "__mark"]
    cuts = boundaries(keyed, names, "__text", model).groupBy(*names).agg(F.array_sort(F.collect_list("pos")).alias("__cuts"))
    cuts = cuts.select(*[F.col(n).alias(f"__key{i}") for i, n in enumerate(names)], "__cuts")
    same = [F.col(n).eqNullSafe(F.col(f"__key{i}")) for i, n in enumerate(names)]
    both = keyed.join(cuts, reduce(and_, same), "left")
    return both.select(*key, cut_at(F.col("__text").cast("string"), F.col("__cuts")).alias("sentences"))
