"""Phrases whose words stand together more often than chance, by best-first branch and bound.

A phrase's score is the least, over the places where it can be cut, of scale * a * n / (l * r): a, l and r
count the phrase and its two parts, n all words of the language. As r >= a, no phrase that
begins with a word of frequency f scores more than scale * n / f: the count of the prefix bounds all
that grows from it. So each language's words are expanded from the rarest on, in waves; what a
wave finds is counted, scored and freed of phrases that a longer one covers. With `top` survivors known, their
last score names the frequency up to which words can still matter; the search has ended when the
bound of all words left is below it.

A scan emits the n-grams of a wave, each counted in its task and then by Spark over exact
strings. Which n-grams those are is told to the tasks by bitmaps of fixed size: what a bitmap
lets through by chance is counted too and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, drop, text_bytes
from tidemark.llm.words import _GRAM, Words, mix

#: Bits of a bitmap that tells tasks which n-grams to emit: 4 MB, whatever the corpus.
FILTER_BITS = 25
#: Bytes of text that are worked on at a time; longer texts are parted between pieces.
STRETCH = 1 << 22
#: Words of a language that the first wave expands, for each phrase that is wanted.
FIRST_WAVE, GROWTH = 4, 4

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 10
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("h", pa.int64()), ("f", pa.int64())])
_COUNTS = "lang string, phrase string, k int, h long, f long"


class Stretch:
    """The words of a stretch of texts, lower-cased, with the piece each belongs to and the keys of their n-grams."""

    def __init__(self, text: np.ndarray, offs: np.ndarray, langs: list[str]):
        words = Words(text, offs)
        self.langs, self.n, self.of = langs, len(words), words.texts()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
        if not self.n:
            return
        self.salt = salts[self.of]
        marks = np.cumsum(text == 10)[words.starts]
        new = np.ones(self.n, bool)
        new[1:] = (marks[1:] != marks[:-1]) | (self.of[1:] != self.of[:-1])
        self.piece = np.cumsum(new)
        self.hashes = words.hashes(False)
        lens = words.ends - words.starts
        self.ends = np.cumsum(lens + 1) - 1  # of each word in the text with one space after each word
        self.starts = self.ends - lens
        self.letters = np.full(int(self.ends[-1]) + 1, 32, np.uint8)
        self.letters[np.arange(int(lens.sum())) + np.repeat(np.arange(self.n), lens)] = text[words.solid]

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """Key of the k words from each of these positions, which must be in one piece."""
        total = self.hashes[at] * _GRAM[0]
        for j in range(1, k):
            total += self.hashes[at + j] * _GRAM[j]
        return mix(mix(total) ^ self.salt[at])

    def word_keys(self) -> np.ndarray:
        return self.keys(1, np.arange(self.n))

    def starts_of(self, k: int) -> np.ndarray:
        """Whether the k words from each position are in one piece."""
        return self.piece[: max(self.n - k + 1, 0)] == self.piece[k - 1 :]

    def counted(self, k: int, at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """The k-grams at these positions, whose keys are given, each once with its count.

        Equal 64-bit keys count as one n-gram here, within one stretch; across stretches strings are compared.
        """
        keys, first, n = np.unique(keys, return_index=True, return_counts=True)
        at = at[first]
        lens = self.ends[at + k - 1] - self.starts[at]
        offs = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lens, out=offs[1:])
        data = self.letters[np.repeat(self.starts[at] - offs[:-1], lens) + np.arange(offs[-1])]
        phrase = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])
        lang = pa.DictionaryArray.from_arrays(pa.array(self.of[at].astype(np.int32)), pa.array(self.langs, pa.string())).dictionary_decode()
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(at), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=_SCHEMA)


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Stretch]:
    """The texts of batches (lang, text), parted only between texts or pieces, which no phrase crosses."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).to_pylist()
        raw, offs = text_bytes(batch.column(1))
        raw = _PLAIN[raw]
        ends = np.union1d(np.flatnonzero(raw == 10) + 1, offs[1:])
        at = 0
        while at < len(raw):
            i = int(np.searchsorted(ends, at + most, "right")) - 1
            to = int(ends[i]) if i >= 0 and ends[i] > at else int(ends[i + 1])
            a, b = int(np.searchsorted(offs, at, "right")) - 1, int(np.searchsorted(offs, to, "left"))
            part = Stretch(raw[at:to], np.clip(offs[a : b + 1], at, to) - at, langs[a:b])
            if part.n:
                yield part
            at = to


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def key_filter(rows: DataFrame) -> np.ndarray:
    """Bitmap of the keys `h` of rows: put together by Spark in fixed-size parts."""
    place = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    parts = rows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for b, m in parts.collect():
        bits[(b - 1) * len(m) : b * len(m)] = np.frombuffer(bytes(m), np.uint8)
    return bits


def count(texts: DataFrame, emit: Callable[[Stretch], Iterator[tuple[int, np.ndarray, np.ndarray]]], least: int) -> DataFrame:
    """(lang, phrase, k, h, f) of the n-grams that `emit` gives for a stretch as (k, positions, keys), met at least `least` times."""

    most = STRETCH

    def run(batches):
        for part in stretches(batches, most):
            for k, at, keys in emit(part):
                if len(at):
                    yield part.counted(k, at, keys)

    met = texts.mapInArrow(run, _COUNTS).groupBy("lang", "phrase", "k").agg(F.min("h").alias("h"), F.sum("f").alias("f"))
    return met.where(F.col("f") >= least)


def _words(part: Stretch):
    yield 1, np.arange(part.n), part.word_keys()


def _pairs(frontier, frequent):
    """Pairs of frequent words, the first one in the frontier."""

    def emit(part: Stretch):
        keys, ok = part.word_keys(), part.starts_of(2)
        at = np.flatnonzero(ok & in_filter(frontier.value, keys[: len(ok)]))
        at = at[in_filter(frequent.value, keys[at + 1])]
        yield 2, at, part.keys(2, at)

    return emit


def _longer(pairs, frequent, longest: int):
    """All longer phrases of frequent words that grow from the pairs."""

    def emit(part: Stretch):
        word = in_filter(frequent.value, part.word_keys())
        ok = part.starts_of(2)
        at = np.flatnonzero(ok & word[: len(ok)] & word[1 : len(ok) + 1])
        at = at[in_filter(pairs.value, part.keys(2, at))]
        for k in range(3, longest + 1):
            at = at[at + k <= part.n]
            at = at[(part.piece[at] == part.piece[at + k - 1]) & word[at + k - 1]]
            yield k, at, part.keys(k, at)

    return emit


def _around(wanted, found, frequent, longest: int):
    """The wanted phrases, and the found ones with the word before them; all are of frequent words."""

    def emit(part: Stretch):
        word = in_filter(frequent.value, part.word_keys())
        shorter = np.zeros(part.n + 1, bool)  # where a found phrase of a word less starts
        at = np.flatnonzero(word)
        for k in range(2, longest + 1):
            at = at[at + k <= part.n]
            at = at[(part.piece[at] == part.piece[at + k - 1]) & word[at + k - 1]]
            keys = part.keys(k, at)
            asked = shorter[at + 1]
            if k < longest:
                asked = asked | in_filter(wanted.value, keys)
            yield k, at[asked], keys[asked]
            shorter = np.zeros(part.n + 1, bool)
            shorter[at[in_filter(found.value, keys)]] = True

    return emit


def _part(start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(known: DataFrame, totals: DataFrame, scale: int) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of the phrases in `known` that are `own`: by the cut with the lowest score, the first of equals.

    Arithmetic is on DECIMAL(38), exact while scale * n * n is below 10^38.
    """
    own = known.where("own and k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda name, value: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    top = (_exact("a") * _exact("n")).cast("decimal(38,0)") * F.lit(scale).cast("decimal(10,0)")
    score = F.expr("t div b")
    both = both.withColumn("t", top.cast("decimal(38,0)")).withColumn("b", (_exact("l") * _exact("r")).cast("decimal(38,0)")).withColumn("score", score.cast("long"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("s"))
    return best.select("lang", "phrase", "s.k", "s.a", "s.l", "s.r", "s.n", "s.score")


def surviving(candidates: DataFrame, known: DataFrame, cover: int) -> DataFrame:
    """Candidates that no longer phrase covers: none with a word more, at either end, is as frequent (cover: in hundredths).

    A longer phrase yet is no more frequent than the one with a word more inside it, so these decide.
    """
    longer = known.where("k >= 3").select("lang", F.col("f").alias("more"), F.split("phrase", " ").alias("w"), "k")
    ends = longer.select("lang", "more", F.explode(F.array(_part(F.lit(1), F.col("k") - 1), _part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    most = ends.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more") * 100 < F.col("a") * cover)).drop("more")


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, scale: int = 1000, cover: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first `top` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), parted at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words at spaces
    and tabs. Candidates are phrases of 2 to `longest` words in one piece that occur `least` times
    or more; those with a one-word longer phrase of cover/100 of their count go. Order: score and a descending, phrase
    ascending (bytes). A null language is `und`, a null text empty; repeated rows count each; ties are
    settled by the phrase, so none is random; no rows give no rows. A language with fewer phrases
    returns all of them. The driver holds the bitmaps only.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = spark.sparkContext.broadcast

    def table(rows: DataFrame):
        return share(key_filter(rows))

    vocabulary = cut(count(texts, _words, 1))
    totals = cut(vocabulary.groupBy("lang").agg(F.sum("f").alias("n")))
    words = cut(vocabulary.where(F.col("f") >= least))
    drop(vocabulary)
    frequent = table(words)
    # how many words are no more frequent than f; a language's frequencies are few
    ladder = cut(words.groupBy("lang", "f").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy("lang").orderBy("f"))))
    known = words.withColumn("own", F.lit(False))
    # words of frequency lo < f <= hi are the wave; of all up to hi the phrases are known
    goal = ladder.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= FIRST_WAVE * top, F.col("f"))), F.max("f")).alias("hi"), F.lit(FIRST_WAVE * top).cast("long").alias("goal"))
    limits = cut(goal.withColumn("lo", F.lit(0).cast("long")))
    while True:
        wave = words.join(limits, "lang").where("f > lo and f <= hi").select("lang", "phrase", "h")
        # languages that are settled aren't read again
        some = texts.join(limits.where("lo < hi").select("lang"), "lang", "left_semi")
        pairs = cut(count(some, _pairs(table(wave), frequent), least))
        more = cut(count(some, _longer(table(pairs), frequent, longest), least)) if longest > 2 else pairs.limit(0)
        first = (F.col("lang") == F.col("_l")) & (F.substring_index("phrase", " ", 1) == F.col("_w"))
        grown = pairs.unionByName(more).join(wave.select(F.col("lang").alias("_l"), F.col("phrase").alias("_w")), first, "left_semi")
        known = _one_of_each(known.unionByName(grown.withColumn("own", F.lit(True))))
        # what else the phrases of languages with words left depend on: their endings, and what stands before them
        left = ladder.join(limits, "lang").groupBy("lang").agg(F.min(F.when(F.col("f") > F.col("hi"), F.col("f"))).alias("next"))
        left = cut(left)
        open_ = left.where("next is not null").select("lang")
        found = known.where("own and k >= 2").join(open_, "lang", "left_semi")
        if longest > 2 and not open_.isEmpty():
            ends = found.select("lang", "k", F.split("phrase", " ").alias("w")).where("k >= 3").withColumn("from", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
            ends = ends.select("lang", _part(F.col("from"), F.col("k") - F.col("from") + 1).alias("phrase")).distinct().join(known.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
            around = count(texts.join(open_, "lang", "left_semi"), _around(table(_keyed(ends)), table(found.where(F.col("k") < longest)), frequent, longest), least)
            known = _one_of_each(known.unionByName(around.withColumn("own", F.lit(False))))
        alive = cut(surviving(scored(known, totals, scale), known, cover))
        steps = alive.groupBy("lang", "score").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy("lang").orderBy(F.desc("score"))))
        last = steps.where(F.col("upto") >= top).groupBy("lang").agg(F.max("score").alias("last"))
        state = limits.join(left, "lang").join(totals, "lang").join(last, "lang", "left").where("next is not null")
        bound = (_exact("n") * F.lit(scale).cast("decimal(10,0)")).cast("decimal(38,0)")
        state = state.withColumn("t", bound).withColumn("b", _exact("next").cast("decimal(38,0)")).withColumn("bound", F.expr("t div b"))
        state = state.where("last is null or last <= bound").withColumn("b", _exact("last").cast("decimal(38,0)")).withColumn("reach", F.expr("t div nullif(b, 0)")).withColumn("wider", F.col("goal") * GROWTH)
        wider = ladder.join(state.select("lang", "wider"), "lang").groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("wider"), F.col("f"))), F.max("f")).alias("to"))
        ahead = cut(state.join(wider, "lang").select("lang", F.col("hi").alias("lo"), F.coalesce("reach", F.greatest("to", "next")).alias("hi"), F.col("wider").alias("goal")))
        if ahead.isEmpty():
            break
        done = limits.join(ahead.select("lang"), "lang", "left_anti").select("lang", F.col("hi").alias("lo"), "hi", "goal")
        limits = cut(ahead.unionByName(done))
    place = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = alive.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _one_of_each(known: DataFrame) -> DataFrame:
    return cut(known.groupBy("lang", "phrase", "k").agg(F.max("h").alias("h"), F.max("f").alias("f"), F.max("own").alias("own")))


def _keyed(phrases: DataFrame) -> DataFrame:
    """(h) of (lang, phrase), as the tasks key n-grams."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(phrase.encode(), np.uint8)
                part = Stretch(raw, np.array([0, len(raw)]), [lang])
                out.append(int(part.keys(part.n, np.zeros(1, np.int64)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")
