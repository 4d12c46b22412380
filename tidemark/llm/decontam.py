"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages, seen as TF-IDF vectors over the words of the benchmark.
A word's weight is its inverse frequency among the items: document frequencies of the corpus
would fall with the very contamination that is looked for, down to no weight at all for an item
that is copied often. Words outside the benchmark have no place in the space, as usual for
folding in, so what stands beside a copied item doesn't lower its cosine.

1. Items form groups of about GROUP_ITEMS. Each has a latent space of RANK dimensions: a
   distributed randomised SVD of all passages of all its items. Every pass of the range finder
   adds up A'(AQ) by Spark partition. Documents are folded in, none is fitted on, so a document's
   matches depend on nothing but its text and the benchmark.
2. Every passage of every document is folded in; those with a latent cosine of LATENT_COSINE or
   more with an item's passage are candidates, if their full cosine is LEAST_COSINE or more.
3. A candidate is a match if the longest common subsequence of the item and the words around the
   passage covers VERBATIM of the item, or (paraphrases) PARAPHRASE of it, as much of its own
   words (those in few items), and ANSWER of its last sentence; or if RUN_WORDS words of the
   item stand there in a row. Items under SHORT_ITEM words must stand there without a gap.

One scan of the corpus searches SCAN_GROUPS groups at once; larger benchmarks take several scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.runtime import chunks, text_bytes
from tidemark.llm.words import Words, grams

#: Passages are 4 cells of words; every second cell starts one.
CELL_WORDS, PASSAGE_CELLS, STEP_CELLS = 8, 4, 2
PASSAGE, STEP = CELL_WORDS * PASSAGE_CELLS, CELL_WORDS * STEP_CELLS
#: Dimensions of a space, columns more that the range finder draws, and its passes.
RANK, OVERSAMPLE, PASSES = 128, 8, 2
#: Tasks that a space is fitted in, and bytes of text (about) that a task takes at once.
FIT_TASKS, FIT_CHUNK = 8, 1 << 17
#: Items (about) of one space, spaces of one scan, and bytes (about) of the items of one scan.
GROUP_ITEMS, SCAN_GROUPS, SCAN_BYTES = 512, 4, 1 << 23
LATENT_COSINE, LEAST_COSINE = 0.5, 0.4
#: In a passage full of other items' words, a short one of n words has a cosine about (n / PASSAGE) ** 0.5;
#: this part of it is enough if it is less than LATENT_COSINE. LEAST_COSINE shrinks alike.
SHORT_PART = 0.8
#: Parts of an item's words in common order that are enough alone, or with the answer.
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.5, 0.6
RUN_WORDS, SHORT_ITEM = 13, 8
#: An item's own words stand in no more than this part of the items (or two).
MOST_COMMON = 0.05
#: Table that tells most words outside a vocabulary at once, and candidates compared at a time.
_TABLE, _PAIRS = 1 << 18, 1 << 17


@dataclass
class Vocabulary:
    """Words of a group of items; hashes are 64 bits, sorted."""

    words: np.ndarray
    weight: np.ndarray
    common: np.ndarray  # mask: in more than MOST_COMMON of the items

    def __post_init__(self):
        self.near = np.zeros(_TABLE, bool)
        self.near[(self.words & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def codes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words in the vocabulary, their codes)."""
        at = np.flatnonzero(self.near[(h & np.uint64(_TABLE - 1)).astype(np.int64)])
        if not len(self.words):
            return at[:0], at[:0]
        code = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        ok = self.words[code] == h[at]
        return at[ok], code[ok]


@dataclass
class Space:
    """A group of items and its latent space."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    own: list[np.ndarray]  # mask of `words`: those in few items
    runs: list[np.ndarray]  # hashes of RUN_WORDS words in a row
    vocabulary: Vocabulary
    item: np.ndarray  # item number of each passage
    entry: np.ndarray  # passage * words + code of each word of a passage, sorted
    value: np.ndarray  # its part of the passage's unit vector times the weight
    basis: np.ndarray  # words x RANK, rows times the weight
    latent: np.ndarray  # passages x RANK, unit vectors
    least: np.ndarray  # latent cosine that a candidate has at least, by passage
    member: np.ndarray  # item * words + code of each word of an item, sorted
    need: np.ndarray  # different words of the item that any match holds


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(pc.utf8_lower(text).as_py().encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), marks_part=True).hashes(lower=False)


def _answer(text: str) -> str:
    """The last sentence that has a word."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", p)]
    return parts[-1] if parts else text


def _starts(n: int) -> range:
    """First words of the passages of a text of n words: the last one is reached, none is inside another."""
    return range(0, max(1, n - STEP), STEP) if n else range(0)


def vocabulary(words: list[np.ndarray]) -> Vocabulary:
    each = [np.unique(w) for w in words if len(w)] or [np.zeros(0, np.uint64)]
    word, n = np.unique(np.concatenate(each), return_counts=True)
    return Vocabulary(word, np.log((1 + len(words)) / n).astype(np.float32), n > max(MOST_COMMON * len(words), 2))


def unit_passages(words: list[np.ndarray], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, texts): (passage, code) and value of the entries of the passages' unit vectors, and each passage's text."""
    size = len(known.words)
    count = np.array([len(_starts(len(w))) for w in words], np.int64)
    text = np.repeat(np.arange(len(words)), count)
    if not len(text):
        none = np.zeros(0, np.int64)
        return np.stack([none, none]), np.zeros(0, np.float32), none
    base = np.append(0, np.cumsum(count))
    live, code = known.codes(np.concatenate(words))
    edge = np.append(0, np.cumsum([len(w) for w in words]))
    owner = np.searchsorted(edge, live, "right") - 1
    step = (live - edge[owner]) // STEP
    keys = []
    for back in range(PASSAGE_CELLS // STEP_CELLS):  # a word is in the passages that start at its step and the one before
        inside = (step >= back) & (step - back < count[owner])
        keys.append((base[owner[inside]] + step[inside] - back) * size + code[inside])
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    place = np.stack([key // size, key % size]) if size else np.zeros((2, 0), np.int64)
    value = times * known.weight[place[1]]
    norm = np.sqrt(np.bincount(place[0], value.astype(float) ** 2, minlength=len(text)))
    return place, (value / norm[place[0]]).astype(np.float32), text


def _gram_times(rows: DataFrame, known: Vocabulary, q: np.ndarray) -> np.ndarray:
    """A'(AQ) for the passages of `rows` (text)."""
    shared = rows.sparkSession.sparkContext.broadcast((known, q))
    slices = -(-len(known.words) // 1024)

    def run(batches):
        known, q = shared.value
        total = np.zeros(q.shape, np.float32)
        for part in chunks(batches, "text", FIT_CHUNK):
            words = Words(*text_bytes(pc.utf8_lower(part.column(0))), marks_part=True)
            h = words.hashes(lower=False)
            place, value, text = unit_passages([h[a:b] for a, b in zip(words.word_offs[:-1], words.word_offs[1:], strict=True)], known)
            if not len(value):
                continue
            used, code = np.unique(place[1], return_inverse=True)
            a = np.zeros((len(text), len(used)), np.float32)
            a[place[0], code] = value
            total[used] += a.T @ (a @ q[used])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([total[i * 1024 : (i + 1) * 1024].tobytes() for i in range(slices)], pa.binary())], ["part", "y"])

    def add(table: pa.Table) -> pa.Table:
        y = sum(np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in table.column("y"))
        return pa.table({"part": table.column("part").slice(0, 1), "y": pa.array([y.astype(np.float32).tobytes()], pa.binary())})

    schema = "part int, y binary"
    out = np.zeros(q.shape, np.float64)
    for r in rows.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect():
        out[r.part * 1024 : (r.part + 1) * 1024] = np.frombuffer(r.y, np.float32).reshape(-1, q.shape[1])
    return out


def fit_basis(rows: DataFrame, known: Vocabulary, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages of all rows (text), by a randomised range finder over Spark partitions."""
    width = min(rank + OVERSAMPLE, len(known.words))
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(known.words), width)))[0].astype(np.float32)
    for step in range(PASSES):
        y = _gram_times(rows, known, q)
        if step < PASSES - 1:
            q = np.linalg.qr(y)[0].astype(np.float32)
    power, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    return (q @ turn[:, np.argsort(-power)][:, :rank]).astype(np.float32)


def build(rows: list[tuple], spark: SparkSession, rank: int = RANK) -> Space:
    """The space of items given as (id, text), fitted on all of them."""
    words = [_hashes(t) for _, t in rows]
    known = vocabulary(words)
    basis = fit_basis(spark.createDataFrame([(t,) for _, t in rows], "text string").repartition(FIT_TASKS), known, rank)
    place, value, item = unit_passages(words, known)
    latent = np.zeros((len(item), basis.shape[1]), np.float32)
    np.add.at(latent, place[0], value[:, None] * basis[place[1]])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    size = np.array([min(PASSAGE, len(words[t])) for t in item], float)
    codes = [np.unique(known.codes(w)[1]) for w in words]
    mine = [~known.common[known.codes(w)[1]] for w in words]
    return Space(
        [i for i, _ in rows], words, [_hashes(_answer(t)) for _, t in rows], mine, [grams(w, RUN_WORDS) for w in words], known, item,
        place[0] * len(known.words) + place[1], value * known.weight[place[1]], basis * known.weight[:, None], latent,
        np.minimum(LATENT_COSINE, SHORT_PART * np.sqrt(size / PASSAGE)).astype(np.float32),
        np.concatenate([i * len(known.words) + c for i, c in enumerate(codes)] or [np.zeros(0, np.int64)]),
        np.array([min(PARAPHRASE * len(w), RUN_WORDS) - (len(w) - len(c)) for w, c in zip(words, codes, strict=True)]),
    )


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit vector over `a` per step."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if (m := where.get(x)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _inside(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether `a` stands in `b` without a gap."""
    return len(a) <= len(b) and bool((np.lib.stride_tricks.sliding_window_view(b, len(a)) == a).all(1).any())


def judge(space: Space, number: int, around: np.ndarray) -> tuple[float, float] | None:
    """(common, answer) if the words around a passage match the item, else None."""
    item, answer = space.words[number], space.answers[number]
    if len(item) < SHORT_ITEM:
        return (1.0, 1.0) if _inside(item, around) else None
    share = common_subsequence(item, around) / len(item)
    said = common_subsequence(answer, around) / max(1, len(answer))
    if share >= VERBATIM:
        return share, said
    if share >= PARAPHRASE and said >= ANSWER:
        own = item[space.own[number]]
        if common_subsequence(own, around) >= PARAPHRASE * len(own):
            return share, said
    if share * len(item) >= RUN_WORDS and np.isin(space.runs[number], grams(around, RUN_WORDS)).any():
        return share, said
    return None


def candidates(space: Space, words: Words, live: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, item passage, full cosine) of the candidates in a batch of texts; live: places of words with a code."""
    none = np.zeros(0, np.int64)
    if not len(live) or not len(space.item):
        return none, none, none, none
    base = np.zeros(len(words.counts) + 1, np.int64)
    np.cumsum(-(-words.counts // CELL_WORDS), out=base[1:])
    text = np.searchsorted(words.word_offs, live, "right") - 1
    cell = base[text] + (live - words.word_offs[text]) // CELL_WORDS
    power = np.append(0, np.cumsum(space.vocabulary.weight[code].astype(float) ** 2))
    active, first = np.unique(cell, return_index=True)
    size = np.diff(np.append(first, len(code)))
    folded = space.basis[code[first]]
    for j in range(1, CELL_WORDS):
        more = np.flatnonzero(size > j)
        folded[more] += space.basis[code[first[more] + j]]
    owner = np.searchsorted(base, active, "right") - 1
    local = (active - base[owner]) // STEP_CELLS
    key = np.unique(np.concatenate([owner * (1 << 40) + np.maximum(local - s, 0) for s in range(PASSAGE_CELLS // STEP_CELLS)]))
    doc, start = key >> 40, (key & ((1 << 40) - 1)) * STEP_CELLS
    begin = base[doc] + start
    end = np.minimum(begin + PASSAGE_CELLS, base[doc + 1])
    z = np.zeros((len(key), folded.shape[1]), np.float32)
    for j in range(PASSAGE_CELLS):
        at = np.searchsorted(active, begin + j)
        ok = (begin + j < end) & (at < len(active))
        ok[ok] = active[at[ok]] == (begin + j)[ok]
        z[ok] += folded[at[ok]]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    p, q = np.divmod(np.flatnonzero(z @ space.latent.T >= space.least), len(space.item))
    lo, hi = np.searchsorted(cell, begin), np.searchsorted(cell, end)  # words of each passage in `live`
    keep, cosine = [], []
    for some in np.array_split(np.arange(len(p)), -(-len(p) // _PAIRS) or 1):
        size = hi[p[some]] - lo[p[some]]
        ends = np.append(0, np.cumsum(size))
        which = np.repeat(np.arange(len(some)), size)
        word = np.arange(ends[-1]) - ends[which] + lo[p[some]][which]
        wanted = q[some][which] * len(space.vocabulary.words) + code[word]
        at = np.minimum(np.searchsorted(space.entry, wanted), len(space.entry) - 1)
        dot = np.bincount(which, np.where(space.entry[at] == wanted, space.value[at], 0), minlength=len(some))
        got = dot / np.sqrt(np.maximum(power[hi[p[some]]] - power[lo[p[some]]], 1e-9))
        near = got >= space.least[q[some]] * (LEAST_COSINE / LATENT_COSINE)
        keep.append(some[near])
        cosine.append(got[near])
    keep = np.concatenate(keep)
    return doc[p[keep]], start[p[keep]] * CELL_WORDS, q[keep], np.concatenate(cosine)


def with_enough_words(space: Space, number: np.ndarray, begin: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which candidates have around them (code[begin:end]) so many different words of the item that a rule can be met."""
    keep = []
    for some in np.array_split(np.arange(len(number)), -(-len(number) // (_PAIRS >> 4)) or 1):
        size = end[some] - begin[some]
        ends = np.append(0, np.cumsum(size))
        which = np.repeat(np.arange(len(some)), size)
        found = code[np.arange(ends[-1]) - ends[which] + begin[some][which]]
        wanted = number[some][which] * len(space.vocabulary.words) + found
        at = np.minimum(np.searchsorted(space.member, wanted), len(space.member) - 1)
        hit = space.member[at] == wanted
        different = np.unique(which[hit] * len(space.member) + at[hit]) // len(space.member)
        keep.append(some[np.bincount(different, minlength=len(some)) >= space.need[number[some]]])
    return np.concatenate(keep)


def find(spaces: list[Space], raw: np.ndarray, offs: np.ndarray) -> list[tuple]:
    """(text, space, item number, cosine, common, answer) of the matches in a batch of lower-case texts, best per pair."""
    words = Words(raw, offs, marks_part=True)
    if not len(words):
        return []
    h = words.hashes(lower=False)
    best: dict[tuple[int, int, int], tuple] = {}
    for n, space in enumerate(spaces):
        live, code = space.vocabulary.codes(h)
        text, start, passage, cosine = candidates(space, words, live, code)
        if not len(text):
            continue
        number = space.item[passage]
        order = np.lexsort((-cosine, number, start, text))
        text, start, number, cosine = text[order], start[order], number[order], cosine[order]
        new = np.append(True, (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(number) != 0))
        text, start, number, cosine = text[new], start[new], number[new], cosine[new]
        reach = np.array([len(w) for w in space.words])[number]
        lo = words.word_offs[text] + np.maximum(0, start - reach)
        hi = np.minimum(words.word_offs[text + 1], words.word_offs[text] + start + PASSAGE + reach)
        for i in with_enough_words(space, number, np.searchsorted(live, lo), np.searchsorted(live, hi), code).tolist():
            key = int(text[i]), n, int(number[i])
            if (got := judge(space, key[2], h[lo[i] : hi[i]])) is not None and (got[0], cosine[i]) > best.get(key, (0.0,))[:2]:
                best[key] = (got[0], float(cosine[i]), got[1])
    return [(d, n, number, min(1.0, c), s, a) for (d, n, number), (s, c, a) in sorted(best.items())]


class Screen:
    """A benchmark prepared for the search of a corpus."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
        self.id_col, self.text_col, self.item_col = id_col, text_col, item_col
        self.spark = docs.sparkSession
        self.item_kind = benchmark.schema[item_col].dataType.simpleString()
        rows = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null").distinct()
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.groups = max(1, -(-n // GROUP_ITEMS), -(-size * SCAN_GROUPS // SCAN_BYTES))
        self.rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(self.groups)))
        self._scans = None

    def scans(self) -> list:
        """Broadcasts of SCAN_GROUPS spaces each, made on first use."""
        if self._scans is None:
            spaces = [build(sorted((r.id, r.text) for r in self.rows.where(F.col("g") == g).collect()), self.spark) for g in range(self.groups)]
            self._scans = [self.spark.sparkContext.broadcast(spaces[i : i + SCAN_GROUPS]) for i in range(0, len(spaces), SCAN_GROUPS)]
        return self._scans

    def matches(self, docs: DataFrame) -> DataFrame:
        """(id column, item column, cosine, common, answer) for each document and item that match."""
        kind = docs.schema[self.id_col].dataType.simpleString()
        schema = f"`{self.id_col}` {kind}, `{self.item_col}` {self.item_kind}, cosine double, common double, answer double"
        names = [self.id_col, self.item_col, "cosine", "common", "answer"]
        source = docs.select(F.col(self.id_col), F.col(self.text_col).alias("text"))
        out = None
        for shared in self.scans():

            def run(batches, shared=shared):
                spaces = shared.value
                for part in chunks(batches, "text"):
                    found = find(spaces, *text_bytes(pc.utf8_lower(part.column(1))))
                    if found:
                        items = pa.array([spaces[f[1]].ids[f[2]] for f in found])
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([f[0] for f in found])), items, *(pa.array([float(f[i]) for f in found]) for i in (3, 4, 5))], names)

            got = source.mapInArrow(run, schema)
            out = got if out is None else out.unionByName(got)
        return out

    def clean(self, docs: DataFrame) -> DataFrame:
        """The rows of docs, with all their columns, whose text matches no item."""
        at = docs.columns.index(self.text_col)
        name = self.text_col
        for shared in self.scans():

            def run(batches, shared=shared):
                for part in chunks(batches, name):
                    bad = {f[0] for f in find(shared.value, *text_bytes(pc.utf8_lower(part.column(at))))}
                    if len(bad) < part.num_rows:
                        yield part.filter(pa.array([i not in bad for i in range(part.num_rows)]))

            docs = docs.mapInArrow(run, docs.schema)
        return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of documents with benchmark items: (doc_id, item_id, cosine, common, answer).

    A row for each document and item that match; documents without a match have none. Null and
    empty texts and items match nothing, an empty benchmark gives no rows, repeated rows match
    alike, texts may be of any length. Case and ASCII punctuation don't count. Other columns are
    left out, whatever their names.
    """
    return Screen(docs, benchmark, id_col, text_col).matches(docs)
