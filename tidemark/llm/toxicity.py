"""Toxicity by compression distance.

Two zstandard dictionaries are trained. The ordinary one is trained on windows of ordinary texts;
the toxic one ends with what was trained on the words that mark toxic texts: those that byte
5-grams run through whose rate is surely higher in toxic than in ordinary texts. Such words are
left out of the ordinary windows, and both dictionaries have the rest in common, so that a window
compresses better with one of them only by what is typical of that class. A text is cut into
windows of whole words; how much its windows save is summed up in a few features, and a logistic
curve calibrated on texts that the dictionaries haven't seen turns them into a score.

Everything that looks at texts runs as Spark tasks; the driver holds the pieces that the
dictionaries are trained on (the windows of the SAMPLE texts) and one row of
numbers by calibration text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import chunks, cut

#: Labelled texts that the fit looks at, by label.
SAMPLE = {1: 2500, 0: 7500}
#: Part of the sample that the dictionaries are trained on; the rest calibrates the score.
TRAINED_SHARE = 0.6
#: Bytes of the longest word that a dictionary is trained on in one piece.
LONGEST_PIECE = 256
WINDOW_BYTES = 60
MARKS_BYTES, BASE_BYTES = 1 << 13, 1 << 15
SEGMENT, DMER = 24, 6
#: Short windows need short matches: binary trees, matches of 3 bytes on.
LEVEL, STRATEGY, MIN_MATCH, SEARCH_LOG = 3, 6, 3, 3
GRAM, GRAM_BITS = 5, 21
#: Occurrences of a gram that count in one text, so that no text decides alone.
MOST_IN_TEXT = 6
#: A gram marks toxic texts if the log-odds of its rate, with this prior count, are so much higher
#: than in ordinary texts, and so many standard errors; a word needs LEAST_MARKS such grams.
PRIOR, LEAST_ODDS, LEAST_SURE, LEAST_MARKS = 0.5, 2.0, 4.0, 2


def pieces(text: str) -> list[bytes]:
    """The words in lower case; longer ones are cut every LONGEST_PIECE bytes."""
    out = []
    for word in text.lower().encode().split():
        out += [word] if len(word) <= LONGEST_PIECE else [word[i : i + LONGEST_PIECE] for i in range(0, len(word), LONGEST_PIECE)]
    return out


def _joined(words: list[bytes]) -> list[bytes]:
    out: list[bytes] = []
    held: list[bytes] = []
    size = 0
    for word in words:
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW_BYTES:
            out.append(b" " + b" ".join(held) + b" ")
            held, size = [], 0
    if held or not out:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def windows(text: str) -> list[bytes]:
    """Whole words, lower case, WINDOW_BYTES or a little more each; an empty text is one empty window."""
    return _joined(pieces(text))


def _grams(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(len(x) - GRAM + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(257) + x[j : j + n]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def split_by_marks(text: str, good: np.ndarray) -> tuple[list[bytes], list[list[bytes]]]:
    """The words with LEAST_MARKS marking grams or more, and the runs of words without any."""
    words = pieces(text)
    raw = b" " + b" ".join(words) + b" "
    total = np.append(0, np.cumsum(good[_grams(raw)]))
    size = np.array([len(w) for w in words], np.int64)
    first = np.append(0, np.cumsum(size + 1))[:-1]  # the space before each word
    last = len(total) - 1
    hits = total[np.minimum(np.maximum(first, first + size + 3 - GRAM), last)] - total[np.minimum(first, last)]
    marked, runs = [], [[]]
    for word, n in zip(words, hits.tolist(), strict=True):
        if n >= LEAST_MARKS:
            marked.append(b" " + word + b" ")
        if n:
            runs.append([])
        else:
            runs[-1].append(word)
    return marked, [r for r in runs if r]


def train(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary of at most `size` bytes trained on the samples."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the most common samples serve
        common = [s for s, _ in Counter(samples).most_common()]
        return b"\0".join(reversed(common))[-size:]


class Scorer:
    """The two dictionaries and the calibrated curve. Picklable; compressors are made on first use."""

    def __init__(self, marks: bytes = b"", base: bytes = b"", prior: float | None = None):
        """With a prior, every text has this score."""
        base = base.rjust(8, b"\0")
        self.toxic, self.ordinary = base + marks, base + bytes(len(marks))
        self.prior = prior
        self._tools = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def _compressors(self):
        if self._tools is None:
            made = []
            for content in (self.toxic, self.ordinary):
                how = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=256, dict_size=len(content), strategy=STRATEGY, min_match=MIN_MATCH, search_log=SEARCH_LOG,
                    write_content_size=False, write_dict_id=False, write_checksum=False,
                )
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
            self._tools = tuple(made)
        return self._tools

    def features(self, text: str) -> list[float]:
        toxic, ordinary = self._compressors()
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])
        top = np.sort(saved)[::-1]
        least = saved[:, None] >= np.array([1, 2, 3, 4, 5, 6, 8])
        return [top[0], top[:3].mean(), saved.mean(), np.maximum(saved, 0).mean(), (saved < 0).mean(), np.log(len(saved)), *least.mean(0), *np.log1p(least[:, 1:6].sum(0))]

    def calibrate(self, x: np.ndarray, label: np.ndarray) -> None:
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        a = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        w = np.zeros(a.shape[1])
        ridge = np.eye(len(w)) * 0.05
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - label) + ridge @ w)
        self.weights = w

    def score(self, texts: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        x = (np.array([self.features(t) for t in texts]) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """(label, text, key, trains) of about SAMPLE labelled rows of each label, chosen by a hash of the row id."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    counts = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    keep = F.lit(False)
    for label, most in SAMPLE.items():
        part = min(1.0, most / counts.get(label, 1))
        keep = keep | ((F.col("label") == label) & (F.pmod(F.xxhash64(F.lit("tox"), F.col(id_col)), F.lit(1 << 20)) < int(part * (1 << 20))))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(marked.where(keep)), id_col)  # about the sum of SAMPLE rows
    key = F.xxhash64(F.lit("part"), F.col(id_col), F.col("text"))
    return cut(rows.select("label", "text", key.alias("key"), (F.pmod(key, F.lit(1000)) < int(1000 * TRAINED_SHARE)).alias("trains")))


def _marks(rows: DataFrame) -> np.ndarray:
    """Which grams mark toxic texts."""

    def run(batches):
        for part in chunks(batches, "text"):
            label = part.column(0).to_numpy()
            for wanted in (0, 1):
                texts = [_grams(b" " + b" ".join(pieces(t)) + b" ") for t in part.column(1).filter(pa.array(label == wanted)).to_pylist()]
                if not texts:
                    continue
                each = [np.unique(g, return_counts=True) for g in texts]
                gram, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
                n = np.bincount(at, np.minimum(np.concatenate([c for _, c in each]), MOST_IN_TEXT), len(gram)).astype(np.int64)
                gram, n = np.append(gram, -1), np.append(n, sum(map(len, texts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), wanted)), pa.array(gram), pa.array(n)], ["label", "gram", "n"])

    seen = rows.select("label", "text").mapInArrow(run, "label long, gram long, n long")
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0)).alias(f"n{label}")
    seen = cut(seen.groupBy("gram").agg(of(0), of(1)))  # a row for each of 2**GRAM_BITS hashes at most
    whole = seen.where("gram = -1").first()
    good = np.zeros(1 << GRAM_BITS, bool)
    if whole is not None and whole.n0 and whole.n1:
        a, b = F.col("n1") + PRIOR, F.col("n0") + PRIOR
        odds = F.log(a / whole.n1) - F.log(b / whole.n0)
        sure = odds >= F.greatest(F.lit(LEAST_ODDS), LEAST_SURE * F.sqrt(1 / a + 1 / (b + 1)))
        good[[r.gram for r in seen.where((F.col("gram") >= 0) & sure).select("gram").collect()]] = True
    return good


def _pieces(rows: DataFrame, good: np.ndarray) -> dict[str, list[bytes]]:
    """All marking words, windows of toxic and windows of ordinary texts of the sample, in an order settled by a hash."""
    shared = rows.sparkSession.sparkContext.broadcast(good)

    def run(batches):
        for part in chunks(batches, "text"):
            kinds, keys, out = [], [], []
            for label, text, key in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words, runs = split_by_marks(text, shared.value)
                got = [("word", w) for w in words] + [("toxic", w) for w in windows(text)] if label else [("ordinary", w) for r in runs for w in _joined(r)]
                kinds += [k for k, _ in got]
                out += [w for _, w in got]
                keys += [key] * len(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(out, pa.binary()), pa.array(keys, pa.int64()), pa.array(range(len(out)), pa.int64())], ["kind", "piece", "key", "at"])

    found = cut(rows.select("label", "text", "key").mapInArrow(run, "kind string, piece binary, key long, at long"))
    # a document's pieces are numbered in its own batch, so the order is settled by its key and the piece
    order = [F.xxhash64("piece", "key"), F.col("piece")]
    return {k: [bytes(r.piece) for r in found.where(F.col("kind") == k).orderBy(*order).select("piece").collect()] for k in ("word", "toxic", "ordinary")}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fit on about SAMPLE texts of each label, chosen by a hash of the row id; whole texts of any length.

    Rows without text or label teach nothing. Without texts of one label (or any label) every
    score is the same: the share of toxic texts with half a text added to either side. A sample
    too small to be split trains and calibrates on the same texts.
    """
    rows = _sample(docs, labels, label_col, id_col, text_col)
    counts = {(r.label, r.trains): r["count"] for r in rows.groupBy("label", "trains").count().collect()}
    n = {label: sum(c for (x, _), c in counts.items() if x == label) for label in (0, 1)}
    if not n[0] or not n[1]:
        return Scorer(prior=(n[1] + 0.5) / (n[0] + n[1] + 1))
    split = len(counts) == 4
    trained = rows.where("trains") if split else rows
    found = _pieces(trained, _marks(trained))
    scorer = Scorer(train(found["word"] or found["toxic"], MARKS_BYTES), train(found["ordinary"], BASE_BYTES))
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for part in chunks(batches, "text"):
            got = [shared.value.features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([list(map(float, x)) for x in got], pa.list_(pa.float64()))], ["label", "key", "x"])

    got = (rows.where("not trains") if split else rows).select("label", "text", "key").mapInArrow(run, f"label {dict(rows.dtypes)['label']}, key long, x array<double>").collect()
    got.sort(key=lambda r: (r.key, r.x))
    scorer.calibrate(np.array([r.x for r in got]), np.array([float(r.label) for r in got]))
    return scorer


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: the id column, score (0 to 1), predicted (1 from `threshold` on).

    Null and empty texts get the score of one empty window. Only the text is looked at; other
    columns are left out and repeated rows repeat; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # under 2 * (BASE_BYTES + MARKS_BYTES) and a few numbers

    def run(batches):
        for part in chunks(batches, "text"):
            got = shared.value.score([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
