"""Language identification by bit-sliced Bloom filters of character trigrams.

Each filter slot holds one bit per language (in words of 64), so one probe of a trigram's slots
returns the mask of all languages that contain it. A text's hits per language are popcounts over its
trigrams, less the hits that the language's filter gives by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import chunks
from tidemark.llm.words import mix

SLOTS = 1 << 17
PROBES = 2
#: A trigram belongs to a language from this share of the language's trigrams on ...
LEAST_SHARE = 5e-5
#: ... if that share is at least this part of the largest share in any language.
LEAST_OF_LARGEST = 0.25
#: Labelled texts of one language that the filters are fitted on.
SAMPLE_PER_LANGUAGE = 3000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    return _LETTER


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased trigrams around each letter, their text offsets, and letters per text.

    All other characters count as one and the same edge.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 0).astype(np.uint64)
    middle = np.flatnonzero(letter)
    grams = mix((points[middle - 1] << np.uint64(42)) | (points[middle] << np.uint64(21)) | points[middle + 1])
    ends = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in low], out=ends[1:])
    offs = np.searchsorted(middle, ends)
    return grams, offs, np.diff(offs)


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


class Filters:
    """The fitted filters: languages, slots (a bit per language) and each language's chance hit rate."""

    def __init__(self, languages: list[str], grams: np.ndarray, owners: np.ndarray):
        """grams: trigrams of the languages whose numbers are in owners."""
        self.languages = languages
        self.slots = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
        bits = np.uint64(1) << (owners % 64).astype(np.uint64)
        for probe in self._probes(grams):
            np.bitwise_or.at(self.slots, (owners // 64, probe), bits)
        fill = np.array([self._bit(self.slots, i).mean() for i in range(len(languages))])
        self.chance = fill**PROBES

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    @staticmethod
    def _probes(grams: np.ndarray) -> list[np.ndarray]:
        return [((grams >> np.uint64(17 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, offs, n = trigrams(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        masks = self.slots[:, self._probes(grams)[0]]
        for probe in self._probes(grams)[1:]:
            masks &= self.slots[:, probe]
        hits = np.stack([_sums(self._bit(masks, i).astype(np.int64), offs) for i in range(len(self.languages))])
        real = np.maximum((hits - self.chance[:, None] * n) / (1 - np.minimum(self.chance, 0.999))[:, None], 0)
        best = real.argmax(0)
        total = real.sum(0)
        top = real[best, np.arange(len(texts))]
        score = np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)
        names = [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
        return names, np.where(n > 0, score, 0.0)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Fit on at most about `sample` texts of each language, chosen by a hash of the row id.

    Rows without text or language teach nothing, nor do texts without a letter; if nothing is
    learned, every text is `und`. The driver receives the trigrams above LEAST_SHARE, at most
    1 / LEAST_SHARE of each language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    nothing = Filters([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not counts:
        return nothing
    languages = sorted(counts)
    parts = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, sample / counts[name]) * (1 << 20)))])
    keep = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < parts[F.col(lang_col)]
    number = {name: i for i, name in enumerate(languages)}

    def count(batches):
        seen: dict[int, list] = {}
        for part in chunks(batches, "text"):
            langs = part.column(0).to_pylist()
            grams, offs, _ = trigrams(part.column(1).to_pylist())
            which = np.repeat([number[x] for x in langs], np.diff(offs))
            for i in np.unique(which):
                seen.setdefault(int(i), []).append(np.unique(grams[which == i], return_counts=True))
        for i, parts in seen.items():
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    grams = rows.where(keep).select(F.col(lang_col), F.col(text_col).alias("text")).mapInArrow(count, "lang long, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from tidemark.llm.runtime import cut

    grams = cut(grams)
    totals = {r[0]: r[1] for r in grams.groupBy("lang").agg(F.sum("n")).collect()}
    if not totals:
        return nothing
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])
    shares = grams.withColumn("share", F.col("n") / total[F.col("lang")]).where(F.col("share") >= LEAST_SHARE)
    largest = shares.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("langs"), F.max("share").alias("top"))
    kept = largest.select("gram", F.explode("langs").alias("l"), "top").where(F.col("l.share") >= F.col("top") * LEAST_OF_LARGEST)
    found = kept.select("gram", F.col("l.lang").alias("lang")).collect()
    return Filters(languages, np.array([r.gram for r in found], np.int64).view(np.uint64), np.array([r.lang for r in found], np.int64))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: the id column, lang_pred, score (share of the corrected hits).

    Null texts and texts without a letter give `und` and 0. Ties go to the language first by
    name. Only the text is looked at; other columns are left out and repeated rows repeat. An
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS * 8 bytes

    def run(batches):
        for part in chunks(batches, "text"):
            names, score = shared.value.predict([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language (not `und`)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_col)

    def run(batches):
        for part in chunks(batches, text_col):
            names, _ = shared.value.predict([t or "" for t in part.column(at).to_pylist()])
            if any(n != "und" for n in names):
                yield part.filter(pa.array([n != "und" for n in names]))

    return docs.mapInArrow(run, docs.schema)
