"""Incremental removal of repeated word windows with a log-structured fingerprint index.

A window is `width` consecutive words. Its fingerprint is the least hash of the word grams
inside it. Consecutive windows mostly share one, so the index holds every window's fingerprint
in run-length form: a row (fingerprint, document, first window, end window) per stretch. There
is one immutable run per batch, hash-partitioned and sorted by fingerprint (a bucketed table). A
new batch is written as a run and merge-joined with the older runs to find fingerprints met
before; the windows under those are verified by two independent 64-bit hashes of all their
words. The earliest place of each window follows from one grouped minimum, which is combined
before the shuffle. When the runs outnumber `fanout` they are compacted into one.

A fingerprint that a sample finds in many documents of a batch (a passage that all share) is
known to repeat: its rows are dealt at random instead of by fingerprint and need no join.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.runtime import chunks, cut, drop, ensure_checkpoint_dir, partitions_for, remove, shuffles_removed, text_bytes
from tidemark.llm.words import Words, gram_starts, grams, mix

GRAM = 8
#: Hashed ids that a broadcast filter of documents may hold.
ID_SLOTS = 1 << 20
#: One of so many documents is looked at for fingerprints in at least HOT_DOCS of them; of these
#: the HOT_PRINTS most frequent (8 bytes each, broadcast) are dealt at random, all others by value.
HOT_PART, HOT_DOCS, HOT_PRINTS = 64, 16, 1 << 16
_FIRST = -(2**63)


def _stretches(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """(fingerprint, text, first window, end window, occurrences of the least gram) of each stretch."""
    h = words.hashes(lower=False)
    g = grams(h, GRAM)
    starts = gram_starts(words.word_offs, width)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    span = width - GRAM + 1
    low, size = g, 1
    while size * 2 <= span:
        low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
    rest = span - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    least = low[starts]
    text = words.texts()[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(starts))
    # how often the least gram occurs under the stretch: more than once, and it may repeat itself
    offs = np.stack([starts[first], starts[end - 1] + span], 1).ravel()
    lens = offs[1::2] - offs[::2]
    at = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    place = np.repeat(offs[::2] - at[:-1], lens) + np.arange(at[-1])
    times = np.add.reduceat((g[place] == np.repeat(least[first], lens)).astype(np.int64), at[:-1])
    base = words.word_offs[text[first]]
    return least[first], text[first], starts[first] - base, starts[end - 1] - base + 1, times


def fingerprints(docs: DataFrame, width: int, hot=None) -> DataFrame:
    """(route, fp, id, lo, hi, times): windows lo..hi-1 of the document share the fingerprint.

    route is the fingerprint and fp null, but for fingerprints in `hot` (broadcast of a sorted
    array): these have route at random and the fingerprint in fp.
    """

    def run(batches):
        for part in chunks(batches, "text"):
            raw, text, lo, hi, times = _stretches(Words(*text_bytes(part.column(1))), width)
            if not len(raw):
                continue
            fp = raw.view(np.int64)
            known = np.zeros(len(fp), bool)
            if hot is not None and len(hot.value):
                known = hot.value[np.minimum(np.searchsorted(hot.value, fp), len(hot.value) - 1)] == fp
            ids = part.column(0).take(pa.array(text))
            spread = mix(raw + ids.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(known, spread, fp)), pa.array(fp, mask=~known), ids, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.minimum(times, 2).astype(np.int32))], ["route", "fp", "id", "lo", "hi", "times"])

    return docs.select("id", "text").mapInArrow(run, "route long, fp long, id long, lo int, hi int, times int")


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, offsets) of a list<struct<lo,hi>> column; null lists are empty."""
    lens = np.nan_to_num(np.array(column.value_lengths().to_pylist(), float)).astype(np.int64)
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    flat = column.flatten()
    lo, hi = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten())
    return lo, hi, offs


def _windows_of(words: Words, column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the distinct windows under each text's spans, sorted."""
    lo, hi, offs = _spans(column)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    most = np.maximum(words.counts - width + 1, 0)
    hi = np.minimum(hi, most[text])
    lens = np.maximum(hi - lo, 0)
    at = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    start = np.repeat(lo - at[:-1], lens) + np.arange(at[-1])
    key = np.unique(words.word_offs[np.repeat(text, lens)] + start)
    text = np.searchsorted(words.word_offs, key, "right") - 1
    return text, key - words.word_offs[text]


def _window_hashes(docs: DataFrame, width: int) -> DataFrame:
    """(w, c, id, at) of the windows under the spans of each document."""

    def run(batches):
        for part in chunks(batches, "text"):
            words = Words(*text_bytes(part.column(1)))
            text, start = _windows_of(words, part.column(2), width)
            if not len(text):
                continue
            h = words.hashes(lower=False)
            place = words.word_offs[text] + start
            w, c = grams(h, width)[place], grams(h, width, check=True)[place]
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.view(np.int64)), part.column(0).take(pa.array(text)), pa.array(start.astype(np.int32))], ["w", "c", "id", "at"])

    return docs.select("id", "text", "spans").mapInArrow(run, "w long, c long, id long, at int")


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), F.col(column)), F.lit(ID_SLOTS))


def _slots(ids: DataFrame) -> DataFrame:
    """At most ID_SLOTS rows: a broadcast filter that keeps every row whose id is among `ids`."""
    return F.broadcast(ids.select(_slot("id").alias("slot")).distinct())


def normal(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns id (long, null as the least long) and text, and those in `carry`."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("id"), F.col(text_col).alias("text"), *carry)


class FingerprintIndex:
    """Runs of the fingerprints of all windows of the documents added so far."""

    def __init__(self, spark: SparkSession, width: int = 20, fanout: int = 1, partitions: int | None = None):
        if width < GRAM:
            raise ValueError(f"windows have at least {GRAM} words")
        self.spark, self.width, self.fanout = spark, width, fanout
        self.buckets = partitions or partitions_for(spark)
        self.runs: list[str] = []
        self.places: dict[str, str] = {}
        self.hot: dict[str, np.ndarray] = {}

    def _write(self, rows: DataFrame, hot: np.ndarray) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        # the catalog knows the buckets; the files lie in the folder that all machines share
        self.places[name] = f"{ensure_checkpoint_dir(self.spark)}/{name}"
        with shuffles_removed(self.spark):
            rows.repartition(self.buckets, "route").write.bucketBy(self.buckets, "route").sortBy("route").format("parquet").option("compression", "zstd").option("path", self.places[name]).saveAsTable(name)
        self.hot[name] = hot
        return name

    def _hot(self, batch: DataFrame) -> np.ndarray:
        sample = fingerprints(batch.where(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(HOT_PART)) == 0), self.width)
        often = sample.groupBy(F.col("route").alias("fp")).agg(F.countDistinct("id").alias("n")).where(F.col("n") >= HOT_DOCS)
        return np.sort(np.array([r.fp for r in often.orderBy(F.desc("n"), "fp").limit(HOT_PRINTS).collect()], np.int64))

    def _listed(self, prints: np.ndarray, name: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(x,) for x in prints.tolist()], f"{name} long"))

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            whole = self.spark.table(self.runs[0])
            for run in self.runs[1:]:
                whole = whole.unionByName(self.spark.table(run))
            hot = np.unique(np.concatenate([self.hot[run] for run in self.runs]))
            if len(hot) > HOT_PRINTS:  # so many that the rest is dealt by value again
                hot = hot[np.argsort(hot.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:HOT_PRINTS]]
                hot.sort()
                listed = self._listed(hot, "fp").withColumn("_hot", F.lit(True))
                whole = whole.join(listed, "fp", "left").select(F.when(F.col("_hot") | F.col("fp").isNull(), F.col("route")).otherwise(F.col("fp")).alias("route"), F.when(F.col("_hot"), F.col("fp")).alias("fp"), "id", "lo", "hi", "times")
            before, self.runs = self.runs, [*self.runs, self._write(whole, hot)]
            for run in before:
                self._remove(run)
            self.runs = self.runs[-1:]

    def drop(self) -> None:
        """Delete all runs, those of an addition that failed too."""
        for run in list(self.places):
            self._remove(run)
        self.runs = []

    def _remove(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, self.places.pop(run))

    def add(self, batch: DataFrame, archive: DataFrame | None = None) -> DataFrame:
        """Add a batch whose ids are all above those added before; returns its decisions.

        batch and archive have columns id (long, not null, one text each) and text; archive must
        hold the documents added before. The decisions are (id, spans, kept): of the windows in
        spans, those starting at `kept` are the first of their kind, the others repeat an
        earlier one. Documents without a row repeat nothing.
        """
        hot = self._hot(batch)
        name = self._write(fingerprints(batch, self.width, self.spark.sparkContext.broadcast(hot)), hot)
        new = self.spark.table(name)
        met = new.where("fp is null").groupBy("route").agg(F.sum("times").alias("n")).withColumn("old", F.lit(False))
        for run in self.runs:
            seen = self.spark.table(run).where("fp is null").select("route").distinct().withColumn("_seen", F.lit(True))
            met = met.join(seen, "route", "left").join(self._listed(self.hot[run], "route").withColumn("_hot", F.lit(True)), "route", "left")
            met = met.select("route", "n", (F.col("old") | F.coalesce("_seen", "_hot", F.lit(False))).alias("old"))
        again = cut(met.where("old or n > 1").select("route", "old"))
        places = ["id", "lo", "hi"]
        spans = new.where("fp is null").join(again.select("route"), "route").select(places).unionByName(new.where("fp is not null").select(places))
        history = None
        for run in self.runs:
            past = self.spark.table(run)
            cold, often = past.where("fp is null"), past.where("fp is not null")
            asked = self._listed(self.hot[run], "route").join(again.where("old"), "route", "left_semi").unionByName(self._listed(hot, "route")).distinct()
            part = cold.join(again.where("old").select("route"), "route").select(places)
            part = part.unionByName(cold.join(self._listed(hot, "route"), "route", "left_semi").select(places))
            part = part.unionByName(often.join(F.broadcast(asked.withColumnRenamed("route", "fp")), "fp", "left_semi").select(places))
            history = part if history is None else history.unionByName(part)
        used = [again]
        mine = cut(spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
        windows = _window_hashes(self._with_spans(batch, mine), self.width)
        if history is not None and archive is not None:
            theirs = cut(history.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
            used.append(theirs)
            windows = windows.unionByName(_window_hashes(self._with_spans(archive, theirs), self.width))
        kept = self._first(windows, batch if archive is None else archive.unionByName(batch))
        decisions = cut(mine.join(kept.groupBy("id").agg(F.collect_list("at").alias("kept")), "id", "left"))
        drop(mine, *used)
        self.runs.append(name)
        if len(self.runs) > self.fanout:
            self.compact()
        return decisions

    @staticmethod
    def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
        near = docs.withColumn("slot", _slot("id")).join(_slots(spans), "slot", "left_semi").drop("slot")
        return near.hint("shuffle_merge").join(spans, "id")

    @staticmethod
    def _first(windows: DataFrame, docs: DataFrame) -> DataFrame:
        """(id, at) of the earliest window of each kind."""
        low, high = docs.agg(F.min("id"), F.max("id")).first()
        if low is not None and high - low < 2**33:
            # id and place fit one long, which a hash aggregate can keep the least of
            least = windows.groupBy("w", "c").agg(F.min(F.shiftleft(F.col("id") - F.lit(low), 30).bitwiseOR(F.col("at").cast("long"))).alias("p"))
            return least.select((F.shiftright("p", 30) + F.lit(low)).alias("id"), F.col("p").bitwiseAND(F.lit((1 << 30) - 1)).cast("int").alias("at"))
        return windows.groupBy("w", "c").agg(F.min(F.struct("id", "at")).alias("p")).select("p.id", "p.at")


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id isn't in ids (a table with column id).

    Only rows that share a hash slot with such an id are shuffled. Rows without an id stay.
    """
    marked = docs.withColumn("_slot", F.pmod(F.xxhash64(F.lit("slot"), F.col(id_col).cast("long")), F.lit(ID_SLOTS)))
    slots = _slots(ids).withColumnRenamed("slot", "_slot")
    near = marked.join(slots, "_slot", "left_semi")
    far = marked.join(slots, "_slot", "left_anti")
    listed = ids.select(F.col("id").alias("_id"))
    return far.unionByName(near.join(listed, F.col(id_col) == F.col("_id"), "left_anti")).drop("_slot")


def apply_decisions(docs: DataFrame, decisions: DataFrame, width: int, carry: tuple[str, ...] = (), keep_whole: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_text and the columns in `carry`) of every document.

    With keep_whole, a text that loses nothing stays as it is, white space included.
    """

    def run(batches):
        for part in chunks(batches, "text"):
            raw, offs = text_bytes(part.column(1))
            words = Words(raw, offs)
            text, start = _windows_of(words, part.column(2), width)
            kept = part.column(3)
            lens = np.nan_to_num(np.array(kept.value_lengths().to_pylist(), float)).astype(np.int64)
            first = words.word_offs[np.repeat(np.arange(len(lens)), lens)] + kept.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = words.word_offs[text] + start
            gone = place[~np.isin(place, first)]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + width, -1)
            stay = np.cumsum(edge[:-1]) == 0
            total = np.zeros(len(words) + 1, np.int64)
            np.cumsum(stay, out=total[1:])
            left = np.diff(total[words.word_offs])
            # kept words and one space after each; the last space of a text is cut off
            at = np.flatnonzero(stay)
            spaced = np.append(raw, np.uint8(32))
            bounds = np.stack([words.starts[at], words.ends[at], np.full(len(at), len(raw)), np.full(len(at), len(raw) + 1)], 1).reshape(-1, 2)
            size = bounds[:, 1] - bounds[:, 0]
            out = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=out[1:])
            joined = spaced[np.repeat(bounds[:, 0] - out[:-1], size) + np.arange(out[-1])]
            ends = out[2 * np.append(0, np.cumsum(left))]
            texts = [joined[a : b - 1].tobytes().decode() if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = words.counts
            if keep_whole:
                texts = [was if same else text for was, text, same in zip(part.column(1).to_pylist(), texts, (n == left).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - left), pa.array(texts, pa.string()), *part.columns[4:]], ["id", "n_words", "n_removed", "kept_text", *carry])

    marked = docs.withColumn("slot", _slot("id"))
    near = _slots(decisions)
    with_rows = marked.join(near, "slot", "left_semi").drop("slot").hint("shuffle_merge").join(decisions, "id", "left")
    kinds = decisions.schema
    rest = marked.join(near, "slot", "left_anti").drop("slot").select("id", "text", F.lit(None).cast(kinds["spans"].dataType).alias("spans"), F.lit(None).cast(kinds["kept"].dataType).alias("kept"), *carry)
    rows = with_rows.select("id", "text", "spans", "kept", *carry).unionByName(rest)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"id long, n_words long, n_removed long, kept_text string{more}")


def _one_text_an_id(rows: DataFrame) -> DataFrame:
    """rows with a column key: the id, or where ids stand for several texts a number in order of (id, text hash)."""
    texts = rows.select("id", F.xxhash64("text").alias("h"))
    pairs = cut(texts.distinct())
    if pairs.groupBy("id").count().where("count > 1").isEmpty():
        drop(pairs)
        return rows.withColumn("key", F.col("id"))
    numbered = cut(pairs.repartitionByRange(partitions_for(rows.sparkSession), "id", "h").sortWithinPartitions("id", "h").withColumn("key", F.monotonically_increasing_id()))
    drop(pairs)
    return cut(rows.withColumn("h", F.xxhash64("text")).join(numbered, ["id", "h"]).drop("h"))


def remove_repeats(docs: DataFrame, width: int = 20, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_whole: bool = False) -> DataFrame:
    """Remove each word covered by a window that also starts earlier in `docs`.

    Earlier is a smaller id, or a smaller place in the same document; windows are judged on the
    input. The documents enter a new index in `batches` ranges of ids. Columns: id (long),
    n_words, n_removed, kept_text (kept words joined by one space). Null and empty texts have
    no words; a null id counts as the smallest. Rows that repeat id and text all keep or lose
    the same words; rows that share an id but not their text are documents of their own, in
    order of a hash of the text. Other columns are left out, but for those named in `carry` (no
    name of a column used here). With keep_whole, a text that loses no word keeps its white
    space. An empty table gives no rows.
    """
    spark = docs.sparkSession
    full = _one_text_an_id(normal(docs, id_col, text_col, carry)).select(F.col("key").alias("id"), "text", *carry, F.col("id").alias("_id"))
    rows = full.select("id", "text")
    cuts = sorted({int(x) for x in rows.select("id").where(F.col("id") != _FIRST).approxQuantile("id", [i / batches for i in range(1, batches)], 0.001)}) if batches > 1 else []
    index = FingerprintIndex(spark, width)
    decisions, low = None, None
    try:
        for high in [*cuts, None]:
            inside = F.lit(True)
            if low is not None:
                inside = inside & (F.col("id") > low)
            if high is not None:
                inside = inside & (F.col("id") <= high)
            got = index.add(rows.where(inside), rows.where(F.col("id") <= low) if low is not None else None)
            decisions = got if decisions is None else decisions.unionByName(got)
            low = high
    finally:
        index.drop()
    done = apply_decisions(full, decisions, width, (*carry, "_id"), keep_whole)
    return done.select(F.when(F.col("_id") != _FIRST, F.col("_id")).alias(id_col), "n_words", "n_removed", "kept_text", *carry)
