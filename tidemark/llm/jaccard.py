"""Exact Jaccard join of word shingle sets by T-occurrence search.

1. Documents with equal sets form a class (grouped by set digest). Copies in the HEAVY largest
   classes send nothing further but their class's first document; copies in smaller classes
   send equal rows, which are counted once.
2. Every set has a prefix by a global order of its shingles, so long that two linked sets
   share a fixed number of shingles of their prefixes. Sets whose prefix has too few shingles
   that another prefix holds can't be linked and stop here; that is most of all documents.
   A shingle that a sample finds in many sets is known to be shared and isn't exchanged.
3. The shingles of the rest are counted; each set is looked up only under its rarest ones, as
   many as a linked set can't miss altogether.
4. Under each of these shingles, every set is tested against the list's most central set, the
   one with the fewest shingles of its own; linked sets grow into groups. Where a list still
   spans several groups, sets of the smaller group are searched in the larger one: its sets are
   split into blocks with inverted lists, and a search merges the short lists by a heap, probes
   the long ones by binary search for the candidates left (DivideSkip), and keeps those that
   reach the required overlap.
5. Components of all links found are the result. Pairs inside a group are never listed.
"""

from __future__ import annotations

from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.runtime import CHUNK_BYTES, chunks, cut, drop, partitions_for, release_memory, text_bytes
from tidemark.llm.substr import _FIRST, _slot, _slots, normal
from tidemark.llm.words import Words, gram_starts, grams, mix

#: Sets in one block of a search, and searches that meet one block in one task.
BLOCK = 512
#: Shared prefix shingles that are asked for, as a part of the set.
PREFIX_SHARE = 0.05
#: Classes whose copies are left out where texts are read (48 bytes each, broadcast).
HEAVY = 1 << 16
#: One of so many documents is looked at for shingles in at least HOT_SETS of them; the HOT_SHINGLES
#: most frequent are known to be shared (8 bytes each, broadcast). All others are exchanged.
HOT_PART, HOT_SETS, HOT_SHINGLES = 64, 16, 1 << 16


def _sets(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their offsets."""
    words = Words(raw, offs)
    h = words.hashes(lower=True)
    counts = words.counts
    starts = gram_starts(words.word_offs, k)
    values = grams(h, k)[starts] if len(starts) else np.zeros(0, np.uint64)
    text = words.texts()[starts] if len(starts) else np.zeros(0, np.int64)
    # fewer words than a shingle: the whole sequence is the one shingle
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.array([int(mix(np.array([np.uint64(counts[t])], np.uint64))[0]) for t in short], np.uint64)
        for i, t in enumerate(short):
            for j in range(words.word_offs[t], words.word_offs[t + 1]):
                own[i] = mix(own[i : i + 1] * np.uint64(3) + h[j : j + 1])[0]
        values, text = np.append(values, own), np.append(text, short)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(offs)))


def _sum_by(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _keys(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set."""
    return _sum_by(mix(values), offs), _sum_by(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offs)


def digests(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, k1, k2): size and digest of each document's shingle set."""

    def run(batches):
        for part in chunks(batches, "text"):
            values, offs = _sets(*text_bytes(part.column(1)), k)
            k1, k2 = _keys(values, offs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["id", "n", "k1", "k2"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, k1 long, k2 long")


class _Heavy:
    """The largest classes by their digest: which rows are copies of their first document."""

    def __init__(self, classes: DataFrame):
        rows = classes.where("m > 1").orderBy(F.desc("m"), "k1", "k2").limit(HEAVY).select("k1", "k2", "rep").collect()
        rows.sort(key=lambda r: r.k1)
        self.k1, self.k2, self.rep = (np.array([r[i] for r in rows], np.int64) for i in range(3))

    def copies(self, ids: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        if not len(self.k1):
            return np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.k1, k1.view(np.int64)), len(self.k1) - 1)
        return (self.k1[at] == k1.view(np.int64)) & (self.k2[at] == k2.view(np.int64)) & (self.rep[at] != ids)


def _asked(n, num: int, den: int):
    """Prefix shingles that a set of n shares at least with a linked set of its size or more."""
    return np.maximum(1, np.floor(n * PREFIX_SHARE)).astype(np.int64)


def prefixes(docs: DataFrame, k: int, num: int, den: int, heavy, hot=None) -> DataFrame:
    """(tok, key, r): the shingles of least hash of each set; key is the set's digest.

    Shingles in `hot` give no row of their own; one row with r, their number, and a made-up tok
    stands for those of a set. heavy and hot are broadcasts of a _Heavy and of a sorted array.
    """

    def run(batches):
        for part in chunks(batches, "text"):
            values, offs = _sets(*text_bytes(part.column(1)), k)
            n = np.diff(offs)
            key, second = _keys(values, offs)
            size = np.minimum(n, n + (-num * n) // den + _asked(n, num, den)) * (n > 0)
            size[heavy.value.copies(part.column(0).to_numpy(), key, second)] = 0
            at = np.zeros(len(n) + 1, np.int64)
            np.cumsum(size, out=at[1:])
            pick = np.repeat(offs[:-1] - at[:-1], size) + np.arange(at[-1])
            tok, owner = values[pick].view(np.int64), np.repeat(np.arange(len(n)), size)
            r = np.zeros(len(tok), np.int32)
            if hot is not None and len(hot.value):
                known = hot.value[np.minimum(np.searchsorted(hot.value, tok), len(hot.value) - 1)] == tok
                many = np.bincount(owner[known], minlength=len(n))
                some = np.flatnonzero(many)
                tok = np.concatenate([tok[~known], mix(key[some]).view(np.int64)])
                owner = np.concatenate([owner[~known], some])
                r = np.concatenate([r[~known], many[some].astype(np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(key[owner].view(np.int64)), pa.array(r)], ["tok", "key", "r"])

    return docs.select("id", "text").mapInArrow(run, "tok long, key long, r int")


def count_shared(rows: DataFrame) -> DataFrame:
    """(key, r) with the number of a set's prefix shingles that another set's prefix holds, in parts to be added up.

    rows: (tok, key, r) dealt by tok and sorted. They stream by; only the last one is held.
    """

    def run(batches):
        held = None  # the last row: tok, key, whether it is counted already
        for batch in batches:
            tok, key, r = (batch.column(i).to_numpy() for i in range(3))
            ready = r > 0
            if ready.any():
                whole = np.unique(np.stack([key[ready], r[ready].astype(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy())], ["key", "r"])
                tok, key = tok[~ready], key[~ready]
            if not len(tok):
                continue
            if held is not None:
                tok, key = np.append(held[0], tok), np.append(held[1], key)
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
            tok, key = tok[new], key[new]
            beside = tok[1:] == tok[:-1]
            shared = np.append(False, beside) | np.append(beside, False)
            counted = held is not None and held[2]
            held = tok[-1], key[-1], bool(shared[-1]) or (counted and len(tok) == 1)
            if counted:
                shared[0] = False
            if shared.any():
                keys, n = np.unique(key[shared], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "r"])
        release_memory()

    return rows.mapInArrow(run, "key long, r long")


def full_sets(docs: DataFrame, k: int, heavy) -> DataFrame:
    """(n, k1, k2, toks): the whole sorted set as packed 64-bit hashes."""

    def run(batches):
        for part in chunks(batches, "text"):
            values, offs = _sets(*text_bytes(part.column(1)), k)
            k1, k2 = _keys(values, offs)
            take = np.flatnonzero(~heavy.value.copies(part.column(0).to_numpy(), k1, k2))
            packed = [values[offs[i] : offs[i + 1]].tobytes() for i in take]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(offs)[take]), pa.array(k1[take].view(np.int64)), pa.array(k2[take].view(np.int64)), pa.array(packed, pa.binary())], ["n", "k1", "k2", "toks"])

    return docs.select("id", "text").mapInArrow(run, "n long, k1 long, k2 long, toks binary")


def _explode(sets: DataFrame) -> DataFrame:
    def run(batches):
        for part in batches:
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                raw, offs = text_bytes(rows.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), np.int64)), rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), np.diff(offs) // 8)))], ["tok", "id"])
        release_memory()

    return sets.select("id", "toks").mapInArrow(run, "tok long, id long")


def merge_lists(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in at least `least` of the sorted lists, and in how many; the lists are merged by a heap."""
    merged = np.fromiter(merge(*(x.tolist() for x in lists)), np.int64, sum(map(len, lists)))
    first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(merged)))
    return merged[first[n >= least]], n[n >= least]


def divide_skip(members: list[np.ndarray], queries: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(query, member) for each query that has a linked member: one member, the first found.

    Sets are sorted arrays. For a query of n shingles the required overlap T is at least
    num * n / den; the T - 1 longest lists at most are left out of the merge and probed.
    """
    sizes = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    tokens, first = np.unique(flat, return_index=True)
    ends = np.append(first, len(flat))
    probe = np.searchsorted(tokens, flat) * len(members) + owner  # sorted: (list, member)
    out = []
    for q, toks in enumerate(queries):
        n = len(toks)
        need = -(-num * n // den)
        at = np.searchsorted(tokens, toks)
        at[at == len(tokens)] = 0
        lists = at[tokens[at] == toks]
        if len(lists) < need:
            continue
        lengths = ends[lists + 1] - ends[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        skip = min(need - 1, int((lengths > 8).sum()))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        fits = (sizes * num <= n * den) & (n * num <= sizes * den)
        left, seen = merge_lists([owner[ends[x] : ends[x + 1]] for x in short], max(1, need - skip))
        left, seen = left[fits[left]], seen[fits[left]]
        if not len(left):
            continue
        if skip:
            keys = (long[:, None] * len(members) + left).ravel()
            hit = np.searchsorted(probe, keys)
            hit[hit == len(probe)] = 0
            seen = seen + (probe[hit] == keys).reshape(len(long), -1).sum(0)
        linked = left[seen * den >= (n + sizes[left] - seen) * num]
        if len(linked):
            out.append((q, int(linked[0])))
    return out


def _search(queries: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between queries (g, id) and members (g, id) of the same g.

    Members of a g are dealt into blocks and queries into portions of about BLOCK rows, by
    their ids; each portion meets each block in a task of its own.
    """
    q = queries.groupBy("g").agg(F.count("*").alias("nq"))
    m = members.groupBy("g").agg(F.count("*").alias("nm"))
    size = cut(q.join(m, "g").select("g", F.ceil(F.col("nq") / BLOCK).alias("nq"), F.ceil(F.col("nm") / BLOCK).alias("nm")))
    part = lambda n: F.pmod(F.xxhash64(F.lit("part"), F.col("id")), F.col(n))
    left = queries.join(size, "g").select("g", "id", part("nq").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)).alias("mb"), F.lit(True).alias("is_query"))
    right = members.join(size, "g").select("g", "id", part("nm").alias("mb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"), F.lit(False).alias("is_query"))
    rows = left.unionByName(right).join(sets.select("id", "toks"), "id")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        ask = table.column("is_query").to_numpy(zero_copy_only=False)
        toks = [np.frombuffer(t.as_py(), np.uint64) for t in table.column("toks")]
        qi, mi = np.flatnonzero(ask), np.flatnonzero(~ask)
        found = divide_skip([toks[i] for i in mi], [toks[i] for i in qi], num, den) if len(qi) and len(mi) else []
        if table.nbytes > CHUNK_BYTES:  # a task has very many small ones
            release_memory()
        return pa.table({"a": pa.array([ids[qi[x]] for x, _ in found], pa.int64()), "b": pa.array([ids[mi[y]] for _, y in found], pa.int64())})

    return rows.groupBy("g", "qb", "mb").applyInArrow(run, "a long, b long").where("a <> b")


def link(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard of num/den or more.

    Columns: the id column (long), n_shingles, component_id (least id reachable by links, itself
    included). Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer than k
    words has its whole sequence as one shingle; null and empty texts have none and are linked
    with nothing. A null id counts as the smallest and stays null. Repeated rows are copies; rows
    that share an id but not their text are documents of their own. Other columns are left out.
    An empty table gives no rows.
    """
    rows = normal(docs, id_col, text_col)
    sized = cut(digests(rows, k))
    classes = sized.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    links, used = _links(rows, classes, k, num, den)
    found = components(links)
    drop(*used)
    # a class without links is its own component; the others take the least id of theirs
    linked = cut(classes.join(found.withColumnRenamed("id", "node"), "node").select("k1", "k2", "n", "rep", "component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    own = cut(linked.join(least, "component").select("k1", "k2", "n", "least").unionByName(classes.where("m > 1").join(linked, ["k1", "k2", "n"], "left_anti").select("k1", "k2", "n", F.col("rep").alias("least"))))
    drop(linked, classes)
    # both sides are plain tables, so that a class of very many copies is split over tasks
    named = sized.join(own, ["k1", "k2", "n"], "left")
    real = lambda c: F.when(c != _FIRST, c)
    return named.select(real(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), real(F.coalesce("least", "id")).alias("component_id"))


def _need(n: Column, num: int, den: int) -> Column:
    smallest = F.ceil(n * num / den)
    return F.greatest(F.lit(1), F.floor(smallest * PREFIX_SHARE))


def _links(rows: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between nodes of classes, and the tables that they are read from."""
    spark = rows.sparkSession
    heavy = spark.sparkContext.broadcast(_Heavy(classes))
    sample = prefixes(rows.where(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(HOT_PART)) == 0), k, num, den, heavy)
    hot = sample.groupBy("tok").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= HOT_SETS).orderBy(F.desc("n"), "tok").limit(HOT_SHINGLES)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.tok for r in hot.collect()], np.int64)))
    dealt = prefixes(rows, k, num, den, heavy, hot).repartition(partitions_for(spark), "tok").sortWithinPartitions("tok", "key")
    shared = cut(count_shared(dealt).groupBy("key").agg(F.sum("r").alias("r")))
    alive = cut(classes.join(shared.withColumnRenamed("key", "k1"), "k1").where(F.col("r") >= _need(F.col("n"), num, den)).select("node", "rep", "k1", "k2", "n"))
    near = rows.withColumn("slot", _slot("id")).join(_slots(alive.select(F.col("rep").alias("id"))), "slot", "left_semi").select("id", "text")
    each = full_sets(near, k, heavy).groupBy("k1", "k2", "n").agg(F.first("toks").alias("toks"))
    sets = cut(each.join(alive.select("node", "k1", "k2", "n"), ["k1", "k2", "n"]).select(F.col("node").alias("id"), "n", "toks"))
    drop(shared, alive)
    each = _explode(sets)
    often = cut(each.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"))
    listed = each.join(often, "tok").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"))
    # of the rarest n - ceil(n * num / den) + 1 shingles, those that no other set holds come first
    quota = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("l.toks"))
    routed = listed.alias("l").join(sets.select("id", "n"), "id").withColumn("quota", quota.cast("int")).where("quota > 0")
    # r: shingles that some other set holds too; no link can share more
    lists = cut(routed.select("id", "n", F.size("l.toks").alias("r"), F.explode(F.slice("l.toks", F.lit(1), F.col("quota"))).alias("t")).select("id", "n", "r", "t.tok"))
    drop(often)
    can = lambda n, r, m, q: F.least(r, q) * (num + den) >= F.lit(num) * (F.col(n) + F.col(m))
    # a list's first set is the one with the smallest part of shingles of its own
    heads = lists.groupBy("tok").agg(F.min_by(F.struct("id", "n", "r"), F.struct((F.col("n") - F.col("r")) / F.col("n"), "id")).alias("h"), F.count("*").alias("m")).where("m > 1")
    heads = cut(heads.select("tok", F.col("h.id").alias("g"), F.col("h.n").alias("gn"), F.col("h.r").alias("gr")))
    asks = cut(lists.join(heads, "tok").where((F.col("id") != F.col("g")) & can("n", "r", "gn", "gr")).select("g", "id").distinct())
    first = cut(_search(asks, asks.select("g", F.col("g").alias("id")).distinct(), sets, num, den))
    drop(heads, asks)
    groups = cut(components(first))
    placed = lists.join(groups, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    stats = cut(placed.select("id", "n", "r", "c").distinct().groupBy("c").agg(F.count("*").alias("size"), F.min("n").alias("least_n"), F.max("r").alias("most_r")))
    mixed = cut(placed.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("tok"))
    held, placed = lists, cut(placed.join(mixed, "tok").join(stats.select("c", "size"), "c"))
    drop(held, mixed)
    other = cut(placed.select("tok", F.col("c").alias("g")).distinct().join(stats.select(F.col("c").alias("g"), F.col("size").alias("gsize"), "least_n", "most_r"), "g"))
    rank = lambda c, s: F.struct(F.col(s).alias("s"), F.col(c).alias("c"))
    asks = cut(placed.join(other, "tok").where((rank("c", "size") < rank("g", "gsize")) & can("n", "r", "least_n", "most_r")).select("g", "id").distinct())
    drop(placed, other, stats)
    whole = groups.select(F.col("component").alias("g"), "id").unionByName(sets.join(groups, "id", "left_anti").select(F.col("id").alias("g"), "id"))
    second = cut(_search(asks, whole.join(asks.select("g").distinct(), "g", "left_semi"), sets, num, den))
    drop(asks, groups, sets)
    return first.unionByName(second), [first, second]
