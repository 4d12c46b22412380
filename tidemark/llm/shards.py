"""Histogram sort into shards of equal bytes, with DataFrame functions only.

Rows are ordered by (hash of the text, row id). Each round counts the exact bytes below
candidate key boundaries: one aggregation over the cells that still hold a splitter, each cut
into 2**STEP_BITS smaller cells by the next bits of the key. A splitter is settled on the
first boundary within the tolerance of its target; when the bits of the text hash are used up
(one text with more bytes than the tolerance), the row ids inside that text are refined alike.
Then the rows are exchanged once, each to the partition that its splitters name. The driver holds at most (shards - 1) * 2**STEP_BITS counts.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, partitions_for

#: Bits that one round adds to the candidate boundaries.
STEP_BITS = 10
_MIN = -(2**63)


def _refine(rows: DataFrame, key: str, size: str, lo_below: dict, targets: dict, tolerance: float, whole: float) -> tuple[dict, dict]:
    """Settle splitters over a signed 64-bit key.

    lo_below: bytes below the whole key range, by target group; targets: splitter -> (group, bytes).
    A boundary beside one key may be off by `whole`, which is the larger of the two tolerances.
    rows has columns grp, key, size. Returns settled {splitter: boundary} and, for splitters
    inside one key, {splitter: (key, bytes below that key)}.
    """
    settled, stuck = {}, {}
    # a cell: (group, prefix of `bits` bits); below: exact bytes below its lower end
    cells = {(g, 0): (lo_below[g], [s for s, (h, _) in targets.items() if h == g]) for g in lo_below}
    bits = 0
    while cells:
        step = min(STEP_BITS, 64 - bits)
        groups = sorted({g for g, _ in cells})
        prefix = F.shiftright(F.col(key), 64 - bits) + F.lit(1 << (bits - 1)) if bits else F.lit(0).cast("long")
        finer = F.shiftright(F.col(key), 64 - bits - step) + F.lit(1 << (bits + step - 1)) if bits + step < 64 else F.col(key)
        wanted = rows.withColumn("_cell", prefix).withColumn("_fine", finer)
        keys = [f"{g}:{p}" for g, p in cells]
        wanted = wanted.where(F.concat_ws(":", "grp", "_cell").isin(keys)) if bits else wanted.where(F.col("grp").isin(groups))
        counts: dict = {}
        for r in wanted.groupBy("grp", "_cell", "_fine").agg(F.sum(size).alias("b")).collect():
            counts.setdefault((r.grp, r._cell), []).append((r._fine, r.b))
        bits += step
        after: dict = {}
        for cell, (below, splitters) in cells.items():
            ladder = [(below, None)]
            for fine, b in sorted(counts.get(cell, [])):
                ladder.append((ladder[-1][0] + b, fine))
            ends = [x for x, _ in ladder]
            for s in splitters:
                want = targets[s][1]
                at = min(max(1, bisect_left(ends, want)), len(ladder) - 1)
                low, high = ladder[at - 1][0], ladder[at][0]
                fine = ladder[at][1]
                signed = fine - (1 << (bits - 1)) if bits < 64 else fine
                lower, upper = signed << (64 - bits), (signed + 1) << (64 - bits)
                near = (low, lower) if want - low <= high - want else (high, upper)
                if abs(near[0] - want) <= tolerance:
                    settled[s] = near[1]
                elif bits == 64 and abs(near[0] - want) <= whole:
                    settled[s] = near[1]
                elif bits == 64:
                    stuck[s] = (fine, low)
                else:
                    entry = after.setdefault((cell[0], fine), (low, []))
                    entry[1].append(s)
        cells = after
    return settled, stuck


def _shard_of(h: Column, d: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below the row, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bh, bd = bounds[mid]
        below = h < F.lit(bh) if bd == _MIN else (h < F.lit(bh)) | ((h == F.lit(bh)) & (d < F.lit(bd)))
        return F.when(below, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds)).cast("int")


def shard(docs: DataFrame, shards: int, overhead: int = 16, tolerance: float = 0.002, whole_text: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put rows into shards 0..shards-1 of nearly equal bytes.

    Columns: the id column (long), size (UTF-8 bytes of the text, null: none, plus `overhead`),
    text_crc32, shard, slot. Every boundary lies within `tolerance` of a shard's share from its
    target, or between two neighbouring rows if one row is larger than that. Equal texts stay
    together where that moves a boundary by no more than `whole_text` of a share. Slots count
    0, 1, ... in each shard along (text hash, row id). Null texts are one group, null ids come
    first; rows that repeat take a slot each; an empty table gives no rows; other columns are
    left out. The texts themselves aren't moved: join the result to them to write the shards.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    slim = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(_MIN)).alias("d"),
        )
    )
    total = slim.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    targets = {s: (0, (s + 1) * share) for s in range(shards - 1)}
    bounds: dict = {}
    if total:
        settled, stuck = _refine(slim.select(F.lit(0).cast("long").alias("grp"), "h", "size"), "h", "size", {0: 0}, targets, tolerance * share, whole_text * share)
        bounds = {s: (b, _MIN) for s, b in settled.items()}
        if stuck:
            texts = sorted({h for h, _ in stuck.values()})
            inner = slim.where(F.col("h").isin(texts)).select(F.col("h").alias("grp"), "d", "size")
            fixed, single = _refine(inner, "d", "size", {h: b for h, b in stuck.values()}, {s: (h, targets[s][1]) for s, (h, _) in stuck.items()}, tolerance * share, tolerance * share)
            bounds |= {s: (stuck[s][0], b) for s, b in fixed.items()} | {s: (stuck[s][0], d) for s, (d, _) in single.items()}
    ends = sorted((b if b[0] < 2**63 else (2**63 - 1, 2**63 - 1)) for b in bounds.values())
    ends = [(h, min(d, 2**63 - 1)) for h, d in ends]
    placed = slim.withColumn("shard", _shard_of(F.col("h"), F.col("d"), ends))
    # the one exchange of rows, by the settled splitters themselves: a shard is one partition or, where there are
    # fewer shards than partitions, a few ranges of its keys; a row's place in its partition gives the slot
    parts = -(-partitions_for(spark) // shards)
    low, high = F.array(*[F.lit(float(h)) for h in [_MIN, *(h for h, _ in ends)]]), F.array(*[F.lit(float(h)) for h in [*(h for h, _ in ends), 2**63]])
    width = F.get(high, F.col("shard")) - F.get(low, F.col("shard"))
    inner = F.when(width > 0, F.floor((F.col("h").cast("double") - F.get(low, F.col("shard"))) / width * parts)).otherwise(0)
    part = F.col("shard") * parts + F.least(F.greatest(inner, F.lit(0)), F.lit(parts - 1))
    dealt = placed.repartitionById(shards * parts, part.cast("int")).sortWithinPartitions("h", "d", "size")
    at = F.monotonically_increasing_id()
    dealt = cut(dealt.withColumn("_task", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    # tasks * shards rows at most, in fact tasks + shards: each task holds a range of shards
    runs = [(r._task, r.shard, r.first, r.n) for r in dealt.groupBy("_task", "shard").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()]
    seen: dict = {}
    shifts = []
    for task, s, first, n in sorted(runs):
        shifts.append((task, s, seen.get(s, 0) - first))
        seen[s] = seen.get(s, 0) + n
    table = spark.createDataFrame(shifts, "_task long, shard int, _shift long")
    return dealt.join(F.broadcast(table), ["_task", "shard"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("_at") + F.col("_shift")).alias("slot")
    )
