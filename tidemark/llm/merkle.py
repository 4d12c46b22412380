"""Merkle manifest of a table: a hash tree over each group's rows and one over the groups.

Bitmap-rank indexing: every task turns the row ids it reads into compressed bitmaps, one a group
and run of 4,096 ids; these are merged and get a directory of popcounts, and a running sum over
them gives the rank of their first row. A row's place among its group's leaves is then a rank
query (directory entry plus popcount of the bits before), with no sort of the rows. Leaves go
into slot arrays of 1,024 keyed by (group, place >> 10); a task reduces an array by ten
levels, and the arrays' own tops are the leaves of the next round. What goes back down is one
path of siblings for each array, to which each leaf adds those inside its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.runtime import cut, drop
from tidemark.operators.lineage import numbered, running_sums

#: Ids of a bitmap, and levels that one slot array is reduced by.
CHUNK_BITS, LEVELS = 12, 10
SPAN, FULL = 1 << CHUNK_BITS, 1 << (CHUNK_BITS - 3)
#: Ids that a task turns into bitmaps at a time.
ROWS = 1 << 19


def field(column: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


# -- bitmaps ------------------------------------------------------------------------------------


def pack_ids(low: np.ndarray) -> bytes:
    """Sorted distinct numbers below SPAN: as they are, or as a bitmap where that is smaller."""
    if 2 * len(low) < FULL:
        return low.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_ids(blob: bytes) -> np.ndarray:
    if len(blob) < FULL:
        return np.frombuffer(blob, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8), bitorder="little"))


def directory(blob: bytes) -> np.ndarray:
    """Bits set before each 64-bit word of a bitmap."""
    counts = np.bitwise_count(np.frombuffer(blob, "<u8")).astype(np.int64)
    return np.cumsum(counts) - counts


def rank(blob: bytes, ahead: np.ndarray | None, low: np.ndarray) -> np.ndarray:
    """How many numbers of the packed set are less than each of `low`."""
    if ahead is None:
        return np.searchsorted(np.frombuffer(blob, "<u2"), low)
    words = np.frombuffer(blob, "<u8")[low >> 6]
    below = words & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
    return ahead[low >> 6] + np.bitwise_count(below).astype(np.int64)


_BITMAP = "grp string, chunk long, n long, bits binary, again array<int>, more array<long>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("again", pa.list_(pa.int32())), ("more", pa.list_(pa.int64()))])


def _own_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the ids that a task reads; ids met again are listed with how often."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        coded = table.column(0).combine_chunks().dictionary_encode()
        names = [None, *coded.dictionary.to_pylist()]
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
        ids = table.column(1).to_numpy()
        order = np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        first = np.ones(len(ids), bool)
        first[1:] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(ids)))
        code, ids = code[at], ids[at]
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (ids[1:] >> CHUNK_BITS != ids[:-1] >> CHUNK_BITS)) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            low, n = ids[a:b] & (SPAN - 1), times[a:b]
            out.append((names[code[a]], int(ids[a]) >> CHUNK_BITS, int(n.sum()), pack_ids(low), low[n > 1].tolist(), (n[n > 1] - 1).tolist()))
        return _batch(out, _ARROW)

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            yield flush(held)
            held, rows = [], 0
    if held:
        yield flush(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap for each (grp, chunk) of bitmaps that come sorted by these."""

    def merge(parts: list[tuple]) -> tuple:
        if len(parts) == 1:
            return parts[0]
        times = np.zeros(SPAN, np.int64)
        for _, _, _, bits, again, more in parts:
            times[unpack_ids(bits)] += 1
            np.add.at(times, again, more)
        low = np.flatnonzero(times)
        again = np.flatnonzero(times > 1)
        return (*parts[0][:2], int(times.sum()), pack_ids(low), again.tolist(), (times[again] - 1).tolist())

    held: list[tuple] = []
    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                done.append(merge(held))
                held = []
            held.append(row)
        if done:
            yield _batch(done, _ARROW)
    if held:
        yield _batch([merge(held)], _ARROW)


def bitmaps(rows: DataFrame) -> DataFrame:
    """(grp, chunk, n, bits, again, more, base) of rows (grp, id): merged bitmaps and the rank of their first row.

    n counts rows; ids with several rows are in `again` with the rows beyond the first in `more`.
    Null ids are a chunk of their own (null), before the others.
    """
    known = rows.where("id is not null").select("grp", "id").mapInArrow(_own_bitmaps, _BITMAP)
    whole = cut(known.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk").mapInArrow(_merged, _BITMAP))
    nulls = rows.where("id is null").groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit(None).cast("long").alias("chunk"), "n")
    sizes = whole.select("grp", "chunk", "n").unionByName(nulls)
    bases = running_sums(sizes, ["grp"], ["chunk"], {"base": "n"}).select(F.col("grp").alias("_g"), F.col("chunk").alias("_c"), "base")
    return whole.join(bases, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("chunk") == F.col("_c"))).drop("_g", "_c")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of rows that come after their bitmap in a stream sorted by (grp, chunk, kind)."""
    bits = ahead = again = extra = None
    base = 0
    schema = pa.schema([("grp", pa.string()), ("id", pa.int64()), ("leaf", pa.binary()), ("claim", pa.binary()), ("slot", pa.int64())])
    for batch in batches:
        kind = batch.column(2).to_numpy()
        heads = np.flatnonzero(kind == 0)
        spans = [(-1, 0, int(heads[0]) if len(heads) else batch.num_rows)]
        spans += [(int(h), int(h) + 1, int(e)) for h, e in zip(heads, [*heads[1:], batch.num_rows])]
        for head, a, b in spans:
            if head >= 0:
                bits, base = batch.column(6)[head].as_py(), batch.column(9)[head].as_py()
                ahead = directory(bits) if len(bits) >= FULL else None
                again = np.array(batch.column(7)[head].as_py(), np.int64)
                extra = np.concatenate([[0], np.cumsum(np.array(batch.column(8)[head].as_py(), np.int64))])
            if a < b:
                part = batch.slice(a, b - a)
                low = part.column(3).to_numpy() & (SPAN - 1)
                slot = base + rank(bits, ahead, low) + extra[np.searchsorted(again, low)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), part.column(5), pa.array(slot, pa.int64())], schema=schema)


def slots(rows: DataFrame) -> DataFrame:
    """rows (grp, id, leaf, claim) with slot: the place 0, 1, ... among the group's rows by (id, leaf), null ids first.

    rows is read twice and should be a written table. Only rows whose id is null or stands in
    several rows of its group are sorted, to be told apart.
    """
    maps = cut(bitmaps(rows))
    often = cut(maps.where("size(again) > 0").select("grp", F.explode("again").alias("low"), "chunk", "base").select(F.col("grp").alias("_g"), (F.shiftleft("chunk", CHUNK_BITS) + F.col("low")).alias("_i")))
    same = F.col("grp").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i"))
    single, several = rows.where("id is not null"), not often.isEmpty()
    asked = single
    if several:
        asked = single.join(often, same, "left_anti").unionByName(often.select(F.col("_g").alias("grp"), F.col("_i").alias("id"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("claim")))
    empty = {"bits": "binary", "again": "array<int>", "more": "array<long>", "base": "long"}
    ask = asked.select("grp", F.shiftright("id", CHUNK_BITS).alias("chunk"), F.lit(1).alias("kind"), "id", "leaf", "claim", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    head = maps.select("grp", "chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("claim"), *empty)
    dealt = head.unionByName(ask).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "kind")
    placed = cut(dealt.mapInArrow(_ranked, "grp string, id long, leaf binary, claim binary, slot long"))
    drop(maps)
    out = placed.where("leaf is not null")
    if several:
        base = placed.where("leaf is null").select(F.col("grp").alias("_g"), F.col("id").alias("_i"), "slot")
        out = out.unionByName(_in_order(single.join(base, same).drop("_g", "_i")))
    unnamed = rows.where("id is null")
    if not unnamed.isEmpty():
        out = out.unionByName(_in_order(unnamed.withColumn("slot", F.lit(0).cast("long"))))
    return out


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows that share (grp, slot) told apart by their leaf: slots count on from the shared one."""
    tagged = cut(rows.withColumn("_tag", F.monotonically_increasing_id()))  # so that equal rows can be in several ranges
    nth = numbered(tagged, ["grp", "slot", "leaf", "_tag"], "_nth")
    first = nth.groupBy(F.col("grp").alias("_g"), F.col("slot").alias("_s")).agg(F.min("_nth").alias("_first"))
    nth = nth.join(first, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("slot") == F.col("_s")))
    return nth.select("grp", "id", "leaf", "claim", (F.col("slot") + F.col("_nth") - F.col("_first")).alias("slot"))


# -- trees --------------------------------------------------------------------------------------


def _h(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def levels_of(nodes: list[str], size: int) -> list[list[str]]:
    """The levels over one slot array, itself first, of a group of `size` nodes on its level.

    Where the group has further arrays, the array goes up by LEVELS levels even if it is short.
    """
    out = [nodes]
    while len(out) <= LEVELS if size > 1 << LEVELS else len(out[-1]) > 1:
        row = out[-1]
        out.append([_h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[str]:
    """Siblings of node i, one a level: `<hex` left of it, `>hex` right of it, `.` where there is none."""
    out = []
    for row in levels[:-1]:
        j = i ^ 1
        out.append("." if j >= len(row) else ("<" if j < i else ">") + row[j])
        i >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    """What a node becomes along a path of siblings."""
    for step in path:
        node = _h(node) if step == "." else _h(step[1:], node) if step[0] == "<" else _h(node, step[1:])
    return node


def _each(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Each row as a batch of one and its values of these columns; one slot array is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield (row, *(row.column(n)[0].as_py() for n in names))


def _arrays(nodes: DataFrame, *carried: str) -> DataFrame:
    """Slot arrays of nodes (grp, slot, size, node): (grp, block, size, cells), with the top of each."""
    cells = F.sort_array(F.collect_list(F.struct("slot", "node", *carried))).alias("cells")
    packed = nodes.withColumn("block", F.shiftright("slot", LEVELS)).groupBy("grp", "block").agg(F.first("size").alias("size"), cells)

    def top(batches):
        for row, cells, size in _each(batches, "cells", "size"):
            apex = bytes.fromhex(levels_of([c["node"].hex() for c in cells], size)[-1][0])
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([apex], pa.binary())], [*row.schema.names, "top"])

    packed = packed.select("grp", "block", "cells", "size")
    return packed.mapInArrow(top, StructType([*packed.schema.fields, StructField("top", BinaryType())]))


def _tree(nodes: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Slot arrays of the nodes, and (grp, block, path, apex) for each of them: the way from its top to the group's."""
    packed = cut(_arrays(nodes, *carried))
    tops = packed.select("grp", "block", "top", "size")
    if tops.where("block > 0").isEmpty():
        return packed, tops.select("grp", "block", F.lit("").alias("path"), F.col("top").alias("apex"))
    up, above = _tree(tops.select("grp", F.col("block").alias("slot"), F.shiftright(F.col("size") + ((1 << LEVELS) - 1), LEVELS).alias("size"), F.col("top").alias("node")))
    return packed, cut(_unfold(up, above))


def _joined(packed: DataFrame, above: DataFrame, *columns: str) -> DataFrame:
    other = above.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), *columns)
    return packed.join(other, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")


def _unfold(packed: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, block, path, apex) of each cell of slot arrays, its slot being the block of the level below."""

    def run(batches):
        for _, grp, cells, size, path, apex in _each(batches, "grp", "cells", "size", "path", "apex"):
            levels = levels_of([c["node"].hex() for c in cells], size)
            paths = ["".join(path_of(levels, i)) + path for i in range(len(cells))]
            places = [c["slot"] for c in cells]
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(cells), pa.string()), pa.array(places, pa.int64()), pa.array(paths, pa.string()), pa.array([apex] * len(cells), pa.binary())], ["grp", "block", "path", "apex"])

    return _joined(packed, above, "path", "apex").mapInArrow(run, "grp string, block long, path string, apex binary")


def steps_of(path: str) -> list[str]:
    """A joined path as its steps."""
    out, at = [], 0
    while at < len(path):
        to = at + (1 if path[at] == "." else 65)
        out.append(path[at:to])
        at = to
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """Proof of every leaf of rows (grp string, id long, leaf binary, claim binary).

    Each group's leaves ascend by id (null first, equal ids by leaf) under a tree whose nodes are
    sha256 of two neighbours' hex digests, or of one where no second is left; the groups' roots,
    ordered by group (null first), stand under a tree of the same kind. Returns grp, id, slot,
    leaf, subroot, root, proof_sha256 (of all siblings, leaf to root), folded_root (what the claim,
    or the leaf where that is null, becomes along them) and verified (folded_root = root).
    Repeated rows are leaves of their own; no rows give no rows. The longest path held is a few
    dozen digests for one slot array; no task holds more than one array and its cells.
    """
    rows = cut(leaves.select("grp", F.col("id").cast("long").alias("id"), "leaf", "claim"))
    size = rows.groupBy(F.col("grp").alias("_g")).agg(F.count("*").alias("size"))
    placed = slots(rows).join(size, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    packed, above = _tree(placed.withColumnRenamed("leaf", "node"), "id", "claim")
    tops = cut(above.select("grp", "apex").distinct())
    # the tree over the groups: one group of their roots
    ranked = numbered(tops, ["grp"], "nth").select(F.lit("").alias("grp"), (F.col("nth") - 1).alias("slot"), F.lit(tops.count()).cast("long").alias("size"), F.col("apex").alias("node"), F.col("grp").alias("name"))
    roots, over = _tree(ranked, "name")

    def of_groups(batches):
        for _, cells, n, path, apex in _each(batches, "cells", "size", "path", "apex"):
            levels = levels_of([c["node"].hex() for c in cells], n)
            paths = ["".join(path_of(levels, i)) + path for i in range(len(cells))]
            yield pa.RecordBatch.from_arrays([pa.array([c["name"] for c in cells], pa.string()), pa.array(paths, pa.string()), pa.array([apex] * len(cells), pa.binary())], ["_n", "on", "root"])

    ends = cut(_joined(roots, over, "path", "apex").mapInArrow(of_groups, "_n string, on string, root binary"))
    above = above.join(ends, F.col("grp").eqNullSafe(F.col("_n"))).drop("_n")

    def prove(batches):
        names = ["grp", "id", "slot", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_()]
        bare = str.maketrans("", "", "<>.")
        for _, grp, cells, size, path, apex, on, root in _each(batches, "grp", "cells", "size", "path", "apex", "on", "root"):
            levels = levels_of([c["node"].hex() for c in cells], size)
            higher, subroot, root = steps_of(path + on), apex.hex(), root.hex()
            tail, known, out = (path + on).translate(bare), {}, []
            for i, c in enumerate(cells):
                own = path_of(levels, i)
                proof = _h("".join(own).translate(bare), tail)
                top = fold((c["claim"] or c["node"]).hex(), own)
                if top not in known:  # of most leaves of an array it's the array's top
                    known[top] = fold(top, higher)
                out.append((grp, c["id"], c["slot"], c["node"].hex(), subroot, root, proof, known[top], known[top] == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _joined(packed, above, "path", "apex", "on", "root").mapInArrow(prove, "grp string, id long, slot long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(grp, id, leaf, claim) of documents: the claim is the leaf with n_chars one higher where `tampered` holds, else null.

    A null n_chars stays null, and so its claim is its leaf. All five fields may be null.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    other = [*fields[:3], F.col("n_chars").cast("long") + 1, fields[4]]
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), digest(fields).alias("leaf"), F.when(tampered, digest(other)).alias("claim"))
