"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: one record a page, as a line of a text file whose line separator is the blank line that
ends a record, so that executors commit archives as they commit any table. Equal payloads are
stored once; the others are `revisit` records that point to it.

Reading: the text reader splits the archives where a record may begin, at each blank line
before `WARC/1.`; a payload may hold the same bytes. A task emits each such candidate with the
offset at which its own length says the next record begins. Offsets are relative to the file's split until the
bytes of each split are summed up; then each split's candidates are followed to the offset at
which they leave it, these exits are chained by pointer jumping from the start of every file, and
inside a split the candidates on the way are marked. The others lie in payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, drop, ensure_checkpoint_dir, partitions_for

#: What parts the archives into candidates, and the part of it that belongs to the record after it.
SEPARATOR, MAGIC = "\r\n\r\nWARC/1.", b"WARC/1."
END = "\r\n\r\n"
_FIELD = re.compile(rb"^([\w-]+):[ \t]*(.*?)[ \t]*$", re.M)


# -- writing ------------------------------------------------------------------------------------


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def _place(id_col: Column, url: Column) -> Column:
    """What orders pages: nulls last."""
    return F.struct(id_col.isNull().alias("a"), id_col.alias("page_id"), url.isNull().alias("b"), url.alias("url"))


def _record_id(page_id: Column, url: Column, copy: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), copy.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with copy, first and repeated: what decides each page's record.

    Of pages with equal payloads of at least least_bytes bytes the one with the least
    page_id (then url; nulls last) is the response; `first` is its place. Rows that repeat wholly
    are numbered by `copy` from 1, of which the first may be the response. Payloads meet by
    digest only, counted before they are shuffled; a group of any size is one row then. Pages are
    joined to the groups that have several members: a broadcast where these are few enough for
    Spark, else a join that splits a hot digest.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("_key"), F.octet_length(html).alias("_n"))
    met = own.where(F.col("_n") >= least_bytes).groupBy("_key").agg(F.min(_place(F.col("page_id"), F.col("url"))).alias("first"), F.count("*").alias("_members"))
    groups = cut(met.where("_members > 1").select("_key", "first"))
    same = F.col("l._key") == F.col("r._key")
    rows = own.alias("l").join(groups.alias("r"), same, "left").select("l.*", "first").withColumn("copy", F.lit(1).cast("long"))
    repeats = cut(own.join(groups.select("_key"), "_key", "left_semi").groupBy("_key", "page_id", "url").count().where("count > 1").drop("count").selectExpr("_key as _k", "page_id as _p", "url as _u"))
    if repeats.isEmpty():
        return rows
    wholly = (F.col("_key") == F.col("_k")) & F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u"))
    once = rows.join(repeats, wholly, "left_anti")
    again = rows.join(repeats, wholly, "left_semi").groupBy("page_id", "url", "html", "_key", "_n", "first").agg(F.count("*").alias("times"))
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
    return once.unionByName(again)


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """(value): each page as a WARC record without the blank line that ends it."""
    rows = decide(pages, least_bytes)
    own = _place(F.col("page_id"), F.col("url"))
    revisit = F.col("first").isNotNull() & ~(own.eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    revisit = F.coalesce(revisit, F.lit(False))
    # control characters would end a header line
    uri = F.coalesce(F.regexp_replace(F.regexp_replace("url", "%", "%25"), r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    id_of = _record_id(F.col("page_id"), F.col("url"), F.col("copy"), F.col("_key"))
    first_id = _record_id(F.col("first.page_id"), F.col("first.url"), F.lit(1), F.col("_key"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), id_of, F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\n"), _line("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), first_id, F.lit("\r\n"), _line("X-Refers-To-Page-Id", F.col("first.page_id").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write pages (page_id, url, html; other columns are left out) as WARC files, one a task.

    A null html is an empty payload, a null url `urn:none`, a null page_id leaves its header out;
    every row gets a record, repeated rows too. No rows give archives without a record.
    """
    records(pages, least_bytes=least_bytes).write.option("lineSep", END).text(folder)


# -- reading ------------------------------------------------------------------------------------

_PIECE = "path string, split long, rel long, n long, size long, type string, record_id string, target_uri string, content_type string, page_id long, refers_to_id string, refers_to long, declared_digest string, head long, length long, payload_bytes long, payload_digest string"
_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _PIECE.split(", "))])


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike by all scans inside, also when executors come or go."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key)
    spark.conf.set(key, before or str(partitions_for(spark)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _number(raw: bytes | None) -> int | None:
    return int(raw) if raw is not None and re.fullmatch(rb"-?\d{1,18}", raw) else None


def payload_of(kind: str | None, block: bytes) -> bytes:
    """A block without its HTTP header, if it has one."""
    if (kind or "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


def parse(piece: bytes) -> dict | None:
    """Header of the record that a piece begins with; None if it isn't one with a length."""
    end = piece.find(b"\r\n\r\n")
    if not piece.startswith(MAGIC) or end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(piece[:end].replace(b"\r\n", b"\n"))}
    length = _number(fields.get(b"content-length"))
    return None if length is None or length < 0 else fields | {b"head": end + 4, b"length": length}


def _split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(path, split, place in the split, bytes up to the next place, size of the file, piece) in file order.

    The reader takes the magic with the separator, except that of a file's first record; the place is that of the magic.
    """
    where, rel = None, 0
    for batch in batches:
        for path, split, size, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where != (path, split):
                where, rel = (path, split), 0
            first = split == 0 and rel == 0
            yield path, split, rel - (0 if first else len(MAGIC)), len(value) + len(SEPARATOR), size, value if first else MAGIC + value
            rel += len(value) + len(SEPARATOR)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for path, split, rel, n, size, piece in _split_pieces(batches):
        got, row = parse(piece), [path, split, rel, n, size]
        if got is None:
            out.append((*row, *[None] * 12))
        else:
            text = lambda k, got=got: got[k].decode("utf-8", "replace") if k in got else None
            count = digest = None
            block = piece[got[b"head"] :]
            # whole inside the piece: what follows is the separator, or the blank line at the end of the file
            if len(block) == got[b"length"] or block[got[b"length"] :] == END.encode():
                payload = payload_of(text(b"content-type"), block[: got[b"length"]])
                count, digest = len(payload), base32_sha1(payload)
            names = (b"warc-type", b"warc-record-id", b"warc-target-uri", b"content-type")
            out.append((*row, *map(text, names), _number(got.get(b"x-page-id")), text(b"warc-refers-to"), _number(got.get(b"x-refers-to-page-id")), text(b"warc-payload-digest"), got[b"head"], got[b"length"], count, digest))
        if len(out) >= 4096:
            yield _rows(out, _SCHEMA)
            out = []
    if out:
        yield _rows(out, _SCHEMA)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("lineSep", SEPARATOR).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of the archives where a record may begin, with its offset and its successor's, and what its header says.

    Columns: path, split and rel (place in it), size (of the file), offset, next (null: no header), payload_bytes and
    payload_digest (null: another candidate lies inside) and the header's fields.
    """
    seen = cut(_pieces(spark, folder).mapInArrow(_candidates, _PIECE))
    # the sum counts a separator after a file's last piece that isn't there, but nothing comes after that
    spans = seen.groupBy("path", "split").agg(F.sum("n").alias("_sum"))
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    bases = spans.select("path", "split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    placed = seen.join(bases, ["path", "split"]).withColumn("offset", F.col("_base") + F.col("rel"))
    return placed.withColumn("next", F.col("offset") + F.col("head") + F.col("length") + len(END)).drop("_base", "n")


def _jump(to: np.ndarray) -> np.ndarray:
    """Where each index ends by following `to` (its own index at the end): pointer jumping."""
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def _links(offsets: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Index of the candidate that each one's successor is, its own where that lies elsewhere."""
    at = np.minimum(np.searchsorted(offsets, nexts), len(offsets) - 1)
    return np.where((offsets[at] == nexts) & (nexts > offsets), at, np.arange(len(offsets)))


def _sorted(part) -> tuple:
    part = part.sort_values("offset", kind="stable")
    return part, part["offset"].to_numpy(np.int64), part["next"].fillna(-1).to_numpy(np.int64)


def _exits(part):
    """Offset at which the chain from each candidate of a split leaves it (-1: it ends there)."""
    part, offsets, nexts = _sorted(part)
    part["leaves"] = nexts[_jump(_links(offsets, nexts))]
    return part[["path", "split", "offset", "leaves"]]


def _mark(part, entries):
    """The candidates of a split and the record of the split that each belongs to, -1 for those before its first."""
    part, offsets, nexts = _sorted(part)
    to, on = _links(offsets, nexts), np.isin(offsets, entries["enter"].to_numpy(np.int64))
    while True:  # what is marked marks what it points to, then the pointers double
        wider, further = on.copy(), to[to]
        wider[to[on]] = True
        if np.array_equal(wider, on) and np.array_equal(further, to):
            break
        on, to = wider, further
    last = np.maximum.accumulate(np.where(on, np.arange(len(on)), -1))
    part["record"] = np.where(last >= 0, offsets[last], -1)
    return part[["path", "split", "offset", "record"]]


def owners(found: DataFrame) -> DataFrame:
    """(path, split, offset, record) of all candidates: the record that each begins (record = offset) or lies in.

    Records are the candidates on the chain from offset 0 of their file. A split's chains are
    followed in its task (its candidates are bounded by its bytes, as each takes a header); what
    is chained over splits by pointer jumping is a row for each exit, and its rounds are the
    logarithm of a file's splits. What comes after a record that is cut short belongs to it.
    """
    slim = found.select("path", "split", "offset", "next")
    exits = cut(slim.groupBy("path", "split").applyInPandas(_exits, "path string, split long, offset long, leaves long"))
    entered = exits.select("path", F.col("leaves").alias("offset")).union(exits.select("path", F.lit(0).cast("long"))).distinct()
    jump = cut(exits.join(entered.hint("merge"), ["path", "offset"], "left_semi").select("path", "offset", "leaves"))
    drop(exits)
    places = jump.select("path", "offset")
    reached = cut(jump.where("offset = 0").select("path", "offset"))
    while True:
        # all within 2^k jumps are known: go 2^k further from each, then double the jumps
        further = reached.join(jump, ["path", "offset"]).select("path", F.col("leaves").alias("offset")).distinct()
        new = cut(further.join(places, ["path", "offset"], "left_semi").join(reached, ["path", "offset"], "left_anti"))
        if new.isEmpty():
            break
        reached = cut(reached.unionByName(new))
        onward = jump.select("path", F.col("offset").alias("leaves"), F.col("leaves").alias("_on"))
        jump = cut(jump.join(onward, ["path", "leaves"], "left").select("path", "offset", F.coalesce("_on", "leaves").alias("leaves")))
    entries = slim.join(reached.hint("merge"), ["path", "offset"], "left_semi").select("path", "split", "offset").toDF("p", "s", "enter")
    marked = slim.groupBy("path", "split").cogroup(entries.groupBy("p", "s")).applyInPandas(_mark, "path string, split long, offset long, record long")
    marked = cut(marked)
    # what comes before a split's first record belongs to the last record of the splits before
    lasts = marked.groupBy("path", "split").agg(F.max("record").alias("_last"))
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    lasts = lasts.select("path", "split", F.max("_last").over(before).alias("_before"))
    return marked.join(lasts, ["path", "split"]).select("path", "split", "offset", F.when(F.col("record") >= 0, F.col("record")).otherwise(F.col("_before")).alias("record"))


def payloads(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """(path, offset, payload) of records given by all their pieces (path, split, rel, offset, record, head, length, content_type).

    The archives are scanned again and the wanted pieces of a record put together: what is shuffled
    is these records only. head, length and content_type are the record's.
    """

    def scan(batches):
        for path, split, rel, _, _, piece in _split_pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([split]), pa.array([rel]), pa.array([piece], pa.binary())], ["path", "split", "rel", "piece"])

    def join(batches):
        for batch in batches:
            out = []
            for path, record, parts_, head, length, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = END.encode().join(p["piece"] for p in parts_)
                out.append((path, record, payload_of(kind, raw[head : head + length])))
            if out:
                yield _rows(out, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())]))

    pieces = _pieces(spark, folder).mapInArrow(scan, "path string, split long, rel long, piece binary")
    met = pieces.join(parts, ["path", "split", "rel"])
    whole = met.groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("parts"), F.max("head").alias("head"), F.max("length").alias("length"), F.max("content_type").alias("kind"))
    return whole.mapInArrow(join, "path string, offset long, payload binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The verified records of all archives in a folder, as a written table.

    Columns: path, offset, type, record_id, target_uri, page_id, payload_bytes, payload_digest (base32 SHA-1 of
    the bytes read; of a revisit those of the record it refers to), refers_to_id, refers_to, complete (its end was reached).
    Bytes that no chain from a file's start reaches aren't records, whatever they look like.
    Archives must not be compressed as a whole; an empty folder gives no rows. A record's payload
    is held by one task.
    """
    with _same_splits(spark):
        found = cut(candidates(spark, folder))
        own = cut(owners(found))
        heads = found.join(own.where("record = offset").select("path", "offset").hint("merge"), ["path", "offset"], "left_semi").withColumn("complete", F.coalesce(F.col("next") <= F.col("size"), F.lit(False)))
        broken = heads.where("complete and payload_digest is null").select("path", F.col("offset").alias("record"), "head", "length", "content_type")
        parts = cut(own.join(broken, ["path", "record"]).join(found.select("path", "offset", "rel"), ["path", "offset"]))
        if not parts.isEmpty():
            put = payloads(spark, folder, parts).select("path", "offset", F.octet_length("payload").cast("long").alias("_n"), _base32(F.sha1("payload")).alias("_d"))
            heads = heads.join(put, ["path", "offset"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_n")).withColumn("payload_digest", F.coalesce("payload_digest", "_d")).drop("_n", "_d")
        heads = cut(heads)
    told = heads.where("type <> 'revisit'").select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    visits = heads.where("type = 'revisit'")
    target = told.join(visits.select(F.col("refers_to_id").alias("_id")).distinct(), "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("_n", "_d")).alias("_t"))
    visits = visits.join(target.hint("merge"), F.col("refers_to_id") == F.col("_id"), "left").withColumn("payload_bytes", F.col("_t._n")).withColumn("payload_digest", F.coalesce("_t._d", F.regexp_extract("declared_digest", r"^sha1:(\w+)$", 1))).drop("_id", "_t")
    out = heads.where("type is null or type <> 'revisit'").unionByName(visits).select("path", "offset", "type", "record_id", "target_uri", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "refers_to", "complete")
    out = cut(out)
    drop(found, own, parts, heads)
    return out


def _base32(hexes: Column) -> Column:
    """Base32 of the 40 hex digits of a SHA-1: every 5 digits are 4 characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    quads = F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda i: F.conv(F.substring(hexes, i, F.lit(5)), 16, 10).cast("int"))
    four = lambda v: F.concat(*[F.substring(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(quads, four), "")
