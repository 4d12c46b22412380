"""Interleaved document sequences: ordered text and media references, payloads in a media table.

A document is HTML. Parsing yields its sequence, an array of structs (position, kind, text,
digest, caption): text blocks and media references in reading order. Payloads are kept once
per row that brings them in a table of grey images (binary PGM, 64 samples a line, one byte a
sample); references find them by SHA-256 digest, so positions and captions stay aligned.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import chunks, ensure_checkpoint_dir

WIDTH = 64
_PIECE = re.compile(r"<figure\b[^>]*>(.*?)</figure\s*>|<(script|style)\b.*?</\2\s*>|<!--.*?-->|<(img|audio|video)\b([^>]*)>|<(/?(?:p|div|h[1-6]|li|br|section|article|td|tr)\b)[^>]*>|<[^>]*>", re.S | re.I)
_SRC = re.compile(r"""\b(?:src|data-digest)\s*=\s*["']?sha256:([0-9a-f]{64})""", re.I)
_ALT = re.compile(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CAPTION = re.compile(r"<figcaption\b[^>]*>(.*?)</figcaption\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def _clean(markup: str) -> str:
    return " ".join(html.unescape(_TAG.sub("", markup)).split())


def parse_sequence(page: str) -> list[dict]:
    """Text blocks and media references of one page, in order."""
    items: list[dict] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            items.append({"position": len(items), "kind": "text", "text": text, "digest": None, "caption": None})

    def media(markup: str, caption: str | None) -> None:
        if m := _SRC.search(markup):
            alt = _ALT.search(markup)
            said = caption if caption is not None else html.unescape(next((x for x in alt.groups() if x), "")) if alt else None
            close()
            items.append({"position": len(items), "kind": "media", "text": None, "digest": m[1].lower(), "caption": said})

    at = 0
    for m in _PIECE.finditer(page):
        held.append(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            said = _CAPTION.search(m[1])
            media(m[1], _clean(said[1]) if said else None)
        elif m[3]:
            media(m[4], None)
        elif m[5]:
            close()
    held.append(page[at:])
    close()
    return items


def parse_sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id column, sequence) of every page; null and empty pages have an empty sequence."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in chunks(batches, "text"):
            rows = [parse_sequence(t or "") for t in part.column(1).to_pylist()]
            items = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, items)], [id_col, "sequence"])

    return pages.select(F.col(id_col), F.col(html_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, sequence {SEQUENCE}")


def pack(payload: bytes) -> bytes:
    """The stored form: a binary PGM of 64 samples a line."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def unpack(stored: bytes) -> bytes:
    """The samples of a stored image."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a stored image")
    return samples


def image_feature(samples: bytes) -> str:
    """Lines, mean, spread and an 8 x 8 difference hash of an image."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    rows = np.minimum((np.arange(9) * len(grid)) // 9, len(grid) - 1)
    small = np.add.reduceat(grid[:, : WIDTH].astype(np.int64), np.arange(0, WIDTH, 8), axis=1)
    lines = np.add.reduceat(small, np.unique(rows), axis=0)[np.searchsorted(np.unique(rows), rows)]
    bits = (lines[1:] > lines[:-1]).ravel()
    mean, spread = float(grid.mean()), float(grid.std())
    return f"h={len(grid)};mean={mean:.3f};std={spread:.3f};dhash={np.packbits(bits).tobytes().hex()}"


def store_texts(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Write each text (null: empty) as an image: digest of the padded payload, bytes, stored form.

    Every row is stored, repeated ones too (read_media returns each digest once); an empty table
    stores nothing. Other columns are left out, so their names may clash with nothing.
    """

    def run(batches):
        for part in chunks(batches, "text"):
            column = []
            for t in part.column(0).to_pylist():
                raw = (t or "").encode()
                payload = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
                column.append((hashlib.sha256(payload).hexdigest(), len(raw), pack(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*column, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["digest", "n_bytes", "media"])

    docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest string, n_bytes long, media binary").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_media(spark, path: str) -> DataFrame:
    """Features of every distinct stored image, from the stored bytes.

    Columns: digest (of the payload), media_digest (with the unpadded length, as texts that
    differ in trailing zero bytes share a payload), payload and stored sizes and digests.
    """

    def run(batches):
        for part in batches:
            out = []
            for digest, n, stored in zip(*(c.to_pylist() for c in part.columns), strict=True):
                samples = unpack(stored)
                out.append((digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), image_feature(samples)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return spark.read.parquet(path).mapInArrow(run, schema).dropDuplicates(["digest"]).drop("n_bytes")


def resolve(sequences: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """One row per media reference: id, position, caption and the columns of its media row.

    References whose digest isn't stored keep nulls. Equal digests meet in the join only as
    references (never payloads), and a hot digest is split by the engine's skew handling.
    """
    refs = sequences.select(F.col(id_col), F.explode("sequence").alias("s")).where("s.kind = 'media'")
    refs = refs.select(id_col, F.col("s.position").alias("position"), F.col("s.caption").alias("caption"), F.col("s.digest").alias("digest"))
    return refs.join(media, "digest", "left")


def interleave_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, html): each text as a page that shows it as an image, captioned with its length in bytes."""

    def run(batches):
        for part in chunks(batches, "text"):
            out = []
            for t in part.column(1).to_pylist():
                raw = (t or "").encode()
                payload = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
                out.append(f'<p>text as image</p><figure><img src="sha256:{hashlib.sha256(payload).hexdigest()}"><figcaption>{len(raw)}</figcaption></figure>')
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], [id_col, "html"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, html string")


def media_table_path(spark) -> str:
    """A new folder for a media table in the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/media-{uuid.uuid4().hex}"
