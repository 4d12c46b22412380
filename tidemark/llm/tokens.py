"""Byte-level BPE encoding and decoding, and token counts with a whole-token shortcut.

Both operators split each text into pre-tokens between which no merge can happen, map equal
pre-tokens of a task to one row, and merge only rows they haven't met (see `bpe`). A worker
keeps what it has merged in a memo that is emptied at a fixed size, so memory is bounded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import PairTable
from tidemark.llm.runtime import chunks, ragged_take

#: Pre-tokens that a worker remembers before it starts afresh.
MEMO_ROWS = 500_000


class _Memo(dict):
    """Numbers new pre-tokens as they are met."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.new.append(key)
        return number


#: Texts without these characters split alike by the pattern below and by public_tokenizers.PATTERN.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f]").search
_USUAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BpeCodec:
    """Encode and decode by a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        split = regex.compile(pattern).findall
        usual = re.compile(_USUAL_PATTERN).findall
        self.split = split if pattern != _PUBLIC_PATTERN else lambda text: split(text) if _UNUSUAL(text) else usual(text)
        n = max(ranks.values()) + 1
        tokens = [b""] * n
        for token, number in ranks.items():
            tokens[number] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_offs = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.token_offs[1:])
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks, np.arange(n))
        self.whole = ranks
        self._clear()

    def _clear(self) -> None:
        self.memo = _Memo()
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Merge the pre-tokens met for the first time and append their ids to the memo."""
        new, self.memo.new = [p.encode() for p in self.memo.new], []
        raw = np.frombuffer(b"".join(new), np.uint8)
        offs = np.zeros(len(new) + 1, np.int64)
        np.cumsum([len(p) for p in new], out=offs[1:])
        symbols = self.byte_id[raw]
        # tiktoken looks a whole pre-token up before it merges
        whole = np.array([self.whole.get(p, -1) for p in new], np.int32)
        rest = np.flatnonzero(whole < 0)
        sizes = np.ones(len(new), np.int64)
        if len(rest):
            merged, at = self.pairs.merge(*ragged_take(symbols, offs, rest))
            sizes[rest] = np.diff(at)
        out = np.zeros(len(new) + 1, np.int64)
        np.cumsum(sizes, out=out[1:])
        ids = np.empty(out[-1], np.int32)
        known = np.flatnonzero(whole >= 0)
        ids[out[known]] = whole[known]
        if len(rest):
            ids[np.repeat(out[rest] - at[:-1], np.diff(at)) + np.arange(at[-1])] = merged
        self.ids = np.concatenate([self.ids, ids])
        self.offs = np.concatenate([self.offs, out[1:] + self.offs[-1]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text."""
        if len(self.memo) > MEMO_ROWS:
            self._clear()
        counts, flat = np.zeros(len(texts) + 1, np.int64), []
        for i, text in enumerate(texts):
            flat += self.split(text)
            counts[i + 1] = len(flat)
        codes = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        if self.memo.new:
            self._learn()
        ids, offs = ragged_take(self.ids, self.offs, codes)
        return ids, offs[counts]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes of all id rows and the offsets of each row."""
        raw, at = ragged_take(self.token_bytes, self.token_offs, ids)
        return raw, at[offs]


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> BpeCodec:
    return BpeCodec(path, pattern)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    Columns: the id column, n_tokens, ids_sha256, decoded_sha256 and, if `with_ids`,
    token_ids (array<int>). Null and empty texts have no tokens and the digests of no bytes.
    Other columns of `docs` are left out, so none can clash; repeated rows give repeated rows.
    `ranks_path` must be readable on every executor (a file installed with the tokenizers).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches):
        codec = _codec(ranks_path, pattern)
        for part in chunks(batches, "text"):
            ids, offs = codec.encode([t or "" for t in part.column(1).to_pylist()])
            raw, at = codec.decode(ids, offs)
            stored, decoded = ids.astype("<u4").tobytes(), raw.tobytes()
            spans = list(zip(offs[:-1].tolist(), offs[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))
            columns = [
                part.column(0),
                pa.array(np.diff(offs)),
                pa.array([hashlib.sha256(stored[4 * a : 4 * b]).hexdigest() for a, b, _, _ in spans]),
                pa.array([hashlib.sha256(decoded[c:d]).hexdigest() for _, _, c, d in spans]),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids)))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id column, text) of rows of token ids; null or empty rows give an empty text, cut characters U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(ranks_path, pattern)
        for part in batches:
            rows = [np.array(r or [], np.int64) for r in part.column(1).to_pylist()]
            offs = np.zeros(len(rows) + 1, np.int64)
            np.cumsum([len(r) for r in rows], out=offs[1:])
            raw, at = codec.decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), offs)
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


class PieceCounter:
    """Token counts by a BPE piece model with byte fallback.

    No piece holds a word mark after another character, and none joins a line break or tab to
    anything, so merges never cross those places: texts are cut there (proved from the
    vocabulary on start, refused otherwise). `whole` are the pieces that encode alone as one
    token, proved by encoding each; they count as one without merging.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        vocabulary = {model.id_to_piece(i): i for i in plain}
        mark = self.MARK
        if any(mark in p.lstrip(mark) or len(p) > 1 and re.search(r"[\t\n]", p) for p in vocabulary):
            raise ValueError("a piece crosses a place where texts are cut")
        score = np.zeros(model.get_piece_size())
        score[plain] = [model.get_score(i) for i in plain]
        _, rank = np.unique(-score, return_inverse=True)
        self.pairs = PairTable(vocabulary, rank)
        top = max(map(ord, "".join(vocabulary))) + 1
        self.symbol = np.full(top, -1, np.int32)
        for piece, number in vocabulary.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = number
        self.split = re.compile(f"{mark}*[^{mark}\t\n]+|{mark}+|[\t\n]").findall
        pieces = list(vocabulary)
        self.whole = frozenset(p for p, n in zip(pieces, self._merged(pieces), strict=True) if n == 1)
        self._clear()

    def _clear(self) -> None:
        self.memo = _Memo()
        for piece in self.whole:
            self.memo[piece] = len(self.memo)
        self.sizes = np.ones(len(self.memo), np.int64)

    def _merged(self, strings: list[str]) -> np.ndarray:
        """Tokens of each string after merging; characters without a piece cost their UTF-8 bytes."""
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
        offs = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=offs[1:])
        symbols = np.where(points < len(self.symbol), self.symbol[np.minimum(points, len(self.symbol) - 1)], -1)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        symbols = np.where(symbols < 0, -1 - width, symbols).astype(np.int32)
        merged, at = self.pairs.merge(symbols, offs)
        cost = np.where(merged < 0, -1 - merged, 1)
        return np.add.reduceat(cost, at[:-1])

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO_ROWS + len(self.whole):
            self._clear()
        ends, flat = np.zeros(len(texts) + 1, np.int64), []
        for i, text in enumerate(texts):
            if text:
                flat += self.split(self.MARK + text.replace(" ", self.MARK))
            ends[i + 1] = len(flat)
        codes = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        if self.memo.new:
            new, self.memo.new = self.memo.new, []
            self.sizes = np.concatenate([self.sizes, self._merged(new)])
        total = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(self.sizes[codes], out=total[1:])
        return np.diff(total[ends])


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text by a sentencepiece BPE model.

    Columns: the id column, n_bytes, n_tokens, over_limit (n_tokens > limit). Null and empty
    texts count 0. Strings of control tokens inside texts are ordinary text. Other columns are
    left out; repeated rows give repeated rows and an empty table none. `model_path` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = _counter(model_path)
        for part in chunks(batches, "text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = counter.count(texts)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
