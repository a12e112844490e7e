"""Byte-level BPE by backtracking over the longest matches of an Aho-Corasick automaton.

The vocabulary's byte strings are mapped to Latin-1, so that one character is one byte. A token sequence is the
one that the merges give exactly when each adjacent pair is compatible: merging the two tokens' bytes alone gives
those two tokens back. The encoder takes the longest token at each place that is compatible with the one before,
falls back to shorter ones, and marks places from which no way leads on; each place is entered a bounded number of
times, which keeps it linear. Compatibility of pairs and whole pieces are memoised.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import bound_arrow, spans_by_bytes, text_bytes

#: Entries of a worker's memo of pieces, in each of two generations, and of pairs. A full generation takes the place of
#: the older one, from which entries that are still met return; a full memo of pairs is emptied.
MEMO_PIECES = 250_000
MEMO_PAIRS = 1_000_000
CALL_BYTES = 4 << 20


class ByteBpe:
    """Encoder and decoder for a rank file; pieces are what pattern matches."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.rank_of = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        self._learn()
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def _learn(self) -> None:
        """Find, in order of rank, the two tokens whose merge makes each token."""
        rank_of = self.rank_of
        for text, rank in sorted(rank_of.items(), key=lambda x: x[1]):
            if len(text) == 1:
                self.parts[rank] = (rank, rank)
            else:
                for cut in range(len(text) - 1, 0, -1):
                    left, right = rank_of.get(text[:cut], rank), rank_of.get(text[cut:], rank)
                    if left < rank and right < rank and left in self.parts and right in self.parts and self._check(left, right, rank):
                        self.parts[rank] = (left, right)
                        self.merged[left, right] = rank
                        break
            if rank in self.parts:  # a token that no merge makes can only be a whole piece
                self.automaton.add_word(text, (rank, len(text)))
        self.automaton.make_automaton()
        for text, rank in rank_of.items():
            if rank in self.parts:
                self.shorter[rank] = next((r for cut in range(len(text) - 1, 0, -1) if (r := rank_of.get(text[:cut], -1)) in self.parts), -1)
        self.pairs.clear()

    def _check(self, left: int, right: int, below: int) -> bool:
        """Whether merging the bytes of left + right, by merges of a rank under below, keeps the border between them.

        Both tokens are unmerged step by step along the border, latest merge first. The pair that then meets at
        the border must not have a merge that comes before the merge just undone.
        """
        parts, merged, limit = self.parts, self.merged, below
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._check(left, right, 1 << 62)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        whole = self.rank_of.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (rank, size) in self.automaton.iter(piece):
            start = end - size + 1
            best = longest[start]
            if best < 0 or self.length[best] < size:
                longest[start] = rank
        open_at, ids, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        length, shorter = self.length, self.shorter
        while at < n:
            while token >= 0 and not (open_at[at + length[token]] and (not ids or self.compatible(ids[-1], token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                open_at[at] = 0
                token = ids.pop()
                at -= length[token]
        return ids

    def encode_text(self, text: str) -> tuple[str, bytes]:
        """Decimal ids of a text, joined by commas, and the bytes that these ids decode to."""
        memo, ids, raw = self.memo, [], []
        for piece in self.pattern.findall(text):
            hit = memo.get(piece)
            if hit is None:
                hit = self.older.get(piece)
                if hit is None:
                    own = self.encode_piece(piece.encode().decode("latin-1"))
                    hit = (",".join(map(str, own)), self.decode(own))
                if len(piece) <= 64:
                    if len(memo) >= MEMO_PIECES:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[piece] = hit
            ids.append(hit[0])
            raw.append(hit[1])
        return ",".join(ids), b"".join(raw)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_text(text)[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_arrow(docs.sparkSession)
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def bpe_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>: the token ids of every whole text; null and empty texts have none."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                part = batch.slice(lo, hi - lo)
                c = coder(path, pattern)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.encode(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], names=schema.names)

    return _rows(docs, id_col, text_col).mapInArrow(run, schema)


def bpe_text(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, data binary: the bytes that each list of ids decodes to; a null list decodes to none."""
    bound_arrow(encoded.sparkSession)
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("data", T.BinaryType())])

    def run(batches):
        for batch in batches:
            c = coder(path, pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=schema.names)

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text and keep digests only.

    Result: id_col, n_tokens long, ids_sha256 string (of the decimal ids joined by commas), decoded_sha256 string
    (of the decoded bytes), a row per input row. Null counts as the empty text: no tokens, digests of nothing.
    Repeated rows, ties and null ids are rows like others; columns besides the two named are not read; an empty
    table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            c = coder(path, pattern)
            n, a, b = [], [], []
            for text in batch.column(1):
                ids, raw = c.encode_text(text.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(sha(ids.encode()))
                b.append(sha(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=schema.names)

    return _rows(docs, id_col, text_col).mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_col, source_col, n_tokens long, ids array<int>, decoded_sha256 string, a row per input row.

    Null counts as the empty text. Other columns of docs are not read.
    """
    bound_arrow(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(source_col, docs.schema[source_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                part, c = batch.slice(lo, hi - lo), coder(path, pattern)
                lists, digests = [], []
                for text in part.column(2):
                    ids, raw = c.encode_text(text.as_py() or "")
                    lists.append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
                    digests.append(hashlib.sha256(raw).hexdigest())
                n = np.array([len(x) for x in lists], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                every = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.ListArray.from_arrays(ends, every), pa.array(digests, pa.string())], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
