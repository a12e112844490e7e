"""Token counts with a sentencepiece model, in Arrow batches that return lengths only."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import bound_arrow, spans_by_bytes, text_bytes

#: One call of the library gets about so many bytes.
CALL_BYTES = 1 << 20
#: A longer text is cut at safe boundaries into pieces of about this size.
LONG_BYTES = 1 << 16
MARK = "▁"


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, _separable(sp)


def _separable(sp) -> bool:
    """Whether a single space between two words is a safe boundary of this model.

    It is when no piece crosses from a word into the mark of the next word, and when the library neither
    drops nor rewrites spaces: then "x y" has the tokens of "x" and of "y", as each gets the leading mark.
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return False
    encode = lambda s: sp.encode(s, out_type=str)
    probes = [("the", "cat"), ("1.", "-x"), ("a\n", "\nb"), ("é", "中")]
    return encode("a")[0].startswith(MARK) and len(encode("a  b")) == 3 and all(encode(f"{a} {b}") == encode(a) + encode(b) for a, b in probes)


def cut_long(text: str, limit: int) -> list[str]:
    """Cut at single spaces between two non-space characters; the space at a cut is what the mark of the next piece stands for."""
    parts, lo, n = [], 0, len(text)
    while n - lo > limit:
        at = text.find(" ", lo + limit)
        while 0 < at < n - 1 and (text[at - 1] in " " + MARK or text[at + 1] in " " + MARK):
            at = text.find(" ", at + 1)
        if at <= 0 or at >= n - 1:
            break
        parts.append(text[lo:at])
        lo = at + 1
    parts.append(text[lo:])
    return parts


def count_tokens(texts: list[str], model_path: str, long_chars: int = LONG_BYTES) -> list[int]:
    """Numbers of tokens that the library gives for each text."""
    sp, separable = _model(model_path)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for part in cut_long(text, long_chars) if separable and len(text) > long_chars else (text,):
            pieces.append(part)
            owner.append(i)
    out = [0] * len(texts)
    for i, ids in zip(owner, sp.encode(pieces, num_threads=1), strict=True):
        out[i] += len(ids)
    return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every whole text.

    Result: id_col, n_bytes long, n_tokens long, over_limit boolean, a row per input row. A null or empty text
    has 0 bytes and 0 tokens. Repeated rows and null ids are counted like others. Other columns of docs are
    not read, so their names can't clash. An empty table gives no rows.
    """
    bound_arrow(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            texts = pc.fill_null(batch.column(1), "")
            counts: list[int] = []
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                counts += count_tokens(texts.slice(lo, hi - lo).to_pylist(), model_path)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), n, pc.greater(n, limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
