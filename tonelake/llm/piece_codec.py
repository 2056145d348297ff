"""SentencePiece encoding and decoding through a table of distinct marked words.

In the given vocabulary a whitespace marker stands only at the front of a piece, so no piece crosses from
one marked word to the next. Each task cuts its texts into marked words, segments and decodes every distinct one
once with the library, and joins ids and text back by position. The join is an array lookup inside the
task: the texts never move between executors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches, texts_of
from .tables import PieceTable, bounds, kept, marked_words

SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(batches, model: str, begin_end: bool, digests: bool):
    table = kept(PieceTable, model)
    sp = table.sp
    head = np.array([sp.bos_id()] if begin_end else [], np.uint32)
    tail = np.array([sp.eos_id()] if begin_end else [], np.uint32)
    for batch in slices(batches):
        docs = batch.column(0).to_pylist()
        codes, counts = table.look_up([marked_words(t) for t in texts_of(batch)])
        flat, lens = table.ids.take(codes)
        at, first = bounds(lens, counts), np.concatenate([[0], np.cumsum(counts)])
        out = []
        for i, doc in enumerate(docs):
            ids = np.concatenate([head, flat[at[i] : at[i + 1]], tail])
            own = codes[first[i] : first[i + 1]].tolist()
            decoded = ""
            if own:
                # the library drops one marker at the start of a text, and only there
                decoded = table.texts[own[0]][1:] + "".join(map(table.texts.__getitem__, own[1:]))
            out.append((doc, len(ids), ids, decoded))
        ids_of = [x[2] for x in out]
        n = pa.array([x[1] for x in out], pa.int64())
        key = pa.array(docs, pa.int64())
        if digests:
            a = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids_of], pa.string())
            b = pa.array([hashlib.sha256(x[3].encode()).hexdigest() for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([key, n, a, b], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            a = pa.array([x.astype(np.int32) for x in ids_of], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([key, n, a, pa.array([x[3] for x in out], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", begin_end: bool = True, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; one row per input row.

    Null text counts as empty: begin and end ids only, decoded to ''. Very long texts are encoded whole. Null ids stay null, repeated
    rows give repeated rows, an empty table gives none; other columns are not carried, so their names cannot clash.
    With ``digests`` the lists and texts are replaced by their SHA-256.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _run(it, model, begin_end, digests), DIGESTS if digests else SCHEMA)
