"""Exact SentencePiece ids through a table of distinct marked words, and their decoding.

The model marks blanks with U+2581 and adds one mark at the front; none of its pieces has a mark after another
character, so no piece crosses from a word into the next mark, and merges of one marked word never depend on another.
A text is therefore cut before each run of marks, each distinct marked word is segmented once by the library, and
ids are joined back by position. `check_model` refuses a model whose pieces cross marks. The table is bounded and
starts anew when full.

Edge cases: null text is empty and has no ids; runs of blanks, blanks at either end and the mark itself in a text are
blanks to the model, as in the library; a word may be as long as a text. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.tokens import LONG, TABLE, claim, slices
from strandlog.runtime import ship

MARK = "▁"


@cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(model)
    return model


def check_model(model) -> None:
    """Raise ValueError unless marked words can be segmented one by one."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK) and not (model.is_control(i) or model.is_unknown(i)):
            raise ValueError(f"piece {piece!r} crosses a mark")
    if model.encode("a  b") != [*model.encode("a"), *model.encode(" b")] or model.encode("ﬁ  ")[-1] != model.piece_to_id(MARK * 2):
        raise ValueError("the model changes its input in a way that marked words don't allow")


def marked_words(text: str) -> list[str]:
    """The text's chunks: each is a run of marks, less one, as blanks, and what follows it."""
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    if not text:
        return []
    out, run = [], 0
    for w in words[:-1]:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    if words[-1]:
        out.append(" " * run + words[-1])
    else:
        out.append(" " * run if run else "")
    return out


class PieceTable:
    def __init__(self, path: str):
        self.model, self.known = _model(path), {}
        self.lone = str(self.model.piece_to_id(MARK))

    def forget(self) -> None:
        self.known = {}

    def encode(self, texts: list[str | None]) -> list[str]:
        """Each text's ids in decimal, joined by commas."""
        split = [marked_words(t or "") for t in texts]
        if len(self.known) > TABLE:
            self.known = {}
        known, rare = self.known, {}
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in known))
        for w, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            (known if len(w) <= LONG else rare)[w] = ",".join(map(str, ids)) if w else self.lone
        if rare:
            return [",".join([known[w] if w in known else rare[w] for w in ws]) for ws in split]
        get = known.__getitem__
        return [",".join(map(get, ws)) for ws in split]

    def decode(self, ids: str) -> str:
        return self.model.decode(np.fromstring(ids, np.int64, sep=",").tolist()) if ids else ""


@cache
def _piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def table(path: str) -> PieceTable:
    """One table for each Python worker and model."""
    return claim(_piece_table(path))


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the text that they decode to."""
    return _apply(docs, path, "ids array<int>, decoded string", lambda ids, text: (np.fromstring(ids, np.int64, sep=",").tolist() if ids else [], text), [pa.list_(pa.int32()), pa.string()])


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return _apply(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (ids.count(",") + 1 if ids else 0, sha(ids), sha(text)), [pa.int64(), pa.string(), pa.string()])


def _apply(docs: DataFrame, path: str, schema: str, made, types: list) -> DataFrame:
    ship(docs.sparkSession)
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        t = table(path)
        for b in batches:
            for i, part in slices(b.column(1)):
                texts = part.to_pylist()
                rows = [made(ids, t.decode(ids)) for ids in t.encode(texts)]
                cols = [pa.array([r[c] for r in rows], k) for c, k in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), *cols], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")
