"""SentencePiece encoding and decoding through a table of distinct chunks.

The vocabulary has no piece with a whitespace marker behind another character, so no merge crosses from a
word into the marker of the next one, and a text may be cut before every run of markers. Each distinct
marked word is segmented once; its ids are joined back by position. The table lives in the task that reads
the texts (a table for the whole corpus would have to move every word of it) and is emptied when it holds
``TABLE_ENTRIES`` words, which bounds memory and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARKER = "▁"
TABLE_ENTRIES = 600_000
SLICE_CHARS = 1 << 20  # texts that are cut at once, or one longer text
SLICE_ROWS = 256  # rows of a batch that are Python objects at once
_CHUNK = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")
_models: dict[str, object] = {}


def load(model: str):
    """The model, once per worker; fails for a vocabulary whose pieces cross whitespace markers."""
    if model not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARKER in p.lstrip(MARKER)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        _models[model] = sp
    return _models[model]


def chunks(text: str) -> list[str]:
    """The text cut before each run of markers, every chunk without its first marker; the text itself
    gets a marker in front, as the library adds one."""
    if not text:
        return []
    if MARKER not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    text = f" {text}".replace(MARKER, " ")
    return [m[1:] for m in _CHUNK.findall(text)]


class ChunkTable:
    """The distinct chunks met so far, and their ids in one array."""

    def __init__(self, sp, entries: int = TABLE_ENTRIES):
        self.sp, self.entries = sp, entries
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, some: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, some, repeat(-1)), np.int64, len(some))

    def learn(self, new: list[str]):
        """Segment chunks that the table does not hold yet."""
        # an empty chunk is a marker alone; the library would see an empty text
        found = [ids if c else [self.sp.piece_to_id(MARKER)] for c, ids in zip(new, self.sp.encode(new, num_threads=1))]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin."""
        cut = [chunks(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        place = self.find(flat)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = list({flat[k] for k in missing})
            if len(self.place) + len(new) > self.entries:
                self.clear()
                new, missing = list(set(flat)), np.arange(len(flat))
            self.learn(new)
            place[missing] = self.find([flat[k] for k in missing])
        first, sizes = self.at[place], self.at[place + 1] - self.at[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])]


def _slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def _encoder(model: str):
    """Batches of (id, text) to batches of ``doc_id, ids``."""

    def kernel(batches):
        table = ChunkTable(load(model))
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                row = 0
                for some in _slices([t or "" for t in part.column(1).to_pylist()]):
                    ids, at = table.encode(some)
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(row, len(some)), lists], ["doc_id", "ids"])
                    row += len(some)

    return kernel


def _decoder(model: str):
    """Batches of ``doc_id, ids`` with the text of the ids."""

    def kernel(batches):
        for batch in batches:
            sp = load(model)
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                ids = part.column(1).to_pylist()
                texts = [sp.decode(x) if x else "" for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return kernel


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")), docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids that the library gives each whole text, no begin or end id.

    A null or empty text has no ids. Repeated rows and null document ids stay as they are; other columns
    of the input are not read.
    """
    named, kind = _named(docs, id_col, text_col)
    return named.mapInArrow(_encoder(model), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text``: the library's text of each row's ``ids``; null or no ids give an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(model), f"doc_id {kind}, ids array<int>, text string")


def roundtrip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`decode` gives after :func:`encode`, in one pass: a task then needs one Python worker with
    one model, and the ids do not travel to the JVM and back in between."""
    named, kind = _named(docs, id_col, text_col)
    there, back = _encoder(model), _decoder(model)
    return named.mapInArrow(lambda batches: back(there(batches)), f"doc_id {kind}, ids array<int>, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of ids and the SHA-256 of the ids and of the decoded text."""
    return roundtrip(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
