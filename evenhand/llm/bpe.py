"""Byte-level BPE, encoding and decoding.

A text is cut at added tokens, then by the pattern of the vocabulary into pieces. A piece starts as one symbol per byte in a
doubly linked list; a priority queue holds the merge rank of every adjacent pair. The least rank merges first, ties from the
left; an entry whose symbols have changed since it was queued is stale and skipped. Decoding joins the vocabulary
strings of the ids, turns their characters back into bytes, and replaces what is not UTF-8.

Pieces repeat, so a worker keeps the ids of short ones, up to a bound. The vocabulary file (a few megabytes) is read by
the driver and broadcast; its path is a parameter.

Defined cases: a null text is an empty one: no ids, decoded to an empty text. A text of any length is worked on as a whole,
piece by piece. Other columns are kept; the added columns replace ones with their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import read, slices
from evenhand.llm.rows import replace_columns, schema_with

VOCABULARY = "byte_bpe_50k.json"
CACHED_PIECES = 250_000
CACHED_LENGTH = 48
# Pieces whose ids are looked up in one go.
STEP = 1 << 16


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class ByteBpe(dict):
    """The ids of pieces; a missing piece is encoded. Built from the content of a vocabulary file."""

    def __init__(self, content: bytes):
        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}
        spec = json.loads(content)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level vocabulary is needed")
        plain = [t for t in spec["added_tokens"] if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        if len(plain) < len(spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in plain}
        marks = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        vocab = model["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.start = [vocab[c] for c in chars]
        strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))

    def forget(self) -> None:
        """Drop what is remembered of pieces."""
        self.clear()
        self.older = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.pop(piece, None) or tuple(self.merge(piece.encode()))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                # Frequent pieces come back from the older half before it is replaced.
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        symbols: list[int | None] = [self.start[b] for b in piece]
        n, ranks = len(symbols), self.ranks
        if n == 1:
            return symbols
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := ranks.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = following[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = merged, None
            after = following[i] = following[j]
            if after < n:
                previous[after] = i
                if found := ranks.get((merged, symbols[after])):
                    heapq.heappush(queue, (found[0], i, merged, symbols[after], found[1]))
            before = previous[i]
            if before >= 0 and (found := ranks.get((symbols[before], merged))):
                heapq.heappush(queue, (found[0], before, symbols[before], merged, found[1]))
        return [s for s in symbols if s is not None]

    def encode(self, text: str) -> list[int]:
        parts = self.split_added.split(text) if self.split_added else [text]
        if len(parts) == 1:
            return self._encode_plain(text)
        out: list[int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.added[part])
            elif part:
                out += self._encode_plain(part)
        return out

    def _encode_plain(self, text: str) -> list[int]:
        if len(text) < 8 * STEP:
            return list(chain.from_iterable(map(self.__getitem__, self.pieces.findall(text))))
        out, found = [], (m.group() for m in self.pieces.finditer(text))
        while step := list(islice(found, STEP)):
            out += chain.from_iterable(map(self.__getitem__, step))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[int, ByteBpe] = {}


def _load(content: bytes) -> ByteBpe:
    """One vocabulary per worker and content."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(content)
    return _LOADED[key]


def _shipped(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows with ``ids``, the token ids of the text."""
    shipped = _shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(shipped.value)
        for batch in slices(batches, text_col, keeper=bpe):
            ids = [np.array(bpe.encode(t), np.int32) if t else np.zeros(0, np.int32) for t in batch.column(text_col).to_pylist()]
            yield replace_columns(batch, {"ids": _lists(ids)})

    return docs.mapInArrow(run, schema_with(docs.schema, "ids array<int>"))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of the column ``ids``."""
    shipped = _shipped(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(shipped.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [bpe.decode(x.values.to_numpy().tolist()) if x.values is not None else "" for x in batch.column("ids")]
                yield replace_columns(batch, {"decoded": pa.array(texts, pa.string())})

    return rows.mapInArrow(run, schema_with(rows.schema, "decoded string"))


def encode_decode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows without the text, with ``ids`` and what they decode to, ``decoded``: both in one pass over the table."""
    shipped = _shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(shipped.value)
        for batch in slices(batches, text_col, keeper=bpe):
            ids = [bpe.encode(t) if t else [] for t in batch.column(text_col).to_pylist()]
            texts = [bpe.decode(x) for x in ids]
            arrays = _lists([np.array(x, np.int32) for x in ids])
            yield replace_columns(batch.drop_columns([text_col]), {"ids": arrays, "decoded": pa.array(texts, pa.string())})

    return docs.mapInArrow(run, schema_with(docs.drop(text_col).schema, "ids array<int>, decoded string"))


@register("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = [F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")]
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digest)
