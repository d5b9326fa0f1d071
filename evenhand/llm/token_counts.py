"""Token counts by overlap resynchronisation.

A text of more than ``CHUNK`` characters is encoded in chunks that overlap. Inside an overlap both encodings are put together at
a stable boundary: a place that both have as a token boundary, between two characters that stand side by side in no piece of the vocabulary.
Merges only make pieces of the vocabulary, so no merge ever crosses such a place and what is left and right of it does not depend on the
other side; that proves the count. If an overlap has no such place it is widened, up to the rest of the text.

Offsets of tokens are running sums of their pieces' lengths. Chunks after the first carry the marker that the library puts before a text;
it lies left of the boundary and does not count.

The proof needs a model that leaves its input's characters as they are (no normalisation, no white space removed); with another
model texts are encoded whole. The model file is read by the driver and broadcast; its path is a parameter.

Defined cases: a null text is an empty one and has no tokens; strings of special tokens are ordinary text; input columns are kept, the
added one replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2

from evenhand.llm.catalog import register
from evenhand.llm.common import read, slices
from evenhand.llm.rows import replace_columns, schema_with

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 15
OVERLAP = 64
SPACE = "▁"


class Counter:
    """Counts tokens of texts with one model."""

    def __init__(self, content: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.chunk, self.overlap = chunk, overlap
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        normal, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        self.plain = (
            model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
            and model.trainer_spec.byte_fallback
            and not normal.precompiled_charsmap
            and not normal.remove_extra_whitespaces
            and normal.escape_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
        )
        self.prefix = int(normal.add_dummy_prefix)
        self.joined: set[str] = set()  # characters that stand side by side in a piece
        self.length = np.zeros(len(model.pieces), np.int64)  # characters of each id
        for i, piece in enumerate(model.pieces):
            if piece.type in (kinds.CONTROL, kinds.UNKNOWN):
                self.length[i] = -1
            elif piece.type == kinds.BYTE:
                # Of the bytes of a character the first counts.
                self.length[i] = not 0x80 <= int(piece.piece[3:5], 16) < 0xC0
            else:
                self.length[i] = len(piece.piece)
                self.joined.update(a + b for a, b in zip(piece.piece, piece.piece[1:]))

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can cross the place before character ``at``."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def _ends(self, text: str, low: int, high: int) -> np.ndarray:
        """Where the tokens of text[low:high] end, as places in the whole text."""
        ids = np.array(self.processor.encode(text[low:high], num_threads=1), np.int64)
        lengths = self.length[ids]
        if (lengths < 0).any() or lengths.sum() != high - low + self.prefix:
            return np.zeros(0, np.int64)  # offsets unknown: nothing aligns, and the overlap is widened
        return np.cumsum(lengths) + low - self.prefix

    def count(self, text: str) -> int:
        if not self.plain or len(text) <= self.chunk + 2 * self.overlap:
            return len(self.processor.encode(text, num_threads=1))
        total, low, splice = 0, 0, 0
        while True:
            middle, overlap = max(splice, low) + self.chunk, self.overlap
            while True:
                high = min(len(text), middle + overlap)
                if high == len(text):
                    if low == 0:
                        return len(self.processor.encode(text, num_threads=1))
                    ends = self._ends(text, low, high)
                    if len(ends):
                        return total + int((ends > splice).sum())
                    # Lengths of its tokens are unknown, so the whole text is encoded at once.
                    return len(self.processor.encode(text, num_threads=1))
                ends, begin = self._ends(text, low, high), max(splice + 1, middle - overlap)
                after = self._ends(text, begin, min(len(text), middle + 2 * overlap))
                at = next((int(p) for p in np.intersect1d(ends, after)[::-1] if begin + 1 < p < high and self.stable(text, int(p))), None)
                if at is not None:
                    break
                overlap *= 2
            # Several bytes of one character end at one place, so tokens are told apart by order.
            total += int((ends <= at).sum() - (ends <= splice).sum()) if splice else int((ends <= at).sum())
            low, splice = begin, at


_LOADED: dict[tuple, Counter] = {}


def _load(content: bytes, chunk: int, overlap: int) -> Counter:
    key = (hash(content), chunk, overlap)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counter(content, chunk, overlap)
    return _LOADED[key]


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows without the text, with ``n_tokens``."""
    with open(path or public_tokenizers.path(MODEL), "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _load(shipped.value, chunk, overlap)
        for batch in slices(batches, text_col):
            counts = [counter.count(t) if t else 0 for t in batch.column(text_col).to_pylist()]
            yield replace_columns(batch.drop_columns([text_col]), {"n_tokens": pa.array(counts, pa.int64())})

    return docs.mapInArrow(run, schema_with(docs.drop(text_col).schema, "n_tokens long"))


@register("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    counted = count_tokens(read(spark, sf_dir, "documents").select("doc_id", size, "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
