"""Removal of repeated passages with prefix-partitioned suffix trees.

Two windows of ``width`` words are alike if the suffixes at a word that both have in the same place share the rest of the window, and the words before
that place agree. So trees are built over the suffixes at some words only, chosen by what stands there:

1. Anchors. Every window is anchored at the group of words (a gram, half as long) in it that has the least hash, the same wherever the window stands;
   one word in some is an anchor of windows. Grams are dealt out by hash; a window can only repeat if its gram occurs in two documents, so
   suffixes at other anchors need not travel.
2. Partition. A suffix is its gram, a symbol for each further word that a window can reach, and with it the words before as far as a window can
   begin. Suffixes are dealt out by their prefix, the gram; a gram that is frequent in a sample of ``SAMPLE`` documents is lengthened
   to the whole window, one entry for each window, until groups fit.
3. Trees. A task sorts the suffixes of its prefixes into the order of the tree's leaves and takes the number of words that neighbours share.
   Suffixes between which no smaller number stands meet in an internal node of that depth. For every place that an anchor can have in a
   window, the nodes deep enough to hold the rest of it are split by the words before; the smallest document of each part keeps its words,
   the others lose them. Windows that are lost one after the other are the maximal repeats (``repeated_passages``).

A gram or window that a task has seen in several documents is decided there as far as possible and travels once, so that
a passage in a third of all documents costs a task at most one row for each other task, and no group is gathered.
Removals carry a check of their window, so that rows that share an id do not take each other's removals.

Windows are judged on the input. Defined cases: null texts have no words and stay null; a document with fewer than ``width`` words
stays; rows with a null id keep their text and remove nothing elsewhere; rows with one id do not remove each other's words; columns
other than the text stay; an added column replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import mix, read, slices, text_bytes, window_hashes, word_hashes, word_spans
from evenhand.llm.rows import replace_columns, schema_with

WIDTH = 13
SAMPLE = 2048
# A gram that anchors windows this often in the sample's documents is lengthened.
FREQUENT = 64
# Text that one group of suffixes comes from, and entries of eight numbers that a task gathers before it sends them.
PART_BYTES = 24 << 20
FLUSH = 400_000
STEP_BYTES = 1 << 20
# Windows of an anchor that one number tells.
BITS = 32


class Words:
    """The words of some documents: hashes in a row, and where each document's begin."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        self.begins, self.ends, self.first = word_spans(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.begins, self.ends)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, width: int) -> np.ndarray:
        """The places of words at which a window of the same document begins."""
        left = self.first[self.doc + 1] - np.arange(len(self.hashes))
        return np.flatnonzero(left >= width)


def _gram_length(width: int) -> int:
    return (width + 1) // 2


def _grams(words: Words, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams, and for each window the place of its least one (the first of equal ones)."""
    length = _gram_length(width)
    grams = window_hashes(words.hashes, length)
    place = starts.copy()
    best = grams[starts] if len(starts) else np.zeros(0, np.uint64)
    for step in range(1, width - length + 1):
        here = grams[starts + step] if len(starts) else best
        less = here < best
        best = np.where(less, here, best)
        place = np.where(less, starts + step, place)
    return grams, place


class Layout:
    """The columns of an entry: which windows of the anchor it stands for, the gram, the words behind it and those before it, nearest first."""

    def __init__(self, width: int):
        self.length = _gram_length(width)
        self.reach = width - self.length  # words on either side that a window can reach
        self.masks = -(-(self.reach + 1) // BITS)
        self.suffix = slice(self.masks, self.masks + 2 + self.reach)
        self.before = slice(self.suffix.stop, self.suffix.stop + self.reach)
        self.columns = self.before.stop

    def entries(self, words: Words, grams: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchors of the windows at ``starts``, and an entry for each."""
        at, of_window = np.unique(place, return_inverse=True)
        out = np.zeros((len(at), self.columns), np.uint32)
        if not len(at):
            return at, out
        offset = place - starts
        for k in range(self.masks):
            # Each window of an anchor has a bit of its own, so bits add up.
            here = offset // BITS == k
            out[:, k] = np.bincount(of_window[here], np.exp2(offset[here] % BITS), len(at)).astype(np.uint64)
        out[:, self.masks] = grams[at] >> np.uint64(32)
        out[:, self.masks + 1] = grams[at] & np.uint64(0xFFFFFFFF)
        symbols = (words.hashes >> np.uint64(32)).astype(np.uint32)
        low, high = words.first[words.doc[at]], words.first[words.doc[at] + 1]
        for k in range(self.reach):
            behind, ahead = at - 1 - k, at + self.length + k
            out[:, self.suffix.start + 2 + k] = np.where(ahead < high, symbols[np.minimum(ahead, len(symbols) - 1)], 0)
            out[:, self.before.start + k] = np.where(behind >= low, symbols[np.maximum(behind, 0)], 0)
        return at, out

    def has(self, key: np.ndarray, offset: int) -> np.ndarray:
        """The entries that stand for the window that begins ``offset`` words before the anchor."""
        return (key[:, offset // BITS] >> np.uint32(offset % BITS)) & np.uint32(1) > 0

    def single(self, key: np.ndarray, offset: int) -> np.ndarray:
        """The same entries for that window alone."""
        out = key.copy()
        out[:, : self.masks] = 0
        out[:, offset // BITS] = np.uint32(1 << (offset % BITS))
        return out

    def gram(self, key: np.ndarray) -> np.ndarray:
        return (key[:, self.masks].astype(np.uint64) << np.uint64(32)) | key[:, self.masks + 1].astype(np.uint64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _further(code: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of some words and one more."""
    return mix((code ^ symbol.astype(np.uint64)) * _STEP + np.uint64(1))


def _check(gram: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What a removal shows of its window: the gram and the words before it, by their hash."""
    return (mix(gram + before * _STEP) >> np.uint64(32)).astype(np.uint32)


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A part for each hash. Least hashes are small ones, so they are scrambled."""
    return ((mix(hashes) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _of_document(doc: np.ndarray, parts: int) -> np.ndarray:
    return _share(doc.astype(np.int64).view(np.uint64), parts).astype(np.int64)


class _Outbox:
    """Entries (document, place, key) that a task gathers before it sends them."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.held, self.count = names, [], 0

    def add(self, **columns: np.ndarray) -> None:
        self.held.append(columns)
        self.count += len(columns["doc"])

    def take(self) -> dict[str, np.ndarray]:
        names = ("doc", "pos", *self.names)
        out = {n: np.concatenate([h[n] for h in self.held]) for n in names}
        self.held, self.count = [], 0
        return out


PACKED = "part int, kind int, doc binary, pos binary, key binary"


def _packed(part: np.ndarray, kind: int, doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each part; documents as steps from one to the next."""
    order = np.lexsort((pos, doc, part))
    part, doc, pos, key = part[order], doc[order], pos[order], key[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = [0, *cuts.tolist(), len(part)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            steps = np.diff(doc[a:b], prepend=np.int64(0))
            arrays = [pa.array([int(part[a])], pa.int32()), pa.array([kind], pa.int32())]
            # Column after column, which compresses well.
            arrays += [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (steps, pos[a:b], key[a:b].T)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "kind", "doc", "pos", "key"])


def _unpacked(table: pa.Table, kind: int, dtype, columns: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, pos, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros((0, columns), dtype)]
    for k, d, p, x in zip(table["kind"], table["doc"], table["pos"], table["key"]):
        if k.as_py() == kind:
            doc.append(np.cumsum(np.frombuffer(d.as_buffer(), np.int64)))
            pos.append(np.frombuffer(p.as_buffer(), np.int32))
            key.append(np.frombuffer(x.as_buffer(), dtype).reshape(columns, -1).T)
    return np.concatenate(doc), np.concatenate(pos), np.concatenate(key)


BY_DOC = "doc_id long, pos binary, check binary"


def _to_documents(doc: np.ndarray, pos: np.ndarray, check: np.ndarray, parts: int) -> pa.Table:
    """Packed rows for parts of documents."""
    packed = list(_packed(_of_document(doc, parts), 0, doc, pos, check))
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary()), ("key", pa.binary())])
    return pa.Table.from_batches(packed, schema)


def _by_document(dtype):
    """What was found for a part of the documents, one row for each."""

    def run(table: pa.Table) -> pa.Table:
        doc, pos, check = _unpacked(table, 0, dtype)
        return _rows_by_document(doc, pos, check[:, 0])

    return run


def _rows_by_document(doc: np.ndarray, pos: np.ndarray, check: np.ndarray) -> pa.Table:
    order = np.lexsort((pos, doc))
    doc, pos, check = doc[order], pos[order], check[order]
    found, starts = np.unique(doc, return_index=True)
    bounds = [*starts.tolist(), len(doc)]
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
    return pa.table({"doc_id": pa.array(found, pa.int64()), "pos": cut(pos), "check": cut(check)})


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, where runs of equal ones begin, and each row's run. ``same``: equal to the row before."""
    begin = np.flatnonzero(~same)
    return begin, np.cumsum(~same) - 1


def _send_grams(width: int, parts: int):
    """Step 1, at the documents: grams that the task has in one document go out, others are known to repeat."""

    def flush(box: _Outbox) -> Iterator[pa.RecordBatch]:
        got = box.take()
        order = np.lexsort((got["doc"], got["key"]))
        doc, pos, key = got["doc"][order], got["pos"][order], got["key"][order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        begin, run = _runs(same)
        if not len(begin):
            return
        last = np.append(begin[1:], len(key)) - 1
        several = (doc[begin] != doc[last])[run]
        # The first and the last entry of a gram in several documents stand for all of them; all are known to repeat.
        out = ~several
        out[begin] = out[last] = True
        yield from _packed(_share(key[out], parts).astype(np.int64), 0, doc[out], pos[out], key[out])
        yield from _packed(_of_document(doc[several], parts), 1, doc[several], pos[several], np.zeros(int(several.sum()), np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(("key",))
        for batch in slices(batches, "text", STEP_BYTES):
            words = Words(batch.column("text"))
            starts = words.windows(width)
            grams, place = _grams(words, starts, width)
            at = place[np.diff(place, prepend=-1) != 0]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            row = words.doc[at] if len(at) else at
            box.add(doc=ids[row], pos=(at - words.first[row]).astype(np.int32), key=grams[at] if len(at) else np.zeros(0, np.uint64))
            if box.count >= FLUSH:
                yield from flush(box)
        if box.count:
            yield from flush(box)

    return run


def _repeated_grams(parts: int):
    """Step 1, at the grams: the places of those that occur in two documents."""

    def run(table: pa.Table) -> pa.Table:
        doc, pos = _in_two_documents(table)
        sure_doc, sure_pos, _ = _unpacked(table, 1, np.uint8)
        doc, pos = np.concatenate([doc, sure_doc]), np.concatenate([pos, sure_pos])
        return _to_documents(doc, pos, np.zeros(len(doc), np.uint8), parts)

    return run


def _in_two_documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    doc, pos, key = _unpacked(table, 0, np.uint64)
    key = key[:, 0]
    order = np.argsort(key, kind="stable")
    doc, pos, key = doc[order], pos[order], key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    begin, run = _runs(same)
    if len(begin):
        repeated = (np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin))[run]
        doc, pos = doc[repeated], pos[repeated]
    return doc, pos


def _shared_words(suffixes: np.ndarray) -> np.ndarray:
    """Of sorted suffixes, the columns that each shares with the one before it; 0 for the first."""
    out = np.zeros(len(suffixes), np.int32)
    if len(out) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    return out


def _lost(layout: Layout, doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The subtree of some suffixes: document, place and check of the windows that start in a smaller document too, and the entries without them."""
    # The order of the tree's leaves; the words that neighbours share are the depths of the nodes between them.
    order = np.lexsort(tuple(key[:, k] for k in range(layout.suffix.stop - 1, layout.suffix.start - 1, -1)))
    doc, pos, key = doc[order], pos[order], key[order]
    shared = _shared_words(key[:, layout.suffix])
    gram = layout.gram(key)
    before = np.zeros(len(key), np.uint64)
    left = key.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for offset in range(layout.reach + 1):
        if offset:
            before = _further(before, key[:, layout.before.start + offset - 1])
        rows = np.flatnonzero(layout.has(key, offset))
        if not len(rows):
            continue
        # The gram takes two columns; behind it the window has what the words before the anchor leave of it.
        node = np.cumsum(shared < 2 + layout.reach - offset)[rows]
        leaves = np.lexsort((doc[rows], before[rows], node))
        rows, node = rows[leaves], node[leaves]
        same = np.zeros(len(rows), bool)
        same[1:] = (node[1:] == node[:-1]) & (before[rows[1:]] == before[rows[:-1]])
        begin, part = _runs(same)
        gone = rows[doc[rows] > doc[rows[begin]][part]]
        found.append((doc[gone], (pos[gone] - offset).astype(np.int32), _check(gram[gone], before[gone])))
        left[gone, offset // BITS] &= ~np.uint32(1 << (offset % BITS))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32))
    lost = [np.concatenate(x) for x in zip(*found, empty)]
    kept = (left[:, : layout.masks] > 0).any(axis=1)
    undo = np.empty(len(order), np.int64)
    undo[order] = np.arange(len(order))
    return *lost, np.where(kept[:, None], left, 0)[undo]


def _send_suffixes(width: int, parts: int, frequent: np.ndarray):
    """Step 2: suffixes whose gram repeats go out by their prefix; windows of which the task has a smaller document are removals at once."""
    layout = Layout(width)

    def flush(box: _Outbox) -> Iterator[pa.RecordBatch]:
        got = box.take()
        lost_doc, lost_pos, check, key = _lost(layout, got["doc"], got["pos"], got["key"])
        own = (key[:, : layout.masks] > 0).any(axis=1)
        doc, pos, key = got["doc"][own], got["pos"][own], key[own]
        gram = layout.gram(key)
        known = np.isin(gram, frequent)
        yield from _packed(_share(gram[~known], parts).astype(np.int64), 0, doc[~known], pos[~known], key[~known])
        doc, pos, key, gram = doc[known], pos[known], key[known], gram[known]
        before = np.zeros(len(key), np.uint64)
        for offset in range(layout.reach + 1 if len(key) else 0):
            if offset:
                before = _further(before, key[:, layout.before.start + offset - 1])
            rows = np.flatnonzero(layout.has(key, offset))
            window = _further(before[rows], np.full(len(rows), offset, np.uint64)) + gram[rows]
            for k in range(layout.reach - offset):
                window = _further(window, key[rows, layout.suffix.start + 2 + k])
            yield from _packed(_share(window, parts).astype(np.int64), 0, doc[rows], pos[rows], layout.single(key[rows], offset))
        yield from _packed(_of_document(lost_doc, parts), 1, lost_doc, lost_pos, check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(("key",))
        for batch in slices(batches, "text", STEP_BYTES):
            words = Words(batch.column("text"))
            starts = words.windows(width)
            grams, place = _grams(words, starts, width)
            marked = np.zeros(len(words.hashes) + 1, bool)
            for row, listed in enumerate(batch.column("flags")):
                if listed.is_valid:
                    low, n = words.first[row], words.first[row + 1] - words.first[row]
                    at = np.frombuffer(listed.as_buffer(), np.int32)
                    marked[low + at[at < n]] = True
            wanted = marked[place]
            at, key = layout.entries(words, grams, starts[wanted], place[wanted])
            row = words.doc[at] if len(at) else at
            ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            box.add(doc=ids[row], pos=(at - words.first[row]).astype(np.int32), key=key)
            if box.count * layout.columns >= FLUSH * 8:
                yield from flush(box)
        if box.count:
            yield from flush(box)

    return run


def _removals(width: int, parts: int):
    """Step 3: the subtrees of one part."""
    layout = Layout(width)

    def run(table: pa.Table) -> pa.Table:
        doc, pos, check, _ = _lost(layout, *_unpacked(table, 0, np.uint32, layout.columns))
        sure_doc, sure_pos, sure_check = _unpacked(table, 1, np.uint32)
        return _to_documents(np.concatenate([doc, sure_doc]), np.concatenate([pos, sure_pos]), np.concatenate([check, sure_check[:, 0]]), parts)

    return run


def _checks_at(words: Words, places: np.ndarray, width: int) -> np.ndarray:
    """The checks of the windows at some places, each of which is in its document."""
    layout = Layout(width)
    grams, anchor = _grams(words, places, width)
    symbols = (words.hashes >> np.uint64(32)).astype(np.uint32)
    before = np.zeros(len(places), np.uint64)
    for k in range(layout.reach):
        more = anchor - places > k
        before[more] = _further(before[more], symbols[anchor[more] - 1 - k])
    return _check(grams[anchor], before) if len(places) else np.zeros(0, np.uint32)


def _cut(width: int):
    """The texts without the words that removals cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            texts = batch.column("text")
            words = Words(texts)
            covered = np.zeros(len(words.hashes) + width + 1, np.int64)
            listed: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
            for row, (places, checks) in enumerate(zip(batch.column("removed_pos"), batch.column("removed_check"))):
                if not places.is_valid:
                    continue
                low, n = words.first[row], words.first[row + 1] - words.first[row]
                at, check = np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(checks.as_buffer(), np.uint32)
                fits = at + width <= n
                listed.append((at[fits] + low, check[fits]))
            at, check = (np.concatenate(x) for x in zip(*listed))
            covered[at[_checks_at(words, at, width) == check]] = 1
            # A word goes if one of the width windows up to it is a removal.
            total = np.concatenate([[0], np.cumsum(covered)])
            n_all = len(words.hashes)
            back = np.maximum(np.arange(n_all) - width + 1, words.first[words.doc] if n_all else 0)
            gone = total[1 : n_all + 1] - total[back] > 0 if n_all else np.zeros(0, bool)
            n_gone = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(words.first[:-1], n_all)) if len(texts) else np.zeros(0, np.int64)
            n_words = np.diff(words.first)
            n_gone = np.where(n_words > 0, n_gone, 0)
            out = [texts[row].as_py() if not n_gone[row] else _kept(words, row, gone) for row in range(len(texts))]
            columns = {"text": pa.array(out, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64())}
            yield replace_columns(batch.drop_columns(["removed_pos", "removed_check"]), columns)

    return run


def _kept(words: Words, row: int, gone: np.ndarray) -> str:
    """The runs of kept words with the white space in them and before each removal."""
    low, high = words.first[row], words.first[row + 1]
    kept = np.concatenate([[False], ~gone[low:high], [False]])
    edges = np.flatnonzero(np.diff(kept.astype(np.int8)))
    begins, ends = edges[::2] + low, edges[1::2] + low
    parts = []
    for a, b, more in zip(begins, ends, [*([True] * (len(begins) - 1)), False]):
        # A run of kept words goes up to the first removed one, so its white space comes along.
        stop = words.begins[b] if more else words.ends[b - 1]
        parts.append(words.data[words.begins[a] : stop].tobytes())
    return b"".join(parts).decode()


def _frequent_grams(docs: DataFrame, width: int, sample: int) -> np.ndarray:
    """Grams that anchor windows ``FREQUENT`` times or more in the sampled documents (those with the least hash of their id)."""
    drawn = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            words = Words(batch.column("text"))
            grams, place = _grams(words, words.windows(width), width)
            found, n = np.unique(grams[np.unique(place)], return_counts=True) if len(place) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    counts = drawn.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).toPandas()
    return np.sort(counts["gram"].to_numpy(np.int64).view(np.uint64))


def _found(docs: DataFrame, rows: DataFrame, width: int, sample: int, parts: int, tasks: int) -> DataFrame:
    """The removals of each document: (doc_id, pos, check), from ``docs`` with ids and texts and ``rows`` dealt out by id to ``tasks``."""
    grams = docs.mapInArrow(_send_grams(width, parts), PACKED)
    flags = grams.groupBy("part").applyInArrow(_repeated_grams(parts), PACKED).groupBy("part").applyInArrow(_by_document(np.uint8), BY_DOC)
    flagged = rows.join(flags.select("doc_id", F.col("pos").alias("flags")).repartition(tasks, "doc_id"), "doc_id", "left")
    suffixes = flagged.mapInArrow(_send_suffixes(width, parts, _frequent_grams(docs, width, sample)), PACKED)
    return suffixes.groupBy("part").applyInArrow(_removals(width, parts), PACKED).groupBy("part").applyInArrow(_by_document(np.uint32), BY_DOC)


def _dealt(docs: DataFrame, width: int, id_col: str, text_col: str, own: list[str]) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows with ids and texts, all rows dealt out by id, the number of groups, and that of tasks: both follow from the bytes of the texts."""
    if width < 1:
        raise ValueError("a window has a word at least")
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long").alias("doc_id")
    named = docs.select(doc_id, text.alias("text")).where("doc_id is not null and text is not null")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), doc_id, text.alias("text")).repartition(tasks, "doc_id")
    return named, rows, parts, tasks


def remove_repeats(docs: DataFrame, width: int = WIDTH, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with what is left of ``text_col``, and ``n_words`` (of the input) and ``n_removed``."""
    own = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    # The same rows meet both joins, so that one shuffle of the texts serves both.
    named, rows, parts, tasks = _dealt(docs, width, id_col, text_col, own)
    removals = _found(named, rows, width, sample, parts, tasks)
    # Places are only valid in the text that they come from; rows with one id are told apart by the checks.
    removals = removals.select("doc_id", F.col("pos").alias("removed_pos"), F.col("check").alias("removed_check")).repartition(tasks, "doc_id")
    joined = rows.join(removals, "doc_id", "left").select("own", "text", "removed_pos", "removed_check")
    schema = schema_with(joined.select("own").schema, "text string, n_words long, n_removed long")
    cut = joined.mapInArrow(_cut(width), schema)
    fields = {c: F.col("own")[c].alias(c) for c in own}
    order = [F.col("text").alias(text_col) if c == text_col else fields[c] for c in docs.columns if c not in ("n_words", "n_removed")]
    return cut.select(*order, "n_words", "n_removed")


def _joined(width: int):
    """Places of windows to passages: those one after the other are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, sizes = [], [], []
            for doc, places in zip(batch.column("doc_id").to_pylist(), batch.column("pos")):
                at = np.unique(np.frombuffer(places.as_buffer(), np.int32))
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                first, last = at[np.append(0, cuts)], at[np.append(cuts - 1, len(at) - 1)]
                ids += [doc] * len(first)
                starts += first.tolist()
                sizes += (last - first + width).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "start", "n_words"])

    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal passages (doc_id, start, n_words) all of whose windows start in a smaller document too; ``start`` counts words from 0.

    Ids are taken to be distinct; passages of rows that share one are listed under it together.
    """
    named, rows, parts, tasks = _dealt(docs, width, id_col, text_col, [id_col])
    return _found(named, rows, width, sample, parts, tasks).select("doc_id", "pos").mapInArrow(_joined(width), "doc_id long, start long, n_words long")


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 12], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words)),
least AS (SELECT win, min(doc_id) AS least FROM starts GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM starts JOIN least USING (win) WHERE doc_id > least),
lists AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM words) ANTI JOIN gone USING (doc_id, pos)),
joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN joined USING (doc_id)
"""


@register("op6_substring_dedup", ORACLE)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(words, "UTF-8"), 256).alias("kept_sha256"))
