"""License scans: TF-IDF cosine of headers and license files to templates, and inheritance from directories.

Templates are notices of one sentence, standard headers and whole license texts. Of a file each line, each paragraph (lines with words in a
row), each window of lines that has as many words as a template, and the whole are sparse vectors over their words, term frequency times
inverse document frequency. Document frequencies are counted over all files and for all words. All tasks know those of the templates'
words and of the ``FREQUENT`` other words that are in most files. A text is passed over if its words cannot reach the threshold with any
template, or if none of its parts reaches it although its rarer words weigh as little as they can; for the texts that are left, the
frequencies of their rarer words are joined to them. The license of the template with the largest cosine of ``THRESHOLD`` or more is the file's own.

A directory has the license of its license files (``LICENSE``, ``COPYING`` and the like). A file without a license of its own
inherits from the nearest directory above it that has one: the distinct directories are joined with their licensed ancestors, and files
with their directory.

Defined cases: null and empty texts have no license of their own but inherit; a null path has no directory; ties of cosine go to the license first
in code point order, ties between license files of a directory to the larger cosine and then to the smaller path; rows that share a path are judged one
by one; input columns are kept, added ones replace those of their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import alphanumeric_spans, lower_ascii, read, slices, text_bytes, word_hashes, written
from evenhand.llm.license_headers import standard_texts
from evenhand.llm.rows import replace_columns, schema_with

THRESHOLD = 0.6
LICENSE_FILE = r"(?i)^(un)?licen[sc]e(s)?([-_.].*)?$|^copying([-_.].*)?$|^notice([-_.].*)?$|^copyright([-_.].*)?$"
# Other words whose document frequency is known to all tasks; that of the rest is joined where it can matter.
FREQUENT = 10_000
# Counts of words that a task holds before it passes them on.
HELD_WORDS = 1 << 20
TERM = re.compile(r"[A-Za-z0-9]+")

# Notices by which texts name their license. Fixed values.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("Released under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}


def all_templates() -> dict[str, tuple[str, ...]]:
    """Notices, headers and license texts by license."""
    longer = standard_texts()
    return {name: (*TEMPLATES.get(name, ()), *longer.get(name, ())) for name in sorted({*TEMPLATES, *longer})}


def terms(text: str) -> list[str]:
    """The words of a text: runs of ASCII letters and digits, in lower case."""
    return TERM.findall(text) if text.islower() else [t.lower() for t in TERM.findall(text)]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words, for each row the number of words before it (one more than rows), and for each word the lines before it."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    begins, ends, first = alphanumeric_spans(data, offsets)
    return word_hashes(data, begins, ends), first, np.searchsorted(np.flatnonzero(data == ord("\n")), begins)


def _hashed(words: Iterable[str]) -> np.ndarray:
    """The hashes of these words, ascending."""
    return np.sort(_words(pa.array([*words], pa.string()))[0])


def _row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


class Matcher:
    """Cosines of texts with the templates, for known document frequencies (by hash of the word).

    No other word is in more than ``others`` files. Where its frequency is not given, it weighs as if it were in so many, the least it can
    weigh, and cosines are upper bounds.
    """

    def __init__(self, templates: Mapping[str, tuple[str, ...]], frequencies: Mapping[int, int], files: int, others: int = 0):
        listed = [(name, notice) for name in sorted(templates) for notice in templates[name]]
        self.names = [name for name, _ in listed]
        hashes, first, _ = _words(pa.array([notice for _, notice in listed], pa.string()))
        self.files = files
        self.unseen = self.weight(others)
        self.vocabulary = np.unique(hashes)
        self.known = np.unique(np.concatenate([self.vocabulary, np.array([*frequencies], np.uint64)]))
        self.idf = np.array([self.weight(frequencies.get(h, 0)) for h in self.known.tolist()])
        # Rows are templates, columns the vocabulary.
        counts = np.zeros((len(listed), len(self.vocabulary)))
        np.add.at(counts, (_row_of(first), np.searchsorted(self.vocabulary, hashes)), 1)
        weights = counts * self.idf[np.searchsorted(self.known, self.vocabulary)]
        self.vectors = weights / np.sqrt((weights**2).sum(axis=1, keepdims=True))
        self.squares = np.ascontiguousarray((self.vectors**2).T)
        self.sizes = np.diff(first)

    def weight(self, n: int) -> float:
        """The inverse document frequency of a word that is in ``n`` files."""
        return math.log((self.files + 1.0) / (n + 1.0)) + 1

    def rarer(self, hashes: np.ndarray) -> np.ndarray:
        """The different words, ascending, whose frequency is not known."""
        words = np.unique(hashes)
        return words[self.known[np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)] != words]

    def possible(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows that may reach the threshold, with the templates that they may reach, their words and the line of each.

        A cosine of any part is at most the root of the template's squared weights on the words that the text has.
        """
        hashes, first, line = _words(texts)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hits = np.flatnonzero(self.vocabulary[at] == hashes)
        pairs = np.unique(_row_of(first)[hits] * len(self.vocabulary) + at[hits])
        rows, begins = np.unique(pairs // len(self.vocabulary), return_index=True)
        ends = np.append(begins[1:], len(pairs))
        for row, begin, end in zip(rows.tolist(), begins.tolist(), ends.tolist()):
            reach = self.squares[pairs[begin:end] % len(self.vocabulary)].sum(axis=0)
            near = np.flatnonzero(reach >= (threshold - 1e-9) ** 2)
            if len(near):
                part = slice(first[row], first[row + 1])
                yield row, near, hashes[part], line[part]

    def best(
        self, near: np.ndarray, hashes: np.ndarray, line: np.ndarray, threshold: float, given: tuple[np.ndarray, np.ndarray] | None = None
    ) -> tuple[str | None, float]:
        """The license whose template, of those given, is nearest to a line, a paragraph, a window or all of the text.

        ``given`` has the rarer words of the text and in how many files each is.
        """
        found, cosine = None, threshold
        words, word = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        weight = np.where(self.known[at] == words, self.idf[at], self.unseen)
        if given is not None:
            counts, of = np.unique(given[1], return_inverse=True)
            weight[np.searchsorted(words, given[0])] = np.array([self.weight(n) for n in counts.tolist()])[of]
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        in_vocabulary = self.vocabulary[place] == words
        begins = np.flatnonzero(np.diff(line, prepend=line[0] - 1))
        ends = np.append(begins[1:], len(line))
        gaps = np.flatnonzero(np.diff(line[begins]) > 1) + 1
        blocks = np.column_stack([np.append(0, begins[gaps]), np.append(begins[gaps], len(line))])
        parts = np.concatenate([np.column_stack([begins, ends]), blocks, [[0, len(line)]]])
        # A part is at least as long as if all its words were different.
        squares = np.concatenate([[0.0], np.cumsum(weight[word] ** 2)])
        for t in near.tolist():
            own = np.where(in_vocabulary, self.vectors[t][place], 0.0) * weight
            dots = np.concatenate([[0.0], np.cumsum(own[word])])
            stops = ends[np.minimum(np.searchsorted(ends, begins + self.sizes[t]), len(ends) - 1)]
            spans = np.unique(np.concatenate([parts, np.column_stack([begins, stops])]), axis=0)
            low, high = spans[:, 0], spans[:, 1]
            most = (dots[high] - dots[low]) / np.sqrt(squares[high] - squares[low]) + 1e-9
            for i in np.argsort(-most, kind="stable").tolist():
                if most[i] < cosine:
                    break
                seen, n = np.unique(word[low[i] : high[i]], return_counts=True)
                value = round(float((n * own[seen]).sum() / math.sqrt(((n * weight[seen]) ** 2).sum())), 12)
                if value > cosine or (value == cosine and (found is None or self.names[t] < found)):
                    found, cosine = self.names[t], value
        return found, cosine if found else 0.0


def term_frequencies(files: DataFrame, templates: Mapping[str, tuple[str, ...]], text_col: str = "text") -> tuple[DataFrame, dict[int, int], int, int]:
    """In how many files each word (by hash) stands.

    A table ``(h, n)`` of all words but the templates', the frequencies of the templates' words and of the ``FREQUENT`` others in most files,
    the number of files, and the most files that a word not among these is in.
    """
    vocabulary = _hashed({t for notices in templates.values() for notice in notices for t in terms(notice)})

    def rows(kind: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind), pa.int32()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["kind", "h", "n"])

    def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(h, return_inverse=True)
        return keys, np.bincount(at, n, len(keys)).astype(np.int64)

    def passed_on(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary[np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)] == h
        yield rows(1, h[wanted], n[wanted])
        yield rows(2, h[~wanted], n[~wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, h, n = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches, text_col):
            total += batch.num_rows
            hashes, first, _ = _words(batch.column(text_col))
            order = np.lexsort((hashes, row := _row_of(first)))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            once = hashes[new]
            h, n = summed(np.concatenate([h, once]), np.concatenate([n, np.ones(len(once), np.int64)]))
            if len(h) > HELD_WORDS:
                yield from passed_on(h, n)
                h, n = h[:0], n[:0]
        yield from passed_on(h, n)
        yield rows(0, np.zeros(1, np.uint64), np.array([total]))

    texts = files.select(F.col(text_col).cast("string").alias(text_col))
    counts = written(texts.mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")))
    found = counts.orderBy("kind", F.desc("n"), "h").limit(1 + len(vocabulary) + FREQUENT).collect()
    by_hash = {r["h"] % 2**64: r["n"] for r in found if r["kind"] > 0}
    total = sum(r["n"] for r in found if r["kind"] == 0)
    # The words that are not here come behind the last one.
    others = [r["n"] for r in found if r["kind"] == 2][-1:] or [total]
    return counts.where("kind = 2").select("h", "n"), by_hash, total, others[0]


def own_licenses(files: DataFrame, templates: Mapping[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows without the text, with ``own_license`` and ``cosine`` (0 without one)."""
    templates = all_templates() if templates is None else templates
    counts, *known = term_frequencies(files, templates, text_col)
    shipped = files.sparkSession.sparkContext.broadcast(Matcher(templates, *known))
    kept = schema_with(files.drop(text_col).schema, "own_license string, cosine double")

    def found_columns(found: list[tuple[str | None, float]]) -> dict[str, pa.Array]:
        return {"own_license": pa.array([f[0] for f in found], pa.string()), "cosine": pa.array(np.array([f[1] for f in found], np.float64))}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shipped.value
        for batch in slices(batches, text_col):
            texts = batch.column(text_col)
            found: list[tuple[str | None, float]] = [(None, 0.0)] * batch.num_rows
            rarer: list[np.ndarray | None] = [None] * batch.num_rows
            for row, near, hashes, line in matcher.possible(texts, threshold):
                other = matcher.rarer(hashes)
                if not len(other):
                    found[row] = matcher.best(near, hashes, line, threshold)
                elif matcher.best(near, hashes, line, threshold - 1e-9)[0] is not None:
                    rarer[row] = other.view(np.int64)
            kept_texts = texts.take(pa.array([None if r is None else i for i, r in enumerate(rarer)], pa.int64()))
            open_columns = {"_open_text": kept_texts, "_open_words": pa.array(rarer, pa.list_(pa.int64()))}
            yield replace_columns(batch.drop_columns([text_col]), found_columns(found) | open_columns)

    def judge_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shipped.value
        for batch in slices(batches, "_open_text"):
            found: list[tuple[str | None, float]] = [(None, 0.0)] * batch.num_rows
            given = batch.column("_open_words")
            for row, near, hashes, line in matcher.possible(batch.column("_open_text"), threshold):
                words = given[row].values
                h, n = (words.field(name).to_numpy(zero_copy_only=False) for name in ("h", "n"))
                found[row] = matcher.best(near, hashes, line, threshold, (h.view(np.uint64), n))
            yield replace_columns(batch.drop_columns(["_open_text", "_open_words"]), found_columns(found))

    # Rows may share all their values, so they are told apart by numbers that are written with them.
    first = schema_with(kept, f"_open_text {files.schema[text_col].dataType.simpleString()}, _open_words array<long>")
    judged = written(files.mapInArrow(judge, first).withColumn("_open_row", F.monotonically_increasing_id()))
    is_open = F.col("_open_words").isNotNull()
    # No word here is in more files than any of the frequent ones, so none gathers a large share of the rows.
    words = judged.where(is_open).select("_open_row", F.explode("_open_words").alias("h"))
    looked_up = words.join(counts, "h", "left").groupBy("_open_row").agg(F.collect_list(F.struct("h", F.coalesce("n", F.lit(0)).alias("n"))).alias("_open_words"))
    left = judged.where(is_open).drop("_open_words").join(looked_up, "_open_row").drop("_open_row")
    columns = [F.col(f"`{c}`") for c in kept.fieldNames()]
    return judged.where(~is_open).select(*columns).unionByName(left.mapInArrow(judge_open, kept))


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows with ``own_license`` and ``cosine`` get ``license`` and ``license_dir``, the directory that it comes from (null for an own one)."""
    rows = files.withColumn("_dir", directory(F.col(path_col)))
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    holders = rows.where(F.col("own_license").isNotNull() & name.rlike(LICENSE_FILE))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col(path_col).alias("p"), F.col("own_license").alias("l")))
    licensed = holders.groupBy(F.col("_dir").alias("_above")).agg(best["l"].alias("_found"))
    dirs = rows.select("_dir").where("_dir is not null").distinct()
    # Each directory with itself and all that are above it; a slash more is a level deeper.
    steps = F.sequence(F.lit(0), F.size(F.split("_dir", "/")))
    above = dirs.select("_dir", F.explode(steps).alias("_level")).withColumn("_above", F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), F.col("_level")), "/"))
    above = above.where("_level > 0 or _dir <> ''")
    nearest = above.join(licensed, "_above").groupBy("_dir").agg(F.max(F.struct("_level", "_above", "_found")).alias("_near"))
    found = rows.join(nearest, "_dir", "left")
    kept = [F.col(f"`{c}`") for c in files.columns if c not in ("license", "license_dir")]
    inherited = F.col("own_license").isNull()
    return found.select(*kept, F.coalesce("own_license", F.col("_near._found")).alias("license"), F.when(inherited, F.col("_near._above")).alias("license_dir"))


def paths(docs: DataFrame, block: int = 500) -> DataFrame:
    """A place in a tree for each document: source / block of ids / id. The first document of a directory is its license file."""
    top = F.coalesce(F.col("source"), F.lit("none"))
    placed = docs.withColumn("_top", top).withColumn("_block", F.floor(F.col("doc_id") / block))
    first = placed.groupBy("_top", "_block").agg(F.min("doc_id").alias("_first"))
    very_first = first.groupBy("_top").agg(F.min("_first").alias("_very_first"))
    placed = placed.join(first.join(very_first, "_top"), ["_top", "_block"], "left")
    inner = F.concat_ws("/", "_top", F.col("_block").cast("string"))
    path = F.when(F.col("doc_id") == F.col("_very_first"), F.concat("_top", F.lit("/LICENSE"))).when(F.col("doc_id") == F.col("_first"), F.concat(inner, F.lit("/LICENSE")))
    path = F.coalesce(path, F.concat(inner, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return placed.withColumn("path", path).drop("_top", "_block", "_first", "_very_first")


@register("op10_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # Paths and directories are looked up several times, the texts only once.
    found = inherit(paths(written(own_licenses(docs))))
    return found.select("doc_id", "path", "own_license", "cosine", "license", "license_dir")
