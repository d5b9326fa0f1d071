"""Near-duplicates, repeated passages, mixing and the pipeline against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenhand.llm import components, mixing, near_dedup, substring_dedup
from evenhand.llm.common import word_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def table(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, s, None, None) for i, t, s in rows], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def variants(seed, groups, copies, length=60, edits=6):
    """Texts in groups of copies with a few words changed."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(length)] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


# Near-duplicates


def shingles(text, width):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(text)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_groups(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("cell", [near_dedup.CELL, 3])
def test_groups_are_those_of_all_pairs(spark, cell):
    texts = variants(3, 6, 14) + ["one", "One", "one two", "ONE TWO", "", " \n", "É a b c", "é a b c"]
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(table(spark, [(i, t, None) for i, t in rows]), cell=cell).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(rows, 5, 80)


def test_odd_rows_of_near_duplicates(spark):
    rows = [(3, "a b c d e f g", "x"), (3, "a b c d e f g", "x"), (9, "a b c d e f g", "y"), (None, "a b c d e f g", "x"), (5, None, None), (6, "", None), (7, "q " * 30000, None), (2, "zz", None), (2, "yy", None)]
    got = near_dedup.near_duplicates(table(spark, rows))
    assert got.columns == ["doc_id", "text_hash", "n_shingles", "component_id", "kept"]
    out = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert out == Counter({(3, 3, 3, True): 2, (9, 3, 3, False): 1, (None, 3, None, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1, (7, 1, 7, True): 1, (2, 1, 2, True): 2})
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 1200).astype(np.uint64)
    for shared, n in ((900, 1000), (300, 400), (50, 100), (1, 2)):
        # Two sets with ``shared`` common elements.
        extra = (n - shared) // 2
        a, b = base[: shared + extra], np.concatenate([base[:shared], base[shared + extra : shared + 2 * extra]])
        hashes = np.concatenate([np.sort(a), np.sort(b)])
        signatures = near_dedup.super_minhash(hashes, np.array([0, len(a), len(a) + len(b)]), 512)
        estimate = (signatures[0] == signatures[1]).mean()
        true = shared / (shared + 2 * extra)
        assert abs(estimate - true) < 0.08
    single = near_dedup.super_minhash(base[:1], np.array([0, 1, 1]), 32)
    # One element fills every place, each with another step; an empty set none.
    assert sorted((single[0] >> np.uint64(48)).tolist()) == list(range(32))
    assert (single[1] == np.iinfo(np.uint64).max).all()


def test_shared_counts_sparse_and_dense():
    rng = np.random.default_rng(1)
    dense = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    sparse = [np.unique(np.concatenate([rng.integers(0, 10**6, 50), rng.integers(0, 400, 2)]).astype(np.uint64)) for _ in range(40)]
    for sets in (dense, sparse):
        left, right = sets[:5], sets[3:]
        expected = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
        assert near_dedup.shared_counts(left, right).tolist() == expected


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    ids = rng.sample(range(10**6), 120)
    links = list(zip(ids[:60], ids[1:61])) + [(ids[70], x) for x in ids[71:100]] + [(ids[110], ids[110])]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    expected = {i: min(ids[:61]) for i in ids[:61]} | {i: min(ids[70:100]) for i in ids[70:100]}
    assert got == {i: c for i, c in expected.items() if i != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Repeated passages


def brute_cut(rows, width):
    least = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(50)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))] for _ in range(5)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(60, "same " * 40), (61, "same " * 30), (62, ""), (63, rows[3][1])]


@pytest.mark.parametrize("width", [3, 13])
def test_cuts_are_those_of_all_windows(spark, width, monkeypatch):
    rows = passages(width)
    expected = brute_cut(rows, width)
    df = table(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    for flush, frequent, part in ((10**6, 64, 1 << 24), (37, 2, 200)):
        monkeypatch.setattr(substring_dedup, "FLUSH", flush)
        monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
        monkeypatch.setattr(substring_dedup, "PART_BYTES", part)
        got = substring_dedup.remove_repeats(df, width=width)
        assert got.columns == [*df.columns, "n_words", "n_removed"]
        out = {r.doc_id: r for r in got.collect()}
        assert {i: (r.n_words, r.n_removed, words_of(r.text)) for i, r in out.items()} == expected
        assert all(out[i].text == t for i, t in rows if not out[i].n_removed)


@pytest.mark.parametrize("width", [1, 2, 5, 13, 70])
def test_passages_are_maximal(spark, width, monkeypatch):
    rng = random.Random(width)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)]
    rows = []
    for i in range(40):
        parts = [base[(a := rng.randrange(300)) : a + rng.randint(1, 90)] if rng.random() < 0.7 else [f"z{i}x{j}" for j in range(5)] for _ in range(3)]
        rows.append((i * 64, " ".join(w for p in parts for w in p), "s"))
    seen, expected = {}, set()
    for i, text, _ in rows:
        words = words_of(text)
        gone = [p for p in range(len(words) - width + 1) if seen.get(tuple(words[p : p + width]), i) < i]
        for p in range(len(words) - width + 1):
            seen.setdefault(tuple(words[p : p + width]), i)
        begins = [p for p in gone if p - 1 not in gone]
        for p in begins:
            n = next(k for k in range(1, len(words) + 2) if p + k not in gone)
            expected.add((i, p, n - 1 + width))
    for flush, frequent, part in ((10**6, 64, 1 << 24), (11, 2, 300)):
        monkeypatch.setattr(substring_dedup, "FLUSH", flush)
        monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
        monkeypatch.setattr(substring_dedup, "PART_BYTES", part)
        got = substring_dedup.repeated_passages(table(spark, rows).repartition(4), width=width).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_nodes_are_as_deep_as_neighbours_agree():
    suffixes = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [1, 5, 0], [2, 5, 0]], np.uint32)
    assert substring_dedup._shared_words(suffixes).tolist() == [0, 3, 2, 1, 0]
    assert substring_dedup._shared_words(suffixes[:0]).tolist() == []


def test_ids_with_a_step_are_dealt_out_to_all_parts():
    parts = substring_dedup._of_document(np.arange(100_000) * 64, 64)
    sizes = np.bincount(parts, minlength=64)
    assert sizes.min() > 1000 and sizes.max() < 2200


def test_odd_rows_of_repeats(spark):
    text = " ".join(f"x{i}" for i in range(20))
    other = " ".join(f"y{i}" for i in range(20))
    rows = [(5, text, "a"), (5, text, "a"), (5, other, "a"), (None, text, "a"), (8, f"  {text} tail", "b"), (9, None, None), (10, other, None), (4, "x1 x2", None)]
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    out = Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got)
    expected = [(5, text, 20, 0), (5, text, 20, 0), (5, other, 20, 0), (None, text, 20, 0), (8, "tail", 21, 20), (9, None, 0, 0), (10, "", 20, 20), (4, "x1 x2", 2, 0)]
    assert out == Counter(expected)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_word_hashes_do_not_depend_on_their_place():
    words = [b"a", b"aa", b"a" * 70, "é".encode(), b"b" * 3_000_000, b"ab", b"ba"]
    seen = defaultdict(set)
    for order in (words, words[::-1]):
        data = np.frombuffer(b" ".join(order), np.uint8)
        begins, ends, _ = word_spans(data, np.array([0, len(data)]))
        for w, h in zip(order, word_hashes(data, begins, ends).tolist()):
            seen[w].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len(set.union(*seen.values())) == len(words)


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            full.add(s)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_what_is_taken(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "b", "a", "é", "Z", "\U0001f600"]
    rows = [(i, "w " * rng.randrange(30), rng.choices(sources, [30, 1, 5, 200, 3, 2, 1])[0]) for i in range(900)]
    drawn = mixing.mix_sources(table(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    targets, taken = brute_targets(dict(sizes)), Counter()
    assert len(drawn) == len(rows)
    for r in drawn:
        assert r.size == len(words_of(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * 30


def test_odd_rows_of_mixing(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (None, "x y", "a"), (3, "z", None), (3, "z", None)]
    df = table(spark, rows).withColumn("size", F.lit("old")).withColumn("copies", F.lit(9))
    drawn = mixing.mix_sources(df)
    assert drawn.columns == [*SCHEMA.replace(",", "").split()[::2], "size", "source_size", "target", "copies"]
    assert drawn.count() == 6
    again = Counter(map(tuple, mixing.mix_sources(df.repartition(3)).collect()))
    assert Counter(map(tuple, drawn.collect())) == again
    kept = mixing.emit(drawn)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert kept.count() == sum(r.copies for r in drawn.collect())
    assert mixing.mix_sources(table(spark, [])).count() == 0
    blank = mixing.mix_sources(table(spark, [(1, None, "a"), (2, " ", "b")])).collect()
    assert [(r.target, r.copies) for r in blank] == [(0.0, 0)] * 2


# The pipeline


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_pipeline_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = {r.doc_id: r for r in docs.collect()}
    languages = corpus_pipeline.identify_language(spark, docs, sf_dir)
    known = {r.doc_id: r for r in languages.collect()}
    assert len(known) >= 0.99 * len(plain) and all(known[i].text == plain[i].text for i in known)

    alone = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    groups = brute_groups([(i, r.text) for i, r in plain.items()], 5, 80)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, g in groups.items() if g[2])

    cut = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs, sf_dir).collect()}
    expected = brute_cut([(i, r.text) for i, r in plain.items()], corpus_pipeline.PASSAGE_WORDS)
    for i, (_, removed, kept) in expected.items():
        assert words_of(cut[i].text) == kept
        assert cut[i].n_chars == (len(cut[i].text) if removed else plain[i].n_chars)

    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_to_weights(spark, docs, sf_dir).collect())
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    assert mixed == Counter({i: n for i, n in copies.items() if n})

    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert rows and all(r.round_trip for r in rows)


def test_pipeline_of_odd_rows(spark):
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(30))
    rows = [(1, long, "a", "en", 3), (1, long, "a", "en", 3), (2, long, None, None, None), (None, long, "a", "en", 1), (3, None, "a", "en", None), (4, "", "b", "en", 0)]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").collect()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    tokens = corpus_pipeline.tokenize(spark, docs, "").collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in tokens)
