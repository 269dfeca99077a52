"""Substring dedup, vector codes and centroid clusters against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftspark.llm import clusters, codebooks, substring
from tests.llm.helpers import WORD, documents, edge_documents, empty_documents


def plain_removal(rows, window):
    """(id, text) -> spans and kept words, by a dictionary of windows in the order of documents."""
    seen, out = set(), {}
    order = sorted({(r[0] is None, r[0], r[1] or "") for r in rows}, key=lambda r: (r[0], r[1] or 0))
    for _, i, text in order:
        words = WORD.findall(text)
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        spans, a = [], 0
        while a < len(words):
            b = a
            while b < len(words) and gone[b]:
                b += 1
            if b > a:
                spans.append((a, b))
            a = b + 1
        out[i, text] = (len(words), sum(gone), spans, " ".join(w for w, g in zip(words, gone) if not g))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    shared = [[f"s{k}_{j}" for j in range(rng.randint(5, 60))] for k in range(6)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [f"u{i}_{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.6:
                passage = rng.choice(shared)
                a = rng.randrange(len(passage))
                words += passage[a:] if rng.random() < 0.5 else passage
        if rng.random() < 0.1:
            words += ["again"] * rng.randint(15, 60)
        out.append((i * 3 % n * 7, " \n".join(words)))
    for i in range(5):  # whole copies, and copies with another blank or end
        out.append((1000 + i, out[i][1]))
        out.append((2000 + i, out[i][1].replace(" \n", "\t") + (" end" if i % 2 else "")))
    return list({r[0]: r for r in out}.values())


def removal(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in df.collect())


@pytest.mark.parametrize("seed, window, tasks, parts", [(0, 20, 1_000_000, 3), (1, 20, 50, 7), (2, 7, 200, 2), (3, 2, 500, 5)])
def test_repeated_passages_equal_brute_force(spark, seed, window, tasks, parts):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    got = removal(substring.repeated_passages(documents(spark, rows).repartition(parts), window, tasks))
    want = sorted((i, *v) for (i, _), v in plain_removal(rows, window).items())
    assert got == want and sum(r[2] for r in got) > 0


def test_packs_are_flushed_without_losing_digests(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(substring, "FLUSH", 10)
    monkeypatch.setattr(substring, "byte_slices", lambda texts: ((i, 1) for i in range(len(texts))))
    packed = substring.packs(documents(spark, rows))
    assert packed.count() == len(rows)
    monkeypatch.setattr(substring, "packs", lambda docs: packed)
    want = sorted((i, *v) for (i, _), v in plain_removal(rows, 20).items())
    assert removal(substring.repeated_passages(documents(spark, rows), 20, 300)) == want


def test_rolled_digests_are_those_of_their_words():
    words = substring.word_digests(" ".join(map(str, range(90))).encode() * 2)
    for size in (1, 2, 3, 10, 20, 21):
        got = substring.rolled(words, size, 3)
        raw = [sum(int(w) * pow(3, j, 1 << 64) for j, w in enumerate(words[i : i + size])) % (1 << 64) for i in range(len(words) - size + 1)]
        assert (got == substring.mixed(np.array(raw, np.uint64))).all()
    for buckets in (1, 3, 1000):
        placed = substring._placed(words, buckets)
        assert [int(p) >> 30 for p in placed] == [int(w) * buckets >> 64 for w in words] and [int(p) for p in placed] == [int(w) * buckets >> 34 for w in words]
    assert (substring._stepped(substring._steps(np.array([3, 3, 900, 2**32 - 1], np.uint32))) == [3, 3, 900, 2**32 - 1]).all()
    assert len(substring.word_digests(b"a " * 5)) == 5 and len(substring.rolled(words[:3], 20, 3)) == 0


def test_long_texts_are_split_between_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)).encode()
    whole = substring.word_digests(text)
    monkeypatch.setattr(substring, "PIECE", 7)
    assert (substring.word_digests(text) == whole).all()


def test_odd_and_no_documents_for_removal(spark):
    from tests.llm.helpers import ODD

    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in substring.repeated_passages(edge_documents(spark), 4).collect())
    plain = plain_removal(ODD, 4)
    want = sorted(((i is None, i or 0), *plain[i, t or ""][:2], plain[i, t or ""][3]) for i, t in ODD)
    assert got == want
    assert substring.repeated_passages(empty_documents(spark)).collect() == []
    # rows of one id and different texts are ordered by a digest: one of them keeps the passage
    text = " ".join(f"w{i}" for i in range(30))
    both = substring.repeated_passages(documents(spark, [(1, text), (1, text + " x"), (None, text)])).collect()
    assert sorted(r.n_removed for r in both) in ([0, 30, 30], [0, 20, 30], [0, 30, 31])
    with pytest.raises(ValueError):
        substring.repeated_passages(empty_documents(spark), 1)


# --- vectors ---------------------------------------------------------------------


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n, d, seed, odd=True, spread=0.2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * spread + rng.integers(0, 3, (n, 1)) / 4).astype(np.float32)
    if n > 8:
        x[5] = x[3]  # ties
        x[7] = x[3]
    rows = [(int(i) * 2, [float(v) for v in x[i]], [None, 0, 1, 2][i % 4]) for i in rng.permutation(n)]
    if odd:
        rows += [(1, None, 0), (3, [1.0] * (d - 1) + [None], 1), (5, [float("nan")] * d, 1), (7, [float("-inf")] * d, None), (9, [1.0] * (d + 4), 2), (11, [], 2), (13, [1e9] * d, 0)]
    return spark.createDataFrame(rows, VECTORS), [r for r in rows if r[1] and len(r[1]) == d and None not in r[1] and all(abs(v) < 1e6 for v in r[1])]


def ints(rows):
    return np.array([[math.floor(1024 * v) for v in r[1]] for r in rows], object)


def plain_assign(x, book):
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    best = [min(range(len(book)), key=lambda j: (row[j], j)) for row in d]
    return best, [row[b] for row, b in zip(d, best)]


def plain_lloyd(x, book, rounds):
    for _ in range(rounds):
        best, _ = plain_assign(x, book)
        for j in range(len(book)):
            own = [i for i, b in enumerate(best) if b == j]
            if own:
                book[j] = [sum(x[i][c] for i in own) // len(own) for c in range(x.shape[1])]
    return (*plain_assign(x, book), book)


@pytest.mark.parametrize("n, d, entries, rounds, parts", [(120, 8, 16, 4, 3), (40, 4, 256, 4, 1), (300, 12, 5, 9, 4), (1, 4, 256, 2, 1)])
def test_vector_codes_equal_plain_rounds(spark, n, d, entries, rounds, parts):
    df, rows = vectors(spark, n, d, n)
    found, books, _ = codebooks.product_codes(df.repartition(parts), entries=entries, rounds=rounds)
    rows.sort()
    x, size, codes, errors = ints(rows), d // 4, [], []
    for p in range(4):
        part = x[:, p * size : (p + 1) * size]
        best, error, book = plain_lloyd(part, part[:entries].copy(), rounds)
        assert (books[p] == book.astype(np.int64)).all()
        codes.append(best)
        errors.append(error)
    want = [(r[0], None if r[2] is None else str(r[2]), list(c), sum(e)) for r, c, e in zip(rows, zip(*codes), zip(*errors))]
    assert sorted(map(str, ((r.vec_id, r.label, r.codes, r.error) for r in found.collect()))) == sorted(map(str, want))


def test_heaps_spare_parts_that_the_drift_has_not_passed(spark):
    df, rows = vectors(spark, 400, 8, 9, odd=False, spread=0.02)
    _, _, scanned = codebooks.product_codes(df, entries=4, rounds=8)
    assert 0 < scanned < 8 * 4 * 400 / 2


def test_heaps_are_kept_as_they_lie():
    rng = np.random.default_rng(0)
    own, keys = rng.integers(0, 6, 50), rng.normal(size=50)
    heaps = codebooks.Heaps.unpacked(codebooks.Heaps.of(own, keys, 7).packed(), 7)
    assert (heaps.own == own).all() and heaps.sizes.tolist() == np.bincount(own, minlength=7).tolist() and (heaps.keys == keys[heaps.members]).all()
    x, book = rng.integers(-50, 50, (50, 3)), rng.integers(-50, 50, (7, 3))
    now, popped = heaps.settle(x, book, np.full(7, 1e9))
    assert popped == 50 and (now.own == ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    again, popped = now.settle(x, book, np.full(7, -1e9))
    assert popped == 0 and again is now


def lot(i):
    return hashlib.sha256(f"3:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n, k, rounds, groups, parts", [(150, 8, 10, None, 3), (200, 13, 6, 4, 2), (60, 8, 10, 1, 1), (90, 9, 10, 9, 2), (3, 8, 10, None, 1)])
def test_clusters_equal_plain_rounds(spark, n, k, rounds, groups, parts):
    df, rows = vectors(spark, n, 12, n + 1)
    found, centroids, measured = clusters.yinyang(df.repartition(parts), k, 12, rounds, groups=groups)
    rows.sort(key=lambda r: lot(r[0]))
    x = ints(rows)
    best, error, book = plain_lloyd(x, x[:k].copy(), rounds)
    assert (centroids == book.astype(np.int64)).all()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted((r[0], b, e) for r, b, e in zip(rows, best, error))
    assert measured <= rounds * n * (k + 1)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    rows = [(i, [float(v) for v in centres[i % 8] + rng.normal(size=12) * 0.05], 0) for i in range(400)]
    _, _, measured = clusters.yinyang(spark.createDataFrame(rows, VECTORS), 8, 12, 10)
    assert measured < 10 * 400 * 8 / 3


def test_large_components_are_exact():
    from shiftspark.llm.intvectors import squared

    x, c = np.array([[1 << 28, -(1 << 28)], [5, 7]]), np.array([[-(1 << 28), 1 << 28], [5, 8]])
    assert squared(x, c).tolist() == [[2 * (1 << 29) ** 2, ((1 << 28) - 5) ** 2 + ((1 << 28) + 8) ** 2], [((1 << 28) + 5) ** 2 + ((1 << 28) - 7) ** 2, 1]]


def test_repeated_null_and_no_vectors(spark):
    rows = [(4, [0.5] * 4, None), (4, [0.5] * 4, None), (4, [0.25] * 4, 1), (None, [0.5] * 4, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("error", "cluster", "codes", "ids", "x"):
        df = df.withColumn(name, F.lit("extra"))
    found, books, _ = codebooks.product_codes(df)
    assert sorted((r.vec_id is None, r.vec_id, r.error) for r in found.collect()) == [(False, 4, 0)] * 3 + [(True, None, 0)]
    assert books[0].tolist() == [[256], [512], [512], [512]]
    found, centroids, _ = clusters.yinyang(df, length=4)
    assert found.count() == 4 and centroids[:, 0].tolist() == [256, 512, 512, 512]
    none = spark.createDataFrame([], VECTORS)
    assert codebooks.product_codes(none)[0].count() == 0 and clusters.yinyang(none)[0].count() == 0
    assert codebooks.product_codes(df.drop("label"))[0].count() == 4
