"""SimHash near-duplicates, line dedup and decontamination against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shiftspark.llm import decontam, linededup, neardup, simhash
from shiftspark.llm.components import connected_components
from tests.llm.helpers import WORD, documents, edge_documents, empty_documents


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(fps, radius):
    """doc_id -> smallest reachable doc_id; fps: (doc_id, fp) with ids"""
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(n)]
    out = []
    for i, w in enumerate(base):
        out.append((len(out), " ".join(w)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2])):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append((len(out), " ".join(v)))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = [(i, fingerprint(t)) for i, t in rows]
    want = groups(fps, 4)
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in fps}
    assert len(set(want.values())) < len(rows)


def test_hot_buckets_are_split_without_losing_links(spark):
    rng = random.Random(4)
    nodes, fp = [], rng.getrandbits(64)
    for i in range(300):  # a chain that drifts through one dense region
        fp ^= 1 << rng.randrange(40)
        nodes.append((i, fp))
    signed = lambda fp: fp - (1 << 64) if fp >> 63 else fp
    distinct = {signed(fp): fp for _, fp in nodes}
    df = spark.createDataFrame([(i,) for i in distinct], "fp long")
    want = groups(list(distinct.items()), 4)
    for cap in (20, 10_000):
        parts = connected_components(simhash.near_links(df, bucket_rows=cap), "a", "b").collect()
        got = {i: i for i in want} | {r.node: r.component for r in parts}
        assert got == want


def test_nearest_links_are_direct_and_leave_no_neighbour_alone(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(14) for _ in range(300)}
    found = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), links=simhash.nearest_links).collect()
    assert found and all((r.a ^ r.b).bit_count() <= 4 and r.a != r.b for r in found)
    linked = {x for r in found for x in (r.a, r.b)}
    assert linked == {x for x in fps if any(0 < (x ^ y).bit_count() <= 4 for y in fps)}


@pytest.mark.parametrize("counted", [1, 300, 1 << 17])
def test_majority_equals_a_plain_count(monkeypatch, counted):
    monkeypatch.setattr(simhash, "COUNTED", counted)
    rng = np.random.default_rng(3)
    sizes = [0, 3, 255, 0, 256, 1, 2, 700, 0]
    hashes = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    want, at = [], 0
    for n in sizes:
        own = [int(x) for x in hashes[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > n))
        at += n
    assert simhash.majority(hashes, sizes).tolist() == want and simhash.majority([], [0, 0]).tolist() == [0, 0] and simhash.majority([], []).tolist() == []


def test_forest_search_follows_every_edge_within_the_radius():
    rng = np.random.default_rng(0)
    fp = np.unique(rng.integers(0, 2**12, 400, dtype=np.uint64))
    tree = np.sort(rng.integers(0, 3, len(fp)))
    seen = {tuple(sorted(p)) for a, b in simhash.search_forest(*simhash.build_forest(tree, fp), fp, 2) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if tree[i] == tree[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert seen == want


@pytest.mark.parametrize("task_links", [0, 50_000])
def test_components(spark, task_links):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 3), (4, 1), (4, 1)]
    df = spark.createDataFrame(links, "a long, b long").withColumn("u", F.lit("extra")).withColumn("node", F.lit(1))
    assert {(r.node, r.component) for r in connected_components(df, "a", "b", task_links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)}
    assert connected_components(df.where("false"), "a", "b", task_links).count() == 0
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(path, "a", "b", task_links).collect()} == {0}
    rng = random.Random(3)
    ends = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(300)]
    want = {}
    for x in sorted({e for pair in ends for e in pair}):
        want.setdefault(x, x)
    for _ in range(400):
        for x, y in ends:
            want[x] = want[y] = min(want[x], want[y])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(ends, "a long, b long"), "a", "b", task_links).collect()}
    assert got == {x: want[x] for pair in ends if pair[0] != pair[1] for x in pair}


def test_near_duplicates_on_odd_rows(spark):
    df = edge_documents(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.fingerprint, r.component_id))
    zero = ("0" * 16, 1)
    assert by[1] == by[2] == by[3] == by[11] == [zero]
    assert by[6] == [by[6][0]] * 2 and by[None] == [by[6][0]]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 1 in ids and 2 not in ids and None in ids
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty_documents(spark)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    one, two, three = ("the first long text of five words", "quite another text with words of its own", "a third text unlike the other two here")
    df = documents(spark, [(3, one), (5, one), (5, two), (7, three), (7, three), (None, two), (None, three), (None, three)])
    kept = simhash.drop_near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", one), ("5", two), ("7", three), ("None", two), ("None", three), ("None", three)])


def test_no_text_is_lost_where_ids_name_two_components(spark):
    one, two = "the first long text of five words", "quite another text with words of its own"
    for dropped in (simhash.drop_near_duplicates, neardup.drop_near_duplicates):
        kept = dropped(documents(spark, [(5, one), (5, two), (7, one), (9, two)])).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, one), (5, two)])


@pytest.mark.parametrize("seed", range(3))
def test_one_row_of_each_component_stays_with_repeated_and_null_ids(spark, seed):
    rng = random.Random(seed)
    texts = [t for _, t in corpus(seed, 25)]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts)) for _ in range(120)]
    part = groups([(i, fingerprint(t)) for i, (_, t) in enumerate(rows)], 4)
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[part[i]].append(doc)
    name = {c: min((d for d in ids if d is not None), default=None) for c, ids in least.items()}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter((doc, f"{fingerprint(t):016x}", name[part[i]]) for i, (doc, t) in enumerate(rows))
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()]
    of = {t: part[i] for i, (_, t) in enumerate(rows)}
    assert Counter(t for d, t in kept if d is None) == Counter(t for d, t in rows if d is None)
    named = [(d, t) for d, t in kept if d is not None]
    assert Counter(of[t] for _, t in named) == Counter(c for c, n in name.items() if n is not None)
    assert all(d == name[of[t]] for d, t in named)


# --- lines ------------------------------------------------------------------------------


def shingles_of(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def kept_by_jaccard(rows, similarity=0.8):
    sets = [shingles_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and sets[j] and 10 * len(a & sets[j]) >= round(10 * similarity) * len(a | sets[j])):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def test_pipeline_drops_pairs_of_similarity_from_0_8(spark):
    import corpus_pipeline

    rng = random.Random(5)
    rows, common = [], " ".join(f"common{i}" for i in range(30))
    for group in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 60, 200]))]
        for edits in (0, 1, 1, 2, 4, 8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy) + (f" {common}" if group % 3 == 0 else "")))
    want = kept_by_jaccard(rows)
    assert 25 < len(want) < 120
    df = documents(spark, rows)
    assert len(simhash.drop_near_duplicates(df).collect()) > len(want)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want


def test_jaccard_near_duplicates_on_odd_rows(spark):
    kept = neardup.drop_near_duplicates(edge_documents(spark))
    assert kept.columns == edge_documents(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9, 10, 12]
    assert neardup.drop_near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("key_rows", [2, 4_000])
def test_pairs_of_a_common_shingle_meet_whole_or_in_chunks(spark, key_rows):
    sets = {i: (n, i % 7, i) for i, n in enumerate([10, 10, 9, 30, 8, 10, 10])}
    rows = [(5, i, n, 0, part, 0, 0, 0, 0, len(sets)) for i, (n, part, _) in sets.items()] + [(6, 1, 10, 9, 1, 0, 0, 0, 0, 2), (6, 5, 10, 9, 5, 0, 0, 0, 0, 2)]
    df = spark.createDataFrame(rows, "key long, sh long, n int, pos int, part long, fp long, fp1 long, fp2 long, fp3 long, met long")
    got = {(r.key, *sorted((r.a, r.b))) for r in neardup.candidates(df, 0.8, key_rows).collect()}
    fits = lambda a, b: min(a, b) >= 0.8 * max(a, b)
    assert got == {(None, i, j) for i in sets for j in sets if i < j and fits(sets[i][0], sets[j][0])}
    crowded = neardup.candidates(df, 0.8, key_rows, 0).collect()
    assert {(r.key, r.a, r.b) for r in crowded} == {(5, None, None)}


@pytest.mark.parametrize("dense, block_rows", [(0, 1_000), (0, 7), (2, 5)])
def test_crowded_shingles_are_compared_in_blocks(spark, monkeypatch, dense, block_rows):
    rng = random.Random(9)
    rows, base = [], [f"w{rng.randrange(3000)}" for _ in range(60)]
    for i in range(70):  # a group of which some are similar, some nearly, and some reach others by a chain
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 4, 6])):
            copy[at] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    want = kept_by_jaccard(rows)
    assert 3 < len(want) < 60
    searched, linked = neardup.candidates, neardup.dense_links
    used = []
    monkeypatch.setattr(neardup, "neighbours", lambda own: own.select(F.col("sh").alias("a"), F.col("sh").alias("b")).where("false"))
    monkeypatch.setattr(neardup, "star_candidates", lambda places, s: places.select(F.col("sh").alias("a"), F.col("sh").alias("b")).where("false"))
    monkeypatch.setattr(neardup, "candidates", lambda places, s: searched(places, s, dense=dense))
    monkeypatch.setattr(neardup, "dense_links", lambda *a: used.append(1) or linked(*a, block_rows=block_rows))
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(documents(spark, rows)).collect()) == want and used


def test_places_of_keys_that_two_sets_have(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(200) for _ in range(rng.randrange(6))]) for i in range(90)]
    rows = [(i, sorted(set(k))) for i, k in rows]
    holders = defaultdict(set)
    for i, keys in rows:
        for k in keys:
            holders[k].add(i)
    df = spark.createDataFrame(rows, "sh long, keys array<long>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "3", batch):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = Counter((r.key, r.sh, r.pos) for r in neardup.shared_places(df).collect())
        assert got == Counter((k, i, at) for i, keys in rows for at, k in enumerate(keys) if len(holders[k]) > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def dedup_lines(rows, min_sites=3, min_words=1):
    """(doc_id, text, source) -> {doc_id: text}"""
    where = defaultdict(list)
    strip = lambda x: x.strip("\t\x0b\x0c\r ")
    for i, text, site in rows:
        for p, line in enumerate((text or "").split("\n")):
            if len(WORD.findall(line)) >= min_words:
                where[strip(line)].append((i, p, site))
    gone = {(i, p) for at in where.values() if len({s for *_, s in at}) >= min_sites for i, p, _ in sorted(at, key=lambda x: x[:2])[1:]}
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone) for i, t, _ in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    shared = [f"this line number {i} is shared" for i in range(12)]
    rows = []
    for i in range(80):
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"own text of {i} line {rng.random()}" for _ in range(rng.randint(0, 7))]
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", " \n"]), f"site{rng.randint(0, 6) if rng.random() < 0.8 else 0}"))
    want = dedup_lines(rows)
    got = {r.doc_id: r for r in linededup.drop_shared_lines(documents(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    for i, t, _ in rows:
        assert got[i].n_lines == t.count("\n") + 1
        assert got[i].n_removed == got[i].n_lines - (want[i].count("\n") + 1) or (want[i] == "" and got[i].n_removed in (got[i].n_lines, got[i].n_lines - 1))
    assert any(r.n_removed for r in got.values())


def test_pipeline_takes_shared_lines_of_one_to_three_words(spark):
    import corpus_pipeline

    rows = [(i, f"Les.\n\nown text of {i}\n \nAll rights reserved.\nHome\na line that is shared", f"site{i % 4 if i != 5 else 9}") for i in range(8)] + [(9, "Two words\n", "site1"), (10, "Two words\n", "site2")]
    want = dedup_lines(rows, min_words=1)
    assert want[3] == "\nown text of 3\n " and want[10] == "Two words\n"
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), "").collect()}
    assert got == want


def test_line_query_gives_the_rows_of_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(c.sql(linededup.OP2_SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in linededup.op2_line_dedup(spark, sf).collect())
    assert got == want and sum(r[2] for r in got) > 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, "a line that many sites have", f"site{i}") for i in range(40)] + [(100 + i, "a line that two sites have", f"site{i % 2}") for i in range(40)]
    for need in (2, 3, 39, 40, 41):
        out = linededup.drop_shared_lines(documents(spark, rows), min_sites=need).collect()
        assert {r.doc_id: r.text for r in out} == dedup_lines(rows, need)


def test_line_dedup_on_odd_rows(spark):
    df = edge_documents(spark)
    out = linededup.drop_shared_lines(df)
    assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))  # nothing is shared
    assert linededup.drop_shared_lines(empty_documents(spark)).count() == 0
    null = documents(spark, [(None, "some shared line here", None), (2, "some shared line here", "b"), (3, "some shared line here", "c"), (4, None, "d")])
    assert {r.doc_id: r.text for r in linededup.drop_shared_lines(null).collect()} == {None: "some shared line here", 2: "", 3: "", 4: None}


# --- decontamination ----------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best_window(doc, item, k=5):
    """(similarity, start) of the best item-sized window, by trying them all"""
    d, b = words(doc), words(item)
    if not d or not b:
        return 0, 0
    k = min(k, len(b))
    count = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own = count(b)
    best = (0, 0)
    for s in range(max(1, len(d) - len(b) + 1)):
        w = count(d[s : s + len(b)])
        least = sum((w & own).values())
        sim = least / max(1, sum(w.values()) + sum(own.values()) - least)
        if sim > best[0] + 1e-12:
            best = (sim, s)
    return best


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 12, 30, 45]))) for i in range(14)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 50))]
        if rng.random() < 0.6:
            v = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(v))
                v = v[:at] + rng.choice([[], [rng.choice(vocabulary)], [v[at], "extra"]]) + v[at + 1 :]
            parts.append(" , ".join(v).title())
        docs.append((i, "\n".join([*parts, text(rng.randint(0, 30))])))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontam.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, d in docs:
        for j, b in items:
            sim, start = best_window(d, b)
            if sim >= 0.8:
                want[i, j] = (round(sim, 9), start)
    assert got == want and len(want) > 20


def test_decontamination_on_odd_rows(spark):
    bench = lambda *rows: spark.createDataFrame(list(rows), "item_id long, text string")
    df = edge_documents(spark)
    assert decontam.contaminated(df, bench((1, None), (2, ""))).count() == 0
    assert decontam.contaminated(df, bench()).count() == 0
    assert decontam.contaminated(empty_documents(spark), bench((1, "a b c d"))).count() == 0
    got = decontam.contaminated(df, bench((7, "A, B; c-D"), (None, "one"))).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("4", None), ("6", 7), ("None", 7)]
    kept = decontam.drop_contaminated(df, bench((7, "a b c d")))
    assert kept.columns == df.columns and not {6, None} & {r.doc_id for r in kept.collect()}
    twice = documents(spark, [(1, "a b c d"), (1, "other words"), (None, "a b c d"), (None, "more words")])
    assert sorted(r.text for r in decontam.drop_contaminated(twice, bench((7, "a b c d"))).collect()) == ["more words", "other words"]


def test_decontamination_finds_moved_parts_repeats_and_far_fingerprints(spark):
    rng = random.Random(11)
    long = " ".join(f"x{i}" for i in range(60)).split()
    own = lambda i: [f"y{i}x{j}" for j in range(rng.randint(50, 70))]
    few = [rng.choice(["p", "q", "r"]) for _ in range(40)]
    turns = ["ta", "bo"] * 6 + ["ta"]
    parts = [own(i) for i in range(12)]
    items = [(0, long), (1, few), (2, turns), *[(i + 10, v) for i, v in enumerate(parts)]]
    short = [[f"z{i}x{j}" for j in range(13)] for i in range(20)]
    items += [(30 + i, v) for i, v in enumerate(short)] * 3  # repeated rows
    docs = [(0, ["j1", "j2", *long[30:], *long[:30], "j3"]), (1, [*few[15:], *few[:15], *few]), (2, ["bo", "ta"] * 6 + ["bo"]), (3, long[:55]), (4, turns * 3)]
    for i, v in enumerate(parts):
        at = rng.randint(10, len(v) - 10)
        moved = v[at:] + v[:at]
        if i % 3 == 0:  # three parts, in another order
            a, b = sorted(rng.sample(range(5, len(v) - 5), 2))
            moved = v[b:] + v[a:b] + v[:a]
        docs.append((10 + i, [f"n{j}" for j in range(rng.randint(0, 90))] + moved + v[: rng.choice([0, 20])]))
    for i, v in enumerate(short):
        docs += [(40 + i, ["other", *v[1:], "more"]), (60 + i, ["more", *v[:-1], "other"])]
    want = {}
    for i, d in docs:
        for j, b in items:
            sim, start = best_window(" ".join(d), " ".join(b))
            if sim >= 0.8 - 1e-9:
                want[i, j] = (round(sim, 9), start)
    table = lambda rows, schema: spark.createDataFrame([(i, " ".join(v)) for i, v in rows], schema)
    rows = decontam.contaminated(documents(spark, [(i, " ".join(v)) for i, v in docs + docs[:3]]), table(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in rows} == want and len(rows) == len(want)
    assert {(0, 0), (1, 1), (2, 2), (40, 30), (60, 30)} <= set(want) and len(want) > 50
    assert max(r.hamming for r in rows) > 26


def test_decontamination_equals_brute_force_on_few_words(spark):
    rng = random.Random(12)
    text = lambda n, words: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.choice([3, 6, 9, 13, 20, 40]), rng.choice(["ab", "abc", "abcdefgh"]))) for i in range(24)]
    items += [(i, rng.choice(items)[1]) for i in range(20, 26)]  # ids that repeat
    docs = []
    for i in range(50):
        v = list(rng.choice(items)[1])
        at = rng.randrange(len(v))
        docs.append((i, text(rng.choice([0, 0, 8]), "abc") + v[at:] + v[:at] + text(rng.choice([0, 0, 30]), "ab")))
    want = {}
    for i, d in docs:
        for j, b in items:
            sim, start = best_window(" ".join(d), " ".join(b))
            if sim >= 0.8 - 1e-9:
                want[i, j] = max(want.get((i, j), (0, 0)), (round(sim, 9), -start))
    items = spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string")
    rows = decontam.contaminated(documents(spark, [(i, " ".join(v)) for i, v in docs]), items).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), -r.start_word) for r in rows} == want and len(want) > 30


def test_simhash_column_is_the_majority_of_bits(spark):
    df = spark.createDataFrame([([1, 3, -1],), ([5],), ([],)], "h array<bigint>")
    assert [r.x for r in df.select(decontam.simhash(F.col("h")).alias("x")).collect()] == [3, 5, 0]


@pytest.mark.parametrize("blocks", [5, 27])
def test_blocks_cover_all_bits(blocks):
    assert sum(m & (2**64 - 1) for m in decontam._masks(blocks)) == 2**64 - 1
