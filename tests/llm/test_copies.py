import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coffer.llm import common, decontaminate, simhash, suffix
from helpers import documents, odd_rows, prose


def brute_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_components(spark):
    rng = random.Random(5)
    rows = odd_rows() + [(200 + i, prose(rng, 400)) for i in range(3)]
    for i in range(40):  # long texts with single edits lie a few bits apart
        words = prose(random.Random(7), 500).split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        rows.append((300 + i, " ".join(words)))
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (doc, _), r in zip(rows, roots, strict=True):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    wanted = Counter((doc, f"{fp:016x}", least.get(r)) for (doc, _), fp, r in zip(rows, fps, roots, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(documents(spark, rows)).collect())) == wanted
    assert len(set(roots)) < len(set(fps))


def test_links_of_random_fingerprints(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << rng.randrange(64) for _ in range(k)) for b in base for k in (1, 2, 3, 4)]
    fps = sorted({f - (f >> 63 << 64) for f in (x % 2**64 for x in fps)} | {0, 1, 7, 15, -1})
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    wanted = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_the_grid_and_the_manhattan_bound_leave_few_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4000)]
    fps = sorted({f - (f >> 63 << 64) for b in base for f in (b, b ^ (1 << rng.randrange(64)))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    linked = {tuple(r) for r in simhash.links(df).collect()}
    for groups in (5, 6):
        met, bounded = (simhash.candidates(df, 3, groups, bound=b) for b in (False, True))
        met, bounded = [tuple(r) for r in met.collect()], {tuple(r) for r in bounded.collect()}
        assert len(met) == len(set(met)) and linked <= bounded < set(met)
        # all pairs are 32 million; the cells leave a few thousand of them, the bound little more than the links
        assert len(met) < 2e-3 * len(fps) ** 2 / 2 and len(bounded) - len(linked) < 0.05 * len(met)


def test_manhattan_distance_of_segment_counts(spark):
    rng = random.Random(10)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(300)]
    df = spark.createDataFrame([tuple(x - (x >> 63 << 64) for x in p) for p in pairs], "a long, b long")
    got = [r.d for r in df.select(simhash.F.expr(f"bit_count({simhash.embedded('a')} ^ {simhash.embedded('b')})").alias("d")).collect()]
    counts = lambda x: [(x >> i & 3).bit_count() for i in range(0, 64, 2)]
    assert got == [sum(abs(p - q) for p, q in zip(counts(a), counts(b), strict=True)) for a, b in pairs]
    assert all(d <= (a ^ b).bit_count() for d, (a, b) in zip(got, pairs, strict=True))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_one_document_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(11)
    texts = [prose(rng, 300) for _ in range(6)]
    rows = list(enumerate(texts)) + [(50, None), (51, ""), (52, texts[0]), (52, texts[0]), (None, texts[1])]
    for i in range(60):
        words = texts[i % 3].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(300)] = f"edit{rng.random()}"
        rows.append((100 + i, " ".join(words)))
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows]
    roots = brute_components(list(range(len(rows))), lambda i, j: (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0)
    df = documents(spark, rows)
    kept = simhash.drop_near_copies(df.coalesce(1))
    assert kept.columns == df.columns
    assert kept.count() == len(set(roots)) == 7


def test_membership_and_kept_documents_agree(spark):
    rng = random.Random(12)
    texts = [prose(rng, 200) for _ in range(3)]
    rows = [(i, texts[i % 3] + " tail" * (i % 5 == 0)) for i in range(300)] + [(900 + i, prose(rng, 50)) for i in range(20)] + [(990, None), (991, ""), (992, " ")]
    df = documents(spark, rows).coalesce(1)
    stored, row, found = simhash.near_copies(df)
    ids = {r[row]: r.doc_id for r in stored.select(row, "doc_id").collect()}
    got = {ids[r.row]: ids[r.root] for r in found.collect()}
    assert got == {i: i % 3 for i in range(300)} | {900 + i: 900 + i for i in range(20)} | {990: 990, 991: 990, 992: 990}
    assert {r.doc_id for r in simhash.drop_near_copies(df).select("doc_id").collect()} == set(got.values())


def test_near_copies_of_the_tables(spark):
    """Every pair of documents at 0.8 or above, by comparing all shingle sets through an inverted index."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, set(simhash.shingle_set(r.text).tolist())) for r in docs.collect()]
    where = {}
    for n, (_, s) in enumerate(rows):
        for h in s:
            where.setdefault(h, []).append(n)
    shared = Counter(p for held in where.values() for i, a in enumerate(held) for p in ((a, b) for b in held[i + 1 :]))
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(rows[a][1]) + len(rows[b][1]) - n)]
    stored, row, found = simhash.near_copies(docs)
    ids = {r[row]: r.doc_id for r in stored.select(row, "doc_id").collect()}
    root = {ids[r.row]: r.root for r in found.collect()}
    met = sum(root[rows[a][0]] == root[rows[b][0]] for a, b in pairs)
    print(f"near copies at 0.8 and above: {met} of {len(pairs)} pairs in one group")
    assert len(pairs) > 50 and met >= 0.99 * len(pairs)
    joined = {frozenset((rows[a][0], rows[b][0])) for a, b in pairs}
    groups = {}
    for d, r in root.items():
        groups.setdefault(r, []).append(d)
    # no document is in a group without a partner of 0.8 there
    blank = {d for d, s in rows if not s}
    assert all(len(g) == 1 or set(g) <= blank or all(any(frozenset((d, e)) in joined for e in g if e != d) for d in g) for g in groups.values())


@pytest.mark.parametrize(("block", "pivots", "members"), [(512, 16, 4096), (24, 4, 80)])
def test_close_pairs_among_texts_of_one_template(spark, monkeypatch, block, pivots, members):
    """All texts share 240 shingles and lie at 0.75 of each other, but for 60 pairs at 0.806."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng = random.Random(5)
    common = [f"c{rng.random()}" for _ in range(244)]
    rows = []
    for i in range(600):
        tail = [f"t{rng.random()}" for _ in range(40)]
        rows.append((i, " ".join(common + tail)))
        if i < 60:
            rows.append((1000 + i, " ".join(common + tail[:10] + [f"u{rng.random()}" for _ in range(30)])))
    rng.shuffle(rows)
    kept = {r.doc_id % 1000 for r in simhash.drop_near_copies(documents(spark, rows, extra=False).repartition(4)).select("doc_id").collect()}
    assert len(kept) == 600
    assert simhash.drop_near_copies(documents(spark, rows, extra=False)).count() == 600


def test_rows_of_different_roots_meet(spark, monkeypatch):
    """Of a large group every two rows with different roots meet in a task, and rows of the largest root are dealt in parts."""
    monkeypatch.setattr(simhash, "BLOCK", 10)
    monkeypatch.setattr(simhash, "MEMBERS", 8)
    rng = random.Random(12)
    groups = [[1] * 70 + [2] * 12 + list(range(10, 25)), [1] * 50 + [3], [5, 6], [7] * 3 + [8] * 30 + [9] * 30]
    rows = []
    for kind, roots in enumerate(groups):
        major = max(set(roots), key=lambda r: (roots.count(r), r))
        for root in roots:
            rows.append((rng.randrange(1 << 40), root, kind, 77, major, roots.count(major), 100 * roots.count(major), len(roots), 100 * len(roots)))
    table = spark.createDataFrame(rows, "row long, root long, kind int, print long, major long, major_n long, major_total long, n long, total long")
    tasks = {}
    for r in simhash._crossing(table).collect():
        tasks.setdefault((r.kind, r.low, r.high), []).append(r)
    met = {frozenset((a.row, b.row)) for task in tasks.values() for a in task for b in task}
    assert all(frozenset((a[0], b[0])) in met for a in rows for b in rows if a[2] == b[2] and a[1] != b[1])
    assert max(map(len, tasks.values())) < 40


def test_pivots_hold_blocks_together(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIVOTS", 3)
    rows = [(i, 0, 7, 100) for i in range(100)] + [(i, 1, 8, 20) for i in range(20)]
    members = spark.createDataFrame(rows, "row long, kind int, print long, n long")
    tasks = {}
    for r in simhash._with_pivots(members, simhash.F.ceil(simhash.F.col("n") / 25).cast("int")).collect():
        assert r.low == r.high
        tasks.setdefault((r.kind, r.low), []).append(r.row)
    assert sorted(tasks.pop((1, 0))) == list(range(20))
    assert len(tasks) == 4 and len(set.intersection(*map(set, tasks.values()))) == 3
    assert sum(map(len, tasks.values())) == 100 + 3 * 3 and set().union(*tasks.values()) == set(range(100))


def test_texts_without_words_are_one_group(spark):
    rows = [(1, None), (2, " "), (3, " \n"), (4, "\t"), (5, "one word"), (6, " ")]
    assert sorted(simhash.drop_near_copies(documents(spark, rows)).select("doc_id").toPandas()["doc_id"]) in ([i, 5] if i < 5 else [5, i] for i in (1, 2, 3, 4, 6))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sets(st.integers(0, 12), min_size=1, max_size=10)), min_size=1, max_size=14))
def test_crossing_pairs_join_all_similar_sets(members):
    roots = np.array([r for r, _ in members])
    sets = [np.array(sorted(s), np.uint64) for _, s in members]
    got = simhash.crossing_pairs(roots, sets, 0.6)
    assert all(a < b for a, b in got)
    alike = {(min(r, q), max(r, q)) for r, s in members for q, t in members if len(s & t) >= 0.6 * len(s | t)}
    nodes = sorted(set(roots.tolist()))
    assert brute_components(nodes, lambda i, j: (i, j) in got or (j, i) in got) == brute_components(nodes, lambda i, j: (min(i, j), max(i, j)) in alike)


def brute_repeats(texts, length, keep_first=False):
    blobs = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out, seen = [], set()
    for b in blobs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if count[w] > 1 and not (keep_first and w not in seen):
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1024, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeated_strings(spark, monkeypatch, keep_first, most):
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", most)
    rng = random.Random(4)
    line, passage = prose(rng, 14), prose(rng, 60)
    rows = odd_rows()
    rows += [(200 + i, prose(rng, 20) + " " + line + " " + prose(rng, 20)) for i in range(25)]
    rows += [(300 + i, prose(rng, rng.randint(0, 9)) + passage[i : i + 210 + i] + prose(rng, 9)) for i in range(20)]
    rows += [(400 + i, passage + "".join(rng.choice("ab") for _ in range(150)) + passage) for i in range(4)]
    if keep_first:
        rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = suffix.remove_repeats(documents(spark, rows), length=100, keep_first=keep_first)
    wanted = Counter((doc, *r) for (doc, _), r in zip(rows, brute_repeats([t for _, t in rows], 100, keep_first), strict=True))
    assert Counter(tuple(r)[:5] for r in got.collect()) == wanted


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60))
def test_longest_previous_factors(text):
    lpf, source = suffix.previous_factors(text.encode())
    for i in range(len(text)):
        best = max((next((k for k in range(len(text) - i + 1) if k == len(text) - i or text[i + k] != text[j + k]), 0) for j in range(i)), default=0)
        assert lpf[i] == best
        assert source[i] == -1 if best == 0 else text[source[i] : source[i] + best] == text[i : i + best] and source[i] < i


def brute_tiles(a, b, least):
    """Greedy tiling by longest match first, from the definition: (place in a, place in b, length)."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best:
                    best, where = k, (i, j)
        if best < least:
            return tiles
        tiles.append((*where, best))
        used_a |= set(range(where[0], where[0] + best))
        used_b |= set(range(where[1], where[1] + best))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=25), st.lists(st.integers(1, 3), max_size=25))
def test_greedy_tiles_do_not_overlap_and_are_maximal(a, b):
    tiles = decontaminate.greedy_tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
    for side, k in ((a, 0), (b, 1)):
        used = [x for t in tiles for x in range(t[k], t[k] + t[2])]
        assert len(used) == len(set(used)) and all(x < len(side) for x in used)
    assert all(a[d : d + n] == b[i : i + n] and n >= 3 for d, i, n in tiles)
    free_a = [x if not any(d <= i < d + n for d, _, n in tiles) else -1 for i, x in enumerate(a)]
    free_b = [x if not any(j <= i < j + n for _, j, n in tiles) else -2 for i, x in enumerate(b)]
    assert brute_tiles(free_a, free_b, 3) == []
    assert tiles == brute_tiles(a, b, 3)


def test_coverage_against_brute_force(spark):
    """The whole query over texts of few words, where items, their pieces and chance matches overlap."""
    rng = random.Random(11)
    some = [prose(rng, 1) for _ in range(7)]
    items = [" ".join(rng.choice(some) for _ in range(rng.randint(4, 26))) for _ in range(7)]
    rows = odd_rows()[:12] + [(103, None), (104, "")]
    for i in range(60):
        piece = rng.choice(items).split()
        a = rng.randrange(len(piece))
        mixed = piece[a:] + [rng.choice(some) for _ in range(rng.randint(0, 8))] + piece[: a + rng.randint(0, 3)]
        rows.append((200 + i, rng.choice([" ", ", ", " - "]).join(w.upper() if i % 3 else w for w in mixed)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def words(text):
        return re.findall(r"[0-9a-z]+", (text or "").lower())

    wanted = []
    for doc, text in rows:
        for item, other in enumerate(items):
            tiles = brute_tiles(words(text), words(other), 5)
            covered, of = sum(n for *_, n in tiles), len(words(other))
            if tiles and covered >= 0.6 * of:
                wanted.append((doc, item, len(tiles), covered, of, covered / of))
    got = decontaminate.contaminated(documents(spark, rows), bench)
    assert Counter(map(tuple, got.collect())) == Counter(wanted) and len(wanted) > 30


def test_leaks_are_found_and_clean_documents_stay(spark):
    rng = random.Random(6)
    items = [prose(rng, 40) for _ in range(5)]
    words = items[0].split()
    moved = " ".join(words[20:] + ["between"] + words[:20])
    rows = odd_rows() + [(500, prose(rng, 50) + " " + items[1] + " " + prose(rng, 50)), (501, moved.upper()), (502, " ".join(words[:15])), (503, items[2] + " " + items[3])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "too short"), (None, "")], "item_id long, text string").withColumn("doc_id", decontaminate.F.lit(1))
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(500, 1), (501, 0), (503, 2), (503, 3)}
    assert got[501, 0].n_tiles == 2 and got[501, 0].coverage == 1.0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [prose(rng, 30) for _ in range(8)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, [(i, prose(rng, 10) + " " + t) for i, t in enumerate(items)])
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert len(decontaminate.blocks_of(bench)) > 2
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and len(whole) == 8


def test_empty_tables(spark):
    nothing = documents(spark, [])
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_copies(nothing).count() == 0
    assert suffix.remove_repeats(nothing).count() == 0


def written_by_shuffles(spark, run):
    """Bytes that the shuffles of ``run`` wrote, from the status store of Spark's own interface."""
    sc = spark.sparkContext
    group = f"measured-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
        sc._jsc.clearJobGroup()
    store = sc._jsc.sc().statusStore()
    total = 0
    for s in stages:
        found = store.stageData(s, False, getattr(store, "stageData$default$3")(), False, getattr(store, "stageData$default$5")())
        total += sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))
    return out, total


def test_near_copies_leave_texts_out_of_the_shuffles(spark, tmp_path):
    """Texts that are nobody's copy go through no shuffle, broadcasts of whole tables or not."""
    rng = random.Random(33)
    texts = ["".join(chr(rng.randrange(97, 123)) if rng.random() < 0.85 else " " for _ in range(8000)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[0]), (1001, texts[1] + " more")]
    documents(spark, rows).write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, moved = written_by_shuffles(spark, lambda: simhash.drop_near_copies(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id for r in kept} >= set(range(2, 120)) and len(kept) == 120
    assert 0 < moved < sum(map(len, texts)) / 2


@pytest.mark.parametrize("most", [16_384, 0])
def test_rows_standing_in_a_set_of_numbers(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BITMAPS", most)
    rng = random.Random(8)
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, (5 << 33), (5 << 33) + 1, 2**62]
    numbers += [rng.randrange(100_000) for _ in range(200)]
    rows = spark.createDataFrame([(n, str(n)) for n in numbers] + [(None, "none")], "row long, `odd ``name` string").withColumn("bucket", F.lit("clash"))
    chosen = set(numbers[::3]) | {99_999_999}
    some = spark.createDataFrame([(n,) for n in [*chosen, 7, 7]], "any long")
    inside = common.standing(rows, "row", some)
    assert inside.columns == rows.columns
    assert sorted(r.row for r in inside.collect()) == sorted(n for n in numbers if n in chosen | {7})
    outside = common.standing(rows, "row", some, keep=False).collect()
    assert Counter(r.row for r in outside) == Counter([n for n in numbers if n not in chosen | {7}] + [None])
    assert common.standing(rows, "row", some.limit(0)).count() == 0 and common.standing(rows, "row", some.limit(0), keep=False).count() == len(numbers) + 1
