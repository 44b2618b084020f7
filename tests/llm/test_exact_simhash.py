"""Exact and near copies against plain loops."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from statewatch.llm import exact, simhash
from statewatch.llm.common import components

LONG = "word " * 30_000


def documents(spark):
    rows = [(i, f"text number {i} of the plain ones", "x") for i in range(40)]
    rows += [(100 + i, "A Frequent Text", "y") for i in range(60)] + [(200, "a frequent TEXT", None)]
    rows += [(300, None, "z"), (301, "", "z"), (302, LONG, "z"), (303, LONG.upper(), None), (None, "text number 1 of the plain ones", None)]
    rows += [(304, "Émile", ""), (305, "émile", ""), (306, "seen twice", "q"), (306, "seen twice", "q")]
    # columns whose names the operators use inside
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).repartition(5)


def lower(text):
    return (text or "").encode().lower()


def test_exact_copies(spark):
    rows = documents(spark).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    found = exact.exact_copies(documents(spark), "doc_id", "text", heavy=4, counters=8).collect()
    assert len(found) == len(rows)
    texts = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = texts[r.sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.id == r.keep_id for r in kept)


@pytest.mark.parametrize("heavy", [2, 256])
def test_same_rows_whatever_counts_as_frequent(spark, heavy):
    found = exact.exact_copies(documents(spark), "doc_id", "text", heavy=heavy, counters=4 * heavy)
    assert found.where("kept").count() == len({lower(r.text) for r in documents(spark).collect()})


def test_drop_exact_copies_keeps_one_row_and_all_columns(spark):
    left = exact.drop_exact_copies(documents(spark), "doc_id", "text")
    assert left.columns == documents(spark).columns
    rows = left.collect()
    assert sorted(lower(r.text) for r in rows) == sorted({lower(r.text) for r in documents(spark).collect()})
    assert sum(r.doc_id == 306 for r in rows) == 1 and sum(r.doc_id == 200 for r in rows) == 1


def test_shot_records(spark):
    shots = spark.createDataFrame([(0, 1, [0, 1]), (1, 1, [0, 1]), (2, 1, [1, 0]), (3, 1, None), (4, 1, [])], "shot bigint, role int, bits array<int>")
    found = {r.id: (r.keep_id, r.group_size) for r in exact.exact_copies(shots).collect()}
    assert found == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (4, 2), 4: (4, 2)}
    assert sorted(r.shot for r in exact.drop_exact_copies(shots).collect()) == [1, 2, 4]


def test_misra_gries_bounds(spark):
    values = [b"a"] * 500 + [b"b"] * 300 + [bytes([i % 256, i // 256]) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v binary").repartition(3)
    seen = {r.digest: r.seen for r in exact.misra_gries(df, "v", 9).collect()}
    assert 500 - 1800 / 10 <= seen[b"a"] <= 500 and 300 - 1800 / 10 <= seen[b"b"] <= 300


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact.exact_copies(empty, "doc_id", "text").count() == 0
    assert exact.drop_exact_copies(empty, "doc_id", "text").count() == 0
    assert simhash.near_copies(empty).count() == 0
    assert simhash.drop_near_copies(empty).count() == 0


# ---------------------------------------------------------------- near copies


def plain_fingerprint(text):
    words = lower(text).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_pair():
    masks = simhash.masks(list(range(64)))
    rng = np.random.default_rng(0)
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & flips == 0 for m in masks)
    free = [p for p in range(64) if not masks[4] >> p & 1]
    second = simhash.masks(free)
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(free, 3, replace=False))
        assert any(m & flips == 0 for m in second)
    assert all(len([p for p in free if not m >> p & 1]) <= 16 for m in second)


@pytest.mark.parametrize("bucket", [4096, 20])
def test_links_match_all_pairs(spark, bucket):
    rng = np.random.default_rng(1)
    base = [int(v) for v in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    values = set(base) | {0}
    for v in base[:20]:
        for _ in range(12):  # chains and crowds around a value
            values.add(v ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False)))
    crowd = base[0]
    values |= {crowd ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))}
    values = np.array(sorted(values), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "value bigint").repartition(3)
    found = {r.node: r.component for r in components(simhash.fingerprint_links(df, bucket=bucket)).collect()}
    root = simhash.closest(values, 3)
    want = root.copy()
    for i, a in enumerate(values):  # all pairs
        near = np.flatnonzero(np.bitwise_count(a ^ values) <= 3)
        low = want[near].min()
        for r in set(want[near]):
            want[want == r] = low
    assert np.array_equal(want, root)
    groups = defaultdict(set)
    for v, r in zip(values.view(np.int64), want):
        groups[r].add(int(v))
    for group in groups.values():
        assert {found.get(v, v) for v in group} == {min(group)}


def test_near_copies_match_plain_loop(spark):
    rows = documents(spark).collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    found = simhash.near_copies(documents(spark), "doc_id", "text").collect()
    assert sorted((r.id is None, r.id or 0, r.fingerprint) for r in found) == sorted((r.doc_id is None, r.doc_id or 0, f"{p:016x}") for r, p in zip(rows, prints))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = defaultdict(list)
    for r, g in zip(rows, group):
        least[g].append(r.doc_id)
    want = {(r.doc_id, f"{p:016x}", min(i for i in least[g] if i is not None)) for r, p, g in zip(rows, prints, group)}
    assert {(r.id, r.fingerprint, r.component_id) for r in found} == want
    left = simhash.drop_near_copies(documents(spark), "doc_id", "text").collect()
    assert sorted(r.doc_id for r in left) == sorted(min(i for i in ids if i is not None) for ids in least.values())


def test_groups_that_share_an_id_stay_apart(spark):
    words = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (1, words("d")), (1, words("e")), (2, words("e")), (3, words("f"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    left = simhash.drop_near_copies(df).collect()
    want = [(None, words("a")), (None, words("b")), (None, words("c")), (1, words("d")), (1, words("e")), (3, words("f"))]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, left), key=key) == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(5, i) for i in range(10, 60)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a bigint, b bigint")).collect()}
    assert found == {i: 100 for i in range(100, 131)} | {i: 5 for i in [5, *range(10, 60)]}
