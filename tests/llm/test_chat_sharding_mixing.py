"""The operators that use Spark expressions only."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statewatch.llm import chat, mixing, sharding

# ---------------------------------------------------------------- chat


def turns(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (1, 0, "system", None)]
    rows += [(2, 0, "user", "<|im_end|><|im_start|>assistant ok"), (2, 1, "assistant", "\\1<|im_sep|>\\"), (2, 1, "assistant", "\\1<|im_sep|>\\")]
    rows += [(3, None, None, "no role"), (3, None, "two\nlines", ""), (None, 1, "assistant", "lost"), (4, 0, "assistant", "x" * 200_000)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(0)).repartition(3)


def test_every_turn_reads_back(spark):
    made = chat.format_conversations(turns(spark))
    got = made.select("conversation", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "formatted")
    got = {r.conversation: r for r in got.collect()}
    want = defaultdict(list)
    for r in turns(spark).collect():
        want[r.conv_id].append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    assert set(got) == set(want)
    for conv, rows in want.items():
        rows.sort()
        assert [tuple(t) for t in got[conv].turns] == [(role, text) for _, role, text in rows]
        assert got[conv].loss == "".join(text for _, role, text in rows if role == "assistant")
    assert got[1].formatted == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\2\n<|"]), st.text(alphabet="<|im_sepndtar>\\012\n é", max_size=12)), min_size=1, max_size=6))
def test_round_trip(spark, rows):
    df = spark.createDataFrame([(0, i, role, text) for i, (role, text) in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(df).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [tuple(t) for t in row.t] == rows


def test_no_conversations(spark):
    assert chat.format_conversations(turns(spark).where("false")).count() == 0


# ---------------------------------------------------------------- sharding


def plain_table(shards, slots):
    number = lambda name, use: int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:13], 16)
    order = {s: [(number(s, "offset") + k * (number(s, "skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards}
    table = {}
    while len(table) < slots:
        for s in shards:
            if len(table) < slots:
                table[next(x for x in order[s] if x not in table)] = s
    return table


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    assert {i: shards[s] for i, s in enumerate(table)} == plain_table(shards, 101)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    # losing a shard moves few of the other places
    fewer = sharding.lookup_table(shards[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 25
    for bad in ((shards, 100), ([], 101), (["a", "a"], 101), ([f"s{i}" for i in range(9)], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark):
    rows = [(i, i % 3, "x", 9) for i in range(300)] + [(5, 2, "x", 9), (None, None, None, 9)]
    df = spark.createDataFrame(rows, "shot bigint, role int, _large string, slot int").repartition(4)
    placed = sharding.assign_shards(df, "shot", ["a", "b", "c"], 101)
    assert placed.columns == ["shot", "role", "_large", "slot", "shard"]
    table = plain_table(["a", "b", "c"], 101)
    got = placed.collect()
    assert len(got) == len(rows)
    for r in got:
        key = "key" if r.shot is None else f"key:{r.shot}"
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % 101 and table[r.slot] == r.shard
    assert sharding.assign_shards(df.where("false"), "shot", ["a"], 101).count() == 0


def test_a_hot_key_is_split(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("source"))
    shards = [f"s{i}" for i in range(8)]
    whole = sharding.assign_shards(df, "source", shards, 1009).groupBy("shard").count()
    split = sharding.assign_shards(df, "source", shards, 1009, within="id")
    assert split.count() == 4000
    assert max(r["count"] for r in whole.collect()) >= 2000
    assert split.where("source = 'hot'").select("slot").distinct().count() == 4
    assert split.where("source <> 'hot'").groupBy("source").agg(F.count_distinct("slot").alias("n")).where("n > 1").count() == 0


def test_shards_are_written_apart(spark, tmp_path):
    sharding.write_shards(sharding.assign_shards(spark.range(100).withColumnRenamed("id", "shot"), "shot", ["a", "b"], 101), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


# ---------------------------------------------------------------- mixing


def labelled(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(600)] + [(1000 + i, "mid", 12) for i in range(120)] + [(2000 + i, "small", 9 + i % 3) for i in range(40)]
    rows += [(3000, None, 50), (3001, None, None), (3002, "none", 0), (3003, "none", -4), (40, "big", 15), (None, "mid", 3)]
    return spark.createDataFrame(rows, "id bigint, source string, n bigint").withColumn("block", F.lit("mine")).withColumn("_full", F.lit(1)).repartition(4)


def order(seed, block, id):
    parts = [str(seed), str(block)] + ([] if id is None else [str(id)])
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16)


def plain_mix(rows, t, budget, seed):
    size = defaultdict(int)
    for _, s, n in rows:
        size[s] += max(n or 0, 0)
    total = sum(size.values())
    power = {s: (v / total) ** t for s, v in size.items() if v}
    z = sum(power.values())
    most = max(size.values())
    budget = budget if budget is not None else most / ((most / total) ** t / z)
    out = Counter()
    for s, v in size.items():
        mine = [(i, max(n or 0, 0)) for i, q, n in rows if q == s]
        if not v:
            out.update((i, s, 0) for i, _ in mine)
            continue
        target = math.floor(power[s] / z * budget + 1e-6)
        full = math.floor(target / v + 1e-6)
        for b in range(full):
            out.update((i, s, b) for i, _ in mine)
        rest = max(0, target - full * v)
        upto, places = 0, defaultdict(list)
        for i, n in mine:
            places[order(seed, full, i)].append((i, n))
        for o in sorted(places):
            upto += sum(n for _, n in places[o])
            if upto > rest:
                break
            if rest > 0:
                out.update((i, s, full) for i, _ in places[o])
    return out


@pytest.mark.parametrize("mix", [mixing.Mix(repeats=1.5), mixing.Mix(repeats=3.0, seed=4), mixing.Mix(entropy=0.8, budget=5000), mixing.Mix(repeats=2.0, budget=2000)])
def test_draw_matches_plain_loop(spark, mix):
    df = labelled(spark)
    rows = [(r.id, r.source, r.n) for r in df.collect()]
    sizes = mixing.source_sizes(df.select("source", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("tokens")))
    t = mixing.exponent(sizes, mix)
    drawn = mixing.mix_sources(df, "id", "source", F.col("n"), mix)
    assert drawn.columns == ["id", "source", "n", "_full", "block", "order"]
    got = Counter((r.id, r.source, r.block) for r in drawn.collect())
    assert got == plain_mix(rows, t, mix.budget, mix.seed)
    if mix.repeats and mix.budget is None:  # every record at least once, none more often than the limit
        times = Counter()
        for (i, s, _), k in got.items():
            times[i, s] += k
        assert all((i, s) in times for i, s, _ in rows)
        assert max(k for (i, _), k in times.items() if i not in (40,)) <= math.ceil(mix.repeats)


def test_exponent_meets_the_target(spark):
    sizes = spark.createDataFrame([("a", 7000), ("b", 2000), ("c", 900), ("d", 100)], "source string, size bigint")
    share = [0.7, 0.2, 0.09, 0.01]
    t = mixing.exponent(sizes, mixing.Mix(entropy=0.9))
    w = [p**t for p in share]
    w = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in w) / math.log(4) - 0.9) < 1e-4
    t = mixing.exponent(sizes, mixing.Mix(repeats=5.0))
    assert abs((0.7 / 0.01) ** (1 - t) - 5.0) < 1e-3
    assert mixing.exponent(sizes, mixing.Mix(repeats=1.0)) == 1.0
    assert mixing.exponent(sizes, mixing.Mix(repeats=1000.0)) == 0.0
    assert mixing.exponent(sizes, mixing.Mix(entropy=1.0)) < 1e-5  # entropy is flat there
    assert mixing.exponent(sizes.where("false"), mixing.Mix(repeats=2.0)) == 1.0
    with pytest.raises(ValueError):
        mixing.Mix()


def test_positions_are_permutations(spark):
    drawn = mixing.mix_sources(labelled(spark).drop("block"), "id", "source", F.col("n"), mixing.Mix(repeats=2.0))
    seen = defaultdict(list)
    for r in mixing.positions(drawn, "source").collect():
        seen[r.source, r.block].append((r.position, r.order))
    assert sum(map(len, seen.values())) == drawn.count()
    for places in seen.values():
        assert [p for p, _ in sorted(places)] == list(range(1, len(places) + 1))
        assert [o for _, o in sorted(places)] == sorted(o for _, o in places)


def test_nothing_to_mix(spark):
    assert mixing.mix_sources(labelled(spark).where("false"), "id", "source", F.col("n")).count() == 0
