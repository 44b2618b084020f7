import hashlib
import json

import numpy as np
import pytest

from statewatch.sources import tables
from statewatch.sources.packedbits import PackedBits


@pytest.fixture(scope="module")
def packed(tmp_path_factory):
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (50, 13)).astype(np.uint8)
    path = tmp_path_factory.mktemp("bits") / "events.b8"
    path.write_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes())
    return str(path), bits


def test_packed_bits_ranges(spark, packed):
    path, bits = packed
    spark.dataSource.register(PackedBits)
    reader = lambda **o: spark.read.format("packedbits").options(bits=13, **o).load(path)
    whole = reader(records=50, range_bytes=14)
    assert whole.rdd.getNumPartitions() == 8
    assert {r.shot: list(r.bits) for r in whole.collect()} == {i: list(b) for i, b in enumerate(bits)}
    part = reader(start=7, stop=11).collect()
    assert sorted(r.shot for r in part) == [7, 8, 9, 10]
    for bad in ({"records": 51}, {"start": 3, "stop": 60}):
        with pytest.raises(Exception):
            reader(**bad).collect()


def test_packed_bits_rejects_padding(spark, tmp_path):
    path = tmp_path / "bad.b8"
    path.write_bytes(bytes([0xFF, 0xFF]))
    spark.dataSource.register(PackedBits)
    with pytest.raises(Exception, match="padding"):
        spark.read.format("packedbits").option("bits", 13).load(str(path)).collect()


def test_snapshots(spark, tmp_path):
    entry = lambda state, bits: {"metadata": {"logical_state": state, "basis": "Z"}, "per_shot_cregs": {"a": bits, "b": bits}}
    path = tmp_path / "s.json"
    path.write_text(json.dumps([entry(0, [[0, 1], [1, 1]]), entry(1, [[1, 0], [0, 0]])]))
    out = tables.load_snapshots(spark, str(path), "1", ["a", "b"])
    assert sorted((r.shot, r.position, r.bit) for r in out["a"].collect()) == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 0)]
    with pytest.raises(Exception, match="no register"):
        tables.load_snapshots(spark, str(path), "1", ["c"])
    with pytest.raises(Exception, match="expected one entry"):
        tables.load_snapshots(spark, str(path), "2", ["a"])
    path.write_text(json.dumps([entry(0, [[0, 2]])]))
    with pytest.raises(Exception, match="bits"):
        tables.load_snapshots(spark, str(path), "0", ["a"])["a"].collect()


def test_outcomes_validate_the_slice_only(spark, tmp_path):
    path = tmp_path / "o.01"
    path.write_text("0\n1\nx\n1\n0\n")
    got = tables.load_outcomes(spark, str(path), 3, 5, expected=5).collect()
    assert sorted((r.shot, r.bit) for r in got) == [(3, 1), (4, 0)]
    with pytest.raises(Exception, match="0 or 1"):
        tables.load_outcomes(spark, str(path), 1, 4).collect()
    with pytest.raises(ValueError):
        tables.load_outcomes(spark, str(path), expected=4)


def test_csv_labels_and_exact_doubles(spark, tmp_path):
    rows = [(1, 0.1 + 0.2, "no_change"), (2, 1e-17, "NA"), (3, float("inf"), "null")]
    tables.write_table(spark.createDataFrame(rows, "id int, v double, y string"), str(tmp_path / "t"), "csv")
    back = tables.load_labelled(spark, str(tmp_path / "t"), ["v"], "y", "id", "id int, v double, y string")
    got = {r.id: r for r in back.where("id < 3").collect()}
    assert {i: r.label for i, r in got.items()} == {1: "no_change", 2: "NA"}
    assert got[1].features == [0.1 + 0.2] and got[2].features == [1e-17]
    bad = spark.createDataFrame([(1, float("nan"), "a")], "id int, v double, y string")
    with pytest.raises(Exception, match="finite"):
        tables.labelled(bad, ["v"], "y", "id").collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    row = tables.file_manifest(spark, str(tmp_path / "m")).first()
    assert row.bytes == 3 and row.sha256 == hashlib.sha256(b"abc").hexdigest()


def test_folder_manifest_joins_files_in_order(spark, tmp_path):
    lines = spark.range(2300, numPartitions=1).selectExpr("id % 2 AS shard", "CAST(id AS STRING) AS value").sortWithinPartitions("shard")
    lines.write.option("maxRecordsPerFile", 1).partitionBy("shard").text(str(tmp_path / "f"))  # part numbers beyond 999
    got = {r.folder[-1]: (r.bytes, r.sha256) for r in tables.folder_manifest(spark, str(tmp_path / "f")).collect()}
    for shard in (0, 1):
        text = "".join(f"{i}\n" for i in range(shard, 2300, 2)).encode()
        assert got[str(shard)] == (len(text), hashlib.sha256(text).hexdigest())


def test_snapshot_entries(spark, tmp_path):
    entry = lambda state, first, bits: json.dumps({"metadata": {"s": state, "first": first}, "per_shot_cregs": {"a": bits}})
    path = tmp_path / "s.json"
    path.write_text("\n".join([entry("x", "0", [[0, 1], [1, 1]]), entry("x", "2", [[1, 0]]), entry("y", "0", [[0]])]))
    rows = tables.load_snapshot_entries(spark, str(path), "a", ["s", "first"]).collect()
    assert sorted(map(tuple, rows)) == [("x", "0", 0, 0, 0), ("x", "0", 0, 1, 1), ("x", "0", 1, 0, 1), ("x", "0", 1, 1, 1), ("x", "2", 0, 0, 1), ("x", "2", 0, 1, 0), ("y", "0", 0, 0, 0)]
    path.write_text("\n".join([entry("x", "0", [[0]]), entry("x", "0", [[1]])]))
    with pytest.raises(ValueError, match="repeat"):
        tables.load_snapshot_entries(spark, str(path), "a", ["s", "first"])
    path.write_text(entry("y", "0", [[2]]))
    with pytest.raises(Exception, match="bits"):
        tables.load_snapshot_entries(spark, str(path), "a", ["s", "first"]).collect()


def test_written_snapshots_are_bounded(spark, monkeypatch, tmp_path):
    """No line holds more than a run of shots, and none of the eight shards is one file."""
    from statewatch.catalog import shaping_queries as S

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(S, "RUN", 7, raising=False)
    monkeypatch.setattr(S, "LINES", 50, raising=False)
    monkeypatch.setattr(S, "shared_folder", lambda s: str(tmp_path))
    S.load_snapshots(spark, sf).collect()
    rows = spark.read.schema(tables.SNAPSHOT).json(f"{tmp_path}/snapshots-*").selectExpr("size(per_shot_cregs.checks) AS n").collect()
    assert len(rows) > 5 and max(r.n for r in rows) <= 7
    S.manifest(spark, sf).collect()
    lines = spark.read.text(f"{tmp_path}/manifest-*").selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()
    assert max(r["count"] for r in lines) <= 50
