"""A manifest of records: one digest per stream and over all streams, with a proof for each record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.functions.arrays import let
from statewatch.llm.exact import content_text
from statewatch.plans import place
from statewatch.plans.durable import durable

#: So many neighbouring nodes make one of the next level.
FAN = 8
#: Tables of at most so many rows (a row is a path of a few kilobytes) are broadcast.
SHIPPED = 4096
#: The tree over the streams. A stream's own tree is named ``n`` (NULL) or ``v`` and its name.
OVER = "w"


def spelled(value: Column) -> Column:
    """Byte count, colon and value of a field; ``-`` for NULL. Bit arrays count as their bits joined by commas."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def field_value(records: DataFrame, field: str) -> Column:
    if isinstance(records.schema[field].dataType, T.ArrayType):
        return F.when(F.col(field).isNotNull(), content_text(records, field))
    return F.col(field)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def spelled_hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def joined_hex(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: spelled_hex(c["digest"])), "")


def node_name(level: int, index: Column, tree: Column) -> Column:
    return F.concat(F.lit(f"{level}:"), index.cast("string"), F.lit(":"), tree)


def leaves(records: DataFrame, state: str, shot: str, fields: Sequence[str], received: Mapping[str, Column]) -> DataFrame:
    """``(tree, id, leaf, held)``: the digest of each record, and that of the record as received where it differs. Texts are read once."""
    values = {f: field_value(records, f) for f in fields}
    tree = F.coalesce(F.concat(F.lit("v"), F.col(state).cast("string")), F.lit("n"))
    leaf = digest(F.concat(*[spelled(v) for f, v in values.items()]))
    held = F.lit(None).cast("binary")
    if received:
        changed = F.lit(False)
        for f, v in received.items():
            changed = changed | ~v.cast("string").eqNullSafe(values[f].cast("string"))
        held = F.when(changed, digest(F.concat(*[spelled(received.get(f, v)) for f, v in values.items()])))
    return records.select(tree.alias("tree"), F.col(shot).alias("id"), leaf.alias("leaf"), held.alias("held"))


def climb(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of up to ``FAN`` neighbours of each tree: ``(tree, index, children, alone, node, digest)``, written once.

    A run is a node of the next level; a tree's only node is its top, and stays as it is (``alone``).
    """
    run = F.floor(F.col("index") / FAN).cast("bigint")
    child = F.struct("index", *[c for c in nodes.columns if c not in ("tree", "index")])
    runs = nodes.groupBy("tree", run.alias("index")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    first = F.get("children", F.lit(0))
    own = first["node"] if "node" in nodes.columns else node_name(level, F.col("index"), F.col("tree"))
    runs = runs.withColumn("alone", (F.col("index") == 0) & (F.size("children") == 1))
    runs = runs.withColumn("node", F.when(F.col("alone"), own).otherwise(node_name(level + 1, F.col("index"), F.col("tree"))))
    made = F.when(F.col("alone"), first["digest"]).otherwise(digest(joined_hex(F.col("children"))))
    return durable(runs.withColumn("digest", made), "runs")


def others(children: Column, at: Column) -> Column:
    """Digests of a run but for one, left to right."""
    rest = F.filter(children, lambda c, i: i != at)
    return F.unhex(joined_hex(rest))


def links(runs: DataFrame, over: bool) -> DataFrame:
    """``(node, ancestor, path, subroot)``: from each child of a run to the run's node, with the siblings on the way."""
    each = runs.select(F.col("node").alias("ancestor"), "children", F.posexplode("children").alias("at", "child"))
    step = F.struct(F.col("at").alias("place"), others(F.col("children"), F.col("at")).alias("others"))
    subroot = F.col("child.digest") if over else F.lit(None).cast("binary")
    return each.select(F.col("child.node").alias("node"), "ancestor", F.array(step).alias("path"), subroot.alias("subroot"))


def build(nodes: DataFrame, longest: int, over: bool) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """All levels of trees with at most ``longest`` leaves: the lowest runs, the links above them, and the trees' tops.

    For the tree over the streams (``over``) the links begin at its leaves.
    """
    made: list[DataFrame] = []
    tops: list[DataFrame] = []
    lowest: DataFrame | None = None
    for level in range(levels(longest) + 1):
        runs = climb(nodes, level)
        lowest = lowest or runs
        tops.append(runs.where("alone").select("tree", "node", "digest"))
        if level > 0 or over:
            made.append(links(runs.where(~F.col("alone")), over and level == 0))
        nodes = runs.where(~F.col("alone")).select("tree", "index", "node", "digest")
    return lowest, made, durable(reduce(DataFrame.unionByName, tops), "tops")


def jump(paths: DataFrame, root: str, steps: int) -> DataFrame:
    """Pointer jumping: ``steps`` links reach the root. Each self-join doubles the distance between a node and its ancestor and appends
    the ancestor's siblings to the node's. At distance d at most 8 ** d nodes share an ancestor, and only far ancestors, of which there are
    few, are broadcast."""
    reached = 1
    while reached < steps:
        further = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("path").alias("more"), F.col("subroot").alias("under"))
        moving = paths.where(F.col("ancestor") != root)
        targets = moving.select("ancestor").distinct()
        if targets.count() <= SHIPPED:
            further = F.broadcast(further.join(F.broadcast(targets), "ancestor", "left_semi"))
        moved = moving.join(further, "ancestor").select(
            "node", F.col("far").alias("ancestor"), F.concat("path", "more").alias("path"), F.coalesce("subroot", "under").alias("subroot")
        )
        paths = durable(paths.where(F.col("ancestor") == root).unionByName(moved), "paths")
        reached *= 2
    return paths


def levels(n: int) -> int:
    found = 0
    while n > 1:
        n, found = -(-n // FAN), found + 1
    return found


def put_in(rest: Column, place: Column, own: Column) -> Column:
    cut = place * 64
    return F.concat(F.substr(rest, F.lit(1), cut), own, F.substr(rest, cut + 1)).cast("binary")


def manifest_proofs(
    records: DataFrame, state: str = "state", shot: str = "shot", fields: Sequence[str] = ("state", "shot", "bits"),
    received: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Digest trees over detection-event records, and whether each record as received still leads to the root.

    Works on the project's records (a stream ``state``, a record number ``shot``, ``bits`` an array) and on any table with a stream, an id
    and further fields. A leaf is the SHA-256 of a record's ``fields``, each spelled as byte count, colon and value, ``-`` where NULL. In each
    stream the leaves ascend by ``shot``; every 8 neighbours make one node (the digest of their digests in hex) until one is left, the
    subroot. Subroots in the order of their streams (NULL first, then by bytes) make the root in the same way. ``received`` gives
    the values that a receiver holds instead. One row per record: ``id, leaf, subroot, root`` (hex), ``proof`` (array of the own place
    in a run and the digests of the others), ``proof_sha256, folded_root`` (from what was received and the proof), ``verified``.

    A run of 8 leaves is one row, for they share their path from the parent on. Its siblings towards the root come from self-joins that double
    the distance; leaves are taken apart at the end, each with its own siblings.

    Cases: NULL fields are spelled ``-``; records without a state form a stream of their own; records without a shot come first. Records with
    the same shot are ordered by leaf; repeated records are leaves of their own, whose proofs differ only in place. A lone leaf is its subroot,
    and the subroot of a lone stream is the root. Empty and very long texts are hashed whole. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    table = durable(leaves(records, state, shot, fields, received or {}), "leaves")
    placed = place(table, ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf")], rows_per_block=FAN**4)
    rows = placed.rows().select("tree", (F.col("t") - 1).alias("index"), "id", F.col("leaf").alias("digest"), "held")
    lowest, inner, subroots = build(rows, placed.longest, False)
    ranked = place(subroots, [], ["tree"], rows_per_block=FAN**4)
    streams = ranked.rows().select(F.lit(OVER).alias("tree"), (F.col("t") - 1).alias("index"), "node", "digest")
    _, upper, tops = build(streams, ranked.longest, True)
    top = tops.first()
    name, root = (top["node"], top["digest"].hex()) if top else ("", "")
    steps = max(levels(placed.longest) - 1, 0) + levels(ranked.longest)
    edges = durable(reduce(DataFrame.unionByName, [*inner, *upper]), "links")
    paths = jump(edges, name, steps).select("node", "path", "subroot")
    runs = lowest.select("node", "children", "alone").join(paths, "node", "left")
    each = runs.select("*", F.posexplode("children").alias("at", "child"))
    none = F.array().cast("array<struct<place:int,others:binary>>")
    own = F.when(F.col("alone"), none).otherwise(F.array(F.struct(F.col("at").alias("place"), others(F.col("children"), F.col("at")).alias("others"))))
    proved = each.select(
        F.col("child.id").alias("id"),
        F.col("child.digest").alias("digest"),
        F.coalesce("child.held", "child.digest").alias("held"),
        spelled_hex(F.col("subroot")).alias("subroot"),
        F.concat(own, F.coalesce("path", none)).alias("proof"),
    )
    # one child of a run: the own digest goes back to its place among the others
    folded = F.aggregate("proof", spelled_hex(F.col("held")), lambda own, step: let(spelled_hex(step["others"]), lambda rest: F.sha2(put_in(rest, step["place"], own), 256)))
    siblings = F.array_join(F.transform("proof", lambda step: spelled_hex(step["others"])), "")
    return proved.select(
        "id",
        spelled_hex(F.col("digest")).alias("leaf"),
        F.coalesce("subroot", F.lit(root)).alias("subroot"),
        F.lit(root).alias("root"),
        "proof",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
