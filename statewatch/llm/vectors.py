"""Near copies among labelled vectors, by product quantisation with an exact check.

Works on the project's labelled tables: rows ``(id, features, label)`` as ``statewatch.sources.labelled`` gives them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.llm.common import components, hashed_sample
from statewatch.plans.durable import durable

#: Rows of a list (and queries against it) that one task compares at a time.
TILE = 1024


@dataclass
class Quantiser:
    """Coarse centres (unit vectors), and for each subspace a codebook for the residuals."""

    centres: np.ndarray  # lists x d
    books: np.ndarray  # subspaces x codes x d / subspaces, zero padded

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest lists of each row, nearest first."""
        score = x @ self.centres.T
        k = min(probes, score.shape[1])
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)

    def reachable(self, x: np.ndarray, home: np.ndarray, radius: np.ndarray, least: float, among: np.ndarray | None = None) -> np.ndarray:
        """Rows x lists: whether a member of the list can have a cosine of at least ``least`` with the row. False is certain.

        A member lies within the list's ``radius`` (an angle) of its centre and no nearer to another centre; rows at most
        acos(least) apart differ by as much in their angle to a centre, and by sqrt(2 - 2 least) across the plane between two centres.
        """
        among = np.arange(len(self.centres)) if among is None else among
        centres, least = self.centres[among], min(max(least, -1.0), 1.0)
        score = x @ centres.T
        near = np.arccos(np.clip(score, -1, 1)) <= radius[among] + np.arccos(least) + 1e-6
        for h in np.unique(home):
            own = home == h
            apart = np.linalg.norm(centres - self.centres[h], axis=1)
            near[own] &= (x[own] @ self.centres[h])[:, None] - score[own] <= np.sqrt(2 - 2 * least) * apart + 1e-6
        return near

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        padded = np.zeros((len(x), m * w))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, w)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each lies from what its codes stand for."""
        parts = self.split(residual)
        codes = np.empty(parts.shape[:2], np.uint8)
        error = np.zeros(len(residual))
        for m, book in enumerate(self.books):
            gap = (parts[:, m] ** 2).sum(1)[:, None] - 2 * parts[:, m] @ book.T + (book**2).sum(1)
            codes[:, m] = gap.argmin(1)
            error += np.maximum(gap.min(1), 0)
        return codes, np.sqrt(error)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all codes: what a code adds to the cosine."""
        return np.einsum("qmw,mcw->qmc", self.split(queries), self.books)


def means(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, steps: int = 12) -> np.ndarray:
    """Lloyd's algorithm; a centre that loses all its rows moves to a random one."""
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = np.concatenate([(p @ centres.T - (0 if spherical else 0.5) * (centres**2).sum(1)).argmax(1) for p in np.array_split(x, len(x) // 4096 + 1)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        empty = counts == 0
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = x[rng.choice(len(x), empty.sum())]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit_quantiser(sample: np.ndarray, lists: int, subspaces: int = 8, codes: int = 256, seed: int = 0) -> Quantiser:
    rng = np.random.default_rng(seed)
    centres = means(sample, lists, rng, True)
    residual = sample - centres[(sample @ centres.T).argmax(1)]
    subspaces = min(subspaces, sample.shape[1])
    width = -(-sample.shape[1] // subspaces)
    books = np.zeros((subspaces, codes, width))
    shaped = Quantiser(centres, books).split(residual)
    for m in range(subspaces):
        found = means(shaped[:, m], codes, rng, False, 8)
        books[m] = found[np.arange(codes) % len(found)]
    return Quantiser(centres, books)


def bundled(centres: np.ndarray, size: int) -> np.ndarray:
    """A bundle number for each list: about ``size`` lists whose centres lie in the same direction share one."""
    heads = centres[np.random.default_rng(0).permutation(len(centres))[: -(-len(centres) // size)]]
    order = np.lexsort((np.arange(len(centres)), (centres @ heads.T).argmax(1)))
    out = np.empty(len(centres), np.int32)
    out[order] = np.arange(len(centres)) // size
    return out


def units(vectors: list) -> np.ndarray:
    """Unit vectors in double precision, without negative zeros."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def usable_rows(rows: DataFrame, id: str, features: str, label: str) -> DataFrame:
    """``(id, label, dim, key, vector)`` of the usable vectors; ``key`` is a digest of the unit vector."""
    element = rows.schema[features].dataType.elementType
    kind = element if isinstance(element, T.FloatType) else T.DoubleType()
    keep = [T.StructField("id", rows.schema[id].dataType), T.StructField("label", rows.schema[label].dataType)]
    schema = T.StructType([*keep, T.StructField("dim", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("vector", T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, dims, keys = [], [], []
            for row, v in enumerate(batch.column(2).to_pylist()):
                if not v or any(x is None for x in v):
                    continue
                top = max(map(abs, v))
                if not np.isfinite(v).all() or top == 0.0:
                    continue
                good.append(row)
                dims.append(len(v))
                keys.append(hashlib.blake2b(units([v])[0].tobytes(), digest_size=16).digest())
            kept = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), kept.column(2)], names=schema.names)

    usable = rows.where(F.col(label).isNotNull() & F.col(id).isNotNull() & F.col(features).isNotNull())
    return usable.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(features).cast(T.ArrayType(kind)).alias("x")).mapInArrow(run, schema)


def near_vectors(
    rows: DataFrame,
    id: str = "id",
    features: str = "features",
    label: str = "label",
    least: float = 0.93,
    list_rows: int = 512,
    most_lists: int = 16_384,
    sample: int = 16_384,
    tile: int = TILE,
) -> DataFrame:
    """Links between vectors of the same label whose cosine is at least ``least``, and the groups they form.

    One row per input row: ``id, n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable) and ``kept`` (it is its own).

    Equal vectors are one class; classes are searched, copies only counted. Coarse centres and residual codebooks are fitted on ``sample`` classes (by
    hash), every class is indexed in its nearest list. A class is looked up in every list of its label that ``Quantiser.reachable`` can't rule
    out, so no link is lost: the codes give its cosine with each member to within the member's quantisation error, so whatever could reach
    ``least`` is kept, and then checked in double precision. About ``list_rows`` classes share a list up to ``most_lists`` lists. Lists travel in
    bundles of about ``tile`` rows of a label, and two bundles meet once. Members and queries of a bundle are cut into tiles of about ``tile`` rows by hash, and a task
    compares two tiles, so a bundle of any size spreads out; a tile reports counts and a spanning set of links, never pairs.

    Cases: rows with NULL id or label, and vectors that are NULL, empty, zero, or hold NULL, NaN or infinite values, link with nothing. Vectors of different
    length don't link. Repeated rows link with each other and share the id. Ties at ``least`` are links. An empty table gives no rows.
    Other columns are not read.
    """
    spark = rows.sparkSession
    node = F.xxhash64("label", "dim", "key").alias("node")
    usable = durable(usable_rows(rows, id, features, label).select("id", node, "label", "dim", "vector"), "vectors")
    classes = usable.groupBy("node").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector")
    )
    classes = durable(classes, "classes")
    links = durable(found_links(spark, classes, least, list_rows, most_lists, sample, tile), "found")
    grouped = components(links.where("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "least", "copies").join(counted, "node", "left").join(grouped, "node", "left")
    known = known.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"))
    named = known.join(known.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("node", "n_links", "component_id")
    finished = usable.select("id", "node").join(durable(named, "named"), "node").select("id", "n_links", "component_id")
    finished = finished.withColumn("kept", F.col("id") == F.col("component_id"))
    # rows that link with nothing: as many of each id as are not among the usable ones
    count = usable.groupBy(F.col("id").alias("_i")).agg(F.count("*").alias("_u"))
    alone = rows.groupBy(F.col(id).alias("id")).agg(F.count("*").alias("_n")).join(count, F.col("id").eqNullSafe(F.col("_i")), "left")
    alone = alone.withColumn("_times", F.col("_n") - F.coalesce("_u", F.lit(0))).where("_times > 0")
    alone = alone.select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")).alias("_t"))
    alone = alone.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    return finished.unionByName(alone)


def found_links(spark, classes: DataFrame, least: float, list_rows: int, most_lists: int, sample: int, tile: int) -> DataFrame:
    """``(node, links, root)``: parts of each class's link count, and links that connect what is linked."""
    labels = classes.groupBy("dim", "label").agg(F.count("*").alias("n"))
    # with n, the size of the label that a class is in, on average over the classes
    sizes = labels.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("own")).collect()
    models: dict[int, Quantiser] = {}
    bundles: dict[int, np.ndarray] = {}
    for dim, n, own in sizes:
        taken = hashed_sample(classes.where(F.col("dim") == dim), F.col("node"), n, sample).select("vector").toArrow()
        x = units(taken["vector"].to_pylist())
        # a fit needs some rows for each centre; sixteen are enough
        models[dim] = fit_quantiser(x, int(min(most_lists, max(1, n // list_rows), max(1, len(x) // 16))))
        lists = len(models[dim].centres)
        bundles[dim] = bundled(models[dim].centres, max(1, round(tile * lists / own)))
    shared = spark.sparkContext.broadcast((models, bundles))
    label = classes.schema["label"]
    index_schema = T.StructType(
        [
            label,
            *[T.StructField(c, T.IntegerType()) for c in ("dim", "list", "bundle")],
            T.StructField("node", T.LongType()),
            T.StructField("copies", T.LongType()),
            T.StructField("angle", T.DoubleType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("error", T.DoubleType()),
            classes.schema["vector"],
        ]
    )

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, bundles = shared.value
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                model = models[dim]
                x = units(part["vector"].to_list())
                home = model.lists(x, 1)[:, 0]
                codes, error = model.encode(x - model.centres[home])
                angle = np.arccos(np.clip((x * model.centres[home]).sum(1), -1, 1))
                part = part.assign(list=home, bundle=bundles[dim][home], angle=angle, codes=[c.tobytes() for c in codes], error=error)
                yield part[index_schema.names]

    base = classes.select("label", "dim", "node", "copies", "vector")
    members = durable(base.mapInPandas(index, index_schema), "index")
    radii = {dim: np.full(len(model.centres), -np.inf) for dim, model in models.items()}
    for dim, list_, angle in members.groupBy("dim", "list").agg(F.max("angle")).collect():
        radii[dim][list_] = angle
    around = spark.sparkContext.broadcast(radii)
    asking_schema = T.StructType([f for f in index_schema if f.name != "angle"] + [T.StructField("near", T.ArrayType(T.IntegerType()))])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, bundles = shared.value
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                found = []
                for start in range(0, len(part), TILE):
                    some = part.iloc[start : start + TILE]
                    near = models[dim].reachable(units(some["vector"].to_list()), some["list"].to_numpy(), around.value[dim], least)
                    # of two bundles, the one with the smaller number asks the other
                    for row, own in zip(near, some["bundle"].to_numpy(), strict=True):
                        others = bundles[dim][row]
                        found.append(np.unique(np.append(others[others > own], own)).astype(np.int32))
                yield part.assign(near=found)[asking_schema.names]

    place = ["label", "dim", "bundle"]
    columns = ["list", "home", "node", "copies", "codes", "error", "vector"]
    homed = members.drop("angle").withColumn("home", F.col("bundle"))
    queries = members.mapInPandas(ask, asking_schema).withColumn("home", F.col("bundle")).withColumn("bundle", F.explode("near")).drop("near")
    sizes_ = members.groupBy(*place).agg(F.count("*").alias("m"))
    asked = queries.groupBy(*place).agg(F.count("*").alias("q"))
    cuts = sizes_.join(asked, place).select(*place, F.ceil(F.col("m") / tile).alias("mt"), F.ceil(F.col("q") / tile).alias("qt"))
    cuts = durable(cuts, "cuts")

    def dealt(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        placed = df.join(cuts, place)
        mine = F.pmod(F.xxhash64("node", F.lit(side)), F.col(own)).cast("int").alias("mine")
        spread = placed.select(*place, *columns, mine, F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int"))).alias("theirs"))
        a, b = ("mine", "theirs") if side else ("theirs", "mine")
        return spread.select(*place, F.col(a).alias("q_tile"), F.col(b).alias("m_tile"), F.lit(side).alias("side"), *columns)

    both = dealt(queries, "qt", "mt", 1).unionByName(dealt(homed, "mt", "qt", 0))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        query = pdf[pdf["side"] == 1].sort_values("list").reset_index(drop=True)
        member = pdf[pdf["side"] == 0].sort_values("list").reset_index(drop=True)
        empty = pd.DataFrame({"node": [], "links": [], "root": []}).astype({"node": "int64", "links": "int64", "root": "Int64"})
        if not len(query) or not len(member):
            return empty
        dim, bundle = int(pdf["dim"].iloc[0]), int(pdf["bundle"].iloc[0])
        model = shared.value[0][dim]
        q, x = units(query["vector"].to_list()), units(member["vector"].to_list())
        codes = np.frombuffer(b"".join(member["codes"]), np.uint8).reshape(len(member), -1)
        error = member["error"].to_numpy()
        here, list_ = np.unique(member["list"].to_numpy(), return_inverse=True)
        nodes = np.concatenate([query["node"].to_numpy(), member["node"].to_numpy()])
        unique, where = np.unique(nodes, return_inverse=True)
        root = np.arange(len(unique))
        counts = np.zeros(len(unique), np.int64)
        home, other = query["list"].to_numpy(), (query["home"] != bundle).to_numpy()
        of_query, of_member = query["copies"].to_numpy(), member["copies"].to_numpy()
        at_q, at_m = where[: len(query)], where[len(query) :]
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            near = model.reachable(part, home[a : a + 256], around.value[dim], least, here).any(0)
            some = np.flatnonzero(near[list_])
            if not len(some):
                continue
            tables = model.tables(part)
            score = (part @ model.centres[here].T)[:, list_[some]]
            for m in range(codes.shape[1]):
                score += tables[:, m, codes[some, m]]
            i, j = np.nonzero(score + error[None, some] >= least - 1e-9)
            j = some[j]
            good = np.empty(len(i), bool)
            for cut in range(0, len(i), 65_536):
                upto = slice(cut, cut + 65_536)
                good[upto] = np.einsum("ij,ij->i", part[i[upto]], x[j[upto]]) >= least
            i, j = i[good] + a, j[good]
            i, j = i[at_q[i] != at_m[j]], j[at_q[i] != at_m[j]]
            np.add.at(counts, at_q[i], of_member[j])
            # inside a bundle the member finds the query by itself
            blind = other[i]
            np.add.at(counts, at_m[j[blind]], of_query[i[blind]])
            u, v = at_q[i], at_m[j]
            while len(u):
                ru, rv = root[u], root[v]
                apart = ru != rv
                u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
                np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
                while not np.array_equal(root, root[root]):
                    root = root[root]
        linked = np.flatnonzero((counts > 0) | (root != np.arange(len(root))))
        if not len(linked):
            return empty
        to = pd.array(unique[root[linked]], dtype="Int64")
        to[root[linked] == linked] = pd.NA
        return pd.DataFrame({"node": unique[linked], "links": counts[linked], "root": to})

    tiles = [*place, "q_tile", "m_tile"]
    return both.groupBy(*tiles).applyInPandas(compare, "node bigint, links bigint, root bigint")
