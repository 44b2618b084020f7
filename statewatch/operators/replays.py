"""Replays of the scorer bank in lockstep: one task steps all replicates of a key together, so pairs are shuffled once, whatever the replicates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import doubles
from statewatch.functions.learners import pair_features, smoothing, spectral_effects, top_k_scores
from statewatch.operators.bank import BETS, L2, RATES, SPARSE_HALF_LIVES, SPECTRAL_HALF_LIVES, STRIDE, _Layout, eligible_ks
from statewatch.plans import draw_index
from statewatch.plans.guards import null_safe
from statewatch.plans.ordering import key_runs, shuffle_tasks

REPLAYED = ("rate", "logistic", "sparse", "spectral", "composite")
#: Steps between two looks at the size of the components: none can outgrow a double in between, since 1.9 ** 500 < 1e140.
LOOK, LARGE = 500, 1e140
#: Draws of one key that are replayed at a time.
DRAWN_AT_ONCE = 1 << 23
#: Result rows that leave a task together.
ROWS_OUT = 1 << 15


def row_features(r: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the learners see of paired bit rows: differences of features (n x p), of densities (n x q x q), and of rates (n)."""
    if not (np.isin(r, (0, 1)).all() and np.isin(m, (0, 1)).all()):
        raise ValueError("paired rows must be binary")
    zm, zr = 1 - 2 * m, 1 - 2 * r
    deltas = (np.einsum("ni,nj->nij", zm, zm) - np.einsum("ni,nj->nij", zr, zr)) / r.shape[1]
    return pair_features(m) - pair_features(r), deltas, m.mean(axis=1) - r.mean(axis=1)


class Replays:
    """Learners of all roles (first axis) in many replays (second axis), and the betting components of each method.

    Replays that have drawn the same so far share a place on the second axis until a draw parts them: ``group`` has the place of each replay
    and ``head`` a replay of each place.
    """

    def __init__(self, replays: int, q: int, methods: Sequence[str], horizon: int, warm: dict[object, np.ndarray] | None = None) -> None:
        self.q, self.p, self.ks, self.horizon, self.warm = q, q * (q + 1) // 2, eligible_ks(q), horizon, warm or {}
        self.methods = list(methods)
        both = ("sparse", "spectral") if "composite" in methods else ()
        self.parts = [m for m in REPLAYED[:-1] if m in methods or m in both]
        self.group, self.head = np.zeros(replays, np.int64), np.zeros(1, np.int64)
        self.places: dict[object, int] = {}
        experts = {"rate": 2, "logistic": len(RATES), "sparse": len(SPARSE_HALF_LIVES) * len(self.ks), "spectral": 2 * len(SPECTRAL_HALF_LIVES)}
        shapes = {
            "w": (len(RATES), self.p), "sparse": (len(SPARSE_HALF_LIVES), self.p), "spectral": (len(SPECTRAL_HALF_LIVES), q, q),
            "effects": (len(SPECTRAL_HALF_LIVES), 2, q, q), **{f"a_{m}": (experts[m], len(BETS)) for m in self.parts},
        }
        self.state = {n: np.zeros((0, 1, *s)) for n, s in shapes.items()}
        self.a_sparse = np.array([smoothing(h) for h in SPARSE_HALF_LIVES])[:, None]
        self.a_spectral = np.array([smoothing(h) for h in SPECTRAL_HALF_LIVES])[:, None, None]
        self.t, self.stepped = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.stale, self.fitted = np.zeros(0, bool), np.zeros(0, bool)
        self.logs = False
        self.shots = 0
        self.first = np.zeros((len(self.methods), 1), np.int64)
        self.top = np.full((len(self.methods), 1), -np.inf)
        self.last = np.full((len(self.methods), 1), np.nan)

    def part(self, drawn: np.ndarray) -> None:
        """Every replay makes a draw (one whole number each, from 0); places that are no longer shared are copied."""
        if len(self.head) == len(self.group):
            return
        code = self.group * (int(drawn.max()) + 1) + drawn
        _, head, group = np.unique(code, return_index=True, return_inverse=True)
        if len(head) != len(self.head):
            parents = self.group[head]
            self.state = {n: v[:, parents] for n, v in self.state.items()}
            self.first, self.top, self.last = self.first[:, parents], self.top[:, parents], self.last[:, parents]
        self.group, self.head = group.reshape(-1), head

    def role(self, role: object) -> int:
        """The place of a role on the first axis."""
        if role not in self.places:
            self.places[role] = len(self.t)
            warm = self.warm.get(role)
            given = {} if warm is None else _Layout(self.q).split(np.asarray(warm, float))
            for n, v in self.state.items():
                fresh = given.get(n, np.full(v.shape[2:], -np.inf if self.logs and n.startswith("a_") else 0.0))
                self.state[n] = np.concatenate([v, np.broadcast_to(fresh, (1, *v.shape[1:]))])
            self.t = np.append(self.t, int(given["t"][0]) if given else 0)
            self.stepped, self.stale = np.append(self.stepped, 0), np.append(self.stale, False)
            self.fitted = np.append(self.fitted, bool(given and given["effects"].any()))
        return self.places[role]

    def scores(self, at, d: np.ndarray, delta: np.ndarray, rate: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of a row of each role ``at`` before it is learned from, as roles x places x experts."""
        state, out, shape = self.state, {}, d.shape[:2]
        if "rate" in self.parts:
            out["rate"] = np.stack([rate, -rate], axis=-1)
        if "logistic" in self.parts:
            w = state["w"][at]
            margin = np.einsum("rgep,rgp->rge", w, d)
            out["logistic"] = np.clip(np.tanh(margin / np.maximum(1.0, np.abs(w).sum(axis=3))), -1.0, 1.0)
            small = np.exp(-np.abs(margin))
            miss = np.where(margin >= 0, small, 1.0) / (1.0 + small)
            state["w"][at] = w + np.array(RATES)[:, None] * (miss[..., None] * d[:, :, None] - L2 * w)
        if "sparse" in self.parts:
            mean = state["sparse"][at]
            x = np.broadcast_to(d[:, :, None], mean.shape).reshape(-1, self.p)
            out["sparse"] = top_k_scores(mean.reshape(-1, self.p), x, self.ks).reshape(*shape, -1)
            state["sparse"][at] = (1 - self.a_sparse) * mean + self.a_sparse * d[:, :, None]
        if "spectral" in self.parts:
            mean = state["spectral"][at]
            due = np.arange(len(self.t))[at]
            due = due[self.stale[due]]
            if len(due):  # one stacked eigenproblem for all replays and half-lives, made when a next row wants it
                state["effects"][due] = spectral_effects(state["spectral"][due].reshape(-1, self.q, self.q)).reshape(state["effects"][due].shape)
                self.stale[due], self.fitted[due] = False, True
            if self.fitted[at].any():
                effects = state["effects"][at].reshape(*shape, -1, self.q * self.q)
                out["spectral"] = np.clip(np.einsum("rgex,rgx->rge", effects, delta.reshape(*shape, -1)), -1.0, 1.0)  # both are symmetric
            else:
                out["spectral"] = np.zeros((*shape, 2 * len(SPECTRAL_HALF_LIVES)))
            state["spectral"][at] = (1 - self.a_spectral) * mean + self.a_spectral * delta[:, :, None]
        self.t[at] += 1
        self.stepped[at] += 1
        self.stale[at] = self.t[at] % STRIDE == 0
        return out

    def step(self, at, d: np.ndarray, delta: np.ndarray, rate: np.ndarray) -> dict[str, np.ndarray]:
        """Log of each method's mean component, as roles x places: ``A <- f (A + 1 / horizon)``."""
        out = {}
        with np.errstate(divide="ignore"):
            if not self.logs and int(self.stepped.max(initial=0)) % LOOK == 0 and max(self.state[f"a_{m}"].max(initial=0.0) for m in self.parts) > LARGE:
                self.logs = True
                self.state.update({f"a_{m}": np.log(self.state[f"a_{m}"]) for m in self.parts})
            for name, score in self.scores(at, d, delta, rate).items():
                f = 1.0 + score[..., None] * np.array(BETS)  # positive: scores and bets are at most 1 and 0.9
                a = self.state[f"a_{name}"]
                if self.logs:
                    a[at] = np.log(f) + np.logaddexp(a[at], -math.log(self.horizon))
                    out[name] = np.logaddexp.reduce(a[at].reshape(*f.shape[:2], -1), axis=2) - math.log(f.shape[2] * f.shape[3])
                else:
                    a[at] = f * (a[at] + 1.0 / self.horizon)
                    out[name] = np.log(a[at].mean(axis=(2, 3)))
        if "composite" in self.methods:
            out["composite"] = np.logaddexp(out["sparse"], out["spectral"]) - math.log(2.0)
        return out

    def shot(self, roles: Sequence[object], d: np.ndarray, delta: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step the rows of one shot (first axis) and return methods x rows x places, and the steps their roles have made."""
        at = np.array([self.role(r) for r in roles])
        if len(at) == len(self.t) and (at == np.arange(len(self.t))).all():
            made = self.step(slice(None), d, delta, rate)
            return np.stack([made[m] for m in self.methods]), self.stepped.copy()
        out, steps = np.empty((len(self.methods), len(at), len(self.head))), np.empty(len(at), np.int64)
        turn = np.array([(at[:i] == a).sum() for i, a in enumerate(at)])
        for k in range(int(turn.max()) + 1):  # a second row of a role follows its first
            mine = np.flatnonzero(turn == k)
            made = self.step(at[mine], d[mine], delta[mine], rate[mine])
            out[:, mine], steps[mine] = np.stack([made[m] for m in self.methods]), self.stepped[at[mine]]
        return out, steps

    def evidence(self, parts: np.ndarray, at: int, level: float) -> None:
        """A complete shot: the mean over its rows plus the mass that has not started."""
        tail = max((self.horizon - at) / self.horizon, 0.0)
        own = np.logaddexp.reduce(parts, axis=1) - math.log(parts.shape[1])
        stat = np.logaddexp(own, math.log(tail) if tail > 0 else -np.inf)
        self.shots += 1
        self.last, self.top = stat, np.maximum(self.top, stat)
        self.first[(stat >= level - 1e-12) & (self.first == 0)] = at


def _plain(values: np.ndarray) -> list:
    return [None if pd.isna(v) else v for v in values.tolist()]


def _joined(held: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def _named(key: Sequence[str], name: tuple, n: int) -> dict[str, np.ndarray]:
    """The key columns of ``n`` result rows; values stay as they are, missing ones too."""
    out = {}
    for k, v in zip(key, name, strict=True):
        out[k] = np.empty(n, dtype=object)
        out[k][:] = [v] * n
    return out


def swap_audit_lockstep(
    pairs: DataFrame, key: Sequence[str], role: str, pair: Sequence[str], ref: str, mon: str, q: int, roles: int, replicates: int, seed: int,
    methods: Sequence[str] = ("logistic", "sparse", "spectral", "composite"), alpha: float = 0.01, family: float = 600.0,
    bits: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``swap_audit`` from cold learners, with all replicates of a key in one task.

    Pairs move once, to the task of their key, and stream through it in the order of their shots; in memory are only the learners of the key's
    roles. A swapped pair only changes the sign of its features. ``bits(replicate)`` says whether a replicate swaps a shot; by default the hash of
    ``swap_pairs``, so that both give the same rows.
    """
    if set(methods) - set(REPLAYED):
        raise ValueError(f"methods must be among {REPLAYED}")
    key, pair, methods = list(key), list(pair), list(methods)
    sizes = pairs.groupBy(*key).agg(F.count_distinct(*[F.col(c) for c in pair]).alias("_H"))
    rows = null_safe(pairs.select(*key, *pair, role, doubles(ref).alias("_r"), doubles(mon).alias("_m")), sizes, key)
    ordered = rows.repartition(shuffle_tasks(rows), *key).sortWithinPartitions(*key, *pair, role)
    drawn = bits or (lambda r: draw_index(2, seed, r, *[F.col(c) for c in [*key, *pair]]) == 1)
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))
    ordered = ordered.withColumn("_s", F.transform(copies, lambda r: F.when(drawn(r), 1).otherwise(0).cast("tinyint")))
    level = -math.log(alpha)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, shot, replay, waiting = None, None, None, []  # rows of the present shot wait for the rest of it
        held: list[dict[str, np.ndarray]] = []

        def close() -> None:
            names = [n for part in waiting for n in part[0]]
            d, delta, rate, s = (np.concatenate([part[i] for part in waiting]) for i in range(1, 5))
            waiting.clear()
            for draw in s[:1] if (s == s[0]).all() else s:
                replay.part(draw)
            sign = np.where(s[:, replay.head] == 1, -1.0, 1.0)
            found, steps = replay.shot(names, sign[:, :, None] * d[:, None], sign[:, :, None, None] * delta[:, None], sign * rate[:, None])
            if len(names) == roles:
                replay.evidence(found, int(steps[-1]), level)

        def ended() -> dict[str, np.ndarray]:
            g, n = replay.group, replicates * len(methods)
            first = replay.first[:, g].ravel()
            return {
                **_named(key, last, n), "replicate": np.tile(np.arange(replicates), len(methods)), "method": np.repeat(np.array(methods, object), replicates),
                "crossed": first > 0, "first_crossing": first, "max_log_e": np.maximum(replay.top[:, g], 0.0).ravel(),
                "final_log_e": replay.last[:, g].ravel(), "shots": np.full(n, replay.shots),
            }

        def out() -> pd.DataFrame:
            made = _joined(held)
            held.clear()
            made["first_crossing"] = made["first_crossing"].astype("Int64").mask(~made["crossed"])
            return made

        for pdf in batches:
            if not len(pdf):
                continue
            r, m = (np.stack(list(pdf[c])).astype(float) for c in ("_r", "_m"))
            d, delta, rate = row_features(r, m)
            s, names, horizon = np.stack(list(pdf["_s"])).astype(np.int64), _plain(pdf[role].to_numpy()), pdf["_H"].to_numpy()
            for name, a, b in key_runs(pdf, [*key, *pair]):
                if waiting and name != shot:
                    close()
                if name[: len(key)] != last:
                    if replay is not None:
                        held.append(ended())
                        if sum(len(h["replicate"]) for h in held) >= ROWS_OUT:
                            yield out()
                    last, replay = name[: len(key)], Replays(replicates, q, methods, int(horizon[a]))
                shot = name
                waiting.append((names[a:b], d[a:b], delta[a:b], rate[a:b], s[a:b]))
        if replay is not None:
            close()
            held.append(ended())
            yield out()

    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = "".join(f"`{k}` {fields[k]}, " for k in key)
    schema += "replicate bigint, method string, crossed boolean, first_crossing bigint, max_log_e double, final_log_e double, shots bigint"
    out = ordered.mapInPandas(run, schema)
    return out.withColumn("crossed_family", F.col("max_log_e") >= math.log(family))


# ---------------------------------------------------------------- replays of drawn shots


class KeyPairs:
    """The paired rows of one key by shot and role."""

    def __init__(self, index: np.ndarray, role: Sequence[object], r: np.ndarray, m: np.ndarray) -> None:
        self.shots, spot = np.unique(index, return_inverse=True)
        self.roles = list(dict.fromkeys(role))
        of = {x: i for i, x in enumerate(self.roles)}
        place = np.array([of[x] for x in role])
        order = np.lexsort((place, spot))
        self.place, self.starts = place[order], np.searchsorted(spot[order], np.arange(len(self.shots) + 1))
        self.d, self.delta, self.rate = row_features(r[order], m[order])
        whole = len(order) == len(self.shots) * len(self.roles)
        self.even = whole and (self.place.reshape(-1, len(self.roles)) == np.arange(len(self.roles))).all()

    def spots(self, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the drawn shots are, and which of them the key has."""
        at = np.minimum(np.searchsorted(self.shots, drawn), len(self.shots) - 1)
        return at, self.shots[at] == drawn

    def replay(self, drawn: np.ndarray, q: int, roles: int, method: str, horizon: int, warm: dict) -> np.ndarray:
        """The largest log e-value of each replay (a row of ``drawn``: spots in order); NaN where no shot is complete."""
        n = len(self.roles)
        if not self.even and len(drawn) > 1:  # replays step different roles, so one follows the other
            return np.concatenate([self.replay(drawn[i : i + 1], q, roles, method, horizon, warm) for i in range(len(drawn))])
        replays = Replays(len(drawn), q, [method], horizon, warm)
        if self.even and n != roles:
            return np.full(len(drawn), np.nan)
        for draw in drawn.T:
            replays.part(draw)
            if self.even:
                rows = draw[replays.head] * n + np.arange(n)[:, None]
                found, steps = replays.shot(self.roles, self.d[rows], self.delta[rows], self.rate[rows])
                replays.evidence(found, int(steps[0]), math.inf)
                continue
            rows = np.arange(self.starts[draw[0]], self.starts[draw[0] + 1])
            found, steps = replays.shot([self.roles[i] for i in self.place[rows]], self.d[rows, None], self.delta[rows, None], self.rate[rows, None])
            for step in np.unique(steps):  # rows of a shot meet if their roles have made as many steps
                if (steps == step).sum() == roles:
                    replays.evidence(found[:, steps == step], int(step), math.inf)
        return replays.top[0, replays.group] if replays.shots else np.full(len(drawn), np.nan)


def replayed_maxima(
    pairs: DataFrame, key: Sequence[str], role: str, pair_index: str, ref: str, mon: str, q: int, roles: int, method: str, indices: DataFrame,
    horizon: int | None, states: DataFrame | None = None,
) -> DataFrame:
    """``(key, replicate, max_log_e)``: the largest log e-value of each replay of the shots that ``indices`` (own key columns, replicate, position, index) names.

    Pairs move once and draws move packed, one row per replay, to the task of their key, which holds that key's pairs and steps its replays
    together. Replays of one key share a task; a key's replays are cut into bounded lots.
    """
    if method not in REPLAYED:
        raise ValueError(f"the method must be among {REPLAYED}")
    key = list(key)
    own = [k for k in key if k in indices.columns]
    least = F.lit(-(2**63))  # stands for a missing number, which matches missing ones
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), least)
    draws = indices.select(*own, "replicate", F.struct(number("position").alias("p"), number("index").alias("i")).alias("_d"))
    packed = draws.groupBy(*own, "replicate").agg(F.sort_array(F.collect_list("_d")).alias("_d"))
    packed = packed.select(*own, "replicate", F.col("_d.p").alias("_at"), F.col("_d.i").alias("_ix"))
    if len(own) < len(key):
        packed = null_safe(pairs.select(*key).distinct(), packed, own)
    absent = {
        role: pairs.schema[role].dataType, "_i": "bigint", "_r": "array<double>", "_m": "array<double>", "replicate": indices.schema["replicate"].dataType,
        "_at": "array<bigint>", "_ix": "array<bigint>", "_state": "array<double>",
    }

    def kind(df: DataFrame, order: int) -> DataFrame:
        return df.select(*key, F.lit(order).alias("_kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in absent.items()])

    rows = kind(pairs.select(*key, role, number(pair_index).alias("_i"), doubles(ref).alias("_r"), doubles(mon).alias("_m")), 1).unionByName(kind(packed, 2))
    if states is not None:
        rows = rows.unionByName(kind(states.select(*key, role, F.col("_state").cast("array<double>").alias("_state")), 0))
    ordered = rows.repartition(shuffle_tasks(rows), *key).sortWithinPartitions(*key, "_kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, warm, raw, have, waiting = None, {}, [], None, []
        held: list[dict[str, np.ndarray]] = []

        def replay() -> None:
            """Replay the draws that wait, those of equal length and horizon together."""
            nonlocal have
            if have is None and raw:
                index, names, r, m = (np.concatenate([part[i] for part in raw]) for i in range(4))
                have = KeyPairs(index, _plain(names), r, m)
                raw.clear()
            lots: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
            sizes = np.array([len(w[2]) for w in waiting])
            for size in np.unique(sizes) if have is not None else ():
                mine = np.flatnonzero(sizes == size)
                who, at, ix = np.array([waiting[i][0] for i in mine], object), *(np.stack([waiting[i][j] for i in mine]) for j in (1, 2))
                spots, known = have.spots(ix)
                if known.all():
                    parts = [(who, at, spots)]
                else:  # a draw of a shot that the key does not have is no draw
                    parts = [(who[[i]], at[[i]][:, k], spots[[i]][:, k]) for i, k in enumerate(known) if k.any()]
                for who, at, spots in parts:
                    n = np.full(len(who), horizon) if horizon is not None else (at[:, 1:] != at[:, :-1]).sum(axis=1) + 1
                    for h in np.unique(n):
                        lots.setdefault((spots.shape[1], int(h)), []).append((who[n == h], spots[n == h]))
            waiting.clear()
            for (_, n), lot in lots.items():
                who, drawn = (np.concatenate([part[i] for part in lot]) for i in (0, 1))
                top = have.replay(drawn, q, roles, method, n, warm)
                found = ~np.isnan(top)
                held.append({**_named(key, last, int(found.sum())), "replicate": who[found], "max_log_e": top[found]})

        def out() -> pd.DataFrame:
            made = _joined(held)
            held.clear()
            return made

        for pdf in batches:
            if not len(pdf):
                continue
            col = {c: pdf[c].to_numpy() for c in ("_kind", role, "_i", "_r", "_m", "replicate", "_at", "_ix", "_state")}
            replicate = pdf["replicate"].astype("Int64").astype(object).where(pdf["replicate"].notna(), None).to_numpy()
            for name, a, b in key_runs(pdf, [*key, "_kind"]):
                if name[:-1] != last:
                    replay()
                    if sum(len(h["replicate"]) for h in held) >= ROWS_OUT:
                        yield out()
                    last, warm, have = name[:-1], {}, None
                    raw.clear()
                if col["_kind"][a] == 0:
                    warm.update(zip(_plain(col[role][a:b]), col["_state"][a:b], strict=True))
                elif col["_kind"][a] == 1:
                    bits = (np.stack(list(col[c][a:b])).astype(float) for c in ("_r", "_m"))
                    raw.append((col["_i"][a:b].astype(np.int64), col[role][a:b], *bits))
                else:
                    for i in range(a, b):
                        waiting.append((replicate[i], col["_at"][i], col["_ix"][i]))
                        if len(waiting) * len(waiting[-1][2]) >= DRAWN_AT_ONCE:
                            replay()
        replay()
        if held:
            yield out()

    fields = {f.name: f.dataType.simpleString() for f in [*pairs.schema.fields, indices.schema["replicate"]]}
    schema = "".join(f"`{k}` {fields[k]}, " for k in key) + f"replicate {fields['replicate']}, max_log_e double"
    return ordered.mapInPandas(run, schema)
