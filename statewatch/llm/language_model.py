"""Scoring of texts by a log-bilinear language model trained with noise-contrastive estimation.

The project's records hold numbers and bits, no prose, so this operator is general: any table with an id and a text.

A word is predicted in two steps. The first predicts one of ``SYMBOLS`` symbols from the symbols before it: the end of the text, one of the most frequent
words, or a class of the other words (by their last two bytes). The second gives the word within its class by its
count. Both steps are normalised, so the log probabilities of a text add up to one of a proper distribution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.llm.common import arrow_rows, frequent_bound, hashed_sample, plain, slices
from statewatch.plans.durable import durable

SYMBOLS = 256
#: Symbol 0 is the end of a text (and what stands before its start); then come frequent words, then classes, the last for all other endings.
WORDS, CLASSES = 127, 128
WIDTH = 16
#: Words before the predicted one that form its bag context; the two nearest also count by position.
BAG = 16
#: Noise words for each batch, and positions in a batch.
NOISE, BATCH = 48, 4096
#: Most words whose counts are shipped to the tasks.
FREQUENT = 524_288
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of all texts as one binary array, and how many each text has."""
    values = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    whole = np.frombuffer(b"\n".join(values).lower() + b"\n", np.uint8)
    blank = BLANK[whole]
    edge = np.empty(len(whole), bool)
    edge[0] = not blank[0]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:])
    at = np.flatnonzero(edge)  # starts and ends in turn; the text ends blank
    starts, ends = at[::2], at[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole[~blank])])
    limits = np.cumsum([len(v) + 1 for v in values])
    return words, np.diff(np.searchsorted(starts, limits), prepend=0)


def endings(words: pa.Array) -> np.ndarray:
    """Last two bytes of each word as a number."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
    last = data[offsets[1:] - 1].astype(np.int32)
    before = np.where(np.diff(offsets) > 1, data[np.maximum(offsets[1:] - 2, 0)], 0)
    return before.astype(np.int32) * 256 + last


# ---------------------------------------------------------------- the model


@dataclass
class Bilinear:
    """Context tables (previous, the one before, bag), output table and bias, all rows by symbol."""

    near: np.ndarray
    far: np.ndarray
    bag: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(counts: np.ndarray, seed: int = 0) -> Bilinear:
        rng = np.random.default_rng(seed)
        table = lambda: rng.normal(0, 0.1, (SYMBOLS, WIDTH)).astype(np.float32)
        return Bilinear(table(), table(), table(), table(), np.log((counts + 1) / (counts + 1).sum()).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.far, self.bag, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    @staticmethod
    def of(flat: np.ndarray) -> Bilinear:
        cuts = np.cumsum([SYMBOLS * WIDTH] * 4)
        *tables, bias = np.split(np.asarray(flat, np.float32), cuts)
        return Bilinear(*(t.reshape(SYMBOLS, WIDTH) for t in tables), bias)


def contexts(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The previous symbol, the one before, and the start of the bag, for positions of texts laid end to end. ``first`` marks starts."""
    n = len(symbols)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(first, at, 0))
    p1 = np.zeros(n, np.uint8)
    p1[1:] = symbols[:-1]
    p1[first] = 0
    p2 = np.zeros(n, np.uint8)
    p2[2:] = symbols[:-2]
    p2[at - start < 2] = 0
    return p1, p2, np.maximum(at - BAG, start)


def predicted(model: Bilinear, symbols: np.ndarray, p1: np.ndarray, p2: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sum of the context's representations: the vector the next word's output row is multiplied with."""
    running = np.zeros((len(symbols) + 1, WIDTH))
    np.cumsum(model.bag[symbols], axis=0, out=running[1:])
    bag = (running[:-1] - running[low]) * (1.0 / BAG)
    return model.near[p1] + model.far[p2] + bag.astype(np.float32)


def log_probabilities(model: Bilinear, symbols: np.ndarray, first: np.ndarray, piece: int = 8192) -> np.ndarray:
    """Natural log of each symbol's probability after its context. Long runs go by pieces, with the words of the bag before each."""
    parts = []
    for a in range(0, len(symbols), piece):
        halo = min(a, BAG)
        parts.append(piece_log_probabilities(model, symbols[a - halo : a + piece], first[a - halo : a + piece])[halo:])
    return np.concatenate(parts) if parts else np.empty(0)


def piece_log_probabilities(model: Bilinear, symbols: np.ndarray, first: np.ndarray, rows: int = 1024) -> np.ndarray:
    """The same for one piece, normalised over all symbols by a batched product."""
    result = np.empty(len(symbols))
    p1, p2, low = contexts(symbols, first)
    # a column of ones brings the bias into the product
    context = np.ones((len(symbols), WIDTH + 1), np.float32)
    context[:, :WIDTH] = predicted(model, symbols, p1, p2, low)
    output = np.ascontiguousarray(np.vstack([model.out.T, model.bias]))
    ones = np.ones(SYMBOLS, np.float32)
    longest = float(np.sqrt(np.einsum("ij,ij->i", context, context).max(initial=0.0)) * np.sqrt((output**2).sum(axis=0).max()))
    logits = np.empty((rows, SYMBOLS), np.float32)
    for a in range(0, len(symbols), rows):
        part = context[a : a + rows]
        block = logits[: len(part)]
        np.matmul(part, output, out=block)
        own = block[np.arange(len(part)), symbols[a : a + rows]].astype(np.float64)
        if longest > 60.0:  # exp could overflow
            top = block.max(axis=1, keepdims=True)
            block -= top
            own -= top[:, 0]
        np.exp(block, out=block)
        result[a : a + rows] = own - np.log((block @ ones).astype(np.float64))
    return result


def by_symbol(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by symbol."""
    out = np.zeros((SYMBOLS, *values.shape[1:]), np.float32)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=SYMBOLS)
    present = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[present]
    out[present] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps. The noise words are drawn by their share in the corpus and serve a whole batch,
    so that all scores and gradients are matrix products."""

    def __init__(self, model: Bilinear, counts: np.ndarray, rate: float, seed: int):
        self.model, self.rate = model, rate
        self.share = (counts + 1.0) / (counts + 1.0).sum()
        self.offset = np.log(NOISE * self.share).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.squares = [np.full_like(p, 1e-4) for p in model.parts()]

    def step(self, symbols: np.ndarray, first: np.ndarray) -> None:
        m, n = self.model, len(symbols)
        p1, p2, low = contexts(symbols, first)
        context = predicted(m, symbols, p1, p2, low)
        noise = self.rng.choice(SYMBOLS, NOISE, p=self.share)
        target, other = m.out[symbols], m.out[noise]
        # data: push the score of the word over that of noise; noise: the reverse
        data = np.einsum("ij,ij->i", context, target) + m.bias[symbols] - self.offset[symbols]
        up = 1.0 / (1.0 + np.exp(np.clip(data, -30, 30)))
        score = context @ other.T + (m.bias[noise] - self.offset[noise])
        down = -1.0 / (1.0 + np.exp(-np.clip(score, -30, 30)))
        toward = up[:, None] * target + down @ other
        out = by_symbol(symbols, up[:, None] * context)
        np.add.at(out, noise, down.T @ context)
        bias = np.bincount(symbols, up, SYMBOLS)
        np.add.at(bias, noise, down.sum(axis=0))
        running = np.zeros((n + 1, WIDTH))
        np.cumsum(toward, axis=0, out=running[1:])
        end = np.searchsorted(low, np.arange(n), side="right")  # the positions whose bag holds this one end here
        bag = (running[np.maximum(end, np.arange(n) + 1)] - running[1:]).astype(np.float32) * (1.0 / BAG)
        gradients = [by_symbol(p1, toward), by_symbol(p2, toward), by_symbol(symbols, bag), out, bias.astype(np.float32)]
        for p, s, g in zip(m.parts(), self.squares, gradients, strict=True):
            g = g / n
            s += g * g
            p += self.rate * g / np.sqrt(s)


def train(model: Bilinear, symbols: np.ndarray, first: np.ndarray, trainer: Trainer) -> None:
    for a in range(0, len(symbols), BATCH):
        begins = first[a : a + BATCH].copy()
        begins[:1] = True
        trainer.step(symbols[a : a + BATCH], begins)


# ---------------------------------------------------------------- the corpus


@dataclass
class Vocabulary:
    """What a task needs to turn words into symbols: the frequent words with counts, most frequent first, and the classes of endings."""

    words: pa.Array
    counts: np.ndarray
    classes: np.ndarray  # symbol by ending
    symbols: np.ndarray  # training tokens by symbol
    distinct: np.ndarray  # distinct training words by symbol
    tokens: int
    kinds: int

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Symbols of all positions with the ends, starts of texts, index of each word in ``words`` (-1: not there), the words, their number by text."""
        words, sizes = split_words(column)
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy()
        known = pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1).to_numpy()
        symbol = np.where((known >= 0) & (known < WORDS), known + 1, self.classes[endings(coded.dictionary)]).astype(np.uint8)
        places = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        symbols = np.zeros(len(words) + len(sizes), np.uint8)
        symbols[places] = symbol[index]
        first = np.zeros(len(symbols), bool)
        first[np.cumsum(sizes + 1)[:-1]] = True
        first[:1] = True
        return symbols, first, known[index], words, sizes


def count_words(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``(word, n)``: words of all texts; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ends = 0
        for batch in slices(batches, 0, 8_000_000):
            words, sizes = split_words(batch.column(0))
            ends += len(sizes)
            counts = pc.value_counts(words)
            held.append(pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"]))
            if sum(b.num_rows for b in held) > most:
                yield from merged(held)
                held = []
        if held:
            yield from merged(held)
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    def merged(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    counted = docs.select("text").mapInArrow(run, "word binary, n bigint").where("n > 0")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def learn_vocabulary(counts: DataFrame, frequent: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the counts of the words that are not in it."""
    words = counts.where(F.length("word") > 0)
    bound = frequent_bound(words, frequent)
    common = words.where((F.col("step") >= bound) & (F.length("word") <= 64)).select("word", "n").toArrow().combine_chunks()
    order = pc.sort_indices(common, [("n", "descending"), ("word", "ascending")])
    common = common.take(order)
    listed = pa.concat_arrays(common["word"].chunks) if common.num_rows else pa.array([], pa.binary())
    top = {w: i + 1 for i, w in enumerate(listed[:WORDS].to_pylist())}
    n_listed = np.asarray(common["n"].to_numpy() if common.num_rows else [], np.int64)
    two = F.conv(F.hex(F.expr("substr(word, -2)")), 16, 10).cast("int")
    by_ending = words.groupBy(two.alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()  # 65,536 rows at most
    n, k = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for r in by_ending:
        n[r["ending"]], k[r["ending"]] = r["n"], r["k"]
    for w, i in top.items():
        e = int.from_bytes(w[-2:], "big")
        n[e] -= int(n_listed[i - 1])
        k[e] -= 1
    classes = np.full(65536, SYMBOLS - 1, np.int64)
    best = np.argsort(-n, kind="stable")[: CLASSES - 1]
    classes[best] = WORDS + 1 + np.arange(CLASSES - 1)
    symbols = np.bincount(classes, n, SYMBOLS)
    symbols[1 : 1 + len(top)] += n_listed[: len(top)]
    distinct = np.bincount(classes, k, SYMBOLS)
    all_ = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).first()
    symbols[0] = all_["ends"] or 0
    rest = words.where((F.col("step") < bound) | (F.length("word") > 64)).select("word", "n")
    return Vocabulary(listed, n_listed, classes, symbols, distinct, int(all_["n"] or 0), int(all_["k"])), rest


def warm_up(docs: DataFrame, vocabulary: Vocabulary, sample: int, most: int = 2_000_000) -> Bilinear:
    """Starting point of the distributed pass: a fit on the texts of a bounded sample (by hash), over about ``most`` words."""
    model = Bilinear.start(vocabulary.symbols)
    trainer = Trainer(model, vocabulary.symbols, 0.1, 1)
    texts = int(vocabulary.symbols[0])
    picked = hashed_sample(docs, F.xxhash64("id", "text"), texts, sample).select("text").toArrow().combine_chunks()
    if not picked.num_rows:
        return model
    symbols, first, *_ = vocabulary.read(pa.concat_arrays(picked["text"].chunks))
    for _ in range(max(1, min(20, most // max(1, len(symbols))))):
        train(model, symbols, first, trainer)
    return model


def fit(docs: DataFrame, vocabulary: Vocabulary, sample: int) -> Bilinear:
    """One pass over all training texts: every task starts from the warm model and trains on its rows; the results are averaged by their words."""
    start = warm_up(docs, vocabulary, sample)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, start.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        model = Bilinear.of(flat)
        trainer = Trainer(model, vocabulary.symbols, 0.02, 2)
        seen = 0
        for batch in slices(batches, 0, 8_000_000):
            symbols, first, *_ = vocabulary.read(batch.column(0))
            train(model, symbols, first, trainer)
            seen += len(symbols)
        if seen:
            values = model.flat() * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values), pa.array(np.full(len(values), seen))], ["at", "value", "seen"])

    parts = docs.select("text").mapInArrow(run, "at bigint, value double, seen bigint")
    mean = parts.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas().sort_values("at")  # the size of the model
    return Bilinear.of(mean["value"].to_numpy()) if len(mean) else start


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", learn: Column | None = None, frequent: int = FREQUENT, sample: int = 2000) -> DataFrame:
    """One row per row of ``docs``: ``id, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    The model and all counts come from the rows where ``learn`` holds (all, where not given). ``base_score`` is the text's probability by
    smoothed word counts, ``score`` by the model. At most ``frequent`` words are shipped to the tasks with their counts; the other words of each text
    are looked up by a join, none of them can be frequent. Only the starting point is fitted on a ``sample`` of texts; counts and
    training cover all learning rows.

    Cases: NULL text counts as empty and has one token, its end. NULL in ``learn`` means no. Without learning rows every word is unknown.
    Repeated rows are scored alike, and learned from as often as they occur. An empty table gives no rows. Other columns are not read
    (but by ``learn``). Texts are read whole.
    """
    source = docs.select(F.col(id).alias("id"), plain(text).alias("text"), (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("learn"))
    training = source.where("learn").select("id", "text")
    counts = count_words(training).withColumn("step", F.floor(F.log2("n") * 8 + 1e-9))
    with arrow_rows(docs.sparkSession):
        counts = durable(counts, "counts")
        vocabulary, rest = learn_vocabulary(counts, frequent)
        model = fit(training, vocabulary, sample)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model.flat()))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", docs.schema[id].dataType),
            *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
            *[T.StructField(c, T.DoubleType()) for c in ("counted", "modelled")],
            T.StructField("rare", T.ArrayType(T.BinaryType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        model = Bilinear.of(flat)
        weight = np.append(np.log10(vocabulary.counts + 1.0), 0.0)  # by index of the word; -1 is the rare ones
        end = np.log10(vocabulary.symbols[0] + 1.0)
        inside = np.zeros(SYMBOLS)
        inside[WORDS + 1 :] = np.log10(vocabulary.symbols[WORDS + 1 :] + vocabulary.distinct[WORDS + 1 :] + 1.0)
        for batch in slices(batches, 2, 4_000_000):
            symbols, first, known, words, sizes = vocabulary.read(batch.column(2))
            logs = log_probabilities(model, symbols, first) / np.log(10)
            in_class = (known >= WORDS) | (known < 0)
            starts = np.cumsum(sizes + 1) - (sizes + 1)
            word_ends = np.cumsum(sizes)
            total = lambda values: np.diff(np.concatenate([[0.0], np.cumsum(values)])[np.concatenate([[0], word_ends])])
            own = weight[known]
            modelled = np.add.reduceat(logs - inside[symbols], starts) + total(own * in_class)
            rare = known < 0
            offsets = np.concatenate([[0], np.cumsum(rare)])[np.concatenate([[0], word_ends])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(rare)))
            n_known = sizes - np.diff(offsets) + (vocabulary.symbols[0] > 0)
            columns = [batch.column(0), batch.column(1), pa.array(sizes + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(total(own) + end), pa.array(modelled), lists]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    numbered = source.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    with arrow_rows(docs.sparkSession):
        scored = durable(numbered.mapInArrow(run, schema), "scored")
    words = scored.select("row", F.explode("rare").alias("word")).join(rest, "word")
    found = words.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("also"))
    joined = scored.drop("rare").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    norm = float(np.log10(vocabulary.tokens + vocabulary.kinds + 1.0))
    return joined.select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("modelled") + more).alias("score"),
    )
