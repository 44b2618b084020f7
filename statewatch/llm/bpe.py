"""Byte-level BPE encoding and decoding with a given rank file.

The project's records hold numbers and bits, no prose, so this operator is general: any table with an id and a text.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.functions.arrays import let
from statewatch.llm.common import arrow_rows, frequent_bound, give_back, plain, slices, trimmed
from statewatch.plans.durable import durable, own_session

#: The split that the rank files go with (fixed value): contractions, words, numbers, signs, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Most words that are encoded once for the whole corpus and shipped to every task.
FREQUENT = 1_000_000
#: Bytes of text whose rare words are encoded together.
BLOCK = 4_000_000
#: Bytes of text that are split at a time: characters take more room while they are split.
PART = 200_000
#: Longer words are merged with a heap instead of the fold, whose steps grow with the square of the length.
LONG = 128
SLOTS = 16_384


def load_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


# ---------------------------------------------------------------- splitting

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Code point -> letter, number, white space or other."""
    if not KINDS:
        table = np.full(0x110000, OTHER, np.uint8)
        for start in range(0, 0x110000, 0x1000):
            some = "".join(chr(c) for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000)
            for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                found = "".join(regex.findall(name, some))
                table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
        KINDS.append(table)
    return KINDS[0]


def starts_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First positions of the words that ``PATTERN`` finds in texts laid end to end; ``ends`` are the texts' ends.

    The pattern's matches tile a text, and depend on runs of one kind of character only: a run takes one blank before
    it along; other white space before a run is cut before its last character; an apostrophe alone, not after a blank,
    takes a contraction's ending from the letters that follow.
    """
    n = len(codes)
    kind = kinds()[codes]
    first = np.zeros(n + 1, bool)  # a text starts here
    first[0] = True
    first[ends] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    start = change.copy()
    space = kind == SPACE
    # the last white space before something else in the same text
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1:] = False
    last &= ~first[1:]
    at = np.flatnonzero(last)
    start[at] = True
    blank = at[codes[at] == 32]
    start[blank + 1] = False
    # contractions
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        follow = np.append(codes, [0, 0, 0])
        begins = np.append(change, True)
        whole = (quote + 1 < n) & begins[np.minimum(quote + 1, n)] & ~first[np.minimum(quote + 1, n)]  # the run is one apostrophe
        for q in quote[whole]:
            if kind[q + 1] != LETTER:
                continue
            for ending in ENDINGS:
                size = len(ending)
                if all(follow[q + 1 + i] == ord(c) for i, c in enumerate(ending)) and not first[q + 2 : q + 1 + size].any():
                    start[q + 1] = False
                    if q + 1 + size < n and not first[q + 1 + size] and kind[q + 1 + size] == LETTER:
                        start[q + 1 + size] = True
                    break
    return np.flatnonzero(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts as one binary array, and how many of them each text has."""
    values = [t or "" for t in texts.to_pylist()]
    whole = "".join(values)
    if not whole:
        return pa.array([], pa.binary()), np.zeros(len(values), np.int64)
    codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(v) for v in values])
    starts = starts_of(codes, ends)
    width = np.ones(len(codes), np.int8)
    for bound in (0x80, 0x800, 0x10000):
        width += codes >= bound
    place = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(width, out=place[1:])
    offsets = np.append(place[starts], place[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


# ---------------------------------------------------------------- merging


def literal_table(tokens: list[bytes]) -> Column:
    """The rank map as a literal: an array of small maps, addressed by hash, over byte strings spelled as Latin-1."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for rank, token in enumerate(tokens):
        spelled = token.decode("latin-1")
        slots[xxhash.xxh64_intdigest(spelled.encode(), 42) % SLOTS][spelled] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def encode_word(word: Column, table: Column) -> Column:
    """Ids of a word (binary) by a fold of ranked merges.

    The state is the array of places where a piece starts, and the end. A step looks up what the pieces on both sides of each place make
    together, and removes the place of lowest rank, the first of equal ones; where nothing has a rank it removes nothing.
    """

    def rank(piece: Column) -> Column:
        slot = F.xxhash64(piece).bitwiseAND(SLOTS - 1).cast("int")
        return F.try_element_at(F.get(table, slot), piece)

    def fold(spelled: Column) -> Column:
        def merge(cuts: Column, _: Column) -> Column:
            def joined(cut: Column, i: Column) -> Column:  # NULL at either end, and where there is no rank
                start = F.get(cuts, i - 1)
                return F.shiftleft(rank(F.substr(spelled, start, F.get(cuts, i + 1) - start)).cast("bigint"), 32).bitwiseOR(cut)

            lowest = F.array_min(F.transform(cuts, joined))
            return F.array_remove(cuts, F.coalesce(lowest.bitwiseAND(2**32 - 1).cast("int"), F.lit(0)))

        n = F.length(spelled)
        cuts = F.aggregate(F.sequence(F.lit(2), n), F.sequence(F.lit(1), n + 1), merge)
        merged = let(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda at, i: rank(F.substr(spelled, at, F.get(c, i + 1) - at))))
        return let(rank(spelled), lambda r: F.when(r.isNull(), merged).otherwise(F.array(r)))

    return let(F.decode(word, "ISO-8859-1"), fold)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, with a heap of pairs and linked neighbours."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts at i
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == stop):
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# ---------------------------------------------------------------- the corpus


def count_words(docs: DataFrame, most: int = 250_000) -> DataFrame:
    """``(word, n)`` over all texts. A task merges its counts block by block and flushes them when they reach ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def total() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in slices(batches, 0, PART):
            words, _ = split_words(batch.column(0))
            counts = pc.value_counts(words)
            held.append(pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"]))
            if sum(b.num_rows for b in held) > most:
                merged = total()
                held = merged.combine_chunks().to_batches()
                if merged.num_rows > most // 2:
                    yield from held
                    held = []
        if held:
            yield from total().combine_chunks().to_batches()

    return docs.select("text").mapInArrow(trimmed(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int) -> DataFrame:
    """The words whose count is at least the smallest bound that leaves ``most`` of them or fewer. Bounds are eighths of powers of two."""
    step = F.floor(F.log2("n") * 8 + 1e-9)
    with arrow_rows(docs.sparkSession):
        counts = durable(count_words(docs).where("n > 1").where(F.length("word") <= LONG).withColumn("step", step), "words")
    return counts.where(F.col("step") >= frequent_bound(counts, most)).select("word")


@dataclass(frozen=True)
class Known:
    """Frequent words in the order of their hashes, for look-ups without a second copy of the words."""

    hashes: np.ndarray
    words: pa.Array

    @staticmethod
    def of(words: pa.Array) -> tuple[Known, pa.Array]:
        """The words, and the order they are in now."""
        hashes = word_hashes(words)
        order = np.argsort(hashes, kind="stable")
        return Known(hashes[order], words.take(pa.array(order))), pa.array(order)

    def find(self, words: pa.Array) -> np.ndarray:
        """Index of each word, -1 for those that are not known (or share a hash with one that is)."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        mine = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


def word_hashes(words: pa.Array) -> np.ndarray:
    each = (w for start in range(0, len(words), 10_000) for w in words.slice(start, 10_000).to_pylist())
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in each), np.uint64, len(words))


@dataclass(frozen=True)
class Ids:
    """Lists of ids, end to end."""

    flat: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(lists: pa.Array) -> Ids:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        return Ids(flat, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at ``at``, end to end, and their lengths."""
        starts = np.where(at > 0, self.ends[at - 1], 0)
        size = self.ends[at] - starts
        return self.flat[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def read_block(block: pa.RecordBatch, known: Known, tokens: list[bytes], ranks: dict[bytes, int]) -> tuple:
    """``(words of each text, code of each word, words to fold, ids of long words)`` of a block of texts.

    A code numbers the known words, then the block's own short ones, then its long ones.
    """
    own: dict[bytes, int] = {}
    shared = len(known.hashes)
    sizes, codes = [np.zeros(0, np.int64)], [np.zeros(0, "<i4")]
    for part in slices([block], 1, PART):
        found, n = split_words(part.column(1))
        sizes.append(n)
        coded = found.dictionary_encode()
        code = known.find(coded.dictionary).astype("<i4")
        new = np.flatnonzero(code < 0)
        code[new] = [shared + own.setdefault(w, len(own)) for w in coded.dictionary.take(pa.array(new)).to_pylist()]
        codes.append(code[coded.indices.to_numpy()])
    words = list(own)
    long = np.array([len(w) > LONG for w in words], bool)
    moved = np.arange(shared, shared + len(words), dtype="<i4")
    moved[~long], moved[long] = shared + np.arange((~long).sum()), shared + (~long).sum() + np.arange(long.sum())
    if long.any() and not ranks:
        ranks.update({t: i for i, t in enumerate(tokens)})
    merged = [merge_long(w, ranks) for w, is_long in zip(words, long, strict=True) if is_long]
    code = np.concatenate(codes)
    mine = code >= shared
    code[mine] = moved[code[mine] - shared]
    return np.concatenate(sizes), code, [w for w, is_long in zip(words, long, strict=True) if not is_long], merged


def write_texts(ids: pa.Array, sizes: np.ndarray, code: np.ndarray, known: Ids, own: Ids, pieces: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Ids and decoded bytes of the texts of a block, some texts at a time. The bytes are the pieces of the ids, put together."""
    shared = len(known.ends)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for a, b in runs(starts, ends):
        part = code[starts[a] : ends[b - 1]]
        mine = part >= shared
        size = np.zeros(len(part), np.int64)
        lists = [known.take(part[~mine]), own.take(part[mine] - shared)]
        for where, (_, n) in zip((~mine, mine), lists, strict=True):
            size[where] = n
        flat = np.empty(size.sum(), "<u4")
        of_own = np.repeat(mine, size)
        flat[~of_own], flat[of_own] = lists[0][0], lists[1][0]
        strings = pieces.take(pa.array(flat))
        joined = memoryview(strings.buffers()[2] or b"")
        at = np.concatenate([[0], np.cumsum(size)])
        to = np.concatenate([[0], np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False))]).astype(np.int64)
        n = at[np.concatenate([starts[a:b], ends[b - 1 : b]]) - starts[a]]
        bounds = list(zip(n, n[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [
                ids.slice(a, b - a),
                pa.array(np.diff(n), pa.int64()),
                pa.array([flat[x:y].tobytes() for x, y in bounds], pa.binary()),
                pa.array([joined[to[x] : to[y]] for x, y in bounds], pa.binary()),
            ],
            names=names,
        )


def encode_texts(docs: DataFrame, ranks_path: str, id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: ``id, n_tokens, ids`` (little-endian unsigned 32-bit, as binary) ``, decoded`` (binary).

    Words are encoded by a fold of Spark's array functions: those that are frequent in the corpus once (at most ``frequent``, which bounds
    what is shipped to the tasks), the others once for each block of texts where they occur, in the task that reads it. So nothing but
    word counts is ever shuffled. Words of more than ``LONG`` bytes are merged with a heap, to the same result. Decoding puts the byte
    strings of each text's ids together.

    Cases: NULL text counts as empty, an empty text has no tokens. Special tokens are ordinary text. Repeated rows give repeated results. An empty
    table gives no rows. Other columns are not read. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    tokens = load_ranks(ranks_path)
    table = literal_table(tokens)
    source = docs.select(F.col(id).alias("id"), plain(text).alias("text"))
    known = frequent_words(source.select("text"), frequent)
    made = known.select("word", let(table, lambda t: encode_word(F.col("word"), t)).alias("ids")).toArrow().combine_chunks()
    words, lists = (pa.concat_arrays(made[c].chunks) if made.num_rows else pa.array([], made[c].type) for c in ("word", "ids"))
    index, order = Known.of(words.cast(pa.binary()))
    lists = Ids.of(lists.take(order))
    spelled = spark.sparkContext.broadcast((tokens, index))
    encoded = spark.sparkContext.broadcast((tokens, lists))
    del made, words, lists, index, order  # the broadcasts have them
    give_back()

    key = docs.schema[id].dataType
    blocks = T.StructType(
        [
            T.StructField("docs", T.ArrayType(key)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("codes", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            T.StructField("long", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, index = spelled.value
        ranks: dict[bytes, int] = {}
        for batch in slices(batches, 1, BLOCK):
            sizes, codes, short, long = read_block(batch, index, tokens, ranks)
            packed = pa.array([pa.compress(codes.tobytes(), codec="zstd", asbytes=True)], pa.binary())
            columns = [pa.array(sizes, pa.int64()), pa.array(short, pa.binary()), pa.array(long, pa.list_(pa.int32()))]
            one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (batch.column(0), *columns)]
            yield pa.RecordBatch.from_arrays([one[0], one[1], packed, one[2], one[3]], names=blocks.names)
            give_back()

    out = T.StructType([T.StructField("id", key), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = encoded.value
        pieces = pa.array(tokens, pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, codes, made, long = (batch.column(c)[row] for c in ("docs", "sizes", "codes", "made", "long"))
                own = Ids.of(pa.concat_arrays([x.values.cast(pa.list_(pa.int32())) for x in (made, long)]))
                sizes = sizes.values.to_numpy()
                n = int(sizes.sum())
                code = np.frombuffer(pa.decompress(codes.as_py(), 4 * n, codec="zstd") if n else b"", "<i4")
                yield from write_texts(ids.values, sizes, code, known, own, pieces, out.names)
                give_back()

    made = let(table, lambda t: F.transform("words", lambda w: encode_word(w, t)))
    folded = source.mapInArrow(trimmed(read), blocks).select("docs", "sizes", "codes", "long", made.alias("made"))
    # written once: the folds are the dear part, and the two passes in Python need not be in memory together
    # a row is a whole block there, so the second pass takes one at a time
    with arrow_rows(spark):
        written = durable(folded, "folded", own_session(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}))
    return written.mapInArrow(trimmed(write), out)


def runs(starts: np.ndarray, ends: np.ndarray, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` words together."""
    a = 0
    for b in range(1, len(starts) + 1):
        if b == len(starts) or ends[b] - starts[a] > most:
            yield a, b
            a = b
