"""Spelling variants of words, by an index of grams of variable length.

The project's records hold numbers and bits, no prose, so this operator is general: any table with an id and a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewatch.llm.common import arrow_rows, plain, slices
from statewatch.plans.durable import durable

#: Letters of a word: a-z and U+00C0 to U+00FF, after A-Z are lower-cased; over UTF-8, where the lead byte C3 stands for nothing else.
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
#: Grams have at least two code points.
FEWEST = 2
#: Longer grams are kept from one occurrence in so many on, so the dictionary has at most that many of each length.
ENTRIES = 20_000


@dataclass(frozen=True)
class Grams:
    """A dictionary of frequent grams. Every gram of ``FEWEST`` code points belongs to it without being listed."""

    longest: int
    listed: frozenset[str]
    opened: frozenset[str]  # what a listed gram goes on from
    inside: frozenset[str]  # what stands in a listed gram, but not at its start

    @staticmethod
    def of(listed: set[str], longest: int) -> Grams:
        opened = {g[:k] for g in listed for k in range(1, len(g))}
        inside = {g[a:b] for g in listed for a in range(1, len(g)) for b in range(a + 1, len(g) + 1)}
        return Grams(longest, frozenset(listed), frozenset(opened), frozenset(inside))

    def split(self, word: str) -> list[tuple[int, str]]:
        """Positions and grams: the longest gram at each place, unless an earlier one covers it."""
        found: list[tuple[int, str]] = []
        end = 0
        for at in range(len(word) - FEWEST + 1):
            size = FEWEST
            for n in range(min(self.longest, len(word) - at), FEWEST, -1):
                if word[at : at + n] in self.listed:
                    size = n
                    break
            if at + size > end:
                end = at + size
                found.append((at, word[at:end]))
        return found

    def unaffected(self, word: str, grams: list[tuple[int, str]]) -> tuple[list[int], list[int]]:
        """How many of the first grams the characters from each place on cannot change, and of the last ones those before it.

        The first: each ends before the place, and none of the matches up to it could go on across the place. The last: what stands from the
        place to the gram's end is inside no listed gram, so no match that begins before the place covers it.
        """
        n = len(grams)
        first, last = [], []
        for place in range(len(word) + 1):
            bound = place
            for k in range(1, min(self.longest, place + 1)):
                if word[place - k : place] in self.opened:
                    bound = place - k
            kept = first[-1] if first else 0  # never fewer than for the place before, less those that may go on
            while kept and not (grams[kept - 1][0] < bound and grams[kept - 1][0] + len(grams[kept - 1][1]) <= place):
                kept -= 1
            while kept < n and grams[kept][0] < bound and grams[kept][0] + len(grams[kept][1]) <= place:
                kept += 1
            first.append(kept)
        kept = 0
        for place in range(len(word), -1, -1):
            while kept and not self._safe(word, place, grams[n - kept]):
                kept -= 1
            while kept < n and self._safe(word, place, grams[n - kept - 1]):
                kept += 1
            last.append(kept)
        return first, last[::-1]

    def _safe(self, word: str, place: int, gram: tuple[int, str]) -> bool:
        at, text = gram
        return at >= place and (at + len(text) - place >= self.longest or word[place : at + len(text)] not in self.inside)

    def keys(self, word: str) -> tuple[set[int], set[int], int, int]:
        """``(gaps, cuts, grams, affected)`` of a word.

        A gap is a hash of the grams that a change of one character leaves in place: those before it with their distance from the
        start, those after it with their distance from the end, and the length without the character. A cut is the same for
        a character put in between. ``affected`` is the largest number of grams that one change can touch.
        """
        grams = self.split(word)
        first, last = self.unaffected(word, grams)
        size, n = len(word), len(grams)
        before, after = [1], [2]
        for at, text in grams:
            before.append(xxhash.xxh64_intdigest(f"{at} {text}", before[-1]))
        for at, text in reversed(grams):
            after.append(xxhash.xxh64_intdigest(f"{size - at} {text}", after[-1]))

        def key(length: int, i: int, j: int) -> int:
            return (before[i] * 0x9E3779B97F4A7C15 ^ after[j] * 0xC2B2AE3D27D4EB4F ^ length * 0x165667B19E3779F9) & 0x7FFFFFFFFFFFFFFF

        held = [(first[i], last[i + 1]) for i in range(size)]
        opened = [(first[i], last[i]) for i in range(size + 1)]
        gaps = {key(size - 1, i, j) for i, j in held}
        cuts = {key(size, i, j) for i, j in opened}
        return gaps, cuts, n, n - min(i + j for i, j in held + opened)


def count_words(docs: DataFrame, id: str, text: str, shortest: int, slip: int | None, most: int = 250_000) -> DataFrame:
    """``(word, n)``: words of at least ``shortest`` code points over all whole texts, and how often they occur.

    A word is a run of letters, A-Z in lower case. With ``slip``, a word whose ``h = crc32("<id>:<word>")`` it divides loses the code point
    ``h % length``: misspellings planted by a fixed rule. A task counts up to ``most`` words before it hands them on.
    """
    # a shorter run never becomes long enough; a longer one is always found whole
    pattern = re.compile(LETTER + b"{%d,}" % shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in slices(batches, 1, 1_000_000):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for row, name in enumerate(ids):
                found = Counter(pattern.findall(texts[row].as_py().encode().lower()))
                start = zlib.crc32(f"{name}:".encode())
                for word, n in found.items():
                    if slip and (h := zlib.crc32(word, start)) % slip == 0:
                        whole = word.decode()
                        lost = h % len(whole)
                        if len(whole) <= shortest:
                            continue
                        word = (whole[:lost] + whole[lost + 1 :]).encode()
                    counts[word] += n
            if len(counts) >= most:
                yield flush()
        if counts:
            yield flush()

    source = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), plain(text).alias("text"))
    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, longest: int, entries: int = ENTRIES) -> Grams:
    """Grams of ``FEWEST`` + 1 to ``longest`` code points that occur in the distinct ``words`` at least once in ``entries`` places.

    A gram that is rarer is cut: its beginning, which is selective enough, stands for it. A beginning of a listed gram is at least as
    frequent, so it is listed too. Counting is distributed; at most ``entries`` grams of each length come back.
    """
    size = F.length("word")
    places = words.select("word", F.explode(F.sequence(F.lit(1), size - FEWEST)).alias("at"))
    total = words.agg(F.sum(size - FEWEST)).first()[0] or 0
    sizes = F.explode(F.sequence(F.lit(FEWEST + 1), F.least(F.lit(longest), size - F.col("at") + 1)))
    grams = places.select("word", "at", sizes.alias("k")).select(F.substr("word", F.col("at"), F.col("k")).alias("gram"))
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= max(2.0, total / entries))
    return Grams.of({r["gram"] for r in found.select("gram").collect()}, longest)


def near_words(words: DataFrame, grams: Grams) -> DataFrame:
    """``(a, b)``, ``a < b``: all pairs of ``words`` that differ by exactly one inserted, deleted or replaced code point.

    Two words that are one change apart have all grams in common that the change leaves alone, at the same distance from the start or
    from the end. So the lists of these grams are merged in one join on their hash, one for each place of a change, and whatever
    meets there is verified. Grams that a change may affect, and that could differ, are left out by each word's own bounds.
    """
    shipped = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                keys: list[int] = []
                gap: list[bool] = []
                held: list[str] = []
                for word in batch.column(0).slice(start, 2000).to_pylist():
                    gaps, cuts, _, _ = index.keys(word)
                    keys += [*gaps, *cuts]
                    gap += [True] * len(gaps) + [False] * len(cuts)
                    held += [word] * (len(gaps) + len(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gap), pa.array(held, pa.string())], ["key", "gap", "word"])

    lists = durable(words.select("word").mapInArrow(run, "key bigint, gap boolean, word string"), "grams")
    one = lists.where("gap").select("key", F.col("word").alias("a"))
    other = lists.select("key", "gap", F.col("word").alias("b"))
    # equal lengths meet gap to gap, once; a longer word's gap meets a shorter one's cut
    met = one.join(other, "key").where((~F.col("gap") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spelling_variants(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 6, fewest: int = 5, ratio: int = 5, slip: int | None = None,
    entries: int = ENTRIES,
) -> DataFrame:
    """Words of all texts with the form that each is most likely a misspelling of: ``word, form, root, n, n_near, form_n``.

    Words have at least ``shortest`` code points and ``fewest`` occurrences (``n``). Two are near when exactly one code point is inserted, deleted
    or replaced. A word's form is its near word of largest ``n``, the first in code-point order of equal ones, where that is at least ``ratio``
    times the word's own; ``root`` follows forms to the last.

    A dictionary of frequent grams, of at most half the shortest word, decomposes each word; bounds of what one change can affect say
    which grams' lists are merged. Each change leaves a gram of three code points or more before or after it, so no list holds all words.

    Cases: NULL text has no words, a NULL id counts as empty text. Texts and words of any length are read whole. Repeated rows count
    again. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    if shortest < 2 * FEWEST + 2:
        raise ValueError("words must have six code points or more")
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    spark = docs.sparkSession
    with arrow_rows(spark):
        words = durable(count_words(docs, id, text, shortest, slip).where(F.col("n") >= fewest), "words")
    pairs = near_words(words, gram_dictionary(words, FEWEST + 1, entries))
    sided = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    near = sided.select(F.col("p.a").alias("word"), F.col("p.b").alias("near")).join(words.select(F.col("word").alias("near"), "n"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    good = -F.col("best.n") >= ratio * F.col("n")
    formed = durable(
        joined.select(
            "word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(good, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    return formed.join(last_forms(formed, ratio), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def last_forms(formed: DataFrame, ratio: int) -> DataFrame:
    """``(word, root)`` for the words that have a form. Each self-join doubles the steps taken; counts grow by ``ratio`` a step, which bounds them."""
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    largest = formed.agg(F.max("n")).first()[0] or 1
    steps = 1
    while ratio ** (steps + 1) <= largest:  # a chain may be longer than the steps taken
        steps *= 2
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = durable(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return roots
