"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alike characters.

The project's records hold numbers and bits, no prose, so this operator is general: any table with an id and a text,
and a table of 0/1 marks for some of the ids.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.llm.common import arrow_rows, hashed_sample, plain, slices, texts, trimmed
from statewatch.plans.durable import durable

#: Characters that look like a Latin letter (Cyrillic, Greek), and digits or signs that stand for one.
LOOK_ALIKES = dict(
    zip(
        "абвгеёзикмнорстухіјѕԁԛԝһӏαβγεηικνορτυχωϲ",
        "a6bree3nkmhopctyxijsdqwhlabyenikvoptuxwc",
        strict=True,
    )
)
SUBSTITUTES = dict(zip("01345789@$€£", "oieastbgasel", strict=True))
#: Prefixes of a word that may enter the lexicon: their lengths.
PREFIXES = range(4, 9)


def fold_table() -> np.ndarray:
    """Code point -> folded code point; 32 for anything that isn't a letter.

    Compatibility forms, case and accents fold first (so full-width and styled letters count), then look-alikes and substitutes. Letters of
    other scripts stay.
    """
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c in SUBSTITUTES:
            table[code] = ord(SUBSTITUTES[c])
        elif c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[0].lower()
            base = LOOK_ALIKES.get(base, base)
            table[code] = ord(SUBSTITUTES.get(base, base))
    table[0x200B:0x2010] = 0  # zero-width marks vanish
    table[0xAD] = 0
    table[0x300:0x370] = 0  # combining accents
    return table


TABLE: list[np.ndarray] = []


def fold(text: bytes) -> str:
    """Folded text: letters, and one space for every other character; a space before and after."""
    if not TABLE:
        TABLE.append(fold_table())
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    codes = TABLE[0][codes]
    return f" {codes[codes != 0].astype('<u4').tobytes().decode('utf-32-le')} "


@dataclass
class Lexicon:
    """``weights``: patterns over folded text, " word " or " prefix". ``exceptions``: whole phrases whose matches don't count.
    ``model``: intercept and slopes of the score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    model: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        entries = {p: (len(p), w, p) for p, w in self.weights.items()}
        entries |= {p: (len(p), None, p) for p in self.exceptions}
        if not entries:
            return None
        found = ahocorasick.Automaton()
        for p, value in entries.items():
            found.add_word(p, value)
        found.make_automaton()
        return found


def weigh(folded: str, automaton: ahocorasick.Automaton | None) -> float:
    """Weight of the matches: at each word the heaviest pattern counts, unless an exception phrase covers it; a pattern that comes n times
    counts 1 + log n times, so that one repeated word does not decide."""
    if automaton is None:
        return 0.0
    best: dict[int, tuple[float, str]] = {}
    clear: list[tuple[int, int]] = []
    for end, (n, weight, pattern) in automaton.iter(folded):
        start = end - n + 1
        if weight is None:
            clear.append((start, end))
        elif start not in best or weight > best[start][0]:
            best[start] = (weight, pattern)
    for start, end in clear if best else ():
        for at in range(start, end):
            best.pop(at, None)
    times = Counter(best.values())
    return sum(weight * (1.0 + math.log(n)) for (weight, _), n in times.items())


def measures(total: float, words: int) -> tuple[float, float]:
    """How much was matched, and how much for the length of the text."""
    return math.log1p(total), math.log1p(100.0 * total / (words + 20.0))


def terms(folded: str) -> set[str]:
    """Patterns that a text could lend the lexicon: its words and their prefixes."""
    words = folded.split()
    out = {f" {w} " for w in set(words) if len(w) > 2}
    out |= {f" {w[:n]}" for w in set(words) for n in PREFIXES if len(w) > n}
    return out


def count_terms(docs: DataFrame, only: list[str] | None, most: int = 400_000) -> DataFrame:
    """``(term, docs)``: texts that hold each term. A task flushes its counts when it holds ``most`` of them."""

    wanted = None if only is None else set(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "docs"])
            counts.clear()
            return out

        for batch in slices(batches, 0):
            for t in texts(batch.column(0)):
                found = terms(fold(t))
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > most:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(trimmed(run), "term string, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))


def sketched(docs: DataFrame) -> DataFrame:
    """Adds ``sketch``, the smallest hash of the three-word shingles; near copies mostly share it."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("sketch", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            out = []
            for t in texts(batch.column(at)):
                words = t.lower().split()
                grams = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
                out.append(min(map(xxhash.xxh64_intdigest, grams)) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def choose(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, support: int, least: float) -> Lexicon:
    """The lexicon from document counts ``(term, in toxic, in clean)``.

    A weight is the smoothed log odds of the term less one and a half standard errors. A longer pattern is left out where a prefix of it says as much; one that a
    kept prefix covers, though clean texts use it, becomes an exception.
    """
    odds = {}
    for term, a, b in counts:
        likely = math.log((a + 0.5) / (toxic + 1.0)) - math.log((b + 0.5) / (clean + 1.0))
        odds[term] = likely - 1.5 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), a, b
    weights: dict[str, float] = {}
    exceptions = []
    for term in sorted(odds, key=lambda t: (len(t.rstrip()), t)):
        weight, a, b = odds[term]
        parents = [weights[p] for n in range(2, len(term)) if (p := term[:n]) in weights]
        above = max(parents, default=0.0)
        if weight >= least and a >= support:
            if weight > above + (0.7 if parents else 0.0):
                weights[term] = weight
        elif parents and term.endswith(" ") and weight < 0.0 and b >= 3:
            exceptions.append(term)
    return Lexicon(weights, exceptions)


def fit_score(points: np.ndarray, marks: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression of the marks on the two measures, by Newton's method with a small ridge."""
    if not len(marks) or marks.min() == marks.max():
        rate = (float(marks.sum()) + 0.5) / (len(marks) + 1.0)
        return (math.log(rate / (1 - rate)), 1.0, 1.0)
    x = np.column_stack([np.ones(len(points)), points])
    beta = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (marks - p) - ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def marked_ids(docs: DataFrame, marks: DataFrame, id: str, mark: str, sample: int) -> DataFrame:
    """``(_id, mark)`` of the rows to learn from: about ``sample`` ids of each mark, by hash. Only ids are shuffled."""
    known = marks.where(F.col(mark).isin(0, 1) & F.col(id).isNotNull())
    known = known.groupBy(F.col(id).alias("_id")).agg(F.min(mark).cast("int").alias("mark"), F.max(mark).alias("high")).where("mark = high").drop("high")
    ids = durable(docs.select(F.col(id).alias("_id")).distinct().join(known, "_id"), "ids")
    sizes = {r["mark"]: r["n"] for r in ids.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    picked = (hashed_sample(ids.where(F.col("mark") == m), F.xxhash64("_id"), sizes.get(m, 0), sample) for m in (0, 1))
    return durable(reduce(DataFrame.unionByName, picked), "sample")


def learn_lexicon(docs: DataFrame, marks: DataFrame, id: str, text: str, mark: str, candidates: int = 50_000, sample: int = 20_000, support: int = 4, least: float = 1.5) -> Lexicon:
    """Fit on rows of ``docs`` whose id has a 0/1 ``mark`` (ids marked both ways, or NULL, are left out).

    It learns from about ``sample`` ids of each mark (twice that at most), picked by hash; that bounds what is gathered, so the ids are broadcast and no
    text is shuffled to find them. Near copies among them (equal mark and equal smallest hash of three-word shingles) teach once. First the
    terms of toxic texts are counted; the ``candidates`` most frequent are then counted in the clean texts. The intercept and
    the slopes are fitted on the same rows.
    """
    picked = F.broadcast(marked_ids(docs, marks, id, mark, sample))  # at most four times the sample
    both = sketched(docs.select(F.col(id).alias("_id"), plain(text).alias("text")).join(picked, "_id"))
    both = both.select(F.col("_id").alias("id"), "text", "mark", "sketch").dropDuplicates(["mark", "sketch"])
    with arrow_rows(docs.sparkSession):
        both = durable(both.drop("sketch"), "marked")
    sizes = {r["mark"]: r["n"] for r in both.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, [], (math.log((toxic + 0.5) / (clean + 0.5)), 1.0, 1.0))
    support = max(support, round(0.004 * toxic))
    bad = count_terms(both.where("mark = 1"), None).where(F.col("docs") >= 2)
    bad = {r["term"]: r["docs"] for r in bad.orderBy(F.desc("docs"), "term").limit(candidates).collect()}
    good = {r["term"]: r["docs"] for r in count_terms(both.where("mark = 0"), list(bad)).collect()}  # no more rows than candidates
    lexicon = choose([(t, n, good.get(t, 0)) for t, n in bad.items()], toxic, clean, support, least)
    rows = match(both, "id", "text", lexicon, ["mark"]).select("mark", "weight", "n_words").collect()
    points = np.array([measures(r["weight"], r["n_words"]) for r in rows]).reshape(-1, 2)
    lexicon.model = fit_score(points, np.array([r["mark"] for r in rows], dtype=float))
    return lexicon


def match(docs: DataFrame, id: str, text: str, lexicon: Lexicon, keep: list[str] = ()) -> DataFrame:
    """``(id, weight, n_words, score)`` and the columns ``keep``, one row per row of ``docs``."""
    columns = [F.col(id).alias("id"), *[F.col(c) for c in keep]]
    fields = [T.StructField("id", docs.schema[id].dataType), *[docs.schema[c] for c in keep]]
    schema = T.StructType([*fields, T.StructField("weight", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        b0, b1, b2 = lexicon.model
        for batch in slices(batches, width):
            weights, words, scores = [], [], []
            for t in texts(batch.column(width)):
                folded = fold(t)
                n = len(t.split())
                total = weigh(folded, automaton)
                m1, m2 = measures(total, n)
                z = max(-40.0, min(40.0, b0 + b1 * m1 + b2 * m2))
                weights.append(total)
                words.append(n)
                scores.append(1.0 / (1.0 + math.exp(-z)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(weights, pa.float64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*columns, plain(text).alias("_text")).mapInArrow(trimmed(run), schema)


def score_toxicity(docs: DataFrame, marks: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "toxic", learn=None, threshold: float = 0.7, **options) -> DataFrame:
    """One row per row of ``docs``: ``id, score, predicted``; ``predicted`` is 1 from ``threshold`` on.

    ``learn`` is a condition on ``docs``: only those rows lend their marks (all, where not given). The score of a text depends on the text alone: the matched
    weight, and the matched weight for its length, through a logistic curve.

    Cases: NULL text counts as empty and gets the score of a text without matches. Rows without mark, NULL marks and ids marked both ways teach nothing;
    without any toxic or clean row the score is the smoothed rate. Repeated rows count as often as they occur. An empty table
    gives no rows. Columns other than id and text are not read (but by ``learn``). Texts are folded and matched whole.
    """
    lexicon = learn_lexicon(docs if learn is None else docs.where(learn), marks, id, text, mark, **options)
    found = match(docs, id, text, lexicon)
    return found.select("id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "n_words")


def drop_toxic(docs: DataFrame, marks: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "toxic", learn=None, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` predicts as toxic; all columns stay."""
    lexicon = learn_lexicon(docs if learn is None else docs.where(learn), marks, id, text, mark, **options)
    return keep_clean(docs, text, lexicon, threshold)


def keep_clean(docs: DataFrame, text: str, lexicon: Lexicon, threshold: float) -> DataFrame:
    """Filter the rows where they are read, in the same pass that scores them."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        b0, b1, b2 = lexicon.model
        for batch in slices(batches, at):
            keep = []
            for t in texts(batch.column(at)):
                m1, m2 = measures(weigh(fold(t), automaton), len(t.split()))
                keep.append(1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, b0 + b1 * m1 + b2 * m2)))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)

