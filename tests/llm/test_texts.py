"""Toxicity, byte-level BPE, language-model scoring and HTML extraction against plain loops or exact round trips."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statewatch.llm import bpe, html, language_model, toxicity
from statewatch.llm.common import remainder

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "ab" * 40_000


def odd_texts(spark):
    """NULLs, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two  THREE four\x1cfive"), (5, LONG + " " + "x y " * 9000), (6, "twice"), (6, "twice"), (None, "no id"), (7, "It's 1² <|endoftext|> naïve 日本\r\n\r\n  end  ")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit(9)).withColumn("row", F.lit("r")).withColumn("word", F.lit(b"w")).repartition(3)


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_files_own():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_split_and_heap_match_reference(reference):
    rng = random.Random(3)
    bits = ["'s", "'", "''", "'re", " ", "  ", "'ll", "\n", "\t", "　", "a", "st", "É", "é", "1", "²", "!", "<|endoftext|>", "日本", "😀", "\x1c", "\x85", "ve", "'M", "\r\n", "𐐷", "Ⅷ"]
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(RANKS))}
    for _ in range(60):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(20)]
        words, sizes = bpe.split_words(pa.array(texts))
        words, at = words.to_pylist(), 0
        for text, n in zip(texts, sizes):
            mine = words[at : at + n]
            at += n
            assert b"".join(mine) == text.encode()
            assert [i for w in mine for i in bpe.merge_long(w, ranks)] == reference.encode_ordinary(text)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_encoding_matches_reference(spark, reference, frequent):
    docs = odd_texts(spark)
    extra = spark.createDataFrame([(100 + i, f"Thousands of unbelievably antidisestablishment words'll {i} ééé {'z' * i}") for i in range(40)], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    got = Counter((r.id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_texts(docs, RANKS, frequent=frequent).collect())
    want = Counter()
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), (r.text or "").encode()] += 1
    assert got == want


def test_bpe_of_nothing(spark):
    assert bpe.encode_texts(odd_texts(spark).where("false"), RANKS).count() == 0


def test_blocks_of_one_batch_stay_apart(spark, reference, monkeypatch):
    docs = spark.createDataFrame([(i, f"uniqueword{i * 7919} and {'q' * (i % 9)}") for i in range(300)], "doc_id bigint, text string").coalesce(1)
    plain = bpe.slices
    monkeypatch.setattr(bpe, "slices", lambda batches, column, most=0: plain(batches, column, 400))
    got = {r.id: (bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_texts(docs, RANKS, frequent=10).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (np.array(reference.encode_ordinary(r.text), "<u4").tobytes(), r.text.encode())


# ---------------------------------------------------------------- language model


def tokens(text):
    lower = (text or "").encode().lower()
    return re.findall(rb"[^\x20\x09-\x0d]+", lower) + [b""]


def test_scores(spark):
    rng = random.Random(0)
    languages = [["the", "cat", "sat", "on", "a", "mat", "of", "it"], ["le", "chat", "est", "sur", "un", "lit", "de", "la"]]
    rows = [(i, " ".join(rng.choice(languages[i % 2]) + ("" if rng.random() < 0.9 else str(rng.randint(0, 500))) for _ in range(rng.randint(5, 80)))) for i in range(400)]
    docs = odd_texts(spark).select("doc_id", "text", "word").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(b"w")))
    held = remainder("doc_id", 7) == 2
    got = language_model.score_texts(docs, "doc_id", "text", learn=~held, frequent=20, sample=50).toPandas()
    rows = docs.collect()
    held_out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held_out(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id is None, r.doc_id or 0, len(t := tokens(r.text)), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r in rows)
    mine = sorted((bool(np.isnan(r.id)), int(0 if np.isnan(r.id) else r.id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples())
    assert [w[:4] for w in want] == [m[:4] for m in mine]
    assert np.allclose([w[4] for w in want], [m[4] for m in mine], atol=1e-5)
    assert set(got.train_tokens) == {n}
    clean = got[got.id >= 100] if len(got[got.id >= 100]) else got
    unseen = clean[[held_out(int(i)) for i in clean.id]]
    assert unseen.score.sum() > unseen.base_score.sum()  # it has learned something that the counts don't hold


def test_symbol_probabilities_add_up():
    rng = np.random.default_rng(0)
    model = language_model.Bilinear.start(rng.integers(0, 1000, language_model.SYMBOLS))
    symbols = rng.integers(0, language_model.SYMBOLS, 50).astype(np.uint8)
    first = np.zeros(50, bool)
    first[[0, 20]] = True
    for at in (0, 7, 20, 49):
        total = 0.0
        for s in range(language_model.SYMBOLS):
            changed = symbols.copy()
            changed[at] = s
            total += math.exp(language_model.log_probabilities(model, changed, first)[at])
        assert abs(total - 1.0) < 1e-4


def test_contexts_stop_at_the_start_of_a_text():
    symbols = np.array([5, 6, 7, 8, 9], np.uint8)
    p1, p2, low = language_model.contexts(symbols, np.array([True, False, False, True, False]))
    assert p1.tolist() == [0, 5, 6, 0, 8] and p2.tolist() == [0, 0, 5, 0, 0] and low.tolist() == [0, 0, 0, 3, 3]


def test_nothing_to_learn_from(spark):
    got = language_model.score_texts(odd_texts(spark), "doc_id", "text", learn=F.lit(False))
    assert got.where("n_known > 0 OR train_tokens <> 0 OR isnan(score)").count() == 0 and got.count() == 9
    assert language_model.score_texts(odd_texts(spark).where("false"), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- toxicity


def test_fold():
    assert toxicity.fold("ІD10T ｓｔｕｐｉｄ s​tupíd мorоn$!".encode()) == " idiot stupid stupid morons  "


def marked(spark, n=600):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    docs, marks = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randint(0, len(text)), rng.choice(["grumbleface", "zorgon" + rng.choice(words), "flibbert!!", "gr0mb"]))
        docs.append((i, " ".join(text)))
        marks.append((i, int(toxic), 1))
    marks += [(0, 0, 1), (1, None, 1), (None, 1, 1)]  # marked both ways, NULL
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int, quality int")


def test_held_out_accuracy(spark):
    docs, marks = marked(spark)
    learn = remainder("doc_id", 3) != 1
    got = toxicity.score_toxicity(docs, marks, learn=learn).toPandas()
    assert len(got) == 600 and got.score.between(0, 1).all()
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.id]]
    wrong = (held.predicted != (held.id % 5 == 0)).mean()
    assert wrong < 0.03
    left = toxicity.drop_toxic(docs, marks, learn=learn)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(got[got.predicted == 0].id)


def test_disguises_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " class": 2.0}, [" classic "], (-3.0, 1.0, 1.0))
    automaton = lexicon.automaton()
    weight = lambda t: toxicity.weigh(toxicity.fold(t.encode()), automaton)
    assert weight("you 1d10t") == weight("You IDIOT!") == weight("іdіоt") == 5.0
    assert weight("a classic") == 0.0 and weight("classy") == 2.0 and weight("idiots") == 0.0
    assert 5.0 < weight("idiot idiot idiot") < 15.0
    a, b = toxicity.measures(5.0, 20), toxicity.measures(5.0, 2000)
    assert a[0] == b[0] and a[1] > b[1]


def test_odd_texts_get_a_score(spark):
    _, marks = marked(spark, 20)
    got = toxicity.score_toxicity(odd_texts(spark), marks)
    assert got.count() == 9 and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score_toxicity(odd_texts(spark), marks.where("false")).count() == 9
    assert toxicity.score_toxicity(odd_texts(spark).where("false"), marks).count() == 0
    assert toxicity.drop_toxic(odd_texts(spark), marks).columns == odd_texts(spark).columns


# ---------------------------------------------------------------- HTML

PAGES = {
    "<p>One <b>two</b>\n three<p>Four": "One two three\n\nFour",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>": "* a\n* b\n  3. c\n  4. d\n* e",
    "<table><tr><th>Name<th>Age<tr><td>Bob &amp; Al<td>3</table>": "Name      Age\nBob & Al  3",
    "<table><tr><td rowspan=2>x<td>1<tr><td>2</table>": "x  1\n   2",
    "<table><tr><td>a<table><tr><td>n<td>m</table><td>b</table>": "a     b\n\nn  m",
    "<div>a<div hidden>no</div><div style='color:red; display : none'>no</div>b</div>": "ab",  # what isn't shown breaks no line
    "<title>t</title><script>if(a<b)</script><style>p{}</style><template>no</template>x<noscript>n</noscript>": "x",
    "<pre>a\n  b</pre>c<br>d<br><br>e": "a\n  b\n\nc\nd\n\ne",
    "<dl><dt>t<dd>d</dl><a title='a>b' href=x>link</a> 5 < 6 &copy;": "t\n    d\n\nlink 5 < 6 ©",
    "<!-- no --><p>x<!-- > --> y</p></p>": "x y",
    "<h1>H</h1>text<hr>more": "H\n\ntext\n\n---\n\nmore",
    "<details><summary>more</summary>no</details><details open><summary>all</summary>yes</details>": "more\nall\nyes",
    "": "",
    "no tags   at all": "no tags at all",
    "<b>open <i>never closed": "open never closed",
}


@pytest.mark.parametrize("page", PAGES)
def test_layout(page):
    assert html.visible_text(page) == PAGES[page]


def test_broken_pages_keep_their_text():
    assert html.visible_text("<div>" * 20_000 + "deep") == "deep"
    assert html.visible_text("<" * 1000) == "<" * 1000
    assert html.visible_text("<table><td>a<p>b</table>c").split() == ["a", "b", "c"]
    assert html.visible_text('<a href="x>y') == "y"  # a quote that never ends
    words = [f"w{i}" for i in range(5000)]
    assert html.visible_text("<div><p>" + "<br>".join(words)).split() == words


def test_extract(spark):
    rows = [(1, "<p>a"), (2, None), (3, ""), (4, "<p>a"), (4, "<p>a"), (None, "x " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit("mine")).withColumn("id", F.lit(0))
    got = html.extract_text(pages).collect()
    assert sorted((r.id or 0, len(r.text)) for r in got) == [(0, 199_999), (1, 1), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert html.extract_text(pages.where("false")).count() == 0


# ---------------------------------------------------------------- deep and hidden parts of pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>" * 450 + "<div style='display:none'>SECRET</div>after", "after"),
        ("<div hidden>" + "<div>" * 450 + "x" + "</div>" * 450 + "STILLHIDDEN</div>shown", "shown"),
        ("a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text>chart label</text></svg>b", "a chart label b"),
        ("a<svg><path d='M0'/><text>x</text><text>y</text></svg>", "a x y"),
        ("<p style='visibility:hidden'>no<span style='visibility:visible'>yes</span></p>", "yes"),
        ("<p style='visibility:hidden'>no<span style='visibility:inherit'>nor</span></p>on", "on"),
        ("<div style='visibility:visible;visibility:hidden'>no</div>yes", "yes"),
        ("<div style='display:none;display:block'>yes</div>", "yes"),
        ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
        ("<map><area>in a map</map><object><p>stand-in</p></object><math><mi>x</mi><annotation>no</annotation></math>", "in a map\nstand-in\nx"),
        ("<ul><li style='visibility:hidden'>no<b style='visibility:visible'>yes</b></ul>", "yes"),
    ],
)
def test_visible_parts(page, text):
    got = [line.strip() for line in html.visible_text(page).split("\n") if line.strip()]
    assert got == text.split("\n")


def test_random_deep_trees():
    """Words of the page in order, by a walk over the tree that made it."""
    rng = random.Random(12)
    for depth in (5, 60, 1000):
        for _ in range(6):
            words, page, count = [], [], 0
            state = [(True, True, "")]  # shown, seen, end tag

            def text():
                nonlocal count
                count += 1
                page.append(f" w{count} ")
                if state[-1][0] and state[-1][1]:
                    words.append(f"w{count}")

            while len(state) <= depth:
                shown, seen, _ = state[-1]
                tag, style = rng.choice(["div", "span", "b", "section"]), rng.choice(["", "", "", "visibility:hidden", "visibility:visible"])
                if rng.random() < 0.1 and len(state) > 1 and depth < 100:
                    page.append(state.pop()[2])
                    text()
                    continue
                hidden = rng.random() < 2 / depth / 3
                page.append(f"<{tag}{' hidden' if hidden else ''} style='{style}'>")
                state.append((shown and not hidden, seen if not style else style.endswith("visible"), f"</{tag}>"))
                text()
            while len(state) > 1:
                page.append(state.pop()[2])
                text()
            assert html.visible_text("".join(page)).split() == words


def test_deep_pages_take_time_in_proportion():
    page = "<div><ul><li><p>x" * 20_000
    assert html.visible_text("<b>" * 200_000 + "end" + "</b>" * 200_000) == "end"
    assert html.parse(page) is not None
