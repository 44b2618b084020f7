"""Manifest proofs, licence notices and spelling variants against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statewatch.llm import licences, merkle, spelling
from statewatch.llm.common import ascii_lower

# ---------------------------------------------------------------- manifest


def spell(value):
    if value is None:
        return b"-"
    text = ",".join(map(str, value)) if isinstance(value, list) else str(value)
    return f"{len(text.encode())}:{text}".encode()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def levels_of(row):
    made = [row]
    while len(made[-1]) > 1:
        made.append([sha("".join(made[-1][i : i + 8])) for i in range(0, len(made[-1]), 8)])
    return made


def proof_of(levels, i):
    steps = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        steps.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return steps


def expected(rows, state, shot, fields, change):
    """Multiset of result rows by a plain tree."""
    groups = defaultdict(list)
    for r in rows:
        leaf = sha(b"".join(spell(r[f]) for f in fields))
        held = sha(b"".join(spell(change(r, f)) for f in fields))
        groups[r[state]].append(((r[shot] is not None, r[shot] or 0), leaf, held, r[shot]))
    names = sorted(groups, key=lambda k: (k is not None, str(k).encode() if k is not None else b""))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda x: x[:2])
        trees[k] = levels_of([x[1] for x in groups[k]])
    over = levels_of([trees[k][-1][0] for k in names])
    found = Counter()
    for n, k in enumerate(names):
        for i, (_, leaf, held, id) in enumerate(groups[k]):
            steps = proof_of(trees[k], i) + proof_of(over, n)
            for left, right in steps:
                held = sha(left + held + right)
            found[(id, leaf, trees[k][-1][0], over[-1][0], sha("".join(a + b for a, b in steps)), held, held == over[-1][0])] += 1
    return found


def result(found):
    return Counter((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect())


@pytest.mark.parametrize("shipped", [0, 4096])
def test_proofs_of_documents(spark, monkeypatch, shipped):
    monkeypatch.setattr(merkle, "SHIPPED", shipped)
    rows = [(i, "Text %d" % (i % 50), "en", i % 7, "x") for i in range(1200)] + [(5000 + i, None if i == 3 else "", None, None, None) for i in range(9)]
    rows += [(6000, "Lone Leaf", "zz", 1, ""), (None, "No Id", "de", 2, "n"), (6001, "Long " * 40_000, "de", 3, "t"), (6001, "same id", "de", 3, "t")]
    rows += [(6002, "twice", "fr", 3, "t")] * 2 + [(7000 + i, "many streams", f"l{i:02d}", 3, "t") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int, node string").repartition(5)
    docs = docs.withColumns({"t": F.lit(1), "index": F.lit(2), "id": F.lit("c"), "tree": F.lit("x")})
    fields = ("doc_id", "lang", "n", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    got = result(merkle.manifest_proofs(docs, "lang", "doc_id", fields, {"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))}))

    def change(r, f):
        if f == "text" and r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            return r["text"].encode().lower().decode()
        return r[f]

    assert got == expected(docs.collect(), "lang", "doc_id", fields, change)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_proofs_of_shot_records(spark):
    rows = [(s, i, [i % 2, s % 2, None if i == 3 else 1]) for s in range(3) for i in range(20)] + [(9, 0, None)]
    shots = spark.createDataFrame(rows, "state int, shot bigint, bits array<int>")
    found = merkle.manifest_proofs(shots)
    assert all(r.verified for r in found.collect()) and len({r.root for r in found.collect()}) == 1
    plain = [{"state": s, "shot": i, "bits": b and ["null" if x is None else x for x in b]} for s, i, b in rows]
    assert result(found) == expected(plain, "state", "shot", ("state", "shot", "bits"), lambda r, f: r[f])


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9])
def test_proofs_of_small_tables(spark, n):
    shots = spark.createDataFrame([(1, i, [i]) for i in range(n)], "state int, shot bigint, bits array<int>")
    plain = [{"state": 1, "shot": i, "bits": [i]} for i in range(n)]
    assert result(merkle.manifest_proofs(shots)) == expected(plain, "state", "shot", ("state", "shot", "bits"), lambda r, f: r[f])


def test_a_changed_record_does_not_verify(spark):
    shots = spark.createDataFrame([(1, i, [i]) for i in range(30)], "state int, shot bigint, bits array<int>")
    bad = F.when(F.col("shot") == 7, F.lit("8")).otherwise(F.concat_ws(",", F.col("bits").cast("array<string>")))
    found = merkle.manifest_proofs(shots, received={"bits": bad})
    assert [r.id for r in found.collect() if not r.verified] == [7]


# ---------------------------------------------------------------- licences


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower().decode())
    starts, base, labels, best = [], set(), set(), 0.0
    for phrase, label in licences.NAMES.items():
        part = phrase.split(" ")
        for i in range(len(words)):
            if words[i : i + len(part)] == part:
                starts.append(i)
                base.add(label)
                best = max(best, licences.NAME_ALONE)
    for label, notice, keys in licences.NOTICES:
        whole = notice.split(" ")
        places = []
        for key in keys:
            part = key.split(" ")
            places.append((next(i for i in range(len(whole)) if whole[i : i + len(part)] == part), part))
        for s in range(-len(whole), len(words)):
            if all(s + at >= 0 and words[s + at : s + at + len(part)] == part for at, part in places):
                labels.add(label)
                best = max(best, sum(s + i >= 0 and s + i < len(words) and words[s + i] == w for i, w in enumerate(whole)) / len(whole))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best


def notices():
    rng = random.Random(4)
    pool = sorted({w for _, n, _ in licences.NOTICES for w in n.split(" ")}) + ["plain", "été", "mit", "Apache", "ıt"]
    made = [None, "", " \n", "MIT License", "mit  license, mit-license; MIT licence", "license mit", "The MIT\nLicense and the Apache License, Version 2.0."]
    made += ["x " * 30_000 + "general public license " * 2000, "kept under CC BY-NC 4.0 only", "éMIT license", "mit license" * 3]
    for label, notice, _ in licences.NOTICES:
        made += [notice.title(), "so: " + notice.replace(" ", " - "), notice.split(" ", 2)[2], notice.replace("the", "their")]
    for _ in range(200):
        made.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))))
        a, b = rng.choice(licences.NOTICES)[1].split(" "), rng.choice(licences.NOTICES)[1].split(" ")
        a[rng.randrange(len(a))] = rng.choice(pool)
        made.append(" ".join(a[rng.randrange(4) :] + b))
    return made


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_licences_equal_a_plain_scan(spark, depth):
    rows = list(enumerate(notices())) + [(None, "MIT license"), (3, "MIT License")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(1), "w": F.lit("q"), "r": F.lit("q"), "word": F.lit("q")}).repartition(3)
    found = licences.scan_licences(docs, depth=depth).collect()
    want = Counter((i, *plain_scan(t)) for i, t in rows)
    got = Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in found)
    assert {k[:-1] for k in got} == {k[:-1] for k in want}
    assert {(k[0], round(k[-1], 12)) for k in got} == {(k[0], round(k[-1], 12)) for k in want} and sum(got.values()) == len(rows)


def test_licences_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert licences.scan_licences(docs).count() == 0
    with pytest.raises(ValueError):
        licences.scan_licences(docs, names={}, notices=[])
    with pytest.raises(ValueError):
        licences.Template.of("x", "one two", ["two one"])


def test_licence_scan_has_no_python(spark, capsys):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id bigint, text string")
    licences.scan_licences(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- spelling


def near(a, b):
    """Exactly one insertion, deletion or replacement."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_variants(rows, slip, shortest=6, fewest=5, ratio=5):
    total = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    words = {w: n for w, n in total.items() if n >= fewest and len(w) >= shortest}
    beside = {w: [u for u in words if near(w, u)] for w in words}
    form = {}
    for w, n in words.items():
        u = min(beside[w], key=lambda u: (-words[u], u), default=None)
        form[w] = u if u is not None and words[u] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(beside[w]), words.get(form[w])) for w, n in words.items()}


def prose():
    rng = random.Random(6)
    parts = ["tion", "an", "ver", "ing", "é", "ñ", "sch", "Ö", "a", "aa", "b", "÷"]
    stems = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 7))) for _ in range(60)] + ["a" * k for k in range(5, 12)] + ["abcabc", "abcabcabc", "ABCABC"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + int(rng.paretovariate(0.6)) % len(stems)])
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abn"), w[k] + rng.choice("ab")]) + w[k + 1 :]
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(None, "nullid " * 6), (500, None), (501, ""), (502, "Longest" * 500 + " " + "lon" * 3000), (503, "wordword wordworb " * 9000), (503, "wordword " * 5)]
    return rows + [(600 + i, "lon" * 3000 + " " + "lon" * 2999 + "lo") for i in range(6)]


@pytest.mark.parametrize(("slip", "entries"), [(None, 20), (3, 200), (1, 20_000)])
def test_variants_equal_a_plain_loop(spark, slip, entries):
    rows = prose()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "key": F.lit(3), "id": F.lit(4)}).repartition(4)
    found = spelling.spelling_variants(docs, slip=slip, entries=entries).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert len(got) == len(found) and got == plain_variants(rows, slip)
    assert any(v[0] for v in got.values()) or slip == 1


def test_variants_of_an_empty_table_and_bad_arguments(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(docs).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, shortest=5)
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, ratio=1)


def test_no_change_touches_every_gram():
    """Whatever the dictionary, a word of six code points keeps a gram, and what a change keeps is kept on both sides."""
    rng = random.Random(2)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcd"
        grams = spelling.Grams.of({"".join(rng.choice(letters) for _ in range(3)) for _ in range(rng.randrange(1, 20))}, 3)
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        gaps, cuts, n, affected = grams.keys(word)
        assert affected < n
        k = rng.randrange(len(word))
        replaced = word[:k] + "z" + word[k + 1 :]
        assert gaps & grams.keys(replaced)[0]
        if len(word) > 6:
            assert gaps & grams.keys(word[:k] + word[k + 1 :])[1]
