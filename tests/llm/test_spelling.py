"""Spelling variants against a comparison of all words, hostile texts, long chains."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import spelling as sp


def near(a, b):
    """One code point inserted, deleted or replaced, by trying each place."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least=6, occurrences=5):
    told = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            told[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in told.items() if len(w) >= least and n >= occurrences}


def brute(words):
    others = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x.encode())) if v else None for w, v in others.items()}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(others[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdeÉéüß×÷Zz") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(rng.choice((None, 1, 2, 3, *range(500))), rng.choice((None, "", " ".join(rng.choices(pool, k=rng.randint(0, 300)))))) for _ in range(300)]
    rows += [(k, "-".join(["abcdef1abcdef", "ABCDEF", "ſabcdefŁ"]) ) for k in range(400)] + rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x")}).repartition(6)
    want = brute_words(rows)
    found = {r.word: r.n for r in sp.words(df).collect()}
    assert found == want and any(len(w) == 6 and w in "abcdef" for w in want)
    assert got(sp.variants(sp.words(df))) == brute(want)


def test_long_text_in_pieces(spark, monkeypatch):
    """Texts longer than a piece are counted piece by piece, counts above the bound are handed on."""
    text = " ".join(f"wörter{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(90_000)) + " " + "y" * 400_000
    rows = [(k, text) for k in range(2)]
    want = brute_words(rows)
    assert len(want) > 600 and max(map(len, want)) < 20
    assert {r.word: r.n for r in sp.words(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


@pytest.mark.parametrize("letters,sizes,seed", [("ab", (6, 9), 1), ("abcé", (6, 8), 2), ("abcdefghij", (6, 7), 3), ("z", (6, 40), 4)])
def test_variants_equal_all_pairs(spark, letters, sizes, seed):
    """Small alphabets put many words, with the same letters in another order, under one number."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): 5 * 3 ** rng.randint(0, 9) for _ in range(500)}
    assert got(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_no_false_neighbours(spark):
    """Transposed letters, equal sums of letters by chance, two exchanges: candidates that must not pass."""
    words = {"abcdef": 900, "abcdfe": 5, "bbcdee": 5, "abcdefab": 5, "abXdef".lower(): 10, "àbcdef": 7, "abcde": 5}
    assert got(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_chain_of_forms(spark):
    words = {"a" * 6 + "b" * k: 5 * 5**k for k in range(11)}
    rows = got(sp.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert rows == brute(words) and rows["a" * 6][1] == "a" * 6 + "b" * 10


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(sp.words(none)).count() == 0


def test_bucket_of_a_third_is_split(spark):
    """Words with the same letters meet under one number; their halves deal them out."""
    rng = random.Random(4)
    words = {"".join(rng.sample("aaaabbbbccccdddd", 16)): 5 for _ in range(1500)} | {"".join(rng.choice("efghijklmn") for _ in range(9)): 5 for _ in range(1500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {(r.word, r.other) for r in sp.near_pairs(df).collect()} == {(a, b) for a in words for b in words if a[0:4] == b[0:4] and near(a, b)} | {(a, b) for a in words for b in words if a[-4:] == b[-4:] and near(a, b)}
