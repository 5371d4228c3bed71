"""Spelling variants by anagram hashing: words that differ by one letter, and the frequent form that each may stand for.

A word's key is the sum of its letters' code points to the fifth power, modulo 2 ** 62. Removing a letter takes its value away, adding one adds it, exchanging one does both. So two
words one letter apart either have keys that differ by a letter's value, or keys that are equal when each has lost the value
of one of its letters. Each word is dealt out under its key (loss 0) and under its key less the value of each of its
distinct letters (loss 1); two rows that meet under one number, of which at least one has lost a letter, are candidates.
A letter's place is not in the key: Spark's levenshtein with a bound of 1 verifies the order of letters, inside the join.

Words are counted in Python, a text at a time, with each batch's words summed up before they leave the task; a long text is
cut at its letters' runs and summed up piece by piece. What is shuffled is then the vocabulary and not the texts. The keys,
the join and the forms are DataFrame operations. A number's bucket holds the words that share their letters but one; buckets
are split by halves too: of two words one letter apart, either the first half or the second half of the shorter one is the
beginning or the end of both, so rows meet only if they also share a beginning or an end. A pair may so meet several times,
and is counted once. No list of a bucket's words is ever built.

form: of the near words that with the largest n, the first in code point order if several have it, provided that n is `times`
the word's own n or more. root: what following forms leads to; n grows `times`-fold with each, so the number of doublings
that can matter follows from the largest n.

A null text has no words; a null doc_id counts as an empty one. Texts of any length are read whole. Documents that repeat
count as often. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

#: Fixed values of the contract: letters, and the damage to a run whose checksum the divisor divides.
LETTERS = "A-Za-zÀ-ÿ"
DIVISOR = 199
POWER = 5
#: A text is read in pieces of so many runs, and a task's counts are handed on at so many words.
PIECE, HELD = 1 << 18, 1 << 18

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _counts(least: int):
    """Word and how often, of words of `least` letters or more, summed up over many texts."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")  # whole runs, as a match begins where a run does

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(told), pa.string()), pa.array(list(told.values()), pa.int64())], ["word", "n"])
            told.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = (m.group() for m in runs.finditer(text)) if len(text) > PIECE else iter(runs.findall(text))
                while some := list(islice(found, PIECE)):
                    for raw, n in Counter(some).items():
                        word = raw.lower() if raw.isascii() else raw.translate(_LOWER)
                        h = zlib.crc32(word.encode(), prefix)
                        if not h % DIVISOR:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        told[word] += n
                    if len(told) >= HELD:
                        yield flush()
        if told:
            yield flush()

    return run


def words(docs: DataFrame, least: int = 6, occurrences: int = 5) -> DataFrame:
    """word, n: the words of the texts that have `least` code points or more and occur that often."""
    lean(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts(least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _value(letter: Column) -> Column:
    return F.pow(F.ascii(letter).cast("double"), F.lit(float(POWER))).cast("long")


def anagram_key(word: Column) -> Column:
    """The sum of the fifth powers of the code points, modulo 2 ** 62 (which only words of millions of letters reach)."""
    letters = F.split(word, "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: F.pmod(s + _value(c), F.lit(1 << 62)))


def _less(key: Column, letter: Column) -> Column:
    return F.pmod(key - _value(letter), F.lit(1 << 62))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, other: each pair of words of the vocabulary (word, n) that are one letter apart, in both directions."""
    size = F.char_length("word")
    keyed = vocabulary.select("word", anagram_key(F.col("word")).alias("key"))
    plain = keyed.select("word", "key", F.lit(0).alias("lost"))
    fewer = keyed.select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "key").select("word", _less(F.col("key"), F.col("c")).alias("key"), F.lit(1).alias("lost"))
    rows = plain.unionByName(fewer)
    # s letters are under the key: words that meet have s or s + 1, and with one letter added, removed or exchanged they
    # share s // 2 letters at their beginning or at their end
    half = F.floor((size - F.col("lost")) / 2).cast("int")
    sides = F.array(F.struct(F.lit(False).alias("tail"), F.substr("word", F.lit(1), half).alias("half")), F.struct(F.lit(True).alias("tail"), F.right("word", half).alias("half")))
    met = rows.withColumn("at", F.explode(sides)).select("word", "key", "lost", "at.tail", "at.half")
    a, b = met.alias("a"), met.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "tail", "half")]
    removal = (F.col("a.lost") == 0) & (F.col("b.lost") == 1)
    exchange = (F.col("a.lost") == 1) & (F.col("b.lost") == 1) & (F.col("a.word") < F.col("b.word"))
    verified = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    pairs = a.join(b, [*on, removal | exchange, verified]).select(F.col("a.word").alias("x"), F.col("b.word").alias("y")).distinct()
    both = F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other")), F.struct(F.col("y").alias("word"), F.col("x").alias("other"))))
    return pairs.select(both.alias("p")).select("p.*")


def variants(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary (word, n)."""
    held = cut(vocabulary)
    other = held.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = near_pairs(held).join(other, "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("other_n").alias("most"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("other"))).alias("best"))
    told = held.join(best, "word", "left").withColumn("is_form", F.coalesce(F.col("most") >= F.col("n") * times, F.lit(False)))
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best.other")).alias("form"), F.when(F.col("is_form"), F.col("most")).alias("form_n")))
    # a chain of forms has log(n) steps at most, each doubling follows twice as many
    links = cut(told.filter("form is not null").select("word", F.col("form").alias("root")))
    most = held.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most, 2)) / math.log(times)))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near", F.col("form_n").cast("long").alias("form_n"))
