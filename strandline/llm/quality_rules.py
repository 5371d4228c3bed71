"""Quality rules: word counts, repeats, and cross-document line frequency.

Base figures come from one pass over whole texts. The line rule hashes each normalised line (lower case, white space
runs as one space, digits as 0) of a word or more, counts the distinct documents of a host that have it, removes the lines
above the host's limit, and rejects a document that keeps too few of its words.

Documents of a host with the same set of normalised lines count as one, so exact copies don't make boilerplate of their own
lines; documents that differ in any line are distinct, however much they share. The limit is a share of the host's distinct
documents within bounds.

A null or empty text has no words and fails the base rules. A null host is a host of its own. A doc_id may repeat: rows
are told apart by doc_id and text, and equal rows share one verdict and count as one document. A table without
the host's column is one host. A line stands for its hash, of 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import boxed, cut, hot_join, lean, same_document, sieved

#: A line is removed above this share of its host's distinct documents, never at so few as MIN_DOCS and always above
#: MAX_DOCS, however large the host is.
MAX_SHARE, MIN_DOCS, MAX_DOCS = 0.002, 10, 100
#: A document is rejected below this share of its words.
MIN_LEFT = 0.5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))


def _lines(part: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces between line feeds, and the number of each one's text."""
    breaks = np.flatnonzero(part.data == 10)
    start = np.sort(np.concatenate([part.offsets[:-1], breaks + 1]))
    owner = np.concatenate([np.arange(len(part)), np.searchsorted(part.offsets, breaks, side="right") - 1])
    start_owner = np.concatenate([part.offsets[:-1], breaks + 1])
    order = np.lexsort((start_owner, owner))
    start, owner = start_owner[order], owner[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = part.offsets[1:][owner[last]]
    return np.stack([start, end]), owner


def _exact_hash(part: tk.Texts, bounds: np.ndarray) -> np.ndarray:
    """A hash of the bytes between bounds."""
    with np.errstate(over="ignore"):
        up, down = tk._powers.upto(len(part.data) + 1)
        sums = np.zeros(len(part.data) + 1, tk.U64)
        np.cumsum(tk._BYTE[part.data] * up[: len(part.data)], out=sums[1:])
        return tk.mix((sums[bounds[1]] - sums[bounds[0]]) * down[bounds[0]] ^ tk.mix((bounds[1] - bounds[0]).astype(tk.U64)))


def _repeat_words(w: tk.Words, texts: int) -> np.ndarray:
    """Words, by text, that lie in a run of three words that the text has twice or more."""
    with np.errstate(over="ignore"):
        count = max(0, len(w.hash) - 2)
        runs = w.hash[:count] * tk._STEPS[0] + w.hash[1 : count + 1] * tk._STEPS[1] + w.hash[2 : count + 2] * tk._STEPS[2]
        at = np.flatnonzero(w.text[:count] == w.text[2:]) if count else np.empty(0, np.int64)
        keys = tk.mix(runs[at] ^ tk.mix(w.text[at].astype(tk.U64) + tk.U64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    hit = np.zeros(len(w.hash), bool)
    for k in range(3):
        hit[at[again] + k] = True
    return np.bincount(w.text[hit], minlength=texts)


def base_figures(part: tk.Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(part)
    w = tk.words(part)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[part.offsets])
    head = (part.data & 0xC0) != 0x80  # a byte that begins a code point
    bounds, owner = _lines(part)
    with_word = np.searchsorted(w.start, bounds[1]) > np.searchsorted(w.start, bounds[0])
    bounds, owner = bounds[:, with_word], owner[with_word]
    with np.errstate(over="ignore"):
        keys = tk.mix(_exact_hash(part, bounds) ^ tk.mix(owner.astype(tk.U64) + tk.U64(1)))
    first = np.unique(keys, return_index=True)[1]
    return [np.diff(w.first), count(head & ~tk.WHITE[part.data]), count(_SYMBOL[part.data]), np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n), _repeat_words(w, n)]


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each text's set of lines; at is where each begins among values without repeats."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, tk.U64)
        np.cumsum(tk.mix(values ^ tk.U64(0x2545F491)), out=sums[1:])
        return tk.mix(sums[at[1:]] - sums[at[:-1]] ^ np.diff(at).astype(tk.U64)).view(np.int64)


def normal_lines(part: tk.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice in lower case: hash, words, text and bounds of each piece between line feeds, blank ones included."""
    digits = _DIGIT[part.data]
    part = tk.Texts(np.where(digits, np.uint8(ord("0")), part.data), part.offsets)
    bounds, owner = _lines(part)
    w = tk.words(part)
    a, b = np.searchsorted(w.start, bounds[0]), np.searchsorted(w.start, bounds[1])
    with np.errstate(over="ignore"):
        # the line's words in order: a polynomial over the numbers of the words in the line
        up, down = tk._powers.upto(len(w.hash) + 1)
        sums = np.zeros(len(w.hash) + 1, tk.U64)
        np.cumsum(w.hash * up[: len(w.hash)], out=sums[1:])
        hashed = tk.mix((sums[b] - sums[a]) * down[a] ^ (b - a).astype(tk.U64))
    return hashed, b - a, owner, bounds


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain, lower = tk.texts_of(batch.column("text")), tk.texts_of(batch.column("text"), lower=True)
        for a, part in plain.slices():
            b = a + len(part)
            mine = tk.Texts(lower.data[lower.offsets[a] : lower.offsets[b]], lower.offsets[a : b + 1] - lower.offsets[a])
            hashed, size, owner, _ = normal_lines(mine)
            keep = size > 0
            hashed, size, owner = hashed[keep], size[keep], owner[keep]
            # a line that comes again in a text counts once, with all its words
            with np.errstate(over="ignore"):
                _, first, back = np.unique(tk.mix(hashed ^ tk.mix(owner.astype(tk.U64) + tk.U64(1))), return_index=True, return_inverse=True)
            total = np.bincount(back, weights=size, minlength=len(first)).astype(np.int32)
            order = np.argsort(owner[first], kind="stable")
            first, total = first[order], total[order]
            at = np.searchsorted(owner[first], np.arange(len(part) + 1)).astype(np.int32)
            lines = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(hashed[first].view(np.int64)), pa.array(total)], ["line", "words"]))
            told = [batch.column(c).slice(a, len(part)) for c in ("doc_id", "text_key", "host")]
            figures = [pa.array(x.astype(np.int64)) for x in base_figures(part)]
            yield pa.RecordBatch.from_arrays([*told, *figures, lines, pa.array(set_keys(hashed[first], at))], ["doc_id", "text_key", "host", *FIGURES, "lines", "set_key"])


def _host(docs: DataFrame, host: str) -> Column:
    return F.col(f"`{host}`").cast("string") if host in docs.columns else F.lit(None).cast("string")


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, text_key, host, the base figures, lines: an array of (line, words) without repeats, set_key: a hash of the
    set of lines."""
    lean(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), _host(docs, host).alias("host"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{x} long" for x in FIGURES)
    return keyed.mapInArrow(_figures, f"doc_id long, text_key long, host string, {kinds}, lines array<struct<line:bigint,words:int>>, set_key long")


def frequent_lines(read: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, max_docs: int = MAX_DOCS) -> DataFrame:
    """host_key, line, docs (distinct documents of the host with it), n (its rows) of the lines to remove.

    The distinct counts are dealt by host, line and set first, so neither a hot host nor a hot line meets in one task. Only
    lines between the bounds need their host's limit, which is above the lower one for large hosts alone; these are joined
    with hot hosts apart."""
    keyed = read.select(F.xxhash64("host").alias("host_key"), "set_key", "lines").filter(F.size("lines") > 0)
    lines = keyed.select("host_key", "set_key", F.explode("lines.line").alias("line"))
    sets = lines.groupBy("host_key", "line", "set_key").agg(F.count(F.lit(1)).alias("n"))
    often = cut(sets.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") > min_docs))
    hosts = keyed.select("host_key", "set_key").distinct().groupBy("host_key").agg(F.count(F.lit(1)).alias("in_host"))
    large = cut(hosts.filter(F.col("in_host") * max_share > min_docs).select("host_key", F.least(F.lit(float(max_docs)), F.col("in_host") * max_share).alias("limit")))
    unsure = often.filter(F.col("docs") <= max_docs)
    limited = hot_join(unsure, large, ["host_key"], unsure.groupBy("host_key").agg(F.count(F.lit(1)).alias("n")), "left")
    sure = often.filter(F.col("docs") > max_docs)
    return sure.unionByName(limited.filter(F.col("limit").isNull() | (F.col("docs") > F.col("limit"))).drop("limit"))


def judge(docs: DataFrame, host: str = "source", min_left: float = MIN_LEFT, **limits) -> tuple[DataFrame, DataFrame]:
    """The verdicts (doc_id, text_key, host, figures, n_frequent_words, removed: its lines that are frequent,
    base_failed, kept), a row for each row of docs, and the frequent lines."""
    read = cut(figures(docs, host)).withColumn("doc", F.xxhash64("doc_id", "text_key", "host"))
    frequent = cut(frequent_lines(read, **limits))
    # a line that a third of all rows have is among the hot ones
    lines = read.select("doc", F.xxhash64("host").alias("host_key"), F.explode("lines").alias("x")).select("doc", "host_key", "x.line", "x.words")
    held = hot_join(lines, frequent.select("host_key", "line"), ["host_key", "line"], frequent.select("host_key", "line", "n"))
    held = held.groupBy("doc").agg(F.collect_set(F.struct("line", "words")).alias("x"))  # equal rows have one doc
    lost = held.select("doc", F.aggregate("x.words", F.lit(0).cast("long"), lambda a, w: a + w).alias("lost"), F.col("x.line").alias("removed"))
    out = read.drop("lines").join(lost, "doc", "left").withColumn("n_frequent_words", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("n_frequent_words") >= min_left * F.col("n_words"))
    return out.select("doc_id", "text_key", "host", *FIGURES, "n_frequent_words", "removed", failed.alias("base_failed"), kept.alias("kept")), frequent


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, removed = batch.column("row"), batch.column("removed")
        names = [f.name for f in row.type]
        columns = dict(zip(names, row.flatten(), strict=True))
        mask = pc.greater(pc.fill_null(pc.list_value_length(removed), 0), 0)
        if pc.any(mask).as_py():
            drop, texts = removed.filter(mask).to_pylist(), columns["text"].filter(mask)
            left: list[str] = []
            for a, part in tk.texts_of(texts, lower=True).slices():
                hashed, size, owner, _ = normal_lines(part)
                at = np.searchsorted(owner, np.arange(len(part) + 1))
                for i, text in enumerate(texts.slice(a, len(part)).to_pylist()):
                    mine = slice(at[i], at[i + 1])
                    gone = np.isin(hashed[mine].view(np.int64), np.array(drop[a + i], np.int64)) & (size[mine] > 0)
                    left.append("\n".join(x for x, g in zip(text.split("\n"), gone, strict=True) if not g))
            columns["text"] = pc.replace_with_mask(columns["text"], mask, pa.array(left, texts.type))
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([columns[c] for c in names], names)], ["row"])


def keep_good(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """The documents that pass, without their frequent lines. The columns of docs; n_chars, if there, is counted
    anew."""
    verdicts, _ = judge(docs, host, **options)
    verdicts = cut(verdicts.select("doc_id", "text_key", "host", "removed", "kept").dropDuplicates(["doc_id", "text_key", "host"]))
    good = verdicts.filter("kept").drop("kept")
    # what is kept as it is needn't be shuffled
    alike, other = sieved(boxed(docs), verdicts.filter("not kept or removed is not null").select("text_key").distinct(), "text_key")
    rows = other.withColumn("host", F.col(f"row.`{host}`").cast("string") if host in docs.columns else F.lit(None).cast("string"))
    kept = rows.join(good, same_document(rows, good) & rows["host"].eqNullSafe(good["host"])).select("row", "removed")
    kept = kept.mapInArrow(_strip, T.StructType([T.StructField("row", docs.schema)]))
    own = {"n_chars": F.when(F.col("row.text").isNotNull(), F.length("row.text").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {}
    return alike.select("row").unionByName(kept.select("row")).select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
