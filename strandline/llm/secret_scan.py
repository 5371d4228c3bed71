"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings are what stands alone: assignments to a secret's name, access key identifiers, long runs of hex digits.
Weak candidates (account names, random-looking strings, endpoints) are reported only where a complementary part lies in
the same scope, at most SCOPE code points away: an account name or an endpoint needs a secret, a random-looking string
needs an account name, an access key identifier or an endpoint. Parts and weak candidates meet in an interval join: both sides are
dealt to the scopes that they touch, joined on document and scope, and compared by their bounds. It is a semi join, so it
makes no row for a pair, and a scope holds no more parts than fit in its characters.

A text is read by a kind's pattern only where it holds one of the kind's marks (plain strings in lower case) or, for runs, a
run long enough. Positions are running sums over arrays, taken in blocks of BLOCK, and a redacted text is joined from pieces
of CHUNK code points at most, so a text's cost grows with its length and not with the square of its findings.

Positions count code points, the end is exclusive. A null text is taken as empty and has no finding. Documents are told
apart by doc_id (null included) and text; equal rows get equal results. Other columns pass by.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut, same_document, sieved

#: Name, pattern, group whose length counts, fewest characters of it. In the order in which kinds are listed.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("account", r"(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@+-]{3,})", 0, 6),
    ("random", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
    ("endpoint", r"(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}", 0, 8),
)
#: What a random-looking string must contain.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
#: One of these strings is in the lower-case text wherever the kind's pattern matches.
MARKS = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "account": ("user", "login", "account", "client", "access"),
    "endpoint": ("://",),
}
_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"
#: hex runs may begin inside a longer word
_HEX_RUN = r"[0-9a-f]{24}"
BLOCK, CHUNK = 256, 1024
KINDS = [k for k, *_ in (*BASE, *WEAK)]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "random": "secret", "endpoint": "endpoint"}
NEEDS = {"account": ["secret"], "random": ["identifier", "endpoint"], "endpoint": ["secret"]}
SCOPE = 300

_SPAN = "array<struct<s:int,k:int,e:int>>"


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each element of a column of int arrays and all before it. A fold that appends copies what it has; here it
    appends to BLOCK elements at most, and once to the blocks' own values. x should be a plain column, as it's read often."""

    def fold(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, y: F.struct(op(acc["at"], y).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], y))).alias("out"))
        return F.aggregate(part, first, step, lambda acc: acc["out"])

    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / BLOCK).cast("int") - 1, F.lit(0)))
    totals = F.transform(numbers, lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), op))
    before = F.concat(F.array(F.lit(0)), fold(totals, F.lit(0)))
    many = F.flatten(F.zip_with(numbers, F.slice(before, F.lit(1), F.size(numbers)), lambda b, at: fold(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), at)))
    return F.when(F.size(x) <= BLOCK, fold(x, F.lit(0))).otherwise(many)


def add(a: Column, b: Column) -> Column:
    return a + b


def lengths(text: Column, lower: Column, kind: str, pattern: str, group: int) -> Column:
    """Of each match of a pattern, leftmost and without overlap: the code points before it since the last one, its own,
    and those that must be enough, as (g, l, c). Null where the text has no match."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    if group:
        counts = F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length)
    elif kind == "random":
        counts = F.transform(whole, lambda m: F.when(m.rlike(MIXED[0]) & m.rlike(MIXED[1]) & m.rlike(MIXED[2]), F.length(m)).otherwise(0))
    else:
        counts = F.transform(whole, F.length)
    own = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("l"))), counts, lambda x, c: F.struct(x["g"].alias("g"), x["l"].alias("l"), c.alias("c")))
    maybe = text.rlike(_HEX_RUN if kind == "hex" else _RUN) if kind in ("hex", "random") else reduce(Column.__or__, [F.contains(lower, F.lit(m)) for m in MARKS[kind]])
    return F.when(maybe, own)


def placed(found: Column, ends: Column, kind: str, least: int) -> Column:
    """From lengths() and their running sums: the matches as (s, k, e); those with too few code points that count are left
    out."""
    kept = F.filter(F.arrays_zip(found.alias("f"), ends.alias("e")), lambda x: x["f"]["c"] >= least)
    spans = F.transform(kept, lambda x: F.struct((x["e"] - x["f"]["l"]).alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def joined(found: Column) -> Column:
    """kind:start:end of each span, in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def _touched(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE)))


def link(read: DataFrame) -> DataFrame:
    """The weak candidates with a complementary part in scope: doc_id, text_key, linked (a sorted array of spans)."""
    key = ["doc_id", "text_key"]
    some = read.filter(F.size("weak") > 0).select(*key, "base", "weak").distinct()
    role = F.create_map(*[F.lit(x) for k in KINDS for x in (KINDS.index(k), ROLE[k])])
    parts = some.select(*key, F.explode(F.concat("base", "weak")).alias("x")).select(*key, "x.*").withColumn("role", role[F.col("k")])
    parts = parts.withColumn("scope", _touched(F.col("s"), F.col("e"))).alias("p")
    weak = some.select(*key, F.explode("weak").alias("x")).select(*key, "x.*").withColumn("scope", _touched(F.col("s") - SCOPE, F.col("e") + SCOPE)).alias("w")
    fits = F.lit(False)
    for kind, roles in NEEDS.items():
        fits = fits | ((F.col("w.k") == KINDS.index(kind)) & F.col("p.role").isin(roles))
    near = (F.col("p.s") <= F.col("w.e") + SCOPE) & (F.col("w.s") <= F.col("p.e") + SCOPE)
    apart = (F.col("p.s") >= F.col("w.e")) | (F.col("w.s") >= F.col("p.e"))
    on = F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.text_key") == F.col("p.text_key")) & (F.col("w.scope") == F.col("p.scope")) & fits & near & apart
    found = weak.join(parts, on, "left_semi").select(*[F.col(f"w.{c}") for c in (*key, "s", "k", "e")]).distinct()
    return found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("linked"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_assign, n_access, n_hex, base (the base spans, sorted), found (all
    spans, sorted): a row for each row of docs."""
    kinds = {k: rest for k, *rest in (*BASE, *WEAK)}
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    read = read.withColumn("_lower", F.lower("_text"))
    read = read.select("doc_id", "text_key", *[lengths(F.col("_text"), F.col("_lower"), k, p, g).alias(f"_{k}") for k, (p, g, _) in kinds.items()])
    read = read.withColumns({f"_{k}_len": F.transform(f"_{k}", lambda x: x["g"] + x["l"]) for k in kinds})
    read = read.withColumns({f"_{k}_end": running(F.col(f"_{k}_len"), add) for k in kinds})
    read = read.select("doc_id", "text_key", *[placed(F.col(f"_{k}"), F.col(f"_{k}_end"), k, least).alias(f"_{k}") for k, (_, _, least) in kinds.items()])
    read = read.select("doc_id", "text_key", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE], F.array_sort(F.concat(*[f"_{k}" for k, *_ in BASE])).alias("base"), F.array_sort(F.concat(*[f"_{k}" for k, *_ in WEAK])).alias("weak"))
    read = cut(read)
    l, r = read.alias("l"), link(read).alias("r")
    both = l.join(r, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key")), "left")
    every = F.array_sort(F.concat(F.col("l.base"), F.coalesce(F.col("r.linked"), F.array().cast(_SPAN))))
    return both.select("l.doc_id", "l.text_key", *[f"l.n_{k}" for k, *_ in BASE], "l.base", every.alias("found"))


def redacted(rows: DataFrame, text: Column, found: Column, mark: str = "[SECRET]") -> DataFrame:
    """rows and new: text with every span of a sorted array replaced by mark; spans that overlap get one."""
    rows = rows.withColumn("_chunks", F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    rows = rows.withColumn("_ends", F.transform(found, lambda x: x["e"]))
    rows = rows.withColumn("_until", running(F.col("_ends"), lambda a, b: F.greatest(a, b)))
    past = F.slice(F.concat(F.array(F.lit(0)), F.col("_until")), F.lit(1), F.size(found))
    gaps = F.zip_with(found, past, lambda x, p: F.struct(p.alias("a"), x["s"].alias("b")))
    rows = rows.withColumn("_gaps", F.concat(F.filter(gaps, lambda g: g["b"] >= g["a"]), F.array(F.struct(F.element_at("_until", -1).alias("a"), F.length(text).alias("b")))))

    def piece(g: Column) -> Column:
        first, last = F.floor(g["a"] / CHUNK).cast("int"), F.floor((g["b"] - 1) / CHUNK).cast("int")
        held = F.array_join(F.slice(F.col("_chunks"), first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(g["b"] > g["a"], F.substr(held, (g["a"] - first * CHUNK + 1).cast("int"), (g["b"] - g["a"]).cast("int"))).otherwise(F.lit(""))

    return rows.withColumn("new", F.array_join(F.transform("_gaps", piece), mark)).drop("_chunks", "_ends", "_until", "_gaps")


def redact(docs: DataFrame) -> DataFrame:
    """Every document, with its findings replaced. The columns of docs; n_chars, if there, follows the text."""
    found = cut(scan(docs).filter(F.size("found") > 0).select("doc_id", "text_key", "found").dropDuplicates(["doc_id", "text_key"]))
    none, rows = sieved(boxed(docs), found.select("text_key").distinct(), "text_key")
    both = rows.join(found, same_document(rows, found), "left").select("row", "found")
    some = redacted(both.filter(F.col("found").isNotNull()), F.col("row.text"), F.col("found"))
    both = some.unionByName(both.filter(F.col("found").isNull()).unionByName(none.select("row"), allowMissingColumns=True).withColumn("new", F.col("row.text")))
    own = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("found").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return both.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
