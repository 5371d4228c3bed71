"""The pipeline against a brute-force version, and the registered queries against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from test_documents import SCHEMA, WORD, base_brute, leaks_brute, near_brute, prose, secrets_brute, varied

import corpus_pipeline
from strandline.llm.queries import ORACLES, QUERIES


def rows():
    out = [(i, prose(i, 55 + i % 40)) for i in range(60)]
    out += [(100 + i, varied(prose(i, 55 + i % 40), 0)) for i in range(0, 20)] + [(130, prose(5, 60)), (131, prose(6, 61))]
    out += [(200 + i, prose(500 + i, 60) + " " + prose(900 + i % 3, 20) + " " + prose(700 + i, 30)) for i in range(9)]
    out += [(300 + i, prose(600 + i, 60) + f" token = 'abcdef{i:06d}' " + prose(650 + i, 20)) for i in range(9)]
    return out + [(400, "too short"), (401, None), (402, ""), (403, "a b c " * 40), (None, prose(77, 70))]


def test_pipeline(spark, tmp_path):
    items = [(k, prose(900 + k, 20)) for k in range(3)]
    docs = rows()
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in docs], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    left = [(i, t) for i, t in docs if (b := base_brute(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    lead = {k[0] for k in near_brute(left) if k[0] == k[1]}
    left = [(i, t) for i, t in left if i in lead]
    bad = {i for i, _ in leaks_brute(left, items)}
    left = [(i, t) for i, t in left if i not in bad]

    def redacted(t):
        for span in sorted(((int(a), int(b)) for _, a, b in (x.split(":") for x in secrets_brute(t)[2].split(",") if x)), reverse=True):
            t = f"{t[: span[0]]}[SECRET]{t[span[1] :]}"
        return t

    assert got == sorted(((i, len(WORD.findall(redacted(t))) + 1) for i, t in left), key=str)
    assert {i for i, _ in got} >= {0, 1, None, 300} and not {i for i, _ in got} & {100, 130, 200, 400, 403}


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").schema == docs.schema


def test_pipeline_equals_its_sql(spark, tmp_path):
    """On the test tables, and on rows with copies, benchmark passages, secrets, lines that a host repeats, nulls."""
    bar = "Accept all cookies to go on reading"
    odd = [(i, t if i is None or i % 2 or not t else f"{bar}\n{t}\n{bar}", "en", f"s{(i or 0) % 3}", 1) for i, t in rows() if i is not None]
    odd += [(1000 + i, f"user: name{i} {prose(3000 + i, 70)} password = 'abcdef{i}' https://db.example.org/x {'é😀 ' * 5} {i:024x}", "en", None, 1) for i in range(5)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, prose(900 + k, 20)) for k in range(3)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for sf, star in (("/root/testdata/sf0.001", ""), (str(tmp_path), "/*.parquet")):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{star}'")
        df = corpus_pipeline.run(spark, sf)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({corpus_pipeline.ORACLE_SQL})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 40


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    df = QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
