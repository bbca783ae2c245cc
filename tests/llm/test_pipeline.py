"""The pipeline's stages against brute-force versions, and the queries against their SQL."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tarnwick.llm.oracles import ORACLES
from tarnwick.llm.queries import QUERIES
from tests.llm.test_edges import LONG, brute_components, brute_repeats, key, prose

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    base = prose(100, 1)
    rows = [(i, prose(60, 10 + i) + (" vile rotten" if i % 4 == 0 else "")) for i in range(120)]
    rows += [(200, base), (201, base + " end"), (202, base), (202, base), (203, None), (204, ""), (None, prose(30, 5)), (205, prose(40, 6) + " " + base[:300]), (206, LONG)]
    spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], COLUMNS).withColumn("token", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(C.STAGES)
    step = lambda name, df: stages[name](spark, df, sf).persist()
    clean = step("toxicity", docs)
    assert clean.columns == list(C.COLUMNS) and {r.doc_id for r in clean.collect() if r.doc_id is not None and r.doc_id < 120} == {i for i in range(120) if i % 4}
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    one = step("ngram_jaccard", clean)
    want = {c for _, _, c in brute_components(rows, 5, 80, 100)}
    assert key(r.doc_id for r in one.collect()) == key(want) and one.columns == list(C.COLUMNS)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    cut = step("suffix_dedup", one)
    left = zip(rows, brute_repeats([(t or "").encode() for _, t in rows], C.PASSAGE), strict=True)
    # of 200 nothing is left, as 206 starts with it
    want = [(i, b) for (i, t), b in left if b.strip() or b == (t or "").encode()]
    assert 200 not in {i for i, _ in want} and key((r.doc_id, (r.text or "").encode()) for r in cut.collect()) == key(want)
    mixed = step("mixing", cut)
    assert mixed.columns == list(C.COLUMNS) and mixed.select("doc_id").distinct().count() <= cut.count()
    ids = step("byte_bpe", mixed)
    assert ids.count() == mixed.count() and ids.where("n_tokens <> size(ids)").count() == 0
    assert C.run(spark, sf).select("doc_id", "n_tokens").exceptAll(ids.select("doc_id", "n_tokens")).count() == 0


def test_stages_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, f in C.STAGES:
        assert f(spark, docs, sf).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name in ORACLES:
        c = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = c.execute(ORACLES[name]).df()
        rows = lambda df: sorted((tuple(None if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
