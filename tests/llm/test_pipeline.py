import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corvane.llm.common import read_table, settle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables aren't here")


def test_stages_keep_their_contract(spark):
    docs = read_table(spark, FOLDER, "documents")
    kept = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, settle(stage(spark, docs, FOLDER), "test-stage")
        if i < 4:
            assert docs.columns == before.columns
            kept.append(docs.count())
    assert kept[0] > kept[1] and kept[1] == kept[2] and kept[2] > kept[3] > 0
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_odd_rows_and_empty_tables_go_through_every_stage(spark, docs_of, tmp_path):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "en", "src1", 1), (1, good, "en", "src1", 1), (2, good + " more", "en", "src1", None), (3, None, None, None, None), (4, "", "en", "src20", 0), (None, " ".join(f"n{i}" for i in range(40)), "de", None, 5)]
    rows += [(5, " ".join(f"long{i}" for i in range(150_000)), None, "src2", 0), (6, "a\nb " * 30, "fr", "other", 1), (7, " ".join(f"v{i}" for i in range(50)), "en", "src9", 3)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(rows)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = settle(stage(spark, docs, str(tmp_path)), "odd-rows")
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert i == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
        if i == 0:
            assert sorted(kept, key=repr) == [1, 1, 2, 5, 7, None]
        if i == 1:
            assert len(kept) == 6 and {r.doc_id: r.text for r in docs.collect()}[2] == "more"
        if i == 2:
            assert sorted(kept, key=repr) == [1, 1, 2, 5, 7, None]
    assert set(kept) <= {1, 2, 5, 7, None}
    empty = docs_of([])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = settle(stage(spark, empty, str(tmp_path)), "empty-rows")
        assert empty.count() == 0


def test_every_numbered_query_is_there_and_runs_twice_alike(spark):
    names = sorted(n for n in entry.queries() if n.startswith("op"))
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in entry.queries()
    for name in ("op2_pack_ffd", "op8_mix_budgets", "op4_ordinal_quality"):
        first, second = (sorted(map(str, entry.queries()[name](spark, FOLDER).collect())) for _ in range(2))
        assert first == second


@pytest.mark.parametrize("name", ["op5_warc", "op7_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
