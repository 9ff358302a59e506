import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators.vector_index import ODD, add_vectors, build_index, nearest_cells, open_index, probes_for, recall_curve, search

SCHEMA = "vec_id long, embedding array<float>, note string"


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 24 directions, one of them with a third of all rows; odd ones last."""
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(24, 16))
    of = np.r_[np.zeros(300, int), rng.integers(0, 24, 600)]
    vectors = heads[of] + rng.normal(scale=0.3, size=(900, 16))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))]
    odd = [(900, None, "null"), (901, [0.0] * 16, "zero"), (902, [1.0, 2.0], "short"), (903, [float("nan")] * 16, "nan"), (5, rows[5][1], "again")]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(clustered, tmp_path_factory):
    return build_index(clustered, str(tmp_path_factory.mktemp("index") / "v"), "vec_id", "embedding", cells=24)


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = []
        for i, w, _ in rows:
            if w is not None and len(w) == len(v):
                s = float(np.dot(np.array(v, np.float64), np.array(w, np.float64)))
                scored.append((-s if s == s else -np.inf, i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "place").collect():
        out.setdefault(r.vec_id, []).append(r.found_vec_id)
    return out


def test_every_row_is_indexed(clustered, index, spark):
    rows = index.rows(spark)
    assert rows.count() == clustered.count() and set(rows.columns) == {"vec_id", "embedding", "note", "cell"}
    assert sorted(r.vec_id for r in rows.where(F.col("cell") == ODD).collect()) == [900, 901, 902, 903]


def test_all_cells_are_exact(clustered, index):
    queries = clustered.where("vec_id % 20 = 0 AND vec_id < 900")
    rows = [tuple(r) for r in clustered.collect()]
    rows = [r for r in rows if r[0] != 903]
    got = found(search(index, queries, "vec_id", "embedding", 10))
    assert got == brute(rows, [r[:2] for r in rows if r[0] % 20 == 0 and r[0] < 900], 10) and len(got) == 45


def test_few_cells_find_most_and_read_few_files(clustered, index, spark):
    queries = clustered.where("vec_id % 20 = 0 AND vec_id < 900")
    curve = recall_curve(index, queries, "vec_id", "embedding", 10)
    shares = [r.recall for r in curve.orderBy("probes").collect()]
    assert shares == sorted(shares) and shares[-1] == pytest.approx(1) and len(shares) == 24
    few = probes_for(curve, 0.9)
    assert few <= 6
    exact, some = (found(search(index, queries, "vec_id", "embedding", 10, p)) for p in (None, few))
    recall = sum(len(set(exact[q]) & set(some[q])) for q in exact) / sum(map(len, exact.values()))
    assert recall == pytest.approx(shares[few - 1]) and recall >= 0.9


def test_only_the_nearest_cells_are_read(clustered, index, spark, tmp_path):
    query = clustered.where("vec_id = 40")
    want = found(search(index, query, "vec_id", "embedding", 10, 2))
    near = query.select(nearest_cells(F.col("embedding"), index.centers, 2)).first()[0]
    part = shutil.copytree(index.path, tmp_path / "part")
    gone = [d for d in (part / "vectors").glob("cell=*") if int(d.name[5:]) not in (*near, ODD)]
    assert len(gone) == 22
    for d in gone:  # a reader of these files stumbles
        for file in d.glob("*.parquet"):
            file.write_bytes(b"no table")
        for file in d.glob(".*.crc"):
            file.unlink()
    assert found(search(replace(index, path=str(part)), query, "vec_id", "embedding", 10, 2)) == want
    with pytest.raises(Exception, match="(?i)parquet"):
        search(replace(index, path=str(part)), query, "vec_id", "embedding", 10).collect()


def test_added_rows_are_found_and_an_index_opens_again(clustered, spark, tmp_path):
    index = build_index(clustered, f"{tmp_path}/v", "vec_id", "embedding")
    assert index.cells == 30
    again = open_index(spark, f"{tmp_path}/v")
    assert np.allclose(again.centers, index.centers) and (again.id_col, again.vector_col) == ("vec_id", "embedding")
    query = clustered.where("vec_id = 7")
    add_vectors(again, query.select(F.lit(5000).cast("long").alias("vec_id"), F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"), F.lit("new").alias("note")))
    best = search(again, query, "vec_id", "embedding", 1, probes=1).first()
    assert best.found_vec_id == 5000 and best.place == 1


def test_queries_without_a_direction_and_empty_tables(clustered, index, spark, tmp_path):
    none = search(index, clustered.where("vec_id = 900"), "vec_id", "embedding", 3, 2)
    assert none.count() == 0 and search(index, clustered.limit(0), "vec_id", "embedding", 3, 2).count() == 0
    empty = build_index(clustered.limit(0), f"{tmp_path}/e", "vec_id", "embedding")
    assert empty.cells == 0


def test_blocks_rank_copies_by_id_and_multiply_matrices(spark, tmp_path, monkeypatch):
    """Many small blocks, with copies whose scores tie: the rows of brute force, without a pass over all pairs in the plan."""
    from corvane.operators import vector_index as v

    monkeypatch.setattr(v, "BLOCK_ROWS", 40)
    monkeypatch.setattr(v, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    held = [(i, base[i % 60].tolist()) for i in range(240)] + [(500, [0.0] * 8), (501, None), (502, [1.0])]
    rows = spark.createDataFrame(held, "id long, v array<float>")
    asked = spark.createDataFrame([(i, held[i][1]) for i in range(20)], "q long, v array<float>")
    index = v.build_index(rows, str(tmp_path / "i"), "id", "v", cells=5)
    found = v.search(index, asked, "q", "v", 6)
    got = {(r.q, r.place): (r.id, r.score) for r in found.collect()}
    for q in range(20):
        scores = [(-sum(float(a) * float(b) for a, b in zip(held[q][1], w)), i) for i, w in held if w and len(w) == 8]
        for place, (score, i) in enumerate(sorted(scores)[:6], 1):
            assert got[q, place] == (i, pytest.approx(-score, abs=1e-12))
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().analyzed().toString()
    few = {(r.q, r.place): r.id for r in v.search(index, asked, "q", "v", 6, 4).collect()}
    cells = {r.id: r.cell for r in index.rows(spark).collect()}
    near = {r.q: {*r.n, ODD} for r in asked.select("q", nearest_cells(F.col("v"), index.centers, 4).alias("n")).collect()}
    for q in range(20):
        scores = [(-sum(float(a) * float(b) for a, b in zip(held[q][1], w)), i) for i, w in held if w and len(w) == 8 and cells[i] in near[q]]
        assert [few[q, place] for place in range(1, 7)] == [i for _, i in sorted(scores)[:6]]
