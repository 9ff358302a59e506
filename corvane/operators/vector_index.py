"""An index of vectors by cells.

Cells are the clusters of a bounded sample, by direction; every vector is assigned to the cell whose centre is nearest and
written to that cell's folder. A search looks at the cells nearest to each query, reads their folders only, and ranks
what they hold exactly. Many queries run at once, as an equi-join on cells. With all cells the result is exact.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import dot, norm
from corvane.operators.joins import small_side
from corvane.session import ship

#: Rows that the cells are learned from, on average, and cells at most: what every task holds is bounded by the latter.
SAMPLE_ROWS, MAX_CELLS = 200_000, 4096
#: The cell of vectors that have no direction: null ones, of another dimension, or zero. Every search reads it.
ODD = -1
_GRAIN = 1 << 20
#: Rows and queries of a block, on average, and queries that a block's rows are multiplied with at once.
BLOCK_ROWS, BLOCK_QUERIES, _PRODUCT_ROWS = 16_384, 1_024, 64


@dataclass(frozen=True)
class VectorIndex:
    path: str
    id_col: str
    vector_col: str
    #: Unit vectors, one row for each cell.
    centers: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centers)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All indexed rows with their cell."""
        return spark.read.parquet(f"{self.path}/vectors")


def _directions(batch: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a direction, their vectors)."""
    fit = np.array([v is not None and len(v) == width and bool(np.any(v)) and bool(np.all(np.isfinite(v))) for v in batch], bool)
    return fit, np.stack(batch[fit].to_numpy()).astype(np.float64) if fit.any() else np.empty((0, width))


def nearest_cells(vector: Column, centers: np.ndarray, n: int) -> Column:
    """The n cells nearest by direction, nearest first, ties by number; ODD alone for a vector without a direction."""

    def rank(batch: pd.Series) -> pd.Series:
        fit, vectors = _directions(batch, centers.shape[1])
        order = iter(np.argsort(-(vectors @ centers.T), axis=1, kind="stable")[:, :n])
        return pd.Series([next(order).tolist() if x else [ODD] for x in fit], dtype=object)

    return F.pandas_udf(rank, "array<int>")(vector)


def _write(index: VectorIndex, vectors: DataFrame, mode: str) -> None:
    cell = F.get(nearest_cells(F.col(index.vector_col), index.centers, 1), F.lit(0))
    placed = vectors.withColumn("cell", cell).hint("rebalance", "cell")  # a cell with a large share of all rows becomes several files
    placed.write.mode(mode).partitionBy("cell").parquet(f"{index.path}/vectors")


def build_index(vectors: DataFrame, path: str, id_col: str, vector_col: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> VectorIndex:
    """Index every row of a table under a path, all its columns kept. Cells are the square root of the number of rows if
    not given, MAX_CELLS at most. They are learned from about `sample_rows` rows, chosen by a hash of the id; rows without
    a direction (null, zero, not finite, or of another dimension than most) are indexed apart. A table without directions has no cells."""
    spark = ship(vectors.sparkSession)
    usable = vectors.select(id_col, vector_col).where((norm(F.col(vector_col)) > 0) & (norm(F.col(vector_col)) < F.lit(math.inf)))
    sizes = usable.groupBy(F.size(vector_col).alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width, n = sizes or (0, 0)
    usable = usable.where(F.size(vector_col) == width)
    share = min(_GRAIN, math.ceil(_GRAIN * sample_rows / max(n, 1)))
    sample = usable.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_GRAIN)) < share).select(array_to_vector(vector_col).alias("features"))
    wanted = max(1, min(MAX_CELLS, round(math.sqrt(n)) if cells is None else cells))
    centers = np.empty((0, 0))
    if n:
        model = KMeans(k=wanted, maxIter=15, seed=seed, distanceMeasure="cosine").fit(sample)
        centers = np.stack(model.clusterCenters())
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    index = VectorIndex(path, id_col, vector_col, centers)
    table = pd.DataFrame({"cell": range(len(centers)), "center": [c.tolist() for c in centers], "id_col": id_col, "vector_col": vector_col})
    spark.createDataFrame(table, "cell int, center array<double>, id_col string, vector_col string").coalesce(1).write.parquet(f"{path}/centers")
    _write(index, vectors, "errorifexists")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before."""
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()  # MAX_CELLS rows at most
    if not rows:
        raise ValueError(f"{path} holds no cells")
    return VectorIndex(path, rows[0].id_col, rows[0].vector_col, np.array([r.center for r in rows]))


def add_vectors(index: VectorIndex, vectors: DataFrame) -> None:
    """Add rows to the cells that are there. Cells aren't learned again: build a new index when the vectors' directions change."""
    _write(index, vectors, "append")


def _best_of_blocks(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(_q, _id, score): of rows (_id, _w, cell) and queries (_q, _v, cell), the k best for each query in each block of its cell's rows.

    Cells are dealt into blocks of some BLOCK_ROWS rows and BLOCK_QUERIES queries, which meet by a shuffle. A product of matrices finds
    what may be among the k best, up to its rounding; the scores of these are summed in the order of `dot`."""
    blocks = lambda df, size, into: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(into))
    counts = F.broadcast(blocks(rows, BLOCK_ROWS, "_nr").join(blocks(asked, BLOCK_QUERIES, "_nq"), "cell"))  # MAX_CELLS rows at most
    number = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(counts, "cell").select("cell", number("_id", "_nr").alias("_rb"), every("_nq").alias("_qb"), "_id", "_w")
    right = asked.join(counts, "cell").select("cell", every("_nr").alias("_rb"), number("_q", "_nq").alias("_qb"), "_q", "_v")

    def best(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(queries):
            held = held.sort_values("_id", na_position="first")
            w, v = np.stack(held["_w"].to_numpy()).astype(np.float64), np.stack(queries["_v"].to_numpy()).astype(np.float64)
            far = 1e-10 * np.linalg.norm(w, axis=1).max()  # more than what the order of a sum may change
            ids, asked_ids = held["_id"].to_numpy(), queries["_q"].to_numpy()
            for at in range(0, len(v), _PRODUCT_ROWS):
                some = v[at : at + _PRODUCT_ROWS]
                near = some @ w.T
                least = np.partition(near, -k, axis=1)[:, -k] if len(w) > k else near.min(axis=1)
                kept = near >= (least - far * np.linalg.norm(some, axis=1))[:, None]
                for i, mask in enumerate(kept):
                    found = np.flatnonzero(mask)
                    score = np.cumsum(some[i] * w[found], axis=1)[:, -1] + 0.0
                    first = np.argsort(-score, kind="stable")[:k]  # rows are in the order of their ids
                    out.append(pd.DataFrame({"_q": asked_ids[at + i], "_id": ids[found[first]], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "_id": [], "score": []}).astype({"score": float})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    keys = ["cell", "_rb", "_qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"_q {kind(asked, '_q')}, _id {kind(rows, '_id')}, score double")


def search(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, the index's id, score, place): for each query the k rows with the largest dot products among the `probes`
    cells nearest to it (None: all cells, exactly), ties by id; place counts from 1. Queries and rows without a score are left
    out.

    Folders of other cells aren't read: the cells that any query needs, MAX_CELLS at most, are named in the scan. Queries
    and rows of a cell meet in blocks (`_best_of_blocks`), and each block keeps k rows for each query before they meet.
    """
    spark = queries.sparkSession
    n = index.cells if probes is None else max(1, min(probes, index.cells))
    near = F.array(F.lit(ODD)) if n == index.cells else F.array_union(nearest_cells(F.col("_v"), index.centers, n), F.array(F.lit(ODD)))
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v")).withColumn("cell", F.explode(near))
    held = index.rows(spark)
    if n < index.cells:
        held = held.where(F.col("cell").isin([r.cell for r in asked.select("cell").distinct().collect()]))
    rows = held.select(F.col(index.id_col).alias("_id"), F.col(index.vector_col).alias("_w"), "cell")
    odd = rows.where(F.col("cell") == ODD).join(small_side(asked.where(F.col("cell") == ODD)), "cell")
    scored = odd.select("_q", "_id", dot(F.col("_v"), F.col("_w")).alias("score"))
    if n == index.cells:  # all cells: which one a row is in says nothing
        asked = asked.where(F.get(nearest_cells(F.col("_v"), index.centers, 1), F.lit(0)) != ODD).withColumn("cell", F.lit(0))
        rows = rows.where(F.col("cell") != ODD).withColumn("cell", F.lit(0))
    scored = scored.unionByName(_best_of_blocks(rows.where(F.col("cell") != ODD), asked.where(F.col("cell") != ODD), k)).where("score IS NOT NULL AND NOT isnan(score)")
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_id"))).where(F.col("place") <= k)
    same = query_id.lower() == index.id_col.lower()
    return best.select(F.col("_q").alias(query_id), F.col("_id").alias(f"found_{index.id_col}" if same else index.id_col), "score", "place")


def recall_curve(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """(probes, recall): what share of the queries' exact k best rows lies in their nearest cells, for every number of cells.
    The exact search runs once: a row is found as soon as its own cell is looked at."""
    ranked = queries.select(F.col(query_id).alias("_q"), F.posexplode(nearest_cells(F.col(query_vector), index.centers, index.cells)).alias("at", "cell"))
    exact = search(index, queries, query_id, query_vector, k)
    found = exact.columns[1]
    rows = index.rows(queries.sparkSession).select(F.col(index.id_col).alias("_id"), "cell")
    placed = exact.select(F.col(query_id).alias("_q"), F.col(found).alias("_id")).join(rows, "_id").join(ranked, ["_q", "cell"], "left")
    counts = placed.groupBy((F.coalesce("at", F.lit(0)) + 1).alias("probes")).agg(F.count(F.lit(1)).alias("n"))  # MAX_CELLS rows at most
    every = queries.sparkSession.range(1, index.cells + 1).select(F.col("id").cast("int").alias("probes")).join(counts, "probes", "left")
    upto, whole = Window.orderBy("probes"), Window.partitionBy()
    return every.select("probes", (F.sum(F.coalesce("n", F.lit(0))).over(upto) / F.sum("n").over(whole)).alias("recall"))


def probes_for(curve: DataFrame, recall: float = 0.9) -> int:
    """The fewest cells that reach a recall."""
    row = curve.where(F.col("recall") >= recall).agg(F.min("probes").alias("n")).first()
    if row.n is None:
        raise ValueError(f"no number of cells reaches a recall of {recall}")
    return row.n
