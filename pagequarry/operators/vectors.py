"""A stored vector table, searched exactly while most of it is skipped.

**Table.** Vectors are written once, at ingest, under ``path/rows``, partitioned by segment (one for each time of writing) and by cell, the nearest
of the coarse centres that were fitted to a bounded sample when the table was made. ``path/cells`` keeps, for each segment and cell, the
radius (the farthest of its vectors from the centre), the largest norm and the number of its vectors. A segment that is written again replaces itself,
so that a repeated micro-batch leaves the same table.

**Search.** For a query q no vector x of a cell with centre c and radius r has a product q.x above q.c + |q| r, nor above |q| times the
largest norm. A first pass over each query's most promising cells gives a score that k vectors reach; the second reads only the cells whose
bound reaches it. Cells that no query needs are partitions that aren't read. Results are those of ``retrieval.dense_top_k``, whatever the
centres are: these decide how much is skipped, and nothing else. Where vectors lie evenly in all directions nothing can be skipped.

Vectors with a null or non-finite component and rows without an id are left out; a query meets vectors of its own length only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators import retrieval as r

#: Vectors that the centres are fitted to, and the most of these; both bound work, not results.
SAMPLE, MOST_CELLS = 20_000, 1024
#: Vectors of a cell, on average, that the number of centres aims at.
CELL_ROWS = 2_000
#: What rounding may add to a product, as a share of the norms.
_SLACK = 1e-9
_CELLS = "cell int, dim int, radius double, norm double, n long, segment int"


def usable(x: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))


@dataclass(frozen=True)
class VectorTable:
    spark: SparkSession
    path: str

    @property
    def rows(self) -> DataFrame:
        """segment, cell, doc_id, vector"""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/kind").schema).parquet(f"{self.path}/rows")

    @property
    def centres(self) -> np.ndarray:
        """(cells, dimension)"""
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([c.centre for c in found], np.float64) if found else np.zeros((0, 0))

    @property
    def cells(self) -> DataFrame:
        """cell, dim, radius, norm, n: over all segments. A cell below zero holds vectors of another length than the centres'."""
        held = self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells")
        return held.groupBy("cell", "dim").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.sum("n").alias("n"))

    def append(self, vectors: DataFrame, segment: int) -> None:
        """Write ``vectors`` (doc_id, vector) as a segment, in place of what it held."""
        centres = self.centres
        kind = dict(vectors.dtypes)
        schema = f"cell int, doc_id {kind['doc_id']}, vector {kind['vector']}, dim int, apart double, norm double"
        placed = vectors.where(F.col("doc_id").isNotNull() & usable(F.col("vector"))).select("doc_id", "vector").mapInArrow(_placer(centres), schema)
        rows = placed.select("doc_id", "vector", F.lit(segment).alias("segment"), "cell").hint("rebalance", "cell")
        _replace(rows, f"{self.path}/rows", "segment", "cell")
        stats = placed.groupBy("cell", "dim").agg(F.max("apart").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("n"))
        _replace(stats.withColumn("segment", F.lit(segment)), f"{self.path}/cells", "segment")

    def top_k(self, queries: DataFrame, k: int = 15) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, vector)."""

        def one(some: DataFrame) -> tuple[DataFrame, list]:
            search = _Search(self, some, k)
            return search.result(), search.sent

        schema = _result_type(queries, self.rows)
        return r.top_k(r.in_passes(_asked(queries), one, schema), k)

    def skipped(self, queries: DataFrame, k: int = 15) -> DataFrame:
        """(query_id, n_vectors, n_scored): how many vectors of a query's length there are, and how many its second pass compares."""
        search = _Search(self, _asked(queries).drop("bytes"), k)
        rows = [(q, int(n), int(m)) for q, n, m in zip(search.ids.to_pylist(), search.held, (search.needed * search.sizes).sum(1), strict=True)]
        for s in search.sent:
            s.destroy()
        return self.spark.createDataFrame(rows, T.StructType([queries.schema["query_id"], T.StructField("n_vectors", T.LongType()), T.StructField("n_scored", T.LongType())]))


def _asked(queries: DataFrame) -> DataFrame:
    return r.vector_queries(queries.where(usable(F.col("vector"))))


def _replace(rows: DataFrame, path: str, *keys: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _result_type(queries: DataFrame, rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])


def _placer(centres: np.ndarray):
    """(doc_id, vector) with cell, dim, distance from the centre, and norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centres * centres).sum(1)
        for batch in batches:
            column = batch.column(1)
            dim = np.diff(column.offsets.to_numpy())
            cell, apart, norm = -dim.astype(np.int32), np.full(len(batch), np.inf), np.empty(len(batch))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                norm[at] = np.sqrt((x * x).sum(1))
                if len(centres) and d == centres.shape[1]:
                    near = np.argmin(square - 2 * x @ centres.T, axis=1)
                    cell[at], apart[at] = near, np.sqrt(np.square(x - centres[near]).sum(1))
            made = [pa.array(cell), *batch.columns, pa.array(dim.astype(np.int32)), pa.array(apart), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(made, names=["cell", "doc_id", "vector", "dim", "apart", "norm"])

    return run


def _fit(vectors: DataFrame, cells: int | None) -> np.ndarray:
    """Centres of the most frequent length's vectors, from a sample that is taken by a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col("doc_id").isNotNull() & usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not most:
        return np.zeros((0, 0))
    wanted = max(2, cells or min(MOST_CELLS, most[0]["count"] // CELL_ROWS))
    sample = rows.where(F.size("vector") == most[0].dim).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    features = sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=wanted, maxIter=10, seed=1, initSteps=1).fit(features).clusterCenters()).reshape(-1, most[0].dim)


def write_vectors(vectors: DataFrame, path: str, cells: int | None = None) -> VectorTable:
    """Make a table of ``vectors`` (doc_id, vector), in place of what stood there; ``cells`` sets the number of centres."""
    spark = vectors.sparkSession
    centres = _fit(vectors, cells)
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    kind = dict(vectors.dtypes)
    rows = f"doc_id {kind['doc_id']}, vector {kind['vector']}, segment int, cell int"
    spark.createDataFrame([], rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")
    for name, schema, keys in (("rows", rows, ["segment", "cell"]), ("cells", _CELLS, ["segment"])):
        spark.createDataFrame([], schema).write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/{name}")
    table = VectorTable(spark, path)
    table.append(vectors, 0)
    return table


class _Search:
    """One pass of queries, which fit on the driver: what each may find in each cell, and the cells that each needs."""

    def __init__(self, table: VectorTable, queries: DataFrame, k: int):
        self.table, self.k, self.sent = table, k, []
        asked = queries.toArrow().combine_chunks()
        self.ids = asked.column(0).combine_chunks() if len(asked) else pa.nulls(0)
        lists = asked.column(1).to_pylist() if len(asked) else []
        self.schema = _result_type(queries, table.rows)
        self.dims = np.array([len(v) for v in lists], int)
        self.vectors = [np.array(v, np.float64) for v in lists]
        cells = table.cells.orderBy("cell").collect()
        self.cell = np.array([c.cell for c in cells], int)
        self.sizes = np.array([c.n for c in cells], int)
        bound = self._bounds(cells, table.centres)
        self.held = ((bound > -np.inf) * self.sizes).sum(1)
        reached = self._reached(self._promising(bound))
        self.needed = (bound >= reached[:, None]) & (bound > -np.inf)

    def _bounds(self, cells: list, centres: np.ndarray) -> np.ndarray:
        """(queries, cells): no product in the cell is above; -inf where lengths differ."""
        out = np.full((len(self.vectors), len(cells)), -np.inf)
        for j, c in enumerate(cells):
            for_them = np.flatnonzero(self.dims == c.dim)
            if not len(for_them):
                continue
            q = np.stack([self.vectors[i] for i in for_them])
            norm = np.sqrt((q * q).sum(1))
            top = norm * c.norm
            if c.cell >= 0:
                top = np.minimum(top, q @ centres[c.cell] + norm * c.radius)
            out[for_them, j] = top + _SLACK * (1 + norm * c.norm)
        return out

    def _promising(self, bound: np.ndarray) -> np.ndarray:
        """The cells with a query's highest bounds, as many as hold k vectors."""
        order = np.argsort(-bound, axis=1, kind="stable")
        there = np.take_along_axis(bound > -np.inf, order, 1)
        held = np.cumsum(self.sizes[order] * there, axis=1) if len(self.cell) else np.zeros((len(bound), 0))
        first = there & (np.hstack([np.zeros((len(held), 1)), held[:, :-1]]) < self.k) if held.shape[1] else there
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, first, 1)
        return out

    def _reached(self, cells: np.ndarray) -> np.ndarray:
        """The score that k vectors of these cells reach, for each query; -inf where there are fewer."""
        out = np.full(len(self.vectors), -np.inf)
        if cells.any():
            best = r.top_k(self._scan(cells), self.k).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= self.k)
            at = {q: i for i, q in enumerate(self.ids.to_pylist())}
            for row in best.collect():
                out[at[row.query_id]] = row.score
        return out - _SLACK

    def _scan(self, cells: np.ndarray) -> DataFrame:
        """(query_id, doc_id, score): of each batch of a cell the best k for each query that looks into it."""
        k, names = self.k, self.schema.names
        of_cell = {int(self.cell[j]): np.flatnonzero(cells[:, j]) for j in range(cells.shape[1]) if cells[:, j].any()}
        sent = self.table.spark.sparkContext.broadcast((self.ids, self.vectors, of_cell))
        self.sent.append(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, asks = sent.value
            for batch in batches:
                of = batch.column(0).to_numpy()
                for cell in np.unique(of):
                    at = np.flatnonzero(of == cell)
                    for some in (at[i : i + r.ROW_BLOCK] for i in range(0, len(at), r.ROW_BLOCK)):
                        part = batch.take(pa.array(some))
                        own = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                        for q_ in (asks[cell][i : i + r.QUERY_BLOCK] for i in range(0, len(asks[cell]), r.QUERY_BLOCK)):
                            score = np.round(np.stack([vectors[i] for i in q_]) @ own.T, 9)
                            q, d = r.best_of(score, k)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q_[q])), part.column(1).take(pa.array(d)), pa.array(score[q, d])], names=names)

        read = self.table.rows.where(F.col("cell").isin([*of_cell])).select("cell", "doc_id", "vector")
        return read.mapInArrow(run, self.schema)

    def result(self) -> DataFrame:
        return self._scan(self.needed)
