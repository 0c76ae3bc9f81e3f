"""Centroid clustering on integer vectors, exact on every machine.

A round screens all centroids of a block of vectors by one float32 matrix product.  Each
product stands for an interval that holds the true value whatever the order of the sums;
a centroid stays on the shortlist while its interval reaches below the smallest upper end.
Where more than one is left, their distances are computed in whole numbers and the lowest
number wins a tie.  Sums of a cluster are whole numbers too, so neither partitions nor
retries change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize

#: Components beyond it are refused: 64 squared differences of them would pass 2**63.
LARGEST = 2**27
#: Vectors that are screened at once.
BLOCK = 4096
#: Half an ulp of 1 as float32 and float64.
_U32, _U64 = 2.0**-24, 2.0**-53


def error_bound(n: int, u: float) -> float:
    """The most by which a sum of ``n`` products is off, as a share of the sum of their magnitudes."""
    return n * u / (1 - n * u)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of whole numbers the nearest centre (lowest number on ties) and the exact squared distance."""
    dims = points.shape[1]
    # as float32 each factor is off by one rounding, the product's own sums by one for each term
    products = (points.astype(np.float32) @ centres.astype(np.float32).T).astype(np.float64)
    squares = np.einsum("ij,ij->i", centres.astype(np.float64), centres.astype(np.float64))
    lengths = [np.sqrt(np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64))) for m in (points, centres)]
    slack = 2 * error_bound(dims + 3, _U32) * np.outer(*lengths) * (1 + 2.0**-20)
    score = squares - 2 * products  # the distance without the vector's own square
    slack += error_bound(dims + 6, _U64) * (squares + 2 * np.abs(products) + slack)
    reach = (score + slack).min(1)
    listed = score - slack <= reach[:, None]
    chosen = listed.argmax(1)
    open_rows = np.flatnonzero(listed.sum(1) > 1)
    if len(open_rows):
        at, centre = np.nonzero(listed[open_rows])
        gaps = points[open_rows[at]] - centres[centre]
        exact = np.einsum("ij,ij->i", gaps, gaps)
        first = np.lexsort((centre, exact, at))
        heads = first[np.r_[True, np.diff(at[first]) > 0]]
        chosen[open_rows] = centre[heads]
    gaps = points - centres[chosen]
    return chosen, np.einsum("ij,ij->i", gaps, gaps)


def _points(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def whole_vectors(rows: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """The rows whose vector has ``dims`` components, all finite, with ``point``: floor(scale * x) of each.

    A component beyond ``LARGEST`` fails the job; no row is left out for its size.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    kept = rows.where((F.size(vector) == dims) & F.forall(vector, finite))
    small = F.forall(F.col(vector), lambda x: F.abs(x.cast("double") * scale) < float(LARGEST))
    return kept.withColumn("point", F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more"))))


def first_centres(points: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The ``k`` points whose SHA-256 of ``seed:key`` is smallest; equal ones follow their components, a NULL key is said ``null``."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = points.orderBy(drawn, "point").limit(k).select("point").collect()  # k rows
    return np.array([r.point for r in rows], np.int64)


def _sums(points: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: vectors, distance, and components, added up; each task adds its own before rows are shuffled."""
    k, dims = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, distance, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), object)
        for batch in batches:
            whole = _points(batch.column(0), dims)
            for lo in range(0, len(whole), BLOCK):
                block = whole[lo : lo + BLOCK]
                chosen, far = nearest(block, centres)
                order = np.argsort(chosen, kind="stable")
                found, starts = np.unique(chosen[order], return_index=True)
                total[found] += np.add.reduceat(block[order], starts).astype(object)
                count += np.bincount(chosen, minlength=k)
                for c, part in zip(found, np.split(far[order], starts[1:]), strict=True):
                    distance[c] += int(part.sum(dtype=object))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": seen.astype(np.int32), "n": count[seen], "distance": [str(distance[c]) for c in seen], "total": [[str(x) for x in total[c]] for c in seen]}, schema=kind)

    kind = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("distance", pa.string()), ("total", pa.list_(pa.string()))])
    each = points.select("point").mapInArrow(add, "cluster int, n long, distance string, total array<string>")
    whole = each.select("cluster", "n", F.col("distance").cast("decimal(38,0)").alias("distance"), F.posexplode("total").alias("at", "x"))
    summed = whole.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))
    out: dict[int, tuple[int, int, list[int]]] = {}
    for r in summed.collect():  # a row for each centroid and component
        out.setdefault(r["cluster"], (r["n"], int(r["distance"]), [0] * dims))[2][r["at"]] = int(r["x"])
    return out


def centre_name(centre: np.ndarray) -> Column:
    """SHA-256 of the components as decimals, joined by commas."""
    return F.sha2(F.lit(",".join(map(str, centre.tolist()))).cast("binary"), 256)


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that can be kept.

    Vectors that are NULL, of another length, or with a NULL or non-finite component are left
    out, as they have no distances.  Keys may be NULL or repeat; each row is a vector of its
    own, and repeated vectors share a cluster.  Ties go to the lowest centroid; clusters that
    run empty keep their centroid; with fewer than ``k`` vectors there are as many centroids.
    Further columns are left out; no vectors give no rows.
    """
    points = materialize(whole_vectors(rows, vector, dims, scale).select(F.col(key).alias("key"), "point"), "points")
    centres = first_centres(points, "key", k, seed)
    if not len(centres):
        return points.selectExpr(f"key AS `{key}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        for c, (n, _far, total) in _sums(points, centres).items():
            centres[c] = [x // n for x in total]  # floors below zero too
    final = {c: far for c, (_n, far, _total) in _sums(points, centres).items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                chosen, far = nearest(_points(part.column(1), dims), centres)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chosen.astype(np.int32)), pa.array(far)], names=["key", "cluster", "distance"])

    kind = points.schema["key"].dataType.simpleString()
    assigned = points.mapInArrow(assign, f"key {kind}, cluster int, distance long")
    spark = rows.sparkSession
    told = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(far).cast("long").alias("cluster_inertia"), centre_name(centres[c]).alias("centroid_sha256")) for c, far in final.items()])).alias("c")).select("c.*")
    met = assigned.join(F.broadcast(told), "cluster")  # k rows
    return met.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", F.lit(sum(final.values())).cast("long").alias("inertia"), "centroid_sha256")
