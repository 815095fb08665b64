"""Vector work: TF-IDF of character n-grams, reduction, clustering, distances to centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import ngrams as N
from dialoom.session import broadcast_within, durable


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of the collapsed lower-case text."""

    return T.let(F.lower(T.collapse(c)), lambda t: F.flatten(F.array(*(_grams(t, n) for n in range(low, high + 1)))))


def _grams(t: Column, n: int) -> Column:
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngrams_counted(df: DataFrame, text: str, *, features: int = 12_000, least: int = 2, most: float = 0.95) -> N.Packed:
    """Counts of the ``features`` most frequent n-grams that ``CountVectorizer`` would take, as packed rows."""
    return N.counted(df, text, CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=features, minDF=least, maxDF=most))


def tfidf(df: DataFrame, text: str, *, features: int = 12_000, least: int = 2, most: float = 0.95) -> DataFrame:
    """``df`` with the unit vector ``tfidf``: 1 + ln(count) times inverse document frequency."""
    packed = ngrams_counted(df, text, features=features, least=least, most=most)
    place, size, idf = np.cumsum(packed.chosen) - 1, int(packed.chosen.sum()), packed.idf

    def unit(places, counts):
        i, n = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32)
        i, n = i[packed_in[i]], n[packed_in[i]]
        v = (1 + np.log(n)) * idf[i]
        return SparseVector(size, place[i], v / (np.linalg.norm(v) or 1))

    packed_in = packed.chosen
    return packed.rows.withColumn("tfidf", F.udf(unit, VectorUDT())("_places", "_counts")).drop("_places", "_counts")


def truncated_svd(df: DataFrame, column: str, k: int, out: str = "reduced", *, rounds: int = 6, seed: int = 42) -> DataFrame:
    """``df`` with the sparse vectors ``column`` on their first min(n - 1, m - 1, k) right singular vectors, at least two; not centred.

    Block Krylov iteration from a random start with ten spare directions: each round is
    one pass over the written vectors. Only the directions come to the driver.
    """
    df = durable(df)
    rows = df.select(F.unwrap_udt(column).alias("_v")).select("_v.indices", "_v.values", "_v.size")
    n, m = rows.agg(F.count("size"), F.max("size")).first()
    rows = rows.select("indices", "values")
    shared = df.sparkSession.sparkContext.broadcast(_directions(lambda q: _gram_times(rows, q, _sparse), np.ones(m, bool), n, k, rounds, seed))

    @F.pandas_udf("array<double>")
    def onto(indices: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([v @ shared.value[i] for i, v in zip(indices, values)])

    return df.withColumn("_v", F.unwrap_udt(column)).withColumn(out, array_to_vector(onto("_v.indices", "_v.values"))).drop("_v")


def ngrams_reduced(packed: N.Packed, k: int, out: str = "reduced", *, rounds: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``packed`` with their unit TF-IDF vectors as :func:`truncated_svd` reduces them, in single precision."""
    idf, blocks = packed.idf, packed.rows.select("_places", "_counts")
    q = _directions(lambda q: _gram_times(blocks, q.astype(np.float32), lambda b: N.weighted(b, idf)), packed.chosen, packed.n, k, rounds, seed)
    shared = packed.rows.sparkSession.sparkContext.broadcast(q.astype(np.float32))

    @F.pandas_udf("array<float>")
    def onto(places: pd.Series, counts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["p", "c"])
        product = N.Product(shared.value)
        return pd.Series([row for b in N.weighted(batch, idf) for row in product.onto(*b)])

    return packed.rows.withColumn(out, array_to_vector(onto("_places", "_counts"))).drop("_places", "_counts")


def _directions(times, used: np.ndarray, n: int, k: int, rounds: int, seed: int) -> np.ndarray:
    """The first right singular vectors of a matrix of n rows; ``times`` gives the product of its square with a matrix, ``used`` are its columns.

    A block Krylov space: the best directions within the span of the start and of all its images, not of the last one only.
    """
    m = int(used.sum())
    k = max(2, min(n - 1, m - 1, k))
    found, images = np.zeros((len(used), 0)), np.zeros((len(used), 0))
    q = np.zeros((len(used), min(m, k + 10)))
    q[used] = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, q.shape[1])))[0]
    for _ in range(rounds + 1):
        found, images = np.hstack([found, q]), np.hstack([images, image := times(q)])
        scale = np.linalg.norm(image, axis=0).max()
        for _ in range(2):  # once leaves rounding errors
            image = image - found @ (found.T @ image)
        q, size, _ = np.linalg.svd(image, full_matrices=False)
        q = q[:, size > 1e-6 * scale]  # else nothing but errors of rounding is left in them
        if not q.shape[1]:
            break
    square = found.T @ images
    values, turn = np.linalg.eigh((square + square.T) / 2)
    return found @ turn[:, np.argsort(-values)[:k]]


def _sparse(batch):
    """Blocks of the sparse vectors of a batch of ``indices, values``."""
    at, cat = batch.column(0).offsets.to_numpy(), batch.column(1).offsets.to_numpy()
    i, v = batch.column(0).values.to_numpy()[at[0] : at[-1]], batch.column(1).values.to_numpy()[cat[0] : cat[-1]]
    at = at - at[0]
    for a in range(0, len(at) - 1, N.ROWS):
        bounds = at[a : a + N.ROWS + 1]
        yield bounds - bounds[0], i[bounds[0] : bounds[-1]], v[bounds[0] : bounds[-1]]


def _gram_times(rows: DataFrame, q: np.ndarray, blocks) -> np.ndarray:
    """The product of A'A and q, A being the rows that ``blocks`` gives of a batch: a part by task, added up by place where the tasks are many."""
    shared = rows.sparkSession.sparkContext.broadcast(q)
    shape, kind = q.shape, q.dtype

    def parts(batches):
        product, g = N.Product(shared.value), np.zeros(shape)
        for batch in batches:
            for block in blocks(batch):
                product.add(g, *block)
        yield from packed(g)

    def added(batches):
        g = np.zeros(shape)
        for batch in batches:
            add(g, zip(*(c.to_pylist() for c in batch.columns)))
        yield from packed(g)

    def packed(g):
        for a in range(0, shape[0], N.ROWS):
            if len(x := a + np.flatnonzero(g[a : a + N.ROWS].any(axis=1))):
                yield pa.RecordBatch.from_pydict({"place": [a], "places": [x.tobytes()], "part": [g[x].astype(kind).tobytes()]}, pa.schema([("place", pa.int64()), ("places", pa.binary()), ("part", pa.binary())]))

    def add(g, rows):
        for _, places, part in rows:
            g[np.frombuffer(places, np.int64)] += np.frombuffer(part, kind).reshape(-1, shape[1])

    names = "place long, places binary, part binary"
    done = N.few(rows).mapInArrow(parts, names)
    if N.tasks(rows) > N.FEW_TASKS:
        done = done.repartition("place").mapInArrow(added, names)
    out = np.zeros(shape)
    add(out, done.collect())
    shared.destroy()
    return out


def reduced(df: DataFrame, column: str, k: int, out: str = "reduced") -> DataFrame:
    return PCA(k=k, inputCol=column, outputCol=out).fit(df).transform(df)


def clustered(df: DataFrame, column: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster`` and ``distance`` to its centre."""
    model = KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster", maxIter=10).fit(df)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, _centre array<double>")
    out = model.transform(df).join(F.broadcast(centres), "cluster")  # k rows
    return out.withColumn("distance", l2(vector_to_array(column), F.col("_centre"))).drop("_centre")


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Group centres up to this many are broadcast.
MAX_CENTRES = 10_000


def group_centres(df: DataFrame, by: str, column: str) -> DataFrame:
    """The mean vector of each group, one partial sum per group, place and task."""
    long = df.select(by, F.posexplode(column).alias("_i", "_x")).groupBy(by, "_i").agg(F.avg("_x").alias("_m"))
    return long.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centre"))


def nearest(df: DataFrame, by: str, column: str, order: str, n: int) -> DataFrame:
    """The n rows of each group that lie nearest to the group's mean."""
    d = df.join(broadcast_within(durable(group_centres(df, by, column)), MAX_CENTRES), by).withColumn("distance", l2(F.col(column), F.col("centre")))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("distance", order))).where(F.col("rank") <= n).drop("centre")


def entropy_bits(share: Column) -> Column:
    """Aggregate: Shannon entropy in bits of shares that sum to 1."""
    return -F.sum(share * F.log2(share + 1e-12))
