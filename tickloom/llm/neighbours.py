"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation, three rounds of random signs and a fast Hadamard transform, turns a unit vector; its hash is the axis
it then lies nearest to, with sign. Every table has its own rotations. A query looks into the buckets of the axes
nearest to it, in each table, and all vectors found there are ranked by their cosine in double precision.

The number of hashes joined into a table's key grows with the logarithm of the number of vectors, so that buckets keep
their size. Neighbouring buckets of a table are searched as one lot, so that a query's vector travels once to each lot it
visits, with the numbers of its buckets there, and not once to each bucket. Lots that are large all the same are split
into shares, each searched by every query of the lot. Where the index is large, its tables are searched in turns, so that
one table's copy of the vectors is shuffled at a time, and queries bring the least cosine that the first table left them to
find. In a lot, pairs are compared in single precision first; all that its error allows are ranked in double.

How many buckets a query must look into depends on the number of hashes and on how near neighbours are, so it is
measured: the true neighbours of a sample of the queries are found by comparing these with all vectors, and as many
buckets are visited as find the wanted part of them. Where that is too many, a key has one hash less.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StructField, StructType

from tickloom.llm.common import staged
from tickloom.llm.vectors import exact_cosines, matrix, unit, usable
from tickloom.session import discard_folder, fresh_folder, session_settings

TABLES = 8
PROBES = 16  # at least
MOST_PROBES = 4096  # with more than one hash; with one, all buckets are visited if need be
RECALL = 0.95  # of the sample; leaves room for its error above 0.9
SAMPLE = 200  # queries of each length whose true neighbours are found
BUCKET_ROWS = 400
SEED = 5
SLACK = 1e-9
CHUNK_ROWS = 50_000  # that a Python step makes at once
LOT_ROWS = 100_000  # vectors of one table that a task searches
LEAST_LOTS = 4  # of a table, for the tasks of small tables
LOT_PAIRS = 4_000_000  # that a task compares at once
HELD_PAIRS = 1_000_000  # that it holds before it takes the exact cosines of the nearest
TURN_FLOATS = 1 << 26  # components of the vectors that are shuffled at a time, or one table's
TASK_PROBES = 500_000  # that a task finds the buckets of
NO_COSINE = -2.0  # below any
BUCKETS_ARROW = pa.list_(pa.int64())
BUCKETS = StructField("buckets", ArrayType(LongType()))
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # once a step's rows are written


def hadamard(vectors: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    step, width = 1, vectors.shape[1]
    while step < width:
        parts = vectors.reshape(len(vectors), -1, 2, step)
        vectors = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2)
        vectors = vectors.reshape(len(parts), width)
        step *= 2
    return vectors / np.sqrt(width)


@cache
def rotation(dim: int, table: int, place: int) -> np.ndarray:
    """The pseudo-rotation of one hash of one table, as a matrix for vectors of this length."""
    width = 1 << max(1, int(dim - 1).bit_length())
    padded = np.eye(dim, width)
    signs = np.random.default_rng([SEED, table, place, width])
    for _ in range(3):
        padded = hadamard(padded * signs.choice([-1.0, 1.0], width))
    return padded


def turned(vectors: np.ndarray, table: int, place: int) -> np.ndarray:
    """Coordinates along the signed axes after the pseudo-rotation of one hash of one table."""
    axes = vectors @ rotation(vectors.shape[1], table, place)
    return np.concatenate([axes, -axes], axis=1)


def axes_of(dim: int) -> int:
    """Signed axes that a hash of vectors of this length can name."""
    return 2 << max(1, int(dim - 1).bit_length())


def own_buckets(vectors: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """Key of the bucket of each row."""
    key = np.zeros(len(vectors), dtype=np.int64)
    for place in range(hashes):
        axes = vectors @ rotation(vectors.shape[1], table, place)
        axis = np.abs(axes).argmax(axis=1)
        below = axes[np.arange(len(axes)), axis] < 0
        key = key * 2 * axes.shape[1] + axis + below * axes.shape[1]
    return key


def buckets(vectors: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """Keys of the ``probes`` nearest buckets of each row, nearest first."""
    keys = losses = None
    for place in range(hashes):
        axes = turned(vectors, table, place)
        nearest = np.argsort(-axes, axis=1, kind="stable")[:, :probes]
        loss = axes.max(axis=1)[:, None] - np.take_along_axis(axes, nearest, axis=1)
        if keys is None:
            keys, losses = nearest, loss
            continue
        # Both are sorted: a pair with ``probes`` pairs or more below it in both is not among the nearest.
        i, j = np.nonzero(np.outer(np.arange(keys.shape[1]) + 1, np.arange(nearest.shape[1]) + 1) <= probes)
        keys, losses = keys[:, i] * axes.shape[1] + nearest[:, j], losses[:, i] + loss[:, j]
        order = np.argsort(losses, axis=1, kind="stable")[:, :probes]
        keys, losses = np.take_along_axis(keys, order, axis=1), np.take_along_axis(losses, order, axis=1)
    return keys


def packed(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, vector) of the usable rows: the components' bytes, which Spark compares, sorts and copies at once."""
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.size("embedding").alias("dim"), "embedding")
    if rows.schema["embedding"].dataType.elementType != FloatType():
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False) + 0  # minus zero becomes zero
            ends = np.append(0, np.cumsum(batch.column("dim").to_numpy(), dtype=np.int32)) * np.int32(values.itemsize)
            held = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)]
            vectors = pa.Array.from_buffers(pa.binary(), batch.num_rows, held)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), vectors], names=["vec_id", "dim", "vector"])

    return rows.mapInArrow(pack, StructType([*rows.schema][:2] + [StructField("vector", BinaryType())]))


def rows_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Packed vectors of one length, row for row."""
    rows = [np.empty((0, dim))]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            kind = np.float32 if ends[1] - ends[0] == 4 * dim else np.float64
            rows.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, dim))
    return np.concatenate(rows)


def by_length(batches: Iterator[pa.RecordBatch], most: dict[int, int]) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """The rows of each length in ``most``, so many at once at most, and their units."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for at in range(0, len(rows) if dim in most else 0, most[dim] if dim in most else 1):
                part = pa.Table.from_batches([batch]).take(pa.array(rows[at : at + most[dim]]))
                yield dim, part, unit(rows_of(part["vector"], dim))


def indexed(classes: DataFrame, tables: int, hashes: dict[int, int]) -> DataFrame:
    """Rows (class_id, dim, vector) with ``buckets``, one of each table."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, units in by_length(batches, dict.fromkeys(hashes, CHUNK_ROWS)):
            keys = np.stack([own_buckets(units, table, hashes[dim]) for table in range(tables)], axis=1)
            ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            yield from part.append_column("buckets", pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))).to_batches()

    rows = classes.select("class_id", "dim", "vector")
    return rows.mapInArrow(enter, StructType([*rows.schema, BUCKETS]))


def probing(queries: DataFrame, turn: range, hashes: dict[int, int], probes: dict[int, int], widths: dict[int, int]) -> DataFrame:
    """Rows (class_id, dim, vector, least) once for each lot that one visits in the tables of ``turn``, with ``buckets`` there."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, units in by_length(batches, {dim: max(1, CHUNK_ROWS // probes[dim]) for dim in hashes}):
            for table in turn:
                keys = np.sort(buckets(units, table, hashes[dim], probes[dim]), axis=1)
                lots = keys // widths[dim]
                first = np.ones(keys.shape, dtype=bool)
                first[:, 1:] = lots[:, 1:] != lots[:, :-1]
                begin = np.flatnonzero(first)
                ends = pa.array(np.append(begin, keys.size).astype(np.int32))
                found = part.take(pa.array(begin // keys.shape[1]))
                found = found.append_column("table", pa.array(np.full(len(begin), table, dtype=np.int32)))
                found = found.append_column("lot", pa.array(lots.ravel()[begin]))
                yield from found.append_column("buckets", pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))).to_batches()

    rows = queries.select("class_id", "dim", "vector", "least")
    return rows.mapInArrow(enter, StructType([*rows.schema, StructField("table", IntegerType()), StructField("lot", LongType()), BUCKETS]))


def lot_width(n: int, dim: int, hashes: int) -> int:
    """Neighbouring buckets of one table that are searched as one lot, of ``n`` vectors."""
    return max(1, axes_of(dim) ** hashes // max(LEAST_LOTS, -(-n // LOT_ROWS)))


def entries(index: DataFrame, turn: range, widths: dict[int, int]) -> DataFrame:
    """Rows of ``index`` once for each table of ``turn``, with its number, bucket and lot."""
    lengths = ", ".join(f"{dim}, {width}L" for dim, width in ({0: 1} | widths).items())
    held = F.posexplode(F.slice("buckets", turn.start + 1, len(turn))).alias("at", "bucket")
    rows = index.select(*[name for name in index.columns if name != "buckets"], held)
    rows = rows.withColumn("table", (F.col("at") + turn.start).cast("int"))
    return rows.withColumn("lot", F.expr(f"bucket div element_at(map({lengths}), dim)")).drop("at")


def nearest_in_lot(left: pa.Table, right: pa.Table, kept: int) -> pa.Table:
    """(query_class, class_id, score): of each query, ``left``, the nearest vectors, ``right``, of the buckets it visits.

    Those below the query's ``least`` may be left out.
    """
    dim = [*left["dim"][:1].to_pylist(), *right["dim"][:1].to_pylist()][0]
    query_ids, ids = left["class_id"].to_numpy(), right["class_id"].to_numpy()
    queries, vectors = rows_of(left["vector"], dim), rows_of(right["vector"], dim)
    visits = pa.chunked_array(left["buckets"].chunks, BUCKETS_ARROW)
    visitor = np.repeat(np.arange(len(queries)), pc.list_value_length(visits).to_numpy())
    visited, own = pc.list_flatten(visits).to_numpy(), right["bucket"].to_numpy()
    of_visit, of_row = np.argsort(visited, kind="stable"), np.argsort(own, kind="stable")
    visitor, visited, own = visitor[of_visit], visited[of_visit], own[of_row]
    rough_queries, rough_vectors = unit(queries).astype(np.float32), unit(vectors).astype(np.float32)[of_row]
    slack = (dim + 8) * 2.0**-22  # above twice the error of a product of rounded units
    floor = left["least"].to_numpy().astype(np.float32) - np.float32(slack)  # a pair needs, roughly, to be among the nearest
    near, pairs = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), []
    held = 0

    def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, rough = map(np.concatenate, zip(*pairs, strict=True))
        pairs.clear()
        # Query and distance in one number, so that one sort finds the place of each query's last of ``kept``.
        order = np.sort(i << 32 | ((1.001 - rough) * 2.0**30).astype(np.int64))
        number = np.bincount(i, minlength=len(queries))
        full = np.flatnonzero(number >= kept)
        least = 1.001 - (order[(np.cumsum(number) - number)[full] + kept - 1] & 0xFFFFFFFF) / 2.0**30
        floor[full] = np.maximum(floor[full], least - slack)
        i, j = i[rough >= floor[i]], j[rough >= floor[i]]
        score = [exact_cosines(queries[i[at : at + CHUNK_ROWS]], vectors[j[at : at + CHUNK_ROWS]]) for at in range(0, len(i), CHUNK_ROWS)]
        new = query_ids[i], ids[j], np.concatenate([np.empty(0), *score])
        return cut(*(np.concatenate(both) for both in zip(near, new, strict=True)), kept)

    for key in np.unique(own):
        begin, end = np.searchsorted(own, [key, key + 1])
        asking = visitor[slice(*np.searchsorted(visited, [key, key + 1]))]
        step = max(1, LOT_PAIRS // (end - begin))
        for at in range(0, len(asking), step):
            part = asking[at : at + step]
            rough = rough_queries[part] @ rough_vectors[begin:end].T
            least = floor[part]
            if end - begin > kept and (new := least < -1.5).any():
                least[new] = np.partition(rough[new], -kept, axis=1)[:, -kept] - slack
            i, j = np.nonzero(rough >= least[:, None])
            pairs.append((part[i], of_row[begin + j], rough[i, j]))
            held += len(i)
            if held > HELD_PAIRS:
                near, held = settled(), 0
    if pairs:
        near = settled()
    return pa.table(dict(zip(["query_class", "class_id", "score"], near, strict=True)))


def cut(query: np.ndarray, ids: np.ndarray, score: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``kept`` nearest of each query; ties go to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    begin = np.searchsorted(query, query)
    order = order[np.arange(len(query)) - begin < kept]
    return np.sort(query[np.arange(len(query)) - begin < kept]), ids[order], score[order]


def nearest_of(found: DataFrame, kept: int) -> DataFrame:
    """The ``kept`` nearest of each query; a pair may come more than once."""
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    return found.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= kept).drop("place").distinct()


def buckets_before(queries: np.ndarray, others: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """For each row, how many buckets its query visits before the one of the other vector, in the best table."""
    least = np.full(len(queries), np.iinfo(np.int64).max)
    for table in range(tables):
        losses, own = [], 0.0
        for place in range(hashes):
            axes = turned(queries, table, place)
            losses.append(axes.max(axis=1)[:, None] - axes)
            axis = turned(others, table, place).argmax(axis=1)[:, None]
            own = own + np.take_along_axis(losses[-1], axis, axis=1)[:, 0]
        for at in range(len(queries)):
            inner = np.zeros(1)
            for loss in losses[1:]:
                inner = (inner[:, None] + loss[at]).ravel()
            before = np.searchsorted(np.sort(inner), own[at] - losses[0][at] - SLACK).sum()
            least[at] = min(least[at], before)
    return least


def true_neighbours(classes: DataFrame, asked: DataFrame, neighbours: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: units of sampled queries, and of their nearest vectors, row for row. Found by comparing with all."""
    some = asked.select("class_id", "dim", "vector").dropDuplicates(["class_id"])
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("class_id"), "class_id"))
    some = some.withColumn("place", place).where(F.col("place") <= SAMPLE).drop("place").toPandas()
    sample = {
        dim: (part["class_id"].to_numpy(), unit(rows_of(pa.array(map(bytes, part["vector"]), pa.binary()), dim)))
        for dim, part in some.groupby("dim")
    }

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, part, given in by_length(batches, dict.fromkeys(sample, CHUNK_ROWS)):
            ids, queries = sample[dim]
            scores = np.where(ids[:, None] == part["class_id"].to_numpy(), -np.inf, queries @ given.T)
            vectors = np.broadcast_to(given, (len(ids), *given.shape))
            if dim in best:
                scores = np.concatenate([best[dim][0], scores], axis=1)
            top = np.argpartition(-scores, min(neighbours, scores.shape[1]) - 1, axis=1)[:, :neighbours]
            held = best[dim][1].shape[1] if dim in best else 0
            new = np.take_along_axis(vectors, np.maximum(top - held, 0)[:, :, None], axis=1)
            if held:
                old = np.take_along_axis(best[dim][1], np.minimum(top, held - 1)[:, :, None], axis=1)
                new = np.where((top < held)[:, :, None], old, new)
            best[dim] = np.take_along_axis(scores, top, axis=1), new
        for dim, (scores, found) in best.items():
            query, spot = np.nonzero(scores > -np.inf)
            ends = pa.array(np.arange(len(query) + 1, dtype=np.int32) * dim)
            vectors = pa.ListArray.from_arrays(ends, pa.array(found[query, spot].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(query), dim, np.int32)), pa.array(query.astype(np.int32)), pa.array(scores[query, spot]), vectors],
                names=["dim", "query", "score", "found"],
            )

    found = classes.select("class_id", "dim", "vector").mapInArrow(
        nearest, "dim int, query int, score double, found array<double>"
    )
    order = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "found")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= neighbours)
    found = found.select("dim", "query", "found").toPandas()
    return {
        dim: (sample[dim][1][part["query"].to_numpy()], matrix(part["found"])) for dim, part in found.groupby("dim")
    }


def plan_probes(
    sizes: dict[int, int], pairs: dict[int, tuple[np.ndarray, np.ndarray]], tables: int, probes: int
) -> tuple[dict[int, int], dict[int, int]]:
    """Hashes and probes of each length that find the part RECALL of ``pairs``."""
    hashes, visits = {}, {}
    for dim, n in sizes.items():
        width = 1 << max(1, int(dim - 1).bit_length())
        hashes[dim], visits[dim] = max(1, round(np.log(n / BUCKET_ROWS) / np.log(2 * width))), probes
        while dim in pairs:
            before = np.sort(buckets_before(*pairs[dim], tables, hashes[dim]))
            visits[dim] = max(probes, int(before[int(np.ceil(RECALL * len(before))) - 1]) + 1)
            if hashes[dim] == 1 or visits[dim] <= MOST_PROBES:
                break
            hashes[dim] -= 1
    return hashes, visits


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, neighbours: int = 5, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest other rows found for each row of ``queries`` (vec_id, embedding).

    ``probes`` buckets of each table are visited at least, and as many more as the wanted recall takes.
    Nearness is the cosine; ties go to the smaller vec_id. Vectors that are null, empty, zero or not finite, and rows
    without vec_id, take no part. Rows that repeat in full are one. Vectors of different length are never near.
    """
    with session_settings(vectors.sparkSession, SETTINGS):
        return searched_neighbours(vectors, queries, neighbours, tables, probes)


def searched_neighbours(vectors: DataFrame, queries: DataFrame, neighbours: int, tables: int, probes: int) -> DataFrame:
    kept = neighbours + 1
    fit = packed(vectors).distinct()
    by_id = Window.partitionBy("vector", "dim").orderBy("vec_id")
    # Of equal vectors only the smallest ids can be among the nearest.
    first = fit.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= kept)
    all_ids = F.collect_list("vec_id").over(by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    classes = first.withColumn("ids", all_ids).where(F.col("place") == 1).withColumnRenamed("vec_id", "class_id").drop("place")
    folder = fresh_folder(vectors.sparkSession, "neighbour-classes")
    classes = staged(classes, "neighbour-classes", folder=folder)
    sizes = {row["dim"]: row["n"] for row in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = packed(queries).distinct().join(classes.select("vector", "dim", "class_id"), ["vector", "dim"])
    asked = staged(asked.withColumnRenamed("vec_id", "query_id"), "neighbour-queries")
    hashes, visits = plan_probes(sizes, true_neighbours(classes, asked, neighbours), tables, probes)
    index = staged(indexed(classes, tables, hashes), "neighbour-index")
    members = staged(classes.select("class_id", "ids"), "neighbour-ids")
    discard_folder(vectors.sparkSession, folder)  # the index has all vectors
    asking = asked.select("class_id", "dim", "vector", F.lit(NO_COSINE).alias("least")).dropDuplicates(["class_id"])
    asking = staged(asking, "neighbour-asking")
    asks = {row["dim"]: row["n"] for row in asking.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    widths = {dim: lot_width(n, dim, hashes[dim]) for dim, n in sizes.items()}
    keys = ["dim", "table", "lot"]
    counts = entries(index.select("dim", "buckets"), range(tables), widths).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    lots = staged(counts.select(*keys, F.ceil(F.col("n") / LOT_ROWS).cast("int").alias("shares")), "neighbour-lots")
    together = max(1, TURN_FLOATS // max(1, sum(dim * n for dim, n in sizes.items())))
    turns = []
    for first in range(0, tables, together):
        turn = range(first, min(tables, first + together))
        if first == together:  # what the first turn found is the least that the others need to find
            full = turns[0].groupBy(F.col("query_class").alias("class_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
            asking = asking.drop("least").join(full.where(F.col("n") == kept).drop("n"), "class_id", "left")
            asking = staged(asking.fillna(NO_COSINE, ["least"]), "neighbour-asking")
        tasks = 1 + sum(n * visits[dim] * len(turn) for dim, n in asks.items()) // TASK_PROBES
        # A row for each LOT_ROWS vectors and table: small beside both sides, whose sizes Spark takes from before they grow.
        searched = probing(asking.repartition(tasks), turn, hashes, visits, widths).join(F.broadcast(lots), keys)
        searched = searched.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        bucketed = entries(index, turn, widths).join(F.broadcast(lots.toDF(*lots.columns)), keys)
        bucketed = bucketed.withColumn("share", F.pmod(F.xxhash64("class_id"), F.col("shares")).cast("int")).drop("shares")
        found = searched.groupBy(*keys, "share").cogroup(bucketed.groupBy(*keys, "share")).applyInArrow(
            lambda left, right: nearest_in_lot(left, right, kept), "query_class long, class_id long, score double"
        )
        turns.append(staged(nearest_of(found, kept), "neighbour-turn"))
    found = nearest_of(reduce(DataFrame.union, turns), kept)
    found = found.join(members, "class_id")
    found = found.select("query_class", "score", F.explode("ids").alias("vec_id"))
    own = asked.select("query_id", F.col("class_id").alias("query_class"))
    answers = own.join(found, "query_class").where("query_id != vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return answers.select("query_id", "rank", "vec_id", "score")


def neighbours_query(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five nearest of each vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))
