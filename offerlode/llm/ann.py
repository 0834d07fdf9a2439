"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector's difference from the centre is rotated into more dimensions and kept as signs, with
its length and the inner product of the unit difference with its own code. From these an inner
product with any query is estimated without bias, with an error that shrinks with the code
length. Blocks of codes meet blocks of queries; a row whose upper bound reaches the k-th best
lower bound is reranked on the original vectors, in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlode.llm.common import durable
from offerlode.llm.vectors import float_type, matrix, packed_vectors, usable

TOP = 20
#: The centre and the length of vectors are fitted on at most so many rows; all are indexed.
FIT_ROWS = 4096
BITS_PER_DIM = 4
#: Standard errors on each side of an estimate.
BOUND = 1.9
BLOCK_ROWS = 16384
QUERY_ROWS = 2048
QUERY_STEP = 128
SEED = 8
#: Components from here on are not squared: no code is made of such a vector, it is reranked.
LARGE = 1e100


class Codec:
    """The rotation and centre, and the two sides of the estimate."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre
        dims = len(centre)
        self.bits = -(-max(64, BITS_PER_DIM * dims) // 8) * 8
        gauss = np.random.default_rng([SEED, dims]).standard_normal((self.bits, dims))
        self.rotation = np.linalg.qr(gauss)[0]

    def encode(self, values: np.ndarray):
        """(packed signs, length, inner product of unit difference and code) of each row."""
        away = values - self.centre
        # Rows too long to square have no usable code; bounds() leaves them open.
        large = np.abs(away).max(1) >= LARGE
        away = np.where(large[:, None], 0.0, away)
        length = np.linalg.norm(away, axis=1)
        turned = (away @ self.rotation.T) / np.where(length > 0, length, 1)[:, None]
        align = np.abs(turned).sum(1) / np.sqrt(self.bits)
        length[large] = np.inf
        return np.packbits(turned >= 0, axis=1), length, np.where((length > 0) & ~large, align, 1.0)

    def bounds(self, queries: np.ndarray, codes: np.ndarray, length: np.ndarray, align: np.ndarray):
        """Estimated inner products (queries by rows) and their error bounds."""
        signs = np.unpackbits(codes, axis=1, count=self.bits).astype(np.float32) * 2 - 1
        size = np.linalg.norm(queries, axis=1)[:, None]
        turned = (queries / size @ self.rotation.T).astype(np.float32)
        scale = length / (np.sqrt(self.bits) * align)
        estimate = (turned @ signs.T) * scale * size + (queries @ self.centre)[:, None]
        spread = length * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(self.bits - 1)
        return estimate, BOUND * size * spread


def _fit(rows: DataFrame, dtype: str) -> dict[int, Codec]:
    """A codec for each length in bytes; its centre is the mean of a bounded sample.

    Vectors too long to square are left out of the mean, but not of the index.
    """
    codecs = {}
    for (size,) in rows.select(F.octet_length("raw")).distinct().orderBy(F.octet_length("raw")).collect():
        of_size = rows.where(F.octet_length("raw") == size)
        sample = of_size.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("raw").collect()
        values = matrix([bytes(raw) for (raw,) in sample], dtype)
        fair = values[np.abs(values).max(1) < LARGE]
        codecs[size] = Codec(fair.mean(axis=0) if len(fair) else np.zeros(values.shape[1]))
    return codecs


def _top_of_tile(codec: Codec, queries, rows, top: int):
    """Arrays (query place, row place, score) of the best rows of a tile for each query."""
    query_ids, query_values = queries
    ids, values, codes, length, align = rows
    out = []
    for start in range(0, len(query_ids), QUERY_STEP):
        some = query_values[start:start + QUERY_STEP]
        with np.errstate(all="ignore"):
            estimate, error = codec.bounds(some, codes, length, align)
        known = np.isfinite(estimate) & np.isfinite(error)
        low = np.where(known, estimate - error, -np.inf)
        high = np.where(known, estimate + error, np.inf)
        same = query_ids[start:start + QUERY_STEP, None] == ids[None, :]
        low[same], high[same] = -np.inf, -np.inf
        if len(ids) > top:
            reach = np.partition(low, len(ids) - top, axis=1)[:, len(ids) - top]
        else:
            reach = np.full(len(some), -np.inf)
        for at in range(len(some)):
            chosen = np.flatnonzero((high[at] >= reach[at]) & ~same[at])
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (values[chosen] * some[at]).sum(axis=1)
            order = np.lexsort((ids[chosen], -exact))[:top]
            out.append((np.full(len(order), start + at), chosen[order], exact[order]))
    return (np.concatenate(parts) for parts in zip(*out))


def nearest(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the top rows by inner product for each query row.

    is_query is a condition on the rows of (vec_id, embedding). A query's own id is no candidate.
    Ties go to the smaller vec_id. Vectors that are null, zero or not finite or without vec_id
    take no part; of several vectors with one vec_id one does, the bytewise smallest. Vectors of
    different lengths have no inner product: each length is searched by itself. Vectors too long
    to square are reranked against every query of their length.
    """
    dtype = float_type(vectors, "embedding")
    typed = "float" if dtype == "<f4" else "double"

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed_vectors(batch.column(1)), pa.binary())], ["vec_id", "raw"]
            )

    kept = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{typed}>")
    )
    rows = kept.mapInArrow(pack, "vec_id long, raw binary").groupBy("vec_id").agg(F.min("raw").alias("raw"))
    rows = durable(rows, "ann-rows")
    codecs = _fit(rows, dtype)
    if not codecs:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = vectors.sparkSession.sparkContext.broadcast(codecs)

    def index(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(1))
            for size in pc.unique(sizes).to_pylist():
                part = batch.filter(pc.equal(sizes, size))
                codes, length, align = shared.value[size].encode(matrix(part.column(1).to_pylist(), dtype))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([code.tobytes() for code in codes], pa.binary()),
                    pa.array(length), pa.array(align),
                ], ["vec_id", "raw", "code", "length", "align"])

    indexed = durable(
        rows.mapInArrow(index, "vec_id long, raw binary, code binary, length double, align double"), "ann-index"
    )
    asked = indexed.where(is_query).select("vec_id", "raw")
    blocks = max(1, -(-indexed.count() // BLOCK_ROWS))
    asked_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    place = F.xxhash64("vec_id", F.lit(SEED))
    left = asked.withColumn("query_block", F.pmod(place, F.lit(asked_blocks)).cast("int")).withColumn(
        "row_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = indexed.withColumn("row_block", F.pmod(place, F.lit(blocks)).cast("int")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1)))
    )
    tile = ["query_block", "row_block", "size"]
    left, right = (side.withColumn("size", F.octet_length("raw")) for side in (left, right))

    def search(queries, rows):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        query_ids, ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        asked_at, found_at, scores = _top_of_tile(
            shared.value[queries.column("size")[0].as_py()], (query_ids, matrix(queries.column("raw").to_pylist(), dtype)),
            (ids, matrix(rows.column("raw").to_pylist(), dtype), codes,
             rows.column("length").to_numpy(), rows.column("align").to_numpy()), top,
        )
        return pa.table([query_ids[asked_at], ids[found_at], scores], schema=schema)

    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        search, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score"
    )
