"""Near-duplicate vectors: sign hashing in several tables, exact cosines, components.

Each table cuts space by random hyperplanes; vectors with equal signs share a bucket. Bits for
each table grow with the logarithm of the number of vectors, and the number of tables follows
from the wanted recall at the threshold, so candidates grow in proportion to the input. Equal
vectors are one class from the start.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlode.llm.common import durable, forget
from offerlode.llm.components import components
from offerlode.llm.vectors import float_type, matrix, packed_vectors, sorted_groups, usable

THRESHOLD = 0.95
#: Share of pairs exactly at the threshold that meet in some table.
RECALL = 0.999
BUCKET_ROWS = 16
#: Rows of a bucket that one task compares with each other; larger ones are tiled.
TILE_ROWS = 1024
SEED = 10


def plan_tables(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables)."""
    bits = max(4, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS + 1)))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, digest, raw) of rows that take part; equal vectors have equal digests."""
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kept = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    if element not in ("float", "double"):
        kept = kept.withColumn("embedding", F.col("embedding").cast("array<double>"))

    def run(batches):
        for batch in batches:
            raw = packed_vectors(batch.column(1))
            digests = [hashlib.blake2b(value, digest_size=16).digest() for value in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "digest", "raw"],
            )

    return kept.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
        run, "vec_id long, digest binary, raw binary"
    )


def signatures(values: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One number for each row and table; the hyperplanes depend on seed and size only."""
    planes = np.random.default_rng([SEED, values.shape[1], bits, tables]).standard_normal(
        (values.shape[1], tables * bits)
    )
    signs = (values @ planes >= 0).reshape(len(values), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def bucket_rows(distinct: DataFrame, bits: int, tables: int, dtype: str, slim: bool) -> DataFrame:
    """A row for each class and table; vectors of different lengths never share a bucket."""
    names = ["place", "bucket", "dims", "part"] + ([] if slim else ["digest", "rep", "copies", "raw", "signs"])

    def run(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            lengths = np.array([len(value) for value in raw])
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                some = batch.take(pa.array(rows))
                found = signatures(matrix(some.column("raw").to_pylist(), dtype), bits, tables)
                signs = pa.array([row.tobytes() for row in found], pa.binary())
                part = np.array([int.from_bytes(d[:6], "little") for d in some.column("digest").to_pylist()])
                for place in range(tables):
                    columns = [
                        pa.array(np.full(len(rows), place, np.int32)), pa.array(found[:, place]),
                        pa.array(np.full(len(rows), length, np.int32)), pa.array(part),
                    ]
                    if not slim:
                        columns += [some.column(name) for name in ("digest", "rep", "copies", "raw")] + [signs]
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "place int, bucket long, dims int, part long" + (
        "" if slim else ", digest binary, rep long, copies long, raw binary, signs binary"
    )
    return distinct.mapInArrow(run, schema)


def tiles(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Adds lower and upper, the two parts of a bucket that a tile compares; full buckets of
    many rows become a triangle of tiles, and each row goes to every tile of its part."""
    large = counted.groupBy("place", "bucket", "dims").count().where(F.col("count") > TILE_ROWS)
    large = durable(large.withColumn("parts", F.ceil(F.col("count") / TILE_ROWS).cast("int")).drop("count"), "hot-buckets")
    if large.isEmpty():
        return rows.withColumns({"own": F.lit(0), "lower": F.lit(0), "upper": F.lit(0)})
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.col("part"), F.col("parts")).cast("int")
    return (
        rows.join(large, ["place", "bucket", "dims"], "left").withColumn("parts", parts)
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"lower": F.least("own", "other"), "upper": F.greatest("own", "other")})
        .drop("parts", "other")
    )


def _linked(group: pa.Table, place: int, dtype: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of the links of one tile that no earlier table has compared."""
    values = matrix(group.column("raw").to_pylist(), dtype)
    values /= np.abs(values).max(axis=1, keepdims=True)  # so that no square overflows
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    own = group.column("own").to_numpy()
    first, second = np.nonzero(np.triu(values @ values.T >= threshold, 1))
    lower, upper = group.column("lower")[0].as_py(), group.column("upper")[0].as_py()
    if lower != upper:
        across = own[first] != own[second]
        first, second = first[across], second[across]
    signs = np.frombuffer(b"".join(group.column("signs").to_pylist()), np.int64).reshape(len(values), -1)
    fresh = np.ones(len(first), bool)
    for earlier in range(place):
        fresh &= signs[first, earlier] != signs[second, earlier]
    return first[fresh], second[fresh]


def _roots(first: np.ndarray, second: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """The smallest rep that each row reaches by the links."""
    roots = reps.copy()
    while True:
        before = roots.copy()
        np.minimum.at(roots, first, roots[second])
        np.minimum.at(roots, second, roots[first])
        if (roots == before).all():
            return roots


def link_counts(tiled: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """(digest, links, rep, root) for each tile and row with links: how many vectors it is
    linked to there, and the smallest one reached within the tile. Links are never emitted."""
    keys = ["place", "bucket", "dims", "lower", "upper"]

    def run(batches):
        for group in sorted_groups(batches, keys):
            if group.num_rows < 2:
                continue
            first, second = _linked(group, group.column("place")[0].as_py(), dtype, threshold)
            if not len(first):
                continue
            copies, reps = group.column("copies").to_numpy(), group.column("rep").to_numpy()
            links = np.zeros(len(reps), np.int64)
            np.add.at(links, first, copies[second])
            np.add.at(links, second, copies[first])
            rows = np.flatnonzero(links)
            digests = group.column("digest").combine_chunks().take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [digests, pa.array(links[rows]), pa.array(reps[rows]), pa.array(_roots(first, second, reps)[rows])],
                ["digest", "links", "rep", "root"],
            )

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, "digest binary, links long, rep long, root long"
    )


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding).

    n_links counts the other rows with a cosine of threshold or more, in double precision, that
    share a bucket in some table. Rows whose vector is null, zero or not finite, or that have no
    vec_id, link with nothing. Vectors of different lengths don't link. Repeated rows link with
    each other; rows that share a vec_id share a component.
    """
    dtype = float_type(vectors, "embedding")
    members = durable(classes(vectors), "vector-classes")
    distinct = durable(
        members.groupBy("digest").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")
        ), "distinct-vectors",
    )
    bits, tables = plan_tables(distinct.count(), threshold, recall)
    rows = bucket_rows(distinct, bits, tables, dtype, slim=False)
    found = durable(
        link_counts(tiles(rows, bucket_rows(distinct, bits, tables, dtype, slim=True)), dtype, threshold), "vector-links"
    )
    roots = components(found.where("rep != root").distinct(), "rep", "root")
    summed = found.groupBy("digest").agg(F.sum("links").alias("links"))
    of_class = (
        distinct.drop("raw").join(summed, "digest", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("digest").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    named = members.drop("raw").join(of_class, F.col("digest") == F.col("class")).select(
        "vec_id", "n_links", "component_id"
    )
    alone = vectors.where(~(F.col("vec_id").isNotNull() & usable(F.col("embedding")))).select(
        F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"),
    )
    return named.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
