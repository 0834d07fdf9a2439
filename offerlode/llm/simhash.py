"""Near-duplicate detection by SimHash, joined on a grid of segment bit counts.

A fingerprint is cut into segments of two bits and mapped to the vector of their bit counts.
The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints. Two vectors at distance 2 or less have a grid cell within one step of both, so
each vector is entered into its own cell and into all cells one step away, and an equality
join of the cells finds every candidate. The exact distance decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlode.llm.common import durable, free_name, same, small
from offerlode.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
LOW_BITS = np.uint64(0x5555555555555555)
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; no words: zero."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[start:] for start in range(words))))
    hashes = np.array([xxhash.xxh64_intdigest(shingle, SEED) for shingle in shingles], "<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:  # counting octets first is cheaper than adding up bits
        votes = np.concatenate(
            [np.bincount(octets[:, place], minlength=256) @ BYTE_BITS for place in range(8)]
        )
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, digest: str | None = None) -> DataFrame:
    """(doc_id, fp) and, if a column is named, digest: the fingerprint of every whole text, as a
    signed long. A null or empty text and one of blanks only have fingerprint zero.
    """
    extra = [F.col(digest).alias("digest")] if digest else []

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(text, words) for text in texts], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra).mapInArrow(
        run, "doc_id long, fp long" + ", digest string" * len(extra)
    )


def ball_cells(prints: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, cell and step (0 or 1) of all cells at most one step from each fingerprint.

    Only the low segments are counted; the bits above them are part of every cell's name.
    """
    low = np.uint64((1 << 2 * segments) - 1)
    counts = (prints & LOW_BITS & low) + ((prints >> np.uint64(1)) & LOW_BITS & low) + (prints & ~low)
    place = np.uint64(2) * np.arange(segments, dtype=np.uint64)
    field = (counts[:, None] >> place) & np.uint64(3)
    step = np.left_shift(np.uint64(1), place)
    up_row, up_at = np.nonzero(field < 2)
    down_row, down_at = np.nonzero(field > 0)
    row = np.concatenate([np.arange(len(prints)), up_row, down_row])
    cell = np.concatenate([counts, counts[up_row] + step[up_at], counts[down_row] - step[down_at]])
    return row, cell, (np.arange(len(row)) >= len(prints)).astype(np.int8)


def grid_cells(prints: DataFrame, segments: int = 32) -> DataFrame:
    """(cell, step, fp) of distinct fingerprints: at most 1 + 2 * segments rows for each."""

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(values), 2000):
                block = values[start:start + 2000]
                row, cell, step = ball_cells(block, segments)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.view(np.int64)), pa.array(step), pa.array(block[row].view(np.int64))],
                    ["cell", "step", "fp"],
                )

    return prints.select("fp").mapInArrow(run, "cell long, step byte, fp long")


def close_pairs(prints: DataFrame, segments: int = 32) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most MAX_BITS apart.

    The Manhattan distance is the Hamming distance, less 2 where the two bits of one segment
    are exchanged; a pair is taken in the cells whose steps add up to it, so copies of a pair
    stay few. Spark sizes the cells like the fingerprints, of which each has up to 65, so the
    join is told to sort both sides; by itself it would send millions of cells to the driver.
    """
    cells = grid_cells(prints, segments).hint("merge")
    left = cells.select("cell", F.col("step").alias("step_a"), F.col("fp").alias("a"))
    right = cells.select("cell", F.col("step").alias("step_b"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pair_mask = F.lit(int(LOW_BITS)).cast("long")
    both = differ.bitwiseAND(F.shiftright(differ, 1)).bitwiseAND(pair_mask)
    mixed = F.col("a").bitwiseXOR(F.shiftright(F.col("a"), 1))
    swapped = both.bitwiseAND(mixed) != 0
    steps = F.bit_count(differ) - F.when(swapped, 2).otherwise(0)
    return (
        left.join(right, "cell")
        .where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= MAX_BITS))
        .where(F.col("step_a") + F.col("step_b") == steps)
        .select("a", "b").distinct()
    )


def rooted_prints(prints: DataFrame) -> DataFrame:
    """(fp, first_id, root): each distinct fingerprint, its smallest doc_id and its group."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(close_pairs(distinct), "a", "b")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): groups of texts linked at MAX_BITS or less.

    component_id is the smallest doc_id reachable. Copies share a fingerprint, so only distinct
    fingerprints are joined; no group of copies is expanded. Rows without doc_id keep their
    group; it is null if no row of the group has one.
    """
    rooted = rooted_prints(prints)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group of texts linked at MAX_BITS or less, with all columns of docs.

    The document with the smallest doc_id stays (null last; of several texts with that id the one
    with the smallest digest, of equal rows one). Null, empty and blank texts have fingerprint
    zero and are one group. An empty table gives no rows.
    """
    digest = free_name(docs, "text_digest")
    named = docs.withColumn(digest, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    prints = durable(fingerprints(named, words, digest), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    kept = durable(
        prints.join(rooted_prints(prints).select("fp", "root"), "fp").groupBy("root").agg(first.alias("kept"))
        .select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.digest").alias("kept_digest")), "kept",
    )
    on = same(named["doc_id"].cast("long"), kept["kept_id"]) & (named[digest] == kept["kept_digest"])
    chosen = named.join(kept, on, "left_semi")
    if not prints.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        order = Window.partitionBy("doc_id", digest).orderBy(*[F.col(f"`{name}`") for name in docs.columns if name != "text"])
        at = free_name(chosen, "row")
        chosen = chosen.withColumn(at, F.row_number().over(order)).where(F.col(at) == 1)
    return chosen.select(*[F.col(f"`{name}`") for name in docs.columns])
