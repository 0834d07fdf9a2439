"""Removal of lines that many documents share, kept reversible.

The state is an exact table of reference counts, one row for each line key with the number of
documents that hold it. Adding documents adds to the counts, deleting them subtracts, and a
line whose count falls below the threshold comes back. Over it lie cuckoo filters, one for each
shard of keys: they hold the keys at or above the threshold, support deletion too, and answer
nearly all lookups in two small buckets. What a filter lets through is looked up in the exact
table, so its errors never reach a result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlode.llm.common import durable, free_name, newest_version, same, small

MIN_DOCS = 10
MIN_CHARS = 1
SHARDS = 64
SLOTS = 4
MAX_KICKS = 500
#: Filters larger than this in all are not broadcast; then every line goes to the exact table.
FILTER_BYTES = 64 << 20
ASCII_BLANKS = b" \t\n\r\x0b\x0c"


class CuckooFilter:
    """16-bit marks in buckets of four; a mark's second bucket follows from the first and it."""

    def __init__(self, buckets: int, marks: np.ndarray | None = None):
        self.mask = buckets - 1
        self.marks = np.zeros((buckets, SLOTS), np.uint16) if marks is None else marks

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter of all keys; it doubles until every key has found a place."""
        buckets = 1 << max(1, (len(keys) * 5 // (4 * SLOTS)).bit_length())
        while True:
            made = cls(buckets)
            if all(made.insert(key) for key in keys):
                return made
            buckets *= 2

    def places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[10:15], "little") & self.mask
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self.places(key)
        return bool((self.marks[first] == mark).any() or (self.marks[second] == mark).any())

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the filter has then to be built anew, twice as large."""
        mark, first, second = self.places(key)
        for bucket in (first, second):
            free = np.flatnonzero(self.marks[bucket] == 0)
            if len(free):
                self.marks[bucket, free[0]] = mark
                return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            mark, self.marks[bucket, slot] = int(self.marks[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            free = np.flatnonzero(self.marks[bucket] == 0)
            if len(free):
                self.marks[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        """Take out a key that was inserted; one of two equal marks may stand for the other."""
        mark, first, second = self.places(key)
        for bucket in (first, second):
            held = np.flatnonzero(self.marks[bucket] == mark)
            if len(held):
                self.marks[bucket, held[0]] = 0
                return True
        return False


def line_key(line: bytes) -> bytes:
    """128 bits of the line without ASCII blanks at its ends, A-Z in lower case."""
    return xxhash.xxh3_128_digest(line.strip(ASCII_BLANKS).lower())


def shard_of(key: bytes) -> int:
    return key[0] % SHARDS


def _long_enough(line: bytes, least: int) -> bool:
    bare = line.strip(ASCII_BLANKS)
    return len(bare) >= least and (len(bare) >= 4 * least or len(bare.decode("utf-8", "replace")) >= least)


def keys_of(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where the line is too short to be dropped."""
    return [line_key(line) if _long_enough(line, min_chars) else None for line in (text or b"").split(b"\n")]


def reference_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, refs): the number of documents that hold each line key, over whole texts.

    A document counts once for a line that it repeats. Each row is a document of its own, also
    where doc_id repeats or is null. Tasks sum up the keys they see before the shuffle.
    """

    def run(batches):
        for batch in small(batches):
            found: dict[bytes, int] = {}
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for key in set(keys_of(text, min_chars)):
                    if key is not None:
                        found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["key", "refs"]
            )

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "key binary, refs long")
    return counted.groupBy("key").agg(F.sum("refs").alias("refs"))


def add_documents(counts: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The counts after docs were inserted."""
    both = counts.union(reference_counts(docs, min_chars))
    return both.groupBy("key").agg(F.sum("refs").alias("refs"))


def remove_documents(counts: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The counts after docs, inserted before, were deleted; keys without documents go."""
    gone = reference_counts(docs, min_chars).select("key", (-F.col("refs")).alias("refs"))
    return counts.union(gone).groupBy("key").agg(F.sum("refs").alias("refs")).where("refs > 0")


def build_filters(frequent: DataFrame) -> DataFrame:
    """(shard, marks): one cuckoo filter for each shard of the keys."""

    def build(found):
        filters = CuckooFilter.of(found.column("key").to_pylist())
        return pa.table({"shard": found.column("shard").slice(0, 1), "marks": pa.array([filters.marks.tobytes()])})

    shard = F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int") % SHARDS
    return frequent.select(shard.alias("shard"), "key").groupBy("shard").applyInArrow(
        build, "shard int, marks binary"
    )


def update_filter(marks: bytes, added: list[bytes], removed: list[bytes]) -> bytes:
    """A shard's filter after keys have crossed the threshold either way."""
    held = CuckooFilter(len(marks) // (2 * SLOTS), np.frombuffer(marks, np.uint16).reshape(-1, SLOTS).copy())
    for key in removed:
        held.delete(key)
    if not all(held.insert(key) for key in added):
        raise OverflowError("the filter is full: build the shard anew from its counts")
    return held.marks.tobytes()


def _loaded(frequent: DataFrame):
    """The filters as a broadcast value, or None if they are too large for one."""
    filters = durable(build_filters(frequent), "line-filters")
    size = filters.agg(F.sum(F.octet_length("marks"))).first()[0] or 0
    if size > FILTER_BYTES:
        return None
    rows = {shard: bytes(marks) for shard, marks in filters.collect()}
    return frequent.sparkSession.sparkContext.broadcast(rows)


def let_through(keys: np.ndarray, marks: np.ndarray, starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which keys (rows of 16 bytes) their shard's filter may hold; the filters lie end to end
    in marks, masks is -1 for a shard without one."""
    shard = keys[:, 0] % SHARDS
    mask = masks[shard]
    mark = np.maximum(keys[:, 8:10].copy().view("<u2")[:, 0], 1)
    place = np.zeros((len(keys), 8), np.uint8)
    place[:, :5] = keys[:, 10:15]
    first = place.view("<i8")[:, 0] & mask
    second = (first ^ (mark.astype(np.int64) * 0x5BD1E995)) & mask
    held = np.zeros(len(keys), bool)
    at = np.flatnonzero(mask >= 0)
    for bucket in (first, second):
        held[at] |= (marks[starts[shard[at]] + bucket[at]] == mark[at, None]).any(axis=1)
    return held


def candidate_lines(docs: DataFrame, loaded, id_name: str, min_chars: int) -> DataFrame:
    """(id, key): the distinct keys of each text that the filters let through."""

    def run(batches):
        if loaded is not None:
            sizes = np.array([len(loaded.value.get(shard, b"")) // (2 * SLOTS) for shard in range(SHARDS)])
            joined = b"".join(loaded.value.get(shard, b"") for shard in range(SHARDS))
            marks = np.frombuffer(joined, np.uint16).reshape(-1, SLOTS)
            starts, masks = np.cumsum(sizes) - sizes, sizes - 1
        for batch in small(batches):
            ids, keys = [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = set(keys_of(text, min_chars)) - {None}
                ids.extend([at] * len(found))
                keys.extend(found)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], ["id", "key"])
            if loaded is not None and keys:
                raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
                out = out.filter(pa.array(let_through(raw, marks, starts, masks)))
            yield out

    return docs.select(id_name, F.col("text").cast("string")).mapInArrow(run, "id string, key binary")


def update_counts(spark: SparkSession, path: str, added: DataFrame | None = None,
                  removed: DataFrame | None = None, min_chars: int = MIN_CHARS) -> int:
    """Store the next version of the counts under path: the newest one with documents inserted
    or deleted. Returns its number; version 0 comes from an empty state. A version is written
    whole or not seen, and an older one stays as it was, so an update can be taken back.
    """
    version = newest_version(spark, path)
    counts = load_counts(spark, path, version) if version is not None else spark.createDataFrame([], "key binary, refs long")
    if added is not None:
        counts = add_documents(counts, added, min_chars)
    if removed is not None:
        counts = remove_documents(counts, removed, min_chars)
    number = 0 if version is None else version + 1
    counts.write.parquet(f"{path}/version={number}")
    return number


def load_counts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(key, refs) of a stored version, the newest if none is named."""
    number = newest_version(spark, path) if version is None else version
    return spark.read.schema("key binary, refs long").parquet(f"{path}/version={number}")


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                      counts: DataFrame | None = None) -> DataFrame:
    """All columns of docs, the text without the lines that min_docs documents share, and
    n_lines (before) and n_dropped.

    A null or empty text is one empty line; a null text stays null. If every line goes, the
    text is empty. Rows with equal texts lose equal lines, so texts are matched by digest and
    neither repeated nor null ids matter. New columns whose names are taken get underscores.
    counts are those of docs unless a stored state (load_counts) is given.
    """
    known = reference_counts(docs, min_chars) if counts is None else counts
    frequent = durable(known.where(F.col("refs") >= min_docs), "line-counts")
    digest = free_name(docs, "text_digest")
    named = docs.withColumn(digest, F.md5(F.col("text").cast("string")))
    found = candidate_lines(named, _loaded(frequent), digest, min_chars)
    exact = found.join(frequent.select("key"), "key").groupBy("id").agg(F.collect_set("key").alias("keys"))
    names = [free_name(named, name) for name in ("n_lines", "n_dropped")]
    drop, of = free_name(named, "drop_keys"), free_name(named, "of_text")
    found_keys = exact.withColumnsRenamed({"keys": drop, "id": of})
    joined = named.join(found_keys, same(F.col(digest), F.col(of)), "left").select(
        *[F.col(f"`{name}`") for name in docs.columns], drop
    )
    at, columns_out = docs.columns.index("text"), [*docs.columns, *names]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())])

    def run(batches):
        for batch in small(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            kept, lines, dropped = [], [], []
            for text, keys in zip(texts, batch.column(batch.num_columns - 1).to_pylist()):
                parts = (text or b"").split(b"\n")
                lines.append(len(parts))
                if keys:
                    gone = set(keys)
                    left = [x for x, key in zip(parts, keys_of(text, min_chars)) if key is None or key not in gone]
                    dropped.append(len(parts) - len(left))
                    text = b"\n".join(left)
                else:
                    dropped.append(0)
                kept.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(kept, pa.binary()).cast(batch.column(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                columns_out,
            )

    return joined.mapInArrow(run, schema)

