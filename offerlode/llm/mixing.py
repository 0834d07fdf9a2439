"""Mixing sources to target weights by pivotal dependent rounding.

Targets share out all words by weight; a source that would pass three times its own size is
held there and the rest is shared again. Every document of a source starts with the same copy
number, target / source size. Its whole part is taken as it is. The fractional parts are
rounded in pairs: mass moves between two documents, weighted by their sizes, until one of them
is whole, at random and so that no expectation and no sum of words changes. Each group of
documents leaves one fractional residual; residuals are grouped and rounded again, level by
level, until each source has one, which is rounded last.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlode.llm.common import durable, free_name, same

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = 3
MOST_COPIES = 3
#: Documents of a group; each level of the tree is smaller by this factor.
GROUP_ROWS = 4096
SEED = 20


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; null counts 0."""
    bare = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(F.length(bare) > 0, spaces + 1).otherwise(0), F.lit(0)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, size, rows): identical rows are one unit and share a decision."""
    text = F.col("text").cast("string")
    return (
        docs.select("doc_id", "source", F.md5(text).alias("digest"), word_count(text).alias("size"))
        .groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("rows"))
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_units, weight, target) from (source, source_size, n_units).

    Sources weigh 1, 2, 3, repeating, by code point, null last. The table has one row for each
    source. Held sources are found without iteration: a source is held if sharing among those
    with no larger ratio of weight to size would take it past its limit, so sorted by that
    ratio the open ones come first, and the share per weight only rises as others are held.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(CYCLE)) + 1).cast("long")
    )
    every = Window.partitionBy()
    # Most weight for its size first; those before a source are held if it is the first open one.
    ratio = F.col("weight") / F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    order = Window.orderBy(F.when(F.col("source_size") == 0, None).otherwise(ratio).desc_nulls_first(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    held = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_COPIES
    open_weight = F.sum("weight").over(after)
    shared = weighed.withColumn("level", (total - held) / open_weight.cast("double"))
    # The first source that fits under its limit at its own level sets the level of all.
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * MOST_COPIES
    level = F.max(F.when(fits & (F.col("source_size") > 0), F.struct(ratio, "level"))).over(every)["level"]
    return shared.withColumn("level", level).select(
        "source", "source_size", "n_units", "weight",
        F.least(
            F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)), F.col("source_size") * F.lit(float(MOST_COPIES))
        ).alias("target"),
    )


def chance(*parts) -> float:
    """A number in [0, 1) that depends on its arguments only."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest()) / 2**56


def pivot(fractions: list[float], masses: list[float], draw) -> tuple[list[float], int | None]:
    """Round all but one of the fractions to 0 or 1, keeping sum(fraction * mass).

    Each step takes two fractional entries. Raising one by d / mass lowers the other likewise;
    the two ways of ending are drawn with the odds that keep each entry's expectation. Returns
    the fractions and the place of the one left over, if any. Entries without mass count as 0.
    """
    rounded = list(fractions)
    open_at = None
    for at, mass in enumerate(masses):
        if mass <= 0:
            rounded[at] = 0.0
            continue
        if not 0 < rounded[at] < 1:
            continue
        if open_at is None:
            open_at = at
            continue
        one, two = rounded[open_at] * masses[open_at], rounded[at] * mass
        up = min(masses[open_at] - one, two)
        down = min(one, mass - two)
        moved = up if draw(open_at, at) < down / (up + down) else -down
        one, two = one + moved, two - moved
        rounded[open_at] = _snapped(one / masses[open_at])
        rounded[at] = _snapped(two / mass)
        left = [place for place in (open_at, at) if 0 < rounded[place] < 1]
        open_at = left[0] if left else None
    return rounded, open_at


def _snapped(value: float) -> float:
    nearest = round(value)
    return float(nearest) if abs(value - nearest) < 1e-9 else value


def _round_groups(rows: DataFrame, level: int) -> DataFrame:
    """Round within (source, bucket); at most one row of each stays fractional."""

    def run(group):
        group = group.sort_by([("place", "ascending"), ("digest", "ascending"), ("doc_id", "ascending")])
        keys = list(zip(group.column("place").to_pylist(), group.column("digest").to_pylist()))
        sizes, times = group.column("size").to_pylist(), group.column("rows").to_pylist()
        done, _ = pivot(
            group.column("fraction").to_pylist(), [float(size * n) for size, n in zip(sizes, times)],
            lambda a, b: chance(SEED, level, *keys[a], *keys[b]),
        )
        at = group.schema.get_field_index("fraction")
        return group.set_column(at, "fraction", pa.array(done, pa.float64()))

    return rows.groupBy("source", "bucket").applyInArrow(run, rows.schema)


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, size, rows, source_size, target, copies) for each unit.

    Deterministic: groups and draws come from hashes of the rows. Each source's words differ
    from its target by less than its last residual document. Null sources are a source; null
    or empty texts have size 0 and are taken target / source size times, rounded down.
    """
    found = durable(units(docs), "mix-units")
    sizes = found.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_units")
    )
    shares = durable(targets(sizes), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(copies, F.lit(float(MOST_COPIES)))
    place = F.xxhash64("doc_id", "digest", F.lit(SEED))
    joined = found.join(
        shares.withColumnRenamed("source", "named"), same(F.col("source"), F.col("named"))
    ).select(
        "doc_id", "source", "digest", "size", "rows", "source_size", "target",
        F.floor(copies + 1e-12).cast("int").alias("whole"),
        F.greatest(copies - F.floor(copies + 1e-12), F.lit(0.0)).alias("fraction"),
        place.alias("place"),
        F.pmod(place, F.ceil(F.col("n_units") / GROUP_ROWS)).cast("long").alias("bucket"),
    )
    most = shares.agg(F.max("n_units")).first()[0] or 0
    settled, level = [], 0
    rows = joined
    while True:
        rounded = durable(_round_groups(rows, level), f"mix-level{level}")
        between = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        settled.append(rounded.where(~between))
        rest = rounded.where(between)
        most = -(-most // GROUP_ROWS)
        level += 1
        if most <= 1:
            draw = F.pmod(F.xxhash64("place", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
            settled.append(rest.withColumn("fraction", F.when(draw < F.col("fraction"), 1.0).otherwise(0.0)))
            break
        rows = rest.withColumn("bucket", F.floor(F.col("bucket") / GROUP_ROWS).cast("long"))
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        "doc_id", "source", "digest", "size", "rows", "source_size", "target",
        (F.col("whole") + F.col("fraction").cast("int")).alias("copies"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """All columns of docs; each row is repeated as often as the mix takes it, or left out."""
    digest = free_name(docs, "mix_digest")
    named = docs.withColumn(digest, F.md5(F.col("text").cast("string")))
    names = {name: free_name(named, f"unit_{name}") for name in ("doc_id", "source", "digest", "copies")}
    chosen = decisions(docs).where("copies > 0").select(*[F.col(name).alias(new) for name, new in names.items()])
    on = (
        same(F.col("doc_id"), F.col(names["doc_id"])) & same(F.col("source"), F.col(names["source"]))
        & same(F.col(digest), F.col(names["digest"]))
    )
    taken = named.join(chosen, on)
    copy = free_name(taken, "unit_copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(
        *[F.col(f"`{name}`") for name in docs.columns]
    )
