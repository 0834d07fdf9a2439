"""A z-fast trie of conversations, built in batches by joins.

A conversation is a string of turns. Its prefixes are named by 128 bits, the exclusive or of a
hash of every turn and its place, so that a name at any depth is a running aggregate. The trie
is compacted: a node is a prefix where a conversation ends or where two go different ways, and
stands for the edge from its parent's depth down to its own. It is found by its handle, the name
at the two-fattest depth of that edge. A batch of conversations is located by fat binary search:
each round looks up the two-fattest depth that is left, so a conversation of n turns takes about
log n joins with the handles instead of n. Where it leaves the trie, inside an edge, that edge
is split; what lies below becomes new nodes. At the end the edges are expanded to one row a turn.

Long conversations are held in blocks of BLOCK prefixes. Rounds at multiples of BLOCK come first,
as those depths are the fattest; from then on a search stays inside one block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlode.llm.common import durable, sha256_hex
from offerlode.llm.mixing import word_count
from offerlode.llm.running import before
from offerlode.llm.vectors import sorted_groups

BLOCK = 1024
#: Batch k holds about GROWTH times the conversations of all batches before it.
BATCHES = 2
GROWTH = 7
#: Rounds of a search between two tables in the shared folder; finished rows leave there.
ROUNDS = 3
#: Ids of a chunk of one group of equal conversations.
CHUNK_IDS = 10_000
FAMILY, HEAD = 20, 4


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, i, key, words): the turns of each conversation, numbered from 1.

    Order is by turn, null first, then role and text; null roles and texts are empty; repeated
    rows are turns of their own. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    base = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"),
    )
    base = base.select("*", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("key"),
                       word_count(F.col("text")).alias("words"))
    placed = before(base, ["conv_id"], ["turn", "role", "text"], "one", "i")
    return placed.select("conv_id", (F.col("i") + 1).alias("i"), "key", "words")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """(conv_id, d, key, words): each conversation behind the head of its family's first one.

    The first crc32(conv_id) % 4 turns are those of conversation conv_id - conv_id % 20, as far
    as it has them; the conversation's own turns after as many of its first follow.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    lengths = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    firsts = lengths.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first_id"), F.col("n").alias("there"))
    heads = lengths.select("conv_id", first.alias("first"), head.alias("head")).join(
        firsts, F.col("first") == F.col("first_id"), "left"
    ).select("conv_id", "first", "head", F.least("head", F.coalesce("there", F.lit(0))).alias("taken"))
    given = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") < HEAD)).select(
        F.col("conv_id").alias("giver"), F.col("i").alias("d"), "key", "words"
    )
    taken = heads.join(given, (F.col("first") == F.col("giver")) & (F.col("d") <= F.col("head"))).select("conv_id", "d", "key", "words")
    missing = heads.where("taken < head").select(F.col("conv_id").alias("short_id"), (F.col("head") - F.col("taken")).alias("gap"))
    own = numbered.where(F.col("i") > head).join(missing, F.col("conv_id") == F.col("short_id"), "left").select(
        "conv_id", (F.col("i") - F.coalesce("gap", F.lit(0))).alias("d"), "key", "words"
    )
    # A row without text for every conversation, so that those without turns are kept.
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("words"))
    return taken.unionByName(own).unionByName(roots)


def classes(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations: (rep, size, n, e1, e2, all_words), and all ends (conv_id, size, e1, e2)."""
    ends = durable(hashed.groupBy("conv_id").agg(
        F.max("d").alias("size"), F.bit_xor("h1").alias("e1"), F.bit_xor("h2").alias("e2"), F.sum("words").alias("all_words")
    ), "trie-ends")
    grouped = ends.groupBy("size", "e1", "e2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min("all_words").alias("all_words"))
    return durable(grouped, "trie-classes"), ends


def hashed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, d, h1, h2, words): the terms of the running names; depth 0 adds nothing."""
    def term(seed: int) -> Column:
        return F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), "key", "d")).otherwise(F.lit(0).cast("long"))

    return durable(turns.select("conv_id", "d", term(1).alias("h1"), term(2).alias("h2"), "words"), "trie-turns")


def packed_prefixes(hashed: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """(rep, block, p1, p2, w, s1, s2, sw): names and word totals of a block's prefixes, in
    arrays, and those just before the block. One row a conversation, or a block of a long one."""
    at = F.floor((F.col("d") - 1) / block).cast("long")
    rows = hashed.where("d > 0").join(reps.select(F.col("rep").alias("conv_rep")), F.col("conv_id") == F.col("conv_rep"), "left_semi")
    rows = rows.withColumn("block", at)
    inside = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(
        "conv_id", "block", "d", F.bit_xor("h1").over(inside).alias("p1"), F.bit_xor("h2").over(inside).alias("p2"),
        F.sum("words").over(inside).alias("w"),
    )
    packs = summed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("d", "p1", "p2", "w"))).alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("rows", -1)
    packs = packs.select(
        F.col("conv_id").alias("rep"), "block", "rows", *[
            F.coalesce(add(last[name]).over(earlier), F.lit(0).cast("long")).alias(to)
            for add, name, to in ((F.bit_xor, "p1", "s1"), (F.bit_xor, "p2", "s2"), (F.sum, "w", "sw"))
        ],
    )
    return durable(packs.select(
        "rep", "block", F.transform("rows", lambda r: r["p1"].bitwiseXOR(F.col("s1"))).alias("p1"),
        F.transform("rows", lambda r: r["p2"].bitwiseXOR(F.col("s2"))).alias("p2"),
        F.transform("rows", lambda r: r["w"] + F.col("sw")).alias("w"), "s1", "s2", "sw",
    ), "trie-prefixes")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides; null if there is none."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    power = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return F.when(low < high, high - F.pmod(high, power))


NODE = ["x1", "x2", "depth", "rep", "above", "q1", "q2", "handle", "f1", "f2", "n1", "n2"]


class Trie:
    """The nodes of a z-fast trie, and the prefixes of the conversations in it.

    nodes: (x1, x2) name the node's prefix, depth is its length, rep a conversation through it,
    above the parent's depth and (q1, q2) its name, (f1, f2) the name at depth handle, (n1, n2)
    that one turn below the parent. The root has no row; its depth is 0 and its name (0, 0).
    """

    def __init__(self, prefixes: DataFrame, block: int = BLOCK):
        self.prefixes, self.block, self.nodes = prefixes, block, None

    def _block(self, depth: Column) -> Column:
        return F.floor((F.greatest(depth, F.lit(1)) - 1) / self.block).cast("long")

    def looked_up(self, frame: DataFrame, keys: list[str], depths: dict[str, Column]) -> DataFrame:
        """frame (with keys that tell its rows apart and rep) and, for each entry name: depth,
        the columns name1, name2: the name of rep's prefix of that depth."""
        asked = F.explode(F.array(*[F.struct(F.lit(name).alias("what"), depth.alias("at")) for name, depth in depths.items()]))
        rows = frame.select(*keys, F.col("rep").alias("ask_rep"), asked.alias("ask")).select(
            *keys, "ask_rep", "ask.what", "ask.at", self._block(F.col("ask.at")).alias("ask_block")
        )
        kept = self.prefixes.select(F.col("rep").alias("held_rep"), F.col("block").alias("held_block"), "p1", "p2", "s1", "s2")
        found = rows.join(kept, (F.col("ask_rep") == F.col("held_rep")) & (F.col("ask_block") == F.col("held_block")), "left")
        index = (F.col("at") - F.col("ask_block") * self.block).cast("int")
        values = found.select(*keys, "what", *[
            F.when(F.col("at") == 0, F.lit(0).cast("long")).when(index == 0, F.col(f"s{side}"))
            .otherwise(F.get(f"p{side}", index - 1)).alias(f"v{side}") for side in (1, 2)
        ])
        wide = values.groupBy(*keys).agg(*[
            F.max(F.when(F.col("what") == name, F.col(f"v{side}"))).alias(f"{name}{side}") for name in depths for side in (1, 2)
        ])
        return frame.join(wide, keys)

    def locate(self, batch: DataFrame) -> DataFrame:
        """(rep, size, m, s1, s2, and of the edge it leaves, or null: ex1, ex2, to, erep, ea, eq1, eq2).

        m is how many turns the trie shares with the conversation, (s1, s2) their name.
        """
        empty = [F.lit(None).cast("long").alias(name) for name in ("ex1", "ex2", "to", "erep", "ea", "eq1", "eq2")]
        state = batch.select("rep", "size", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"), *empty)
        if self.nodes is None:
            zero = [F.lit(0).cast("long").alias(name) for name in ("s1", "s2")]
            return durable(state.select("rep", "size", F.col("low").alias("m"), *zero, "ex1", "ex2", "to", "erep", "ea", "eq1", "eq2"), "trie-located")
        # Depths at multiples of the block first: a lookup each, for conversations that are so long.
        steps = int(batch.agg(F.max("size")).first()[0] or 0)
        for _ in range((steps // self.block).bit_length()):
            state = durable(self._far_round(state), "trie-far")
        inside = self._block(F.col("low") + 1)
        joined = state.join(
            self.prefixes.select(F.col("rep").alias("own"), "block", "p1", "p2"),
            (F.col("rep") == F.col("own")) & (inside == F.col("block")), "left",
        ).drop("own")
        done, active = [], joined
        rounds = min(steps, self.block).bit_length()
        while True:
            for _ in range(min(ROUNDS, rounds)):
                active = self._near_round(active)
            rounds -= ROUNDS
            active = durable(active, "trie-search")
            if rounds <= 0:
                done.append(active)
                break
            done.append(active.where("low >= high"))
            active = active.where("low < high")
        found = done[0]
        for part in done[1:]:
            found = found.unionByName(part)
        return durable(self._matched(self._children(found)), "trie-located")

    def _probe(self, state: DataFrame, f: Column, one: Column, two: Column) -> DataFrame:
        """state joined with the node whose handle is asked for; rows that ask nothing spread."""
        nodes = self.nodes.select(*[F.col(name).alias(f"at_{name}") for name in ("x1", "x2", "depth", "rep", "above", "q1", "q2", "handle", "f1", "f2")])
        state = state.withColumn("f", F.coalesce(f, F.lit(-1)))
        asking = F.col("f") > 0
        state = state.withColumn("k1", F.when(asking, one).otherwise(F.xxhash64("rep"))).withColumn("k2", F.when(asking, two).otherwise(F.col("rep")))
        return state.join(nodes, (F.col("k1") == F.col("at_f1")) & (F.col("k2") == F.col("at_f2")) & (F.col("f") == F.col("at_handle")), "left")

    @staticmethod
    def _narrowed(state: DataFrame, fits: Column) -> DataFrame:
        """Where the handle is unknown the search ends above it; where its node is a prefix of
        the conversation it goes on below; else the node's edge is where it leaves the trie."""
        found, asked = F.col("at_depth").isNotNull(), F.col("f") > 0
        left = found & ~F.coalesce(fits, F.lit(False))
        low = F.when(left, F.col("at_above")).when(found, F.col("at_depth")).otherwise(F.col("low"))
        high = F.when(left, F.col("at_above")).when(found, F.col("high")).when(asked, F.col("f") - 1).otherwise(F.col("high"))
        edge = {"ex1": "at_x1", "ex2": "at_x2", "to": "at_depth", "erep": "at_rep", "ea": "at_above", "eq1": "at_q1", "eq2": "at_q2"}
        # A node that fits is no exit, and earlier rounds have none as long as the search goes on.
        made = state.withColumns({name: F.when(left, F.col(source)).otherwise(F.col(name)) for name, source in edge.items()} | {
            "new_low": low, "new_high": high})
        gone = [name for name in made.columns if name.startswith("at_")] + ["f", "k1", "k2", "low", "high"]
        return made.drop(*gone).withColumnsRenamed({"new_low": "low", "new_high": "high"})

    def _near_round(self, state: DataFrame) -> DataFrame:
        start = F.col("block") * self.block
        f = fattest(F.col("low"), F.col("high"))

        def name(side: int, depth: Column) -> Column:
            return F.get(f"p{side}", (depth - start - 1).cast("int"))

        probed = self._probe(state, f, name(1, f), name(2, f))
        fits = (F.col("at_depth") <= F.col("size")) & (name(1, F.col("at_depth")) == F.col("at_x1")) & (name(2, F.col("at_depth")) == F.col("at_x2"))
        return self._narrowed(probed, fits)

    def _far_round(self, state: DataFrame) -> DataFrame:
        f = fattest(F.col("low"), F.col("high"))
        asked = state.withColumn("f0", F.when(F.pmod(f, F.lit(self.block)) == 0, f))
        named = self.looked_up(asked, ["rep"], {"g": F.coalesce("f0", F.lit(0).cast("long"))})
        probed = self._probe(named, F.col("f0"), F.col("g1"), F.col("g2"))
        ended = self.looked_up(probed, ["rep"], {"z": F.least(F.coalesce("at_depth", F.lit(0).cast("long")), F.col("size"))})
        fits = (F.col("at_depth") <= F.col("size")) & (F.col("z1") == F.col("at_x1")) & (F.col("z2") == F.col("at_x2"))
        return self._narrowed(ended, fits).drop("f0", "g1", "g2", "z1", "z2")

    def _children(self, state: DataFrame) -> DataFrame:
        """The edge below the last node found, for searches that ended there."""
        nodes = self.nodes.select(*[F.col(name).alias(f"c_{name}") for name in ("x1", "x2", "depth", "rep", "above", "q1", "q2", "n1", "n2")])
        open_end = F.col("to").isNull() & (F.col("low") < F.col("size"))
        at = (F.col("low") - F.col("block") * self.block).cast("int")
        spread = [F.xxhash64("rep"), F.col("rep")]
        for side in (1, 2):
            state = state.withColumn(f"k{side}", F.when(open_end, F.get(f"p{side}", at)).otherwise(spread[side - 1]))
        joined = state.join(nodes, (F.col("k1") == F.col("c_n1")) & (F.col("k2") == F.col("c_n2")) & (F.col("low") == F.col("c_above")), "left")
        edge = {"ex1": "c_x1", "ex2": "c_x2", "to": "c_depth", "erep": "c_rep", "ea": "c_above", "eq1": "c_q1", "eq2": "c_q2"}
        return joined.select("rep", "size", "low", *[F.coalesce(name, source).alias(name) for name, source in edge.items()])

    def _matched(self, state: DataFrame) -> DataFrame:
        """How far each conversation follows its edge: blocks of both are compared."""
        first, last = self._block(F.col("low") + 1), self._block(F.least("to", "size"))
        pieces = state.where("to is not null").select(
            "rep", "erep", "to", first.alias("first"), F.explode(F.sequence(first, last)).alias("block")
        )
        side = self.prefixes.select("rep", "block", "p1", "p2")
        both = pieces.join(side, ["rep", "block"]).join(
            side.select(F.col("rep").alias("erep"), "block", F.col("p1").alias("o1"), F.col("p2").alias("o2")), ["erep", "block"]
        )
        equal = F.zip_with(
            F.zip_with("p1", "o1", lambda a, b: a == b), F.zip_with("p2", "o2", lambda a, b: a == b), lambda a, b: a & b
        )
        counted = both.groupBy("rep").agg(
            (F.min("first") * self.block + F.sum(F.size(F.filter(equal, lambda same: same)))).cast("long").alias("reach")
        )
        reached = state.join(counted, "rep", "left").withColumn("m", F.coalesce("reach", "low"))
        named = self.looked_up(reached, ["rep"], {"s": F.col("m")})
        return named.select("rep", "size", "m", "s1", "s2", "ex1", "ex2", "to", "erep", "ea", "eq1", "eq2")

    def insert(self, batch: DataFrame) -> None:
        """Add the conversations (rep, size, e1, e2), which are all different and not yet in it."""
        located = self.locate(batch)
        mine = self.prefixes.join(located.select("rep", "size", "m"), "rep")
        first = F.greatest(F.col("m"), F.col("block") * self.block) + 1
        last = F.col("block") * self.block + F.size("p1")
        index = F.col("d") - F.col("block") * self.block

        def at(side: int, place: Column) -> Column:
            place = place.cast("int")
            return F.when(place == 0, F.col(f"s{side}")).otherwise(F.get(f"p{side}", place - 1))

        below = durable(
            mine.where(first <= last).withColumn("d", F.explode(F.sequence(first, last)))
            .select("rep", "m", "d", *[at(side, index).alias(f"x{side}") for side in (1, 2)],
                    *[at(side, index - 1).alias(f"o{side}") for side in (1, 2)]), "trie-below",
        )
        ends = batch.join(located.select(F.col("rep").alias("of"), "m"), F.col("rep") == F.col("of")).where("size > m").select(
            F.col("e1").alias("x1"), F.col("e2").alias("x2"), F.col("size").alias("depth"), "rep"
        )
        branches = below.where("d > m + 1").groupBy("o1", "o2").agg(
            F.min("d").alias("next"), F.min("rep").alias("rep"), *[f(f"x{side}").alias(f"{f.__name__}{side}") for f in (F.min, F.max) for side in (1, 2)]
        ).where("min1 != max1 or min2 != max2").select(
            F.col("o1").alias("x1"), F.col("o2").alias("x2"), (F.col("next") - 1).alias("depth"), "rep"
        )
        fresh = durable(ends.union(branches).groupBy("x1", "x2").agg(F.min("depth").alias("depth"), F.min("rep").alias("rep")), "trie-fresh")
        # Nodes on one conversation's new part: as many as it has places where others part from it,
        # each of which has as many turns, so they stay under the root of twice all turns.
        line = Window.partitionBy("line").orderBy("d")
        on_line = below.select(F.col("rep").alias("line"), "d", "m", F.col("x1").alias("l1"), F.col("x2").alias("l2")).join(
            fresh, (F.col("l1") == F.col("x1")) & (F.col("l2") == F.col("x2"))
        ).withColumns({"pd": F.lag("d").over(line), "p1": F.lag("x1").over(line), "p2": F.lag("x2").over(line)}).where("line = rep")
        roots = located.select(F.col("rep").alias("of"), "s1", "s2")
        lower = on_line.join(roots, F.col("line") == F.col("of")).select(
            "x1", "x2", "depth", "rep", F.coalesce("pd", "m").alias("above"), F.coalesce("p1", "s1").alias("q1"), F.coalesce("p2", "s2").alias("q2")
        )
        changed = lower
        if self.nodes is not None:
            split = located.where("to is not null")
            points = split.groupBy("ex1", "ex2", "s1", "s2").agg(
                F.min("m").alias("depth"), F.min("rep").alias("rep"), *[F.min(name).alias(name) for name in ("ea", "eq1", "eq2")]
            ).select("ex1", "ex2", F.col("s1").alias("x1"), F.col("s2").alias("x2"), "depth", "rep", "ea", "eq1", "eq2")
            tips = split.groupBy("ex1", "ex2").agg(*[F.min(name).alias(name) for name in ("to", "erep", "ea", "eq1", "eq2")]).select(
                "ex1", "ex2", F.col("ex1").alias("x1"), F.col("ex2").alias("x2"), F.col("to").alias("depth"), F.col("erep").alias("rep"), "ea", "eq1", "eq2"
            )
            edge = Window.partitionBy("ex1", "ex2").orderBy("depth")
            upper = points.unionByName(tips).select(
                "x1", "x2", "depth", "rep", F.coalesce(F.lag("depth").over(edge), "ea").alias("above"),
                F.coalesce(F.lag("x1").over(edge), "eq1").alias("q1"), F.coalesce(F.lag("x2").over(edge), "eq2").alias("q2"),
            )
            changed = changed.unionByName(upper)
        changed = changed.withColumn("handle", fattest(F.col("above"), F.col("depth")))
        named = self.looked_up(changed, ["x1", "x2"], {"f": F.col("handle"), "n": F.col("above") + 1}).select(*NODE)
        if self.nodes is not None:
            touched = located.where("to is not null").select(F.col("ex1").alias("x1"), F.col("ex2").alias("x2")).distinct()
            named = self.nodes.join(touched, ["x1", "x2"], "left_anti").unionByName(named)
        self.nodes = durable(named, "trie-nodes")


def build(turns: DataFrame, block: int = BLOCK, batches: int = BATCHES) -> tuple[Trie, DataFrame, DataFrame]:
    """The trie of conversations (conv_id, d, key, words), their classes and all ends.

    Equal conversations are one class, the smallest conv_id stands for it. The classes are
    dealt to the batches by hash; the first holds about one in GROWTH ** (batches - 1).
    """
    hashed = hashed_turns(turns)
    grouped, ends = classes(hashed)
    trie = Trie(packed_prefixes(hashed, grouped, block), block)
    ticket = F.pmod(F.xxhash64("rep"), F.lit(GROWTH ** (batches - 1)))
    number = sum((F.when(ticket >= GROWTH**k, 1).otherwise(0) for k in range(batches - 1)), F.lit(0))
    for batch in range(batches):
        trie.insert(grouped.where((number == batch) & (F.col("size") > 0)))
    return trie, grouped, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(y1, y2, ends_sha256): of the conv_ids of equal conversations, ascending, comma-joined.

    A digest can't be put together from parts, so one task reads a group's ids, but as text
    already joined in chunks by the tasks that sorted them.
    """
    keys = ["e1", "e2"]
    rows = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def chunks(batches):
        for batch in batches:
            made = []
            for group in sorted_groups([batch], keys):
                ids = group.column("conv_id").to_pylist()
                e1, e2 = (group.column(key)[0].as_py() for key in keys)
                made += [
                    (e1, e2, ids[start], ",".join(map(str, ids[start:start + CHUNK_IDS]))) for start in range(0, len(ids), CHUNK_IDS)
                ]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*made)], [*keys, "first", "ids"])

    def digest(batches):
        key, running = None, None
        for batch in batches:
            made = []
            for e1, e2, ids in zip(*(batch.column(name).to_pylist() for name in (*keys, "ids"))):
                if key == (e1, e2):
                    running.update(b"," + ids.encode())
                    continue
                if key is not None:
                    made.append((*key, running.hexdigest()))
                key, running = (e1, e2), hashlib.sha256(ids.encode())
            yield _digest_rows(made)
        if key is not None:
            yield _digest_rows([(*key, running.hexdigest())])

    parts = rows.mapInArrow(chunks, "e1 long, e2 long, first long, ids string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, "y1 long, y2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    one, two, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(text, pa.string())], ["y1", "y2", "ends_sha256"])


def node_totals(trie: Trie, grouped: DataFrame) -> DataFrame:
    """Every compacted node and the root with what its subtree holds.

    Each class of conversations walks its own path, so a node's totals are sums over the classes
    through it. A node's edge words count once: on the path of the conversation that stands for it.
    """
    nodes = trie.nodes
    children = nodes.groupBy("q1", "q2").agg(F.count("*").alias("n_children"))
    counted = nodes.join(children.withColumnsRenamed({"q1": "c1", "q2": "c2"}), (F.col("x1") == F.col("c1")) & (F.col("x2") == F.col("c2")), "left").select(
        *NODE, F.coalesce("n_children", F.lit(0)).alias("n_children")
    )
    counted = durable(counted, "trie-counted")
    at_root = counted.where("above = 0").count()
    path = trie.prefixes.select("rep", "block", F.arrays_zip("p1", "p2", "w").alias("rows")).select(
        "rep", F.posexplode("rows").alias("at", "row"), "block"
    ).select(F.col("rep").alias("line"), (F.col("block") * trie.block + F.col("at") + 1).alias("d"), "row.p1", "row.p2", "row.w")
    passed = path.join(
        counted.select("x1", "x2", "rep", "depth", "n_children"), (F.col("p1") == F.col("x1")) & (F.col("p2") == F.col("x2"))
    ).select("line", "d", "w", "x1", "x2", (F.col("rep") == F.col("line")).alias("stands"), "n_children")
    zero = F.lit(0).cast("long")
    roots = grouped.select(F.col("rep").alias("line"), zero.alias("d"), zero.alias("w"), zero.alias("x1"), zero.alias("x2"),
                           F.lit(False).alias("stands"), F.lit(at_root).cast("long").alias("n_children"))
    lines = passed.unionByName(roots).join(grouped.select(F.col("rep").alias("of"), "size", "n", "all_words"), F.col("line") == F.col("of"))
    down = Window.partitionBy("line").orderBy("d")
    whole = Window.partitionBy("line")
    edge = F.when(F.col("stands"), F.col("w") - F.lag("w", 1, 0).over(down)).otherwise(0)
    walked = lines.withColumns({
        "edge": edge, "leaf": F.max(F.when((F.col("d") == F.col("size")) & (F.col("n_children") == 0), 1).otherwise(0)).over(whole),
    }).withColumn("under", F.sum("edge").over(whole) - F.sum("edge").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    totals = walked.groupBy("x1", "x2").agg(
        F.min("line").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        (F.sum(F.col("n") * (F.col("all_words") - F.col("w"))) - F.sum("under")).alias("below"), F.max("w").alias("w_end"),
        F.max("n_children").alias("n_children"), F.max("d").alias("depth"),
    )
    totals = durable(totals, "trie-totals")
    shape = counted.select(F.col("x1").alias("t1"), F.col("x2").alias("t2"), "rep", "above", "q1", "q2")
    parents = totals.select(F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("conv_id").alias("upper_id"))
    return totals.join(shape, (F.col("x1") == F.col("t1")) & (F.col("x2") == F.col("t2")), "left").join(
        parents, (F.col("q1") == F.col("u1")) & (F.col("q2") == F.col("u2")), "left"
    ).drop("t1", "t2", "u1", "u2")


def expanded(trie: Trie, totals: DataFrame, digests: DataFrame) -> DataFrame:
    """One row for each depth of each edge, and the root's."""
    ended = totals.join(digests, (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")), "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(sha256_hex(b"")))
    )
    held = ["conv_id", "depth", "above", "upper_id", "n_convs", "n_children", "n_leaves", "below", "w_end", "ends_sha256"]
    first, last = trie._block(F.col("above") + 1), trie._block(F.col("depth"))
    pieces = ended.where("rep is not null").select(*held, F.col("rep").alias("of"), F.explode(F.sequence(first, last)).alias("part"))
    start = F.col("block") * trie.block
    low, high = F.greatest(F.col("above"), start) + 1, F.least(F.col("depth"), start + F.size("w"))
    rows = pieces.join(trie.prefixes.select("rep", "block", "w", "sw"), (F.col("of") == F.col("rep")) & (F.col("part") == F.col("block")))
    rows = rows.withColumn("d", F.explode(F.sequence(low, high)))
    index = (F.col("d") - start).cast("int")
    ahead = F.when(index == 1, F.col("sw")).otherwise(F.get("w", index - 2))
    tip = F.col("d") == F.col("depth")
    inner = rows.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("above") + 1, F.col("upper_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(tip, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("w_end") - ahead)).alias("saved_tokens"),
        F.when(tip, F.col("ends_sha256")).otherwise(F.lit(sha256_hex(b""))).alias("ends_sha256"),
    )
    root = ended.where("rep is null").select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("below").alias("saved_tokens"), "ends_sha256",
    )
    return inner.unionByName(root).select(
        *[F.col(name).cast("long").alias(name) for name in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        "ends_sha256",
    )


def prefix_trie(turns: DataFrame, block: int = BLOCK, batches: int = BATCHES) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, the textless root included.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Input: (conv_id, turn, role, text); other columns are ignored.
    Conversations without turns are members of the root. An empty table has no root.
    """
    trie, grouped, ends = build(rebuilt(durable(ordered_turns(turns), "trie-numbered")), block, batches)
    return expanded(trie, node_totals(trie, grouped), end_digests(ends))


#: The same rows for DuckDB. A prefix is named by the digests of its turns, end to end.
TRIE_SQL = r"""
with ids as (select distinct conv_id as c from conversations where conv_id is not null),
heads as (
  select c, c - c % 20 as p, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
    list_transform(string_split(cast(c as varchar), ''), lambda s: cast(ascii(s) as bigint))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda a, i: case when a & 1 = 1 then xor(a >> 1, cast(3988292384 as bigint)) else a >> 1 end)), cast(4294967295 as bigint)) % 4 as h
  from ids
), numbered as (
  select conv_id as c, md5(length(role) || ':' || role || text) as key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), sized as (
  select h.c, h.p, h.h, least(h.h, coalesce(n, 0)) as g
  from heads h left join (select c, count(*) as n from numbered group by c) l on h.p = l.c
), rebuilt as (
  select s.c, n.i as d, n.key, n.words from sized s join numbered n on n.c = s.p and n.i <= s.h
  union all select s.c, s.g + n.i - s.h, n.key, n.words from sized s join numbered n on n.c = s.c and n.i > s.h
), member as (
  select c, d, words, string_agg(key, '') over (partition by c order by d rows between unbounded preceding and current row) as path from rebuilt
  union all select c, 0, 0, '' from ids
), node as (
  select path, min(d) as depth, min(c) as conv_id, count(*) as n_convs, max(words) as words,
    case when min(d) > 0 then substr(path, 1, length(path) - 32) end as above from member group by path
), child as (select above, count(*) as n from node where above is not null group by above),
ended as (
  select path, string_agg(cast(c as varchar), ',' order by c) as convs
  from (select c, path from member qualify row_number() over (partition by c order by d desc) = 1) group by path
), subtree as (
  select m.path, count(*) filter (k.n is null) as n_leaves, sum((x.n_convs - 1) * x.words) as saved
  from node x join member m on m.c = x.conv_id and m.d <= x.depth left join child k on k.above = x.path group by m.path
)
select x.conv_id, x.depth, u.conv_id as parent_conv_id, x.n_convs, coalesce(k.n, 0) as n_children,
  t.n_leaves, cast(t.saved as bigint) as saved_tokens, sha256(coalesce(e.convs, '')) as ends_sha256
from node x join subtree t on t.path = x.path left join node u on u.path = x.above
  left join child k on k.above = x.path left join ended e on e.path = x.path
"""
