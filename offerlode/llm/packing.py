"""Mixture-controlled packing: deficit round-robin over the queues of the sources.

Every document becomes token ids and a place in its source's queue. The sequence of all windows
is cut into spans. What a span takes of each queue follows from running totals alone, rounded
so that no source is ever a token off its share; that is the deficit carried from one span, and
from one task, to the next. Inside a span the queues are served in turn: each window adds its
share to a queue's deficit counter, a queue sends documents while the counter pays for them,
cuts one when the counter is at least a quantum, and what is not spent stays for the next window.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from offerlode.llm.common import durable, same, small
from offerlode.llm.running import before
from offerlode.llm.vectors import sorted_groups

WINDOW = 4096
#: A queue that can't finish a document sends a part of it once its deficit is so many tokens.
QUANTUM = 256
#: Windows of a span, which one task fills.
SPAN_WINDOWS = 64
CLOSING_ID = 2
#: Words and pieces of words that a worker knows, in one table.
CACHE_WORDS = 690_000
#: New pieces that are encoded in one call.
CALL_WORDS = 4000
#: Texts whose new words are learnt together.
CALL_TEXTS = 32
#: Python's split takes these for blanks, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORD_END = "</w>"
#: What no plain text has: controls, characters beyond Latin letters and signs, and the one
#: letter among those that is two characters in lower case.
UNPLAIN = re.compile("[^\t-\r\x20-\u012f\u0131-\u017f]")
SPECIAL = "<|"


class Coder:
    """Ids of texts, word by word: the tokenizer never joins what blanks separate.

    A plain text is lower-cased whole, as the tokenizer would. Its new words are cut into the
    tokenizer's own pieces here, and pieces that are new are encoded many at a time, without
    normaliser and without the tokenizer's own cache. Words of other texts, and all words if the
    tokenizer doesn't work that way, go through the whole tokenizer.
    """

    def __init__(self, path: str | None):
        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        #: Ids of words, and of pieces, which are words of one piece.
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.pattern = _piece_pattern(model)
        if self.pattern:
            merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["model"]["merges"]]
            self.plain = Tokenizer(models.BPE(
                model["model"]["vocab"], merges, end_of_word_suffix=WORD_END, cache_capacity=0))
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[rank for token, rank in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _is_plain(self, text: str) -> bool:
        return self.pattern is not None and SPECIAL not in text and not UNPLAIN.search(text)

    def _cut(self, word: str) -> list[str]:
        # One sign or digit behind letters is a piece of its own.
        return [word[:-1], word[-1]] if word[:-1].isalpha() else self.pattern.findall(word)

    def _learn(self, words: set[str]) -> None:
        """Words of plain texts, in lower case."""
        known = self.known
        parted = {word: self._cut(word) for word in words if not word.isalpha()}
        new = list(words.difference(parted).union(*parted.values()).difference(known))
        for first in range(0, len(new), CALL_WORDS):
            some = new[first:first + CALL_WORDS]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.type)
            cuts = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
            packed = ids.tobytes()
            known.update((piece, packed[begin:end]) for piece, begin, end in zip(some, [0, *cuts[:-1]], cuts, strict=True))
        for word, pieces in parted.items():
            if word not in known:
                known[word] = b"".join([known[piece] for piece in pieces])

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of this vocabulary's width."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return [ids for first in range(0, len(texts), CALL_TEXTS) for ids in self._packed(texts[first:first + CALL_TEXTS])]

    def _packed(self, texts: list[str]) -> list[bytes]:
        known, ids_of = self.known, self.known.get
        rows, gaps, plain, other = [], [], set(), set()
        for text in texts:
            # A text's words are looked up while they are at hand; only new ones are kept.
            easy = self._is_plain(text)
            words = text.lower().split() if easy else text.split(" ") if SEPARATORS.search(text) else text.split()
            row = list(map(ids_of, words))
            new = [at for at, ids in enumerate(row) if ids is None]
            names = [words[at] for at in new]
            (plain if easy else other).update(names)
            rows.append(row)
            gaps.append((new, names))
        self._learn(plain)
        for word in other.difference(known):
            known[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.type).tobytes()
        for row, (new, names) in zip(rows, gaps):
            for at, word in zip(new, names):
                row[at] = known[word]
        return [b"".join(row) for row in rows]


def _piece_pattern(model: dict) -> regex.Pattern | None:
    """The pattern of pieces, if the tokenizer lower-cases and cuts the way Coder does."""
    cuts = (model["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [step["type"] for step in (model["normalizer"] or {}).get("normalizers", [])]
    if kinds != ["NFC", "Replace", "Lowercase"] or [cut["type"] for cut in cuts] != ["Split", "ByteLevel"]:
        return None
    if model["model"].get("end_of_word_suffix") != WORD_END or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"]:
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"])


@lru_cache(maxsize=2)
def coder(path: str | None) -> Coder:
    """One coder for each Python worker and vocabulary."""
    return Coder(path)


def token_queues(docs: DataFrame, path: str | None = None, closing: int = CLOSING_ID) -> DataFrame:
    """(doc_id, source, n, ids, width, task, before) of every row, written to the shared folder.

    ids are those of the whole text, without special tokens, and the closing id; width is their
    size in bytes; before counts the tokens of the same source earlier in the same task, so that
    places in a queue follow from one sum for each task and source.
    """

    def run(batches):
        code, task = coder(path), TaskContext.get().partitionId()
        end, width = np.array([closing], code.type).tobytes(), np.dtype(code.type).itemsize
        ahead: dict[str | None, int] = {}
        for batch in small(batches):
            sources = batch.column(1).to_pylist()
            ids = [found + end for found in code.packed([text or "" for text in batch.column(2).to_pylist()])]
            sizes = [len(found) // width for found in ids]
            starts = []
            for source, size in zip(sources, sizes):
                starts.append(ahead.get(source, 0))
                ahead[source] = starts[-1] + size
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([width] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(starts, pa.int64())],
                ["doc_id", "source", "n", "ids", "width", "task", "before"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return durable(slim.mapInArrow(
        run, "doc_id long, source string, n long, ids binary, width int, task int, before long"
    ), "token-queues")


def _queued(totals: DataFrame, size: str, part: str, tokens: int) -> DataFrame:
    """(source, size, and for the part: its ahead, own, shift and all), one row a source.

    A queue has own tokens, ahead more in queues before it, and the source begins shift tokens
    into it. Sources that would be due less than a token a span are put before the largest one,
    in its queue; every other source has its own.
    """
    every, largest = totals.agg(F.coalesce(F.sum(size), F.lit(0)), F.max(F.struct(size, "source"))).first()
    spans = -(-every // tokens)
    apart = (F.col(size) >= spans) & ~F.col("source").eqNullSafe(F.lit(largest and largest["source"]))
    marked = durable(totals.withColumn("apart", apart), "queue-totals")
    pool = marked.where("not apart").agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    start = before(marked, [], ["apart", "source"], size, "start")
    return start.select(
        *totals.columns, F.when(F.col("apart"), F.col("start")).otherwise(0).cast("long").alias(f"ahead{part}"),
        F.when(F.col("apart"), F.col(size)).otherwise(pool).cast("long").alias(f"own{part}"),
        F.when(F.col("apart"), 0).otherwise(F.col("start")).cast("long").alias(f"shift{part}"),
        F.lit(every).cast("long").alias(f"all{part}"),
    )


def shares(queues: DataFrame, window: int, weights: dict[str | None, float] | None) -> DataFrame:
    """(source, mixed, rest, and what _queued adds for parts 0 and 1), one row a source.

    mixed tokens of a source go into the windows that follow the weights, which end when the
    first weighted source runs out; the rest follows in the proportions that are left. Without
    weights the sources' own sizes are the weights, and nothing is left.
    """
    totals = queues.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        parted = totals.select("source", F.col("tokens").alias("mixed"), F.lit(0).cast("long").alias("rest"))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
        weighed = totals.withColumn("weight", weight)
        level, whole = weighed.where("weight > 0").agg(F.min(F.col("tokens") / F.col("weight")), F.sum("weight")).first()
        # Whole windows only, so that hardly any token is padded where the two parts meet.
        level = (level or 0.0) * (whole or 0.0) // window * window / (whole or 1.0)
        mixed = F.least(F.round(F.col("weight") * F.lit(level)).cast("long"), F.col("tokens"))
        parted = weighed.select("source", mixed.alias("mixed"), (F.col("tokens") - mixed).alias("rest"))
    tokens = window * SPAN_WINDOWS
    return durable(_queued(_queued(durable(parted, "queue-parts"), "mixed", "0", tokens), "rest", "1", tokens), "queue-shares")


def span_cuts(place: int, size: int, earlier: int, own: int, every: int, tokens: int):
    """(span, first, size) for a stretch of a queue, first counting from the stretch's start.

    By the end of span k a queue has given floor(e * (earlier + own) / every) less
    floor(e * earlier / every) tokens, e being the tokens of k + 1 spans. That never falls if
    the queue is due a token a span, and adds up to whole spans over all queues.
    """
    def given(spans: int) -> int:
        done = min(spans * tokens, every)
        return done * (earlier + own) // every - done * earlier // every

    span, first = place * every // (own * tokens), 0
    while span and given(span) > place:
        span -= 1
    while size > first:
        while given(span + 1) <= place + first:
            span += 1
        part = min(size - first, given(span + 1) - place - first)
        yield span, first, part
        first += part


def _dealt(queues: DataFrame, placed: DataFrame, window: int) -> DataFrame:
    """Rows (span, queue, place, ...) of every queue's stretch in every span."""
    tokens = window * SPAN_WINDOWS

    columns = ["doc_id", "n", "width", "place", "mixed", "ids", *[f"{name}{part}" for part in (0, 1) for name in ("ahead", "own", "shift", "all")]]

    def run(batches):
        for batch in small(batches):
            rows = []
            for doc, n, width, place, mixed, ids, *parts in zip(*(batch.column(name).to_pylist() for name in columns)):
                inside = min(max(mixed - place, 0), n)
                for part, begin, size in ((0, 0, inside), (1, inside, n - inside)):
                    if not size:
                        continue
                    ahead, own, shift, every = parts[4 * part:4 * part + 4]
                    at = shift + place + begin - mixed * part
                    for span, first, length in span_cuts(at, size, ahead, own, every, tokens):
                        start = begin + first
                        rows.append((part, span, ahead, at + first, doc, start, length, n, width, ids[start * width:(start + length) * width]))
            made = list(zip(*rows)) or [()] * 10
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(made, (
                    pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                ["part", "span", "queue", "place", "doc_id", "start", "size", "doc_tokens", "width", "ids"],
            )

    on = (F.col("task") == F.col("of_task")) & same(F.col("source"), F.col("of_source"))
    return queues.join(placed, on).withColumn("place", F.col("base") + F.col("before")).mapInArrow(
        run, "part int, span long, queue long, place long, doc_id long, start long, size long, doc_tokens long, "
        "width int, ids binary"
    )


def fill(queues: list[list[int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Deficit round-robin: (queue, item, tokens, window, offset) from the sizes in each queue.

    Deficits are whole numbers, in tokens times the sum of all sizes. The last window may be
    short; every other one is full.
    """
    shares = [sum(sizes) for sizes in queues]
    every = sum(shares)
    deficit = [0] * len(queues)
    item, left = [0] * len(queues), [sizes[0] if sizes else 0 for sizes in queues]
    out = []
    for at in range(-(-every // window)):
        room = full = min(window, every - at * window)

        def send(queue: int, amount: int) -> None:
            nonlocal room
            out.append((queue, item[queue], amount, at, full - room))
            room -= amount
            deficit[queue] -= amount * every
            left[queue] -= amount
            if not left[queue]:
                item[queue] += 1
                left[queue] = queues[queue][item[queue]] if item[queue] < len(queues[queue]) else 0

        for queue, share in enumerate(shares):
            deficit[queue] += full * share
        for turn in range(len(queues)):
            queue = (at + turn) % len(queues)
            while room and left[queue]:
                due = deficit[queue] // every
                if left[queue] <= due:
                    send(queue, min(left[queue], room))
                elif due >= QUANTUM:
                    send(queue, min(due, room))
                else:
                    break
        while room:
            queue = max((q for q in range(len(queues)) if left[q]), key=lambda q: (deficit[q], -q))
            send(queue, min(left[queue], room, max(deficit[queue] // every, 0) + QUANTUM))
    return out


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW,
         weights: dict[str | None, float] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue) of pieces.

    Every id of every row's whole text, and a closing id, lies in exactly one piece. All windows
    but the last are full (with weights, also that where the weighted part ends, if it can't be
    cut even). In each window a source's tokens come within about two quanta of its share, and
    over any run of windows as well, because deficits carry. Null and empty texts are one closing
    id. A null source counts as one source; queue tells the
    sources' queues apart. Rows with one doc_id are packed row by row. An empty
    table gives no rows; other columns are ignored. Order within a queue is that of the input's
    files; reruns over the same files agree.
    """
    queues = token_queues(docs, path)
    along = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = queues.groupBy("source", "task").agg(F.sum("n").alias("sent"))
    bases = tasks.select("source", F.col("task").alias("of_task"), F.coalesce(F.sum("sent").over(along), F.lit(0)).cast("long").alias("base"))
    named = shares(queues, window, weights).withColumnRenamed("source", "of_source")
    placed = durable(bases.join(named, same(F.col("source"), F.col("of_source"))).drop("source"), "queue-places")
    first = -(-(placed.agg(F.max("all0")).first()[0] or 0) // window)
    keys = ["part", "span"]

    def run(batches):
        for group in sorted_groups(batches, keys):
            part, span, width = (group.column(name)[0].as_py() for name in ("part", "span", "width"))
            ranks = group.column("queue").to_numpy()
            edges = np.flatnonzero(np.diff(ranks, prepend=ranks[0] - 1)).tolist()
            sizes = group.column("size").to_pylist()
            queued = [sizes[a:b] for a, b in zip(edges, [*edges[1:], len(sizes)])]
            ids, starts = group.column("ids").to_pylist(), group.column("start").to_pylist()
            docs_of, tokens_of, queue_of = (group.column(name).to_pylist() for name in ("doc_id", "doc_tokens", "queue"))
            sent: dict[int, int] = {}
            pieces = []
            for queue, item, amount, at, offset in fill(queued, window):
                row = edges[queue] + item
                done = sent.get(row, 0)
                sent[row] = done + amount
                piece = np.frombuffer(ids[row], f"<u{width}", amount, done * width).astype("<u4")
                pieces.append((
                    docs_of[row], starts[row] + done, amount, zlib.crc32(piece), tokens_of[row],
                    first * part + span * SPAN_WINDOWS + at, offset, queue_of[row],
                ))
            made = list(zip(*pieces))
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in made], PIECE)

    dealt = _dealt(queues, placed, window).repartition(*keys).sortWithinPartitions(*keys, "queue", "place")
    return dealt.mapInArrow(run, ", ".join(f"{name} long" for name in PIECE))


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
