"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one encoding, and so one last token. The table of last tokens
is filled from left to right: the last token of a prefix is the one vocabulary entry ending
there that stays apart from the last token before it when the two are encoded together. Reading
the table backwards gives the encoding of any prefix. Appending bytes extends the table; an edit
re-encodes from the match it touches until matches fall on old boundaries again.
"""

from __future__ import annotations

import base64
import bisect
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlode.llm.common import release_memory, small

CACHE_PIECES = 250_000
#: Below two thirds of 2^19, beyond which the table doubles.
CACHE_PREFIXES = 340_000
CACHE_PAIRS = 300_000
#: Bytes of a piece up to which it is cached and shares its prefixes with others.
SHORT = 64
TAIL = 4


def load_ranks(path: str | None) -> dict[bytes, int]:
    """Byte strings and their ranks; without a path, those of the public 50k vocabulary."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self._ending: dict[bytes, set[int]] = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self._ending.setdefault(token[-TAIL:], set()).add(len(token))
        #: For the last TAIL bytes of a prefix, the lengths of tokens that may end there.
        self.lengths: dict[bytes, list[int]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding by its definition: join the neighbours of lowest rank, leftmost first."""
        parts = [data[at:at + 1] for at in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, where = None, 0
            for at in range(len(parts) - 1):
                rank = ranks.get(parts[at] + parts[at + 1])
                if rank is not None and (best is None or rank < best):
                    best, where = rank, at
            if best is None:
                break
            parts[where:where + 2] = [parts[where] + parts[where + 1]]
        return [ranks[part] for part in parts]

    def ending(self, tail: bytes) -> list[int]:
        """Lengths of tokens that end in this tail, or are its end, longest first."""
        known = self.lengths.get(tail)
        if known is None:
            found = set(self._ending.get(tail, ())) if len(tail) == TAIL else set()
            found |= {size for size in range(1, len(tail) + 1) if tail[-size:] in self.ranks}
            if len(self.lengths) > 300_000:
                self.lengths.clear()
            known = self.lengths[tail] = sorted(found, reverse=True)
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, encoded together, give these two tokens."""
        pair = (left, right)
        known = self._apart.get(pair)
        if known is None:
            if len(self._apart) > CACHE_PAIRS:
                self._apart.clear()
            joined = self.tokens[left] + self.tokens[right]
            token = self.ranks.get(joined)
            known = (token is None or not self.whole(token)) and self.merged(joined) == [left, right]
            self._apart[pair] = known
        return known

    def last_token(self, data: bytes, end: int, before) -> int:
        """The last token of data[:end]; before(start) is that of data[:start]."""
        for length in self.ending(data[max(0, end - TAIL):end]):
            start = end - length
            token = self.ranks.get(data[start:end]) if start >= 0 else None
            if token is None:
                continue
            if self.apart(before(start), token) if start else self.whole(token):
                return token
        raise ValueError("a byte has no token")

    def whole(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known


class PrefixTable:
    """last[i] is the last token of the encoding of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend by bytes; entries of earlier prefixes never change."""
        v, last = self.vocabulary, self.last
        begin, self.data = len(self.data), self.data + more
        data = self.data
        for end in range(begin + 1, len(data) + 1):
            last.append(v.last_token(data, end, lambda start: last[start - 1]))

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes."""
        end = len(self.last) if end is None else end
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class SharedPrefixes(dict):
    """Last tokens of the prefixes of many short pieces; a piece extends the longest known one."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def encode(self, data: bytes) -> list[int]:
        known, size = len(data), len(data)
        while known and data[:known] not in self:
            known -= 1
        v = self.vocabulary
        rank_of, lengths, known_apart = v.ranks.get, v.lengths.get, v._apart.get
        for end in range(known + 1, size + 1):
            tail = data[end - TAIL:end] if end > TAIL else data[:end]
            for length in lengths(tail) or v.ending(tail):
                token = rank_of(data[end - length:end]) if length <= end else None
                if token is None:
                    continue
                if length == end:
                    fits = v.whole(token)
                else:
                    before = self[data[:end - length]]
                    fits = known_apart((before, token))
                    if fits is None:
                        fits = v.apart(before, token)
                if fits:
                    self[data[:end]] = token
                    break
        out = []
        while size:
            token = self[data[:size]]
            out.append(token)
            size -= len(v.tokens[token])
        if len(self) > CACHE_PREFIXES:
            self.clear()
        return out[::-1]


class Pieces(dict):
    """Packed ids of each piece of text, filled on demand and emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.prefixes = SharedPrefixes(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        known = self.vocabulary.ranks.get(data)
        if known is not None:
            ids = [known]
        elif len(data) <= SHORT:
            ids = self.prefixes.encode(data)
        else:
            ids = PrefixTable(self.vocabulary, data).tokens()
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(data) <= SHORT:
            self[piece] = packed
        return packed


class Encoder:
    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.matcher = regex.compile(pattern)
        self.pieces = Pieces(self.vocabulary)

    def packed(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[piece] for piece in self.matcher.findall(text)])



class Encoded:
    """A text with its matches and ids, kept exact under appends and edits."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, ""
        self.ends: list[int] = []
        self.packs: list[bytes] = []
        self.edit(0, 0, text)

    def packed(self) -> bytes:
        return b"".join(self.packs)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; returns how many matches were encoded anew.

        A match depends on the text from its start to two characters past its end (a run of
        blanks leaves its last one to a word, an apostrophe looks for two letters), so earlier
        matches stay, and once a match ends on an old boundary past the edit, the rest stay too.
        """
        shift = len(new) - (end - start)
        first = bisect.bisect_left(self.ends, start - 1)
        old_ends, old_packs = self.ends[first:], self.packs[first:]
        begin = self.ends[first - 1] if first else 0
        self.text = self.text[:start] + new + self.text[end:]
        boundaries = {at + shift: place for place, at in enumerate(old_ends) if at >= end}
        ends, packs = [], []
        rest: int | None = None
        for match in self.encoder.matcher.finditer(self.text, begin):
            ends.append(match.end())
            packs.append(self.encoder.pieces[match.group()])
            if match.end() >= start + len(new) and match.end() in boundaries:
                rest = boundaries[match.end()] + 1
                break
        done = len(ends)
        if rest is not None:
            ends += [at + shift for at in old_ends[rest:]]
            packs += old_packs[rest:]
        self.ends[first:], self.packs[first:] = ends, packs
        return done


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str | None) -> list[bytes]:
    """Bytes of each id; ids that the vocabulary leaves free have none."""
    ranks = load_ranks(path)
    known = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        known[rank] = token
    return known


def _with_columns(frame: DataFrame, steps: list[tuple], leave: tuple[str, ...] = ()) -> DataFrame:
    """All columns of frame but leave, and a binary one for each step (source, name, change).

    change makes its column from a batch's source, which may be a column of an earlier step. All
    steps run in one pass: with a pass for each, every task would hold a Python worker for each,
    and in time all of them would fill the encoder's caches.
    """
    fields = [*frame.schema.fields, *[T.StructField(name, T.BinaryType()) for _, name, _ in steps]]
    names = [field.name for field in fields]
    work = [(names.index(source), change) for source, _, change in steps]
    kept = [at for at, name in enumerate(names) if name not in leave]

    def run(batches):
        release_memory()
        for batch in small(batches):
            columns = list(batch.columns)
            for at, change in work:
                columns.append(pa.array(change(columns[at]), pa.binary()))
            yield pa.RecordBatch.from_arrays([columns[at] for at in kept], [names[at] for at in kept])

    return frame.mapInArrow(run, T.StructType([fields[at] for at in kept]))


def _encoding(path: str | None):
    def change(column):
        coder = encoder(path)
        return [coder.packed(value or "") for value in column.to_pylist()]

    return change


def _decoding(path: str | None):
    def change(column):
        known = token_bytes(path)
        ids = (np.frombuffer(value or b"", "<u4").tolist() for value in column.to_pylist())
        return [b"".join([known[rank] for rank in found]) for found in ids]

    return change


def encode(frame: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ids: token ids as little-endian unsigned 32-bit integers, end to end.

    Each match of the pattern is encoded by itself, without special tokens, over the whole
    text. A null text counts as empty and has no ids. ids must be a new name.
    """
    return _with_columns(frame, [(text, ids, _encoding(path))])


def decode(frame: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids; null ids give no bytes."""
    return _with_columns(frame, [(ids, out, _decoding(path))])


def encode_decode(frame: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids",
                  out: str = "decoded") -> DataFrame:
    """As decode after encode, without the text, in one pass over the rows."""
    return _with_columns(frame, [(text, ids, _encoding(path)), (ids, out, _decoding(path))], leave=(text,))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return encode_decode(slim, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
