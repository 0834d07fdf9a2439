"""The prefix trie, packing and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import compare, database
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerlode.llm import conversation_trie, packing, periodic, queries
from offerlode.llm.running import before

TURNS = "conv_id long, turn long, role string, text string, words string, i string, rep string, size string"


def words_of(text):
    return (text or "").encode().split()


def crc(value):
    return zlib.crc32(str(value).encode())


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Prefix trie


def plain_trie(rows):
    """Nodes by their definition, from (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {conv: [turn[2:] for turn in sorted(found)] for conv, found in talks.items()}
    if not talks:
        return []
    members, ends = defaultdict(set), defaultdict(list)
    for conv, own in talks.items():
        head = crc(conv) % 4
        first = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        whole = tuple(talks.get(first, [])[:head] + own[head:])
        for depth in range(len(whole) + 1):
            members[whole[:depth]].add(conv)
        ends[whole].append(conv)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for node, found in members.items():
        cost = (len(found) - 1) * len(words_of(node[-1][1])) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += cost
    return sorted(
        (min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children[node], leaves[node], saved[node],
         sha(",".join(map(str, sorted(ends[node])))))
        for node, found in members.items()
    )


def trie_rows(frame):
    return sorted(tuple(row) for row in frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def talks(seed, convs, turns, kinds):
    """Conversations over few different turns, so that they share and part at every depth."""
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        size = draw.randint(1, turns)
        trunk = draw.randint(0, size)
        for turn in range(size):
            kind = turn % 3 if turn < trunk else draw.randrange(kinds)
            rows.append((draw.choice([conv, conv, conv * 7]), turn, "user" if turn % 2 else "assistant", f"say {kind} " * (kind + 1)))
    return rows


@pytest.mark.parametrize("seed,convs,turns,kinds,block,batches", [(1, 60, 9, 2, 4, 3), (2, 40, 30, 1, 4, 2)])
def test_trie_equals_its_definition(spark, seed, convs, turns, kinds, block, batches):
    rows = talks(seed, convs, turns, kinds)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(conversation_trie.prefix_trie(frame, block, batches)) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (1, 0, "a", "ties"),
        (1, 0, "a", "go"), (20, 0, "user", "hello there"), (20, 1, "user", "long " * 30_000), (21, 5, "user", None), (22, 0, "x", "y"),
        (40, 0, "user", "same"), (60, 0, "user", "same"), (-3, 0, "user", "below zero"), (0, 0, "user", "zero"), (39, 0, "user", "gone"),
    ]
    frame = spark.createDataFrame([(*row, "w", "i", "r", "s") for row in rows], TURNS)
    assert trie_rows(conversation_trie.prefix_trie(frame)) == plain_trie(rows)
    assert trie_rows(conversation_trie.prefix_trie(frame.limit(0))) == []


def test_trie_of_the_small_table(spark, small):
    rows = [tuple(row) for row in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op11_prefix_trie(spark, small)) == plain_trie(rows)


def test_running_totals_cross_tasks(spark):
    rows = [(draw % 3 if draw % 5 else None, draw * 37 % 101, draw) for draw in range(500)]
    frame = spark.createDataFrame(rows, "kind long, at long, value long").repartition(7)
    known = {(row.kind, row.at, row.value): row.sum for row in before(frame, ["kind"], ["at", "value"], "value", "sum").collect()}
    for kind in (0, 1, 2, None):
        total = 0
        for row in sorted((r for r in rows if r[0] == kind), key=lambda r: r[1:]):
            assert known[row] == total
            total += row[2]


# Packing


def plain_ids(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_pieces(rows, docs, tokenizer, window=packing.WINDOW, short=1):
    """Every id of docs (doc_id, text) once, sequences gapless; returns the tokens by sequence."""
    wanted = Counter()
    for doc, text in docs:
        ids = plain_ids(text, tokenizer)
        wanted[(doc, len(ids))] += 1
    covered, sequences = Counter(), defaultdict(list)
    texts = {doc: plain_ids(text, tokenizer) for doc, text in docs}
    for row in rows:
        piece = texts[row.doc_id][row.start:row.start + row.length]
        assert len(piece) == row.length > 0 and row.doc_tokens == len(texts[row.doc_id])
        assert row.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        covered.update((row.doc_id, at) for at in range(row.start, row.start + row.length))
        sequences[row.sequence_id].append((row.offset, row.length))
    assert covered == Counter({(doc, at): times for (doc, n), times in wanted.items() for at in range(n)})
    totals = {}
    for name, parts in sequences.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        totals[name] = end
    assert sorted(totals) == list(range(len(totals)))
    assert sum(size < window for size in totals.values()) <= short
    return totals


def test_packing_of_the_small_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op12_packing(spark, small).collect()
    check_pieces(rows, [(row.doc_id, row.text) for row in docs.collect()], tokenizer)
    again = queries.op12_packing(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    # Every full window is near every source's share, and so is every stretch of windows.
    sent, sizes = defaultdict(Counter), Counter()
    for row in rows:
        sent[row.sequence_id][row.queue] += row.length
        sizes[row.queue] += row.length
    every, so_far = sum(sizes.values()), Counter()
    for at in range(max(sent)):
        so_far.update(sent[at])
        for source, size in sizes.items():
            assert abs(so_far[source] - (at + 1) * packing.WINDOW * size / every) <= 2 * packing.QUANTUM


def test_packing_of_odd_rows(spark, tokenizer):
    texts = [
        (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (None, "no id", "b"), (4, "twice", "b"), (4, "twice", "b"),
        (5, "word " * 30_000, "a"), (6, "x" * 20_000, None), (7, "a\x1cb\x85c  d Ünïcode ÉCOLE's 123 don't", "c"),
        (8, "<|endoftext|> x<|startoftext|>y", "c"),
    ]
    schema = "doc_id long, text string, source string, n string, ids string, task string, base string, place string"
    frame = spark.createDataFrame([(*row, "n", "i", "t", "b", "p") for row in texts], schema)
    check_pieces(packing.pack(frame).collect(), [row[:2] for row in texts], tokenizer)
    assert packing.pack(frame.limit(0)).collect() == []
    # Many sources due less than a token a span share a queue.
    many = spark.createDataFrame([(at, f"t{at} " * 3, f"s{at}" if at % 3 == 1 else f"s{at % 3}") for at in range(900)], "doc_id long, text string, source string")
    rows = packing.pack(many, window=8).collect()
    check_pieces(rows, [(at, f"t{at} " * 3) for at in range(900)], tokenizer, 8)
    assert len({row.queue for row in rows}) == 2
    # With weights, the windows before the first weighted source ends hold the weights.
    rows = packing.pack(frame, window=512, weights={"a": 1.0, None: 1.0}).collect()
    check_pieces(rows, [row[:2] for row in texts], tokenizer, 512, short=2)


def test_spans_share_out_every_token():
    draw = random.Random(5)
    for _ in range(200):
        sizes = [draw.randint(50, 900) for _ in range(draw.randint(1, 6))]
        every, spans, ahead = sum(sizes), Counter(), 0
        tokens = draw.randint(-(-every // min(sizes)), 300)
        for own in sizes:
            place = 0
            while place < own:
                size = min(draw.randint(1, 200), own - place)
                last = 0
                for span, first, part in packing.span_cuts(place, size, ahead, own, every, tokens):
                    assert first == last and part > 0
                    last += part
                    spans[span] += part
                assert last == size
                place += size
            ahead += own
        assert all(spans[span] == min(tokens, every - span * tokens) for span in range(-(-every // tokens)))


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=600, deadline=None)
def test_ids_are_the_tokenizers(texts):
    code = packing.coder(None)
    plain = [code.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(ids, code.type).tolist() for ids in code.packed(texts)] == plain


def test_words_of_any_case_are_learnt_once():
    """New words are most of the work, so case and a sign behind a word must not make more."""
    code = packing.Coder(None)
    packed = code.packed(["Carrot carrot, CARROT\tCarrot.\u00a0carrot"])
    assert set(code.known) == {"carrot", "carrot,", "carrot.", ",", "."}
    assert np.frombuffer(packed[0], code.type).tolist() == code.tokenizer.encode(
        "Carrot carrot, CARROT\tCarrot.\u00a0carrot", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "ΑΣ ας", "İi İ", "\u212a\u212b k", "e\u0301 é", "<|ENDOFTEXT|> a<|endoftext|>b", "a\x1cb\x85c d", "x\x1f \u2028y",
    "\x1c y\u00a0 z", "it's IT'S '\u017f", "½²ªº5x 12", "\x00a\x7f.\x80"])
def test_ids_of_odd_texts(text):
    code = packing.coder(None)
    for one in (text, f"{text} plain", text.upper()):
        want = code.tokenizer.encode(one, add_special_tokens=False).ids
        assert np.frombuffer(code.packed([one])[0], code.type).tolist() == want


# Periodic runs


def plain_runs(words):
    """All runs, by trying every period at every place."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            stop = at
            while stop + period < len(words) and words[stop] == words[stop + period]:
                stop += 1
            if stop - at >= period:
                found.setdefault((at, stop + period - at), period)
            at = stop + 1
    return sorted((start, length, period) for (start, length), period in found.items() if length >= max(12, 2 * period))


def periodic_words(seed):
    draw = random.Random(seed)
    kind, letters = draw.randrange(5), draw.choice([1, 2, 2, 3, 30])
    if kind == 0:
        return [draw.randrange(letters) for _ in range(draw.randint(0, 150))]
    if kind == 1:
        words = [draw.randrange(letters) for _ in range(draw.randint(1, 5))]
        for _ in range(draw.randint(1, 5)):
            words = words * draw.randint(1, 4) + [draw.randrange(letters) for _ in range(draw.randint(0, 2))]
        return words[:300]
    if kind == 2:
        short, words = [0], [1]
        while len(words) < draw.randint(5, 120):
            short, words = words, words + short
        return (words + words[:draw.randint(0, len(words))])[:300]
    if kind == 3:
        words = []
        for _ in range(draw.randint(1, 5)):
            words += ([0, 1, 2][:draw.randint(1, 3)] * 40)[draw.randint(0, 2):draw.randint(3, 60)]
        return words[:300]
    words = [0]
    while len(words) < 200:
        words += [1 - word for word in words]
    return words[draw.randint(0, 50):draw.randint(60, 256)]


def test_runs_equal_brute_force():
    for seed in range(0, 1200, 4):
        texts = [[b"%d" % word for word in periodic_words(seed + more)] for more in range(4)]
        assert periodic._batch_runs(texts) == [plain_runs(words) for words in texts]


def plain_digests(doc, text):
    words = [word.decode() for word in words_of(text)]
    if doc is not None and crc(doc) % 10 == 0 and words:
        n, g = len(words), crc(doc) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {at for start, length, period in runs for at in range(start + period, start + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    return (doc, len(runs), *longest, sha(listed), sha(" ".join(word for at, word in enumerate(words) if at not in gone)))


def test_run_digests_of_odd_and_short_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    texts = [(row.doc_id, row.text) for row in docs if len(words_of(row.text)) < 400]
    repeats = " ".join(map(str, periodic_words(7)))
    texts += [(None, "a b " * 20), (None, None), (9001, None), (9002, ""), (9003, " \t\n"), (9004, repeats), (9004, repeats),
              (9005, "same " * 700), (9006, "a b c d e f g\x0bh\x0c" * 9), (9007, "x" * 100_000)]
    frame = spark.createDataFrame([(*row, "n", "r") for row in texts], "doc_id long, text string, n_runs string, crc string")
    plain = sorted((plain_digests(*row) for row in texts), key=str)
    assert sorted((tuple(row) for row in periodic.digests(frame).collect()), key=str) == plain
    assert periodic.digests(frame.limit(0)).collect() == [] and any(row[1] for row in plain)


def test_long_repeats_in_a_long_text(spark):
    draw = random.Random(3)
    block = " ".join(f"w{draw.randrange(10**6)}" for _ in range(9_000))
    text = f"start {block} {block} {block} end " + "la " * 50_000
    (row,) = periodic.runs_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(run) for run in row.runs] == [(1, 27_000, 9_000), (27_002, 50_000, 1)]
    assert row.collapsed == f"start {block} end la"
