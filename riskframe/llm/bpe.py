"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. In a list of tokens that the merges give, every two neighbours are what the merges give for
their joint bytes; and of every prefix of a text the encoding ends in one token only. So the encoding
of each prefix is its last token after the encoding of a shorter prefix. Reading a byte adds one such
link: a trie of the tokens with failure links names the tokens that end there, longest first, and the first one
that the merges leave beside the last token before it is the link. A prefix stays open while its rest can still
begin a token; what all open prefixes share is settled and is emitted. A state is the last settled token and the
bytes after it, which are fewer than the longest token and its context need.

States and arcs are made for what is met OFTEN; from an arc that is met for the first times the links are
followed to the end of the piece without making any (a long piece always goes by arcs, so its open bytes stay few).
New pieces come sorted, and one that begins like the last one follows its links anew only from where they part. Which two tokens may stand side by side is found by
taking both apart again, the later merge first, and is kept per pair in a bounded table.

Decoding. Tokens may end inside a UTF-8 sequence. The decoder's state is the unfinished sequence; arcs
(state, token) -> (text, state) are made when first met.

A worker keeps the trie of a vocabulary, whose size the vocabulary bounds; all tables that grow with
the text are given up when a task ends.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of the tables of a task, in entries (some 300 bytes each); a full one is begun anew or becomes the older one of two.
MAX_STATES = 30_000
MAX_PIECES = 200_000
MAX_PAIRS = 300_000
MAX_STEPS = 200_000
LONG_PIECE = 64
AT_ONCE = 1 << 21
# An arc is made when it is met so many times.
OFTEN = 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(ranks: dict[bytes, int], text: bytes) -> list[int]:
    """Tokens of a short text by merging the pair of least rank, leftmost first, until none is left."""
    parts, none = [text[i: i + 1] for i in range(len(text))], 1 << 60
    order = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while order and (best := min(order)) < none:
        at = order.index(best)
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
        del order[at]
        if at:
            order[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(order):
            order[at] = ranks.get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


NO_TOKEN = (1 << 20) - 1
START = (NO_TOKEN, b"", ())
MEANING = -1


class Vocabulary:
    """The tokens as a trie with failure links, and which of them the merges leave side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.child: dict[int, int] = {}
        self.after: dict[int, int] = {}  # steps met of late
        self.fail: list[int] = [0]
        self.ends: list[tuple] = [()]  # per node the tokens (rank, length) that end there, longest first
        self._build()
        self.inner = {key >> 8 for key in self.child}  # nodes that something follows

    def _build(self) -> None:
        child, own, level = self.child, {}, []
        for token, rank in self.ranks.items():
            node = 0
            for depth, byte in enumerate(token):
                after = child.get(node << 8 | byte)
                if after is None:
                    after = child[node << 8 | byte] = len(self.fail)
                    self.fail.append(0)
                    self.ends.append(())
                    while len(level) <= depth:
                        level.append([])
                    level[depth].append((node, byte, after))
                node = after
            own[node] = ((rank, len(token)),)
        for depth, nodes in enumerate(level):
            for before, byte, node in nodes:
                back = self.fail[before]
                if depth:
                    while back and back << 8 | byte not in child:
                        back = self.fail[back]
                    self.fail[node] = child.get(back << 8 | byte, 0)
                self.ends[node] = own.get(node, ()) + self.ends[self.fail[node]]

    def step(self, node: int, byte: int) -> int:
        """The longest suffix that begins a token, after one more byte."""
        key = node << 8 | byte
        found = self.after.get(key)
        if found is None:
            child = self.child
            while node and node << 8 | byte not in child:
                node = self.fail[node]
            found = child.get(node << 8 | byte, 0)
            if len(self.after) >= MAX_STEPS:
                self.after.clear()
            self.after[key] = found
        return found

    def begins(self, body: bytes) -> bool:
        """Is this the beginning of a longer token?"""
        node = 0
        for byte in body:
            node = self.child.get(node << 8 | byte)
            if node is None:
                return False
        return node in self.inner

    def taken_apart(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the merge that makes this one; None where the merges do not make it."""
        if token not in self.parts:
            self.parts[token], body = None, self.bytes_of[token]
            for cut in range(1, len(body)):
                left, right = self.ranks.get(body[:cut], token), self.ranks.get(body[cut:], token)
                if left < token and right < token and self.made(left) and self.made(right) and self.stay(left, right, token):
                    self.parts[token] = left, right
                    break
        return self.parts[token]

    def made(self, token: int) -> bool:
        """Do the merges make this token from its bytes?"""
        return self.length[token] == 1 or self.taken_apart(token) is not None

    def stay(self, left: int, right: int, until: int) -> bool:
        """Do merges of less rank than `until` leave these two tokens side by side?

        Back in time: of the two tokens at the border the one made later is taken apart. A merge across the border
        would have come first if its rank is less, or equal and it lies further left.
        """
        body, rank_of, first = self.bytes_of, self.ranks.get, until
        while True:
            across = rank_of(body[left] + body[right], until)
            if across < first:
                return False
            a = -1 if len(body[left]) == 1 else left
            b = -1 if len(body[right]) == 1 else right
            if a > b:
                first, left = a, self.taken_apart(left)[1]
            elif b >= 0:
                first, right = b + 1, self.taken_apart(right)[0]
            else:
                return True


class Transducer:
    """Encoder of single pieces of text; `encode(piece)` gives the token ids.

    A node maps a byte to (emitted tokens, next node), or to how often it was met there, and MEANING to its state;
    `nodes` finds the node of a state.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ranks, self.bytes_of, self.length = vocabulary.ranks, vocabulary.bytes_of, vocabulary.length
        self.pairs: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.start: dict = {MEANING: START}
        self.nodes: dict[tuple, dict] = {START: self.start}

    def _joins(self, left: int, right: int) -> bool:
        """Do the merges make `right` and leave it beside `left` (NO_TOKEN: at the start)?"""
        pair = left << 20 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            vocabulary = self.vocabulary
            known = self.pairs[pair] = vocabulary.made(right) and (left == NO_TOKEN or vocabulary.stay(left, right, NO_TOKEN))
        return known

    def _arc(self, state: tuple, byte: int) -> tuple:
        """(emitted tokens, next state) after one more byte.

        A state is (settled, pending, lasts): the last settled token (None at the start), the bytes after
        it, and for each number of pending bytes the last token of that prefix, None where it starts
        before the settled place (no open prefix leads there).
        """
        settled, pending, lasts = state
        pending += bytes((byte,))
        end, found, length = len(pending), None, self.length
        for start in range(end):
            token = self.ranks.get(pending[start:])
            before = lasts[start - 1] if start else settled
            if token is not None and before is not None and self._joins(before, token):
                found = token
                break
        lasts += (found,)
        # The chain of links from here; where the chains of all open prefixes meet it, all is settled.
        chain, n = {end}, end
        while n:
            n -= length[lasts[n - 1]]
            chain.add(n)
        cut, used, begins = end, set(chain), self.vocabulary.begins
        for n in range(end):
            if (n == 0 or lasts[n - 1] is not None) and begins(pending[n:]):
                while n not in chain:
                    used.add(n)
                    n -= length[lasts[n - 1]]
                if n < cut:
                    cut = n
        if not cut:
            return (), (settled, pending, lasts)
        emitted = tuple([lasts[n - 1] for n in sorted(chain) if 0 < n <= cut])
        # Only links that open prefixes use stay, so that equal futures are one state.
        kept = tuple([lasts[n - 1] if n in used else None for n in range(cut + 1, end + 1)])
        return emitted, (emitted[-1], pending[cut:], kept)

    def _step(self, node: dict, byte: int) -> tuple[tuple, dict]:
        emitted, state = self._arc(node[MEANING], byte)
        after = self.nodes.get(state)
        if after is None:
            after = self.nodes[state] = {MEANING: state}
        arc = node[byte] = emitted, after
        return arc

    def encode_all(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """The token ids of each piece, best of sorted ones.

        Each goes by arcs as far as there are any and by links from there. A piece that begins like the one before it goes
        on where they part, if that one had left the arcs by then.
        """
        vocabulary, known, length, rank_of = self.vocabulary, self.pairs.get, self.length, self.ranks.get
        after, ends, step, joins = vocabulary.after.get, vocabulary.ends, vocabulary.step, self._joins
        piece, left, head, lasts, nodes, ahead = b"", 0, [], [NO_TOKEN], [0], 0
        for next_piece in pieces:
            token = rank_of(next_piece)
            if token is not None:
                yield [token]
                continue
            most, at = min(len(piece), len(next_piece)), 0
            while at < most and piece[at] == next_piece[at]:
                at += 1
            piece = next_piece
            if at > left:
                del lasts[ahead + at - left + 1:], nodes[at - left + 1:]
            else:
                left, head, (settled, pending, own) = self._by_arcs(piece)
                lasts, ahead, at = [settled, *own], len(pending), left
                whole = settled == NO_TOKEN  # else no token may begin before the settled one ends, nor at a closed place
                node = 0
                for byte in pending:
                    node = step(node, byte)
                nodes = [node]
            node, n = nodes[-1], len(lasts) - 1
            for byte in piece[at:]:
                found = after(node << 8 | byte)
                node = step(node, byte) if found is None else found
                nodes.append(node)
                n += 1
                for token, size in ends[node]:
                    if whole or size <= n:
                        before = lasts[n - size]
                        if before is None:
                            continue
                        good = known(before << 20 | token)
                        if joins(before, token) if good is None else good:
                            break
                lasts.append(token)
            tail = []
            while n:
                tail.append(lasts[n])
                n -= length[lasts[n]]
            yield head + tail[::-1]

    def _by_arcs(self, piece: bytes) -> tuple[int, list[int], tuple]:
        """How many bytes of a piece the arcs read, the tokens they emit, and the state they reach."""
        if len(self.nodes) >= MAX_STATES:
            self._restart()
        out: list[int] = []
        node = self.start
        for at, byte in enumerate(piece):
            arc = node.get(byte, 0)
            if arc.__class__ is int:
                if arc < OFTEN and at < LONG_PIECE:
                    node[byte] = arc + 1
                    return at, out, node[MEANING]
                arc = self._step(node, byte)
            emitted, node = arc
            if emitted:
                out += emitted
        return len(piece), out, node[MEANING]

    def encode(self, piece: bytes) -> list[int]:
        return next(self.encode_all([piece]))


class Encoder:
    """Texts to ids: splits by the pattern and encodes each piece. Pieces met of late are kept in two
    generations, so a full table becomes the older one and what is met again moves on."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.transducer = Transducer(vocabulary)
        self.split = regex.compile(pattern).findall
        self.recent: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def close(self) -> None:
        self.recent, self.older = {}, {}
        self.transducer.pairs.clear()
        self.transducer._restart()

    def _learn(self, pieces: set[str]) -> None:
        """Make the ids of all these pieces known; new ones are encoded in sorted order."""
        if len(self.recent) >= MAX_PIECES:
            self.recent, self.older = {}, self.recent
        missing = pieces.difference(self.recent)
        again = missing.intersection(self.older)
        self.recent.update(zip(again, map(self.older.__getitem__, again)))
        fresh = sorted(missing - again)
        self.recent.update(zip(fresh, self.transducer.encode_all(p.encode("utf-8") for p in fresh)))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; whole texts are taken together up to some AT_ONCE characters."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
                size += len(texts[end])
                end += 1
            pieces = [self.split(text) for text in texts[at:end]]
            self._learn(set(chain.from_iterable(pieces)))
            for some in pieces:
                yield list(chain.from_iterable(map(self.recent.__getitem__, some)))
            for piece in [p for some in pieces for p in some if len(p) > LONG_PIECE]:
                self.recent.pop(piece, None)
            at = end

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))


def utf8_step(state: bytes, byte: int) -> tuple[str, bytes]:
    """One byte of the UTF-8 automaton: text that is complete now, and the unfinished sequence.

    A byte that cannot follow ends the unfinished sequence with a replacement character.
    """
    if state:
        lead, n = state[0], len(state)
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if n == 1 else 0x80
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if n == 1 else 0xBF
        if low <= byte <= high:
            whole = state + bytes((byte,))
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return (whole.decode("utf-8"), b"") if len(whole) == need else ("", whole)
        text, rest = utf8_step(b"", byte)
        return "\ufffd" + text, rest
    if byte < 0x80:
        return chr(byte), b""
    if 0xC2 <= byte <= 0xF4:
        return "", bytes((byte,))
    return "\ufffd", b""


class Unfinished(Exception):
    """A token ends inside a UTF-8 sequence."""


class Texts(dict):
    """Texts of the tokens that begin and end between characters."""

    def __init__(self, bytes_of: dict[int, bytes]):
        super().__init__()
        self.bytes_of = bytes_of

    def __missing__(self, token: int) -> str:
        text, state = run_bytes(b"", self.bytes_of[token])
        if state or "\ufffd" in text:
            raise Unfinished
        self[token] = text
        return text


def run_bytes(state: bytes, body: bytes) -> tuple[str, bytes]:
    texts = []
    for byte in body:
        text, state = utf8_step(state, byte)
        texts.append(text)
    return "".join(texts), state


class Decoder:
    """Ids to text; `feed` takes ids in any portions, `close` ends an unfinished sequence."""

    PORTION = 256

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.plain = Texts(bytes_of)
        self.arcs: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.state = b""

    def feed(self, ids: list[int]) -> str:
        out = []
        for at in range(0, len(ids), self.PORTION):
            part = ids[at: at + self.PORTION]
            try:
                if self.state:
                    raise Unfinished
                out.append("".join(map(self.plain.__getitem__, part)))
            except Unfinished:
                out.append(self._arcs(part))
        return "".join(out)

    def _arcs(self, ids: list[int]) -> str:
        """Arc by arc, for portions with tokens that split a character."""
        out, state = [], self.state
        for token in ids:
            arc = self.arcs.get((state, token))
            if arc is None:
                if len(self.arcs) >= MAX_STATES:
                    self.arcs.clear()
                arc = self.arcs[state, token] = run_bytes(state, self.bytes_of[token])
            text, state = arc
            out.append(text)
        self.state = state
        return "".join(out)

    def close(self) -> str:
        rest, self.state = "\ufffd" if self.state else "", b""
        return rest


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    """Kept per worker process."""
    return Vocabulary(load_ranks(path))


def file_of(path: str) -> str:
    """Where an executor has a vocabulary file: at its path, or where the session's added files are."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@contextmanager
def codec(path: str, pattern: str) -> Iterator[tuple[Encoder, Decoder]]:
    """Encoder and decoder of a vocabulary file for one task.

    Its tables hold no cycles, and scanning them takes long, so collection pauses; at the end they are given up.
    """
    vocabulary = _vocabulary(file_of(path))
    paused = gc.isenabled()
    gc.disable()
    try:
        encoder = Encoder(vocabulary, pattern)
        yield encoder, Decoder(vocabulary.bytes_of)
    finally:
        encoder.close()
        if paused:
            gc.enable()


def share(spark, path: str) -> str:
    """Make a vocabulary file known to all executors."""
    spark.sparkContext.addFile(path)
    return path


def tokenise(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, rows: int = 1024) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    Whole texts are encoded, each match of `pattern` by itself and without special tokens, and the ids
    are decoded again. Null counts as empty: no ids. Other columns are ignored.
    """
    path = share(docs.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as (encoder, decoder):
            decimal = {token: str(token) for token in decoder.bytes_of}.__getitem__
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    counts, shas, decoded, lists = [], [], [], []
                    for ids in encoder.encode_all([text.as_py() or "" for text in part.column(1)]):
                        counts.append(len(ids))
                        shas.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                        back = decoder.feed(ids) + decoder.close()
                        decoded.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                        if with_ids:
                            lists.append(pa.array(ids, pa.int32()))
                    columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        offsets = pa.array([0, *pa.compute.cumulative_sum(columns[1]).to_pylist()], pa.int32())
                        values = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                        columns.append(pa.ListArray.from_arrays(offsets, values))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, schema)
