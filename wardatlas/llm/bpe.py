"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode by a UTF-8 state machine.

A token sequence is the encoding of its bytes if and only if every two neighbours are the encoding of theirs. So the
vocabulary's trie, with an arc from the end of token s to the start of token t wherever (s, t) encodes to itself, is a
nondeterministic transducer with one accepting path for each input. It is determinised while it runs: a state is the set
of paths still possible, each with the trie node it is in, the token before, and the tokens not yet emitted; tokens on
which all paths agree are emitted at once. The paths of a state start their last token at different bytes, so there are
no more of them than bytes in the longest token, which bounds the lookahead. States and arcs are made when first met and
kept up to `STATES`, and four times as many arcs; beyond that the tables start anew from the paths still open, in the middle of a piece
too, which costs time and changes nothing.

Merges enter by rank: the arc test merges the bytes of two tokens, lowest rank first, leftmost among equals.

Decoding is streaming: tokens may cut a character, whose bytes wait in the state. Bytes that no character can go on with
become U+FFFD, as in Python's "replace".

Defined results: a null text is empty and has no tokens; any length of text is one pass, an unbroken piece of any length too; ids outside
the vocabulary are an error; every row gives one row, so repeated rows give equal rows; an empty table gives none; other columns pass unchanged.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .frames import HELD, map_arrow, with_column

STATES = 1 << 17
PIECES = 1 << 18                # pieces of text in each of the two halves of a worker's memory


def read_ranks(path: str) -> tuple[bytes, ...]:
    """Token bytes by rank from a file of "base64 rank" lines; the file is small and read on the driver."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without a gap")
    return tuple(token for _, token in ranked)


def merge_by_rank(ranks: dict[bytes, int], text: bytes) -> list[int]:
    """The definition: join the two neighbours whose bytes have the lowest rank, leftmost first, until none has one."""
    parts = [text[i:i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def two_parts(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes]:
    """The two parts that a token's last merge joins."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            raise ValueError("a token of the vocabulary cannot be merged from bytes")
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Transducer:
    """Encodes one piece of text after another; `encode` walks the determinised table."""

    def __init__(self, tokens: tuple[bytes, ...], share: int = 1):
        self.tokens, self.ranks, self.share = tokens, {t: i for i, t in enumerate(tokens)}, share
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for i, token in enumerate(tokens):
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token_at[node] = i
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states, self.number, self.arcs = [start], {start: 0}, {}
        self.ends: list[tuple[int, ...] | None] = [None]        # of each state, the tokens of its one path that may end there

    def _spine(self, token: int, right: bool) -> list[int]:
        """What stands at the token's edge while its bytes are merged: first a single byte, at last the token itself."""
        key = (token, right)
        if key not in self.spines:
            grown, whole = [], self.tokens[token]
            while len(whole) > 1:
                grown.append(self.ranks[whole])
                whole = two_parts(self.ranks, whole)[right]
            self.spines[key] = [self.ranks[whole], *reversed(grown)]
        return self.spines[key]

    def _follows(self, before: int, token: int) -> bool:
        """Do the two tokens stay apart when their bytes are merged together? The merges at the edge go by rank, and by
        place among equals; the tokens stay apart if none joins what stands left and right of the edge."""
        if before < 0:
            return True
        key = before << 20 | token
        known = self.pairs.get(key)
        if known is None:
            left, right = self._spine(before, True), self._spine(token, False)
            i = j = 0
            never = len(self.tokens)
            while True:
                grow_left = left[i + 1] if i + 1 < len(left) else never
                grow_right = right[j + 1] if j + 1 < len(right) else never
                across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], never)
                if across < grow_left and across <= grow_right and across < never:
                    known = False
                    break
                if grow_left == grow_right == never:
                    known = True
                    break
                if grow_left <= grow_right:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > 16 * STATES // self.share:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _state(self, paths: tuple) -> int:
        found = self.number.get(paths)
        if found is None:
            found = self.number[paths] = len(self.states)
            self.states.append(paths)
            end = None
            for node, before, waiting in paths:
                token = self.token_at.get(node)
                if token is not None and self._follows(before, token):
                    end = (*waiting, token)
                    break
            self.ends.append(end)
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child, paths = self.child, []
        for node, before, waiting in self.states[state]:
            after = child.get(node << 8 | byte)
            if after is not None:
                paths.append((after, before, waiting))
        done = self.ends[state]
        if done is not None and byte in child:
            paths.append((child[byte], done[-1], done))
        if not paths:
            raise ValueError("the vocabulary has no token for a byte")
        first = paths[0][2]
        agreed = len(first)
        for _, _, waiting in paths[1:]:
            agreed = min(agreed, len(waiting))
            while waiting[:agreed] != first[:agreed]:
                agreed -= 1
            if not agreed:
                break
        if agreed:
            paths = [(node, before, waiting[agreed:]) for node, before, waiting in paths]
        arc = self.arcs[state << 8 | byte] = (self._state(tuple(paths)), first[:agreed])
        return arc

    def encode(self, text: bytes) -> tuple[int, ...]:
        state, out = 0, []
        arcs = self.arcs
        for byte in text:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                if len(self.states) > STATES // self.share or len(arcs) > 4 * STATES // self.share:
                    paths = self.states[state]              # the open paths are all that the text so far has left
                    self._reset()
                    state, arcs = self._state(paths), self.arcs
                arc = self._step(state, byte)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        return (*out, *self.ends[state]) if state else ()


#: Bytes that may begin a character: (first, last, bytes to follow, lowest and highest first follower); fixed values of UTF-8.
_LEADS = [(0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
          (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF),
          (0xF4, 0xF4, 3, 0x80, 0x8F)]


class Decoder:
    """Token ids to text, a chunk at a time: `feed` returns what is certain, `finish` the rest."""

    def __init__(self, tokens: tuple[bytes, ...]):
        self.tokens = tokens
        self.lead = {b: (need, lo, hi) for first, last, need, lo, hi in _LEADS for b in range(first, last + 1)}
        self.whole = [self._run(b"", t) for t in tokens]        # (text, bytes that wait) from the empty state
        self.plain = [text if not rest else None for text, rest in self.whole]
        self.known: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.waiting = b""

    def _run(self, waiting: bytes, more: bytes) -> tuple[str, bytes]:
        """One pass of the state machine: its state is (bytes still needed, range of the next), `begin` the character's start."""
        data = waiting + more
        out, begin, need, lo, hi = [], 0, 0, 0, 0
        i = 0
        while i < len(data):
            byte = data[i]
            if need:
                if lo <= byte <= hi:
                    need, lo, hi, i = need - 1, 0x80, 0xBF, i + 1
                    if not need:
                        out.append(data[begin:i].decode())
                else:                                           # a broken character; this byte is looked at again
                    out.append("�")
                    need = 0
            elif byte in self.lead:
                (need, lo, hi), begin, i = self.lead[byte], i, i + 1
                if not need:
                    out.append(chr(byte))
            else:
                out.append("�")
                i += 1
        return "".join(out), data[begin:] if need else b""

    def feed(self, ids: Iterable[int]) -> str:
        if not self.waiting:
            ids = list(ids)
            parts = [self.plain[i] for i in ids]
            if None not in parts:                               # every token begins and ends between characters
                return "".join(parts)
        out = []
        for i in ids:
            key = (self.waiting, i)
            if key not in self.known:
                if len(self.known) > STATES:
                    self.known.clear()
                self.known[key] = self._run(self.waiting, self.tokens[i])
            text, self.waiting = self.known[key]
            out.append(text)
        return "".join(out)

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return "�" if rest else ""


class Codec:
    """Encoder and decoder of one vocabulary, with a memory of pieces already seen; all that grows has 1 / `share` of its full bound."""

    def __init__(self, tokens: tuple[bytes, ...], pattern: str, share: int = 1):
        self.split, self.transducer, self.decoder, self.share = regex.compile(pattern), Transducer(tokens, share), Decoder(tokens), share
        self.seen: dict[str, tuple[int, ...]] = {}              # pieces met lately; `older` is its predecessor
        self.older: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> Iterator[str]:
        return (m.group() for m in self.split.finditer(text))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        seen = self.seen
        for piece in self.split.findall(text) if len(text) < 1 << 24 else self.pieces(text):
            ids = seen.get(piece)
            if ids is None:
                ids = self._piece(piece)
                seen = self.seen
            out += ids
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            token = self.transducer.ranks.get(raw)
            ids = self.transducer.encode(raw) if token is None else (token,)
        if len(piece) <= 64:
            if len(self.seen) >= PIECES // self.share:
                self.older, self.seen = self.seen, {}
            self.seen[piece] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.finish()


@lru_cache(maxsize=4)
def _codec(tokens: tuple[bytes, ...], pattern: str, share: int) -> Codec:
    return Codec(tokens, pattern, share)


HELD["bpe"] = _codec.cache_clear


def _in_worker(held, pattern: str, share: int = 1) -> Codec:
    """One codec per Python worker and vocabulary, kept from task to task."""
    return _codec(held.value, pattern, share)


def encode(docs: DataFrame, tokens: tuple[bytes, ...], pattern: str, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """All columns, and the token ids of the whole text as array<int>."""
    held = docs.sparkSession.sparkContext.broadcast(tokens)
    schema = with_column(docs.schema, out_col, ArrayType(IntegerType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _in_worker(held, pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, type=pa.list_(pa.int32()))], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(task, schema)


def decode(frame: DataFrame, tokens: tuple[bytes, ...], ids_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids decode to."""
    held = frame.sparkSession.sparkContext.broadcast(tokens)
    schema = with_column(frame.schema, out_col, StringType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _in_worker(held, "")
        for batch in batches:
            found = [codec.decode(ids or ()) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=pa.string())], names=[*batch.schema.names, out_col])

    return frame.mapInArrow(task, schema)


def round_trip(docs: DataFrame, tokens: tuple[bytes, ...], pattern: str, id_col: str = "doc_id", text_col: str = "text", *,
               share: int = 1) -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256): the ids of each whole text and what decoding them gives, as digests, so
    that no task has to hand over the ids. A `share` above 1 cuts the worker's tables to that part; the results are the same."""
    held = docs.sparkSession.sparkContext.broadcast(tokens)
    digits = [str(i) for i in range(len(tokens))]

    def digests(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = _in_worker(held, pattern, share)
        counts, ids_sha, decoded_sha = [], [], []
        for value in batch.column("text"):
            ids = codec.encode(value.as_py() or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        yield {"doc": batch.column("doc"), "n_tokens": pa.array(counts, type=pa.int64()), "ids_sha256": pa.array(ids_sha, type=pa.string()),
               "decoded_sha256": pa.array(decoded_sha, type=pa.string())}

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, digests, f"doc {rows.schema['doc'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
