"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding.  A token sequence is the BPE encoding of its bytes exactly if every
neighbouring pair is *settled*, that is, merging the pair's joined bytes gives
the pair back.  So each prefix of a piece has one encoding, which ends in one token:
the longest of the tokens that end the prefix and are settled after the encoding of what stands before
them.  The transducer reads bytes; its state is the place in an automaton of all tokens (the longest end of what was read
that begins a token) and, for every prefix since the last emitted token, the
token that ends it.  A token yet to come begins no earlier than that longest end, so
the encodings of the prefixes from there on are the open hypotheses.  What all of them agree on is
emitted and leaves the state, once there are more than a few prefixes.  A token's length bounds how many hypotheses
are open, and so the lookahead.  States and transitions are built when first
met and shared by later pieces; past a fixed number the tables start anew,
even within a piece.

Decoding.  `Utf8Decoder` takes ids in any portions and returns text as soon as
code points are complete.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import annotated, table

#: Entries kept of the memos of pieces and of pairs before either starts anew.
MEMO_PIECES = 120_000
MEMO_PAIRS = 300_000
#: Transitions that are kept; past these, the tables start anew and the state at hand goes on.
MAX_TRANSITIONS = 100_000
#: Prefixes since the last emitted token from which on what all hypotheses agree on is looked for and emitted.
HELD = 24
#: Bytes from a piece's start within which states keep their transitions; further on pieces rarely agree, and sorted neighbours share their path anyway.
KEPT_DEPTH = 6
_ROOT = 0


def _pack(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_ranks(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


#: The place in the automaton of tokens, the last token emitted, the token that ends each prefix since, and where a byte leads, if that is kept:
#: to a state and the packed ids that are emitted.
State = tuple[int, int, tuple[int, ...], dict[int, tuple["State", bytes]] | None]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._lengths = {i: len(t) for t, i in ranks.items()}
        self._children: dict[int, int] = {}
        self._token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = _ROOT
            for b in token:
                step = node << 8 | b
                node = self._children.get(step, -1)
                if node < 0:
                    node = self._children[step] = len(self._token_at)
                    self._token_at.append(-1)
            self._token_at[node] = rank
        self._depth = [0] * len(self._token_at)
        self._parent = [0] * len(self._token_at)
        for step, node in self._children.items():  # parents were made before their children
            self._parent[node] = step
            self._depth[node] = self._depth[step >> 8] + 1
        self._fails: dict[int, int] = {_ROOT: _ROOT}
        self._ends: dict[int, tuple[tuple[int, int], ...]] = {_ROOT: ()}
        self._settled: dict[int, bool] = {}
        self._spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self._irregular: set[int] = set()
        #: States that follow an emission, by what they hold; those before it are a tree from the start on.
        self._shared: dict[tuple, State] = {}
        self._transitions = 0
        self._start: State = (_ROOT, -1, (), {})
        self._last, self._path = b"", [self._start]

    def _fail(self, node: int) -> int:
        """The place of the longest proper end of the node's bytes that begins a token."""
        found = self._fails.get(node)
        if found is None:
            step = self._parent[node]
            found = self._fails[node] = _ROOT if step >> 8 == _ROOT else self._goto(self._fail(step >> 8), step & 255)
        return found

    def _goto(self, node: int, byte: int) -> int:
        get = self._children.get
        while (to := get(node << 8 | byte)) is None:
            if node == _ROOT:
                raise ValueError("the ranks lack a single byte")
            node = self._fail(node)
        return to

    def _ending(self, node: int) -> tuple[tuple[int, int], ...]:
        """(length, token) of the tokens that end in the node's bytes, the longest first."""
        found = self._ends.get(node)
        if found is None:
            own, token = self._ending(self._fail(node)), self._token_at[node]
            found = self._ends[node] = ((self._depth[node], token), *own) if token >= 0 else own
        return found

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """Merging by rank, lowest first and leftmost on ties: what defines settled pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > stop:
            best, at = min((get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, right: bool) -> list[int]:
        """The tokens that stand at one edge while merging builds the token, from the byte on."""
        memo = self._spines[right]
        found = memo.get(token)
        if found is None:
            data = self.bytes_of[token]
            if len(data) == 1:
                found = [token]
            else:
                halves = self.merge(data, stop=2)
                if max(halves) >= token:
                    self._irregular.add(token)
                found = [*self._spine(halves[-1 if right else 0], right), token]
            memo[token] = found
        return found

    def _is_settled(self, a: int, b: int) -> bool:
        """Whether b may follow a; a is -1 at a piece's start."""
        found = self._settled.get(a << 20 | b)
        if found is None:
            if len(self._settled) > MEMO_PAIRS:
                self._settled.clear()
            # a token that merging can't make stands in no encoding
            found = self._settled[a << 20 | b] = self.merge(self.bytes_of[b]) == [b] if a < 0 else self._is_settled(-1, b) and self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        """Replays both sides' merges in rank order and looks for one across the boundary that would come first."""
        left, right = self._spine(a, True), self._spine(b, False)
        if self._irregular and not self._irregular.isdisjoint((*left, *right)):
            return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        i, j, never = 0, 0, 1 << 60
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else never
            next_right = right[j + 1] if j + 1 < len(right) else never
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], never)
            if across < next_left and across <= next_right and across != never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        node, last, held, _ = state
        to = self._children.get(node << 8 | byte)
        node = self._goto(node, byte) if to is None else to
        settled, n = self._settled.get, len(held)
        for length, token in self._ends.get(node) or self._ending(node):
            if length <= n:
                before = held[n - length]
            elif length == n + 1:
                before = last
            else:
                continue
            fits = settled(before << 20 | token)
            if fits or fits is None and self._is_settled(before, token):
                break
        else:
            raise ValueError("the ranks lack a single byte")
        held = (*held, token)
        n += 1
        if last < 0 and n <= HELD:  # nothing has left it, so it spells its prefix and is like no other
            return (node, last, held, {} if n < KEPT_DEPTH else None), ()
        emitted = ()
        if n > HELD:
            chains = [self._chain(held, b) for b in range(max(0, n - self._depth[node]), n + 1)]
            cut = max(set(chains[0]).intersection(*chains))
            if cut:
                # prefixes on no open encoding don't matter any more
                used, emitted, last = set().union(*chains), self._tokens(held, cut), held[cut - 1]
                held = tuple([t if b in used else -2 for b, t in enumerate(held[cut:], cut + 1)])
        key = (node, last, held)
        found = self._shared.get(key)
        if found is None:
            found = self._shared[key] = (*key, {})
        return found, emitted

    def _chain(self, held: tuple[int, ...], end: int) -> list[int]:
        """The prefixes at which the encoding of a prefix has its tokens' ends, from the last to 0."""
        out = [end]
        while end:
            end -= self._lengths[held[end - 1]]
            out.append(end)
        return out

    def _tokens(self, held: tuple[int, ...], end: int) -> tuple[int, ...]:
        """The encoding of a prefix."""
        out, lengths = [], self._lengths
        while end:
            token = held[end - 1]
            out.append(token)
            end -= lengths[token]
        return tuple(out[::-1])

    def _restart(self) -> None:
        """Empties the tables; the state that is being read from goes on without one."""
        self._shared.clear()
        self._start[3].clear()
        self._transitions = 0
        self._last, self._path = b"", [self._start]

    def packed(self, piece: bytes) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers; what is settled leaves the state as it is read."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return _pack((whole,))
        # pieces come sorted: what this one begins like, up to an emission, was read before
        same, path = 0, self._path
        for x, y in zip(piece, self._last):
            if x != y:
                break
            same += 1
        same = min(same, len(path) - 1)
        del path[same + 1 :]
        state, out = path[same], bytearray()
        for byte in memoryview(piece)[same:]:
            known = state[3]
            found = known and known.get(byte)
            if not found:
                if self._transitions >= MAX_TRANSITIONS:
                    self._restart()
                    path = []  # no more of this piece's path is kept
                found = self._step(state, byte)
                found = found[0], found[1] and _pack(found[1])
                if known is not None:
                    known[byte] = found
                    self._transitions += 1
            state, emitted = found
            if emitted:
                out += emitted
                path = []
            elif path:
                path.append(state)
        self._last = piece
        out += _pack(self._tokens(state[2], len(state[2])))
        return bytes(out)

    def encode_piece(self, piece: bytes) -> list[int]:
        return [i for i, in struct.iter_unpack("<I", self.packed(piece))]


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self._split = regex.compile(pattern).findall
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        memo, older = self._memo, self._older
        new = []
        for piece in {p for pieces in split for p in pieces if p not in memo}:
            if piece in older:
                memo[piece] = older[piece]
            else:
                new.append(piece)
        new.sort()  # pieces of one prefix meet its transitions before the tables start anew
        for piece in new:
            memo[piece] = self.transducer.packed(piece.encode())
        out = [b"".join([memo[p] for p in pieces]) for pieces in split]
        if len(memo) > MEMO_PIECES:  # pieces not met since the last turn over go
            self._memo, self._older = {}, memo
        return out


#: Of a lead byte, how many bytes its code point has.
_WIDTH = bytes(1 if b < 0x80 else 2 if 0xC0 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if b >= 0xF0 else 0 for b in range(256))


class Utf8Decoder:
    """Ids in, text out as code points become complete; ``close`` gives what is left over.

    The state is the bytes (three at most) of a code point begun but not ended.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self._bytes_of = bytes_of
        self._open = b""

    def feed(self, ids) -> str:
        data = self._open + b"".join(map(self._bytes_of.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            width = _WIDTH[data[-back]]
            if width:
                if width > back:
                    cut -= back
                break
        self._open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self._open = self._open, b""
        return left.decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(rank_path: str, pattern: str) -> Encoder:
    """One for each worker process; the rank file has to be at the same path on every machine."""
    key = (rank_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(rank_path), pattern)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, *, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, portion: int = 1 << 16, carry: bool = False) -> DataFrame:
    """Ids of every whole text and the text decoded from them in a stream.

    Returns id (with carry the input as ``row`` and ``text``), n_tokens, ids (array, with keep_ids),
    ids_sha256 (of little-endian uint32) and decoded_sha256 (of the decoded UTF-8 bytes).
    Null and empty texts have no tokens; equal texts get equal results; null or repeated ids give a row each; an empty table gives no rows; other
    columns are ignored or, with carry, kept in ``row`` whatever their names.  A long text is split into pieces at once, and a long piece is
    read byte by byte with its ids, which are decoded in portions.
    """

    def work(texts: list[bytes | None]):
        # the tables are made of tuples and never in cycles: the collector would go through all of them again and again
        collecting = gc.isenabled()
        gc.disable()
        try:
            return encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def encoded(texts: list[bytes | None]):
        encoder = _encoder(rank_path, pattern)
        counts, ids, id_hashes, hashes = [], [], [], []
        for packed in encoder.encode([(raw or b"").decode("utf-8", "replace") for raw in texts]):
            tokens = np.frombuffer(packed, "<u4")
            decoder, digest = Utf8Decoder(encoder.transducer.bytes_of), hashlib.sha256()
            for at in range(0, len(tokens), portion):
                digest.update(decoder.feed(tokens[at : at + portion].tolist()).encode())
            digest.update(decoder.close().encode())
            counts.append(len(tokens))
            ids.append(tokens.astype(np.int32))
            id_hashes.append(hashlib.sha256(packed).hexdigest())
            hashes.append(digest.hexdigest())
        return (counts, ids, id_hashes, hashes) if keep_ids else (counts, id_hashes, hashes)

    ddl = "n_tokens long, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return annotated(docs, work, ddl, id_col=id_col, text_col=text_col, carry=carry)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(
        table(spark, sf_dir, "documents"), rank_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN, keep_ids=False,
    )
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
