"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding: a token sequence is the BPE encoding of its bytes exactly if every two neighbours
stay as they are when their joined bytes are encoded. So the encoding of each prefix ends
in one certain token, and a byte-by-byte machine can keep all prefixes at which a later
token may still begin, each with its encoding. Tokens common to all of them are certain and
leave at once; since vocabulary tokens are short, the lookahead is bounded. What is left,
with the trie places of the open tokens, is the machine's state. States and transitions are
made once they have been met some times (rare ones are followed prefix by prefix) and forgotten
together when there are too many.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame

from glyphloom.llm.common import arrow_rows

MAX_STATES = 200_000
MAX_CHUNKS = 400_000
MAX_PIECES = 350_000
MAX_PAIRS = 500_000
MAX_MISSED = 400_000
MEETINGS = 12
"""Times that a transition has to be met before it is made."""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    """Encodes one pattern match at a time; emits ids, keeps no text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        # The vocabulary as a trie: per node its children by byte and the token that ends there.
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                at = self.children[node].get(b)
                if at is None:
                    at = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(None)
                node = at
            self.token_at[node] = rank
        self.own: set[int] = set()
        self._forget()

    def _forget(self) -> None:
        # A state is a tuple of open prefixes: trie node of the bytes since, its tokens not yet
        # emitted, and how many tokens at their front are emitted ones kept as context (0 or 1).
        start = ((0, (), 0),)
        self.number = {start: 0}
        self.states: list[tuple] = [start]
        self.flush: list[tuple[int, ...] | None] = [()]
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state * 256 + byte
        self.missed: dict[int, int] = {}

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of ``piece``; a piece that is itself in the vocabulary is one token, as in tiktoken."""

        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        out: tuple[int, ...] = ()
        state, steps = 0, self.steps
        for at, b in enumerate(piece):
            key = state << 8 | b
            hop = steps.get(key)
            if hop is None:
                met = self.missed.get(key, 0) + 1
                if met < MEETINGS:
                    self.missed[key] = met
                    return out + self._undetermined(self.states[state], piece[at:])
                if len(self.states) >= self.max_states or len(self.missed) > MAX_MISSED:
                    here = self.states[state]
                    self._forget()
                    steps, state = self.steps, self._intern(here)
                hop = steps[state << 8 | b] = self._step(self.states[state], b)
            state, emitted = hop
            if emitted:
                out += emitted
        left = self.flush[state]
        if left is None:  # tokens of the prefix that is the whole input
            left = self.flush[state] = next(tokens[known:] for node, tokens, known in self.states[state] if node == 0)
        return out + left

    def _undetermined(self, state: tuple, rest: bytes) -> tuple[int, ...]:
        """Tokens still to emit after ``rest``, by the open prefixes themselves, without new states.

        A transition is made when it is missed for the ``MEETINGS``-th time, so what is met
        often gets its states and what is met once costs no more than this.
        """

        children, token_at, pairs, own = self.children, self.token_at, self.pairs, self.own
        live = [(node, tokens[-1] if tokens else -1, tokens[known:]) for node, tokens, known in state]
        whole = next(x for x in live if not x[0])
        for b in rest:
            onward, whole = [], None
            for node, last, path in live:
                at = children[node].get(b)
                if at is None:
                    continue
                if whole is None:
                    token = token_at[at]
                    if token is not None and (token in own or self._own(token, at)):
                        stays = True if last < 0 else pairs.get(last << 32 | token)
                        if stays or stays is None and self._stay(last, token):
                            whole = (0, token, (*path, token))
                if children[at]:
                    onward.append((at, last, path))
            onward.append(whole)
            live = onward
        return whole[2]

    def _intern(self, state: tuple) -> int:
        at = self.number.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
            self.flush.append(None)
        return at

    def _step(self, state: tuple, b: int) -> tuple[int, tuple[int, ...]]:
        children, token_at = self.children, self.token_at
        live, whole = [], None
        for node, tokens, known in state:
            at = children[node].get(b)
            if at is None:
                continue
            if whole is None:
                token = token_at[at]
                if token is not None and self._own(token, at) and (not tokens or self._stay(tokens[-1], token)):
                    whole = (0, (*tokens, token), known)
            if children[at]:
                live.append((at, tokens, known))
        if whole is None:
            raise ValueError("the vocabulary lacks a single byte")
        live.append(whole)
        # Emit what all open prefixes share; keep the last emitted token as context.
        known, tokens = whole[2], whole[1]
        same = min([len(t) for _, t, _ in live])
        while same > known and any(t[:same] != tokens[:same] for _, t, _ in live):
            same -= 1
        cut = max(same - 1, 0)
        return self._intern(tuple([(node, t[cut:], same - cut) for node, t, _ in live])), tokens[known:same]

    def _own(self, token: int, node: int) -> bool:
        """Whether the merges give the token for its own bytes; others are never part of an encoding."""

        if token not in self.own:
            if self.merge(self.bytes_of[token]) != [token]:
                self.token_at[node] = None
                return False
            self.own.add(token)
        return True

    def _stay(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def merge(self, piece: bytes) -> list[int]:
        """BPE by its definition, for two tokens' bytes: join the neighbours of least rank, the first of equals."""

        get, none = self.ranks.get, 1 << 40
        cuts = list(range(len(piece) + 1))
        costs = [get(piece[k : k + 2], none) for k in range(len(piece) - 1)]
        while costs:
            least = min(costs)
            if least == none:
                break
            at = costs.index(least)
            del cuts[at + 1], costs[at]
            if at < len(costs):
                costs[at] = get(piece[cuts[at] : cuts[at + 2]], none)
            if at:
                costs[at - 1] = get(piece[cuts[at - 1] : cuts[at + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


# First bytes of UTF-8 sequences: (from, to, following bytes, least and largest second byte).
LEADS = (
    (0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
)
LEAD_OF = {b: (more, low, high) for first, last, more, low, high in LEADS for b in range(first, last + 1)}


class Utf8Stream:
    """Incremental UTF-8: bytes in any cuts, text out as soon as characters are complete.

    State between feeds: the bytes of the open character, how many are to come, and the
    range of the next one. A byte that can't follow ends the open character as U+FFFD.
    """

    def __init__(self) -> None:
        self.open, self.more, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.more and data.isascii():
            return data.decode("ascii")
        out, at = [], 0
        while self.more and at < len(data):
            at += self._byte(data[at], out)
        stop = self._boundary(data, at)
        try:
            out.append(data[at:stop].decode("utf-8"))
        except UnicodeDecodeError:
            stop = at
        while stop < len(data):
            stop += self._byte(data[stop], out)
        return "".join(out)

    def finish(self) -> str:
        left = "�" if self.open else ""
        self.__init__()
        return left

    @staticmethod
    def _boundary(data: bytes, at: int) -> int:
        """The last place from ``at`` on before which no character is cut."""

        for back in range(1, min(4, len(data) - at) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                return len(data) if LEAD_OF.get(b, (0,))[0] < back else len(data) - back
        return len(data)

    def _byte(self, b: int, out: list[str]) -> int:
        """Take one byte; 0 if it has to be looked at again as the first of a character."""

        if not self.more:
            lead = LEAD_OF.get(b)
            if lead is None:
                out.append("�")
            elif not lead[0]:
                out.append(chr(b))
            else:
                self.more, self.low, self.high = lead
                self.open.append(b)
            return 1
        if not self.low <= b <= self.high:
            self.__init__()
            out.append("�")
            return 0
        self.open.append(b)
        self.more, self.low, self.high = self.more - 1, 0x80, 0xBF
        if not self.more:
            out.append(self.open.decode("utf-8"))
            self.open.clear()
        return 1


class Codec:
    """Encodes and decodes whole texts; chunks met again come from a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES) -> None:
        import regex

        self.machine = Transducer(ranks, max_states)
        self.split = regex.compile(pattern).findall
        self.runs = regex.compile(r"\s ").search
        self.table = [self.machine.bytes_of.get(k, b"") for k in range(max(self.machine.bytes_of) + 1)]
        self.decimal = [str(k) for k in range(len(self.table))]
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of every match of the pattern, each encoded by itself.

        A chunk from a space that stands between other characters up to the next is a unit of
        the pattern; texts with white space before a space are taken whole.
        """

        if self.runs(text):
            chunks = [text]
        else:
            first, *rest = text.split(" ")
            chunks = [" " + c for c in rest]
            if first:
                chunks.insert(0, first)
        known = self.known
        try:
            return list(chain.from_iterable(map(known.__getitem__, chunks)))
        except KeyError:
            pass
        if len(known) > MAX_CHUNKS:
            known.clear()
        out: list[int] = []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = tuple(chain.from_iterable(map(self._piece, self.split(chunk))))
                if len(chunk) < 64:
                    known[chunk] = ids
            out += ids
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
            if len(self.pieces) > MAX_PIECES:  # what was met since the last change of generation stays
                self.older, self.pieces = self.pieces, {}
            if len(piece) < 64:
                self.pieces[piece] = ids
        return ids

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode_stream(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """Text of id lists that arrive one after the other; characters may be cut between tokens."""

        stream = Utf8Stream()
        for ids in parts:
            yield stream.feed(self.decode_bytes(ids))
        yield stream.finish()


_CODECS: dict[tuple[str, str], Codec] = {}


def file_codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


DECODE_IDS = 4_096
"""Ids that the streaming decoder gets at once."""


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, SHA-256 of the ids and of the bytes the ids decode to.

    Null text is empty (no ids). Rows keep their partition; each slice of texts is encoded
    and decoded and nothing but the digests leaves it.
    """

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        codec = file_codec(path, pattern)
        for part in slices:
            out = []
            for doc_id, value in part:
                ids = codec.encode(value or "")
                digest = hashlib.sha256()
                for decoded in codec.decode_stream(ids[k : k + DECODE_IDS] for k in range(0, len(ids), DECODE_IDS)):
                    digest.update(decoded.encode())
                out.append((doc_id, len(ids), hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest(), digest.hexdigest()))
            yield out

    kind = dict(docs.dtypes)[key]
    return arrow_rows(docs, [key, text], f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows)
