"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. A byte string has exactly one sequence of tokens in which every two neighbours are
themselves the encoding of their joined bytes, and that sequence is its encoding. The transducer
reads bytes and keeps every hypothesis that may still become it: the last whole token, the token
being read (a node of the vocabulary's trie), and the ids not yet certain. Sets of hypotheses are
the states of a deterministic machine that is built only where texts lead; the ids all hypotheses
share are emitted at once, so an id waits no longer than the longest token. Transitions and whole
pieces of text are remembered, up to a bound, after which the memory is started anew.

Decoding. Ids are turned into bytes one by one and run through a UTF-8 state machine that keeps only
the bytes of an unfinished character; malformed bytes become U+FFFD as in ``bytes.decode``. Ids
that leave the machine between characters take a remembered path.

Cases: a null or empty text has no ids and decodes to nothing; texts of any length are read piece by
piece; rows that repeat repeat their result, a null doc_id is kept; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
REMEMBERED = 400_000  # pieces of text kept at once
STATES = 300_000  # states of the machine kept at once
NEVER = 1 << 60
LONGEST_KEPT = 64  # characters of a remembered piece


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = self.child.get(node << 8 | byte)
                if step is None:
                    step = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = step
            self.token_at[node] = rank
        self.fits: dict[int, bool] = {}  # left << 32 | right
        self.made_of: dict[int, tuple[int, int]] = {}
        self.forget()

    def forget(self) -> None:
        start = ((-1, 0, ()),)
        self.state_of, self.states = {start: 0}, [start]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: merging its bytes lowest rank first, what the last merge joins."""
        known = self.made_of.get(token)
        if known is None:
            piece, ranks = self.bytes_of[token], self.ranks
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                found = [ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
                i = found.index(min(found))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.made_of[token] = (ranks[parts[0]], ranks[parts[1]])
        return known

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their joined bytes.

        Their merges are undone from the last; a merge across the border that comes before the one
        just undone would have taken its place. At equal ranks the merge further left comes first.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) >= 2_000_000:
            self.fits.clear()
        bytes_of, ranks, limit = self.bytes_of, self.ranks, NEVER
        while ranks.get(bytes_of[left] + bytes_of[right], NEVER) >= limit:
            a = left if len(bytes_of[left]) > 1 else -1
            b = right if len(bytes_of[right]) > 1 else -1
            if a > b:
                limit, left = a, self.halves(left)[1]
            elif b >= 0:
                limit, right = b + 1, self.halves(right)[0]
            else:
                self.fits[key] = True
                return True
        self.fits[key] = False
        return False

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the ids that are now certain.

        Hypotheses stand in the order of their open token's length, which no two share; at most one
        ends with a whole token, as the bytes so far have one encoding.
        """
        child, inner, token_at, whole, found = self.child, self.inner, self.token_at, None, []
        for last, node, pending in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                found.append((last, node, pending))
            if whole is None and (token := token_at[node]) >= 0 and (last < 0 or self.neighbours(last, token)):
                whole = (token, 0, pending + (token,))
        if whole:
            found.append(whole)
        if not found:
            raise ValueError("a byte that the vocabulary lacks")
        out = found[0][2]
        for _, _, pending in found:
            if out and pending[: len(out)] != out:
                n = 0
                while n < len(pending) and n < len(out) and pending[n] == out[n]:
                    n += 1
                out = out[:n]
        key = tuple([(last, node, p[len(out) :]) for last, node, p in found]) if out else tuple(found)
        to = self.state_of.get(key)
        if to is None:
            to = self.state_of[key] = len(self.states)
            self.states.append(key)
        return to, out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of text, as its bytes arrive."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.forget()
        out: list[int] = []
        state, moves = 0, self.moves
        for at, byte in enumerate(piece):
            move = moves.get(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self.step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
            if at & 0xFFFF == 0xFFFF and len(self.states) > STATES:  # very long pieces
                key = self.states[state]
                self.forget()
                moves, state = self.moves, self.state_of.setdefault(key, 1)
                if state:
                    self.states.append(key)
        last, node, pending = self.states[state][-1]
        if node:
            raise ValueError("no encoding")
        return out + list(pending)


class Utf8Machine:
    """Bytes to text as they come; keeps the bytes of an unfinished character."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.clean: dict[int, str | None] = {}
        for i, token in bytes_of.items():
            try:
                self.clean[i] = token.decode()
            except UnicodeDecodeError:
                self.clean[i] = None

    def decode(self, ids: Iterator[int] | list[int]) -> Iterator[str]:
        """Text of each id, complete characters only; ends with what an unfinished character becomes."""
        decoder, clean, bytes_of = self.decoder, self.clean, self.bytes_of
        decoder.reset()
        between = True  # whether no character is unfinished
        for i in ids:
            if between and (text := clean[i]) is not None:
                yield text
                continue
            yield decoder.decode(bytes_of[i])
            between = not decoder.getstate()[0]
        yield decoder.decode(b"", True)

    def text(self, ids: list[int]) -> str:
        parts = list(map(self.clean.__getitem__, ids))
        return "".join(self.decode(ids)) if None in parts else "".join(parts)


class Coder:
    """Whole texts to ids and back, with the pattern that splits them before the merges."""

    def __init__(self, path: str = MULTI):
        import regex

        self.machine = Transducer(load_ranks(path))
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.decoder = Utf8Machine(self.machine.bytes_of)
        self.known: dict[str, list[int]] = {}
        self.digits = [str(i) for i in range(1 + max(self.machine.bytes_of))]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.split.findall(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = self.machine.encode_piece(piece.encode())
                if len(piece) <= LONGEST_KEPT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


WARM: dict[str, Coder] = {}


def warm(vocabulary: str) -> Coder:
    """This worker process' coder of a vocabulary, which keeps what it has learnt between batches and tasks."""
    if vocabulary not in WARM:
        WARM[vocabulary] = Coder(vocabulary)
    return WARM[vocabulary]


def encoded(docs: DataFrame, vocabulary: str = MULTI) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""
    return _run(docs, vocabulary, "doc_id long, ids array<int>, decoded string", lambda coder, ids, text: (ids, text))


def _run(docs: DataFrame, vocabulary: str, schema: str, result) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        coder = warm(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                found = []
                for text in part.column(1).to_pylist():
                    ids = coder.encode(text)
                    found.append(result(coder, ids, coder.decoder.text(ids)))
                columns = list(zip(*found)) if found else [[] for _ in types[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str = MULTI) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def result(coder, ids, text):
        from hashlib import sha256

        return len(ids), sha256(",".join(map(coder.digits.__getitem__, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()

    return _run(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", result)


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
