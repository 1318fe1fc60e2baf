"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Merging by rank gives, for every text, the one sequence of tokens whose
neighbours are stable: merging the bytes of two neighbours gives those two
again.  That makes encoding a rational relation: a nondeterministic transducer
guesses where tokens end, and a guess survives if the new token is stable next
to the one before.  Determinising it by subsets gives states that hold, for
each token that may be under way, its node in the vocabulary's trie, the token
before it and the tokens not yet emitted; what all guesses agree on is emitted.
A guess lives as long as the trie goes on, so the lookahead is at most the
longest token.  States and transitions are made when first met and dropped
together when there are too many.

The decoder turns ids into bytes block by block and hands complete characters
on through an incremental UTF-8 state machine, so a block may end inside a
character.

Defined results: a null or empty text has no ids and decodes to an empty text;
rows with equal ids are encoded one by one; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import gc
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import REMEMBERED, ChunkMemory
from .common import slices, table, whole_text

# States kept before all are dropped.
STATES = 150_000
# Pairs of neighbours whose stability is remembered.
PAIRS = 500_000
# Ids decoded at a time.
BLOCK = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Bytes of one match of the pattern to token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie: the children of each node, and the token that ends there.
        leaf: dict[int, int] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.children[node]
                if below is leaf:
                    below = self.children[node] = {}
                following = below.get(byte)
                if following is None:
                    following = below[byte] = len(self.children)
                    self.children.append(leaf)
                    self.token_at.append(-1)
                node = following
            self.token_at[node] = rank
        self.stable: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self._reset()

    def _reset(self) -> None:
        # A guess is (tokens not yet emitted, the token before, the node of the token under way).
        start = (((), -1, 0),)
        self.states = [start]
        self.number = {start: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _begun_anew(self, state: int) -> int:
        """Forget all states but ``state``, which may be in the middle of a match."""
        guesses = self.states[state]
        self._reset()
        if guesses not in self.number:
            self.number[guesses] = len(self.states)
            self.states.append(guesses)
            self.steps.append({})
        return self.number[guesses]

    def _spines(self, token: int) -> tuple[list, list] | None:
        """What merging makes at the left and at the right end of a token: (bytes, the rank that takes it up), None if it isn't made."""
        found = self.edges.get(token, 0)
        if found != 0:
            return found
        data = self.bytes_of[token]
        left, right = [], []
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                self.edges[token] = None
                return None
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        left.append((data, 1 << 40))
        right.append((data, 1 << 40))
        self.edges[token] = left, right
        return left, right

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether merging keeps ``token`` after ``before``, -1 for none.

        Merging works through the ranks in order, so two parts at the border
        merge across it if their rank comes before what takes up the one on the
        left, and not after what takes up the one on the right.
        """
        spines = self._spines(token)
        if before < 0 or spines is None:
            return spines is not None
        kept = self.stable.get((before, token))
        if kept is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            ranks, kept = self.ranks, True
            for a, until_a in self._spines(before)[1]:
                for b, until_b in spines[0]:
                    rank = ranks.get(a + b)
                    if rank is not None and rank < until_a and rank <= until_b:
                        kept = False
                        break
                if not kept:
                    break
            self.stable[before, token] = kept
        return kept

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of ``state`` by ``byte``."""
        guesses, ended = [], None
        children, token_at, stable = self.children, self.token_at, self.stable
        for guess in self.states[state]:
            pending, before, node = guess
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node]:
                guesses.append((pending, before, node))
            if ended is None:
                token = token_at[node]
                if token >= 0:
                    kept = stable.get((before, token))
                    if kept or kept is None and self._may_follow(before, token):
                        ended = ((*pending, token), token, 0)
        if not guesses:
            emitted, key = ended[0], (((), ended[1], 0),)
        elif not guesses[0][0]:  # the guess under way longest has nothing pending, so nothing is agreed on
            guesses.append(ended)
            emitted, key = (), tuple(guesses)
        else:
            out = min(len(g[0]) for g in guesses)
            while out and any(g[0][:out] != ended[0][:out] for g in guesses):
                out -= 1
            guesses.append(ended)
            emitted = ended[0][:out]
            key = tuple([(pending[out:], before, node) for pending, before, node in guesses])
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        step = self.steps[state][byte] = (target, emitted)
        return step

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, steps = 0, [], self.steps
        for byte in piece:
            found = steps[state].get(byte)
            if found is None:
                if len(self.states) > STATES:
                    state, steps = self._begun_anew(state), self.steps
                found = self._step(state, byte)
            state, emitted = found
            if emitted:
                out += emitted
        out += self.states[state][-1][0]  # the guess that has just ended
        return out


class BpeEncoder(ChunkMemory):
    """Ids of texts by the transducer, one match of the pattern at a time."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.ranks = load_ranks(path)
        self.matches = regex.compile(pattern)
        self.transducer = Transducer(self.ranks)
        self.pieces: dict[str, bytes] = {}
        size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            ids = array("I", self.transducer.encode(piece.encode())).tobytes()
            if len(piece) < 64:
                self.pieces[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return b"".join(self._piece(m.group()) for m in self.matches.finditer(text))

    def spaced(self, chunks: list[str]) -> list[bytes]:
        out: list[list[bytes]] = []
        for m in self.matches.finditer("".join(" " + c for c in chunks)):
            piece = m.group()
            if piece[0] == " ":  # only a chunk's first match has a space
                out.append([])
            out[-1].append(self._piece(piece))
        return list(map(b"".join, out))

    def encode(self, texts: list[str]) -> list[bytes]:
        # The tables are very many small objects without cycles, which the collector would walk again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return super().encode(texts)
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text of the ids, in parts that end with whole characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        numbers = memoryview(ids).cast("I")
        for at in range(0, len(numbers), BLOCK):
            block = b"".join(map(self.bytes_of.__getitem__, numbers[at : at + BLOCK]))
            yield machine.decode(block, at + BLOCK >= len(numbers))


_ENCODERS: dict[tuple[str, str], BpeEncoder] = {}


def transcode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ids (little-endian unsigned 32-bit integers) and decoded, the text of these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern)
        if key not in _ENCODERS:  # one per worker; it outlives a task
            _ENCODERS[key] = BpeEncoder(*key)
        encoder = _ENCODERS[key]
        for batch in batches:
            for at, upto in slices(batch.column(1)):
                ids = encoder.encode(batch.column(1)[at:upto].to_pylist())
                decoded = ["".join(encoder.decode(x)) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:upto], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"]
                )

    plain = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return plain.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = transcode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
