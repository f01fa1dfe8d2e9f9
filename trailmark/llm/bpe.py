"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that a string automaton over the vocabulary finds the
tokens that start at every position of a piece. Tokens are laid from the left, the longest first.
A token may follow another only if merging the two tokens' bytes alone gives back these two; a
sequence in which all neighbours fit is the one that the merges produce. As every token ranks after
its parts, that is seen from the parts that touch the border in the course of the merges. Where nothing fits, the
position is marked dead and the last token is shortened; no position is tried twice. The answers
for neighbours are memoised, and so are whole pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES_HELD = 200_000
PAIRS_HELD = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encoder and decoder for one vocabulary of ranks that holds all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._split = regex.compile(pattern).findall
        self._parts: dict[bytes, tuple[bytes, bytes]] = {}
        # The automaton reads a piece from its end: what ends there, reversed, starts in the piece.
        self._automaton = ahocorasick.Automaton()
        self._in_order = True
        for token, rank in ranks.items():
            parts = self._merge(token, until=2)
            if len(parts) > 2 or (len(parts) == 2 and parts[0] + parts[1] != token):
                continue  # never made by merges
            if len(parts) == 2:
                self._parts[token] = (parts[0], parts[1])
                self._in_order &= max(ranks[parts[0]], ranks[parts[1]]) < rank
            self._automaton.add_word(token[::-1].decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._edges = {}
        self._fits = common.BoundedCache(self._pair_fits, PAIRS_HELD)
        self._piece = common.BoundedCache(self._encode_piece, PIECES_HELD)
        self._named = common.BoundedCache(lambda p: ",".join(map(str, self._encode_piece(p))), PIECES_HELD)
        self._by_name = {str(rank): token for rank, token in self.tokens.items()}

    def _merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """The merges themselves, on the bytes of a token or two: always the lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranked = [(self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[bytes]:
        """The parts at the left (0) or right (1) end of a token, from its outer byte to the token."""
        found = self._edges.get((token, side))
        if found is None:
            part = self.tokens[token]
            found = [part]
            while part in self._parts:
                part = self._parts[part][side]
                found.append(part)
            found.reverse()
            self._edges[token, side] = found
        return found

    def _pair_fits(self, pair: tuple[int, int]) -> bool:
        if not self._in_order:
            left, right = self.tokens[pair[0]], self.tokens[pair[1]]
            return self._merge(left + right) == [left, right]
        ranks, never = self.ranks, 1 << 40
        lefts, rights = self._edge(pair[0], 1), self._edge(pair[1], 0)
        i = j = 0
        while True:
            # Ranks at which the touching parts grow, and at which they would join across the border.
            grow_left = ranks[lefts[i + 1]] if i + 1 < len(lefts) else never
            grow_right = ranks[rights[j + 1]] if j + 1 < len(rights) else never
            across = ranks.get(lefts[i] + rights[j], never)
            if across < grow_left and across <= grow_right and across < never:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:  # of equal ranks the leftmost is merged first
                i += 1
            else:
                j += 1

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n, starts = len(data), [[] for _ in data]
        for end, found in self._automaton.iter(data[::-1].decode("latin-1")):
            starts[n - 1 - end].append(found)  # the longest comes first
        ids: list[int] = []
        left: list[tuple[int, Iterator]] = []  # position and untried tokens of each laid token
        dead = bytearray(n + 1)
        at, untried = 0, iter(starts[0])
        while at < n:
            for token, length in untried:
                if not dead[at + length] and (not ids or self._fits[ids[-1], token]):
                    ids.append(token)
                    left.append((at, untried))
                    at += length
                    untried = iter(starts[at]) if at < n else iter(())
                    break
            else:
                dead[at] = 1
                at, untried = left.pop()
                ids.pop()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self._split(text) for i in self._piece[piece]]

    def encode_named(self, text: str) -> str:
        """The ids as decimal numbers joined by commas."""
        return ",".join(map(self._named.__getitem__, self._split(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_named(self, named: str) -> bytes:
        return b"".join(map(self._by_name.__getitem__, named.split(","))) if named else b""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    import public_tokenizers

    return Encoder(read_ranks(path), public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, ids`: the token ids of every whole text. A null or empty text has none; repeated rows and
    null ids stay as they are."""
    path = path or default_path()

    def run(batch):
        of = encoder(path).encode
        return pa.record_batch(
            [batch.column(0), pa.array([of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))],
            names=["id", "ids"],
        )

    texts = common.keyed_texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(common.per_batch(run), f"id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """`id, data`: the bytes of `id, ids`. Null ids give no bytes."""
    path = path or default_path()

    def run(batch):
        of = encoder(path).decode
        return pa.record_batch(
            [batch.column(0), pa.array([of(t or ()) for t in batch.column(1).to_pylist()], pa.binary())],
            names=["id", "data"],
        )

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "ids").mapInArrow(common.per_batch(run), f"id {kind}, data binary")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_tokens, ids_sha256, decoded_sha256`: encodes and decodes each text in one pass, so that
    only digests leave the task. Nulls as in `encode`."""
    path = path or default_path()

    def run(batch):
        own = encoder(path)
        counts, ids, back = [], [], []
        for text in batch.column(1).to_pylist():
            named = own.encode_named(text)
            counts.append(named.count(",") + 1 if named else 0)
            ids.append(hashlib.sha256(named.encode()).hexdigest())
            back.append(hashlib.sha256(own.decode_named(named)).hexdigest())
        return pa.record_batch(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    texts = common.keyed_texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(
        common.per_batch(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_bpe(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return round_trip(docs).withColumnRenamed("id", "doc_id")
