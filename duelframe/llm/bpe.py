"""Byte-level BPE: encoding by a table of last tokens, and decoding.

Every prefix of a piece has one valid last token, so a table with the last token
of each prefix holds the encoding of all of them. It grows at its end when bytes
are appended, and an edit changes it from the edit up to where it agrees again.

A null or empty text has no tokens. Rows with an equal doc_id are encoded one
by one. Other columns are kept by ``encode``, but for one with the name of the ids,
which is replaced, and not read by ``token_report``. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import column

# White space as Unicode defines the property.
SPACES = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)

# Entries of each look-up table that a worker remembers; beyond, it begins anew.
REMEMBERED = 1_000_000

NONE = 1 << 62

# The ids as text, their number, and the bytes they stand for.
Digest = tuple[str, int, bytes]


@dataclass
class Vocabulary:
    """Ranks of byte strings, and the pattern that splits a text into pieces.

    ``blanks_apart`` says that a piece has a blank at its begin only, unless it is
    all white space; then stretches between blanks may be split apart from each other.
    """

    ranks: dict[bytes, int]
    pattern: str
    blanks_apart: bool = False

    @classmethod
    def load(cls, path: str, pattern: str, blanks_apart: bool = False) -> Vocabulary:
        """From a file of lines with a token in base64 and its rank."""
        with open(path, "rb") as file:
            rows = (line.split() for line in file)
            return cls({base64.b64decode(r[0]): int(r[1]) for r in rows if r}, pattern, blanks_apart)

    @cached_property
    def halves(self) -> dict[bytes, tuple[bytes, bytes]]:
        """The two tokens that are merged last into each token that merging reaches."""
        found = {}
        for token in self.ranks:
            if len(token) > 1:
                parts = self._merged(token, until=self.ranks[token])
                if len(parts) == 2:
                    found[token] = (parts[0], parts[1])
        return found

    @cached_property
    def splitter(self) -> regex.Pattern:
        spelled = self.pattern.replace(r"[^\s", "[^" + SPACES).replace(r"\S", f"[^{SPACES}]")
        return regex.compile(spelled.replace(r"\s", f"[{SPACES}]"))

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ranks), default=1)

    @cached_property
    def encoder(self) -> Encoder:
        """Kept as long as a worker keeps the broadcast vocabulary."""
        return Encoder(self)

    def __getstate__(self) -> dict:
        self.halves  # worked out once, on the driver  # noqa: B018
        return {k: v for k, v in self.__dict__.items() if k not in ("splitter", "encoder")}

    def _merged(self, token: bytes, until: int) -> list[bytes]:
        """The token's bytes after all merges of a rank below ``until``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1)
            )
            if rank >= until:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Merges:
    """Verdicts on neighbouring tokens, remembered."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.tokens = {rank: token for token, rank in vocab.ranks.items()}
        # the tokens that merging reaches
        self.usable = {t: r for t, r in vocab.ranks.items() if len(t) == 1 or t in vocab.halves}
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.chains: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}

    def _chain(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at one end of a token, each with the rank that merges it away."""
        chain = self.chains.get((token, side))
        if chain is None:
            chain, part, merged_at = [], token, NONE
            while part in self.vocab.halves:
                chain.append((part, merged_at))
                merged_at = self.vocab.ranks[part]
                part = self.vocab.halves[part][side]
            chain.append((part, merged_at))
            self.chains[token, side] = chain
        return chain

    def fits(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes leaves the two as they are.

        It doesn't if parts that meet at the border are merged before either is
        merged into its own token; of equal ranks the leftmost goes first.
        """
        known = self.verdicts.get((left, right))
        if known is None:
            if len(self.verdicts) >= REMEMBERED:
                self.verdicts.clear()
            rank_of = self.vocab.ranks.get
            known = not any(
                (rank := rank_of(a + b)) is not None and rank < a_at and rank <= b_at
                for a, a_at in self._chain(self.tokens[left], 1)
                for b, b_at in self._chain(self.tokens[right], 0)
            )
            self.verdicts[left, right] = known
        return known



class Prefixes:
    """The encoding of every prefix of a piece: ``last[i]`` ends the first ``i`` bytes."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.data = bytearray()
        self.last = [-1]

    def _extend(self, to: int) -> None:
        """Fill the table up to ``to`` bytes."""
        data, last, merges = self.data, self.last, self.merges
        for end in range(len(last), to + 1):
            for start in range(max(0, end - merges.vocab.longest), end):
                rank = merges.usable.get(bytes(data[start:end]))
                if rank is not None and (start == 0 or merges.fits(last[start], rank)):
                    last.append(rank)
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start`` to ``end``; how many places were worked out anew.

        A place depends on as many before it as the longest token has bytes: once
        so many in a row agree with the old table, the rest does.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data[start:end] = new
        self.last = old[: start + 1]
        same, at = 0, start + 1
        while at <= len(self.data) and same < self.merges.vocab.longest:
            self._extend(at)
            beyond = at > start + len(new)
            same = same + 1 if beyond and self.last[at] == old[at - shift] else 0
            at += 1
        self.last += old[at - shift :]
        return at - start - 1

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the first ``upto`` bytes, of all by default."""
        at = len(self.data) if upto is None else upto
        found = []
        while at:
            found.append(self.last[at])
            at -= len(self.merges.tokens[self.last[at]])
        return found[::-1]


class Encoder:
    """Encodes pieces: an automaton finds the tokens that end at each byte."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.merges = vocab, Merges(vocab)
        self.ending = ahocorasick.Automaton()
        for token, rank in self.merges.usable.items():
            self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()
        self.shown: dict[str, Digest] = {}
        self.runs: dict[str, Digest] = {}

    def piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last = [-1] * (n + 1)
        verdict, fits = self.merges.verdicts.get, self.merges.fits
        for at, (rank, size) in self.ending.iter(piece.decode("latin-1")):
            if last[at + 1] >= 0:
                continue
            start = at + 1 - size
            if start:
                left = last[start]
                fitting = verdict((left, rank))
                if not (fits(left, rank) if fitting is None else fitting):
                    continue
            last[at + 1] = rank
        ids, tokens = [], self.merges.tokens
        while n:
            if last[n] < 0:
                raise ValueError(f"byte {piece[n - 1]} is not in the vocabulary")
            ids.append(last[n])
            n -= len(tokens[last[n]])
        return ids[::-1]

    def ids(self, text: str) -> list[int]:
        pieces = self.vocab.splitter.findall(text)
        found = {p: self.piece(p.encode()) for p in set(pieces)}
        return [rank for p in pieces for rank in found[p]]

    def _digest(self, piece: str) -> Digest:
        found = self.shown.get(piece)
        if found is None:
            if len(self.shown) >= REMEMBERED:
                self.shown.clear()
            ids = self.piece(piece.encode())
            data = decoded(ids, self.merges.tokens)
            found = self.shown[piece] = (" ".join(map(str, ids)), len(ids), data)
        return found

    def _run(self, run: str) -> Digest | None:
        """A blank and what follows up to the next; None if the pattern may not split there."""
        if not run or run[0] in SPACES or run[-1] in SPACES:
            return None
        if len(self.runs) >= REMEMBERED:
            self.runs.clear()
        parts = [self._digest(p) for p in self.vocab.splitter.findall(" " + run)]
        found = self.runs[run] = (
            " ".join(p[0] for p in parts),
            sum(p[1] for p in parts),
            b"".join(p[2] for p in parts),
        )
        return found

    def digests(self, text: str) -> list[Digest]:
        """The digests of a text's pieces, or of runs of them where blanks keep pieces apart.

        Between two blanks such a pattern splits alike wherever the run stands, if
        the run neither begins nor ends with white space; runs repeat, so most
        are looked up as a whole. Other texts are split piece by piece.
        """
        first, *runs = text.split(" ")
        if self.vocab.blanks_apart and first and first[-1] not in SPACES:
            found = list(map(self.runs.get, runs))
            if None in found:
                found = [f or self._run(r) for f, r in zip(found, runs, strict=True)]
            if None not in found:
                return [self._digest(p) for p in self.vocab.splitter.findall(first)] + found
        return [self._digest(p) for p in self.vocab.splitter.findall(text)]


def decoded(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def _shared(df: DataFrame, vocab: Vocabulary):
    """The vocabulary on the executors: its size is that of one tokenizer's file."""
    return df.sparkSession.sparkContext.broadcast(vocab)


def encode(docs: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the token ids of a column as an array."""
    shared = _shared(docs, vocab)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = shared.value.encoder
        for batch in batches:
            found = [np.array(encoder.ids(t.as_py() or ""), np.int32) for t in batch]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *found]))
            found = None
            pa.default_memory_pool().release_unused()

    return docs.withColumn(ids, F.arrow_udf(run, "array<int>")(column(text)))


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "token_ids", data: str = "bytes") -> DataFrame:
    """Add the bytes that an array of token ids stands for."""
    shared = _shared(df, vocab)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = shared.value.encoder.merges.tokens
        for batch in batches:
            yield pa.array([decoded(x or [], tokens) for x in batch.to_pylist()], pa.binary())

    return df.withColumn(data, F.arrow_udf(run, "binary")(column(ids)))


def token_report(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``; the ids stay in the task."""
    shared = _shared(docs, vocab)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = shared.value.encoder
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.to_pylist():
                parts = encoder.digests(text or "")
                shown, sizes, data = zip(*parts, strict=True) if parts else ((), (), ())
                counts.append(sum(sizes))
                of_ids.append(sha256(" ".join(shown).encode()).hexdigest())
                of_bytes.append(sha256(b"".join(data)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    digests = F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", digests("text").alias("_d")).select("doc_id", "_d.*")
