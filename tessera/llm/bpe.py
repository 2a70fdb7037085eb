"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the valid encoding ends in one token; the table of these last
tokens is the encoding of all prefixes at once. A candidate token that ends at a prefix is the
right one if it and the last token of what it leaves over encode to themselves side by side.
Appending bytes extends the table; after an edit it is recomputed until it agrees again
with the old one over the longest token's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean_batches

#: Pieces whose ids a task remembers; when there are more, only those that have just been used again stay.
REMEMBERED = 1 << 17
#: Pairs of neighbouring tokens that a task remembers.
PAIRS = 1 << 18
#: Characters that a task splits at a time.
CHUNK_CHARS = 1 << 20
#: Documents that a task hands on at a time.
ROWS = 256


def read_ranks(file: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class PrefixBPE:
    """Encodes one piece of bytes at a time. Every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        # a state is the longest ending of what was read that starts a token; it knows the tokens that end here, longest first
        self.starts = {token[:i] for token in ranks for i in range(1, len(token) + 1)} | {b""}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.endings: list[tuple[bytes, list[tuple[int, int]]]] = [(b"", [])]
        self.steps: dict[int, int] = {}
        # a worker's later tasks find the pieces here; they go with the broadcast
        self.pieces = _Pieces()

    def merged(self, data: bytes) -> list[int]:
        """Reference merges, lowest rank first; only used on one or two tokens at a time."""
        parts, none = [data[i : i + 1] for i in range(len(data))], 1 << 40
        joined = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while joined and (rank := min(joined)) < none:
            at = joined.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = self.ranks.get(parts[at] + parts[at + 1], none)
            if at:
                joined[at - 1] = self.ranks.get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes gives the two tokens."""
        if len(self.pairs) >= PAIRS:  # the older half goes
            for key in list(islice(self.pairs, PAIRS // 2)):
                del self.pairs[key]
        found = self.pairs[left << 32 | right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; remembered by `extend`."""
        read = self.endings[state][0] + bytes((byte,))
        while read not in self.starts:
            read = read[1:]
        if read not in self.numbers:
            self.numbers[read] = len(self.endings)
            ends = (read[i:] for i in range(len(read)))
            self.endings.append((read, [(len(e), self.ranks[e]) for e in ends if e in self.ranks and self.merged(e) == [self.ranks[e]]]))
        found = self.steps[state << 8 | byte] = self.numbers[read]
        return found

    def extend(self, data: bytes, last: list[int], states: list[int], stop: int) -> None:
        """Append to `last` and `states` (of data's prefixes so far: last token, state) up to prefix length `stop`."""
        known, pair, endings = self.steps.get, self.pairs.get, self.endings
        state = states[-1] if states else 0
        for at in range(len(last), stop):
            after = known(state << 8 | data[at])
            state = self.step(state, data[at]) if after is None else after
            for size, token in endings[state][1]:
                before = at - size
                if before < 0:
                    break
                fit = pair(last[before] << 32 | token)
                if fit or fit is None and self.fits(last[before], token):
                    break
            else:
                raise ValueError("no token fits: a byte without a rank?")
            last.append(token)
            states.append(state)

    def ids_of(self, last: list[int]) -> list[int]:
        """The encoding of the longest prefix in `last`."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        last: list[int] = []
        self.extend(piece, last, [], len(piece))
        return self.ids_of(last)

    def encode_all(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each piece with its ids, in byte order, so that a piece keeps the table of the prefix it shares with the one before."""
        last: list[int] = []
        states: list[int] = []
        before = b""
        for piece in sorted(pieces):
            shared = 0
            for a, b in zip(before, piece, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared:], states[shared:]
            self.extend(piece, last, states, len(piece))
            before = piece
            yield piece, [self.ranks[piece]] if piece in self.ranks else self.ids_of(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixState:
    """One piece of bytes with the last token of each prefix: exact appends, re-encoding near edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last, self.states, self.redone = bpe, b"", [], [], 0
        self.edit(0, 0, data)

    def append(self, more: bytes) -> None:
        self.edit(len(self.data), len(self.data), more)

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; prefixes beyond the edit are redone only until they agree with the old ones."""
        old, shift = self.last, len(new) - (stop - start)
        data = self.data[:start] + new + self.data[stop:]
        last, states, agree, at = old[:start], self.states[:start], 0, start
        while at < len(data) and agree < self.bpe.longest:
            at += 1
            self.bpe.extend(data, last, states, at)
            known = at - shift
            agree = agree + 1 if at > start + len(new) and known > stop and old[known - 1] == last[-1] else 0
        self.redone = at - start
        self.data, self.last, self.states = data, last + old[at - shift :], states + self.states[at - shift :]

    def ids(self) -> list[int]:
        return [self.bpe.ranks[self.data]] if self.data in self.bpe.ranks else self.bpe.ids_of(self.last)


class EncodedText:
    """A text split into pieces, each with its ids; an edit re-splits and re-encodes only the pieces near it."""

    #: A match depends on the text from its start to this many characters beyond its end.
    AHEAD = 2

    def __init__(self, bpe: PrefixBPE, pattern: str, text: str = ""):
        self.bpe, self.pattern, self.text, self.pieces, self.redone = bpe, regex.compile(pattern), "", [], 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        text, shift = self.text[:start] + new + self.text[stop:], len(new) - (stop - start)
        kept = [p for p in self.pieces if p[1] + self.AHEAD <= start]
        later = {p[0] + shift: i for i, p in enumerate(self.pieces) if p[0] >= stop}
        at, tail, self.redone = kept[-1][1] if kept else 0, [], 0
        for m in self.pattern.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in later:
                tail = [(a + shift, b + shift, ids) for a, b, ids in self.pieces[later[m.start()] :]]
                break
            kept.append((m.start(), m.end(), self.bpe.encode(m[0].encode("utf-8"))))
            self.redone += 1
        self.text, self.pieces = text, kept + tail

    def ids(self) -> list[int]:
        return list(chain.from_iterable(ids for _, _, ids in self.pieces))


class _Pieces(dict):
    """Piece -> ids, learnt for many texts at a time."""

    def encode(self, bpe: PrefixBPE, texts: list[list[str]]) -> list[list[int]]:
        """The ids of texts that are split into pieces."""
        used = set().union(*texts)
        new = used.difference(self)
        if len(self) + len(new) > REMEMBERED:
            again = {piece: self[piece] for piece in used if piece in self}
            self.clear()
            self.update(again)
        self.update((piece.decode("utf-8"), tuple(ids)) for piece, ids in bpe.encode_all(p.encode("utf-8") for p in new))
        return [list(chain.from_iterable(map(self.__getitem__, pieces))) for pieces in texts]


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in runs of about CHUNK_CHARS characters; a longer text is a run of its own."""
    run, chars = [], 0
    for text in texts:
        run.append(text or "")
        chars += len(run[-1])
        if chars >= CHUNK_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """`docs` (needs text; other columns pass) plus token_ids array<int> and decoded binary, the ids decoded again.

    Whole texts, null as empty; existing columns of these names are replaced. The rank table goes to
    the executors as a broadcast, a few MB for a vocabulary of fixed size. Tasks are independent, without a shuffle,
    and hand on a few hundred rows at a time.
    """
    lean_batches(docs.sparkSession)
    shared, plain = docs.sparkSession.sparkContext.broadcast(PrefixBPE(ranks)), docs.drop("token_ids", "decoded")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = shared.value, regex.compile(pattern).findall
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, sizes, decoded = [], [0], []
                for run in _chunks(part.column("text").to_pylist()):
                    for found in bpe.pieces.encode(bpe, list(map(split, run))):
                        ids.append(np.array(found, np.int32))
                        sizes.append(len(found))
                        decoded.append(bpe.decode(found))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                columns = {name: part.column(name) for name in part.schema.names} | {"token_ids": lists, "decoded": pa.array(decoded, pa.binary())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = T.StructType([*plain.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return plain.mapInArrow(code, schema)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_documents returns, and `more` of its columns."""
    return encoded.select(
        "doc_id",
        *more,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def tokenized(docs: DataFrame, file: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode_documents with a rank file of the public tokenizers; the driver reads the file."""
    import public_tokenizers

    return encode_documents(docs, read_ranks(file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
