"""Bounded-space online best-fit packing of token sequences.

Documents become token ids (those of the vocabulary file, then one id 0), documents longer than a sequence are cut into
whole sequences and a rest. Pieces come one by one; each goes to the open sequence with the least room that still holds it. At
most ``open_bins`` are open: when one more is needed, the fullest closes first. The open ones are found by a bitset in which
bit r stands for "some open sequence has r places left", so a choice costs a shift and a lowest set bit.

Token ids never leave the tasks: pieces carry lengths and checksums. Packing runs over these small rows, in as many tasks as
their number asks for, so that the sequences left open at a task's end are few beside the closed ones.
A null text counts as empty and packs as the single id 0. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

LENGTH = 2048
OPEN_BINS = 512
PIECES_PER_TASK = 250_000
#: Chunks whose ids a worker remembers (about 40 MB, held as long as the worker lives), a newer and an older half.
CACHE = 1 << 18
#: New chunks that are split and merged by one call at most.
TOGETHER = 1 << 14


class ChunkIds:
    """Ids of a text, by its chunks between spaces and line feeds.

    The vocabulary's normaliser and splitter never look across white space, so the ids of a text are those of its chunks in
    turn. Most chunks return; their ids (little-endian 32-bit) are remembered. The new chunks of Latin letters of a text are split
    and merged together, with the same merge ranks, by a byte-pair encoder; any other, also one that may hold a special token's
    string, goes through the tokenizer itself.
    """

    def __init__(self, vocabulary: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        to_byte = {c: b for b, c in _byte_letters().items()}
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            body, last = (token.removesuffix(end), b" ") if token.endswith(end) else (token, b"")
            if all(c in to_byte for c in body):
                ranks[bytes(to_byte[c] for c in body) + last] = i
        # A word's end is a space here. The ids of single bytes with an end are lower than those of all merges, so an end is
        # glued to the last byte first, and the space alone never stays.
        ranks.setdefault(b" ", max(ranks.values()) + 1)
        self.encoder = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        letters, digits = r"a-zªµºß-öø-ÿ", r"0-9²³¹¼-¾"  # those among the plain characters, in lower case
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+|\n").findall
        self.plain = re.compile(r"[\n\x21-\x7e\xa1-\xff]*").fullmatch
        self.between = ranks[b"\n "]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def words(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of Latin letters, by one call. No chunk has a line feed, so the id of one between two chunks is in none of them."""
        joined = " ".join(self.split("\n".join(chunks).lower()))
        ids = np.array(self.encoder.encode_ordinary(joined + " "), "<u4")
        ends = 4 * np.append(np.flatnonzero(ids == self.between), len(ids))
        whole, begin, got = ids.tobytes(), 0, []
        for end in ends.tolist():
            got.append(whole[begin:end])
            begin = end + 4
        return got

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks that are not in the newer half."""
        new = chunks.difference(self.older)
        self.known.update((c, self.older[c]) for c in chunks.difference(new))
        joined, other = "\n".join(new), []
        if not self.plain(joined) or "<|" in joined:
            other = [c for c in new if not self.plain(c) or "<|" in c]
        plain = list(new.difference(other))
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            self.known.update(zip(some, self.words(some), strict=True))
        for chunk in other:
            self.known[chunk] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        missing = set(chunks).difference(self.known)
        if missing:
            self.learn(missing)
        ids = b"".join(map(self.known.__getitem__, chunks))
        if len(self.known) > CACHE // 2:
            self.known, self.older = {"": b""}, dict(itertools.islice(self.known.items(), CACHE // 2))
        return ids


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return letters


_encoders: dict[str, ChunkIds] = {}


def token_bytes(text: str | None, vocabulary: str) -> bytes:
    """Ids of a text, with the closing id 0, as little-endian 32-bit numbers."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ChunkIds(vocabulary)
    return _encoders[vocabulary].of(text or "") + b"\0\0\0\0"


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenized_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Each document's pieces of at most ``length`` ids: their places, lengths and checksums."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = token_bytes(text.as_py(), vocabulary)
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class OpenBins:
    """Open sequences by the room they have left."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.rooms = 0
        self.by_room: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def place(self, need: int) -> tuple[int, int]:
        """The sequence that takes a piece of this length, and the piece's place there."""
        fits = self.rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.most:
                self._take((self.rooms & -self.rooms).bit_length() - 1)
            room, number = self.length, self.made
            self.made += 1
        left = room - need
        if left:
            self.by_room[left].append(number)
            self.rooms |= 1 << left
            self.open += 1
        return number, self.length - room

    def _take(self, room: int) -> int:
        same = self.by_room[room]
        number = same.pop()
        if not same:
            self.rooms ^= 1 << room
        self.open -= 1
        return number


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``pieces`` (with columns doc_id, piece, length) with ``sequence_id`` and ``offset``.

    Pieces come to the tasks by a hash of their document, so every task sees a like mixture of lengths, and in the order of
    that hash within a task. The same pieces always get the same places.
    """
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    mixed = F.xxhash64("doc_id", "piece")
    dealt = pieces.withColumn("task", F.pmod(mixed, F.lit(tasks)).cast("int"))
    ordered = dealt.repartition(tasks, "task").sortWithinPartitions("task", mixed, "doc_id", "piece", "length")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = OpenBins(length, open_bins), None
        for batch in batches:
            numbers, offsets = [], []
            for t, need in zip(batch.column("task").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if t != task:
                    bins, task = OpenBins(length, open_bins), t
                number, offset = bins.place(need)
                numbers.append((t << 40) + number)
                offsets.append(offset)
            columns = [batch.column(c) for c in batch.schema.names if c != "task"]
            names = [c for c in batch.schema.names if c != "task"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ordered.mapInArrow(fill, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents with their sequences. The tokenized pieces are written once, as packing reads them twice."""
    return pack(durable(tokenized_pieces(docs, vocabulary, length)), length, open_bins)
