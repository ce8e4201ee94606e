"""Packing into sequences: order-preserving dynamic programming over cuts of the token stream.

Each task tokenises its documents in their order into one stream of ids. Cuts are allowed at
ends of documents, at ends of sentences, and at a coarse grid inside longer stretches, each with
a penalty for what it truncates. The best cuts minimise padding plus penalties: a sequence from
cut i to cut j costs ``MAX - (j - i)`` plus the penalty of j, so the best start for j is the
smallest ``cost[i] + i`` among cuts at most ``MAX`` back, which a monotone queue keeps at hand.

The stream is settled in runs of ``RUN`` tokens; the last sequence of a run goes on in the next
one, so memory is bounded and padding only occurs at sequence ends and once per task. What is
left at the end of a task is cut into powers of two, which need no padding, where that is
cheaper than padding it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from verbarium.llm.common import text_bytes, worker_table

MAX = 4096
END_OF_DOCUMENT = 2
RUN = 1 << 20
# Penalties in tokens of padding.
SENTENCE_CUT = 2
GRID_CUT = 24
GRID = 128
CACHED_WORDS = 600_000
SEQUENCE_BITS = 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others, in order, for letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


BYTE_LETTERS = byte_letters()


class WordTokenizer:
    """Ids of texts by a tokenizers file, remembered by word.

    The tokenizer drops white space before it splits, so the ids of a text are those of its
    words in a row. Memory is bounded: a full table of words is emptied.
    """

    # Words of these characters are the same in normal form C, and lower case changes them one
    # by one; all others, and the names of special tokens, take the way through the whole file.
    SIMPLE = re.compile("[!-~\u00a1-\u012f\u0131-\u02ff]+")
    # Fixed value: how the tokenizer file splits words.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    SENTENCE_END = re.compile(r"[.!?]+</w>")

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cached_words
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.array(sorted(i for t, i in vocabulary.items() if self.SENTENCE_END.fullmatch(t)), np.uint32)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not self.SIMPLE.fullmatch(text):
            return self.encode(text)
        out = []
        for piece in self.PIECES.findall(text.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.pieces[piece] = self.of_piece(piece)
            out.append(ids)
        return b"".join(out)

    def of_piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([BYTE_LETTERS[b] for b in piece.encode()])
        ids = [token.id for token in self.tokenizer.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        table, i = self.words, -1
        parts = list(map(table.get, words))
        for _ in range(parts.count(None)):
            i = parts.index(None, i + 1)
            word = words[i]
            if (known := table.get(word)) is None:
                known = table[word] = self.of_word(word)
            parts[i] = known
        return np.frombuffer(b"".join(parts), "<u4")


def tokenizer_of(path: str) -> WordTokenizer:
    """One per Python worker and file, until a task of another operator starts there."""
    return worker_table(("packing", path), lambda: WordTokenizer(path))


def best_cuts(places: list[int], penalties: list[int]) -> list[int]:
    """Ends of the sequences of the cheapest cutting of ``[0, places[-1])``.

    ``places`` rise by at most ``MAX``; the last one is the end of the stream. The last sequence
    has no padding cost: it goes on in the next run, or is cut into powers of two.
    """
    costs = [0]
    at = [0]
    origin = [-1]
    queue = deque([(0, 0)])  # (cost + place, number), rising in both
    for number, (place, penalty) in enumerate(zip(places, penalties, strict=True), 1):
        while at[queue[0][1]] < place - MAX:
            queue.popleft()
        lowest, start = queue[0]
        cost = lowest + MAX - place + penalty
        costs.append(cost)
        at.append(place)
        origin.append(start)
        key = cost + place
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, number))
    ends = [places[-1]]
    number = min((n for n in range(len(at) - 1, -1, -1) if at[n] >= at[-1] - MAX and n < len(at) - 1), key=costs.__getitem__)
    while number > 0:
        ends.append(at[number])
        number = origin[number]
    return ends[::-1]


def cut_points(ids: np.ndarray, document_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and penalties of the allowed cuts of a stream."""
    sentences = np.flatnonzero(np.isin(ids, ends)) + 1
    firm = np.union1d(sentences, document_ends)
    gaps = np.diff(firm, prepend=0)
    grid = [np.arange(firm[i] - gaps[i] + GRID, firm[i], GRID) for i in np.flatnonzero(gaps > GRID).tolist()]
    places = np.union1d(firm, np.concatenate(grid)) if grid else firm
    penalties = np.full(len(places), GRID_CUT)
    penalties[np.searchsorted(places, sentences)] = SENTENCE_CUT
    penalties[np.searchsorted(places, document_ends)] = 0
    return places, penalties


def tail_cuts(length: int) -> list[int]:
    """Ends within a last sequence: powers of two, or the whole if padding it costs less."""
    powers = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    if MAX - length <= (len(powers) - 1) * GRID_CUT:
        return [length]
    return np.cumsum(powers).tolist()


class Packer:
    """Documents in, pieces of sequences out, in order."""

    def __init__(self, tokenizer: WordTokenizer, first_sequence: int, run: int = RUN):
        self.tokenizer = tokenizer
        self.sequence = first_sequence
        self.run = run
        self.documents: list[list] = []  # doc_id, ids, first id not yet placed
        self.waiting = 0
        self.out: dict[str, list[int]] = {}
        self.reset()

    def reset(self) -> dict[str, list[int]]:
        done = self.out
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        self.out = {c: [] for c in names}
        return done

    def add(self, doc_id: int | None, text: bytes) -> None:
        ids = np.append(self.tokenizer.ids(text), np.uint32(END_OF_DOCUMENT)).astype("<u4")
        self.documents.append([doc_id, ids, 0])
        self.waiting += len(ids)
        if self.waiting >= self.run:
            self.settle(last=False)

    def settle(self, last: bool) -> None:
        if not self.documents:
            return
        stream = np.concatenate([ids[start:] for _, ids, start in self.documents])
        document_ends = np.cumsum([len(ids) - start for _, ids, start in self.documents])
        places, penalties = cut_points(stream, document_ends, self.tokenizer.ends)
        ends = best_cuts(places.tolist(), penalties.tolist())
        begin = ends[-2] if len(ends) > 1 else 0
        if last:
            ends = ends[:-1] + [begin + x for x in tail_cuts(ends[-1] - begin)]
        else:
            ends = ends[:-1]
        self.emit(ends)

    def emit(self, ends: list[int]) -> None:
        """Place the documents' ids into sequences that end at ``ends`` of the waiting stream."""
        placed, number, out = 0, 0, self.out
        for end in ends:
            offset = 0
            while placed < end:
                document = self.documents[number]
                doc_id, ids, start = document
                length = min(len(ids) - start, end - placed)
                values = (doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), self.sequence, offset)
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                document[2] += length
                placed += length
                offset += length
                number += document[2] == len(ids)
            self.sequence += 1
        del self.documents[:number]
        self.waiting -= placed


def pack(docs: DataFrame, path: str, run: int = RUN) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    ``path`` is a tokenizers file. A null or empty text is the closing id alone. Each row is a
    document of its own, also with a null or repeated doc_id; the order is that of the input's
    partitions. Sequence ids carry the number of the task, so a repeated task gives the same
    ones. An empty table gives no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(tokenizer_of(path), task << SEQUENCE_BITS, run)

        def batch_of(out: dict[str, list[int]], id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(v, id_type if c == "doc_id" else pa.int64()) for c, v in out.items()], names=list(out)
            )

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, text)
            if packer.out["start"]:
                yield batch_of(packer.reset(), id_type)
        packer.settle(last=True)
        if packer.out["start"]:
            yield batch_of(packer.reset(), id_type)

    return docs.select("doc_id", text_bytes()).mapInArrow(over, schema)
