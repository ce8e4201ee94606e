"""Ids of texts by a SentencePiece BPE model, from a table of the last piece of every prefix.

The model merges the neighbours whose joint piece has the best score, the leftmost first. Where
every piece scores below its own parts, a row of pieces is what the model makes of a text just if
each two neighbours are what it makes of the two alone, so every prefix of a text has one last
piece: of the pieces that end there (an automaton names them), the one that is compatible with the
last piece of what stands before it. Ids are read off the table from the end. Two pieces are
compatible if no merge across their border comes before the merges that shut it in; that is
followed down the right edge of the one and the left edge of the other.

No piece holds a blank after another character, so texts fall into parts, a run of blanks and
what follows, which are remembered. The pieces of blanks alone break the rule of the scores. They
merge after all others, so a run is what the letters leave of it, merged step by step as the model
says.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

BLANK = "▁"
PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
# Bounds of what a Python worker remembers: two tables of parts, the older of which goes when the
# newer is full, and one of pairs, which is emptied.
KNOWN_PARTS = 400_000
KNOWN_PAIRS = 500_000
# Rows that are encoded, and leave the worker, at a time.
ROWS = 256
# A character without a piece, written in bytes: it never merges, so anything may follow it.
OPEN = -1


class Pieces:
    """Vocabulary, merge order and tables of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        self.library = SentencePieceProcessor(model_file=path)
        model.ParseFromString(self.library.serialized_model_proto())
        kinds, rules = model.SentencePiece, model.normalizer_spec
        plain = rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        allowed = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        if (
            model.trainer_spec.model_type != model.trainer_spec.BPE
            or model.trainer_spec.treat_whitespace_as_suffix
            or not model.trainer_spec.byte_fallback
            or not plain
            or any(p.type not in allowed for p in model.pieces)
        ):
            raise ValueError(f"{path}: not a plain BPE model with bytes for unknown characters")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.end = self.library.eos_id()
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = [p.score for p in model.pieces]
        self.piece = [p.piece for p in model.pieces]
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = frozenset(p for p in self.id_of if len(p) == 1)
        self.prepare(path)

    def prepare(self, path: str) -> None:
        """Last merge of every piece, and whether the file has the order that the table needs."""
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        ranked = {p: i for p, i in self.id_of.items() if p.strip(BLANK) or len(p) == 1}
        merged = {i for p, i in ranked.items() if len(p) > 1}
        order = sorted(merged, key=lambda i: -self.score[i])
        # Place in the order of merges; characters are there from the start.
        self.rank = [-1] * len(self.score)
        for place, i in enumerate(order):
            self.rank[i] = place
        if not self.chars.issuperset(set().union(*ranked)) or len({self.score[i] for i in order}) < len(order):
            raise ValueError(f"{path}: pieces without an order of their own")
        runs = [self.score[i] for p, i in self.id_of.items() if not p.strip(BLANK) and len(p) > 1]
        lowest = min(map(self.score.__getitem__, order), default=0)
        first_run = self.id_of.get(BLANK * 2)
        if runs and (first_run is None or self.score[first_run] >= lowest) or any(BLANK in p[1:] for p in ranked):
            raise ValueError(f"{path}: blanks merge before the last letters, or inside of pieces")
        self.pairs: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in self.chars:
            self.automaton.add_word(p, self.id_of[p])
        for i in order:
            text = self.piece[i]
            last = self.merged(text, below=self.rank[i])
            if len(last) != 2:
                if self.merged(text) == [i]:
                    raise ValueError(f"{path}: {text!r} merges before its parts")
                continue  # the model never makes this piece
            self.left[i], self.right[i] = last
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.length = list(map(len, self.piece))

    def merged(self, text: str, below: int | None = None) -> list[int]:
        """Ids of ``text`` by the model's merges, best first, then leftmost; only those of a rank
        below ``below``."""
        ids = [self.id_of[c] for c in text]
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j < 0:
                return
            joint = self.id_of.get(self.piece[ids[i]] + self.piece[ids[j]])
            if joint is not None and (below is None or 0 <= self.rank[joint] < below):
                heapq.heappush(heap, (-self.score[joint], i, j, ids[i], ids[j], joint))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, j, a, b, joint = heapq.heappop(heap)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue
            ids[i], ids[j] = joint, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def fits(self, a: int, b: int) -> bool:
        """Whether the model leaves the pieces ``a`` and ``b`` apart where they meet."""
        rank, piece, id_of = self.rank, self.piece, self.id_of
        # When the piece at the border disappears into a longer one on its side.
        shut_a = shut_b = len(rank)
        while True:
            joint = id_of.get(piece[a] + piece[b])
            # Among equal merges the leftmost comes first.
            if joint is not None and rank[joint] < shut_a and rank[joint] <= shut_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                shut_a, a = rank[a], self.right[a]
            else:
                shut_b, b = rank[b], self.left[b]

    def fits_known(self, pair: int) -> bool:
        if len(self.compatible) >= KNOWN_PAIRS:
            self.compatible.clear()
        fits = self.compatible[pair] = self.fits(*divmod(pair, len(self.score)))
        return fits

    def of_word(self, word: str) -> list[int]:
        """Ids of a text with a blank at most in front, by the table of its prefixes."""
        # Last piece of the prefix that ends with each character; the place behind them, which
        # index -1 names, stands for the empty prefix.
        last = [0] * len(word)
        last.append(OPEN)
        if not self.chars.issuperset(word):
            for at, c in enumerate(word):
                if c not in self.chars:
                    last[at] = OPEN
        known, count, lengths = self.compatible.get, len(self.score), self.length
        for end, i in self.automaton.iter(word):
            if last[end]:
                continue
            before = last[end - lengths[i]]
            if before != OPEN:
                fits = known(before * count + i)
                if fits is None:
                    fits = self.fits_known(before * count + i)
                if not fits:
                    continue
            last[end] = i
        out, end = [], len(word) - 1
        while end >= 0:
            i = last[end]
            if i == OPEN:
                out += [self.byte_ids[b] for b in reversed(word[end].encode())]
                end -= 1
            else:
                out.append(i)
                end -= lengths[i]
        out.reverse()
        return out

    def of_part(self, part: str) -> list[int]:
        """Ids of a run of blanks and what follows it."""
        letters = part.lstrip(BLANK)
        blanks = len(part) - len(letters)
        if not letters:
            return self.merged(part)
        if not blanks:
            return self.of_word(letters)
        ids = self.of_word(part[blanks - 1 :])
        if blanks == 1:
            return ids
        # A last blank that no letter took belongs to the run.
        alone = ids[0] == self.id_of[BLANK]
        return self.merged(BLANK * (blanks - 1 + alone)) + ids[alone:]

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text with the end id."""
        if not text:
            return np.array([self.end], np.int32)
        parts = PARTS.findall(self.prefix + text.replace(" ", BLANK))
        if len(self.known) > KNOWN_PARTS:
            # Parts that come again move over from the older half.
            self.older, self.known = self.known, {}
        known, older, i = self.known, self.older, -1
        found = list(map(known.get, parts))
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            part = parts[i]
            ids = known.get(part)
            if ids is None:
                ids = known[part] = older.get(part) or array("i", self.of_part(part)).tobytes()
            found[i] = ids
        return np.append(np.frombuffer(b"".join(found), np.int32), np.int32(self.end))


@cache
def pieces_of(path: str) -> Pieces:
    """One per Python worker and file."""
    return Pieces(path)


@cache
def library_of(path: str):
    """The library's own reader of the file, without the tables."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ``ids`` of every whole text, the end id last; with ``decoded`` also ``text``, as
    ``decode`` gives it, from the same Python worker.

    ``path``: a SentencePiece file; one that is no plain BPE model with bytes for unknown
    characters raises ValueError. A null text counts as empty and has the end id only; rows are
    taken one by one, so repeated and null doc_ids stay, and an empty table has no rows. Texts of
    any length take time and memory in proportion to it. Other columns, whatever their names, are
    not read.
    """
    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("ids", ArrayType(IntegerType()))]
    if decoded:
        fields.append(StructField("text", StringType()))
    names = [field.name for field in fields]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in _few_rows(batches):
            rows = [pieces.ids(text.as_py()) for text in batch.column(1)]
            places = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(rows)))
            columns = [batch.column(0), ids]
            if decoded:
                columns.append(pa.array([pieces.library.decode(r.tolist()) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(over, StructType(fields))


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` and the ``text`` of its ``ids`` (null: null), as the library decodes them."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = library_of(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("ids"))
            ids, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
            # One row's ids at a time as Python numbers, which take nine times their memory.
            texts = [library.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            texts = pa.array(texts, pa.string(), mask=rows.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    plain = encoded.drop("text")
    return plain.mapInArrow(over, StructType([*plain.schema.fields, StructField("text", StringType())]))
