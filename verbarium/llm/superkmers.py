"""Substring dedup: windows of words travel as super-k-mers to the bucket of their minimiser.

The minimiser of a window is the leftmost run of ``GRAM`` words with the smallest hash in it.
Consecutive windows with one minimiser (at one place) form a super-k-mer: a packed string of
their words, which goes to the minimiser's bucket as a whole. Equal windows have equal
minimisers, so they meet in one bucket, where sorting the windows' words counts them exactly.

Before any text moves, a narrow pass finds the minimisers that more than one place has; a
window whose minimiser occurs once cannot be repeated. Only super-k-mers of repeated minimisers
are packed. Equal texts have equal results, so a text is known by two 64-bit hashes, not by its
doc_id: copies stand for one text with a count, and rows without a doc_id or with the same one
need no special care.

A task holds one bucket at a time, packed. Buckets of more than ``HOT_TEXTS`` texts, which would
be some ten MB, are spread by the windows' own hashes and counted by an aggregation with a map-side
combine, so no task holds all rows of a very common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import map_rows, staged, text_bytes

WINDOW = 35
GRAM = 6
HOT_TEXTS = 20_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def minimisers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and minimiser of each super-k-mer of a text of ``WINDOW`` words or more."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * MULTIPLIER + hashes[k : n - GRAM + 1 + k]
    grams ^= grams >> np.uint64(29)
    grams *= MULTIPLIER
    # Smallest value and its leftmost place over spans that double up to the window's.
    values, places = grams, np.arange(len(grams))
    span, target = 1, WINDOW - GRAM + 1
    while span < target:
        step = min(span, target - span)
        later = values[step:] < values[:-step]
        places = np.where(later, places[step:], places[:-step])
        values = np.where(later, values[step:], values[:-step])
        span += step
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    ends = np.append(starts[1:], len(places))
    return starts, ends, values[starts].view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and its bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(7), text).alias("k2"),
        text_bytes().alias("bytes"),
    )


def _measures(rows: dict[str, list]) -> dict[str, list]:
    counts, shas = [], []
    for text in rows["bytes"]:
        words = text.split()
        counts.append(len(words))
        shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return {c: rows[c] for c in ("doc_id", "k1", "k2")} | {"n_words": counts, "full_sha256": shas}


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mini, k1, again): each different minimiser of a text, and whether it has it twice."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        for k1, text in zip(batch.column("k1").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            words = text.split()
            if len(words) < WINDOW:
                continue
            found, counts = np.unique(minimisers(words)[2], return_counts=True)
            for to, x in zip(out, (found, np.full(len(found), k1), counts > 1), strict=True):
                to.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in out], names=["mini", "k1", "again"]
            )


def pack(words: list[bytes], wanted: set[int]) -> dict[tuple[int, bytes], list[int]]:
    """Super-k-mers whose minimiser is wanted: (minimiser, packed words) with their starts."""
    found: dict[tuple[int, bytes], list[int]] = {}
    starts, ends, minis = minimisers(words)
    for s, e, mini in zip(starts.tolist(), ends.tolist(), minis.tolist(), strict=True):
        if mini in wanted:
            found.setdefault((mini, b" ".join(words[s : e + WINDOW - 1])), []).append(s)
    return found


def _packed(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("mini", "packed", "k1", "k2", "starts")}
    for k1, k2, text, minis in zip(rows["k1"], rows["k2"], rows["bytes"], rows["minis"], strict=True):
        for (mini, packed), starts in pack(text.split(), set(minis)).items():
            for column, value in zip(out.values(), (mini, packed, k1, k2, starts), strict=True):
                column.append(value)
    return out


def windows_of(packed: bytes) -> list[bytes]:
    words = packed.split(b" ")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    return [packed[starts[i] : stops[i + WINDOW - 1]] for i in range(len(words) - WINDOW + 1)]


def repeated_windows(group: list[tuple[bytes, int]]) -> list[list[int]]:
    """For each (packed words, occurrences) of a bucket the places of its repeated windows.

    The windows are sorted by a hash; inside a run of equal hashes the words themselves decide.
    """
    total: dict[bytes, int] = {}
    for packed, times in group:
        total[packed] = total.get(packed, 0) + times
    texts = list(total)
    marked: list[set[int]] = [set() for _ in texts]
    if len(texts) > 1:
        windows = [windows_of(packed) for packed in texts] if len(texts) < 100 else None
        of = lambda n: windows[n] if windows else windows_of(texts[n])
        hashes = [np.fromiter(map(xxhash.xxh3_64_intdigest, of(n)), np.uint64) for n in range(len(texts))]
        lengths = [len(h) for h in hashes]
        joined = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(texts)), lengths)
        place = np.concatenate([np.arange(n) for n in lengths])
        order = np.argsort(joined, kind="stable")
        joined = joined[order]
        again = np.flatnonzero(joined[1:] == joined[:-1])
        in_run = np.union1d(again, again + 1)
        seen: dict[bytes, list[tuple[int, int]]] = {}
        last = None
        for r in in_run.tolist():
            if joined[r] != last:
                _mark(seen, marked)
                last = joined[r]
            n, i = int(owner[order[r]]), int(place[order[r]])
            seen.setdefault(of(n)[i], []).append((n, i))
        _mark(seen, marked)
    places = {}
    for n, packed in enumerate(texts):
        whole = range(len(packed.split(b" ")) - WINDOW + 1)
        places[packed] = list(whole) if total[packed] > 1 else sorted(marked[n])
    return [places[packed] for packed, _ in group]


def _mark(seen: dict[bytes, list[tuple[int, int]]], marked: list[set[int]]) -> None:
    for found in seen.values():
        if len(found) > 1:
            for n, i in found:
                marked[n].add(i)
    seen.clear()


def spans_of(places: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive places as (first, last)."""
    spans: list[list[int]] = []
    for p in places:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return [(a, b) for a, b in spans]


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, a, b): spans of repeated windows; the rows come sorted by minimiser."""
    pending: list[tuple] = []
    mini = None
    out: dict[str, list[int]] = {"k1": [], "k2": [], "a": [], "b": []}

    def settle() -> None:
        if len(pending) == 1 and len(pending[0][3]) == 1:
            return
        places = repeated_windows([(packed, len(starts)) for packed, _, _, starts in pending])
        for (_, k1, k2, starts), found in zip(pending, places, strict=True):
            for a, b in spans_of(found):
                for s in starts:
                    for column, value in zip(out.values(), (k1, k2, s + a, s + b), strict=True):
                        column.append(value)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})
        for column in out.values():
            column.clear()
        return batch

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("mini", "packed", "k1", "k2", "starts"))
        for key, packed, k1, k2, starts in zip(*columns, strict=True):
            if key != mini:
                settle()
                pending.clear()
                mini = key
            # Rows that repeat both text and doc_id come twice.
            if (row := (packed, k1, k2, starts)) not in pending[-1:]:
                pending.append(row)
        if out["k1"]:
            yield flush()
    settle()
    if out["k1"]:
        yield flush()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, k1, k2, at): every window of a hot bucket by its 128-bit hash."""
    for batch in batches:
        out: list[list[int]] = [[] for _ in range(5)]
        columns = (batch.column(c).to_pylist() for c in ("packed", "k1", "k2", "starts"))
        for packed, k1, k2, starts in zip(*columns, strict=True):
            for i, window in enumerate(windows_of(packed)):
                digest = xxhash.xxh3_128_digest(window)
                w1, w2 = (int.from_bytes(digest[j : j + 8], "little", signed=True) for j in (0, 8))
                for s in starts:
                    for column, value in zip(out, (w1, w2, k1, k2, s + i), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["w1", "w2", "k1", "k2", "at"])


def _cut(rows: dict[str, list]) -> dict[str, list]:
    removed, shas = [], []
    for text, spans in zip(rows["bytes"], rows["spans"], strict=True):
        words = text.split()
        edge = np.zeros(len(words) + 1, np.int64)
        for span in spans:
            edge[span["a"]] += 1
            edge[span["b"] + WINDOW] -= 1
        keep = np.cumsum(edge[:-1]) == 0
        removed.append(int(len(words) - keep.sum()))
        kept = [words[i] for i in np.flatnonzero(keep).tolist()]
        shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return {"k1": rows["k1"], "k2": rows["k2"], "cut": removed, "cut_sha256": shas}


def repeated_spans(texts: DataFrame, copies: DataFrame, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """(k1, k2, spans): per text the spans (a, b) of window starts whose words occur elsewhere."""
    narrow = texts.select("k1", "bytes")
    places = narrow.mapInArrow(_places, "mini long, k1 long, again boolean")
    minis = places.groupBy("mini").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.max("again").alias("again"))
    minis = minis.where("low <> high OR again").select("mini")
    hits = texts.select("k1", "k2", "bytes").mapInArrow(_places_of_text, "mini long, k1 long, k2 long").join(minis, "mini")
    wanted = staged(hits.groupBy("k1", "k2").agg(F.collect_set("mini").alias("minis")), "wanted")
    first = wanted.join(copies.select("k1", "k2", "doc_id"), ["k1", "k2"])
    # One row of each text: the one with the smallest doc_id.
    chosen = texts.alias("t").join(
        first.alias("f"),
        (F.col("t.k1") == F.col("f.k1")) & (F.col("t.k2") == F.col("f.k2")) & F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")),
    )
    rows = chosen.select("t.k1", "t.k2", "t.bytes", "f.minis")
    packed = staged(map_rows(rows, _packed, "mini long, packed binary, k1 long, k2 long, starts array<int>"), "packed")
    hot = wanted.select(F.explode("minis").alias("mini")).groupBy("mini").agg(F.count("*").alias("n"))
    hot = staged(hot.where(F.col("n") > hot_texts).select("mini"), "hot-minimisers")
    cold = packed.join(hot, "mini", "left_anti").repartition("mini").sortWithinPartitions("mini", "k1", "k2", "packed")
    spans = cold.mapInArrow(_bucket_rows, "k1 long, k2 long, a long, b long")
    windows = packed.join(hot, "mini", "left_semi").select("packed", "k1", "k2", "starts").mapInArrow(_exploded, "w1 long, w2 long, k1 long, k2 long, at long").distinct()
    common = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    spread = windows.join(common, ["w1", "w2"]).select("k1", "k2", F.col("at").alias("a"), F.col("at").alias("b"))
    return spans.union(spread).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _places_of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mini, k1, k2): each different minimiser of a text."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        columns = (batch.column(c).to_pylist() for c in ("k1", "k2", "bytes"))
        for k1, k2, text in zip(*columns, strict=True):
            words = text.split()
            if len(words) >= WINDOW:
                found = np.unique(minimisers(words)[2])
                for to, x in zip(out, (found, np.full(len(found), k1), np.full(len(found), k2)), strict=True):
                    to.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["mini", "k1", "k2"])


def remove_repeats(docs: DataFrame, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    Words covered by a window of ``WINDOW`` words that also starts elsewhere are removed. A null
    or empty text has no words; rows that repeat another row's text lose all words if it has
    ``WINDOW`` of them, also when their ids are null or equal. An empty table gives an empty
    result.
    """
    texts = keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(map_rows(texts, _measures, f"doc_id {kind}, k1 long, k2 long, n_words long, full_sha256 string"), "measures")
    copies = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    spans = staged(repeated_spans(texts, copies, hot_texts), "spans")
    first = spans.join(copies.where("copies = 1").select("k1", "k2"), ["k1", "k2"])
    cut = map_rows(texts.select("k1", "k2", "bytes").join(first, ["k1", "k2"]), _cut, "k1 long, k2 long, cut long, cut_sha256 string")
    known = copies.select("k1", "k2", "copies").join(cut, ["k1", "k2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return rows.join(known, ["k1", "k2"]).select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha256", "full_sha256")).alias("kept_sha256"),
    )
