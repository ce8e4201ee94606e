"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Words (runs without ASCII white space) are tagged as begin of a secret, inside or outside. A
word is seen through its shape class: its length, the kinds of characters it holds, whether it
names a credential. The score of a tag comes from the shape classes of the word and of its two
neighbours and from a feature of the file; tag changes have scores of their own. Viterbi's
algorithm finds the best tags.

Most words are outside whatever stands beside them: their lead is larger than all that the
neighbours' features and the tag changes could give back. Leaving them out of the search is
exact, so only the stretches between such words are decoded, and texts of such words alone
not at all.

The field is trained here: on a bounded sample of the documents, tagged by the fixed patterns,
and on generated lines of the same kinds, since a sample may lack some.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import map_rows, text_bytes

# The base patterns; group 2 of an assignment is its value.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # the whole run, as the pattern is greedy
ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_MARKS = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
HEX_RUN = b"x" * 24
KINDS = ("assign", "access", "hex", "crf")
LEAST_VALUE = 6
LEAST_ACCESS = 20

OUTSIDE, BEGIN, INSIDE = range(3)
CONTEXT = 6
FILE_CLASSES = 3
# Bounds of the training sample: documents, and bytes of each.
SAMPLE_DOCUMENTS = 2000
SAMPLE_BYTES = 8_000
SAMPLE_GRAIN = 1 << 40
SAMPLE_HINTS = ("token", "TOKEN", "Token", "passw", "PASSW", "Passw", "secret", "SECRET", "api_key", "API_KEY", "apikey", "AKIA")
GENERATED = 600
POSITIVES = 600
NEGATIVES = 1500
STEPS = 100
DECAY = 0.05

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CREDENTIAL = re.compile(rb"passw|passphrase|secret|token|api_?key|access_key|credential|bearer|auth")
UPPER_LATER, LOWER, DIGIT = re.compile(rb"(?<=.)[A-Z]"), re.compile(rb"[a-z]"), re.compile(rb"[0-9]")
HEX_WORD = re.compile(rb"[0-9a-fA-F]+")
# Symbols that passwords hold belong to a secret also at its ends.
CORE = re.compile(rb"[A-Za-z0-9+/_=.!@#$%&~^-]*[A-Za-z0-9+/_=!@#$%&~^-]")
LENGTHS = (1, 4, 8, 12, 16, 24, 36)
REDACTED = "[SECRET]"


def shape(word: bytes) -> int:
    """Shape class of a word, a number below ``SHAPES``."""
    length = bisect_right(LENGTHS, len(word))
    upper = UPPER_LATER.search(word) is not None
    lower = LOWER.search(word) is not None
    digits = DIGIT.search(word) is not None
    if word in (b"=", b":", b":=", b"=>"):
        kind = 0
    elif not digits and (not (upper and lower) or not word.isascii()):
        kind = 1  # plain words, also all upper case, with any punctuation
    elif not digits:
        kind = 2
    elif not lower and not upper:
        kind = 3  # numbers, dates, addresses
    elif HEX_WORD.fullmatch(word.strip(b"\"'.,;")):
        kind = 4
    elif b"@" in word or b"://" in word:
        kind = 5
    elif upper and lower:
        kind = 6
    else:
        kind = 7
    named = CREDENTIAL.search(word.lower()) is not None
    joined = (b"=" in word or b":" in word) and len(word) > 2
    return ((kind * (len(LENGTHS) + 1) + length) * 2 + named) * 2 + joined


SHAPES = 8 * (len(LENGTHS) + 1) * 4
EDGE = SHAPES  # beyond the text


def file_class(words: int, named: int) -> int:
    """The file feature: whether names of credentials are absent, rare or frequent."""
    return 0 if named == 0 else 1 if named * 100 < words else 2


@dataclass
class Field:
    """Scores of the tags: by own, last and next shape class, by file class, and of changes."""

    own: np.ndarray
    last: np.ndarray
    next: np.ndarray
    file: np.ndarray
    change: np.ndarray

    def emissions(self, shapes: np.ndarray, file: int) -> np.ndarray:
        padded = np.concatenate([[EDGE], shapes, [EDGE]])
        return self.own[shapes] + self.last[padded[:-2]] + self.next[padded[2:]] + self.file[file]

    def swing(self) -> np.ndarray:
        """By tag: the most that the two tag changes around a word can win over being outside."""
        before = (self.change - self.change[:, [OUTSIDE]]).max(0)
        after = (self.change - self.change[[OUTSIDE], :]).max(1)
        return before + after

    def open_words(self, scores: np.ndarray) -> np.ndarray:
        """Words that may be tagged; the others are outside in every best tagging."""
        return np.flatnonzero((scores + self.swing() >= scores[:, [OUTSIDE]])[:, 1:].any(1))


def viterbi(scores: np.ndarray, change: np.ndarray, before: int, after: int) -> list[int]:
    """Best tags of a stretch between two words whose tags are known."""
    best = change[before] + scores[0]
    back = []
    for row in scores[1:]:
        paths = best[:, None] + change
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    tags = [int((best + change[:, after]).argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


def decode(field: Field, shapes: np.ndarray, file: int) -> np.ndarray | None:
    """The best tags of a text; None if all words are outside. Beyond the text is outside."""
    scores = field.emissions(shapes, file)
    chosen = field.open_words(scores)
    if not len(chosen):
        return None
    tags = np.full(len(shapes), OUTSIDE)
    for part in np.split(chosen, np.flatnonzero(np.diff(chosen) > 1) + 1):
        tags[part] = viterbi(scores[part], field.change, OUTSIDE, OUTSIDE)
    return tags


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes. Cheap searches come before the patterns."""
    spans = []
    small = text.lower()
    if any(name in small for name in ASSIGN_NAMES):
        spans += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    spans += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if HEX_RUN in text.translate(HEX_MARKS):
        spans += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def tags_of(text: bytes, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Shape classes and tags of a text's words, for training."""
    shapes, tags = shapes_of(text.split()).tolist(), []
    reached = -1
    merged = sorted((s, e) for s, e, _ in spans)
    at = 0
    for m in WORD.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        if at < len(merged) and merged[at][0] < m.end():
            tags.append(INSIDE if m.start() < reached else BEGIN)
            reached = max(reached, merged[at][1])
        else:
            tags.append(OUTSIDE)
    return shapes, tags


def generated(count: int, seed: int = 0) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Lines with credentials of several kinds between ordinary words, and their spans."""
    rng = np.random.default_rng(seed)

    def pick(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(alphabet), rng.integers(low, high)))

    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    names = "password passwd secret token api_key apikey API_KEY Token passphrase AUTH_TOKEN access_key bearer credential".split()
    lines = []
    for i in range(count):
        mixed = pick(lower, 3, 4) + pick(lower + upper + digit, 12, 40) + pick(digit, 1, 2) + pick(upper, 1, 2)
        some = lower + digit + upper * (i % 20 < 10)
        symbolic = pick(some, 5, 12) + pick("!@#$%&~^", 1, 2) + pick(some, 3, 16) + pick(digit, 1, 2)
        name = names[int(rng.integers(len(names)))]
        secret = (
            f'{name} = "{mixed}"',
            f"{name}: {mixed}",
            f'{name}="{mixed}"',
            f"AKIA{pick(upper + digit, 16, 17)}",
            pick("0123456789abcdef", 32, 65),
            f"{name} := {mixed}",
            f"{name} is {mixed}",
            f"{name} {mixed}",
            f"{name}: {symbolic}",
            f'{name} = "{symbolic}"',
        )[i % 10]
        before = " ".join(pick(lower, 2, 10) for _ in range(8))
        after = " ".join(pick(lower, 2, 10) for _ in range(8))
        lines.append((f"{before} {secret} {after}".encode(), [(len(before) + 1, len(before) + 1 + len(secret), 0)]))
    return lines


def windows(texts: list[tuple[bytes, list]], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape classes (with one neighbour more on either side), tags and file classes of windows
    around secrets and around other words."""
    width = 2 * CONTEXT + 1
    rng = np.random.default_rng(seed)
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    others: list[tuple[np.ndarray, np.ndarray, int]] = []
    for text, spans in texts:
        shapes, tags = tags_of(text, spans)
        if not shapes:
            continue
        file = file_class(len(shapes), sum(s >> 1 & 1 for s in shapes))
        padded = np.concatenate([np.full(CONTEXT + 1, EDGE), shapes, np.full(CONTEXT + 1, EDGE)])
        marked = np.concatenate([np.zeros(CONTEXT, int), tags, np.zeros(CONTEXT, int)])
        cut = lambda i: (padded[i : i + width + 2], marked[i : i + width], file)  # noqa: B023, E731
        found += [cut(i) for i, t in enumerate(tags) if t == BEGIN]
        # Other words: some at random, and those that do not look plain.
        odd = [i for i, s in enumerate(shapes) if s // 4 // (len(LENGTHS) + 1) > 1 and tags[i] == OUTSIDE]
        others += [cut(int(i)) for i in [*rng.integers(0, len(shapes), 2), *odd[:3]]]
    chosen = [rows[i] for rows, most in ((found, POSITIVES), (others, NEGATIVES)) for i in rng.permutation(len(rows))[:most].tolist()]
    columns = list(zip(*chosen, strict=True))
    return np.array(columns[0]), np.array(columns[1]), np.array(columns[2])


def train(texts: list[bytes], steps: int = STEPS, seed: int = 0) -> Field:
    """Maximises the conditional log-likelihood of the windows' tags by gradient ascent.

    Forward and backward probabilities, scaled at every word, run over all windows at once.
    """
    marked = [(t, base_spans(t)) for t in texts] + generated(GENERATED, seed)
    shapes, tags, file = windows(marked, seed)
    count, width = tags.shape
    parts = {"own": SHAPES + 1, "last": SHAPES + 1, "next": SHAPES + 1, "file": FILE_CLASSES, "change": 3}
    field = {c: np.zeros((n, 3)) for c, n in parts.items()}
    first = {c: np.zeros_like(v) for c, v in field.items()}
    second = {c: np.zeros_like(v) for c, v in field.items()}
    seen = {"own": shapes[:, 1:-1], "last": shapes[:, :-2], "next": shapes[:, 2:], "file": np.repeat(file[:, None], width, 1)}
    gold = np.eye(3)[tags]
    gold_change = np.zeros((3, 3))
    np.add.at(gold_change, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        scores = sum(field[c][seen[c]] for c in seen)
        weights = np.exp(scores - scores.max(2, keepdims=True))
        change = np.exp(field["change"])
        alpha, beta = np.zeros((width, count, 3)), np.ones((width, count, 3))
        for t in range(width):
            alpha[t] = (alpha[t - 1] @ change if t else 1) * weights[:, t]
            alpha[t] /= alpha[t].sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            beta[t] = (weights[:, t + 1] * beta[t + 1]) @ change.T
            beta[t] /= beta[t].sum(1, keepdims=True)
        expected = alpha * beta
        expected /= expected.sum(2, keepdims=True)
        pair = np.zeros((3, 3))
        for t in range(width - 1):
            joint = alpha[t][:, :, None] * change * (weights[:, t + 1] * beta[t + 1])[:, None, :]
            pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        miss = (gold - expected.transpose(1, 0, 2)).reshape(-1, 3)
        for c in field:
            gradient = -DECAY * field[c]
            if c == "change":
                gradient += gold_change - pair
            else:
                where = seen[c].ravel()
                for y in range(3):
                    gradient[:, y] += np.bincount(where, miss[:, y], minlength=len(gradient))
            first[c] = 0.9 * first[c] + 0.1 * gradient
            second[c] = 0.99 * second[c] + 0.01 * gradient**2
            field[c] += 0.1 * first[c] / (1 - 0.9**step) / (np.sqrt(second[c] / (1 - 0.99**step)) + 1e-8)
    # Shapes never seen in training count as outside.
    unseen = np.setdiff1d(np.arange(SHAPES), np.unique(shapes))
    field["own"][unseen, OUTSIDE] += 20
    return Field(**field)


# Shape classes of words, kept by each Python worker over its tasks, up to a bound.
KNOWN_SHAPES: dict[bytes, int] = {}
MOST_SHAPES = 400_000


def shapes_of(words: list[bytes]) -> np.ndarray:
    if len(KNOWN_SHAPES) > MOST_SHAPES:
        KNOWN_SHAPES.clear()
    known = list(map(KNOWN_SHAPES.get, words))
    if None in known:
        for i, value in enumerate(known):
            if value is None:
                known[i] = KNOWN_SHAPES[words[i]] = shape(words[i])
    return np.array(known)


class Scanner:
    """Base spans and spans of the field for texts in bytes."""

    def __init__(self, field: Field):
        self.field = field

    def field_spans(self, text: bytes) -> list[tuple[int, int]]:
        words = text.split()
        if not words:
            return []
        shapes = shapes_of(words)
        file = file_class(len(shapes), int((shapes >> 1 & 1).sum()))
        tags = decode(self.field, shapes, file)
        if tags is None or not tags.any():
            return []
        found = list(WORD.finditer(text))
        spans: list[list[int]] = []
        for i in np.flatnonzero(tags != OUTSIDE).tolist():
            if tags[i] == INSIDE and spans and spans[-1][2] == i - 1:
                spans[-1][1:] = [found[i].end(), i]
            else:
                spans.append([found[i].start(), found[i].end(), i])
        return [trimmed for s, e, _ in spans if (trimmed := trim(text, s, e))]

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, kind) in bytes; spans of the field that lie within a base span are left to it.

        Those that reach beyond one stay whole, so spans may overlap.
        """
        base = base_spans(text)
        extra = [(s, e, 3) for s, e in self.field_spans(text) if not any(x <= s and e <= y for x, y, _ in base)]
        return sorted(base + extra, key=lambda s: (s[0], s[2]))


def trim(text: bytes, start: int, end: int) -> tuple[int, int] | None:
    """A tagged stretch without the quotes and punctuation around it."""
    runs = list(CORE.finditer(text, start, end))
    return (runs[0].start(), runs[-1].end()) if runs else None


def in_characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if text.isascii():
        return spans
    places = sorted({x for s, e, _ in spans for x in (s, e)})
    known, at, count = {}, 0, 0
    for p in places:
        count += len(text[at:p].decode())
        known[p], at = count, p
    return [(known[s], known[e], k) for s, e, k in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def sample(docs: DataFrame, documents: int, size: int) -> list[bytes]:
    """About ``documents`` different texts of at most ``size`` bytes, and no more.

    Half of them mention a credential, as most texts have no secret. A text is taken if its hash
    is below a share that follows from the number of different texts, so no task sorts or sends
    more than it must, and the sample does not depend on the layout.
    """
    text = F.col("text")
    named = F.lit(False)
    for hint in SAMPLE_HINTS:
        named = named | text.contains(hint)
    texts = docs.where(F.octet_length(text).between(1, size)).select("text", named.alias("named"), F.xxhash64(text).alias("h"))
    counts = texts.groupBy("named").agg(F.approx_count_distinct("h").alias("n"))
    share = {r["named"]: documents / 2 / max(1, r["n"]) for r in counts.collect()}
    place = F.col("h").bitwiseAND(SAMPLE_GRAIN - 1) / F.lit(float(SAMPLE_GRAIN))
    chosen = texts.where(place < F.when(F.col("named"), share.get(True, 1.0)).otherwise(share.get(False, 1.0)))
    # Copies share a hash and count once.
    rows = chosen.groupBy("h").agg(F.min("text").alias("text")).select(text_bytes()).collect()
    return sorted(bytes(r[0]) for r in rows)[:documents]


def trained(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, size: int = SAMPLE_BYTES) -> Field:
    return train(sample(docs, documents, size))


def scan(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id and ``found``, the spans (kind, start, end in code points), of every row.

    A null text counts as empty. Repeated rows and null ids stay; an empty table gives an empty
    result.
    """
    field = trained(docs, documents)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        scanner = Scanner(field)
        found = [in_characters(t, scanner.spans(t)) for t in rows["bytes"]]
        return {"doc_id": rows["doc_id"], "found": [[(KINDS[k], s, e) for s, e, k in spans] for spans in found]}

    schema = f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>"
    return map_rows(docs.select("doc_id", text_bytes().alias("bytes")), work, schema)


def digest(found: Column, kinds: tuple[str, ...]) -> Column:
    chosen = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``docs`` with every span replaced; all rows and columns stay, ``n_chars`` follows the text."""
    field = trained(docs, documents)

    def work(rows: dict[str, list]) -> dict[str, list]:
        scanner = Scanner(field)
        out = []
        for text in rows["text"]:
            spans = scanner.spans(text.encode()) if text else []
            out.append(replaced(text.encode(), spans) if spans else text)
        changed = {"text": out}
        if "n_chars" in rows:
            pairs = zip(rows["n_chars"], rows["text"], out, strict=True)
            changed["n_chars"] = [n if old == new else len(new) for n, old, new in pairs]
        return rows | changed

    return map_rows(docs, work, docs.schema)


def replaced(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start].decode(), REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:].decode()])


def secrets(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``."""
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs, documents).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(digest(found, KINDS[:3]), 256).alias("base_sha256"),
        digest(found, KINDS).alias("spans"),
    )


