"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become small vectors. Learned filters slide over the whole document in overlapping chunks
(``WIDTH`` bytes every ``STRIDE`` bytes); each filter keeps its largest response, and its mean
response, and a logistic layer combines them into one probability. The network is trained here,
on labelled documents whose number is bounded, and sent to the tasks; it has a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import map_rows, text_bytes

EMBEDDING = 4
WIDTH = 16
STRIDE = 4
FILTERS = 16
BLOCK = 1 << 16
THRESHOLD = 0.3
# Bounds of the training sample: documents, and bytes of each.
SAMPLE_DOCUMENTS = 3000
SAMPLE_BYTES = 20_000
FOLDS = 5
EPOCHS = 8
BATCH = 32
RATE = 0.02


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # WIDTH * EMBEDDING x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # maxima, then means
    offset: float

    def chunks(self, values: np.ndarray) -> np.ndarray:
        """All chunks of a text as rows; the text is padded to a whole number of strides."""
        count = max(0, -(-(len(values) - WIDTH) // STRIDE)) + 1
        padded = np.zeros((count - 1) * STRIDE + WIDTH, np.uint8)
        padded[: len(values)] = values
        embedded = self.embedding[padded].ravel()
        view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBEDDING)
        return view[:: STRIDE * EMBEDDING]

    def respond(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximum, its chunk and mean of each filter's response over the whole text."""
        values = np.frombuffer(text, np.uint8)
        best = np.full(FILTERS, -np.inf, np.float32)
        where = np.zeros(FILTERS, np.int64)
        total = np.zeros(FILTERS)
        count = 0
        # Blocks bound the memory; each starts where the chunks of the one before it end.
        for start in range(0, max(1, len(values) - WIDTH + STRIDE), BLOCK):
            part = values[start : start + BLOCK + WIDTH - STRIDE]
            response = np.tanh(self.chunks(part) @ self.filters + self.bias)
            top = response.argmax(0)
            largest = response[top, np.arange(FILTERS)]
            where = np.where(largest > best, start // STRIDE + top, where)
            best = np.maximum(best, largest)
            total += response.sum(0)
            count += len(response)
        return best, where, (total / count).astype(np.float32)

    def score(self, text: bytes) -> float:
        best, _, mean = self.respond(text)
        z = float(np.concatenate([best, mean]) @ self.weights + self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def start_network(seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        normal(256, EMBEDDING, scale=0.5),
        normal(WIDTH * EMBEDDING, FILTERS, scale=0.25),
        np.zeros(FILTERS, np.float32),
        normal(2 * FILTERS, scale=0.1),
        0.0,
    )


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Gradient descent with momentum-free Adam steps on the log loss; classes weigh the same.

    The gradient of a maximum flows to its chunk alone; that of a mean to all chunks of the text.
    """
    net = start_network(seed)
    if not texts:
        return net
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    names = ("embedding", "filters", "bias", "weights")
    moments = {c: [np.zeros_like(getattr(net, c)), np.zeros_like(getattr(net, c))] for c in names}
    offset_moments = [0.0, 0.0]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            grads = {c: np.zeros_like(getattr(net, c)) for c in names}
            offset_grad = 0.0
            batch = order[at : at + BATCH]
            for i in batch:
                values = np.frombuffer(texts[i], np.uint8)
                rows = net.chunks(values)
                response = np.tanh(rows @ net.filters + net.bias)
                top = response.argmax(0)
                features = np.concatenate([response[top, np.arange(FILTERS)], response.mean(0)])
                z = float(features @ net.weights + net.offset)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(batch)
                grads["weights"] += error * features
                offset_grad += error
                flow = np.zeros_like(response)
                flow[top, np.arange(FILTERS)] = error * net.weights[:FILTERS]
                flow += error * net.weights[FILTERS:] / len(response)
                flow *= 1 - response * response
                grads["filters"] += rows.T @ flow
                grads["bias"] += flow.sum(0)
                # Back to the bytes of the chunks with a maximum.
                chosen = np.unique(top)
                back = (flow[chosen] @ net.filters.T).reshape(-1, EMBEDDING)
                places = (chosen[:, None] * STRIDE + np.arange(WIDTH)).ravel()
                inside = places < len(values)
                np.add.at(grads["embedding"], values[places[inside]], back[inside])
            step += 1
            for c in names:
                first, second = moments[c]
                first *= 0.9
                first += 0.1 * grads[c]
                second *= 0.999
                second += 0.001 * grads[c] ** 2
                change = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                setattr(net, c, getattr(net, c) - np.float32(RATE) * change.astype(np.float32))
            offset_moments = [0.9 * offset_moments[0] + 0.1 * offset_grad, 0.999 * offset_moments[1] + 0.001 * offset_grad**2]
            net.offset -= RATE * offset_moments[0] / (1 - 0.9**step) / (np.sqrt(offset_moments[1] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def sample(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS, size: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """At most ``documents`` labelled texts of at most ``size`` bytes that are not held out.

    They are the first by a hash of their id, so the sample does not depend on the layout.
    Labels that are null or contradict each other are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    known = known.where("low = high").where(~held_out()).select("doc_id", F.col("low").cast("int").alias("quality"))
    texts = docs.where(F.octet_length("text") <= size).select("doc_id", "text")
    # Ids are picked first, so that only the texts of the sample move.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", text_bytes(), "quality")
    # A doc_id may be repeated.
    found = sorted(map(tuple, rows.limit(2 * documents).collect()))[:documents]
    return [bytes(t) for _, t, _ in found], [q for _, _, q in found]


def classify(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Only the text is an input of the score. A null text counts as empty and has the score of
    padding alone; without labelled rows the untrained network scores. A null doc_id counts as
    the empty string for the fold. Repeated rows stay; an empty table gives an empty result.
    """
    net = train(*sample(docs, labels, documents))

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {
            "doc_id": rows["doc_id"],
            "held_out": rows["held_out"],
            "score": [net.score(t) for t in rows["bytes"]],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("bytes"))
    scored = map_rows(chosen, work, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
