"""Quality classifier: a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks of ``CHUNK`` bytes that together hold every byte; the last chunk ends
with the text, a shorter text is filled up with a byte of its own kind. Each byte is a learned vector, learned filters of
``WIDTH`` bytes slide over a chunk in steps of ``STRIDE``, and each filter keeps its maximum over the chunk. The
document has the largest, smallest and mean of these maxima over its chunks; a hidden layer and a logistic unit combine
them into one probability, so junk in one chunk of a long text is seen as well as junk throughout.

The network is fitted on at most ``PER_CLASS`` labelled documents of each class, chosen by hash, with at most ``FIT_CHUNKS`` chunks
each, spread over the text. This bounds the fit, which runs on the driver, and the network (some 35 kB) that tasks get. Both classes
weigh the same. Scores read all chunks of all documents.

Defined cases: null and empty texts are one chunk of filling and get a score like any text. Labels without a document, null labels
and ids are not used; of several labels of one document the smallest counts. If a class has no labelled document, every
score is the share of label 1 among those there are (0.5 without labels). Repeated rows get equal scores. An empty table gives
an empty result. Only ids and texts are read of documents. Scores are rounded to six places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.llm.registry import query, staged, table

CHUNK, STEP, FILL = 512, 448, 256
WIDTH, STRIDE, VECTOR, FILTERS, HIDDEN = 8, 2, 8, 32, 24
PER_CLASS, FIT_CHUNKS = 1000, 12
EPOCHS, BATCH, RATE, SEED = 24, 32, 0.004, 7
THRESHOLD = 0.3
_AT_ONCE = 128


def starts_of(size: int) -> np.ndarray:
    """Where the chunks of a text of that many bytes begin."""
    if size <= CHUNK:
        return np.zeros(1, "i8")
    return np.r_[np.arange(0, size - CHUNK, STEP), size - CHUNK]


def chunks_of(text: bytes, most: int | None = None) -> np.ndarray:
    """The chunks of a text as rows of byte numbers; with ``most``, that many spread over it."""
    data = np.frombuffer(text, "u1").astype("i2")
    if len(data) < CHUNK:
        data = np.r_[data, np.full(CHUNK - len(data), FILL, "i2")]
    starts = starts_of(len(text))
    if most and len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype("i8")]
    return data[starts[:, None] + np.arange(CHUNK)]


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(scale, *shape):
        return (rng.standard_normal(shape) * scale).astype("f4")

    return {
        "vector": normal(0.5, 257, VECTOR),
        "filter": normal((2 / (WIDTH * VECTOR)) ** 0.5, WIDTH * VECTOR, FILTERS),
        "filter_bias": np.zeros(FILTERS, "f4"),
        "hidden": normal((2 / (3 * FILTERS)) ** 0.5, 3 * FILTERS, HIDDEN),
        "hidden_bias": np.zeros(HIDDEN, "f4"),
        "out": normal(HIDDEN**-0.5, HIDDEN, 1),
        "out_bias": np.zeros(1, "f4"),
    }


_PLACES = np.arange(0, CHUNK - WIDTH + 1, STRIDE)[:, None] + np.arange(WIDTH)


def filtered(net: dict, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk and filter the maximum over the places, and the place."""
    best, place = [], []
    for at in range(0, len(chunks), _AT_ONCE):
        part = chunks[at : at + _AT_ONCE]
        vectors = net["vector"][part].reshape(len(part), -1)
        windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]
        answer = windows.reshape(-1, WIDTH * VECTOR) @ net["filter"]
        answer = answer.reshape(len(part), -1, FILTERS)
        where = answer.argmax(axis=1)
        place.append(where)
        best.append(np.take_along_axis(answer, where[:, None], 1)[:, 0])
    return np.maximum(np.concatenate(best) + net["filter_bias"], 0), np.concatenate(place)


def pooled(best: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum.reduceat(best, first), np.minimum.reduceat(best, first), np.add.reduceat(best, first) / sizes[:, None]], axis=1)


def combined(net: dict, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(features @ net["hidden"] + net["hidden_bias"], 0)
    return 1 / (1 + np.exp(-np.clip((hidden @ net["out"] + net["out_bias"])[:, 0], -30, 30))), hidden


def scores(net: dict, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1; all bytes of all texts are read."""
    parts, sizes, held, out = [], [], 0, []

    def flush():
        first = np.cumsum([0] + sizes[:-1])
        best, _ = filtered(net, np.concatenate(parts))
        out.append(combined(net, pooled(best, first, np.array(sizes)))[0])

    for text in texts:
        if len(text) > (2 << 20):
            # A very long text goes through in parts; its maxima, minima and sums are put together.
            starts = starts_of(len(text))
            data = np.frombuffer(text, "u1")
            most, least, total = None, None, 0
            for at in range(0, len(starts), 2048):
                best, _ = filtered(net, data[starts[at : at + 2048, None] + np.arange(CHUNK)].astype("i2"))
                most = best.max(0) if most is None else np.maximum(most, best.max(0))
                least = best.min(0) if least is None else np.minimum(least, best.min(0))
                total = total + best.sum(0, dtype="f8")
            if parts:
                flush()
                parts, sizes, held = [], [], 0
            out.append(combined(net, np.r_[most, least, total / len(starts)][None].astype("f4"))[0])
            continue
        chunks = chunks_of(text)
        parts.append(chunks), sizes.append(len(chunks))
        held += len(chunks)
        if held >= 1024:
            flush()
            parts, sizes, held = [], [], 0
    if parts:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def _gradients(net, chunks, first, sizes, labels, weights):
    best, place = filtered(net, chunks)
    features = pooled(best, first, sizes)
    chance, hidden = combined(net, features)
    grad = {}
    d_out = ((chance - labels) * weights)[:, None].astype("f4") / len(labels)
    grad["out"], grad["out_bias"] = hidden.T @ d_out, d_out.sum(0)
    d_hidden = (d_out @ net["out"].T) * (hidden > 0)
    grad["hidden"], grad["hidden_bias"] = features.T @ d_hidden, d_hidden.sum(0)
    d_most, d_least, d_mean = np.split(d_hidden @ net["hidden"].T, 3, axis=1)
    of = np.repeat(np.arange(len(sizes)), sizes)
    d_best = (d_mean / sizes[:, None])[of]
    for pick, d in ((features[:, :FILTERS], d_most), (features[:, FILTERS : 2 * FILTERS], d_least)):
        hit = best == pick[of]
        share = np.add.reduceat(hit, first, dtype="f4")
        d_best += hit * (d / share)[of]
    d_best *= best > 0
    grad["filter_bias"] = d_best.sum(0)
    # Only the windows that gave a maximum have a part in it.
    window = _PLACES[place][..., :] + (np.arange(len(chunks)) * CHUNK)[:, None, None]
    symbols = chunks.reshape(-1)[window]
    vectors = net["vector"][symbols].reshape(len(chunks), FILTERS, WIDTH * VECTOR)
    grad["filter"] = np.einsum("cfk,cf->kf", vectors, d_best)
    d_vectors = (d_best[..., None] * net["filter"].T[None]).reshape(-1, VECTOR)
    grad["vector"] = np.stack([np.bincount(symbols.reshape(-1), d_vectors[:, i], 257) for i in range(VECTOR)], 1)
    loss = -np.mean(weights * np.where(labels == 1, np.log(chance + 1e-7), np.log(1 - chance + 1e-7)))
    return loss, grad


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A network from the chunks and labels of documents; both labels must occur."""
    net, rng = initial(seed), np.random.default_rng(seed + 1)
    weights = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(texts[i]) for i in some])
            begin = np.cumsum(np.r_[0, sizes[:-1]])
            _, grad = _gradients(net, np.concatenate([texts[i] for i in some]), begin, sizes, labels[some], weights[some])
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / total)
            for k, g in grad.items():
                first[k] += 0.1 * (g.astype("f4") - first[k])
                second[k] += 0.01 * (np.square(g).astype("f4") - second[k])
                net[k] = net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return {k: v.astype("f4") for k, v in net.items()}


def labelled_chunks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, h, chunks) of at most ``PER_CLASS`` documents of each label, chosen by hash."""
    known = labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("label")).where("k is not null and label in (0, 1)")
    known = known.groupBy("k").agg(F.min("label").alias("label"))
    known = known.join(documents.select(F.col("doc_id").alias("k")).distinct(), "k", "left_semi").withColumn("h", F.xxhash64("k"))
    picked = [known.where(F.col("label") == c).orderBy("h", "k").limit(PER_CLASS) for c in (0, 1)]
    # At most two times PER_CLASS rows of three numbers: small enough for every task.
    wanted = F.broadcast(staged(picked[0].unionByName(picked[1]), "labelled"))

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            data = [chunks_of(t.as_py() or b"", FIT_CHUNKS).astype("<i2").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["label", "h", "chunks"])

    found = documents.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("k")).select("label", "h", "text")
    found = staged(found.mapInArrow(run, "label int, h long, chunks binary"), "chunks")
    # Rows may repeat an id; the bound is on rows.
    picked = [found.where(F.col("label") == c).orderBy("h", "chunks").limit(PER_CLASS) for c in (0, 1)]
    return picked[0].unionByName(picked[1])


def learn(documents: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | float:
    """The fitted network, or a constant score if only one label occurs."""
    rows = sorted((r.label, r.h, bytes(r.chunks)) for r in labelled_chunks(documents, labels).collect())
    given = np.array([r[0] for r in rows])
    if len(np.unique(given)) < 2:
        return float(given.mean()) if len(given) else 0.5
    return train([np.frombuffer(r[2], "<i2").reshape(-1, CHUNK) for r in rows], given)


def classify(documents: DataFrame, model: dict[str, np.ndarray] | float) -> DataFrame:
    """doc_id, score, predicted for every document."""
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, predicted int"

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 1000):
                part = [t.as_py() or b"" for t in texts.slice(at, 1000)]
                score = scores(model, part) if isinstance(model, dict) else np.full(len(part), model)
                score = np.round(score.astype("f8"), 6)
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1000), pa.array(score), pa.array((score >= THRESHOLD).astype("i4"))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id, is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@query("op12_quality_net")
def op12_quality_net(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return classify(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
