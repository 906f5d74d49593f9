"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, runs of ``PASSAGE`` bytes that cover its whole text.
A passage is described by how its byte classes follow each other (letters, capitals, digits, blanks,
line ends, kinds of punctuation, non-ASCII) and by how many of its words already stood, with their right neighbourhood,
earlier in the document; a tanh layer encodes that.  Gated attention weighs the
encoded passages, and the weighted sum is scored:

    h = tanh(x W),  a = softmax(w . (tanh(h V) * sigmoid(h U))),  score = sigmoid(c . sum(a h) + b)

Only document labels are used.  Training takes a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import in_arrow, mixed, raw, slices, texts_of

PASSAGE = 512
# Byte classes, by example: a, A, 0, blank, line end, stop, comma, "!?", "|", other ASCII, non-ASCII.
_CLASSES = np.full(256, 9, np.uint8)
_CLASSES[0x61:0x7B], _CLASSES[0x41:0x5B], _CLASSES[0x30:0x3A], _CLASSES[0x80:] = 0, 1, 2, 10
for _bytes, _class in ((b" ", 3), (b"\t\n\v\f\r", 4), (b".", 5), (b",;:", 6), (b"!?", 7), (b"|", 8)):
    _CLASSES[list(_bytes)] = _class
N_CLASSES = 11
N_FEATURES = N_CLASSES * N_CLASSES + 3


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); an empty text is one empty passage."""
    sizes = np.array([len(x) for x in texts], np.int64)
    bags = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(texts) + bytes(17), np.uint8)
    n = int(sizes.sum())
    begins = np.cumsum(sizes) - sizes
    first = np.cumsum(bags) - bags
    total = int(bags.sum())
    features = np.zeros((total, N_FEATURES), np.float32)
    if n:
        owner = np.repeat(np.arange(len(texts)), sizes)
        passage = first[owner] + (np.arange(n) - begins[owner]) // PASSAGE
        kind = _CLASSES[data[: n + 1]]
        pair = kind[:-1].astype(np.int64) * N_CLASSES + kind[1:]
        inside = np.ones(n, bool)
        inside[begins[1:][begins[1:] > 0] - 1] = False
        inside[-1] = False
        counts = np.bincount((passage * (N_CLASSES * N_CLASSES) + pair)[inside], minlength=total * N_CLASSES * N_CLASSES)
        counts = counts.reshape(total, -1).astype(np.float32)
        features[:, : N_CLASSES * N_CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
        blank = (kind[:-1] == 3) | (kind[:-1] == 4)
        starts = ~blank
        starts[1:] &= blank[:-1] | ~inside[:-1]
        at = np.flatnonzero(starts)
        # Sixteen bytes from each word's start, and the document: seen before or not.
        gram = np.zeros(len(at), np.uint64)
        for half in (0, 8):
            part = np.zeros(len(at), np.uint64)
            for i in range(8):
                part |= data[at + half + i].astype(np.uint64) << np.uint64(8 * i)
            gram = mixed(gram ^ part)
        _, earliest = np.unique(mixed(gram ^ owner[at].astype(np.uint64)), return_index=True)
        seen = np.ones(len(at), bool)
        seen[earliest] = False
        words = np.bincount(passage[at], minlength=total)
        features[:, -3] = np.bincount(passage[at], weights=seen, minlength=total) / np.maximum(1, words)
        length = np.bincount(passage, minlength=total)
        features[:, -2] = np.log1p(length / np.maximum(1, words))
        features[:, -1] = np.log1p(length)
    return features, bags


def _sums(x: np.ndarray, bags: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(bags) - bags, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + p["Wb"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        top = np.maximum.reduceat(s, np.cumsum(bags) - bags)
        e = np.exp(s - np.repeat(top, bags))
        a = e / np.repeat(_sums(e, bags), bags)
        z = _sums(a[:, None] * h, bags)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"])}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, bags = encode(texts)
        return self.forward((x - self.mean) / self.scale, bags)["score"]


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, width: int = 24, rounds: int = 40, batch: int = 128, rate: float = 3e-3, seed: int = 7) -> Network:
    """Adam on the cross entropy of document labels; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float64)
    p = {
        "W": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], width)), "Wb": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, width)),
        "U": rng.normal(0, width**-0.5, (width, width)), "w": rng.normal(0, 0.1, width), "c": rng.normal(0, 0.1, width), "b": np.zeros(1),
    }
    net = Network(mean, scale, p)
    first = np.cumsum(bags) - bags
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            own = bags[chosen]
            rows = np.repeat(first[chosen] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            part = x[rows]
            f = net.forward(part, own)
            error = (f["score"] - y[chosen]) / len(chosen)
            dz = np.repeat(error[:, None] * p["c"], own, axis=0)
            da = (f["h"] * dz).sum(axis=1)
            ds = f["a"] * (da - np.repeat(_sums(f["a"] * da, own), own))
            dtg = ds[:, None] * p["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grads = {
                "W": part.T @ dh + 1e-4 * p["W"], "Wb": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ error, "b": error.sum(keepdims=True),
            }
            step += 1
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    net.weights = {k: v.astype(np.float32) for k, v in p.items()}
    net.mean, net.scale = mean.astype(np.float32), scale.astype(np.float32)
    return net


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x, bags = encode(raw(part.column("text")))
            ends = np.cumsum(bags)
            rows = [x[a:b].astype("<f2").tobytes() for a, b in zip(ends - bags, ends)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "passages"])


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 3000, max_bytes: int = 48 << 20) -> Network | None:
    """Network learned from the rows of ``docs`` that ``labels`` (doc_id, quality 0/1) covers; None without rows of both classes.

    The sample: of the first ``max_documents`` labelled rows by a hash of id and text those whose
    (whole) texts fit into ``max_bytes`` together, taken in turn; a text that does not fit is passed over, and a class that
    is then missing has its shortest text.  Both bounds are documented parameters.  The sample is chosen from
    ids, hashes and sizes; texts are fetched for the chosen ones alone.
    """
    rows = texts_of(docs).withColumns({"mark": F.xxhash64(F.lit(17), "doc_id", "text"), "size": F.octet_length("text")})
    marked = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = rows.select("doc_id", "mark", "size").join(marked, "doc_id")
    chosen, total = [], 0
    for r in known.orderBy("mark", "size", "quality").limit(max_documents).collect():
        if total + r["size"] <= max_bytes:
            total += r["size"]
            chosen.append((r["doc_id"], r["mark"], r["quality"]))
    for missing in {0, 1} - {x[2] for x in chosen}:
        shortest = known.where(F.col("quality") == missing).orderBy("size", "mark").first()
        if shortest is None:
            return None
        chosen.append((shortest["doc_id"], shortest["mark"], shortest["quality"]))
    few = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, mark bigint, quality int").distinct()
    sample = rows.join(F.broadcast(few), ["doc_id", "mark"]).select("doc_id", "text", "quality")
    sample = in_arrow(sample, _encoded, "doc_id bigint, quality int, passages binary")
    found = sorted((r["doc_id"], r["quality"], bytes(r["passages"])) for r in sample.collect())
    bags = np.array([len(r[2]) // (2 * N_FEATURES) for r in found], np.int64)
    x = np.frombuffer(b"".join(r[2] for r in found), "<f2").reshape(-1, N_FEATURES).astype(np.float32)
    return fit(x, bags, np.array([r[1] for r in found], np.float64))


def _score(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = net.scores(raw(part.column("text"))) if net else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.asarray(scores, np.float64))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row, 0 to 1, higher for better quality.

    Equal texts have equal scores; a null text is empty, and an empty one is a bag of one empty passage.
    Without a network every score is 0.5.  Only the text is looked at.
    """
    return in_arrow(texts_of(docs), _score(net), "doc_id bigint, score double")
