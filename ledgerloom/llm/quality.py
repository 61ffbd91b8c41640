"""Quality scores by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, each with a learned vector. Chunks of ``WIDTH`` bytes begin every
``STRIDE`` bytes, so that they overlap and the last covers the text's end (padded by a symbol of its
own). Learned filters run over every chunk of the whole text; their rectified answers are max-pooled
over all chunks and combined into one probability by a logistic layer with one hidden layer.

Besides its bytes a chunk holds how often a byte equals the one a few places before it, a fixed
function of the bytes that lets filters see stuttering without knowing the words.

Fitting takes a bounded sample of labelled rows: ``most_rows`` in the order of a hash of the id, and of
these, in that order, each whose whole text still fits into ``most_bytes``; one that doesn't is passed over. It runs in one task
with a fixed seed and returns weights only; the task holds about six bytes for each byte of the sample.
Scoring is a map over batches and covers every byte of every text; a text above ``PIECE`` blocks is
walked in pieces whose chunks overlap, with a running maximum, so memory doesn't grow with its length.

Defined results: a null or empty text is a chunk of padding and gets a score as any other; a null
label is no label, and of several labels of an id the least counts; without labels of both kinds the
score is the share of 1 (0.5 with no labels at all); repeated rows are scored each; an empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import keep_rows, text_blocks

STRIDE, BLOCKS = 8, 3
WIDTH = STRIDE * BLOCKS
PAD, DIM, FILTERS, HIDDEN = 256, 4, 24, 12
#: Distances at which a byte is compared with an earlier one.
LAGS = tuple(range(2, 18))
#: Blocks of bytes that the filters run over at a time.
PIECE = 1 << 15
#: Steps that a fit takes at least, in up to 60 rounds over the rows.
LEAST_STEPS = 400
BLOCK_IN = STRIDE * DIM + len(LAGS)


@dataclass
class Network:
    """Weights; ``prior`` is the score where there was nothing to learn from."""

    prior: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(PAD + 1, DIM, scale=0.5),
        "filters": normal(BLOCKS * BLOCK_IN, FILTERS, scale=(BLOCKS * BLOCK_IN) ** -0.5),
        "shift": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        "hidden_shift": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, scale=HIDDEN**-0.5),
        "out_shift": np.zeros(1, np.float32),
    }


def layout(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by block of ``STRIDE``, their lag counts, and the first block of each text (and the end)."""
    sizes = np.diff(at)
    chunks = np.maximum(1, -(-(sizes - (WIDTH - STRIDE)) // STRIDE))
    first = np.concatenate(([0], np.cumsum(chunks + BLOCKS - 1)))
    codes = np.full(first[-1] * STRIDE, PAD, np.uint16)
    codes[np.arange(len(buf)) + np.repeat(first[:-1] * STRIDE - at[:-1], sizes)] = buf
    lags = np.empty((first[-1], len(LAGS)), np.uint8)
    real, same = codes != PAD, np.zeros(len(codes), bool)
    for k, lag in enumerate(LAGS):
        np.equal(codes[lag:], codes[:-lag], out=same[lag:])
        same &= real
        lags[:, k] = np.bitwise_count(same.view(np.uint64))  # eight flags are one word
    # A text's first bytes have none of their own before them.
    for begin in range(-(-max(LAGS) // STRIDE)):
        own = first[:-1] + begin
        lags[own[own < first[1:]]] = 0
    return codes.reshape(-1, STRIDE), lags, first


def answers(w: dict[str, np.ndarray], codes: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """What the filters say of the chunk that begins at each block (the last ones of a text are not chunks)."""
    parts = w["filters"].reshape(BLOCKS, BLOCK_IN, FILTERS)
    wide = parts.transpose(1, 0, 2).reshape(BLOCK_IN, -1)
    # Four floats are taken as one number of 16 bytes, which is much faster than a row each.
    seen = np.take(w["embed"].view(np.complex128).ravel(), codes).view(np.float32).reshape(len(codes), -1)
    said = seen @ wide[: STRIDE * DIM]
    said += lags.astype(np.float32) @ (wide[STRIDE * DIM :] / STRIDE)
    out = said[:, :FILTERS] + w["shift"]
    for k in range(1, BLOCKS):
        out[:-k] += said[k:, k * FILTERS : (k + 1) * FILTERS]
    return out


def pooled(w: dict[str, np.ndarray], codes: np.ndarray, lags: np.ndarray, first: np.ndarray) -> np.ndarray:
    said = answers(w, codes, lags)
    bounds = np.stack([first[:-1], first[1:] - (BLOCKS - 1)], axis=1).ravel()
    return np.maximum(np.maximum.reduceat(said[: bounds[-1]], bounds[:-1], axis=0)[::2], 0)


def pooled_long(w: dict[str, np.ndarray], buf: np.ndarray) -> np.ndarray:
    """What ``pooled`` gives for a single text, by pieces with a running maximum."""
    chunks = max(1, -(-(len(buf) - (WIDTH - STRIDE)) // STRIDE))
    top = np.zeros(FILTERS, np.float32)
    for begin in range(0, chunks, PIECE):
        end = min(chunks, begin + PIECE)
        # Bytes before the piece for its lags; the chunks that begin there belong to the piece before.
        lead = min(begin, -(-max(LAGS) // STRIDE))
        part = buf[(begin - lead) * STRIDE : (end - 1) * STRIDE + WIDTH]
        codes, lags, _ = layout(part, np.array([0, len(part)]))
        top = np.maximum(top, answers(w, codes, lags)[lead : lead + end - begin].max(0))
    return top[None]


def best_chunks(w: dict[str, np.ndarray], codes: np.ndarray, lags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and filter the chunk of the greatest answer, the first of equal ones, and that answer."""
    best = np.zeros((len(first) - 1, FILTERS), np.int64)
    top = np.full(best.shape, -np.inf, np.float32)
    for begin in range(0, first[-1], PIECE):
        end = min(first[-1], begin + PIECE)
        said = answers(w, codes[begin : end + BLOCKS - 1], lags[begin : end + BLOCKS - 1])
        for t in range(np.searchsorted(first, begin, "right") - 1, np.searchsorted(first, end, "left")):
            a, b = max(first[t], begin), min(first[t + 1] - (BLOCKS - 1), end)
            if a < b:
                own = said[a - begin : b - begin]
                at = own.argmax(0)
                value = own[at, np.arange(FILTERS)]
                new = value > top[t]
                best[t, new], top[t, new] = a + at[new], value[new]
    return best, top


def head(w: dict[str, np.ndarray], pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pool @ w["hidden"] + w["hidden_shift"], 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_shift"][0], -30, 30)))


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, lags: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss; only the chunk that gave a filter's maximum takes part."""
    n = len(y)
    best, top = best_chunks(w, codes, lags, first)
    pool = np.maximum(top, 0)
    hidden, p = head(w, pool)
    d_out = ((p - y) / n).astype(np.float32)
    d_hidden = np.outer(d_out, w["out"]) * (hidden > 0)
    d_top = (d_hidden @ w["hidden"].T) * (top > 0)
    parts = w["filters"].reshape(BLOCKS, BLOCK_IN, FILTERS)
    d_filters, d_embed = np.zeros_like(parts), np.zeros_like(w["embed"])
    for k in range(BLOCKS):
        own = codes[best + k]  # texts, filters, bytes of the block
        seen = np.concatenate([w["embed"][own].reshape(n, FILTERS, -1), lags[best + k] / np.float32(STRIDE)], axis=2)
        d_filters[k] = np.einsum("nfi,nf->if", seen, d_top)
        back = (d_top[:, :, None] * parts[k].T[None, :, : STRIDE * DIM]).reshape(-1, DIM)
        for d in range(DIM):
            d_embed[:, d] += np.bincount(own.ravel(), back[:, d], PAD + 1)
    return {
        "embed": d_embed, "filters": d_filters.reshape(-1, FILTERS), "shift": d_top.sum(0),
        "hidden": pool.T @ d_hidden, "hidden_shift": d_hidden.sum(0), "out": hidden.T @ d_out, "out_shift": d_out.sum(keepdims=True),
    }


def fit(texts: list[str], labels: list[int], epochs: int = 14, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> Network:
    """Adam over shuffled batches, more often over few rows; deterministic for equal input."""
    y = np.array(labels, np.float32)
    if len(y) == 0:
        return Network()
    if y.min() == y.max():
        return Network(float(y[0]))
    epochs = max(epochs, min(60, LEAST_STEPS * batch // len(y)))
    ready = [layout(b := np.frombuffer(t.encode(), np.uint8), np.array([0, len(b)])) for t in texts]
    w, rng = start(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    mean = {k: np.zeros(x.shape) for k, x in w.items()}
    step = taken = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            own = order[lo : lo + batch]
            step += 1
            first = np.concatenate(([0], np.cumsum([len(ready[i][0]) for i in own])))
            g = gradients(w, np.concatenate([ready[i][0] for i in own]), np.concatenate([ready[i][1] for i in own]), first, y[own])
            pace = rate * min(1, 2 * (1 - (epoch + lo / len(y)) / epochs))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if epoch >= epochs - 2:  # the mean of the last weights is steadier than the last
                taken += 1
                for k in w:
                    mean[k] += w[k]
    return Network(float(y.mean()), {k: (x / taken).astype(np.float32) for k, x in mean.items()})


def probabilities(texts: pa.Array, network: Network) -> np.ndarray:
    scores = np.full(len(texts), network.prior)
    if network.weights:
        for lo, hi, buf, at in text_blocks(texts, 1 << 18):
            long = len(buf) > PIECE * STRIDE
            pool = pooled_long(network.weights, buf) if long else pooled(network.weights, *layout(buf, at))
            scores[lo:hi] = head(network.weights, pool)[1]
    return scores


def _score(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(probabilities(batch.column("text"), network))], ["id", "score"])


def _good(texts: pa.Array, network: Network, least: float) -> np.ndarray:
    return probabilities(texts, network) >= least


def keep_good(docs: DataFrame, network: Network, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` and more, with all their columns."""
    return keep_rows(docs, text_col, partial(_good, network=network, least=least))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row: the probability of label 1."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(partial(_score, network=network), f"id {own.schema['id'].dataType.simpleString()}, score double")


WEIGHTS = "prior double, name string, shape array<int>, weights binary"


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of a network fitted on all the rows; a row of the prior alone where nothing was to learn."""
    rows = sorted(r for b in batches for r in zip(b.column("place").to_pylist(), b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True))
    network = fit([t for _, t, _ in rows], [int(y) for _, _, y in rows])
    parts = sorted(network.weights.items()) or [("", np.empty(0, np.float32))]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([network.prior] * len(parts)),
            pa.array([name for name, _ in parts]),
            pa.array([list(x.shape) for _, x in parts], pa.list_(pa.int32())),
            pa.array([x.tobytes() for _, x in parts], pa.binary()),
        ],
        ["prior", "name", "shape", "weights"],
    )


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 3000, most_bytes: int = 64 << 20
) -> Network:
    """Fit on at most ``most_rows`` labelled documents and ``most_bytes`` of whole texts, by the least hash of the id."""
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    chosen = told.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most most_rows identifiers and numbers: small enough to be sent to every task.
    rows = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    # As many identifiers and sizes come to the driver; of the texts only those chosen there come together, in one task.
    sizes = rows.select("id", "label", F.xxhash64("id").alias("hash"), F.octet_length("text").alias("size")).collect()
    fitting = []
    for r in sorted(sizes, key=lambda r: (r["hash"], r["id"])):
        if r["size"] <= most_bytes:
            most_bytes -= r["size"]
            fitting.append((r["id"], int(r["label"]), len(fitting)))
    kind = own.schema["id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame(fitting, f"id {kind}, label int, place int")
    sample = own.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("place").alias("place"))
    found = sample.select("place", "text", "label").coalesce(1).mapInArrow(_fit, WEIGHTS).collect()
    weights = {r["name"]: np.frombuffer(bytes(r["weights"]), np.float32).reshape(r["shape"]) for r in found if r["name"]}
    return Network(found[0]["prior"] if found else 0.5, weights)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training: every third by CRC-32 of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
