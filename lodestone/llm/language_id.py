"""Language of texts: a bidirectional gated recurrent network over bytes that labels every position.

Two layers of gated units read a window of bytes, one forwards, one backwards; at each position the states of both
give the probabilities of the languages, and a document's are the means over all its bytes. The weights are trained
here, in NumPy, by backpropagation through time on windows of a bounded sample of labelled documents; they are all
that the driver holds. Whole texts are labelled in tasks, window by window, many windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Units of a direction, bytes of a window, and windows that are read at a time.
UNITS, WINDOW, LANES = 8, 64, 2048
#: The sample: labelled documents of a language at most, pieces of each, and code points of a piece.
MOST_DOCS, PIECES, PIECE = 1000, 4, 128
STEPS, BATCH, RATE, SEED = 300, 256, 0.03, 20240517
#: The symbol that fills up a window: it leaves states as they are.
PAD = 256
UNKNOWN = "und"


@dataclass
class Model:
    """Weights of both directions (leading axis); update, reset and candidate lie one after the other.

    Gates and candidates bend by x / (1 + |x|), which is cheap and saturates slowly.
    """

    langs: list[str]
    inputs: np.ndarray  # 2 × 257 × 3 units
    states: np.ndarray  # 2 × 3 units × units
    bias: np.ndarray  # 2 × units, of the candidate's state
    out: np.ndarray  # langs × 2 units
    out_bias: np.ndarray  # langs

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.bias, self.out, self.out_bias]


def _bend(x: np.ndarray) -> None:
    size = np.abs(x)
    size += 1
    x /= size


def forward(model: Model, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Probabilities (window length × langs × lanes) at each position of `windows` (window length × lanes).

    `keep` gets what the way back needs of each step.
    """
    length, lanes = windows.shape
    units = model.states.shape[2]
    both = [windows.astype(np.intp), windows[::-1].astype(np.intp)]
    state = np.zeros((2, units, lanes), np.float32)
    seen = np.empty((length, 2 * units, lanes), np.float32)
    given, rows = np.empty((2, units, lanes), np.float32), np.empty((lanes, 3 * units), np.float32)
    carried, bias = np.empty((2, 3 * units, lanes), np.float32), model.bias[:, :, None]
    gates, candidate = carried[:, : 2 * units], carried[:, 2 * units :]
    update, reset = carried[:, :units], carried[:, units : 2 * units]
    for t in range(length):
        np.matmul(model.states, state, out=carried)
        for way in range(2):
            np.take(model.inputs[way], both[way][t], axis=0, out=rows, mode="clip")
            gates[way] += rows[:, : 2 * units].T
            given[way] = rows[:, 2 * units :].T
        _bend(gates)
        gates += 1
        gates *= np.float32(0.5)
        candidate += bias
        inner = candidate.copy() if keep is not None else None
        candidate *= reset
        candidate += given
        _bend(candidate)
        if keep is not None:
            keep.append((state.copy(), update.copy(), reset.copy(), inner, candidate.copy()))
        state -= candidate
        state *= update
        state += candidate
        seen[t, :units] = state[0]
        seen[length - 1 - t, units:] = state[1]
    probs = np.matmul(model.out, seen)
    probs += model.out_bias[:, None]
    probs -= probs.max(1, keepdims=True)
    np.exp(probs, out=probs)
    probs /= probs.sum(1, keepdims=True)
    if keep is not None:
        keep.append((both, seen))
    return probs


def gradients(model: Model, windows: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy over the positions that hold bytes, and its gradient by each weight, back through time."""
    keep: list = []
    probs = forward(model, windows, keep)
    length, _, lanes = probs.shape
    units = model.states.shape[2]
    both, seen = keep.pop()
    real = windows != PAD
    total = max(1, int(real.sum()))
    loss = -float(np.log(np.maximum(probs[:, truth, np.arange(lanes)], 1e-9))[real].sum() / total)
    d_logits = probs
    d_logits[:, truth, np.arange(lanes)] -= 1
    d_logits *= real[:, None] / np.float32(total)
    d_seen = np.matmul(model.out.T, d_logits)
    d_inputs, d_states, d_bias = np.zeros_like(model.inputs), np.zeros_like(model.states), np.zeros_like(model.bias)
    d_given = np.empty((2, 3 * units, length, lanes), np.float32)
    d_state = np.zeros((2, units, lanes), np.float32)
    for t in range(length - 1, -1, -1):
        before, update, reset, inner, candidate = keep[t]
        d_state = d_state + np.stack([d_seen[t, :units], d_seen[length - 1 - t, units:]])
        d_candidate = d_state * (1 - update) * (1 - np.abs(candidate)) ** 2
        d_inner = d_candidate * reset
        d_update = d_state * (before - candidate) * (1 - np.abs(2 * update - 1)) ** 2 / 2
        d_reset = d_candidate * inner * (1 - np.abs(2 * reset - 1)) ** 2 / 2
        d_carried = np.concatenate([d_update, d_reset, d_inner], 1)
        d_given[:, :, t] = np.concatenate([d_update, d_reset, d_candidate], 1)
        d_states += np.matmul(d_carried, before.transpose(0, 2, 1))
        d_bias += d_inner.sum(2)
        d_state = d_state * update + np.matmul(model.states.transpose(0, 2, 1), d_carried)
    for way in range(2):
        for u in range(3 * units):
            d_inputs[way, :, u] = np.bincount(both[way].ravel(), d_given[way, u].ravel(), minlength=PAD + 1)
    d_inputs[:, PAD] = 0
    return loss, [d_inputs, d_states, d_bias, np.einsum("tkl,tul->ku", d_logits, seen), d_logits.sum((0, 2))]


def windows_of(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (a row each) that hold all bytes of the texts in order, the last of each filled up; and their texts' numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // length)
    out = np.full((int(counts.sum()), length), PAD, np.int16)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) * length if len(texts) else sizes
    flat, data = out.reshape(-1), np.frombuffer(b"".join(texts), np.uint8)
    at = 0
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        flat[start : start + size] = data[at : at + size]
        at += size
    return out, np.repeat(np.arange(len(texts)), counts)


def train(pieces: list[tuple[str, bytes]], *, units: int = UNITS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Model:
    """A model of labelled pieces of text, by Adam; all languages are drawn equally often."""
    langs = sorted({lang for lang, _ in pieces})
    rng = np.random.default_rng(seed)
    wide = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    model = Model(langs, wide(2, PAD + 1, 3 * units), wide(2, 3 * units, units), np.zeros((2, units), np.float32), wide(len(langs), 2 * units), np.zeros(len(langs), np.float32))
    model.inputs[:, PAD] = 0
    model.inputs[:, PAD, :units] = 1e9  # the update gate keeps the state
    if not langs:
        return model
    windows, of = windows_of([data for _, data in pieces])
    truth = np.array([langs.index(lang) for lang, _ in pieces])[of]
    places = [np.flatnonzero(truth == k) for k in range(len(langs))]
    places = [p for p in places if len(p)]
    if len(langs) < 2 or not len(windows):
        return model
    weights = model.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        own = np.concatenate([rng.choice(p, -(-batch // len(places))) for p in places])
        _, slopes = gradients(model, windows[own].T, truth[own])
        norm = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        pace = rate * min(1.0, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-4
        for w, m, v, g in zip(weights, first, second, slopes, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (pace / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, *, ident: str, text: str, lang: str, most_docs: int = MOST_DOCS, pieces: int = PIECES, piece: int = PIECE, steps: int = STEPS, units: int = UNITS) -> Model:
    """A model of the languages of labelled documents.

    The fit looks at no more than `pieces` pieces of `piece` code points of `most_docs` documents a language: of some eight
    times as many, drawn from all by a hash of the id, those with the least hash; and pieces at places that follow from the
    id. A row is counted and drawn where it is read, so what meets by language doesn't grow with the table. Rows with a
    null language or text, or with a text without letters, aren't looked at. Ties and repeated rows may be drawn as often
    as they are there. Without any rows there are no languages. The driver holds the sample and a row for each language.
    """
    key, n = F.col("key"), F.length("text")
    places = [F.substring(F.col("text"), F.pmod(F.xxhash64(key, F.lit(k)), F.greatest(n - piece, F.lit(0)) + 1).cast("int") + 1, F.lit(piece)) for k in range(pieces)]
    known = docs.select(F.col(ident).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))  # a row for each language
    near = known.join(F.broadcast(sizes), "lang").withColumn("draw", F.pmod(F.xxhash64(key), F.lit(1 << 40)) / (1 << 40)).filter(F.col("draw") < 8 * most_docs / F.col("size"))
    rows = near.filter(F.col("text").rlike(r"\p{L}")).select("lang", "draw", F.array(*places).alias("pieces"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("draw", "pieces"))  # of some 8 · `most_docs` rows a language
    drawn = rows.withColumn("_r", rank).filter(F.col("_r") <= most_docs).select("lang", "_r", "pieces").collect()
    drawn = sorted(drawn, key=lambda r: (r.lang, r["_r"]))
    return train([(r.lang, p.encode("utf-8", "replace")) for r in drawn for p in r.pieces if p], steps=steps, units=units)


def label_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of the languages over the bytes of each text."""
    windows, of = windows_of(texts)
    out = np.zeros((len(texts), len(model.langs)))
    for s in range(0, len(windows), LANES):
        own = windows[s : s + LANES]
        held = np.full((LANES, WINDOW), PAD, np.int16)  # a full set of lanes each time, so that sums don't depend on how many there are
        held[: len(own)] = own
        probs = forward(model, held.T)[:, :, : len(own)]
        np.add.at(out, of[s : s + LANES], np.einsum("tkl,tl->lk", probs, (own.T != PAD).astype(np.float32)))
    return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The columns of `docs` with ``lang_pred`` and ``score``, the probability of that language, to six digits.

    A text that is null, empty or without letters is `UNKNOWN` with a score of 0, as are all without a language to
    choose. Every byte of a text counts, however long it is. Rows are judged one by one, so repeated rows agree;
    columns named like a result are replaced; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*kept, F.when(lettered, F.col(text)).alias("_read"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary()).to_pylist()
            probs = label_texts(model, [t or b"" for t in texts]) if model.langs else np.zeros((len(texts), 1))
            best = probs.argmax(1) if len(probs) else np.zeros(0, int)
            known = [bool(t) and bool(model.langs) for t in texts]
            langs = [model.langs[k] if there else UNKNOWN for k, there in zip(best, known, strict=True)]
            scores = np.where(known, np.clip(np.round(probs[np.arange(len(best)), best], 6), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(label, f"{schema}, lang_pred string, score double")
