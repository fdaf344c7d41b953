"""Telling the language of transcripts with a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribble.llm.words import LETTERS, LOWER, buffers
from cribble.operators.ranking import broadcast_if_small, top_per_group

UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 1_200
SAMPLE_CHARS = 240
HIDDEN = 8
STEP = 96
#: Chunks that run side by side.
LANES = 2_048

#: Input symbols: 0 for a run of anything that is no letter, 1-26 a-z without case, one for
#: each byte beyond ASCII, and one for padding.
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(LETTERS)] = np.arange(1, 27)
SYMBOL = SYMBOL[LOWER]
SYMBOL[128:] = np.arange(27, 155)
PAD = 155
SYMBOLS = 156

GATES = ("z", "r", "n")


@dataclass
class Network:
    """Weights of both directions and of the output layer; index 0 is forward."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        w = {}
        for g in GATES:
            w["w" + g] = draw(2, SYMBOLS, hidden, scale=0.5)
            w["u" + g] = draw(2, hidden, hidden, scale=hidden**-0.5)
        w["b"] = np.zeros((2, hidden), np.float32)
        w["out"] = draw(2 * hidden, len(languages), scale=0.3)
        w["bias"] = np.zeros(len(languages), np.float32)
        return cls(languages, w)


def symbols_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input symbols of many texts, a run of non-letters being one, and the texts' bounds in them."""
    codes = SYMBOL[data]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[starts] = True
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return codes[keep], before[bounds]


def chunks_of(codes: np.ndarray, bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text cut into chunks of ``step`` symbols: padded rows, lengths, text numbers."""
    n = np.diff(bounds)
    pieces = -(-n // step)
    text = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = bounds[:-1][text] + nth * step
    length = np.minimum(step, bounds[1:][text] - start)
    at = start[:, None] + np.arange(step)
    padded = np.append(codes, np.uint8(PAD))
    rows = padded[np.where(np.arange(step) < length[:, None], at, len(codes))]
    return rows, length, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1.0)
    x *= np.float32(0.5)
    return x


def _states(w: dict, d: int, codes: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """Hidden states of direction ``d`` at each position; ``keep`` gets what training needs."""
    steps, lanes = codes.shape
    h = np.zeros((lanes, w["b"].shape[1]), np.float32)
    out: list = [None] * steps
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        c = codes[t]
        z = _sigmoid(w["wz"][d].take(c, axis=0) + h @ w["uz"][d])
        r = _sigmoid(w["wr"][d].take(c, axis=0) + h @ w["ur"][d])
        q = h @ w["un"][d]
        q += w["b"][d]
        n = r * q
        n += w["wn"][d].take(c, axis=0)
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, z, r, q, n))
        new = h - n
        new *= z
        new += n
        out[t] = h = new
    return out


def _probabilities(w: dict, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    k = ahead.shape[1]
    x = ahead @ w["out"][:k]
    x += back @ w["out"][k:]
    x += w["bias"]
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def pool(w: dict, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of the label probabilities over the positions of each chunk."""
    total = np.zeros((len(rows), len(w["bias"])), np.float64)
    for a in range(0, len(rows), LANES):
        codes = np.ascontiguousarray(rows[a: a + LANES].T)
        ahead, back = _states(w, 0, codes), _states(w, 1, codes)
        n, full = length[a: a + LANES], int(length[a: a + LANES].min())
        sums = np.zeros((codes.shape[1], len(w["bias"])), np.float32)
        for t in range(len(codes)):
            p = _probabilities(w, ahead[t], back[t])
            sums += p if t < full else p * (t < n)[:, None]
        total[a: a + LANES] = sums
    return total


def gradients(w: dict, codes: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Loss (mean over positions) and its gradient by backpropagation through time."""
    steps, lanes = codes.shape
    k = w["b"].shape[1]
    g = {name: np.zeros_like(v) for name, v in w.items()}
    kept: tuple[list, list] = ([], [])
    states = [_states(w, d, codes, kept[d]) for d in (0, 1)]
    count, loss = float(length.sum()), 0.0
    dh_out: list = [[None] * steps, [None] * steps]
    for t in range(steps):
        p = _probabilities(w, states[0][t], states[1][t])
        inside = (t < length).astype(np.float32)[:, None] / np.float32(count)
        loss -= float((np.log(p[np.arange(lanes), label] + 1e-12) * inside[:, 0]).sum())
        p[np.arange(lanes), label] -= 1
        p *= inside
        g["bias"] += p.sum(0)
        for d in (0, 1):
            g["out"][d * k: (d + 1) * k] += states[d][t].T @ p
            dh_out[d][t] = p @ w["out"][d * k: (d + 1) * k].T
    for d in (0, 1):
        dh = np.zeros((lanes, k), np.float32)
        for t, h, z, r, q, n in reversed(kept[d]):
            dh = dh + dh_out[d][t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dq = dn * r
            dr = dn * q * r * (1 - r)
            for name, part in (("z", dz), ("r", dr), ("n", dn)):
                np.add.at(g["w" + name][d], codes[t], part)
            g["uz"][d] += h.T @ dz
            g["ur"][d] += h.T @ dr
            g["un"][d] += h.T @ dq
            g["b"][d] += dq.sum(0)
            dh = dh * z + dz @ w["uz"][d].T + dr @ w["ur"][d].T + dq @ w["un"][d].T
    return loss, g


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, rounds: int = 500,
          lanes: int = 96, step: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit the network to labelled texts with Adam; every position is to show its text's language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, hidden, rng)
    # Padding leaves a state as it is: its update gate is shut.
    net.weights["wz"][:, PAD] = 60
    if len(languages) < 2:
        return net
    data, bounds = buffers(pa.array(texts, pa.string()))
    rows, length, text = chunks_of(*symbols_of(data, bounds), step)
    target = np.array([languages.index(x) for x in labels])[text]
    by_label = [np.flatnonzero(target == i) for i in range(len(languages))]
    by_label = [x for x in by_label if len(x)]
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for i in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(x, -(-lanes // len(by_label))) for x in by_label])
        _, g = gradients(net.weights, np.ascontiguousarray(rows[pick].T), length[pick], target[pick])
        g["wz"][:, PAD] = 0
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        now = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for name, w in net.weights.items():
            x = g[name] * np.float32(min(1.0, 1.0 / max(size, 1e-9)))
            mean[name] = np.float32(0.9) * mean[name] + np.float32(0.1) * x
            square[name] = np.float32(0.99) * square[name] + np.float32(0.01) * x * x
            w -= np.float32(now / (1 - 0.9**i)) * mean[name] / (np.sqrt(square[name] / np.float32(1 - 0.99**i)) + np.float32(1e-7))
    return net


def fit_language_tagger(
    labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS, **training,
) -> Network:
    """Train on a bounded sample of ``text, language`` rows.

    Of the different texts of each language about ``per_language`` are drawn by a hash of the
    text, never more than twice as many, and ``chars`` characters from a hashed place of each. So what
    reaches the driver is bounded by these parameters and the number of languages, however many
    rows share a text. Rows without text, letters or language do not take part.
    """
    usable = labelled.select("text", "language", F.xxhash64("text").alias("h")).where(
        F.col("language").isNotNull() & has_letters(F.col("text")))
    counts = broadcast_if_small(usable.groupBy("language").agg(F.countDistinct("h").alias("n")))
    mark = F.pmod("h", F.lit(1_000_000))
    drawn = usable.join(counts, "language").where(mark * F.col("n") < F.lit(per_language * 1_000_000))
    room = F.greatest(F.lit(1), F.length("text") - chars)
    start = F.pmod(F.xxhash64("text", F.lit(1)), room).cast("int") + 1
    once = drawn.select(F.substring("text", start, F.lit(chars)).alias("text"), "language", "h").dropDuplicates(["language", "h"])
    kept = top_per_group(once, ["language"], [F.pmod("h", F.lit(1_000_000)), F.col("h")], 2 * per_language)
    rows = kept.orderBy("language", "text").collect()
    return train([r.text for r in rows], [r.language for r in rows], **training)


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _tagging(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = net.weights, len(net.languages)
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            sums = np.zeros((len(bounds) - 1, k))
            a = 0
            while a < len(bounds) - 1:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 20), "right")) - 1)
                codes, inner = symbols_of(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
                # A very long text goes through in pieces of whole chunks.
                for c in range(0, max(1, len(codes)), STEP * LANES * 8):
                    d = min(len(codes), c + STEP * LANES * 8)
                    rows, length, text = chunks_of(codes[c:d], np.clip(inner - c, 0, d - c), STEP)
                    if len(rows) and k:
                        np.add.at(sums[a:b], text, pool(w, rows, length))
                a = b
            total = sums.sum(1)
            share = sums / np.maximum(total, 1e-12)[:, None]
            best = share.argmax(1) if k else np.zeros(len(share), int)
            known = batch.column(2).to_numpy(zero_copy_only=False) & (total > 0)
            names = [net.languages[i] if ok else UNKNOWN for i, ok in zip(best, known)]
            score = np.where(known, share[np.arange(len(share)), best] if k else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0.0, 1.0), pa.float64())],
                ["id", "language", "language_probability"])

    return run


def tag_language(transcripts: DataFrame, net: Network) -> DataFrame:
    """Predict the language of each whole transcript.

    ``transcripts``: ``id, text``; other columns are ignored. Texts are cut into
    chunks; the network labels every position of every chunk, and a text's
    probabilities are the means over its positions.

    Returns one row per input row, in place: ``id, language,
    language_probability`` (of that language, 0 to 1). A text that is null or
    has no letters is ``und`` with 0; so is every text if nothing was learned.
    Ties go to the language first in order. Nothing is shuffled; the weights
    (some 10,000 numbers) travel with the tasks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = transcripts.select("id", text.alias("text"), has_letters(text).alias("letters"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_tagging(net), f"id {kind}, language string, language_probability double")
