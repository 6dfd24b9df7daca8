"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes forwards and backwards, labels every position, and a document's
probabilities are the mean over all its positions. It is trained in numpy by backpropagation through time on a
bounded sample of documents, and applied to every byte of every text.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import materialised

WINDOW = 64
#: Windows that run through the network together.
LANES = 4096
#: Tables of so many languages or sampled documents at most are sent to all executors.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Training:
    """``docs_per_lang`` and ``windows_per_doc`` bound the sample the network learns from."""

    docs_per_lang: int = 1500
    windows_per_doc: int = 6
    hidden: int = 8
    steps: int = 500
    batch: int = 192
    rate: float = 0.02
    seed: int = 5


@dataclass
class Model:
    """Per direction: input table (256 x 3 H: reset, update, candidate), recurrence (H x 3 H), and the output layer."""

    langs: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: list[np.ndarray]
    bias: np.ndarray


def _gate(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _run(inputs: np.ndarray, recurrent: np.ndarray, steps, codes: np.ndarray, mask: np.ndarray | None, keep: list | None):
    """Hidden states (T x S x H) in the order of time. ``mask`` is 0 where a window has ended; there the state is 0."""
    t_max, lanes = codes.shape
    hidden = recurrent.shape[0]
    states = np.empty((t_max, lanes, hidden), dtype=np.float32)
    h = np.zeros((lanes, hidden), dtype=np.float32)
    for t in steps:
        x, u = inputs[codes[t]], h @ recurrent
        gates = _gate(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        r, z = gates[:, :hidden], gates[:, hidden:]
        recur = u[:, 2 * hidden :]
        c = np.tanh(x[:, 2 * hidden :] + r * recur)
        new = c + z * (h - c)
        if mask is not None:
            new *= mask[t][:, None]
        if keep is not None:
            keep.append((t, h, r, z, recur, c))
        h = new
        states[t] = h
    return states


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(windows: np.ndarray, langs: np.ndarray, names: list[str], how: Training = Training()) -> Model:
    """Learn from windows of bytes (N x WINDOW) and their language numbers; every position has its window's label."""
    rng = np.random.default_rng(how.seed)
    h, k = how.hidden, len(names)
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    inputs, recurrent = [draw(256, 3 * h, s=0.5) for _ in range(2)], [draw(h, 3 * h, s=0.3) for _ in range(2)]
    output, bias = [draw(h, k, s=0.3) for _ in range(2)], np.zeros(k, dtype=np.float32)
    params = [*inputs, *recurrent, *output, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    groups = [np.flatnonzero(langs == i) for i in range(k)]
    for step in range(how.steps if len(windows) else 0):
        pick = np.concatenate([rng.choice(g, max(1, how.batch // k)) for g in groups if len(g)])
        codes, wanted = windows[pick].T, langs[pick]
        orders = [range(WINDOW), range(WINDOW - 1, -1, -1)]
        kept: list[list] = [[], []]
        states = [_run(inputs[d], recurrent[d], orders[d], codes, None, kept[d]) for d in range(2)]
        chances = _softmax(states[0] @ output[0] + states[1] @ output[1] + bias)
        wrong = chances
        wrong[:, np.arange(len(pick)), wanted] -= 1
        wrong /= np.float32(WINDOW * len(pick))
        grads = [np.zeros_like(p) for p in params]
        grads[6] = wrong.sum(axis=(0, 1))
        for d in range(2):
            grads[4 + d] = np.tensordot(states[d], wrong, axes=((0, 1), (0, 1)))
            from_output = wrong @ output[d].T
            back = np.zeros((len(pick), h), dtype=np.float32)
            for t, before, r, z, recur, c in reversed(kept[d]):
                g = back + from_output[t]
                to_c = g * (1 - z) * (1 - c * c)
                to_z = g * (before - c) * z * (1 - z)
                to_r = to_c * recur * r * (1 - r)
                to_x = np.concatenate([to_r, to_z, to_c], axis=1)
                to_u = np.concatenate([to_r, to_z, to_c * r], axis=1)
                np.add.at(grads[d], codes[t], to_x)
                grads[2 + d] += before.T @ to_u
                back = g * z + to_u @ recurrent[d].T
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = how.rate * (1 - step / how.steps)
        for p, g, m, v in zip(params, grads, first, second):
            g = g * np.float32(scale)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p -= np.float32(rate) * (m / np.float32(1 - 0.9 ** (step + 1))) / (np.sqrt(v / np.float32(1 - 0.99 ** (step + 1))) + np.float32(1e-8))
    return Model(names, inputs, recurrent, output, bias)


def _windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows side by side, the bytes in each, and how many each text has. No window spans two texts."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    data = np.zeros((int(counts.sum()), WINDOW), dtype=np.uint8)
    sizes = np.full(len(data), WINDOW, dtype=np.int32)
    flat, at = data.reshape(-1), 0
    for t, n in zip(texts, counts):
        if n:
            flat[at * WINDOW : at * WINDOW + len(t)] = np.frombuffer(t, dtype=np.uint8)
            at += n
            sizes[at - 1] = len(t) - (n - 1) * WINDOW
    return data, sizes, counts


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all bytes of each text; a text without bytes has zeros."""
    data, sizes, counts = _windows_of(texts)
    sums = np.zeros((len(data), len(model.langs)), dtype=np.float64)
    for at in range(0, len(data), LANES):
        codes, size = np.ascontiguousarray(data[at : at + LANES].T), sizes[at : at + LANES]
        inside = (np.arange(WINDOW)[:, None] < size).astype(np.float32)
        ends = None if (size == WINDOW).all() else inside
        forward = _run(model.inputs[0], model.recurrent[0], range(WINDOW), codes, ends, None)
        backward = _run(model.inputs[1], model.recurrent[1], range(WINDOW - 1, -1, -1), codes, ends, None)
        logits = forward.reshape(-1, forward.shape[2]) @ model.output[0]
        logits += backward.reshape(-1, backward.shape[2]) @ model.output[1]
        # Few languages: work along them one by one is quicker than along a short last axis.
        columns = np.ascontiguousarray(logits.T) + model.bias[:, None]
        np.exp(columns - columns.max(axis=0), out=columns)
        columns /= columns.sum(axis=0)
        columns = columns.reshape(len(model.langs), WINDOW, -1)
        if ends is not None:
            columns *= inside
        sums[at : at + LANES] = columns.sum(axis=1).T
    totals = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    stops = np.cumsum(counts)
    length = np.array([max(len(t), 1) for t in texts])
    return np.clip((totals[stops] - totals[stops - counts]) / length[:, None], 0, 1)


def fit(docs: DataFrame, how: Training = Training(), text: str = "text", lang: str = "lang") -> Model:
    """Train on the rows of ``docs`` with a text and a language.

    At most ``how.docs_per_lang`` documents of each language, taken by a hash of id and text, and
    ``how.windows_per_doc`` windows of each, evenly spaced over the whole text, come to the driver.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    share = F.shiftrightunsigned(F.xxhash64("doc_id", text), 1).cast("double") / 2.0**63
    slim = materialised(known.select(F.col(lang).alias("__l"), share.alias("__share")))
    # Thin out large languages before they are ranked: a third more than wanted is left, all but surely.
    sizes = materialised(slim.groupBy("__l").agg(F.count(F.lit(1)).alias("__n")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    thin = slim.join(sizes, "__l").where(F.col("__share") * F.col("__n") < how.docs_per_lang * 1.34 + 100).distinct()
    order = Window.partitionBy("__l").orderBy("__share")
    picked = materialised(thin.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= how.docs_per_lang).select("__l", "__share"))
    # The texts of the other documents are not moved, as long as the sample is as small as its parameters mean it to be.
    few = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    ranked = known.withColumn("__s", share).join(few, (F.col(lang) == F.col("__l")) & (F.col("__s") == F.col("__share")))
    # Rows that repeat id and text are one.
    ranked = ranked.groupBy("__l", "__share").agg(F.min(text).alias(text))
    n = F.length(text)
    starts = F.transform(F.sequence(F.lit(0), F.lit(how.windows_per_doc - 1)), lambda i: F.floor(F.greatest(n - WINDOW, F.lit(0)) * i / max(how.windows_per_doc - 1, 1)).cast("int"))
    parts = F.array_distinct(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(WINDOW))))
    rows = ranked.select("__l", parts.alias("parts")).collect()
    names = sorted({r["__l"] for r in rows})
    windows, labels = [], []
    for r in sorted(rows, key=lambda r: (r["__l"], r["parts"])):
        for part in r["parts"]:
            raw = part.encode("utf-8")
            windows.append((raw * (WINDOW // len(raw) + 1))[:WINDOW])
            labels.append(names.index(r["__l"]))
    data = np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WINDOW)
    return train(data, np.array(labels, dtype=np.int64), names, how)


def predicted(model: Model, text: Column) -> Column:
    """Struct ``lang_pred, score``: the likeliest language and its pooled probability.

    Null texts, texts without a letter, and a model that has learnt no language give ``und`` and 0.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), 512):
            raw = [(t.as_py() or "").encode("utf-8") for t in texts[at : at + 512]]
            chances = probabilities(model, raw)
            best = chances.argmax(axis=1)
            langs += [model.langs[b] for b in best]
            scores += chances[np.arange(len(best)), best].tolist()
        return pa.StructArray.from_arrays([pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=["lang_pred", "score"])

    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.langs:
        return unknown
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), run(text)).otherwise(unknown)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input with ``lang_pred`` and ``score``; columns of those names are replaced."""
    return docs.withColumn("__lang", predicted(model, F.col(text))).withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")
