"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words. A word comes in as the embedding of the word
and the mean embedding of its character n-grams, so spellings not seen in training still
say something. A gated recurrent network reads each window in both directions, attention
weighs its words, and a logistic unit scores it. The highest score of all windows of a text
is calibrated to a probability. The network is written and trained in numpy, on a bounded
sample of labelled rows; scoring runs in Arrow batches over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import (
    byte_class,
    mix,
    span_hashes,
    text_blocks,
    text_bytes,
    whole_text,
    word_spans,
)

#: Words of a window, and words from the start of one to the start of the next.
WINDOW, STRIDE = 64, 48
#: Labelled rows per class that are sampled to train on, and bytes of the longest of them.
SAMPLE, SAMPLE_BYTES = 1500, 1 << 15
#: Rows of the embedding tables, their width, and units of each direction.
BUCKETS, WIDTH, UNITS = 1 << 14, 8, 8
#: Lengths of character n-grams, in bytes, word boundaries included.
GRAMS = (3, 5)
EPOCHS, BATCH, RATE = 5, 128, 0.01
#: Share of the training texts whose words are misspelt, and of the windows whose words are
#: known by their n-grams alone, so that spellings that were not seen say something.
MISSPELT, NAMELESS = 0.3, 0.5
#: Texts of each label that are needed to learn, or to calibrate, at all.
LEAST = 20
#: Steps that a small sample is trained for, over at most so many epochs.
STEPS, MOST_EPOCHS = 150, 40
_WORD = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


# -- inputs --------------------------------------------------------------------------


class Words:
    """Words of a column of lower-case texts: embedding rows of each and of its n-grams.

    Row ``i`` has the words ``first[i]:first[i + 1]``, word ``w`` the n-grams
    ``begin[w]:begin[w + 1]``.
    """

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        """The words of many texts, taken in parts, as the way there needs much memory."""
        parts, part, held = [], [], 0
        for text in [*texts, None]:
            if part and (text is None or held > 1 << 19):
                parts.append(cls(pa.array(part, pa.string())))
                part, held = [], 0
            if text is not None:
                part.append(text)
                held += len(text)
        whole = cls(pa.array([], pa.string()))
        if parts:
            whole.word = np.concatenate([p.word for p in parts])
            whole.grams = [np.concatenate(g) for g in zip(*(p.grams for p in parts))]
            whole.first = _chained([p.first for p in parts])
            whole.begin = _chained([p.begin for p in parts])
        return whole

    def part(self, low: int, high: int) -> Words:
        """The words of rows ``low`` to ``high``, that one left out."""
        a, b = self.first[low], self.first[high]
        part = object.__new__(Words)
        part.word, part.first = self.word[a:b], self.first[low : high + 1] - a
        part.begin = self.begin[a : b + 1] - self.begin[a]
        part.grams = [g[self.begin[a] : self.begin[b]] for g in self.grams]
        return part

    def parts(self) -> Iterator[tuple[int, Words]]:
        """Parts of some ten thousand words, or one longer row, each with its first row."""
        low = 0
        while low < len(self.first) - 1:
            high = int(np.searchsorted(self.first, self.first[low] + 50_000, side="right")) - 1
            high = min(max(high, low + 1), len(self.first) - 1)
            yield low, self.part(low, high)
            low = high

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        starts, ends, self.first = word_spans(data, offsets, _WORD)
        self.word = (span_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int32)
        # every byte of a word, and the separator before it, begins an n-gram
        inside = np.where(_WORD[data], data, 0).astype(np.uint64)
        padded = np.concatenate([np.zeros(1, np.uint64), inside, np.zeros(max(GRAMS), np.uint64)])
        spans = ends - starts + 1
        self.begin = np.concatenate([[0], np.cumsum(spans)])
        at = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1] - starts, spans)
        last = np.repeat(ends, spans) + 1  # in padded positions, the separator behind
        self.grams = []
        with np.errstate(over="ignore"):
            for n in GRAMS:
                value = np.full(len(at), n, np.uint64)
                for k in range(n):
                    c = np.where(at + k <= last, padded[np.minimum(at + k, len(padded) - 1)], 0)
                    c = np.where((k == 0) & (at == np.repeat(starts, spans)), 0, c)
                    value = value * np.uint64(0x100000001B3) ^ c.astype(np.uint64)
                self.grams.append((mix(value) % np.uint64(BUCKETS)).astype(np.int16))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and number of words of every window, and the row it belongs to."""
        counts = np.diff(self.first)
        number = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
        row = np.repeat(np.arange(len(counts)), number)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start = self.first[:-1][row] + nth * STRIDE
        return start, np.minimum(self.first[1:][row] - start, WINDOW), row


def _chained(offsets: list[np.ndarray]) -> np.ndarray:
    """Offsets of lists that are put one behind the other."""
    ends = np.cumsum([0, *(o[-1] for o in offsets)])
    return np.concatenate([[0], *(o[1:] + end for o, end in zip(offsets, ends))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# -- the network ---------------------------------------------------------------------


class Network:
    """Parameters, scoring, and gradients by backpropagation through time."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "word": draw(BUCKETS, WIDTH, scale=0.1),
            "gram": draw(BUCKETS, WIDTH, scale=0.3),
            "attend": draw(2 * UNITS, 2 * UNITS, scale=0.3),
            "attend_bias": np.zeros(2 * UNITS, np.float32),
            "attend_to": draw(2 * UNITS, scale=0.3),
            "out": draw(2 * UNITS, scale=0.3),
            "out_bias": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.p[f"in_{way}"] = draw(2 * WIDTH, 3 * UNITS, scale=0.3)
            self.p[f"bias_{way}"] = np.zeros(3 * UNITS, np.float32)
            self.p[f"again_{way}"] = draw(UNITS, 3 * UNITS, scale=0.3)
        #: weights of the logistic calibration: highest score, log of windows, constant
        self.calibration = np.array([1.0, 0.0, 0.0])
        self.base_rate = 0.0

    def inputs(self, words: Words) -> np.ndarray:
        """Word embedding and mean n-gram embedding of every word."""
        grams = sum(self.p["gram"][g] for g in words.grams)
        if len(words.word) == 0:
            return np.zeros((0, 2 * WIDTH), np.float32)
        mean = np.add.reduceat(grams, words.begin[:-1], axis=0)
        mean /= (len(GRAMS) * np.diff(words.begin))[:, None]
        return np.concatenate([self.p["word"][words.word], mean], axis=1)

    def read(self, x: np.ndarray, live: np.ndarray, way: str, keep: bool):
        """States of one direction over windows; ``x`` is ``step, window, width``."""
        steps, count = live.shape
        h = np.zeros((count, UNITS), np.float32)
        again = self.p[f"again_{way}"]
        states, kept = np.empty((steps, count, UNITS), np.float32), {}
        fed = x @ self.p[f"in_{way}"] + self.p[f"bias_{way}"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            back = h @ again
            gates = _sigmoid(fed[t, :, : 2 * UNITS] + back[:, : 2 * UNITS])
            update, reset = gates[:, :UNITS], gates[:, UNITS:]
            new = np.tanh(fed[t, :, 2 * UNITS :] + reset * back[:, 2 * UNITS :])
            moved = np.where(live[t, :, None], new + update * (h - new), h)
            if keep:
                kept[t] = (h, gates, new, back[:, 2 * UNITS :])
            h = states[t] = moved
        return states, kept

    def scores(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what their gradients need."""
        f, kept_f = self.read(x, live, "f", keep)
        b, kept_b = self.read(x, live, "b", keep)
        states = np.concatenate([f, b], axis=2)
        hidden = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        weight = np.where(live, hidden @ self.p["attend_to"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight *= live
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logits = pooled @ self.p["out"] + self.p["out_bias"]
        return (logits, (states, hidden, weight, pooled, kept_f, kept_b)) if keep else logits

    def gradients(self, x: np.ndarray, live: np.ndarray, labels: np.ndarray):
        """Gradients of the mean log loss by parameter, and by input."""
        p, g = self.p, {}
        logits, (states, hidden, weight, pooled, kept_f, kept_b) = self.scores(x, live, True)
        slope = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        g["out"], g["out_bias"] = pooled.T @ slope, slope.sum(keepdims=True)
        d_pooled = slope[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["attend_to"] = np.einsum("tn,tnk->k", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["attend_to"] * (1 - hidden**2)
        g["attend"] = np.einsum("tni,tnj->ij", states, d_hidden)
        g["attend_bias"] = d_hidden.sum((0, 1))
        d_states += d_hidden @ p["attend"].T
        d_x = np.zeros_like(x)
        for way, kept, part in (("f", kept_f, slice(0, UNITS)), ("b", kept_b, slice(UNITS, None))):
            again, inner = p[f"again_{way}"], p[f"in_{way}"]
            g_again, d_fed = np.zeros_like(again), np.zeros((*live.shape, 3 * UNITS), np.float32)
            d_h = np.zeros((live.shape[1], UNITS), np.float32)
            steps = range(live.shape[0])
            for t in reversed(steps) if way == "f" else steps:
                before, gates, new, back_new = kept[t]
                update, reset = gates[:, :UNITS], gates[:, UNITS:]
                d_all = d_h + d_states[t][:, part]
                d_on = d_all * live[t, :, None]
                d_new = d_on * (1 - update) * (1 - new**2)
                d_back = np.concatenate(
                    [
                        d_on * (before - new) * update * (1 - update),
                        d_new * back_new * reset * (1 - reset),
                        d_new * reset,
                    ],
                    axis=1,
                )
                d_fed[t, :, : 2 * UNITS] = d_back[:, : 2 * UNITS]
                d_fed[t, :, 2 * UNITS :] = d_new
                g_again += before.T @ d_back
                d_h = d_all - d_on + d_on * update + d_back @ again.T
            flat = d_fed.reshape(-1, 3 * UNITS)
            g[f"again_{way}"] = g_again
            g[f"in_{way}"] = x.reshape(-1, x.shape[2]).T @ flat
            g[f"bias_{way}"] = flat.sum(0)
            d_x += d_fed @ inner.T
        return g, d_x

    def window_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, and the row of each."""
        found, rows = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        for low, part in words.parts():
            start, size, row = part.windows()
            if len(row):
                found.append(self.scores(*_cut(self.inputs(part), start, size)))
                rows.append(row + low)
        return np.concatenate(found), np.concatenate(rows)

    def highest(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit of every row, and its number of windows (0: no words)."""
        logits, row = self.window_scores(words)
        rows = len(words.first) - 1
        best = np.full(rows, -np.inf)
        np.maximum.at(best, row, logits)
        return best, np.bincount(row, minlength=rows)

    def probabilities(self, words: Words) -> np.ndarray:
        best, windows = self.highest(words)
        a, b, c = self.calibration
        seen = np.where(windows > 0, best, 0.0)
        calibrated = _sigmoid(a * seen + b * np.log1p(windows) + c)
        return np.where(windows > 0, calibrated, self.base_rate)


def _cut(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of windows as ``step, window, width``, and which of them are words."""
    steps = np.arange(int(size.max()))[:, None]
    live = steps < size
    return x[np.minimum(start + steps, len(x) - 1)], live


# -- training ------------------------------------------------------------------------


class _Adam:
    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.t = 0

    def step(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.p[k] -= rate * m / (np.sqrt(v) + 1e-8)


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by row."""
    columns = [np.bincount(rows, values[:, k], size) for k in range(values.shape[1])]
    return np.stack(columns, axis=1).astype(np.float32)


def _input_gradients(words: Words, wanted: np.ndarray, d_word: np.ndarray):
    """Gradients of both embedding tables from those of the inputs of ``wanted`` words."""
    table = _scatter(words.word[wanted], d_word[:, :WIDTH], BUCKETS)
    spans = np.diff(words.begin)[wanted]
    share = d_word[:, WIDTH:] / (len(GRAMS) * spans)[:, None]
    ends = np.cumsum(spans)
    at = np.arange(ends[-1]) - np.repeat(ends - spans - words.begin[:-1][wanted], spans)
    share = np.repeat(share, spans, axis=0)
    grams = sum(_scatter(g[at], share, BUCKETS) for g in words.grams)
    return table, grams


_LOOKS = {"a": "4@", "e": "3", "i": "1!", "o": "0", "s": "5$", "t": "7", "b": "8", "l": "1"}


def misspelt(word: str, rng: np.random.Generator) -> str:
    """``word`` with one change: letters swapped, doubled, left out, replaced, or an ending."""
    if len(word) < 4:
        return word
    at, way = int(rng.integers(1, len(word) - 1)), int(rng.integers(6))
    if way == 0:
        return word[:at] + word[at + 1] + word[at] + word[at + 2 :]
    if way == 1:
        return word[:at] + word[at] + word[at:]
    if way == 2:
        return word[:at] + word[at + 1 :]
    if way == 3:
        return word[:at] + "*" + word[at + 1 :]
    if way == 4:
        return word + ("s", "ed", "er", "ing", "ly")[int(rng.integers(5))]
    looks = [_LOOKS.get(c, c) for c in word]
    return "".join(x[int(rng.integers(len(x)))] for x in looks)


def _misspelt_some(texts: list[str], rng: np.random.Generator) -> list[str]:
    """``texts``, of which a share has each word misspelt, whatever its label."""
    return [
        " ".join(misspelt(w, rng) for w in text.split(" ")) if rng.random() < MISSPELT else text
        for text in texts
    ]


def train(texts: list[str], labels: np.ndarray, base_rate: float, seed: int = 7) -> Network:
    """A network trained on lower-case texts and their 0/1 labels.

    With fewer than ``LEAST`` texts of a label nothing is learned and every score is the base
    rate. Four fifths of the texts train it, the rest calibrates, or all if it is too few. In the first epoch every window
    has the label of its text; later those windows count that scored highest, since a text is
    judged by its highest window and not every part of a toxic text need be toxic.
    """
    network = Network(seed)
    network.base_rate = float(base_rate)
    network.calibration = np.array([0.0, 0.0, np.log((base_rate + 1e-6) / (1 - base_rate + 1e-6))])
    if min((labels == 0).sum(), (labels == 1).sum()) < LEAST:
        return network
    held = np.arange(len(texts)) % 5 == 0
    rng, adam = np.random.default_rng(seed), _Adam(network.p)
    words = Words.of(_misspelt_some([t for t, h in zip(texts, held) if not h], rng))
    own = labels[~held]
    start, size, row = words.windows()
    used = np.arange(len(row))
    later = max(1, len(row) // (3 * BATCH))  # steps of an epoch after the first
    epochs = min(MOST_EPOCHS, max(EPOCHS, STEPS // later))
    for epoch in range(epochs):
        if epoch:
            used = _telling(network, words)
        rng.shuffle(used)
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(used), BATCH):
            batch = used[i : i + BATCH]
            named = rng.random(len(batch)) >= NAMELESS
            _learn(network, adam, words, start[batch], size[batch], own[row[batch]], rate, named)
    if min((labels[held] == 0).sum(), (labels[held] == 1).sum()) < LEAST:
        held[:] = True  # too few to calibrate on alone
    rest = Words.of([t for t, h in zip(texts, held) if h])
    network.calibration = _calibrate(network, rest, labels[held], base_rate)
    return network


def _telling(network: Network, words: Words) -> np.ndarray:
    """The highest third of the windows of every text."""
    logits, row = network.window_scores(words)
    order = np.lexsort([-logits, row])
    count = np.bincount(row)
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row)) - (np.cumsum(count) - count)[row[order]]
    return np.flatnonzero(rank * 3 <= count[row])


def _learn(network, adam, words, start, size, labels, rate, named) -> None:
    """One step; the words of windows that are not ``named`` have no embedding of their own."""
    steps = np.arange(int(size.max()))[:, None]
    live = steps < size
    at = np.where(live, start + steps, start)
    wanted, place = np.unique(at, return_inverse=True)
    grams_at = words.begin[:-1][wanted]
    spans = np.diff(words.begin)[wanted]
    ends = np.cumsum(spans)
    index = np.arange(ends[-1]) - np.repeat(ends - spans - grams_at, spans)
    total = sum(network.p["gram"][g[index]] for g in words.grams)
    mean = np.add.reduceat(total, ends - spans, axis=0) / (len(GRAMS) * spans)[:, None]
    x = np.concatenate([network.p["word"][words.word[wanted]], mean], axis=1).astype(np.float32)
    place = place.reshape(at.shape)
    fed = x[place]
    fed[:, ~named, :WIDTH] = 0
    gradients, d_x = network.gradients(fed, live, labels)
    d_x[:, ~named, :WIDTH] = 0
    d_word = _scatter(place.ravel(), d_x.reshape(-1, 2 * WIDTH), len(wanted))
    gradients["word"], gradients["gram"] = _input_gradients(words, wanted, d_word)
    adam.step(gradients, rate)


def _calibrate(network, words, labels, base_rate: float) -> np.ndarray:
    """Logistic weights of the highest score and the log of windows, by Newton's method.

    The sample is balanced by class; rows are weighted back to the base rate.
    """
    best, windows = network.highest(words)
    ok = windows > 0
    x = np.stack([best[ok], np.log1p(windows[ok]), np.ones(ok.sum())], axis=1)
    y = labels[ok]
    share = y.mean() if len(y) else 0.5
    if not 0 < share < 1:
        return np.array([1.0, 0.0, 0.0])
    weight = np.where(y == 1, base_rate / share, (1 - base_rate) / (1 - share))
    beta, ridge = np.zeros(3), np.diag([0.05, 0.5, 1e-3])
    for _ in range(30):
        q = _sigmoid(x @ beta)
        slope = x.T @ (weight * (q - y)) + ridge @ beta
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


# -- over tables ---------------------------------------------------------------------


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(key.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` labelled rows of each class, chosen by hash.

    ``docs`` has ``doc_id, text``, ``labels`` has ``doc_id, toxic``. Rows that are held out
    or not labelled, and texts of more than ``SAMPLE_BYTES``, are not learned from. If a row
    has several labels or texts, the largest label and the smallest text count. Without
    labels of both classes, scores are the base rate.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base_rate = counts.get(1, 0) / max(sum(counts.values()), 1)
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.join(F.broadcast(chosen), "doc_id")  # at most two samples
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .select("doc_id", "toxic", F.lower("text").alias("text"))
        .collect()
    )
    texts = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]), reverse=True):
        texts[r["doc_id"]] = (r["text"], r["toxic"])
    order = sorted(texts, key=lambda d: (mix(np.array([d & (2**64 - 1)], np.uint64))[0], d))
    found = [texts[d] for d in order]
    return train([t for t, _ in found], np.array([y for _, y in found], np.float32), base_rate)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Only ``text`` is read. NULL texts and texts without words get the base rate. All other
    columns are kept; existing ones of the two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)
    columns = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        found = [sent.value.probabilities(Words(b)) for b in text_blocks(texts)]
        return pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    # only texts and scores travel; an expression that may not be repeated is evaluated once
    scored = docs.select(
        *[F.col(c) for c in columns],
        probability.asNondeterministic()(F.lower(whole_text("text"))).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
