"""Scorers made of layers: forward and backward passes in Arrow batches, importances by three rules, and training in rounds.

A network is a list of layers over one example, an array (length, channels) of any length:
convolutions without padding, rectifiers, the mean over the length, dense layers. Weights are a
dimension that each task gets; examples stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.sequences import shuffled_codes

BASES = np.full(256, -1)
BASES[list(b"ACGT")] = range(4)


def base_codes(sequence: str) -> np.ndarray:
    """0 to 3 for A, C, G and T, -1 for what isn't one of them."""
    return BASES[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]


def one_hot(sequence: str) -> np.ndarray:
    """(length, 4); a base that isn't one of ACGT is a row of zeros."""
    places = base_codes(sequence)
    out = np.zeros((len(places), 4))
    known = np.flatnonzero(places >= 0)
    out[known, places[known]] = 1
    return out


def one_place(values: object) -> np.ndarray:
    """(1, values): an array column as an example of length one."""
    return np.asarray(values, float)[None, :]


@dataclass
class Conv:
    """Filters (filters, width, channels) over every place that has room for them."""

    weights: np.ndarray
    bias: np.ndarray
    linear = True

    def parameters(self) -> list[np.ndarray]:
        return [self.weights, self.bias]

    def windows(self, x: np.ndarray) -> np.ndarray:
        width = self.weights.shape[1]
        if len(x) < width:
            return np.zeros((0, width * x.shape[1]))
        cut = np.lib.stride_tricks.sliding_window_view(x, width, axis=0)  # place, channel, offset
        return cut.transpose(0, 2, 1).reshape(len(cut), -1)

    def shares(self, codes: np.ndarray) -> list[np.ndarray]:
        """What each offset's base adds to the filters at each place (behind the end are no bases): weights looked up by codes, filter after filter in memory."""
        tables = np.pad(self.weights, ((0, 0), (0, 0), (0, 1)))  # code -1 adds nothing
        codes = np.pad(codes, (0, tables.shape[1] - 1), constant_values=-1)
        n = len(codes) - tables.shape[1] + 1
        out = np.empty((tables.shape[1], len(tables), n))
        for k in range(tables.shape[1]):
            for f, table in enumerate(tables[:, k]):
                out[k, f] = table[codes[k : k + n]]
        return [share.T for share in out]

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.windows(x) @ self.weights.reshape(len(self.weights), -1).T + self.bias

    def backward(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for k in range(self.weights.shape[1]):
            out[k : k + len(g)] += g @ self.weights[:, k, :]
        return out

    def gradients(self, x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        return [(g.T @ self.windows(x)).reshape(self.weights.shape), g.sum(axis=0)]


@dataclass
class Dense:
    """Weights (outputs, inputs) of a vector."""

    weights: np.ndarray
    bias: np.ndarray
    linear = True

    def parameters(self) -> list[np.ndarray]:
        return [self.weights, self.bias]

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self.weights @ x + self.bias

    def backward(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return g @ self.weights

    def gradients(self, x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        return [np.outer(g, x), g]


@dataclass
class Relu:
    linear = False

    def parameters(self) -> list[np.ndarray]:
        return []

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x, 0)

    def backward(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return g * (x > 0)

    def gradients(self, x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        return []


@dataclass
class Mean:
    """Over the length; zeros if there is no place."""

    linear = True

    def parameters(self) -> list[np.ndarray]:
        return []

    def forward(self, x: np.ndarray) -> np.ndarray:
        return x.sum(axis=0) / max(len(x), 1)

    def backward(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.broadcast_to(g / max(len(x), 1), x.shape)

    def gradients(self, x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        return []


Network = list


def activations(network: Network, x: np.ndarray) -> list[np.ndarray]:
    """The input and what each layer makes of it."""
    out = [x]
    for layer in network:
        out.append(layer.forward(out[-1]))
    return out


def gradient(network: Network, seen: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """Of ``seed`` times the output, by the input."""
    for layer, x in zip(reversed(network), reversed(seen[:-1]), strict=True):
        seed = layer.backward(x, seed)
    return seed


#: Below this difference from the reference a rectifier's multiplier is its gradient.
SMALL = 1e-8


def quotients(layer: Relu, x: np.ndarray, y: np.ndarray, x0: np.ndarray, y0: np.ndarray, g: np.ndarray) -> np.ndarray:
    """``g`` times the difference of what a layer makes, per difference of what it is given."""
    dx = x - x0
    small = np.abs(dx) < SMALL
    np.copyto(dx, 1, where=small)
    out = g * (y - y0) / dx
    np.copyto(out, layer.backward(x, g), where=small)
    return out


def multipliers(network: Network, seen: list[np.ndarray], reference: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """What the output's difference from that of a reference is per difference of the input: a rectifier has its quotient of differences, other layers are linear."""
    pairs = zip(network, seen[:-1], seen[1:], reference[:-1], reference[1:], strict=True)
    for layer, x, y, x0, y0 in reversed(list(pairs)):
        seed = layer.backward(x, seed) if layer.linear else quotients(layer, x, y, x0, y0, seed)
    return seed


def importances_of(network: Network, x: np.ndarray, task: int, rule: str, references: list[np.ndarray], steps: int) -> tuple[float, np.ndarray]:
    """The output and an importance for each entry of ``x``: gradient times input, multipliers times the difference from each reference (their mean), or the mean gradient along the way from zeros times input."""
    seen = activations(network, x)
    seed = np.eye(len(seen[-1]))[task]
    if rule == "gradient":
        return float(seen[-1][task]), x * gradient(network, seen, seed)
    if rule == "path":
        ways = (activations(network, x * k / steps) for k in range(1, steps + 1))
        return float(seen[-1][task]), x * sum(gradient(network, way, seed) for way in ways) / steps
    if rule == "multipliers":
        parts = [(x - r) * multipliers(network, seen, activations(network, r), seed) for r in references]
        return float(seen[-1][task]), sum(parts) / max(len(parts), 1) if parts else np.zeros_like(x)
    raise ValueError(f"no rule {rule}")


class Line:
    """Sequences laid one behind the other, so that a layer is one pass over all of them.

    ``codes`` are those of their bases, an empty sequence has one place of no base. Each layer before the mean leaves
    its values in its sequence's places; windows that reach into the next sequence have values too, which
    the mean takes as zeros, and no gradient comes back to them.
    """

    def __init__(self, network: Network, codes: list[np.ndarray]):
        self.sizes = np.array([max(len(c), 1) for c in codes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lengths = np.array([len(c) for c in codes])
        self.codes = self.laid(codes)
        cut = next(i for i, layer in enumerate(network) if isinstance(layer, Mean))
        self.before, self.after = network[:cut], network[cut + 1 :]
        lost = sum(layer.weights.shape[1] - 1 for layer in self.before if isinstance(layer, Conv))
        self.counts = np.maximum(self.lengths - lost, 0)
        self.divisors = np.maximum(self.counts, 1)[:, None]
        over = self.sizes - self.counts
        self.beyond = np.repeat(self.starts + self.counts - np.cumsum(over) + over, over) + np.arange(over.sum())

    def laid(self, codes: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([c if len(c) else BASES[:1] for c in codes])

    def activations(self, x: np.ndarray, done: int = 0) -> list[np.ndarray]:
        """The values that ``done`` layers have made (``x``, which may be changed) and those that each later layer makes of them."""
        out = [x]
        for layer in self.before[done:]:
            y = layer.forward(out[-1])
            out.append(y if len(y) == len(x) else np.pad(y, ((0, len(x) - len(y)), (0, 0))))
        out[-1][self.beyond] = 0
        out.append(np.stack([np.add.reduceat(column, self.starts) for column in out[-1].T], axis=1) / self.divisors)
        for layer in self.after:
            out.append(out[-1] @ layer.weights.T + layer.bias if isinstance(layer, Dense) else layer.forward(out[-1]))
        return out

    def back(self, seen: list[np.ndarray], seed: np.ndarray, reference: list[np.ndarray] | None = None) -> np.ndarray:
        """The gradient of ``seed`` times the outputs by the first of the values ``seen``, or the multipliers against those of a reference."""
        at = len(seen) - 1 - len(self.after)  # that of the means

        def through(layers: list, at: int, g: np.ndarray) -> np.ndarray:
            for k in range(len(layers) - 1, -1, -1):
                layer, x = layers[k], seen[at + k]
                if isinstance(layer, Conv):
                    g = g[: max(len(x) - layer.weights.shape[1] + 1, 0)]
                g = layer.backward(x, g) if reference is None or layer.linear else quotients(layer, x, seen[at + k + 1], reference[at + k], reference[at + k + 1], g)
            return g

        g = through(self.after, at, np.broadcast_to(seed, seen[-1].shape)) / self.divisors
        g = np.repeat(g.T, self.sizes, axis=1).T
        g[self.beyond] = 0
        return through(self.before[len(self.before) - at + 1 :], 0, g)


def importances_by_base(network: Network, codes: list[np.ndarray], task: int, rules: list[str], references: list[list[np.ndarray]], steps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """``importances_of`` whole sequences of base codes: the outputs and, for each rule, one array with the sum over the four bases at each place of the sequences, one behind the other.

    The network is filters and rectifiers, the mean, and what goes on from it. What its first layer makes of a base is
    looked up, once for all rules. ``references`` has those of each sequence, of its length (else ValueError).
    """
    if any(len(r) != len(c) for c, some in zip(codes, references, strict=True) for r in some):
        raise ValueError("references are not as long as their sequences")
    line = Line(network, codes)
    first = line.before[0] if line.before and isinstance(line.before[0], Conv) else Conv(np.eye(4)[:, None, :], np.zeros(4))
    done = int(bool(line.before) and first is line.before[0])

    def dealt(g: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(line.codes))
        for k, share in enumerate(shares):
            out[k:] += (g * share).sum(axis=1)[: max(len(out) - k, 0)]
        return out

    shares = first.shares(line.codes)
    plain = sum(shares[1:], shares[0])
    seen = line.activations(plain + first.bias, done)
    seed = np.eye(seen[-1].shape[1])[task]

    def found(rule: str) -> np.ndarray:
        if rule == "gradient":
            return dealt(line.back(seen, seed), shares)
        if rule == "path":
            g = line.back(seen, seed)  # where the way ends
            for k in range(1, steps):
                g = g + line.back(line.activations(plain * (k / steps) + first.bias, done), seed)
            return dealt(g / steps, shares)
        if rule == "multipliers":
            out = np.zeros(len(line.codes))
            numbers = np.array([len(some) for some in references])
            for k in range(max(numbers, default=0)):  # a sequence without a k-th reference is its own: no difference
                theirs = first.shares(line.laid([some[k] if k < len(some) else c for c, some in zip(codes, references, strict=True)]))
                reference = line.activations(sum(theirs[1:], theirs[0]) + first.bias, done)
                out += dealt(line.back(seen, seed, reference), [x - r for x, r in zip(shares, theirs, strict=True)])
            return out / np.repeat(np.maximum(numbers, 1), line.sizes)
        raise ValueError(f"no rule {rule}")

    held = np.repeat(line.lengths > 0, line.sizes)
    return seen[-1][:, task], [found(rule)[held] for rule in rules]


#: Bases of the sequences that go through a network at once; a longer sequence goes alone.
TOGETHER = 1 << 15


def keep_memory() -> None:
    """Once a large array has been freed, glibc keeps what smaller ones free for the next ones. It would give it back after each of them, and new pages took half of the time."""
    np.empty(31 << 20, np.uint8)


def together(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbours of TOGETHER bases at most; an empty sequence counts as one."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and total + max(n, 1) > TOGETHER:
            yield at, i - at
            at, total = i, 0
        total += max(n, 1)
    if lengths:
        yield at, len(lengths) - at


def with_importances(df: DataFrame, network: Network, seq: str, rule: str = "gradient", task: int = 0, references: str | None = None, steps: int = 20, logit: str = "logit", out: str = "importances") -> DataFrame:
    """Add the network's output for ``task`` and, for each base of the whole sequence, the importance of what stands there (of all four bases for multipliers, whose references differ).

    ``references``: a column with an array of sequences of the same length, for multipliers;
    none of them give zeros. A null sequence counts as empty and has no importances.
    """
    held = df.sparkSession.sparkContext.broadcast(network)
    df = df.drop(logit, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        # A few sequences at a time: their importances are eight times as large as they are.
        for whole in batches:
            texts = whole.column(seq).to_pylist()
            for a, n in together([len(t or "") for t in texts]):
                batch = whole.slice(a, n)
                given = batch.column(references).to_pylist() if references else [None] * n
                codes = [base_codes(t or "") for t in texts[a : a + n]]
                values, (found,) = importances_by_base(held.value, codes, task, [rule], [[base_codes(r or "") for r in some or []] for some in given], steps)
                offsets = np.cumsum([0, *map(len, codes)])
                new = [pa.array(values, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, logit, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(logit, DoubleType()), StructField(out, ArrayType(DoubleType()))]))


def importance_totals(df: DataFrame, network: Network, seq: str, rules: dict[str, str], task: int = 0, shuffles: str | None = None, steps: int = 20, logit: str = "logit") -> DataFrame:
    """The other columns, the network's output for ``task`` and, for each of ``rules`` (column: rule), the sum of the importances of the whole sequence's bases.

    A sequence travels once, for all rules; the importances stay in the task. ``shuffles``: a column with an array of keys (with
    their seeds), the references of multipliers are the sequence's block shuffles by them. A null sequence counts as empty.
    """
    held = df.sparkSession.sparkContext.broadcast(network)
    rest = [f for f in df.schema.fields if f.name not in (seq, shuffles, logit, *rules)]
    columns = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for whole in batches:
            texts = whole.column(seq).to_pylist()
            keys = whole.column(shuffles).to_pylist() if shuffles else [None] * len(texts)
            parts = []
            for a, n in together([len(t or "") for t in texts]):
                codes = [base_codes(t or "") for t in texts[a : a + n]]
                references = [[] for _ in codes]
                for k in range(max((len(some or []) for some in keys[a : a + n]), default=0)):
                    those = [i for i, some in enumerate(keys[a : a + n]) if k < len(some or [])]
                    for i, c in zip(those, shuffled_codes([codes[i] for i in those], [keys[a + i][k] for i in those]), strict=True):
                        references[i].append(c)
                values, found = importances_by_base(held.value, codes, task, list(rules.values()), references, steps)
                ends = np.cumsum([len(c) for c in codes])
                parts.append([values, *[np.array([f[e - len(c) : e].sum() for c, e in zip(codes, ends, strict=True)]) for f in found]])
            new = [pa.array(np.concatenate(some), pa.float64()) for some in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*[whole.column(c) for c in columns], *new], names=[*columns, logit, *rules])

    return df.mapInArrow(run, StructType([*rest, *[StructField(c, DoubleType()) for c in (logit, *rules)]]))


def task_weights(df: DataFrame, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(task weights, class weights): positives over negatives, and negatives over positives, of each label column; null labels don't count."""
    sums = df.agg(*[F.sum(F.col(c).cast("double")).alias(f"p{i}") for i, c in enumerate(labels)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(labels)]).first()
    p = np.array([sums[f"p{i}"] or 0.0 for i in range(len(labels))])
    n = np.array([sums[f"n{i}"] for i in range(len(labels))]) - p
    return np.divide(p, n, out=np.ones_like(p), where=n > 0), np.divide(n, p, out=np.ones_like(p), where=p > 0)


@dataclass
class Loss:
    """Cross entropy of sigmoids, or squared error. ``positive`` weighs the positives of each task, ``task`` the tasks: class-weighted with the first, positives-focused with both."""

    kind: str = "cross-entropy"
    positive: np.ndarray | None = None
    task: np.ndarray | None = None

    def of(self, logits: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss of an example and its gradient by the logits; tasks without a label (nan) don't count."""
        known = ~np.isnan(y)
        y, weight = np.where(known, y, 0), known * (1.0 if self.task is None else self.task)
        if self.kind == "squared":
            return float((weight * (logits - y) ** 2).sum()), 2 * weight * (logits - y)
        positive = 1.0 if self.positive is None else self.positive
        p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
        loss = positive * y * np.logaddexp(0, -logits) + (1 - y) * np.logaddexp(0, logits)
        return float((weight * loss).sum()), weight * ((1 - y) * p - positive * y * (1 - p))


def summed(df: DataFrame, network: Network, make: Callable[[object], np.ndarray], features: str, labels: list[str], loss: Loss, with_gradients: bool = True) -> tuple[float, int, np.ndarray]:
    """Loss, number of rows and gradient by all parameters (laid end to end), summed over ``df``: one aggregation of fixed size."""
    size = sum(p.size for layer in network for p in layer.parameters())
    held = df.sparkSession.sparkContext.broadcast((network, loss))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layers, by = held.value
        out = np.zeros(size + 2)
        for pdf in batches:
            y = pdf[labels].to_numpy(float)
            for i, value in enumerate(pdf["x"]):
                seen = activations(layers, make(value))
                here, g = by.of(seen[-1], y[i])
                out[:2] += here, 1
                if with_gradients:
                    parts = []
                    for layer, x in zip(reversed(layers), reversed(seen[:-1]), strict=True):
                        parts[:0] = layer.gradients(x, g)
                        g = layer.backward(x, g)
                    out[2:] += np.concatenate([p.ravel() for p in parts]) if parts else 0
        some = np.flatnonzero(out)
        yield pd.DataFrame({"place": some, "value": out[some]})

    rows = df.select(F.col(features).alias("x"), *[F.col(c).cast("double").alias(c) for c in labels]).where("x IS NOT NULL")
    out = np.zeros(size + 2)
    for r in rows.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # as many rows as parameters, and two
        out[r.place] = r.value
    held.destroy()
    return float(out[0]), int(out[1]), out[2:]


def flattened(network: Network) -> np.ndarray:
    parts = [p.ravel() for layer in network for p in layer.parameters()]
    return np.concatenate(parts) if parts else np.zeros(0)


def filled(network: Network, flat: np.ndarray) -> Network:
    """The network with other parameters, taken from one long row."""
    at, out = 0, []
    for layer in network:
        parts = []
        for p in layer.parameters():
            parts.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        out.append(type(layer)(*parts))
    return out


@dataclass
class State:
    """Where training stands: enough to go on after a stop."""

    flat: np.ndarray
    mean_square: np.ndarray
    best: np.ndarray
    best_loss: float = float("inf")
    best_round: int = -1
    rounds: int = 0
    losses: list[float] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.flat.tolist(), self.mean_square.tolist(), self.best.tolist(), self.best_loss, self.best_round, self.rounds, self.losses)
        schema = "flat array<double>, mean_square array<double>, best array<double>, best_loss double, best_round int, rounds int, losses array<double>"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/round={self.rounds:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        """The last whole state below a path."""
        r = spark.read.parquet(path).orderBy(F.col("rounds").desc()).first()
        return cls(np.array(r.flat), np.array(r.mean_square), np.array(r.best), r.best_loss, r.best_round, r.rounds, list(r.losses))


def trained(
    train: DataFrame, valid: DataFrame, network: Network, make: Callable[[object], np.ndarray], features: str, labels: list[str],
    loss: Loss | None = None, rounds: int = 30, patience: int = 3, rate: float = 0.002, decay: float = 0.98, state: State | None = None, path: str | None = None,
) -> tuple[Network, State]:
    """The network with the parameters of the least mean loss on ``valid``, and where training stands.

    A round sums loss and gradients over all of ``train``, takes one step scaled by the
    running mean square of each gradient, and measures ``valid``. It stops after ``rounds``
    in all or ``patience`` without a lesser loss. ``state`` (of an earlier call, or State.load) goes
    on from there, with ``path`` each round's state is a table below it. A weight kept by
    ``network`` alone (no state) is a warm start. Rows with null features don't count.
    """
    spark, loss = train.sparkSession, loss or Loss()
    if state is None:
        flat = flattened(network)
        state = State(flat, np.ones_like(flat), flat.copy())
    while state.rounds < rounds and state.rounds - 1 - state.best_round < patience:
        _, n, g = summed(train, filled(network, state.flat), make, features, labels, loss)
        g = g / max(n, 1)
        mean_square = decay * state.mean_square + (1 - decay) * g**2
        flat = state.flat - rate * g / np.sqrt(mean_square + 1e-10)
        total, n, _ = summed(valid, filled(network, flat), make, features, labels, loss, with_gradients=False)
        now = total / max(n, 1)
        better = now < state.best_loss
        state = State(flat, mean_square, flat if better else state.best, now if better else state.best_loss, state.rounds if better else state.best_round, state.rounds + 1, [*state.losses, now])
        if path is not None:
            state.save(spark, path)
    return filled(network, state.best), state
