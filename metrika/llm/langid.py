"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The whole text is read as UTF-8 bytes, white space, digits and signs included, in windows of SPAN bytes. Within a window the
network carries its state from byte to byte, forwards and backwards, and gives every byte position a distribution over the
languages. A document's distribution pools the log probabilities of all its positions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import text_slices

#: Bytes of a window; windows that are read at once.
SPAN, AT_ONCE = 128, 1024
#: Bounds of the training sample: documents a language (about), characters a document, windows of TRAIN_SPAN bytes a language.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WINDOWS = 300, 20_000, 2000
TRAIN_SPAN, HIDDEN, EPOCHS, LEAST_STEPS, BATCH, RATE = 64, 16, 2, 120, 128, 0.02
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


class Gru:
    """One direction. Gates z, r and candidate c: h' = (1 - z) h + z c, c = tanh(input + (r h) U)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.n = hidden
        self.p = {
            "w": rng.normal(0, 0.1, (256, 3 * hidden)).astype(np.float32),
            "b": np.zeros(3 * hidden, np.float32),
            "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        }

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of bytes x (time, batch), and what back() needs of every step if it is to be kept."""
        n, w, u = self.n, self.p["w"] + self.p["b"], self.p["u"]
        gates, candidate = np.ascontiguousarray(u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])
        h, kept = np.zeros((x.shape[1], n), w.dtype), []
        out = np.empty((*x.shape, n), w.dtype)
        for t in range(len(x)):
            a = w[x[t]]
            g = np.tanh((a[:, : 2 * n] + h @ gates) / 2)
            g += 1
            g /= 2
            z, r = g[:, :n], g[:, n:]
            c = np.tanh(a[:, 2 * n :] + (r * h) @ candidate)
            if keep:
                kept.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out, kept

    def states(self, x: np.ndarray) -> np.ndarray:
        """run() where nothing is kept: each gate apart and in place, so that no array is read with gaps."""
        n, w, u = self.n, self.p["w"] + self.p["b"], self.p["u"]
        of = lambda k, by: tuple(np.ascontiguousarray(p[:, k * n : k * n + n] * p.dtype.type(by)) for p in (w, u))
        (w_z, u_z), (w_r, u_r), (w_c, u_c) = of(0, -1), of(1, -1), of(2, -2)
        out = np.empty((*x.shape, n), w.dtype)
        h = np.zeros(out.shape[1:], w.dtype)
        z, r, c, own = (np.empty_like(h) for _ in range(4))
        with np.errstate(over="ignore"):
            for t, at in enumerate(x.astype(np.intp)):
                for gate, w_in, u_in, state in ((z, w_z, u_z, h), (r, w_r, u_r, h), (c, w_c, u_c, r)):
                    np.take(w_in, at, axis=0, out=gate, mode="clip")
                    gate += np.matmul(state, u_in, out=own)
                    np.exp(gate, out=gate)
                    gate += 1
                    np.divide(2 if gate is c else 1, gate, out=gate)
                    if gate is r:
                        r *= h
                c -= 1
                c -= h
                c *= z
                h = np.add(h, c, out=out[t])
        return out

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time."""
        n, u = self.n, self.p["u"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = dh + d_out[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            drh = dc @ u[:, 2 * n :].T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(g["w"], x[t], da)
            g["u"][:, : 2 * n] += h.T @ da[:, : 2 * n]
            g["u"][:, 2 * n :] += (r * h).T @ dc
            dh = dh - dh * z + drh * r + da[:, : 2 * n] @ u[:, : 2 * n].T
        g["b"] = g["w"].sum(axis=0)
        return g


def windows_of(raws: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (window, span) filled up with zeros, bytes of each window, text of each window) of all whole texts."""
    n = np.array([-(-len(r) // span) for r in raws], np.int64)
    x = np.frombuffer(b"".join(r.ljust(k * span, b"\0") for r, k in zip(raws, n.tolist(), strict=True)), np.uint8).reshape(-1, span)
    size = np.full(len(x), span)
    last = np.cumsum(n)[n > 0] - 1
    size[last] = [(len(r) - 1) % span + 1 for r in raws if r]
    return x, size, np.repeat(np.arange(len(raws)), n)


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.forward, self.backward = labels, Gru(rng, hidden), Gru(rng, hidden)
        self.p = {"v": rng.normal(0, 0.1, (2 * hidden, len(labels))).astype(np.float32), "c": np.zeros(len(labels), np.float32)}

    @staticmethod
    def turned(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes (time, window) from the front, the same from the back of each window, where each position stands from the
        back, and which positions hold a byte. Positions without one come last in both, so no state passes through them."""
        at = np.arange(x.shape[1])[:, None]
        turn = np.where(at < size, size - 1 - at, at)
        x = np.ascontiguousarray(x.T)
        return x, np.take_along_axis(x, turn, axis=0), turn, at < size

    def log_probabilities(self, f: np.ndarray, b: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """(time, window, language) from the states of both directions, b in its own order."""
        n, v = self.forward.n, self.p["v"]
        of = lambda p, x: np.ascontiguousarray(p.T) @ x.reshape(-1, n).T
        place = (turn * turn.shape[1] + np.arange(turn.shape[1])).ravel()
        logit = of(v[:n], f) + np.take(of(v[n:], b), place, axis=1) + self.p["c"][:, None]
        logit -= logit.max(axis=0)
        logit -= np.log(np.exp(logit).sum(axis=0))
        return np.moveaxis(logit.reshape(-1, *turn.shape), 0, 2)

    def sums(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probabilities (window, language), summed over the positions of each window."""
        out = np.zeros((len(x), len(self.labels)))
        for k in range(0, len(x), AT_ONCE):
            x_t, y_t, turn, live = self.turned(x[k : k + AT_ONCE], size[k : k + AT_ONCE])
            logp = self.log_probabilities(self.forward.states(x_t), self.backward.states(y_t), turn)
            out[k : k + AT_ONCE] = (logp * live[:, :, None]).sum(axis=0)
        return out

    def read(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and its pooled probability for every whole text; ties go to the first label."""
        some = [k for k, t in enumerate(texts) if has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        raws = [texts[k].encode() for k in some]
        total = np.zeros((len(raws), len(self.labels)))
        x, size, of = windows_of(raws, SPAN)
        np.add.at(total, of, self.sums(x, size))
        for k, r, s in zip(some, raws, total, strict=True):
            p = np.exp((s - s.max()) / len(r))
            names[k], scores[k] = self.labels[int(p.argmax())], float(p.max() / p.sum())
        return names, scores

    def gradients(self, x: np.ndarray, size: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the cross-entropy of every position, weighted by window, for the parameters in the order of parameters()."""
        x_t, y_t, turn, live = self.turned(x, size)
        (f, kept_f), (b, kept_b) = self.forward.run(x_t, True), self.backward.run(y_t, True)
        d = np.exp(self.log_probabilities(f, b, turn))
        d[:, np.arange(len(x)), labels] -= 1
        d *= (live * weights)[:, :, None].astype(d.dtype)
        back, n, v = np.take_along_axis(d, turn[:, :, None], axis=0), self.forward.n, self.p["v"]
        own = np.concatenate([np.einsum("tbi,tbj->ij", f, d), np.einsum("tbi,tbj->ij", b, back)])
        g_f, g_b = self.forward.back(x_t, kept_f, d @ v[:n].T), self.backward.back(y_t, kept_b, back @ v[n:].T)
        return [own, d.sum(axis=(0, 1)), *(g_f[k] for k in self.forward.p), *(g_b[k] for k in self.backward.p)]

    def parameters(self) -> list[tuple[dict, str]]:
        return [(self.p, k) for k in ("v", "c")] + [(d.p, k) for d in (self.forward, self.backward) for k in d.p]

    def train(self, x: np.ndarray, size: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 8) -> None:
        """Adam on the cross-entropy of every position."""
        rng, params = np.random.default_rng(seed), self.parameters()
        mean, square = [np.zeros_like(o[k]) for o, k in params], [np.zeros_like(o[k]) for o, k in params]
        total, step = max(1, epochs * -(-len(x) // batch)), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for j in range(0, len(order), batch):
                some, step = order[j : j + batch], step + 1
                w = weights[some] / (weights[some] * size[some]).sum()
                lr = rate * min(1, 2 * (1 - (step - 1) / total)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for (o, k), g, m, q in zip(params, self.gradients(x[some], size[some], labels[some], w), mean, square, strict=True):
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    o[k] -= (lr * m / (np.sqrt(q) + 1e-8)).astype(np.float32)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_windows: int = SAMPLE_WINDOWS) -> Network | None:
    """Trains on a bounded sample of the labelled rows that aren't held out; None if there are none.

    About sample_docs rows of every label, chosen by a hash of the id, and of a longer text the sample_chars characters from
    a place chosen by that hash; of their windows of TRAIN_SPAN bytes at most sample_windows a label, at random with a fixed
    seed. The driver gets that sample and the number of rows of each label alone. Null texts and labels, and texts without a
    letter, are left out. An empty table, or one without labels, gives None. Every label weighs the same.
    """
    rows = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter("text is not null and label is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, sample_docs / n))))
    chosen = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.element_at(share, F.col("label")) * (1 << 30)
    begin = F.pmod(F.xxhash64("id", F.lit(4)), F.greatest(F.lit(1), F.char_length("text") - sample_chars + 1)).cast("int")
    piece = rows.filter(chosen).select("label", F.substring("text", begin + 1, F.lit(sample_chars)).alias("text"))
    sample = piece.limit(2 * sample_docs * len(counts)).collect()
    labels = sorted(counts)
    rng, x, size, of = np.random.default_rng(5), [], [], []
    for k, name in enumerate(labels):
        own, n, _ = windows_of(sorted(r["text"].encode() for r in sample if r["label"] == name and has_letter(r["text"])), TRAIN_SPAN)
        some = rng.permutation(len(own))[:sample_windows]
        x, size, of = [*x, own[some]], [*size, n[some]], [*of, np.full(len(some), k)]
    x, size, of = (np.concatenate(v) for v in (x, size, of))
    if not len(x):
        return None
    network = Network(labels)
    weights = 1 / np.bincount(of, size, len(labels))[of]
    network.train(x, size, of, weights, max(EPOCHS, LEAST_STEPS // -(-len(x) // BATCH)))
    return network


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns added, the language and its probability, from the whole text alone; `names` says their names.

    Null texts, and those without a letter, get `und` and score 0; so do all where there was nothing to learn from. Ties go
    to the label that comes first in order. Texts of any length are read a bounded number of windows at a time. Repeated
    rows and null ids pass through, an empty table stays empty, and columns of the two names are replaced. The network's
    size is fixed, and it goes to the tasks with the function.
    """
    rest = [c for c in docs.columns if c not in names]
    k = rest.index(text_col)

    def predict(batches):
        for b in batches:
            at = 0
            for _, texts in text_slices(pa.RecordBatch.from_arrays([b.column(k), pc.fill_null(b.column(k), "")], names=["a", "b"])):
                part = b.slice(at, len(texts))
                at += len(texts)
                found, scores = network.read(texts) if network else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*rest, *names])

    schema = StructType([docs.schema[c] for c in rest]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(predict, schema)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text holds a letter."""
    k = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array([has_letter(t or "") for t in b.column(k).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
