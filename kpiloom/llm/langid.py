"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled windows. At
every byte the network gives a probability of each language; a document's probabilities are the
mean over all its bytes. Activations are piecewise linear, which numpy evaluates fast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import crc_fold, pieces_of
from kpiloom.llm.flat import text_bytes

HIDDEN = 8
WINDOW = 128  # bytes that the state runs over; a text is cut into such windows, none is left out
FIT_WINDOW = 64
LANES = 1024  # windows evaluated side by side
PAD = 256
UNKNOWN = "und"
LETTER = r"\p{L}"  # fixed value: a text without one has no language


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def _run(bytes_: np.ndarray, table: np.ndarray, u: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (time, lane, hidden) of one direction over bytes (time, lane); PAD resets a lane."""
    size = u.shape[0]
    h = np.zeros((bytes_.shape[1], size), np.float32)
    out = np.empty((*bytes_.shape, size), np.float32)
    for t, x in enumerate(bytes_):
        live = (x != PAD).astype(np.float32)[:, None]
        a, b = table[x], h @ u
        gates = _sigmoid(a[:, : 2 * size] + b[:, : 2 * size])
        r, z = gates[:, :size], gates[:, size:]
        n = np.clip(a[:, 2 * size :] + r * b[:, 2 * size :], -1, 1)
        after = (n + z * (h - n)) * live
        if tape is not None:
            tape.append((x, h, b[:, 2 * size :], r, z, n, live))
        h = out[t] = after
    return out


def _back(tape: list, grads: np.ndarray, u: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and of u, given those of the states."""
    size = u.shape[0]
    g_u, seen, given = np.zeros_like(u), [], []
    carry = np.zeros_like(grads[0])
    for t in range(len(tape) - 1, -1, -1):
        x, h, bn, r, z, n, live = tape[t]
        g = (grads[t] + carry) * live
        g_n = g * (1 - z) * (np.abs(n) < 1)
        g_z = g * (h - n) * 0.25 * ((z > 0) & (z < 1))
        g_r = g_n * bn * 0.25 * ((r > 0) & (r < 1))
        g_a = np.concatenate([g_r, g_z, g_n], axis=1)
        g_b = np.concatenate([g_r, g_z, g_n * r], axis=1)
        seen.append(x)
        given.append(g_a)
        g_u += h.T @ g_b
        carry = g * z + g_b @ u.T
    ids, rows = np.concatenate(seen), np.concatenate(given)
    g_table = np.stack([np.bincount(ids, rows[:, k], classes) for k in range(rows.shape[1])], axis=1)
    return g_table.astype(np.float32), g_u


def _sweep(x: np.ndarray, live: np.ndarray, order: range, table: np.ndarray, u: np.ndarray, states: np.ndarray) -> None:
    """What `_run` gives, into `states` (hidden, time, lane), without a tape and in place.

    Lanes are sorted by length, so at each time the first live[t] of them go on. Arrays are
    hidden by lane, so that every operation runs along the lanes. table (3 * hidden, byte) and u
    (3 * hidden, hidden) have the slope and shift of the gates in them.
    """
    size = u.shape[1]
    lanes = x.shape[1]
    h = np.zeros((size, lanes), np.float32)
    a, b = np.empty((3 * size, lanes), np.float32), np.empty((3 * size, lanes), np.float32)
    for t in order:
        k = int(live[t])
        if k == lanes:
            a_, b_, h_ = a, b, h
        else:
            a_, b_, h_ = np.empty((3 * size, k), np.float32), np.empty((3 * size, k), np.float32), h[:, :k]
        np.take(table, x[t, :k], axis=1, out=a_, mode="clip")
        np.matmul(u, h_, out=b_)
        gates = a_[: 2 * size]
        gates += b_[: 2 * size]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        n = b_[2 * size :]
        n *= gates[:size]
        n += a_[2 * size :]
        np.maximum(n, -1, out=n)
        np.minimum(n, 1, out=n)
        h_ -= n
        h_ *= gates[size:]
        h_ += n
        states[:, t, :k] = h_


class ByteTagger:
    """The network: names of the languages, and for each direction a byte table and a state matrix."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        scale = 1 / np.sqrt(hidden)
        self.weights = [
            rng.normal(0, 0.5, (PAD + 1, 3 * hidden)), rng.normal(0, scale, (hidden, 3 * hidden)),
            rng.normal(0, 0.5, (PAD + 1, 3 * hidden)), rng.normal(0, scale, (hidden, 3 * hidden)),
            rng.normal(0, scale, (2 * hidden, len(languages))), np.zeros(len(languages)),
        ]
        self.weights = [w.astype(np.float32) for w in self.weights]

    def positions(self, windows: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (time, lane, language) and states for bytes (time, lane)."""
        table_f, u_f, table_b, u_b, out, bias = self.weights
        forward = _run(windows, table_f, u_f, tapes and tapes[0])
        backward = _run(windows[::-1], table_b, u_b, tapes and tapes[1])[::-1]
        states = np.concatenate([forward, backward], axis=2)
        logits = states @ out + bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, states

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.01) -> None:
        """windows: bytes (lane, time) with PAD at the end; labels: language number of each lane."""
        rng = np.random.default_rng(11)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        size = self.weights[1].shape[0]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            x, y = windows[pick].T, labels[pick]
            tapes: tuple[list, list] = ([], [])
            p, states = self.positions(x, tapes)
            g = p
            g[:, np.arange(batch), y] -= 1
            g *= (x != PAD)[:, :, None] / max(1, (x != PAD).sum())
            g_out = np.einsum("tbh,tbl->hl", states, g)
            g_states = g @ self.weights[4].T
            gt_f, gu_f = _back(tapes[0], g_states[:, :, :size], self.weights[1], PAD + 1)
            gt_b, gu_b = _back(tapes[1], g_states[::-1, :, size:], self.weights[3], PAD + 1)
            grads = [gt_f, gu_f, gt_b, gu_b, g_out, g.sum(axis=(0, 1))]
            norm = np.sqrt(sum(float((q * q).sum()) for q in grads))
            for w, q, (m, v) in zip(self.weights, grads, moments, strict=True):
                q = q * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (q - m)
                v += 0.01 * (q * q - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (document, language) over all bytes of each text; 0 for empty ones."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][owner] + within * WINDOW
        length = np.minimum(WINDOW, offsets[1:][owner] - begin)
        total = np.zeros((len(sizes), len(self.languages)))
        order = np.argsort(-length, kind="stable")
        size = self.weights[1].shape[0]
        slope = np.repeat(np.float32([0.25, 1]), [2 * size, size])[:, None]
        shift = np.repeat(np.float32([0.5, 0]), [2 * size, size])[:, None]
        tables = [np.ascontiguousarray(self.weights[i].T * slope + shift) for i in (0, 2)]
        inner = [np.ascontiguousarray(self.weights[i].T * slope) for i in (1, 3)]
        out, bias = np.ascontiguousarray(self.weights[4].T), self.weights[5][:, None]
        for i in range(0, len(owner), LANES):
            lanes = order[i : i + LANES]
            last = int(length[lanes[0]])
            steps = np.arange(last)[:, None]
            valid = steps < length[lanes]
            x = data[np.minimum(begin[lanes] + steps, len(data) - 1)].astype(np.intp)
            live = valid.sum(axis=1)
            states = np.zeros((2 * size, last, len(lanes)), np.float32)
            _sweep(x, live, range(last), tables[0], inner[0], states[:size])
            _sweep(x, live, range(last - 1, -1, -1), tables[1], inner[1], states[size:])
            p = out @ states.reshape(2 * size, -1)
            p += bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            p = p.reshape(len(self.languages), last, len(lanes))
            p *= valid
            np.add.at(total, owner[lanes], p.sum(axis=1).T)
        return total / np.maximum(sizes, 1)[:, None]


def train(
    documents: DataFrame, usable: Column, per_language: int = 1500, seed: int = 3, most_languages: int = 64
) -> ByteTagger | None:
    """Fit on at most 2 * `per_language` windows of FIT_WINDOW bytes for each language (None without any).

    Learned are the `most_languages` languages of most rows, of equal ones those that sort first, so the sample is
    bounded by the parameters. Each window is cut from a text chosen by a hash of doc_id and text, at a place
    chosen by a hash, whatever the splits; predictions then cover all rows and bytes.
    """
    rows = documents.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select(
        "lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("key")
    )
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    counts = {r["lang"]: r["count"] for r in most}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_language / n))])
    hashed = F.pmod("key", F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.greatest(F.length("text") - FIT_WINDOW + 1, F.lit(1)))
    taken = (
        rows.where(F.col("lang").isin(languages) & (hashed < share[F.col("lang")]))
        .select("lang", "key", F.substring(F.col("text"), (place + 1).cast("int"), F.lit(FIT_WINDOW)).alias("text"))
        .limit(2 * per_language * len(languages))
        .toArrow()
        .sort_by([("key", "ascending"), ("text", "ascending")])
    )
    windows = np.full((len(taken), FIT_WINDOW), PAD, np.int64)
    for i, text in enumerate(taken.column("text").to_pylist()):
        raw = np.frombuffer(text.encode()[:FIT_WINDOW], np.uint8)
        windows[i, : len(raw)] = raw
    index = {name: i for i, name in enumerate(languages)}
    labels = np.array([index[x] for x in taken.column("lang").to_pylist()])
    model = ByteTagger(languages)
    # Each language counts alike, however many windows it has.
    even = np.random.default_rng(seed)
    pick = np.concatenate([even.choice(np.flatnonzero(labels == k), per_language) for k in np.unique(labels)])
    model.fit(windows[pick], labels[pick])
    return model


def predict(
    documents: DataFrame, model: ByteTagger | None, keep: list[str], carry_text: bool = False
) -> DataFrame:
    """Columns `keep` with lang_pred and score for each row of `documents`.

    A null text and one without a letter get `und` and score 0, and so does every text if
    there was nothing to learn from. All bytes of a text count, whatever its length. Equal
    texts get equal answers; ties go to the language that sorts first. Columns of the input
    that are not in `keep` are not read.
    """
    told = F.when(F.col("text").rlike(LETTER), F.col("text"))
    # With `carry_text` the text is among `keep` and goes to the tasks once, with a flag.
    inner = documents.select(*keep, told.isNotNull().alias("_told") if carry_text else told.alias("_text"))
    schema = inner.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text" if carry_text else "_text"):
                texts = batch.column("text" if carry_text else "_text")
                empty = texts.is_null() if not carry_text else pc.invert(batch.column("_told").fill_null(False))
                empty = empty.to_numpy(zero_copy_only=False).astype(bool)
                if model is None or not len(texts):
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    p = model.documents(*text_bytes(texts))
                    score = np.where(empty, 0.0, p.max(axis=1))
                    best = p.argmax(axis=1)
                    names = [UNKNOWN if e else model.languages[b] for e, b in zip(empty.tolist(), best.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))],
                    [*keep, "lang_pred", "score"],
                )

    return inner.mapInArrow(run, schema)


def identify(documents: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learned from rows of the other folds only.

    The fold is crc32 of doc_id as text; a null doc_id counts as the empty text. Neither lang,
    source nor doc_id takes part in a prediction. Rows with a null lang are predicted, not learned
    from. An empty table gives no rows; other columns are not read.
    """
    rows = documents.withColumn("held_out", crc_fold(F.col("doc_id"), folds) == held)
    model = train(rows, ~F.col("held_out"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return predict(rows, model, ["doc_id", "held_out"])
