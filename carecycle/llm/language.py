"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecycle.llm import tokens

STEPS = 64  # bytes of a segment; the state starts anew in each
HIDDEN = 8
SAMPLE_DOCS = 800  # documents per language to learn from
SAMPLE_SEGMENTS = 4  # segments of each of them, spread over its text
EPOCHS = 4
BATCH = 64
RATE = 0.01
BLOCK = 1024  # segments that run together
FOLDS = 5
UNKNOWN = "und"


@dataclass
class Network:
    """Both directions' weights and the classes.

    ``x`` (2, 257, 3H) has what each byte adds to the update, reset and
    candidate gates, bias included; byte 256 pads. ``u`` (2, H, 3H) is applied
    to the state, ``c`` (2, H) is the candidate's inner bias. ``w`` (2H, K) and
    ``b`` (K) give each position's class scores.
    """

    classes: list[str]
    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c, self.w, self.b]


def fresh(classes: list[str], hidden: int, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def draw(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Network(
        classes, draw(2, 257, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden**-0.5),
        np.zeros((2, hidden), np.float32), draw(2 * hidden, len(classes), scale=0.3),
        np.zeros(len(classes), np.float32),
    )


def _run(net: Network, codes: np.ndarray, direction: int):
    """States (T, B, H) of one direction over codes (T, B), and what learning needs of each step."""
    steps, width = codes.shape
    hidden = net.c.shape[1]
    x, u, c = net.x[direction], net.u[direction], net.c[direction]
    states = np.zeros((steps, width, hidden), np.float32)
    h = np.zeros((width, hidden), np.float32)
    kept = []
    for t in range(steps) if direction == 0 else reversed(range(steps)):
        a, v = x[codes[t]], h @ u
        gates = np.tanh(0.5 * (a[:, : 2 * hidden] + v[:, : 2 * hidden])) * 0.5 + 0.5
        z, r = gates[:, :hidden], gates[:, hidden:]
        inner = v[:, 2 * hidden :] + c
        n = np.tanh(a[:, 2 * hidden :] + r * inner)
        kept.append((t, h, z, r, inner, n))
        h = h + z * (n - h)
        states[t] = h
    return states, kept


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def positions(net: Network, codes: np.ndarray) -> np.ndarray:
    """Class probabilities (K, T, B) of every position of segments codes (T, B).

    The states that ``_run`` computes, with gates as rows so that each gate's values
    of all segments lie together, and computed in place.
    """
    steps, width = codes.shape
    hidden = net.c.shape[1]
    half = np.repeat(np.float32([0.5, 1]), [2 * hidden, hidden])[:, None]  # for the gates' tanh form
    scores = np.empty((len(net.classes), steps, width), np.float32)
    for d in (0, 1):
        x, u, c = half * net.x[d].T, half * net.u[d].T, net.c[d][:, None]
        w = net.w[d * hidden : (d + 1) * hidden].T.copy()
        h = np.zeros((hidden, width), np.float32)
        for t in reversed(range(steps)) if d else range(steps):
            a, v = x.take(codes[t], 1), u @ h
            gates, n = a[: 2 * hidden], v[2 * hidden :]
            gates += v[: 2 * hidden]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            n += c
            n *= gates[hidden:]
            n += a[2 * hidden :]
            np.tanh(n, out=n)
            n -= h
            n *= gates[:hidden]
            h += n
            if d:
                scores[:, t] += w @ h
            else:
                np.add(w @ h, net.b[:, None], out=scores[:, t])
    scores -= scores.max(0)
    np.exp(scores, out=scores)
    scores /= scores.sum(0)
    return scores


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
    hidden = net.c.shape[1]
    states, kept = zip(*(_run(net, codes, d) for d in (0, 1)))
    p = _softmax(states[0] @ net.w[:hidden] + states[1] @ net.w[hidden:] + net.b)
    real = codes < 256
    total = max(1, real.sum())
    hit = np.take_along_axis(p, labels[None, :, None].repeat(len(codes), 0), 2)[..., 0]
    loss = float(-(np.log(hit + 1e-9) * real).sum() / total)
    p[:, np.arange(len(labels)), labels] -= 1
    p *= (real / np.float32(total))[..., None]
    grads = [np.zeros_like(w) for w in net.weights()]
    gx, gu, gc, gw, gb = grads
    gb += p.sum((0, 1))
    for d in (0, 1):
        part = slice(d * hidden, (d + 1) * hidden)
        gw[part] += np.tensordot(states[d], p, ((0, 1), (0, 1)))
        into = p @ net.w[part].T
        carry = np.zeros_like(into[0])
        for t, h, z, r, inner, n in reversed(kept[d]):
            dh = into[t] + carry
            dn = dh * z * (1 - n * n)
            dz = dh * (n - h) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            dv = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(gx[d], codes[t], da)
            gu[d] += h.T @ dv
            gc[d] += (dn * r).sum(0)
            carry = dh * (1 - z) + dv @ net.u[d].T
    return loss, grads


def train(codes: np.ndarray, labels: np.ndarray, classes: list[str], hidden: int = HIDDEN,
          epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fits a network to segments codes (T, N) with class numbers labels (N), by Adam."""
    net = fresh(classes, hidden, seed)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            _, grads = gradients(net, codes[:, rows], labels[rows])
            step += 1
            for w, g, m, v in zip(net.weights(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def segments(text: bytes, steps: int = STEPS) -> np.ndarray:
    """The bytes of a text as rows of ``steps`` codes, the last one padded with 256."""
    rows = -(-len(text) // steps)
    codes = np.full(rows * steps, 256, np.int64)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return codes.reshape(rows, steps)


def held_out(id_col: str) -> Column:
    """Whether a document's id puts it into the fold that is never learnt from."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS, sample_segments: int = SAMPLE_SEGMENTS) -> Network | None:
    """A network learnt from text and language of documents outside the held-out fold.

    The sample is bounded by ``sample_docs`` documents of each language, those
    with the least hashes of id and text, and by ``sample_segments`` pieces of
    STEPS characters of each, at even distances in the whole text. Hashes are
    first held against a share of each language, so that few documents more
    than the sample are moved. None if no document has a language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) / float(1 << 40)
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row for each class of the network
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 2.0 * sample_docs / r["count"])])
    n = F.length("text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(sample_segments - 1)),
        lambda j: F.col("text").substr((F.floor(n * j / sample_segments) + 1).cast("int"), F.lit(STEPS)),
    )
    drawn = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    drawn = drawn.filter(F.col("draw") < F.element_at(share, F.col("lang")))
    drawn = drawn.select("lang", "draw", pieces.alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("pieces")))
    rows = drawn.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).select("lang", "pieces").collect()
    rows = sorted((r.lang, p.encode()) for r in rows for p in dict.fromkeys(r.pieces) if p)
    if not rows:
        return None
    classes = sorted({lang for lang, _ in rows})
    codes = np.concatenate([segments(p)[:1] for _, p in rows]).T.copy()
    return train(codes, np.array([classes.index(lang) for lang, _ in rows]), classes)


def _documents(net: Network | None, text_col: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.encoder.cache_clear()  # of an earlier run's last stage, in a worker that is used again
        for batch in batches:
            row = batch.column(0)
            texts = row.field(text_col).to_pylist()
            langs = [UNKNOWN] * len(texts)
            scores = np.zeros(len(texts))
            if net:
                read = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                for i, p in zip(read, _pooled(net, (texts[i].encode() for i in read))):
                    langs[i], scores[i] = net.classes[int(p.argmax())], min(1.0, float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(langs, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"]
            )

    return rows


def _pooled(net: Network, texts: Iterator[bytes]) -> list[np.ndarray]:
    """Mean class probabilities of all positions of each text."""
    sums: list[np.ndarray] = []
    lengths: list[int] = []
    waiting: list[tuple[int, np.ndarray]] = []

    def flush():
        owner = np.repeat([i for i, _ in waiting], [len(r) for _, r in waiting])
        codes = np.concatenate([r for _, r in waiting])
        for i in range(0, len(codes), BLOCK):
            block = codes[i : i + BLOCK].T
            p = positions(net, block)
            p *= block < 256
            total = p.sum(1).T
            for k, row in zip(owner[i : i + BLOCK].tolist(), total.astype(float)):
                sums[k] += row
        waiting.clear()

    n = 0
    for text in texts:
        rows = segments(text)
        waiting.append((len(sums), rows))
        sums.append(np.zeros(len(net.classes)))
        lengths.append(len(text))
        n += len(rows)
        if n >= BLOCK:
            flush()
            n = 0
    if waiting:
        flush()
    return [s / max(1, k) for s, k in zip(sums, lengths)]


def label(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): every row of ``docs`` as a struct, with its language.

    Every byte of the whole text is labelled; a document's probabilities are
    the means over its positions, the language is the likeliest and the score
    its mean probability. Texts that are null or have no letter, and all texts
    if nothing was learnt, get 'und' and 0. Repeated rows each return a row; an
    empty table gives no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_documents(net, text_col), f"row {kind}, lang_pred string, score double")


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, as ``label`` finds them.

    A null doc_id counts as an empty one for the fold and stays null; only the
    two named columns are read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = label(source, net)
    return found.select(
        "row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score"
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``fit`` and ``predict`` on one table."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
