"""Byte-level convolutional networks in numpy, and operators 3 (quality) and 4 (language) built on them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, id_text, rows_of, text_digest

#: Bounds of the fitting sample, the only rows a model is learned from: documents, and bytes of each; a longer text
#: gives this many pieces, spread over all of it.
FIT_ROWS, FIT_BYTES, FIT_PIECES = 1500, 32_768, 16
#: Every doc whose crc32(doc_id as text) leaves this remainder by FOLDS is held out from learning.
FOLDS, HELD_OUT = 3, 1
#: Positions convolved at once.
BLOCK = 1 << 16
UNKNOWN = "und"


@dataclass
class ByteConv:
    """Filters of several widths over bytes, max-pooled over chunks, then one linear layer per chunk.

    A filter of width w has a weight for each of 256 byte values at each of its w
    places.  A text's chunks start every ``stride`` bytes and hold the filter
    positions of ``length`` bytes; zeros follow the text, so that filters reach
    past its end, and an empty text is one chunk of zeros.
    """

    widths: tuple[int, ...]
    filters: int
    length: int
    stride: int
    classes: int
    weights: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    @property
    def reach(self) -> int:
        return max(self.widths)

    def start(self, rng: np.random.Generator) -> None:
        n = self.filters * len(self.widths)
        self.weights = [rng.normal(0, 0.5 / w**0.5, (w, 256, self.filters)).astype(np.float32) for w in self.widths]
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, self.classes)).astype(np.float32)
        self.out_bias = np.zeros(self.classes, np.float32)

    # -- learning ---------------------------------------------------------------

    def fit(self, windows: np.ndarray, classes: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam on the cross entropy of single chunks; ``windows`` has length + reach bytes a row."""
        rng = np.random.default_rng(seed)
        self.start(rng)
        params = [*self.weights, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        by_class = [np.flatnonzero(classes == c) for c in range(self.classes)]
        by_class = [i for i in by_class if len(i)]
        for step in range(1, steps + 1):
            # as many of each class; what is rare is drawn again and again
            pick = np.concatenate([rng.choice(i, batch // len(by_class)) for i in by_class])
            for p, g, a, b in zip(params, self._gradients(windows[pick], classes[pick]), first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        rows, at, tops = np.arange(len(x))[:, None], [], []
        for w, weight in zip(self.widths, self.weights):
            conv = weight[0][x[:, : self.length]]
            for j in range(1, w):
                conv += weight[j][x[:, j : j + self.length]]
            best = conv.argmax(axis=1)
            at.append(best)
            tops.append(np.take_along_axis(conv, best[:, None, :], 1)[:, 0])
        pre = np.concatenate(tops, 1) + self.bias
        hidden = np.maximum(pre, 0)
        p = softmax(hidden @ self.out + self.out_bias)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (pre > 0)
        grads = []
        for k, (w, weight) in enumerate(zip(self.widths, self.weights)):
            g, part = np.zeros_like(weight), back[:, k * self.filters : (k + 1) * self.filters]
            for j in range(w):
                np.add.at(g[j], (x[rows, at[k] + j], np.arange(self.filters)), part)
            grads.append(g)
        return [*grads, back.sum(0), hidden.T @ p, p.sum(0)]

    # -- use ----------------------------------------------------------------------

    def prepare(self) -> None:
        """Tables by pairs of bytes: a filter of width w then takes w / 2 look-ups a position."""
        self.tables = [
            [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(w), 2)]
            for w in self.weights
        ]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of a text begin and end."""
        n = max(1, size)
        begin = np.arange(0, max(1, n - (self.length - self.stride)), self.stride)
        return begin, np.minimum(begin + self.length, n)

    def chunk_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all chunks of the texts, in order, and the number of chunks of each text."""
        counts, begins, ends, at = [], [], [], 0
        for t in texts:
            b, e = self.windows(len(t))
            counts.append(len(b))
            begins.append(b + at)
            ends.append(e + at)
            at += len(t) + self.reach
        data = np.frombuffer((b"\0" * self.reach).join([*texts, b""]), np.uint8)
        pairs = data[:-1].astype(np.uint16) * 256 + data[1:]
        begin, end = np.concatenate(begins), np.concatenate(ends)
        tops, k = np.empty((len(begin), len(self.bias)), np.float32), 0
        while k < len(begin):
            stop = max(k + 1, int(np.searchsorted(end, begin[k] + BLOCK)))
            base, top = begin[k], end[stop - 1]
            marks = np.empty(2 * (stop - k), np.int64)
            marks[::2], marks[1::2] = begin[k:stop] - base, end[k:stop] - base
            for i, tables in enumerate(self.tables):
                conv = tables[0][pairs[base : top + 1]]
                for j, t in enumerate(tables[1:], 1):
                    conv[:-1] += t[pairs[base + 2 * j : top + 2 * j]]
                tops[k:stop, i * self.filters : (i + 1) * self.filters] = np.maximum.reduceat(conv, marks)[::2]
            k = stop
        return np.maximum(tops + self.bias, 0) @ self.out + self.out_bias, np.array(counts)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _batches(texts: list[bytes], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= most or i == len(texts) - 1:
            yield a, i + 1
            a, size = i + 1, 0


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def fitting_sample(docs: DataFrame, labels: DataFrame, rows: int, most: int) -> list[tuple[bytes, object]]:
    """At most ``rows`` pairs of text and label of documents not held out, drawn by a hash of the id.

    ``labels`` has ``doc_id`` and ``y``; of several labels of one document the smallest
    counts, of several texts the first in order.  The labels are drawn first, so the
    driver sees ``rows`` texts of at most ``most`` bytes, whatever the size of the corpus:
    of a longer text, ``FIT_PIECES`` pieces at even distances.
    """
    pick = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pick = pick.groupBy(F.col("doc_id").alias("_id")).agg(F.min("y").alias("y"))
    pick = pick.orderBy(F.xxhash64(F.col("_id"), F.lit(11)), "_id").limit(rows)
    size = max(1, most // FIT_PIECES // 4)  # a character has at most four bytes
    piece = f"substring(text, cast(1 + n * (length(text) - {size}) div {FIT_PIECES - 1} AS int), {size})"
    spread = f"array_join(transform(sequence(0L, {FIT_PIECES - 1}L), n -> {piece}), '')"
    texts = id_text(docs).select("doc_id", F.expr(f"IF(octet_length(text) <= {most}, text, {spread})").alias("text"))
    got = texts.join(F.broadcast(pick), texts["doc_id"] == pick["_id"]).where("text IS NOT NULL")
    got = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    return [(r.text.encode(), r.y) for r in sorted(got, key=lambda r: r.doc_id)]


def _chunks(model: ByteConv, sample: list[tuple[bytes, object]], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The sample's chunks as rows of bytes, and their classes."""
    rows, of = [], []
    for (t, _), c in zip(sample, y):
        padded = np.frombuffer(t + bytes(model.length + model.reach), np.uint8)
        for a in model.windows(len(t))[0]:
            rows.append(padded[a : a + model.length + model.reach])
            of.append(c)
    return np.stack(rows), np.array(of)


# -- quality ------------------------------------------------------------------------


@dataclass
class QualityModel:
    """A chunk network and the weights that combine a document's chunks into one probability."""

    net: ByteConv
    mix: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits, counts = self.net.chunk_logits(texts)
        return 1 / (1 + np.exp(-(self.document(logits[:, 1] - logits[:, 0], counts) @ self.mix)))

    @staticmethod
    def document(z: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean, least and largest chunk logit, pooled over the document, and one."""
        z = np.clip(z, -12, 12)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        pools = [np.add.reduceat(z, at) / counts, np.minimum.reduceat(z, at), np.maximum.reduceat(z, at)]
        return np.stack([*pools, np.ones(len(counts))], 1)


def fit_quality(sample: list[tuple[bytes, object]], steps: int = 900, seed: int = 3) -> QualityModel:
    """Learn from (text, 0 or 1) pairs; with fewer than two classes the score is the share of ones."""
    net = ByteConv(widths=(2, 6), filters=8, length=512, stride=448, classes=2)
    y = [int(q) for _, q in sample]
    if len(set(y)) < 2:
        net.start(np.random.default_rng(seed))
        net.out[:] = 0
        net.prepare()
        p = min(0.99, max(0.01, (sum(y) + 1) / (len(y) + 2)))
        return QualityModel(net, np.array([0, 0, 0, np.log(p / (1 - p))]))
    net.fit(*_chunks(net, sample, y), steps=steps, batch=64, rate=0.02, seed=seed)
    net.prepare()
    logits, counts = net.chunk_logits([t for t, _ in sample])
    x, t, mix = QualityModel.document(logits[:, 1] - logits[:, 0], counts), np.array(y), np.array([1.0, 0, 0, 0])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-(x @ mix)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(4)
        mix = mix - np.linalg.solve(h, x.T @ (p - t) + (mix - [1.0, 0, 0, 0]))
    return QualityModel(net, mix)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> DataFrame:
    """Quality of every whole text, learned from ``labels.quality``.

    The network sees bytes alone.  It is fitted on the driver to at most ``rows``
    labelled texts of at most ``most`` bytes outside the held-out fold; scoring
    covers all bytes of all texts in overlapping chunks.  Returns one row per
    input row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.  Null
    counts as empty; a null ``doc_id`` is not held out; empty tables give no rows;
    without labels every score is one half.
    """
    scored = _quality(docs, labels, id_text(docs), "doc_id long, score double", rows, most)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def _quality(docs: DataFrame, labels: DataFrame, texts: DataFrame, schema: str, rows: int, most: int) -> DataFrame:
    """Scores of ``texts`` (``doc_id``, ``text`` and what else stays), learned from ``docs`` and ``labels``."""
    y = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y"))
    model = fit_quality(fitting_sample(docs, y.where("y IN (0, 1)"), rows, most))
    net, mix = model.net, model.mix
    del net.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.prepare()
        m = QualityModel(net, mix)
        for b in few_rows(batches):
            texts, score = _bytes(b.column(1)), [np.empty(0)]
            for a, z in _batches(texts):
                score.append(m.scores(texts[a:z]))
            rest = b.schema.names[2:]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score)), *b.columns[2:]], ["doc_id", "score", *rest])

    return texts.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be of quality 1, columns unchanged.

    Rows are told by ``doc_id`` (which may be null) and their text's digest.
    """
    texts = id_text(docs).withColumn("digest", text_digest(F.col("text")))
    scored = _quality(docs, labels, texts, "doc_id long, score double, digest string", rows, FIT_BYTES)
    return rows_of(docs, scored.where("score >= 0.5").select("doc_id", "digest"), text_digest(docs["text"]))


# -- language ---------------------------------------------------------------------------


def fit_language(sample: list[tuple[bytes, object]], steps: int = 700, seed: int = 4) -> tuple[ByteConv, list[str]]:
    """Learn from (text, language) pairs; the languages come back sorted."""
    langs = sorted({str(y) for _, y in sample}) or [UNKNOWN]
    net = ByteConv(widths=(2, 4, 6), filters=8, length=256, stride=256, classes=len(langs))
    if len(langs) < 2:
        net.start(np.random.default_rng(seed))
    else:
        x, y = _chunks(net, sample, [langs.index(str(y)) for _, y in sample])
        net.fit(x, y, steps=steps, batch=64, rate=0.02, seed=seed)
    return net, langs


ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def language_ids(docs: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> DataFrame:
    """Language of every whole text, learned from the non-null ``lang`` of ``docs`` itself.

    Windows of 256 bytes cover the text; their logits are averaged and softmaxed.
    Fitting is bounded as for quality.  Returns one row per input row: ``doc_id``,
    ``held_out``, ``lang_pred`` (``und`` if the text is null or has no letter, with
    score 0, or if nothing could be learned), ``score``.  A null ``doc_id`` is not
    held out; empty tables give no rows.
    """
    labels = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("y"))
    net, langs = fit_language(fitting_sample(docs, labels, rows, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.prepare()
        names = np.array(langs, object)
        for b in few_rows(batches):
            texts = _bytes(b.column(1))
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            lettered = np.array([has_letter(t.decode()) for t in texts], bool)
            for a, z in _batches(texts):
                logits, counts = net.chunk_logits(texts[a:z])
                at = np.concatenate([[0], np.cumsum(counts)[:-1]])
                p = softmax(np.add.reduceat(logits.astype(np.float64), at, axis=0) / counts[:, None])
                lang[a:z], score[a:z] = names[p.argmax(1)], p.max(1)
            lang[~lettered], score[~lettered] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    out = id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
