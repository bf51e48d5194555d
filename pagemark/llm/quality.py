"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are what the line and its two neighbours are made of; the
field adds how labels follow each other. The quality of a document is the mean chance of its lines
to be good (forward-backward marginals), weighted by their length, brought to a probability by a
logistic curve.

The field is learnt from at most sample labelled documents (a documented bound), the first by a hash
of their id, whose lines all carry the document's label. Their lines' features are made in the tasks;
only those come to the driver. Sequences are whole documents, however many lines they have. Of
several labels of one id the largest counts, of several texts the first by hash.

Very long texts are read whole, a text at a time. A score that equals the threshold is good.

Nulls: a null text is empty, and an empty text is one empty line. Rows with a null label are not
learnt from; with nothing to learn from, each score is 0.5. Repeated rows each give a row. An
empty table gives an empty result. Other columns, whatever their names, are ignored, or kept as they are
where rows are filtered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of_id, few

SAMPLE = 4_000
THRESHOLD = 0.3
#: Documents of a training step, and lines that are worked on together there, with those that fill up shorter documents.
BATCH, LINES = 512, 1 << 17
STEPS = 150
#: Weight of the squared parameters.
DECAY = 1e-3
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"#%&$*@^~<>{}[]=+_\\"
OWN = 11


def line_features(lines: list[bytes]) -> np.ndarray:
    """What each line is made of."""
    out = np.zeros((len(lines), OWN))
    for row, line in zip(out, lines, strict=True):
        words = line.split()
        n, size = len(words), len(line)
        if not n:
            row[0] = 1
            continue
        upper, lower = size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LOWER))
        row[1] = min(1.0, line.count(b"!") / n)
        row[2] = min(1.0, line.count(b"|") / n)
        row[3] = min(1.0, (size - len(line.translate(None, _MARKS))) / n)
        row[4] = upper / (upper + lower + 1)
        row[5] = (size - len(line.translate(None, _DIGIT))) / size
        row[6] = 1 - len(set(words)) / n if n > 3 else 0
        row[7] = max(Counter(words).values()) / n if n > 3 else 0
        row[8] = min(2.0, size / n / 8)
        row[9] = np.log1p(n) / 8
        row[10] = line.rstrip()[-1:] in (b".", b"?", b"!", b":")
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """A line's features with those of the lines before and after it and a constant."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[: n - 1] = own[:-1], own[1:]
    return np.concatenate([own, before, after, np.ones((n, 1))], axis=1)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of a text's lines."""
    lines = (text or b"").split(b"\n")
    return with_neighbours(line_features(lines)), line_lengths(lines)


def line_lengths(lines: list[bytes]) -> np.ndarray:
    """What each line weighs: its bytes, or 1 if it is empty."""
    return np.array([max(1, len(x)) for x in lines], float)


@dataclass
class Field:
    weights: np.ndarray  #: of the features, for good against bad
    follow: np.ndarray  #: 2 x 2: from bad, good to bad, good
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Chance of each line to be good."""
        score = np.zeros((1, len(x), 2))
        score[0, :, 1] = x @ self.weights
        return _chances(score, self.follow, np.ones((1, len(x)), bool))[1][0, :, 1]

    def quality(self, x: np.ndarray, lengths: np.ndarray) -> float:
        return float((self.marginals(x) * lengths).sum() / lengths.sum())

    def score(self, x: np.ndarray, lengths: np.ndarray) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.quality(x, lengths) + b, -40, 40))))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _chances(score: np.ndarray, follow: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the total weight of each sequence, marginals of the labels, sums of those of the pairs in each sequence. there: which lines there are."""
    n, size, _ = score.shape
    forward, back = np.zeros_like(score), np.zeros_like(score)
    forward[:, 0] = score[:, 0]
    for t in range(1, size):
        step = _log_sum(forward[:, t - 1, :, None] + follow, 1) + score[:, t]
        forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
    for t in range(size - 2, -1, -1):
        step = _log_sum(follow + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(there[:, t + 1, None], step, 0)
    total = _log_sum(forward[:, -1], 1)
    marginal = np.exp(forward + back - total[:, None, None]) * there[:, :, None]
    pairs = np.zeros((n, 2, 2))
    if size > 1:
        both = forward[:, :-1, :, None] + follow + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pairs = np.exp(np.where(there[:, 1:, None, None], both, -np.inf)).sum(axis=1)
    return total, marginal, pairs


def fit(told: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Field:
    """A field that makes the labels likely, from features and lengths of texts' lines; each line has its text's label."""
    if len(set(labels)) < 2:
        return Field(np.zeros(3 * OWN + 1), np.zeros((2, 2)), (0.0, 0.0 if not labels else (4.0 if labels[0] else -4.0)))
    y = np.array(labels)
    lines = np.array([len(x) for x, _ in told])
    # both labels weigh the same, and a document as much as another
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    theta, one, two = np.zeros(3 * OWN + 1 + 4), 0.0, 0.0
    rng = np.random.default_rng(6)
    for step in range(1, STEPS + 1):
        some = rng.permutation(len(y))[:BATCH]
        some = some[np.argsort(lines[some], kind="stable")]
        grad, total = DECAY * theta, weight[some].sum()
        for part in _alike(lines[some]):
            grad = grad + _gradient(theta, [told[i][0] for i in some[part]], y[some[part]], weight[some[part]] / total)
        one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad**2
        theta -= 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2))
    quality = np.array([field.quality(x, n) for x, n in told])
    field.curve = _logistic(quality, np.array(labels, float))
    return field


def _alike(lines: np.ndarray) -> Iterator[slice]:
    """Parts of documents, ascending by lines, that differ little in length and fit LINES when filled up (one at least)."""
    at = 0
    while at < len(lines):
        end = at + 1
        while end < len(lines) and lines[end] <= 4 * lines[at] + 16 and lines[end] * (end + 1 - at) <= LINES:
            end += 1
        yield slice(at, end)
        at = end


def _gradient(theta: np.ndarray, xs: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope of the documents' mean negative log likelihood a line, each by its weight."""
    lines = np.array([len(x) for x in xs])
    there = np.arange(lines.max()) < lines[:, None]
    x = np.zeros((*there.shape, xs[0].shape[1]))
    x[there] = np.concatenate(xs)
    score = np.zeros((*there.shape, 2))
    score[:, :, 1] = x @ theta[:-4]
    _, marginal, pairs = _chances(score, theta[-4:].reshape(2, 2), there)
    off = (marginal[:, :, 1] - y[:, None]) * (w / lines)[:, None] * there
    pairs[np.arange(len(y)), y, y] -= lines - 1  # those that are there
    return np.concatenate([np.tensordot(off, x, 2), np.einsum("n,nij->ij", w / lines, pairs).ravel()])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))), by Newton steps with a small penalty; equal weight for both labels."""
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (p - y)) + 1e-3 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta -= np.linalg.solve(hess, grad)
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from docs (doc_id, text) and labels (doc_id, quality)."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [tuple(x) for x in chosen.collect()]  # sample rows at most
    if not rows:
        return fit([], [])
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(rows, "id long, quality int"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            lines = [(x or b"").split(b"\n") for x in batch["data"].to_pylist()]
            told = [(line_features(x), line_lengths(x)) for x in lines]
            made = [pa.array([x[k].astype("<f4").tobytes() for x in told], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["quality"], batch["mark"], *made], ["id", "quality", "mark", "own", "lengths"])

    text = F.col("text").cast("binary")
    docs = docs.select("doc_id", "text")  # whatever else is there
    joined = docs.join(known, docs["doc_id"] == known["id"]).select("id", "quality", text.alias("data"), F.xxhash64(text).alias("mark"))
    made = joined.mapInArrow(described, "id long, quality int, mark long, own binary, lengths binary")
    # one row of each id: sample rows at most
    got = made.groupBy("id").agg(F.min_by(F.struct("quality", "own", "lengths"), "mark").alias("x")).select("id", "x.*").toArrow().sort_by("id")
    read = lambda data, wide: np.frombuffer(data, "<f4").astype(float).reshape(-1, wide)
    told = [(with_neighbours(read(own, OWN)), read(n, 1)[:, 0]) for own, n in zip(got["own"].to_pylist(), got["lengths"].to_pylist(), strict=True)]
    return fit(told, got["quality"].to_pylist())


def classify(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score of each row of docs (doc_id, text)."""
    field_ = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            scores = [field_.value.score(*features(x)) for x in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return given.mapInArrow(work, "doc_id long, score double")


def held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the rows whose crc32(doc_id) mod modulus is not rest."""
    fold = F.coalesce(bucket_of_id("doc_id", modulus) == rest, F.lit(False))
    field = learn(docs.select("doc_id", "text"), labels.where(~fold), sample)
    return classify(docs, field).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that score THRESHOLD or more."""
    field_ = docs.sparkSession.sparkContext.broadcast(learn(docs.select("doc_id", "text"), labels, sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            texts = batch["text"].cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([field_.value.score(*features(x)) >= THRESHOLD for x in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
