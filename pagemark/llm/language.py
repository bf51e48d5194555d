"""Language identification as mixture inference over letter trigrams.

Each language has a smoothed trigram distribution. For each text, expectation-maximisation
estimates the proportions of a mixture of all languages. Sets of languages, from that of the largest
share to that of all, are then compared by their likelihood less a penalty for each language, and the
best is taken; what no larger set can reach, by a bound on the likelihood of any mixture, is not
tried. The prediction is the language of the largest share in that set. The score is its share there,
or, where it is alone, its share in the mixture of all.

The distributions are learnt from about per_language documents of each language (a documented
bound, the same at every size), chosen by a hash of id and text, with whole texts; equal rows count once.
What is sent to tasks is languages x FEATURES numbers, for MOST languages at most.

Trigrams never reach from one text into the next, so a prediction depends on its own text alone, however
rows are dealt. Very long texts are read whole, a text at a time. Ties between languages go to the
first by name.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows with a null language are
not learnt from. With nothing to learn from, all is `und`. Repeated rows each give a row. An empty
table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of_id, few

FEATURES = 1 << 16
PER_LANGUAGE = 1_500
ROUNDS = 8
SMOOTHING = 0.2
#: Penalty for each language, in units of half the log of the number of trigrams.
PENALTY = 4.0
UNKNOWN = "und"
#: Languages that a model may have; more are an error, as the model is sent to all tasks.
MOST = 500
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text's letters, a gap before and after them, and where each text's begin and end."""
    codes, sizes = [], [0]
    for text in texts:
        own = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.where(letters()[own], own, np.uint32(0))
        own = np.concatenate([own[:0], [np.uint32(0)], own, [np.uint32(0)]])
        own = own[np.append(True, (own[1:] != 0) | (own[:-1] != 0))]  # one gap for several
        some = len(own) > 2
        codes += [own] if some else []
        sizes.append(len(own) - 2 if some else 0)
    ends = np.cumsum(sizes)
    if not codes:
        return np.zeros(0, np.int64), ends
    c = np.concatenate(codes)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    inside = np.ones(len(c), bool)
    last = np.cumsum([len(x) for x in codes])
    inside[last - 1] = inside[last - 2] = False  # those would reach into the next text
    return (h >> np.uint32(16))[inside[:-2]].astype(np.int64), ends


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray  #: trigrams x languages

    def mixture(self, grams: np.ndarray) -> tuple[int, float]:
        """Language of the largest share in the best set, and its share."""
        p = self.chances[grams]
        n, cost = len(grams), PENALTY * np.log(len(grams) + 1) / 2
        share = _em(p, ROUNDS)
        order = np.argsort(-share, kind="stable")
        p, share = p[:, order], share[order]
        fit = p @ share
        # no mixture is likelier than this: the likelihood is concave in the shares
        most = float(np.log(fit).sum()) + n * max(0.0, float((p / fit[:, None]).mean(axis=0).max()) - 1)
        best, result = -np.inf, (int(order[0]), float(share[0]))
        for k in range(1, len(order) + 1):
            if most - cost * k <= best:
                break
            own = share if k == len(order) else np.ones(1, p.dtype) if k == 1 else _em(p[:, :k], ROUNDS)
            value = float(np.log(p[:, :k] @ own).sum()) - cost * k
            if value > best:
                best, top = value, int(np.argmax(own))
                result = (int(order[top]), float(share[0] if k == 1 else own[top]))
        return result


def _em(p: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of a mixture, from the components' likelihoods of each observation."""
    share = np.full(p.shape[1], 1 / p.shape[1], p.dtype)
    for _ in range(rounds):
        share = share * (p / (p @ share)[:, None]).mean(axis=0)
    return share / share.sum()


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the texts and languages of docs (text, lang, doc_id)."""
    there = dict(docs.where("lang IS NOT NULL").groupBy("lang").count().collect())
    if not there:
        return Model([], np.zeros((FEATURES, 0), np.float32))
    if len(there) > MOST:
        raise ValueError(f"{len(there)} languages; a model has {MOST} at most")
    names = sorted(there)
    # about per_language rows of each, by the first of their hashes
    limit = F.element_at(F.create_map(*(F.lit(x) for k in names for x in (k, min(2**62, 2**62 * per_language // there[k])))), F.col("lang"))
    first = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) < limit
    some = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(first).dropDuplicates(["doc_id", "text", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            grams, ends = trigrams(batch["text"].to_pylist())
            which = np.repeat([names.index(x) for x in batch["lang"].to_pylist()], np.diff(ends))
            cell, n = np.unique(which * FEATURES + grams, return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    # languages x FEATURES rows at most
    counts = some.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(names) * FEATURES)
    table[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    table = table.reshape(len(names), FEATURES).T + SMOOTHING
    return Model(names, (table / table.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text)."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)  # languages x FEATURES numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model_.value
        for batch in few(batches):
            grams, ends = trigrams(batch["text"].to_pylist())
            found = [
                known.mixture(grams[a:b]) if b > a and known.languages else None for a, b in zip(ends, ends[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([known.languages[x[0]] if x else UNKNOWN for x in found], pa.string()), pa.array([min(1.0, x[1]) if x else 0.0 for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame, modulus: int = 4, rest: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows whose crc32(doc_id) mod modulus is not rest."""
    fold = bucket_of_id("doc_id", modulus) == rest
    model = learn(docs.where(F.coalesce(~fold, F.lit(False))).select("doc_id", "text", "lang"), per_language)
    return identify(docs, model).select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
