"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its words, each weighted by how many characters it fills. For each sample
k a term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of (term, k). A term of weight w
stands at t = floor(ln w / r + b) and bids ln a = ln c - r (t - b + 1). The lowest bid gives the
sample (term, t), of which 21 bits are kept. Two texts agree in a sample as often as their
generalised Jaccard similarity: the sum of the smaller weights over that of the larger.

Nulls: a null text is empty; null ids count as larger than all others. Texts without words have an
empty fingerprint, which is like another empty one (1.0) and unlike all others (0.0). Repeated
rows stand side by side in the order of (doc_id, text). A lone document is its own neighbour. Very long texts are
exploded into words as any other, and grouped in parts. An empty table gives an empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SAMPLES = 32
#: Tasks for each shuffle partition, as a text's terms take far more room than the text.
TASKS_PER_PARTITION = 4
#: Buckets of neighbouring ids for each task.
RANGES_PER_TASK = 4
_LAST_ID = (1 << 63) - 1
_BLANKS = r"[ \t\n\x0B\f\r]+"


def _draws(k: int, term: Column) -> tuple[Column, Column, Column, Column]:
    """r, ln c, b and the hash they come from."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))

    def uniform(bits: Column, size: int) -> Column:
        return (bits + F.lit(0.5)) * F.lit(2.0**-size)

    low32 = F.lit((1 << 32) - 1)
    r = -F.ln(uniform(F.shiftrightunsigned(one, 32), 32) * uniform(one.bitwiseAND(low32), 32))
    c = -F.ln(
        uniform(F.shiftrightunsigned(two, 40), 24) * uniform(F.shiftrightunsigned(two, 16).bitwiseAND(F.lit((1 << 24) - 1)), 24)
    )
    return r, F.ln(c), uniform(two.bitwiseAND(F.lit((1 << 16) - 1)), 16), one


def _bid(draws: tuple[Column, Column, Column, Column], log_weight: Column) -> Column:
    """ln a as a fixed-point number over 21 bits of what the sample is."""
    r, log_c, b, seen = draws
    t = F.floor(log_weight / r + b)
    bid = log_c - r * (t - b + F.lit(1.0))
    fixed = ((bid + F.lit(128.0)) * F.lit(2.0**34)).cast("long")
    return F.shiftleft(fixed, 21).bitwiseOR(F.shiftrightunsigned(seen, 43).bitwiseXOR(t.bitwiseAND(F.lit(0x1FFFFF))))


def signatures(df: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each column of texts, an array of samples (nulls for a text without words).

    keys name one row each. No text is shuffled if df is already dealt out by some of the keys.
    """
    words = df.select(*keys, *(F.split(F.coalesce(F.col(x), F.lit("")), _BLANKS).alias(f"_w{i}") for i, x in enumerate(texts)))
    sizes, total = [], F.lit(0)
    for i in range(len(texts)):
        total = total + F.size(f"_w{i}")
        sizes.append(total.alias(f"_n{i}"))
    listed = words.select(*keys, *sizes, F.concat(*(F.col(f"_w{i}") for i in range(len(texts)))).alias("_words"))
    each = listed.select(*keys, *(f"_n{i}" for i in range(len(texts))), F.posexplode("_words").alias("_pos", "_word"))
    length = F.length("_word").cast("double")
    weights, before = [], F.lit(0)
    for i in range(len(texts)):
        inside = (F.col("_pos") >= before) & (F.col("_pos") < F.col(f"_n{i}"))
        weights.append(F.sum(F.when(inside, length).otherwise(F.lit(0.0))).alias(f"_v{i}"))
        before = F.col(f"_n{i}")
    terms = each.groupBy(*keys, F.xxhash64("_word").alias("_term")).agg(*weights)
    logs = terms.select(*keys, "_term", *(F.ln(F.nullif(F.col(f"_v{i}"), F.lit(0.0))).alias(f"_l{i}") for i in range(len(texts))))
    bids = []
    for k in range(samples):
        draws = _draws(k, F.col("_term"))
        bids += [F.min(_bid(draws, F.col(f"_l{i}"))).alias(f"_s{k}_{i}") for i in range(len(texts))]
    drawn = logs.groupBy(*keys).agg(*bids)
    return drawn.select(
        *keys,
        *(F.array(*(F.col(f"_s{k}_{i}").bitwiseAND(F.lit(0x1FFFFF)) for k in range(samples))).alias(x) for i, x in enumerate(texts)),
    )


def shown(signature: Column) -> Column:
    """A signature as text: six hexadecimal digits a sample."""
    return F.when(signature[0].isNull(), F.lit("")).otherwise(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the samples in which two signatures agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return (same / F.size(a)).cast("double")


def _range_of(order: Column, bounds: list[int]) -> Column:
    """Number of bounds that are not above order, by halving."""
    steps = max(1, len(bounds)).bit_length()
    padded = F.lit(bounds + [_LAST_ID] * ((1 << steps) - len(bounds)))
    halves = F.lit([1 << k for k in reversed(range(steps))])
    found = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.element_at(padded, at + half) <= order, at + half).otherwise(at))
    return F.when(order == F.lit(_LAST_ID), F.lit(len(bounds))).otherwise(found)


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs as bucket, row, ghost, order, doc_id, text: neighbouring ids share a bucket.

    The first document of each bucket also ends the bucket before it (the first of all ends the
    last), as a ghost, so each document's successor is the next row of its bucket.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("order"))
    tasks = partitions(docs.sparkSession) * TASKS_PER_PARTITION
    n = tasks * RANGES_PER_TASK
    cuts = ids.agg(F.percentile_approx("order", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("cuts")).first().cuts
    bounds = sorted({x for x in cuts or [] if x < _LAST_ID})
    firsts = dict(ids.select(_range_of(F.col("order"), bounds).alias("bucket"), "order").groupBy("bucket").agg(F.min("order")).collect())
    filled = sorted(firsts)
    first = F.lit([firsts.get(b, -1) for b in range(len(bounds) + 1)])
    known = F.lit([b in firsts for b in range(len(bounds) + 1)])
    previous = dict(zip(filled, filled[-1:] + filled[:-1], strict=True))
    before = F.lit([previous.get(b, 0) for b in range(len(bounds) + 1)])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("order")
    ).withColumn("bucket", _range_of(F.col("order"), bounds))
    at = F.col("bucket") + F.lit(1)
    leads = F.element_at(known, at) & (F.element_at(first, at) == F.col("order"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    other = F.struct(F.element_at(before, at).alias("bucket"), F.lit(True).alias("ghost"))
    both = rows.select("doc_id", "text", "order", F.explode(F.when(leads, F.array(own, other)).otherwise(F.array(own))).alias("to"))
    by = Window.partitionBy("bucket").orderBy("ghost", "order", "text")
    placed = both.select("to.bucket", "to.ghost", "order", "doc_id", "text").repartition(tasks, "bucket")
    return placed.select("*", F.row_number().over(by).alias("row"), F.lead("text").over(by).alias("next_text"))


def edited_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last quarter replaced by the start of the next document's text.
    """
    n = F.length("text")
    swapped = F.floor(n / 4).cast("int")
    rows = in_ranges(docs)
    texts = rows.select(
        "bucket", "row", "ghost", "doc_id", "text", n.cast("long").alias("n_chars"),
        F.when(F.col("ghost"), F.lit("")).otherwise(F.concat(F.substring("text", F.lit(1), n - swapped), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), swapped))).alias("edited"),
    )
    # with doc_id, so that both sides of the join below read the same shuffle
    signed = signatures(texts, ["bucket", "row", "doc_id"], ["text", "edited"], samples)
    by = Window.partitionBy("bucket").orderBy("row")
    near = signed.select(
        "bucket", "row", shown(F.col("text")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.lead("text").over(by)).alias("near_next"),
    )
    facts = texts.where(~F.col("ghost")).select("bucket", "row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(near, ["bucket", "row"]).drop("bucket", "row")
