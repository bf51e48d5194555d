"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Each text is the set of its distinct word shingles. A SuperMinHash signature gives every shingle
its own random permutation of the places: in round j the shingle bids j plus a fraction at its
j-th place, and a document is done when no later bid can win. Bands of the signature put documents
in buckets. Equal sets are one class, of which only the smallest doc_id goes on.

In a bucket every member is first held, on full sets, against its hub: the member that meets most
others in its buckets. What is linked becomes one component. Two members s and e of different
components are told apart, or linked, by how they differ from their hub: with F the shingles in
which a set differs from the hub's, |F(s) & F(e)| gives their similarity exactly, and the least it
must be for a link grows with both differences. So pairs are found by a prefix-filtered join on the
rarest shingles of F, with bounds by their places, not by comparing all members: near copies of one text differ from it each in
its own way. No bucket is capped, and no pair that may be linked is left out.

A pair at the least similarity shares no band with a chance of (1 - 0.8**4)**32 < 1e-7.

Nulls: a null text, like one without words, has an empty set and is linked with nothing; a row with
a null doc_id takes the component of the documents with the same set, if there are any. Fewer words than a shingle has are one shingle. Rows with
the same doc_id are one document in the groups; each gives its own row, and equal ones are compared once. Ties: of two hubs
that meet as many, the smaller doc_id, then the smaller hash of the text, is the hub; that decides no link. Very long texts are
read whole, a text at a time. An empty table gives an empty result. Other columns are ignored, or kept as they
are by one_of_each, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, join2, keep, mix, partitions, word_hashes

BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Shingles that are signed at a time.
SLICE = 1 << 15
#: Documents that are held against a copy of their hub's text.
SHARE = 256


def shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Hashes of each text's distinct shingles, sorted."""
    words, counts = word_hashes([(x or b"").lower() for x in texts])
    out = []
    for own in np.split(words, np.cumsum(counts)[:-1]) if texts else ():
        k = min(size, len(own))
        if k:
            made = mix(own[: len(own) - k + 1] + np.uint64(k))
            for i in range(1, k):
                made = join2(made, own[i : len(own) - k + 1 + i])
            own = np.unique(made)
        out.append(own)
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, one row for each set; a value is the same only for the same shingle."""
    out = np.full((len(sets), places), float(places))
    flat = out.ravel()
    elements = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    for a in range(0, len(elements), SLICE):
        element, doc = elements[a : a + SLICE], owner[a : a + SLICE]
        place = np.tile(np.arange(places, dtype=np.int16), (len(element), 1))
        row = np.arange(len(element))
        for j in range(places):
            drawn = mix(element[row] + np.uint64((j + 1) * 0xA0761D6478BD642F % 2**64))
            k = j + ((drawn & np.uint64(0xFFFFFF)) % np.uint64(places - j)).astype(np.int64)
            mine = place[row, k]
            place[row, k] = place[row, j]
            np.minimum.at(flat, doc[row] * places + mine, j + (drawn >> np.uint64(11)) * 2.0**-53)
            first, last = doc[0], doc[-1]
            waits = out[first : last + 1].max(axis=1) >= j + 1
            row = row[waits[doc[row] - first]]
            if not len(row):
                break
    return out


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, said (a hash of the text), n_shingles, a, b (the class: hashes of the set), bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            sets = shingles(batch["data"].to_pylist(), size)
            bits = signatures(sets).view(np.uint64).reshape(len(sets), BANDS, ROWS)
            key = mix(np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy())
            for k in range(ROWS):
                key = join2(key, bits[:, :, k])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "said": batch["said"],
                    "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                    "a": pa.array([int(mix(x).sum(dtype=np.uint64).astype(np.int64)) for x in sets], pa.int64()),
                    "b": pa.array([int(np.bitwise_xor.reduce(mix(x + np.uint64(7)), initial=np.uint64(len(x))).astype(np.int64)) for x in sets], pa.int64()),
                    "bands": pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
                }
            )

    return docs.mapInArrow(work, "doc_id long, said long, n_shingles long, a long, b long, bands array<long>")


def compared(pairs: DataFrame, docs: DataFrame, size: int, least: int) -> DataFrame:
    """hub, doc_id, linked, total, added, missing, differ of the pairs (hub, hub_said, doc_id, said), on full sets.

    total: shingles of the hub; added and missing: how many the document has more and less; differ:
    those shingles. The documents of a hub are held against it SHARE at a time, so that a large group is
    spread over many tasks. docs: doc_id, said, data. Each text is moved once to be found by its id, and once to be compared.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        hub_set = np.zeros(0, np.uint64)
        for batch in few(batches):
            out: dict[str, list] = {x: [] for x in ("hub", "doc_id", "linked", "total", "added", "missing", "differ")}
            facts = (batch[c].to_pylist() for c in ("hub", "hub_said", "part", "is_doc", "doc_id"))
            for hub, hub_said, part, is_doc, doc_id, other in zip(*facts, shingles(batch["data"].to_pylist(), size), strict=True):
                if not is_doc:  # comes before the documents of the part
                    now, hub_set = (hub, hub_said, part), other
                    continue
                if now != (hub, hub_said, part):
                    raise ValueError("a hub is missing")
                differ = np.setxor1d(hub_set, other, assume_unique=True)
                both = (len(hub_set) + len(other) - len(differ)) // 2
                values = (hub, doc_id, 100 * both >= least * (both + len(differ)) > 0, len(hub_set), len(other) - both, len(hub_set) - both, differ.view(np.int64))
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    parts = pairs.groupBy("hub", "hub_said").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    asked_hubs = parts.select("hub", "hub_said", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_doc"), F.col("hub").alias("doc_id"), F.col("hub_said").alias("said"))
    asked = pairs.join(parts, ["hub", "hub_said"]).select("hub", "hub_said", F.pmod(F.xxhash64("doc_id", "said"), "parts").cast("int").alias("part"), F.lit(True).alias("is_doc"), "doc_id", "said")
    one = docs.groupBy("doc_id", "said").agg(F.any_value("data").alias("data"))  # of repeated rows
    found = asked.unionByName(asked_hubs).join(one, ["doc_id", "said"]).select("hub", "hub_said", "part", "is_doc", "doc_id", "data")
    order = ("hub", "hub_said", "part")
    dealt = found.repartition(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "is_doc")
    schema = "hub long, doc_id long, linked boolean, total long, added long, missing long, differ array<long>"
    return dealt.mapInArrow(work, schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of the edges (low, high)."""
    both = keep(edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v"))), slim=True)
    label = keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), slim=True)
    while True:
        seen = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("component").alias("m"))
        least = label.join(seen, label["node"] == seen["u"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        root = label.select(F.col("node").alias("root"), F.col("component").alias("above"))
        jumped = keep(least.join(root, F.col("component") == F.col("root"), "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "old"), slim=True)
        label = jumped.select("node", "component")
        if jumped.where("component <> old").limit(1).count() == 0:
            return label


def near_duplicates(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id; size: words in a shingle; least: similarity in hundredths."""
    return _grouped(docs, size, least).select("doc_id", "n_shingles", "component_id")


def _said(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("binary"))


def _grouped(docs: DataFrame, size: int, least: int) -> DataFrame:
    """doc_id, said, n_shingles, a, b, component_id."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).withColumn("said", _said("data"))
    sketch = keep(_sketched(given, size))
    # of equal sets only the smallest document goes on
    first = F.min(F.struct("doc_id", "said", "bands"))
    classes = keep(sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("a", "b", "n_shingles").agg(first.alias("h")).select("a", "b", "h.*"))
    told = keep(compared(keep(_held_against_hubs(classes), slim=True), given.where("doc_id IS NOT NULL"), size, least))
    label = components(told.where("linked").select(F.col("hub").alias("low"), F.col("doc_id").alias("high")))
    named = classes.select("a", "b", "doc_id").join(label, classes["doc_id"] == label["node"], "left").select("a", "b", F.coalesce("component", "doc_id").alias("component"))
    more = keep(_later_links(told, label, least), slim=True)
    if more.limit(1).count():
        # links between components join them as wholes
        above = components(more).select(F.col("node").alias("component"), F.col("component").alias("_above"))
        named = named.join(above, "component", "left").select("a", "b", F.coalesce("_above", "component").alias("component"))
    return sketch.join(named, ["a", "b"], "left").select("doc_id", "said", "n_shingles", "a", "b", F.coalesce(F.col("component"), F.col("doc_id")).alias("component_id"))


def _held_against_hubs(classes: DataFrame) -> DataFrame:
    """hub, hub_said, doc_id, said: in each bucket each member and its hub, the one that meets most others in its buckets."""
    members = classes.select(F.explode("bands").alias("band"), "doc_id", "said")
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # at most as many buckets as bands
    met = members.join(buckets, "band").groupBy("doc_id", "said").agg(F.sum("n").alias("weight"), F.collect_list("band").alias("bands"))
    weighed = keep(met.select("doc_id", "said", "weight", F.explode("bands").alias("band")), slim=True)
    hubs = weighed.groupBy("band").agg(F.min_by(F.struct("doc_id", "said"), F.struct(-F.col("weight"), "doc_id", "said")).alias("h")).select("band", F.col("h.doc_id").alias("hub"), F.col("h.said").alias("hub_said"))
    other = (F.col("doc_id") != F.col("hub")) | (F.col("said") != F.col("hub_said"))
    return weighed.join(hubs, "band").where(other).select("hub", "hub_said", "doc_id", "said").distinct()


def _later_links(told: DataFrame, label: DataFrame, least: int) -> DataFrame:
    """Links (low, high) between components, by documents that were held against the same hub."""
    own = label.withColumnRenamed("node", "doc_id")
    hubs = label.select(F.col("node").alias("hub"), F.col("component").alias("of_hub"))
    named = told.join(own, "doc_id", "left").join(hubs, "hub", "left").withColumn("component", F.coalesce("component", "doc_id")).withColumn("away", F.col("component") != F.coalesce("of_hub", "hub"))
    # a group needs a second look if it has two members, and one away from the hub
    groups = named.groupBy("hub").agg(F.count("*").alias("k"), F.max("away").alias("any")).where("k > 1 AND any").select("hub")
    # (100 + least) * |F(s) & F(e)| >= cost(s) + cost(e) - spare
    cost = 100 * F.col("missing") + least * F.col("added")
    spare = (100 - least) * F.col("total")
    rows = named.join(groups, "hub").select("hub", "doc_id", "component", "away", cost.alias("cost"), spare.alias("spare"), "differ")
    open_ = keep(rows.repartition(partitions(told.sparkSession), "hub", "doc_id"))  # a large group in many tasks
    # from one side alone; for members at the hub's component only what such a one must have for others
    rest = lambda share: F.greatest(F.lit(1), F.ceil(share / (100 + least)))
    facts = open_.select("hub", "doc_id", "component", "away", "cost", "spare", F.size("differ").alias("n"))
    tokens = open_.select("hub", "doc_id", F.explode("differ").alias("token"))
    often = tokens.groupBy("hub", "token").agg(F.count("*").alias("often")).where("often > 1")
    by = Window.partitionBy("hub", "doc_id").orderBy("often", "token")
    # a token of one document meets nothing; it ranks before all others, so their ranks count from how many there are
    shared = tokens.join(often, ["hub", "token"]).withColumn("place", F.row_number().over(by)).withColumn("last", F.count("*").over(Window.partitionBy("hub", "doc_id")))
    placed = shared.join(facts, ["hub", "doc_id"]).withColumn("after", F.col("last") - F.col("place")).withColumn("rank", F.col("n") - F.col("after"))
    asks_here = F.col("away") & (F.col("rank") <= F.col("n") - rest(F.col("cost") - F.col("spare")) + 1)
    ranked = keep(placed.where(asks_here | (F.col("rank") <= F.col("n") - rest(F.col("cost")) + 1)).select("hub", "token", "doc_id", "component", "cost", "after", (F.col("cost") - F.col("spare")).alias("over"), asks_here.alias("asks"), (F.col("rank") <= F.col("n") - rest(F.col("cost")) + 1).alias("answers")))
    asks = ranked.where("asks").select("hub", "token", F.col("doc_id").alias("s"), F.col("component").alias("cs"), F.col("after").alias("after_s"), F.col("over").alias("over_s"))
    answers = ranked.where("answers").select("hub", "token", F.col("doc_id").alias("e"), F.col("component").alias("ce"), F.col("after").alias("after_e"), F.col("cost").alias("cost_e"))
    # at the first token that both have, what they share lies there and after it
    enough = (100 + least) * (1 + F.least("after_s", "after_e")) >= F.col("over_s") + F.col("cost_e")
    met = asks.join(answers, ["hub", "token"]).where((F.col("cs") != F.col("ce")) & enough).select("hub", "s", "e").distinct()
    one = open_.select("hub", F.col("doc_id").alias("s"), F.col("differ").alias("fs"), F.col("cost").alias("cost_s"), "spare", F.col("component").alias("cs"))
    two = open_.select("hub", F.col("doc_id").alias("e"), F.col("differ").alias("fe"), F.col("cost").alias("cost_e"), F.col("component").alias("ce"))
    both = met.join(two, ["hub", "e"]).join(one, ["hub", "s"])
    linked = (100 + least) * F.size(F.array_intersect("fs", "fe")) >= F.col("cost_s") + F.col("cost_e") - F.col("spare")
    return both.where(linked).select(F.least("cs", "ce").alias("low"), F.greatest("cs", "ce").alias("high")).distinct()


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return result.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """One row, all columns, of each group of docs: of its smallest doc_id, null last.

    Every text of every id is on its own in this, so near copies under one doc_id, and rows without an id, are grouped like all others, and
    unlike texts under one id stay. Of rows of one id and text one stays, the same whatever the order. Texts without words are in no
    group and give a row of equal ids and texts.
    """
    doc_id = F.col("doc_id").cast("long")
    node = F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.col("text").cast("binary"))
    label = _grouped(docs.select(node.alias("doc_id"), "text"), size, least).select(F.col("doc_id").alias("_node"), "component_id")
    ids = docs.select(node.alias("_node"), doc_id.isNull().alias("_none"), doc_id.alias("_id")).distinct()
    heads = label.distinct().join(ids, "_node").groupBy("component_id").agg(F.min(F.struct("_none", "_id", "_node")).alias("h")).select(F.col("h._node").alias("_node"))
    # the rows as one column, whatever the names in them; equal ones are few before they are shuffled
    rows = docs.select(F.struct(*docs.columns).alias("doc"), node.alias("_node"), F.xxhash64(*docs.columns).alias("_all"))
    return rows.groupBy("_node").agg(F.min_by("doc", "_all").alias("doc")).join(heads, "_node", "left_semi").select("doc.*")
