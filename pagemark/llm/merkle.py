"""Merkle manifest of a dataset: a tree of BASE children a node for each group, and one over the groups.

Rows are leaves, hashed where they are read, so texts are never shuffled. The slim leaves are dealt by ranges of
(group, order), so that a group of any size lies in as many partitions as it needs, each an indexed run of its group. A partition keeps a
mountain range (Range): a stack of the completed peaks of each height, to which a leaf is added like one to a
number in BASE, each carry a node. Children to the left of the first whole node stay at its open left edge, as their node has
begun in another partition. Ranges of neighbours merge into one in the same way, in rounds of FAN,
and the last one is closed: what is left of a run is hashed as it is, with nothing put in for what it lacks. Only edges
and the nodes made of them leave a partition, a few for each height. Then each partition gets the siblings that it lacks, makes its nodes
again and reads off the path of each leaf. The groups' roots are leaves of a tree made by the same steps.

Nulls: a null column is written as `-`; a null group is a group, before all others; a null in the order column
comes first. Ties and repeated rows: equal orders go by leaf; equal rows have a place each. A lone leaf is its own root,
with an empty path. Very long texts are hashed whole, one at a time. An empty table gives an empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of_id, group_starts, keep, partitions

#: Children of a node.
BASE = 3
#: Neighbouring ranges that are merged at a time.
FAN = 64
#: Leaves of a partition, about; there are not fewer partitions than the session has for shuffles.
RUN = 200_000
#: Columns of a leaf of `documents`, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(children: list[str]) -> str:
    """Lowercase hex SHA-256 of hex digests, concatenated as text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """SHA-256 of values, each as its UTF-8 bytes after their number and a colon, `-` for a null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


Node = tuple[int, int, str]  # height, index, digest


@dataclass
class Range:
    """Nodes of the leaves from start to end of a tree that are not yet part of a whole node.

    left: by height, children whose run has begun before start. right: by height, the run that is not full.
    """

    start: int
    end: int
    left: list[list[str]] = field(default_factory=list)
    right: list[list[str]] = field(default_factory=list)

    def _put(self, height: int, index: int, value: str, made: list[Node]) -> None:
        """Adds the next node of a height; a full run carries."""
        while True:
            while len(self.right) <= height:
                self.left.append([])
                self.right.append([])
            run = self.right[height]
            first = -(-self.start // BASE**height)  # of the nodes of this height that are whole here
            if index // BASE * BASE < first:
                self.left[height].append(value)
                return
            run.append(value)
            if len(run) < BASE:
                return
            value = digest(run)
            run.clear()
            height, index = height + 1, index // BASE
            made.append((height, index, value))

    def add(self, value: str, made: list[Node]) -> None:
        self.end += 1
        self._put(0, self.end - 1, value, made)

    def edges(self) -> Iterator[Node]:
        """The nodes at both edges."""
        for height, (left, right) in enumerate(zip(self.left, self.right, strict=True)):
            first = -(-self.start // BASE**height)
            for k, value in enumerate(left):
                yield height, first + k, value
            last = self.end // BASE**height
            for k, value in enumerate(right):
                yield height, last - len(right) + k, value

    def merge(self, other: Range, made: list[Node]) -> Range:
        """This range and the one that begins where it ends, as one."""
        out = Range(self.start, other.end)
        nodes = sorted([*self.edges(), *other.edges()], key=lambda x: (x[0], x[1]))
        carried: list[Node] = []
        at = 0
        height = 0
        while at < len(nodes) or carried:
            row = []
            while at < len(nodes) and nodes[at][0] == height:
                row.append(nodes[at])
                at += 1
            row = sorted([*row, *carried], key=lambda x: x[1])
            carried = []
            while len(out.right) <= height:
                out.left.append([])
                out.right.append([])
            first = -(-out.start // BASE**height)
            run: list[str] = []
            for _, index, value in row:
                if index // BASE * BASE < first:
                    out.left[height].append(value)
                    continue
                # whole nodes between two edges are not here: a run begins anew after them
                run = [value] if index % BASE == 0 else [*run, value]
                if index % BASE == BASE - 1:
                    carried.append((height + 1, index // BASE, digest(run)))
                    run = []
            out.right[height] = run
            made += carried
            height += 1
        return out

    def close(self, made: list[Node]) -> str:
        """The root, if this is the whole tree: short runs are hashed as they are."""
        n, height, over = self.end, 0, None
        while n > 1:
            run = [*(self.right[height] if height < len(self.right) else []), *([over] if over is not None else [])]
            over = None
            n = -(-n // BASE)
            if run:
                over = digest(run)
                made.append((height + 1, n - 1, over))
            height += 1
        return over if over is not None else self.right[height][0]


@dataclass
class Grown:
    """Trees over leaves."""

    dealt: DataFrame  #: the leaves with part and place
    runs: DataFrame  #: part, tree, size, start and n of its tree
    roots: DataFrame  #: tree, root, n
    shared: DataFrame  #: nodes at the edges of partitions and above; all, if records are asked for


_EDGE = pa.schema([("tree", pa.binary()), ("height", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("part", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_EDGES = "tree binary, height int, index long, digest string, part long, start long, end long, kind int"
#: Kinds of rows: a node at the edge of a partition's range, one of a range of several, one made in between, a root.
OWN, EDGE, MADE, ROOT = range(4)


def _rows(tree: bytes, part: int, of: Range, kind: int, nodes: list[Node]) -> list[tuple]:
    """A range as rows; it has at least one node."""
    return [(tree, h, i, d, part, of.start, of.end, kind) for h, i, d in nodes]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _EDGE.types, strict=True)] if rows else [pa.array([], t) for t in _EDGE.types], schema=_EDGE)


def _runs(tab: pa.Table) -> Iterator[tuple[bytes, pa.Table]]:
    """The leaves of each tree that a partition has, in order."""
    tab = tab.combine_chunks().sort_by([("tree", "ascending"), ("place", "ascending")])
    if not len(tab):
        return
    codes = tab["tree"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    at = group_starts(codes)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(codes)], strict=True):
        yield tab["tree"][a].as_py(), tab.slice(a, b - a)


def _read(rows: list[dict]) -> list[tuple[int, Range]]:
    """Ranges of one tree by part, from their rows; all of one part are one range."""
    by: dict[int, list[dict]] = {}
    for x in rows:
        by.setdefault(x["part"], []).append(x)
    out = []
    for part, some in by.items():
        r = Range(some[0]["start"], some[0]["end"])
        for x in sorted(some, key=lambda y: (y["height"], y["index"])):
            while len(r.right) <= x["height"]:
                r.left.append([])
                r.right.append([])
            first = -(-r.start // BASE ** x["height"])
            (r.left if x["index"] // BASE * BASE < first else r.right)[x["height"]].append(x["digest"])
        out.append((part, r))
    return sorted(out, key=lambda x: x[1].start)


def _merged(ranges: list[tuple[int, Range]], made: list[Node]) -> Range:
    total = ranges[0][1]
    for _, r in ranges[1:]:
        total = total.merge(r, made)
    return total


def _dealt(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """leaves (tree, order columns, leaf, and what is carried) by ranges: with part and place; the runs: part, tree, start, n of its tree; and how many parts."""
    spark = leaves.sparkSession
    order = [c for c in leaves.columns if c.startswith("order")]
    many = leaves.count()
    n = max(1, min(partitions(spark), many), many // RUN)
    by = ["tree", *order, "leaf", "row"]
    dealt = leaves.repartitionByRange(n, *by).sortWithinPartitions(*by).drop(*order)
    # places rise with the rows of a partition
    dealt = keep(dealt.withColumns({"part": F.spark_partition_id().cast("long"), "place": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("part", "tree").agg(F.count("*").alias("size"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("tree")
    return dealt, keep(runs.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(total)}), slim=True), n


def node_records(leaves: DataFrame) -> DataFrame:
    """tree, height, index, digest of all nodes above the leaves; leaves as for `grown`. For manifests that list their nodes."""
    return grown(leaves, records=True).shared.where(F.col("kind") == MADE).select("tree", "height", "index", "digest")


def grown(leaves: DataFrame, records: bool = False) -> Grown:
    """Trees over leaves: tree (binary, null for one), order columns (named order...), leaf (hex), row (any number of its own), and what is carried.
    """
    dealt, runs, n = _dealt(leaves)

    def stacks(key: tuple[pa.Scalar, ...], tab: pa.Table, known: pa.Table) -> pa.Table:
        start = {x["tree"]: x["start"] for x in known.to_pylist()}
        rows: list[tuple] = []
        for tree, run in _runs(tab):
            r, made = Range(start[tree], start[tree]), []
            for value in run["leaf"].to_pylist():
                r.add(value, made)
                if not records:
                    made.clear()
            rows += _rows(tree, key[0].as_py(), r, OWN, list(r.edges())) + _rows(tree, key[0].as_py(), r, MADE, made)
        return _table(rows)

    def merge(last: bool):
        def work(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
            made: list[Node] = []
            tree, part = key[0].as_py(), key[1].as_py()
            r = _merged(_read(tab.to_pylist()), made)
            if last:
                root = r.close(made)
                return _table([*_rows(tree, part, r, MADE, made), (tree, 0, 0, root, part, r.start, r.end, ROOT)])
            return _table(_rows(tree, part, r, EDGE, list(r.edges())) + _rows(tree, part, r, MADE, made))

        return work

    own = keep(dealt.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(stacks, _EDGES), slim=True)
    open_, found = own, [own]
    while True:
        last, n = n <= FAN, -(-n // FAN)
        below = open_.where(F.col("kind").isin(OWN, EDGE)).withColumn("to", F.floor(F.col("part") / FAN) if not last else F.lit(0).cast("long"))
        open_ = keep(below.groupBy("tree", "to").applyInArrow(merge(last), _EDGES), slim=True)
        found.append(open_)
        if last:
            break
    roots = open_.where(F.col("kind") == ROOT).select("tree", F.col("digest").alias("root"), F.col("end").alias("n"))
    shared = found[0].where(F.col("kind").isin(OWN, MADE))
    for x in found[1:]:
        shared = shared.unionAll(x.where(F.col("kind") == MADE))
    return Grown(dealt, runs, roots, shared)


def _lacking(runs: DataFrame, shared: DataFrame) -> DataFrame:
    """part, tree, height, index, digest of the siblings that each run lacks: those of the runs of children that reach over its edges."""
    heights = F.sequence(F.lit(0), F.ceil(F.log(F.greatest(F.col("n"), F.lit(2)).cast("double")) / F.log(F.lit(float(BASE)))).cast("int") + 1)
    at = runs.select("part", "tree", "start", (F.col("start") + F.col("size") - 1).alias("last"), F.explode(heights).alias("height"))
    group = lambda c: F.floor(F.col(c) / F.pow(F.lit(BASE), F.col("height") + 1)).cast("long")
    wanted = at.select("part", F.coalesce("tree", F.lit(b"")).alias("t"), F.col("tree").isNull().alias("none"), "height", F.explode(F.array_distinct(F.array(group("start"), group("last")))).alias("group"))
    there = shared.select(F.coalesce("tree", F.lit(b"")).alias("t"), F.col("tree").isNull().alias("none"), "height", F.floor(F.col("index") / BASE).cast("long").alias("group"), "index", "digest")
    return wanted.join(there, ["t", "none", "height", "group"]).select("part", F.when(~F.col("none"), F.col("t")).alias("tree"), "height", "index", "digest")


def _sides(values: list[str], start: int, n: int, outside: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """Of the leaves from start of a tree of n: for each height below the root the nodes of all runs that they are in, and the index of the first."""
    out, own, first, height = [], values, start, 0
    while n > 1:
        lo, hi = first // BASE * BASE, min(n, -(-(first + len(own)) // BASE) * BASE)
        row = [*(outside[height, i] for i in range(lo, first)), *own, *(outside[height, i] for i in range(first + len(own), hi))]
        out.append((lo, row))
        own = [digest(row[a : a + BASE]) for a in range(0, len(row), BASE)]
        first, n, height = lo // BASE, -(-n // BASE), height + 1
    return out


def _path(index: int, sides: list[tuple[int, list[str]]]) -> str:
    """For each height the siblings to the left, a dot, those to the right, and a comma."""
    out = []
    for lo, row in sides:
        i = index - lo
        a = i // BASE * BASE
        out += [*row[a:i], ".", *row[i + 1 : a + BASE], ","]
        index //= BASE
    return "".join(out)


def folded(value: str, path: str) -> str:
    """The root from a leaf and its path."""
    for step in path.split(",")[:-1]:
        left, right = step.split(".")
        value = hashlib.sha256((left + value + right).encode()).hexdigest()
    return value


def siblings(path: str) -> str:
    """SHA-256 of a path's digests from the leaf up, left to right."""
    return hashlib.sha256(path.replace(".", "").replace(",", "").encode()).hexdigest()


#: Heights of rows that tell of a run: where it starts and how large its tree is, the path above its tree, its tree's root.
PLACE, ABOVE, TOP = -1, -2, -3


def proofs(trees: Grown, carried: str, above: DataFrame | None = None, test: str | None = None) -> DataFrame:
    """tree, leaf, the carried columns (names and types) and subroot of each leaf, with its path.

    above: name and path of each tree in a tree of trees; paths then go on with it. test: a carried column with another digest; then not the path is
    given but proof_sha256 (`siblings`) and folded_root (`folded` from that digest).
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    row = lambda height, index, value: F.struct(F.lit(height).alias("height"), index.alias("index"), value.alias("digest"))
    told = trees.runs.join(trees.roots.select(F.col("tree").alias("_tree"), "root"), same("tree", "_tree"))
    rows = [row(PLACE, F.col("start"), F.col("n").cast("string")), row(TOP, F.lit(0).cast("long"), F.col("root"))]
    if above is not None:
        told = told.join(above.select(F.col("name").alias("_name"), F.col("path").alias("_path")), same("tree", "_name"))
        rows.append(row(ABOVE, F.lit(0).cast("long"), F.col("_path")))
    known = told.select("part", "tree", F.explode(F.array(*rows)).alias("x")).select("part", "tree", "x.*").unionAll(_lacking(trees.runs, trees.shared))
    known = known.toDF(*known.columns)  # columns of its own
    names = [x.split()[0] for x in carried.split(", ")]
    ends = ["path"] if test is None else ["proof_sha256", "folded_root"]

    def work(key: tuple[pa.Scalar, ...], tab: pa.Table, right: pa.Table) -> pa.Table:
        outside: dict[bytes, dict[tuple[int, int], str]] = {}
        for x in right.to_pylist():
            outside.setdefault(x["tree"], {})[x["height"], x["index"] if x["height"] >= 0 else 0] = x["digest"] if x["height"] != PLACE else (x["index"], int(x["digest"]))
        parts = []
        for tree, run in _runs(tab):
            known = outside[tree]
            start, n = known[PLACE, 0]
            over = known.get((ABOVE, 0), "")
            sides = _sides(run["leaf"].to_pylist(), start, n, known)
            paths = (_path(start + i, sides) + over for i in range(len(run)))
            if test is None:
                out = [list(paths)]
            else:
                out = [list(x) for x in zip(*((siblings(p), folded(v, p)) for p, v in zip(paths, run[test].to_pylist(), strict=True)), strict=True)]
            run = run.select(["tree", "leaf", *names]).append_column("subroot", pa.array([known[TOP, 0]] * len(run), pa.string()))
            for name, values in zip(ends, out, strict=True):
                run = run.append_column(name, pa.array(values, pa.string()))
            parts.append(run)
        return pa.concat_tables(parts)

    schema = ", ".join(["tree binary", "leaf string", carried, "subroot string", *(f"{x} string" for x in ends)])
    return trees.dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(work, schema)


def manifest(leaves: DataFrame, carried: str, test: str | None = None) -> tuple[DataFrame, str | None]:
    """Proofs of leaves in the tree of their groups' trees, and its root (null without leaves). leaves as for `grown`; a group's name is its tree."""
    groups = grown(leaves)
    # the roots of the groups are leaves in the order of their names
    tops = grown(keep(groups.roots.select(F.lit(None).cast("binary").alias("tree"), F.col("tree").alias("order_name"), F.col("tree").alias("name"), F.col("root").alias("leaf"), F.lit(0).cast("long").alias("row")), slim=True))
    root = tops.roots.first()
    return proofs(groups, carried, proofs(tops, "name binary"), test), None if root is None else root.root


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of `documents`, for `manifest`: by source, in the order of doc_id; tampered: the leaf of the text without line breaks where 2 divides the id's crc32."""
    values = [F.col(c) for c in COLUMNS]
    broken = (bucket_of_id("doc_id", 2) == 0) & F.contains(F.col("text"), F.lit("\n"))
    other = leaf(*values[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return docs.select(
        F.col("source").cast("binary").alias("tree"), F.col("doc_id").cast("long").alias("order_id"), leaf(*values).alias("leaf"),
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.when(broken, other).alias("tampered"),
    ).withColumn("tampered", F.coalesce("tampered", "leaf"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each document's proof, held against its tampered text."""
    found, root = manifest(keep(document_leaves(docs)), "doc_id long, tampered string", "tampered")
    return found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
