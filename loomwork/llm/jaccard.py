"""N-gram Jaccard join: documents link when their word n-gram sets overlap enough; exact, without comparing all pairs.

Sets are keyed by a 64-bit fingerprint, so exact copies are one set. The method:

* *Prefix lists.* A set is put in the index list of its first n - ceil(t n) + 1 n-grams under one order of all n-grams (those
  that fill lists come last), with its size and their position. Two sets that link share a list.
* *Skipping by position.* A short list is sorted by set size. Pairs whose sizes differ too much, or whose positions leave too few
  n-grams to reach the overlap needed, are skipped; the sets of long lists stand in blocks, of which whole pairs are skipped so.
* *One block for each set of long lists.* Of its long lists the longest owns a set; the owner's sets are dealt at random into blocks of like
  sizes, so no list is read by one task. Sets are compared within their blocks, once, and what links is joined; then representatives of each
  block's groups, dealt anew, join the blocks of a large group.
* *Only what is still apart meets.* A list whose sets are all joined is done. Of the others the sets outside the largest group are
  dealt anew, and their blocks meet each block they share a list with: once, whatever the number of lists. The sets of the
  largest group never meet each other again, so the work for a group of near copies grows with its size and not with its square.
* *Answers from similar sets.* A task computes a set's overlaps with a block from those of an already answered, similar set: it
  touches the lists of the n-grams in which the two differ and nothing else. A set whose possible partners, by the triangle
  inequality of Jaccard distance, are all known to be joined with it needs no answers at all. Links that join what is joined
  already are not given out.

Short lists give distinct pairs, which are checked against the sets. Components are found by star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frame import free
from . import kernels as K
from .common import Scratch, give_back, prepare, removed, text_column, trimmed, written
from .components import connected

#: A list of more sets than this is handled in blocks.
SHORT_LIST = 64
#: About so many sets, or so many n-grams, are dealt into a block of a long list, which bounds a task's memory.
BLOCK_SETS, BLOCK_GRAMS = 1024, 500_000
#: Representatives of blocks are compared while there are lists of so many sets, and while that leaves at most half of the groups.
MANY = 4 * BLOCK_SETS
#: An n-gram in so many prefixes is moved to the end of the order; at most so many are (8 bytes each are broadcast). The order changes the work, never the result.
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Up to so many sets are looked up by a broadcast list of ids, more by a join.
MOST_BROADCAST = 1_000_000
#: Fingerprints that a task remembers, to give out copies once.
SEEN = 200_000
#: After a pair of blocks of so many bytes memory is given back.
LARGE_GROUP = 2 << 20

_DOCS = pa.schema([("row_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fp", pa.int64())])
_GRAMS = pa.schema([("gram", pa.int64())])
_POSTINGS = pa.schema([("gram", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SETS = pa.schema([("fp", pa.int64()), ("grams", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


_SALT = 0xC2B2AE3D27D4EB4F


def _fingerprint(grams: np.ndarray) -> int:
    m = K.mix(grams)
    return int(K.mix(np.array([np.bitwise_xor.reduce(m) + K.U64(len(m)), K.mix(m ^ K.U64(_SALT)).sum()], K.U64)).sum().view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _documents(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp = [], []
            for _, s in K.shingle_sets(b.column(2), width):
                n.append(len(s))
                fp.append(_fingerprint(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.int64())], schema=_DOCS)

    return trimmed(run)


def _new_sets(batches, width):
    """The sets of a task's rows, each fingerprint once (as far as it remembers)."""
    seen: set[int] = set()
    for b in batches:
        found = []
        for r, s in K.shingle_sets(b.column(1), width):
            if len(s) and (fp := _fingerprint(s)) not in seen:
                if len(seen) < SEEN:
                    seen.add(fp)
                found.append((r, fp, s))
        yield b, found


def _first_grams(width: int, percent: int):
    def run(batches):
        for _, found in _new_sets(batches, width):
            parts = [np.partition(m := K.mix(s), k - 1)[:k] if (k := prefix_length(len(s), percent)) < len(s) else K.mix(s) for _, _, s in found]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], schema=_GRAMS)

    return trimmed(run)


def _postings(width: int, percent: int, frequent):
    def run(batches):
        last = frequent.value
        for _, found in _new_sets(batches, width):
            gram, n, fp, pos = [], [], [], []
            for _, f, s in found:
                m = np.sort(K.mix(s))
                k = prefix_length(len(m), percent)
                late = last[np.minimum(np.searchsorted(last, m), len(last) - 1)] == m if len(last) else np.zeros(len(m), bool)
                m = np.concatenate([m[~late], m[late]])[:k]
                gram.append(m)
                n.append(np.full(k, len(s), np.int32))
                fp.append(np.full(k, f, np.int64))
                pos.append(np.arange(k, dtype=np.int32))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gram).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (n, fp, pos))], schema=_POSTINGS)

    return trimmed(run)


def _pairs(percent: int):
    """Reads short lists in order of (gram, n, fp) and gives the pairs that sizes and positions leave."""

    def pairs(gram, n, fp, pos):
        for k in range(1, len(gram)):
            at = np.flatnonzero(gram[:-k] == gram[k:])
            if not len(at):
                return
            small, large = n[at].astype(np.int64), n[at + k].astype(np.int64)
            need = -(-percent * (small + large) // (100 + percent))
            room = 1 + np.minimum(small - pos[at] - 1, large - pos[at + k] - 1)
            at = at[(100 * small >= percent * large) & (room >= need) & (fp[at] != fp[at + k])]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[at], fp[at + k])), pa.array(np.maximum(fp[at], fp[at + k]))], schema=_PAIRS)

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.concatenate(x) for x in zip(held, (b.column(i).to_numpy(zero_copy_only=False) for i in range(4)))]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last list may go on
            yield from pairs(*(c[:cut] for c in cols))
            held = [c[cut:] for c in cols]
        yield from pairs(*held)

    return trimmed(run)


def _some_sets(width: int, wanted):
    def run(batches):
        ids = wanted.value if wanted is not None else None
        for _, found in _new_sets(batches, width):
            fp = np.array([f for _, f, _ in found], np.int64)
            if ids is not None:
                keep = ids[np.minimum(np.searchsorted(ids, fp), len(ids) - 1)] == fp if len(ids) else np.zeros(len(fp), bool)
            else:
                keep = np.ones(len(fp), bool)
            size, rows = 0, []
            for k in np.flatnonzero(keep):
                rows.append(k)
                size += len(found[k][2])
                if size > 500_000 or len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array([found[k][2].tobytes() for k in rows], pa.binary())], schema=_SETS)
                    size, rows = 0, []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array([found[k][2].tobytes() for k in rows], pa.binary())], schema=_SETS)

    return trimmed(run)


def _linked(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            u, v, x, y = b.columns
            keep = []
            for k in range(b.num_rows):
                p, q = np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                o = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if _linked(o, len(p), len(q), percent):
                    keep.append(k)
            if keep:
                yield pa.RecordBatch.from_arrays([u.take(pa.array(keep)), v.take(pa.array(keep))], schema=_LINKS)

    return trimmed(run)


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


def answers(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links enough to connect whatever links connect: between `left` and `right`, or within `left` if right is None. Sets are sorted hash arrays; right's are
    numbered after left's. `joined` labels sets that are known to be connected (left's, then right's)."""
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    if not left or not other:
        return []
    sizes = np.array([len(s) for s in other], np.int64)
    owner = np.repeat(np.arange(len(other)), sizes)
    grams = np.concatenate(other)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    keys, lengths = grams[starts], np.diff(np.append(starts, len(grams)))

    def lists(s: np.ndarray) -> np.ndarray:
        """The sets that hold each gram of s, one after the other."""
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        at = at[keys[at] == s]
        k = lengths[at]
        if not k.sum():
            return np.zeros(0, np.int64)
        return owner[np.repeat(starts[at] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]

    forest, out = _Forest(len(left) + (0 if right is None else len(right))), []
    if joined is not None:
        _, first, label = np.unique(joined, return_index=True, return_inverse=True)
        forest.up = first[label]
    known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # answered sets: grams, overlaps, distances
    for i, s in enumerate(left):
        roots = forest.roots()
        if (roots[shift : shift + len(other)] == roots[i]).all():
            continue
        best, spare = None, None
        for grams_of, overlaps, distance in known:
            o = int((grams_of[np.minimum(np.searchsorted(grams_of, s), len(grams_of) - 1)] == s).sum())
            differ = len(s) + len(grams_of) - 2 * o
            if spare is None or differ < spare:
                best, spare, best_o = (grams_of, overlaps, distance), differ, o
        if best is not None:
            gap = 1 - best_o / (len(s) + len(best[0]) - best_o)
            near = np.flatnonzero(best[2] <= gap + (100 - percent) / 100 + 1e-9)  # no other set can link with this one
            if not len(near) or (roots[near + shift] == roots[i]).all():
                continue
        if best is not None and 2 * spare < len(s):
            g = best[0]
            overlap = best[1] + np.bincount(lists(np.setdiff1d(s, g, True)), minlength=len(other)) - np.bincount(lists(np.setdiff1d(g, s, True)), minlength=len(other))
        else:
            overlap = np.bincount(lists(s), minlength=len(other))
        if best is None or (2 * spare >= len(s) and len(known) < 24):
            known.append((s, overlap, 1 - overlap / np.maximum(1, len(s) + sizes - overlap)))
        hits = np.flatnonzero(_linked(overlap, len(s), sizes, percent))
        hits = hits[roots[hits + shift] != roots[i]]
        if len(hits):
            _, first = np.unique(roots[hits + shift], return_index=True)
            for h in hits[first]:
                out.append((i, int(h) + shift))
            joined = np.unique(np.append(roots[hits + shift], roots[i]))
            up = roots.copy()
            up[np.isin(roots, joined)] = joined[0]
            forest.up = up
    return out


def _compare(percent: int):
    """Links of a pair of blocks (sides 0 and 1) or within one (side 0 alone), between the groups that their sets are known to be in."""

    def run(table: pa.Table) -> pa.Table:
        side, label = table["side"].to_numpy(), table["label"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"]]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        number = np.concatenate([one, two])
        found = answers([sets[k] for k in one], [sets[k] for k in two] if len(two) else None, percent, label[number])
        if table.nbytes > LARGE_GROUP:
            give_back()
        return pa.table({"u": pa.array([int(label[number[a]]) for a, _ in found], pa.int64()), "v": pa.array([int(label[number[b]]) for _, b in found], pa.int64())}, schema=_LINKS)

    return run


def _owned(members: DataFrame) -> DataFrame:
    """fp, n, owner: of a set's lists the longest, with the list's size."""
    lists = members.groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
    own = members.join(lists, "gram").groupBy("fp", "n").agg(F.max(F.struct("size", "gram")).alias("x"))
    return own.select("fp", "n", F.col("x.gram").alias("owner"), F.col("x.size").alias("size"))


def _dealt(sets: DataFrame, percent: int, *by: str) -> DataFrame:
    """Sets (fp, n and the columns `by`) with a block: sets of one key and of like sizes, at random."""
    kind = F.floor(F.log("n") / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n")
    keyed = sets.withColumn("kind", kind)
    cells = keyed.groupBy(*by, "kind").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("parts"))
    return keyed.join(cells, [*by, "kind"]).withColumn("block", F.xxhash64(*by, "kind", F.pmod(F.xxhash64("fp", F.lit(29)), "parts"))).drop("kind", "parts")


class _Groups:
    """What sets are joined so far: tables of (node, root), each of the roots of the one before."""

    def __init__(self, spark):
        self.spark, self.table = spark, spark.createDataFrame([], "node long, root long")

    def add(self, links: DataFrame) -> bool:
        """Takes links between roots; False if there are none."""
        new = connected(links)
        if new.isEmpty():
            removed(self.spark, new)
            return False
        before, old = self.table, self.table.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        self.table = written(old.union(new.join(self.table.select("node"), "node", "left_anti")), "groups")
        for x in (new, before):
            removed(self.spark, x)
        return True

    def label(self, sets: DataFrame) -> DataFrame:
        """Sets (fp and others) with the label of their group."""
        return sets.join(self.table.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")


_LINK, _SIDES = "u long, v long", ("side", "label", "grams")


def _inside(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within blocks, of sets with labels."""
    return dealt.join(sets, "fp").select("block", F.lit(0).alias("side"), "label", "grams").groupBy("block").applyInArrow(_compare(percent), _LINK)


def _join_blocks(members: DataFrame, dealt: DataFrame, sets: DataFrame, groups: _Groups, percent: int, scratch: Scratch) -> None:
    """Compares one representative of each group in each block with those of the other blocks of its lists, while there are long lists and that joins many."""
    many = members.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MANY).select("gram")
    if many.isEmpty():
        return
    held = members.join(many, "gram", "left_semi")
    before = None
    while True:
        some = groups.label(dealt.select("fp", "n", "block")).groupBy("block", "label").agg(F.min("fp").alias("fp"))
        lists = held.join(some.select("fp"), "fp", "left_semi")
        dealt = scratch.written(groups.label(_dealt(_owned(lists).select("fp", "n", "owner"), percent, "owner")), "dealt")
        left = dealt.count()
        if before is not None and 2 * left > before or left == 0 or not groups.add(_inside(dealt, sets, percent)):
            return
        before = left


def _apart(members: DataFrame, sets: DataFrame, groups: _Groups, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links between groups: in the lists that hold several, the blocks of sets outside the largest meet all blocks of the list."""
    labelled = groups.label(members)
    open_lists = labelled.groupBy("gram").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("gram")
    own = scratch.written(labelled.join(open_lists, "gram", "left_semi"), "open")
    if own.isEmpty():
        return None
    owned = groups.label(_owned(own.drop("label")).select("fp", "n", "owner"))
    largest = owned.groupBy("owner", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("owner").agg(F.max(F.struct("c", F.col("label"))).alias("x")).select("owner", F.col("x.label").alias("most"))
    # A block holds sets of the owner's largest group alone (whole: its label), or of others (whole: null).
    flagged = owned.join(largest, "owner").withColumn("main", F.col("label") == F.col("most"))
    dealt = scratch.written(_dealt(flagged.select("fp", "n", "owner", "main", "label"), percent, "owner", "main"), "dealt")
    placed = own.select("gram", "fp", "n", "pos").join(dealt.select("fp", "block", F.when(F.col("main"), F.col("label")).alias("whole")), "fp")
    lists = scratch.written(placed.groupBy("gram", "block", "whole").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("pos")), "lists")
    main = lists.where("whole is not null").groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("c")).groupBy("gram").agg(F.max(F.struct("c", F.col("whole"))).alias("x")).select("gram", F.col("x.whole").alias("main"))
    few = lists.join(main, "gram", "left").where("whole is null or whole <> main").drop("main")
    x, y = few.select("gram", *(F.col(c).alias(f"x_{c}") for c in ("block", "whole", "least", "most", "pos"))), lists.select("gram", *(F.col(c).alias(f"y_{c}") for c in ("block", "whole", "least", "most", "pos")))
    small = F.least("x_least", "y_least")
    met = x.join(y, "gram").where(
        "x_whole is null or y_whole is null or x_whole <> y_whole"
    ).where(
        # Sizes too far apart, or positions that leave too few n-grams for the overlap needed, cannot link.
        (100 * F.col("x_most") >= percent * F.col("y_least")) & (100 * F.col("y_most") >= percent * F.col("x_least")) & (F.least(F.col("x_most") - F.col("x_pos"), F.col("y_most") - F.col("y_pos")) >= F.ceil(percent * (small + F.greatest("x_least", "y_least")) / (100 + percent)))
    )
    pairs = scratch.written(met.select(F.least("x_block", "y_block").alias("a"), F.greatest("x_block", "y_block").alias("b")).distinct(), "meets")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).union(pairs.where("a <> b").select("a", "b", F.lit(1), "b"))
    return sides.join(dealt.select("fp", "block", "label"), "block").join(sets, "fp").select("a", "b", "side", "label", "grams").groupBy("a", "b").applyInArrow(_compare(percent), _LINK)


def set_groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of all fingerprints that link with another: the smallest of their component."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = docs.select(F.lit(0).alias("row_id"), text_column(docs).alias("text"))
    counts = text.mapInArrow(_first_grams(width, percent), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)
    found = counts.orderBy(F.col("c").desc(), "gram").limit(MOST_FREQUENT).select("gram").toArrow()["gram"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(found.view(np.uint64)))
    postings = written(text.mapInArrow(_postings(width, percent, frequent), "gram long, n int, fp long, pos int"), "postings")
    # Long lists are told by their counts before any list is gathered, so the key of a long one is never dealt to one task.
    long = scratch.written(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SHORT_LIST).select("gram"), "long")
    members = scratch.written(postings.join(long, "gram", "left_semi").groupBy("gram", "fp", "n").agg(F.min("pos").alias("pos")), "members")
    short = postings.join(long, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "n", "fp")
    pairs = scratch.written(short.mapInArrow(_pairs(percent), "a long, b long").distinct(), "pairs")
    removed(spark, postings)
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(members.select("fp")).distinct()
    few = needed.limit(MOST_BROADCAST + 1).toArrow()["fp"].to_numpy()
    if len(few) <= MOST_BROADCAST:
        sets = text.mapInArrow(_some_sets(width, spark.sparkContext.broadcast(np.sort(few))), "fp long, grams binary")
    else:
        sets = text.mapInArrow(_some_sets(width, None), "fp long, grams binary").join(needed, "fp", "left_semi")
    sets = scratch.written(sets.groupBy("fp").agg(F.any_value("grams").alias("grams")), "sets")
    checked = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    links = checked.select("a", "b", "x", "y").mapInArrow(_verify(percent), _LINK)
    groups = _Groups(spark)
    if members.isEmpty():
        groups.add(links)
    else:
        dealt = scratch.written(_dealt(_owned(members).select("fp", "n", "owner"), percent, "owner"), "dealt")
        groups.add(links.union(_inside(dealt.withColumn("label", F.col("fp")), sets, percent)))
        _join_blocks(members, dealt, sets, groups, percent, scratch)
        if (more := _apart(members, sets, groups, percent, scratch)) is not None:
            groups.add(more)
    scratch.close()
    return groups.table


def _components(documents: DataFrame, width: int, percent: int, id_col: str) -> DataFrame:
    """A row a document: row_id, text_hash, n, and the component."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("row_id"), text_column(documents).alias("text"))
    rows = written(docs.select("row_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_documents(width), "row_id long, text_hash long, n long, fp long"), "rows")
    roots = set_groups(docs, width, percent)
    per_set = rows.where("fp is not null").groupBy("fp").agg(F.min("row_id").alias("least"))
    joined = per_set.join(roots, per_set.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    some = rows.where("fp is not null").join(named, "fp").select("row_id", "text_hash", "n", "component_id")
    return some.unionByName(rows.where("fp is null").select("row_id", "text_hash", "n", F.col("row_id").alias("component_id")))


def jaccard_components(documents: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id") -> DataFrame:
    """Every row's id, n_shingles (size of its n-gram set) and component_id (smallest id reachable by links, its own included).

    A null or empty text, or one of white space, has an empty set: size 0, linked with nothing, component_id its own id. Fewer
    than `width` words make one n-gram of them all. Repeated rows link with each other like any copies. A null id stays null
    unless its component has another. An empty table gives an empty table; other columns are ignored.
    """
    return _components(documents, width, percent, id_col).select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def first_of_each(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """One row of each component: that of the smallest id (of several texts with that id in the component, one of them).

    Rows with a null id stay, as do rows whose text is null, empty or white space, but for exact repetitions of id and text. Columns as given; an empty
    table gives an empty table.
    """
    own, first, text_hash = (free(x, documents) for x in ("__own", "__first", "__hash"))
    parts = _components(documents, width, percent, id_col).where("row_id is not null and row_id = component_id")
    kept = parts.groupBy(F.col("component_id").alias(first), F.when(F.col("n") == 0, F.col("text_hash")).alias("empty")).agg(F.min("text_hash").alias(text_hash))
    named = documents.where(F.col(id_col).isNotNull()).withColumn(own, F.xxhash64(text_column(documents)))
    out = named.join(kept, (F.col(id_col).cast("long") == F.col(first)) & (F.col(own) == F.col(text_hash)), "left_semi")
    if not named.groupBy(id_col).count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, own])
    return out.drop(own).union(documents.where(F.col(id_col).isNull()))


#: DuckDB SQL for jaccard_components with words of four and 85 percent.
JACCARD_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON c.a = d.doc_id
"""
