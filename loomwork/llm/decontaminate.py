"""Benchmark decontamination: edit-distance search for benchmark items inside documents.

Texts are compared lower-cased, with runs of ASCII characters other than letters and digits as one space, character by character.

* *CGK embedding.* A random walk over a text's characters (advance or repeat, by a random bit for step and character) maps
  edit distance to Hamming distance. Walks begin at every word of items and documents, and at every character of scripts without
  spaces and of very long words; all are walked with the same bits, WALKS times.
* *Bit sampling.* From each walk SAMPLES signatures of BITS sampled steps, spread over it, are looked up among those of all items: the tables alone
  name the item, and the place in it, that the text at hand may be a copy of. Walks are STEPS long, not as long as the item: over
  a whole item with an edit every few characters hardly any walk stays in step.
* *Verification.* Of each collision the item's piece of up to 64 characters around it is compared first (an item within the
  tolerance has a piece within it), then the exact edit distance of the item against any substring of the surroundings.

Items of fewer than SHORT characters are too short for such walks: one more piece than they may have edits is looked up verbatim at
every character, which misses none. In scripts with spaces they count only as words of their own:
a letter joined to their ends counts as an edit.

The benchmark is read in blocks of at most MOST_ITEMS items and MOST_CHARS characters, which bounds what is broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import new_path, prepare, removed, text_column, trimmed, written

#: An item is found where its edit distance is at most this share of its length.
TOLERANCE = 0.2
WALKS, SAMPLES, BITS, STEPS = 2, 4, 8, 32
#: Characters of a piece, edits at which it is given up, and how far it may be off its place; the length under which an item is short.
PIECE, PIECE_SHARE, DRIFT, SHORT = 64, 0.28, 20, 48
#: Characters of a word after which each is a place of its own.
LONG_WORD = 16
CHUNK = 1 << 13
#: Collisions that are held before their pieces are compared.
HELD = 1_000_000
MOST_ITEMS, MOST_CHARS = 20_000, 16_000_000

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[[*range(48, 58), *range(97, 123)]] = False
_SPLIT = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normal(text: str | None) -> bytes:
    """As documents are compared: lower-cased by the same rules, runs of other ASCII characters as one space."""
    low = pc.utf8_lower(pa.scalar(text or "", pa.large_string())).as_py()
    return b" ".join(x for x in _SPLIT.split(low.encode()) if x)


def edit_search(item: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of item to any substring of text, and where the first such substring ends (Myers's bit vectors)."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        masks[c] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j
    return best, at


_BITS = np.stack([np.random.default_rng(1000 + w).integers(0, 2, (STEPS, 256), np.int64) for w in range(WALKS)])
#: The sampled steps, one of each eighth of a walk.
_PICKS = [[np.arange(BITS) * STEPS // BITS + np.random.default_rng(7919 * w + j).integers(0, STEPS // BITS, BITS) for j in range(SAMPLES)] for w in range(WALKS)]
#: Scripts that are written without spaces: Thai to Burmese, Khmer, kana and Han.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def symbols(code: np.ndarray) -> np.ndarray:
    """A byte for each character: ASCII as it is, others hashed to the upper half."""
    return np.where(code < 128, code, 128 + (code * np.uint32(0x9E3779B1) >> np.uint32(25))).astype(np.uint8)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unspaced(code: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([(code >= a) & (code <= b) for a, b in _UNSPACED])


def places(code: np.ndarray) -> np.ndarray:
    """Where walks begin."""
    n = len(code)
    gap = code == 32
    begins = ~gap
    begins[1:] &= gap[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return at
    ends = np.append(at[1:], n)
    more = [at]
    for k in np.flatnonzero(ends - at > LONG_WORD).tolist():
        more.append(np.arange(at[k] + LONG_WORD, ends[k]))
    if (code >= _UNSPACED[0][0]).any():
        more.append(np.flatnonzero(unspaced(code)))
    if len(more) > 1:
        at = np.unique(np.concatenate(more))
    return at[~gap[at]]


def signatures(symbol: np.ndarray, begin: np.ndarray):
    """Yields, for each walk and sample, the signatures of all walks and the last character that each was drawn from. All walks advance together, a step at a time."""
    for w in range(WALKS):
        at = begin.copy()
        seen, spots = [], []
        for j in range(STEPS):
            c = symbol.take(at, mode="clip")
            seen.append(c)
            spots.append(at.copy())
            at += _BITS[w, j].take(c)
        for k, picks in enumerate(_PICKS[w]):
            out = np.empty((len(begin), BITS), np.uint8)
            for b, j in enumerate(picks):
                out[:, b] = seen[j]
            key = out.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15) + np.uint64((w * SAMPLES + k) * 0xD1342543DE82EF95 % (1 << 64))
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            yield key, spots[picks[-1]]


def grams(code: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of `size` characters."""
    n = max(0, len(code) - size + 1)
    key = np.full(n, size, np.uint64)
    for k in range(size):
        key = (key ^ code[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key * np.uint64(0xBF58476D1CE4E5B9)


def piece_distances(pattern: np.ndarray, which: np.ndarray, size: np.ndarray, text: np.ndarray, begin: np.ndarray, span: int) -> np.ndarray:
    """Smallest edit distance of each pattern (a row of at most 64 symbols, `size` of them) to any substring of `span` symbols from `begin` (Myers's bit vectors, side by side)."""
    one = np.uint64(1)
    masks = np.zeros((len(pattern), 256), np.uint64)
    row = np.arange(len(pattern))
    for k in range(pattern.shape[1]):
        live = size > k
        masks[row[live], pattern[live, k]] |= np.uint64(1 << k)
    flat, base, top = masks.ravel(), which * 256, (size[which] - 1).astype(np.uint64)
    n = len(which)
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), top + one
    best, at = score.copy(), begin.copy()
    xv, xh, ph = np.empty((3, n), np.uint64)
    for _ in range(span):
        eq = flat.take(base + text.take(at, mode="clip"))
        at += 1
        np.bitwise_or(eq, down, out=xv)
        np.bitwise_and(eq, up, out=xh)
        xh += up
        xh ^= up
        xh |= eq
        np.bitwise_or(xh, up, out=ph)
        np.invert(ph, out=ph)
        ph |= down
        xh &= up  # the falls
        score += np.right_shift(ph, top, out=eq).__iand__(one)
        score -= np.right_shift(xh, top, out=eq).__iand__(one)
        np.minimum(best, score, out=best)
        ph <<= one
        xh <<= one
        np.bitwise_and(ph, xv, out=down)
        np.bitwise_or(xv, ph, out=up)
        np.invert(up, out=up)
        up |= xh
    return best.astype(np.int64)


@dataclass
class Table:
    """Sorted keys, each with an item and a place in it, behind a bitmap."""

    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys, item, place) -> Table:
        keys, item, place = np.concatenate(keys), np.concatenate(item).astype(np.int32), np.concatenate(place).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        shift = 64 - min(25, max(16, int(len(keys)).bit_length() + 4))
        seen = np.zeros(1 << (64 - shift), bool)
        seen[(keys >> np.uint64(shift)).astype(np.int64)] = True
        return cls(keys[order], item[order], place[order], seen, shift)

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(index into keys, item, place) of all that agree, in parts of about HELD (those of one key stand together)."""
        spots = np.flatnonzero(self.seen[(keys >> np.uint64(self.shift)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, keys[spots], "left"), np.searchsorted(self.keys, keys[spots], "right")
        some = hi > lo
        spots, lo, n = spots[some], lo[some], (hi - lo)[some]
        part = (np.cumsum(n) - n) // HELD
        for k in range(int(part[-1]) + 1 if len(part) else 0):
            a, b = np.searchsorted(part, [k, k + 1])
            m = n[a:b]
            at = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(spots[a:b], m), self.item[at], self.place[at]


@dataclass
class Index:
    """A block of items, ready to be looked up."""

    ids: list[int]
    texts: list[str]
    symbol: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    #: Whether an item begins, and ends, in a script with spaces.
    edges: np.ndarray
    walked: Table | None = None
    short: dict[int, Table] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        kept = [(i, t.decode()) for i, text in items if (t := normal(text))]
        length = np.array([len(t) for _, t in kept], np.int64)
        # A space before each item and after it: those of short items are compared.
        code = codes("".join(f" {t} " for _, t in kept))
        begin = np.cumsum(length + 2) - length - 1
        out = cls([i for i, _ in kept], [t for _, t in kept], symbols(code), begin, length, ~unspaced(code[np.stack([begin, begin + length - 1])]))
        at = places(code)
        if len(at):
            item = np.searchsorted(begin, at, "right") - 1
            at, item = at[length[item] >= SHORT], item[length[item] >= SHORT]
        if len(at):
            keys, items_of, place = [], [], []
            for key, last in signatures(out.symbol, at):
                whole = last < begin[item] + length[item]
                keys.append(key[whole])
                items_of.append(item[whole])
                place.append((at - begin[item])[whole])
            out.walked = Table.of(keys, items_of, place)
        pieces = defaultdict(lambda: ([], [], []))
        for k in np.flatnonzero(length < SHORT).tolist():
            n, m = int(TOLERANCE * length[k]) + 1, int(length[k])
            if n == 1:  # as words of their own
                starts, size = [-int(out.edges[0, k])], m + int(out.edges[:, k].sum())
            else:
                starts, size = [j * m // n for j in range(n)], m // n
            own = grams(code[begin[k] - 1 : begin[k] + m + 1], size)
            for j in starts:
                for x, v in zip(pieces[size], (own[j + 1], k, j)):
                    x.append([v])
        out.short = {size: Table.of([np.array(x, np.uint64) for x in keys], item, place) for size, (keys, item, place) in pieces.items()}
        return out

    def collisions(self, code: np.ndarray, symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, place in the item) of all collisions, some more than once."""
        if self.walked is not None:
            at = places(code)
            for k in range(0, len(at), CHUNK):
                begin = at[k : k + CHUNK]
                for key, _ in signatures(symbol, begin):
                    for spot, item, place in self.walked.find(key):
                        yield begin[spot], item, place
        for size, table in self.short.items():
            yield from table.find(grams(code, size))

    def candidates(self, code: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item) of the collisions around which the item's piece is near the text. A stock phrase of many items gives many collisions; no more than about HELD are kept at a time."""
        out, held, size = [], [], 0

        def compared():
            at, item, place = (np.concatenate(x).astype(np.int64) for x in zip(*held))
            # Of one diagonal, one collision for each piece of the item.
            key = np.stack([item, at - place, self.pieces(item, place)])
            order = np.lexsort(key)
            key = key[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            order = order[new]
            at, item, place = at[order], item[order], place[order]
            close = self.near(symbol, at, item, place)
            return at[close], item[close], place[close]

        for found in self.collisions(code, symbol):
            if len(found[0]):
                held.append(found)
                size += len(found[0])
                if size >= HELD:
                    out.append(compared())
                    held, size = [], 0
        if held:
            out.append(compared())
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def pieces(self, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where in its item the piece around a place begins; a short item is one piece, with the spaces around it if its script has them."""
        m = self.length[item]
        return np.where(m < SHORT, -self.edges[0, item].astype(np.int64), np.maximum(0, np.minimum(place // PIECE * PIECE, m - PIECE)))

    def near(self, symbol: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the piece around each collision is near the text there."""
        out = np.zeros(len(at), bool)
        start = self.pieces(item, place)
        short = self.length[item] < SHORT
        size = np.where(short, self.length[item] + self.edges[:, item].sum(axis=0), np.minimum(self.length[item], PIECE))
        most = np.where(short, (TOLERANCE * self.length[item]).astype(np.int64), (PIECE_SHARE * size).astype(np.int64) + 1)
        for k in range(0, len(at), CHUNK):
            part = slice(k, k + CHUNK)
            first, which = np.unique(self.begin[item[part]] + start[part] << 8 | size[part], return_inverse=True)
            own, width = first >> 8, first & 255
            pattern = self.symbol.take(own[:, None] + np.arange(int(width.max())), mode="clip")
            out[part] = piece_distances(pattern, which, width, symbol, np.maximum(0, at[part] - place[part] + start[part] - DRIFT), int(width.max()) + 2 * DRIFT) <= most[part]
        return out

    def find(self, column: pa.Array):
        """Yields (row, item id, distance, item's length) for the rows of a text column, the smallest distance of each item."""
        data, offsets = K.text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
        for first, stop in K.blocks(offsets):
            part = offsets[first : stop + 1]
            if not self.ids or part[-1] == part[0]:
                continue
            text, rows = joined(data[part[0] : part[-1]], part - part[0])
            code = codes(text)
            symbol = symbols(code)
            at, item, place = self.candidates(code, symbol)
            row = np.searchsorted(rows, at + (place < 0), "right") - 1
            # Neighbouring diagonals are searched once.
            diagonal = at - place
            order = np.lexsort((diagonal, item, row))
            found: dict[tuple[int, int], int] = {}
            last, until = None, 0
            for r, i, d in zip(row[order].tolist(), item[order].tolist(), diagonal[order].tolist()):
                slack = int(TOLERANCE * self.length[i]) + 1
                if (r, i) == last and d <= until or found.get((r, i)) == 0:
                    continue
                last, until = (r, i), d + slack
                own = self.texts[i]
                distance, _ = edit_search(own, text[max(int(rows[r]), d - slack) : min(int(rows[r + 1]) - 1, until + len(own) + slack)])
                if distance <= TOLERANCE * len(own) and distance < found.get((r, i), 1 << 60):
                    found[r, i] = distance
            for (r, i), distance in sorted(found.items()):
                yield first + r, self.ids[i], distance, len(self.texts[i])


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray]:
    """The lower-cased rows as one text, compared characters alone and a space before and after each, and where each row begins (and the text ends)."""
    rows = offsets + np.arange(len(offsets))
    raw = np.zeros(len(data) + len(offsets), np.uint8)
    word = np.ones(len(raw), bool)
    word[rows] = False
    raw[word] = data
    word = ~_GAP[raw]
    keep = word.copy()
    keep[0] = True
    keep[1:] |= word[:-1]  # one space after a word
    begin = keep & (raw & 0xC0 != 0x80)
    raw[~word] = 32
    return raw[keep].tobytes().decode(errors="replace"), np.cumsum(begin)[rows]


def item_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark, block by block, as it streams to the driver."""
    block, chars = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column(benchmark).alias("text")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) >= MOST_ITEMS or chars + len(r.text) > MOST_CHARS):
            yield Index.of(block)
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    yield Index.of(block)


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_chars", pa.int64())])


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_chars, similarity: every item found in every row, with its smallest edit distance.

    Null or empty texts hold nothing, null or empty items are not searched; equal items are found each. Repeated rows are
    reported each; a null doc_id is reported as null. Empty tables give an empty table; extra columns are ignored. Of a benchmark
    of several blocks each block's findings are written before the next is sent out.
    """
    spark = documents.sparkSession
    prepare(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(documents).alias("text"))
    path, kind, own, shared = None, "doc_id long, item_id long, distance long, item_chars long", None, None
    for index in item_blocks(benchmark):
        if own is not None:
            path = path or new_path(spark, "leaks")
            own.write.mode("append").parquet(path)
            shared.destroy()
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                found = list(shared.value.find(b.column(1)))
                if found:
                    row, item, distance, size = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(distance, pa.int64()), pa.array(size, pa.int64())], schema=_LEAKS)

        own = rows.mapInArrow(trimmed(run), kind)
    out = own if path is None else own.union(spark.read.schema(kind).parquet(path))
    return out.withColumn("similarity", 1 - F.col("distance") / F.col("item_chars"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no item is found, columns as given.

    Rows with a null or empty text, and with a null doc_id, are judged by their text like any: the former stay. Repeated rows stay or go each. An
    empty table gives an empty table, an empty benchmark all rows. What a block of a larger benchmark leaves is written before
    the next is sent out.
    """
    spark = documents.sparkSession
    prepare(spark)
    out, text, shared, before = documents, documents.columns.index("text"), None, None
    for index in item_blocks(benchmark):
        if shared is not None:
            out = written(out, "clean")
            shared.destroy()
            if before is not None:
                removed(spark, before)
            before = out
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, *_ in shared.value.find(b.column(text).cast(pa.string())):
                    keep[row] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(trimmed(run), documents.schema)
    return out
