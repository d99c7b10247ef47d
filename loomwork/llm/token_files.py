"""Token-id files: Parquet with a list column of ids, delta or dictionary encoded, small row groups and page indexes.

Documents are range-partitioned by id, so the files in order of their `part` column hold ascending ids; `local_start` counts
the ids before a document in its part. Readers can take the counts, or the ids of some documents, without the rest.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, prepare, text_column, trimmed
from .kernels import blocks, text_buffer

END = 1
#: Words whose ids a worker remembers, and their letters and ids in bytes: two generations of half as many.
REMEMBERED, REMEMBERED_BYTES = 700_000, 40 << 20
#: Text encoded at once.
BLOCK_BYTES = 6 << 20
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 1 << 18, 512

_STOP = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])([ \n])"
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

_tokenizers: dict = {}


class WordEncoder:
    """Encodes texts with a tokenizers file that drops white space: words between blanks are encoded on their own and remembered, which gives the ids of the whole text.

    A sentence's full stop or comma is a token run of its own, so it is cut off the word. New words of plain letters are one run each
    and go through the library together, as one text: the vocabulary marks the ids that end a run.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-cased Latin-1 letters the file's normalizer and pattern change nothing, so a plainer front of the same model serves.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        for k in range(0, len(plain), 2048):
            some = plain[k : k + 2048]
            ids = np.array(self.letters.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some) or cut[-1] != len(ids):
                raise ValueError("the tokenizer does not keep words of letters apart")
            raw, cut = ids.tobytes(), (4 * cut).tolist()
            self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut))))
        other = [w for w in words if w not in self.known]
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. The younger generation becomes the older one where it is full, and what is used of that comes back."""
        own = list(map(self.known.get, words))
        gaps = [k for k, x in enumerate(own) if x is None]
        if gaps:
            missing = [words[k] for k in gaps]
            if self.older:
                back = {w: x for w in missing if (x := self.older.get(w)) is not None}
                self.known |= back
                missing = [w for w in missing if w not in back]
            self.learn(missing)
            for k in gaps:
                own[k] = found = self.known[words[k]]
                self.bytes += len(words[k]) + len(found)
            if 2 * len(self.known) > REMEMBERED or 2 * self.bytes > REMEMBERED_BYTES:
                self.older, self.known, self.bytes = self.known, {}, 0
        return own

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by `end`, and the texts' offsets into them."""
        text = pc.replace_substring_regex(column.cast(pa.large_string()).fill_null(""), _STOP, r"\1 \2\3")
        split = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
        word = split.flatten().dictionary_encode()
        used = word.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = self.ids_of(used)
        own.append(np.array([end], "<u4").tobytes())
        flat, size = np.frombuffer(b"".join(own), "<i4"), np.array([len(x) // 4 for x in own], np.int32)
        first = np.cumsum(size, dtype=np.int32) - size
        last = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        index = np.insert(word.indices.to_numpy(), last, len(used))
        del text, split, word, own, used
        lengths = size[index]
        total = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        # A block's ids are far fewer than 2**31, so places in it are 32 bits wide.
        spot = np.repeat(first[index] - total[:-1].astype(np.int32), lengths)
        spot += np.arange(total[-1], dtype=np.int32)
        return flat[spot], total[np.concatenate([[0], last + np.arange(1, len(last) + 1)])]


def encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BLOCK_BYTES: words are looked up once a batch."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for whole in _gathered(batches):
            _, at = text_buffer(whole.column(1))
            for start, stop in blocks(at, BLOCK_BYTES):
                b = whole.slice(start, stop - start)
                ids, offsets = own.encode(b.column(1), END)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), lists], schema=_SCHEMA)
                before += int(offsets[-1])

    return trimmed(run)


def write_token_files(documents: DataFrame, path: str, tokenizer: str) -> None:
    """Writes doc_id, part, local_start, n_tokens and ids of every row, in ascending doc_id order (null first, ties by text)."""
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(documents).alias("text"))
    rows = text.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(_encode(tokenizer), "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
    (
        rows.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .parquet(path)
    )


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids. The parts' totals are read from the counts alone."""
    files = spark.read.parquet(path)
    from pyspark.sql import Window

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for b in batches:
        ids = b.column(3)
        values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[at[k] : at[k + 1]].tobytes()) for k in range(len(ids))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_table(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the files.

    A null or empty text has the end id alone. Repeated rows are documents of their own; null doc_ids come first. An empty table gives an empty
    table; extra columns are ignored.
    """
    spark = documents.sparkSession
    prepare(spark)
    path = new_path(spark, "tokens")
    write_token_files(documents, path, tokenizer)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
