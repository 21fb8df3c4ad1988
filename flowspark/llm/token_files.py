"""Token ids in Parquet list columns that can be read in parts.

Documents are dealt by ranges of doc_id, sorted, encoded and written: one file per range, rows in
ascending doc_id order, ids as a list column with dictionary pages, doc_id, lengths and positions
delta-encoded (format version 2), row groups and pages of set sizes, and page indexes, so that a
reader takes only metadata columns, or only the pages of some documents.

Encoding is the library's, of whole texts.  White space never joins the word before it, so a text
is cut before each run of it, and a piece that was met before is not encoded again; pieces are
remembered up to a bound per worker, until it turns to other work (``common.kept_for``).  Words that
are new go to the library many to a text, as most of the time of a short text is its own result.

Defined cases: null text is empty and holds the end id alone; null doc_ids come first; equal
doc_ids are ordered by the text's hash, then exact repeats stand side by side, each with its own
row and start; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.common import kept_for, materialized

SCHEMA = "doc_id long, n_tokens long, tokens array<int>"
#: Pieces that a worker remembers, and bytes of text of a batch; other pieces are encoded once per batch.
REMEMBERED, TEXT = 700_000, 4 << 20
#: Pieces that the library encodes at once: its results are many times as large as the ids; pieces of one text.
AT_ONCE, JOINED = 2048, 64
#: Cutting at blanks is exact where white space stands alone; else before each run of it.
_RUNS = re.compile(r"\s\s|[\0\x1c-\x1f]")
_ODD = re.compile("[\0\x1c-\x1f]")
_PIECES = re.compile(r"\s*\S+|\s+")
#: The same as _RUNS for Arrow, whose classes are of ASCII.
_ARROW_RUNS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|[\x{0}\x{1c}-\x{1f}]"
#: Name of the end of a text; no other piece has it.
_END = "\x1c"


def pieces_of(text: str, added: re.Pattern | None = None) -> list[str]:
    """Cuts whose encodings, one after the other, are the encoding of the text.

    A piece that begins with a blank is named by what follows the blank, any other by a zero
    character and itself.  A text with one of the tokenizer's ``added`` tokens is one piece.
    """
    if not text:
        return []
    if added is not None and added.search(text):
        return ["\0" + text]
    if _RUNS.search(text):
        cuts = [text] if _ODD.search(text) else _PIECES.findall(text)
        return [c[1:] if c[0] == " " and not _ODD.search(c) else "\0" + c for c in cuts]
    parts = text.split(" ")
    if parts[0]:
        parts[0] = "\0" + parts[0]
    else:
        del parts[0]
    return parts


class Encoder:
    """Ids of texts; equal pieces are encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [re.escape(t.content) for t in sorted(self.tokenizer.get_added_tokens_decoder().values(), key=lambda t: len(t.content), reverse=True)]
        self.added = re.compile("|".join(names)) if names else None
        self.odd = "|".join([_ARROW_RUNS, *names])
        vocab = self.tokenizer.get_vocab()
        self.after_blank = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.after_blank[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.numbers = {_END: 0}
        self.known = pa.array([[0]], pa.list_(pa.int32()))  # the ids of each number; the first is the end's

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of the texts, without the offsets in them."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space at their ends, each after a blank, and their numbers.

        They are encoded as texts of many words: a word begins where a token begins with a blank.
        """
        texts = [" " + " ".join(words[j : j + JOINED]) for j in range(0, len(words), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._ids(texts)), np.int32)
        at = np.flatnonzero(self.after_blank[ids])
        if len(at) != len(words) or self.added and any(map(self.added.search, texts)):
            return self._apart([" " + w for w in words])
        return ids, np.diff(at, append=len(ids))

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self._ids(texts)
        return np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _encode(self, words: list[str], others: list[str]) -> pa.ListArray:
        """Ids of each of the pieces."""
        done = [self._words(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)]
        done += [self._apart([p[1:] if p[:1] == "\0" else " " + p for p in others[k : k + AT_ONCE]]) for k in range(0, len(others), AT_ONCE)]
        ends = np.cumsum(np.concatenate([[0], *(n for _, n in done)]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(i for i, _ in done)])))

    def _pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of all texts, each text with its end, and the number of each text's."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        marked = pc.binary_join_element_wise("\0", texts if not odd.any() else texts.filter(pa.array(~odd)), " " + _END, "")
        parts = pc.split_pattern(marked, " ")
        sizes, pieces = np.diff(np.asarray(parts.offsets)), parts.flatten()
        if not odd.any():
            return pieces.dictionary_encode(), sizes
        others = [[*pieces_of(t, self.added), _END] for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes = np.concatenate([sizes, np.fromiter(map(len, others), np.int64)])
        text = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        pieces = pa.concat_arrays([pieces, pa.array(chain.from_iterable(others), pieces.type)]).dictionary_encode()
        order = np.argsort(np.repeat(text, sizes), kind="stable")
        return pa.DictionaryArray.from_arrays(pieces.indices.take(pa.array(order)), pieces.dictionary), sizes[np.argsort(text)]

    def encode(self, texts: pa.Array | list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with ``end_id`` after each text, and the number of each text's."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pieces, sizes = self._pieces(texts)
        numbers, names = self.numbers, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in names if p not in numbers]
        words, others = [], []
        for p in new:
            (words if p and p[0] != "\0" and not p[0].isspace() and not p[-1].isspace() else others).append(p)
        new = words + others
        numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
        place = np.fromiter(map(numbers.__getitem__, names), np.int32, len(names))[np.asarray(pieces.indices)]
        known = pa.concat_arrays([self.known, self._encode(words, others)]) if new else self.known
        if len(numbers) <= REMEMBERED and len(known.values) <= 8 * REMEMBERED:  # pieces may be long
            self.known = known
        else:
            for p in new:
                del numbers[p]
        found = known.take(pa.array(place))
        ids, at = np.array(found.values), np.asarray(found.offsets)
        last = np.cumsum(sizes)
        ids[at[last] - 1] = end_id
        return ids, np.diff(at[last], prepend=0).astype(np.int64)


def encoder(path: str) -> Encoder:
    return kept_for(("tokens", path), lambda: Encoder(path))


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, n_tokens, tokens`` of every row, in the order of the rows."""

    def run(batches):
        for batch in batches:
            upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(upto // TEXT)) + 1).tolist(), batch.num_rows]
            for first, end in pairwise(cuts):
                part = batch.slice(first, end - first)
                ids, sizes = encoder(tokenizer).encode(part.column("text"), end_id)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), lists], ["doc_id", "n_tokens", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, files: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10, page_rows: int = 200) -> None:
    """Writes the documents' ids to ``path``; ``files`` defaults to the session's shuffle partitions."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    options = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd",
    }
    encode(dealt, tokenizer, end_id).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, start`` and place of every document, without reading ids.

    Starts are sums within a file on top of the sums of the files before it; one row per file is
    summed along the files.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_sum"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select("doc_id", "n_tokens", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "file", "row")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, n_tokens, tokens``; with ``doc_ids`` the filter reaches row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, ids_crc32`` from the ids in the files."""
    rows = spark.read.schema(SCHEMA).parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "tokens")

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            ids, ends = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), pa.array(sums, pa.int64())], ["file", "row", "ids_crc32"])

    return rows.mapInArrow(run, "file string, row long, ids_crc32 long")


def token_table(docs: DataFrame, path: str, *, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files, reads them back: ``doc_id, start, n_tokens, ids_crc32, file, row``."""
    write_tokens(docs, path, tokenizer=tokenizer, end_id=end_id)
    spark = docs.sparkSession
    meta = materialized(read_metadata(spark, path), "tokens-meta")
    return meta.join(digests(spark, path), ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "row")
