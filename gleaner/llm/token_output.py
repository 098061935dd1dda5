"""Token-ID output: Parquet files of list columns, written for selective reads.

Documents are dealt to files by ranges of doc_id, sorted, encoded, and written with the ids as a delta-encoded
list column (format version 2, no dictionary), in row groups and pages of a set size with page indexes. A
reader of lengths or offsets alone touches no ids; a reader of one document reads the pages that hold it.

Each row carries its file's number and its offset among the ids of that file; the sums of the files, a row
for each, give the offset among all ids.

Encoding: any tokenizer file of the tokenizers library serves. Where the file's own rules say that white space
is dropped and how words are cut (SPLITS_WORDS), a text is cut at ASCII white space and equal pieces of a slice
are encoded once: a piece's words of ASCII or Latin letters go straight to the merge table, other pieces, and
texts that hold a special token's string, go through the whole tokenizer. What was encoded is kept by the task,
up to a number of pieces. Files with other rules get whole texts, slice by slice.

Cases: null and empty texts have the end id alone. Equal ids keep the order of their rows in the input, and
their texts are written one after the other. A null id sorts first. An empty table makes files without rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded, frugal, scratch_path, slices, split_words
from gleaner.session import ship

END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 500
#: Pieces and words that a task keeps.
KEPT = 100_000

#: The normalizer and the pre-tokenizer of files whose texts may be cut at white space.
SPLITS_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_SIMPLE = re.compile(r"[!-~ß-öø-ÿ]*")


class Encoder:
    """The tokenizer of a file, piece by piece."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = tuple(json.loads(part.__getstate__()) if part else None for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.by_pieces = rules == SPLITS_WORDS and getattr(self.model, "dropout", None) is None
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                plain = word if word.isascii() else word.translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
            self.words[word] = ids
        return ids

    def _encode(self, pieces: list[str]) -> None:
        rest = []
        for piece in pieces:
            if piece.isascii() and piece.isalpha():
                self.pieces[piece] = self._word(piece)
            elif _SIMPLE.fullmatch(piece):
                self.pieces[piece] = b"".join(map(self._word, _PARTS.findall(piece)))
            else:
                rest.append(piece)
        if rest:
            for piece, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.pieces[piece] = np.array(found.ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END_ID after them, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_pieces:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ids = [np.array([*x, END_ID], np.uint32) for x in found]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)
        lower = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(lower, token, ignore_case=True).to_numpy(zero_copy_only=False)
        flat, starts = split_words(pc.ascii_trim_whitespace(lower))
        coded = flat.dictionary_encode()
        del lower, flat  # a slice's copies are let go as soon as may be: workers share the executor's memory
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces) > KEPT:  # what this slice has too is likely to come again
            self.pieces = {p: self.pieces[p] for p in pieces if p in self.pieces}
        if len(self.words) > KEPT // 2:  # a word that comes again is taken over from the older half
            self.older, self.words = self.words, {}
        found = list(map(self.pieces.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            self._encode([pieces[i] for i in missing])
            for i in missing:
                found[i] = self.pieces[pieces[i]]
        stored = pa.array([*found, np.uint32(END_ID).tobytes()], pa.large_binary())
        # after the last piece of each text comes the end: piece number len(pieces), one id long
        n = len(starts) - 1
        place = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
        place += np.arange(len(place), dtype=np.int32)
        order = np.full(len(place) + n, len(pieces), np.int32)
        order[place] = coded.indices.to_numpy()
        del coded, found, pieces, place
        _, offsets, data = stored.take(pa.array(order)).buffers()
        ends = np.frombuffer(offsets, np.int64, len(order) + 1)[starts + np.arange(n + 1)] // 4
        out = np.frombuffer(data, np.uint32, int(ends[-1])) if n else np.zeros(0, np.uint32)
        counts = np.diff(ends)
        if odd.any():  # a special token's string is matched in the text as it stands
            cut = np.split(out, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                cut[i] = np.append(self.whole(texts[i].as_py()), np.uint32(END_ID))
            out, counts = np.concatenate(cut), np.array([len(x) for x in cut])
        return out, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", 4000, 8 << 20):
                ids, counts = coder.encode(rows.column("text"))
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.record_batch([rows.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts), pa.array(counts), lists], ["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(ends[-1]) if len(ends) else 0

    return run


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None) -> None:
    """Encode docs (doc_id, text) into Parquet files under path, in ascending order of doc_id."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = max(1, rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    coded = rows.mapInArrow(frugal(_encode_rows(tokenizer or default_tokenizer())), "doc_id long, part int, at long, n_tokens long, ids array<int>")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.block.size": ROW_GROUP,
        "parquet.page.size": PAGE,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.page.write-checksum.enabled": "true",
    }
    coded.write.options(**options).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids."""
    rows = spark.read.schema("doc_id long, part int, at long, n_tokens long, ids array<int>").parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    firsts = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(bounded(firsts, 1_000_000), F.col("part") == F.col("p")).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        starts = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).view(np.uint8))
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, *, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs and read them back: doc_id, start, n_tokens and the checksum of the ids that were read."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer=tokenizer)
    return read_tokens(spark, path).mapInArrow(frugal(_checksums), "doc_id long, start long, n_tokens long, ids_crc32 long")
