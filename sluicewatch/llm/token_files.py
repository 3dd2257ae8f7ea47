"""Token ids as ORC files.

Documents are put into ascending doc_id order by ranges, encoded, and written as ORC: integer
columns are run-length encoded in stripes, each stripe carries a row index, and doc_id has a
Bloom filter, so readers can split a file by stripes and skip those that cannot hold an id.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, running_sums, shared_path
from .words import LOWER, NOT_ALNUM, mix, pieces, powers

END_ID = 1
#: Chunks of text whose ids a worker remembers, and bytes of text that it encodes at a time.
REMEMBERED = 1 << 18
PIECE = 1 << 18
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000",
       "orc.create.index": "true", "compression": "zstd"}


#: The text handling of tokenizers whose ids of a text are those of its blank-separated chunks.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
BLANK = np.zeros(256, bool)
BLANK[[10, 32]] = True
POINT = np.zeros(256, bool)
POINT[[44, 46]] = True
ALNUM = ~NOT_ALNUM & (np.arange(256) < 128)
#: A second, unrelated value for each byte: a hit in the table must agree in the hashes of both.
OTHER = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1)


def chunks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, other hash, document, start, stop) of the texts' chunks.

    Chunks end at a blank or line end, and before a comma or full stop right after an ASCII letter or
    digit. A capital counts as its small letter unless a byte above ASCII, maybe a mark on it, follows.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    blank = BLANK[data]
    cut = first.copy()
    cut[1:n] |= blank[:-1] | (POINT[data[1:]] & ALNUM[data[:-1]])
    start = np.flatnonzero(~blank & cut[:n])
    stops = cut[1:].copy()
    stops[:-1] |= blank[1:]
    stop = np.flatnonzero(~blank & stops) + 1
    low = data.copy()
    plain = np.ones(n, bool)
    plain[:-1] = data[1:] < 128
    low[plain] = LOWER[data[plain]]
    up, down = powers(n + 1)
    out = []
    for values in (low.astype(np.uint64) + np.uint64(1), OTHER[low]):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=sums[1:])
        out.append(mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
    return out[0], out[1], np.searchsorted(ends, start, side="right"), start, stop


class Encoder:
    """Encodes whole texts, each chunk once: its ids are looked up by hash when it comes again.

    That is right for tokenizers that drop white space and never join what stands on two sides of a
    blank or of a letter and a comma (CHUNKED says which); texts that hold one of the tokenizer's special
    strings, and all texts for any other tokenizer, are encoded as a whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.chunked = all(form.get(k) == v for k, v in CHUNKED.items()) and not form.get("post_processor")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.known = 0
        self.slots = np.zeros(2 << int(np.ceil(np.log2(self.remembered))), np.uint64)
        self.number = np.full(len(self.slots), -1, np.int32)
        self.other = np.zeros(1 << 12, np.uint64)
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)
        self.used = 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the chunks with these hashes, -1 where there is none."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(hashes), -1, np.int32)
        left, at = np.arange(len(hashes)), (hashes & mask).astype(np.int64)
        while len(left):
            number = self.number[at]
            hit = (number >= 0) & (self.slots[at] == hashes[left])
            out[left[hit]] = number[hit]
            on = (number >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        left, at = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.number[at] < 0
            self.number[at[free]] = numbers[left[free]]
            self.slots[at[free]] = hashes[left[free]]
            lost = self.number[at] != numbers[left]  # the place was taken, or another new one got it
            left, at = left[lost], (at[lost] + 1) & mask

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, other: np.ndarray, texts: list[str]) -> None:
        """Chunks of letters only are one word each, so many are encoded as one text and cut at
        the word ends; if the ends don't add up, and for other chunks, each is encoded alone."""
        plain = [i for i, c in enumerate(texts) if c.isalpha()]
        rest = [i for i, c in enumerate(texts) if not c.isalpha()]
        for at in range(0, len(plain), 500):
            some = plain[at:at + 500]
            ids = np.array(self._encode([" ".join(texts[i] for i in some)])[0], np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                self._store(hashes[some], other[some], ids, np.diff(cuts, prepend=0))
            else:
                rest += some
        lists = self._encode([texts[i] for i in rest])
        self._store(hashes[rest], other[rest], np.array([i for x in lists for i in x], np.int64),
                    np.array([len(x) for x in lists], np.int64))

    def _store(self, hashes: np.ndarray, other: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        at, n, to = self.known, len(ids), self.known + len(hashes)
        while to > len(self.start):
            self.start, self.length, self.other = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.other))
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + n] = ids
        self.length[at:to] = lengths
        self.start[at:to] = self.used + np.cumsum(lengths) - lengths
        self.other[at:to] = other
        self.used += n
        self.known = to
        if 2 * to > len(self.slots):
            old, number = self.slots[self.number >= 0], self.number[self.number >= 0]
            self.slots, self.number = np.zeros(4 * len(self.slots), np.uint64), np.full(4 * len(self.slots), -1, np.int32)
            self._place(old, number)
        self._place(hashes, np.arange(at, to, dtype=np.int32))

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 end to end) and the number of each text's."""
        raw = data.tobytes()
        whole = np.full(len(ends), not self.chunked)
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                whole[np.searchsorted(ends, at, side="right")] = True
                at = raw.find(special, at + 1)
        hashes, other, doc, start, stop = chunks(data, ends)
        own = ~whole[doc]
        hashes, other, doc, start, stop = hashes[own], other[own], doc[own], start[own], stop[own]
        if self.known > self.remembered:
            self.forget()
        number = self._find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, one = np.unique(hashes[new], return_index=True)
            for k in range(0, len(one), self.remembered):
                some = new[one[k:k + self.remembered]]
                self._learn(hashes[some], other[some], [raw[a:b].decode() for a, b in zip(start[some].tolist(), stop[some].tolist(), strict=True)])
            number[new] = self._find(hashes[new])
        length = self.length[number].astype(np.int64)
        stops = np.cumsum(length)
        places = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.start[number] - (stops - length), length)
        ids = self.ids[places].astype(np.int32)
        per_doc = np.zeros(len(ends), np.int64)
        np.add.at(per_doc, doc, length)
        odd = {i: None for i in np.flatnonzero(whole).tolist()}
        odd |= {i: None for i in doc[self.other[number] != other].tolist()}  # two chunks with one hash
        if odd:
            begin = np.concatenate([[0], ends[:-1]])
            odd = dict(zip(odd, self._encode([raw[begin[i]:ends[i]].decode() for i in odd]), strict=True))
            cuts = np.concatenate([[0], np.cumsum(per_doc)])
            parts = [np.array(odd[i], np.int32) if i in odd else ids[cuts[i]:cuts[i + 1]] for i in range(len(ends))]
            ids, per_doc = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, per_doc


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so tasks that follow each other share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) with ``end_id`` after each document's ids; NULL texts are empty."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part, data, ends in pieces(batch, most=PIECE):
                ids, lengths = own.encode(data, ends)
                stops = np.cumsum(lengths)
                ids = np.insert(ids, stops, end_id).astype(np.int32)
                offsets = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(ends)), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                    names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes ``folder`` as ORC in ascending doc_id order, NULL ids first: file after file, row after
    row. Each text is shuffled once, into its range, and encoded there."""
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    tokenise(ranged.sortWithinPartitions("doc_id"), path, end_id).write.options(**ORC).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>").orc(folder)


def tokens_of(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """The stored rows of some documents. The ids are a filter on the files: stripes and row groups are skipped by
    their least and largest id and their Bloom filters. A NULL id finds nothing."""
    return read_tokens(spark, folder).filter(F.col("doc_id").isin([i for i in ids if i is not None]))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per stored document, from the files alone.

    ``start`` counts the ids of all documents that stand before it in doc_id order. Rows with one
    doc_id follow each other by (n_tokens, ids_crc32). No file gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, folder).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long")
    return running_sums(rows, [], ["doc_id", "n_tokens", "ids_crc32"], ["n_tokens"]).select(
        "doc_id", F.col("before_n_tokens").cast("long").alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), folder)
    return digests(spark, folder)


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
