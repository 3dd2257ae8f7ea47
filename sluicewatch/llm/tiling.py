"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared runs of LEAST words, their seeds. For each pair with
enough of them the longest common stretches that do not overlap are marked, longest first, by running Karp-Rabin
rounds of falling length; how much of the item the tiles cover decides. Since tiles may stand in
any order, reordered passages are caught.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, holding, keyed, read, without
from .words import NOT_ALNUM, mix, pieces, powers, shingles, words

LEAST = 5
COVERAGE = 0.6
FIRST_LENGTH = 20
#: Size of the filter of benchmark seeds, and of the pieces in which it is put together.
FILTER_BITS = 26
PIECE_OF_FILTER = 1 << 16
#: Ways over which the documents that hold one seed are spread.
SALTS = 16


def _window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` tokens, each from the one before by two sums."""
    up, down = powers(len(tokens) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:len(tokens)], dtype=np.uint64)])
    n = len(tokens) - length + 1
    return mix((sums[length:] - sums[:n]) * down[:n])


def tiles(item: np.ndarray, text: np.ndarray, broken: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``item`` by ``text`` as (start in item, start in text, length).

    ``broken`` marks places of ``text`` across which no tile may run. Of matches of one length the
    first in the item, then in the text, is marked first.
    """
    used_item, used_text = np.zeros(len(item), bool), broken.copy()
    found: list[tuple[int, int, int]] = []

    def free(used: np.ndarray, length: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(used)])
        return np.flatnonzero(taken[length:] == taken[:len(used) - length + 1])

    length = max(least, min(FIRST_LENGTH, len(item), len(text)))
    while True:
        matches: list[tuple[int, int, int]] = []
        longer = 0
        if length <= min(len(item), len(text)):
            a, b = free(used_item, length), free(used_text, length)
            places: dict[int, list[int]] = {}
            for at, h in zip(b.tolist(), _window_hashes(text, length)[b].tolist(), strict=True):
                places.setdefault(h, []).append(at)
            for p, h in zip(a.tolist(), _window_hashes(item, length)[a].tolist(), strict=True):
                for t in places.get(h, ()):
                    k = 0
                    while (p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k]
                           and not used_item[p + k] and not used_text[t + k]):
                        k += 1
                    if k >= length:
                        matches.append((k, p, t))
                        longer = max(longer, k)
        if longer > 2 * length:
            length = longer
            continue
        waiting = sorted(matches, key=lambda m: (-m[0], m[1], m[2]))
        while waiting:
            k, p, t = waiting.pop(0)
            taken = used_item[p:p + k] | used_text[t:t + k]
            if taken.any():  # part of it went to a longer tile: its first free stretch may still do
                edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
                runs = [(int(e - s), p + int(s), t + int(s)) for s, e in zip(edges[0::2], edges[1::2], strict=True)]
                waiting = sorted([*waiting, *(r for r in runs if r[0] >= length)], key=lambda m: (-m[0], m[1], m[2]))
                continue
            used_item[p:p + k] = True
            used_text[t:t + k] = True
            found.append((p, t, k))
        if length > 2 * least:
            length //= 2
        elif length > least:
            length = least
        else:
            return found


def seeds_of(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, seeds, first word of each seed) of one text."""
    data = np.frombuffer(text, np.uint8)
    tokens, of, _, _ = words(data, np.array([len(data)]), NOT_ALNUM)
    seeds, _, first = shingles(tokens, of, least)
    return tokens, seeds, first


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """(seed, item, times, n_item_words): an item's distinct seeds and how often each stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in pieces(batch):
                hashes, of, _, _ = words(data, ends, NOT_ALNUM)
                n = np.bincount(of, minlength=len(ends))
                seeds, item, _ = shingles(hashes, of, least)
                order = np.lexsort((seeds, item))
                seeds, item = seeds[order], item[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(seeds) != 0) | (np.diff(item) != 0)])) if len(seeds) else order
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds[new].view(np.int64)), batch.column("key").take(pa.array(part.start + item[new])),
                     pa.array(np.diff(new, append=len(seeds)).astype(np.int64)), pa.array(n[item[new]])],
                    names=["seed", "item", "times", "n_item_words"])

    return items.select("key", "text").mapInArrow(run, "seed long, item long, times long, n_item_words long")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """One bit for each value of the seeds' first FILTER_BITS bits: of one size whatever the benchmark's."""
    size = 1 << (FILTER_BITS - 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        rows = bits.reshape(-1, min(PIECE_OF_FILTER, size))
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([rows[i].tobytes() for i in used], pa.binary())],
                                         names=["piece", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, bits in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                own[piece] = own.get(piece, 0) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())],
                                         names=["piece", "bits"])

    out = np.zeros(size, np.uint8)
    shape = "piece int, bits binary"
    for piece, bits in seeds.select("seed").mapInArrow(mark, shape).repartition("piece").mapInArrow(join, shape).collect():
        out[piece * len(bits):(piece + 1) * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def document_seeds(docs: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """(key, seed): the distinct seeds of each document that the filter lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part, data, ends in pieces(batch):
                hashes, of, _, _ = words(data, ends, NOT_ALNUM)
                seeds, doc, _ = shingles(hashes, of, least)
                at = seeds >> np.uint64(64 - FILTER_BITS)
                likely = (known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                found = np.unique(np.rec.fromarrays([doc[likely], seeds[likely]], names="doc,seed"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(part.start + found.doc)), pa.array(found.seed.view(np.int64))], names=["key", "seed"])

    return docs.select("key", "text").mapInArrow(run, "key long, seed long")


def tiled(item: bytes, text: bytes, least: int, coverage: float) -> tuple[int, ...] | None:
    """(covered, tiles, longest, first word, last word) where tiles cover enough of the item, else None."""
    own, own_seeds, _ = seeds_of(item, least)
    tokens, seeds, first = seeds_of(text, least)
    place = first[np.isin(seeds, own_seeds)]
    if not len(place):
        return None
    near = np.unique((place[:, None] + np.arange(least)).ravel())
    gap = np.flatnonzero(np.diff(near) > 1) + 1  # a marked place between stretches that do not touch
    at = np.insert(near, gap, 0)
    marked = tiles(own, np.insert(tokens[near], gap, 0), np.insert(np.zeros(len(near), bool), gap, True), least)
    covered = sum(k for _, _, k in marked)
    if not marked or covered < coverage * len(own):
        return None
    return (covered, len(marked), max(k for _, _, k in marked), int(min(at[t] for _, t, _ in marked)),
            int(max(at[t + k - 1] for _, t, k in marked)))


SHAPE = ("key long, doc_id long, item_id long, n_item_words long, covered long, n_tiles long, longest long, first_word long, "
         "last_word long")


def matches(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> DataFrame:
    """SHAPE rows of the documents ``docs`` (key, doc_id, text) and the benchmark items in them."""
    spark = docs.sparkSession
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("doc_id"), "text")
    items = cut_lineage(keyed(items))
    seeds = cut_lineage(item_seeds(items, least))
    held = document_seeds(docs, seed_filter(seeds), least).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    told = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a tile of k words has k - least + 1 seeds, k / least at least
    pairs = cut_lineage(held.join(told, ["seed", "salt"]).groupBy("key", "item").agg(
        F.sum("times").alias("places"), F.max("n_item_words").alias("n_item_words")).filter(
        F.col("places") * least >= F.lit(coverage) * F.col("n_item_words")).select("key", "item", "n_item_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rest = [], []
            for i, (item, text) in enumerate(zip(batch.column("item_text"), batch.column("text"), strict=True)):
                found = tiled(item.as_buffer().to_pybytes(), text.as_buffer().to_pybytes(), least, coverage)
                if found:
                    keep.append(i)
                    rest.append(found)
            own = batch.take(pa.array(keep, pa.int64()))
            columns = [pa.array([r[j] for r in rest], pa.int64()) for j in range(5)]
            yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("key", "doc_id", "item_id", "n_item_words")], *columns],
                                             names=[c.split()[0] for c in SHAPE.split(", ")])

    if pairs.isEmpty():
        return spark.createDataFrame([], SHAPE)
    both = pairs.join(holding(docs.select("key", "doc_id", "text"), pairs.select("key")), "key").join(
        items.select(F.col("key").alias("item"), F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")), "item")
    return both.select("key", "doc_id", "item_id", "n_item_words", "text", "item_text").mapInArrow(run, SHAPE)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item of which tiles cover at least ``coverage``.

    (doc_id, item_id, n_item_words, covered, n_tiles, longest, first_word, last_word, coverage). Words
    are runs of letters and digits, ASCII case aside; whole texts are read, of any length. Items with fewer
    than ``least`` words, NULL or without id never match; an empty benchmark, or one of such items only, gives no
    rows. NULL and empty documents hold nothing. Rows with one doc_id are documents of their own, repeated
    items items of their own. Other columns are passed by. Documents and items are joined as tables; only two filters are
    broadcast, of 2 ** FILTER_BITS bits for seeds, which the larger the benchmark the more seeds pass, and one for the
    documents of pairs, so that no other document's text is moved.
    """
    found = matches(keyed(docs), benchmark, least, coverage).drop("key")
    return found.withColumn("coverage", F.col("covered") / F.col("n_item_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item to ``coverage``, all columns kept; see ``leaks`` for
    NULLs, empty tables and repeated rows."""
    rows = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), ["row"])
    found = matches(rows.select("key", "doc_id", "text"), benchmark, least, coverage)
    return without(rows.select("key", "row"), cut_lineage(found.select("key").distinct())).select("row.*")


def op3_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op3_tiling": op3_tiling}
ORACLES: dict[str, str] = {}
