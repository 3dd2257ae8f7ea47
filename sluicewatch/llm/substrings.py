"""Removal of repeated substrings with a logarithmic family of fingerprint tables.

Every string of ``length`` bytes holds one suffix start, its anchor, chosen by its content alone, so
equal strings have equal anchors and only anchored suffixes are kept. A suffix record holds a
fingerprint of its first bytes, one of the whole stretch of strings it is the anchor of, and
the place where that stretch first stands. Documents come in batches: a batch's records are sorted
by hash, joined against the tables of all levels on equal hashes, and what is new becomes a level;
two levels of one size merge into the next. A stretch that stood before is a match from end to end.
Where suffixes agree in their first bytes but not in the whole stretch, their bytes are compared
string by string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, keyed, read, release, shared_path
from .words import mix, pieces

LENGTH = 100
BATCHES = 4
#: Suffix groups with more distinct stretches than this are compared by an aggregate over all their strings.
HOT = 50_000
PART = 1 << 18
_PLACE = 24


def _seed(length: int) -> int:
    """Bytes of a suffix's first fingerprint: a power of two, so that two of them fit into a string."""
    k = 1
    while 7 * k < 2 * length:
        k *= 2
    if 2 * k > length or length < 8:
        raise ValueError(f"strings of {length} bytes are not supported")
    return k


def _fingerprints(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all strings of k and of 2k bytes, by doubling."""
    h, s = data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15), 1
    small = h
    while s <= k:
        if s == k:
            small = h
        if len(h) <= s:
            return (small if s == k else h[:0]), h[:0]
        a = h[:-s] * np.uint64(0xBF58476D1CE4E5B9 + 2 * s)
        a ^= a >> np.uint64(29)
        a *= np.uint64(0x94D049BB133111EB)
        a += h[s:]
        h, s = a, 2 * s
    return small, h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while 2 * s <= width:
        keys = np.minimum(keys[:-s], keys[s:])
        s *= 2
    return np.minimum(keys[:s - width], keys[width - s:]) if width > s else keys


class Stretches:
    """The stretches of some documents' bytes: runs of neighbouring strings with one anchor."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int):
        k = _seed(length)
        n = len(data)
        starts = np.concatenate([[0], ends[:-1]])
        self.doc = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.doc
        self.seed = self.whole = np.zeros(0, np.uint64)
        if n < length:
            return
        inside = np.zeros(n + 1, np.int32)
        fits = ends - starts >= length
        np.add.at(inside, starts[fits], 1)
        np.add.at(inside, ends[fits] - length + 1, -1)
        valid = np.cumsum(inside[:n - length + 1]) > 0
        small, large = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        anchor = np.full(n - length + 1, -1, np.int64)
        for at in range(0, n - length + 1, PART):  # what is worked on at a time stays in the cache
            to = min(n - length + 1, at + PART)
            if not valid[at:to].any():
                continue
            a, b = _fingerprints(data[at:to + length - 1], k)
            small[at:at + len(a)], large[at:at + len(b)] = a, b
            keys = (a >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(a), dtype=np.uint64)
            anchor[at:to] = (_least(keys, length - k + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + at
        places = np.flatnonzero(valid)
        if not len(places):
            return
        own = anchor[places]
        new = np.ones(len(places), bool)
        new[1:] = (own[1:] != own[:-1]) | (places[1:] != places[:-1] + 1)
        a = np.flatnonzero(new)
        self.first, self.last, self.anchor = places[a], places[np.append(a[1:], len(places)) - 1], own[a]
        end = self.last + length - 2 * k
        whole = (mix(large[self.first] + np.uint64(1)) ^ mix(large[(self.first + end) // 2] + np.uint64(2))
                 ^ mix(large[end] + np.uint64(3)))
        self.whole = mix(whole + ((self.anchor - self.first) * 4096 + self.last - self.first).astype(np.uint64))
        self.seed = mix(small[self.anchor])
        self.doc = np.searchsorted(ends, self.first, side="right")
        self.place = self.first - starts[self.doc]


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """(seed, whole, key, place) of every stretch; of equal ones within a batch of rows the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            parts = []
            for rows, data, ends in pieces(batch):
                s = Stretches(data, ends, length)
                if len(s.first):
                    parts.append((s.seed, s.whole, keys[rows][s.doc], s.place))
            if parts:
                seed, whole, key, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((place, key, whole, seed))
                seed, whole = seed[order], whole[order]
                new = np.ones(len(order), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (whole[1:] != whole[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[new].view(np.int64)), pa.array(whole[new].view(np.int64)),
                     pa.array(key[order][new]), pa.array(place[order][new])], names=["seed", "whole", "key", "place"])

    return docs.select("key", "text").mapInArrow(run, "seed long, whole long, key long, place long")


class Family:
    """Levels of fingerprint tables in the shared folder, each (seed, whole, key, place) sorted by (seed, whole).

    Level sizes are powers of two times a batch. A record stands in one level only, with its first place.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, str]] = []

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("seed long, whole long, key long, place long").parquet(path)

    def _write(self, rows: DataFrame) -> str:
        path = shared_path(self.spark, "suffixes")
        rows.sortWithinPartitions("seed", "whole").write.parquet(path)
        return path

    def _drop(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def append(self, batch: DataFrame) -> None:
        """Takes records that come after all earlier ones; those already in a level are left out."""
        rows = batch.repartition("seed").groupBy("seed", "whole").agg(F.min(F.struct("key", "place")).alias("at"))
        rows = rows.select("seed", "whole", "at.key", "at.place")
        for _, path in self.levels:
            rows = rows.join(self._read(path), ["seed", "whole"], "left_anti")
        self.levels.append((1, self._write(rows)))
        del rows
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            release(self.spark)
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._write(self._read(a).unionByName(self._read(b)).repartition("seed"))))
            self._drop(a)
            self._drop(b)
        release(self.spark)

    def records(self) -> DataFrame:
        out = self._read(self.levels[0][1])
        for _, path in self.levels[1:]:
            out = out.unionByName(self._read(path))
        return out

    def drop(self) -> None:
        for _, path in self.levels:
            self._drop(path)
        self.levels = []


def index(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> Family:
    """The family of all documents, appended in ``batches`` ranges of keys of about equal bytes' rows."""
    family = Family(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("key", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs
        if lo is not None:
            part = part.filter(F.col("key") > lo)
        if hi is not None:
            part = part.filter(F.col("key") <= hi)
        family.append(suffixes(part, length))
    return family


def _strings(data: np.ndarray, length: int, k: int) -> np.ndarray:
    """A fingerprint of every string of ``length`` bytes."""
    large = _fingerprints(data, k)[1]
    n = len(data) - length + 1
    return mix(large[:n] + np.uint64(1)) ^ mix(large[length - 2 * k:length - 2 * k + n] + np.uint64(2))


def compare(rows: DataFrame, length: int) -> DataFrame:
    """(key, place, kept) of stretches (seed, key, place, anchor, bytes): a bit for each string that
    no earlier stretch of the same seed holds."""
    k = _seed(length)

    def settle(seed: np.ndarray, anchor: np.ndarray, data: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(data), np.uint8)
        size = np.array([len(d) for d in data])
        begin = np.cumsum(size) - size
        n = size - length + 1
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        offset = np.repeat(anchor + begin, n) - at
        group = mix(np.repeat(seed.view(np.uint64), n) + mix(_strings(flat, length, k)[at] + offset.astype(np.uint64)))
        _, first, which = np.unique(group, return_index=True, return_inverse=True)
        kept = first[which] == np.arange(len(group))
        view = np.lib.stride_tricks.sliding_window_view(flat, length)
        later = np.flatnonzero(~kept)
        for a in range(0, len(later), 20_000):
            some = later[a:a + 20_000]
            kept[some] = (view[at[some]] != view[at[first[which[some]]]]).any(1)
        return [np.packbits(x).tobytes() for x in np.split(kept, np.cumsum(n)[:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.table(batch) if isinstance(batch, pa.StructArray) else pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            seed = held.column("seed").to_numpy()
            whole = int(np.searchsorted(seed == seed[-1], True)) if len(seed) else 0
            if whole and held.num_rows >= 2_000:
                yield from done(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from done(held)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kept = settle(table.column("seed").to_numpy(), table.column("anchor").to_numpy(), table.column("bytes").to_pylist())
        yield from pa.table({"key": table.column("key"), "place": table.column("place"),
                             "kept": pa.array(kept, pa.binary())}).to_batches()

    dealt = rows.repartition("seed").sortWithinPartitions("seed", "key", "place")
    return dealt.mapInArrow(run, "key long, place long, kept binary")


def compare_hot(rows: DataFrame, length: int) -> DataFrame:
    """The same for seeds with very many stretches: an aggregate over their strings keeps each one's first
    place, so no group meets in one task."""
    k = _seed(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[i].as_buffer(), np.uint8)
                a = _strings(data, length, k)
                b = _strings(data ^ np.uint8(255), length, k)
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("seed")[i].as_py())), pa.array(batch.column("anchor")[i].as_py() - np.arange(n)),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, batch.column("key")[i].as_py())),
                     pa.array(batch.column("place")[i].as_py() + np.arange(n))],
                    names=["seed", "offset", "a", "b", "key", "place"])

    strings = rows.mapInArrow(run, "seed long, offset long, a long, b long, key long, place long")
    first = strings.groupBy("seed", "offset", "a", "b").agg(F.min(F.struct("key", "place")).alias("at"))
    return first.select("at.key", "at.place", F.unhex(F.lit("80")).alias("kept"))


def stretches_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(seed, hot, key, place, anchor, bytes) of the wanted (seed, hot, key, place), from the texts."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("seed", "hot", "place")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column("key").to_pylist(), batch.column("wanted").to_pylist()
            for rows, data, ends in pieces(batch):
                s = Stretches(data, ends, length)
                where = {(int(d), int(p)): i for i, (d, p) in enumerate(zip(s.doc, s.place, strict=True))} if len(s.first) else {}
                out = [(w["seed"], w["hot"], keys[rows.start + d], w["place"], where[d, w["place"]])
                       for d in range(len(ends)) for w in lists[rows.start + d]]
                if out:
                    seed, hot, key, place, at = zip(*out, strict=True)
                    at = np.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seed, pa.int64()), pa.array(hot, pa.bool_()), pa.array(key, pa.int64()), pa.array(place, pa.int64()),
                         pa.array(s.anchor[at] - s.first[at]),
                         pa.array([data[a:b].tobytes() for a, b in zip(s.first[at], s.last[at] + length, strict=True)], pa.binary())],
                        names=["seed", "hot", "key", "place", "anchor", "bytes"])

    return docs.select("key", "text").join(lists, "key").select("key", "text", "wanted").mapInArrow(
        run, "seed long, hot boolean, key long, place long, anchor long, bytes binary")


def deduplicate(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) for every row of ``docs``.

    ``spans`` are the maximal runs (start, length) of bytes covered by a string of ``length`` bytes that
    starts earlier too, ``kept`` the other bytes end to end. Earlier means a smaller doc_id, or the
    same document and a smaller start; rows that share a doc_id are taken in the order of a hash of
    their texts, NULL ids last. NULL and short texts have no spans. Columns besides doc_id and text
    are ignored.
    """
    docs = keyed(docs)
    spark = docs.sparkSession
    family = index(docs, length, batches)
    of_seed = F.count(F.lit(1)).over(Window.partitionBy("seed"))
    records = cut_lineage(family.records().repartition("seed").withColumn("n", of_seed).select(
        F.when(F.col("n") > 1, F.col("seed")).alias("seed"), "key", "place", (F.col("n") > hot).alias("hot")))
    family.drop()
    release(spark)
    alike = stretches_of(docs, records.filter("seed IS NOT NULL"), length)
    few = compare(alike.filter("NOT hot").drop("hot"), length)
    if not records.filter("hot").isEmpty():
        few = few.unionByName(compare_hot(stretches_of(docs, records.filter("hot"), length).drop("hot"), length))
    settled = cut_lineage(few)
    release(spark)
    alone = records.filter("seed IS NULL").select("key", "place", F.lit(None).cast("binary").alias("kept"))
    lists = alone.unionByName(settled).groupBy("key").agg(F.collect_list("place").alias("places"),
                                                          F.collect_list(F.coalesce("kept", F.unhex(F.lit("")))).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, bits = batch.column("places"), batch.column("bits")
            for rows, data, ends in pieces(batch):
                starts = np.concatenate([[0], ends[:-1]])
                s = Stretches(data, ends, length)
                gone = np.zeros(len(data) + length + 1, bool)
                for a, b in zip(s.first, s.last, strict=True):
                    gone[a:b + 1] = True
                last = dict(zip(s.first.tolist(), s.last.tolist(), strict=True))
                for d in range(len(ends)):
                    at = places[rows.start + d].as_py() or ()
                    for p, kept in zip(at, bits[rows.start + d].as_py() or (), strict=True):
                        a = int(starts[d]) + p
                        if kept:
                            flags = np.unpackbits(np.frombuffer(kept, np.uint8))
                            gone[a + np.flatnonzero(flags)] = False
                        else:
                            gone[a:last[a] + 1] = False
                change = np.zeros(len(data) + 1, np.int64)
                at = np.flatnonzero(gone)
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                covered = np.cumsum(change[:-1]) > 0
                kept_bytes, spans = [], []
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    own = covered[a:b]
                    edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(edge[0::2], edge[1::2], strict=True)])
                    kept_bytes.append(data[a:b][~own].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, len(ends)), pa.array(np.diff(ends, prepend=0)),
                     pa.array(kept_bytes, pa.binary()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                    names=["doc_id", "n_bytes", "kept", "spans"])

    joined = docs.join(lists, "key", "left").select("doc_id", "text", "places", F.col("kept").alias("bits"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,length:long>>")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return deduplicate(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substrings": op1_substrings}
ORACLES: dict[str, str] = {}
