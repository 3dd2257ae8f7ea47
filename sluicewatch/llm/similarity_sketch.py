"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In every round each shingle of a set is thrown into one coordinate with
a value that grows with the round; the least value stays. The first T rounds choose the coordinate
by a hash, the next T give one coordinate to every shingle each, so after 2 T rounds all are full,
and a set stops at the first round that leaves none empty. Two sets agree in a coordinate with
their Jaccard similarity, as concentrated as with a permutation each, at the cost of one or two
passes over a large set.

Sets that agree in all ROWS coordinates of one of the bands meet in its bucket. At a similarity of
0.8 a pair misses all 24 bands with a chance of 3.3e-8. Who meets is verified on whole texts.

No bucket is paired off as a whole: its members are verified against its first one, links become
components, and a bucket in one component needs no more. In those still open, members look for the
partners outside their component that seem closest; the pairs between components that are left at the
end are all gone through, cell by cell. Parity maps give a lower bound of two sets' difference, so nearly
all pairs without a link are ruled out where they are met and only the rest is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut_lineage, keyed, read, release
from .jaccard import document_sets, extended
from .words import mix, pieces

WIDTH = 4
#: Documents link when 100 * overlap >= PERCENT * union.
PERCENT = 80
T = 72
ROWS = 3
#: Least and largest logarithm of a parity map's bits.
BITS = (8, 15)
#: Members of a bucket that a task compares at a time, and partners that each one looks for in a turn.
CELL = 1_000
NEAR = 3
TURNS = 8
#: Pairs between components, for each member of an open bucket, that are verified without more turns.
CROSS = 20
#: Ways over which the rows of one bucket are spread, and partners of one document that share a task.
SALTS = 16
CHUNK = 2_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(found: np.ndarray, of: np.ndarray, count: int, t: int = T) -> np.ndarray:
    """(count, t) sketch values of the sets whose elements are ``found``, ordered by set number ``of``."""
    out = np.full(count * t, EMPTY)
    for turn in range(2 * t):
        if not len(found):
            break
        h = mix(found + np.uint64((turn * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))
        value = (np.uint64(turn) << np.uint64(56)) | (mix(h) >> np.uint64(8))
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if turn < t else turn - t
        slot = of * t + place
        if turn:
            empty = out[slot] == EMPTY
            slot, value = slot[empty], value[empty]
        np.minimum.at(out, slot, value)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        short = (out.reshape(count, t)[of[first]] == EMPTY).any(axis=1)
        short = np.repeat(short, np.diff(first, append=len(of)))
        found, of = found[short], of[short]
    return out.reshape(count, t)


def bands_of(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) bucket numbers; the band's own number is part of the hash."""
    bands = sketch.shape[1] // rows
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for r in range(rows):
        out = mix(out + np.uint64(r)) + sketch[:, r:bands * rows:rows]
    return mix(out)


def parities(found: np.ndarray, of: np.ndarray, count: int) -> list[bytes]:
    """A bit map of each set: the parity of its elements by the low bits of a hash, two bits an element and more.

    Elements that two sets share cancel out, so where the maps differ is at most where the sets do, and
    a map folded in half is that of half the bits.
    """
    n = np.bincount(of, minlength=count)
    bits = np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(1, 2 * n))), *BITS).astype(np.int64))
    start = np.cumsum(bits) - bits
    place = start[of] + (mix(found ^ np.uint64(0x2545F4914F6CDD1D)).astype(np.int64) & (bits[of] - 1))
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((start // 8).tolist(), ((start + bits) // 8).tolist(), strict=True)]


class Maps:
    """Parity maps of many sets, to be compared at the length of the shorter one."""

    def __init__(self, maps: list[bytes]):
        self.size = np.array([len(m) for m in maps], np.int64)
        self.at: dict[int, np.ndarray] = {}
        longer, rows = np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)
        for size in sorted(set(self.size.tolist()), reverse=True):
            while longer.shape[1] > size:
                half = longer.shape[1] // 2
                longer = longer[:, :half] ^ longer[:, half:]
            own = np.flatnonzero(self.size == size)
            here = np.frombuffer(b"".join(maps[i] for i in own.tolist()), np.uint8).reshape(len(own), size)
            longer, rows = np.concatenate([longer.reshape(len(rows), size), here]), np.concatenate([rows, own])
            table = np.zeros((len(maps), size), np.uint8)
            table[rows] = longer
            self.at[size] = table

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of each pair's symmetric difference."""
        size = np.minimum(self.size[a], self.size[b])
        out = np.zeros(len(a), np.int64)
        for s in set(size.tolist()):
            own = size == s
            out[own] = np.bitwise_count(self.at[s][a[own]] ^ self.at[s][b[own]]).sum(axis=1)
        return out


def summaries(docs: DataFrame, width: int, t: int, rows: int) -> DataFrame:
    """(key, n, sid, sid2, bands, map): a set's size and 128-bit name, its buckets, its parity map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, ends in pieces(batch):
                found, of = document_sets(data, ends, width)
                n = np.bincount(of, minlength=len(ends))
                sid, sid2 = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
                if len(found):
                    at = np.flatnonzero(np.diff(of, prepend=-1))
                    sid[of[at]] = np.add.reduceat(mix(found), at)
                    sid2[of[at]] = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), at)
                sketch = sketches(found, of, len(ends), t)
                buckets = bands_of(sketch, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(ends) + 1, dtype=np.int32) * buckets.shape[1]), pa.array(buckets.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(part.start, len(ends)), pa.array(n), pa.array(sid.view(np.int64)),
                     pa.array(sid2.view(np.int64)), lists, pa.array(parities(found, of, len(ends)), pa.binary())],
                    names=["key", "n", "sid", "sid2", "bands", "map"])

    return docs.select("key", "text").mapInArrow(
        run, "key long, n long, sid long, sid2 long, bands array<long>, map binary")


def likely(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their parity maps don't rule out; none that is similar enough is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                both = Maps(batch.column("map_a").to_pylist() + batch.column("map_b").to_pylist())
                total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                fits = (100 + percent) * both.apart(np.arange(n), np.arange(n, 2 * n)) <= (100 - percent) * total
                batch = batch.filter(pa.array(fits))
            yield batch.select(["a", "b"])

    sides = [maps.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}")) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, by the sets of both whole texts.

    Pairs are dealt by b, at most about CHUNK to a task's group, so a document with many partners is
    spread; its text travels once a group and those of its partners once a pair.
    """
    ways = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("ways"))
    sides = cut_lineage(
        pairs.withColumn("lot", F.xxhash64("a")).join(ways, "b").select(
            "b", F.pmod("lot", "ways").alias("way"), F.col("a").alias("key"), F.lit(True).alias("other")).unionByName(
        ways.select("b", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.col("b").alias("key"),
                    F.lit(False).alias("other"))))
    texts = docs.select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            group = list(zip(batch.column("b").to_pylist(), batch.column("way").to_pylist(), strict=True))
            other = batch.column("other").to_pylist()
            keep = []
            for part, data, ends in pieces(batch):
                found, of = document_sets(data, ends, width)
                cut = np.searchsorted(of, np.arange(len(ends) + 1))
                for d in range(len(ends)):
                    i, mine = part.start + d, found[cut[d]:cut[d + 1]]
                    if not other[i]:
                        held, own = group[i], mine
                    elif held == group[i]:
                        total = len(own) + len(mine)
                        both = np.concatenate([own, mine])
                        both.sort()
                        same = int((both[1:] == both[:-1]).sum())
                        if 100 * same >= percent * (total - same):
                            keep.append(i)
            chosen = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column("key"), chosen.column("b")], names=["a", "b"])

    met = sides.join(texts, "key").select("b", "way", "other", "key", "text")
    met = met.repartition("b", "way").sortWithinPartitions("b", "way", "other")
    return met.mapInArrow(run, "a long, b long")


def between(members: DataFrame, turn: int, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) of members (bucket, key, n, component, map, m) in different components of a bucket.

    Members are dealt into rows of about CELL. Otherwise than ``every``, each looks inside its row for
    the NEAR ones that seem closest; with it, all pairs of rows are compared, each in a task's group of
    two rows, and every pair goes on that sizes and parity maps allow.
    """
    ways = F.ceil(F.col("m") / CELL).cast("int")
    dealt = members.withColumn("row", F.pmod(F.xxhash64("key", F.lit(turn)), ways).cast("int"))
    if every:
        both = F.transform(F.sequence(F.lit(0), ways - 1),
                           lambda j: F.struct(F.least("row", j).alias("x"), F.greatest("row", j).alias("y")))
        dealt = dealt.withColumn("cell", F.explode(both))
    else:
        dealt = dealt.withColumn("cell", F.struct(F.col("row").alias("x"), F.col("row").alias("y")))

    def run(table: pa.Table) -> pa.Table:
        key, n, component, row = (table.column(c).to_numpy() for c in ("key", "n", "component", "row"))
        maps = Maps(table.column("map").to_pylist())
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        left, right = np.flatnonzero(row == x), np.flatnonzero(row == y)
        a, b = [], []
        for i in left.tolist():
            others = right[component[right] != component[i]]
            if x == y and every:
                others = others[others > i]
            others = others[np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * percent]
            apart = maps.apart(np.full(len(others), i), others)
            fits = (100 + percent) * apart <= (100 - percent) * (n[others] + n[i])
            others, apart = others[fits], apart[fits]
            if not every and len(others) > NEAR:
                others = others[np.argpartition(apart, NEAR)[:NEAR]]
            a += [key[i]] * len(others)
            b += key[others].tolist()
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"a": pa.array(hi, pa.int64()), "b": pa.array(lo, pa.int64())})

    told = dealt.select("bucket", "cell.x", "cell.y", "key", "n", "component", "map", "row")
    return told.groupBy("bucket", "x", "y").applyInArrow(run, "a long, b long").distinct()


def salted(df: DataFrame) -> DataFrame:
    """``df``, one row a bucket, once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def linked_components(reps: DataFrame, docs: DataFrame, width: int, percent: int, cell_turns: int) -> DataFrame:
    """(node, component) of the keys in ``reps`` (key, n, bands, map), one a set, that have a link."""
    spark = docs.sparkSession
    maps = reps.select("key", "n", "map")
    held = reps.select(F.explode("bands").alias("bucket"), "key", "n")
    hubs = held.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    spread = held.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    shared = cut_lineage(spread.join(salted(hubs), ["bucket", "salt"]))
    close = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    tried = shared.filter(close & (F.col("key") != F.col("hub.key"))).select(
        F.col("key").alias("a"), F.col("hub.key").alias("b")).distinct()
    tried = cut_lineage(likely(tried, maps, percent))
    named = components(cut_lineage(verified(tried, docs, width, percent)))
    release(spark)
    before = None
    for turn in range(1, cell_turns + 1):
        named = cut_lineage(named)
        placed = shared.select("bucket", "salt", "key", "n", "m").join(
            named.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        placed = cut_lineage(placed)
        counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(
            F.sum(F.col("c") * F.col("c")).alias("s"), F.sum("c").alias("all")).filter("s < all * all")
        counts = cut_lineage(counts)
        cross, members = counts.agg(F.sum((F.col("all") * F.col("all") - F.col("s")) / 2), F.sum("all")).first()
        if not cross:
            return named
        every = turn == cell_turns or cross <= CROSS * members or cross == before
        before = cross
        open_ = placed.join(salted(counts.select("bucket")), ["bucket", "salt"]).join(maps.drop("n"), "key")
        more = cut_lineage(between(open_, turn, percent, every).join(tried, ["a", "b"], "left_anti"))
        named = extended(named, cut_lineage(verified(more, docs, width, percent)))
        if every:
            return named
        tried = tried.unionByName(more)
        release(spark)
    return named


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, t: int = T, rows: int = ROWS,
                    turns: int = TURNS) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, first) for every row of ``docs``.

    NULL texts and texts without words have no shingles and stand alone. Rows that share a doc_id are
    documents of their own; NULL ids are named last, so a component's id is NULL only if all its ids
    are. Equal sets meet as one, however many documents have them; whole texts are read, of any length.
    ``first`` marks one row of each component, the one that names it. Other columns are passed by, so their
    names may clash; an empty table gives no rows.
    """
    docs = keyed(docs)
    told = cut_lineage(summaries(docs, width, t, rows))
    sets = told.select("key", "n", "sid", "sid2")
    named_by = cut_lineage(sets.filter("n > 0").groupBy("n", "sid", "sid2").agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")))
    reps = cut_lineage(told.select("key", "n", "bands", "map").join(
        named_by.select(F.col("least").alias("key")), "key", "left_semi"))
    named = linked_components(reps, docs, width, percent, turns)
    salt = F.pmod(F.xxhash64("least"), F.lit(SALTS)).cast("int")
    every = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt))
    same = named_by.join(named.withColumnRenamed("node", "least"), "least", "left").select(
        "n", "sid", "sid2", F.coalesce("component", "least").alias("component"), F.explode(every).alias("salt"))
    of_key = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    joined = sets.withColumn("salt", of_key).join(same, ["n", "sid", "sid2", "salt"], "left").select(
        "key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"))
    out = cut_lineage(docs.select("key", "doc_id").join(joined, "key"))
    first = out.filter("key = component").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key", F.lit(True).alias("first"))
    others = out.filter("key != component").withColumn("salt", of_key)
    names = salted(first.select(F.col("key").alias("component"), "component_id").join(
        others.select("component").distinct(), "component"))
    return first.unionByName(others.join(names, ["component", "salt"]).select(
        "doc_id", "n_shingles", "component_id", "key", F.lit(False).alias("first")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS set
  FROM d
), e AS (SELECT doc_id, len(set) AS n, unnest(set) AS g FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * c >= 80 * (n + m - c)),
twoway AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE t(x, y) AS (SELECT a, b FROM twoway UNION SELECT t.x, w.b FROM t JOIN twoway w ON t.y = w.a)
  SELECT x, min(y) AS y FROM t GROUP BY x
), f AS (
  SELECT s.doc_id, len(set)::BIGINT AS n_shingles, coalesce(least(r.y, s.doc_id), s.doc_id) AS component_id
  FROM s LEFT JOIN r ON s.doc_id = r.x
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM f
"""

QUERIES = {"op12_minhash": op12_minhash}
ORACLES = {"op12_minhash": SQL}
