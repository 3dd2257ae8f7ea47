"""Exact n-gram Jaccard join by rare-first prefix filtering.

A document's shingles are put in one global order, rare ones first. Two sets that are similar
enough share a shingle among their first few, so only documents with a common prefix shingle
are paired, if their lengths and the places of that shingle allow the overlap. Each pair is
verified once, after the suffix filter, on the whole texts. Links give components.

Groups that share a prefix shingle are joined pairwise while they are small. In a large group
each member meets a few random others and the best-linked one; what is connected by then needs
no more pairs, and the pairs left between components are all verified, so no link between
components is lost and a group of near copies does not cost its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut_lineage, holding, keyed, read, release
from .words import mix, pieces, shingles, words

WIDTH = 4
#: Documents link when 100 * overlap >= PERCENT * union.
PERCENT = 85
#: Counters of the frequency sketch, which alone is broadcast, and of each row it travels in.
COUNTERS = 1 << 20
CHUNK = 1 << 14
#: Groups up to SMALL are joined pairwise; larger ones meet NEAR random others per round, in rows of about ROW.
SMALL = 64
NEAR = 3
ROW = 1_000
ROUNDS = 6
#: Cross pairs a member, counted once for each shared shingle, that are verified without more rounds.
CROSS = 400
#: Shingles a verifying task remembers.
HELD = 4_000_000
#: Shingles with more than this many documents are dealt out by document as well.
HOT = 1_000_000


def document_sets(data: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, document) of each document's distinct shingles, by document; of a document with fewer
    words its whole sequence."""
    hashes, doc, _, _ = words(data, ends)
    found, of, _ = shingles(hashes, doc, width)
    n_words = np.bincount(doc, minlength=len(ends))
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = n_words[short] > k
            whole[there] = mix(whole[there] * np.uint64(31) + hashes[first[there] + k] + np.uint64(k + 101))
        found, of = np.concatenate([found, mix(whole)]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (key, n, sid, sid2), and rows (chunk, counts) of each task's frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        names = ["key", "n", "sid", "sid2", "chunk", "counts"]
        for batch in batches:
            n, sid, sid2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            for rows, data, ends in pieces(batch):
                found, of = document_sets(data, ends, width)
                counts += np.bincount((found >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
                n[rows] = np.bincount(of, minlength=len(ends))
                if len(found):
                    at = np.flatnonzero(np.diff(of, prepend=-1))
                    sid[rows.start + of[at]] = np.add.reduceat(mix(found), at)
                    sid2[rows.start + of[at]] = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), at)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n), pa.array(sid.view(np.int64)), pa.array(sid2.view(np.int64)), none,
                 pa.nulls(batch.num_rows, pa.binary())], names=names)
        used = [(c, counts[c * CHUNK:(c + 1) * CHUNK]) for c in range(COUNTERS // CHUNK)]
        used = [(c, x) for c, x in used if x.any()]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array([c for c, _ in used], pa.int32()),
             pa.array([x.astype("<i8").tobytes() for _, x in used], pa.binary())], names=names)

    return docs.select("key", "text").mapInArrow(run, "key long, n long, sid long, sid2 long, chunk int, counts binary")


def frequencies(sketch: DataFrame) -> np.ndarray:
    """The summed sketch, COUNTERS numbers whatever the corpus; each task adds its rows as they come."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            names=["chunk", "counts"])

    out = np.zeros(COUNTERS, np.int64)
    for chunk, counts in sketch.select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[chunk * CHUNK:(chunk + 1) * CHUNK] += np.frombuffer(counts, "<i8")
    return out


def rare_first(found: np.ndarray, of: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shingles in the global order: by frequency level, then by hash."""
    order = np.lexsort((found, levels[(found >> np.uint64(44)).astype(np.int64)], of))
    return found[order], of[order]


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)


def prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int, hot: int) -> DataFrame:
    """(token, salt, sid, n, pos, key) of each set's prefix; equal sets of one batch are told once, by
    the smallest key that the batch has for them in any of its pieces, so the smallest key told is the set's."""
    sent = docs.sparkSession.sparkContext.broadcast(
        (levels_of(counts), np.where(counts > hot, -(-counts // hot), 1).astype(np.int32) if (counts > hot).any() else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, salts = sent.value
        for batch in batches:
            parts, seen, sids, owners = [], set(), [], []
            keys = batch.column("key").to_numpy()
            for rows, data, ends in pieces(batch):
                found, of = rare_first(*document_sets(data, ends, width), levels)
                if not len(found):
                    continue
                at = np.flatnonzero(np.diff(of, prepend=-1))
                n = np.bincount(of, minlength=len(ends))
                sid = np.zeros(len(ends), np.uint64)
                sid[of[at]] = np.add.reduceat(mix(found), at)
                sids.append(sid[of[at]])
                owners.append(keys[rows][of[at]])
                first = np.zeros(len(ends), bool)
                for d in of[at].tolist():
                    if int(sid[d]) not in seen:
                        seen.add(int(sid[d]))
                        first[d] = True
                pos = np.arange(len(found)) - np.repeat(at, np.diff(np.append(at, len(found))))
                keep = first[of] & (pos < (n - (percent * n + 99) // 100 + 1)[of])
                token, d = found[keep], of[keep]
                salt = np.zeros(len(token), np.int32)
                if salts is not None:
                    ways = salts[(token >> np.uint64(44)).astype(np.int64)]
                    salt = (sid[d] % ways.astype(np.uint64)).astype(np.int32) + (ways > 1)
                parts.append((token.view(np.int64), salt, sid[d], n[d].astype(np.int32), pos[keep].astype(np.int32)))
            if parts:
                token, salt, sid, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                sids, owners = np.concatenate(sids), np.concatenate(owners)
                order = np.lexsort((owners, sids))
                smallest = owners[order][np.searchsorted(sids[order], sid)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, salt, sid.view(np.int64), n, pos, smallest)],
                                                 names=["token", "salt", "sid", "n", "pos", "key"])

    return docs.select("key", "text").mapInArrow(run, "token long, salt int, sid long, n int, pos int, key long")


def suffix_allows(a: np.ndarray, b: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the sets' symmetric difference, by halving around pivots; stops above ``most``."""
    apart = abs(len(a) - len(b))
    if depth == 0 or apart > most or not len(a) or not len(b):
        return apart
    pivot = b[len(b) // 2]
    i, j = int(np.searchsorted(a, pivot)), len(b) // 2
    same = int(i < len(a) and a[i] == pivot)
    left = suffix_allows(a[:i], b[:j], most, depth - 1)
    if left + 1 - same > most:
        return left + 1 - same
    return left + suffix_allows(a[i + same:], b[j + 1:], most - left, depth - 1) + 1 - same


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, from the whole texts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        room = HELD

        def own_set(key: int, value) -> np.ndarray:
            nonlocal room
            if key not in held:
                data = np.frombuffer(value.as_buffer(), np.uint8)
                found = document_sets(data, np.array([len(data)]), width)[0]
                room -= len(found)
                if room < 0:
                    held.clear()
                    room = HELD
                held[key] = found
            return held[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            keep = []
            for i in range(batch.num_rows):
                one, other = own_set(a[i], text_a[i]), own_set(b[i], text_b[i])
                total = len(one) + len(other)
                least = -(-percent * total // (100 + percent))
                if suffix_allows(one, other, total - 2 * least) <= total - 2 * least:
                    both = np.concatenate([one, other])
                    both.sort()
                    if int((both[1:] == both[:-1]).sum()) >= least:
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())),
                                              batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    # only texts of documents in pairs are moved
    texts = holding(texts.select("key", "text"), pairs.select(F.explode(F.array("a", "b")).alias("key")))
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def possible(x: str, y: str, percent: int):
    """Length and positional filter on two rows of one group."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = 1 + F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) - 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (n + m))


def extended(named: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the names of the old ones are connected anew."""
    of_a = named.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = named.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    new = components(links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = named.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return cut_lineage(old.unionByName(new.join(named, "node", "left_anti")))


def linked_components(docs: DataFrame, counts: np.ndarray, width: int = WIDTH, percent: int = PERCENT, small: int = SMALL,
                      hot: int = HOT) -> DataFrame:
    """(node, component) of the keys that have a link to a different set, one key a set."""
    spark = docs.sparkSession
    held = prefixes(docs, counts, width, percent, hot).repartition("token", "salt")
    held = held.groupBy("token", "salt", "sid", "n", "pos").agg(F.min("key").alias("key"))
    together = F.count(F.lit(1)).over(Window.partitionBy("token", "salt"))
    shared = cut_lineage(held.withColumn("members", together).filter("members > 1 OR salt > 0")
                         .select("token", "salt", "n", "pos", "key", "members"))
    release(spark)
    whole = shared.filter("salt > 0").groupBy("token").agg(F.count(F.lit(1)).alias("of_all"))
    rows = shared.join(whole, "token", "left").select(
        "token", "n", "pos", "key", F.coalesce("of_all", "members").alias("members")).filter("members > 1")
    few = rows.filter(F.col("members") <= small)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key")) & possible("x", "y", percent))
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()

    large = rows.filter(F.col("members") > small)
    before = Window.partitionBy("key").orderBy("pos", "token").rowsBetween(Window.unboundedPreceding, -1)
    large = cut_lineage(large.withColumn("earlier", F.collect_list("token").over(before)))
    crowded = not large.isEmpty()

    def met(members: DataFrame, turn: int) -> DataFrame:
        """Each member with a few others, in a random order of the turn, inside rows of bounded length."""
        lot = F.xxhash64("key", "token", F.lit(turn))
        row = F.pmod(F.xxhash64("token", "key", F.lit(-turn - 1)), F.ceil(F.col("members") / ROW))
        order = Window.partitionBy("token", "row").orderBy("lot", "key")
        dealt = members.withColumns({"lot": lot, "row": row})
        near = F.array(*[F.lead(F.struct("key", "n", "pos"), k).over(order) for k in range(1, NEAR + 1)])
        found = dealt.withColumn("near", near).select(
            F.struct("key", "n", "pos").alias("x"), F.explode("near").alias("y")).filter("y IS NOT NULL")
        return found.filter(possible("x", "y", percent)).select(
            F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()

    if crowded:
        pairs = pairs.unionByName(met(large, 0)).distinct()
    tried = cut_lineage(pairs)
    found = cut_lineage(linked(tried, docs, width, percent))
    release(spark)
    named = components(found)
    if not crowded:
        return named
    texts = cut_lineage(docs.select("key", "text").join(large.select("key").distinct(), "key", "left_semi"))
    before = None
    for turn in range(1, ROUNDS + 1):
        named = cut_lineage(named)
        placed = cut_lineage(large.join(named.withColumnRenamed("node", "key"), "key", "left").withColumn(
            "component", F.coalesce("component", "key")))
        mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        open_ = placed.join(mixed.select("token"), "token", "left_semi")
        parts = open_.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
        cross, members = parts.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.sum("m")).first()
        if not cross:
            return named
        last = turn == ROUNDS or cross <= CROSS * members and turn > 1 or before is not None and cross > before / 2
        before = cross
        if last:
            x, y = open_.alias("x"), open_.alias("y")
            more = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key"))
                          & (F.col("x.component") != F.col("y.component")) & possible("x", "y", percent)
                          & ~F.arrays_overlap("x.earlier", "y.earlier"))
            more = more.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        else:
            degree = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("d"))
            hubs = open_.join(degree, "key").groupBy("token").agg(
                F.max_by(F.struct("key", "component"), F.struct("d", "key")).alias("hub"))
            to_hub = open_.join(hubs, "token").filter("component != hub.component").select(
                F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b"))
            more = met(open_, turn).unionByName(to_hub).distinct()
        more = cut_lineage(more.join(tried, ["a", "b"], "left_anti"))
        fresh = cut_lineage(linked(more, texts, width, percent))
        named = extended(named, fresh)
        if last:
            return named
        found, tried = found.unionByName(fresh), tried.unionByName(more)
        release(spark)
    return named


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id, key) for every row of ``docs``.

    NULL texts and texts without words have no shingles and stand alone. Rows that share a doc_id
    are documents of their own; NULL ids are named last, so a component is NULL only if all its
    ids are. Equal sets meet as one, however many documents have them.
    """
    return groups(keyed(docs), width, percent, small, hot)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those whose component holds a smaller doc_id, all columns kept."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    rows = keyed(whole, ["row"])
    first = groups(rows.select("key", "doc_id", "text"), width, percent).filter("first").select("key")
    return rows.join(first, "key", "left_semi").select("row.*")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """``similar_groups`` of rows that have a key."""
    told = cut_lineage(summaries(docs, width))
    counts = frequencies(told.filter("chunk IS NOT NULL"))
    sets = told.filter("chunk IS NULL").select("key", "n", "sid", "sid2")
    named = linked_components(docs, counts, width, percent, small, hot)
    same = sets.filter("n > 0").groupBy("n", "sid", "sid2").agg(F.min("key").alias("first"))
    same = same.join(named.withColumnRenamed("node", "first"), "first", "left").select(
        F.col("n").alias("of_n"), F.col("sid").alias("of_sid"), F.col("sid2").alias("of_sid2"),
        F.coalesce("component", "first").alias("component"))
    joined = sets.join(same, (F.col("n") == F.col("of_n")) & (F.col("sid") == F.col("of_sid"))
                       & (F.col("sid2") == F.col("of_sid2")), "left")
    joined = joined.select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"))
    ids = docs.select("key", "doc_id")
    own = ids.join(joined, "key")
    return own.join(ids.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id")), "component").select(
        "doc_id", "n_shingles", "component_id", "key", (F.col("key") == F.col("component")).alias("first"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


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
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * c >= 85 * (n + m - c)),
twoway AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE t(x, y) AS (SELECT a, b FROM twoway UNION SELECT t.x, w.b FROM t JOIN twoway w ON t.y = w.a)
  SELECT x, min(y) AS y FROM t GROUP BY x
)
SELECT s.doc_id, len(set)::BIGINT AS n_shingles, coalesce(least(r.y, s.doc_id), s.doc_id) AS component_id
FROM s LEFT JOIN r ON s.doc_id = r.x
"""

QUERIES = {"op9_jaccard": op9_jaccard}
ORACLES = {"op9_jaccard": SQL}
