"""Prefix trie of conversations in balanced parentheses, built shard by shard.

Every turn gets a digest, and running sums over a conversation's turns name each of its prefixes,
so a node is a name and a depth. What only one conversation has is a chain; its top is the last
node of it that goes into the trie. The paths of the trie, each once, are put in order and cut into
shards by ranges, so a shared prefix of any weight is spread. A shard writes its part as balanced
parentheses: blocks with the least and largest excess find each node's closing place, and with
it its subtree, a range of nodes; the rank of "()" counts the leaves in it, and cumulative arrays
its conversations and savings. Only nodes on a shard's first and last path can belong to more
shards. These spines are merged at the end by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read, running_sums

WORD = r"[^\x20\x09-\x0D]+"
#: Places of the parentheses a block of the excess covers.
BLOCK = 256
#: Ways over which the rows of one conversation or node are spread.
SALTS = 16
#: Turns of a conversation that share a row's salt when its path is put together.
STRETCH = 4_096
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A forest in preorder as parentheses: its nodes' depths, with excess blocks to find closing places."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.open = 2 * np.arange(n) - (depth - (depth[0] if n else 0))
        bits = np.zeros(2 * n, np.int64)
        bits[self.open] = 1
        self.bits = bits
        self.excess = np.cumsum(2 * bits - 1)
        padded = np.full(-(-max(1, len(bits)) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        self.blocks = padded.reshape(-1, BLOCK)
        self.levels = [self.blocks.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.levels.append(low.reshape(-1, 2).min(axis=1))
        #: Leaves, the pairs "()", before each place.
        pair = np.zeros(len(bits) + 1, np.int64)
        if n:
            pair[1:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.rank = np.cumsum(pair)

    def close(self, places: np.ndarray) -> np.ndarray:
        """The closing place of each opening one: the first behind it whose excess is smaller."""
        out = np.empty(len(places), np.int64)
        for a in range(0, len(places), 4096):
            p = places[a:a + 4096]
            block, below = p // BLOCK, self.excess[p]
            fits = (self.blocks[block] < below[:, None]) & (np.arange(BLOCK) > (p % BLOCK)[:, None])
            at = block * BLOCK + fits.argmax(axis=1)
            far = np.flatnonzero(~fits.any(axis=1))
            node, level = block[far], np.zeros(len(far), np.int64)
            want, up = below[far], np.ones(len(far), bool)
            for h in range(len(self.levels) - 1):  # up to the first right neighbour that goes low enough
                low = self.levels[h]
                right = np.minimum(node + 1, len(low) - 1)
                found = up & (node % 2 == 0) & (node + 1 < len(low)) & (low[right] < want)
                node = np.where(found, right, node)
                level[found] = h
                up &= ~found
                node = np.where(up, node // 2, node)
            for h in range(len(self.levels) - 2, -1, -1):  # and down to its first such block
                down = level > h
                left = 2 * node
                low = self.levels[h]
                node = np.where(down, np.where(low[np.minimum(left, len(low) - 1)] < want, left, left + 1), node)
            if len(far):
                at[far] = node * BLOCK + (self.blocks[node] < want[:, None]).argmax(axis=1)
            out[a:a + 4096] = at
        return out


def least_in_ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """min(values[start:stop]) for many ranges that are not empty, from minima over powers of two."""
    width = np.int64(1)
    out = np.empty(len(start), np.int64)
    size = (stop - start).astype(np.int64)
    row = values
    while True:
        own = (size >= width) & (size < 2 * width)
        out[own] = np.minimum(row[start[own]], row[stop[own] - width])
        if not (size >= 2 * width).any():
            return out
        row = np.minimum(row[:-width], row[width:]) if len(row) > width else row
        width *= 2


NODE = "depth long, hi long, lo long, phi long, plo long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
SHARD = f"{NODE}, parent_conv_id long, words long, ends string, spine string, shard long"


def shard_nodes(table: pa.Table, shard: int) -> pa.Table:
    """The nodes of one shard from its paths (hi, lo, words, n, least, more, ends), in order and all different.

    On the first or last path (``spine``: c on both, f, l), counts leave out other such nodes; elsewhere they are final.
    """
    hi, lo, words = (table.column(c).combine_chunks() for c in ("hi", "lo", "words"))
    first = hi.offsets.to_numpy().astype(np.int64)
    length = np.diff(first)
    rows = len(length)
    hi, lo, words = (x.values.to_numpy() for x in (hi, lo, words))
    row = np.repeat(np.arange(rows), length)
    depth = np.arange(len(hi)) - first[row]
    same = np.zeros(len(hi), bool)
    before = np.where(row > 0, first[row - 1] + depth, 0)
    inside = (row > 0) & (depth < length[row - 1])
    same[inside] = (hi[inside] == hi[before[inside]]) & (lo[inside] == lo[before[inside]])
    common = np.minimum.reduceat(np.where(same, length[row], depth), first[:-1])
    new = np.flatnonzero(depth >= common[row])
    end_of = np.cumsum(np.bincount(row[new], minlength=rows)) - 1  # the node at which a path ends is its last new one
    row, depth, hi, lo, words = row[new], depth[new], hi[new], lo[new], words[new]
    n = len(new)
    tree = Parentheses(depth)
    closing = tree.close(tree.open)
    after = np.arange(n) + (closing - tree.open + 1) // 2

    weight, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    weight[end_of], least[end_of] = table.column("n").to_numpy(), table.column("least").to_numpy()
    more, ends = np.zeros(n, bool), np.full(n, None, object)
    more[end_of], ends[end_of] = table.column("more").to_numpy(zero_copy_only=False), table.column("ends").to_pylist()

    def within(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
        return sums[after] - sums[:n]

    n_convs, conv = within(weight), least_in_ranges(least, np.arange(n), after)
    by_level = np.sort(depth * n + np.arange(n))
    parent = by_level[np.maximum(np.searchsorted(by_level, (depth - 1) * n + np.arange(n)) - 1, 0)] % n
    on_first, on_last = np.zeros(n, bool), np.zeros(n, bool)
    on_first[:length[0]] = True
    step = n - 1
    while True:
        on_last[step] = True
        if depth[step] == 0:
            break
        step = parent[step]
    spine = on_first | on_last
    kids = np.searchsorted(by_level, (depth + 1) * n + after) - np.searchsorted(by_level, (depth + 1) * n + np.arange(n))
    kids = kids - np.bincount(parent[spine & (depth > 0)], minlength=n) + more
    leaf = tree.rank[closing + 1] - tree.rank[tree.open]  # leaves of each subtree
    leaf_here = after == np.arange(n) + 1
    leaves = leaf - within(leaf_here & spine)
    saved = within(np.where(spine, 0, (n_convs - 1) * words))
    marks = np.where(on_first & on_last, "c", np.where(on_first, "f", "l")).astype(object)
    marks[~spine] = None
    top = depth == 0
    up_conv = pa.array(conv[parent], mask=top | spine[parent])
    return pa.table(
        [depth, hi, lo, pa.array(hi[parent], mask=top), pa.array(lo[parent], mask=top), conv, n_convs, kids, leaves, saved,
         up_conv, words, pa.array(ends.tolist(), pa.string()), pa.array(marks.tolist(), pa.string()), np.full(n, shard)],
        names=[c.split()[0] for c in SHARD.split(", ")])


def trie_of(paths: DataFrame) -> DataFrame:
    """All nodes (NODE, parent_conv_id, ends) of the trie of ``paths`` (path, hi, lo, words, n, least, more, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), TaskContext.get().partitionId()).to_batches()

    ordered = paths.repartitionByRange("path").sortWithinPartitions("path").drop("path")
    nodes = cut_lineage(ordered.mapInArrow(run, SHARD))
    name = ["depth", "hi", "lo"]
    spines = nodes.filter("spine IS NOT NULL")
    merged = cut_lineage(spines.groupBy(*name).agg(
        *[F.max(c).alias(c) for c in ("phi", "plo", "words", "ends")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("shard").alias("owner")))
    # each spine node adds its own saving, and itself if it is a leaf, to the spine nodes above it: once, in one shard
    of_parent = merged.filter("phi IS NOT NULL").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("spines"))
    whole = cut_lineage(merged.join(of_parent, name, "left").withColumn("n_children", F.col("n_children") + F.coalesce("spines", F.lit(0))))
    own = spines.select(*name, "shard", "spine").join(
        whole.select(*name, F.col("owner").alias("shard"), ((F.col("n_convs") - 1) * F.col("words")).alias("saves"),
                     (F.col("spines").isNull() & (F.col("n_leaves") == 0)).cast("long").alias("leaf")), [*name, "shard"], "left").na.fill(0, ["saves", "leaf"])
    below = Window.partitionBy("shard", "spine").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    apart = Window.partitionBy("shard")

    def summed(c: str) -> Column:
        return F.sum(c).over(below) + F.when(F.col("spine") == "c", F.sum(F.when(F.col("spine") != "c", F.col(c))).over(apart)).otherwise(0)

    added = own.select(*name, *[F.coalesce(summed(c), F.sum(c).over(below)).alias(c) for c in ("saves", "leaf")]).groupBy(*name).agg(
        F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    total = cut_lineage(whole.join(added, name).withColumns(
        {"saved_tokens": F.col("saved_tokens") + F.col("saves"), "n_leaves": F.col("n_leaves") + F.col("leaf")}))
    named = total.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"),
                         F.col("conv_id").alias("of_parent"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keep = [c.split()[0] for c in NODE.split(", ")]
    rest = nodes.filter("spine IS NULL").select(*keep, "parent_conv_id", "ends").unionByName(
        total.select(*keep, F.lit(None).cast("long").alias("parent_conv_id"), "ends"))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS)).cast("int"))
    return rest.join(named, ["depth", "phi", "plo", "salt"], "left").select(
        *keep, F.coalesce("parent_conv_id", "of_parent").alias("parent_conv_id"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, h1, h2, words): each turn's number in its conversation, a 128-bit digest of role and text, its words.

    Turns are ordered by ``turn``, NULL first; those of one number by their digests. NULL roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).alias("one"))
    numbered = running_sums(rows, ["conv_id"], ["turn", "h1", "h2"], ["one"], ["words"])
    return cut_lineage(numbered.select("conv_id", F.col("before_one").cast("long").alias("p"), "h1", "h2", "words"))


def _salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def with_borrowed_starts(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations and their ids, turnless ones too.

    Of conversation c the first h turns, h its id's CRC-32 modulo ``most`` + 1, are those of c - c % group: as many as
    that one has, none if it is absent. Its own turns after the first h follow.
    """
    convs = cut_lineage(turns.select("conv_id").distinct().withColumns(
        {"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), "base": F.col("conv_id") - F.col("conv_id") % group}))
    heads = turns.filter(F.col("p") < most).withColumnRenamed("conv_id", "base")
    start = convs.join(heads, "base").filter("p < h").select("conv_id", "p", "h1", "h2", "words")
    there = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    moved = convs.join(there, "base", "left").select(
        "conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = turns.withColumn("salt", F.pmod("p", F.lit(SALTS)).cast("int")).join(moved, ["conv_id", "salt"]).filter("p >= h").select(
        "conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "h1", "h2", "words")
    return cut_lineage(start.unionByName(own)), convs.select("conv_id")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node.

    ``turns`` (conv_id, p, h1, h2, words) are numbered from 0 without gaps, ``convs`` are all ids, those without turns
    too. The root has depth 0 and is there unless there is no conversation. Nodes are told apart by 128-bit names.
    A path of the trie is one row: as long as the turns that a conversation shares with others, and one. SHA-256 takes its input
    in order, so the ids that end at one node go through one task, as a sorted stream that is not held.
    """
    x, y = F.xxhash64("h1", "h2", "p"), F.xxhash64("p", "h2", "h1")
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = {"m0": x.bitwiseAND(low), "m1": F.shiftrightunsigned(x, 32), "m2": y.bitwiseAND(low), "m3": F.shiftrightunsigned(y, 32)}
    sums = running_sums(turns.withColumns(parts), ["conv_id"], ["p"], list(parts), ["words"])

    def name(a: Column, b: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(low), 32).bitwiseOR(b.bitwiseAND(low))

    at = {m: F.col(f"before_{m}") + F.col(m) for m in parts}
    found = cut_lineage(sums.select(
        "conv_id", (F.col("p") + 1).alias("depth"), name(at["m0"], at["m1"]).alias("hi"), name(at["m2"], at["m3"]).alias("lo"),
        name(F.col("before_m0"), F.col("before_m1")).alias("phi"), name(F.col("before_m2"), F.col("before_m3")).alias("plo"), "words"))
    single = cut_lineage(found.groupBy("depth", "hi", "lo").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1").select("conv_id", "depth"))
    tops = single.groupBy("conv_id").agg(F.min("depth").alias("top"))
    last = found.groupBy("conv_id").agg(F.max(F.struct("depth", "hi", "lo")).alias("last"))
    zero = F.lit(0).cast("long")
    ways = cut_lineage(convs.join(last, "conv_id", "left").join(tops, "conv_id", "left").select(
        "conv_id", F.coalesce("last.depth", zero).alias("length"), F.coalesce("last.hi", zero).alias("hi"),
        F.coalesce("last.lo", zero).alias("lo"), "top"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha, n, least, length = None, None, 0, 0, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"conv_id": least, "cut": length, "n": n, "more": False, "ends": sha.hexdigest()}],
                pa.schema([("conv_id", pa.int64()), ("cut", pa.int64()), ("n", pa.int64()), ("more", pa.bool_()), ("ends", pa.string())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, conv = (batch.column(c).to_numpy() for c in ("hi", "lo", "conv_id"))
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(hi) != 0) | (np.diff(lo) != 0)]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hi)], strict=True):
                joined = ",".join(map(str, conv[a:b].tolist()))
                if held != (hi[a], lo[a]):
                    if held is not None:
                        yield told()
                    held, sha, n, least = (hi[a], lo[a]), hashlib.sha256(), 0, int(conv[a])
                    length = batch.column("length")[a].as_py()
                sha.update((("," if n else "") + joined).encode())
                n += b - a
        if held is not None:
            yield told()

    shared_ends = ways.filter("top IS NULL").select("hi", "lo", "conv_id", "length").repartition("hi", "lo").sortWithinPartitions(
        "hi", "lo", "conv_id").mapInArrow(stream, "conv_id long, cut long, n long, more boolean, ends string")
    sha_of_one = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    alone = ways.filter("top IS NOT NULL").select(
        "conv_id", F.col("top").alias("cut"), F.lit(1).cast("long").alias("n"), (F.col("length") > F.col("top")).alias("more"),
        F.when(F.col("length") == F.col("top"), sha_of_one).alias("ends"))
    leaves = cut_lineage(shared_ends.unionByName(alone))
    stretch = F.floor((F.col("depth") - 1) / STRETCH)
    pieces = leaves.filter("cut > 0").select("conv_id", "cut", F.explode(F.sequence(F.lit(0), F.floor((F.col("cut") - 1) / STRETCH))).alias("stretch"))
    steps = found.withColumn("stretch", stretch).join(pieces, ["conv_id", "stretch"]).filter("depth <= cut")
    paths = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "hi", "lo", "words"))).alias("path"))
    root = F.array(F.struct(zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), zero.alias("words")))
    paths = leaves.join(paths, "conv_id", "left").withColumn("path", F.concat(root, F.coalesce("path", F.expr("array()").cast("array<struct<depth:bigint,hi:bigint,lo:bigint,words:bigint>>"))))
    paths = cut_lineage(paths.select("path", *[F.col(f"path.{c}").alias(c) for c in ("hi", "lo", "words")], "n",
                                     F.col("conv_id").alias("least"), "more", "ends"))
    nodes = trie_of(paths).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                  F.col("ends").alias("ends_sha256"))
    # a conversation's own chain below its top
    chain = single.withColumn("salt", F.pmod("depth", F.lit(SALTS)).cast("int")).join(
        ways.filter("length > top").select("conv_id", "length", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")),
        ["conv_id", "salt"]).filter("depth > top")
    one = F.lit(1).cast("long")
    ended = F.col("depth") == F.col("length")
    return nodes.unionByName(chain.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(ended, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(ended, sha_of_one).otherwise(F.lit(NO_ENDS)).alias("ends_sha256")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_borrowed_starts(turn_digests(read(spark, sf_dir, "conversations"))))


SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t), crc
), r AS (
  SELECT c.c, 0 AS part, p, role, text FROM c JOIN t ON t.c = c.base AND p < h
  UNION ALL SELECT c.c, 1, p, role, text FROM c JOIN t ON t.c = c.c AND p >= h
), q AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, md5(md5(role) || md5(text)) AS k,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r
), o AS (
  SELECT c, 0 AS d, '' AS node, 0 AS w FROM c
  UNION ALL SELECT c, d, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)), w FROM q
), o2 AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ended FROM o
), n AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, any_value(up) AS up,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends
  FROM o2 GROUP BY node, d
), kids AS (SELECT up AS node, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
s AS (
  SELECT o.node, o.d, sum((n.n - 1) * n.w)::BIGINT AS saved, count(*) FILTER (kids.node IS NULL) AS leaves
  FROM n LEFT JOIN kids USING (node, d) JOIN o ON o.c = n.conv_id AND o.d <= n.d
  GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s USING (node, d) LEFT JOIN kids USING (node, d) LEFT JOIN n p ON p.node = n.up AND p.d = n.d - 1
"""

QUERIES = {"op11_conversation_trie": op11_conversation_trie}
ORACLES = {"op11_conversation_trie": SQL}
