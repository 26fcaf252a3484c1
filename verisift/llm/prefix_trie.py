"""Prefix trie of conversations, rolled up by pointer jumping (Spark).

A node is a distinct beginning of a conversation. Its key is a digest: the exclusive or of two 64-bit hashes of each of its turns, taken
with the turn's place, so that digests are running values that are computed in blocks and no conversation is walked turn by turn in one task. Edges
lead from a digest to that of the beginning one turn shorter. Sums over subtrees come from doubling: in round r each node
adds what it has gathered to the node 2^r above it, and points 2^(r+1) up from then on, so a trie of depth D takes log2(D) rounds.

Edge cases: null roles and texts are empty; rows without conv_id belong to no conversation; turns of equal number (null ones come first)
stand in the order of the digest of role and text, equal rows count each; a conversation without turns is a member of the root
alone; no conversations give no node. Other columns are not read. Very long texts are hashed in the scan and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.llm.common import drop_staged, parts, small_side, staged, table
from verisift.operators.numbering import numbered

#: Turns of the shared beginning, at most, and conversations that share one.
HEADS, SHARING = 6, 100
#: Turns of a conversation whose digests one window runs over, and ids that are joined to one text.
BLOCK, IDS = 512, 4096


def turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of a turn's role and text."""
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 0), key and chars of each turn; staged by the numbering."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_key(role, text).alias("key"), F.char_length(text).alias("chars"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),  # ranges may part equal rows
    )
    return numbered(rows, ["conv_id"], ["turn", "key", "salt"], "n").select("conv_id", (F.col("n") - 1).alias("i"), "key", "chars")


def rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, depth from 1, key, chars) of the rebuilt conversations, and (c, len) of each of them. A conversation begins with the first h turns of
    the one that it shares its beginning with, and goes on with its own after its first h."""
    shared = lambda c: c - c % SHARING
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    sizes = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = t.where((F.col("i") < HEADS) & (F.col("conv_id") % SHARING == 0)).select(F.col("conv_id").alias("b"), "i", "key", "chars")
    bases = staged(first.groupBy("b").agg(F.count(F.lit(1)).alias("nb")), "trie-bases")
    c = F.col("conv_id")
    at = F.least(h(c), F.coalesce("nb", F.lit(0)))
    convs = sizes.join(small_side(bases), shared(c) == F.col("b"), "left").select(c.alias("c"), h(c).alias("h"), (at + F.greatest(F.col("n") - h(c), F.lit(0))).alias("len"))
    head = convs.join(first, shared(F.col("c")) == F.col("b")).where("i < h").select("c", (F.col("i") + 1).alias("depth"), "key", "chars")
    own = t.where(F.col("i") >= h(c)).join(small_side(bases), shared(c) == F.col("b"), "left").select(c.alias("c"), (at + F.col("i") - h(c) + 1).alias("depth"), "key", "chars")
    return head.unionByName(own), convs.select("c", "len")


def digests(r: DataFrame) -> DataFrame:
    """c, depth, chars, the digest (g1, g2) of the first depth turns and that of one turn fewer (p1, p2)."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "key").alias(f"x{seed}") for seed in (1, 2)]
    x = staged(r.select("c", "depth", "chars", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), *hashes), "trie-turns")
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = x.groupBy("c", "block").agg(*[F.bit_xor(f"x{s}").alias(f"b{s}") for s in (1, 2)])
    blocks = blocks.select("c", "block", *[F.coalesce(F.bit_xor(f"b{s}").over(before), F.lit(0)).alias(f"b{s}") for s in (1, 2)])
    within = W.partitionBy("c", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = x.select("*", *[F.bit_xor(f"x{s}").over(within).alias(f"r{s}") for s in (1, 2)]).join(blocks, ["c", "block"])
    g = [F.col(f"b{s}").bitwiseXOR(F.col(f"r{s}")) for s in (1, 2)]
    return run.select("c", "depth", "chars", *[e.alias(f"g{s}") for s, e in enumerate(g, 1)], *[e.bitwiseXOR(F.col(f"x{s}")).alias(f"p{s}") for s, e in enumerate(g, 1)])


def rollup(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (g1, g2, depth, p1, p2: the parent's digest; staged) with each of `sums` summed over its subtree. The root has depth 0.

    After round r a node has gathered what lies less than 2^(r+1) below it. Sums combine before the shuffle; only nodes that
    still point below the root look their pointer up.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    t, step = nodes.select("g1", "g2", "depth", "p1", "p2", *sums), 1
    while step <= deepest:
        up = t.where(F.col("depth") >= step).groupBy(F.col("p1").alias("u1"), F.col("p2").alias("u2"), (F.col("depth") - step).alias("ud")).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        same = (F.col("g1") == F.col("u1")) & (F.col("g2") == F.col("u2")) & (F.col("depth") == F.col("ud"))
        more = t.join(up, same, "left").select("g1", "g2", "depth", "p1", "p2", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])
        over = t.where(F.col("depth") >= step).select(F.col("g1").alias("a1"), F.col("g2").alias("a2"), F.col("depth").alias("ad"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
        far = more.where(F.col("depth") >= 2 * step).join(over, (F.col("p1") == F.col("a1")) & (F.col("p2") == F.col("a2")) & (F.col("depth") - step == F.col("ad")), "left")
        near = more.where(F.col("depth") < 2 * step)
        none = F.lit(None).cast("long")
        new = staged(
            far.select("g1", "g2", "depth", F.col("n1").alias("p1"), F.col("n2").alias("p2"), *sums).unionByName(near.select("g1", "g2", "depth", none.alias("p1"), none.alias("p2"), *sums)), "trie-round"
        )
        if step > 1:
            drop_staged(t)
        t, step = new, 2 * step
    return t.select("g1", "g2", "depth", *sums)


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids that end at each node (g1, g2, depth, c). Ids are joined by blocks first, so
    that the task which hashes a node that very many share reads a few texts, one after another."""
    here = ends.repartitionByRange(parts(ends.sparkSession), "g1", "g2", "depth", "c").sortWithinPartitions("g1", "g2", "depth", "c")
    here = staged(here.withColumn("block", F.shiftright(F.monotonically_increasing_id(), IDS.bit_length() - 1)), "trie-ends")
    ids = F.array_join(F.array_sort(F.collect_list("c")), ",")
    blocks = here.groupBy("g1", "g2", "depth", "block").agg(ids.alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        node, sha, names = None, None, ["g1", "g2", "depth", "ends_sha256"]
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(n).to_pylist() for n in ("g1", "g2", "depth", "ids")), strict=True):
                if key != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, sha.hexdigest())], names=names)

    one = blocks.repartition(parts(ends.sparkSession), "g1", "g2", "depth").sortWithinPartitions("g1", "g2", "depth", "block")
    return one.mapInArrow(run, "g1 long, g2 long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, with members, children, leaves and saved code points of their subtrees."""
    none = F.lit(None).cast("long")
    r, convs = rebuilt(turns(conversations))
    convs = staged(convs, "trie-convs")
    d = staged(digests(r), "trie-digests")
    made = d.groupBy("g1", "g2", "depth", "p1", "p2").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("g1"), zero.alias("g2"), zero.alias("depth"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", F.lit(0).alias("chars"))
    nodes = staged(made.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    key = ["g1", "g2", "depth"]
    x = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    x = staged(x.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars").cast("long")), "trie-edges")
    sums = rollup(x, ["n_leaves", "saved_tokens"])
    last = d.join(convs.where("len > 0").select("c", F.col("len").alias("depth")), ["c", "depth"]).select(*key, "c")
    ended = ends_digests(last.unionByName(convs.where("len = 0").select(zero.alias("g1"), zero.alias("g2"), zero.alias("depth"), "c")))
    # The root's id, one value, goes to its children as it is: a join on its key would bring all of them into one task.
    first = nodes.where("depth = 0").select("conv_id").first()
    top = F.lit(first[0] if first else None).cast("long")
    up = nodes.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")).where("depth > 1")
    deep = x.where("depth > 1").join(up, ["p1", "p2", "depth"])
    flat = x.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, top))
    told = [*key, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    out = deep.select(*told).unionByName(flat.select(*told)).join(sums, key).join(ended, key, "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The checksum of a text as SQL, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({0}, '.'), lambda ch: ord(ch)::BIGINT)),
 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
SQL = f"""WITH RECURSIVE o AS (SELECT conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key, length(coalesce(text, '')) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id AS c, conv_id - conv_id % 100 AS b, {CRC32.format("conv_id::VARCHAR")} % 6 AS h, count(*) AS n FROM o GROUP BY conv_id),
nb AS (SELECT c.c, least(h, count(o.i)) AS nb FROM c LEFT JOIN o ON o.conv_id = c.b AND o.i < c.h GROUP BY c.c, h),
r AS MATERIALIZED (SELECT c, i + 1 AS depth, key, chars FROM c JOIN o ON o.conv_id = b AND i < h UNION ALL SELECT c, nb + i - h + 1, key, chars FROM c JOIN nb USING (c) JOIN o ON o.conv_id = c.c AND i >= h),
p AS MATERIALIZED (SELECT c, 0::BIGINT AS depth, '' AS node, 0::BIGINT AS chars FROM c UNION ALL SELECT r.c, r.depth, sha256(concat(p.node, r.key)), r.chars FROM p JOIN r ON r.c = p.c AND r.depth = p.depth + 1),
m AS (SELECT c, max(depth) AS len FROM p GROUP BY c),
n AS MATERIALIZED (SELECT node, depth, min(p.c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, string_agg(CASE WHEN depth = len THEN p.c::VARCHAR END, ',' ORDER BY p.c) AS ends FROM p JOIN m USING (c) GROUP BY node, depth),
up AS (SELECT DISTINCT a.node, b.node AS parent FROM p a JOIN p b ON a.c = b.c AND a.depth = b.depth + 1),
k AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.c = b.c AND b.depth >= a.depth),
s AS (SELECT top AS node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens FROM below JOIN n ON n.node = below.node LEFT JOIN k ON k.node = below.node GROUP BY top)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN up USING (node) LEFT JOIN n q ON q.node = up.parent LEFT JOIN k ON k.node = n.node JOIN s ON s.node = n.node"""
