"""A trie of all prefixes of conversations, by Spark SQL's ROLLUP over positional columns of turn ids.

A conversation is cut into column blocks of ``BLOCK`` turns, one row each: the key of the node that the blocks before lead to, then the ids of its turns.
``ROLLUP`` over these columns makes every prefix a group, ``grouping_id`` tells its depth, and a longer conversation goes on in
further rows keyed by the node before. A node's key is its depth and two 64-bit sums (xor) of hashes of its turns and their places, so that the key before any
block comes from a running xor over blocks, in stretches.

Subtrees need no walk. Every node is owned by its smallest member; a conversation owns its nodes from some depth to its end. What a subtree holds
is therefore a sum over the members of its top: words beyond that depth which are shared with a smaller member, and whether a
member owns a leaf. A second ROLLUP over the same rows sums it up, so the work grows with turns, not with turns times depth.

Defined results. NULL role and text are empty; NULL turns come first; equal turns go by role, then text; repeated rows are turns of their own. A row without
conv_id belongs to no conversation. A conversation without turns ends at the root. An empty table has no node. Very long texts are only hashed and
counted. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import numbered
from ..session import stored

BLOCK = 8  # turns in a row of columns
STRETCH = 256  # blocks of one conversation that one window orders
HEAD = 3  # turns that a conversation can take over from another
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, position from 1, ``tid`` (a digest of role and text) and ``words``; one row per turn, stored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    placed = numbered(turns, order, "_n").select("conv_id", "_n", digest.alias("tid"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    placed = stored(placed, "trie-turns")
    first = placed.groupBy("conv_id").agg(F.min("_n").alias("_first"))
    return stored(placed.join(first, "conv_id").select("conv_id", (F.col("_n") - F.col("_first") + 1).alias("position"), "tid", "words"), "trie-turns")


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns after every conversation has got the head of conversation ``conv_id - conv_id % 20``.

    A head has as many turns as the checksum of the id says, 3 at most; one conversation gives its head to 20.
    """
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("_base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("_h"))
    donors = turns.where((F.col("conv_id") % 20 == 0) & (F.col("position") <= HEAD)).withColumnRenamed("conv_id", "_base")
    heads = wanted.join(donors, "_base").where("position <= _h").select("conv_id", "position", "tid", "words")
    lengths = heads.groupBy("conv_id").agg(F.count("*").alias("_had"))
    have = wanted.join(lengths, "conv_id", "left").select("conv_id", "_h", F.coalesce("_had", F.lit(0)).alias("_had"))
    tails = turns.join(have, "conv_id").where("position > _h").select("conv_id", (F.col("position") - F.col("_h") + F.col("_had")).alias("position"), "tid", "words")
    return heads.unionByName(tails)


def _lanes(depth: Column, tid: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth.cast("long"), tid), F.xxhash64(tid, depth.cast("long"), F.lit("second"))


def column_blocks(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: b, keys k1 and k2 of the node before it, t1.. (NULL beyond the end), w1.., and ``words`` before it.

    Every id has a row of block 0, also without turns.
    """
    b, at = F.floor((F.col("position") - 1) / block).cast("long"), ((F.col("position") - 1) % block + 1)
    z1, z2 = _lanes(F.col("position"), F.col("tid"))
    keyed = turns.unionByName(ids.select("conv_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("binary").alias("tid"), F.lit(0).cast("long").alias("words")))
    rows = keyed.groupBy("conv_id", F.coalesce(b, F.lit(0)).alias("b")).agg(
        *[F.max(F.when(at == i, F.col("tid"))).alias(f"t{i}") for i in range(1, block + 1)],
        *[F.coalesce(F.max(F.when(at == i, F.col("words"))), F.lit(0)).alias(f"w{i}") for i in range(1, block + 1)],
        F.coalesce(F.bit_xor(F.when(F.col("tid").isNotNull(), z1)), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor(F.when(F.col("tid").isNotNull(), z2)), F.lit(0)).alias("x2"),
        F.sum("words").alias("_w"), F.count("tid").alias("_n"))
    rows = stored(rows, "trie-blocks").withColumn("_s", F.floor(F.col("b") / STRETCH))
    # what lies before a block: within its stretch, and over the stretches before
    measures = {"k1": (F.bit_xor, "x1"), "k2": (F.bit_xor, "x2"), "before": (F.sum, "_w")}
    within = Window.partitionBy("conv_id", "_s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    stretches = rows.groupBy("conv_id", "_s").agg(*[f(x).alias(f"_{n}") for n, (f, x) in measures.items()])
    stretches = stretches.select("conv_id", "_s", *[F.coalesce(f(f"_{n}").over(across), zero).alias(f"_{n}") for n, (f, _) in measures.items()])
    local = rows.withColumns({n: F.coalesce(f(x).over(within), zero) for n, (f, x) in measures.items()})
    add = lambda n: F.col(n) + F.col(f"_{n}") if n == "before" else F.col(n).bitwiseXOR(F.col(f"_{n}"))
    both = local.join(stretches, ["conv_id", "_s"]).withColumns({n: add(n) for n in measures})
    return stored(both.drop("_s", "_w", *[f"_{n}" for n in measures]), "trie-keyed")


def rolled_up(blocks: DataFrame, measures: dict[str, str], block: int = BLOCK) -> DataFrame:
    """All prefixes of column blocks: depth, keys n1 and n2 of the node and p1 and p2 of its parent (NULL for the root), and the measures.

    A measure is SQL for an aggregate; ``{i}`` in it stands for the depth within the block, of which the right one is taken.
    """
    columns = [f"t{i}" for i in range(1, block + 1)]
    many = {n: e for n, e in measures.items() if "{i}" in e}
    one = {n: e for n, e in measures.items() if n not in many}
    said = [f"{e} AS {n}" for n, e in one.items()] + [f"{e.format(i=i)} AS {n}_{i}" for n, e in many.items() for i in range(block + 1)]
    groups = blocks.sparkSession.sql(
        f"SELECT b, k1, k2, {', '.join(columns)}, grouping_id() AS g, {', '.join(said)} FROM {{blocks}} GROUP BY ROLLUP ((b, k1, k2), {', '.join(columns)})", blocks=blocks)
    level = F.lit(block) - F.log2(F.col("g") + 1).cast("int")  # a bit per column that is rolled up
    at = F.array(*[F.col(c).isNotNull() for c in columns])
    real = groups.where(F.col("g") < 1 << block).withColumn("_i", level).where(
        F.when(F.col("_i") == 0, F.col("b") == 0).otherwise(F.element_at(at, F.greatest("_i", F.lit(1)))))
    depth = F.col("b") * block + F.col("_i")

    def key(lane: int, less: int) -> Column:
        out = F.col(f"k{lane + 1}")
        for i, c in enumerate(columns, 1):
            out = out.bitwiseXOR(F.when(F.col("_i") - less >= i, _lanes(F.col("b") * block + i, F.col(c))[lane]).otherwise(F.lit(0)))
        return out

    up = lambda lane: F.when(depth > 0, key(lane, 1))
    chosen = [F.element_at(F.array(*[F.col(f"{n}_{i}") for i in range(block + 1)]), F.col("_i") + 1).alias(n) for n in many]
    return real.select(depth.alias("depth"), key(0, 0).alias("n1"), key(1, 0).alias("n2"), up(0).alias("p1"), up(1).alias("p2"), *one, *chosen)


def _ends(blocks: DataFrame, block: int) -> DataFrame:
    """conv_id, depth, n1 and n2 of the node where each conversation ends, and all its words."""
    last = F.struct("b", "_n", "k1", "k2", "x1", "x2")
    own = sum((F.col(f"w{i}") for i in range(2, block + 1)), F.col("w1"))
    found = blocks.groupBy("conv_id").agg(F.max(last).alias("_l"), F.max(F.col("before") + own).alias("all_words"))
    return found.select("conv_id", (F.col("_l.b") * block + F.col("_l._n")).alias("depth"), F.col("_l.k1").bitwiseXOR(F.col("_l.x1")).alias("n1"),
                        F.col("_l.k2").bitwiseXOR(F.col("_l.x2")).alias("n2"), "all_words")


def ends_digest(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids that end there, ascending and joined by commas, hashed as a stream."""
    schema = pa.schema([("depth", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node == now:
                    sha.update(f",{conv}".encode())
                    continue
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(str(conv).encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), schema.types)], schema=schema) if done else pa.RecordBatch.from_pylist([], schema)
            done = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, sha.hexdigest())))], schema)

    keys = ["depth", "n1", "n2"]
    return ends.select(*keys, "conv_id").repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(work, "depth long, n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, position from 1, tid, words) of the conversations ``ids``."""
    node = ["depth", "n1", "n2"]
    rows = column_blocks(turns, ids, block)
    nodes = stored(rolled_up(rows, {"n_convs": "count(*)", "conv_id": "min(conv_id)"}, block), "trie-nodes")
    parents = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    counted = stored(nodes.join(parents, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-counted")
    # from which depth a conversation owns its nodes, the words up to there, and whether its last node is a leaf
    since = counted.groupBy("conv_id").agg(F.min("depth").alias("_since"), F.max((F.col("n_children") == 0).cast("long")).alias("_leaf"))
    before = F.col("before")
    up_to = [before]
    for i in range(1, block + 1):
        up_to.append(up_to[-1] + F.col(f"w{i}"))
    ends = stored(_ends(rows, block), "trie-ends")
    upper = F.array(*up_to)  # words of the first b * block + i turns
    own_block = F.floor(F.greatest(F.col("_since") - 1, F.lit(0)) / block)
    inside = rows.join(since, "conv_id").where(F.col("b") == own_block).select(
        "conv_id", "_leaf", F.when(F.col("_since") > 0, F.element_at(upper, (F.col("_since") - 1 - F.col("b") * block + 1).cast("int"))).otherwise(F.lit(0)).alias("_shared"))
    per = ends.select("conv_id", "all_words").join(inside, "conv_id", "left").select(
        "conv_id", F.coalesce("_leaf", F.lit(0)).alias("_leaf"), F.coalesce("_shared", "all_words").alias("_shared"))
    levels = {f"s{i}": F.greatest(F.lit(0), F.col("_shared") - (up_to[i - 1] if i else F.lit(0))) for i in range(block + 1)}
    summed = rolled_up(rows.join(per, "conv_id").withColumns(levels), {"n_leaves": "sum(_leaf)", "saved_tokens": "sum(s{i})"}, block).drop("p1", "p2")
    over = counted.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return counted.join(summed, node).join(over, ["depth", "p1", "p2"], "left").join(ends_digest(ends), node, "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def rebuilt_trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of all conversations of ``rows`` (conv_id, turn, role, text), rebuilt."""
    ids = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = stored(ids, "trie-ids")
    return trie(stored(rebuilt(ordered_turns(rows), ids), "trie-rebuilt"), ids, block)
