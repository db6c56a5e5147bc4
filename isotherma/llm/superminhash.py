"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

Signature. Each element visits all 101 slots in an order of its own; at its j-th slot it offers j plus a fraction. A slot keeps the
least offer. Offers of round j are below those of round j+1, so a set whose slots are all filled stops early. The order is
``a + j b (mod 101)``; for a prime these orders permute any two slots uniformly, which is all that the variance depends on.

Banding. 25 bands of 4 slots: sets with a similarity of 0.8 miss each other in all bands with a chance of 2e-6, of 0.85 with 1e-8.

Verification loses no link between members of a bucket, and yet emits no pairs within one. All members are compared with one hub R.
Let D(x) be the symmetric difference of x and R. A pair x, y that is similar enough but not linked through R shares more than it
leaves unshared in D(x) and D(y): 2 |D(x) & D(y)| >= |D(x)| + |D(y)| - c (|x| + |y|) with c = (100 - percent) / (100 + percent). So elements
that occur in one D only tell which members cannot have such a partner, and the others are dealt anew by the elements of D that they share,
of which a prefix in a common order suffices. A small group is then compared within one task; a larger one gets a hub and is treated likewise,
until none holds two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .store import mixed, slices, stream, texts
from .words import hashed_words, shingle_sets, shingles

SLOTS = 101  # prime
ROWS = 4
BANDS = SLOTS // ROWS
SMALL_GROUP, SMALL_ELEMENTS = 256, 1_000_000  # members, and elements of their sets together, of a group that a task compares
BROADCAST_TEXTS = 1_000_000  # text hashes; more are joined by a shuffle
POWERS = stream(ROWS, 91) | np.uint64(1)
ROUND = np.uint64(56)


@dataclass(frozen=True)
class Rule:
    """Texts are linked if ``100 * common >= percent * union`` of their sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80

    def linked(self, common: int, x: int, y: int) -> bool:
        return 100 * common >= self.percent * (x + y - common)


def signatures(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n rows of 101 values; the elements need not be distinct. Texts without elements keep the largest value everywhere."""
    sig = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.bincount(owner, minlength=n) == 0
    begin = (mixed(elements, 92) % np.uint64(SLOTS)).astype(np.int64)
    step = (mixed(elements, 93) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    for j in range(SLOTS):
        offer = (mixed(elements, 1000 + j) >> np.uint64(8)) | (np.uint64(j) << ROUND)
        np.minimum.at(sig, owner * SLOTS + (begin + j * step) % SLOTS, offer)
        filled |= (sig.reshape(n, SLOTS).max(axis=1) >> ROUND) <= j
        going = ~filled[owner]
        if not going.any():
            break
        elements, owner, begin, step = elements[going], owner[going], begin[going], step[going]
    return sig.reshape(n, SLOTS)


def bands(sig: np.ndarray) -> np.ndarray:
    own = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    return mixed((own * POWERS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 94)


def node_keys(sets: list[np.ndarray]) -> list[bytes]:
    """16 bytes that identify a set of shingles."""
    out = []
    for s in sets:
        key = np.array([mixed(s, 95).sum(dtype=np.uint64), mixed(s, 96).sum(dtype=np.uint64)]) + np.uint64(len(s))
        out.append(mixed(key).tobytes())
    return out


def sketches(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, hash of the text, node (key of the shingle set), n (its size) and the bands; node and bands are NULL for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(2))
            for a, b in slices(rows):
                words = hashed_words(rows[a:b])
                values, owner = shingles(words, b - a, rule.words)
                edges = np.searchsorted(owner, np.arange(b - a + 1))
                sets = [np.unique(values[x:y]) for x, y in zip(edges, edges[1:])]
                found = bands(signatures(values, owner, b - a)).view(np.int64)
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(1)[a:b],
                    pa.array([k if s else None for k, s in zip(node_keys(sets), some)], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([list(x) if s else None for x, s in zip(found.tolist(), some)], pa.list_(pa.int64()))],
                    names=["id", "texthash", "node", "n", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("texthash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, texthash long, node binary, n long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """(node, elements) of the texts whose hash is wanted; a task gives a set once."""
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            new = [i for i, h in enumerate(batch.column(0).to_pylist()) if h not in given and not given.add(h)]
            rows = texts(batch.column(1).take(pa.array(new, pa.int64())))
            for a, b in slices(rows):
                sets = shingle_sets(rows[a:b], rule.words)
                yield pa.RecordBatch.from_arrays([pa.array(node_keys(sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["node", "elements"])

    rows = docs.select(F.xxhash64(text_col).alias("texthash"), F.col(text_col).alias("text")).join(keys, "texthash", "left_semi")
    return rows.mapInArrow(work, "node binary, elements binary").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame, with_delta: bool = False) -> DataFrame:
    """Pairs (node, hub, n) with the hub's size m and the size d of the symmetric difference, or with its elements."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                out, sizes, hub, hub_bytes = [], [], None, None
                for x, y in zip(batch.column("_x"), batch.column("_y")):
                    own, other = np.frombuffer(x.as_py(), np.uint64), y.as_py()
                    if other != hub_bytes:
                        hub, hub_bytes = np.frombuffer(other, np.uint64), other
                    inside = hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own
                    sizes.append(len(hub))
                    if with_delta:
                        out.append(np.concatenate([own[~inside], np.setdiff1d(hub, own, assume_unique=True)]).view(np.int64).tolist())
                    else:
                        out.append(len(own) + len(hub) - 2 * int(inside.sum()))
                kind = pa.list_(pa.int64()) if with_delta else pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), batch.column("n"), pa.array(sizes, pa.int64()),
                                                  pa.array(out, kind)], names=["node", "hub", "n", "m", "d"])

    both = pairs.join(sets.withColumnRenamed("elements", "_x"), "node").join(
        sets.select(F.col("node").alias("hub"), F.col("elements").alias("_y")), "hub")
    kind = "array<long>" if with_delta else "long"
    return both.select("node", "hub", "n", "_x", "_y").mapInArrow(work, f"node binary, hub binary, n long, m long, d {kind}")


def _busy(groups: DataFrame) -> DataFrame:
    """Rows of groups that have more than one member."""
    often = groups.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1").select("key")
    return groups.join(often, "key")


def _mixed(groups: DataFrame, comps: DataFrame, key: str = "key") -> DataFrame:
    """Rows of groups whose members are in more than one component."""
    labelled = groups.join(comps.select(F.col("a").alias("node"), F.col("b").alias("_comp")), "node", "left")
    labelled = labelled.withColumn("_comp", F.coalesce("_comp", "node"))
    several = labelled.groupBy(key).agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).where("_low != _high").select(key)
    return labelled.join(several, key)


def _within(groups: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between components of small groups: the sets of a group meet in one task, which compares members not yet connected."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for members in batch.column(0):
                rows = [(x["node"], x["_comp"], np.frombuffer(x["elements"], np.uint64)) for x in members.as_py()]
                label = {comp: comp for _, comp, _ in rows}
                for i, (node, comp, own) in enumerate(rows):
                    for other, its, theirs in rows[:i]:
                        if label[comp] == label[its] or 100 * min(len(own), len(theirs)) < rule.percent * max(len(own), len(theirs)):
                            continue
                        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                        if rule.linked(int((own[place] == theirs).sum()), len(own), len(theirs)):
                            links.append((node, other))
                            old, new = label[comp], label[its]
                            label = {k: new if v == old else v for k, v in label.items()}
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links)], names=["a", "b"])

    rows = groups.join(sets, "node").groupBy("key").agg(F.collect_list(F.struct("node", "_comp", "elements")).alias("members"))
    return rows.select("members").mapInArrow(work, "a binary, b binary")


def _hub_pairs(groups: DataFrame, jump: bool) -> DataFrame:
    """Distinct (node, hub, n). A group's hub is the member that meets the most others in all groups, so that it is a central one.

    With ``jump``, the hub is replaced by the best hub of its own groups, so that the groups of one crowd have one hub. Without it a hub is
    a member of its group, which the groups dealt later on no longer hold; so they end.
    """
    sizes = groups.groupBy("key").agg(F.count("*").alias("_size"))
    score = groups.join(sizes, "key").groupBy("node").agg(F.sum("_size").alias("_score"))
    rank = F.struct(-F.col("_score"), F.col("node").alias("hub"))
    hubs = groups.join(score, "node").groupBy("key").agg(F.min(rank).alias("_best"))
    if jump:
        hubs = stored(hubs, "near-hubs")
        best = groups.join(hubs, "key").groupBy("node").agg(F.min("_best").alias("_better"))
        hubs = hubs.join(best, F.col("_best.hub") == F.col("node")).select("key", F.col("_better").alias("_best"))
    return groups.join(hubs.select("key", "_best.hub"), "key").where("node != hub").select("node", "hub", "n").distinct()


def _excess(rule: Rule):
    """Above 0 if a pair is not linked."""
    return (100 + rule.percent) * F.col("d") - (100 - rule.percent) * (F.col("n") + F.col("m"))


def _frontier(members: DataFrame, name: str) -> DataFrame:
    """Per hub the members' (a, b) that no other beats by a smaller a and a larger b. There are no more than differences of the hub's sets."""
    best = members.groupBy("hub", "a").agg(F.max("b").alias("b"))
    before = Window.partitionBy("hub").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    edge = best.withColumn("_top", F.max("b").over(before)).where("_top IS NULL OR b > _top")
    return edge.groupBy("hub").agg(F.collect_list(F.struct("a", "b")).alias(name))


def _dealt(open_pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Groups (key, node, n) of members that share an element of their differences from the hub and may have a link through it.

    With K = 100 + percent and q = 100 - percent, a pair needs 2 K |D(x) & D(y)| >= a(x) + a(y) for a = K |D| - q n. What is shared is no
    more than the elements of D(x), or of D(y), that anyone else has; so a(x) <= b(y) and a(y) <= b(x) for b = 2 K shared - a.
    """
    k, q = 100 + rule.percent, 100 - rule.percent
    deltas = compared(open_pairs.select("node", "hub", "n"), sets, with_delta=True)
    deltas = deltas.select("node", "hub", "n", "m", F.size("d").cast("long").alias("d"), F.explode("d").alias("_e"))
    deltas = stored(deltas.withColumn("key", F.xxhash64("hub", "_e")), "near-deltas")
    often = deltas.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1")
    shared = deltas.join(often, "key").groupBy("node", "hub", "n", "m", "d").agg(F.collect_list(F.struct("_c", "key")).alias("_keys"))
    a = k * F.col("d") - q * F.col("n")
    members = stored(shared.withColumn("a", a).withColumn("b", 2 * k * F.size("_keys") - F.col("a")).withColumn("_open", _excess(rule) > 0), "near-members")
    edges = _frontier(members.where("_open"), "_f_open").join(_frontier(members, "_f_all"), "hub")
    both = members.join(edges, "hub")
    fits = lambda f: F.filter(f, lambda e: (e["a"] <= F.col("b")) & (F.col("a") <= e["b"]))
    with_open = fits("_f_open")
    partners = F.when(F.col("_open"), F.concat(with_open, fits("_f_all"))).otherwise(with_open)
    judged = both.withColumn("_fits", partners).where(F.size("_fits") > 0)
    need = F.ceil((F.col("a") + F.array_min(F.transform("_fits", lambda e: e["a"]))) / (2 * k))
    least = F.greatest(F.lit(1), need).cast("int")
    prefix = F.slice(F.sort_array("_keys"), 1, F.greatest(F.lit(0), F.size("_keys") - least + 1))
    return judged.select("node", "n", F.explode(F.transform(prefix, lambda e: e["key"])).alias("key")).select("key", "node", "n")


def linked_nodes(docs: DataFrame, found: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """Components (a, b) of the nodes of the stored sketches ``found``."""
    classes = found.where("node IS NOT NULL").dropDuplicates(["node"])
    buckets = classes.select("node", "n", "texthash", F.posexplode("bands").alias("_band", "_hash")).select(
        F.xxhash64("_band", "_hash").alias("key"), "node", "n", "texthash")
    groups = stored(_busy(buckets), "near-buckets")
    sets = stored(full_sets(docs, groups.select("texthash").distinct(), rule, text_col), "near-sets")
    groups, comps = groups.drop("texthash"), None
    while True:
        checked = stored(compared(_hub_pairs(groups, comps is None), sets), "near-checked")
        links = checked.where(_excess(rule) <= 0).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        comps = components(links if comps is None else comps.unionByName(links))
        # families of a hub that are still in pieces
        open_pairs = stored(_mixed(checked, comps, "hub").drop("_comp"), "near-open")
        if open_pairs.isEmpty():
            return comps
        groups = stored(_mixed(_busy(stored(_dealt(open_pairs, sets, rule), "near-dealt")), comps), "near-groups")
        size = groups.groupBy("key").agg(((F.count("*") <= SMALL_GROUP) & (F.sum("n") <= SMALL_ELEMENTS)).alias("_small"))
        sized = groups.join(size, "key")
        comps = components(comps.unionByName(_within(sized.where("_small"), sets, rule)))
        groups = stored(_mixed(sized.where("NOT _small").drop("_small", "_comp"), comps).drop("_comp"), "near-groups")
        if groups.isEmpty():
            return comps


def groups(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, texthash, n (size of the set of shingles), component (smallest id of its group), kept and group.

    ``group`` names the group itself, which its smallest id does not where ids repeat or are NULL; rows without shingles are a group of equal texts
    and ids.

    Texts with equal sets are one node and always linked. Empty and NULL texts have no shingles and are linked with nothing. A
    NULL id does not count as smallest; a group without ids has the component NULL. ``kept`` is whether the id is the component's, NULL equal to
    NULL, so rows that repeat the kept id are all kept here. An empty table gives an empty result. Other columns are not read.
    """
    found = stored(sketches(docs, rule, id_col, text_col), "near-sketches").select("id", "texthash", "node", "n", "bands")
    comps = linked_nodes(docs, found, rule, text_col).select(F.col("a").alias("node"), F.col("b").alias("_comp"))
    some = found.where("node IS NOT NULL").select("id", "texthash", "n", "node").join(comps, "node", "left")
    some = some.withColumn("group", F.coalesce("_comp", "node"))
    least = some.groupBy("group").agg(F.min("id").alias("component"))
    alone = F.concat_ws(" ", F.lit("alone"), "texthash", "id").cast("binary").alias("group")
    rest = found.where("node IS NULL").select("id", "texthash", "n", F.col("id").alias("component"), alone)
    out = some.join(least, "group").select("id", "texthash", "n", "component", "group").unionByName(rest)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def one_per_group(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, of the smallest id. Rows that repeat id and text count once.

    All rows without shingles stay, but for repeats. All columns pass through.
    """
    stay = groups(docs, rule, id_col, text_col).where("kept").groupBy("group").agg(F.first("component").alias("component"), F.min("texthash").alias("_hash"))
    known, null = F.coalesce(F.col(id_col), F.lit(0).cast("long")), F.col(id_col).isNull()
    keys = ["_known", "_null", "_hash"]
    named = stay.select(F.coalesce("component", F.lit(0).cast("long")).alias("_known"), F.col("component").isNull().alias("_null"), "_hash")
    rows = docs.withColumn("_known", known).withColumn("_null", null).withColumn("_hash", F.xxhash64(text_col))
    return rows.join(named, keys, "left_semi").dropDuplicates(keys).drop(*keys)
