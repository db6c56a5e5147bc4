"""Mixing sources to target weights by capped water-filling.

The budget is shared among the sources by weight. A source whose share exceeds its maximum number of epochs is clamped there
and the excess goes to the others by weight, until no source is above. A source that is due ``e`` epochs gives every document
``floor(e)`` times. The fraction is filled in a seeded order: whoever still fits in what is left is taken once more, whoever does
not is passed over, so less is left over than the smallest document passed over has. One more document is added if that comes nearer.

All of it is DataFrame operations. The walk goes in rounds, for all sources at once: sums per hash bin locate the bin in which the
next document does not fit, only that bin is put in order, and what is beyond it and still fits is kept for the next round. Each
round leaves a random part of what was left before it, so their number grows with the logarithm of a source. Equal rows are one
entry with a count, so neither a source nor a row with a third of all rows is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..session import stored

GAP = r"[\x20\x09-\x0D]+"
BIN_BITS = 12
BROADCAST_SOURCES = 10_000  # a plan of more sources is joined by a shuffle
SALTS = 64
END = (1 << 63) - 1
SAME = ["_named", "_source"]
CUTS = "array<struct<room: bigint, u: bigint, size: bigint, rows: bigint, of: bigint>>"


def word_count(text: Column) -> Column:
    """Number of runs of other than space and the control characters 9 to 13; 0 for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def cycled_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """Sources by code point, NULL last, get the weights in turn."""
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_rank")
    at = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int") + 1
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at).cast("double")).drop("_rank")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    The loop runs once per round of clamping; only two sums and a count come to the driver. If all sources are clamped, the budget
    is not used up. Sources of weight 0 or size 0 get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    clamped, n, level = F.lit(False), 0, 0.0
    while True:
        capped, free, over = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))),
            F.count(F.when(clamped, 1))).first()
        if not free or (level and over == n):
            break
        n, level = over, (budget - capped) / free
        clamped = cap < F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))


def _order(seed: int, key: Column, text: Column) -> Column:
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_named", F.col("source").isNotNull()).withColumn("_source", F.coalesce("source", F.lit("")))


def _beside(df: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``df`` with its source's row of ``plan``: broadcast if the sources are few, else by a shuffle that splits a hot source."""
    if few:
        return df.join(F.broadcast(plan), SAME)
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod("_u", F.lit(SALTS)).cast("int")).join(salted, [*SAME, "_salt"]).drop("_salt")


def _walk(left: DataFrame, plan: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """One round: what still fits beyond the cut, and ``plan`` with one more cut where a source had anything ``left``."""
    bin_of = F.shiftright("_u", 60 - BIN_BITS)
    up_to = Window.partitionBy(*SAME).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    left = left.withColumn("_bin", bin_of).withColumn("_words", F.col("size") * F.col("n"))
    bins = left.groupBy(*SAME, "_bin").agg(F.sum("_words").alias("_sum")).withColumn("_end", F.sum("_sum").over(up_to))
    bins = bins.join(plan.select(*SAME, "_room"), SAME)
    whole = bins.groupBy(*SAME).agg(F.max("_end").alias("_all"))
    edge = bins.where(F.col("_end") > F.col("_room")).groupBy(*SAME).agg(F.min(F.struct("_bin", "_sum", "_end")).alias("_e"))
    edge = edge.select(*SAME, F.col("_e._bin").alias("_bin"), (F.col("_e._end") - F.col("_e._sum")).alias("_begin"))
    inside = Window.partitionBy(*SAME, "_bin").orderBy("_u", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = left.join(edge, [*SAME, "_bin"]).withColumn("_cum", F.col("_begin") + F.sum("_words").over(inside))
    at = at.join(plan.select(*SAME, "_room"), SAME).where(F.col("_cum") > F.col("_room"))
    cut = at.groupBy(*SAME).agg(F.min(F.struct("_u", "size", "n", (F.col("_cum") - F.col("_words")).alias("before"))).alias("_c"))
    found = plan.join(whole, SAME, "left").join(cut, SAME, "left")
    c, room = F.col("_c"), F.col("_room")
    rows = F.floor((room - c["before"]) / c["size"]).cast("long")
    entry = lambda u, size, n, of: F.array(F.struct(room.alias("room"), u.alias("u"), size.alias("size"), n.alias("rows"), of.alias("of")))
    stop = entry(c["_u"], c["size"], rows, c["n"])
    through = entry(F.lit(END), F.lit(END), F.lit(0).cast("long"), F.lit(0).cast("long"))
    new = F.when(c.isNotNull(), stop).when(F.col("_all").isNotNull(), through).otherwise(F.array().cast(CUTS))
    rest = (F.when(c.isNotNull(), room - c["before"] - rows * c["size"]).when(F.col("_all").isNotNull(), room - F.col("_all")).otherwise(room))
    at_u = F.when(c.isNotNull(), c["_u"]).otherwise(F.lit(END))
    plan = stored(found.select(*SAME, "source_size", "target", "whole", rest.alias("_room"), F.concat("_cuts", new.cast(CUTS)).alias("_cuts"),
                               at_u.alias("_at_u"), F.coalesce(c["size"], F.lit(END)).alias("_at_size")), "mix-plan")
    beyond = F.struct(F.col("_u"), F.col("size")) > F.struct(F.col("_at_u").alias("_u"), F.col("_at_size").alias("size"))
    more = _beside(left, plan.select(*SAME, "_room", "_at_u", "_at_size"), few).where(beyond & (F.col("size") > 0) & (F.col("size") <= F.col("_room")))
    return stored(more.select(*SAME, "_u", "size", "n"), "mix-left"), plan


def _before(cuts: str = "_cuts") -> Column:
    """Whether the walk has taken an entry on its way: it fitted in a round whose cut is beyond it. Empty texts are taken up to the first cut."""
    earlier = lambda c: (F.col("_u") < c["u"]) | ((F.col("_u") == c["u"]) & (F.col("size") < c["size"]))
    return F.size(F.filter(cuts, lambda c, i: (F.col("size") <= c["room"]) & ((F.col("size") > 0) | (i == 0)) & earlier(c))) > 0


def _at(c: Column) -> Column:
    return (F.col("_u") == c["u"]) & (F.col("size") == c["size"])


def _with_filler(entries: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``plan`` with one more row of the smallest entry not taken whole, if that comes nearer to the target."""
    room = F.col("_room")
    near = _beside(entries, plan.select(*SAME, "_room", "_cuts"), few).where((F.col("size") > room) & (F.col("size") < 2 * room) & ~_before())
    cut = F.try_element_at(F.filter("_cuts", _at), F.lit(1))
    near = near.withColumn("_got", F.coalesce(cut["rows"], F.lit(0))).where(F.col("_got") < F.col("n"))
    best = near.groupBy(*SAME).agg(F.min(F.struct("size", "_u", "_got", "n")).alias("_f"))
    f = F.col("_f")
    entry = F.array(F.struct(F.lit(-1).cast("long").alias("room"), f["_u"].alias("u"), f["size"].alias("size"), (f["_got"] + 1).alias("rows"), f["n"].alias("of")))
    out = plan.join(best, SAME, "left")
    return out.withColumn("_cuts", F.when(f.isNotNull(), F.concat("_cuts", entry.cast(CUTS))).otherwise(F.col("_cuts"))).drop("_f")


def _in_part(rows: DataFrame) -> DataFrame:
    """``rows`` of entries that the fraction takes in part, with ``_more``: 1 for the first ``_want`` rows of an entry, else 0.

    The rows are written, so that their numbers stand. They are numbered per entry and partition, and what the partitions before hold
    is summed over one row per partition.
    """
    entry = [*SAME, "_u", "size"]
    held = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-part").withColumn("_part", F.shiftright("_row", 33))
    before = Window.partitionBy(*entry).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*entry, "_part").agg(F.count("*").alias("_n"))
    counts = counts.select(*entry, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_past"))
    ranked = held.withColumn("_i", F.row_number().over(Window.partitionBy(*entry, "_part").orderBy("_row"))).join(counts, [*entry, "_part"])
    return ranked.withColumn("_more", (F.col("_past") + F.col("_i") <= F.col("_want")).cast("int"))


def mix_plan(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: its target, whole repetitions, and the cuts of the walk that fills the fraction, one per round.

    ``narrow`` has source, size and _u; ``sources`` has source, source_size and target. Only counts come to the driver.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = _keyed(sources).withColumn("whole", whole)
    room = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 1e-6).cast("long")
    plan = stored(plan.select(*SAME, "source_size", "target", "whole", room.alias("_room"), F.array().cast(CUTS).alias("_cuts")), "mix-plan")
    few = plan.count() <= BROADCAST_SOURCES
    entries = stored(_keyed(narrow).groupBy(*SAME, "_u", "size").agg(F.count("*").alias("n")), "mix-entries")
    left = _beside(entries, plan.select(*SAME, "_room"), few).where((F.col("_room") > 0) & (F.col("size") <= F.col("_room"))).select(*entries.columns)
    while not left.isEmpty():
        left, plan = _walk(left, plan, few)
    return stored(_with_filler(entries, plan, few).select(*SAME, "source_size", "target", "whole", "_cuts"), "mix-plan")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
        id_col: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target (of the source) and copies (how often the mix takes the document).

    ``weights`` go to the sources by code point, NULL last and a source like any other, in turn. Size is the number of words;
    empty and NULL texts have 0. The order rests on id and text. Rows with equal id, text and source are an entry of which the mix may take
    some once more than the others; how many is the same in every run, which of them is not. A NULL id is one more id. A very long
    text that does not fit in a fraction is passed over, and a source is then filled up from its other texts. An empty table gives an empty
    result. Columns of ``docs`` with the names of new columns are replaced; all others stay.
    """
    kept = docs.drop("size", "source_size", "target", "copies")
    sized = kept.withColumn("size", word_count(F.col("text"))).withColumn("_u", _order(seed, F.col(id_col), F.col("text")))
    narrow = stored(sized.select("source", "size", "_u"), "mix-sizes")
    sources = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(stored(cycled_weights(sources, weights), "mix-weights"), share * total, max_epochs)
    plan = mix_plan(narrow, filled)
    cut = F.array_max(F.transform(F.filter("_cuts", _at), lambda c: F.struct(c["rows"], c["of"])))
    rows = _beside(_keyed(sized), plan, plan.count() <= BROADCAST_SOURCES).withColumn("_cut", cut)
    rows = rows.withColumn("_want", F.coalesce(F.col("_cut.rows"), F.lit(0))).withColumn("_of", F.coalesce(F.col("_cut.of"), F.lit(0)))
    in_part = (F.col("_want") > 0) & (F.col("_want") < F.col("_of"))
    out = [*kept.columns, "size", "source_size", "target", (F.col("whole") + F.col("_more")).cast("long").alias("copies")]
    alike = rows.where(~in_part).withColumn("_more", (_before() | (F.col("_want") > 0)).cast("int")).select(*out)
    if plan.where(F.exists("_cuts", lambda c: (c["rows"] > 0) & (c["rows"] < c["of"]))).isEmpty():
        return alike
    return alike.unionByName(_in_part(rows.where(in_part).drop("_cut", "_cuts")).select(*out))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken."""
    new = ("size", "source_size", "target", "copies")
    times = mixed.where(F.col("copies") > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.drop("_k", *new)
