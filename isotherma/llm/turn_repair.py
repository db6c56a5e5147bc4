"""Conversation structure repair: the cheapest edits that give every conversation the shape ``(s?(ua)+)?`` of role initials.

A turn is one of nine symbols: its role's initial (s, u, a or another), whole or truncated, or X for one that must go. The shape is an automaton of
four states, so a turn is a 4 x 4 matrix over (min, +): the cheapest edits that lead from one state to another, with the initials of the
edits as an audit rope. Symbol strings of many conversations are compressed by one Re-Pair grammar: in each round the most frequent pairs of
adjacent symbols become rules. The matrix of a rule is the product of those of its two sides, computed once, bottom-up, and shared by all
conversations that hold it; each distinct string is multiplied out once.

Order and ties. No audit up to a turn's end is a proper prefix of another of that cost, because a longer one would end in costly inserts and those
belong to the next turn's matrix. So the least audit of a product is put together from least audits of its parts, and audits of different
states are ordered by their heads alone.

Turns are numbered once by a range-partitioned sort. A conversation is cut into blocks of at most 2^``bits`` turns, so the turns of one that holds
a third of all rows are spread; only what is a single value of the result is put together in one task, as a stream: the audit from one row per block, and the
SHA-256 of the repaired text, which cannot be split.

Defined results. NULL role and text are one space; NULL conv_id is a conversation of its own, NULL turns come first. Turns of equal number go by role, then text;
repeated rows are duplicates. A role whose initial is none of s, u, a is never kept. Empty texts are blank; very long ones are only read,
never held together. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
BITS = 12  # a block has at most 2^12 turns
RULES = 2048  # bounds the grammar; more rules would save products, not change results
ROUNDS = 24
GAIN = 0.01  # rounds go on while they shorten the strings by this share
FIRST_RULE = 0x100
START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what follows a state: the role is the state's name
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {("s", START): SYSTEM, **{("u", s): USER for s in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
# whole turns by initial, the same truncated, and one that must go
SYMBOLS = {"s": ("s", 0), "u": ("u", 0), "a": ("a", 0), "o": ("", 0), "S": ("s", 1), "U": ("u", 1), "A": ("a", 1), "O": ("", 1), "X": (None, 0)}

Matrix = dict  # (state before, state after) -> (cost, rope); a rope is a string or a pair of ropes


def flat(rope) -> str:
    """The string of a rope."""
    out, todo = [], [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            todo += [top[1], top[0]]
    return "".join(out)


def best(cells: list) -> tuple:
    """The cheapest of (cost, rope); ties go to the ASCII-least string."""
    least = min(c for c, _ in cells)
    cells = [x for x in cells if x[0] == least]
    return cells[0] if len(cells) == 1 else min(cells, key=lambda x: flat(x[1]))


def product(a: Matrix, b: Matrix) -> Matrix:
    cells: dict = {}
    for (i, k), (cost, rope) in a.items():
        for j in range(4):
            if (k, j) in b:
                more, tail = b[k, j]
                cells.setdefault((i, j), []).append((cost + more, (rope, tail)))
    return {at: best(found) for at, found in cells.items()}


def inserts() -> Matrix:
    """From each state to those that inserts reach; going round the states would only cost more."""
    out: Matrix = {}
    for i in range(4):
        state, n = i, 0
        while (i, state) not in out:
            out[i, state] = (INSERT * n, "I" * n)
            state, n = INSERTED[state], n + 1
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then one edit of a turn."""
    initial, truncated = SYMBOLS[symbol]
    edits: dict = {(i, i): [(DELETE, "D")] for i in range(4)}
    if initial is not None:
        for i in range(4):
            edits.setdefault((i, INSERTED[i]), []).append((REROLE + TRUNCATED * truncated, "R"))
            if (initial, i) in KEPT:
                edits.setdefault((i, KEPT[initial, i]), []).append((KEEP + TRUNCATED * truncated, "K"))
    return product(inserts(), {at: best(found) for at, found in edits.items()})


def rule_matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of each symbol and each rule (two symbols before it), bottom-up."""
    out = {s: symbol_matrix(s) for s in SYMBOLS}
    for k, pair in enumerate(rules):
        out[chr(FIRST_RULE + k)] = product(out[pair[0]], out[pair[1]])
    return out


def ending() -> dict[int, tuple[int, str]]:
    """What it takes from a state to the end."""
    reach = inserts()
    return {i: best([reach[i, j] for j in (START, ASSISTANT) if (i, j) in reach]) for i in range(4)}


def grammar(strings: DataFrame) -> tuple[list[str], DataFrame]:
    """Re-Pair over column ``seq``: the rules, and ``strings`` with ``packed``, the same strings in rules.

    A round takes the most frequent pairs no two of which share a symbol, so its counts stay true, and replaces each from left to right. The
    driver sees at most (symbols + rules)^2 counts a round.
    """
    rules: list[str] = []
    now = stored(strings.withColumn("packed", F.col("seq")), "repair-grammar")
    for _ in range(ROUNDS):
        at = F.sequence(F.lit(1), F.length("packed") - 1)
        pairs = now.where(F.length("packed") > 1).select(F.explode(F.transform(at, lambda i: F.substring("packed", i, F.lit(2)))).alias("pair"))
        counts = pairs.groupBy("pair").count().orderBy(F.desc("count"), "pair").limit(256).collect()
        total = now.agg(F.sum(F.length("packed"))).first()[0] or 0
        used, chosen = set(), []
        for r in counts:
            if r["count"] > 1 and not used & set(r["pair"]) and len(rules) + len(chosen) < RULES:
                used |= set(r["pair"])
                chosen.append((r["pair"], r["count"]))
        if not chosen or sum(n for _, n in chosen) < GAIN * total:
            break
        packed = F.col("packed")
        for pair, _ in chosen:
            packed = F.replace(packed, F.lit(pair), F.lit(chr(FIRST_RULE + len(rules))))
            rules.append(pair)
        now = stored(now.withColumn("packed", packed), "repair-grammar")
    return rules, now


def sorted_turns(rows: DataFrame) -> DataFrame:
    """Turns with ``_id`` in the order of (conv_id, turn, role, text), their symbol but for duplicates, and a digest of role and text; stored."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    symbol = F.when(end == "", "X").when(end.isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    return stored(placed.withColumns({"_symbol": symbol, "_initial": initial, "_same": F.unhex(same)}), "repair-turns")


def blocks(turns: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per block of a conversation: its symbols, and what the counts of the conversation are made of."""
    first = turns.where("_symbol != 'X'").groupBy("conv_id", "_same").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(
        F.col("conv_id").alias("_conv"), F.col("_same").alias("_as"), "_first")
    marked = turns.select("conv_id", "_id", "turn", "_symbol", "_initial", "_same").join(
        first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_as")), "left")
    again = F.coalesce((F.col("_symbol") != "X") & (F.col("_id") > F.col("_first")), F.lit(False))
    entry = F.struct("_id", F.when(again, "D").otherwise(F.col("_symbol")).alias("s"), F.col("_initial").alias("i"), "turn")
    packs = marked.groupBy("conv_id", F.shiftright("_id", bits).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    step = lambda test: F.size(F.filter(F.sequence(F.lit(2), F.size("_all")), test))
    nth = lambda k, name: F.element_at(F.col("_all"), k)[name]
    legal = lambda k: F.concat(nth(k - 1, "i"), nth(k, "i")).isin("su", "ua", "au")
    many = lambda test: F.size(F.filter("_all", lambda x: test(x["s"])))
    longer = F.size("_all") > 1
    return packs.select(
        "conv_id", "block",
        F.array_join(F.transform("_all", lambda x: F.when(x["s"] == "D", "X").otherwise(x["s"])), "").alias("seq"),
        many(lambda s: s == "X").alias("blank"), many(lambda s: s == "D").alias("duplicate"), many(lambda s: s.isin("S", "U", "A", "O")).alias("truncated"),
        F.when(longer, step(lambda k: ~legal(k))).otherwise(0).alias("illegal"),
        F.size(F.array_distinct(F.filter(F.transform("_all", lambda x: x["turn"]), lambda t: t.isNotNull()))).alias("n_turns"),
        F.array_min(F.transform("_all", lambda x: x["turn"])).alias("low"), F.array_max(F.transform("_all", lambda x: x["turn"])).alias("high"),
        nth(1, "i").alias("head"), nth(-1, "i").alias("tail"))


def multiplied(strings: DataFrame, rules: list[str]) -> DataFrame:
    """For each distinct string its matrix: ``costs`` and ``audits`` of 16 cells, NULL where no edits lead."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rule_matrices(rules)
        for batch in batches:
            costs, audits = [], []
            for packed in batch.column(1).to_pylist():
                matrix = of[packed[0]]
                for s in packed[1:]:
                    matrix = product(matrix, of[s])
                cells = [matrix.get((i, j)) for i in range(4) for j in range(4)]
                costs.append([x and x[0] for x in cells])
                audits.append([x and flat(x[1]) for x in cells])
            yield pa.RecordBatch.from_pydict({"_seq": batch.column(0), "costs": pa.array(costs, pa.list_(pa.int64())), "audits": pa.array(audits, pa.list_(pa.string()))})

    return strings.select("seq", "packed").mapInArrow(work, "_seq string, costs array<long>, audits array<string>")


COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Path:
    """The cheapest ways to each state over the blocks of one conversation, as back pointers; ``rank`` orders their audits."""

    def __init__(self) -> None:
        self.cost, self.rank = {START: 0}, {START: 0}
        self.back: list[dict] = []
        self.counts, self.n_turns, self.low, self.high, self.tail = dict.fromkeys(COUNTS, 0), 0, None, None, None

    def add(self, r: dict) -> None:
        pointers, found = {}, {}
        for j in range(4):
            cells = [(self.cost[k] + r["costs"][4 * k + j], self.rank[k], r["audits"][4 * k + j], k) for k in self.cost if r["costs"][4 * k + j] is not None]
            if cells:
                cost, rank, audit, k = min(cells)
                pointers[j], found[j] = (k, audit), (cost, (rank, audit))
        self.cost = {j: x[0] for j, x in found.items()}
        places = {key: n for n, key in enumerate(sorted(x[1] for x in found.values()))}
        self.rank = {j: places[x[1]] for j, x in found.items()}
        self.back.append(pointers)
        for c in COUNTS:
            self.counts[c] += r[c]
        self.counts["illegal"] += self.tail is not None and self.tail + r["head"] not in ("su", "ua", "au")
        self.n_turns += r["n_turns"] - (self.high is not None and r["low"] == self.high)
        self.low = r["low"] if self.low is None else self.low
        self.high, self.tail = r["high"] if r["high"] is not None else self.high, r["tail"]

    def result(self) -> tuple[dict, int, str]:
        end = ending()
        cost, _, tail, j = min((self.cost[k] + end[k][0], self.rank[k], end[k][1], k) for k in self.cost)
        parts = [tail]
        for pointers in reversed(self.back):
            j, audit = pointers[j]
            parts.append(audit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return {"gaps": gaps, **self.counts}, cost, "".join(reversed(parts))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict, bool]]:
    """(key, row, whether the key is new) of rows that come in the order of their key."""
    last = object()
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            row = dict(zip(names, values))
            yield row[key], row, row[key] != last
            last = row[key]


OUTCOME = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _by_conversation(df: DataFrame, order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), order)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(v) for v in r.values() if isinstance(v, str))
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def outcomes(turns: DataFrame, bits: int = BITS) -> DataFrame:
    """Per conversation of ``sorted_turns``: gaps, faults, the cost and the audit of the cheapest repair."""
    cut = stored(blocks(turns, bits), "repair-blocks")
    rules, strings = grammar(cut.select("seq").distinct())
    ways = cut.join(multiplied(strings, rules), F.col("seq") == F.col("_seq")).drop("seq", "_seq")
    schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in [x.split()[0] for x in OUTCOME.split(", ")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            path, conv = None, None
            for key, r, new in _runs(batches, "conv_id"):
                if new:
                    if path:
                        yield said(conv, path)
                    path, conv = _Path(), key
                path.add(r)
            if path:
                yield said(conv, path)

        def said(conv, path: _Path) -> dict:
            counts, cost, audit = path.result()
            return {"conv_id": conv, **counts, "cost": cost, "audit": audit}

        yield from _batches(rows(), schema)

    return _by_conversation(ways, "block").mapInArrow(work, OUTCOME)


class _Edits:
    """Follows an audit from state to state; gives the turns that are left, as (role, text)."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = INSERTED[self.state]
            yield ROLE[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[:1], self.state]
            yield role, text
        elif edit == "R":
            self.state = INSERTED[self.state]
            yield ROLE[self.state], text


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of a conversation, then its turns, in order."""
    names = [c for c in found.columns if c != "conv_id"]
    head = found.withColumns({"_id": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    body = turns.select("conv_id", "_id", "role", "text", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names])
    return _by_conversation(head.select(*body.columns).unionByName(body), "_id")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, role and text."""
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for conv, left in _followed(batches):
                yield from ({"conv_id": conv["conv_id"], "position": n, "role": r, "text": t} for n, (r, t) in enumerate(left))

        yield from _batches(rows(), schema)

    return _with_audits(turns, found).mapInArrow(work, "conv_id long, position long, role string, text string")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """For each conversation its audit row and the turns left. The turns must be taken before the next conversation."""
    rows = _runs(batches, "conv_id")
    ahead = next(rows, None)

    def left() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        edits = _Edits(ahead[1]["audit"])
        ahead = next(rows, None)
        while ahead and not ahead[2]:
            yield from edits.turn(ahead[1]["role"], ahead[1]["text"])
            ahead = next(rows, None)
        yield from edits.inserted()

    while ahead:
        yield ahead[1], left()


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: of the repaired ``role:text``, joined by newlines, hashed as a stream."""
    out = found.withColumn("repaired_sha256", F.lit(""))
    kinds = {"audit": pa.string(), "repaired_sha256": pa.string()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in out.columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for conv, left in _followed(batches):
                sha = hashlib.sha256()
                for n, (role, text) in enumerate(left):
                    sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                yield {c: conv[c] for c in schema.names if c in conv} | {"repaired_sha256": sha.hexdigest()}

        yield from _batches(rows(), schema)

    return _with_audits(turns, found).mapInArrow(work, out.schema)


def repair(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation in ``rows``."""
    turns = sorted_turns(rows)
    return digests(turns, stored(outcomes(turns, bits), "repair-outcomes"))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults by a checksum of ``conv_id:turn``: a turn of 20 is dropped, emptied, stripped of ``.!?``, repeated, or given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text: Column = F.coalesce("text", F.lit(" "))
    marked = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), fault.alias("_fault")).where("_fault != 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def repaired_conversations(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``repair`` of the damaged rows, for every conv_id of ``rows``; one whose turns are all lost has zeros and empty values."""
    found = repair(damaged(rows), bits).withColumnRenamed("conv_id", "_conv")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", *COUNTS, "cost")}
    return joined.drop("_conv").withColumns(zero | {
        "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
