"""Conversation repair and the prefix trie, against brute force."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from isotherma.llm import prefix_trie, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            if rng.random() < 0.05:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rng.choice(["Yes.", "No!", "Why?", "well", " ", "", None, "See. ", "a b c.", "tail \n", "é?", "Yes. "])
            rows.append((c, None if rng.random() < 0.03 else t + (t > 3), role, text))
    rows += [(n + 1, 0, "user", "one."), (None, 1, "user", "lost?"), (None, None, "assistant", "lost."), (n + 2, 5, "user", "a."), (n + 2, 5, "user", "a.")]
    return rows


def brute_repair(turns):
    """Dijkstra over (turn, state) with the audit as the second part of the cost."""
    nexts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in (0, 3):
            return cost, audit, out
        for i, name in (("u", "user"), ("a", "assistant")):
            if i in nexts[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, nexts[state][i], (*out, (name, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in nexts[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, nexts[state][role[:1]], (*out, (role, text))))
                for i, name in (("u", "user"), ("a", "assistant")):
                    if i in nexts[state]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, nexts[state][i], (*out, (name, text))))


def brute_conversations(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = said(role), said(text)
        by[c] += []
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            by[c] += [(t, "user" if k == 4 else role, text)] * (1 + (k == 3))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, turns = set(), []
        for _, role, text in own:
            ink = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = {t for t, _, _ in own if t is not None}
        cost, audit, left = brute_repair(turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        count = collections.Counter(f for _, _, f in turns)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


@pytest.mark.parametrize(("bits", "longest"), [(12, 9), (2, 30)])
def test_repair_against_brute_force(spark, bits, longest):
    rows = conversations(bits, 150, longest)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS block", "'y' AS seq", "role AS cost").repartition(5)
    got = turn_repair.repaired_conversations(df, bits)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute_conversations(rows)


def test_repair_of_one_long_conversation(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"turn {t % 50}." if t % 7 else "cut off") for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = turn_repair.repaired_conversations(df, 6).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_conversations(rows)


def test_repair_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repaired_conversations(empty).count() == 0
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "x" * 3_000_000 + "?"), (1, 2, "assistant", "y.")]
    turns = turn_repair.sorted_turns(spark.createDataFrame(rows, SCHEMA))
    found = turn_repair.outcomes(turns)
    assert found.first()["audit"] == "KKK"
    assert [tuple(r) for r in turn_repair.repaired_turns(turns, found).orderBy("position").collect()] == [(1, k, r[2], r[3]) for k, r in enumerate(rows)]


def test_rules_are_shared_by_strings(spark):
    strings = spark.createDataFrame([("uaua" * 20,), ("s" + "ua" * 30,), ("uaX" * 9,), ("a",)], "seq string")
    rules, packed = turn_repair.grammar(strings)
    expand = dict(zip((chr(turn_repair.FIRST_RULE + k) for k in range(len(rules))), rules))

    def plain(s):
        return "".join(plain(expand[c]) if c in expand else c for c in s)

    assert rules and all(plain(r["packed"]) == r["seq"] for r in packed.collect())
    assert sum(len(r["packed"]) for r in packed.collect()) < 40


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tree_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(130):
        for t in range(rng.choice([1, 2, 3, 5, 9, 30])):
            rows.append((c, t or None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "d e\tf "])))
    rows += [(c, t, "user", "the same words") for c in range(200, 260) for t in range(12)]
    return rows + [(None, 0, "user", "x"), (301, 0, "u", "y"), (301, 0, "u", "y"), (17, 0, "user", "tie"), (17, 0, "user", "also a tie")]


@pytest.mark.parametrize("block", [8, 2])
def test_trie_against_brute_force(spark, block):
    rows = tree_rows(block)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "'y' AS b", "role AS t1").repartition(5)
    got = prefix_trie.rebuilt_trie(df, block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(f.dataType.typeName() == "long" for f in got.schema.fields[:-1])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    rows = [(c, t, "user", f"{t} {t % 3 if c > 2 else 0}" if t < 40 * c else "end") for c in range(5) for t in range(60 * c + 1)]
    assert sorted((tuple(r) for r in prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), 4).collect()), key=str) == brute_trie(rows)


def test_trie_of_no_rows(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
