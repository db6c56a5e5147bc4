"""Operators that work in Python tasks: line chunks, token files, digests, importance, near-duplicates, WARC."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import uuid
import zlib

import numpy as np
import pytest
import xxhash

from isotherma.llm import components, elias_fano, importance, line_chunks, rarity_digest, superminhash, token_files, warc_bundles
from isotherma.llm.words import shingle_sets
from isotherma.session import shared_folder

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ODD = ["", "  a  b\n\n c", "don't  you'll\t\tx", "<|endoftext|> x <|endoftext|>y", " lead", "trail ", "a b c d", "日本 語 텍스트", "x²½ ǅ ɐ µª",
       "12 345a6,b_ __ -- \x1c \x85", "a" * 200 + " " + "b" * 60, "\n\n", "\r\n a", "é è " * 500]


def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# line chunks

def brute_dedup(rows):
    seen, out = {}, []
    hashes = {t: h for t, h in rows}
    for doc, text in sorted(((d, t) for d, t in hashes), key=lambda x: (x[0] is None, x[0] or 0, hashes[x])):
        for no, lines in enumerate(line_chunks.cut((text or "").encode())):
            if len(lines) >= 2:
                seen.setdefault(b"\n".join(lines), (doc, text, no))
    for (doc, text), _ in rows:
        chunks = line_chunks.cut((text or "").encode())
        left = [x for no, c in enumerate(chunks) if len(c) < 2 or seen[b"\n".join(c)] == (doc, text, no) for x in c]
        out.append((str(doc), None if text is None else b"\n".join(left).decode()))
    return sorted(out, key=str)


def test_line_chunks_against_brute_force(spark, make, words):
    passage = "\n".join(" ".join(words(70 + k, 6)) for k in range(12))
    rows = [(i, "\n".join([" ".join(words(i, 5)), *[" ".join(words(i * 9 + k, 4)) for k in range(i % 4)], passage, " ".join(words(i + 500, 5))])) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (None, passage), (3, rows[3][1]), (60, "x\n" * 3000), (61, "x\n" * 3000)]
    df = make(rows)
    hashed = [((r["doc_id"], r["text"]), r["h"]) for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]
    got = line_chunks.dedup(df)
    assert sorted(((str(r["doc_id"]), r["text"]) for r in got.collect()), key=str) == brute_dedup(hashed)
    assert got.where("n_removed > 0").count() > 10
    assert set(got.columns) == set(df.columns) | {"n_lines", "n_removed"}
    assert line_chunks.dedup(df.limit(0)).count() == 0


def test_no_chunk_has_one_line(words):
    for n in range(2, 200):
        assert min(map(len, line_chunks.cut("\n".join(" ".join(words(n * 1000 + k, 5)) for k in range(n)).encode()))) >= 2
    assert min(map(len, line_chunks.cut(b"x\n" * 3000))) >= 2 and line_chunks.cut(b"x") == [[b"x"]]


def test_passages_go_up_to_their_edges(spark, make, words, tmp_path):
    from isotherma.llm import queries

    text = lambda seed, n, size=10: [" ".join(words(seed + k, size)) for k in range(n)]
    rows, want = [], {}
    for k, (n, size) in enumerate([(5, 10), (6, 10), (8, 10), (12, 10), (2, 30), (3, 20), (5, 11), (20, 3)] * 5):
        passage = text(10_000 + 100 * k, n, size)
        for doc in (k, 100 + k):
            before, after = text(100_000 + 1000 * doc, k % 4), text(500_000 + 1000 * doc, (k + 1) % 3)
            rows.append((doc, "\n".join([*before, *passage, *after])))
            want[doc] = "\n".join([*before, *(passage if doc < 100 else []), *after])
    again = text(900_000, 6)
    rows += [(300, "\n".join(["a", *again, *again, "b"])), (301, "\n".join(["c d e"] * 400)), (302, "\n".join([*text(950_000, 1, 60), *text(960_000, 3)])), (303, "\n".join([*text(950_000, 1, 60), *text(970_000, 3)]))]
    want |= {300: "\n".join(["a", *again, "b"]), 302: rows[-2][1], 303: rows[-1][1]}
    make(rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op1_line_chunks(spark, str(tmp_path)).collect()}
    assert {d: out[d]["text"] for d in want} == want
    left = out[301]["text"].split("\n")
    assert 17 <= len(left) <= 128 and set(left) == {"c d e"} and out[301]["n_removed"] == 400 - len(left)


def test_boundaries_resist_shifts(words):
    text = [" ".join(words(k, 5)).encode() for k in range(200)]
    a, b = line_chunks.cut(b"\n".join(text)), line_chunks.cut(b"\n".join([b"new line", *text]))
    assert len({tuple(x) for x in a} & {tuple(x) for x in b}) >= len(a) - 2
    assert b"\n".join(x for c in a for x in c) == b"\n".join(text)


# token files

@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-9, -9, 3, 10**12], list(range(0, 40000, 7)), [0] * 2000 + [10**9]])
def test_elias_fano(values):
    data = elias_fano.encode(np.array(values, np.int64))
    seq = elias_fano.Sequence(data)
    assert seq.range(0, len(values)).tolist() == values
    assert [seq.select(i) for i in range(0, len(values), 97)] == values[::97]
    if len(values) > 1000 and values[-1] < 50000:
        assert len(data) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 2


def test_chunk_encoder_equals_the_tokenizer(words):
    from tokenizers import Tokenizer

    own, plain = token_files.ChunkEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in [*ODD, *ODD, *[" ".join(words(i, 60)).capitalize() + ",\nEnd." for i in range(50)]]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, make):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rows = [(i * 3 - 20, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (7, "again"), (7, "again"), (1000, None)]
    at = folder(spark)
    token_files.write_shards(make(rows), at, TOKENIZER)
    got = sorted((r.asDict() for r in token_files.read_documents(spark, at, True).collect()), key=lambda r: r["start"])
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [0]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        assert r["start"] == start and r["ids"] in [ids(t) for d, t in rows if d == r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    name = spark.read.parquet(f"{at}/manifest").orderBy("part").first()["name"]
    assert token_files.Shard(at, name).document(0).tolist() == got[0]["ids"]
    none = folder(spark)
    token_files.write_shards(make(rows).limit(0), none, TOKENIZER)
    assert token_files.read_documents(spark, none).count() == 0


# digests

def slow_levels(data):
    out = []
    for i in range(len(data) - 63):
        total = sum(int(rarity_digest.PLOG[c]) for c in collections.Counter(data[i:i + 64]).values())
        out.append((rarity_digest.TOP - total) * 1023 // rarity_digest.TOP)
    return out


def test_entropy_levels(words):
    text = (" ".join(words(1, 60)) + "a" * 100).encode()
    assert rarity_digest.entropy_levels(np.frombuffer(text, np.uint8)).tolist() == slow_levels(text)


def test_features_are_those_of_all_runs(words):
    text = " ".join(words(2, 100)).encode()
    levels = rarity_digest.entropy_levels(np.frombuffer(text, np.uint8))
    ranks = rarity_digest.rank_table([(int(a), int(b)) for a, b in zip(*np.unique(levels, return_counts=True))])
    votes = collections.Counter(min(range(i, i + 64), key=lambda j: (ranks[levels[j]], j)) for i in range(len(levels) - 63))
    assert rarity_digest.feature_starts(levels, ranks).tolist() == sorted(i for i, n in votes.items() if n >= 16)


def test_digests_of_documents(spark, make, words):
    rows = [(i, " ".join(words(i, 200 + i))) for i in range(12)] + [(40, None), (41, ""), (42, "short"), (43, "é" * 70), (5, "same id"), (None, "no id"), (None, "no id")]
    df = make(rows)
    ranks = rarity_digest.rank_table([(r["level"], r["n"]) for r in rarity_digest.level_counts(df).collect()])
    order = [(r["doc_id"], r["text"] or "") for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").orderBy("doc_id", "h").collect()]
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))
                              for r in rarity_digest.compare_with_next(df, ranks).collect())
    want = collections.Counter()
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        changed = (text[: len(text) - half] + after[:half]).encode()
        own, its, other = (rarity_digest.digest(x, ranks) for x in (text.encode(), changed, after.encode()))
        want[doc, len(text), hashlib.sha256(changed).hexdigest(), own.spelled(), its.spelled(), round(rarity_digest.likeness(own, its), 9), round(rarity_digest.likeness(own, other), 9)] += 1
    assert got == want
    assert rarity_digest.compare_with_next(df.limit(0), ranks).count() == 0
    one = rarity_digest.compare_with_next(make([(1, "only")]), ranks).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_likeness(words):
    ranks = rarity_digest.rank_table([(900 + k, k + 1) for k in range(100)])
    a, b = " ".join(words(1, 400)), " ".join(words(2, 400))
    half = rarity_digest.likeness(*[rarity_digest.digest(x.encode(), ranks) for x in (a, a[: len(a) // 2] + b[len(b) // 2:])])
    same, other = (rarity_digest.likeness(rarity_digest.digest(a.encode(), ranks), rarity_digest.digest(x.encode(), ranks)) for x in (a, b))
    assert same == 1.0 and other < 0.2 < half < 0.9
    d = rarity_digest.digest(a.encode(), ranks)
    assert rarity_digest.Digest.read(d.spelled()).spelled() == d.spelled()
    empty = rarity_digest.digest(b"", ranks)
    assert rarity_digest.likeness(empty, empty) == 1.0 and rarity_digest.likeness(empty, d) == 0.0


# importance

def test_importance_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = "pmod(xxhash64(doc_id), 4) = 0"
    kept = {r["doc_id"] for r in importance.resample(docs, labels.where(f"NOT {held}")).where("kept").collect()}
    rows = labels.where(held).collect()
    share = lambda rs: sum(r["doc_id"] in kept for r in rs) / max(1, len(rs))
    assert share([r for r in rows if r["quality"] == 1 and r["toxic"] == 0]) > 0.85
    assert share([r for r in rows if r["quality"] == 0 and r["toxic"] == 0]) < 0.3


def test_importance_edges(spark, make, words):
    labels = "doc_id long, quality int, toxic int"
    rows = [(i, " ".join(words(i, 50)) + (" %%% bad $$$" * 9 if i % 3 == 0 else "")) for i in range(60)] + [(None, None), (70, ""), (71, None), (5, " ".join(words(5, 50)))]
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (41, None, None)], labels)
    out = importance.resample(make(rows), known).collect()
    assert len(out) == len(rows)
    assert sum(r["kept"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 3 == 0) <= 2
    assert sum(r["kept"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 3) >= 36
    assert importance.resample(make(rows), known.limit(0)).where("kept").count() == len(rows)
    assert importance.resample(make(rows).limit(0), known).count() == 0


def brute_importance(rows, good, known, seed=29):
    """Scores and kept keys by plain counting of the n-grams themselves."""
    def grams(text):
        whole = re.sub(r"[ \t\n]+", " ", text.lower() + "\n")
        out = [whole[i:i + n] for n in importance.GRAMS for i in range(len(whole) - n + 1)]
        w, run = text.lower().split(), 0
        for x, y in itertools.pairwise(w):
            run = run + 1 if x == y else 0
            out.append(("again", min(run, importance.RUNS)) if run else (x, y))
        return out

    found = [grams(t) for _, t in rows]
    n, g = (collections.Counter(f for (doc, _), own in zip(rows, found) if some is None or doc in some for f in set(own)) for some in (None, good))
    n_good = sum(doc in good for doc, _ in rows)

    def ratio(f):
        a, b = g[f] + 0.5, n[f] + 0.5
        return min(0.0, math.log(a / (n_good + 1)) - math.log(b / (len(rows) + 1)) + importance.ERRORS * math.sqrt(1 / a + 1 / b))

    scores = [sum(map(ratio, own)) * min(1, importance.TYPICAL / max(1, len(t))) for (_, t), own in zip(rows, found)]

    def key(doc, text, score):
        h = 42
        for part in (struct.pack("<i", seed), struct.pack("<q", doc), text.encode()):
            h = xxhash.xxh64_intdigest(part, h)
        return score - math.log(-math.log(((h >> 11) + 0.5) / 2**53))

    keys = [key(d, t, x) for (d, t), x in zip(rows, scores)]
    marked = sorted((x, known[d]) for (d, _), x in zip(rows, scores) if d in known)
    least = sorted({x for x, _ in marked})
    worth = lambda c: (sum(x >= c for x, ok in marked if ok) / sum(ok for _, ok in marked)
                       + sum(x < c for x, ok in marked if not ok) / sum(not ok for _, ok in marked))
    at = max(range(len(least)), key=lambda i: (round(worth(least[i]), 12), -i))
    cut = (least[at] + least[at - 1]) / 2 if at else -math.inf
    k = sum(x >= cut for x in scores)
    return scores, keys, sorted(keys)[-k], k


def test_importance_is_that_of_plain_counts(spark, make, words):
    few = words(1, 14)
    rng = random.Random(8)
    bad = ["#buy#", "now!!", "$$$"]
    rows = []
    for i in range(240):
        own = rng.choices(few, k=rng.randint(3, 12)) + (rng.choices(bad, k=6) if i % 3 == 0 else [])
        rows.append((i, (" ", "  ", "\n")[i % 3].join(own).title()))
    rows += [(500, "  ".join(rng.choices(few, k=400))), (501, " ".join(bad * 120)), (502, "x x x x x " + " ".join(few)), (3, rows[3][1]), (4, rows[4][1]), (4, rows[4][1]), (503, "")]
    labels = [(i, int(i % 3 > 0), int(i == 4)) for i in range(0, 240, 2)]
    good = {i for i, quality, toxic in labels if quality and not toxic}
    scores, keys, least, k = brute_importance(rows, good, {i: i in good for i, _, _ in labels})
    out = importance.resample(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = sorted((d, x, y, y >= least) for (d, _), x, y in zip(rows, scores, keys))
    got = sorted((r["doc_id"], r["score"], r["gumbel_key"], r["kept"]) for r in out)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[3] for g in got] == [w[3] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4) and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)
    assert k <= sum(g[3] for g in got) < len(rows) and min(x for _, x, _, _ in want) < 0


def test_threshold_is_exact(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(500)] + [1.0] * 40 + [-1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "_key double")
    for k in (1, 7, 45, 300, 541):
        assert importance.threshold(df, k) == sorted(values)[-k]
    assert importance.threshold(df, 542) is None


# near-duplicates

def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_groups(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and rule.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]))]
    top = dict(components.forest([(b, a) for a, b in pairs]))
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[top.get(i, i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[top.get(i, i)]) for i in range(len(rows)))


def edited(text, n, rng, words):
    for k in range(n):
        text = list(text)
        text[rng.randrange(len(text))] = words(rng.randrange(10**6), 1)[0]
    return text


@pytest.mark.parametrize("rule", [superminhash.Rule(3, 85), superminhash.Rule(5, 80)])
def test_near_groups_against_brute_force(make, words, rule):
    rng = random.Random(rule.words)
    rows = [(i, " ".join(words(i, 5 + i % 90))) for i in range(40)]
    for family in range(3):  # copies of copies, some too far from the first one
        base = words(1000 + family, 150)
        for k in range(40):
            base_k = edited(base, rng.choice([0, 1, 2, 3, 5, 8]), rng, words)
            rows.append((100 + family * 100 + k, " ".join(base_k)))
            if k % 10 == 0:
                base = base_k
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  B"), (905, "a"), (None, rows[0][1]), (None, "alone here"), (10, rows[10][1])]
    got = collections.Counter((r["id"], r["n"], r["component"]) for r in superminhash.groups(make(rows), rule).collect())
    assert got == brute_groups(rows, rule)


def test_one_of_each_group_stays(make, words):
    text = " ".join(words(1, 100))
    rows = [(4, text), (3, text), (3, text), (9, " ".join(words(2, 100))), (None, text), (None, None), (5, ""), (5, "")]
    df = make(rows)
    out = superminhash.one_per_group(df, superminhash.Rule())
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "5", "9", "None"] and out.columns == df.columns
    assert superminhash.groups(df.limit(0), superminhash.Rule()).count() == 0


def test_groups_stay_apart_without_ids_and_with_repeated_ids(make, words):
    texts = [" ".join(words(k, 100)) for k in range(8)]
    rows = [*[(None, t) for t in texts[:4]], (None, texts[0]), (None, None), (None, ""), (None, " "), (7, texts[4]), (7, texts[5]), (7, texts[5] + " x"), (7, ""), (8, texts[6]), (None, texts[6])]
    out = superminhash.one_per_group(make(rows), superminhash.Rule())
    left = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    near = [x for x in left if x[1] and x[1].startswith(texts[5])]
    assert len(near) == 1
    assert left == collections.Counter([*[(None, t) for t in texts[:4]], (None, None), (None, ""), (None, " "), (7, texts[4]), near[0], (7, ""), (8, texts[6])])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = pool[:200], pool[100:]
        sig = superminhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), 2)
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(2 / 9 / superminhash.SLOTS) * 1.1


def test_shingle_sets_have_the_sizes_of_text_shingles(words):
    rows = [" ".join(words(i, i)) for i in range(30)] + ["the the the the the", "\x0bA\tb\x0c", "x" * 9000 + " y"]
    assert [len(s) for s in shingle_sets([t.encode() for t in rows], 3)] == [len(shingles(t, 3)) for t in rows]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert sorted(map(tuple, components.components(df).collect())) == sorted(components.forest(edges))
    assert components.components(df.limit(0)).count() == 0


# WARC

def test_warc_round_trip(spark):
    big, other = "<p>" + "é" * 700 + "</p>", "x" * 200_000
    rows = [(1, "http://a/ü?x=1 2\n", big), (5, None, big), (3, "http://c", big), (5, "http://again", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big),
            (8, "u", other), (9, "u", "a\r\n\r\nWARC/1.1\r\n" * 100)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    at = folder(spark)
    index = warc_bundles.write_bundles(df, at)
    got = collections.Counter(tuple(r) for r in warc_bundles.read_bundles(spark, at).collect())
    want = collections.Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        best = max((p for p, _, h in rows if h == html and p is not None), default=None)
        same = sum(h == html for _, _, h in rows)
        revisit = len(body) >= 1000 and same > 1 and best is not None and page != best
        want[page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best if revisit else None] += 1
    assert got == want
    ids = {r["record_id"] for r in index.collect()}
    for r in index.collect():
        head, block = warc_bundles.read_record(at, r["name"], r["frame"], r["offset"])
        assert head["WARC-Record-ID"] == f"<{r['record_id']}>"
        if head["WARC-Type"] == "revisit":
            assert head["WARC-Refers-To"].strip("<>") in ids
    none = folder(spark)
    warc_bundles.write_bundles(df.limit(0), none)
    assert warc_bundles.read_bundles(spark, none).count() == 0


def test_frames_are_read_in_as_many_tasks_as_they_need(spark):
    """Payloads larger than a frame, and more frames than one task takes."""
    rng = random.Random(8)
    rows = [(i, f"http://x/{i}", "".join(rng.choices("abcdefgh", k=2_000_000 if i == 3 else 400_000))) for i in range(60)]
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    warc_bundles.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), folder)
    read = warc_bundles.read_bundles(spark, folder)
    assert read.rdd.getNumPartitions() > 1
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in read.collect()}
    assert got == {i: (len(html), hashlib.sha1(html.encode()).hexdigest()) for i, _, html in rows}
