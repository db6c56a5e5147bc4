"""The stages of the pipeline at the smallest scale against plain Python, each on its own input."""

import collections
import itertools
import re
import zlib

import numpy as np

import corpus_pipeline
from isotherma.session import stored
from tests.llm.test_native import best_windows, water

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(rows):
    """Components of rows linked at a similarity of 0.8; a row without words is alone."""
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            root[find(i)] = find(j)
    out = collections.defaultdict(set)
    for i, r in enumerate(rows):
        out[find(i)].add(r["doc_id"])
    return out


def leaking(rows, items):
    plain = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}
    held, out = [(i, grams(plain(i[1]))) for i in items if plain(i[1])], set()
    for r in rows:
        words = plain(r["text"])
        near = [i for i, own in held if own & {tuple(words[k : k + len(g)]) for g in [next(iter(own))] for k in range(len(words))}]
        out |= {doc for doc, _ in best_windows([(r["doc_id"], r["text"])], near)} if near else set()
    return out


def test_stages_against_plain_python(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        seen[name] = docs.collect()
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert all(list(seen[n][0].asDict()) == columns for n, _ in corpus_pipeline.STAGES[:-1])

    ids = {n: collections.Counter(r["doc_id"] for r in rows) for n, rows in seen.items()}
    assert ids["quality"] <= ids["documents"] and len(seen["quality"]) > len(seen["documents"]) / 2

    want = groups(seen["quality"])
    assert len(seen["near_duplicates"]) == len(want)
    assert all(len(own & set(ids["near_duplicates"])) == 1 for own in want.values())

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == leaking(seen["near_duplicates"], items)

    sizes, taken, least = collections.Counter(), collections.Counter(), {}
    for r in seen["decontamination"]:
        size = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += size
        taken[r["source"]] += size * ids["mixture"][r["doc_id"]]
        least[r["source"]] = max(size, least.get(r["source"], 0))
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = water(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(ranked)}, 1.5 * sum(sizes.values()), 2.0)
    assert all(abs(taken[s] - target[s]) <= least[s] / 2 + 1 for s in sizes) and max(ids["mixture"].values()) <= 2

    tokenizer = Tokenizer.from_file(path(corpus_pipeline.TOKENIZER))
    coded = collections.Counter()
    for r in seen["mixture"]:
        own = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        coded[r["doc_id"], len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert coded == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in seen["tokens"])
    ends = sorted((r["start"], r["n_tokens"]) for r in seen["tokens"])
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
