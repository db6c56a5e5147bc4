"""Toxicity: the composed grammar against a plain reading of its rules, learning, and labels held out."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from isotherma.llm import toxicity

from ..conftest import SMALL


def plain(symbols):
    """What the four patterns say of a clause, one after the other; ends with END."""
    out, covered = [], 0
    for s in symbols:  # negation
        said = {"INSULT": "NEGATED", "HARM": "WORD"}.get(s, s) if covered else s
        covered = toxicity.WINDOW if s == "NOT" else max(0, covered - 1)
        out.append("WORD" if s == "NOT" else said)
    said_before = list(itertools.accumulate((s == "SAID" for s in out), lambda a, b: a or b, initial=False))
    out = [{"SAID": "WORD", "INSULT": "REPORTED" if r else s, "HARM": "WORD" if r else s}.get(s, s) for s, r in zip(out, said_before)]
    will_before = list(itertools.accumulate((s == "WILL" for s in out), lambda a, b: a or b, initial=False))
    out = [{"WILL": "WORD", "HARM": "THREAT" if w else "WORD"}.get(s, s) for s, w in zip(out, will_before)]
    weight = 0.0
    if "YOU" in out:
        at = out.index("YOU")
        before, after = out[:at], [s for s in out[at:] if s in ("INSULT", "THREAT")][:1]
        aimed = {s for s in before if s in ("INSULT", "THREAT")}
        if len(aimed) == 2:
            first = [s for s in before if s in ("INSULT", "THREAT")]
            aimed = set(first)
        aimed = aimed or set(after)
        weight = toxicity.TARGETED * ("INSULT" in aimed) + toxicity.THREATENED * ("THREAT" in aimed)
    return ["WORD" if s == "YOU" else s for s in out], weight


def test_grammar_against_plain_rules():
    rng = random.Random(3)
    symbols = [s for s in toxicity.ALPHABET if s != "END"]
    for n in range(3000):
        clause = rng.choices(symbols, k=rng.randint(1, 9))
        state, said, total = 0, [], 0.0
        for s in clause:
            state, out, more = toxicity.GRAMMAR.step(state, s)
            said.append(out)
            total += more
        assert (said, total) == plain(clause), clause
        assert toxicity.GRAMMAR.step(state, "END")[0] == 0


@pytest.mark.parametrize(("text", "high"), [
    ("You are an idiot.", 3.0), ("The idiot left.", 2.0), ("You are not an idiot.", 0.5), ("She said he is an idiot.", 1.0), ("I will kill you!", 4.0),
    ("I will not kill you.", 0.0), ("kill you", 0.0), ("Nothing here. At all", 0.0), ("", 0.0), ("IDIOTS; " * 3, 2.0)])
def test_clauses(text, high):
    reader = toxicity.Reader({"=idiot": 2.0, "^idiot": 2.0})
    total, most, matches, words = reader.measures(text)
    assert most == high and total == high * (3 if ";" in text else 1)


def test_learns_words_and_leaves_copies_alone(spark, make, words):
    rng = random.Random(8)
    insults = ["grumbold", "snarkel", "plimford"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = words(i, 60)
        if toxic:
            for w in rng.choices(insults, k=4):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic), 1))
    copied = " ".join(words(5000, 40)) + " zebrawood."
    rows += [(1000 + k, copied) for k in range(300)]  # one toxic text without an insult, copied
    labels += [(1000 + k, 1, 1) for k in range(300)]
    rows += [(None, "grumbold snarkel"), (2000, None), (2001, ""), (2002, "plain words only"), (2003, "grumbold " + "x y " * 400_000), (5, rows[5][1])]
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, marks)
    assert {f"={w}" for w in insults} <= set(model.lexicon) and "=zebrawood" not in model.lexicon
    got = toxicity.classify(docs, marks)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    found = {(r["doc_id"], r["predicted"]) for r in got.collect()}
    assert all((i, int(i % 4 == 0)) in found for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1)
    assert {(2000, 0), (2001, 0), (2002, 0)} <= found
    assert got.where("held_out <> (crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1)").count() == 0
    assert got.where("doc_id = 5").select("score").distinct().count() == 1
    clauses = toxicity.toxic_clauses(docs.where("doc_id = 0"), model)
    assert clauses.count() == 1 and "words" in clauses.columns


def test_no_labels_and_no_rows(spark, make):
    docs = make([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, none).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), none).count() == 0


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.where("toxic = 1").agg(F.avg("predicted")).first()[0] > 0.75
    assert got.where("toxic = 0").agg(F.avg("predicted")).first()[0] < 0.02
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.classify(docs, other)
    assert {(r[0], r[2]) for r in again.collect()} == {(r[0], r[2]) for r in toxicity.classify(docs, labels).collect()}
