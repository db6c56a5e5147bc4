"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer reads a word and says what it is: an insult with a weight, a verb of harm, an announcement, a target, a negation, a verb of speech.
Insults and their weights are learned: whole words and beginnings of words, so that compounds and endings count. Four small transducers are
composed into one: negation (an insult within three words after it is negated), reported speech (what follows a verb of speech in the clause is reported),
threat (harm that is announced), and target (an insult or threat that is aimed at somebody weighs more). The composed transducer reads whole clauses,
and a clause's score is the sum of its path; isolated words of a clause that no pattern matches score nothing. A logistic curve, fitted on clause scores,
turns what the clauses of a text add up to into a score from 0 to 1; texts without a match score the share of toxic ones among such texts.

Learning. At most ``SAMPLE`` labelled documents (those with the smallest hash of the id) are used. Of near copies, found by three MinHashes in turn,
one is counted, so a text that was copied a thousand times is no evidence for its words. Words are counted by halves of the sample, and a text's
clauses are weighed with the words of the other half while the curve is fitted, so that words which stand in a few texts by chance do not mislead it.

Defined results. NULL texts are empty; empty texts score what a text without any match does. Repeated rows and equal texts get equal scores. Rows
without label, also those with NULL ids, are scored and not learned from. Without toxic or without clean labels all scores are 0. Very long texts are read
whole, clause by clause. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .store import mixed, slices, texts
from .transducers import ANY, Transducer, compose
from .words import hashed_words, shingles

SAMPLE = 200_000  # labelled documents at most
LEXICON = 20_000  # insults at most
BEGINNINGS = range(4, 11)  # letters of a beginning of a word that is counted
LEAST = 3  # toxic texts that must have a feature
EVIDENCE = 2.0  # standard errors by which a log ratio is drawn towards 0; what is left is the weight
FLUSH = 400_000  # features that a task counts before it hands them on
WINDOW = 3  # words that a negation covers
FACTOR = {"INSULT": 1.0, "NEGATED": 0.25, "REPORTED": 0.5, "THREAT": 1.0}  # of a word's weight, by what the grammar makes of it
TARGETED, THREATENED = 1.0, 4.0  # added once a clause

# Function words of four languages.
CLASSES = {
    "YOU": "you your you're ur he she they him her them his their du dich dir dein ihr euch sie tu toi te vous ton votre il elle ils tú te ti usted ustedes vosotros él ella ellos",
    "NOT": "not no never neither nor isn't aren't don't doesn't wasn't without nicht kein keine nie weder ohne pas jamais ni sans aucun no nunca jamás ni sin",
    "SAID": "said says wrote writes called quoted quote reported claimed sagte schrieb nannte behauptete zitierte dit écrit appelé cité dijo escribió llamó citó",
    "WILL": "will gonna going shall i'll we'll werde werden wird vais allons va voy vamos va",
    "HARM": "kill hurt destroy beat murder stab shoot burn töten schlagen verletzen vernichten tuer frapper détruire brûler matar golpear destruir quemar",
}
FUNCTION = {w: name for name, words in CLASSES.items() for w in words.split()}
ALPHABET = ["WORD", "INSULT", *CLASSES, "END"]
PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]+")


def negation() -> Transducer:
    t = Transducer().arc(0, ANY, 0).arc(0, "NOT", WINDOW, "WORD")
    for k in range(1, WINDOW + 1):
        t.arc(k, ANY, k - 1).arc(k, "NOT", WINDOW, "WORD").arc(k, "INSULT", k - 1, "NEGATED").arc(k, "HARM", k - 1, "WORD").arc(k, "END", 0)
    return t


def reported() -> Transducer:
    t = Transducer().arc(0, ANY, 0).arc(0, "SAID", 1, "WORD").arc(1, ANY, 1).arc(1, "SAID", 1, "WORD").arc(1, "END", 0)
    return t.arc(1, "INSULT", 1, "REPORTED").arc(1, "HARM", 1, "WORD")


def threat() -> Transducer:
    t = Transducer().arc(0, ANY, 0).arc(0, "HARM", 0, "WORD").arc(0, "WILL", 1, "WORD")
    return t.arc(1, ANY, 1).arc(1, "WILL", 1, "WORD").arc(1, "HARM", 1, "THREAT").arc(1, "END", 0)


def target() -> Transducer:
    """States: nothing, a target, an insult, a threat, an insult and a threat that still lack one; "done" when all has been weighed."""
    t = Transducer()
    for state in (0, "you", "insult", "threat", "both", "done"):
        t.arc(state, ANY, state).arc(state, "END", 0)
    t.arc(0, "YOU", "you", "WORD").arc(0, "INSULT", "insult").arc(0, "THREAT", "threat")
    t.arc("you", "YOU", "you", "WORD").arc("you", "INSULT", "done", weight=TARGETED).arc("you", "THREAT", "done", weight=THREATENED)
    t.arc("insult", "YOU", "done", "WORD", TARGETED).arc("insult", "THREAT", "both")
    t.arc("threat", "YOU", "done", "WORD", THREATENED).arc("threat", "INSULT", "both")
    return t.arc("both", "YOU", "done", "WORD", TARGETED + THREATENED).arc("done", "YOU", "done", "WORD")


GRAMMAR = compose([negation(), reported(), threat(), target()], ALPHABET)


def features_of(word: str) -> list[str]:
    """The whole word, and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if n <= len(word))]


@dataclass
class Reader:
    """Scores clauses with a lexicon. ``known`` remembers words; None is a word that says nothing."""

    lexicon: dict[str, float]
    known: dict = field(default_factory=dict)

    def look_up(self, word: str) -> tuple[str, float] | None:
        if len(self.known) > 200_000:
            self.known.clear()
        if word[0] in ".!?;:\n":
            found = ("END", 0.0)
        elif word in FUNCTION:
            found = (FUNCTION[word], 0.0)
        else:
            weight = max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)
            found = ("INSULT", weight) if weight > 0 else None
        self.known[word] = found
        return found

    def clause(self, words: list[tuple[str, float] | None]) -> tuple[float, bool]:
        """The score of a path through the grammar, never below 0, and whether a pattern matched."""
        state, total, matched = 0, 0.0, False
        for found in words:
            symbol, weight = found or ("WORD", 0.0)
            state, said, more = GRAMMAR.step(state, symbol)
            matched |= said in FACTOR
            total += more + weight * FACTOR.get(said, 0.0)
        return max(0.0, total), matched

    def measures(self, text: str) -> tuple[float, float, float, float]:
        """Sum of clause scores, the highest, clauses matched, and words."""
        total = high = matches = words = 0.0
        clause: list = []
        alive = False
        known, none = self.known, object()
        for piece in PIECE.findall(text.lower() + "\n"):
            found = known.get(piece, none)
            if found is none:
                found = self.look_up(piece)
            if found is not None and found[0] == "END":
                words += len(clause)
                if alive:
                    score, matched = self.clause(clause)
                    total, high, matches = total + score, max(high, score), matches + matched
                clause, alive = [], False
                continue
            clause.append(found)
            alive = alive or (found is not None and found[0] in ("INSULT", "HARM"))
        return total, high, matches, words


def inputs(measures: np.ndarray) -> np.ndarray:
    """What the curve sees of (sum, highest, matches, words)."""
    total, high, matches, words = measures.T
    length = np.log1p(words)
    return np.column_stack([np.ones(len(total)), total, np.sqrt(total), high, matches, length, 100 * total / (20 + words), np.sqrt(total) * length])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method on centred and scaled inputs; the first is constant."""
    centre = np.concatenate([[0.0], x[:, 1:].mean(axis=0)])
    scale = np.concatenate([[1.0], np.maximum(x[:, 1:].std(axis=0), 0.5)])  # no steep slopes from inputs that hardly vary
    z = (x - centre) / scale
    beta, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - pull * beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), gradient)
        beta += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    slopes = beta / scale
    slopes[0] -= (slopes[1:] * centre[1:]).sum()
    return slopes


@dataclass(frozen=True)
class Model:
    """A lexicon, the curve for texts with a match, and ``base``, the score of those without one."""

    lexicon: dict[str, float]
    beta: np.ndarray | None
    base: float = 0.0

    def scores(self, rows: list[str], reader: Reader) -> np.ndarray:
        if self.beta is None or not rows:
            return np.full(len(rows), self.base)
        seen = np.array([reader.measures(t) for t in rows])
        z = inputs(seen) @ self.beta
        return np.where(seen[:, 2] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.base)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half) of labelled documents that are not held out, one of near copies; at most SAMPLE."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "toxic-labels").withColumnRenamed("doc_id", "_id")
    told = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most SAMPLE ids
    told = told.select("text", "toxic", F.xxhash64("text").alias("_text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(0))
            keys = np.zeros((3, len(rows)), np.int64)
            for a, b in slices(rows):
                values, owner = shingles(hashed_words(rows[a:b]), b - a, 3)
                starts = np.flatnonzero(np.diff(np.concatenate([[-1], owner])))
                for k in range(3):
                    if len(values):
                        keys[k, a + owner[starts]] = np.minimum.reduceat(mixed(values, 90 + k), starts).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(k) for k in keys]], names=["toxic", "_text", "k0", "k1", "k2"])

    one = told.mapInArrow(sketch, "toxic int, _text long, k0 long, k1 long, k2 long")
    for k in ("k0", "k1", "k2"):  # texts of a similarity of 0.8 share one of three with a chance of 0.99
        one = one.groupBy("toxic", k).agg(F.min(F.struct("_text", "k0", "k1", "k2")).alias("_one")).select("toxic", "_one.*")
    chosen = one.groupBy(F.col("_text").alias("_key")).agg(F.max("toxic").alias("_toxic"))
    unique = told.dropDuplicates(["_text"]).join(chosen, F.col("_text") == F.col("_key"))
    return stored(unique.select("text", F.col("_toxic").alias("toxic"), (F.shiftright("_text", 7) % 2 == 0).cast("int").alias("half")), "toxic-training")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n00, n01, n10, n11): texts of each half and label that have it."""
    names = ["n00", "n01", "n10", "n11"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        of: dict[str, list[str]] = {}

        def batch() -> pa.RecordBatch:
            columns = list(zip(*counts.values())) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["feature", *names])

        for b in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in b.columns)):
                at, seen = 2 * half + toxic, set()
                for word in set(PIECE.findall(text.lower())):
                    if word not in of:
                        if len(of) > 200_000:
                            of.clear()
                        of[word] = [] if word[0] in ".!?;:\n" or word in FUNCTION or len(word) > 40 else features_of(word)
                    seen.update(of[word])
                for f in seen:
                    if f in counts:
                        counts[f][at] += 1
                    else:
                        counts[f] = [0, 0, 0, 0]
                        counts[f][at] = 1
                if len(counts) > FLUSH:
                    yield batch()
                    counts.clear()
        yield batch()

    counted = rows.select("text", "toxic", "half").mapInArrow(work, "feature string, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def weight(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """The log ratio of the shares of toxic and clean texts, less its standard errors; NULL where it tells nothing."""
    a, b = toxic + 0.5, clean + 0.5
    ratio = F.log(a / (n_toxic + 1)) - F.log(b / (n_clean + 1)) - EVIDENCE * F.sqrt(1 / a + 1 / b)
    return F.when((toxic >= LEAST) & (ratio > 0), ratio)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training(docs, labels)
    sizes = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}  # four rows
    n = {(h, t): sizes.get((h, t), 0) for h in (0, 1) for t in (0, 1)}
    if not all(n[0, t] + n[1, t] for t in (0, 1)):
        return Model({}, None)
    w0 = weight(F.col("n01"), F.col("n00"), n[0, 1], n[0, 0])
    w1 = weight(F.col("n11"), F.col("n10"), n[1, 1], n[1, 0])
    both = weight(F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10"), n[0, 1] + n[1, 1], n[0, 0] + n[1, 0])
    found = feature_counts(rows).select("feature", w0.alias("w0"), w1.alias("w1"), both.alias("w")).where("coalesce(w0, w1, w) IS NOT NULL")
    best = found.orderBy(F.desc(F.coalesce("w", F.greatest("w0", "w1"))), "feature").limit(LEXICON).toArrow().to_pylist()
    pick = lambda name: {r["feature"]: r[name] for r in best if r[name] is not None}
    halves, whole = [pick("w0"), pick("w1")], pick("w")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(halves[1]), Reader(halves[0])]  # the other half's words
        for b in batches:
            got = [readers[h].measures(t) for t, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(c, pa.float64()) for c in np.array(got).reshape(len(got), 4).T]], names=["toxic", "a", "b", "c", "d"])

    seen = rows.select("text", "toxic", "half").mapInArrow(measure, "toxic int, a double, b double, c double, d double").toArrow()  # at most SAMPLE rows
    x = np.column_stack([seen.column(c).to_numpy() for c in "abcd"])
    order = np.lexsort(x.T)  # the rows come in no fixed order
    x, y = x[order], seen.column("toxic").to_numpy()[order].astype(float)
    hit = x[:, 2] > 0
    base = float((y[~hit].sum() + 1) / ((~hit).sum() + 20))
    return Model(whole, fit_curve(inputs(x[hit]), y[hit]) if hit.any() else None, base)


def scored(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for b in batches:
            score = model.scores([t or "" for t in b.column(1).to_pylist()], reader)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double, predicted int")


def toxic_clauses(docs: DataFrame, model: Model) -> DataFrame:
    """The clauses that score: doc_id, clause (its number in the text), its words and its score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for b in batches:
            out: list = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                number, words = 0, []
                for piece in PIECE.findall((text or "").lower() + "\n"):
                    if piece[0] not in ".!?;:\n":
                        words.append(piece)
                        continue
                    score, matched = reader.clause([reader.look_up(w) for w in words])
                    if matched and score > 0:
                        out.append((doc, number, " ".join(words), score))
                    number, words = number + bool(words), []
            columns = zip(*out) if out else [()] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "clause", "words", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, clause long, words string, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, learned from the labels that are not held out."""
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
