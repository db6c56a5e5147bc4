import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, source]) as a documents table with columns whose names clash with the operators' own."""

    def table(rows, n=3):
        full = [(r[0], r[1], "xx", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        extra = {c: df["lang"] for c in ("size", "kept", "score", "spans", "blob", "target", "copies", "n_lines", "shard", "slot", "hash", "node", "start", "key")}
        return df.withColumns(extra).repartition(n)

    return table


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda seed, n: random.Random(seed).choices(vocabulary, k=n)
