"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger (Parquet in the shared folder) holds, for each
blob and rule version that was ever scanned, the spans found, also when there are none. A run scans each blob once, only for the rule
versions the ledger does not have, appends to the ledger, and joins the findings back to all paths that hold the blob.

All of it is DataFrame operations. Positions come from the lengths of what lies between matches and of the matches themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``least`` characters of group ``group`` make a match count; ``version`` changes when the rule does."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The base rules. A run of hex digits or of an access key is maximal, so its least length stands in the pattern;
# a short assignment consumes its text, so there the length is checked afterwards.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
ENTRY = "array<struct<kind:string,version:int>>"
SPANS = "array<struct<start:int,stop:int,kind:string>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _lengths(text: Column, rule: Rule) -> Column:
    """Lengths before each match, of each match and of its group; NULL without a match."""
    pattern = F.lit(rule.pattern)
    before = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    sizes = lambda parts: F.transform(parts, lambda x: F.char_length(x))
    zipped = F.arrays_zip(F.slice(sizes(before), 1, F.size(hits)).alias("a"), sizes(hits).alias("b"), sizes(groups).alias("c"))
    found = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), zipped.alias("runs"))
    return F.when(text.rlike(rule.pattern), found)


def _missing(rule: Rule) -> Column:
    have = F.coalesce(F.array_contains("_have", F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))), F.lit(False))
    return ~have


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows (blob, scanned, spans); none if nothing has been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"blob string, scanned {ENTRY}, spans {SPANS}"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_unseen(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...], text_col: str = "text") -> None:
    """Scan the blobs and rule versions that the ledger lacks, each distinct blob once, and append what was found.

    An append that fails leaves no rows, so the same call can be repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(blob_of(F.col(text_col)).alias("blob"), text.alias("_text")).dropDuplicates(["blob"])
    seen = read_ledger(docs.sparkSession, ledger_path)
    have = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("_have"))
    todo = F.filter(F.array(*[F.when(_missing(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))) for r in rules]),
                    lambda x: x.isNotNull())
    unseen = blobs.join(have, "blob", "left").withColumn("scanned", todo).where(F.size("scanned") > 0)
    found = F.filter(F.array(*[F.when(_missing(r), _lengths(F.col("_text"), r)) for r in rules]), lambda x: x.isNotNull())
    hits = unseen.select("blob", "scanned", F.explode_outer(found).alias("_f"))
    runs = hits.select("blob", "scanned", "_f.kind", "_f.least", F.posexplode_outer("_f.runs").alias("_at", "_run"))
    order = Window.partitionBy("blob", "kind").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("_run.a") + F.col("_run.b")).over(order)
    spans = runs.withColumn("stop", stop.cast("int")).withColumn("start", (F.col("stop") - F.col("_run.b")).cast("int"))
    span = F.when(F.col("_run.c") >= F.col("least"), F.struct("start", "stop", "kind"))
    rows = spans.groupBy("blob", "scanned").agg(F.collect_list(span).alias("spans"))
    rows.write.mode("append").parquet(ledger_path)


def findings(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind position, stop, kind) in code points, sorted, end exclusive.

    NULL texts are empty texts and have no spans; repeated rows get the same spans; an empty table gives an empty result. A column
    of ``docs`` named ``spans`` or ``blob`` is replaced.
    """
    scan_unseen(docs, ledger_path, rules, text_col)
    place = F.create_map(*[F.lit(v) for k, r in enumerate(rules) for v in (r.kind, k)])
    version = F.create_map(*[F.lit(v) for r in rules for v in (r.kind, r.version)])
    current = read_ledger(docs.sparkSession, ledger_path).withColumn(
        "_kinds", F.transform(F.filter("scanned", lambda s: s["version"] == F.element_at(version, s["kind"])), lambda s: s["kind"]))
    valid = F.filter("spans", lambda s: F.array_contains("_kinds", s["kind"]))
    ordered = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["kind"]).alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    per_blob = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(ordered))).alias("spans"))
    return docs.drop("spans", "blob").withColumn("blob", blob_of(F.col(text_col))).join(per_blob, "blob", "left")


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
