"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). The ledger lists the pairs
(blob, rule version) scanned so far; a scan takes one row for each blob with pairs not yet listed, runs
only those rules on it, and joins old and new findings back to all paths that hold the blob. A changed
rule gets a new version, so every blob is scanned with it once and with nothing else. Ledger keeps pairs and
findings in a folder: a later scan, in this or another session, reads no text that it knows.

Positions come from the text between the matches: start k = lengths of the first k pieces and k-1 matches.
All in code points, ends exclusive.

Null texts count as empty; null ids are ids of their own; copies share one scan and all get its findings;
a text of any length is scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import Files
from .common import Scratch, row_key, spare


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of a regular expression that don't overlap; a match counts if its group is long enough."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order that breaks ties between spans with one start. Runs of one
# class of characters take their least length in the pattern itself, which matches the same spans.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Formats of vendors' keys.
VENDOR = (Rule("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|sk_live_[A-Za-z0-9]{16,}"),)
RULES = BASE + VENDOR


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], "blob binary, rule string")


def unseen(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rk (the row that stands for it), rules (keys not yet in the ledger): blobs with something left to scan."""
    blobs = docs.select(blob_of().alias("blob"), row_key().alias("rk")).groupBy("blob").agg(F.min("rk").alias("rk"))
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "rk", todo.alias("rules")).filter(F.size("rules") > 0)


def scan(docs: DataFrame, todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rule, kind, start, stop: findings of the pairs in todo.

    The texts cross the network once, unsorted, at every size. Patterns run behind the join, on unseen pairs only."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), blob_of().alias("blob"), row_key().alias("rk")).join(todo.hint("shuffle_hash"), ["blob", "rk"])
    on = lambda r, then: F.when(F.array_contains("rules", r.key), then)
    # one expression over both sides of the join: in parts, the optimizer would run the patterns before it
    some = F.array_compact(F.array(*[F.when(F.array_contains("rules", r.key) & F.col("text").rlike(r.pattern), F.lit(r.key)) for r in rules]))
    found = texts.filter(F.size(some) > 0)
    each = [
        on(r, F.struct(F.lit(r.key).alias("rule"), F.arrays_zip(
            F.split("text", r.pattern, -1).alias("gap"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hit"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("part"),
        ).alias("m")))
        for r in rules
    ]
    rows = found.select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r")).select("blob", "r.rule", F.posexplode("r.m").alias("n", "m")).filter("m.hit is not null")
    w = W.partitionBy("blob", "rule").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    stop = F.sum(F.char_length("m.gap") + F.char_length("m.hit")).over(w)
    # rows of one blob can come from repeated rows: n tells matches apart, so duplicates go first
    rows = rows.dropDuplicates(["blob", "rule", "n"]).withColumn("stop", stop).withColumn("start", F.col("stop") - F.char_length("m.hit"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.least))])
    return rows.filter(F.char_length("m.part") >= least[F.col("rule")]).select("blob", "rule", F.substring_index("rule", "@", 1).alias("kind"), "start", "stop")


def advance(ledger: DataFrame, todo: DataFrame) -> DataFrame:
    """The ledger once todo is scanned."""
    return ledger.unionByName(todo.select("blob", F.explode("rules").alias("rule")))


class Ledger:
    """Pairs scanned so far and their findings, in a folder. A scan writes both and publishes them by one commit
    file; what a lost scan leaves behind is never read. One scan at a time; a second one fails with FileExistsError."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _scans(self) -> list[dict]:
        return [json.loads(self.files.read(f"_log/{n}")) for n in self.files.names("_log")]

    def _read(self, table: str, schema: str) -> DataFrame:
        folders = [f"{self.files.base}/{x['folder']}/{table}" for x in self._scans() if x["pairs"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        return self._read("pairs", "blob binary, rule string")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, rule, kind, start, stop of these rules' versions."""
        return self._read("findings", "blob binary, rule string, kind string, start long, stop long").filter(F.col("rule").isin([r.key for r in rules]))

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scans what the ledger doesn't know of docs, and returns how many pairs that was."""
        scratch, n, folder = Scratch(self.spark), len(self.files.names("_log")), f"scan-{uuid.uuid4().hex}"
        todo = scratch.table(unseen(docs, self.pairs(), rules))
        new = advance(empty_ledger(self.spark), todo)
        new.write.parquet(f"{self.files.base}/{folder}/pairs")
        found = new.count()
        if found:
            scan(docs, todo, rules).write.parquet(f"{self.files.base}/{folder}/findings")
        self.files.create(f"_log/{n:020d}.json", json.dumps({"folder": folder, "pairs": found, "rules": [r.key for r in rules]}).encode())
        scratch.close()
        return found


def summarise(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with findings: counts of the base kinds, digests of spans, the spans in order, and
    `keep`, the pieces (start, length) of the text between them, of which the last goes to the text's end."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    rows = findings.withColumn("o", order[F.col("kind")])
    before = F.max("stop").over(W.partitionBy("blob").orderBy("start", "o", "stop").rowsBetween(W.unboundedPreceding, -1))
    span = F.struct("start", "o", "stop", "kind", "before")
    got = rows.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("s"), F.max("stop").alias("end"))
    base = F.filter("s", lambda x: x["o"] < len(BASE))
    say = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    keep = F.transform(F.filter("s", lambda x: x["start"] >= x["before"]), lambda x: F.struct(x["before"].alias("at"), (x["start"] - x["before"]).alias("n")))
    return got.select("blob", *[n(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(say(base), 256).alias("base_sha256"), say(F.col("s")).alias("spans"), keep.alias("keep"), "end")


def find(scratch: Scratch, docs: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries by blob of old and new findings, all findings, the new ledger), from a ledger that the caller holds."""
    ledger = empty_ledger(docs.sparkSession) if ledger is None else ledger
    todo = scratch.table(unseen(docs, ledger, rules))
    fresh = scan(docs, todo, rules)
    findings = scratch.table(fresh if known is None else fresh.unionByName(known))
    return scratch.table(summarise(findings, rules)), findings, advance(ledger, todo)


def _found(docs: DataFrame, ledger: Ledger | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Summaries by blob, once the ledger (by default an empty one in the shared folder) has seen all of docs."""
    scratch = Scratch(docs.sparkSession)
    ledger = ledger or Ledger(docs.sparkSession, f"{scratch.base}/ledger")
    ledger.scan(docs, rules)
    return scratch.table(summarise(ledger.findings(rules), rules))


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    found = _found(docs, ledger, rules).drop("keep", "end")
    rows = docs.select("doc_id", blob_of().alias("blob")).join(found.hint("merge"), ["blob"], "left")
    count = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE]
    return rows.select("doc_id", *count, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every found span replaced by `mark`, and n_chars, if there is one, to fit. Overlapping spans become one mark."""
    blob, keep, end = spare(docs.columns, "blob", "keep", "end")
    found = _found(docs, ledger, rules).select(F.col("blob").alias(blob), F.col("keep").alias(keep), F.col("end").alias(end))
    rows = docs.withColumn(blob, blob_of()).join(found.hint("merge"), [blob], "left")
    pieces = F.transform(keep, lambda x: F.substring("text", x["at"].cast("int") + 1, x["n"].cast("int")))
    clean = F.concat(F.array_join(pieces, mark), F.lit(mark), F.substring(F.col("text"), F.col(end).cast("int") + 1, F.char_length("text")))
    out = rows.withColumn("text", F.when(F.col(end).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(end).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
