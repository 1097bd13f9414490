"""Secret scans with an incremental blob ledger (operator 2).

Every version of a file or document is addressed by its content (SHA-256). The ledger holds the pairs (blob, rule version)
that were scanned; a run scans only pairs that the ledger lacks, each blob once however many paths and versions
show it, and joins findings back to all paths. Raising a rule's version rescans all blobs for that rule alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, prepare, save, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern; `group` of a match must have `least` characters or more, other matches are dropped (and use up their text)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self) -> Callable[[str], list[tuple[int, int]]]:
        find, group, least = re.compile(self.pattern, self.flags).finditer, self.group, self.least
        return lambda text: [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]


#: The three base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # runs of 24 and more: a shorter run is no match of its own and touches no other
)
#: What this operator looks for besides: key blocks, signed web tokens, and prefixed service tokens.
MORE = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    # Only where a run of such characters begins, and without giving any back: each run is read a bounded number of times.
    Rule("web_token", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("service_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"),
)
RULES = BASE + MORE
FINDING = "array<struct<kind: string, start: int, end: int, version: int>>"


def address(text: Column) -> Column:
    """Content address of a blob."""
    return F.sha2(text, 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    """A ledger row: blob, the scanned rule versions (`kind@version`) and their findings."""
    return spark.createDataFrame([], f"blob string, rules array<string>, findings {FINDING}")


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """blob, text, rules: each distinct content with the rule versions that the ledger lacks; none if it lacks none.

    Copies collapse before the shuffle (one per task), so a group of any size is a few rows.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    content = versions.select(text_or_empty(text).alias("text")).withColumn("blob", address(F.col("text")))
    if ledger is None:
        return content.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", keys)
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    lacking = save(
        content.select("blob").distinct().join(known, "blob", "left")
        .select("blob", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))).alias("rules")).filter(F.size("rules") > 0),
        "secrets-unseen",
    )
    return content.join(lacking, "blob").groupBy("blob", "rules").agg(F.first("text").alias("text"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """New ledger rows (blob, rules, findings) of the blobs that `unseen` names. Offsets are code points, end exclusive."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {r.key: (r, r.spans()) for r in rules}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("version", pa.int32())]))
        for batch in batches(rows):
            found = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                own = []
                for key in wanted:
                    rule, search = searches[key]
                    own += [{"kind": rule.kind, "start": a, "end": b, "version": rule.version} for a, b in search(text)]
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, kind)], names=["blob", "rules", "findings"])

    return blobs.select("blob", "text", "rules").mapInArrow(run, f"blob string, rules array<string>, findings {FINDING}")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows to append to the ledger, `versions` with `findings` in place of the text).

    The second has every row of `versions`, repeated rows and NULL texts (empty blob) too, with the findings of the current version
    of each rule from old and new ledger rows. Columns of `versions` named blob or findings are replaced.
    """
    versions = versions.drop("blob", "findings")
    fresh = save(scan(unseen(versions, ledger, rules, text), rules), "secrets-ledger")
    all_rows = fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns))
    current = F.array(*[F.lit(r.key) for r in rules])
    spans = all_rows.select("blob", F.explode("findings").alias("f")).filter(F.array_contains(current, F.concat_ws("@", "f.kind", "f.version")))
    per_blob = spans.groupBy("blob").agg(F.collect_set("f").alias("findings"))
    paths = versions.withColumn("__blob", address(text_or_empty(text))).drop(text)
    joined = paths.join(save(per_blob, "secrets-findings"), F.col("__blob") == F.col("blob"), "left").drop("blob")
    return fresh, joined.withColumnRenamed("__blob", "blob")


def listed(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """`kind:start:end` by start, then kind in the order of the rules, joined by commas."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    wanted = F.filter(F.coalesce(findings, F.array().cast(FINDING)), lambda f: F.array_contains(order, f["kind"]))
    keyed = F.array_sort(F.transform(wanted, lambda f: F.struct(f["start"].alias("s"), F.array_position(order, f["kind"]).alias("k"), f["end"].alias("e"), f["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda f: F.concat_ws(":", f["kind"], f["s"], f["e"])), ",")


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty ledger: every blob is scanned once."""
    _, found = scan_versions(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(F.coalesce("findings", F.array().cast(FINDING)), lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(F.col("findings"), BASE), 256).alias("base_sha256"), listed(F.col("findings"), RULES).alias("spans"),
    )
