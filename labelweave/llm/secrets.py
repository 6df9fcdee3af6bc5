"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. Only pairs of blob and rule version that the ledger
does not hold yet are scanned, each distinct text once; the findings go to the ledger and are joined back to all paths
that ever held the blob. Equal texts are brought together by a hash aggregate that first drops copies within each task;
the join back is a left join of two plain exchanges, which AQE splits where one blob has very many paths.

Null text: the empty one, without findings. Very long texts are scanned in whole. Repeated rows: each gets the findings of
its blob, once, also where two scans at a time put it into the ledger twice. Other columns of the versions may have any
name but those that findings() adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_at, shared_dir

FINDINGS = "array<struct<rule:string,start:int,end:int>>"


class Rule(NamedTuple):
    """group: the part of a match that must have at least `least` characters; hints: a match needs one of them in the lower-cased text."""

    name: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: A private key from its BEGIN line to its END line, or, without one before the next BEGIN line, over the header fields and the base64 that follow: lines
#: of nothing else, and words of 40 letters or more. Line ends may be escaped; lines may be indented, quoted or marked as comments.
_GAP = r"""(?:\\++[nrt]?|[\s"'>#*|,;+]|//\x20)*+"""
_LINE_END = r"""(?=["',;+\x20\t]*+(?:\n|\r|\\|\Z))"""
_FIELD = r"(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Comment|Version):[^\n\\]*+"
_BASE64 = rf"(?:[A-Za-z0-9+/=]{{40,}}+|[A-Za-z0-9+/=]++{_LINE_END})"
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN |END [A-Z ]{0,40}PRIVATE KEY-----))[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:{_FIELD}|{_BASE64}))*+)"
)
#: In the order in which spans that start together are listed.
RULES = (
    Rule("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", _PEM, 0, 1, ("private key",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("gh",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
)
BASE = ("assign", "access", "hex")


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, sorted by start, then by the order of the rules."""
    found, low = [], text.lower()
    for k, r in enumerate(rules):
        if not r.hints or any(h in low for h in r.hints):
            found += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return [(rules[k].name, a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    one = pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            found = [[{"rule": r, "start": s, "end": e} for r, s, e in scan_text(t, rules)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(one))], ["blob", "findings"])


class Ledger:
    """Scanned pairs of blob and rule version, kept as Parquet below path, one folder for each rule version."""

    def __init__(self, spark, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        import uuid

        self.spark, self.rules, self.version = spark, rules, rule_version(rules)
        self.path = f"{path or f'{shared_dir(spark)}/ledger-{uuid.uuid4().hex}'}/rules={self.version}"

    def seen(self) -> DataFrame | None:
        """blob, findings of this rule version, or None before the first scan."""
        fs, at = file_at(self.spark, self.path)
        if not fs.exists(at):
            return None
        return self.spark.read.schema(f"blob binary, findings {FINDINGS}").parquet(self.path)

    def scan(self, versions: DataFrame) -> None:
        """Scan the texts of versions (column text) whose blob the ledger lacks, and append what they hold."""
        new = versions.select(_address().alias("blob"), _text().alias("text"))
        if (seen := self.seen()) is None:
            new = new.distinct()
        else:  # grouped by blob alone, so that the anti-join shuffles no text
            new = new.groupBy("blob").agg(F.first("text").alias("text")).hint("merge").join(seen.select("blob"), "blob", "left_anti")
        rules = self.rules
        (
            new.mapInArrow(lambda batches: _scan(batches, rules), f"blob binary, findings {FINDINGS}")
            .write.mode("append").option("compression", "zstd").parquet(self.path)
        )

    def findings(self, versions: DataFrame, *keep: str) -> DataFrame:
        """keep, blob, findings (empty where nothing was found) for every row of versions, all of which have been scanned."""
        if {"blob", "findings"} & {k.lower() for k in keep}:
            raise ValueError("blob and findings are columns of the result; put those of the same name into a struct")
        found = self.seen().where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
        rows = versions.select(*keep, _address().alias("blob"))
        return rows.join(found, "blob", "left").select(*keep, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _address():
    return F.unhex(F.sha2(_text(), 256))


def joined(findings, rules: tuple[str, ...] | None = None):
    """rule:start:end of findings, joined by commas; only of the named rules, if given."""
    kept = F.filter(findings, lambda x: x["rule"].isin(*rules)) if rules else findings
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text, findings, mark: str = "[secret]"):
    """text with each span of findings, and what overlaps it, as one mark. Findings are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc, x):
        fresh = x["start"] >= acc["at"]
        part = F.concat(F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"))

    return F.aggregate(findings, start, add, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
