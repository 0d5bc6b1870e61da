"""Secret scans over an incremental ledger of content-addressed blobs, with DataFrame functions only.

Each version of a document is a blob named by the SHA-256 of its text. A ledger row says that a blob was scanned under a
rule version and what was found. A run scans only the (blob, rule version) pairs that the ledger lacks, each once however
many paths hold the blob, and joins the findings back to all paths.

A ledger is a table in a shared folder that runs append to. An append is one write of whole files, so a run that ends early
leaves at most rows that the next one finds scanned.

Positions come from marking: a match is wrapped in two control characters, the text is split at the first of them, and the
lengths of the parts add up to offsets in code points. Marks that a text holds itself are first replaced by another control
character, one for one, which no rule matches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stash, let, packed

_OPEN, _MID, _SHUT, _BLANK = "\x01", "\x02", "\x03", "\x04"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and without overlap; one counts if group ``group`` has ``least`` characters.

    ``pattern`` is split in a head and the group of interest at the end, so that marks can stand around the group.
    """

    kind: str
    head: str
    body: str
    least: int
    #: Lower-case literals of which a text with a match has one; without them the pattern is not tried. None: always tried.
    literals: tuple[str, ...] = ()


# The kinds of the scan's contract, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)""", r"[A-Za-z0-9+/_.=-]+", 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"", r"AKIA[A-Z0-9]+", 16, ("akia",)),
    Rule("hex", r"", r"[0-9a-f]{32,}", 32),
)
#: Kinds beyond the contract's: private key blocks and bearer tokens with a known prefix.
MORE_RULES = (
    Rule("pem", r"", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, ("private key-----",)),
    Rule("prefixed", r"", r"(?:ghp|gho|xoxb|xoxp|sk_live)[_-][A-Za-z0-9_-]{16,}", 20, ("ghp", "gho", "xoxb", "xoxp", "sk_live")),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "3"
#: Matches that one fold goes over; spans of a text are folds of folds, so their cost does not grow with the square of the matches.
FOLD = 256
#: ``start`` and ``end`` are in code points, ``at`` and ``upto`` the same places in bytes of UTF-8.
_SPAN = "struct<start:bigint,ord:int,kind:string,end:bigint,at:bigint,upto:bigint>"
_PLACE = "struct<chars:bigint,bytes:bigint>"


def _place(chars: Column, octets: Column) -> Column:
    return F.struct(chars.alias("chars"), octets.alias("bytes")).cast(_PLACE)


def _size(part: Column) -> Column:
    """Characters and bytes of a part, less the two marks in it, which are a byte each."""
    return _place(F.length(part) - 2, F.octet_length(part) - 2)


def _sum(a: Column, b: Column) -> Column:
    return _place(a["chars"] + b["chars"], a["bytes"] + b["bytes"])


def find(text: Column, rule: Rule, order: int) -> Column:
    """The array of spans (start, ord, kind, end, at, upto) of one rule in a text without the marks."""
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, part: Column) -> Column:
        """``part`` is head, mid mark, body, shut mark, what follows."""
        head, rest = F.instr(part, _MID) - 1, F.instr(part, _SHUT) - 2
        at = acc["at"]
        upto = at["bytes"] + F.octet_length(F.substring_index(part, _SHUT, 1)) - 1
        hit = F.struct(at["chars"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (at["chars"] + rest).alias("end"), at["bytes"].alias("at"), upto.alias("upto")).cast(_SPAN)
        ok = (rest - head) >= rule.least
        return F.struct(_sum(at, _size(part)).alias("at"), F.when(ok, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    def fold(parts: Column, at: Column) -> Column:
        return F.aggregate(parts, F.struct(at.alias("at"), none.alias("found")), step)["found"]

    def walked(parts: Column) -> Column:
        """``parts``: what stands before the first match, then a part a match. Runs of FOLD parts start where those before them end."""
        sizes = F.transform(F.slice(parts, 2, F.size(parts) - 1), _size)
        runs = F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / FOLD).cast("int"))
        lengths = lambda sizes: F.transform(runs, lambda i: F.aggregate(F.slice(sizes, i * FOLD + 1, F.lit(FOLD)), _place(F.lit(0), F.lit(0)), _sum))
        first = _place(F.length(parts[0]), F.octet_length(parts[0]))
        starts = lambda sums: F.aggregate(sums, F.array(first), lambda a, x: F.concat(a, F.array(_sum(F.element_at(a, -1), x))))
        begun = let(let(sizes, lengths), starts)
        return let(begun, lambda at: F.flatten(F.transform(runs, lambda i: fold(F.slice(parts, i * FOLD + 2, F.lit(FOLD)), at[i]))))

    marked = F.regexp_replace(text, f"({rule.head})({rule.body})", f"{_OPEN}$1{_MID}$2{_SHUT}")
    return let(F.split(marked, _OPEN), lambda parts: F.when(F.size(parts) > 1, walked(parts)).otherwise(none))


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then rule order. Null counts as empty. Base rules are found alone, then the others added."""
    none = F.array().cast(f"array<{_SPAN}>")

    def tried(clean: Column, low: Column, rule: Rule, order: int) -> Column:
        may = functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in rule.literals)) if rule.literals else None
        return find(clean, rule, order) if may is None else F.when(may, find(clean, rule, order)).otherwise(none)

    clean = F.translate(F.coalesce(text, F.lit("")), _OPEN + _MID + _SHUT, _BLANK * 3)
    both = lambda c: let(F.lower(c), lambda low: F.array_sort(F.concat(*[tried(c, low, r, i) for i, r in enumerate(rules)])))
    return let(clean, both)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans): one for each blob of ``docs`` (text) not yet in ``ledger`` under ``version``.

    Append them to the ledger. An empty table gives none; null texts are the empty blob. Texts of scanned blobs are not moved.
    """
    blobs = docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version).select("blob").distinct()
        unseen = blobs.select("blob").distinct().join(seen, "blob", "left_anti")
        blobs = blobs.join(unseen, "blob", "left_semi")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return once.select("blob", F.lit(version).alias("rule_version"), spans(F.col("text"), rules).alias("spans"))


@dataclass(frozen=True)
class Ledger:
    """What has been scanned, under ``path`` in a shared folder: rows (blob, rule_version, spans), one for each pair."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """All rows; none where nothing has been scanned yet."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        kind = f"blob string, rule_version string, spans array<{_SPAN}>"
        return self.spark.read.schema(kind).parquet(self.path) if there else self.spark.createDataFrame([], kind)

    def extend(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> None:
        """Scan the blobs of ``docs`` that the ledger lacks under ``version``, and append them."""
        known = self.rows()
        scan(docs, None if known.isEmpty() else known, rules, version).write.mode("append").parquet(self.path)


def fresh_ledger(spark: SparkSession) -> Ledger:
    """A ledger of this run alone, in the folder that the session names for such tables."""
    return Ledger(spark, f"{Stash(spark, 'secrets').base}/ledger")


def findings(docs: DataFrame, ledger: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, blob, spans): each path with what its blob holds; no finding is an empty array."""
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    held = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    joined = paths.join(held, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def scan_all(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Scan what the ledger lacks (all, in a ledger of its own, if none is given), append it, and give every path its findings.

    An empty table gives no rows. Of ``docs`` only doc_id and text are read, whatever other columns there are; repeated rows and
    repeated texts each get their findings; null texts are the empty blob.
    """
    ledger = ledger or fresh_ledger(docs.sparkSession)
    ledger.extend(docs)
    return findings(docs, ledger.rows())


def written(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of rows (doc_id, spans)."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [of_kind(r.kind) for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by one mark that names the first span's kind.

    Spans are turned into the pieces of text before each run, FOLD spans at a time, and pieces are cut from the bytes, where a
    place costs nothing to reach, and joined once: the cost grows with the text and the spans, not with their product.
    """
    gap = "array<struct<a:bigint,b:bigint,kind:string>>"

    def step(acc: Column, s: Column) -> Column:
        one = F.array(F.struct(acc["reach"].alias("a"), s["at"].alias("b"), s["kind"].alias("kind"))).cast(gap)
        return F.struct(F.greatest(acc["reach"], s["upto"]).alias("reach"), F.when(s["at"] >= acc["reach"], F.concat(acc["gaps"], one)).otherwise(acc["gaps"]).alias("gaps"))

    def block(acc: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(found, i * FOLD + 1, F.lit(FOLD)), F.struct(acc["reach"].alias("reach"), F.array().cast(gap).alias("gaps")), step)
        return let(part, lambda p: F.struct(p["reach"].alias("reach"), F.concat(acc["gaps"], p["gaps"]).alias("gaps")))

    def pieces(raw: Column, walked: Column) -> Column:
        cut = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
        each = F.transform(walked["gaps"], lambda g: F.concat(cut(g["a"], g["b"]), F.lit("[secret:"), g["kind"], F.lit("]")))
        return F.concat(F.array_join(each, ""), cut(walked["reach"], F.octet_length(raw).cast("bigint")))

    start = F.struct(F.lit(0).cast("bigint").alias("reach"), F.array().cast(gap).alias("gaps"))
    walked = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int")), start, block)
    return F.when(F.size(found) > 0, let(text.cast("binary"), lambda raw: let(walked, lambda w: pieces(raw, w)))).otherwise(text)


def redact_documents(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with secrets redacted in ``text`` and ``n_chars`` set anew where that changed; all rows and columns stay.

    A document holds its findings through its blob. Null texts stay null.
    """
    ledger = ledger or fresh_ledger(docs.sparkSession)
    ledger.extend(docs)
    known = ledger.rows()
    held = known.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).dropDuplicates(["_blob"])
    rows = packed(docs, blob_id(F.col("text")).alias("_of"))
    joined = rows.join(held, F.col("_of") == F.col("_blob"), "left")
    text = F.when(F.col("_spans").isNotNull(), redacted(F.col("row.text"), F.col("_spans"))).otherwise(F.col("row.text"))
    out = joined.select("row", "_spans", text.alias("_new"))

    def column(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == "n_chars":
            return F.when(F.col("_spans").isNotNull(), F.length("_new")).otherwise(old).cast(docs.schema[c].dataType).alias(c)
        return F.col("_new").alias(c) if c == "text" else old

    return out.select(*[column(c) for c in docs.columns])
