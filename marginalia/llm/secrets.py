"""Secret scans over an incremental blob ledger, in native expressions.

Every version of a document is addressed by the SHA-256 of its text.  The
ledger holds, for each blob scanned, the rule versions that have seen it and
their findings.  A run scans each distinct blob once, and only with the rule
versions the ledger lacks for it; then it joins the findings of the current
rules back to all rows (paths) that hold the blob.

Base rules (assign, access, hex) are fixed patterns; the others add spans.

Defined cases: a null text is the empty blob; repeated rows keep their rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cols, materialize, own_name, path_exists
from .spans import find_spans, let, nothing

FINDING = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    #: what a matching text surely contains, as a Column of the text
    guard: Callable[[Column], Column] | None = None
    keep: Callable[[Column], Column] | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Quantifiers are possessive where nothing behind them could take back a
# character, so that long runs cost neither stack nor retries.
_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?+\x20*+[:=]\x20*+["']?+"""
_VALUE = r"[A-Za-z0-9+/_.=-]"

# A private key goes up to its END line; without one, over its headers and
# base64 lines (a last line may be short).  Line ends may be written as \\n.
_GAP = r"(?:\s|\\[rn])"
_KEY_LINES = rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{40,}}+={{0,2}}+)++(?:{_GAP}++[A-Za-z0-9+/]++(?:={{1,2}}+|(?=\x20*+(?:[\r\n\\]|\z))))?+"
_PEM = rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----|{_KEY_LINES})?+"

BASE_RULES = (
    Rule(
        "assign", 1, r"(?=[PpSsTtAa])" + _ASSIGN + _VALUE + "++",
        # no (?i): a plain class scan is enough to skip most texts
        guard=lambda t: t.rlike(r"(?:[Ww][Oo][Rr][Dd]|[Ww][Dd]|[Rr][Ee][Tt]|[Kk][Ee][NnYy])[\"']?\x20*[:=]"),
        keep=lambda v: F.length(F.regexp_replace(v, "^" + _ASSIGN, "")) >= 6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+", guard=lambda t: t.contains("AKIA")),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+", guard=lambda t: t.rlike(r"[0-9a-f]{24}")),
)

MORE_RULES = (
    Rule("pem", 2, _PEM, guard=lambda t: t.contains("PRIVATE KEY-----")),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", guard=lambda t: t.contains("eyJ")),
    Rule("forge", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}+", guard=lambda t: t.rlike("gh[pousr]_")),
    Rule("chat", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", guard=lambda t: t.contains("xox")),
    Rule("userinfo", 1, r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s:/@]{1,256}:[^\s:/@]{1,256}@", guard=lambda t: t.contains("://")),
)
RULES = BASE_RULES + MORE_RULES
ORDER = {r.name: i for i, r in enumerate(RULES)}


def _findings(text: Column, todo: Column, rules: tuple[Rule, ...]) -> Column:
    """Findings of the rules whose key is in todo."""
    each = []
    for r in rules:
        wanted = F.array_contains(todo, r.key)
        spans = find_spans(text, r.pattern, r.name, r.keep, if_text=wanted & r.guard(text) if r.guard else wanted)
        each.append(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return F.concat(*each).cast(FINDING)


def scan_versions(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger after scanning docs: digest, findings of the current rules.

    Texts are shuffled once, one of each digest (the map side drops its own
    repeats).  With ledger_path the new rows are appended there.
    """
    spark, keys = docs.sparkSession, F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(text.alias("blob")).withColumn("digest", F.sha2("blob", 256)).groupBy("digest").agg(F.first("blob").alias("blob"))
    row = f"digest string, rules array<string>, findings {FINDING}"
    known = ledger_path and path_exists(spark, ledger_path)
    if known:
        seen = spark.read.schema(row).parquet(ledger_path).groupBy("digest").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        blobs = blobs.join(seen, "digest", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).filter("size(todo) > 0")
    else:
        blobs = blobs.withColumn("todo", keys)
    fresh = blobs.select("digest", F.col("todo").alias("rules"), _findings(F.col("blob"), F.col("todo"), rules).alias("findings"))
    if not ledger_path:
        return materialize(fresh, "secret-ledger").select("digest", "findings")
    fresh.write.mode("append").parquet(ledger_path)
    if not known:
        return spark.read.schema(row).parquet(ledger_path).select("digest", "findings")
    # Several runs may have scanned a blob, each with other rules; retired rules and versions drop out.
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.key)])
    live = spark.read.schema(row).parquet(ledger_path).filter(F.arrays_overlap("rules", keys))
    live = live.withColumn("findings", F.filter("findings", lambda f: F.coalesce(F.array_contains("rules", current[f["kind"]]), F.lit(False))))
    joined = live.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
    return materialize(joined, "secret-findings")


def sort_spans(spans: Column) -> Column:
    """By start, then in the order of the rules."""
    order = F.create_map(*[F.lit(x) for k, v in ORDER.items() for x in (k, v)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.coalesce(order[s["kind"]], F.lit(99)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carried columns and findings of every row."""
    ledger = scan_versions(docs, ledger_path, rules, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*[col(c).alias(f"__{i}") for i, c in enumerate(carry)], F.sha2(text, 256).alias("digest"))
    out = rows.join(ledger.withColumn("findings", sort_spans(F.col("findings"))), "digest")
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(carry)], "findings")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """text with the union of the findings' spans replaced by mark."""
    # state: the text so far and the place reached
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, f: Column) -> Column:
        fresh = F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, f["start"] - s["at"]), F.lit(mark)).alias("out"), f["end"].alias("at"))
        grown = F.struct(s["out"].alias("out"), F.greatest(s["at"], f["end"]).alias("at"))
        return F.when((f["start"] >= s["at"]) & ((f["start"] > 0) | (s["at"] == 0)), fresh).otherwise(grown)

    done = F.aggregate(findings, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(F.length(text) - s["at"], F.lit(0)))))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def redact_texts(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets replaced in the text, and the new length in length_col where a text changed.

    Without a ledger each row is scanned where it stands, behind the rules'
    guards: no text is shuffled.  With one only unseen blobs are scanned, and
    findings joined back to the rows by digest.  Rows and other columns stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    done = own_name(docs, "__done")
    changed = lambda f: F.struct(F.size(f).alias("n"), redact(F.col(text_col), f, mark).alias("text"))
    if ledger_path is None:
        made = docs.withColumn(done, let(sort_spans(_findings(text, F.array(*[F.lit(r.key) for r in rules]), rules)), changed))
    else:
        digest, its, found = (own_name(docs, n) for n in ("__digest", "__its", "__found"))
        ledger = scan_versions(docs, ledger_path, rules, text_col).filter("size(findings) > 0").select(F.col("digest").alias(its), sort_spans(F.col("findings")).alias(found))
        joined = docs.withColumn(digest, F.sha2(text, 256)).join(ledger, F.col(digest) == F.col(its), "left")
        made = joined.withColumn(done, let(F.coalesce(found, nothing(FINDING)), changed))
    out = {text_col: F.when(F.col(done)["n"] > 0, F.col(done)["text"]).otherwise(F.col(text_col))}
    if length_col:
        out[length_col] = F.when(F.col(done)["n"] > 0, F.length(F.col(done)["text"]).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return made.withColumns(out).select(*cols(docs))


__all__ = ["RULES", "BASE_RULES", "Rule", "find_secrets", "redact", "redact_texts", "scan_versions", "sort_spans", "nothing"]
