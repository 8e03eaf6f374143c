"""The audit log: record projection, flags, alerts, snippets, tails and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.text import category_codes
from sluiceway.policy import Policy

# Fixed values.
DETAIL_CHARS = 120
LONG_DETAIL_CHARS = 240
LONG_DETAIL_REASONS = ("guard_verdict_unparseable", "guard_no_adapter")
ALERT_TOKENS = (
    "S1 ", "S2 ", "S3 ", "S4 ", "S9 ", "S10 ", "S11 ", "regex:csam", "regex:despaced", "regex:extra", "regex:malware",
    "guard_verdict_unparseable", "guard_no_adapter", "guard_unavailable",
)
NEVER_ALERT = "sentinel"
NEVER_SNIPPET = ("S4", "csam", "despaced")
SNIPPET_CHARS = 160
SNIPPET_DETAIL_CHARS = 60
PAGE_SIZES = (10, 25, 50, 100)
EMPTY_FINGERPRINT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _listed(reason: Column, detail: Column, categories: list[str], lists: list[str]) -> Column:
    named = F.arrays_overlap(category_codes(detail), F.array(*[F.lit(c) for c in categories]).cast("array<string>"))
    return named | F.coalesce(reason.isin([f"regex:{name}" for name in lists]), F.lit(False))


def is_immutable(reason: Column, detail: Column, policy: Policy) -> Column:
    keep = policy.retention
    return _listed(reason, detail, keep["immutable_categories"], keep["immutable_tripwires"])


def wants_evidence(reason: Column, detail: Column, policy: Policy) -> Column:
    evidence = policy.retention["evidence"]
    if not evidence["enabled"]:
        return F.lit(False)
    return _listed(reason, detail, evidence["categories"], evidence["tripwires"])


def client_fields(proxy_headers: Column, metadata_headers: Column) -> Column:
    """Client identity from two header maps; the second one wins, names are case-blind."""
    def lowered(headers: Column) -> Column:
        pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
        return F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    entries = F.concat(lowered(proxy_headers), lowered(metadata_headers))

    def header(name: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]

    def filled(value: Column) -> Column:
        return F.when(value != "", value)

    first_hop = F.trim(F.try_element_at(F.split(header("x-forwarded-for"), ","), F.lit(1)))
    print_ = F.lower(F.trim(header("x-device-fingerprint")))
    return F.struct(
        F.coalesce(filled(first_hop), filled(header("x-real-ip"))).alias("client_ip"),
        header("user-agent").alias("user_agent"),
        F.when(print_.rlike(r"\A[0-9a-f]{64}\z") & (print_ != EMPTY_FINGERPRINT), print_).alias("device_fingerprint"),
        filled(header("x-device-subject")).alias("device_subject"),
    )


def records(vetoes: DataFrame, policy: Policy) -> DataFrame:
    """Audit records of vetoes, with the whole detail on one line. ``evidence_id`` names the evidence body of those that have one."""
    shown = F.replace(F.coalesce("detail", F.lit("")), F.lit("\n"), F.lit("\\n"))
    reason, detail = F.col("reason"), F.col("detail")
    return vetoes.select(
        "ts", "stage", "reason", shown.alias("detail"), "call_id", "model", "key_alias",
        "device_fingerprint", is_immutable(reason, detail, policy).alias("immutable"),
        F.when(wants_evidence(reason, detail, policy), F.col("call_id")).alias("evidence_id"),
    )


def _mentions(column: Column, tokens: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(column, F.lit(token))
    return found


def is_alert(reason: Column, detail: Column) -> Column:
    """Detail or reason holds an alert token (``S1`` needs its trailing blank, so ``S10`` does not
    count as ``S1``); the self-test list never alerts."""
    reason, detail = F.coalesce(reason, F.lit("")), F.coalesce(detail, F.lit(""))
    quiet = F.contains(reason, F.lit(NEVER_ALERT)) | F.contains(detail, F.lit(NEVER_ALERT))
    return (_mentions(detail, ALERT_TOKENS) | _mentions(reason, ALERT_TOKENS)) & ~quiet


def alerts(log: DataFrame) -> DataFrame:
    """One text per alert-worthy record. Whether it is one is told from the whole detail; a message shows its start."""
    size = F.when(F.col("reason").isin(*LONG_DETAIL_REASONS), LONG_DETAIL_CHARS).otherwise(DETAIL_CHARS)
    text = F.concat_ws(
        " ", F.lit("[veto]"), "stage", "reason", F.substring("detail", F.lit(1), size),
        F.concat(F.lit("key="), F.coalesce("key_alias", F.lit("None"))),
        F.concat(F.lit("model="), F.coalesce("model", F.lit("None"))),
        F.concat(F.lit("at "), F.substring("ts", 1, 19)),
    )
    return log.where(is_alert(F.col("reason"), F.col("detail"))).select("call_id", text.alias("alert"))


def snippets(flagged: DataFrame, policy: Policy) -> DataFrame:
    """Diagnostic pieces of flagged output: only when switched on, never of the protected kinds."""
    if not policy.document["audit"]["store_snippet"]:
        return flagged.where(F.lit(False)).select("ts", "stage", "reason", "detail", "call_id", "key_alias", F.lit("").alias("snippet"))
    barred = _mentions(F.coalesce("detail", F.lit("")), NEVER_SNIPPET) | _mentions(F.col("reason"), NEVER_SNIPPET)
    piece = F.substring(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 1, SNIPPET_CHARS)
    return flagged.where(~barred).select(
        "ts", "stage", "reason", F.substring("detail", 1, SNIPPET_DETAIL_CHARS).alias("detail"), "call_id", "key_alias", piece.alias("snippet")
    )


def tail(log: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """The newest ``n`` rows, newest first. The cut comes before bad lines are skipped."""
    newest = log.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return newest.where("_corrupt_record IS NULL").drop("_corrupt_record") if "_corrupt_record" in log.columns else newest


def page(log: DataFrame, order: list[Column], per: int = 25, number: int = 1) -> DataFrame:
    """One page of a sorted table; unknown sizes fall back to 25, the number is clamped."""
    per = per if per in PAGE_SIZES else 25
    total = log.count()
    pages = max(1, -(-total // per))
    number = min(max(1, number), pages)
    rows = log.orderBy(*order).offset((number - 1) * per).limit(per)
    return rows.withColumns({"page": F.lit(number), "pages": F.lit(pages), "total": F.lit(total)})


def union_logs(text_log: DataFrame, image_log: DataFrame) -> DataFrame:
    """Text and image vetoes in one log; the fields only images carry stay NULL for texts."""
    return text_log.unionByName(image_log, allowMissingColumns=True)
