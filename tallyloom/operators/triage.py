"""Severity, waivers, root causes, order and ids of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.stored import placed

# Classes of findings by their severity; others are warnings.
CRITICAL = """value_changed formula_error formula_hardcoded formula_removed formula_missing circular_reference external_link
active_content vba_module_changed power_query_changed connection_changed external_connection named_range_invalid
chart_reference_invalid pivot_source_invalid ppt_draft_token ppt_required_slide_missing required_value_missing duplicate_key
numeric_bound_violation tie_out_mismatch row_deleted column_deleted sheet_removed workbook_removed row_key_changed
column_key_changed crosscheck_mismatch package_period_mismatch""".split()
INFO = """cell_comment_changed style_changed chart_geometry_changed ppt_shape_geometry_changed sheet_added sheet_renamed
column_moved workbook_added slide_added slide_reordered crosscheck_unresolved hidden_content""".split()
# Findings of formulas at one place share a root cause.
FORMULA_CLASSES = "formula_error formula_hardcoded formula_removed formula_missing formula_not_extended formula_logic_changed formula_inconsistent".split()
# Materiality tiers with a severity of their own, contexts that are recent, order of severities.
TIERS = {"noise": "info", "within_tolerance": "info"}
RECENT = ("current_period", "recent_window")
RANKS = {"critical": 0, "warning": 1, "info": 2, "expected": 3}
# Classes that a condition already there before demotes, and subtypes with a severity of their own.
DEMOTED = ("formula_inconsistent",)
SUBTYPES = {
    ("row_key_changed", "key_derived_label"): "warning", ("column_key_changed", "key_derived_label"): "warning",
    ("row_deleted", "rolling_turnover"): "warning", ("column_deleted", "rolling_turnover"): "warning",
}


def error_severity(f: str = "") -> Column:
    """Of a formula_error: critical if structural, new or changed; info if an explicit #N/A in a formula's text was there before;
    warning if a formula's error is one of a systematic population; else critical. Null for other classes, which have no tags."""
    tags = F.coalesce(F.col(f"{f}evidence_tags"), F.array().cast("array<string>"))
    has = lambda t: F.array_contains(tags, t)
    inherited = F.coalesce(F.col(f"{f}provenance") == "inherited", F.lit(False))
    regressed = F.coalesce(F.col(f"{f}provenance").isin("new", "changed"), F.lit(False))
    systematic = has("concentrated_population") | has("contiguous_population")
    own = F.when(has("structural_error") | regressed, "critical").when(inherited & has("explicit_na") & has("formula_text"), "info").when(has("formula_presence") & systematic, "warning").otherwise("critical")
    return F.when(F.col(f"{f}finding_class") == "formula_error", own)


def severity(f: str = "", *, tiers: dict[str, str] | None = None, overrides: dict[str, str] | None = None, subtype: str | None = None, evidence: bool = False) -> Column:
    """The first that applies: expected, a formula error's rule, a tier's own, material but recent, demoted as inherited, the
    profile's override of the class, the subtype's, the class's default.

    tiers and overrides: a profile's severities by tier and by class. subtype: the column that has one; evidence: whether
    findings have evidence_tags.
    """
    c = lambda n: F.col(f"{f}{n}")
    default = F.when(c("finding_class").isin(CRITICAL), "critical").when(c("finding_class").isin(INFO), "info").otherwise("warning")
    for (name, kind), s in SUBTYPES.items() if subtype else ():
        default = F.when((c("finding_class") == name) & (c(subtype) == kind), s).otherwise(default)
    for name, s in (overrides or {}).items():
        default = F.when(c("finding_class") == name, s).otherwise(default)
    out = F.when(c("expected_reason").isNotNull(), "expected")
    if evidence:
        out = out.when(c("finding_class") == "formula_error", error_severity(f))
    for tier, s in (TIERS | (tiers or {})).items():
        out = out.when(c("materiality") == tier, s)
    return out.when((c("materiality") == "material") & c("temporal_context").isin(*RECENT), "warning").when((c("provenance") == "inherited") & c("finding_class").isin(*DEMOTED), "info").otherwise(default)


def expired(spark: SparkSession, waivers: list[dict], today: str) -> DataFrame:
    """A finding for each waiver whose date has passed."""
    rows = [("profile", w.get("sheet"), w.get("location"), w.get("element") or w["finding_class"], "waiver_expired", w["expires"], f"waiver for {w['finding_class']} expired on {w['expires']}: {w['reason']}") for w in waivers if w["expires"] < today]
    return spark.createDataFrame(rows, "artifact string, sheet string, location string, element string, finding_class string, current_value string, message string")


def in_scope(findings: DataFrame, member: str, sheet: str, members: list[str] | None, sheets: dict[str, list[str]] | None) -> DataFrame:
    """Findings of the members, and of these the sheets, that a run was asked for; None: all. A finding without a sheet is of its whole member."""
    keep = F.lit(True)
    if members is not None:
        keep = keep & (F.col(member).isin(members) | F.col(member).isNull())
    for m, own in (sheets or {}).items():
        keep = keep & ((F.col(member) != m) | F.col(member).isNull() | F.col(sheet).isNull() | F.col(sheet).isin(own))
    return findings.where(keep)


def waived(findings: DataFrame, waivers: list[dict], today: str) -> DataFrame:
    """findings with waiver_reason of the first waiver that matches and hasn't expired; its fields sheet, location, element match anything when null."""
    out = F.lit(None).cast("string")
    for w in reversed(waivers):
        if w["expires"] < today:
            continue
        hit = F.col("finding_class") == w["finding_class"]
        for k in ("sheet", "location", "element"):
            if w.get(k) is not None:
                hit = hit & (F.col(k) == w[k])
        out = F.when(hit, F.lit(w["reason"])).otherwise(out)
    return findings.withColumn("waiver_reason", out).withColumn("expected_reason", F.when(F.col("waiver_reason").isNotNull(), "waiver").otherwise(F.col("expected_reason")))


def root_causes(findings: DataFrame) -> DataFrame:
    """findings with root_cause_key, for formula findings that share their place with another."""
    key = F.when(F.col("finding_class").isin(FORMULA_CLASSES) & F.col("location").isNotNull(), F.concat_ws(":", "artifact", "sheet", "location"))
    d = findings.withColumn("_key", key)
    many = d.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key", F.col("_key").alias("root_cause_key"))
    return d.join(many, "_key", "left").drop("_key")


# The global order of findings.
ORDER = ("severity_rank", "artifact", "sheet", "location", "element", "finding_class", "message")


def ordered(findings: DataFrame) -> DataFrame:
    """findings with finding_id F0001, F0002 ... in the global order (severity, artifact, sheet, location, element, class, message; null as empty).

    Sorted by range over all tasks and written once so; a place is that in its part plus the rows of the parts before it.
    """
    rank = F.lit(1)
    for s, n in RANKS.items():
        rank = F.when(F.col("severity") == s, n).otherwise(rank)
    d = findings.withColumn("severity_rank", rank)
    keys = [F.coalesce(F.col(c), F.lit("")) if c != "severity_rank" else F.col(c) for c in ORDER]
    d = placed(d, "_place", *keys)
    return d.withColumn("finding_id", F.format_string("F%04d", F.col("_place") + 1)).drop("_place", "severity_rank")
