"""Status, text and date expressions of the incident and telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- fixed values ----------------------------------------------------------------------------------------------------

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
UNKNOWN_SEVERITY_RANK = 4
DEFAULT_SEVERITY = "MEDIUM"

PASSED_WORDS = ("PASSED", "PASS", "SUCCESS", "SUCCEEDED")
FAILED_WORDS = ("FAILED", "FAIL", "ERROR")

CLOSED_STATUSES = ("RESOLVED", "REJECTED", "ESCALATED")
DIAGNOSIS_READY_STATUSES = (
    "DIAGNOSED", "REMEDIATION_PROPOSED", "AWAITING_APPROVAL", "REMEDIATING", "VALIDATING", "RESOLVED", "REJECTED",
    "ESCALATED",
)

KNOWN_ADAPTERS = ("spark", "synapse")
DEFAULT_ADAPTER = "spark"

RUN_ID_PATTERN = r"^\d{8}_\d{6}_[0-9a-f]{6}$"

HIGH_CONFIDENCE = 0.7

# ---------------------------------------------------------------------------------------------------------------------


def _c(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: ColumnOrName) -> Column:
    """Remove white space of every kind from both ends (SQL ``trim`` removes blanks only)."""
    return F.trim(_c(value), F.lit(WHITESPACE))


def blank_to_null(value: ColumnOrName) -> Column:
    """Stripped text, NULL if nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def first_non_blank(*values: ColumnOrName, default: str = "") -> Column:
    """First value with visible text, stripped; blank values never hide later ones."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(default))


def normalize_severity(value: ColumnOrName) -> Column:
    upper = F.upper(strip(value))
    return F.when(upper.isin(*SEVERITY_RANK), upper).otherwise(F.lit(DEFAULT_SEVERITY))


def severity_rank(severity: ColumnOrName) -> Column:
    """0 for the most severe; anything unknown, NULL included, ranks last."""
    known = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(known, _c(severity)), F.lit(UNKNOWN_SEVERITY_RANK))


def normalize_outcome(value: ColumnOrName) -> Column:
    upper = F.upper(strip(value))
    return F.when(upper.isin(*PASSED_WORDS), F.lit("PASSED")).when(upper.isin(*FAILED_WORDS), F.lit("FAILED")).otherwise(F.lit(""))


def humanize(value: ColumnOrName) -> Column:
    """``tenant_a-west`` -> ``Tenant A West``; text without any word stays as it is."""
    words = strip(F.regexp_replace(_c(value), r"[_\-\s]+", " "))
    return F.when(words == "", _c(value)).otherwise(F.initcap(words))


def effective_status(status: ColumnOrName, recovery_confirmed: ColumnOrName) -> Column:
    """A RESOLVED incident counts as VALIDATING until its recovery is confirmed."""
    unconfirmed = (_c(status) == "RESOLVED") & ~F.coalesce(_c(recovery_confirmed), F.lit(False))
    return F.when(unconfirmed, F.lit("VALIDATING")).otherwise(_c(status))


def diagnosis_ready(status: ColumnOrName) -> Column:
    return F.coalesce(_c(status).isin(*DIAGNOSIS_READY_STATUSES), F.lit(False))


def execution_progress(status: ColumnOrName) -> Column:
    return (
        F.when(_c(status).isin("VALIDATING", "RESOLVED"), "Succeeded").when(_c(status) == "ESCALATED", "Failed").otherwise("Not started")
    )


def recovery_outcome(status: ColumnOrName) -> Column:
    return F.when(_c(status).isin("RESOLVED", "ESCALATED"), _c(status)).otherwise("")


def resolve_adapter(platform: ColumnOrName) -> Column:
    name = F.lower(strip(platform))
    return F.when(name.isin(*KNOWN_ADAPTERS), name).otherwise(F.lit(DEFAULT_ADAPTER))


def run_id_is_valid(run_id: ColumnOrName) -> Column:
    return F.coalesce(_c(run_id).rlike(RUN_ID_PATTERN), F.lit(False))


def run_started_at(run_id: ColumnOrName) -> Column:
    """Start time carried by a run id; NULL for anything that is not a run id of a real date."""
    stamp = F.when(_c(run_id).rlike(RUN_ID_PATTERN), F.substring(_c(run_id), 1, 15))
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))


def incident_id_for_run(workflow_run_id: ColumnOrName) -> Column:
    """Same run, same incident id, however often the run is processed."""
    return F.concat(F.lit("INC-"), F.upper(F.substring(_c(workflow_run_id), 1, 8)))


def stage_duration(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Seconds from start to end, never negative, four decimals."""
    micros = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return F.round(F.greatest(F.lit(0.0), micros / F.lit(1e6)), 4)


def clamp01(value: ColumnOrName) -> Column:
    """NULL stays NULL (``greatest``/``least`` alone would turn it into a bound)."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(value).cast("double")))
    return F.when(_c(value).isNotNull(), bounded)


def confident_without_evidence(confidence: ColumnOrName, evidence: ColumnOrName) -> Column:
    empty = F.coalesce(F.size(_c(evidence)) == 0, F.lit(True))
    return F.coalesce(_c(confidence) >= HIGH_CONFIDENCE, F.lit(False)) & empty


def promotion_status_on(start: ColumnOrName, end: ColumnOrName, as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp")
    return F.when(now < _c(start), "UPCOMING").when(now > _c(end), "EXPIRED").otherwise("ACTIVE")


def identifier_is_clean(value: ColumnOrName) -> Column:
    """Not blank, no white space at the edges, no control characters."""
    text = _c(value)
    return F.coalesce((text != "") & (text == strip(text)) & ~text.rlike(r"[\x00-\x1f]"), F.lit(False))


def non_blank_lines(lines: ColumnOrName) -> Column:
    return F.filter(F.transform(_c(lines), strip), lambda line: line != "")


def last_items(items: ColumnOrName, n: int) -> Column:
    """The last ``n`` items in order; all of them if there are fewer."""
    array = _c(items)
    return F.slice(array, F.greatest(F.size(array) - F.lit(n) + F.lit(1), F.lit(1)), F.lit(n))


def first_items(items: ColumnOrName, n: int) -> Column:
    return F.slice(_c(items), 1, n)


def key_value_pairs(details: ColumnOrName, separator: str) -> Column:
    pairs = F.transform(F.map_entries(_c(details)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.array_join(pairs, separator)


def _or_word(value: ColumnOrName, word: str) -> Column:
    return F.coalesce(F.nullif(_c(value), F.lit("")), F.lit(word))


def similarity_query_text(recent_lines: int = 10) -> Column:
    """Search text of one incident row (pipeline, adapter, failed_stage, failed_task, error_message, logs, details)."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Pipeline: "), F.col("pipeline")),
        F.concat(F.lit("Adapter: "), F.col("adapter")),
        F.concat(F.lit("Failed stage: "), _or_word("failed_stage", "unknown")),
        F.concat(F.lit("Failed task: "), _or_word("failed_task", "unknown")),
        F.concat(F.lit("Error: "), F.col("error_message")),
        F.lit("Logs:"),
        F.array_join(last_items("logs", recent_lines), "\n"),
        F.concat(F.lit("Details: "), key_value_pairs("details", ", ")),
    )


def memory_document() -> Column:
    """Stored text of one incident row: as the query text but with all logs, diagnosis and remedies."""
    blocks = [
        F.concat(F.lit("Pipeline: "), F.col("pipeline")),
        F.concat(F.lit("Adapter: "), F.col("adapter")),
        F.concat(F.lit("Failed stage: "), _or_word("failed_stage", "unknown")),
        F.concat(F.lit("Error:\n"), F.col("error_message")),
        F.concat(F.lit("Logs:\n"), _or_word(F.array_join("logs", "\n"), "(none)")),
        F.concat(F.lit("Details:\n"), _or_word(key_value_pairs("details", "\n"), "(none)")),
        F.when(
            F.col("root_cause").isNotNull(),
            F.concat(F.lit("Diagnosis:\n"), F.col("root_cause"), F.lit(" (failure location: "), F.col("failure_location"), F.lit(")")),
        ),
        F.when(F.size("remedies") > 0, F.concat(F.lit("Recommended remediation:\n"), F.array_join("remedies", "; "))),
    ]
    return F.concat_ws("\n\n", *blocks)


def incident_summary(adapter: ColumnOrName, failure_location: ColumnOrName, root_cause: ColumnOrName) -> Column:
    return F.format_string(
        "The %s pipeline failed during %s. The most probable cause is %s.", _c(adapter), _c(failure_location), _c(root_cause)
    )
