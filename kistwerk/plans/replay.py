"""Corpus replay as DataFrames: scan, filter, extract, summarise, compare, gate and view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kistwerk.functions.globs import matches_any, passes

from . import options as O


# Scan


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def with_reason(listing: DataFrame, ext: list[str], include: list[str], exclude: list[str], least: int = -1, most: int = -1) -> DataFrame:
    """``listing(rel, size)`` with the first filter that a file fails: ext, path or size; null where it matches."""
    size_ok = F.lit(True)
    if least >= 0:
        size_ok = size_ok & (F.col("size") >= least)
    if most >= 0:
        size_ok = size_ok & (F.col("size") <= most)
    reason = F.when(~extension(F.col("rel")).isin(ext), "ext") if ext else F.when(F.lit(False), "ext")
    return listing.withColumn("reason", reason.when(~passes(F.col("rel"), include, exclude), "path").when(~size_ok, "size"))


def scan_counters(reasoned: DataFrame, cap: int = -1) -> DataFrame:
    """One row; filtered counts exclude one another and, with matched_files_total, sum to scanned_files."""
    total = F.count_if(F.col("reason").isNull())
    matched = F.least(total, F.lit(cap)) if cap >= 0 else total
    filtered = [F.count_if(F.col("reason") == r).alias(f"filtered_by_{r}") for r in ("ext", "path", "size")]
    return reasoned.agg(F.count("*").alias("scanned_files"), matched.alias("matched_files"), total.alias("matched_files_total"), (total - matched).alias("truncated_matches"), *filtered)


def matched(reasoned: DataFrame, cap: int = -1) -> DataFrame:
    """Files that match, the first ``cap`` by path."""
    out = reasoned.where(F.col("reason").isNull()).drop("reason")
    return out.orderBy("path").limit(cap) if cap >= 0 else out


# Summary


def summary(files: DataFrame) -> DataFrame:
    """One row over all files; a partial file is a success, a failed one adds no warnings."""
    ok = F.col("success")
    passed, n = F.count_if(ok), F.count("*")
    warned = F.when(ok, F.col("warnings")).otherwise(0)
    return files.agg(
        n.alias("processed"), passed.alias("success"), (n - passed).alias("failed"), F.count_if(ok & F.col("partial")).alias("partial"), F.count_if(warned > 0).alias("warning_files"),
        F.coalesce(F.sum(warned), F.lit(0)).cast("bigint").alias("warnings_total"), F.when(n > 0, passed / n).otherwise(0.0).alias("pass_rate"),
    )


def normal_code(code: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(code)), F.lit("")), F.lit("UNKNOWN"))


def error_codes(files: DataFrame) -> DataFrame:
    """(code, files) of the failed files."""
    return files.where(~F.col("success")).groupBy(normal_code(F.col("error_code")).alias("code")).agg(F.count("*").alias("files"))


# View

_ISSUE = "not success or partial or warnings > 0"
_POLICY = {"all": "true", "failed": "not success", "success": "success", "partial": "partial", "issues": _ISSUE, "warnings": "warnings > 0", "clean": "success and not partial and warnings = 0", "none": "false"}


def _rel(root: str) -> Column:
    """The path below the root, for the view's globs; a path elsewhere stands as it is."""
    base = root.rstrip("/") + "/"
    return F.when(F.col("path").startswith(base), F.substring(F.col("path"), len(base) + 1, 1_000_000)).otherwise(F.col("path")) if root else F.col("path")


def selected(files: DataFrame, policy: str = "all", include: list[str] = (), exclude: list[str] = (), codes: list[str] = (), not_codes: list[str] = (), root: str = "") -> DataFrame:
    """Policy, then path patterns, then error-code patterns; a success has no code, so that codes drop it and not_codes keep it."""
    out = files.where(_POLICY[policy])
    if include or exclude:
        out = out.where(passes(_rel(root), list(include), list(exclude)))
    code = F.when(F.col("success"), "").otherwise(normal_code(F.col("error_code")))
    if codes:
        out = out.where((code != "") & matches_any(code, list(codes)))
    if not_codes:
        out = out.where((code == "") | ~matches_any(code, list(not_codes)))
    return out


def sort_keys(sort: str, tie_breaker: str = "path") -> list[Column]:
    path, down = F.col("path").asc(), lambda c: F.col(c).desc()
    code = F.nullif(F.upper(F.trim(F.col("error_code"))), F.lit("")).asc_nulls_last()
    return {
        "path": [path, F.col("duration_ms").asc()],
        "duration-desc": [down("duration_ms"), path],
        "size-desc": [down("size"), path],
        "artifacts-desc": [down("artifacts_total"), path],
        "artifacts-failed-desc": [down("artifacts_failed"), path],
        "warnings-desc": [down("warnings"), path],
        "error-code": [code, *([down("duration_ms")] if tie_breaker == "duration-desc" else []), path],
        "failed-first": [F.col("success").asc(), down("partial"), down("warnings"), down("duration_ms"), path],
    }[sort]


def page(files: DataFrame, sort: str = "path", tie_breaker: str = "path", offset: int = 0, limit: int = -1) -> DataFrame:
    out = files.orderBy(*sort_keys(sort, tie_breaker))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit >= 0 else out


def view(files: DataFrame, o: O.ReplayOptions) -> DataFrame:
    chosen = selected(files, o.report_files, o.report_include_glob, o.report_exclude_glob, o.report_error_codes, o.report_exclude_error_codes, o.root)
    return page(chosen, o.report_sort, o.report_sort_tie_breaker, o.report_offset, o.report_limit)


# Baseline

_STATE = ("success", "partial", "error_code")


def file_state(success: Column, partial: Column, code: Column) -> Column:
    failed = F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("failed:"), code)).otherwise("failed")
    return F.when(success & partial, "success(partial)").when(success, "success").otherwise(failed)


def _one_per_path(files: DataFrame) -> DataFrame:
    """Of rows with one path the last by all its columns."""
    return files.groupBy("path").agg(F.max(F.struct(*_STATE)).alias("s"))


def compared(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row for each path of either run, with the kinds of change (an array)."""
    c, b = (_one_per_path(x).withColumnRenamed("s", n) for x, n in ((current, "c"), (baseline, "b")))
    cs, bs = F.col("c.success"), F.col("b.success")
    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    code = lambda s: F.coalesce(F.col(f"{s}.error_code"), F.lit(""))
    changes = F.array(
        F.when(F.col("b").isNull(), "new"), F.when(F.col("c").isNull(), "removed"), F.when(both & bs & ~cs, "new_failure"), F.when(both & ~bs & cs, "fixed"),
        F.when(both & ~bs & ~cs & (code("b") != code("c")), "error_code_changed"), F.when(both & ~F.col("b.partial") & F.col("c.partial"), "became_partial"),
    )
    return c.join(b, "path", "full_outer").withColumn("changes", F.array_compact(changes))


def baseline_counts(diff: DataFrame) -> DataFrame:
    has = lambda k: F.count_if(F.array_contains("changes", k))
    return diff.agg(
        F.count_if(F.col("b").isNotNull()).alias("baseline_files"), F.count_if(F.col("c").isNotNull()).alias("current_files"), has("new").alias("new_files"), has("removed").alias("removed_files"),
        has("new_failure").alias("newly_failed"), has("fixed").alias("fixed"), has("error_code_changed").alias("error_code_changed"), has("became_partial").alias("newly_partial"),
    )


def regressions(diff: DataFrame) -> DataFrame:
    """(path, kind, baseline, current), in this order."""
    kinds = F.array_intersect("changes", F.array(*(F.lit(k) for k in ("new_failure", "error_code_changed", "became_partial"))))
    state = lambda s: file_state(F.col(f"{s}.success"), F.col(f"{s}.partial"), F.col(f"{s}.error_code"))
    return diff.select("path", F.explode(kinds).alias("kind"), state("b").alias("baseline"), state("c").alias("current")).orderBy("path", "kind")


def code_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(code, baseline, current, delta) for every code of either run."""
    c, b = (error_codes(x).withColumnRenamed("files", n) for x, n in ((current, "current"), (baseline, "baseline")))
    both = c.join(b, "code", "full_outer").select("code", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("baseline", "current")))
    return both.withColumn("delta", F.col("current") - F.col("baseline")).orderBy("code")


def code_changes(delta: DataFrame) -> DataFrame:
    """One row: the sorted codes that are new, and those with more files than before."""
    return delta.agg(
        F.sort_array(F.collect_set(F.when((F.col("baseline") == 0) & (F.col("current") > 0), F.col("code")))).alias("new_error_codes"),
        F.sort_array(F.collect_set(F.when(F.col("delta") > 0, F.col("code")))).alias("increased_error_codes"),
    )


# Trend; a history has a row for each run, so a window over all of it is small


def trend_points(history: DataFrame, current: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` runs (all, if it isn't positive) by (when, report_path), then the current one; ``pos`` counts from 1."""
    if limit > 0:
        newest = Window.orderBy(F.desc("when"), F.desc("report_path"))
        history = history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")
    points = history.withColumn("_last", F.lit(False)).unionByName(current.withColumn("_last", F.lit(True)))
    return points.withColumn("pos", F.row_number().over(Window.orderBy("_last", "when", "report_path"))).drop("_last")


def latest_delta(points: DataFrame) -> DataFrame:
    """One row, the last point against the one before; none with fewer than two points."""
    w = Window.orderBy("pos")
    deltas = {f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in ("processed", "pass_rate", "failed", "partial", "warnings")}
    steps = points.withColumns({"from_generated_at": F.lag("generated_at").over(w), "before": F.lag("pos").over(w), **deltas})
    return steps.where("before is not null").orderBy(F.desc("pos")).limit(1).select("from_generated_at", F.col("generated_at").alias("to_generated_at"), *deltas)


def latest_report(history: DataFrame) -> DataFrame:
    return history.agg(F.max_by(F.struct(*history.columns), F.struct("when", "report_path")).alias("r")).where("r is not null").select("r.*")


def to_prune(history: DataFrame, keep: int, preserve: str = "") -> DataFrame:
    """The oldest reports beyond ``keep``, never the preserved one."""
    n = history.count()
    old = history.where(F.lower("report_path") != preserve.lower()).orderBy("when", "report_path")
    return old.limit(max(0, n - keep) if keep > 0 else 0)


# Gates: (option, observed value, its name in messages, sense); fixed values, with the messages' wording
_OBSERVED = {
    "min_scanned_files": ("scanned_files", "scanned_files"),
    "max_scanned_files": ("scanned_files", "scanned_files"),
    "min_matched_files": ("matched_files_total", "matched_files_total"),
    "max_matched_files_total": ("matched_files_total", "matched_files_total"),
    "max_truncated_matches": ("truncated_matches", "truncated_matches"),
    "min_processed": ("processed", "processed"),
    "max_processed": ("processed", "processed"),
    "min_pass_rate": ("pass_rate", "pass_rate"),
    "max_failed": ("failed", "failed"),
    "max_partial": ("partial", "partial"),
    "max_warnings": ("warnings_total", "warnings"),
    "max_warning_files": ("warning_files", "warning_files"),
    "max_newly_failed": ("newly_failed", "newly_failed"),
    "max_new_files": ("new_files", "new_files"),
    "max_removed_files": ("removed_files", "removed_files"),
    "max_newly_partial": ("newly_partial", "newly_partial"),
    "max_pass_rate_drop": ("-delta_pass_rate", "pass_rate_drop"),
    "max_processed_increase": ("delta_processed", "processed_increase"),
    "max_processed_drop": ("-delta_processed", "processed_drop"),
    "max_failed_increase": ("delta_failed", "failed_increase"),
    "max_partial_increase": ("delta_partial", "partial_increase"),
    "max_warning_increase": ("delta_warnings", "warning_increase"),
    "max_new_error_codes": ("size(new_error_codes)", "new_error_codes"),
    "max_error_code_regressions": ("size(increased_error_codes)", "error_code_regressions"),
}
_DENY_AT = "max_new_error_codes"  # the deny list is reported before this gate
_RATES = ("min_pass_rate", "max_pass_rate_drop")


def gates(facts: DataFrame, o: O.ReplayOptions) -> DataFrame:
    """(position, gate, observed, limit, passed, message) for each enabled gate of one row of facts.

    ``facts`` has the columns of scan_counters and summary, ``error_codes`` (a map), those of baseline_counts and code_changes, null
    without a baseline, and those of latest_delta, null without one. message is null where a gate passes.
    """
    found: list[Column] = []

    def add(gate: str, observed: Column, limit: Column, failed: Column, message: Column) -> None:
        row = (F.lit(len(found)).alias("position"), F.lit(gate).alias("gate"), observed.cast("double").alias("observed"), limit.cast("double").alias("limit"))
        found.append(F.struct(*row, (~failed).alias("passed"), F.when(failed, message).alias("message")))

    for gate, (value, name) in _OBSERVED.items():
        if gate == _DENY_AT:
            for code in o.deny_error_codes:
                n = F.coalesce(F.element_at("error_codes", code), F.lit(0))
                add("deny_error_codes", n, F.lit(0), n > 0, F.format_string(f"error_code {code} present %d time(s)", n.cast("bigint")))
        limit = getattr(o, gate)
        if limit < 0:
            continue
        seen = F.expr(value)
        failed = seen < limit if gate.startswith("min") else seen > limit
        kind, form = ("double", "%.6f") if gate in _RATES else ("bigint", "%d")
        message = F.format_string(f"{name} {form} {'<' if gate.startswith('min') else '>'} {gate} {form}", seen.cast(kind), F.lit(limit).cast(kind))
        missing = "baseline diff" if gate in O.BASELINE_GATES else "trend latest delta"
        add(gate, seen, F.lit(limit), F.coalesce(failed, F.lit(True)), F.when(seen.isNull(), f"{gate} gate requires {missing}").otherwise(message))
    kind = "array<struct<position:int,gate:string,observed:double,limit:double,passed:boolean,message:string>>"
    return facts.select(F.explode(F.array(*found).cast(kind)).alias("g")).select("g.*")


def gate_error(results: DataFrame) -> DataFrame:
    """One row: whether all passed, and the error with every failure in order."""
    failures = F.transform(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.struct("position", "message")))), lambda x: x["message"])
    out = results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), failures.alias("failures"))
    return out.withColumn("error", F.when(~F.col("passed"), F.concat(F.lit("gate failed: "), F.array_join("failures", "; "))))
