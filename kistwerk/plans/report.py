"""A whole replay: from options to the report, the trend directory and the gates' verdict."""

from __future__ import annotations

import json
import os
import re
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kistwerk.operators import containers as C
from kistwerk.operators import schema as S
from kistwerk.sources.corpus_files import list_files, with_content

from . import replay as R
from .options import ReplayOptions

#: A report of an earlier run; missing fields are null.
SAVED = (
    "generated_at string, options struct<run_id:string>, "
    "summary struct<processed:bigint,success:bigint,failed:bigint,partial:bigint,warnings_total:bigint,pass_rate:double>, "
    f"files array<struct<{S.FILES.replace(' ', ':').replace(',:', ',')}>>"
)


class GateError(Exception):
    """At least one gate failed; the report is complete all the same."""

    def __init__(self, message: str, report: dict):
        super().__init__(message)
        self.report = report


def saved_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report_path, mtime, report): every JSON object in the folder's .json files is a report, whatever it holds."""
    if not os.path.isdir(folder):
        return _no_reports(spark)
    listed = list_files(spark, folder).where(R.extension(F.col("path")) == ".json")
    text = with_content(listed).select("path", F.decode("content", "UTF-8").alias("text"))
    times = F.udf(lambda p: datetime.fromtimestamp(os.stat(p).st_mtime, UTC), "timestamp")
    parsed = text.select(F.col("path").alias("report_path"), times("path").alias("mtime"), F.from_json("text", SAVED).alias("report"), F.get_json_object("text", "$").alias("whole"))
    return parsed.where(F.trim("whole").startswith("{")).drop("whole")


def _no_reports(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit(None).cast("string").alias("report_path"), F.lit(None).cast("timestamp").alias("mtime"), F.from_json(F.lit("{}"), SAVED).alias("report"))


def history(reports: DataFrame) -> DataFrame:
    """Trend points, zero where a report lacks a field; ``when`` is generated_at, else the file's time."""
    s = lambda c: F.coalesce(F.col(f"report.summary.{c}"), F.lit(0))
    return reports.select(
        F.coalesce("report.generated_at", F.lit("")).alias("generated_at"), F.col("report.options.run_id").alias("run_id"), "report_path", s("processed").alias("processed"), s("success").alias("success"),
        s("failed").alias("failed"), s("partial").alias("partial"), s("warnings_total").alias("warnings"), s("pass_rate").cast("double").alias("pass_rate"),
        F.coalesce(F.try_to_timestamp("report.generated_at"), "mtime").alias("when"),
    )


def report_files(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode("report.files").alias("f")).select("f.*").na.fill(False, ["success", "partial"]).na.fill(0)


def trend_file_name(o: ReplayOptions, now: datetime) -> str:
    token = lambda v: re.sub(r"[^A-Za-z0-9._-]", "_", v.strip()).strip("._- ")[:64]
    if o.save_trend_name.strip():
        name = token(os.path.basename(o.save_trend_name.strip())) or "replay"
        return name if name.lower().endswith(".json") else name + ".json"
    run = token(o.run_id)
    return f"replay-{now:%Y%m%dT%H%M%SZ}" + (f"-{run}" if run else "") + ".json"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _lean(d: dict) -> dict:
    return {k: v for k, v in d.items() if v not in (None, "", [], {})}


def replay(spark: SparkSession, o: ReplayOptions) -> dict:
    """The report. Raises GateError, with the report, if a gate fails; a saved trend is saved all the same.

    Files stay distributed; what comes to the driver is the summary, the gates, the page that the view asks for, and the
    regressions, which are part of the report.
    """
    o.validate()
    began, now = datetime.now(UTC), datetime.now(UTC)
    root = os.path.abspath(o.root)
    listing = R.with_reason(list_files(spark, root), o.ext, o.include_glob, o.exclude_glob, o.min_file_size_bytes, o.max_file_size_bytes).persist(StorageLevel.MEMORY_AND_DISK)
    scan = _rows(R.scan_counters(listing, o.max_matched_files))[0]
    chosen = R.matched(listing, o.max_matched_files)
    files = C.files(C.extract_reports(with_content(chosen), o.extraction())).persist(StorageLevel.MEMORY_AND_DISK)
    totals = _rows(R.summary(files))[0]
    codes = {r["code"]: r["files"] for r in _rows(R.error_codes(files))}
    past = saved_reports(spark, o.trend_dir) if o.trend_dir else None

    baseline = None
    if o.baseline or o.baseline_latest:
        if o.baseline:
            source = spark.read.schema(SAVED).option("multiLine", True).json(o.baseline).select(F.lit(o.baseline).alias("report_path"), F.struct("*").alias("report"))
        else:
            latest = R.latest_report(history(past)).select("report_path")
            source = past.join(latest, "report_path").select("report_path", "report")
        head = source.select("report_path", "report.generated_at").first()
        if head is None:
            raise FileNotFoundError("no baseline report")
        before = report_files(source).persist(StorageLevel.MEMORY_AND_DISK)
        diff = R.compared(files, before)
        delta = _rows(R.code_delta(files, before))
        baseline = {"baseline_path": head[0], "baseline_generated_at": head[1], **_rows(R.baseline_counts(diff))[0]}
        baseline["error_code_delta"] = {d["code"]: d["delta"] for d in delta if d["delta"]}
        baseline["new_error_codes"] = [d["code"] for d in delta if not d["baseline"] and d["current"]]
        baseline["increased_error_codes"] = [d for d in delta if d["delta"] > 0]
        baseline["regressions"] = _rows(R.regressions(diff))

    stamp = now.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    trend = None
    if past is not None:
        current = spark.range(1).select(
            F.lit(stamp).alias("generated_at"), F.lit(o.run_id).alias("run_id"), F.lit("").alias("report_path"), *(F.lit(totals[c]).cast("bigint").alias(c) for c in ("processed", "success", "failed", "partial")),
            F.lit(totals["warnings_total"]).cast("bigint").alias("warnings"), F.lit(totals["pass_rate"]).alias("pass_rate"), F.lit(stamp).cast("timestamp").alias("when"),
        )
        points = R.trend_points(history(past), current, o.trend_limit).persist()
        step = _rows(R.latest_delta(points))
        trend = {"source_dir": o.trend_dir, "points": [_lean({k: v for k, v in p.items() if k not in ("when", "pos")}) for p in _rows(points.orderBy("pos"))]}
        if step:
            trend["latest_delta"] = step[0]

    facts = _facts(spark, scan | totals, codes, baseline, (trend or {}).get("latest_delta"))
    verdict = _rows(R.gates(facts, o).orderBy("position"))
    failures = [g["message"] for g in verdict if not g["passed"]]

    shown = _rows(R.view(files, o))
    shown_codes: dict[str, int] = {}
    for f in shown:
        if not f["success"]:
            code = (f["error_code"] or "").strip().upper() or "UNKNOWN"
            shown_codes[code] = shown_codes.get(code, 0) + 1
    report = {
        "generated_at": stamp,
        "options": o.echo() | {"root": root},
        "summary": scan | totals | {"reported_files": len(shown), "omitted_files": totals["processed"] - len(shown), "duration_ms": int((datetime.now(UTC) - began).total_seconds() * 1000), "error_codes": codes, "reported_error_codes": shown_codes},
        "files": [_lean(f) | {k: f[k] for k in ("success", "partial")} for f in shown],
    }
    if baseline:
        report["baseline"] = _lean(baseline)
    if trend:
        report["trend"] = trend
    limits = {g: getattr(o, g) for g in R._OBSERVED if getattr(o, g) >= 0}
    report["gate"] = _lean({"deny_error_codes": o.deny_error_codes, "failures": failures}) | limits | {"enabled": bool(limits or o.deny_error_codes), "passed": not failures}

    text = json.dumps(report, indent=2, default=str)
    if o.output:
        os.makedirs(os.path.dirname(os.path.abspath(o.output)), exist_ok=True)
        with open(o.output, "w") as f:
            f.write(text)
    if o.save_trend:
        os.makedirs(o.trend_dir, exist_ok=True)
        target = os.path.join(os.path.abspath(o.trend_dir), trend_file_name(o, now))
        with open(target, "w") as f:
            f.write(text)
        if o.save_trend_prune:
            for r in R.to_prune(history(saved_reports(spark, o.trend_dir)), o.trend_limit, target).select("report_path").collect():
                os.remove(r[0])
    for df in (listing, files):
        df.unpersist()
    if failures:
        raise GateError("gate failed: " + "; ".join(failures), report)
    return report


def _facts(spark: SparkSession, numbers: dict, codes: dict, baseline: dict | None, delta: dict | None) -> DataFrame:
    """One row of what the gates look at."""
    value = lambda source, k, kind="bigint": F.lit(source[k] if source else None).cast(kind).alias(k)
    listed = lambda k, pick: F.lit(None).cast("array<string>").alias(k) if not baseline else F.array(*(F.lit(pick(x)) for x in baseline[k])).cast("array<string>").alias(k)
    code_map = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)) if codes else F.create_map().cast("map<string,bigint>")
    return spark.range(1).select(
        *(value(numbers, k, "double" if k == "pass_rate" else "bigint") for k in numbers), code_map.alias("error_codes"), *(value(baseline, k) for k in ("newly_failed", "new_files", "removed_files", "newly_partial")),
        listed("new_error_codes", lambda x: x), listed("increased_error_codes", lambda x: x["code"]), value(delta, "delta_pass_rate", "double"), *(value(delta, f"delta_{k}") for k in ("processed", "failed", "partial", "warnings")),
    )
