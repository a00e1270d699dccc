"""Registered queries over real files, reports and gates, each with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kistwerk.formats import fixed as X
from kistwerk.formats.extract import Options
from kistwerk.functions import binary, names
from kistwerk.operators import containers as C
from kistwerk.sources import artifact_dir
from kistwerk.sources.corpus_files import list_files, with_content

from . import queries as Q
from . import replay as R
from .options import BASELINE_GATES, SCAN_GATES, SUMMARY_GATES, TREND_GATES, ReplayOptions
from .registry import ORACLES, query
from .report import history, replay, report_files, saved_reports

# Gates: (gate, limit, observed value in SQL, its name in messages); limits are such that some pass and some fail

_SCAN = [
    ("min_scanned_files", 1, "scanned_files", "scanned_files"), ("max_scanned_files", 10, "scanned_files", "scanned_files"), ("min_matched_files", 1000000, "matched_files_total", "matched_files_total"),
    ("max_matched_files_total", 0, "matched_files_total", "matched_files_total"), ("max_truncated_matches", 1000000, "truncated_matches", "truncated_matches"),
]
_SUMMARY = [
    ("min_processed", 10, "processed", "processed"), ("max_processed", 20, "processed", "processed"), ("min_pass_rate", 0.75, "pass_rate", "pass_rate"), ("max_failed", 3, "failed", "failed"),
    ("max_partial", 1000000, "partial", "partial"), ("max_warnings", 2, "warnings_total", "warnings"), ("max_warning_files", 1, "warning_files", "warning_files"),
]
_BASELINE = [
    ("max_newly_failed", 0, "newly_failed", "newly_failed"), ("max_new_files", 1000000, "new_files", "new_files"), ("max_removed_files", 0, "removed_files", "removed_files"),
    ("max_newly_partial", 5, "newly_partial", "newly_partial"), ("max_new_error_codes", 0, "new_codes", "new_error_codes"), ("max_error_code_regressions", 0, "more_codes", "error_code_regressions"),
]
_TREND = [
    ("max_pass_rate_drop", 0.0, "-delta_pass_rate", "pass_rate_drop"), ("max_processed_increase", 0, "delta_processed", "processed_increase"), ("max_processed_drop", 0, "-delta_processed", "processed_drop"),
    ("max_failed_increase", 0, "delta_failed", "failed_increase"), ("max_partial_increase", 0, "delta_partial", "partial_increase"), ("max_warning_increase", 0, "delta_warnings", "warning_increase"),
]


def _gate_sql(gates: list[tuple], facts: str) -> str:
    rows = []
    for gate, limit, value, name in gates:
        sign, form = ("<" if gate.startswith("min") else ">"), ("%.6f" if "rate" in gate else "%d")
        kind = "double" if "rate" in gate else "bigint"
        shown = f"printf('{name} {form} {sign} {gate} {form}', cast({value} as {kind}), cast({limit} as {kind}))"
        rows.append(f"select '{gate}' as gate, cast({value} as double) as observed, cast({limit} as double) as threshold, not ({value} {sign} {limit}) as passed, case when {value} {sign} {limit} then {shown} end as message from facts")
    return f"with facts as ({facts}) " + " union all ".join(rows)


def _gated(facts: DataFrame, gates: list[tuple]) -> DataFrame:
    return R.gates(facts, ReplayOptions(**{g[0]: g[1] for g in gates}))


def _shown(results: DataFrame) -> DataFrame:
    return results.select("gate", "observed", F.col("limit").alias("threshold"), "passed", "message")


assert [g[0] for g in _SCAN] == list(SCAN_GATES) and [g[0] for g in _SUMMARY] == list(SUMMARY_GATES) and [g[0] for g in _BASELINE] == list(BASELINE_GATES) and [g[0] for g in _TREND] == list(TREND_GATES)


@query("gates_scan", _gate_sql(_SCAN, ORACLES["filter_counters"]))
def gates_scan(spark, sf_dir):
    return _shown(_gated(R.scan_counters(Q._reasoned(spark, sf_dir), 40), _SCAN))


_TOTALS = f"""select count(*) as processed, count(*) filter (where success) / count(*)::double as pass_rate, count(*) filter (where not success) as failed, count(*) filter (where success and partial) as partial,
  cast(coalesce(sum(warnings) filter (where success), 0) as bigint) as warnings_total, count(*) filter (where success and warnings > 0) as warning_files from ({Q._FILES})"""


@query("gates_summary", _gate_sql(_SUMMARY, _TOTALS))
def gates_summary(spark, sf_dir):
    return _shown(_gated(R.summary(Q.state_files(spark, sf_dir)), _SUMMARY))


_CHANGES = f"select * from ({ORACLES['baseline_counts']}), (select count(*) filter (where baseline = 0 and current > 0) as new_codes, count(*) filter (where delta > 0) as more_codes from ({Q._DELTA}))"


@query("gates_baseline", _gate_sql(_BASELINE, _CHANGES))
def gates_baseline(spark, sf_dir):
    runs = Q._runs(spark, sf_dir)
    facts = R.baseline_counts(R.compared(*runs)).crossJoin(F.broadcast(R.code_changes(R.code_delta(*runs))))  # one row each
    return _shown(_gated(facts, _BASELINE))


@query("gates_trend", _gate_sql(_TREND, ORACLES["trend_delta"]))
def gates_trend(spark, sf_dir):
    return _shown(_gated(R.latest_delta(R.trend_points(*Q._days(spark, sf_dir), limit=7)), _TREND))


@query(
    "gate_error",
    f"""with results as ({_gate_sql(_SUMMARY, _TOTALS)}), ordered as (select *, list_position({[g[0] for g in _SUMMARY]}, gate) as k from results)
    select bool_and(passed) as passed, count(*) filter (where not passed) as failures, 'gate failed: ' || string_agg(message, '; ' order by k) filter (where not passed) as error from ordered""",
)
def gate_error(spark, sf_dir):
    """All failures in one error, in the order of the gates."""
    out = R.gate_error(_gated(R.summary(Q.state_files(spark, sf_dir)), _SUMMARY))
    return out.select("passed", F.size("failures").cast("bigint").alias("failures"), "error")


# Real files: the documents' containers and files that are none, written by the sink and scanned again

_scratch: dict[tuple, str] = {}


def _folder(spark: SparkSession) -> str:
    """A folder that all executors see: below spark.checkpoint.dir, or in local mode, if unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = tempfile.mkdtemp(prefix="kistwerk-files-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    base = base.removeprefix("file://").removeprefix("file:")
    out = os.path.join(base, f"files-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def _corpus(spark: SparkSession, sf_dir: str) -> str:
    """The root of a corpus on disk, made once a session and table folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _scratch:
        root = _folder(spark)
        short = Q._table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bad/"), F.col("item_id").cast("string"), F.lit(".cfb")).alias("path"), F.encode("text", "UTF-8").alias("content"))
        files = Q.doc_containers(spark, sf_dir).unionByName(short)
        artifact_dir.write_files(files.select(F.col("path").alias("relative_path"), F.col("content").alias("raw")), root)
        _scratch[key] = root
    return _scratch[key]


_DISK = f"""select source || '/' || doc_id || '.cfb' as rel, size, sha256(text) as sha256, true as ok from (select source, doc_id, text, {Q._CONTAINER.replace('from (', 'as size from (', 1)})
  union all select 'bad/' || item_id || '.cfb', cast({Q._BYTES} as bigint), sha256(text), false from benchmark"""


@query("corpus_scan", f"select rel, size, sha256 from ({_DISK})")
def corpus_scan(spark, sf_dir):
    """Files that the sink has placed are listed, filtered by extension, opened and read."""
    listing = R.matched(R.with_reason(list_files(spark, _corpus(spark, sf_dir)), [".cfb"], [], []))
    found = with_content(listing).select("rel", "size", "content", C.cfb_read_stream("content", F.lit("/Docs/A")).alias("text"))
    return found.select("rel", "size", binary.sha256(F.coalesce("text", "content")).alias("sha256"))


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """(root, trend folder, output of the second run): two runs, the first without a trend folder, the second against the first."""
    root, key = _corpus(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir, "runs")
    if key not in _scratch:
        work = _folder(spark)
        common = dict(root=root, ext=[".cfb"], trend_dir=f"{work}/trend", save_trend=True)
        replay(spark, ReplayOptions(**common, run_id="one", save_trend_name="one", output=f"{work}/first/report.json"))
        replay(spark, ReplayOptions(**common, run_id="two", save_trend_name="two", baseline_latest=True, report_limit=25, report_files="issues", output=f"{work}/second/report.json"))
        _scratch[key] = work
    work = _scratch[key]
    return root, f"{work}/trend", work


_RUN = f"select count(*) as processed, count(*) filter (where ok) as success, count(*) filter (where not ok) as failed, cast(0 as bigint) as partial, cast(0 as bigint) as warnings, count(*) filter (where ok) / count(*)::double as pass_rate from ({_DISK})"


@query("report_history", f"select 'one' as run_id, * from ({_RUN}) union all select 'two', * from ({_RUN})")
def report_history(spark, sf_dir):
    """Two saved reports, scanned from their folder."""
    points = history(saved_reports(spark, _replayed(spark, sf_dir)[1]))
    return points.select("run_id", "processed", "success", "failed", "partial", "warnings", "pass_rate")


@query("report_files", f"select rel, size, ok as success, case when not ok then 'BAD_HEADER' end as error_code, case when ok then 1 else 0 end as artifacts_total from ({_DISK})")
def report_files_query(spark, sf_dir):
    """The files of the first report, loaded from its JSON."""
    root, trend, _ = _replayed(spark, sf_dir)
    saved = saved_reports(spark, trend).where("report.options.run_id = 'one'")
    rel = F.substring("path", len(root) + 2, 1_000_000)
    return report_files(saved).select(rel.alias("rel"), "size", "success", "error_code", F.coalesce("artifacts_total", F.lit(0)).cast("int").alias("artifacts_total"))


@query(
    "report_output",
    f"""select 'first' as run, count(*) as processed, count(*) as reported_files, cast(0 as bigint) as omitted_files, 1 as points, false as has_delta, cast(null as bigint) as baseline_files, cast(null as bigint) as newly_failed,
      count(*) filter (where not ok) as bad_headers from ({_DISK})
    union all select 'second', count(*), least(25, count(*) filter (where not ok)), count(*) - least(25, count(*) filter (where not ok)), 2, true, count(*), 0, count(*) filter (where not ok) from ({_DISK})""",
)
def report_output(spark, sf_dir):
    """The reports as files: what is listed and left out, the trend without and with a run before, the comparison with the latest report."""
    work = _replayed(spark, sf_dir)[2]
    parts = []
    for run in ("first", "second"):
        text = spark.read.text(f"file://{work}/{run}/report.json", wholetext=True)
        get = lambda p: F.get_json_object("value", p)
        n = lambda p: get(p).cast("bigint")
        parts.append(text.select(
            F.lit(run).alias("run"), n("$.summary.processed").alias("processed"), n("$.summary.reported_files").alias("reported_files"), n("$.summary.omitted_files").alias("omitted_files"),
            F.json_array_length(get("$.trend.points")).alias("points"), get("$.trend.latest_delta").isNotNull().alias("has_delta"), n("$.baseline.baseline_files").alias("baseline_files"),
            n("$.baseline.newly_failed").alias("newly_failed"), n("$.summary.error_codes.BAD_HEADER").alias("bad_headers"),
        ))
    return parts[0].unionByName(parts[1])


@query("manifest_files", f"select 'Docs/000000_A.bin' as relative_path, '/Docs/A' as artifact_path, source || '/' || doc_id || '.cfb' as container, cast({Q._BYTES} as bigint) as size from documents where {Q._BYTES} > 0")
def manifest_files(spark, sf_dir):
    """The sink's files below a folder for each container, as its manifest lists them."""
    out = _folder(spark)
    artifacts = C.artifacts(C.extract_reports(Q.doc_containers(spark, sf_dir), Options(include_raw=True)))
    artifact_dir.write(artifacts, out, tree=True, by_container=True)
    files = artifact_dir.manifest_files(spark, f"{out}/manifest.json")
    below = F.substring_index("relative_path", "/", 1)
    inside = F.substring(F.col("relative_path"), F.length(below) + 2, F.length("relative_path"))
    return files.select(inside.alias("relative_path"), "artifact_path", F.regexp_replace(below, "_", "/").alias("container"), F.col("size").cast("bigint").alias("size"))


# Containers of more than 109 allocation sectors, search, totals, changes

_LONG = "repeat(r_name || '-', cast(8000000 // (length(r_name) + 1) as integer))"


@query("difat_chain", f"select cast(r_regionkey as bigint) as r_regionkey, octet_length(encode({_LONG})) // 512 > 109 * 128 as beyond_header, sha256({_LONG}) as sha256 from region")
def difat_chain(spark, sf_dir):
    """Streams of 8 MB: their allocation table has more sectors than the header lists, so the chain behind it is read."""
    text = F.repeat(F.concat("r_name", F.lit("-")), F.floor(8000000 / (F.length("r_name") + 1)).cast("int"))
    made = Q._table(spark, sf_dir, "region").select("r_regionkey", C.cfb_build(Q._one("/Long", F.encode(text, "UTF-8"))).alias("content"))
    return made.select(F.col("r_regionkey").cast("bigint"), (F.substring("content", 73, 4) != F.expr("X'00000000'")).alias("beyond_header"), binary.sha256(C.cfb_read_stream("content", F.lit("/Long"))).alias("sha256"))


_HITS = f"select path, node_path from ({Q._TREE}) where type = 'stream' and node_path like '/en/%' and node_path like '%1%'"


@query("find_nodes", f"select path, node_path from ({_HITS}) where path || '!' || node_path > (select path || '!' || node_path from ({_HITS}) order by path || '!' || node_path limit 1 offset 4) order by path || '!' || node_path limit 20")
def find_nodes(spark, sf_dir):
    """The second page of a search, behind the cursor that the first one ended with."""
    nodes = C.gathered_nodes(Q.source_streams(spark, sf_dir))
    search = dict(prefix="/en/", name_like="%1%", kind="stream")
    last = C.find_nodes(nodes, **search, limit=5).collect()[-1]
    return C.find_nodes(nodes, **search, limit=20, after=f"{last.path}!{last.node_path}").select("path", "node_path")


@query(
    "model_stats",
    f"""select path, cast(count(*) as integer) as node_total, cast(count(*) filter (where type = 'stream') as integer) as stream_total, cast(count(*) filter (where type = 'storage') as integer) as storage_total,
    cast(count(*) filter (where type = 'stream') as integer) as artifact_total, 0 as warning_total, 0 as error_total, cast(max(depth) as integer) as max_depth from ({Q._TREE}) group by path
    union all select 'bad/' || item_id || '.cfb', 0, 0, 0, 0, 0, 1, 0 from benchmark""",
)
def model_stats(spark, sf_dir):
    options = Options(deduplicate=False, **Q.UNLIMITED)
    bad = Q.bad_files(spark, sf_dir).where("path like 'bad/%'")
    return C.gathered_model_stats(Q.source_streams(spark, sf_dir), options).unionByName(C.model_stats(bad, options))


@query(
    "mutations",
    f"""select source || '/' || doc_id || '.cfb' as path, kind, node_path, case when kind = 'create' then null else cast({Q._BYTES} as bigint) end as size_before,
    case node_path when '/Docs/A' then cast({Q._BYTES} + 1 as bigint) when '/New' then 0 when '/New/B' then cast({Q._BYTES} as bigint) end as size_after
    from documents, (values ('update', '/Docs/A'), ('create', '/New'), ('create', '/New/B')) as m(kind, node_path)""",
)
def mutations(spark, sf_dir):
    """What a transaction of three operations has changed."""
    text = F.encode("text", "UTF-8")
    op = lambda o, p, data: F.struct(F.lit(o).alias("op"), F.lit(p).alias("path"), F.lit("").alias("new_path"), data.alias("data"))
    ops = F.array(op("put", "/Docs/A", F.concat(text, F.expr("X'21'"))), op("mkdir", "/New", text), op("put", "/New/B", text))
    made = Q._table(spark, sf_dir, "documents").select(Q._doc_path().alias("path"), C.cfb_build(Q._one("/Docs/A", text)).alias("content"), ops.alias("ops"))
    after = made.select("path", C.cfb_apply("content", "ops").alias("r")).select("path", "r.content")
    changed = C.mutations(C.nodes(made.select("path", "content")), C.nodes(after))
    return changed.select("path", "kind", "node_path", F.col("size_before").cast("bigint").alias("size_before"), F.col("size_after").cast("bigint").alias("size_after"))


@query(
    "cfb_put_properties",
    f"""select source || '/' || doc_id || '.cfb' as path, '{X.SUMMARY}' as format_id, cast(pid as bigint) as pid, s as value_string, v as value_long from (
    select source, doc_id, 2 as pid, 'p ' || lang as s, cast(null as bigint) as v from documents union all select source, doc_id, 14, null, doc_id from documents)""",
)
def cfb_put_properties(spark, sf_dir):
    """A property set put as one operation of a transaction, and read again."""
    prop = lambda pid, vt, text, number: F.struct(F.lit(pid).alias("pid"), F.lit(vt).alias("vt"), text.cast("string").alias("value_string"), number.cast("bigint").alias("value_long"))
    none = F.lit(None)
    props = F.array(prop(2, X.VT_LPWSTR, F.concat(F.lit("p "), "lang"), none), prop(14, X.VT_I8, none, F.col("doc_id")))
    docs = Q._table(spark, sf_dir, "documents")
    made = docs.select(Q._doc_path().alias("path"), C.cfb_build(Q._one("/Docs/A", F.encode("text", "UTF-8"))).alias("content"), F.array(C.put_properties(F.lit("/Props"), F.lit(X.SUMMARY), props)).alias("ops"))
    done = made.select("path", C.cfb_apply("content", "ops").alias("r")).select("path", "r.content")
    return C.properties(done, ["/Props"]).select("path", "format_id", "pid", "value_string", "value_long")


# Values

_RAW = "case doc_id % 4 when 0 then ' run ' || doc_id || '/' || lang || '. ' when 1 then '__' || lang || '--' when 2 then repeat('ab', 40) else lang || ':' || doc_id end"


@query("file_tokens", f"select doc_id, substr(regexp_replace(regexp_replace(trim({_RAW}), '[^A-Za-z0-9._-]', '_', 'g'), '^[._ -]+|[._ -]+$', '', 'g'), 1, 64) as token from documents")
def file_tokens(spark, sf_dir):
    raw = F.expr("case doc_id % 4 when 0 then concat(' run ', doc_id, '/', lang, '. ') when 1 then concat('__', lang, '--') when 2 then repeat('ab', 40) else concat(lang, ':', doc_id) end")
    return Q._table(spark, sf_dir, "documents").select("doc_id", names.file_token(raw).alias("token"))


@query("ranged_casts", "select doc_id, try_cast(v as tinyint) as a, try_cast(v as smallint) as b, try_cast(v as integer) as c, v as d from (select doc_id, (doc_id % 7 - 3) * (doc_id * doc_id * 977 + 50) as v from documents)")
def ranged_casts(spark, sf_dir):
    """An integer as each narrower kind, null where it does not fit."""
    d = Q._table(spark, sf_dir, "documents").selectExpr("doc_id", "(doc_id % 7 - 3) * (doc_id * doc_id * 977 + 50) as v")
    return d.select("doc_id", *(binary.range_checked(F.col("v"), k).alias(n) for n, k in zip("abc", ("tinyint", "smallint", "int"), strict=True)), F.col("v").alias("d"))
