"""Registered queries over containers made from the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kistwerk.formats import fixed as X
from kistwerk.formats.extract import Options
from kistwerk.functions import binary, names, paths
from kistwerk.operators import containers as C

from . import replay as R
from .options import ReplayOptions
from .registry import query

UNLIMITED = dict(max_artifacts=1 << 30, max_total_bytes=1 << 50, max_artifact_size=1 << 40)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one(path: str | Column, data: Column) -> Column:
    return F.array(F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), data.alias("data")))


def _doc_path() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".cfb"))


def doc_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for each document, its text in /Docs/A."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(_doc_path().alias("path"), C.cfb_build(_one("/Docs/A", F.encode("text", "UTF-8"))).alias("content"))


def source_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of a container for each source, its documents in /lang/doc_id."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("path"), F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("stream_path"), F.encode("text", "UTF-8").alias("data"))


def source_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gather(source_streams(spark, sf_dir))


def bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no containers: benchmark texts (short) and pages (long enough for a header)."""
    short = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bad/"), F.col("item_id").cast("string"), F.lit(".cfb")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    long = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".cfb")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return short.unionByName(long)


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(C.extract_reports(doc_containers(spark, sf_dir).unionByName(bad_files(spark, sf_dir))))


_BYTES = "octet_length(encode(text))"
_SIZE = f"""case when {_BYTES} >= 4096 then ceil({_BYTES} / 512.0) else ceil(ceil({_BYTES} / 64.0) * 64 / 512.0) end"""
_CONTAINER = f"cast(512 * (1 + n + ceil(n / 127.0)) as bigint) from (select *, {_SIZE} + case when {_BYTES} between 1 and 4095 then 1 else 0 end + 1 as n from documents)"


@query("extract_flat", f"select source || '/' || doc_id || '.cfb' as path, '/Docs/A' as artifact_path, sha256(text) as sha256, cast({_BYTES} as bigint) as size, 'stream' as kind, 'ok' as status from documents")
def extract_flat(spark, sf_dir):
    """Every document's payload, found again in its container."""
    return C.artifacts(C.extract_reports(doc_containers(spark, sf_dir))).select("path", "artifact_path", "sha256", "size", "kind", "status")


@query("container_size", f"select source || '/' || doc_id || '.cfb' as path, {_CONTAINER.replace('from (', 'as size from (', 1)}")
def container_size(spark, sf_dir):
    return doc_containers(spark, sf_dir).select("path", F.octet_length("content").cast("bigint").alias("size"))


_VISIT = f"""select source as path, '/' || lang || '/' || doc_id as artifact_path, sha256(text) as sha256, cast({_BYTES} as bigint) as size,
  row_number() over (partition by source order by '/' || lang || '/' || doc_id) - 1 as seq from documents"""
_FIRST = f"select * from (select *, row_number() over (partition by path, sha256 order by seq) as copy from ({_VISIT})) where copy = 1"


@query(
    "extract_stats_by_container",
    f"""select path, count(*) as artifacts_total, count(*) as artifacts_ok, cast(0 as bigint) as artifacts_failed, cast(any_value(n) - count(*) as bigint) as dedup_hits, cast(sum(size) as bigint) as bytes_exported
    from ({_FIRST}) join (select source as path, count(*) as n from documents group by source) using (path) group by path""",
)
def extract_stats_by_container(spark, sf_dir):
    stats = C.extract_stats(C.extract_reports(source_containers(spark, sf_dir), Options(**UNLIMITED)))
    longs = [F.col(c).cast("bigint").alias(c) for c in ("artifacts_total", "artifacts_ok", "artifacts_failed", "dedup_hits", "bytes_exported")]
    return stats.select("path", *longs)


def _flat(spark, sf_dir, **options) -> DataFrame:
    return C.artifacts(C.extract_reports(source_containers(spark, sf_dir), Options(**(UNLIMITED | options)))).select("path", "artifact_path", "sha256", "size")


_COLS = "path, artifact_path, sha256, size"


@query("dedup_artifacts", f"select {_COLS} from ({_FIRST})")
def dedup_artifacts(spark, sf_dir):
    return _flat(spark, sf_dir)


@query("dedup_artifacts_window", f"select {_COLS} from ({_FIRST})")
def dedup_artifacts_window(spark, sf_dir):
    """The same by a window over all artifacts."""
    return C.first_of_equal(C.artifacts(C.extract_reports(source_containers(spark, sf_dir), Options(deduplicate=False, **UNLIMITED)))).select("path", "artifact_path", "sha256", "size")


@query("artifact_count_limit", f"select {_COLS} from ({_VISIT}) where seq < 7")
def artifact_count_limit(spark, sf_dir):
    return _flat(spark, sf_dir, deduplicate=False, max_artifacts=7)


@query("artifact_byte_quota", f"select {_COLS} from (select *, sum(size) over (partition by path order by seq) as total from ({_VISIT})) where total <= 30000")
def artifact_byte_quota(spark, sf_dir):
    return _flat(spark, sf_dir, deduplicate=False, max_total_bytes=30000)


@query("artifact_byte_quota_window", f"select {_COLS} from (select *, sum(size) over (partition by path order by seq) as total from ({_VISIT})) where total <= 30000")
def artifact_byte_quota_window(spark, sf_dir):
    return C.within_bytes(C.artifacts(C.extract_reports(source_containers(spark, sf_dir), Options(deduplicate=False, **UNLIMITED))), 30000).select("path", "artifact_path", "sha256", "size")


@query("artifact_size_limit", f"select {_COLS} from ({_VISIT}) where size <= 2000")
def artifact_size_limit(spark, sf_dir):
    return _flat(spark, sf_dir, deduplicate=False, max_artifact_size=2000)


_TREE = """select source as path, node_path, type, depth, children,
  row_number() over (partition by source order by node_path) - 1 as dfs_index, row_number() over (partition by source order by depth, node_path) - 1 as bfs_index from (
  select source, '/' as node_path, 'root' as type, 0 as depth, count(distinct lang) as children from documents group by source
  union all select source, '/' || lang, 'storage', 1, count(*) from documents group by source, lang
  union all select source, '/' || lang || '/' || doc_id, 'stream', 2, 0 from documents)"""


@query("nodes_walk_dfs", f"select path, node_path, type, cast(depth as integer) as depth, cast(children as bigint) as children, cast(dfs_index as integer) as idx from ({_TREE})")
def nodes_walk_dfs(spark, sf_dir):
    return C.walk(C.nodes(source_containers(spark, sf_dir))).select("path", "node_path", "type", "depth", F.col("child_count").cast("bigint").alias("children"), F.col("index").alias("idx"))


@query("nodes_walk_bfs", f"select path, node_path, cast(bfs_index as integer) as idx from ({_TREE}) where depth between 1 and 1")
def nodes_walk_bfs(spark, sf_dir):
    """Breadth first, without the root, to depth 1: the index counts what is left out."""
    return C.walk(C.nodes(source_containers(spark, sf_dir)), breadth_first=True, max_depth=1, include_root=False).select("path", "node_path", F.col("index").alias("idx"))


@query("walk_result", f"select path, cast(count(*) as integer) as visited, cast(max(depth) as integer) as max_depth from ({_TREE}) group by path")
def walk_result(spark, sf_dir):
    return C.walk_result(C.walk(C.nodes(source_containers(spark, sf_dir))))


@query("child_counts", f"select path, node_path, cast(children as integer) as children from ({_TREE}) where children > 0")
def child_counts(spark, sf_dir):
    return C.child_counts(C.gathered_nodes(source_streams(spark, sf_dir))).select("path", "node_path", "children")


@query("subtree", f"select path, node_path from ({_TREE}) where node_path = '/de' or node_path like '/de/%'")
def subtree(spark, sf_dir):
    return C.subtree(C.nodes(source_containers(spark, sf_dir)), "/DE").select("path", "node_path")


@query("node_by_path", f"select path, node_path, type from ({_TREE}) where node_path = '/en'")
def node_by_path(spark, sf_dir):
    return C.node_by_path(C.nodes(source_containers(spark, sf_dir)), "/EN").select("path", "node_path", "type")


@query("read_stream", f"select source || '/' || doc_id || '.cfb' as path, sha256(text) as sha256 from documents")
def read_stream(spark, sf_dir):
    return doc_containers(spark, sf_dir).select("path", binary.sha256(C.cfb_read_stream("content", F.lit("/docs/a"))).alias("sha256"))


_RUN = "select true as success union all select true from documents"
_ALL = """select 'd' as kind, cast(null as varchar) as code from documents union all select 'b', 'BAD_HEADER' from benchmark union all select 'p', 'BAD_HEADER' from pages"""


@query(
    "replay_summary",
    f"""select count(*) as processed, count(*) filter (where code is null) as success, count(*) filter (where code is not null) as failed, cast(0 as bigint) as partial, cast(0 as bigint) as warning_files,
    cast(0 as bigint) as warnings_total, count(*) filter (where code is null) / count(*)::double as pass_rate from ({_ALL})""",
)
def replay_summary(spark, sf_dir):
    return R.summary(run_files(spark, sf_dir))


@query("error_code_hist", f"select code, count(*) as files from ({_ALL}) where code is not null group by code")
def error_code_hist(spark, sf_dir):
    return R.error_codes(run_files(spark, sf_dir))


@query(
    "header_error_message",
    """select 'bad/' || item_id || '.cfb' as path, case when octet_length(encode(text)) < 512 then 'file is smaller than CFB header' else 'invalid CFB signature' end as message from benchmark
    union all select 'page/' || page_id || '.cfb', case when octet_length(encode(html)) < 512 then 'file is smaller than CFB header' else 'invalid CFB signature' end from pages""",
)
def header_error_message(spark, sf_dir):
    return bad_files(spark, sf_dir).select("path", C.cfb_header_error("content").alias("message"))


# Scan filters over a listing of the documents

_LISTING = f"select source || '/' || case doc_id % 3 when 0 then 'a' else '' end || doc_id || case doc_id % 4 when 0 then '.CFB' when 1 then '.doc' when 2 then '.txt' else '' end as rel, cast({_BYTES} as bigint) as size from documents"


def listing(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    rel = F.concat("source", F.lit("/"), F.when(n % 3 == 0, "a").otherwise(""), n.cast("string"), F.when(n % 4 == 0, ".CFB").when(n % 4 == 1, ".doc").when(n % 4 == 2, ".txt").otherwise(""))
    docs = _table(spark, sf_dir, "documents")
    return docs.select(rel.alias("rel"), F.octet_length("text").cast("bigint").alias("size")).withColumn("path", F.concat(F.lit("/corpus/"), "rel"))


_EXT, _IN, _OUT = [".cfb", ".doc"], ["src1*/*", "src[2-5]/a?*"], ["*/*7.doc"]
_REASON = f"""select *, case when not regexp_full_match(lower(rel), '.*\\.(cfb|doc)') then 'ext'
  when not (regexp_full_match(rel, 'src1[^/]*/[^/]*') or regexp_full_match(rel, 'src[2-5]/a[^/][^/]*')) or regexp_full_match(rel, '[^/]*/[^/]*7\\.doc') then 'path'
  when not size between 300 and 5000 then 'size' end as reason from ({_LISTING})"""


def _reasoned(spark, sf_dir) -> DataFrame:
    return R.with_reason(listing(spark, sf_dir), _EXT, _IN, _OUT, 300, 5000)


@query("filter_reasons", f"select rel, size, coalesce(reason, 'matched') as reason from ({_REASON})")
def filter_reasons(spark, sf_dir):
    return _reasoned(spark, sf_dir).select("rel", "size", F.coalesce("reason", F.lit("matched")).alias("reason"))


@query("filter_ext", f"select rel from ({_LISTING}) where regexp_full_match(lower(rel), '.*\\.(cfb|doc)')")
def filter_ext(spark, sf_dir):
    return R.matched(R.with_reason(listing(spark, sf_dir), _EXT, [], [])).select("rel")


@query("filter_size", f"select rel from ({_LISTING}) where size between 300 and 5000")
def filter_size(spark, sf_dir):
    return R.matched(R.with_reason(listing(spark, sf_dir), [], [], [], 300, 5000)).select("rel")


@query(
    "filter_counters",
    f"""select count(*) as scanned_files, least(count(*) filter (where reason is null), 40) as matched_files, count(*) filter (where reason is null) as matched_files_total,
    greatest(count(*) filter (where reason is null) - 40, 0) as truncated_matches, count(*) filter (where reason = 'ext') as filtered_by_ext, count(*) filter (where reason = 'path') as filtered_by_path,
    count(*) filter (where reason = 'size') as filtered_by_size from ({_REASON})""",
)
def filter_counters(spark, sf_dir):
    return R.scan_counters(_reasoned(spark, sf_dir), 40)


@query("matched_capped", f"select rel from ({_REASON}) where reason is null order by rel limit 40")
def matched_capped(spark, sf_dir):
    """The stable order with a cap is the scan's own feature."""
    return R.matched(_reasoned(spark, sf_dir), 40).select("rel")


# Views over files whose states are derived from the documents

_FILES = f"""select source || '/' || doc_id || '.cfb' as path, cast({_BYTES} as bigint) as size, cast(doc_id % 97 as bigint) as duration_ms, doc_id % 5 <> 0 as success, doc_id % 5 <> 0 and doc_id % 7 = 0 as partial,
  cast(doc_id % 11 as integer) as artifacts_total, cast(doc_id % 3 as integer) as artifacts_failed, cast(case when doc_id % 5 <> 0 then doc_id % 4 else 0 end as integer) as warnings,
  case when doc_id % 5 = 0 then case doc_id % 3 when 0 then 'BAD_HEADER' when 1 then ' bad_fat_chain' else '' end end as error_code from documents"""


def state_files(spark, sf_dir, shift: int = 0) -> DataFrame:
    n = F.col("doc_id") + shift
    failed = n % 5 == 0
    return _table(spark, sf_dir, "documents").select(
        _doc_path().alias("path"), F.octet_length("text").cast("bigint").alias("size"), (F.col("doc_id") % 97).alias("duration_ms"), (~failed).alias("success"), (~failed & (n % 7 == 0)).alias("partial"),
        (n % 11).cast("int").alias("artifacts_total"), (n % 3).cast("int").alias("artifacts_failed"), F.when(~failed, n % 4).otherwise(0).cast("int").alias("warnings"),
        F.when(failed, F.when(n % 3 == 0, "BAD_HEADER").when(n % 3 == 1, " bad_fat_chain").otherwise("")).alias("error_code"),
    )


_WHERE = {
    "all": "true", "failed": "not success", "success": "success", "partial": "partial", "issues": "(not success or partial or warnings > 0)", "warnings": "warnings > 0",
    "clean": "(success and not partial and warnings = 0)", "none": "false",
}


def _view_query(policy: str):
    @query(f"view_{policy}", f"select path, size, success, partial, warnings from ({_FILES}) where {_WHERE[policy]}")
    def run(spark, sf_dir):
        return R.selected(state_files(spark, sf_dir), policy).select("path", "size", "success", "partial", "warnings")


for _policy in _WHERE:
    _view_query(_policy)

_CODE = "case when success then '' else coalesce(nullif(upper(trim(error_code)), ''), 'UNKNOWN') end"


@query("view_glob", f"select path from ({_FILES}) where not success and regexp_full_match(path, 'src[^/]/[^/]*\\.cfb') and not regexp_full_match(path, '[^/]*/[^/]*0\\.cfb')")
def view_glob(spark, sf_dir):
    return R.selected(state_files(spark, sf_dir), "failed", ["src?/*.cfb"], ["*/*0.cfb"]).select("path")


@query("view_code_patterns", f"select path, {_CODE} as code from ({_FILES}) where {_CODE} like 'BAD%' and {_CODE} <> 'BAD_HEADER'")
def view_code_patterns(spark, sf_dir):
    chosen = R.selected(state_files(spark, sf_dir), "all", codes=["BAD*"], not_codes=["BAD_HEADER"])
    return chosen.select("path", R.normal_code(F.col("error_code")).alias("code"))


_ORDER = {
    "path": "path, duration_ms", "duration-desc": "duration_ms desc, path", "size-desc": "size desc, path", "artifacts-desc": "artifacts_total desc, path",
    "artifacts-failed-desc": "artifacts_failed desc, path", "warnings-desc": "warnings desc, path", "error-code": "nullif(upper(trim(error_code)), '') nulls last, duration_ms desc, path",
    "failed-first": "success, partial desc, warnings desc, duration_ms desc, path",
}


def _sort_query(sort: str):
    sql = f"select path, cast(rank as integer) as rank from (select path, row_number() over (order by {_ORDER[sort]}) as rank from ({_FILES})) where rank between 11 and 60"

    @query(f"sort_{sort.replace('-', '_')}", sql)
    def run(spark, sf_dir):
        """A page of the sorted view: offset 10, limit 50."""
        shown = R.page(state_files(spark, sf_dir), sort, "duration-desc", 10, 50)
        return shown.withColumn("rank", (F.row_number().over(Window.orderBy(*R.sort_keys(sort, "duration-desc"))) + 10).cast("int")).select("path", "rank")


for _sort in _ORDER:
    _sort_query(_sort)

# Baseline: the run before lacks some documents and has others in another state

_BASE = _FILES.replace("doc_id % 5", "(doc_id + 1) % 5").replace("doc_id % 7", "(doc_id + 1) % 7").replace("doc_id % 11", "(doc_id + 1) % 11").replace("doc_id % 3", "(doc_id + 1) % 3").replace("doc_id % 4", "(doc_id + 1) % 4")


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    current, before = state_files(spark, sf_dir), state_files(spark, sf_dir, 1)
    return current.where("duration_ms <> 5"), before.where("duration_ms <> 8")


_STATE = "case when {0}.success then case when {0}.partial then 'success(partial)' else 'success' end else case when coalesce({0}.error_code, '') <> '' then 'failed:' || {0}.error_code else 'failed' end end"
_DIFF = f"(select * from ({_FILES}) where duration_ms <> 5) c full join (select * from ({_BASE}) where duration_ms <> 8) b on c.path = b.path"


@query(
    "baseline_counts",
    f"""select count(b.path) as baseline_files, count(c.path) as current_files, count(*) filter (where b.path is null) as new_files, count(*) filter (where c.path is null) as removed_files,
    count(*) filter (where b.success and not c.success) as newly_failed, count(*) filter (where not b.success and c.success) as fixed,
    count(*) filter (where not b.success and not c.success and coalesce(b.error_code, '') <> coalesce(c.error_code, '')) as error_code_changed,
    count(*) filter (where not b.partial and c.partial) as newly_partial from {_DIFF}""",
)
def baseline_counts(spark, sf_dir):
    return R.baseline_counts(R.compared(*_runs(spark, sf_dir)))


@query(
    "regressions",
    " union all ".join(
        f"select c.path as path, '{kind}' as kind, {_STATE.format('b')} as baseline, {_STATE.format('c')} as current from {_DIFF} where {cond}"
        for kind, cond in (
            ("new_failure", "b.success and not c.success"),
            ("error_code_changed", "not b.success and not c.success and coalesce(b.error_code, '') <> coalesce(c.error_code, '')"),
            ("became_partial", "not b.partial and c.partial"),
        )
    ),
)
def regressions(spark, sf_dir):
    return R.regressions(R.compared(*_runs(spark, sf_dir)))


_CODES = "select coalesce(nullif(upper(trim(error_code)), ''), 'UNKNOWN') as code, count(*) as n from ({0}) where not success and duration_ms <> {1} group by 1"
_DELTA = f"""select coalesce(c.code, b.code) as code, coalesce(b.n, 0) as baseline, coalesce(c.n, 0) as current, coalesce(c.n, 0) - coalesce(b.n, 0) as delta
  from ({_CODES.format(_FILES, 5)}) c full join ({_CODES.format(_BASE, 8)}) b on c.code = b.code"""


@query("code_delta", _DELTA)
def code_delta(spark, sf_dir):
    return R.code_delta(*_runs(spark, sf_dir))


@query("increased_codes", f"select code, delta from ({_DELTA}) where delta > 0")
def increased_codes(spark, sf_dir):
    changes = R.code_changes(R.code_delta(*_runs(spark, sf_dir)))
    return changes.select(F.explode("increased_error_codes").alias("code")).join(R.code_delta(*_runs(spark, sf_dir)), "code").select("code", "delta")


# Trend: a run for each day of events, the last day is the current run

_DAYS = """select strftime(ts, '%Y-%m-%d') as generated_at, count(*) as processed, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type = 'click') as partial,
  count(*) filter (where value > 50) as warnings, (count(*) - count(*) filter (where event_type = 'error')) / count(*)::double as pass_rate from events group by 1"""


def _days(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events")
    failed = F.count_if(F.col("event_type") == "error")
    days = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("generated_at")).agg(
        F.count("*").alias("processed"), failed.alias("failed"), F.count_if(F.col("event_type") == "click").alias("partial"), F.count_if(F.col("value") > 50).alias("warnings"),
        ((F.count("*") - failed) / F.count("*")).alias("pass_rate"),
    )
    days = days.withColumns({"when": F.to_timestamp("generated_at"), "report_path": F.concat(F.lit("run-"), "generated_at")})
    last = days.agg(F.max("generated_at").alias("last"))
    marked = days.crossJoin(F.broadcast(last))  # one row
    return marked.where("generated_at < last").drop("last"), marked.where("generated_at = last").drop("last")


_POINTS = f"""select *, row_number() over (order by generated_at) as pos from (select * from ({_DAYS}) order by generated_at desc limit 8)"""


@query("trend_points", f"select generated_at, processed, failed, partial, warnings, pass_rate, cast(pos as integer) as pos from ({_POINTS})")
def trend_points(spark, sf_dir):
    return R.trend_points(*_days(spark, sf_dir), limit=7).select("generated_at", "processed", "failed", "partial", "warnings", "pass_rate", "pos")


@query(
    "trend_delta",
    f"""select b.generated_at as from_generated_at, a.generated_at as to_generated_at, a.processed - b.processed as delta_processed, a.pass_rate - b.pass_rate as delta_pass_rate, a.failed - b.failed as delta_failed,
    a.partial - b.partial as delta_partial, a.warnings - b.warnings as delta_warnings from ({_POINTS}) a join ({_POINTS}) b on a.pos = b.pos + 1 where a.pos = (select max(pos) from ({_POINTS}))""",
)
def trend_delta(spark, sf_dir):
    return R.latest_delta(R.trend_points(*_days(spark, sf_dir), limit=7))


# Gates over the summary of the current run

_SUM = f"""select count(*) as processed, count(*) filter (where not success) as failed, count(*) filter (where success and partial) as partial, coalesce(sum(warnings) filter (where success), 0) as warnings,
  count(*) filter (where success) / count(*)::double as pass_rate, count(*) filter (where not success and error_code = 'BAD_HEADER') as bad from ({_FILES})"""


@query(
    "gates",
    f"""select gate, passed, message from (
    select 'min_pass_rate' as gate, pass_rate >= 0.9 as passed, case when pass_rate < 0.9 then printf('pass_rate %.6f < min_pass_rate %.6f', pass_rate, 0.9::double) end as message from ({_SUM})
    union all select 'max_failed', failed <= 0, case when failed > 0 then 'failed ' || failed || ' > max_failed 0' end from ({_SUM})
    union all select 'max_partial', partial <= 1000000, case when partial > 1000000 then 'x' end from ({_SUM})
    union all select 'max_warnings', warnings <= 3, case when warnings > 3 then 'warnings ' || warnings || ' > max_warnings 3' end from ({_SUM})
    union all select 'max_newly_failed', false, 'max_newly_failed gate requires baseline diff'
    union all select 'max_failed_increase', false, 'max_failed_increase gate requires trend latest delta'
    union all select 'deny_error_codes', bad = 0, case when bad > 0 then 'error_code BAD_HEADER present ' || bad || ' time(s)' end from ({_SUM}))""",
)
def gates(spark, sf_dir):
    files = state_files(spark, sf_dir)
    o = ReplayOptions(min_pass_rate=0.9, max_failed=0, max_partial=1000000, max_warnings=3, max_newly_failed=0, max_failed_increase=0, deny_error_codes=["BAD_HEADER"])
    codes = R.error_codes(files).agg(F.map_from_entries(F.collect_list(F.struct("code", "files"))).alias("error_codes"))
    none = {c: F.lit(None).cast("bigint") for c in ("newly_failed", "delta_failed")}
    facts = R.summary(files).crossJoin(F.broadcast(codes)).withColumns(none)  # one row each
    return R.gates(facts, o).select("gate", "passed", "message")


# Values

_MEDIA = "case doc_id % 8 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/gif' when 3 then 'image/gif' when 4 then 'image/bmp' when 5 then 'image/tiff' when 6 then 'image/tiff' else 'image/webp' end"


@query("image_media", f"select doc_id, {_MEDIA} as media from documents")
def image_media(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    magic = F.lit(None).cast("binary")
    heads = [m for _, m in X.IMAGE_MAGIC] + [b"RIFF0000WEBP"]
    for k, m in enumerate(heads):
        magic = F.when(F.col("doc_id") % 8 == k, F.expr(f"X'{m.hex()}'")).otherwise(magic)
    return docs.select("doc_id", binary.image_media(F.concat(magic, F.encode("text", "UTF-8"))).alias("media"))


@query(
    "path_functions",
    """select doc_id, '/' || replace(replace(name, '~', '~0'), '/', '~1') as path, name as base, '/' as parent, length(name) <= 31 as canonical
    from (select doc_id, lang || '/~' || doc_id || case when doc_id % 2 = 0 then '~0' else 'x' || repeat('y', (doc_id % 40)::int) end as name from documents)""",
)
def path_functions(spark, sf_dir):
    n = F.col("doc_id")
    name = F.concat("lang", F.lit("/~"), n.cast("string"), F.when(n % 2 == 0, "~0").otherwise(F.concat(F.lit("x"), F.repeat(F.lit("y"), (n % 40).cast("int")))))
    p = _table(spark, sf_dir, "documents").select("doc_id", paths.join_path(F.lit("/"), name).alias("path"))
    return p.select("doc_id", "path", paths.base_name(F.col("path")).alias("base"), paths.parent_path(F.col("path")).alias("parent"), paths.is_canonical(F.col("path")).alias("canonical"))


@query(
    "artifact_names",
    """select doc_id, printf('%06d', doc_id) || '_' || lang || '_x_' || doc_id || case doc_id % 3 when 0 then '.png' when 1 then '.txt' else '.ole' end as flat_name,
    'ole/' || lang || '/' || printf('%06d', doc_id) || '_x_' || doc_id || case doc_id % 3 when 0 then '.png' when 1 then '.txt' else '.ole' end as tree_name from documents""",
)
def artifact_names(spark, sf_dir):
    n = F.col("doc_id")
    args = n, F.concat(F.lit("/"), "lang", F.lit("/x "), n.cast("string")), F.when(n % 3 == 0, "image").when(n % 3 == 1, "stream").otherwise("ole_file"), F.when(n % 3 == 0, "image/png").otherwise(""), F.when(n % 3 == 1, "a.TXT").otherwise("")
    nested = args[0], F.concat(F.lit("!"), args[1]), *args[2:]
    return _table(spark, sf_dir, "documents").select("doc_id", names.flat_name(*args).alias("flat_name"), names.tree_name(*nested).alias("tree_name"))


@query(
    "properties_roundtrip",
    f"""select source || '/' || doc_id || '.cfb' as path, '{X.SUMMARY}' as format_id, cast(pid as bigint) as pid, vt, s as value_string, v as value_long from (
    select source, doc_id, 2 as pid, 31 as vt, lang as s, cast(null as bigint) as v from documents union all select source, doc_id, 3, 30, 'doc ' || doc_id, null from documents
    union all select source, doc_id, 14, 3, null, n_chars from documents union all select source, doc_id, 16, 20, null, doc_id from documents)""",
)
def properties_roundtrip(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")

    def prop(pid, vt, text=None, number=None):
        return F.struct(F.lit(pid).alias("pid"), F.lit(vt).alias("vt"), (F.lit(None) if text is None else text).cast("string").alias("value_string"), (F.lit(None) if number is None else number).cast("bigint").alias("value_long"))

    props = F.array(prop(2, X.VT_LPWSTR, F.col("lang")), prop(3, X.VT_LPSTR, F.concat(F.lit("doc "), F.col("doc_id").cast("string"))), prop(14, X.VT_I4, number=F.col("n_chars")), prop(16, X.VT_I8, number=F.col("doc_id")))
    made = docs.select(_doc_path().alias("path"), C.ole_properties_marshal(F.lit(X.SUMMARY), props).alias("data"))
    made = made.select("path", C.cfb_build(_one(X.SUMMARY_STREAMS[0], F.col("data"))).alias("content"))
    return C.summary_information(made).select("path", "format_id", "pid", "vt", "value_string", "value_long")


@query(
    "nested_extract",
    f"""select source || '/' || doc_id || '.cfb' as path, '/Embedded' as artifact_path, 'ole_object' as kind, 0 as depth, 1 as children, {_CONTAINER.replace('from (', 'as size, cast(null as varchar) as sha256 from (', 1)}
    union all select source || '/' || doc_id || '.cfb', '/Embedded!/Blob', 'stream', 1, 0, cast({_BYTES} as bigint), sha256(text) from documents""",
)
def nested_extract(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(_doc_path().alias("path"), C.cfb_build(_one("/Blob", F.encode("text", "UTF-8"))).alias("inner"))
    outer = docs.select("path", C.cfb_build(_one("/Embedded", F.col("inner"))).alias("content"))
    found = C.artifacts(C.extract_reports(outer, Options(**UNLIMITED)))
    return found.select("path", "artifact_path", "kind", "depth", "children", "size", F.when(F.col("depth") == 1, F.col("sha256")).alias("sha256"))


@query(
    "ole10_unwrap",
    f"""select source || '/' || doc_id || '.cfb' as path, artifact_path, depth, children, ole_file_name, size, note from (
    select source, doc_id, '/' || chr(1) || 'Ole10Native' as artifact_path, 0 as depth, 1 as children, doc_id || '.txt' as ole_file_name, cast({_BYTES} + 4 + 2 + length(doc_id || '.txt') + 1 + length('c:/' || lang) + 1 + 1 + 4 as bigint) as size,
      'oleds:ole10native' as note from documents
    union all select source, doc_id, '/' || chr(1) || 'Ole10Native!$ole10native', 1, 0, doc_id || '.txt', cast({_BYTES} as bigint), 'ole10native;file=' || doc_id || '.txt;src=c:/' || lang from documents)""",
)
def ole10_unwrap(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    made = docs.select(_doc_path().alias("path"), C.ole_native_build(name, F.concat(F.lit("c:/"), "lang"), F.encode("text", "UTF-8")).alias("data"))
    made = made.select("path", C.cfb_build(_one("/\x01Ole10Native", F.col("data"))).alias("content"))
    return C.artifacts(C.extract_reports(made, Options(empty_objects=True, **UNLIMITED))).select("path", "artifact_path", "depth", "children", "ole_file_name", "size", "note")


# Edits

_PATHS = "select source || '/' || doc_id || '.cfb' as path, node_path from documents, (select unnest({0}) as node_path)"


def _applied(spark, sf_dir, *operations: tuple[str, str, str]) -> DataFrame:
    data = F.encode("text", "UTF-8")
    ops = F.array(*(F.struct(F.lit(o).alias("op"), F.lit(p).alias("path"), F.lit(q).alias("new_path"), data.alias("data")) for o, p, q in operations))
    docs = _table(spark, sf_dir, "documents").select(_doc_path().alias("path"), C.cfb_build(_one("/Docs/A", data)).alias("content"), ops.alias("ops"))
    return docs.select("path", C.cfb_apply("content", "ops").alias("r"))


def _apply_query(name: str, operations: list[tuple[str, str, str]], left: list[str]):
    @query(f"cfb_apply_{name}", _PATHS.format(left))
    def run(spark, sf_dir):
        done = _applied(spark, sf_dir, *operations).select("path", F.col("r.content").alias("content"))
        return C.nodes(done).select("path", "node_path")


_apply_query("put", [("put", "/Docs/B", ""), ("put", "/a", "")], ["/", "/a", "/Docs", "/Docs/A", "/Docs/B"])
_apply_query("mkdir", [("mkdir", "/New", ""), ("mkdir", "/New/Sub", "")], ["/", "/Docs", "/Docs/A", "/New", "/New/Sub"])
_apply_query("delete", [("put", "/B", ""), ("delete", "/docs", "")], ["/", "/B"])
_apply_query("rename", [("rename", "/Docs", "/Texts")], ["/", "/Texts", "/Texts/A"])
_apply_query("conflict", [("put", "/B", ""), ("rename", "/B", "/docs")], ["/", "/Docs", "/Docs/A"])


@query("cfb_apply_errors", "select source || '/' || doc_id || '.cfb' as path, 'NOT_FOUND' as code, 'parent path not found' as message from documents")
def cfb_apply_errors(spark, sf_dir):
    return _applied(spark, sf_dir, ("put", "/Nowhere/X", "")).select("path", "r.error.code", "r.error.message")


@query("nodes_by_lateral", "select 'stream' as type, count(*) as n from documents union all select 'storage', count(*) from documents union all select 'root', count(*) from documents")
def nodes_by_lateral(spark, sf_dir):
    """The table function in SQL."""
    from kistwerk.operators.sql import register

    register(spark)
    return spark.sql("select n.type as type, count(*) as n from {c} c, lateral cfb_nodes(c.content) n group by n.type", c=doc_containers(spark, sf_dir))


@query(
    "cfb_apply_in_place",
    f"""select source || '/' || doc_id || '.cfb' as path, 'incremental' as strategy_used, cast({_BYTES} as bigint) as bytes_written, {_CONTAINER.replace('from (', "as size, sha256(regexp_replace(text, '[a-z]', 'x', 'g')) as sha256 from (", 1)}""",
)
def cfb_apply_in_place(spark, sf_dir):
    """A stream replaced by one of its size: its sectors alone are rewritten."""
    data = F.encode("text", "UTF-8")
    same_size = F.encode(F.regexp_replace("text", "[a-z]", "x"), "UTF-8")
    ops = F.array(F.struct(F.lit("put").alias("op"), F.lit("/Docs/A").alias("path"), F.lit("").alias("new_path"), same_size.alias("data")))
    docs = _table(spark, sf_dir, "documents").select(_doc_path().alias("path"), C.cfb_build(_one("/Docs/A", data)).alias("content"), ops.alias("ops"))
    done = docs.select("path", C.cfb_apply_in_place("content", "ops").alias("r")).select("path", "r.*")
    read = binary.sha256(C.cfb_read_stream("content", F.lit("/Docs/A")))
    return done.select("path", "strategy_used", "bytes_written", F.octet_length("content").cast("bigint").alias("size"), read.alias("sha256"))


@query(
    "cfb_put_summary",
    f"""select source || '/' || doc_id || '.cfb' as path, cast(set_index as integer) as set_index, format_id, cast(2 as bigint) as pid, s as value_string from (
    select source, doc_id, 0 as set_index, '{X.SUMMARY}' as format_id, 'new ' || doc_id as s from documents)""",
)
def cfb_put_summary(spark, sf_dir):
    """The summary's set replaced as a whole."""
    docs = _table(spark, sf_dir, "documents")

    def title(text: Column) -> Column:
        prop = F.struct(F.lit(2).alias("pid"), F.lit(X.VT_LPWSTR).alias("vt"), text.alias("value_string"), F.lit(None).cast("bigint").alias("value_long"))
        return C.ole_properties_marshal(F.lit(X.SUMMARY), F.array(prop))

    made = docs.select(_doc_path().alias("path"), title(F.col("lang")).alias("old"), title(F.concat(F.lit("new "), F.col("doc_id").cast("string"))).alias("new"))
    made = made.select("path", "new", C.cfb_build(_one(X.SUMMARY_STREAMS[0], F.col("old"))).alias("content"))
    done = made.select("path", C.cfb_put_summary("content", F.lit(X.SUMMARY), "new").alias("r")).select("path", "r.content")
    return C.summary_information(done).select("path", "set_index", "format_id", "pid", "value_string")


@query("manifest_totals", f"select count(*) as files_written, cast(sum({_BYTES}) as bigint) as bytes_written, cast(0 as bigint) as skipped from documents")
def manifest_totals(spark, sf_dir):
    from kistwerk.sources.artifact_dir import manifest_totals, planned

    return manifest_totals(planned(C.artifacts(C.extract_reports(doc_containers(spark, sf_dir), Options(include_raw=True)))))


@query(
    "embedded_kinds",
    """select doc_id, case doc_id % 4 when 0 then 'package' when 1 then 'ole10native' when 2 then 'compobj' else 'unknown' end as kind,
    cast(case doc_id % 4 when 0 then 0.9 when 1 then 0.5 when 2 then 0.85 else 0.0 end as double) as confidence, case when doc_id % 4 = 2 then 'Doc.' || lang else '' end as prog_id from documents""",
)
def embedded_kinds(spark, sf_dir):
    """Detection by stream name, then by content."""
    n = F.col("doc_id") % 4
    path = F.when(n == 0, "/x/Package").when(n == 1, "/\x01Ole10Native").when(n == 2, "/\x01CompObj").otherwise("/Text")
    strings = F.concat(F.lit("User\0CLIP\0Doc."), "lang", F.lit("\0"))
    data = F.when(n == 2, F.concat(F.expr(f"X'{'00' * 28}'"), F.encode(strings, "UTF-8"))).otherwise(F.encode("lang", "UTF-8"))
    found = _table(spark, sf_dir, "documents").select("doc_id", C.ole_detect(path, data).alias("d"))
    return found.select("doc_id", "d.kind", "d.confidence", "d.prog_id")


@query(
    "filetimes",
    """select event_id, cast((epoch_us(ts) + 11644473600000000) * 10 as varchar) as ticks, epoch_us(ts) as back from events""",
)
def filetimes(spark, sf_dir):
    """Timestamps to ticks of 100 ns since 1601, and back."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    ticks = binary.timestamp_to_filetime(F.col("t"))
    return e.select("event_id", ticks.cast("string").alias("ticks"), F.unix_micros(binary.filetime_to_timestamp(ticks)).alias("back"))


@query(
    "guids",
    """select doc_id, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as guid
    from (select doc_id, md5(text) as h from documents)""",
)
def guids(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", binary.guid_text(F.unhex(F.md5("text"))).alias("guid"))


@query("extract_images", f"select source || '/' || doc_id || '.cfb' as path, 'image' as kind, {_MEDIA} as media_type from documents")
def extract_images(spark, sf_dir):
    """Images are recognised by their first bytes inside containers."""
    docs = _table(spark, sf_dir, "documents")
    data = F.lit(None).cast("binary")
    for k, m in enumerate([m for _, m in X.IMAGE_MAGIC] + [b"RIFF0000WEBP"]):
        data = F.when(F.col("doc_id") % 8 == k, F.expr(f"X'{m.hex()}'")).otherwise(data)
    made = docs.select(_doc_path().alias("path"), C.cfb_build(_one("/Image", F.concat(data, F.encode("text", "UTF-8")))).alias("content"))
    return C.artifacts(C.extract_reports(made)).select("path", "kind", "media_type")


@query(
    "latest_report",
    f"select generated_at, processed from ({_DAYS}) where generated_at < (select max(generated_at) from ({_DAYS})) order by generated_at desc limit 1",
)
def latest_report(spark, sf_dir):
    return R.latest_report(_days(spark, sf_dir)[0]).select("generated_at", "processed")


@query(
    "trend_pruned",
    f"select generated_at from ({_DAYS}) where generated_at < (select max(generated_at) from ({_DAYS})) order by generated_at limit greatest(0, (select count(*) - 1 - 5 from ({_DAYS})))",
)
def trend_pruned(spark, sf_dir):
    """Reports that go when five are kept."""
    return R.to_prune(_days(spark, sf_dir)[0], 5).select("generated_at")
