"""DataFrame layer: replays over real directories, literal rows, sinks, streams, and every query against its SQL."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kistwerk import cli
from kistwerk.formats.paths import Problem
from kistwerk.formats.writer import build
from kistwerk.functions.globs import glob_regex
from kistwerk.operators import containers as C
from kistwerk.plans import queries, queries_reports, registry  # noqa: F401
from kistwerk.plans import replay as R
from kistwerk.plans.options import OptionError, ReplayOptions
from kistwerk.plans.report import GateError, replay
from kistwerk.sources import artifact_dir
from kistwerk.sources.corpus_files import list_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for rel, data in {"ok/sample.cfb": build([("/Docs/A", b"abc")]), "ok/.hidden.cfb": build([("/A", b"one"), ("/B", b"two")]), "bad/broken.doc": b"not-cfb", "bad/note.txt": b"text", "_x.CFB": build([("/Image1", b"\x89PNG\r\n\x1a\n")])}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(data)
    (root / "link.cfb").symlink_to(root / "ok/sample.cfb")
    return root


def test_listing_has_hidden_files_and_no_links(spark, corpus):
    assert sorted(r.rel for r in list_files(spark, str(corpus)).collect()) == ["_x.CFB", "bad/broken.doc", "bad/note.txt", "ok/.hidden.cfb", "ok/sample.cfb"]


def test_replay(spark, corpus):
    got = replay(spark, ReplayOptions(root=str(corpus)))
    s = got["summary"]
    assert (s["scanned_files"], s["matched_files"], s["filtered_by_ext"], s["processed"], s["success"], s["failed"], s["pass_rate"]) == (5, 4, 1, 4, 3, 1, 0.75)
    assert s["error_codes"] == {"BAD_HEADER": 1} and [os.path.basename(f["path"]) for f in got["files"]] == ["_x.CFB", "broken.doc", ".hidden.cfb", "sample.cfb"]
    got = replay(spark, ReplayOptions(root=str(corpus), max_artifact_size=1, report_files="partial", report_include_glob=["ok/*"], include_glob=["ok/*.cfb"]))
    assert got["summary"]["partial"] == 2 and got["summary"]["filtered_by_path"] == 2 and len(got["files"]) == 2


def test_scan_counters(spark, tmp_path):
    for rel, n in {"a.txt": 1, "drop/b.cfb": 9, "keep/small.cfb": 1, "keep/big.cfb": 9}.items():
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_bytes(b"x" * n)
    s = replay(spark, ReplayOptions(root=str(tmp_path), ext=["cfb"], include_glob=["keep/*.cfb"], min_file_size_bytes=2))["summary"]
    assert [s[k] for k in ("scanned_files", "matched_files", "filtered_by_ext", "filtered_by_path", "filtered_by_size")] == [4, 1, 1, 1, 1]


def test_baseline_trend_and_gates(spark, corpus, tmp_path):
    trend, first = str(tmp_path / "trend"), str(tmp_path / "first.json")
    replay(spark, ReplayOptions(root=str(corpus), output=first, trend_dir=trend, save_trend=True, save_trend_name="one", run_id="r1"))
    (corpus / "ok/sample.cfb").write_bytes(b"bad")
    (corpus / "new.ole").write_bytes(build([]))
    with pytest.raises(GateError, match="^gate failed: failed 2 > max_failed 0; newly_failed 1 > max_newly_failed 0; pass_rate_drop 0.150000 > max_pass_rate_drop 0.000000; failed_increase 1 > max_failed_increase 0; error_code BAD_HEADER present 2 time") as e:
        replay(spark, ReplayOptions(root=str(corpus), baseline=first, trend_dir=trend, save_trend=True, max_failed=0, max_newly_failed=0, max_pass_rate_drop=0, max_failed_increase=0, deny_error_codes=["bad_header"], max_new_files=1))
    got = e.value.report
    b = got["baseline"]
    assert [b.get(k, 0) for k in ("new_files", "removed_files", "newly_failed", "fixed", "newly_partial")] == [1, 0, 1, 0, 0] and b["error_code_delta"] == {"BAD_HEADER": 1}
    assert [(r["kind"], r["baseline"], r["current"]) for r in b["regressions"]] == [("new_failure", "success", "failed:BAD_HEADER")]
    assert len(got["trend"]["points"]) == 2 and got["trend"]["points"][0]["run_id"] == "r1" and got["trend"]["latest_delta"]["delta_failed"] == 1
    assert len(os.listdir(trend)) == 2  # saved even though gates fail
    (tmp_path / "trend" / "junk.json").write_text("[1]")
    (tmp_path / "trend" / "bare.json").write_text("{}")
    got = replay(spark, ReplayOptions(root=str(corpus), baseline_latest=True, trend_dir=trend, save_trend=True, save_trend_name="third", save_trend_prune=True, trend_limit=2))
    assert "third.json" in os.listdir(trend) and len(glob.glob(f"{trend}/*.json")) == 3  # two reports and what is none
    fresh = replay(spark, ReplayOptions(root=str(corpus), trend_dir=str(tmp_path / "none")))
    assert len(fresh["trend"]["points"]) == 1 and "latest_delta" not in fresh["trend"]


def test_cli(spark, corpus, tmp_path, capsys):
    out = str(tmp_path / "r" / "out.json")
    assert cli.main(["--root", str(corpus), "--output", out, "--report-files", "failed", "--max-failed", "5"]) == 0
    assert len(json.load(open(out))["files"]) == 1
    assert cli.main(["--root", str(corpus), "--max-failed", "0"]) == 1 and "failed 1 > max_failed 0" in capsys.readouterr().err
    assert cli.main(["--root", str(corpus), "--max-new-files", "0"]) == 1


@pytest.mark.parametrize("bad", [dict(baseline_latest=True), dict(baseline="b", baseline_latest=True, trend_dir="t"), dict(max_new_files=0), dict(max_failed_increase=0), dict(save_trend=True), dict(trend_dir="t", save_trend_prune=True), dict(min_pass_rate=1.5), dict(report_limit=-2), dict(report_offset=-1), dict(mode="x"), dict(min_file_size_bytes=5, max_file_size_bytes=4), dict(include_glob=["[a"])])
def test_option_rules(bad):
    with pytest.raises(OptionError):
        ReplayOptions(**bad).validate()


FILES = "path string, size long, duration_ms long, success boolean, partial boolean, artifacts_total int, artifacts_ok int, artifacts_failed int, warnings int, error_code string, error_message string"


def rows(spark, **values):
    base = dict(size=0, duration_ms=0, success=True, partial=False, artifacts_total=0, artifacts_ok=0, artifacts_failed=0, warnings=0, error_code=None, error_message=None)
    return spark.createDataFrame([{"path": p, **base, **v} for p, v in values.items()], FILES)


def order(df, sort, **k):
    return [r.path for r in R.page(df, sort, **k).collect()]


def test_sorts(spark):
    assert order(rows(spark, a=dict(duration_ms=10), c=dict(duration_ms=30), b=dict(duration_ms=20)), "duration-desc", limit=2) == ["c", "b"]
    f = rows(spark, ok={}, partial=dict(partial=True), bad1=dict(success=False, duration_ms=2), bad2=dict(success=False, duration_ms=8))
    assert order(f, "failed-first") == ["bad2", "bad1", "partial", "ok"]
    for sort, c in (("size-desc", "size"), ("artifacts-desc", "artifacts_total"), ("artifacts-failed-desc", "artifacts_failed"), ("warnings-desc", "warnings")):
        assert order(rows(spark, a={c: 2}, c={c: 1}, b={c: 2}), sort) == ["a", "b", "c"]
    codes = rows(spark, ok={}, z1=dict(error_code="ZZZ"), a2=dict(error_code="aaa"), a1=dict(error_code="AAA"))
    assert order(codes, "error-code") == ["a1", "a2", "z1", "ok"]
    ties = rows(spark, b=dict(error_code="AAA", duration_ms=10), a=dict(error_code="AAA", duration_ms=20), c=dict(error_code="BBB", duration_ms=5))
    assert order(ties, "error-code", tie_breaker="duration-desc") == ["a", "b", "c"] and order(ties, "path", offset=9) == [] and order(ties, "path", limit=0) == []


def test_globs(spark):
    cases = [("*", "a/b", False), ("*/*", "a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("\\*", "*", True), ("a.b", "axb", False), ("*.cfb", "x.cfb", True)]
    import re

    for pattern, text, want in cases:
        assert bool(re.search(glob_regex(pattern), text)) == want
        assert spark.range(1).select(R.matches_any(F.lit(text), [pattern]).alias("m")).first().m == want
    for bad in ("[", "a[", "[]a]", "[a-]", "\\"):
        with pytest.raises(ValueError):
            glob_regex(bad)


def test_sink(spark, tmp_path):
    made = spark.createDataFrame([("c", [("/Docs/A", bytearray(b"aaa")), ("/Embedded", bytearray(build([("/Blob", b"bbb")])))])], "path string, s array<struct<path:string,data:binary>>").select("path", C.cfb_build("s").alias("content"))
    found = C.artifacts(C.extract_reports(made, C.Options(include_raw=True)))
    out = str(tmp_path / "out")
    artifact_dir.write(found, out, tree=True)
    listed = json.load(open(f"{out}/manifest.json"))
    assert listed["files_written"] == 3 and sorted(f["relative_path"] for f in listed["files"]) == ["000001_Embedded.oleobj", "Docs/000000_A.bin", "Embedded/ole/000002_Blob.bin"]
    assert open(f"{out}/Embedded/ole/000002_Blob.bin", "rb").read() == b"bbb" and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="exists"):
        artifact_dir.write(found, out, tree=True)
    artifact_dir.write(found, out, tree=True, overwrite=True)
    totals = artifact_dir.manifest_totals(artifact_dir.planned(found)).first()
    assert totals.files_written == 3 and totals.skipped == 0
    with pytest.raises(Problem):
        artifact_dir.write(found, out, manifest_file="../bad.json")


def test_streaming(spark, corpus, tmp_path):
    from kistwerk.streaming.landing import arriving, arriving_artifacts

    out = arriving_artifacts(arriving(spark, str(corpus / "ok")))
    q = out.writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("landed").count() >= 1


def test_sql_functions(spark):
    from kistwerk.operators.sql import register

    register(spark)
    made = spark.sql("select cfb_build(array(named_struct('path', '/A', 'data', cast('hi' as binary)))) as content")
    got = spark.sql("select a.artifact_path, a.size, decode(cfb_read_stream(c.content, '/A'), 'UTF-8') as t from {c} c, lateral cfb_extract(c.content, false) a", c=made).first()
    assert tuple(got) == ("/A", 2, "hi")
    assert spark.sql("select ole_detect('/package', cast('' as binary)).kind as k").first().k == "package"


def test_entry_without_the_optional_subpackage():
    import subprocess
    import sys

    script = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("kistwerk.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "extract_flat" in names and "op1_sharding" not in names and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
