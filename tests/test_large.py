"""What only shows on payloads, containers or corpora beyond the sizes of the small tables."""

import json
import os
import pickle

import duckdb
import pytest
from pyspark.sql import Row

from kistwerk.formats.container import Container
from kistwerk.formats.extract import HEAD, Options, extract
from kistwerk.formats.paths import Problem
from kistwerk.formats.writer import build, build_file
from kistwerk.operators import containers as C
from kistwerk.plans import queries, queries_reports, registry  # noqa: F401
from kistwerk.sources import artifact_dir


def native(name: str, payload: bytes) -> bytes:
    body = b"\x02\0" + name.encode() + b"\0c:/x\0\0" + len(payload).to_bytes(4, "little") + payload
    return len(body).to_bytes(4, "little") + body


def test_names_of_a_native_object_longer_than_the_head():
    for n in (100, HEAD - 1, HEAD, HEAD + 1, 3 * HEAD):
        outer, inner = extract(build([("/\x01Ole10Native", native("a.txt", b"x" * n))]), Options()).artifacts
        assert (outer.ole_file_name, outer.ole_source_path, outer.children) == ("a.txt", "c:/x", 1)
        assert (inner.ole_file_name, inner.size) == ("a.txt", n)
    (broken,) = extract(build([("/\x01Ole10Native", b"\x01" * 2 * HEAD)]), Options()).artifacts
    assert (broken.ole_file_name, broken.note) == ("", "oleds:ole10native")


def test_empty_text_in_a_native_object(spark, tmp_path):
    """An empty text had no row of its own, and its object no child."""
    texts = [(1, "", "en", "s", 0), (2, "a", "fr", "s", 1), (3, "é" * HEAD, "de", "t", HEAD)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(db.execute(registry.ORACLES["ole10_unwrap"]).fetchall(), key=str)
    assert len(want) == 6 and rows(registry.QUERIES["ole10_unwrap"](spark, str(tmp_path))) == want
    (alone,) = extract(build([("/\x01Ole10Native", native("a.txt", b""))]), Options()).artifacts
    assert alone.children == 0


def streams(spark, most: int = 9000):
    """Streams of two containers, one of them with 300 streams, some in the mini stream, some with one path twice, and of one that can't be built."""
    rows = [("a", f"/x/{k}", bytes([k % 251]) * (k * 37 % most)) for k in range(300)] + [("a", "/X/7", b"last"), ("a", "/y/z/1", None), ("b", "/1", b"b" * 5000), ("c", "no path", b"c"), (None, "/1", b"n")]
    return spark.createDataFrame(rows, "path string, stream_path string, data binary").repartition(3)


def test_file_is_as_build(tmp_path):
    for sizes in ((), (0,), (1, 4095, 4096, 70000), tuple(range(0, 9000, 37))):
        for version in (3, 4):
            pairs = [(f"/S{k % 3}/{k}", bytes([k % 256]) * n) for k, n in enumerate(sizes)]
            with open(tmp_path / "file", "w+b") as out, open(tmp_path / "spool", "w+b") as spool:
                build_file(pairs, out, spool, version)
            assert (tmp_path / "file").read_bytes() == build(pairs, version)


def test_streams_out_of_order_and_mini_stream_in_pieces():
    raw = bytearray(build([(f"/{k}", bytes([k]) * 4000) for k in range(1, 5)]))
    c = Container(bytes(raw))
    assert isinstance(c.mini, memoryview)
    first, size = c.entries[0].start, 512
    a, b = first + 1, first + 3  # two sectors of the mini stream change places
    fat_at = (c.header.difat[0] + 1) * size
    for at, to in ((first, b), (b, first + 2), (first + 2, a), (a, first + 4)):
        raw[fat_at + 4 * at : fat_at + 4 * at + 4] = to.to_bytes(4, "little")
    swapped = raw[(a + 1) * size : (a + 2) * size], raw[(b + 1) * size : (b + 2) * size]
    raw[(b + 1) * size : (b + 2) * size], raw[(a + 1) * size : (a + 2) * size] = swapped
    d = Container(bytes(raw))
    assert isinstance(d.mini, bytes) and [d.read(f"/{k}") for k in range(1, 5)] == [bytes([k]) * 4000 for k in range(1, 5)]
    cut = Container(bytes(raw[: (first + 3) * size]))
    assert cut.partial


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_gathered_is_as_gather(spark):
    made = C.gather(streams(spark))
    assert rows(C.gathered_nodes(streams(spark))) == rows(C.nodes(made))
    options = Options(deduplicate=False)
    stats = rows(C.gathered_model_stats(streams(spark), options))
    assert stats == rows(C.model_stats(made, options)) and [s for s in stats if s[0] == "c"] == [("c", 0, 0, 1, 0, 0, 0, 0)]
    assert [s for s in stats if s[0] == "a"] == [("a", 301, 0, 0, 305, 301, 3, 3)]


def test_child_counts(spark):
    got = rows(C.child_counts(C.gathered_nodes(streams(spark))).select("path", "node_path", "children"))
    assert got == sorted([("a", "/", 2), ("a", "/X", 300), ("a", "/y", 1), ("a", "/y/z", 1), ("b", "/", 1), (None, "/", 1)], key=str)


@pytest.mark.parametrize("name", ["model_stats", "child_counts", "find_nodes"])
def test_no_record_holds_a_container(spark, name):
    """The containers of the sources were lists of all their streams, collected in one record."""
    assert "collect_list" not in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def sink_rows(n: int, at: int = 0):
    for k in range(at, at + n):
        yield Row(container=f"c{k % 7}", seq=k, id=f"i{k}", artifact_path="/A", kind="stream", status="ok", sha256="", ole_file_name='é"\n', ole_source_path="", ole_temp_path=None, relative_path=f"d{k % 3}/{k}", raw=b"x" * (k % 5))


def test_commit_holds_no_listing(tmp_path, monkeypatch):
    """A task's message named each artifact, and the commit held all of them."""
    monkeypatch.setattr(artifact_dir, "RUN_ROWS", 10)
    monkeypatch.setattr(artifact_dir, "OPEN_RUNS", 3)
    w = artifact_dir._Writer({"path": str(tmp_path / "out")})
    messages = [w.write(sink_rows(95, 95 * t)) for t in range(4)]
    monkeypatch.setattr(artifact_dir, "RUN_ROWS", 5000)
    messages.append(w.write(sink_rows(1000, 380)))
    assert len(pickle.dumps(messages[-1])) < 1000 and w.write(iter([])).rows == []
    w.commit([*messages, None])
    text = (tmp_path / "out/manifest.json").read_text()
    listed = json.loads(text)
    assert text == json.dumps(listed, indent=2) and os.listdir(tmp_path) == ["out"]
    want = sorted((r for r in sink_rows(1380)), key=lambda r: (r.container, r.seq))
    assert [a["id"] for a in listed["artifacts"]] == [r.id for r in want] and listed["skipped"] == 276 and listed["files_written"] == 1104
    assert [f["artifact_id"] for f in listed["files"]] == [r.id for r in want if r.raw] and listed["bytes_written"] == sum(len(r.raw) for r in want)
    assert all(os.path.getsize(f["file_path"]) == f["size"] for f in listed["files"])
    assert listed["artifacts"][0] == {"id": "i0", "path": "/A", "kind": "stream", "status": "ok", "size": 0, "ole_file_name": 'é"\n', "has_raw": False}
    assert list(artifact_dir._listed_files(str(tmp_path / "out/manifest.json"))) == listed["files"]


def test_commit_finds_equal_names_and_puts_back(tmp_path, monkeypatch):
    monkeypatch.setattr(artifact_dir, "RUN_ROWS", 2)
    out = tmp_path / "out"
    w = artifact_dir._Writer({"path": str(out)})
    with pytest.raises(Problem, match="one file name"):
        w.commit([w.write(sink_rows(5)), w.write(sink_rows(5))])
    assert not os.listdir(tmp_path)
    w.commit([w.write(sink_rows(9))])
    before = {p: p.read_bytes() for p in out.rglob("*") if p.is_file()}
    w = artifact_dir._Writer({"path": str(out)})
    with pytest.raises(Problem, match="exists"):
        w.commit([w.write(sink_rows(9))])
    w = artifact_dir._Writer({"path": str(out), "overwrite": "true"})
    with monkeypatch.context() as m:
        m.setattr(w, "_write_manifest", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            w.commit([w.write(Row(**{**r.asDict(), "raw": b"new"}) for r in sink_rows(12))])
    assert {p: p.read_bytes() for p in out.rglob("*") if p.is_file()} == before and os.listdir(tmp_path) == ["out"]


def test_manifest_is_read_item_by_item(spark, tmp_path):
    files = [{"artifact_id": f"i{k}", "artifact_path": "/A", "relative_path": f"{k}", "file_path": "é" * 300, "size": k} for k in range(2000)]
    for n, indent in ((0, 2), (1, None), (2000, 2), (2000, None)):
        (tmp_path / "m").write_text(json.dumps({"files_written": n, "files": files[:n], "artifacts": [{}]}, indent=indent))
        assert list(artifact_dir._listed_files(str(tmp_path / "m"))) == files[:n]
    assert [r.asDict() for r in artifact_dir.manifest_files(spark, str(tmp_path / "m")).collect()] == files
    (tmp_path / "m").write_text('{"files": [{"size": 1}')
    with pytest.raises(ValueError):
        list(artifact_dir._listed_files(str(tmp_path / "m")))
