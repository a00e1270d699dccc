"""The plain format layer: containers built here, edited, damaged and read back."""

import random
import struct

import pytest

from kistwerk.formats import fixed as X
from kistwerk.formats import properties as P
from kistwerk.formats.container import Container, Limits, follow
from kistwerk.formats.embedded import detect, image_type, native_object
from kistwerk.formats.extract import Options, extract
from kistwerk.formats.paths import Problem, base_name, canonical, decode_segment, encode_segment, join, parent_of
from kistwerk.formats.writer import Draft, apply, build, commit, serialize, table_sectors


def native(payload, name="a.txt", source="c:/a", temp="t"):
    body = b"\2\0" + b"".join(s.encode() + b"\0" for s in (name, source, temp)) + struct.pack("<I", len(payload)) + payload
    return struct.pack("<I", len(body)) + body


def code(f, *a, **k):
    with pytest.raises(Problem) as e:
        f(*a, **k)
    return e.value.code


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("sizes", [[], [0], [3], [63, 64, 65], [4095, 4096, 4097], [1, 100_000, 500, 9000]])
def test_round_trip(version, sizes):
    streams = [(f"/D{k % 2}/S{k}", bytes([k + 1]) * n) for k, n in enumerate(sizes)]
    c = Container(build(streams, version), strict=True)
    assert c.header.major_version == version and {n.path for n in c.nodes.values() if n.type == "stream"} == {p for p, _ in streams}
    assert all(c.read(p.lower()) == d for p, d in streams) and len(c.content) % c.header.sector == 0


def test_large_stream_needs_difat():
    data = b"\xab" * (8 << 20)
    c = Container(build([("/Big", data)]), strict=True)
    assert c.header.difat_sectors > 0 and c.read("/Big") == data


def test_table_sectors_is_a_least_fixed_point():
    for n in (1, 126, 127, 128, 13_842, 13_843, 13_844, 50_000):
        fat, difat = table_sectors(n, 128)
        assert fat * 128 >= n + fat + difat and (fat == 1 or (fat - 1) * 128 < n + fat - 1 + difat) and difat == -(-max(0, fat - 109) // 127)


def test_paths():
    for p in ("/", "/A", "/Folder/Doc", "/A~1B", "/A~0B", "/A~1B/C~0D"):
        assert canonical(p) == p
    for p in ("", "A", "/A/", "/A//B", "/A~", "/A~2", "/" + "x" * 32, "/" + "/".join(["x" * 31] * 129)):
        assert code(canonical, p) == X.INVALID_ARGUMENT
    assert encode_segment("a/~b") == "a~1~0b" and decode_segment("a~1~0b") == "a/~b" and join("/A", " b/c ") == "/A/b~1c"
    assert parent_of("/A/B") == "/A" and parent_of("/A") == "/" and base_name("/A/b~1c") == "b/c"


def test_header_problems():
    good = bytearray(build([("/A", b"abc")]))
    for at, value, message in ((0, b"x", "signature"), (28, b"\0\0", "byte order"), (32, b"\7\0", "mini sector shift"), (56, b"\0\0\0\0", "cutoff"), (36, b"\1", "reserved"), (26, b"\5\0", "major version"), (30, b"\x0c\0", "512-byte"), (40, b"\1", "zero")):
        bad = bytearray(good)
        bad[at : at + len(value)] = value
        with pytest.raises(Problem, match=message) as e:
            Container(bytes(bad))
        assert e.value.code == X.BAD_HEADER
    assert code(Container, b"not-cfb") == X.BAD_HEADER and code(Container, bytes(good), limits=Limits(total_bytes=10)) == X.QUOTA_EXCEEDED


def test_strict_and_lenient():
    raw = bytearray(build([("/Docs/A", b"abc")]))
    raw[48:52] = struct.pack("<I", 99)
    assert code(Container, bytes(raw), strict=True) == X.OUT_OF_BOUNDS
    c = Container(bytes(raw))
    assert c.partial and [w.code for w in c.warnings] and list(c.nodes) == [0]
    raw = bytearray(build([("/Docs/A", b"abc")]))
    raw[76:80] = b"\xff\xff\xff\xff"
    assert code(Container, bytes(raw), strict=True) == X.BAD_HEADER and Container(bytes(raw)).partial


def test_chains():
    assert follow([1, X.END_OF_CHAIN], 0, 0) == [0, 1] and follow([], X.END_OF_CHAIN, 0) == []
    for table, start, most, want in (([1, 0], 0, 0, X.CYCLE_DETECTED), ([5], 0, 0, X.OUT_OF_BOUNDS), ([X.FREE], 0, 0, X.BAD_FAT_CHAIN), ([X.FAT_SECTOR], 0, 0, X.BAD_FAT_CHAIN), ([1, 2, X.END_OF_CHAIN], 0, 2, X.LIMIT_EXCEEDED), ([], 0, 0, X.BAD_FAT_CHAIN)):
        assert code(follow, table, start, most) == want


def test_walk_orders():
    c = Container(build([("/A/A1", b"1"), ("/B", b"2")]))
    assert [n.path for n in c.nodes.values()] == ["/", "/A", "/A/A1", "/B"]
    assert [c.nodes[i].path for i in c.breadth_first()] == ["/", "/A", "/B", "/A/A1"]
    assert [n.path for n in Container(build([("/zeta/s", b""), ("/Alpha/s", b""), ("/beta/s", b"")])).nodes.values()] == ["/", "/Alpha", "/Alpha/s", "/beta", "/beta/s", "/zeta", "/zeta/s"]


def test_extract_nested_and_depth():
    inner = build([("/InnerOLE", build([("/Blob", b"deep")]))])
    outer = build([("/Embedded", inner)])
    got = extract(outer)
    assert [(a.path, a.depth) for a in got.artifacts] == [("/Embedded", 0), ("/Embedded!/InnerOLE", 1), ("/Embedded!/InnerOLE!/Blob", 2)]
    assert [a.children for a in got.artifacts] == [1, 1, 0] and got.artifacts[1].parent_id == got.artifacts[0].id
    got = extract(outer, Options(max_depth=1, objects=False, unwrap=False))
    assert [a.path for a in got.artifacts] == ["/Embedded", "/Embedded!/InnerOLE"] and got.partial and got.warnings[-1].code == X.DEPTH_EXCEEDED
    assert [a.kind for a in got.artifacts] == ["ole_file", "ole_file"]


def test_extract_native_chain():
    c = build([("/\x01Ole10Native", native(native(build([("/Blob", b"x" * 5000)]))))])
    got = extract(c)
    assert [a.path for a in got.artifacts] == ["/\x01Ole10Native", "/\x01Ole10Native!$ole10native", "/\x01Ole10Native!$ole10native!$ole10native", "/\x01Ole10Native!$ole10native!$ole10native!/Blob"]
    assert [a.depth for a in got.artifacts] == [0, 1, 2, 3] and got.artifacts[1].ole_file_name == "a.txt" and got.artifacts[1].note.startswith("ole10native;file=a.txt;src=c:/a")


def test_extract_limits():
    c = build([("/A", b"same"), ("/B", b"same"), ("/C", b"other")])
    got = extract(c)
    assert len(got.artifacts) == 2 and got.dedup_hits == 1 and [a.id.rpartition("#")[2] for a in got.artifacts] == ["1", "3"]
    got = extract(c, Options(deduplicate=False, max_total_bytes=7))
    assert got.bytes_exported == 4 and got.partial and got.warnings[0].code == X.QUOTA_EXCEEDED
    got = extract(c, Options(max_artifacts=1))
    assert len(got.artifacts) == 1 and got.partial and got.warnings[0].code == X.LIMIT_EXCEEDED
    got = extract(c, Options(max_artifact_size=3))
    assert not got.artifacts and len(got.warnings) == 3
    assert code(extract, None) == X.NOT_FOUND and code(extract, b"bad") == X.BAD_HEADER


def test_failed_stream_is_not_partial():
    raw = bytearray(build([("/A", b"z" * 5000)]))
    c = Container(bytes(raw))
    entry = raw.find("A".encode("utf-16-le") + b"\0" * 62)
    raw[entry + 116 : entry + 120] = struct.pack("<I", c.header.first_dir)
    got = extract(bytes(raw))
    assert [a.status for a in got.artifacts] == ["failed"] and got.artifacts[0].id == "" and not got.partial and len(got.warnings) == 1


def test_detection():
    assert native_object(native(b"pay")).payload == b"pay" and native_object(b"\0" * 40) is None
    d = detect("/\x01Ole10Native", native(b"p"))
    assert (d.kind, d.confidence, d.file_name) == ("ole10native", 0.95, "a.txt") and detect("/\x01ole10native", b"").confidence == 0.5
    comp = bytes(28) + b"User Type\0CLIPFORMAT\0Word.Document\0"
    assert (detect("/\x01CompObj", comp).prog_id, detect("/compobj", b"").confidence) == ("Word.Document", 0.4)
    assert detect("/x/Package", b"").kind == "package" and detect("/x", b"PK\x03\x04..").confidence == 0.4 and detect("/x", b"text").kind == "unknown"
    for media, magic in X.IMAGE_MAGIC:
        assert image_type(magic + b"....") == media
    assert image_type(b"RIFF....WEBP") == "image/webp" and image_type(b"RIFF") == ""


def test_properties():
    s = P.PropertySet(X.SUMMARY)
    s.put(2, "Hello OLE")
    s.put(14, 42, X.VT_I4)
    s.put(16, True)
    s.put(7, "ansi", X.VT_LPSTR)
    s.put(12, P.from_filetime(132_000_000_000_000_000))
    s.put(9, 2**64 - 1, X.VT_UI8)
    s.properties[0x777] = P.Property(0x777, 0x1337, bytes.fromhex("DEADBEEF"))
    raw = P.marshal(P.PropertyStream(sets=[s, P.PropertySet(X.DOCUMENT_SUMMARY)]))
    back = P.parse(raw)
    got = back.find(X.SUMMARY).properties
    assert (got[2].value, got[14].value, got[16].value, got[7].value, got[9].value, got[12].value) == ("Hello OLE", 42, True, "ansi", 2**64 - 1, 132_000_000_000_000_000)
    assert got[0x777].value == bytes.fromhex("DEADBEEF") and P.marshal(back) == raw
    for vt, v in ((X.VT_I2, 40000), (X.VT_UI4, -1), (X.VT_UI8, -1), (X.VT_LPWSTR, 5), (X.VT_BOOL, b"")):
        with pytest.raises(P.PropertyError):
            P.marshal(P.PropertyStream(sets=[P.PropertySet(X.SUMMARY, {1: P.Property(1, vt, v)})]))
    with pytest.raises(P.PropertyError):
        P.parse(b"\0" * 40)


def test_edits():
    base = build([("/Docs/A", b"abc"), ("/Docs/B", b"x" * 5000)])
    ops = [{"op": "mkdir", "path": "/New"}, {"op": "rename", "path": "/docs/A", "new_path": "/New/C"}, {"op": "put", "path": "/Docs/D", "data": b"d"}, {"op": "delete", "path": "/docs/b"}]
    got = Container(apply(base, [{"new_path": None, "data": None, **o} for o in ops]).content, True)
    assert [n.path for n in got.nodes.values()] == ["/", "/Docs", "/Docs/D", "/New", "/New/C"] and got.read("/New/C") == b"abc"
    one = lambda **o: apply(base, [{"new_path": None, "data": None, **o}])
    assert code(one, op="put", path="/No/X") == X.NOT_FOUND and code(one, op="delete", path="/") == X.INVALID_ARGUMENT
    assert code(one, op="rename", path="/Docs/A", new_path="/docs/b") == X.CONFLICT and code(one, op="rename", path="/Docs", new_path="/Docs/X") == X.INVALID_ARGUMENT
    assert code(one, op="mkdir", path="/docs") == X.CONFLICT and code(one, op="put", path="/Docs") == X.CONFLICT
    assert Container(apply(None, []).content, True).nodes[0].entry.name == "Root Entry"


@pytest.mark.parametrize("version", [3, 4])
def test_in_place(version):
    base = build([("/A", b"a" * 100), ("/B", b"b" * 9000)], version)
    for path, n in (("/A", 100), ("/B", 9000)):
        d = Draft(Container(base, True))
        d.put(path, b"z" * n)
        done = commit(d, incremental=True)
        assert done.strategy == "incremental" and done.bytes_written == n and len(done.content) == len(base) and Container(done.content, True).read(path) == b"z" * n
        d = Draft(Container(base, True))
        d.put(path, b"z" * (n + 1))
        assert commit(d, incremental=True).strategy == "full_rewrite"
    assert commit(Draft(Container(base, True)), incremental=True).bytes_written == 0


def test_put_summary_keeps_other_sets():
    other = P.PropertySet(X.DOCUMENT_SUMMARY)
    other.put(2, "kept")
    first = P.PropertySet(X.SUMMARY)
    first.put(2, "old")
    path = X.SUMMARY_STREAMS[0]
    d = Draft(Container(build([(path, P.marshal(P.PropertyStream(sets=[first, other])))])))
    new = P.PropertySet()
    new.put(2, "new")
    d.put_summary(X.SUMMARY, new)
    got = P.parse(Container(serialize(d), True).read(path))
    assert [s.properties[2].value for s in got.sets] == ["new", "kept"]
    d = Draft(Container(build([(path, b"junk")])))
    assert code(d.put_summary, X.SUMMARY, new) == X.DIR_CORRUPT


def test_parsers_are_total():
    rng = random.Random(0)
    seeds = [build([("/Docs/A", b"abc"), ("/\x01Ole10Native", native(build([("/B", b"y" * 5000)])))]), build([("/X", b"q" * 9000)], 4)]
    for _ in range(1500):
        raw = bytearray(rng.choice(seeds))
        for _ in range(rng.randint(1, 12)):
            raw[rng.randrange(len(raw)) if rng.random() < 0.5 else rng.randrange(24, 512)] = rng.choice((0, 255, 254, rng.randrange(256)))
        raw = bytes(raw[: rng.choice((len(raw), rng.randrange(len(raw))))])
        try:
            got = extract(raw)
        except Problem:
            continue
        assert got.count("ok") + got.count("failed") == len(got.artifacts)
    s = P.PropertySet(X.SUMMARY)
    s.put(2, "Hello")
    s.put(7, "x", X.VT_LPSTR)
    raw0 = P.marshal(P.PropertyStream(sets=[s]))
    for _ in range(2000):
        raw = bytearray(raw0)
        for _ in range(rng.randint(1, 5)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            P.parse(bytes(raw))
        except P.PropertyError:
            pass


def test_deterministic():
    streams = [(f"/S{k:03}", bytes([k]) * 1024) for k in range(64)]
    assert build(streams) == build(streams[::-1]) and len(extract(build(streams), Options(deduplicate=False)).artifacts) == 64
