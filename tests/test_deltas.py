"""Golden traces, round trips and broken patches."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaloom import cli
from deltaloom.functions import bytesops as b
from deltaloom.operators import block_index, codec, controls, cover, patchfile, scan, synth
from deltaloom.operators.chunking import chunks
from deltaloom.plans import deltas
from deltaloom.schema import DiffOptions, PatchDecodeError, WrongMagic, WrongVersion
from deltaloom.sources import versions
from deltaloom.streaming.versions import write_patches

O64, O96, O128 = (bytes(range(n)) for n in (64, 96, 128))
CHANGED = O96[:40] + b"\xc8" + O96[41:]
PUT_IN = O96[:48] + bytes.fromhex("C8C9CACB") + O96[48:]
TRACES = {
    "same": (O64, O64, [(0, 0, 64, 64)], ["81010000"]),
    "new": (b"", b"ABCDEFGHIJ", [(0, 0, 0, 10)], ["01144142434445464748494a00"]),
    "append": (O64, O64 + b"XYZ", [(0, 0, 64, 67)], ["81010658595a00"]),
    "change": (O96, CHANGED, [(0, 0, 96, 96)], ["c001" + "00" * 40 + "a0" + "00" * 55 + "0000"]),
    "insert": (O96, PUT_IN, [(0, 0, 48, 52), (48, 52, 48, 100)], ["6108c8c9cacb00", "610000"]),
    "empty": (O64, b"", [], []),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, old binary, new binary")


def test_golden_traces(spark):
    pairs = frame(spark, [(k, bytearray(o), bytearray(n)) for k, (o, n, _, _) in TRACES.items()])
    found = deltas.matches(pairs, DiffOptions(32, None)).cache()
    codes = codec.encode_controls(controls.controls(found)).collect()
    for key, (_, _, matches, stream) in TRACES.items():
        own = sorted((r for r in found.collect() if r.pair_id == key), key=lambda r: r.seq)
        assert [(r.add_old_start, r.add_new_start, r.add_length, r.copy_end) for r in own] == matches, key
        assert [bytes(r.code).hex() for r in sorted((c for c in codes if c.pair_id == key), key=lambda c: c.seq)] == stream


def test_each_chunk_starts_anew(spark):
    found = deltas.matches(frame(spark, [("f", bytearray(O128), bytearray(O128))]), DiffOptions(32, 64))
    rows = [tuple(r)[1:7] for r in found.orderBy("chunk_idx", "seq").collect()]
    assert rows == [(0, 0, 0, 0, 64, 64), (1, 0, 0, 0, 0, 0), (1, 1, 64, 0, 64, 64)]


@pytest.mark.parametrize("mode", ["exact", "relational"])
@pytest.mark.parametrize("options", [DiffOptions(4, None), DiffOptions(5, 7), DiffOptions(32, 33)])
def test_round_trips(spark, mode, options):
    rng = np.random.default_rng(5)
    rows = [(k, bytearray(o), bytearray(n)) for k, (o, n, _, _) in TRACES.items()]
    for i in range(60):
        old = rng.integers(0, 3 if i % 2 else 256, rng.integers(1, 300), dtype=np.uint8).tobytes()
        rows.append((str(i), bytearray(old), bytearray(synth.run_script(old, rng.bytes(24)))))
    pairs = frame(spark, rows)
    report = deltas.cycle(pairs, options, mode).collect()
    assert len(report) == len(rows) and all(r.ok for r in report)
    parts = chunks(pairs, options.chunk_size)
    assert cover.untiled(deltas.matches(pairs, options, mode), parts).count() == 0
    assert patchfile.broken(patchfile.parse(deltas.diff(pairs, options, mode))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.binary(max_size=40), st.sampled_from([4, 5, 31, 32, 33]))
def test_scan_tiles_and_rebuilds(old, script, block):
    new = synth.run_script(old, script)
    o, n = b.as_array(old), b.as_array(new)
    at, of = block_index.Index(o, block).probe(n)
    end, out = 0, b""
    for old_start, start, length, stop in scan.scan_chunk(o, n, at, of, block):
        assert start == end and stop >= start + length and old_start + length <= len(old)
        delta = n[start : start + length] - o[old_start : old_start + length]
        out += (delta + o[old_start : old_start + length]).tobytes() + new[start + length : stop]
        end = stop
    assert out == new and end == len(new)


def matches_byte_by_byte(old, new, block):
    """The scan as it is defined: each place is looked up, and all counts are made anew."""
    index = {}
    for i in range(0, len(old) - block + 1, block):
        index.setdefault(old[i : i + block], i)

    def looked_up(place):
        start = index.get(new[place : place + block]) if place + block <= len(new) else None
        if start is None:
            return 0, 0
        return start, b.prefix_of(b.as_array(old[start:]), b.as_array(new[place:]))

    def agree(i, shift):
        return 0 <= i + shift < len(old) and old[i + shift] == new[i]

    def best(gains):
        sums = [sum(gains[:k]) for k in range(len(gains) + 1)]
        return sums.index(max(sums))

    out, from_old, from_new, shift, place, length, start = [], 0, 0, 0, 0, 0, 0
    while place < len(new):
        place += length
        reach = place
        for at in range(place, len(new)):
            start, length = looked_up(at)
            reach = max(reach, at + length)
            kept = sum(agree(i, shift) for i in range(at, reach))
            if length > kept + 8 or length == kept > 0:
                place = at
                break
        else:
            place, kept = len(new), None
        if kept == length:
            continue
        votes = [1 if old[from_old + i] == new[from_new + i] else -1 for i in range(min(place - from_new, len(old) - from_old))]
        ahead, back = best(votes), 0
        if place < len(new):
            back = best([1 if old[start - i] == new[place - i] else -1 for i in range(1, min(place - from_new, start) + 1)])
        both = from_new + ahead - (place - back)
        if both > 0:
            shared = range(place - back, place - back + both)
            cut = best([agree(i, from_old - from_new) - agree(i, start - place) for i in shared])
            ahead, back = ahead - both + cut, back - cut
        out.append((from_old, from_new, ahead, place - back))
        from_new, from_old, shift = place - back, start - back, start - place
    return out


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=90), st.binary(max_size=30), st.sampled_from([4, 5, 8, 32]), st.booleans())
def test_scan_is_the_one_byte_by_byte(old, script, block, few):
    old = bytes(x % 3 for x in old) if few else old
    new = synth.run_script(old, script) if old else script
    index = block_index.Index(b.as_array(old), block)
    found = list(scan.scan_chunk(b.as_array(old), b.as_array(new), *index.probe(b.as_array(new)), block))
    assert found == matches_byte_by_byte(old, new, block)


def test_versions_of_one_byte(spark):
    rows = [("a", bytearray(b"\0" * 300_000), bytearray(b"\0" * 300_001)), ("b", bytearray(b"\0" * 1000), bytearray(b"\0" * 10 + b"\1" + b"\0" * 5000))]
    for options in (DiffOptions(32, None), DiffOptions(32, 1 << 10), DiffOptions(4, None, 22)):
        assert all(r.ok for r in deltas.cycle(frame(spark, rows), options).collect())


def test_spans_of_chunks(spark, monkeypatch):
    from deltaloom.operators import chunking

    monkeypatch.setattr(chunking, "TOGETHER", 70)
    monkeypatch.setattr(codec, "TOGETHER", 70)
    pairs = frame(spark, [("a", bytearray(O128), bytearray(PUT_IN * 5)), ("b", bytearray(b""), bytearray(b""))])
    for options in (DiffOptions(8, 33), DiffOptions(8, 100)):
        report = {r.pair_id: r for r in deltas.cycle(pairs, options).collect()}
        assert report["a"].ok and report["b"].ok
        assert report["a"].patch_size == len(deltas.diff(pairs, options).where("pair_id = 'a'").first().patch)
    whole = deltas.rebased(deltas.matches(pairs, DiffOptions(8, 33)), chunks(pairs, 33)).orderBy("chunk_idx", "seq").collect()
    assert whole[0].add_new_start == 0 and whole[-1].copy_end == 500
    assert all(x.copy_end == y.add_new_start for x, y in zip(whole, whole[1:], strict=False))


def test_repeated_and_null_ids(spark):
    pairs = frame(spark, [("a", bytearray(O64), bytearray(O96)), ("a", bytearray(O96), bytearray(O64))])
    with pytest.raises(Exception, match="repeated pair_id"):
        deltas.diff(pairs).collect()
    assert deltas.diff(frame(spark, [(None, bytearray(O64), bytearray(O96))])).count() == 0


@pytest.mark.parametrize(
    ("text", "needle", "expected"),
    [
        ("hello world, hello rust!", "hello rust", (0, 6)),
        ("abcdefghijklmnop", "xyzw1234", (0, 0)),
        ("", "hello", (0, 0)),
        ("abcdefghijklmnop", "ab", (0, 0)),
        ("the quick brown fox jumps over the lazy dog!", "the lazy dog!", (0, 4)),
        ("abcdWXYZabcd", "abcd", (0, 4)),
        ("abcdef", "cdef", (0, 0)),
    ],
)
def test_prefix_match(spark, text, needle, expected):
    pairs = spark.createDataFrame([("a", bytearray(text.encode()), bytearray(needle.encode()))], "pair_id string, old binary, needle binary")
    row = block_index.prefix_match(pairs, block_index.block_index(pairs, 4), 4).first()
    assert (row.start, row.len) == expected


def test_index_geometry(spark):
    lengths = spark.createDataFrame([(0,), (31,), (64,), (1048576,), (938475520,)], "length long")
    rows = block_index.index_geometry(lengths, 32).orderBy("length").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (0, 1, 8, 64),
        (0, 1, 8, 64),
        (2, 1, 8, 64),
        (32768, 8192, 65536, 524288),
        (29327360, 8388608, 67108864, 536870912),
    ]


def test_edit_script_lengths():
    old, out = bytes(29) + b"\x01\x02\x00", []
    script = bytes([12, 16, 5, 40, 132, 1, 47, 43, 20, 86, 150, 0, 150, 0, 150, 0, 115, 31, 0, 0, 0, 0, 0, 0, 0, 1, 38, 188, 128, 0, 150, 0])
    for i in range(2, len(script) + 1, 2):
        out.append(len(synth.run_script(old, script[:i])))
    assert out == [48, 88, 92, 135, 221, 221, 221, 221, 252, 252, 252, 252, 253, 441, 441, 441]
    with pytest.raises(ValueError):
        synth.run_script(b"", b"\x01\x02")


def test_numbers():
    for x, code in ((0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (129, "8101"), (300, "ac02")):
        assert codec.varint(x).hex() == code and codec.Stream(codec.varint(x)).number("x") == x


@pytest.mark.parametrize(
    ("stream", "message"),
    [
        ("01", "truncated copy tag"),
        ("010704", "truncated seek"),
        ("0107", "truncated old position"),
        ("c0", "truncated add tag"),
        ("640000", "outside old"),
        ("010b0400", "outside old"),
        ("010000", "a chunk has 0 bytes"),
    ],
)
def test_broken_streams(stream, message):
    with pytest.raises(PatchDecodeError, match=message):
        codec.apply_stream(bytes.fromhex(stream), b"abcdefgh", 0, 3)


def test_copy_from_old():
    assert codec.apply_stream(bytes.fromhex("01070400"), b"abcdefgh", 0, 3) == b"efg"


def test_broken_patches(spark):
    pairs = frame(spark, [("a", bytearray(O64), bytearray(O64 + b"XYZ"))])
    patch = bytes(deltas.diff(pairs, DiffOptions(32, None)).first().patch)
    assert patch[:20].hex() == "dfb10000" "00200000" "4300000000000000" "01000000"
    assert struct.unpack("<QQQQQ", patch[20:60])[:4] == (0, 0, 67, 7)
    assert patchfile.parse_patch(patch + b"more")[1][0][5] == patch[60:]
    for cut in (0, 3, 7, 19, 59, len(patch) - 1):
        with pytest.raises(PatchDecodeError):
            patchfile.parse_patch(patch[:cut])
    with pytest.raises(WrongMagic):
        patchfile.parse_patch(b"\0" + patch[1:])
    with pytest.raises(WrongVersion):
        patchfile.parse_patch(patch[:4] + b"\1" + patch[5:])
    with pytest.raises(PatchDecodeError, match="invalid data"):
        codec.decompress(patch[60:-4] + b"????", 7)
    for wrong in (patch[60:] + b"?", patch[60:] + patch[60:], patch[60:-1]):
        with pytest.raises(PatchDecodeError, match="invalid data"):
            codec.decompress(wrong, 7)
    rows = spark.createDataFrame([("x", bytearray(patch[:30])), ("y", bytearray(patch)), ("z", None)], "pair_id string, patch binary")
    errors = {r.pair_id: r.error for r in patchfile.parse(rows, permissive=True).collect()}
    assert errors == {"x": "truncated patch", "y": None, "z": "truncated patch"}


def test_options():
    for wrong in ({"block_size": 3}, {"chunk_size": 0}):
        with pytest.raises(ValueError):
            DiffOptions(**wrong)


def test_nulls_give_no_patch(spark):
    pairs = frame(spark, [("a", None, bytearray(b"x")), ("b", bytearray(b"x"), None), ("c", bytearray(b""), bytearray(b""))])
    assert [r.pair_id for r in deltas.diff(pairs).collect()] == ["c"]
    assert deltas.cycle(pairs).collect()[0].ratio is None


def test_sizes(spark):
    row = spark.range(1).select(
        b.format_size(F.lit(5 << 20)), b.format_size(F.lit(2048)), b.format_size(F.lit(7)), b.format_size_fine(F.lit(1024)),
        b.next_power_of_two(F.lit(0)), b.next_power_of_two(F.lit(8)), b.next_power_of_two(F.lit(9)),
    ).first()
    assert list(row) == ["5.0 MiB", "2 KiB", "7 B", "1024 B", 1, 8, 16]
    row = spark.range(1).select(b.format_size(F.lit(2560)), b.format_size_fine(F.lit(1 << 30)), b.next_power_of_two(F.lit((1 << 61) + 1))).first()
    assert list(row) == ["2 KiB", "1024.00 MiB", 1 << 62]


def test_files_and_pages(spark, tmp_path):
    for name, data in (("old/a/x", O96), ("new/a/x", PUT_IN), ("new/y", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    pairs = versions.file_pairs(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert sorted(r.pair_id for r in pairs.collect()) == ["a/x", "y"]
    assert all(r.ok for r in deltas.cycle(pairs).collect())
    files = versions.read_files(spark, str(tmp_path / "new"))
    parts = versions.pages(files, 64).where("name = 'a/x'").orderBy("start").collect()
    assert b"".join(bytes(r.bytes) for r in parts) == PUT_IN and len(parts) == 2


def test_stream_of_versions(spark, tmp_path):
    known = spark.createDataFrame([("x", bytearray(O96))], "name string, content binary")
    news = spark.createDataFrame([("x", bytearray(PUT_IN)), ("y", bytearray(b"new"))], "name string, content binary")
    news.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(news.schema).parquet(str(tmp_path / "in"))
    write_patches(stream, known, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    records = versions.read_records(spark, str(tmp_path / "out"))
    olds = known.select(F.col("name").alias("pair_id"), F.col("content").alias("old"))
    olds = olds.unionByName(spark.createDataFrame([("y", bytearray(b""))], "pair_id string, old binary"))
    rebuilt = codec.joined_chunks(codec.apply_chunks(records, olds)).collect()
    assert {r.pair_id: bytes(r.new) for r in rebuilt} == {"x": PUT_IN, "y": b"new"}


def test_later_batches_follow_earlier_ones(spark, tmp_path):
    known = spark.createDataFrame([("x", bytearray(O96))], "name string, content binary")
    olds = known.select(F.col("name").alias("pair_id"), F.col("content").alias("old"))
    for i, new in enumerate((PUT_IN, PUT_IN + O64)):
        news = spark.createDataFrame([("x", bytearray(new))], known.schema)
        news.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(known.schema).parquet(str(tmp_path / "in"))
        write_patches(stream, known, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        records = versions.read_records(spark, str(tmp_path / "out")).where(f"batch = {i}")
        assert bytes(codec.joined_chunks(codec.apply_chunks(records, olds)).first().new) == new
        olds = spark.createDataFrame([("x", bytearray(new))], "pair_id string, old binary")


def test_files_of_one_name(spark, tmp_path, monkeypatch):
    for name in ("p/old/x", "p/old/a/x", "p/new/x", "p/new/a/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 20)
    for old, new in ((f"file:{tmp_path}/p/old", f"{tmp_path}/p/new/"), (f"{tmp_path}/p/../p/old", f"{tmp_path}/p/new")):
        pairs = {r.pair_id: (bytes(r.old), bytes(r.new)) for r in versions.file_pairs(spark, old, new).collect()}
        assert pairs == {n: (f"p/old/{n}".encode() * 20, f"p/new/{n}".encode() * 20) for n in ("x", "a/x")}
    assert {r.name for r in versions.read_files(spark, f"{tmp_path}/p/old/x").collect()} == {"x"}
    assert versions.read_files(spark, f"{tmp_path}/p/*/x").select("name").distinct().count() == 2


def test_threads_are_at_least_one(capsys):
    with pytest.raises(SystemExit):
        cli.main(["cycle", "a", "b", "--threads", "0"])
    assert "at least 1" in capsys.readouterr().err


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "other").mkdir()
    old, new, patch, out = (str(tmp_path / x) for x in ("same", "other/same", "patch", "out"))
    open(old, "wb").write(O96 * 3)
    open(new, "wb").write(PUT_IN * 3)
    options = DiffOptions(32, 100)
    cli.diff(spark, old, new, patch, options)
    cli.patch(spark, old, patch, out)
    assert open(out, "rb").read() == PUT_IN * 3
    cli.cycle(spark, old, new, options)
    said = capsys.readouterr().out
    assert "of 300 B" in said and "dtime" in said and "ptime" in said and "MiB/s" in said


def test_patches_are_put_together_without_python(spark):
    """Values of whole patches never lie in a Python worker; order and header are those of the records."""
    records = spark.createDataFrame(
        [("p", i, 0, 10 * i, 10, 3, 2, bytes([i, 255])) for i in (2, 0, 1)],
        "pair_id string, chunk_idx int, old_start long, new_start long, new_len long, raw_len long, data_len long, data binary",
    )
    made = patchfile.assemble(records)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    size, parts = patchfile.parse_patch(made.collect()[0].patch)
    assert size == 30 and [p[-1] for p in parts] == [b"\0\xff", b"\1\xff", b"\2\xff"]
    joined = codec.joined_chunks(records.withColumnRenamed("data", "bytes"))
    assert "Python" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.collect()[0].new == b"\0\xff\1\xff\2\xff"


def test_near_copies_are_compared_by_arrays_of_numbers(spark):
    """Candidates don't meet by a row for each of their blocks; four shared blocks are too few."""
    rows = [(1, range(0, 9)), (2, range(0, 9)), (3, range(4, 14)), (4, range(5, 9)), (5, range(30, 40))]
    held = spark.createDataFrame([(i, bytes([x]) * 32) for i, own in rows for x in own], "doc_id long, block binary")
    found = versions.near_copies(held)
    plan = found._jdf.queryExecution().toString()
    assert "array_intersect" in plan
    assert {(r.doc_id, r.class_id, r.links) for r in found.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 2)}
