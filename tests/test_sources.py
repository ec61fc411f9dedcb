"""Record files: splits, partial records, chunks, commits."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortloom import cli
from sortloom.functions import record as R
from sortloom.operators import sort as S
from sortloom.plans import job as J
from sortloom.sources import fixedrec as X
from sortloom.sources import gensort as G


def records(spark, n):
    return G.generate(spark, n, partitions=3).select(R.key_of(F.col("record")).alias("key"), "record")


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


@pytest.mark.parametrize(("split", "want"), [((0, 250), (0, 200)), ((250, 250), (200, 300)), ((0, 99), (0, 0)), ((150, 40), (100, 0)), ((500, 55), (500, 0))])
def test_alignment(split, want):
    assert X.aligned(*split) == want


def test_splits_tile_a_file():
    for width in (1, 99, 100, 101, 250, 333):
        seen = [b for s in range(0, 5000, width) for b in range(*(lambda a: (a[0], a[0] + a[1], 100))(X.aligned(s, min(width, 5000 - s))))]
        assert seen == list(range(0, 5000, 100))


def test_sizes_of_files(spark, tmp_path):
    whole = G.records(0, 3).tobytes()
    folder = put(tmp_path / "in", a=b"", b=whole[:100], c=whole[:250], d=whole[:99])
    assert X.read(spark, folder).count() == 3
    assert X.read(spark, folder, split_bytes=100).count() == 3
    assert X.read(spark, put(tmp_path / "none")).count() == 0
    assert X.read(spark, f"{folder}/[bc]").count() == 3
    with pytest.raises(Exception, match="partial record"):
        X.read(spark, folder, strict="true").collect()


def test_round_trip_in_chunks(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = S.sort_records(records(spark, 1000), 8)
    X.write(rows, out, chunk_bytes=2_550)
    sizes = json.loads((tmp_path / "out" / X.MANIFEST).read_text())
    want = [(r["object_name"], r["bytes"]) for r in J.chunk_manifest(rows, 2_550).orderBy("p", "chunk").collect()]
    assert [(x["object_name"], x["object_size"]) for x in sizes] == want and max(s for _, s in want) == 2_500
    assert [(x, os.path.getsize(f"{out}/{x}")) for x, _ in want] == want
    assert b"".join((tmp_path / "out" / x).read_bytes() for x, _ in want) == b"".join(bytes(r["record"]) for r in rows.collect())
    assert not (tmp_path / "out" / X.STAGING).exists()
    back = X.read(spark, out, split_bytes=700)
    assert sorted(bytes(r["record"]) for r in back.collect()) == sorted(bytes(r["record"]) for r in rows.collect())
    listing = X.listing(spark, out).collect()
    assert [r["object_name"].split("/out/")[1] for r in listing] == [x for x, _ in want]
    assert J.total_bytes(X.listing(spark, out)).first().asDict() == {"objects": len(want), "bytes": 100_000}


def test_overwrite_and_append(spark, tmp_path):
    out = str(tmp_path / "out")
    X.write(records(spark, 50), out)
    X.write(records(spark, 20), out)
    assert X.read(spark, out).count() == 20
    with pytest.raises(Exception, match="holds objects"):
        X.write(records(spark, 5), out, overwrite=False)
    assert X.read(spark, out).count() == 20


def test_small_chunk_means_one_record(spark, tmp_path):
    X.write(records(spark, 7).coalesce(1), str(tmp_path / "out"), chunk_bytes=10)
    assert len(json.loads((tmp_path / "out" / X.MANIFEST).read_text())) == 7


def test_bad_records_leave_nothing(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(Exception, match="100 bytes"):
        X.write(spark.createDataFrame([(bytearray(5),)], "record binary"), str(out))
    assert not out.exists() or not list(out.iterdir())


def test_a_read_that_fails_goes_on_where_it_stopped(tmp_path, monkeypatch):
    data = G.records(0, 50).tobytes()
    put(tmp_path / "in", a=data)
    reader = X.FixedReader({"path": str(tmp_path / "in"), "buffer_size": "1000"})
    real, calls = X.opened(str(tmp_path))[0], []

    class Weak:
        def __init__(self, f):
            self.f, self.reads = f, 0

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, n):
            calls.append(n)
            self.f.seek(n)

        def read(self, n):
            self.reads += 1
            if self.reads == 2:
                raise OSError("lost")
            return self.f.read(n)

    class Store:
        def open_input_file(self, path):
            return Weak(real.open_input_file(path))

    monkeypatch.setattr(X, "opened", lambda path: (Store(), path))
    part = X.Split(str(tmp_path / "in" / "a"), 0, 5000, 5000)
    # Each attempt makes progress, so as many failures as it takes are borne.
    assert b"".join(bytes(x) for b in reader.read(part) for x in b.column(0).to_pylist()) == data and calls == [0, 1000, 2000, 3000, 4000]
    # Without progress they are counted.
    calls.clear()
    monkeypatch.setattr(Weak, "read", lambda self, n: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        list(reader.read(part))
    assert calls == [0] * 4


def test_a_slow_read_that_progresses_goes_on(tmp_path, monkeypatch):
    data = G.records(0, 50).tobytes()
    put(tmp_path / "in", a=data)
    monkeypatch.setattr(X, "LEAST_TIMEOUT", -1.0)
    reader = X.FixedReader({"path": str(tmp_path / "in"), "buffer_size": "500", "download_timeout": "0"})
    assert b"".join(bytes(x) for b in reader.read(X.Split(str(tmp_path / "in" / "a"), 0, 5000, 5000)) for x in b.column(0).to_pylist()) == data


def test_names_that_begin_with_a_path(spark, tmp_path):
    one = G.records(0, 1).tobytes()
    folder = put(tmp_path / "in", part1=one, part2=one, other=one)
    put(tmp_path / "in" / "part3", a=one)
    assert [n.removeprefix(folder) for n, _ in X.listed(f"{folder}/part")] == ["/part1", "/part2", "/part3/a"]
    assert X.read(spark, f"{folder}/part").count() == 3 and X.read(spark, f"{folder}/part3").count() == 1 and X.listed(f"{folder}/none") == []


def test_direct_writes_and_stale_objects(spark, tmp_path):
    out = str(tmp_path / "out")
    for n in (1000, 300):
        rows = S.sort_records(records(spark, n), 4)
        X.write(rows, out, chunk_bytes=2_500, direct="true")
        names = [x["object_name"] for x in json.loads((tmp_path / "out" / X.MANIFEST).read_text())]
        assert sorted(names) == sorted(f.removeprefix(f"{out}/") for f, _ in X.listed(out)) and not (tmp_path / "out" / X.STAGING).exists()
        assert [bytes(r["record"]) for r in X.read(spark, out).collect()] == [bytes(r["record"]) for r in rows.collect()]
    with pytest.raises(Exception, match="holds objects"):
        X.write(records(spark, 5).coalesce(1), out, overwrite=False, direct="true")
    with pytest.raises(Exception, match="twice"):
        X.write(records(spark, 5), out, direct="true", speculation="true")


def test_objects_pass_through_commands(spark, tmp_path):
    """A client's commands, here those of any machine: written, read, resumed, failed and timed out."""
    out = tmp_path / "out"
    for p in range(4):
        (out / str(p)).mkdir(parents=True)
    rows = S.sort_records(records(spark, 1000), 4)
    X.write(rows, str(out), chunk_bytes=2_500, put_command="dd status=none of={url}", storage_class="X")
    want = [bytes(r["record"]) for r in rows.collect()]
    assert [bytes(r["record"]) for r in X.read(spark, str(out), get_command="cat {url}", split_bytes=100).collect()] == want
    name, size = max(X.listed(str(out)), key=lambda f: f[1])
    reader = X.FixedReader({"path": str(out), "get_command": "head -c 1200 {url}", "buffer_size": "500"})
    with pytest.raises(OSError, match="ends early"):
        list(reader.read(X.Split(name, 0, size, size)))
    with pytest.raises(Exception, match="exit code"):
        X.write(rows, str(out), put_command="sh -c 'cat > /dev/null; exit 3' {url}")
    with pytest.raises(Exception, match="no end"):
        X.write(rows.limit(5), str(out), put_command="sh -c 'cat > /dev/null; exec sleep 20' {url}", upload_timeout="0.3")


def test_options_that_cannot_be_kept_are_refused():
    base = ["sort", "--input", "generate", "--input_count", "5", "--num_partitions", "2", "--output_bucket", "b", "--output_prefix", "p"]
    parse = lambda *more: cli.arguments().parse_args([*base, *more])
    for more in (["--output", "awscli"], ["--output", "awscli", "--storage_class", "GLACIER"], ["--output", "gcp", "--upload_timeout", "9"], ["--output", "awscli", "--storage_class", "STANDARD", "--upload_timeout", "9"], ["--output", "gcp", "--concurrent_files", "2"]):
        with pytest.raises(SystemExit):
            cli.refused(parse(*more), 4)
    kept = parse("--output", "awscli", "--storage_class", "REDUCED_REDUNDANCY", "--client", "command", "--upload_timeout", "60", "--concurrent_files", "16")
    cli.refused(kept, 4)
    writer = cli.job_of(kept).writer
    assert X.command(writer["put_command"], "s3://b/p/0/0", storage_class=writer["storage_class"]) == ["aws", "s3", "cp", "--storage-class", "REDUCED_REDUNDANCY", "-", "s3://b/p/0/0"] and writer["upload_timeout"] == 60


def test_command_line(spark, tmp_path, capsys):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert cli.main(["gensort", "-c", "1000", a], spark) == 0
    assert "1f9ffe645ec" in capsys.readouterr().out
    assert cli.main(["sort", "--input", "fs", "--input_path", a, "--output", "fs", "--output_path", b, "--num_partitions", "8", "--chunk_size", "5000"], spark) == 0
    assert "checksum: 1f9ffe645ec, record count: 1000, duplicate count: 0, unordered count: 0" in capsys.readouterr().out
    assert cli.main(["validate", b], spark) == 0
    assert "checksum: 1f9ffe645ec, record count: 1000, duplicate count: 0, unordered count: 0" in capsys.readouterr().out
    assert cli.main(["validate", a], spark) == 1
    assert cli.main(["sort", "--input", "generate", "--input_count", "500", "--output", "discard", "--num_partitions", "4"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["sort", "--input", "awscli", "--output", "discard", "--num_partitions", "4"], spark)
    args = cli.arguments().parse_args(["sort", "--input", "awscli", "--input_bucket", "b", "--input_prefix", "p/", "--output", "gcp", "--output_bucket", "c", "--output_prefix", "q", "--num_partitions", "4"])
    assert cli.job_of(args).input_path == "s3://b/p/" and cli.job_of(args).output_path == "gs://c/q"


def test_records_survive_arrow_slices():
    rows = G.records(3, 10)
    column = G.as_binary(rows).slice(2, 5)
    assert [bytes(x) for x in column.to_pylist()] == [r.tobytes() for r in rows[2:7]] and isinstance(rows, np.ndarray)
