"""Files of fixed-length records without header or separator: a data source to read and write them.

Reading: files under a path (a folder, a glob, or a prefix of names), in the order of their names, cut into splits that
start and end at a record; a partial record at the end of a file is dropped, or with strict=true an error. Writing: each partition
writes objects <path>/<partition>/<chunk> of at most chunk_bytes (rounded down to whole records, one
record at least); an empty partition writes none. Rows that have a column crc beside record are validated as they
are written; the partitions' summaries lie beside the manifest.

Commit, where files can be renamed: tasks write to a staging folder of their attempt, and the driver renames the folders of the
attempts that succeeded, one for each partition and several at a time, so a task that is retried or run twice leaves no trace.
In object stores, where a rename is a copy, tasks write the final names (direct): a retried task writes the same names again, and
the manifest, written last, commits what it lists; tasks mustn't run twice at a time there, so speculation is refused.

Paths are local, or have the scheme of a store that pyarrow opens (s3, s3a, gs, hdfs); credentials come from the
environment or the instance, never from options. A read that fails is opened again where it stopped; failures
count from the last progress on. With get_command or put_command objects pass through a client's command in place of pyarrow ({url} stands for
the object), which reads are resumed with too; with signed=true through signed URLs (`signed`), uploads in objects of at most HELD bytes. An upload that fails or takes longer than upload_timeout after its last byte fails its task, which Spark runs again.
"""

from __future__ import annotations

import contextlib
import fnmatch
import json
import shlex
import subprocess
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sortloom.functions.record import KEY_BYTES, RECORD_BYTES
from sortloom.operators.validate import Running
from sortloom.sources.gensort import as_binary
from sortloom.sources.signed import Download, SignedUpload

BUFFER, SPLIT, RETRIES, LEAST_TIMEOUT = 8 << 20, 256 << 20, 3, 30.0
#: The largest object that is held in memory for an upload to a signed URL.
HELD = 512 << 20
#: Requests that the driver has under way at a time when it commits.
AT_ONCE = 64
MANIFEST, SUMMARIES, STAGING = "_manifest.json", "_summaries.json", "_staging"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def listed(path: str) -> list[tuple[str, int]]:
    """(name, size) of the objects in a folder, matching a glob, or whose names begin with the path, in the order of their names."""
    store, base = opened(path)
    below = lambda top: store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    hidden_from = base
    if any(c in base for c in "*?["):
        top = base[: min(base.find(c) for c in "*?[" if c in base)].rpartition("/")[0] or "."
        found = [f for f in below(top) if fnmatch.fnmatch(f.path, base)]
    else:
        info = store.get_file_info(base)
        if info.type == fs.FileType.File:
            found = [info]
        elif info.type == fs.FileType.Directory:
            found = below(base)
        else:
            top, _, _ = base.rpartition("/")
            found, hidden_from = [f for f in below(top or ".") if f.path.startswith(base)], top
    hidden = lambda f: any(x.startswith(("_", ".")) for x in f.path.removeprefix(hidden_from).split("/"))
    files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f)]
    number = lambda s: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in s.split("/")]
    return sorted(files, key=lambda f: number(f[0]))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """split_number, object_name, object_size."""
    rows = [(i, *f) for i, f in enumerate(listed(path))]
    return spark.createDataFrame(rows, "split_number long, object_name string, object_size long")


def aligned(start, length) -> tuple:
    """A split (of numbers, or of columns of numbers) moved down to the records' starts; neighbours stay neighbours."""
    first = start - start % RECORD_BYTES
    rest = start + length - first
    return first, rest - rest % RECORD_BYTES


def url_of(path: str, name: str) -> str:
    """The name of an object that a listing of path has given, with the scheme that path has."""
    return f"{path.partition('://')[0]}://{name}" if "://" in path else name


def command(template: str, url: str, **more: str) -> list[str]:
    return [part.format(url=url, **more) for part in shlex.split(template)]


class Piped:
    """What a client's command writes of an object, as a file that can be read on: bytes before a place are passed over."""

    def __init__(self, words: list[str]):
        self.process = subprocess.Popen(words, stdout=subprocess.PIPE, stdin=subprocess.DEVNULL)

    def __enter__(self):
        return self

    def __exit__(self, *failed):
        self.process.kill()
        self.process.wait()
        self.process.stdout.close()

    def seek(self, at: int) -> None:
        while at > 0:
            n = len(self.process.stdout.read(min(at, BUFFER)))
            if not n:
                raise OSError("the command's output ends early")
            at -= n

    def read(self, n: int) -> bytes:
        return self.process.stdout.read(n)


class Upload:
    """An object that a client's command takes from its input."""

    def __init__(self, words: list[str], timeout: float):
        self.words, self.timeout = words, timeout
        self.process = subprocess.Popen(words, stdin=subprocess.PIPE, stdout=subprocess.DEVNULL)

    def write(self, data) -> None:
        self.process.stdin.write(memoryview(data))

    def close(self) -> None:
        try:
            with contextlib.suppress(BrokenPipeError):  # the command's exit code tells
                self.process.stdin.close()
            code = self.process.wait(self.timeout)
        except subprocess.TimeoutExpired:
            self.process.kill()
            self.process.wait()
            raise TimeoutError(f"{self.words[0]}: no end {self.timeout:g} s after the last byte") from None
        if code:
            raise OSError(f"{self.words[0]}: exit code {code}")


@dataclass
class Split(InputPartition):
    path: str
    start: int
    length: int
    size: int


class FixedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.get_command = options.get("get_command")
        self.signed, self.endpoint = str(options.get("signed", "false")).lower() == "true", options.get("endpoint")
        # A command writes an object from its start, so it is read as one.
        self.split = (1 << 62) if self.get_command else max(RECORD_BYTES, int(options.get("split_bytes", SPLIT)))
        self.buffer = max(RECORD_BYTES, int(options.get("buffer_size", BUFFER)) // RECORD_BYTES * RECORD_BYTES)
        self.timeout = float(options.get("download_timeout", 120))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self):
        out = []
        for path, size in listed(self.path):
            if self.strict and size % RECORD_BYTES:
                raise ValueError(f"{path} ends in a partial record")
            cuts = [aligned(s, min(self.split, size - s)) for s in range(0, size, self.split)]
            out += [Split(path, s, n, size) for s, n in cuts if n]
        return out or [Split("", 0, 0, 0)]

    def _open(self, store, name: str):
        if self.signed:
            return Download(url_of(self.path, name), self.endpoint)
        return Piped(command(self.get_command, url_of(self.path, name))) if self.get_command else store.open_input_file(name)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        """Opens again where it stopped when a read fails or is slow: each attempt has time in proportion to what is left."""
        store = None if self.get_command or self.signed else opened(self.path)[0]
        at, end, failures = partition.start, partition.start + partition.length, 0
        while at < end:
            deadline = time.monotonic() + max(LEAST_TIMEOUT, self.timeout * (end - at) / max(1, partition.size))
            try:
                with self._open(store, partition.path) as f:
                    f.seek(at)
                    while at < end:
                        data = f.read(min(self.buffer, end - at))
                        n = len(data) // RECORD_BYTES
                        if not n:
                            raise OSError(f"{partition.path} ends early at {at}")
                        yield pa.RecordBatch.from_arrays([as_binary(np.frombuffer(data, np.uint8)[: n * RECORD_BYTES].reshape(n, RECORD_BYTES))], names=["record"])
                        at, failures = at + n * RECORD_BYTES, 0
                        if at < end and time.monotonic() > deadline:
                            raise TimeoutError(f"{partition.path}: slow at {at}")
            except OSError:  # TimeoutError is one
                failures += 1
                if failures > self.retries:
                    raise


@dataclass
class Written(WriterCommitMessage):
    partition: int
    staged: str
    objects: list[tuple[str, int]]
    summary: dict | None = None


class FixedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        chunk = int(options.get("chunk_bytes", (1 << 63) - 1))
        self.chunk = max(RECORD_BYTES, chunk // RECORD_BYTES * RECORD_BYTES)
        self.job = uuid.uuid4().hex
        self.put_command, self.storage_class = options.get("put_command"), options.get("storage_class", "STANDARD")
        self.timeout = float(options.get("upload_timeout", 60))
        self.signed, self.endpoint = str(options.get("signed", "false")).lower() == "true", options.get("endpoint")
        if self.signed and self.chunk > HELD:
            raise ValueError(f"signed uploads need chunk_bytes of at most {HELD}")
        self.direct = bool(self.put_command) or self.signed or str(options.get("direct", self.path.startswith(("s3://", "s3a://", "gs://")))).lower() == "true"
        if self.direct:
            if str(options.get("speculation", "false")).lower() == "true":  # write() tells what the session has
                raise ValueError("tasks mustn't run twice at a time where objects can't be renamed: set spark.speculation to false")

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = opened(self.path)
        staged = f"{base}/{task.partitionId()}" if self.direct else f"{base}/{STAGING}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        objects: list[tuple[str, int]] = []
        out, held, seen = None, 0, Running()
        try:
            for batch in iterator:
                crcs = batch.column(batch.schema.get_field_index("crc")) if "crc" in batch.schema.names else None
                column = batch.column(batch.schema.get_field_index("record"))
                column = column.cast(pa.binary())
                _, offsets, data = column.buffers()
                where = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
                if column.null_count or (np.diff(where) != RECORD_BYTES).any():
                    raise ValueError(f"a record must have {RECORD_BYTES} bytes")
                at, end = int(where[0]), int(where[-1])
                if crcs is not None and at < end:
                    rows = np.frombuffer(data, np.uint8)[at:end].reshape(-1, RECORD_BYTES)
                    seen.add(rows[:, :KEY_BYTES], crcs.to_numpy(zero_copy_only=False))
                while at < end:
                    if out is None:
                        if not objects and not self.put_command and not self.signed:
                            store.create_dir(staged, recursive=True)
                        out, held = self._open(store, f"{staged}/{len(objects)}"), 0
                    take = min(end - at, self.chunk - held)
                    out.write(data.slice(at, take))
                    at, held = at + take, held + take
                    if held >= self.chunk:
                        out.close()
                        out = None
                        objects.append((str(len(objects)), held))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            objects.append((str(len(objects)), held))
        row = seen.row(task.partitionId())
        return Written(task.partitionId(), staged, objects, {k: v.hex() if isinstance(v, bytes) else str(v) if k == "checksum" else v for k, v in row.items()} if seen.count else None)

    def _open(self, store, name: str):
        if self.signed:
            return SignedUpload(url_of(self.path, name), self.timeout, self.endpoint)
        if self.put_command:
            return Upload(command(self.put_command, url_of(self.path, name), storage_class=self.storage_class), self.timeout)
        return store.open_output_stream(name)

    def commit(self, messages):
        store, base = opened(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        manifest = [{"object_name": f"{m.partition}/{name}", "object_size": size} for m in done for name, size in m.objects]
        summaries = [m.summary for m in done if m.summary]
        there = store.get_file_info(fs.FileSelector(base, recursive=self.direct, allow_not_found=True))
        old = [f for f in there if f.base_name != STAGING]
        if self.direct:
            own = {f"{base}/{x['object_name']}" for x in manifest}
            old = [f for f in old if f.type == fs.FileType.File and f.path not in own]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{base} holds objects already")
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda f: (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path), old))
            store.create_dir(base, recursive=True)
            if not self.direct:
                list(pool.map(lambda m: store.move(m.staged, f"{base}/{m.partition}"), [m for m in done if m.objects]))
        for name, rows in ((SUMMARIES, summaries), (MANIFEST, manifest)):  # the manifest last: it commits
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(json.dumps(rows).encode())
        self._clean(store, base)

    def abort(self, messages):
        store, base = opened(self.path)
        for m in (m for m in messages if m and self.direct):
            for name, _ in m.objects:
                with contextlib.suppress(OSError):
                    store.delete_file(f"{m.staged}/{name}")
        self._clean(store, base)

    def _clean(self, store, base) -> None:
        own, top = f"{base}/{STAGING}/{self.job}", f"{base}/{STAGING}"
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class FixedRecordSource(DataSource):
    """format("fixedrec"): options path; reading strict, split_bytes, buffer_size, download_timeout, retries,
    get_command, signed, endpoint; writing chunk_bytes, put_command, storage_class, upload_timeout, signed, endpoint, direct."""

    @classmethod
    def name(cls):
        return "fixedrec"

    def schema(self):
        return "record binary"

    def reader(self, schema):
        return FixedReader(self.options)

    def writer(self, schema, overwrite):
        return FixedWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FixedRecordSource)
    return spark.read.format("fixedrec").options(**{k: str(v) for k, v in options.items()}).load(path)


def summaries(path: str) -> list[dict]:
    """The summaries that the last write of rows with CRCs has left: p, keys as bytes, counts, checksum."""
    store, base = opened(path.rstrip("/"))
    with store.open_input_stream(f"{base}/{SUMMARIES}") as f:
        rows = json.loads(f.read())
    return [r | {"first_key": bytes.fromhex(r["first_key"]), "last_key": bytes.fromhex(r["last_key"]), "checksum": int(r["checksum"])} for r in rows]


def write(records: DataFrame, path: str, overwrite: bool = True, **options) -> None:
    records.sparkSession.dataSource.register(FixedRecordSource)
    options = {"speculation": records.sparkSession.conf.get("spark.speculation", "false")} | options
    records.select("record", *(["crc"] if "crc" in records.columns else [])).write.format("fixedrec").options(**{k: str(v) for k, v in options.items()}).mode("overwrite" if overwrite else "append").save(path)
