"""Command line: python -m sortloom.cli sort|gensort|validate|cost ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sortloom.functions.record import crc_sum, u128_hex
from sortloom.operators.validate import merged, partition_summaries, summary_line
from sortloom.plans import cost
from sortloom.plans.job import Job, run_and_print
from sortloom.sources import fixedrec, gensort

#: Kinds of input and output and the scheme of their paths.
STORES = {"fs": None, "awscli": "s3", "awscurl": "s3", "gcp": "gs"}
#: With --client command, what reads and writes an object.
GET = {"awscli": "aws s3 cp --cli-connect-timeout 15 --cli-read-timeout 15 {url} -", "gcp": "gsutil cp {url} -"}
PUT = {"awscli": "aws s3 cp --storage-class {storage_class} - {url}", "gcp": "gsutil cp - {url}"}


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sortloom")
    sub = top.add_subparsers(dest="command", required=True)
    sort = sub.add_parser("sort", help="sort fixed-length records")
    sort.add_argument("--input", required=True, choices=[*STORES, "generate"])
    sort.add_argument("--output", required=True, choices=[*STORES, "discard"])
    for side in ("input", "output"):
        for what in ("path", "bucket", "prefix"):
            sort.add_argument(f"--{side}_{what}")
    sort.add_argument("--input_count", type=int)
    sort.add_argument("--num_partitions", type=int, required=True)
    sort.add_argument("--buffer_size", type=int)
    sort.add_argument("--download_timeout", type=int)
    sort.add_argument("--chunk_size", type=int)
    sort.add_argument("--sampled", action="store_true", help="boundaries from a sample of the keys")
    sort.add_argument("--client", choices=["library", "command", "signed"], default="library", help="awscli and gcp: objects pass through the store's library (its credentials, retries and transfers), or through the aws and gsutil commands, or through signed URLs, as awscurl's always do")
    sort.add_argument("--storage_class", help="of objects that awscli writes; one other than STANDARD needs --client command")
    sort.add_argument("--upload_timeout", type=float, help="seconds that a command may take after the last byte of an object, or a signed upload without an answer")
    sort.add_argument("--concurrent_files", type=int, help="uploads of an executor at a time, at least its cores: each task uploads one object at a time")
    gen = sub.add_parser("gensort", help="write generated records")
    gen.add_argument("-a", action="store_true", help="ASCII records")
    gen.add_argument("-c", action="store_true", help="print the checksum")
    gen.add_argument("-b", type=int, default=0, metavar="START")
    gen.add_argument("num_recs", type=int)
    gen.add_argument("path")
    check = sub.add_parser("validate", help="check sorted objects")
    check.add_argument("path")
    price = sub.add_parser("cost", help="storage cost from gauge lines")
    price.add_argument("log")
    for name, kind in (("total_bytes", int), ("start", float), ("stop", float), ("price", float)):
        price.add_argument(name, type=kind)
    return top


def place(args, side: str) -> str:
    """The path of one side."""
    scheme = STORES[getattr(args, side)]
    if scheme is None:
        path = getattr(args, f"{side}_path")
        if not path:
            raise SystemExit(f"--{side}_path is needed")
        return path
    bucket, prefix = getattr(args, f"{side}_bucket"), getattr(args, f"{side}_prefix")
    if not bucket or prefix is None:
        raise SystemExit(f"--{side}_bucket and --{side}_prefix are needed")
    return f"{scheme}://{bucket}/{prefix}"


def signs(args, side: str) -> bool:
    """Whether a side's objects pass through signed URLs."""
    return getattr(args, side) == "awscurl" or args.client == "signed" and getattr(args, side) in PUT


def refused(args, cores: int | None = None) -> None:
    """Ends on options that can't be kept."""
    if args.output == "awscli" and not args.storage_class:
        raise SystemExit("--storage_class is needed")
    if args.storage_class and args.storage_class != "STANDARD" and not (args.output == "awscli" and args.client == "command"):
        raise SystemExit("--storage_class other than STANDARD needs --output awscli and --client command")
    if args.upload_timeout and not (signs(args, "output") or args.output in PUT and args.client == "command"):
        raise SystemExit("--upload_timeout needs awscurl, or --client command or signed and --output awscli or gcp")
    if args.concurrent_files and cores and args.concurrent_files < cores:
        raise SystemExit(f"--concurrent_files {args.concurrent_files}: an executor has {cores} cores and so many uploads at a time; set spark.executor.cores")


def job_of(args) -> Job:
    if args.input == "generate" and args.input_count is None:
        raise SystemExit("--input_count is needed")
    given = lambda **x: {k: v for k, v in x.items() if v is not None}
    return Job(
        partitions=args.num_partitions,
        input_path=None if args.input == "generate" else place(args, "input"),
        input_count=args.input_count if args.input == "generate" else None,
        output_path=None if args.output == "discard" else place(args, "output"),
        sampled=args.sampled,
        reader=given(signed=signs(args, "input") or None, buffer_size=args.buffer_size, download_timeout=args.download_timeout, get_command=GET.get(args.input) if args.client == "command" else None),
        writer=given(signed=signs(args, "output") or None, chunk_bytes=args.chunk_size, upload_timeout=args.upload_timeout, storage_class=args.storage_class, put_command=PUT.get(args.output) if args.client == "command" else None),
    )


def cores_of(spark: SparkSession) -> int:
    """Task slots of an executor."""
    master = spark.sparkContext.master
    return spark.sparkContext.defaultParallelism if master.startswith("local") else int(spark.conf.get("spark.executor.cores", "1"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sortloom").getOrCreate()
    if args.command == "sort":
        refused(args, cores_of(spark))
        run_and_print(spark, job_of(args))
    elif args.command == "gensort":
        rows = gensort.generate(spark, args.num_recs, args.b, args.a)
        fixedrec.write(rows, args.path)
        if args.c:
            print(rows.agg(u128_hex(F.coalesce(crc_sum(F.col("record")), F.lit(0)))).first()[0])
    elif args.command == "validate":
        # Splits in the order of names stand for partitions.
        rows = fixedrec.read(spark, args.path)
        summary = merged(partition_summaries(rows)).first().asDict()
        print(summary_line(summary))
        return int(summary["unordered_count"] > 0)
    else:
        # Lines are numbered where they stand: splits of a file follow each other.
        lines = spark.read.text(args.log).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
        samples = cost.last_writes(cost.sink_records(cost.parsed(lines, order="n")), "n")
        row = cost.storage_cost(samples, args.total_bytes, args.start, args.stop, args.price).first()
        print(f"byte-seconds: {row['byte_seconds']:.0f}, cost: {row['cost']:.2f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
