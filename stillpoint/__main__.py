"""Run the extraction plan over tables: python -m stillpoint --tables DIR --out DIR [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import pipeline
from .sources import sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stillpoint", description="Select the samples that carry all distinct information.")
    p.add_argument("--tables", required=True, help="folder with samples, features, metrics, evidence and, optionally, segments as Parquet")
    p.add_argument("--out", required=True)
    p.add_argument("--pass1-clusters", type=int, default=15)
    p.add_argument("--max-output-frames", type=int)
    p.add_argument("--transcript-only", action="store_true")
    p.add_argument("--transcript-format", choices=["txt", "srt", "vtt", "json"], default="txt")
    p.add_argument("--debug-qa-targets", help="JSON of wanted times, traced through the stages of every recording")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("stillpoint").getOrCreate()
    read = lambda name: spark.read.parquet(f"{args.tables}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{args.tables}/segments")
    segments = read("segments") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    if segments is not None:
        for fmt in {args.transcript_format, "json"}:
            sinks.write_transcript(segments, f"{args.out}/transcript.{fmt}", fmt)
    if args.transcript_only:
        return 0 if segments is not None else 1
    result = pipeline.extract(*map(read, ("samples", "features", "metrics", "evidence")), pipeline.Config(pass1_clusters=args.pass1_clusters, max_output_frames=args.max_output_frames))
    sinks.write_manifest(result.selected, f"{args.out}/manifest", segments)
    if args.debug_qa_targets:
        wanted = sinks.load_targets(spark, args.debug_qa_targets)
        targets = result.stages["sampling"].select("video_id").distinct().join(wanted)  # wanted times are a short list
        sinks.write_trace({"qa": pipeline.trace_targets(result, targets)}, f"{args.out}/trace")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
