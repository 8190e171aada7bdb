"""Command line: sample, index, evaluate, baseline.

Models and decoders are named as module:attribute and loaded on the driver; see ``operators.inference`` and
``sources.frames`` for what they have to offer. Without names, the deterministic stubs are used.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.config import EVALUATION, AnswerConfig, IndexConfig, RetrievalConfig, parse_quotas
from chronoreel.functions.text import query_text
from chronoreel.operators import inference, manifest, sampling
from chronoreel.plans import pipeline
from chronoreel.plans.store import written_once
from chronoreel.sources import frames as videos_source
from chronoreel.sources import sinks
from chronoreel.sources.manifest import read_manifest, read_question_table


def load(name: str | None, default: Callable) -> Callable:
    if not name:
        return default
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _model(name: str | None, default: Callable, args: argparse.Namespace) -> Callable:
    """A model's factory, with the device and the environment of the run."""
    missing = [v for v in args.worker_env if v not in os.environ]
    if missing:
        raise ValueError(f"not set in the environment: {', '.join(missing)}")
    return inference.configured(load(name, default), args.device, {v: os.environ[v] for v in args.worker_env})


def sample(spark: SparkSession, args: argparse.Namespace) -> None:
    """A development subset of a manifest, or of a table of questions, as one JSON document."""
    if bool(args.manifest) == bool(args.table):
        raise ValueError("give --manifest or --table")
    videos = read_manifest(spark, args.manifest) if args.manifest else read_question_table(spark, args.table, args.table_format)
    fields = tuple(args.bucket_fields.split(","))
    quotas = parse_quotas(args.quota)
    if quotas:
        drawn = sampling.quota_sample(videos, quotas, args.seed, fields)
    else:
        drawn = sampling.stratified_sample(videos, args.sample_size, args.seed, fields)
    log = []
    if args.video_root:
        files = videos_source.availability(spark, args.video_root)
        drawn, replaced = sampling.validate_and_replace(drawn, videos, files, args.seed, fields, bool(quotas))
        log = [r.asDict() for r in replaced.collect()]
    document = sinks.manifest_document(
        drawn.drop("row_no"),
        manifest.stats(drawn),
        source_json=args.manifest,
        source_dataset=args.table,
        sample_size=sum(quotas.values()) if quotas else args.sample_size,
        seed=args.seed,
        bucket_fields=list(fields),
        duration_quota=quotas or None,
        video_root=args.video_root,
        validate_downloadable=bool(args.video_root),
        replacements=log,
    )
    with open(args.output, "w", encoding="utf-8") as out:
        json.dump(document, out, ensure_ascii=False, indent=2)


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    """Decode, embed, segment and pool all videos below a folder."""
    config = IndexConfig(sample_fps=args.fps)
    if args.manifest:
        wanted = manifest.select_targets(read_manifest(spark, args.manifest), args.target_url)
        videos_source.fetch_missing(wanted, args.videos, load(args.fetch, None) if args.fetch else None)
    decoded = videos_source.sample_videos(spark, args.videos, load(args.decoder, videos_source.raw_decoder), config.sample_fps, energy=True)
    coded = inference.encode(decoded, "image", _model(args.encoder, inference.StubEncoder, args), config.image_batch)
    coded = inference.encode(coded, "image", _model(args.second_encoder, inference.StubEncoder, args), config.image_batch, out="dino_embedding")
    # The models are the expensive part, so their output is stored before anything is built on it.
    coded.write.mode("overwrite").parquet(f"{args.output}/frames")
    pipeline.build_index(spark.read.parquet(f"{args.output}/frames"), config).write(args.output)


def _questions(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    videos = manifest.select_targets(read_manifest(spark, args.manifest), args.target_url)
    return manifest.question_rows(videos).withColumn("video_key", F.col("url"))


def _finish(results: DataFrame, config: dict, args: argparse.Namespace, began: float) -> None:
    results.write.mode("overwrite").parquet(f"{args.output}/rows")
    stored = results.sparkSession.read.parquet(f"{args.output}/rows")
    sinks.write_results(stored, f"{args.output}/results")
    settings = config | {"answer_config": asdict(AnswerConfig(args.answerer or "stub", inference.device_of(args.device)))}
    found = sinks.write_summary(stored, settings, f"{args.output}/summary", round(time.time() - began, 3), args.manifest, args.index).first()
    print(f"questions: {found['question_count']}\nsummary_accuracy: {found['choice_accuracy']:.3f}\nsaved: {args.output}/summary")


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Answer a manifest's questions from retrieved evidence."""
    began = time.time()
    config = RetrievalConfig(EVALUATION.top_high, EVALUATION.top_low, args.max_frames)
    asked = _questions(spark, args).withColumn("text", query_text(F.col("question"), F.col("options")))
    asked = inference.encode(asked, "text", _model(args.text_encoder, inference.StubEncoder, args), 32, out="query").drop("text")
    found = pipeline.retrieve(pipeline.VideoIndex.read(spark, args.index), asked, config)
    if args.export:
        found["evidence"] = written_once(found["evidence"])
        sinks.write_evidence(found["evidence"], spark.read.parquet(f"{args.index}/frames"), args.export, "overwrite")
    _finish(pipeline.evaluate(asked, found, _model(args.answerer, inference.StubAnswerer, args), args.prefix), asdict(config), args, began)


def baseline(spark: SparkSession, args: argparse.Namespace) -> None:
    """Answer a manifest's questions from evenly spaced frames."""
    began = time.time()
    rows = spark.read.parquet(f"{args.index}/frames").select("video_key", "frame_ordinal")
    shown = None
    if args.match_folder:
        shown = sinks.exported_counts(spark, args.match_folder)
    elif args.match:
        shown = spark.read.parquet(f"{args.match}/rows").select("video_key", "question_id", F.size("evidence_frames").alias("n_frames"))
    results = pipeline.evaluate_baseline(_questions(spark, args), rows, _model(args.answerer, inference.StubAnswerer, args), args.max_frames, args.prefix, shown)
    _finish(results, {"max_frames": args.max_frames, "match_retrieval_frame_count": bool(args.match or args.match_folder)}, args, began)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronoreel", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(run: Callable, *options: tuple) -> None:
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    need, output = {"required": True}, ("--output", {"required": True})
    models = (("--device", {"help": "where models run, for those that take one"}), ("--worker-env", {"action": "append", "default": [], "help": "a variable, such as an access token, that workers get"}))
    command(
        sample, ("--manifest", {}), ("--table", {"help": "a table of question rows, such as a local export of a hub dataset"}), ("--table-format", {"default": "parquet"}), output, ("--sample-size", {"type": int, "default": 50}), ("--seed", {"type": int, "default": 7}),
        ("--bucket-fields", {"default": "duration,domain"}), ("--quota", {"action": "append", "default": []}), ("--video-root", {}),
    )
    command(index, ("--videos", need), output, ("--fps", {"type": float, "default": 4.0}), ("--decoder", {}), ("--encoder", {}), ("--second-encoder", {}),
            ("--manifest", {"help": "videos that must be below --videos before the run"}), ("--target-url", {"action": "append", "default": []}), ("--fetch", {"help": "module:function(url, path) for those that are not"}), *models)
    run = [*models, ("--manifest", need), ("--index", need), output, ("--target-url", {"action": "append", "default": []}), ("--answerer", {}), ("--prefix", {"default": ""}), ("--max-frames", {"type": int, "default": 64})]
    command(evaluate, *run, ("--text-encoder", {}), ("--export", {"help": "a folder for the evidence frames; what is in it goes"}))
    command(baseline, *run, ("--match", {"help": "output of an evaluate run, for as many frames as it showed"}), ("--match-folder", {"help": "a folder of exported evidence frames, likewise"}))
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("chronoreel").getOrCreate(), args)


if __name__ == "__main__":
    main()
