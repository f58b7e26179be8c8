"""Command line: ``python -m skein build|search|answer|eval|normalize|listen|speak|watch ...``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.engine import Engine, build_index
from skein.functions import speech as V
from skein.operators import ingest as I
from skein.operators import retrieval as R
from skein.rules import SYNTHETIC, Profile
from skein.sources import records as S
from skein.streaming import voice
from skein.streaming.audio import RuntimePaths


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="skein")
    out.add_argument("--profile", help="JSON file with a site's rule tables")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str, k: bool = False) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=about)
        for x in positional:
            own.add_argument(x)
        if k:
            own.add_argument("-k", type=int, default=5)
            own.add_argument("--mode", choices=("fast", "full"), default="full")
        return own

    command("build", "build an index from crawl records", "records", "index").add_argument("--files", help="folder of hand-made documents")
    command("normalize", "crawl records to documents, without an index", "records", "documents")
    command("search", "search an index", "index", k=True).add_argument("query", nargs="+")
    command("answer", "answer from an index", "index", k=True).add_argument("query", nargs="+")
    command("eval", "success at k of gold queries (JSON lines: query, expected_sources)", "index", "gold", k=True)
    command("listen", "answer utterances (a line each) that arrive as files in a folder", "index", "folder", "runtime", k=True)
    command("speak", "texts (a line each) as they are to be spoken", "texts")
    command("watch", "print the lines that a file gets", "file")
    return out


def bridge(engine: Engine, runtime: str, profile: Profile, k: int = 5) -> voice.Bridge:
    """Answers utterances and appends them to a runtime folder's files."""
    paths = RuntimePaths.of(runtime)

    def answer(rows):
        asked = rows.select(F.xxhash64("text").alias("query_id"), F.col("text").alias("query")).dropDuplicates(["query_id"])
        found = engine.answer(asked, k=k)
        return rows.withColumn("query_id", F.xxhash64("text")).join(found, "query_id", "left").drop("query_id")

    sinks = [voice.text_sink(str(paths.display_output)), voice.text_sink(str(paths.speaker_output), "speaker"), voice.json_sink(str(paths.llm_output))]
    return voice.Bridge(answer, sinks, skip=lambda t: V.skip_text(t, profile.stop_phrases))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "watch":
        voice.FileWatch(args.file, print).run(lambda: False)
    spark = SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    profile = Profile.from_json("".join(r.value for r in spark.read.text(args.profile, wholetext=True).collect())) if args.profile else SYNTHETIC
    if args.command == "build":
        print(build_index(spark, S.read_records(spark, args.records), args.index, profile, S.read_files(spark, args.files) if args.files else None))
    elif args.command == "normalize":
        I.documents_from_records(S.read_records(spark, args.records), profile).write.mode("overwrite").parquet(args.documents)
    elif args.command == "speak":
        spark.read.text(args.texts).select(F.explode(V.speech_sentences(V.speech_text("value"))).alias("said")).show(1000, truncate=False)
    else:
        engine = Engine.load(spark, args.index, profile, args.mode)
        run(spark, engine, args, profile)


def run(spark: SparkSession, engine: Engine, args: argparse.Namespace, profile: Profile) -> None:
    """The commands that need an index."""
    if args.command == "listen":
        Path(args.runtime).mkdir(parents=True, exist_ok=True)
        bridge(engine, args.runtime, profile, args.k).start(voice.read_lines(spark, args.folder), f"{args.runtime}/state").awaitTermination()
    elif args.command == "eval":
        gold = spark.read.schema("query string, expected_sources array<string>").json(args.gold).selectExpr("xxhash64(query) query_id", "query", "expected_sources")
        ranked = engine.search(gold.select("query_id", "query"), args.k).selectExpr("query_id", "source", "place rank")
        R.evaluate(ranked, gold.selectExpr("query_id", "explode_outer(expected_sources) source"), args.k, "source").show()
    else:
        queries = spark.createDataFrame(list(enumerate(args.query)), "query_id long, query string")
        if args.command == "search":
            engine.search(queries, args.k).select("query_id", "place", "score", "source", "text").orderBy("query_id", "place").show(truncate=100)
        else:
            engine.answer(queries, k=args.k).orderBy("query_id").show(truncate=200, vertical=True)


if __name__ == "__main__":
    main()
