"""Command line: python -m wordloom.cli extract | train | segment | evaluate."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom import api
from wordloom.operators import features, tagger, train
from wordloom.sources import models
from wordloom.sources.corpus import read_corpus

SETS = ("fast", "balanced", "full")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordloom")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="corpus to feature lines")
    e.add_argument("--tag-free", action="store_true")
    e.add_argument("--stage2-features", choices=SETS, default="fast")
    e.add_argument("corpus")
    e.add_argument("features")
    t = sub.add_parser("train", help="feature lines to a model")
    t.add_argument("-t", "--threshold", type=float, default=0.01)
    t.add_argument("-i", "--iterations", type=int, default=100)
    t.add_argument("-m", "--model")
    t.add_argument("--perceptron", action="store_true")
    t.add_argument("--num-epochs", type=int, default=10)
    t.add_argument("--pos", action="store_true")
    t.add_argument("--dominance", type=float, default=models.DOMINANCE)
    t.add_argument("features")
    t.add_argument("output")
    s = sub.add_parser("segment", help="lines to words; without files from standard input to standard output")
    s.add_argument("--threads", type=positive, help="tasks at a time")
    s.add_argument("model")
    s.add_argument("input", nargs="?")
    s.add_argument("output", nargs="?")
    v = sub.add_parser("evaluate", help="metrics against gold lines")
    v.add_argument("model")
    v.add_argument("gold")
    for x in (e, s, v):
        x.add_argument("-l", "--language", default="japanese")
        x.add_argument("--pos", action="store_true")
    for x in (e, v):
        x.add_argument("--format", choices=("space", "tsv"), default="space")
    return p


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


#: Lines of standard input that are read, segmented and printed at a time.
CHUNK = 4096


def pipe(args: argparse.Namespace, source, sink) -> None:
    """Lines from source to sink in bounded chunks, in order."""
    from itertools import islice

    own = api.Segmenter.open(args.model, args.language)
    lines = (x for raw in source if (x := raw.strip()))
    try:
        while part := list(islice(lines, CHUNK)):
            if args.pos:
                out = [" ".join(f"{w}/{t}" for w, t in tokens) for tokens in own.segment_with_pos_batch(part)]
            else:
                out = [" ".join(words) for words in own.segment_batch(part)]
            sink.write("".join(f"{x}\n" for x in out))
        sink.flush()
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """id and line of text files, in order of the id."""
    return read_corpus(spark, path)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "extract":
        if args.pos and args.tag_free:
            raise ValueError("--tag-free doesn't go with --pos")
        lines, tsv = numbered(spark, args.corpus), args.format == "tsv"
        own = api.Extractor(args.language)
        if args.pos:
            one, two, lex = own.extract_two_stage(lines, tsv, args.stage2_features, ("id",))
            for suffix, rows in (("stage1", features.feature_lines(one.orderBy("id", "pos"))), ("stage2", features.feature_lines(two.orderBy("id", "word_no"))), ("lexicon", features.lexicon_lines(lex))):
                rows.write.text(f"{args.features}.{suffix}")
        else:
            features.feature_lines(own.extract(lines, tsv, args.tag_free, ("id",)).orderBy("id", "pos")).write.text(args.features)
    elif args.command == "train":
        if args.pos and (args.perceptron or args.model):
            raise ValueError("--pos goes neither with --perceptron nor with -m")
        read = lambda path: features.read_feature_lines(numbered(spark, path)).withColumn("id", F.monotonically_increasing_id())
        if args.pos:
            one, two = (trained(read(f"{args.features}.{s}"), args.num_epochs) for s in ("stage1", "stage2"))
            lexicon = models.parse_lexicon([r[0] for r in spark.read.text(f"{args.features}.lexicon", lineSep="\n").collect()])
            text = models.TwoStageModel(one.collapsed(), lexicon, two, args.dominance).dump()
        elif args.perceptron:
            text = trained(read(args.features), args.num_epochs, args.model).dump()
        else:
            trainer = api.Trainer(read(args.features).withColumn("label", F.col("label").cast("int")), args.threshold, args.iterations)
            if args.model:
                trainer.load_model(args.model)
            model, metrics = trainer.train()
            text = model.dump()
            report(metrics)
        with open(args.output, "w", newline="\n") as f:
            f.write(text)
    elif args.command == "segment":
        from wordloom.functions.text import trim

        lines = numbered(spark, args.input).withColumn("line", trim(F.col("line"))).where("line <> ''")
        own = api.Segmenter.open(args.model, args.language)
        out = own.segment_with_pos(lines).select("id", tagger.joined_tags().alias("line")) if args.pos else own.segment(lines).select("id", F.array_join("words", " ").alias("line"))
        out = out.orderBy("id").select("line")
        (out.coalesce(args.threads) if args.threads else out).write.text(args.output)
    else:
        report(api.Segmenter.open(args.model, args.language).evaluate(numbered(spark, args.gold), args.format == "tsv", args.pos))


def trained(instances: DataFrame, epochs: int, model: str | None = None) -> models.PerceptronModel:
    """A perceptron over instances in the order of id; its metrics are reported."""
    trainer = api.PerceptronTrainer(instances, epochs, ("id",))
    if model:
        trainer.load_model(model)
    found, metrics = trainer.train()
    report(metrics)
    return found


def report(metrics: DataFrame) -> None:
    for k, v in metrics.first().asDict().items():
        print(f"{k}: {v:.2f}" if isinstance(v, float) else f"{k}: {v}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "segment" and not args.input:
            pipe(args, sys.stdin, sys.stdout)
        else:
            threads = getattr(args, "threads", None) or "*"
            run(args, SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{threads}]")).getOrCreate())
    except (ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
