"""Commands: split, synthetic, evaluate, fusion, pairs, judge, negatives, vectors."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m likeness", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        for flag, kind in options:
            sub.add_argument(flag, **kind)

    config = ("config", {})
    command("split", ("--csv", {"required": True}), ("--out", {"required": True}), ("--seed", {"type": int, "default": 42}),
            ("--fractions", {"type": float, "nargs": 3, "default": [0.7, 0.1, 0.2]}), ("--force", {"action": "store_true"}))
    command("synthetic", ("--out", {"required": True}), ("--n-models", {"type": int, "default": 150}), ("--seed", {"type": int, "default": 0}))
    command("evaluate", config, ("--split", {"choices": ["train", "val", "test"], "default": "val"}), ("--unlock-test", {"action": "store_true"}),
            ("--results-dir", {"default": "results"}))
    command("fusion", config, ("--k", {"type": int, "default": 50}), ("--fold", {"choices": ["A", "B"]}), ("--folds-file", {}))
    command("pairs", config, ("--out", {"required": True}), ("--n", {"type": int, "default": 20}), ("--train-queries", {"type": int, "default": 6000}),
            ("--seed", {"type": int, "default": 0}), ("--folds-file", {}))
    command("judge", ("--pairs", {"required": True}), ("--train-scores", {"required": True}), ("--out", {"required": True}))
    command("negatives", config, ("--out", {"required": True}), ("--k", {"type": int, "default": 20}), ("--per-query", {"type": int, "default": 5}))
    command("vectors", config, ("--out", {"required": True}), ("--dim", {"type": int, "default": 100}), ("--epochs", {"type": int, "default": 20}))
    return parser


def main(argv: list[str] | None = None) -> None:
    from likeness.operators import splits, training
    from likeness.plans import evaluate
    from likeness.sources import sinks, synthetic, tables

    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "synthetic":
        synthetic.catalogue(spark, args.n_models, args.seed).coalesce(1).write.mode("overwrite").csv(args.out, header=True)
    elif args.command == "split":
        listings = evaluate.numbered(tables.load_listings(spark, args.csv))
        split = splits.group_split(listings, tuple(args.fractions), args.seed)
        named = split.join(listings.select("id", "posting_id"), "id")
        sinks.save_split(named, splits.split_counts(listings, split), args.out, args.csv, args.seed, tuple(args.fractions), args.force)
    elif args.command == "judge":
        print(json.dumps(evaluate.train_judge(spark, args.pairs, args.train_scores, args.out)))
    else:
        config = tables.load_config(args.config)
        if args.command == "evaluate":
            print(json.dumps(evaluate.run(spark, config, args.split, args.results_dir, args.unlock_test)["metrics"], indent=2))
        elif args.command == "fusion":
            print(json.dumps(evaluate.train_fusion(spark, config, args.k, args.fold, args.folds_file)))
        elif args.command == "pairs":
            evaluate.export(spark, config, args.out, args.n, args.train_queries, args.seed, args.folds_file)
        elif args.command == "negatives":
            print(evaluate.mine(spark, config, args.out, args.k, args.per_query).count())
        elif args.command == "vectors":
            train = evaluate.split_frame(spark, config, "train")
            words = training.train_word_vectors(train, args.dim, args.epochs).persist()
            every = evaluate.numbered(tables.load_listings(spark, config["data"]["csv"]))
            from likeness.operators.bm25 import build as index

            stats = index(train, canonical_units=True).stats
            n = train.count()
            idf = stats.select("term", F.log1p(F.lit(float(n)) / F.col("df")).alias("idf"))
            for name, weights in (("mean", None), ("idf", idf)):
                found = training.title_vectors(every, words, weights).join(every.select("id", "posting_id"), "id").select("posting_id", "embedding")
                sinks.write_vectors(found, f"{args.out}/words_{name}", {"name": name, "dim": args.dim, "n_train": n})


if __name__ == "__main__":
    main()
