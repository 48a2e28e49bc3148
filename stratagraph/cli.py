"""Command line: a dataset to levels of landmarks with embeddings, written as Parquet.

spark-submit stratagraph/cli.py --dataset SWISSROLL --sampling HUBS --connection SL-BFS --level 2 --output out
"""

from __future__ import annotations

import argparse
import inspect
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.features import add_noise
from stratagraph.functions.session import checkpoint
from stratagraph.operators.connecting import CONNECTORS, Connecting
from stratagraph.operators.hierarchy import build, embed
from stratagraph.operators.sampling import SAMPLERS, Sampling
from stratagraph.sources.datasets import DATASETS, load_dataset, save_levels

SPARSE_FROM, SPARSE_THRESHOLD = 20_000, 1e-4


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dataset", default="SWISSROLL", choices=sorted(set(DATASETS) - {"GAUSSIANS"}))
    p.add_argument("--sampling", default="RANDOM", choices=sorted(SAMPLERS))
    p.add_argument("--connection", default="CON", choices=sorted(CONNECTORS))
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--output", default=".")
    p.add_argument("--noise", type=float, default=0.0)
    p.add_argument("--reduction", type=float, default=0.2)
    p.add_argument("--directed", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--weighted", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--directory", default=None)
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--level", type=int, default=1, choices=(1, 2, 3))
    p.add_argument("--random_init", action=argparse.BooleanOptionalAction, default=False)
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    """Levels, their embeddings and the run's configuration, under the output folder."""
    a = options().parse_args(argv)
    needs = "directory" in inspect.signature(DATASETS[a.dataset]).parameters
    points = load_dataset(spark, a.dataset, **({"directory": a.directory or "."} if needs else {}))
    points = checkpoint(add_noise(points.select("node", "features"), a.noise, a.seed, a.dataset))
    threshold = SPARSE_THRESHOLD if a.connection == "EXACT" and points.count() > SPARSE_FROM else 0.0
    sampling = Sampling(a.sampling, a.reduction, a.seed, a.k)
    connecting = Connecting(a.connection, a.k, seed=a.seed, threshold_i=threshold, threshold_t=threshold)
    levels = build(points, sampling, connecting, a.level, a.k, a.directed, a.weighted)
    save_levels(levels, a.output)
    for x in levels:
        embed(x, points, a.random_init, a.seed).drop("level").write.mode("overwrite").parquet(f"{a.output}/embedding/level={x.level}")
    config = vars(a) | {"sampling_config": asdict(sampling), "connecting_config": asdict(connecting)}
    spark.range(1).select(*[F.lit(str(v)).alias(k) for k, v in config.items()]).write.mode("overwrite").parquet(f"{a.output}/config")


def main() -> None:
    import sys

    run(SparkSession.builder.appName("stratagraph").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
