"""Command line over a folder of CSV files: experiment, samplers, prepare (what a generator trains on), convert (its sample as a graph), check (the session)."""

from __future__ import annotations

import argparse

from .plans import build, learn, report
from .session import session
from .sources import csv

MODEL, PRIVACY = learn.ModelConfig(), learn.PrivacyConfig(ratio=3)
#: Defaults fixed by the interface, by command: rows, rows scanned, share of positives.
SLICE = {"experiment": (600_000, 2_000_000, 0.05), "samplers": (200_000, 1_000_000, 0.06), "prepare": (80_000, 500_000, 0.05), "convert": (300_000, 2_000_000, 0.05)}


def arguments() -> argparse.ArgumentParser:
    """Names and defaults of the options are the interface's, so they are fixed."""
    top = argparse.ArgumentParser(prog="tallygraph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("check")
    for name, (rows, scanned, share) in SLICE.items():
        p = commands.add_parser(name)
        p.add_argument("folder")
        p.add_argument("--max_transactions", type=int, default=rows)
        p.add_argument("--slice_mode", choices=build.SLICES, default="prefix")
        p.add_argument("--balance_scan_rows", type=int, default=scanned)
        p.add_argument("--target_edge_pos_fraction", type=float, default=share)
        p.add_argument("--seed", type=int, default=7)
        p.add_argument("--max_nodes", type=int, default=1000 if name == "prepare" else 1200)
        p.add_argument("--seed_strategy", choices=("top_sar_by_degree", "all_sar", "top_degree"), default="top_sar_by_degree")
        p.add_argument("--neighbor_hops", type=int, default=2, help="hops of fraud_enriched sampling")
        p.add_argument("--snowball_top_k", type=int, default=20)
        p.add_argument("--snowball_wave_limit", type=int, default=15)
        p.add_argument("--no_stratify_edges", action="store_true")
        p.add_argument("--no_stratify_nodes", action="store_true")
        p.add_argument("--out_dir", default="outputs")
    for name in ("prepare", "convert"):
        commands.choices[name].add_argument("--sampling", choices=build.SAMPLING, default="random_induced")
    p = commands.choices["convert"]
    p.add_argument("--sample", required=True, help="folder of the generator's sample: nodes (node, features, y) and pairs (u, v) as Parquet")
    p.add_argument("--syn_edge_fraud_rate", type=float)
    p.add_argument("--syn_edge_fraud_rate_floor", type=float, default=0.0)
    p.add_argument("--min_directed_edges", type=int, default=4096)
    p = commands.choices["experiment"]
    p.add_argument("--all_transactions", action="store_true")
    p.add_argument("--generator", choices=("from_files", "from_pt", "degree_preserving", "snowball"), default="degree_preserving")
    p.add_argument("--synthetic", "--synthetic_pt", help="folder of a stored graph, for from_files")
    p.add_argument("--no_self_loops", action="store_true", help="repair the self-loops of degree_preserving")
    p.add_argument("--min_synthetic_nodes", type=int, default=50_000)
    p.add_argument("--edges_only", action="store_true")
    p.add_argument("--warm_start", action="store_true")
    p.add_argument("--use_dp", action="store_true")
    p.add_argument("--checkpoint_dir", help="with --use_dp: folder, in any store Spark reaches, for the weights of each epoch and the best ones; an interrupted run goes on from there")
    for name, field in (("noise_multiplier", "noise"), ("max_grad_norm", "clip"), ("delta", "delta"), ("batch_size", "batch"), ("steps_per_epoch", "steps"), ("num_hops", "hops"), ("pos_to_neg_ratio", "ratio")):
        default = getattr(PRIVACY, field)
        p.add_argument(f"--dp_{name}", dest=field, type=type(default), default=default)
    for name in ("node_epochs", "edge_epochs", "syn_node_epochs", "syn_edge_epochs"):
        p.add_argument(f"--{name}", type=int, default=getattr(MODEL, name))
    return top


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = session()
    if a.command == "check":
        spark.sql("SELECT 1 AS ok, version() AS spark").show(truncate=False)
        return
    options = {"max_transactions": a.max_transactions, "slice_mode": a.slice_mode, "balance_scan_rows": a.balance_scan_rows, "target_edge_pos_fraction": a.target_edge_pos_fraction, "seed": a.seed}
    if a.command == "samplers":
        options.pop("slice_mode")
        scanned = build.load_scanned(spark, csv.resolve_paths(spark, a.folder).transactions, **options)
        stats, waves = build.sampler_comparison(scanned, a.max_nodes, a.seed, top_k=a.snowball_top_k, waves=a.snowball_wave_limit)
        stats.show(truncate=False)
        waves.show(truncate=False)
        return
    if getattr(a, "all_transactions", False) or a.max_transactions <= 0:
        options["max_transactions"] = None
    real = build.load_graph(spark, a.folder, stratify_edges=not a.no_stratify_edges, stratify_nodes=not a.no_stratify_nodes, **options)
    sample = lambda mode: build.sampled(real, mode, a.max_nodes, a.seed, hops=a.neighbor_hops, top_k=a.snowball_top_k, waves=a.snowball_wave_limit, strategy=a.seed_strategy)
    if a.command == "prepare":
        bits = build.generator_input(sample(a.sampling), real.meta["node_columns"])
        names = [c for c in bits.nodes.columns if c not in ("node", "y")]
        csv.write_graph(bits, f"{a.out_dir}/generator_input")
        build.marginals(bits, names).write.mode("overwrite").parquet(f"{a.out_dir}/marginals")
        return
    if a.command == "convert":
        rate = real.meta["edge_rate"] or 0.0
        exact = a.syn_edge_fraud_rate is not None
        graph = build.from_sample(
            spark, spark.read.parquet(f"{a.sample}/nodes"), spark.read.parquet(f"{a.sample}/pairs"), node_width=real.meta["node_width"], edge_width=real.meta["edge_width"], seed=a.seed,
            edge_rate=a.syn_edge_fraud_rate if exact else rate, rate_floor=0.0 if exact else a.syn_edge_fraud_rate_floor, least_edges=a.min_directed_edges,
        )
        csv.write_graph(graph, f"{a.out_dir}/synthetic")
        return
    make = {
        "degree_preserving": lambda: build.degree_preserving(real, a.seed, allow_self_loops=not a.no_self_loops),
        "snowball": lambda: sample("snowball"),
        "from_files": lambda: build.from_files(spark, a.synthetic, real, a.seed),
    }["from_files" if a.generator == "from_pt" else a.generator]
    config = learn.ModelConfig(node_epochs=a.node_epochs, edge_epochs=a.edge_epochs, syn_node_epochs=a.syn_node_epochs, syn_edge_epochs=a.syn_edge_epochs, seed=a.seed, edges_only=a.edges_only, warm_start=a.warm_start)
    privacy = learn.PrivacyConfig(noise=a.noise, clip=a.clip, delta=a.delta, batch=a.batch, steps=a.steps, hops=a.hops, ratio=a.ratio) if a.use_dp else None
    run = learn.Transfer(config, real.meta["node_columns"], real.meta["edge_columns"], privacy, a.checkpoint_dir if a.use_dp else None)
    out = run.run(real, make, least_nodes=a.min_synthetic_nodes if a.generator in ("from_files", "from_pt") else 0)
    name = report.result_name(real.meta["n_nodes"], real.meta["n_edges"], a.max_transactions, a.generator, edges_only=a.edges_only, private=a.use_dp)
    report.write_json(f"{a.out_dir}/{name}", {"meta": real.meta} | out)


if __name__ == "__main__":
    main()
