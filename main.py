"""Run experiments: ``python main.py --variant NAME|all [--ingest] [--qa]``."""

from __future__ import annotations

import argparse
import logging
import sys

from lodestone.config import list_variants, load_config
from lodestone.plans.pipelines import run_ingest, run_qa
from lodestone.plugins import offline_models, service_models
from lodestone.session import build_session
from lodestone.sources.logs import session_path


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--variant", required=True, help='name of a variant, or "all"')
    p.add_argument("--ingest", action="store_true", help="ingest the documents of the dataset")
    p.add_argument("--qa", action="store_true", help="answer the questions of the dataset")
    p.add_argument("--data-dir", default="data/raw", help="folder of the datasets")
    p.add_argument("--output-dir", default="evaluations", help="folder of the results")
    p.add_argument("--config", default=None, help="YAML file with the variants")
    p.add_argument("--models", choices=("offline", "service"), default="service",
                   help="offline: deterministic stand-ins that need no network")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    if not (args.ingest or args.qa):
        print("nothing to do: give --ingest, --qa or both", file=sys.stderr)
        return 1
    logging.basicConfig(level=logging.INFO)
    names = list_variants(args.config) if args.variant == "all" else [args.variant]
    configs = [load_config(name, args.config) for name in names]
    spark = build_session()
    for config in configs:
        models = offline_models() if args.models == "offline" else service_models(config)
        log = session_path(config.telemetry.output_dir, config.variant_name)
        if args.ingest:
            run_ingest(spark, config, models, args.data_dir, log)
        if args.qa:
            print(run_qa(spark, config, models, args.data_dir, args.output_dir, log))
    return 0


if __name__ == "__main__":
    sys.exit(main())
