"""Command line: python -m tidemark.cli [--config FOLDER] COMMAND."""

from __future__ import annotations

import argparse
import logging
import sys

from tidemark.config import load_config
from tidemark.plans.pipeline import Study
from tidemark.session import build_session, prepare

log = logging.getLogger("tidemark")
STEPS = ["ingest", "build-events", "validate-events", "build-features", "validate-features", "build-labels", "train", "ablate", "backtest", "train-drift", "report"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("--config", help="folder of YAML files, one per section")
    top.add_argument("--output", help="output folder")
    top.add_argument("--stocks", type=int)
    top.add_argument("--golden", help="CSV of known cases that validate-events holds the effective dates against")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", *STEPS, "run-all"):
        one = sub.add_parser(name)
        if name in ("train", "ablate", "backtest"):
            one.add_argument("--target", default="reaction_car")
        if name == "backtest":
            one.add_argument("--model", default="surprise")
    return top


def run(study: Study, command: str, target: str = "reaction_car", model: str = "surprise") -> object:
    if command == "train-drift":
        return study.train("drift_car_20")
    arguments = {"train": (target,), "ablate": (target,), "backtest": (model, target)}.get(command, ())
    return getattr(study, command.replace("-", "_"))(*arguments)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    args = parser().parse_args(argv)
    overrides = {f"base__{k}": v for k, v in (("output", args.output), ("stocks", args.stocks), ("golden", args.golden)) if v is not None}
    config = load_config(args.config, **overrides)
    if args.command == "inspect":
        print(config.sections, config.digest())
        return 0
    study = Study(prepare(build_session("tidemark")), config)
    for step in STEPS if args.command == "run-all" else [args.command]:
        try:
            log.info("%s: %s", step, run(study, step, getattr(args, "target", "reaction_car"), getattr(args, "model", "surprise")))
        except ValueError as error:
            log.error("%s failed: %s", step, error)
            return 2 if args.command == "run-all" else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
