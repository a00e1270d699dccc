"""``python -m kistwerk.cli --root DIR ...``: prints the replay report; exit code 1 for an error or a failed gate."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from kistwerk.plans.options import OptionError, ReplayOptions
from kistwerk.plans.report import GateError, replay


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0", "t", "f"):
        raise argparse.ArgumentTypeError(f"not a boolean: {text}")
    return text.lower() in ("true", "1", "t")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kistwerk")
    blank = ReplayOptions()
    for f in fields(ReplayOptions):
        name, default = "--" + f.name.replace("_", "-"), getattr(blank, f.name)
        if isinstance(default, bool):
            out.add_argument(name, type=_flag, nargs="?", const=True, default=default)
        elif isinstance(default, list):
            out.add_argument(name, type=lambda v: v.split(","), default=default)
        else:
            out.add_argument(name, type=float if f.type == "float" else type(default), default=default)
    return out


def main(args: list[str] | None = None) -> int:
    try:
        options = ReplayOptions(**vars(parser().parse_args(args))).validate()
        spark = SparkSession.builder.appName("kistwerk").getOrCreate()
        report, code = replay(spark, options), 0
    except GateError as e:
        print(e, file=sys.stderr)
        report, code = e.report, 1
    except (OptionError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if not options.output:
        print(json.dumps(report, indent=2, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
