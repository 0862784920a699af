"""Command line: distill, inspect, intake, cocreate, eval."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from charloom.config import Config
from charloom.engine import Engine
from charloom.functions.text import slugify_persona_id
from charloom.model.cocreate import Setting
from charloom.sources import artifacts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("charloom")
    p.add_argument("--workdir", default="./work")
    p.add_argument("--client", help="module:name of the model client", default="")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("distill")
    d.add_argument("input")
    d.add_argument("--output", default="./out")
    d.add_argument("--persona-id", default="persona")
    d.add_argument("--eval", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("input")
    n = sub.add_parser("intake")
    n.add_argument("input")
    n.add_argument("--search", default="")
    m = sub.add_parser("method")
    m.add_argument("--output", default="")
    e = sub.add_parser("eval")
    e.add_argument("output")
    c = sub.add_parser("cocreate")
    for f in ("name", "age", "background", "traits", "worldview", "catchphrase"):
        c.add_argument(f"--{f}", default="", required=f == "name")
    c.add_argument("--rounds", type=int, default=8)
    c.add_argument("--persona-id", default="")
    return p


def client(name: str):
    if not name:
        return None
    import importlib

    module, _, attr = name.partition(":")
    return getattr(importlib.import_module(module), attr)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("charloom").getOrCreate()
    engine = Engine(spark, Config.from_env(workdir=args.workdir), client(args.client))
    if args.command == "inspect":
        engine.load(args.input).select("relpath", "ext", "size_chars", "corpus_uuid").show(50, truncate=False)
    elif args.command == "intake":
        print(engine.index(engine.mentions(engine.chunks(engine.load(args.input)))), "entries added")
        found = engine.resolve()
        print(len(found.merged), "merged,", len(found.pending), "pending")
        (engine.search(args.search) if args.search else engine.characters()).show(50, truncate=120)
    elif args.command == "distill":
        print(json.dumps(engine.distill(args.input, args.persona_id, args.output, args.eval)["metadata"], ensure_ascii=False, indent=2, default=str))
    elif args.command == "method":
        print(engine.write_method(args.output or None))
    elif args.command == "eval":
        result = artifacts.load_result(args.output)
        print(json.dumps(engine.evaluate(result, artifacts.read_distillates(spark, f"{args.output}/distillates.jsonl")), ensure_ascii=False, indent=2))
    else:
        setting = Setting(args.name, args.age, args.background, args.traits, args.worldview, args.catchphrase)
        pid = args.persona_id or spark.range(1).select(slugify_persona_id(F.lit(args.name))).first()[0]
        if not pid:
            print("give --persona-id: the name leaves none", file=sys.stderr)
            return 2
        engine.skeleton(setting, pid)
        print(engine.interview(setting, pid, args.rounds)["path"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
