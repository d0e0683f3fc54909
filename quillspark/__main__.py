"""Command line: build an index from files, and complete prompts with it."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.engine import Autocomplete


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build an index from .txt, .pdf and .docx files")
    b.add_argument("files", nargs="+", type=Path)
    b.add_argument("--output")
    b.add_argument("--profile", default="balanced")
    s = sub.add_parser("suggest", help="complete a prompt, or each line of the standard input")
    s.add_argument("--index", required=True)
    s.add_argument("--topk", type=int)
    s.add_argument("--max-words", type=int)
    s.add_argument("text", nargs="?")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if a.command == "build":
        engine = Autocomplete.create(spark, a.files, quality_profile=a.profile)
        print(engine.save(a.output))
        return 0
    engine = Autocomplete.load(spark, a.index)
    for text in [a.text] if a.text is not None else (line.rstrip("\n") for line in sys.stdin):
        print("\n".join(engine.complete(text, topk=a.topk, max_words=a.max_words)), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
