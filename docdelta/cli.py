"""python -m docdelta.cli OLD NEW: compare two documents (PDF, or text files with form feeds between pages)."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from docdelta.plans.client import ChatClient, duration
from docdelta.plans.pipeline import Engine
from docdelta.sources.layout import ExtractionError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("old", help="the old version")
    p.add_argument("new", help="the new version")
    p.add_argument("--output-dir", default="outputs/comparison", help="folder for JSON and HTML artifacts")
    p.add_argument("--llm-provider", default="none", help="none, openai, or any other with --llm-base-url")
    p.add_argument("--llm-base-url", default="", help="chat-completions endpoint for summaries (none: fixed sentences)")
    p.add_argument("--llm-model", default="", help="model name for it")
    p.add_argument("--llm-key-variable", default="LLM_API_KEY", help="environment variable with its key")
    p.add_argument("--debug", action="store_true", help="also write the pages table")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    provider = "custom" if args.llm_base_url and args.llm_provider == "none" else args.llm_provider
    client = ChatClient(args.llm_base_url, os.environ.get(args.llm_key_variable, ""), args.llm_model, provider=provider)
    spark = SparkSession.builder.appName("docdelta").getOrCreate()
    engine = Engine(spark, client if client.address else None)

    def say(message: str) -> None:
        print(message, file=sys.stderr, flush=True)

    try:
        if args.old.lower().endswith(".pdf") or args.new.lower().endswith(".pdf"):
            result = engine.compare_pdfs(args.old, args.new, args.output_dir, say, args.debug)
        else:
            texts = None
            for side, path in (("v1", args.old), ("v2", args.new)):
                one = spark.read.text(path, wholetext=True).selectExpr("'pair' AS pair_id", f"'{side}' AS side", "value AS text")
                texts = one if texts is None else texts.union(one)
            result = engine.compare_texts(texts, args.output_dir, say)
    except ExtractionError as e:
        print(f"extraction failed: {e}", file=sys.stderr)
        return 2
    counts, t = result.kpi_summary, result.timings
    print(f"{counts['total']} changes: {counts['added']} added, {counts['deleted']} deleted, {counts['changed']} changed")
    if "extraction" in t:
        print(f"Extraction {duration(t['extraction'])}")
    print(f"Structuring {duration(t['structuring'])}, comparing {duration(t['matching'] + t['diffing'])}, total {duration(t['total'])}")
    print(f"Artifacts: {args.output_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
