"""One folder from the shell: python -m gleanery FOLDER COMMAND [ARGUMENTS]. Every answer is one JSON value; exit 1 on an error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.operators import files as listing
from gleanery.plans.engine import Engine, EngineError
from gleanery.session import local_session
from gleanery.sources import folder, notes


def engine_of(spark: SparkSession, root: str, index_dir: str) -> Engine:
    """An engine over the prose and code below a local folder."""
    scanned = folder.scan(spark, root, content=True)
    seconds = F.unix_micros("mtime") / 1e6
    prose = folder.texts(scanned).select("path", seconds.alias("mtime"), "text")
    endings = listing.code_suffixes()
    sources = scanned.where(listing.suffix(F.col("path")).isin(*endings) & (F.col("bytes") <= listing.MAX_CODE_BYTES))
    return Engine(spark, prose, index_dir, sources.select("path", F.decode("content", "UTF-8").alias("text")))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gleanery", description=__doc__)
    out.add_argument("folder")
    out.add_argument("--index", help="where the index lies (default: .gleanery in the folder)")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **options: type) -> None:
        one = commands.add_parser(name)
        for a in arguments:
            one.add_argument(a)
        for option, kind in options.items():
            one.add_argument(f"--{option.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))

    command("build", rebuild=bool)
    command("search", "query", k=int, scope=str)
    command("read", "path", start=int, end=int, section=str, max_chars=int)
    command("files", scope=str, status=str, limit=int, cursor=str)
    for name in ("outline", "links", "backlinks", "lint"):
        command(name, "path")
    for name in ("orphans", "unresolved", "status", "identity"):
        command(name)
    command("pack", "target", budget=int)
    command("write", "path", "body", expect_version=str, create_only=bool)
    return out


def answer(asked: argparse.Namespace) -> object:
    given = {k: v for k, v in vars(asked).items() if k not in ("folder", "index", "command") and v is not None}
    if "scope" in given:
        given["folder"] = given.pop("scope")
    if asked.command == "identity":
        return folder.identity(asked.folder)
    if asked.command == "write":
        return notes.write_note(asked.folder, given.pop("path"), given.pop("body"), **given)
    spark = local_session(**{"spark.log.level": "ERROR"})
    engine = engine_of(spark, asked.folder, asked.index or f"{asked.folder.rstrip('/')}/.gleanery")
    if asked.command == "status":
        return [r.asDict() for r in engine.status().collect()]
    call = {"links": engine.links_of, "backlinks": engine.backlinks_of, "pack": engine.code_pack}
    return (call.get(asked.command) or getattr(engine, asked.command))(**given)


def main(arguments: list[str] | None = None) -> int:
    try:
        reply, failed = answer(parser().parse_args(arguments)), 0
    except EngineError as e:
        reply, failed = {"error": {"code": e.code, "message": str(e)}}, 1
    print(json.dumps(reply, ensure_ascii=False, default=str))
    return failed


if __name__ == "__main__":
    sys.exit(main())
