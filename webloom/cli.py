"""Command line: ``python -m webloom.cli --root DIR OBJECT VERB [SUBVERB] [options]``."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from webloom.operators import images
from webloom.workspace import Workspace

#: object -> verb -> workspace method; a nested verb is joined by a space.
COMMANDS = {
    "db": {"setup": "db_setup", "migrate": "db_migrate", "fix_archive_domains": "fix_archive_domains"},
    "domain": {"crawl": "domain_crawl"},
    "land": {
        "list": "land_list", "create": "land_create", "delete": "land_delete", "addterm": "land_addterm", "addurl": "land_addurl", "urlist": "land_urlist", "crawl": "land_crawl", "readable": "land_readable",
        "consolidate": "land_consolidate", "export": "land_export", "medianalyse": "land_medianalyse", "seorank": "land_seorank", "llm validate": "land_llm_validate",
    },
    "tag": {"export": "tag_export"},
    "embedding": {"generate": "embedding_generate", "similarity": "embedding_similarity", "check": "embedding_check", "reset": "embedding_reset"},
    "heuristic": {"update": "heuristic_update"},
}


def dispatch(workspace: Workspace, obj: str, verb: str, **options):
    """Run one command; unknown objects and verbs are errors."""
    if obj not in COMMANDS:
        raise ValueError(f"unknown object {obj!r}")
    if verb not in COMMANDS[obj]:
        raise ValueError(f"unknown verb {verb!r} of {obj}")
    return getattr(workspace, COMMANDS[obj][verb])(**{k: v for k, v in options.items() if v is not None})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("object")
    p.add_argument("verb", nargs="+")
    for name, kind in (("name", str), ("description", str), ("lang", str), ("addresses", str), ("path", str), ("export", str), ("folder", str), ("method", str), ("provider", str), ("limit", int), ("depth", int), ("minrel", int), ("maxrel", int), ("topk", int), ("lshbits", int), ("maxpairs", int), ("threshold", float)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--terms", type=lambda t: t.split(","))
    p.add_argument("--as-of", type=datetime.fromisoformat)
    p.add_argument("--store", help="Parquet table of stored markup (url, html) for crawl")
    p.add_argument("--payloads", help="Parquet table (url, seorank) for seorank")
    p.add_argument("--answers", help="Parquet table (id, answer) for llm validate")
    p.add_argument("--images", help="Parquet table of files (url, content) for medianalyse")
    p.add_argument("--dryrun", action="store_true", default=None)
    a = vars(p.parse_args(argv))
    spark = SparkSession.builder.appName("webloom").getOrCreate()
    store = a.pop("store")
    plugs = {"payloads": lambda t: lambda pages: pages.join(t, "url").select("id", "seorank"), "answers": lambda t: lambda prompts: prompts.select("id").join(t, "id"), "images": images.of_store}
    for name, plug in plugs.items():
        if path := a.pop(name):
            a["analyse" if name == "images" else name] = plug(spark.read.parquet(path))
    options = {k: v for k, v in a.items() if k not in ("root", "object", "verb")}
    out = dispatch(Workspace(spark, a["root"]), a["object"], " ".join(a["verb"]), fetch=spark.read.parquet(store) if store else None, **options)
    if isinstance(out, DataFrame):
        out.show(1000, truncate=False)
    elif out is not None:
        print(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
