"""Batch command line: the service's endpoints and the report tool as Spark jobs.

    python -m piisift scrub  --input docs.parquet  --output out/  [--format json]
    python -m piisift guard  --input answers.json  --input-format json --output out/
    python -m piisift report --input pages.parquet --output out/

``scrub`` and ``guard`` read a table with ``doc_id`` and ``text`` columns (or
``--id-col``/``--text-col``) and write one JSON response per row in the
service's shape; ``report`` reads pages ``(doc_id, page_no, text)`` and writes
one document report per document, over whole documents.  ``--responses`` takes
a table of model answers ``(doc_id, task, response[, answer_no])``, merged by
all three.  ``--allowlist`` takes a parquet/JSON table ``(kind,
value)`` of any size, on top of the shipped list.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from piisift.config import DEFAULT_ALLOWLIST, DetectorConfig
from piisift.operators.guard import guard, hybrid_guard, hybrid_scrub, scrub
from piisift.operators.reports import page_report
from piisift.session import get_spark
from piisift.sources.texts import guard_response, read_texts, scrub_response


def _read(spark, path: str):
    return spark.read.format("json" if path.endswith(".json") else "parquet").load(path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="piisift")
    ap.add_argument("command", choices=["scrub", "guard", "report"])
    ap.add_argument("--input", required=True)
    ap.add_argument("--input-format", default="parquet")
    ap.add_argument("--output", required=True)
    ap.add_argument("--format", default="json", help="output format (json or parquet)")
    ap.add_argument("--id-col", default="doc_id")
    ap.add_argument("--text-col", default="text")
    ap.add_argument("--allowlist", help="table (kind, value); default: the shipped list")
    ap.add_argument("--responses", help="model answers (doc_id, task, response[, answer_no])")
    ap.add_argument("--names", action="store_true", help="also detect NAME candidates (off = parity)")
    args = ap.parse_args(argv)

    spark = get_spark()
    table = None
    if args.allowlist:
        table = _read(spark, args.allowlist)
    config = DetectorConfig(allowlist=DEFAULT_ALLOWLIST, name_candidates=args.names)

    if args.command == "report":
        pages = spark.read.format(args.input_format).load(args.input)
        entities = F.transform("entities", lambda e: F.struct(e["ptype"].alias("type"), e["value"].alias("value")))
        answers = _read(spark, args.responses) if args.responses else None
        out = page_report(pages, config, doc_col=args.id_col, text_col=args.text_col, answers=answers, allowlist_table=table).select(
            "doc_id",
            F.to_json(F.struct("pii_score", "blocked", "total_matches", entities.alias("entities"), "preview")).alias("response"),
        )
    else:
        texts = read_texts(spark, args.input, args.input_format, args.id_col, args.text_col)
        answers = _read(spark, args.responses) if args.responses else None
        if args.command == "scrub":
            done = hybrid_scrub(texts, answers, config=config, allowlist_table=table) if answers is not None else scrub(texts, config=config, allowlist_table=table)
            out = scrub_response(done)
        else:
            done = hybrid_guard(texts, answers, config=config, allowlist_table=table) if answers is not None else guard(texts, config=config, allowlist_table=table)
            out = guard_response(done)
    out.write.mode("overwrite").format(args.format).save(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
