"""``python -m strophe.cli validate|prepare ROOT``: a catalog of song directories."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    from strophe.config import Config
    from strophe.plans import prepare
    from strophe.session import local_session
    from strophe.sources import catalog

    parser = argparse.ArgumentParser(prog="strophe")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "prepare"):
        p = sub.add_parser(name)
        p.add_argument("root")
    p.add_argument("--out", required=True)
    p.add_argument("--backend", default="kana")
    p.add_argument("--lexicon", help="parquet table of surface, reading, pos")
    p.add_argument("--format", choices=["json", "parquet", "csv"], default="parquet")
    args = parser.parse_args(argv)
    spark = local_session()
    if args.command == "validate":
        errors = catalog.input_errors(spark, args.root).orderBy("song_id", "problem")
        n = 0
        for r in errors.toLocalIterator():
            n += 1
            print(f"{r['song_id']}: {r['problem']}")
        return int(n > 0)
    lines = catalog.timeline(spark, args.root).select(
        F.xxhash64("song_id", "source_index").alias("line_id"), F.col("song_id").alias("song_dir"), "song_id", "source_index", "text", "start_ms", "end_ms", F.lit(0).alias("loaded_at")
    )
    lexicon = spark.read.parquet(args.lexicon) if args.lexicon else None
    catalog.exports(prepare.prepare(lines, Config(g2p_backend=args.backend), lexicon=lexicon), args.out, args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
