"""Command line for the three programs of the reference (M4-M6), for ``spark-submit``.

    spark-submit --py-files rubricon.zip rubricon/cli.py score   --input A --output B --scorer pkg.mod:factory [--head D/model]
    spark-submit ... rubricon/cli.py profile --input A --output-dir D [--score-col pred_score]
    spark-submit ... rubricon/cli.py fit     --vectors V --output D [--tolerance 1.0] [--test-size 0.2]
    spark-submit ... rubricon/cli.py agree   --input A --output D [--pred pred --label label --group g]

Inputs are Parquet unless ``--format`` says otherwise; the session comes from
``spark-submit`` (``getOrCreate``), so cluster settings, including
``spark.checkpoint.dir``, are whatever the launcher configured.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession


def _read(spark, path, fmt):
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(path)


def _factory(spec: str):
    mod, _, name = spec.partition(":")
    if not name:
        raise SystemExit("--scorer must look like package.module:factory")
    return getattr(importlib.import_module(mod), name)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="rubricon")
    sub = ap.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("score", help="score every row of an answer table (status per row)")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--scorer", required=True,
                   help="package.module:factory returning scorer(texts)->scores; with --head, a factory "
                        "returning embed(texts)->(batch, D) vectors")
    s.add_argument("--head", default=None, help="fitted head written by `fit` (its model/ folder)")
    s.add_argument("--id-col", default="BMH")
    s.add_argument("--text-col", default="OCR文字结果")
    s.add_argument("--batch-size", type=int, default=16)
    s.add_argument("--order", default=None, help="'input': the reference's batches, in the order of the input files; or a column name")
    s.add_argument("--reference-layout", action="store_true", help="write the original score and status columns")

    p = sub.add_parser("profile", help="length and score profiles")
    p.add_argument("--input", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--text-col", default="OCR文字结果")
    p.add_argument("--score-col", default="pred_score")

    f = sub.add_parser("fit", help="fit the ordinal head on frozen vectors and validate")
    f.add_argument("--vectors", required=True, help="table (BMH, pooled array<double>, label double)")
    f.add_argument("--output", required=True)
    f.add_argument("--vec-col", default="pooled")
    f.add_argument("--test-size", type=float, default=0.2)
    f.add_argument("--seed", type=int, default=42)
    f.add_argument("--tolerance", type=float, default=0.0)
    f.add_argument("--reg-param", type=float, default=1e-3)
    f.add_argument("--max-iter", type=int, default=100)
    f.add_argument("--eval-every", type=int, default=None, help="validate after every so many passes and keep the best head")

    a = sub.add_parser("agree", help="agreement metrics between two score columns")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--pred", default="pred")
    a.add_argument("--label", default="label")
    a.add_argument("--group", action="append", default=[])
    a.add_argument("--tolerance", type=float, default=None)

    for sp in (s, p, f, a):
        sp.add_argument("--format", default="parquet")
    args = ap.parse_args(argv)

    from rubricon import jobs
    from rubricon.operators import agree, prepare
    from rubricon.sources.answers import require_columns
    from rubricon.sources.sinks import write_metrics_json
    from rubricon.session import checkpoint_dir

    spark = SparkSession.builder.appName(f"rubricon-{args.cmd}").getOrCreate()
    checkpoint_dir(spark)

    if args.cmd == "score":
        df = _read(spark, args.input, args.format)
        require_columns(df, [args.id_col, args.text_col], "input table")
        factory = _factory(args.scorer)
        if args.head:
            from rubricon.sources.sinks import load_head
            factory = jobs.ordinal_text_scorer(factory, load_head(spark, args.head), spark)
        scored, counts = jobs.score_table(df, factory, args.output, args.id_col,
                                          args.text_col, args.batch_size, args.format, args.order,
                                          args.reference_layout)
        for r in counts.collect():
            print(f"{r['status']}={r['n']}")
    elif args.cmd == "profile":
        df = _read(spark, args.input, args.format)
        for name, out in jobs.profile_table(df, args.text_col, args.score_col).items():
            out.write.mode("overwrite").json(f"{args.output_dir}/{name}")
    elif args.cmd == "fit":
        v = _read(spark, args.vectors, args.format)
        require_columns(v, ["BMH", args.vec_col, "label"], "vector table")
        labelled, pts = prepare.encode_ordinal(v, "label")
        points = [r["label"] for r in pts.orderBy("label_idx").collect()]
        split = prepare.split_exact(labelled, ["BMH"], args.test_size, args.seed)
        head, metrics = jobs.fit_and_validate(split, points, args.vec_col, args.tolerance,
                                              args.reg_param, args.max_iter, args.output, args.eval_every)
        for r in metrics.collect():
            print(f"{r['metric']}={r['value']}")
    elif args.cmd == "agree":
        df = _read(spark, args.input, args.format)
        m = agree.compute_metrics(df, args.pred, args.label, args.group, args.tolerance)
        write_metrics_json(m, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
