"""Command line: python -m quarry corpus | index | evaluate | labels (see --help of each)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """HTML filings to blocks, chunks and an ingest log. --rechunk starts from the blocks at --out."""
    from quarry.operators import corpus as c
    from quarry.sources import files, html, sinks

    blocks_at, chunks_at = f"{a.out}/blocks", f"{a.out}/chunks"
    if not a.rechunk:
        raw = files.raw_filings(spark, a.html)
        if a.limit is not None:
            raw = raw.orderBy("filing_stem").limit(a.limit)
        html.parse(raw).write.mode("overwrite").parquet(blocks_at)
    blocks = spark.read.parquet(blocks_at)
    c.pack_chunks(c.atoms(blocks)).write.mode("overwrite").parquet(chunks_at)
    stats = c.block_stats(blocks.withColumn("is_table", F.col("rows").isNotNull())).join(c.filing_stats(spark.read.parquet(chunks_at)), "filing_stem", "left")
    sinks.append_events(stats.withColumnRenamed("filing_stem", "stem").withColumn("status", F.lit("ok")), f"{a.out}/log")


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Appends new filings' chunks to the table and to the term index."""
    from quarry.model import served
    from quarry.operators.corpus import not_loaded
    from quarry.operators.retrieval import Bm25Index
    from quarry.sources import files, sinks

    chunks = spark.read.parquet(a.chunks)
    for name, kind in (("variant", "string"), ("embedding", "array<float>"), ("id", "long"), ("ingested_at", "timestamp")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit("A") if name == "variant" else F.lit(None).cast(kind))
    keyed = lambda df: df.withColumn("id", F.coalesce("id", F.xxhash64("filing_stem", "chunk_index", "variant")))
    if files.exists(spark, f"{a.terms}/totals"):
        new = not_loaded(chunks, spark.read.parquet(f"{a.terms}/filings"))
        if not new.isEmpty():
            Bm25Index.append(served(keyed(new)), a.terms)
    else:
        Bm25Index.build(served(keyed(chunks))).write(a.terms)
    done = {"appended": sinks.append_new(chunks, a.table)}
    spark.read.parquet(a.table).select("filing_stem").distinct().write.mode("overwrite").parquet(f"{a.terms}/filings")
    print(json.dumps(done))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Report of a split's rankings against gold labels (split, id, gold): of stored ones (--scores, --cell), or with --live of what is
    retrieved now (--chunks, --terms, --lexicon, --questions, --vectors, --words)."""
    from quarry.plans import evaluate as e
    from quarry.sources import files

    labels = e.split_of(spark.read.parquet(f"{a.gold}/labels"), a.split, a.limit)
    if a.live:
        from quarry.model import served
        from quarry.operators import resolve
        from quarry.operators.retrieval import Bm25Index
        from quarry.plans.retrieve import Engine

        vectors = spark.read.parquet(a.vectors).select(F.col("id").alias("query_id"), "vector")
        engine = Engine(served(spark.read.parquet(a.chunks)), Bm25Index.read(spark, a.terms), resolve.load(*files.lexicon(spark, a.lexicon), files.word_list(spark, [a.words])), lambda q: q.join(vectors, "query_id"))
        asked = spark.read.schema(files.QUESTIONS).json(a.questions).join(labels.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "question").dropDuplicates(["query_id"])
        ranked = engine.retrieve(asked, 50)
        stems = spark.read.schema(files.QUESTIONS).json(a.questions).select("id", files.filing_stem(F.col("company_symbol"), F.col("report_year"), F.col("company_cik")).alias("stem")).dropDuplicates(["id"])
        labels = labels.join(stems, "id")
    else:
        ranked = files.ranking(files.score_lines(spark, a.scores), a.cell).withColumnRenamed("id", "query_id")
        labels = labels.withColumn("stem", F.col("row_key"))
    key = F.transform("gold", lambda i: F.concat_ws("#", "stem", i.cast("string")))
    report = e.replay(ranked, labels.select(F.col("id").alias("query_id"), key.alias("relevant")))
    if a.out:
        from quarry.sources import sinks

        sinks.write_json(report, a.out)
    print(report.toJSON().first())


def labels(spark: SparkSession, a: argparse.Namespace) -> int:
    """build makes labels from --questions, --evidence, --tables, --summaries and --chunks (or takes them ready from --new) and writes
    them, unless they moved; check lists what moved."""
    from quarry.operators.gold import label_diff
    from quarry.sources import sinks

    if a.new:
        new, marks = spark.read.parquet(a.new), {"code": a.fingerprint}
    else:
        from quarry.model import served
        from quarry.operators.corpus import matched_questions
        from quarry.plans import labels as made
        from quarry.sources import files

        asked = spark.read.schema(files.QUESTIONS).json(a.questions)
        chunks = served(spark.read.parquet(a.chunks))
        parts = {"questions": matched_questions(asked, chunks.select("filing_stem")), "evidence": files.evidence(spark, a.evidence), "tables": files.gold_tables(spark, a.tables), "summaries": files.summaries(spark, a.summaries), "chunks": chunks.select("filing_stem", "chunk_index", "text")}
        new, marks = made.build(*parts.values()), made.fingerprint(parts)
    if a.action == "build":
        sinks.write_labels(new, a.path, marks, a.allow_moved)
        return 0
    moved = label_diff(sinks.read_labels(spark, a.path, marks), new).orderBy("split", "id")
    n = moved.count()
    for r in moved.limit(50).collect():
        print(r.split, r.id, r.change)
    return int(n > 0)


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("corpus", help=corpus.__doc__)
    c.add_argument("--html", default="")
    c.add_argument("--out", required=True)
    c.add_argument("--limit", type=int)
    c.add_argument("--rechunk", action="store_true")
    i = sub.add_parser("index", help=index.__doc__)
    for name in ("--chunks", "--table", "--terms"):
        i.add_argument(name, required=True)
    e = sub.add_parser("evaluate", help=evaluate.__doc__)
    e.add_argument("--gold", required=True)
    e.add_argument("--live", action="store_true")
    for name in ("--scores", "--cell", "--chunks", "--terms", "--lexicon", "--questions", "--vectors", "--words"):
        e.add_argument(name, default="")
    e.add_argument("--split", default="dev", choices=["dev", "test"])
    e.add_argument("--limit", type=int)
    e.add_argument("--out")
    g = sub.add_parser("labels", help=labels.__doc__)
    g.add_argument("action", choices=["build", "check"])
    g.add_argument("--path", required=True)
    for name in ("--new", "--fingerprint", "--questions", "--evidence", "--tables", "--summaries", "--chunks"):
        g.add_argument(name, default="")
    g.add_argument("--allow-moved", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"quarry {a.command}").getOrCreate()
    return {"corpus": corpus, "index": index, "evaluate": evaluate, "labels": labels}[a.command](spark, a) or 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
