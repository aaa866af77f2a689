"""Command line: build a catalog of a workspace, query it, find definitions, print its figures.

    python -m corpusloom build ROOT --out DIR [--dim N] [--max-file-bytes N]
    python -m corpusloom query DIR TEXT [--k N] [--threshold X] [--relative X] [--scope PART ...] [--no-hybrid] [--json]
    python -m corpusloom define DIR SYMBOL
    python -m corpusloom stats DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieval, search
from corpusloom.session import build_session, cut
from corpusloom.sources import catalog, workspace


def opened(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) of a catalog as retrieval takes them."""
    chunks = tables["chunks"].select(F.col("chunk_id").cast("string").alias("chunk"), "path", "line_start", "line_end", "text", F.col("token_estimate").alias("tokens"))
    vectors = tables["vectors"].select(F.col("id").cast("string").alias("id"), "vector")
    return chunks, vectors.join(chunks.select(F.col("chunk").alias("id"), "path"), "id")


def answer(spark: SparkSession, path: str, text: str, limits: retrieval.Limits, scope: list[str], hybrid: bool = True) -> DataFrame:
    """The result of one request over a catalog: scoped and dense with parts of paths, else hybrid."""
    tables = catalog.open_catalog(spark, path)
    chunks, vectors = opened(tables)
    asked = spark.createDataFrame([(0, text)], "q long, text string")
    asked = cut(asked.join(catalog.query_vectors(tables, asked), "q"), "asked")
    if scope:
        return retrieval.page_fault(vectors, chunks, asked.withColumn("hints", F.array(*[F.lit(s) for s in scope])), limits)
    return retrieval.hybrid_fault(vectors, chunks, asked, limits) if hybrid else retrieval.page_fault(vectors, chunks, asked, limits)


def definitions(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """(path, line_start, line_end, text) of the chunks that define a symbol, in order of their ids."""
    chunks = catalog.open_catalog(spark, path)["chunks"]
    return chunks.where(T.defines("text", symbol)).orderBy("chunk_id").select("path", "line_start", "line_end", "text")


def figures(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Names and values of a catalog's figures."""
    tables = catalog.open_catalog(spark, path, verify=True)
    meta = tables["meta"].select("*", T.human_bytes("source_bytes").alias("human")).first()
    parts = tables["centroids"].count()
    names = ("embedder_id", "dim", "chunk_count", "file_count", "human")
    return [*((n, str(meta[n])) for n in names), ("partitions", str(parts))]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("root")
    build.add_argument("--out", required=True)
    build.add_argument("--dim", type=int, default=256)
    build.add_argument("--max-file-bytes", type=int, default=workspace.MAX_BYTES)
    query = sub.add_parser("query")
    query.add_argument("catalog")
    query.add_argument("text")
    query.add_argument("--k", type=int, default=8)
    query.add_argument("--threshold", type=float, default=0.05)
    query.add_argument("--relative", type=float, default=0.6)
    query.add_argument("--scope", action="append", default=[])
    query.add_argument("--no-hybrid", action="store_true")
    query.add_argument("--json", action="store_true")
    define = sub.add_parser("define")
    define.add_argument("catalog")
    define.add_argument("symbol")
    sub.add_parser("stats").add_argument("catalog")
    a = parser.parse_args(argv)
    spark = spark or build_session("corpusloom")
    try:
        if a.command == "build":
            print(catalog.build(workspace.workspace_files(spark, a.root, a.max_file_bytes).select("path", "text"), a.out, a.dim))
        elif a.command == "query":
            limits = retrieval.Limits(threshold=a.threshold, relative=a.relative, max_chunks=a.k)
            result = answer(spark, a.catalog, a.text, limits, a.scope, not a.no_hybrid)
            shown = retrieval.result_json(result).select("result") if a.json else result.select(search.tool_block(F.col("hits")))
            print(shown.first()[0])
        elif a.command == "define":
            for r in definitions(spark, a.catalog, a.symbol).collect():
                print(f"── {r['path']}:{r['line_start']}-{r['line_end']}\n{r['text']}\n")
        else:
            for name, value in figures(spark, a.catalog):
                print(f"{name}: {value}")
    except catalog.CatalogError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
