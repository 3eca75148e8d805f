"""Run programs of the pattern language over a graph file: ``python -m weft.run DATA PROGRAM [--relabel SEED] [--repeat N] [--steps]``.

DATA is a Matrix Market file or an edge table's folder (Parquet, see weft.sources.binary). Prints how long the
graph took to load, its size and load imbalance, then for each run of the program the rows of its result and
the seconds; with --steps also the entries and seconds of each step, which are taken one by one then.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.matrix import SparseMatrix
from weft.operators.ranking import checkpointed
from weft.plans.compile import Plan, compile_program
from weft.plans.program import Program, parse
from weft.sources.generate import relabelled
from weft.sources.text import read_mtx


@dataclass
class Run:
    """One run of a program: rows of the result, seconds, and the plan with its steps if they were counted."""

    rows: int
    seconds: float
    plan: Plan


def load(spark: SparkSession, path: str, relabel: int | None = None) -> tuple[SparseMatrix, DataFrame | None]:
    """The graph, and with ``relabel`` (a seed) under random vertex numbers, with the names (id, new)."""
    if path.rstrip("/").endswith((".mtx", ".txt", ".mm")):
        graph = read_mtx(spark, path)
    else:
        df = spark.read.parquet(path)
        top = df.agg(F.max(F.greatest("row", "col"))).first()[0]
        graph = SparseMatrix(df, (-1 if top is None else top) + 1, (-1 if top is None else top) + 1)
    return (graph, None) if relabel is None else relabelled(graph, relabel)


def renamed(program: Program, names: DataFrame | None) -> Program:
    """The program with its constants under the graph's new names; the handful of constants is looked up."""
    constants = sorted({s.constant for s in program.steps if s.constant is not None})
    if names is None or not constants:
        return program
    new = {r["id"]: r["new"] for r in names.where(F.col("id").isin(constants)).collect()}
    steps = [s if s.constant is None else replace(s, constant=new.get(s.constant, -1)) for s in program.steps]
    return replace(program, steps=steps)


def run(graph: SparseMatrix, program: str | Program, repeat: int = 1, names: DataFrame | None = None, steps: bool = False) -> list[Run]:
    """Run a program ``repeat`` times over one graph."""
    program = renamed(parse(program) if isinstance(program, str) else program, names)
    out = []
    for _ in range(repeat):
        began = time.perf_counter()
        plan = compile_program(program, graph.df, count_steps=steps)
        out.append(Run(plan.count(), time.perf_counter() - began, plan))
        plan.free()
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> list[Run]:
    parser = argparse.ArgumentParser(prog="weft.run", description="Run a pattern program over a graph.")
    parser.add_argument("data")
    parser.add_argument("program")
    parser.add_argument("--relabel", type=int, default=None, metavar="SEED", help="number the vertices anew at random")
    parser.add_argument("--repeat", type=int, default=1)
    parser.add_argument("--steps", action="store_true", help="take the steps one by one and report them")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("weft-run").getOrCreate()
    began = time.perf_counter()
    graph, names = load(spark, args.data, args.relabel)
    graph = SparseMatrix(checkpointed(graph.df), graph.nrow, graph.ncol)
    say(f"graph: {graph.nrow} x {graph.ncol}, {graph.nnz()} entries, {time.perf_counter() - began:.3f} s, imbalance {graph.load_imbalance().first()[0]}")
    text = "\n".join(r["value"] for r in spark.read.text(args.program, wholetext=True).collect())  # a program, so a page of text
    out = run(graph, text, args.repeat, names, args.steps)
    for k, r in enumerate(out):
        for line, entries, seconds in r.plan.steps:
            say(f"  {line}: {entries} entries, {seconds:.3f} s")
        say(f"run {k + 1}: {r.rows} rows, {r.seconds:.3f} s" + (", stopped at an empty step" if r.plan.stopped else ""))
    return out


if __name__ == "__main__":
    main()
