"""Programs to lazy plans over an edge table (row = subject, col = object, val = predicate)."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.ranking import checkpointed

from .program import Program, Result, Step, parse, variables


@dataclass
class Plan:
    """``bindings``: one column v<name> for each variable, in the order of names.

    If asked for, ``nnz``: how many entries each step left, and ``steps``: of each step taken its line, entries and
    seconds. ``stopped``: whether a step left nothing that the result needs, so that the others weren't taken.
    """

    bindings: DataFrame | None
    matrices: dict[str, DataFrame]
    nnz: list[int] = field(default_factory=list)
    steps: list[tuple[str, int, float]] = field(default_factory=list)
    stopped: bool = False
    kept: list[DataFrame] = field(default_factory=list)

    def count(self) -> int:
        return self.bindings.count()

    def free(self) -> None:
        for df in self.kept:
            df.unpersist()


def _order(name: str) -> tuple:
    return (0, int(name), name) if name.isdigit() else (1, 0, name)


def _rows(matrix: DataFrame, columns: bool) -> DataFrame:
    return matrix.select(F.col("col" if columns else "row").alias("id"))


def literal_step(edges: DataFrame, made: dict[str, DataFrame], step: Step) -> DataFrame:
    """A step as it is written: filters and left-semi joins."""
    one = F.lit(1)
    if step.kind == "S":
        end, other = ("row", "col") if step.transposed else ("col", "row")
        df = edges
        if step.op == "⊗":  # the predicate is compared
            df = df.where(F.col("val") == step.factor)
        if step.diag is None:
            df = df.where(F.col(end) == step.constant)
        else:
            df = df.join(_rows(made[step.diag.matrix], step.diag.columns), F.col(end) == F.col("id"), "left_semi")
        value = one if step.op == "⊗" else F.col("val") * step.factor
        df = df.select(F.col(other).alias("row"), F.col(end).alias("col"), value.alias("val"))
        return df if step.op == "⊗" or step.factor else df.where(F.lit(False))
    m = made[step.target]
    if step.kind == "C":
        m = m.where(F.col("row") == step.constant)
        return m.withColumn("val", F.col("val") * step.factor) if step.factor else m.where(F.lit(False))
    side = "row" if step.kind == "L" else "col"
    m = m.join(_rows(made[step.diag.matrix], step.diag.columns), F.col(side) == F.col("id"), "left_semi")
    return m.where(F.col("val") == 1) if step.op == "⊗" else m


def can_join(program: Program) -> bool:
    """Whether the result is one multiway join of filtered edges, so that no semijoin adds anything.

    A semijoin may go if both matrices take part in the result and their variable is equated there.
    Programs where values other than 1 arise, or a matrix is made anew from the graph, are taken literally.
    """
    used = {r.matrix for r in program.results}
    same = {r.row: r.bound for r in program.results if r.kind == "filter"}
    name = lambda v: same.get(v, v)
    made: set[str] = set()
    for s in program.steps:
        if s.target not in used or (s.kind == "S" and (s.op != "⊗" or s.target in made)) or (s.kind == "C" and s.factor != 1):
            return False
        made.add(s.target)
        if s.diag:
            row, col = variables(s.target)
            mine = col if s.kind in "SR" else row
            theirs = variables(s.diag.matrix)[1 if s.diag.columns else 0]
            if name(mine) != name(theirs) or s.diag.matrix not in used:
                return False
    return len({r.matrix for r in program.results}) == len(program.results)


def _joined_step(edges: DataFrame, made: dict[str, DataFrame], step: Step) -> DataFrame | None:
    if step.kind == "S":
        df = edges.where(F.col("val") == step.factor)
        end, other = ("row", "col") if step.transposed else ("col", "row")
        if step.diag is None:
            df = df.where(F.col(end) == step.constant)
        return df.select(F.col(other).alias("row"), F.col(end).alias("col"), F.lit(1).alias("val"))
    return made[step.target].where(F.col("row") == step.constant) if step.kind == "C" else None


def result(made: dict[str, DataFrame], results: list[Result]) -> DataFrame | None:
    """Joins as bag joins, filters as two-key semijoins; columns in the order of the variables' names."""
    table, names = None, []
    for r in results:
        row, col = variables(r.matrix)
        m = made[r.matrix]
        if r.kind == "join":
            new = m.select(F.col("col").alias(f"v{col}"), F.col("row").alias(f"v{row}"))
            table = new if table is None else table.join(new, f"v{col}")
            names = sorted({*names, row, col}, key=_order)
            table = table.select(*[f"v{v}" for v in names])
        else:
            pairs = m.select(F.col("row").alias(f"v{r.bound}"), F.col("col").alias(f"v{col}"))
            table = table.join(pairs, [f"v{r.bound}", f"v{col}"], "left_semi").select(*[f"v{v}" for v in names])
    return table


def _needed(program: Program, at: int) -> bool:
    """Whether the result is empty if step ``at`` leaves nothing: its matrix is in the result and isn't made anew later."""
    target = program.steps[at].target
    return any(r.matrix == target for r in program.results) and not any(s.kind == "S" and s.target == target for s in program.steps[at + 1 :])


def compile_program(program: Program | str, edges: DataFrame, reduce: bool | None = None, count_steps: bool = False) -> Plan:
    """A program over an edge table.

    ``reduce``: take every step literally, as a chain of semijoins; False: one multiway join where
    can_join() allows; None: that too. Literal plans keep matrices that are used more than once
    (Plan.free() lets go of them). ``count_steps`` takes the steps one by one, with their entries and
    seconds in Plan.steps, and stops where one leaves nothing that the result needs.
    """
    program = parse(program) if isinstance(program, str) else program
    literal = bool(reduce) or count_steps or not can_join(program)
    made: dict[str, DataFrame] = {}
    plan = Plan(None, made)
    for at, step in enumerate(program.steps):
        began = time.perf_counter()
        df = literal_step(edges, made, step) if literal else _joined_step(edges, made, step)
        if df is None:
            continue
        if literal:
            later = [*program.steps[at + 1 :]]
            uses = sum((s.diag is not None and s.diag.matrix == step.target) or (s.kind in "CLR" and s.target == step.target) for s in later)
            if count_steps:  # cut off, or each step's plan would hold those of all before
                df = checkpointed(df)
            elif uses + any(r.matrix == step.target for r in program.results) > 1:
                df = df.persist()
                plan.kept.append(df)
        made[step.target] = df
        if count_steps:
            plan.nnz.append(df.count())
            plan.steps.append((step.line, plan.nnz[-1], time.perf_counter() - began))
            if not plan.nnz[-1] and _needed(program, at):
                plan.stopped = True
                break
    if plan.stopped:  # matrices that weren't made are as empty as the result
        none = edges.sparkSession.createDataFrame([], "row long, col long, val int")
        plan.bindings = result({r.matrix: none for r in program.results}, program.results)
    else:
        plan.bindings = result(made, program.results)
    return plan
