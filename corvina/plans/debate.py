"""A debate in three passes as one plan: two opposed views at once, a critic of both, a synthesis.  Generation is a boundary."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..boundary import Generator


@dataclasses.dataclass(frozen=True)
class Roles:
    """Instructions of the four roles of a mode; {advocate}, {opponent} and {critic} stand for what these said."""

    advocate: str
    opponent: str
    critic: str
    synthesis: str


_READ = "\n\nFOR:\n{advocate}\n\nAGAINST:\n{opponent}"
MODES = {
    "general": Roles(
        "Argue for the proposal: a thesis, three to five arguments with evidence, answers to objections.", "Argue against the proposal: counter-examples, documented failures, main risks.",
        "Judge both sides without taking one: strengths, gaps and risks of each." + _READ, "Answer the question directly, with conditions and caveats." + _READ + "\n\nCRITIQUE:\n{critic}",
    ),
    "code": Roles(
        "As an architect propose a concrete design: stack, scaling, tests, known trade-offs.", "As a second architect propose a fundamentally different design on the same points.",
        "As a reviewer compare both designs by security, performance, scaling and upkeep." + _READ, "As the lead decide: the design, what of the critique is accepted, a plan, the largest risk left." + _READ + "\n\nREVIEW:\n{critic}",
    ),
    "medical": Roles(
        "As a clinician present the evidence for the treatment: levels of proof, indications, guidelines.", "As a sceptical clinician present negative studies, alternatives and contra-indications.",
        "As an expert of evidence weigh the quality of both cases." + _READ, "Conclude for practice, with limits, and advise to see a professional." + _READ + "\n\nAPPRAISAL:\n{critic}",
    ),
}


def _prompt(rows: DataFrame, role: str, modes: dict[str, Roles]) -> Column:
    """The role's instruction in the row's mode (general where it is unknown), filled in, then the context and the question."""
    told = F
    for name, roles in modes.items():
        text = F.lit(getattr(roles, role))
        for said in ("advocate", "opponent", "critic"):
            if said in rows.columns:
                text = F.replace(text, F.lit("{" + said + "}"), F.col(said))
        told = told.when(F.col("mode") == name, text) if name != "general" else told
    default = F.lit(getattr(modes["general"], role))
    for said in ("advocate", "opponent", "critic"):
        if said in rows.columns:
            default = F.replace(default, F.lit("{" + said + "}"), F.col(said))
    told = told.otherwise(default)
    context = F.when(F.length(F.coalesce("context", F.lit(""))) > 0, F.concat(F.lit("\n\n--- Context ---\n"), "context")).otherwise("")
    return F.concat(told, context, F.lit("\n\n"), "question")


def debate(rows: DataFrame, generate: Generator, modes: dict[str, Roles] = MODES) -> DataFrame:
    """rows (key, question, mode, context) with what each role said: advocate, opponent, critic, synthesis.

    The first two are generated in one pass over twice the rows, so that a generator can serve them side by side.
    """
    sides = [rows.withColumn("prompt", _prompt(rows, role, modes)).withColumn("_role", F.lit(role)) for role in ("advocate", "opponent")]
    said = generate(reduce(lambda a, b: a.unionByName(b), sides))
    both = said.groupBy("key").agg(*[F.max(F.when(F.col("_role") == role, F.col("answer"))).alias(role) for role in ("advocate", "opponent")])
    out = rows.join(both, "key")
    for role in ("critic", "synthesis"):
        out = generate(out.withColumn("prompt", _prompt(out, role, modes))).withColumnRenamed("answer", role).drop("prompt")
    return out
