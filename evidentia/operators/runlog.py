"""Evolution logs: why a row is dropped, what a mutant gained over its parents, and the leaves it yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the fitness that marks a run which failed validation.
DEAD = -1000.0

OUTPUT = "struct<archetype:string,changes:array<struct<description:string,explanation:string>>,justification:string,insights_used:array<string>,code:string>"


def measured(fitness: Column) -> Column:
    """Fitness that was really measured; null for none and for the dead marker."""
    return F.when(fitness != DEAD, fitness)


def parent_best(mutants: DataFrame) -> DataFrame:
    """``program_id, parent_fitness``: the best measured fitness among a row's parents (``parent_ids``)."""
    child = mutants.select("program_id", F.explode("parent_ids").alias("parent"))
    known = mutants.select(F.col("program_id").alias("parent"), measured(F.col("fitness")).alias("f")).where(F.col("f").isNotNull())
    return child.join(known, "parent").groupBy("program_id").agg(F.max("f").alias("parent_fitness"))


def with_delta(mutants: DataFrame) -> DataFrame:
    """``mutants`` with ``parent_fitness`` and ``delta``; a parent fitness that the log gives (``given_parent_fitness``) counts before the one that is looked up."""
    out = mutants.join(parent_best(mutants), "program_id", "left")
    if "given_parent_fitness" in mutants.columns:
        out = out.withColumn("parent_fitness", F.coalesce(measured(F.col("given_parent_fitness")), "parent_fitness"))
    return out.withColumn("delta", F.round(measured(F.col("fitness")) - F.col("parent_fitness"), 6))


def gate(rows: DataFrame, min_delta: float = 0.0, parsed: Column | None = None, changes: Column | None = None) -> DataFrame:
    """``rows`` with ``reason``: the first rule that drops the row, null if it is kept."""
    parsed = F.lit(True) if parsed is None else parsed
    changes = F.lit(1) if changes is None else changes
    reason = F.when(F.col("fitness").isNull(), "no_fitness").when(F.col("fitness") == DEAD, "dead").when(F.coalesce(F.size("parent_ids"), F.lit(0)) <= 0, "root")
    reason = reason.when(F.col("parent_fitness").isNull(), "parent_unmeasured").when(~parsed, "unparsed").when(changes <= 0, "no_changes").when(F.abs(F.col("delta")) < min_delta, "min_delta")
    return rows.withColumn("reason", reason)


def parse_output(raw: Column, parsed: Column | None = None) -> Column:
    """The structured output of a mutation; null where it is not an object with archetype and changes.

    Where an output that is parsed already (as JSON text of an object) is given, it counts and the raw text does not.
    """
    given = raw if parsed is None else F.coalesce(parsed, raw)
    has = lambda k: F.get_json_object(given, f"$.{k}").isNotNull()
    return F.when(has("archetype") & has("changes"), F.from_json(given, OUTPUT))


#: Fixed value: names of runs, which become file names.
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$"


def valid_run_id(run: Column) -> Column:
    """Whether a run's name is safe as a file name, inside the folder of the runs."""
    return F.coalesce(run.rlike(RUN_ID) & ~run.contains("\n"), F.lit(False))


def run_name(path: Column) -> Column:
    """The folder that holds ``results/``, else the file's stem."""
    inside = F.regexp_extract(path, r"([^/]+)/results/[^/]+$", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def seed(run: Column) -> Column:
    found = F.regexp_extract(run, r"seed(\d+)$", 1)
    return F.when(found != "", found).otherwise(run)


def task(run: Column) -> Column:
    left = F.regexp_replace(run, r"_seed\d+$", "")
    return F.when(left != "", left).otherwise(run)


def effect_text(before: Column, after: Column) -> Column:
    return F.concat(F.lit("fitness "), before.cast("string"), F.lit(" -> "), after.cast("string"), F.format_string(" (%+.2f)", after - before))


def top_delta(rows: DataFrame, limit: int) -> DataFrame:
    """The rows that moved most, in either direction."""
    return rows.where(F.col("delta").isNotNull()).orderBy(F.desc(F.abs("delta")), "program_id").limit(limit)


def leak_terms(program: Column, run: Column, task_: Column, model: Column, code_names: Column) -> Column:
    """Terms of at least three characters that a generalised text of the run may not hold, sorted."""
    own = F.array(program, run, task_, model)
    both = F.array_union(F.filter(own, lambda t: t.isNotNull()), F.coalesce(code_names, F.array().cast("array<string>")))
    return F.sort_array(F.array_distinct(F.filter(both, lambda t: F.length(t) >= 3)))


def convert(mutants: DataFrame, run: str, min_delta: float = 0.0, limit: int | None = None) -> DataFrame:
    """Leaves of a run log (``program_id, fitness, parent_ids, mutation_output, mutation_model``): one per change of each kept mutant."""
    rows = with_delta(mutants).withColumn("mo", parse_output(F.col("mutation_output")))
    kept = gate(rows, min_delta, F.col("mo").isNotNull(), F.size("mo.changes")).where(F.col("reason").isNull())
    if limit is not None:
        kept = top_delta(kept, limit)
    url = F.concat(F.lit(f"run://{run}/"), F.col("program_id"))
    each = kept.select("*", url.alias("url"), F.posexplode("mo.changes").alias("n", "change"))
    return each.select(
        F.substring(F.sha1(F.concat("url", "program_id")), 1, 16).alias("source_id"), "url", F.concat_ws(" · ", "mo.archetype", F.concat(F.lit(f"{run}/"), "program_id")).alias("title"),
        (F.col("delta") > 0).alias("run_success"), "delta", F.col("change.description").alias("text"), F.concat_ws(" · ", "mo.archetype", task(F.lit(run)), "mutation_model").alias("context"),
        effect_text(F.col("parent_fitness"), F.col("fitness")).alias("effect"), F.concat(F.lit(f"{run}:"), "program_id", F.lit("#changes["), F.col("n").cast("string"), F.lit("]")).alias("locator"),
    )
