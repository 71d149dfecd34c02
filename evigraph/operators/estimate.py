"""Time left for a run, from its log and the calls made so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phases of the steps, and what is assumed where nothing is known.
PHASES = {6: "memory", 7: "inventory", 8: "evidence"}
PHASE_SECONDS = {"memory": 75.0, "inventory": 105.0, "evidence": 105.0}
STEP_SECONDS = {2: 60.0, 3: 30.0, 4: 120.0, 5: 60.0, 9: 60.0, 10: 60.0, 11: 30.0}


def latest_run(lines: DataFrame, start: str) -> DataFrame:
    """Lines (file, line_no, line) from the last line that matches ``start`` on, of each file."""
    w = W.partitionBy("file").orderBy("line_no")
    run = F.sum(F.col("line").rlike(start).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = lines.withColumn("run", run)
    return numbered.withColumn("last", F.max("run").over(W.partitionBy("file"))).where("run = last and run > 0").drop("last", "run")


def phase_seconds(lines: DataFrame, step: str, paper: str, seconds: str) -> DataFrame:
    """(phase, seconds): median over papers of the seconds logged, trimmed to 1..7200, or the assumed value.

    A step line opens a phase, a paper line a paper, seconds add up; the patterns have one group each."""
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    marked = lines.select("file", "line_no", got(step).alias("s"), got(paper).alias("p"), got(seconds).cast("double").alias("sec"))
    opened = marked.withColumn("at_step", F.last("s", True).over(w)).withColumn("n_step", F.count("s").over(w)).withColumn("at_paper", F.last("p", True).over(W.partitionBy("file", "n_step").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)))
    turn = F.count(F.when(F.col("p").isNotNull() & (F.col("p") != F.coalesce(F.col("before"), F.lit(""))), 1)).over(w)
    before = F.last("at_paper", True).over(W.partitionBy("file", "n_step").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    runs = opened.withColumn("before", before).withColumn("turn", turn)
    phase = F.element_at(F.create_map(*[x for k, v in PHASES.items() for x in (F.lit(str(k)), F.lit(v))]), F.col("at_step"))
    papers = runs.where("at_paper is not null and p is null and sec is not null").groupBy("file", "n_step", "turn", phase.alias("phase")).agg(F.sum("sec").alias("sec")).where("phase is not null and sec between 1 and 7200")
    known = papers.groupBy("phase").agg(F.median("sec").alias("m"))
    assumed = lines.sparkSession.createDataFrame(list(PHASE_SECONDS.items()), "phase string, assumed double")
    return assumed.join(F.broadcast(known), "phase", "left").select("phase", F.coalesce("m", "assumed").alias("seconds"))


def step_seconds(lines: DataFrame, done: str) -> DataFrame:
    """(step, seconds): median of the durations logged for a step (pattern with step and seconds), or the assumed value."""
    hit = lines.select(F.regexp_extract("line", done, 1).alias("s"), F.regexp_extract("line", done, 2).alias("d")).where("s != '' and d != ''")
    known = hit.select(F.col("s").cast("int").alias("step"), F.col("d").cast("double").alias("d")).where("d between 0 and 604800").groupBy("step").agg(F.median("d").alias("m"))
    assumed = lines.sparkSession.createDataFrame(list(STEP_SECONDS.items()), "step int, assumed double")
    return assumed.join(F.broadcast(known), "step", "full").select("step", F.coalesce("m", "assumed").alias("seconds"))


def call_models(calls: DataFrame, phase: str, ok: Column, seconds: Column) -> DataFrame:
    """(phase, sample_count, seconds_per_chunk, sigma_per_chunk, retry_factor): all attempts' time over the successes."""
    g = calls.where(seconds.between(0, 1800)).groupBy(phase).agg(F.count("*").alias("n"), F.count_if(ok).alias("sample_count"), F.sum(seconds).alias("total"), F.stddev_pop(seconds).alias("spread")).where("sample_count > 0")
    each, retry = F.col("total") / F.col("sample_count"), F.col("n") / F.col("sample_count")
    sigma = F.greatest(F.lit(1.0), F.when(F.col("n") > 1, F.col("spread")).otherwise(each * 0.25) * F.sqrt(retry))
    return g.select(phase, "sample_count", each.alias("seconds_per_chunk"), sigma.alias("sigma_per_chunk"), retry.alias("retry_factor"))


def remaining(backlog: DataFrame, models: DataFrame, phase: str, step: int, steps: dict[int, float] | None = None, provider_errors: bool = False, typical: dict[str, float] | None = None) -> DataFrame:
    """(estimate_seconds, uncertainty_seconds, low_seconds, high_seconds) for pending work (phase, chunks, papers) and the steps
    from ``step`` on. A phase without a call model or without chunks counts its papers at their ``typical`` seconds, with a
    spread of 35 percent of each."""
    fixed = sum(v for k, v in (STEP_SECONDS | (steps or {})).items() if k >= step and k in STEP_SECONDS)
    spread = sum((v * 0.30) ** 2 for k, v in (STEP_SECONDS | (steps or {})).items() if k >= step and k in STEP_SECONDS)
    j = backlog.join(models, phase, "left")
    usual = F.create_map(*[x for k, v in (PHASE_SECONDS | (typical or {})).items() for x in (F.lit(k), F.lit(float(v)))])
    each = F.coalesce(F.element_at(usual, F.col(phase)), F.lit(0.0))
    papers = F.col("papers") if "papers" in backlog.columns else F.lit(0)
    modelled = F.col("seconds_per_chunk").isNotNull() & (F.col("chunks") > 0)
    seconds = F.when(modelled, F.col("chunks") * F.col("seconds_per_chunk")).otherwise(papers * each)
    var = F.when(modelled, F.col("chunks") * F.col("sigma_per_chunk") * F.col("sigma_per_chunk")).otherwise(papers * (each * 0.35) * (each * 0.35))
    s = j.agg(F.coalesce(F.sum(seconds), F.lit(0.0)).alias("chunks"), F.coalesce(F.sum(var), F.lit(0.0)).alias("var"))
    total = F.col("chunks") + F.lit(fixed + 60.0)
    doubt = F.greatest(F.lit(120.0), F.sqrt(F.col("var") + F.lit(spread + 900.0)), total * (0.30 if provider_errors else 0.10))
    low = F.greatest(F.lit(30.0), total - doubt)
    return s.select(F.round(total, 3).alias("estimate_seconds"), F.round(doubt, 3).alias("uncertainty_seconds"), F.round(low, 3).alias("low_seconds"), F.round(F.greatest(low + 30, total + doubt), 3).alias("high_seconds"))
