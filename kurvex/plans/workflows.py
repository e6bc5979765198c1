"""Declared workflows: preflight checks, ordered steps with decisions, results as named tables, text reports and plot data."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import decomposition as dec
from ..operators import distances as dist
from ..operators import geometry as geo
from ..operators import inference as inf
from ..operators import observation as obs
from ..operators import recurrence as rec


@dataclass
class WorkflowResult:
    """Tables by name, the configuration, steps with seconds, decisions and what was not done."""

    name: str
    config: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    steps: list[dict] = field(default_factory=list)
    decisions: list[dict] = field(default_factory=list)
    provenance: dict = field(default_factory=lambda: {"interpolated": False, "imputed": False, "parameters_selected": False})

    def step(self, name: str, run: Callable[[], DataFrame]) -> DataFrame:
        """Runs a step to its end: its table is stored, so the seconds are those of its work and later steps don't repeat it."""
        start = time.perf_counter()
        self.tables[name] = out = stored(run(), name)
        self.steps.append({"order": len(self.steps) + 1, "step": name, "seconds": round(time.perf_counter() - start, 3)})
        return out

    def decide(self, what: str, value, reason: str) -> None:
        self.decisions.append({"decision": what, "value": json.dumps(value), "reason": reason})

    def frame(self, spark: SparkSession, which: str) -> DataFrame:
        """``steps`` or ``decisions`` as a table."""
        kind = {"steps": "order int, step string, seconds double", "decisions": "decision string, value string, reason string"}[which]
        return spark.createDataFrame([tuple(r.values()) for r in getattr(self, which)], kind)


def preflight(samples: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Counts that tell before a run whether the contracts hold: curves, samples, missing, duplicate times, short curves."""
    per = samples.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("k"), *(F.sum(F.col(d).isNull().cast("int")).alias(f"m_{d}") for d in dims))
    return per.agg(F.count(F.lit(1)).alias("n_curves"), F.sum("n").alias("n_samples"), F.sum(F.col("n") - F.col("k")).alias("duplicate_times"), F.count(F.when(F.col("n") < 2, 1)).alias("short_curves"), *(F.sum(f"m_{d}").alias(f"missing_{d}") for d in dims))


def recurrence_workflow(samples: DataFrame, *, dims: tuple[str, ...] = ("x",), radius: float, theiler: int = 1, window: int | None = None, step: int | None = None) -> WorkflowResult:
    w = WorkflowResult("recurrence", {"dims": list(dims), "radius": radius, "theiler": theiler, "window": window, "step": step})
    w.step("preflight", lambda: preflight(samples, dims))
    pairs = w.step("pairs", lambda: rec.recurrence_pairs(samples, dims, radius, theiler))
    w.step("rqa", lambda: rec.rqa_metrics(samples, pairs))
    nodes = w.step("network_nodes", lambda: rec.network_nodes(samples, pairs))
    w.step("network_summary", lambda: rec.network_summary(nodes))
    if window:
        w.step("windowed_rqa", lambda: rec.windowed_rqa(samples, dims, radius, window, step or window, theiler))
    w.decide("radius", radius, "declared by the caller")
    return w


def fpca_workflow(samples: DataFrame, time_grid, *, dim: str = "x", n_components: float | int = 0.95) -> WorkflowResult:
    w = WorkflowResult("fpca", {"dim": dim, "n_components": n_components})
    w.step("preflight", lambda: preflight(samples, (dim,)))
    arrays = dist.curve_arrays(samples, (dim,))
    fit = dec.fit_fpca(arrays, time_grid, n_components)
    w.decide("n_components", len(fit.components), "least number above the declared share" if isinstance(n_components, float) else "declared by the caller")
    scored = w.step("scores", lambda: dec.scores(arrays, fit))
    w.step("reconstruction", lambda: dec.reconstruct(scored, fit))
    w.step("errors", lambda: dec.reconstruction_error(arrays, fit))
    w.step("spectrum", lambda: samples.sparkSession.createDataFrame([tuple(s.values()) for s in dec.spectrum(fit)], "component int, eigenvalue double, ratio double, cumulative double, gap double, relative_gap double, next_ratio double"))
    return w


def observation_workflow(process: DataFrame, *, predictor: str, edges: list[float]) -> WorkflowResult:
    w = WorkflowResult("observation", {"predictor": predictor, "edges": edges})
    w.step("runs", lambda: obs.longest_missing_runs(process))
    w.step("support", lambda: obs.time_bin_support(process, edges))
    w.step("difference", lambda: obs.standardized_difference(process, predictor))
    w.step("association", lambda: obs.spearman_association(process, predictor))
    return w


def function_on_scalar_workflow(samples: DataFrame, *, predictor: str) -> WorkflowResult:
    w = WorkflowResult("function_on_scalar", {"predictor": predictor})
    w.step("coefficients", lambda: inf.function_on_scalar(samples, predictor))
    w.step("mean", lambda: inf.mean_function(samples))
    return w


def sensitivity(run: Callable[..., WorkflowResult], samples: DataFrame, table: str, grid: list[dict], **fixed) -> DataFrame:
    """One table of a workflow over a declared grid of parameters, stacked with the parameters as JSON."""
    out = None
    for p in grid:
        t = run(samples, **fixed, **p).tables[table].withColumn("parameters", F.lit(json.dumps(p, sort_keys=True)))
        out = t if out is None else out.unionByName(t)
    return out


def preprocess(samples: DataFrame, plan: list[dict]) -> DataFrame:
    """Applies declared steps in order; an unknown step raises."""
    steps = {"normalize_time": geo.normalize_time, "center": geo.center_on_landmark, "normalize_coordinates": geo.normalize_coordinates, "fill_gaps": geo.interpolate_short_gaps, "differentiate": geo.differentiate}
    for s in plan:
        s = dict(s)
        samples = steps[s.pop("step")](samples, **s)
    return samples


def reporting_text(title: str, table: DataFrame, note: str = "") -> str:
    """A sentence from a small result table: its first row's values, the number of rows, and what was not done."""
    rows = table.limit(2).collect()
    if not rows:
        return f"{title}: no rows. {note}".strip()
    shown = ", ".join(f"{k} = {v:.4g}" if isinstance(v, float) else f"{k} = {v}" for k, v in rows[0].asDict().items() if not isinstance(v, list))
    more = f" The first of {table.count()} rows is shown." if len(rows) > 1 else ""
    return f"{title}: {shown}.{more} {note}".strip()


def plot_data(table: DataFrame, x: str, y: str, by: str | None = None, max_groups: int | None = None) -> DataFrame:
    """Tidy data for a figure (x, y, group): all groups, or the first ``max_groups`` by name; drawing is the caller's."""
    t = table.select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(by) if by else F.lit("all")).cast("string").alias("group"))
    if by and max_groups is not None:
        first = t.select(F.col("group").alias("shown")).distinct().orderBy("shown").limit(max_groups)
        t = t.join(F.broadcast(first), F.col("group").eqNullSafe(F.col("shown")))
    return t.select("group", "x", "y")


def render_report(result: WorkflowResult, style: str = "markdown") -> str:
    """Configuration, steps, decisions and the head of every table as Markdown or HTML."""
    parts = [f"# {result.name}", "```json\n" + json.dumps(result.config, sort_keys=True, default=str) + "\n```"]
    parts += ["## Steps", *(f"- {s['order']}. {s['step']}" for s in result.steps), "## Decisions", *(f"- {d['decision']}: {d['value']} ({d['reason']})" for d in result.decisions)]
    for name, t in result.tables.items():
        head = t.limit(5).collect()
        parts += [f"## {name}", "| " + " | ".join(t.columns) + " |", "|" + "---|" * len(t.columns), *("| " + " | ".join(map(str, r)) + " |" for r in head)]
    text = "\n".join(parts)
    return text if style == "markdown" else f"<!DOCTYPE html><html><body><pre>{html.escape(text)}</pre></body></html>"
