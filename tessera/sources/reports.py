"""Sinks for small results: Markdown tables, JSON reports, one CSV file."""

from __future__ import annotations

import json
import math
from datetime import date
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession


def markdown_table(df: DataFrame, digits: int = 4, missing: str = "") -> str:
    """A Markdown table of a small result; nulls and NaN are ``missing``."""

    def cell(v) -> str:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return missing
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", r"\|").replace("\n", " ")

    rows = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def json_report(tables: dict[str, DataFrame]) -> str:
    """Rows of small results by name; NaN and infinity become null."""

    def plain(v):
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, date):
            return v.isoformat()
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    return json.dumps({name: [plain(r.asDict(True)) for r in df.collect()] for name, df in tables.items()}, indent=2)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` is for small results only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def format_p(p: float | None) -> str:
    """Four decimals; scientific below 0.0001; empty if missing."""
    if p is None or math.isnan(p):
        return ""
    return f"{p:.2e}" if p < 1e-4 else f"{p:.4f}"


def percent(v: float | None) -> str:
    """A share as a percentage with one decimal; empty if missing."""
    return "" if v is None or math.isnan(v) else f"{v:.1%}"


def scored_path(path: str) -> str:
    """Where the scores of a file go unless a place is named: <stem>_scored.csv beside it."""
    scheme, found, rest = path.rpartition("://")
    p = PurePosixPath(rest)
    return scheme + found + str(p.with_name(p.stem + "_scored.csv"))


def metrics_json(run: dict, results: dict[str, dict], baselines: dict[str, float]) -> str:
    """Settings, metrics of each model, and baselines of one training run."""
    return json.dumps({"run": run, "models": results, "baselines": baselines}, indent=2, default=float)


def metrics_text(run: dict, results: dict[str, dict], baselines: dict[str, float]) -> str:
    """The same for reading."""
    lines = [", ".join(f"{k}: {v}" for k, v in run.items())]
    for name, metrics in results.items():
        lines += ["", name, *(f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in metrics.items())]
    return "\n".join([*lines, "", "baselines", *(f"  {k}: {v:.4f}" for k, v in baselines.items())])


def model_card(run: dict, results: dict[str, dict], baselines: dict[str, float], stripped: bool) -> str:
    """A Markdown card: use, data and settings, results beside baselines, limits."""
    names = list(dict.fromkeys(k for m in results.values() for k in m))

    def row(cells) -> str:
        return "| " + " | ".join(f"{c:.4f}" if isinstance(c, float) else "" if c is None else str(c) for c in cells) + " |"

    table = [row(["model", *names]), row(["---"] * (1 + len(names))), *(row([k, *(m.get(n) for n in names)]) for k, m in results.items())]
    base = [row(["baseline", "accuracy"]), row(["---", "---"]), *(row(x) for x in baselines.items())]
    limits = [
        "- The score tells which half of the training corpus a text is worded like. It checks no facts.",
        "- A publisher's marks can give the class away: compare with the one-rule baseline. Boilerplate was " + ("stripped." if stripped else "not stripped."),
        "- The test part comes from the same corpus and years; other sources and later texts are unmeasured.",
    ]
    settings = [f"- {k}: {v}" for k, v in run.items()]
    return "\n".join(["# Model card", "", "For sorting texts that people then review; not for decisions without them.", "", "## Data and settings", "", *settings, "", "## Results on the test part", "", *table, "", *base, "", "## Limits", "", *limits, ""])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text as a folder with one file, on any storage that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run(spark: SparkSession, folder: str, run: dict, results: dict[str, dict], baselines: dict[str, float], stripped: bool = False) -> None:
    """metrics.json, metrics.txt, run_metadata.json and MODEL_CARD.md of one training run."""
    write_text(spark, metrics_json(run, results, baselines), f"{folder}/metrics.json")
    write_text(spark, metrics_text(run, results, baselines), f"{folder}/metrics.txt")
    write_text(spark, json.dumps(run, indent=2, default=float), f"{folder}/run_metadata.json")
    write_text(spark, model_card(run, results, baselines, stripped), f"{folder}/MODEL_CARD.md")
