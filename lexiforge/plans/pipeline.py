"""The keyword pipeline: load, project, normalise, find duplicates, match, look up, summarise, export.

Every stage maps a DataFrame to a DataFrame, so the whole run is one lazy plan with actions only where a result decides
what comes next: the header, the rounds of the components, the gates and the sinks.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import textnorm as tn
from lexiforge.operators import analytics, dedup, lookup, match, schema
from lexiforge.sources import files, sinks

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PipelineConfig:
    normalizer: tn.NormalizerConfig = tn.NormalizerConfig()
    duplicates: bool = True
    fuzzy_threshold: float = dedup.THRESHOLD
    volume: bool = False
    extra_stages: tuple[tuple[str, Stage], ...] = ()


@dataclass
class PipelineResult:
    data: DataFrame
    left_out: list[str]
    keyword_column: tuple[str, str, float]
    stages: dict[str, float] = field(default_factory=dict)
    summary: dict = field(default_factory=dict)
    files: list[str] = field(default_factory=list)


def keyword_frame(df: DataFrame, keyword_column: str | None = None) -> tuple[DataFrame, tuple[str, str, float]]:
    """The frame with its keyword column named so; a given column must exist, else the best candidate is taken."""
    if keyword_column is not None:
        if keyword_column not in df.columns:
            raise schema.SchemaError(f"no column {keyword_column!r}; got {df.columns}")
        choice = (keyword_column, "MANUAL", 100.0)
    else:
        choice = schema.resolve_keyword_column(df.columns)[0]
    clash = [c for c in df.columns if c.strip().lower() == "keyword" and c != choice[0]]
    return df.drop(*clash).withColumnRenamed(choice[0], "keyword"), choice


def run(
    spark: SparkSession, source: str | bytes, file_name: str | None = None, entities: DataFrame | None = None, config: PipelineConfig = PipelineConfig(),
    sheet: str | None = None, keyword_column: str | None = None, output: str | None = None,
) -> PipelineResult:
    """``entities`` are (kind, ord, entity) rows to match; ``output`` is a folder for the CSV views and the summary."""
    took: dict[str, float] = {}

    def staged(name: str, f: Callable, *args):
        start = time.time()
        out = f(*args)
        took[name] = round(time.time() - start, 3)
        return out

    raw = staged("load", files.load, spark, source, file_name, sheet)
    framed, choice = staged("resolve", keyword_frame, raw, keyword_column)
    projected, left_out = staged("project", schema.project_canonical, schema.drop_blank_rows(framed))
    df = staged("clean", lambda d: schema.numbered(schema.drop_empty_keywords(d)), projected)
    df = staged("normalise", lambda d: tn.normalise(d.withColumn("original_keyword", F.col("keyword")), config=config.normalizer), df)
    if config.duplicates:
        df = staged("duplicates", lambda d: dedup.detect(d, "normalized_keyword", threshold=config.fuzzy_threshold)[1], df)
    if entities is not None:
        found = staged("match", match.contained, df, entities, "normalized_keyword")
        df = df.join(match.profile_context(found), "row_id", "left")
    if config.volume:
        df = staged("volume", lambda d: d.join(lookup.mock_volume(d).withColumnsRenamed({"competition": "looked_up_competition", "cpc": "looked_up_cpc"}), "keyword", "left"), df)
    for name, stage in config.extra_stages:
        df = staged(name, stage, df)
    flags = {"changed": F.col("normalization_trace") != ""}
    if "status" in df.columns:
        flags["duplicates"] = F.col("status") == "DUPLICATE"
    if "reason" in df.columns:
        flags["matched"] = F.col("reason").isNotNull()
    summary = staged("summary", lambda d: analytics.summary(d, flags).first().asDict(), df)
    result = PipelineResult(df, left_out, choice, took, summary)
    if output is not None:
        staged("export", export, result, output)
    return result


def export(result: PipelineResult, folder: str) -> None:
    """keywords and duplicates as CSV, the summary as JSON."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    sinks.write_csv(result.data, f"{folder}/keywords")
    result.files.append(f"{folder}/keywords")
    if result.summary.get("duplicates"):
        sinks.write_csv(result.data.filter("status = 'DUPLICATE'"), f"{folder}/duplicates")
        result.files.append(f"{folder}/duplicates")
    sinks.write_json({"summary": result.summary, "stages": result.stages, "left_out": result.left_out}, f"{folder}/summary.json")
    result.files.append(f"{folder}/summary.json")


def with_stage(config: PipelineConfig, name: str, stage: Stage) -> PipelineConfig:
    return replace(config, extra_stages=(*config.extra_stages, (name, stage)))
