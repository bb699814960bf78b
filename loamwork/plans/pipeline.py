"""Step lists: registered step types folded over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import checks, cleaning, documents, joins, pii_masking, profile, task_checks, transforms

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Register a function (DataFrame, config) -> DataFrame under a step type."""

    def add(fn: Step) -> Step:
        STEPS[name] = fn
        return fn

    return add


step("rename")(lambda df, c: transforms.rename(df, c["mapping"]))
step("filter")(lambda df, c: transforms.filter_rows(df, c["condition"]))
step("select")(lambda df, c: transforms.select(df, c["columns"]))
step("cast")(lambda df, c: transforms.cast(df, c["types"]))
step("aggregate")(lambda df, c: profile.group_aggregate(df, c["keys"], c["aggs"]))
step("custom")(lambda df, c: transforms.custom(df, c["fn"]))
step("sample")(lambda df, c: transforms.sample_by_hash(df, c["key_cols"], c.get("n", 1000)))
step("data_cleaning")(lambda df, c: cleaning.clean(df, **c))
step("text_cleaning")(lambda df, c: cleaning.clean(df, **{"missing": "fill", **c}))
step("text_preprocessing")(lambda df, c: cleaning.clean(df, **{"missing": "fill", **c}))
step("outlier_detection")(lambda df, c: cleaning.outliers(df, **c))
step("pii_detection")(lambda df, c: {"mask": pii_masking.redact, "remove": pii_masking.blank, "flag": pii_masking.flag, "partial": pii_masking.mask}[c.get("action", "mask")](df, c.get("columns")))
step("content_analysis")(lambda df, c: documents.analyse(df, c.get("column", "text")))
step("quality_validation")(lambda df, c: checks.validate(df, c.get("schema"), c.get("rules")))
step("content_validation")(lambda df, c: task_checks.task_quality(df)[0])
step("metadata_enrichment")(lambda df, c: df)
step("text_extraction")(lambda df, c: df)


@step("join")
def _join(inputs: dict[str, DataFrame], c: dict) -> DataFrame:
    left, right = (inputs[n] for n in c["inputs"])
    return joins.join_step(left, right, c["keys"], c.get("how", "inner"))


@step("map_pandas")
def _map_pandas(df: DataFrame, c: dict) -> DataFrame:
    """A user's function over batches, with a declared result schema."""
    return df.mapInPandas(c["fn"], c["schema"])


def run(steps: list[dict], source: DataFrame, others: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Name -> lazy result of every step.  A step reads its parent's table, or, with several
    parents, a dict of tables by name; without depends_on it reads the step before it.
    `checkpoint: path` writes a step's table there and reads it again."""
    done: dict[str, DataFrame] = {"source": source, **(others or {})}
    last = "source"
    for s in steps:
        if s["type"] not in STEPS:
            raise ValueError(f"unknown step type {s['type']}")
        parents = s.get("depends_on") or [last]
        unknown = [p for p in parents if p not in done]
        if unknown:
            raise ValueError(f"{s['name']}: unknown parents {unknown}")
        given = done[parents[0]] if len(parents) == 1 else {p: done[p] for p in parents}
        out = STEPS[s["type"]](given, s.get("config", {}))
        if path := s.get("checkpoint"):
            out.write.mode("overwrite").parquet(path)
            out = out.sparkSession.read.schema(out.schema).parquet(path)
        done[s["name"]] = out
        last = s["name"]
    return done
