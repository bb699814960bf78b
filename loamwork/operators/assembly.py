"""Training-set assembly: request plans, response parsing, typed rows, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .documents import window_of

BATCH, SLICE = 100, 3000
#: Row schemas of the dataset types.
SCHEMAS = {
    "qa_pairs": "question string, answer string",
    "classification": "text string, label string",
    "ner": "text string, entities array<struct<text:string,label:string,start:int,end:int>>",
    "summarization": "text string, summary string",
}


def request_plan(df: DataFrame, target, dataset_type: str, column: str = "text", windowed: bool = True) -> DataFrame:
    """One request row per batch of 100 examples: batch_number (from 1), n_examples, content.

    content is the first 3,000 characters of the batch's own window (`documents.window_of`);
    where not windowed, of the text.
    """
    n = F.greatest(F.ceil(target / BATCH), F.lit(1)).cast("int")
    d = df.withColumn("batch_number", F.explode(F.sequence(F.lit(1), n)))
    left = target - (F.col("batch_number") - 1) * BATCH
    own = window_of(F.col(column), F.col("batch_number") - 1, n) if windowed else F.col(column)
    return d.withColumns({"dataset_type": F.lit(dataset_type), "n_examples": F.least(left, F.lit(BATCH)).cast("long"), "content": F.left(own, F.lit(SLICE)), "batch_number": F.col("batch_number").cast("long")})


def parse_responses(df: DataFrame, column: str = "response", schema: str = SCHEMAS["qa_pairs"]) -> DataFrame:
    """Rows from model responses: a JSON list, {data: [...]}, one object, Q:/A: lines, else raw text."""
    c = F.col(column)
    body = F.regexp_extract(c, r"\{[\s\S]*\}|\[[\s\S]*\]", 0)
    keys = [p.strip().split()[0] for p in schema.split(",")] if "<" not in schema else ["text"]
    arr = F.from_json(body, f"array<struct<{', '.join(':'.join(p.strip().split(' ', 1)) for p in schema.split(','))}>>") if "<" not in schema else F.from_json(body, "array<struct<text:string,entities:array<struct<text:string,label:string,start:int,end:int>>>>")
    kind = f"data array<struct<{', '.join(':'.join(p.strip().split(' ', 1)) for p in schema.split(','))}>>" if "<" not in schema else "data array<struct<text:string,entities:array<struct<text:string,label:string,start:int,end:int>>>>"
    wrapped = F.from_json(body, kind)["data"]
    one = F.from_json(body, schema)
    has = lambda s: F.coalesce(s[keys[0]].isNotNull(), F.lit(False))
    qa = F.when(F.rlike(c, F.lit(r"(?m)^Q:")), F.transform(F.filter(F.split(c, r"(?m)^Q:"), lambda x: F.contains(x, F.lit("A:"))), lambda x: F.struct(strip(F.regexp_extract(x, r"^([\s\S]*?)\n?A:", 1)).alias("question"), strip(F.regexp_replace(x, r"^[\s\S]*?A:", "")).alias("answer"))))
    d = df.withColumns({"__a": arr, "__w": wrapped, "__o": one, "__q": qa})
    listed = F.startswith(F.trim(body), F.lit("["))
    how = F.when(listed & F.coalesce(F.size(F.filter("__a", has)) > 0, F.lit(False)), "list").when(F.coalesce(F.size("__w") > 0, F.lit(False)), "data").when(has(F.col("__o")), "object").when(F.coalesce(F.size("__q") > 0, F.lit(False)), "lines").otherwise("raw")
    d = d.withColumn("parsed_as", how)
    rows = F.when(F.col("parsed_as") == "list", F.col("__a")).when(F.col("parsed_as") == "data", F.col("__w")).when(F.col("parsed_as") == "object", F.array("__o"))
    if keys == ["question", "answer"]:
        rows = rows.when(F.col("parsed_as") == "lines", F.col("__q"))
    keep = [x for x in df.columns if x != column]
    d = d.select(*keep, "parsed_as", F.when(F.col("parsed_as") == "raw", c).alias("raw_content"), F.explode_outer(rows).alias("__r"))
    return d.select(*keep, "parsed_as", "raw_content", "__r.*")


def combine(frames: list[DataFrame], target: int, order_cols: list[str]) -> DataFrame:
    """Union of the batches without repeats, the first `target` by order_cols."""
    from .ordering import union_all

    return union_all(frames).dropDuplicates().orderBy(*order_cols).limit(target)


def valid_spans(df: DataFrame) -> DataFrame:
    """Entity rows whose every span holds the entity's text."""
    return df.filter(F.forall("entities", lambda e: F.substr(F.col("text"), e["start"] + 1, e["end"] - e["start"]) == e["text"]))


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = conversations.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return d.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def balanced_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int | None = None) -> DataFrame:
    """Labelled documents with as many of each class as the smallest has, of least hash."""
    from .joins import ranked

    found = labels.filter(F.col(label).isNotNull()).select("doc_id", label)
    if per_class is None:
        per_class = found.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    # ids are ranked without their texts, and no class is one task
    ids = docs.select("doc_id").join(found.hint("merge"), "doc_id").withColumn("__h", F.md5(F.col("doc_id").cast("string")))
    chosen = ranked(ids, [label], ["__h", "doc_id"]).filter(F.col("__pos") <= per_class).select("doc_id", label)
    return docs.join(chosen.hint("merge"), "doc_id")


def pattern_entities(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, label, text, start, end of every match; positions from the pieces between matches."""
    out = None
    for label, p in patterns.items():
        d = docs.filter(F.rlike("text", F.lit(p))).select("doc_id", F.split("text", p, -1).alias("b"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m"))
        d = d.select("doc_id", F.posexplode(F.arrays_zip("b", "m")).alias("i", "x"), "b")
        w = Window.partitionBy("doc_id").orderBy("i")
        d = d.withColumn("end", F.sum(F.length("x.b") + F.length(F.coalesce("x.m", F.lit("")))).over(w)).filter("x.m IS NOT NULL")
        d = d.select("doc_id", F.lit(label).alias("label"), F.col("x.m").alias("text"), (F.col("end") - F.length("x.m")).alias("start"), "end")
        out = d if out is None else out.unionByName(d)
    return out


def lead_summaries(docs: DataFrame, least: int = 3, lead: int = 2, body: int = 5) -> DataFrame:
    """text: the first 3 to 5 sentences; summary: the first of them."""
    s = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")
    d = docs.withColumn("__s", s).filter(F.size("__s") >= least)
    return d.select("doc_id", F.array_join(F.slice("__s", 1, body), " ").alias("text"), F.array_join(F.slice("__s", 1, lead), " ").alias("summary"))


def split(df: DataFrame, key_cols: list[str], train: int = 80, val: int = 10) -> DataFrame:
    """split: train, val or test by the hash of the key, so that equal keys stay together."""
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols])), 1, 8), 16, 10).cast("long"), F.lit(100))
    return df.withColumn("split", F.when(h < train, "train").when(h < train + val, "val").otherwise("test"))


