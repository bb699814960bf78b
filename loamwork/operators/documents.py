"""Documents: analysis, chunks, packing, and plans of tokens and cost."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Marks of sections; limits and sizes in tokens.
SECTION_MARKS = ("#", "Chapter", "Section", "1.", "2.")
SINGLE, CHUNK, MEAN_BATCH, MANY_DOCS = 50_000, 150_000, 5_000, 10
CHUNK_SIZES = {"small": 25_000, "medium": 50_000, "large": 75_000}
CONTEXT, BATCH_SIZE = 160_000, 5
#: Fixed values by dataset type: overhead of chunks, prompt tokens, tokens per row.
TYPES = {
    "qa_pairs": (1.2, 1200, 250),
    "classification": (1.1, 800, 80),
    "ner": (1.3, 1000, 150),
    "summarization": (1.4, 900, 350),
    "custom": (1.2, 1500, 200),
}
#: Fixed values, rows by characters: (more characters than, least rows, characters a row), then the cap.
ROWS_BY_CHARS = {
    "qa_pairs": (((10000, 100, 150), (5000, 50, 120), (2000, 30, 100), (-1, 20, 80)), 5000),
    "classification": (((10000, 150, 120), (5000, 80, 100), (-1, 30, 80)), 5000),
    "ner": (((10000, 80, 200), (5000, 50, 180), (-1, 20, 150)), 2000),
    "summarization": (((10000, 30, 500), (5000, 20, 400), (-1, 10, 300)), 1000),
    "custom": (((10000, 80, 150), (5000, 50, 130), (-1, 20, 100)), 3000),
}
#: Fixed values, rows by tokens: (more tokens than, least rows, tokens a row, cap).
ROWS_BY_TOKENS = {
    "qa_pairs": ((10000, 100, 100, 2000), (5000, 50, 80, 1000), (-1, 20, 50, 500)),
    "classification": ((10000, 150, 75, 3000), (5000, 100, 60, 1500), (-1, 30, 40, 750)),
    "ner": ((10000, 80, 150, 1000), (5000, 50, 120, 500), (-1, 20, 80, 250)),
    "summarization": ((10000, 30, 300, 500), (5000, 20, 250, 250), (-1, 10, 200, 125)),
    "custom": ((10000, 80, 120, 1500), (5000, 50, 100, 750), (-1, 20, 80, 400)),
}
#: Price per million tokens in and out, of planning.
PLAN_PRICES = (200.0, 500.0)


def analyse(df: DataFrame, column: str = "text") -> DataFrame:
    """analysis_word_count, _char_count, _line_count, _has_tables, _has_sections; null for empty text."""
    c = F.col(column)
    full = c.isNotNull() & (c != "")
    marks = F.lit(False)
    for m in SECTION_MARKS:
        marks = marks | F.contains(c, F.lit(m))
    return df.withColumns(
        {
            "analysis_word_count": F.when(full, X.word_count(c)),
            "analysis_char_count": F.when(full, F.length(c).cast("long")),
            "analysis_line_count": F.when(full, X.line_count(c)),
            "analysis_has_tables": F.when(full, F.contains(F.lower(c), F.lit("table")) | F.contains(c, F.lit("|"))),
            "analysis_has_sections": F.when(full, marks),
        }
    )


def token_totals(docs: DataFrame, group_cols: list[str], column: str = "text") -> DataFrame:
    return docs.groupBy(*group_cols).agg(F.count("*").alias("n_docs"), F.sum(X.tokens(F.coalesce(F.col(column), F.lit("")))).alias("tokens"), F.sum(F.length(F.coalesce(F.col(column), F.lit("")))).cast("long").alias("chars"))


def strategy_of(n_docs, tokens):
    return F.when((n_docs == 1) | (tokens < SINGLE), "single").when((n_docs > MANY_DOCS) & (tokens / n_docs < MEAN_BATCH), "batch").when(tokens > CHUNK, "chunk").otherwise("combine")


def choose_strategy(totals: DataFrame) -> DataFrame:
    return totals.withColumn("strategy", strategy_of(F.col("n_docs"), F.col("tokens")))


def warnings_of(n_docs, tokens):
    return F.filter(F.array(F.when(tokens > 500_000, F.lit("very_large")), F.when(n_docs > 50, F.lit("many_documents")), F.when(tokens > 1_000_000, F.lit("costly"))), lambda x: x.isNotNull())


def chunk_estimate(totals: DataFrame, dataset_type: str = "qa_pairs") -> DataFrame:
    """base_chunks and adjusted_chunks of totals with strategy, and warnings."""
    t = F.col("tokens")
    base = F.when(F.col("strategy") == "chunk", F.ceil(t / CHUNK_SIZES["medium"])).when(F.col("strategy") == "batch", F.ceil(t / (SINGLE * 0.8))).otherwise(1).cast("long")
    d = totals.withColumn("base_chunks", base)
    return d.withColumns({"adjusted_chunks": F.ceil(F.round(F.col("base_chunks") * TYPES.get(dataset_type, TYPES["custom"])[0], 9)).cast("long"), "warnings": F.array_join(warnings_of(F.col("n_docs"), t), ",")})


def bins_of(sizes, limit: int):
    """Greedy bins of an array of sizes, in order: a bin closes before it would exceed limit.

    A fold over token counts only, by Arrow batches: the built-in one copies its list of bins
    at every step.
    """

    @F.pandas_udf("array<long>")
    def fold(arrays: pd.Series) -> pd.Series:
        out = []
        for x in arrays:
            now, used, bins = 0, 0, []
            for i, n in enumerate(x.tolist()):
                if i and used + n > limit:
                    now, used = now + 1, 0
                used += n
                bins.append(now)
            out.append(bins)
        return pd.Series(out)

    return fold(sizes)


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZES["medium"], separator: str = "\n\n", id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, chunk_index, total_chunks, tokens, content: whole paragraphs packed greedily.

    The fold runs over token counts only; a paragraph is never split, so one over the size
    stands alone.  A document within the size is one chunk.
    """
    c = F.coalesce(F.col(column), F.lit(""))
    pieces = F.when(X.tokens(c) <= size, F.array(c)).otherwise(F.split(c, "\\Q" + separator + "\\E", -1))
    d = docs.select(F.col(id_col), pieces.alias("p"))
    d = d.withColumn("b", bins_of(F.transform("p", X.tokens), size))
    n = F.element_at("b", -1) + 1
    d = d.select(id_col, n.alias("total_chunks"), "p", "b", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_index"))
    # bins ascend, so a chunk is a slice of the pieces
    first = F.array_position("b", F.col("chunk_index")).cast("int")
    last = F.coalesce(F.nullif(F.array_position("b", F.col("chunk_index") + 1).cast("int"), F.lit(0)) - 1, F.size("b"))
    part = F.slice("p", first, last - first + 1)
    return d.select(id_col, "chunk_index", "total_chunks", F.aggregate(F.transform(part, X.tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), F.array_join(part, separator).alias("content"))


def pack_documents(docs: DataFrame, group_cols: list[str], order_col: str, limit: int = CONTEXT, column: str = "text") -> DataFrame:
    """group, bin, n_docs, tokens, content: whole documents of a group packed greedily in order.

    Null groups and orders are values; documents of one order go by tokens, then by digest.
    Bins are found over (order, tokens, digest) in ranges (`packing.greedy_bins`), so a group may
    hold most rows; texts join their bins by digest, equal documents once with a count.
    """
    from ..sources.writers import staged
    from .packing import greedy_bins

    x = F.coalesce(F.col(column), F.lit(""))
    # tells documents apart; never null
    digest = F.md5(F.concat(F.md5(x), F.coalesce(F.to_json(F.struct(*group_cols, order_col)), F.lit(""))))
    d = docs.select(*group_cols, F.col(order_col), X.tokens(x).alias("__t"), digest.alias("__h"), x.alias("__x"))
    sizes = staged(d.drop("__x").withColumn("__id", F.monotonically_increasing_id()), "sizes")
    bins = greedy_bins(sizes, group_cols, [order_col, "__t", "__h", "__id"], "__t", limit)
    copies = bins.groupBy("__h", "bin").agg(F.count("*").alias("__n"))
    texts = d.groupBy("__h").agg(*[F.first(c).alias(c) for c in d.columns if c != "__h"])
    j = texts.join(copies.withColumnRenamed("__h", "__h2").hint("merge"), F.col("__h") == F.col("__h2"))
    header = F.concat(F.lit("\n\n--- Document: "), F.coalesce(F.col(order_col).cast("string"), F.lit("")), F.lit(" ---\n\n"), F.col("__x"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order_col), "__t", "__h", F.array_repeat(header, F.col("__n").cast("int")).alias("p"))))
    return j.groupBy(*group_cols, "bin").agg(F.sum("__n").alias("n_docs"), F.sum(F.col("__n") * F.col("__t")).alias("tokens"), F.array_join(F.flatten(F.transform(in_order, lambda r: r["p"])), "").alias("content"))


def batch_documents(docs: DataFrame, group_cols: list[str], order_col: str, size: int = BATCH_SIZE, column: str = "text") -> DataFrame:
    """group, batch_index, batch_total, n_docs, content: `size` documents a batch, with headers."""
    from .ordering import batches

    # positions are found without the texts
    found = batches(docs.select(*group_cols, order_col), size, [order_col], group_cols)
    found = found.withColumnsRenamed({c: f"__{c}" for c in [*group_cols, order_col]})
    b = docs.select(*group_cols, order_col, column).join(found.hint("merge"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group_cols, order_col]])
    part = F.concat(F.lit("=== "), F.col(order_col).cast("string"), F.lit(" ===\n"), F.coalesce(F.col(column), F.lit("")))
    return b.groupBy(*group_cols, "batch_index", "batch_total").agg(F.count("*").alias("n_docs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col), part.alias("h")))), lambda x: x["h"]), "\n\n").alias("content"))


def combined_content(docs: DataFrame, group_cols: list[str], order_col: str, size: int = 3000) -> DataFrame:
    """group, content: `=== name ===` headers and texts in order, cut to size with an ellipsis."""
    from .transforms import text_column

    part = F.concat(F.lit("=== "), F.col(order_col).cast("string"), F.lit(" ===\n"), F.coalesce(text_column(docs), F.lit("")))
    # what lies beyond the cut can't show: texts are cut before they meet, and only the first
    # rows that can reach it meet at all (each has a header of 10 characters and 2 between)
    d = docs.select(*group_cols, F.col(order_col), F.left(part, F.lit(size + 1)).alias("h"))
    w = Window.partitionBy(*group_cols).orderBy(F.col(order_col).asc_nulls_last(), "h")
    d = d.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= size // 12 + 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col), "h"))), lambda x: x["h"]), "\n\n")
    return d.groupBy(*group_cols).agg(X.preview(joined, size).alias("content"))


def rows_by(table: dict, value, dataset_type, capped: bool = True):
    """The row target as a column: a rules table over characters or tokens."""
    out = None
    for name, spec in table.items():
        steps, cap = (spec[0], spec[1]) if isinstance(spec[1], int) else (spec, None)
        e = None
        for s in reversed(steps):
            one = F.greatest(F.lit(s[1]), F.floor(value / s[2]))
            top = cap if cap is not None else s[3]
            one = F.least(one, F.lit(top)) if capped else one
            e = one if e is None else F.when(value > s[0], one).otherwise(e)
        out = F.when(dataset_type == name, e) if out is None else out.when(dataset_type == name, e)
    return out.cast("long")


def rows_from_chars(chars, dataset_type):
    known = F.when(dataset_type.isin(*ROWS_BY_CHARS), dataset_type).otherwise("custom")
    return rows_by(ROWS_BY_CHARS, chars, known)


def rows_from_tokens(tokens, dataset_type):
    known = F.when(dataset_type.isin(*ROWS_BY_TOKENS), dataset_type).otherwise("custom")
    return rows_by(ROWS_BY_TOKENS, tokens, known)


def generator_rows(chars, min_examples: int = 20):
    """The generator's own rule for question pairs: no cap, a floor for short content."""
    return F.when(chars > 2000, rows_by({"qa_pairs": ROWS_BY_CHARS["qa_pairs"]}, chars, F.lit("qa_pairs"), capped=False)).otherwise(F.lit(max(20, min_examples))).cast("long")


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in TYPES.items()], "dataset_type string, overhead double, prompt_tokens long, row_tokens long")


def cost_estimate(totals: DataFrame, instruction_tokens: int = 0, prices=PLAN_PRICES) -> DataFrame:
    """Totals (tokens, chars) by dataset type: tokens in and out, rows, costs, seconds."""
    d = totals.crossJoin(F.broadcast(type_table(totals.sparkSession)))  # five rows
    d = d.withColumns({"input_tokens": F.col("tokens") + F.col("prompt_tokens") + instruction_tokens, "rows": rows_from_chars(F.col("chars"), F.col("dataset_type"))})
    d = d.withColumn("output_tokens", F.col("rows") * F.col("row_tokens"))
    i, o = F.col("input_tokens") * (prices[0] / 1e6), F.col("output_tokens") * (prices[1] / 1e6)
    d = d.withColumns({"input_cost": F.round(i, 4), "output_cost": F.round(o, 4), "total_cost": F.round(i + o, 4)})
    return d.withColumns({"seconds": (F.col("input_tokens") / 10000 + F.col("output_tokens") / 1000 + 5).cast("long"), "over_budget": F.col("total_cost") > 10})


def multi_document_cost(totals: DataFrame, prices=PLAN_PRICES) -> DataFrame:
    """cost_estimate of collections (n_docs, tokens): strategy, chunks, cost times 1.1 and chunks."""
    d = cost_estimate(totals.withColumn("chars", F.col("tokens") * 4), prices=prices)
    d = d.withColumn("strategy", F.when(F.col("tokens") > CHUNK, "chunk").when(F.col("n_docs") > MANY_DOCS, "batch").otherwise("combine"))
    d = d.withColumn("chunks", F.when(F.col("strategy") == "chunk", F.ceil(F.col("tokens") / CHUNK_SIZES["medium"])).when(F.col("strategy") == "batch", F.ceil(F.col("n_docs") / BATCH_SIZE)).otherwise(1).cast("long"))
    many = F.col("strategy").isin("chunk", "batch")
    return d.withColumns({"total_cost": F.when(many, F.round(F.col("total_cost") * 1.1 * F.col("chunks"), 4)).otherwise(F.col("total_cost")), "seconds": F.when(many, F.col("seconds") * F.col("chunks")).otherwise(F.col("seconds"))})


def window_of(c, batch, batches, least: int = 1000):
    """The slice of text c that belongs to batch (from 0) of batches; the whole text for short ones."""
    n, size = F.length(c), F.greatest(F.lit(least), F.floor(F.length(c) / F.greatest(batches, F.lit(1))).cast("int"))
    start = F.least(F.floor(batch * size / 2), n - size)
    return F.when(n > 2 * size, F.substr(c, (start + 1).cast("int"), size.cast("int"))).otherwise(c)


def windows(df: DataFrame, batches: int, column: str = "text", least: int = 1000) -> DataFrame:
    """batch (from 0), content: overlapping slices of long texts, the whole text for short ones."""
    d = df.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    return d.withColumn("content", window_of(F.col(column), F.col("batch"), F.lit(batches), least))


def document_ids(df: DataFrame, *parts: str) -> DataFrame:
    return df.withColumn("document_id", F.left(F.md5(F.concat_ws(":", *parts)), F.lit(12)))


def merge_key_values(df: DataFrame, doc_col: str, page_col: str, map_col: str) -> DataFrame:
    """doc, key, values: a key's values over the pages in order."""
    kv = df.select(doc_col, page_col, F.explode(map_col))
    return kv.groupBy(doc_col, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page_col), F.col("value")))), lambda x: x["value"]).alias("values"))


def text_from_sections(sections, pairs):
    """Section texts, then `key: value` lines, joined by line feeds."""
    return F.array_join(F.concat(sections, F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def confident(df: DataFrame, threshold: float = 0.8, column: str = "confidence") -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit(1.0)) >= threshold)


def rows_from_table_json(df: DataFrame, column: str) -> DataFrame:
    """`{headers, rows}` texts to one map a row: header to cell."""
    t = F.from_json(F.col(column), "headers array<string>, rows array<array<string>>")
    d = df.withColumn("__t", t).withColumn("__row", F.explode(F.col("__t.rows")))
    width = F.least(F.size("__t.headers"), F.size("__row"))
    return d.withColumn("record", F.map_from_arrays(F.slice("__t.headers", F.lit(1), width), F.slice("__row", F.lit(1), width))).drop("__t", "__row")


def step_costs(steps: DataFrame) -> DataFrame:
    """Step rows (step_type, n_rows) with their planned cost."""
    k, n = F.col("step_type"), F.col("n_rows")
    cost = F.when(k == "source", F.lit(0.06)).when(k.isin("transform", "validate"), 0.001 * n / 1000).when(k == "model", 0.01 + n * 10 * 3e-6).otherwise(0.0)
    return steps.withColumn("cost", F.round(cost, 6))


def collection_summary(docs: DataFrame, group_col: str = "source", column: str = "text") -> DataFrame:
    """Documents and tokens by group and in total (group null), from one rollup."""
    return docs.rollup(group_col).agg(F.count("*").alias("n_docs"), F.sum(X.tokens(F.coalesce(F.col(column), F.lit("")))).alias("tokens"))


def document_stats(docs: DataFrame, column: str = "text") -> DataFrame:
    t, n = F.sum(X.tokens(F.coalesce(F.col(column), F.lit("")))), F.count("*")
    d = docs.agg(n.alias("n_docs"), F.coalesce(t, F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.octet_length(column)) / 1048576, F.lit(0.0)).alias("total_mb"))
    return d.withColumns({"strategy": strategy_of(F.col("n_docs"), F.col("tokens")), "warnings": F.array_join(warnings_of(F.col("n_docs"), F.col("tokens")), ",")})


def group_by_similarity(docs: DataFrame, type_col: str = "lang") -> DataFrame:
    """The contract's grouping, by type; by similarity of the texts: `groups.similar_groups`."""
    return docs.groupBy(type_col).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def recommended_steps(catalog: DataFrame) -> DataFrame:
    """step, reason by the kinds of files in a catalog (file_type)."""
    kinds = catalog.agg(F.max(F.rlike("file_type", F.lit("csv|excel")).cast("int")).alias("s"), F.max(F.rlike("file_type", F.lit("pdf|doc")).cast("int")).alias("d"))
    plan = {
        "structured": (("quality_validation", "Ensure data quality"), ("data_cleaning", "Handle missing values and duplicates"), ("pii_detection", "Check for sensitive data")),
        "documents": (("document_extraction", "Extract content from documents"), ("text_cleaning", "Clean and normalize extracted text"), ("content_analysis", "Analyze content structure and metadata"), ("pii_detection", "Check for sensitive information")),
        "mixed": (("quality_validation", "Validate data quality"), ("pii_detection", "Detect sensitive information")),
    }
    steps = F.create_map(*[x for k, v in plan.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("step"), F.lit(b).alias("reason")) for a, b in v]))])
    kind = F.when(F.col("s") == 1, "structured").when(F.col("d") == 1, "documents").otherwise("mixed")
    return kinds.select(F.posexplode(F.element_at(steps, kind)).alias("pos", "x")).select("pos", "x.step", "x.reason")


def numbered(chunks: DataFrame, doc_col: str, order_col: str) -> DataFrame:
    """chunk_number (from 1) and chunk_count within each document."""
    w = Window.partitionBy(doc_col)
    return chunks.withColumns({"chunk_number": F.row_number().over(w.orderBy(order_col)).cast("long"), "chunk_count": F.count("*").over(w)})
