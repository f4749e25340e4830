"""Facts and events from nodes and lines, page breaks, hierarchies and windows that seek a boundary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.numbers import MONEY, money_decimal
from folioforge.functions.text import fold, heading_level, scale_phrase, tax_basis

EVENTS_MOST = 256


def extract_facts(nodes: DataFrame, keys: Sequence[str], node: str = "node_id", text: str = "text") -> DataFrame:
    """(keys, node, ord, kind, raw_value, normalized_value, unit, tax_basis): the money, percent, date and tax-number values of each text, in order of kind and place."""
    t = fold(F.col(text))
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw_value")))
    values = F.concat(found("MONEY", MONEY), found("PERCENT", r"(?<![\d.,])\d{1,3}(?:[.,]\d+)?\s*%"), found("DATE", r"(?<!\d)\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(?!\d)"), found("TAX_CODE", r"(?:mst|ma so thue)\s*:?\s*\d{10}(?:-\d{3})?"))
    got = nodes.select(*keys, node, tax_basis(F.col(text)).alias("tax_basis"), F.posexplode(values).alias("ord", "f")).select(*keys, node, "ord", "f.*", "tax_basis")
    raw = F.col("raw_value")
    number = money_decimal(raw).cast("string")
    plain = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    value = F.when(F.col("kind").isin("MONEY", "PERCENT"), plain).when(F.col("kind") == "DATE", F.try_to_date(F.regexp_replace(raw, "[.-]", "/"), "d/M/yyyy").cast("string")).otherwise(F.regexp_extract(raw, r"(\d{10}(?:-\d{3})?)", 1))
    unit = F.when(F.col("kind") == "PERCENT", "percent").when(raw.rlike("usd"), "USD").when(F.col("kind") == "MONEY", "VND")
    return got.withColumn("normalized_value", value).withColumn("unit", unit).withColumn("tax_basis", F.when(F.col("kind") == "MONEY", F.col("tax_basis")))


def contract_value(text: Column) -> Column:
    """The amount behind a label of the contract's total: digits, or one, two or three with a scale word; null without a label."""
    t = fold(text)
    label = r"(?:tong gia tri hop dong|gia tri hop dong|total contract value)"
    digits = F.regexp_extract(t, label + r"\D{0,40}?(\d{1,3}(?:[.,]\d{3})+)", 1)
    words = F.regexp_extract(t, label + r"[^\d.;]{0,40}?((?:mot|hai|ba) (?:ty|trieu|nghin))", 1)
    return F.when(digits != "", F.regexp_replace(digits, "[.,]", "")).when(words != "", scale_phrase(words))


def labelled_fields(lines: DataFrame, keys: Sequence[str], labels: dict[str, str], text: str = "line") -> DataFrame:
    """(keys, field, raw_value) of `label: value` lines; labels maps a field to a pattern of folded labels."""
    t = F.col(text)
    key, value = fold(F.regexp_extract(t, r"^([^:\n]{1,60}):", 1)), F.trim(F.regexp_extract(t, r"^[^:\n]{1,60}:\s*(.*)$", 1))
    field = F
    for name, pattern in labels.items():
        field = field.when(key.rlike(pattern), name)
    got = lines.withColumn("field", field.otherwise(None)).withColumn("raw_value", value)
    return got.where("field IS NOT NULL AND raw_value <> ''").select(*keys, "field", "raw_value")


def contract_events(nodes: DataFrame, lexicon: dict[str, Sequence[str]], keys: Sequence[str], order: str, node: str = "node_id", text: str = "text", most: int = EVENTS_MOST) -> DataFrame:
    """(keys, node, event_type, state): an event for each type whose words a text holds; fields are left out; PASS for confirmed nodes. The first `most` of the keys, in order."""
    t = fold(F.col(text))
    types = F.array_compact(F.array(*[F.when(t.rlike("|".join(terms)), F.lit(name)) for name, terms in lexicon.items()]))
    got = nodes.where("node_type <> 'FIELD'").select(*keys, node, order, "status", F.posexplode(types).alias("rank", "event_type"))
    got = got.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order, node, "rank"))).where(F.col("_rn") <= most)
    return got.select(*keys, node, "event_type", F.when(F.col("status") == "CONFIRMED", "PASS").otherwise("NEEDS_REVIEW").alias("state"))


def bilingual_pairs(nodes: DataFrame, keys: Sequence[str], order: str, label: str = "label", text: str = "text") -> DataFrame:
    """(keys, number, english, vietnamese): articles of both languages with one number whose stripped texts differ; the last node of a number counts."""
    side = lambda p, name: nodes.select(*keys, order, F.regexp_extract(F.col(label), p, 1).alias("number"), F.trim(text).alias("t")).where("number <> ''").groupBy(*keys, "number").agg(F.max_by("t", order).alias(name))
    return side(r"(?i)^\s*art(?:icle)?\.?\s+(\d+)", "english").join(side(r"(?iu)^\s*điều\s+(\d+)", "vietnamese"), [*keys, "number"]).where("english <> vietnamese")


def reused_phrases(nodes: DataFrame, keys: Sequence[str], node: str = "node_id", label: str = "label", text: str = "text", n: int = 3) -> DataFrame:
    """(keys, node): the first node whose label says that it is new and of which an n-word window stands in another node."""
    w = nodes.select(*keys, node, fold(F.col(label)).rlike(r"\bmoi\b").alias("new"), F.split(fold(F.col(text)), " ").alias("w"))
    grams = w.where(F.size("w") >= n).select(*keys, node, "new", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("g"))
    seen = grams.groupBy(*keys, "g").agg(F.count("*").alias("_n")).where("_n > 1")
    return grams.where("new").join(seen, [*keys, "g"]).groupBy(*keys).agg(F.min(node).alias(node))


def round_robin(frames: DataFrame, document: str, order: str) -> DataFrame:
    """frames with turn: documents alternate, in the order in which they were first seen."""
    first = frames.groupBy(document).agg(F.min(order).alias("_first"))
    got = frames.join(first, document).withColumn("_k", F.row_number().over(W.partitionBy(document).orderBy(order)))
    return got.withColumn("turn", F.struct("_k", "_first")).drop("_k", "_first")


def page_wraps(lines: DataFrame, keys: Sequence[str], page: str, order: str, text: str, least: int = 60) -> DataFrame:
    """(keys, page, last_line, next_line): a long last content line without an end mark before a first line in lower case, on adjacent pages. Page marks, capitals and digit-masked repeats are no content."""
    masked = F.regexp_replace(fold(F.col(text)), r"\d+", "#")
    t = lines.withColumn("_m", masked).where((F.trim(text) != "") & ~F.col("_m").rlike(r"^(trang|page)?\s*#(\s*/\s*#)?$") & ~((F.upper(text) == F.col(text)) & (F.lower(text) != F.col(text))))
    often = t.groupBy(*keys, "_m").agg(F.count_distinct(page).alias("_n")).where("_n > 1")
    t = t.join(often, [*keys, "_m"], "left_anti")
    edge = t.groupBy(*keys, page).agg(F.max_by(text, order).alias("last_line"), F.min_by(text, order).alias("first_line"))
    nxt = edge.select(*keys, (F.col(page) - 1).alias(page), F.col("first_line").alias("next_line"))
    return edge.join(nxt, [*keys, page]).where((F.char_length("last_line") >= least) & ~F.rtrim("last_line").rlike(r"[.;:!?]$") & F.col("next_line").rlike(r"(?u)^\s*\p{Ll}")).select(*keys, page, "last_line", "next_line")


def repeated_bands(lines: DataFrame, keys: Sequence[str], page: str, band: str, text: str, share: float = 0.6) -> DataFrame:
    """(keys, band, masked): digit-masked lines in the top or bottom band of enough pages; one page repeats nothing."""
    pages = lines.groupBy(*keys).agg(F.count_distinct(page).alias("_pages")).where("_pages > 1")
    got = lines.withColumn("masked", F.regexp_replace(fold(F.col(text)), r"\d+", "#")).where("masked <> ''").groupBy(*keys, band, "masked").agg(F.count_distinct(page).alias("_n"))
    return got.join(pages, list(keys)).where(F.col("_n") >= share * F.col("_pages")).select(*keys, band, "masked")


def hierarchy(segments: DataFrame, keys: Sequence[str], order: str, label: str = "label", node_type: str = "node_type") -> DataFrame:
    """segments with level and parent_ord: the last segment before it of the nearest coarser level."""
    levels = ["ANNEX", "SECTION", "ARTICLE", "SUBCLAUSE", "BLOCK"]
    got = segments.withColumn("level", heading_level(F.col(label), F.col(node_type)))
    rank = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level"))
    got = got.withColumn("_r", rank)
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = {i: F.last(F.when(F.col("_r") == i, F.col(order)), ignorenulls=True).over(w) for i in range(1, 5)}
    got = got.withColumns({f"_l{i}": c for i, c in last.items()})
    # an annex closes what was open before it, an article the clauses, and so on: the greatest of the coarser ones is the open one
    parent = F.greatest(*[F.when(F.col("_r") > i, F.col(f"_l{i}")) for i in range(1, 5)])
    return got.withColumn("parent_ord", parent).drop("_r", *[f"_l{i}" for i in range(1, 5)])


def final_confidence(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum of the signals, within 0 and 1; a missing signal counts 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(scores[name], F.lit(0.0)) * weight
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def boundary_action(last_line: Column, next_line: Column) -> Column:
    """What a page break does to a paragraph: NEW_HEADING, MERGE_HYPHEN, MERGE, NEW_PARAGRAPH or UNSURE, by the first rule that holds."""
    return (
        F.when(next_line.isNull() | last_line.isNull(), "NEW_PARAGRAPH").when(heading_level(next_line, F.lit("")) != "BLOCK", "NEW_HEADING").when(F.rtrim(last_line).rlike(r"\p{L}-$"), "MERGE_HYPHEN")
        .when(~F.rtrim(last_line).rlike(r"[.;:!?]$") & next_line.rlike(r"(?u)^\s*\p{Ll}"), "MERGE").when(F.rtrim(last_line).rlike(r"[.;!?]$"), "NEW_PARAGRAPH").otherwise("UNSURE")
    )


def seeking_windows(df: DataFrame, key: str, text: str = "text", size: int = 1600, overlap: int = 200) -> DataFrame:
    """(key, start, end, piece): windows of at most `size` characters that end at a line break, else after a full stop, past their half; the next one begins `overlap` before. Each end depends on the one before, so a text is cut in its worker."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                at, t = 0, t or ""
                while at < len(t):
                    end = min(len(t), at + size)
                    if end < len(t):
                        cut = t.rfind("\n", at + size // 2, end)
                        cut = cut if cut > 0 else t.rfind(". ", at + size // 2, end)
                        end = cut + 1 if cut > 0 else end
                    rows.append((k, at, end, t[at:end]))
                    if end == len(t):
                        break
                    at = max(end - overlap, at + 1)
            yield pd.DataFrame(rows, columns=[key, "start", "end", "piece"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, start long, end long, piece string")


def clause_chunks(nodes: DataFrame, crumbs: DataFrame, keys: Sequence[str], node: str = "node_id", text: str = "text") -> DataFrame:
    """(keys, node, chunk): each clause's text behind its breadcrumb."""
    return nodes.join(crumbs, [*keys, node], "left").select(*keys, node, F.concat_ws("\n", "breadcrumb", text).alias("chunk"))
