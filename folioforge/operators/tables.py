"""Tables: headers, amounts, arithmetic checks, payment schedules, rows and fragments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.numbers import boq_decimal, parse_amount, percent
from folioforge.functions.text import fold

# What names an amount column, and what describes a row.
AMOUNT_NAMES = ("amount", "thanh tien", "total amount", "line total", "tong cong", "gia tri", "subtotal", "total")
ROW_NAMES = ("description", "mo ta", "noi dung", "dien giai", "hang muc", "item", "unit", "dvt", "qty", "sl", "quantity", "don gia", "unit price")
MONEY = "decimal(38,6)"


def cells(tables: DataFrame, keys: Sequence[str], rows: str = "rows") -> DataFrame:
    """(keys, row_no, col_no, cell) of array<array<string>>."""
    return tables.select(*keys, F.posexplode(rows).alias("row_no", "_r")).select(*keys, "row_no", F.posexplode("_r").alias("col_no", "cell"))


def amount_column(header: Column) -> Column:
    """The index of the only header cell that names an amount; null for none or several."""
    named = F.filter(F.transform(header, lambda c, i: F.when(fold(F.coalesce(c, F.lit(""))).rlike("|".join(AMOUNT_NAMES)), i)), lambda i: i.isNotNull())
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def header_row(rows: Column) -> Column:
    """The index of the first of five rows with one amount column and a descriptor; null without one."""
    described = lambda r: F.exists(r, lambda c: fold(F.coalesce(c, F.lit(""))).rlike("|".join(ROW_NAMES)))
    ok = F.transform(F.slice(rows, 1, 5), lambda r, i: F.when(amount_column(r).isNotNull() & described(r), i))
    return F.array_min(F.filter(ok, lambda i: i.isNotNull()))


def is_header_continuation(row: Column) -> Column:
    """A row under the header that is blank, in brackets, or all units and names."""
    filled = F.filter(F.transform(row, lambda c: fold(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return F.forall(filled, lambda c: c.rlike(r"^[(\[]|vnd|usd|don vi|quantity|price|amount"))


def table_facts(tables: DataFrame, keys: Sequence[str], rows: str = "rows") -> DataFrame:
    """(keys, row_no, label, raw_value, amount, review_state): one fact for each data row under the header; repeats of the header and notes are left out, blank amounts are MISSING."""
    t = tables.withColumn("_h", header_row(F.col(rows))).where("_h IS NOT NULL").withColumn("_col", amount_column(F.get(rows, F.col("_h")))).withColumn("_head", F.get(rows, F.col("_h")))
    each = t.select(*keys, "_h", "_col", "_head", F.posexplode(rows).alias("row_no", "_r")).where("row_no > _h")
    each = each.where(~((F.col("row_no") <= F.col("_h") + 2) & is_header_continuation(F.col("_r"))) & (F.col("_r") != F.col("_head")))
    raw, label = F.trim(F.coalesce(F.get("_r", F.col("_col")), F.lit(""))), F.get(F.filter("_r", lambda c: F.coalesce(c, F.lit("")).rlike(r"\p{L}")), F.lit(0))
    amount = parse_amount(raw)
    note = label.rlike(r"(?iu)^\s*(ghi chú|note|\*)") & (raw == "")
    out = each.where(~F.coalesce(note, F.lit(False))).select(*keys, "row_no", label.alias("label"), F.nullif(raw, F.lit("")).alias("raw_value"), amount.alias("amount"))
    return out.withColumn("review_state", F.when(F.col("raw_value").isNull(), "MISSING").when(F.col("amount").isNull(), "NEEDS_REVIEW").otherwise("PASS"))


def check_boq(lines: DataFrame, keys: Sequence[str], role: str = "role", quantity: str = "quantity", price: str = "price", amount: str = "amount", rate: str = "tax_rate") -> DataFrame:
    """(keys, issues, state): exact decimal checks of a bill of quantities.

    Lines: quantity times price is the amount. Totals: lines add up to the subtotal, subtotal and tax to the total, and
    the tax is within 1 of its rate. role is line, subtotal, tax or total. PASS without an issue.
    """
    n = lines.select(*keys, role, F.col(rate), *[F.col(c).cast(MONEY).alias(c) for c in (quantity, price, amount)])
    of = lambda r: F.max(F.when(F.col(role) == r, F.col(amount)))
    wrong = (F.col(role) == "line") & ~F.coalesce((F.col(quantity).cast("decimal(19,6)") * F.col(price).cast("decimal(19,6)")).cast(MONEY) == F.col(amount), F.lit(False))
    agg = n.groupBy(*keys).agg(F.count_if(wrong).alias("_wrong"), F.sum(F.when(F.col(role) == "line", F.col(amount))).alias("_sum"), of("subtotal").alias("_sub"), of("tax").alias("_tax"), of("total").alias("_total"), F.max(F.when(F.col(role) == "tax", F.col(rate))).alias("_rate"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("_wrong") > 0, "LINE_AMOUNT_MISMATCH"),
            F.when(F.col("_sub") != F.col("_sum"), "SUBTOTAL_MISMATCH"),
            F.when(F.col("_total") != F.coalesce("_sub", "_sum") + F.coalesce("_tax", F.lit(0)), "TOTAL_MISMATCH"),
            F.when(F.abs(F.col("_tax") - F.coalesce("_sub", "_sum") * F.col("_rate") / 100) > 1, "TAX_MISMATCH"),
        )
    )
    return agg.withColumn("issues", issues).select(*keys, "issues", F.when(F.size("issues") == 0, "PASS").otherwise("NEEDS_REVIEW").alias("state"))


def payment_schedule(rows: DataFrame, keys: Sequence[str], label: str, share: str) -> DataFrame:
    """(keys, n, total, issues, state): shares over 0 and up to 100, labels once each, and a sum of exactly 100."""
    p = rows.select(*keys, fold(F.col(label)).alias("_l"), percent(F.col(share)).alias("_p"))
    got = p.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_p").alias("total"), F.count_if(F.col("_p").isNull() | (F.col("_p") <= 0) | (F.col("_p") > 100)).alias("_bad"), (F.count("_l") - F.count_distinct("_l")).alias("_twice"))
    issues = F.array_compact(F.array(F.when(F.col("_bad") > 0, "INVALID_PERCENT"), F.when(F.col("_twice") > 0, "DUPLICATE_LABEL"), F.when(~F.coalesce(F.col("total") == 100, F.lit(False)), "SUM_NOT_100")))
    return got.withColumn("issues", issues).select(*keys, "n", "total", "issues", F.when(F.size("issues") == 0, "PASS").otherwise("NEEDS_REVIEW").alias("state"))


def physical_lines(words: DataFrame, keys: Sequence[str], ratio: float = 0.6) -> DataFrame:
    """words with line_no: by the centre's distance to the running mean of the open line, in median heights. One page is one task's group."""
    from pyspark.sql import types as T

    schema = T.StructType([*words.schema.fields, T.StructField("line_no", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_c=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["_c", "x0"])
        limit = ratio * (pdf["y1"] - pdf["y0"]).median()
        out, line, total, n = [], -1, 0.0, 0
        for c in pdf["_c"]:
            if n == 0 or abs(c - total / n) > limit:
                line, total, n = line + 1, 0.0, 0
            total, n = total + c, n + 1
            out.append(line)
        return pdf.drop(columns="_c").assign(line_no=out)

    return words.groupBy(*keys).applyInPandas(run, schema)


def column_bounds(words: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """(keys, bounds): middles of the gaps, at least so wide, between merged x-intervals."""
    w = W.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = words.withColumn("_r", reach).where(F.col("x0") - F.col("_r") >= gap)
    found = cut.groupBy(*keys).agg(F.sort_array(F.collect_set((F.col("x0") + F.col("_r")) / 2)).alias("bounds"))
    return words.select(*keys).distinct().join(found, list(keys), "left").withColumn("bounds", F.coalesce("bounds", F.array().cast("array<double>")))


def anchor_column(cells_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, anchor_col): the column whose cells most often are the whole numbers of a sequence; the leftmost of equals."""
    w = W.partitionBy(*keys, "col_no").orderBy("row_no")
    n = F.regexp_extract("cell", r"^\s*(\d+)\.?\s*$", 1).try_cast("int")
    seq = cells_.withColumn("_n", n).withColumn("_step", (F.col("_n") - F.lag("_n").over(w) == 1).cast("int"))
    scored = seq.groupBy(*keys, "col_no").agg((F.count("_n") + F.coalesce(F.sum("_step"), F.lit(0))).alias("_s")).where("_s > 0")
    return scored.groupBy(*keys).agg(F.max_by("col_no", F.struct("_s", -F.col("col_no"))).alias("anchor_col"))


def logical_rows(lines: DataFrame, keys: Sequence[str], anchor: str, text: str, top: str, order: str, ratio: float = 1.8) -> DataFrame:
    """(keys, logical_row, text, needs_review): an anchor begins a row; without one, a gap over `ratio` medians does and flags it."""
    w = W.partitionBy(*keys).orderBy(order)
    gap = F.col(top) - F.lag(top).over(w)
    g = lines.withColumn("_gap", gap)
    g = g.withColumn("_mid", F.median("_gap").over(W.partitionBy(*keys)))
    has = F.coalesce(F.trim(anchor) != "", F.lit(False))
    loose = ~has & (F.col("_gap") > ratio * F.col("_mid"))
    g = g.withColumn("_new", (has | F.coalesce(loose, F.lit(False))).cast("int")).withColumn("_loose", F.coalesce(loose, F.lit(False)))
    g = g.withColumn("logical_row", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return g.groupBy(*keys, "logical_row").agg(F.concat_ws(" ", F.transform(parts, lambda x: x[text])).alias(text), F.max("_loose").alias("needs_review"))


def fill_down(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Empty cells take the one above, with filled_down naming the columns."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    blank = {c: F.nullif(F.trim(c), F.lit("")) for c in columns}
    filled = F.array_compact(F.array(*[F.when(blank[c].isNull() & F.last(blank[c], ignorenulls=True).over(w).isNotNull(), F.lit(c)) for c in columns]))
    return rows.withColumns({**{c: F.coalesce(F.last(blank[c], ignorenulls=True).over(w), F.col(c)) for c in columns}, "filled_down": filled})


def merge_score(df: DataFrame, weights: dict[str, float], gates: Sequence[Column], threshold: float = 0.6) -> DataFrame:
    """df with score and merge: no gate holds, and the weights of the signals (boolean columns) reach the threshold."""
    stop = F.lit(False)
    for g in gates:
        stop = stop | F.coalesce(g, F.lit(False))
    total = sum((F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", F.when(stop, 0.0).otherwise(total)).withColumn("merge", ~stop & (F.col("score") >= threshold))


def chain_fragments(fragments: DataFrame, keys: Sequence[str], order: str, merges: str) -> DataFrame:
    """fragments with table_no: a fragment that doesn't merge with the one before begins a table."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return fragments.withColumn("table_no", F.sum((~F.coalesce(F.col(merges), F.lit(False))).cast("int")).over(w))


def tables_continue(width_a: Column, width_b: Column, header_similarity: Column) -> Column:
    """(continues, confidence): never for different widths; for equal ones always, surer with like headers."""
    same = width_a == width_b
    return F.struct(F.coalesce(same, F.lit(False)).alias("continues"), F.when(~F.coalesce(same, F.lit(False)), 0.0).when(header_similarity >= 85, F.greatest(F.lit(0.9), header_similarity / 100)).otherwise(0.75).alias("confidence"))


def validate_anchors(rows: DataFrame, keys: Sequence[str], anchor: str, order: str) -> DataFrame:
    """(keys, issues): the greatest anchor is the row count; anchors never fall and never leap by more than 1."""
    w = W.partitionBy(*keys).orderBy(order)
    step = rows.withColumn("_d", F.col(anchor) - F.lag(anchor).over(w))
    got = step.groupBy(*keys).agg(F.max(anchor).alias("_m"), F.count("*").alias("_n"), F.count_if(F.expr("_d < 0")).alias("_down"), F.count_if(F.expr("_d > 1")).alias("_leap"))
    return got.select(*keys, F.array_compact(F.array(F.when(~F.coalesce(F.col("_m") == F.col("_n"), F.lit(False)), "ROW_COUNT"), F.when(F.col("_down") > 0, "ANCHOR_DECREASE"), F.when(F.col("_leap") > 0, "ANCHOR_GAP"))).alias("issues"))


def markdown_table(text: Column) -> Column:
    """Rows of a pipe table, without the line of dashes: array<array<string>>."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda r: r.startswith("|") & ~r.rlike(r"^\|[\s:|-]+\|?$"))
    return F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))


def rectangular(rows: Column) -> Column:
    """Rows padded with nulls to the longest one's width."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r))))


def parse_cell(cell: Column) -> Column:
    return boq_decimal(cell)


def header_similarity(pairs: DataFrame, a: str, b: str, out: str = "header_similarity") -> DataFrame:
    """The indel ratio of two headers, 0 to 100, in batches."""
    from folioforge.functions.sequence import indel_ratio
    from pyspark.sql import types as T

    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{out: [100 * indel_ratio(x or "", y or "") for x, y in zip(pdf[a], pdf[b], strict=True)]})

    return pairs.mapInPandas(run, schema)


# Words of folded headers that name a payment table, and the budget of one table.
PAYMENT_HEADERS = ("thanh toan", "payment", "milestone")
TABLE_ROWS, TABLE_CELLS, TABLE_PAGES = 200, 5000, 100


def bounded_tables(tables: DataFrame, rows: DataFrame, terms: Sequence[str] = PAYMENT_HEADERS, max_rows: int = TABLE_ROWS, max_cells: int = TABLE_CELLS, max_pages: int = TABLE_PAGES) -> DataFrame:
    """tables (table_id, header, n_rows, n_cols) whose folded header holds a term, with their rows as far as the budget reaches and a report of what it leaves out.

    rows: table_id, row_index (places from 0), cells, pages (the page that each cell cites, or null). Whole rows are
    taken in order: at most max_rows of them and max_cells cells, and none from the first row on whose cells bring the
    table's distinct pages over max_pages. Cells beyond n_cols, and their pages, don't count; a table without columns
    has no rows. Added: rows (array of row_index, cells, pages), processed_rows, source_cells, processed_cells, reason
    ('page cap reached', 'row or cell cap reached' or null) and complete (no reason, and all stated rows are there).
    Null counts are the header's width and no rows. The budget bounds what one table gathers; rows beyond it are
    dropped before any shuffle of theirs but the one that brings the limits.
    """
    folded = F.array_join(F.transform("header", lambda h: fold(F.coalesce(h, F.lit("")))), " ")
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | F.contains(folded, F.lit(t))
    source, width = F.greatest(F.coalesce("n_rows", F.lit(0)), F.lit(0)), F.greatest(F.coalesce("n_cols", F.size("header")), F.lit(0))
    asked = tables.where(wanted).withColumns({"n_rows": source.cast("long"), "n_cols": width.cast("long")})
    fits = F.when(F.col("n_cols") > 0, F.least("n_rows", F.lit(max_rows), F.floor(F.lit(max_cells) / F.col("n_cols")))).otherwise(0).cast("long")
    limits = asked.select("table_id", F.col("n_cols").alias("_width"), fits.alias("_limit"))
    cut = lambda c: F.slice(c, F.lit(1), F.least(F.size("cells"), F.col("_width")).cast("int"))
    taken = rows.join(limits, "table_id").where("row_index < _limit").select("table_id", "row_index", cut("cells").alias("cells"), cut("pages").alias("pages"))
    first = taken.select("table_id", "row_index", F.explode("pages").alias("_page")).where("_page <> ''").groupBy("table_id", "_page").agg(F.min("row_index").alias("_first"))
    over = first.withColumn("_n", F.row_number().over(W.partitionBy("table_id").orderBy("_first", "_page"))).where(F.col("_n") == max_pages + 1).select("table_id", F.col("_first").alias("_stop"))
    kept = taken.join(over, "table_id", "left").where("_stop IS NULL OR row_index < _stop")
    kept = kept.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "cells", "pages"))).alias("rows"), F.sum(F.size("cells")).alias("_cells"))
    out = asked.withColumn("_limit", fits).join(kept, "table_id", "left").join(over, "table_id", "left")
    n = F.when(F.col("rows").isNull(), 0).otherwise(F.size("rows")).cast("long")
    reason = F.when(F.col("_stop").isNotNull(), "page cap reached").when(F.col("_limit") < F.col("n_rows"), "row or cell cap reached")
    out = out.withColumns({"processed_rows": n, "source_cells": F.col("n_rows") * F.col("n_cols"), "processed_cells": F.coalesce("_cells", F.lit(0)), "reason": reason})
    return out.withColumn("complete", F.col("reason").isNull() & (F.col("processed_rows") == F.col("n_rows"))).drop("_limit", "_stop", "_cells")
