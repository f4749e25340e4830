"""The context of a contract: its body and annexes, what links them, what is cited and absent, and where they disagree.

Nothing is concluded: a finding says what a text shows, and all but a shown link ask for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import fold
from folioforge.operators.graph import canonical_address, inherit_address, named_document, parse_addresses, resolve_addresses

# Patterns over folded text.
HEADING = r"^\s*phu\s+luc\s+(?:so\s*)?(\d+)\b"
MENTION = r"\bphu\s+luc\s+(?:so\s*)?(\d+)\b"
AMENDMENT = r"\b(?:sua\s+doi|thay\s+the|dieu\s+chinh|bo\s+sung|cap\s+nhat|amend)\b"
CLAUSE = r"\bdieu\s+(\d+(?:\.\d+)?)\b"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"
EXTERNAL, EXTERNAL_WINDOW = r"\b(?:bo luat|luat|nghi dinh|thong tu|quyet dinh|phap lenh|nghi quyet)\b", 60


def annex_key(number: Column) -> Column:
    """A number without leading zeros, so that annex 1 and 01 are one."""
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def page_annexes(pages: DataFrame) -> DataFrame:
    """(dossier, file, page, annex): the annex that each page stands in, null for the body.

    A page opens an annex by the first of its lines that is a heading of one, on the first page that has it; the annex
    runs to the next opening. A mention within a line opens nothing.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"^\s*[pP][hH]"))
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(fold(x), HEADING, 1)), lambda n: n != "")
    p = pages.select("dossier", "file", "page", F.get(found, F.lit(0)).alias("_mark"))
    seen = W.partitionBy("dossier", "file", "_mark").orderBy("page")
    p = p.withColumn("_mark", F.when(F.col("_mark").isNotNull() & (F.row_number().over(seen) == 1), F.col("_mark")))
    upto = W.partitionBy("dossier", "file").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return p.select("dossier", "file", "page", F.last("_mark", True).over(upto).alias("annex"))


def placed(nodes: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """nodes (dossier, file, node_id, page, ord, text) with part and annex: `body`, an annex within a file, or a whole file that is declared an annex."""
    where = page_annexes(pages)
    first = where.where("annex IS NOT NULL").groupBy("dossier", "file").agg(F.min_by("annex", "page").alias("_first"))
    role = files.select("dossier", "file", (F.col("role") == "annex").alias("_whole"))
    n = nodes.join(where, ["dossier", "file", "page"], "left").join(role, ["dossier", "file"], "left").join(first, ["dossier", "file"], "left")
    whole = F.coalesce("_whole", F.lit(False))
    file = F.col("file").cast("string")
    part = F.when(whole & F.col("_first").isNotNull(), F.concat(F.lit("annex:"), "_first", F.lit(":"), file)).when(whole, F.concat(F.lit("annex:file:"), file)).when(F.col("annex").isNotNull(), F.concat(F.lit("annex:"), "annex")).otherwise("body")
    return n.withColumns({"part": part, "annex": F.when(whole, F.col("_first")).otherwise(F.col("annex"))}).select(*nodes.columns, "part", "annex")


def parts(found: DataFrame) -> DataFrame:
    """(dossier, part, kind, annex, n_nodes, first_page, last_page)."""
    kind = F.when(F.col("part") == "body", "BODY").otherwise("ANNEX")
    return found.groupBy("dossier", "part").agg(F.first(kind).alias("kind"), F.first("annex").alias("annex"), F.count("*").alias("n_nodes"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def findings(found: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(dossier, kind, subject, state, relation, nodes, details): what placed nodes, and facts of theirs, show of a contract.

    PART_LINK (PASS): the body names an annex, or the annex names its contract; nodes are those that do. CONTEXT_GAP: an
    annex that nothing links, or one that the body names and no heading opens. AMENDMENT_SIGNAL: an annex with words of
    change; details hold the clauses and dates that it names. CONTEXT_CONFLICT: annexes whose facts of one item differ;
    details hold the values and parts. facts: dossier, node_id, item_key, value. What the body cites is exploded from its
    mentions and met with the parts by key, so no text meets every annex.
    """
    n = found.withColumn("_t", fold(F.coalesce("text", F.lit(""))))
    annexes = n.where("part <> 'body'")
    body = n.where("part = 'body'").withColumn("_said", F.transform(F.regexp_extract_all("_t", F.lit(MENTION), F.lit(1)), lambda x: x))
    said = body.select("dossier", "node_id", "ord", F.explode(F.array_distinct("_said")).alias("raw")).withColumn("key", annex_key(F.col("raw")))
    list_of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])

    each = annexes.groupBy("dossier", "part").agg(
        F.first("annex").alias("annex"), F.min_by("node_id", F.struct("ord", "node_id")).alias("_first"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").contains("hop dong") & (F.col("_t").contains("kem theo") | F.col("_t").contains("so ")), F.struct("ord", "node_id")))), lambda x: x["node_id"]).alias("_own"),
        F.max(F.col("_t").rlike(AMENDMENT)).alias("_changes"), list_of("node_id").alias("_nodes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("_t", F.lit(CLAUSE), F.lit(1)))))).alias("_clauses"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(DATE), F.lit(0)))))).alias("_dates"),
    ).withColumn("key", annex_key(F.col("annex")))
    named = said.groupBy("dossier", "key").agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "node_id"))), lambda x: x["node_id"]).alias("_named"))
    # an annex without a number is named by any mention of an annex
    any_ = body.where(F.col("_t").contains("phu luc")).groupBy("dossier").agg(list_of("node_id").alias("_any"))
    each = each.join(named, ["dossier", "key"], "left").join(any_, "dossier", "left")
    refs = F.concat(F.coalesce(F.when(F.col("annex").isNull(), F.col("_any")).otherwise(F.col("_named")), F.array().cast("array<string>")), "_own")
    each = each.withColumn("_refs", refs)
    number = F.concat(F.lit("annex:"), F.coalesce("annex", F.lit("")))
    linked = F.size("_refs") > 0
    none = F.lit(None).cast("string")
    details = lambda clauses, dates, values, of: F.struct(clauses.alias("clauses"), dates.alias("dates"), values.alias("values"), of.alias("parts"))
    empty = F.array().cast("array<string>")
    nothing = details(empty, empty, empty, empty)
    row = lambda d, kind, subject, state, relation, nodes, more: d.select("dossier", kind.alias("kind"), subject.alias("subject"), state.alias("state"), relation.alias("relation"), nodes.alias("nodes"), more.alias("details"))
    review = F.lit("NEEDS_REVIEW")
    links = row(each, F.when(linked, "PART_LINK").otherwise("CONTEXT_GAP"), number, F.when(linked, "PASS").otherwise(review), F.when(linked, "REFERENCES"), F.when(linked, F.col("_refs")).otherwise(F.array("_first")), nothing)
    changes = row(each.where("_changes"), F.lit("AMENDMENT_SIGNAL"), number, review, F.lit("AMENDS"), F.col("_nodes"), details(F.col("_clauses"), F.col("_dates"), empty, empty))
    # only annexes that a heading opens within the contract's own files are present; the others are declared, not opened
    opened = annexes.where(F.col("part") == F.concat(F.lit("annex:"), "annex")).select("dossier", annex_key(F.col("annex")).alias("key")).distinct()
    absent = said.join(opened, ["dossier", "key"], "left_anti").groupBy("dossier", "raw").agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("node"))
    gaps = row(absent, F.lit("CONTEXT_GAP"), F.concat(F.lit("annex:"), "raw"), review, none, F.array("node"), nothing)
    out = links.unionByName(changes).unionByName(gaps)
    if facts is not None:
        f = facts.join(annexes.select("dossier", "node_id", "part", "ord"), ["dossier", "node_id"]).where("item_key IS NOT NULL")
        f = f.groupBy("dossier", "item_key").agg(F.array_sort(F.collect_set("value")).alias("v"), F.array_sort(F.collect_set("part")).alias("p"), list_of("node_id").alias("ns")).where((F.size("v") > 1) & (F.size("p") > 1))
        out = out.unionByName(row(f, F.lit("CONTEXT_CONFLICT"), F.col("item_key"), review, none, F.col("ns"), details(empty, empty, F.col("v"), F.col("p"))))
    return out


def explicit_targets(nodes: DataFrame, keys: list[str], order: str = "ord", node: str = "node_id", text: str = "text", chain: str = "chain") -> DataFrame:
    """(keys, node_a, node_b): the provisions that a node's text names and that resolve to one other node; a blocking source of candidates.

    An address without its article takes the coarse levels of the nearest complete one before it in the node, else those
    of the node's own place (chain). What names a document or, soon after an address, a law speaks of another text.
    Addresses in reading order are rows with a running last value: an as-of join by order, no join by range.
    """
    sentences = nodes.select(*keys, order, node, chain, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"[.;\n]+")).alias("_s", "_sentence")).where(F.trim("_sentence") != "")
    told = sentences.withColumn("_found", parse_addresses(F.col("_sentence"))).where(F.size("_found") > 0)
    # text after the last address that a law's name would follow
    after = F.left(F.regexp_extract(fold(F.col("_sentence")), r"^.*\b(?:diem|khoan|dieu|phu luc)\s+\S+(.*)$", 1), F.lit(EXTERNAL_WINDOW))
    told = told.where(named_document(F.col("_sentence")).isNull() & ~after.rlike(EXTERNAL))
    a = told.select(*keys, order, node, chain, "_s", F.posexplode("_found").alias("_i", "address"))
    complete = F.col("address.dieu").isNotNull() | F.col("address.phu_luc").isNotNull()
    w = W.partitionBy(*keys, order, node).orderBy("_s", "_i").rowsBetween(W.unboundedPreceding, -1)
    near = F.coalesce(F.last(F.when(complete, F.col("address")), True).over(w), F.col(chain))
    full = a.withColumn("address", inherit_address(F.col("address"), near)).withColumn("_r", F.struct(node, "_s", "_i"))
    met = resolve_addresses(full.select(*keys, "_r", "address").distinct(), nodes, keys, "_r", node, "address", chain, text)
    return met.where("state IN ('UNIQUE', 'ANCESTOR')").select(*keys, F.col(f"_r.{node}").alias("node_a"), F.col(node).alias("node_b")).where("node_a <> node_b").distinct()


__all__ = ["annex_key", "canonical_address", "explicit_targets", "findings", "page_annexes", "parts", "placed"]
