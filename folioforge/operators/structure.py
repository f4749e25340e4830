"""Trees from evidence: outlines of headings by a stack, and the repair of given nodes that keeps what is sound and invents nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators.events import folded

# What a heading must look like from end to end, coarse ones first, and fields that speak of the document.
HEADINGS = {
    "ANNEX": r"(?iuU)^\s*phụ\s+lục\s+\d+(?:\s*(?:[-–—:]\s*.*)?)?\s*$",
    "SECTION": r"(?iuU)^\s*(?:phần|chương|mục)\s+\d+(?:\s*[.:–—-].*)?\s*$",
    "ARTICLE": r"(?iuU)^\s*(?:điều|article)\s+[\d.]+(?:\s*[.:–—-].*)?\s*$",
    "SUBCLAUSE": r"(?iuU)^\s*(?:khoản|điểm)\s+\(?[a-z0-9]+\)?(?:\s*[.:–—-].*)?\s*$",
}
OPENINGS = {"ANNEX": r"^(?:phụ\s+lục|phu\s+luc)\s+\d+", "SECTION": r"^(?:phần|chương|mục)\s+\d+", "ARTICLE": r"^(?:điều|article)\s+[\d.]", "SUBCLAUSE": r"^(?:khoản|điểm)\s+"}
DOCUMENT_FIELDS = ("party_a", "party_b", "party_c", "party_y", "mst_party_a", "mst_party_b", "mst_party_c", "mst_party_y", "mst_seller", "mst_buyer")


class _Stack:
    """The open headings of a document, each coarser than the next: (place, level)."""

    def __init__(self):
        self.open: list[tuple[int, int]] = []

    def __call__(self, at: int, level: int | None) -> dict:
        if level is not None:
            while self.open and self.open[-1][1] >= level:
                self.open.pop()
        parent = self.open[-1] if self.open else None
        skipped = level is not None and level > (parent[1] if parent else 0) + 1
        depth = len(self.open) + (level is not None)
        if level is not None:
            self.open.append((at, level))
        return {"parent": parent[0] if parent else None, "depth": depth, "skipped": skipped}


def outline(rows: DataFrame, keys: Sequence[str], order: str, level: str) -> DataFrame:
    """rows with parent, depth and skipped: the nearest earlier coarser heading, the depth below the top, and whether the stated level leaves one out.

    level counts from 1, the coarsest; null is content, which belongs to the open heading and has its depth. A repeated
    level makes a sibling; a skipped one hangs on the nearest coarser heading, one step deeper, and doesn't shift what
    follows. Spark deals and sorts the rows; a task keeps the open path of one document, whatever its length.
    """
    kind = T._parse_datatype_string("parent long, depth int, skipped boolean")
    placed = folded(rows.withColumns({order: F.col(order).cast("long"), level: F.col(level).cast("int")}), keys, [order], [order, level], "_o", kind, _Stack)
    return placed.select(*rows.columns, "_o.parent", "_o.depth", "_o.skipped")


def heading_of(label: Column) -> Column:
    """The level of a label that is a heading from end to end; null for one that only begins like it, such as a sentence about an annex."""
    out = F
    for name, pattern in HEADINGS.items():
        out = out.when(label.rlike(pattern), name)
    return out.otherwise(None)


def level_of(label: Column, kind: Column) -> Column:
    """The level by the label's first words, then TABLE or FIELD by type, else BLOCK."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F
    for name, pattern in OPENINGS.items():
        out = out.when(t.rlike("(?U)" + pattern), name)
    return out.when(kind.isin("TABLE", "FIELD"), kind).otherwise("BLOCK")


class _Repair:
    """The open section and clause of one file, and the scopes of the nodes seen."""

    def __init__(self):
        self.section = self.clause = None
        self.started = False
        self.scopes: dict[str, str] = {}

    def __call__(self, node: str, kind: str, role: str, given: str | None, keep: bool, sound: bool, single: bool, root: str, document: bool) -> dict:
        if not self.started:
            self.started = True
            self.scopes[root] = root
            self.section = root if single else None
        if role == "root":
            self.section = node if single else self.section
            parent, scope = None, node
        elif role == "heading":
            parent, scope = (root if single or not sound else given), node
            self.section, self.clause = node, None
        elif role == "false":
            parent = self.clause or self.section or root
            scope = self.scopes.get(parent, parent)
        elif kind == "CLAUSE":
            parent = self.section or root
            scope = self.scopes.get(parent, parent)
            self.clause = node
        else:
            parent = given if keep else (self.section or root) if document else (self.clause or self.section or root)
            scope = self.scopes.get(parent, parent)
        self.scopes[node] = scope
        return {"parent": parent, "scope": scope}


def repaired(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, node_id, type, level, parent_id, scope_id, changed, synthetic, issue): a conservative tree of each file's nodes.

    nodes: file, node_id, type, label, parent_id, page, ord and structured_key, in reading order by page and ord; files:
    file and role. A file without a root (a SECTION without parent) gets one that is no evidence. With one root, sections
    hang on it, clauses on the open section, other nodes on the open clause; a section whose label is no heading is
    content (AMBIGUOUS_HEADING_AS_BLOCK); a sound parent that is no root is kept; fields of the parties belong to the
    section. With several roots only what lacks a sound parent is moved. Ids are unique within a file.
    """
    n = nodes.select("file", "node_id", "type", "label", "parent_id", "page", "ord", "structured_key")
    is_root = (F.col("type") == "SECTION") & F.col("parent_id").isNull()
    heading = heading_of(F.col("label"))
    n = n.withColumn("_role", F.when(is_root, "root").when((F.col("type") == "SECTION") & heading.isNotNull(), "heading").when(F.col("type") == "SECTION", "false").otherwise("other"))
    n = n.withColumn("_at", F.struct(F.coalesce("page", F.lit(1_000_000_000)).alias("p"), F.coalesce("ord", F.lit(0)).alias("o"), F.col("node_id").alias("i")))
    roots = n.groupBy("file").agg(F.count_if(F.col("_role") == "root").alias("_roots"), F.min_by("node_id", F.when(F.col("_role") == "root", F.col("_at"))).alias("_first"), F.coalesce(F.min("page"), F.lit(1)).alias("_page"))
    roots = roots.withColumn("_root", F.coalesce("_first", F.concat(F.lit("root:"), F.coalesce(F.col("file").cast("string"), F.lit("document")))))
    parents = n.select("file", F.col("node_id").alias("parent_id"), F.col("_role").alias("_parent_role"))
    n = n.join(roots.drop("_page"), "file").join(parents, ["file", "parent_id"], "left")
    keep = F.coalesce(F.col("_parent_role") != "root", F.lit(False))
    sound = F.coalesce(F.col("_parent_role").isin("root", "heading"), F.lit(False))
    document = (F.col("type") == "FIELD") & F.coalesce(F.replace(F.lower("structured_key"), F.lit("-"), F.lit("_")).isin(*DOCUMENT_FIELDS), F.lit(False))
    n = n.withColumns({"_keep": keep, "_sound": sound, "_single": F.col("_roots") <= 1, "_document": document})
    n = n.withColumns({"_p": F.col("_at.p").cast("long"), "_o": F.col("_at.o").cast("long")})
    kind = T._parse_datatype_string("parent string, scope string")
    done = folded(n.drop("_at"), ["file"], ["_p", "_o", "node_id"], ["node_id", "type", "_role", "parent_id", "_keep", "_sound", "_single", "_root", "_document"], "_r", kind, _Repair)
    level = F.when(F.col("_role") == "root", "DOCUMENT").when(F.col("_role") == "false", "BLOCK").otherwise(level_of(F.col("label"), F.col("type")))
    level = F.when((F.col("type") == "CLAUSE") & (level == "BLOCK"), "ARTICLE").otherwise(level)
    false = F.col("_role") == "false"
    out = done.select(
        "file", "node_id", F.when(false, "UNNUMBERED_BLOCK").otherwise(F.col("type")).alias("type"), level.alias("level"), F.col("_r.parent").alias("parent_id"), F.col("_r.scope").alias("scope_id"),
        (false | ~F.col("_r.parent").eqNullSafe(F.col("parent_id"))).alias("changed"), F.lit(False).alias("synthetic"), F.when(false, "AMBIGUOUS_HEADING_AS_BLOCK").alias("issue"),
    )
    made = roots.where("_first IS NULL")
    if files is not None:
        made = made.join(files.select("file", "role"), "file", "left")
    synthetic = made.select("file", F.col("_root").alias("node_id"), F.lit("SECTION").alias("type"), F.lit("DOCUMENT").alias("level"), F.lit(None).cast("string").alias("parent_id"), F.col("_root").alias("scope_id"), F.lit(True).alias("changed"), F.lit(True).alias("synthetic"), F.lit("STRUCTURE_ROOT_DERIVED").alias("issue"))
    return out.unionByName(synthetic)
