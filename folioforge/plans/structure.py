"""Reconstruction of documents: page breaks, segments, trees of clauses, tables over pages, outlines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import context as CX
from folioforge.operators import frames as FR
from folioforge.operators import reconstruct as R
from folioforge.operators import structure as S
from folioforge.plans.catalog import query, read
from folioforge.plans.scalars import fold_sql

#: What stands before a block of a cut document, by (place + doc_id) % 9.
_MARKS = {0: "Điều {n}. ", 2: "(a) ", 3: "(b) ", 5: "4.2 ", 6: "i) ", 7: "j) "}


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the documents cut into pages, some with a number before them."""
    b = R.paged(read(spark, sf, "documents"))
    at = F.col("page") * 3 + F.col("block_no")
    phase, n = (at + F.col("doc")) % 9, F.floor(at / 9).cast("string")
    mark = F.lit("")
    for k, m in _MARKS.items():
        mark = F.when(phase == k, F.replace(F.lit(m), F.lit("{n}"), n)).otherwise(mark)
    return b.withColumn("text", F.concat(mark, "text"))


def _case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


_BLOCKS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(0, ceil(len(w) / 20.0)::BIGINT)) AS pos FROM words WHERE len(w) > 0
), blocks AS (
  SELECT doc_id, pos, pos // 3 AS page, pos % 3 AS no, {mark} || array_to_string(w[pos * 20 + 1 : pos * 20 + 20], ' ') AS t FROM places
), tokens AS (
  SELECT *, regexp_extract(t, '^(?:Điều|ĐIỀU|Article|ARTICLE|Section|SECTION)\s+([0-9]+)(?:[^\p{L}\p{N}_]|$)', 1) AS sec,
    regexp_extract(t, '^(?:Khoản|KHOẢN)\s+([0-9]+)(?:[^\p{L}\p{N}_]|$)', 1) AS kho, lower(regexp_extract(t, '^\(([A-Za-z]+)\)(?:[\s.,;:)]|$)', 1)) AS par,
    regexp_extract(t, '^([0-9]+(?:\.[0-9]+)+)(?:[\s.]|$)', 1) AS dec, regexp_extract(t, '^([0-9]+)\.(?:\s|$)', 1) AS one,
    regexp_extract(t, '^([0-9]+)\)(?:\s|$)', 1) AS num, lower(regexp_extract(t, '^([A-Za-z])\)(?:\s|$)', 1)) AS let FROM blocks
), marked AS (
  SELECT doc_id, pos, page, no, t, CASE WHEN sec <> '' THEN 'section' WHEN kho <> '' THEN 'clause' WHEN par IN ('i', 'v', 'x') OR (length(par) > 1 AND regexp_full_match(par, 'x{0,3}(ix|iv|v?i{0,3})')) THEN 'roman'
      WHEN par <> '' THEN 'letter' WHEN dec <> '' OR one <> '' THEN 'clause' WHEN num <> '' THEN 'number' WHEN let <> '' THEN 'letter' END AS kind,
    CASE WHEN sec <> '' THEN sec WHEN kho <> '' THEN kho WHEN par <> '' THEN par WHEN dec <> '' THEN dec WHEN one <> '' THEN one WHEN num <> '' THEN num WHEN let <> '' THEN let END AS value FROM tokens
), ranked AS (
  SELECT *, CASE WHEN kind = 'roman' THEN nullif(list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii', 'xiii', 'xiv', 'xv', 'xvi', 'xvii', 'xviii', 'xix', 'xx'], value), 0)
      WHEN kind = 'number' THEN try_cast(value AS HUGEINT) WHEN kind = 'letter' AND length(value) = 1 THEN ascii(value) END AS place,
    last_value(CASE WHEN kind = 'section' THEN value END IGNORE NULLS) OVER w AS section,
    nullif(last_value(CASE WHEN kind = 'section' THEN '' WHEN kind = 'clause' THEN value END IGNORE NULLS) OVER w, '') AS clause
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), pairs AS (
  SELECT doc_id, pos, page, no, t, kind, value, place, lag(t) OVER w AS pt, lag(kind) OVER w AS pkind, lag(place) OVER w AS pplace, lag(section) OVER w AS section, lag(clause) OVER w AS clause
  FROM ranked WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), signals AS (
  SELECT *, coalesce(clause, section) AS parent, coalesce(kind = pkind AND kind IN ('roman', 'number', 'letter') AND place = pplace + 1, false) AS next_item,
    NOT regexp_matches(pt, '((\.\s*){3,}|…\s*)$') AND regexp_matches(pt, '[.!?:;]["''”’)\]]*$') AS ended, regexp_matches(t, '^\p{Lu}') AS opens,
    coalesce(pkind IS NOT NULL OR clause IS NOT NULL, false) AS scoped
  FROM pairs WHERE no = 0 AND page > 0
), decided AS (
  SELECT *, CASE WHEN next_item THEN 'CONTINUE_LIST' WHEN kind = 'section' THEN 'NEW_SECTION' WHEN kind = 'clause' THEN 'NEW_CLAUSE' WHEN kind IS NOT NULL THEN 'ATTACH_CHILD'
      WHEN NOT ended AND NOT opens THEN 'MERGE_BLOCKS' WHEN ended AND opens THEN 'NEW_PARAGRAPH' ELSE 'NEEDS_REVIEW' END AS action FROM signals
)
""".replace("{mark}", _case([(f"(pos + doc_id) % 9 = {k}", f"replace('{m}', '{{n}}', (pos // 9)::VARCHAR)") for k, m in _MARKS.items()], "''"))


@query(
    _BLOCKS
    + """SELECT doc_id, page - 1 AS previous_page, action, CASE action WHEN 'CONTINUE_LIST' THEN 'LIST_CONTINUE' WHEN 'ATTACH_CHILD' THEN 'NEW_CLAUSE' WHEN 'NEEDS_REVIEW' THEN 'UNKNOWN' WHEN 'MERGE_BLOCKS' THEN CASE WHEN scoped THEN 'CONTINUE_CLAUSE' ELSE 'CONTINUE_PARAGRAPH' END ELSE action END AS relationship,
  CASE action WHEN 'CONTINUE_LIST' THEN 'LIST_ITEM' WHEN 'ATTACH_CHILD' THEN 'LIST_ITEM' WHEN 'NEW_SECTION' THEN 'SECTION' WHEN 'NEW_CLAUSE' THEN 'CLAUSE' WHEN 'NEW_PARAGRAPH' THEN 'PARAGRAPH' WHEN 'MERGE_BLOCKS' THEN CASE WHEN scoped THEN 'CLAUSE' ELSE 'PARAGRAPH' END END AS entity_type,
  CASE WHEN action IN ('CONTINUE_LIST', 'ATTACH_CHILD') THEN concat_ws('.', parent, value) WHEN action IN ('NEW_SECTION', 'NEW_CLAUSE') THEN value WHEN action = 'MERGE_BLOCKS' THEN CASE WHEN scoped THEN clause ELSE section END END AS node_id,
  CASE WHEN action IN ('CONTINUE_LIST', 'ATTACH_CHILD') THEN parent WHEN action = 'NEW_CLAUSE' OR (action = 'MERGE_BLOCKS' AND scoped) THEN section END AS parent_id FROM decided"""
)
def page_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolved_pages(_numbered(spark, sf))[1].select(F.col("doc").alias("doc_id"), "previous_page", "action", "relationship", "entity_type", "node_id", "parent_id")


@query(
    _BLOCKS
    + r""", joined AS (
  SELECT b.doc_id, b.pos, b.page, b.t, coalesce(d.action = 'MERGE_BLOCKS', false) AS glued FROM blocks b LEFT JOIN decided d ON b.doc_id = d.doc_id AND b.pos = d.pos
), cut AS (
  SELECT *, glued AND regexp_matches(lag(t) OVER w, '\S+\s*[-‐\x{00AD}]$') AND length(regexp_extract(lag(t) OVER w, '(\S+)\s*[-‐\x{00AD}]$', 1)) >= 2 AND regexp_matches(regexp_extract(lag(t) OVER w, '(\S+)\s*[-‐\x{00AD}]$', 1), '\p{L}') AND regexp_matches(t, '^\p{Ll}') AS hyphen
  FROM joined WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  SELECT *, sum((NOT glued)::INT) OVER w AS segment_no, coalesce(lead(hyphen) OVER w, false) AS loses FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
)
SELECT doc_id, segment_no::BIGINT AS segment_no, min(page) AS page_start, max(page) AS page_end, count(*) > 1 AS was_merged,
  md5(string_agg(CASE WHEN glued AND NOT hyphen THEN ' ' ELSE '' END || CASE WHEN loses THEN left(t, length(t) - 1) ELSE t END, '' ORDER BY pos)) AS text FROM numbered GROUP BY 1, 2"""
)
def reconstructed_segments(spark: SparkSession, sf: str) -> DataFrame:
    got = R.segments(*R.resolved_pages(_numbered(spark, sf)))
    return got.select(F.col("doc").alias("doc_id"), "segment_no", "page_start", "page_end", "was_merged", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def reconstructed_clauses(spark: SparkSession, sf: str) -> DataFrame:
    got = R.clauses(R.segments(*R.resolved_pages(_numbered(spark, sf))))
    return got.select(F.col("doc").alias("doc_id"), "node", "parent", "clause_id", "level", "marker", "title", "page_start", "page_end", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def reconstructed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of each customer as a table cut into pages of two rows, each with its header; some rows lack a cell."""
    from pyspark.sql import Window as W

    o = read(spark, sf, "orders").withColumn("at", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    cell = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), cell, F.lit(" | "), F.col("o_orderstatus"), F.lit(" |"))
    rows = o.select(F.col("o_custkey").alias("doc"), F.floor(F.col("at") / 2).alias("page"), (F.col("at") % 2 + 1).alias("block_no"), row.alias("text"))
    heads = rows.select("doc", "page").distinct().withColumns({"block_no": F.lit(0).cast("long"), "text": F.lit("| order | date | status |")})
    none = {c: F.lit(None).cast(k) for c, k in (("y0", "double"), ("y1", "double"), ("page_height", "double"), ("font_size", "double"), ("bold", "boolean"))}
    blocks = rows.unionByName(heads).withColumn("block_no", F.col("block_no").cast("long")).withColumn("type", F.lit("table_row")).withColumns(none)
    return R.table_rows(*R.resolved_pages(blocks)).select(F.col("doc").alias("o_custkey"), "table_no", "row_no", "values", "pages", "page_start", "page_end")


# ---- outlines ---------------------------------------------------------------------------------------------------------

_LEVEL = "CASE WHEN coalesce(length(text), 0) % 5 = 0 THEN NULL ELSE coalesce(length(text), 0) % 4 + 1 END"


@query(
    f"""WITH RECURSIVE r AS (SELECT conv_id, turn, ({_LEVEL})::INT AS level FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.level, max(b.turn) AS parent FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level IS NOT NULL AND (a.level IS NULL OR b.level < a.level) GROUP BY 1, 2, 3),
d AS (SELECT conv_id, turn, level, parent, (level IS NOT NULL)::INT AS depth FROM p WHERE parent IS NULL
  UNION ALL SELECT p.conv_id, p.turn, p.level, p.parent, d.depth + (p.level IS NOT NULL)::INT FROM p JOIN d ON p.conv_id = d.conv_id AND p.parent = d.turn)
SELECT d.conv_id, d.turn, d.parent, d.depth::INT AS depth, coalesce(d.level > coalesce(u.level, 0) + 1, false) AS skipped FROM d LEFT JOIN r u ON u.conv_id = d.conv_id AND u.turn = d.parent"""
)
def conversation_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as headings whose level their length gives; some are content."""
    rows = read(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_LEVEL} AS level")
    return S.outline(rows, ["conv_id"], "turn", "level").select("conv_id", F.col("turn").cast("int").alias("turn"), F.col("parent").cast("int").alias("parent"), "depth", "skipped")


#: What a node of a cut document is labelled, by a hash of its place.
LABELS = ["Điều 1. Giá", "Phụ lục 2 - Bảng giá", "Phụ lục 2 quy định giá", "Chương 3", "Khoản a", "Bên A", "Bảng", "Mục 4: Phạt"]


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of conversations as nodes of files: types, labels and parents follow from place and text; some files have no root, some several."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    pick = F.pmod(F.col("n") * 7 + F.col("turn") * 3 + F.col("conv_id"), F.lit(11)).cast("int")
    kind = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 > 0), "SECTION").when(pick < 4, "SECTION").when(pick < 6, "CLAUSE").when(pick == 6, "TABLE").when(pick < 9, "FIELD").otherwise("BLOCK")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.pmod(F.col("n") + F.col("turn"), F.lit(len(LABELS))).cast("int") + 1)
    parent = F.when((F.col("turn") == 0) | (F.col("conv_id") % 9 == 8) & (pick == 3), None).otherwise(F.concat(F.lit("n"), F.floor(F.col("n") * F.col("turn") / 50) % (F.col("turn") + 2)))
    return c.select(F.col("conv_id").alias("file"), F.concat(F.lit("n"), "turn").alias("node_id"), kind.alias("type"), label.alias("label"), parent.alias("parent_id"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("ord"), F.when(F.col("n") % 2 == 0, "party_a").otherwise("price").alias("structured_key"))


@query()
def repaired_structure(spark: SparkSession, sf: str) -> DataFrame:
    return S.repaired(_nodes(spark, sf))


# ---- frames -----------------------------------------------------------------------------------------------------------

_WHO, _MODE, _DOES = ["Bên A", "Bên B", "Hai bên"], [" phải ", " không được ", " được phép ", " "], ["thanh toán", "giao hàng", "bồi thường", "thông báo", "chấm dứt", "tiết lộ"]
_PICK = lambda xs, n: "[" + ", ".join(f"'{x}'" for x in xs) + f"][doc_id % {n} + 1]"


@query(
    f"""WITH d AS (SELECT doc_id, text, n_chars, {_PICK(["A", "B", "BOTH"], 3)} AS who, {_PICK(["REQUIRED", "PROHIBITED", "PERMITTED", "REQUIRED"], 4)} AS mode, {_PICK(["PAY", "DELIVER", "COMPENSATE", "NOTIFY", "TERMINATE", "DISCLOSE"], 6)} AS does FROM documents)
SELECT doc_id, CASE mode WHEN 'PROHIBITED' THEN 'PROHIBITION' WHEN 'PERMITTED' THEN 'RIGHT' ELSE CASE WHEN does = 'COMPENSATE' THEN 'REMEDY' ELSE 'OBLIGATION' END END AS family, who AS actor, mode AS modality, does AS action,
  CASE WHEN does IN ('PAY', 'DELIVER', 'COMPENSATE') THEN 'phần này' END AS object_scope, n_chars::VARCHAR AS amount, 'VND' AS currency, (doc_id % 50 + 1)::VARCHAR AS deadline, CASE WHEN doc_id % 2 = 0 THEN 'day' ELSE 'month' END AS deadline_unit,
  CASE WHEN doc_id % 5 = 0 THEN 'bên kia chậm' END AS condition, (1 + len([x FOR x IN string_split(coalesce(text, ''), ';') IF trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '']))::BIGINT AS n_frames FROM d"""
)
def clause_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A clause of a planted grammar before each whole text, and the frames of both."""
    d = read(spark, sf, "documents")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs)).cast("int") + 1)
    clause = F.concat(pick(_WHO), pick(_MODE), pick(_DOES), F.lit(" phần này "), F.col("n_chars").cast("string"), F.lit(" VND trong vòng "), (F.col("doc_id") % 50 + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, " ngày").otherwise(" tháng"), F.when(F.col("doc_id") % 5 == 0, " nếu bên kia chậm").otherwise(""))
    frames = FR.extract_frames(d.select("doc_id", F.concat(clause, F.lit(";"), F.coalesce("text", F.lit(""))).alias("text")), ["doc_id"], {})
    value = lambda s: F.max(F.when(F.col("at") == 0, F.col("slots")[s]["value"]))
    names = {"actor": "actor", "modality_negation": "modality", "action": "action", "object_scope": "object_scope", "amount": "amount", "currency": "currency", "deadline": "deadline", "deadline_unit": "deadline_unit", "condition": "condition"}
    return frames.groupBy("doc_id").agg(F.max(F.when(F.col("at") == 0, F.col("family"))).alias("family"), *[value(k).alias(v) for k, v in names.items()], F.count("*").alias("n_frames"))


_SWEEP = """WITH p AS (SELECT l_suppkey, l_shipdate::DATE AS s, (l_shipdate::DATE + l_linenumber::INT)::DATE AS e FROM lineitem),
t AS (SELECT l_suppkey, s AS day FROM p UNION SELECT l_suppkey, e FROM p),
c AS (SELECT t.l_suppkey, t.day, (SELECT count(*) FROM p WHERE p.l_suppkey = t.l_suppkey AND p.s <= t.day AND t.day < p.e) AS n FROM t),
k AS (SELECT * FROM c QUALIFY n IS DISTINCT FROM lag(n) OVER (PARTITION BY l_suppkey ORDER BY day)),
o AS (SELECT l_suppkey, day AS "from", lead(day) OVER (PARTITION BY l_suppkey ORDER BY day) AS "to", n FROM k)
"""


def _shipping(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("s"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int")).alias("e"))


@query(_SWEEP + """SELECT l_suppkey, "from", "to", n FROM o WHERE "to" IS NOT NULL""")
def periods_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """How many line items of each supplier are under way, by stretches of time."""
    return FR.coverage(_shipping(spark, sf), ["l_suppkey"], "s", "e")


@query(_SWEEP + """SELECT l_suppkey, "from", "to" FROM o WHERE "to" IS NOT NULL AND n = 0""")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return FR.gaps(_shipping(spark, sf), ["l_suppkey"], "s", "e")


# ---- context ----------------------------------------------------------------------------------------------------------

#: What is planted before a document's text, in Spark's and DuckDB's SQL alike.
_PLANTED = r"""(CASE WHEN doc_id % 7 = 0 THEN concat('PHỤ LỤC 0', doc_id % 5 + 1, chr(10)) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN concat('theo phụ lục ', doc_id % 9 + 1, '. ') ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN 'hợp đồng kèm theo. ' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN concat('sửa đổi Điều ', doc_id % 6 + 1, ' ngày 1/2/2024. ') ELSE '' END || coalesce(text, ''))"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Each source as a contract of one file whose pages are its documents."""
    d = read(spark, sf, "documents").where("source IS NOT NULL").selectExpr("source AS dossier", "source AS file", "doc_id AS page", "doc_id AS ord", "CAST(doc_id AS string) AS node_id", f"{_PLANTED} AS text")
    files = d.select("dossier", "file").distinct().withColumn("role", F.lit("body"))
    return CX.placed(d, d.select("dossier", "file", "page", "text"), files)


_CONTEXT = rf"""WITH d AS (SELECT source AS dossier, doc_id, {_PLANTED} AS t FROM documents WHERE source IS NOT NULL),
m AS (SELECT *, {fold_sql('t')} AS f, regexp_extract({fold_sql('(string_split(t, chr(10))[1])')}, '^phu luc (?:so ?)?([0-9]+)(?:[^a-z0-9_]|$)', 1) AS mark FROM d),
o AS (SELECT *, CASE WHEN mark <> '' AND row_number() OVER (PARTITION BY dossier, mark ORDER BY doc_id) = 1 THEN mark END AS opens FROM m),
p AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY dossier ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS annex FROM o),
"""


@query(_CONTEXT + """x AS (SELECT 1) SELECT dossier, coalesce('annex:' || annex, 'body') AS part, CASE WHEN annex IS NULL THEN 'BODY' ELSE 'ANNEX' END AS kind, annex, count(*) AS n_nodes, min(doc_id) AS first_page, max(doc_id) AS last_page FROM p GROUP BY dossier, annex""")
def contract_parts(spark: SparkSession, sf: str) -> DataFrame:
    return CX.parts(_placed(spark, sf))


@query(
    _CONTEXT
    + r"""said AS (SELECT DISTINCT dossier, doc_id, unnest(regexp_extract_all(f, '(?:^|[^a-z0-9_])phu luc (?:so ?)?([0-9]+)', 1)) AS raw FROM p WHERE annex IS NULL),
named AS (SELECT dossier, ltrim(raw, '0') AS k, list(DISTINCT doc_id ORDER BY doc_id) AS ids FROM said GROUP BY 1, 2),
own AS (SELECT dossier, annex, min(doc_id) AS first, list(doc_id ORDER BY doc_id) AS ids, coalesce(list(doc_id ORDER BY doc_id) FILTER (contains(f, 'hop dong') AND (contains(f, 'kem theo') OR contains(f, 'so '))), []) AS tied,
  bool_or(regexp_matches(f, '(?:^|[^a-z0-9_])(?:sua doi|thay the|dieu chinh|bo sung|cap nhat|amend)(?:[^a-z0-9_]|$)')) AS changes,
  list_sort(list_distinct(flatten(list(regexp_extract_all(f, '(?:^|[^a-z0-9_])dieu ([0-9]+(?:\.[0-9]+)?)', 1))))) AS clauses FROM p WHERE annex IS NOT NULL GROUP BY 1, 2),
met AS (SELECT own.*, list_concat(coalesce(named.ids, []), tied) AS refs FROM own LEFT JOIN named ON own.dossier = named.dossier AND ltrim(own.annex, '0') = named.k)
SELECT dossier, CASE WHEN len(refs) > 0 THEN 'PART_LINK' ELSE 'CONTEXT_GAP' END AS kind, 'annex:' || annex AS subject, CASE WHEN len(refs) > 0 THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS state, CASE WHEN len(refs) > 0 THEN 'REFERENCES' END AS relation, array_to_string(CASE WHEN len(refs) > 0 THEN refs ELSE [first] END, ',') AS nodes, '' AS clauses FROM met
UNION ALL SELECT dossier, 'AMENDMENT_SIGNAL', 'annex:' || annex, 'NEEDS_REVIEW', 'AMENDS', array_to_string(ids, ','), array_to_string(clauses, ',') FROM own WHERE changes
UNION ALL SELECT dossier, 'CONTEXT_GAP', 'annex:' || raw, 'NEEDS_REVIEW', NULL, min(doc_id)::VARCHAR, '' FROM said WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.dossier = said.dossier AND ltrim(own.annex, '0') = ltrim(said.raw, '0')) GROUP BY dossier, raw"""
)
def contract_context(spark: SparkSession, sf: str) -> DataFrame:
    return CX.findings(_placed(spark, sf)).select("dossier", "kind", "subject", "state", "relation", F.array_join("nodes", ",").alias("nodes"), F.array_join("details.clauses", ",").alias("clauses"))
