"""Number columns. The parsers differ on purpose in what `1.234` and `1,234` are; see their docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import fold, skeleton

EXACT = "decimal(38,6)"


def _try(c: Column, kind: str = EXACT) -> Column:
    return c.try_cast(kind)


def _no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s ]", "")


def money_decimal(value: Column, unit: Column | None = None) -> Column:
    """Percent by its point or comma; anything else is its digits alone: `1.234`, `1,234` and `-1234` are all 1234. Null without digits."""
    percent = value.contains("%") if unit is None else value.contains("%") | F.coalesce(unit == "percent", F.lit(False))
    share = F.replace(F.replace(_no_space(value), F.lit(","), F.lit(".")), F.lit("%"), F.lit(""))
    return F.when(percent, _try(share)).otherwise(_try(F.nullif(F.regexp_replace(value, "[^0-9]", ""), F.lit(""))))


def parse_amount(raw: Column) -> Column:
    """Two groups after points, or one after commas, are thousands; `1.234` could be either and is null; `1,234` is 1234."""
    t = F.replace(F.trim(raw), F.lit(" "), F.lit(""))
    return (
        F.when(t.rlike(r"^-?\d{1,3}(\.\d{3}){2,}$"), _try(F.replace(t, F.lit("."), F.lit(""))))
        .when(t.rlike(r"^-?\d{1,3}(,\d{3})+$"), _try(F.replace(t, F.lit(","), F.lit(""))))
        .when(t.rlike(r"^-?\d+\.\d{3}$"), F.lit(None).cast(EXACT))
        .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), _try(t))
    )


def boq_decimal(value: Column, limit: int = 64) -> Column:
    """A table cell without its currency; one separator before three digits (`1.234`, `1,234`) is null, with both the last is decimal."""
    t = F.regexp_replace(F.replace(F.trim(value), F.lit(" "), F.lit("")), "₫|đ|VND|USD", "")
    drop = lambda c, s: F.replace(c, F.lit(s), F.lit(""))
    point = F.length(t) - F.locate(".", F.reverse(t)) > F.length(t) - F.locate(",", F.reverse(t))
    return (
        F.when(~t.rlike(r"^[+-]?\d+([.,]\d+)*$") | (F.char_length(t) > limit) | t.rlike(r"^[+-]?\d{1,3}[.,]\d{3}$"), F.lit(None).cast(EXACT))
        .when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+$"), _try(drop(t, ".")))
        .when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+$"), _try(drop(t, ",")))
        .when(t.contains(".") & t.contains(","), F.when(point, _try(drop(t, ","))).otherwise(_try(F.replace(drop(t, "."), F.lit(","), F.lit(".")))))
        .otherwise(_try(F.replace(t, F.lit(","), F.lit("."))))
    )


def percent(value: Column) -> Column:
    return _try(F.replace(F.replace(_no_space(value), F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))


def parse_vn_number(text: Column) -> Column:
    """Points group, a comma is decimal: `1.234` is 1234, `1,234` is 1.234. Null for what is no such number."""
    t = _no_space(F.regexp_replace(F.trim(text), r"(?iu)\s*(đồng|vnđ|vnd|đ)\s*$", ""))
    ok = t.rlike(r"^-?(\d{1,3}(\.\d{3})*(,\d+)?|\d+(,\d+)?)$")
    return F.when(ok, _try(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))


# Vietnamese number words.
DIGIT_WORDS = {"không": 0, "một": 1, "mốt": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9}
SCALE_WORDS = {"nghìn": 1_000, "ngàn": 1_000, "triệu": 1_000_000, "tỷ": 1_000_000_000}
SILENT_WORDS = ("đồng", "chẵn", "chẳn")


def vn_words_to_number(text: Column) -> Column:
    """Number words as a number, by one fold over the words.

    The state is the total, the open group of up to three places, its open digit (-1 for none), the lowest place that is
    filled (3 for none, 2 hundreds, 1 tens), the last scale, and whether a zero word waits for its digit. Places fall
    within a group, and scales from group to group. Null for what is no such number: an unknown word, two digits in a row,
    a place or scale that doesn't fall or has no digit before it, a zero word without its digit.
    """
    words = F.filter(F.split(F.lower(F.trim(text)), r"[\s,]+"), lambda w: (w != "") & ~w.isin(*SILENT_WORDS))
    digit = F.create_map(*[F.lit(x) for k, v in DIGIT_WORDS.items() for x in (k, v)])
    scale = F.create_map(*[F.lit(x) for k, v in SCALE_WORDS.items() for x in (k, v)])
    names = {"total": "decimal(38,0)", "group": "long", "open": "long", "place": "int", "scale": "long", "waits": "boolean", "ok": "boolean"}

    def state(s: Column | None, **now) -> Column:
        value = lambda k: now[k] if k in now else s[k]
        return F.struct(*[(value(k) if isinstance(value(k), Column) else F.lit(value(k))).cast(t).alias(k) for k, t in names.items()])

    def step(s: Column, w: Column) -> Column:
        has = s["open"] >= 0
        group = s["group"] + F.greatest(s["open"], F.lit(0))
        big = scale[w]
        return (
            F.when(big.isNotNull(), state(s, total=s["total"] + group * big, group=0, open=-1, place=3, scale=big, ok=s["ok"] & (has | (s["group"] > 0)) & ~s["waits"] & (big < s["scale"])))
            .when(w == "trăm", state(s, group=s["open"] * 100, open=-1, place=2, ok=s["ok"] & has & (s["place"] == 3)))
            .when(w == "mươi", state(s, group=s["group"] + s["open"] * 10, open=-1, place=1, ok=s["ok"] & has & (s["place"] > 1)))
            .when(w == "mười", state(s, group=s["group"] + 10, place=1, ok=s["ok"] & ~has & (s["place"] > 1)))
            .when(w.isin("linh", "lẻ"), state(s, place=1, waits=True, ok=s["ok"] & ~has & (s["place"] > 1)))
            .when(digit[w].isNotNull(), state(s, open=digit[w], waits=False, ok=s["ok"] & ~has))
            .otherwise(state(s, ok=False))
        )

    begin = state(None, total=0, group=0, open=-1, place=3, scale=10**18, waits=False, ok=True)
    end = F.aggregate(words, begin, step, lambda s: F.when(s["ok"] & ~s["waits"], s["total"] + s["group"] + F.greatest(s["open"], F.lit(0))))
    return F.when(F.size(words) > 0, end)


def normalize_typed(kind: Column, value: Column) -> Column:
    """DATE as ISO, MONEY, QUANTITY and PERCENTAGE as a plain decimal (points group where threes follow, a comma is decimal), TAX_CODE without spaces and hyphens, else folded case."""
    v = F.trim(value)
    iso = F.coalesce(*[F.try_to_date(v, f) for f in ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy")]).cast("string")
    n = F.regexp_replace(v, r"[^0-9,.-]", "")
    n = F.when(n.contains(","), F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(n.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(n, F.lit("."), F.lit(""))).otherwise(n)
    plain = lambda d: F.when(d.contains("."), F.regexp_replace(F.regexp_replace(d, "0+$", ""), r"\.$", "")).otherwise(d)
    return (
        F.when(kind == "DATE", F.coalesce(iso, v))
        .when(kind.isin("MONEY", "QUANTITY", "PERCENTAGE"), F.coalesce(plain(_try(n).cast("string")), n))
        .when(kind == "TAX_CODE", F.regexp_replace(v, r"[\s-]", ""))
        .otherwise(F.regexp_replace(F.lower(v), r"\s+", " "))
    )


def canonical_number(raw: Column) -> Column:
    """The evaluation's reading: a single group of three after either separator is thousands, `1.234` and `1,234` are both 1234; null if unreadable."""
    t = _no_space(raw)
    both = t.contains(".") & t.contains(",")
    point = F.locate(".", F.reverse(t)) < F.locate(",", F.reverse(t))
    fixed = (
        F.when(both & point, F.replace(t, F.lit(","), F.lit("")))
        .when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(t.rlike(r"^[+-]?\d+([.,]\d{3})+$"), F.regexp_replace(t, "[.,]", ""))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )
    plain = _try(fixed).cast("string")
    return F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)


def normalize_visible(value: Column) -> Column:
    """Dates as `date:ISO`, contract numbers as they are, a lone number with its unit in one spelling, else the folded text."""
    t = fold(value)
    words, slash = r"^ngay\s+(\d{1,2})\s+thang\s+(\d{1,2})\s+nam\s+(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    date = lambda p: F.concat(F.lit("date:"), F.lpad(F.regexp_extract(t, p, 3), 4, "0"), F.lit("-"), F.lpad(F.regexp_extract(t, p, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(t, p, 1), 2, "0"))
    lone = r"^([+-]?\d[\d., ]*\d|[+-]?\d)\s*(%|vnd|dong|usd|eur)?$"
    n, unit = canonical_number(F.regexp_extract(t, lone, 1)), F.regexp_extract(t, lone, 2)
    return (
        F.when(t.rlike(r"^(so\s+)?\d+/\d{4}/[a-z0-9.-]+$"), F.regexp_replace(t, r"^so\s+", ""))
        .when(t.rlike(words), date(words))
        .when(t.rlike(slash) & F.regexp_extract(t, slash, 1).try_cast("int").between(1, 31) & F.regexp_extract(t, slash, 2).try_cast("int").between(1, 12), date(slash))
        .when(t.rlike(lone) & n.isNotNull(), F.concat(n, F.when(unit == "", "").when(unit == "%", "%").when(unit == "dong", " vnd").otherwise(F.concat(F.lit(" "), unit))))
        .otherwise(t)
    )


# ---- tokens whose misreading changes a contract ------------------------------------------------------------------------

# Patterns over folded text.
MONEY = r"(?<![\d.,])(\d{1,3}(?:[.,]\d{3})+|\d{4,})(?:,\d{1,2})?\s*(?:dong|vnd|d\b|usd)"
GROUPED = r"(?<![\d.,/])(\d{1,3}(?:\.\d{3}){2,})(?![\d.,]*\d)"
PERCENT = r"(?<![\d.,])(\d{1,3}(?:[.,]\d+)?)\s*%"
DATES = (r"(?<!\d)(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})(?!\d)", r"(ngay\s+\d{1,2}\s+thang\s+\d{1,2}\s+nam\s+\d{4})")
CONTRACT_NUMBER = r"(?<![\d/])(\d{1,5}/\d{4}/[a-z0-9-]+)"
LONG_NUMBER = r"(?<![\d.,/-])(\d{9,16}(?:-\d{3})?)(?![\d/]|[.,]\d)"


def critical_tokens(text: Column) -> Column:
    """`kind:value` of money, grouped numbers outside money, percents, dates, contract numbers and long ids, with repeats, by kind."""
    s = skeleton(text)
    found = lambda source, pattern, f: F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), f)
    digits = lambda x: F.regexp_replace(x, "[.,]", "")
    parts = lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))
    date = lambda x: F.concat(F.lit("date:"), F.lpad(F.get(parts(x), F.lit(0)), 2, "0"), F.lit("/"), F.lpad(F.get(parts(x), F.lit(1)), 2, "0"), F.lit("/"), F.get(parts(x), F.lit(2)))
    without_money = F.regexp_replace(s, MONEY, "¤")
    return F.concat(
        found(s, MONEY, lambda x: F.concat(F.lit("money:"), digits(x))),
        found(without_money, GROUPED, lambda x: F.concat(F.lit("number:"), digits(x))),
        found(s, PERCENT, lambda x: F.concat(F.lit("percent:"), F.replace(x, F.lit(","), F.lit(".")))),
        *[found(s, p, date) for p in DATES],
        found(s, CONTRACT_NUMBER, lambda x: F.concat(F.lit("contract:"), x)),
        found(s, LONG_NUMBER, lambda x: F.concat(F.lit("id:"), x)),
    )


def amount_words_mismatch(text: Column) -> Column:
    """Whether the last amount in digits before "(bằng chữ: …)" differs from the words; false where either can't be read or the words are zero."""
    inside = r"(?iu)\(\s*bằng\s*chữ\s*:?\s*([^)]+)\)"
    words = vn_words_to_number(F.regexp_replace(F.regexp_extract(text, inside, 1), r"[\s.]+$", ""))
    before = F.regexp_extract_all(skeleton(F.regexp_replace(text, r"(?isu)\(\s*bằng\s*chữ.*$", "")), F.lit(MONEY), F.lit(1))
    digits = parse_vn_number(F.try_element_at(before, F.lit(-1)))
    return F.coalesce(text.rlike(inside) & (F.size(before) > 0) & (words != 0) & (digits != words), F.lit(False))


def unit_values(text: Column) -> Column:
    """A map from unit word ("" for none) to the sorted distinct numbers before it; clause numbers and addresses are no values."""
    s = F.regexp_replace(F.regexp_replace(fold(text), r"^\s*\d+(?:\.\d+)*\.?\s+", ""), r"\b(?:khoan|diem|dieu|muc|chuong|phu luc)\s+[\w.]+", " ")
    hits = F.regexp_extract_all(s, F.lit(r"((?<!\w)\d+(?:[.,]\d+)*(?!\w)\s*(?:%|[a-z]+)?)"), F.lit(1))
    pairs = F.transform(hits, lambda h: F.struct(F.regexp_extract(h, r"(%|[a-z]+)$", 1).alias("unit"), F.regexp_extract(h, r"^(\d+(?:[.,]\d+)*)", 1).alias("n")))
    units = F.array_distinct(F.transform(pairs, lambda p: p["unit"]))
    return F.map_from_entries(F.transform(units, lambda u: F.struct(u, F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["unit"] == u), lambda p: p["n"]))))))


def values_differ(left: Column, right: Column) -> Column:
    """Whether a unit that both have has different numbers."""
    return F.exists(F.array_intersect(F.map_keys(left), F.map_keys(right)), lambda u: left[u] != right[u])


def quantities(folded: Column) -> Column:
    """`number unit` of each quantity of folded text, dates taken out first."""
    s = F.regexp_replace(folded, r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|ngay \d{1,2} thang \d{1,2} nam \d{4}", " ")
    return F.regexp_extract_all(s, F.lit(r"(\d+(?:[.,]\d+)*\s*(?:%|[a-z]+))"), F.lit(1))
