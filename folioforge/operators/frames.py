"""Frames of clauses: who must, may or must not do what, for how much, by when and if what; and the periods in which terms hold.

Grammar that isn't supported stays visible: a slot that nothing was found for is UNKNOWN, and ABSENT only where the text
rules it out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words of the grammar. Patterns match without regard to case, letters and spaces as in Unicode.
_F = "(?iuU)"
ACTIONS = {"thanh toán": "PAY", "giao hàng": "DELIVER", "bồi thường": "COMPENSATE", "thông báo": "NOTIFY", "chấm dứt": "TERMINATE", "tiết lộ": "DISCLOSE"}
_ACTION = _F + r"\b(" + "|".join(ACTIONS) + r")\b"
_ACCEPT = _F + r"^([\s\S]*?(?:\bbên\s+[ab]|\bhai\s+bên)\s+(?:(?:phải|có\s+nghĩa\s+vụ|sẽ)\s+)?)nghiệm\s+thu\b"
_MONEY = r"(?<![\d.,])(\d[\d.,\s]*\d|\d)\s*(VND|USD|EUR|đồng|đ)\b"
_TOTAL = r"(?:tổng\s+giá\s+trị\s+hợp\s+đồng|tổng\s+cộng|grand\s+total|total)"
_NUMBER = r"(?<![\d.,])(\d[\d.,\s]*\d|\d)(?![\d.,])"
_REFERENCE = r"\b(?:khoản|điểm|điều|mục|chương|phụ\s+lục)\s+[\w.]+"
_DEADLINE = r"\btrong\s+(?:vòng\s+|thời\s+hạn\s+)?(\d+)\s+(ngày\s+làm\s+việc|ngày|tháng|tuần|năm|giờ)\b"
_UNITS = {"ngày": "day", "tháng": "month", "tuần": "week", "năm": "year", "giờ": "hour"}
#: What a text must hold, in any case, for a trigger to stand in it.
_TRIGGER_WORDS = {"SIGNING": ("ký", "signing"), "DELIVERY": ("giao", "delivery"), "ACCEPTANCE": ("nghiệm", "acceptance"), "DOCUMENTS_COMPLETE": ("đủ", "documents"), "INVOICE": ("nhận", "invoice")}
_TRIGGERS = {
    "SIGNING": r"(?:kể\s+từ|sau\s+khi|khi)\s+(?:ngày\s+)?ký|after\s+signing",
    "DELIVERY": r"(?:sau\s+khi|khi)\s+giao\s+hàng|upon\s+delivery",
    "ACCEPTANCE": r"(?:sau\s+khi|khi)\s+nghiệm\s+thu|upon\s+acceptance",
    "DOCUMENTS_COMPLETE": r"(?:sau\s+khi|khi)\s+(?:nhận\s+)?đủ\s+hồ\s+sơ|after\s+complete\s+documents",
    "INVOICE": r"(?:kể\s+từ|sau\s+khi)\s+(?:ngày\s+)?nhận\s+(?:được\s+)?hóa\s+đơn|upon\s+receipt\s+of\s+(?:the\s+)?invoice",
}
_SINCE = r"\bkể\s+từ\s+(?:ngày\s+|khi\s+)?([^.,;:\n]{3,60}?)\s*(?:[.,;:]|$)"
SLOTS = ("action", "actor", "amount", "beneficiary", "condition", "currency", "deadline", "deadline_unit", "definition", "exception", "modality_negation", "object_scope", "parameter", "qualifier", "temporal_trigger", "unit")


def decimal_amount(raw: Column) -> Column:
    """A grouped number as a plain decimal: with both separators the last one is decimal, a lone comma before three digits groups, several points group; null for what is none."""
    t = F.regexp_replace(raw, r"(?U)\s+", "")
    both = t.contains(",") & t.contains(".")
    comma = F.locate(",", F.reverse(t)) < F.locate(".", F.reverse(t))
    drop = lambda c, x: F.replace(c, F.lit(x), F.lit(""))
    lone = F.when(F.char_length(F.element_at(F.split(t, ","), -1)) == 3, drop(t, ",")).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    points = F.char_length(t) - F.char_length(drop(t, "."))
    plain = F.when(both & comma, F.replace(drop(t, "."), F.lit(","), F.lit("."))).when(both, drop(t, ",")).when(t.contains(","), lone).when(points > 1, drop(t, ".")).otherwise(t)
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def _clauses(nodes: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, at, raw): the parts between semicolons, trimmed, with the number of each; blank parts are left out."""
    each = nodes.select(*keys, F.posexplode(F.split(text, ";", -1)).alias("at", "raw"))
    # the two ends tell whether there is something to trim
    ends = F.concat(F.left("raw", F.lit(1)), F.right("raw", F.lit(1)))
    return each.withColumn("raw", F.when(ends.rlike(r"(?U)\s"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).otherwise(F.col("raw"))).where("raw <> ''")


def _key(text: Column) -> Column:
    """A text in which a word stands in small letters wherever a pattern finds it without regard to case: long s, the dotted and the dotless i count as letters of the alphabet, as they do there."""
    for odd, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def extract_frames(nodes: DataFrame, keys: Sequence[str], fields: dict[str, str], text: str = "text") -> DataFrame:
    """(keys, at, start, family, slots): a frame for each action of each clause, one without action for a clause that has none.

    at is the number of the clause in the text, start the action's in the clause (-1 without one). slots maps each slot to
    (value, state, reason); state is GROUNDED, ABSENT or UNKNOWN. fields maps patterns of labels to parameters of the
    contract's profile. All is decided by columns, so frames are found where Spark reads the texts. A pattern is only
    tried on a clause that holds one of the words without which it finds nothing.
    """
    c = _clauses(nodes, keys, text).withColumns({"_key": _key(F.col("raw")), "_digits": F.col("raw").rlike(r"\p{Nd}")})
    there = lambda *words: reduce(lambda x, y: x | y, [F.col("_key").contains(w) for w in words])
    c = c.withColumns({"_lead": F.when(there("nghiệm"), F.regexp_extract("raw", _ACCEPT, 1)).otherwise(""), "_acts": there(*ACTIONS), "_refers": there("khoản", "điểm", "điều", "mục", "chương", "phụ")})
    none_found = F.array().cast("array<string>")
    c = c.withColumns({"_found": F.when(F.col("_acts"), F.regexp_extract_all("raw", F.lit(_ACTION), F.lit(1))).otherwise(none_found), "_parts": F.when(F.col("_acts"), F.split("raw", _ACTION, -1)).otherwise(F.array("raw"))})
    c = c.withColumn("_n", F.size("_found")).withColumn("_accepts", (F.col("_n") == 0) & (F.col("_lead") != ""))
    c = c.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)))))
    # the text before the k-th action: parts and actions in turn
    joined = F.array_join(F.zip_with(F.slice("_parts", F.lit(1), F.col("_k") + 1), F.slice("_found", F.lit(1), F.col("_k")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    c = c.withColumn("_prefix", F.lower(F.when(F.col("_n") > 0, joined).when(F.col("_accepts"), F.col("_lead")).otherwise(F.col("raw"))))
    raw, prefix = F.col("raw"), F.col("_prefix")
    symbols = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    word = F.lower(F.regexp_replace(F.get("_found", F.col("_k")), r"(?U)\s+", " "))
    c = c.withColumn("_action", F.when(F.col("_n") > 0, symbols[word]).when(F.col("_accepts"), "ACCEPT"))
    has = lambda p, *words, on=raw: there(*words) & on.rlike(_F + p)
    take = lambda p, *words, g=1: F.when(there(*words), F.nullif(F.regexp_extract(raw, _F + p, g), F.lit("")))
    action, simple = F.col("_action"), F.col("_n") <= 1

    parties = F.col("_parties")
    c = c.withColumn("_parties", F.when(there("bên"), F.regexp_extract_all(prefix, F.lit(_F + r"\bbên\s+([ab])\b"), F.lit(1))).otherwise(none_found))
    c = c.withColumn("_party", F.when(F.size(parties) == 1, F.upper(parties[0]))).withColumn("_both", (F.size(parties) == 0) & has(r"\bhai\s+bên\b", "bên", on=prefix))
    party, both = F.col("_party"), F.col("_both")
    c = c.withColumn("_banned", has(r"không\s+được(?:\s+phép)?\s*$", "không", on=prefix))
    banned = F.col("_banned")
    c = c.withColumn("_allowed", ~banned & has(r"được\s+phép\s*$", "được", on=prefix) & ~has(r"\b(?:không|chưa|chẳng)\b", "không", "chưa", "chẳng", on=prefix))
    allowed = F.col("_allowed")
    bound = ~banned & ~allowed & has(r"(?:phải|có\s+nghĩa\s+vụ)\s*$", "phải", "nghĩa", on=prefix) & ~prefix.contains("không")
    stated = F.when(banned, "PROHIBITED").when(allowed, "PERMITTED").when(bound, "REQUIRED")
    c = c.withColumn("_mode", stated)
    mode = F.col("_mode")
    c = c.withColumn("_passive", has(r"được\s*$", "được", on=prefix) & mode.isNull())
    passive = F.col("_passive")
    c = c.withColumn("_plain", mode.isNull() & action.isNotNull() & (party.isNotNull() | both) & ~passive & ~prefix.rlike(_F + r"\b(?:không|chưa|chẳng|được|quyền|có\s+thể|nếu|khi|trường\s+hợp)\b"))
    plain = F.col("_plain")

    # what is done: amounts and shares are slots of their own, a copula or a reference is no object
    acted = action.isin("PAY", "DELIVER", "COMPENSATE", "ACCEPT")
    object_ = F.when(acted, take(r"\b(?:thanh toán|giao hàng|bồi thường|nghiệm\s+thu)\s+(.+?)(?=\s+(?:trong|sau|khi|nếu)\b|[.,;](?!\d)|$)", "thanh", "giao", "bồi", "nghiệm"))
    object_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(object_, r"(?U)^\s+|\s+$", ""), _F + _MONEY, ""), r"(?U)(?<![\w.,])\d+(?:[.,]\d+)*\s*%(?!\w)", "")
    c = c.withColumn("_object", F.regexp_replace(object_, r"^[ ,:-]+|[ ,:-]+$", ""))
    object_ = F.col("_object")
    object_ = F.when(acted & (object_ != "") & ~object_.rlike(_F + r"^(?:theo|như|tùy|là|được)\b"), object_)

    quoted = r'(?iuU)^["“]([^"”]+)["”]\s+nghĩa\s+là\s+([^\n]+)$'
    none = action.isNull()
    c = c.withColumn("_term", F.when(none & there("nghĩa"), F.nullif(F.regexp_extract(raw, quoted, 1), F.lit(""))))
    label = F.when(none & F.col("_term").isNull() & F.left(raw, F.lit(121)).contains(":") & raw.rlike(r"^[^:]{1,120}:\s*[^\n]+$"), F.regexp_extract(raw, r"^([^:]{1,120}):", 1))
    known = F
    for pattern, key in fields.items():
        known = known.when(label.rlike(_F + pattern), key)
    known = known.otherwise(None) if fields else F.lit(None).cast("string")
    c = c.withColumn("_total", has(_TOTAL, "tổng", "total"))
    total = F.col("_total")
    parameter = F.coalesce(F.col("_term"), known, F.when(none & F.col("_term").isNull() & total, "total_price"))
    c = c.withColumn("_parameter", parameter)
    breach = (action == "COMPENSATE") & ~F.coalesce(mode.isin("PROHIBITED", "PERMITTED"), F.lit(False))
    family = F.when(mode == "PROHIBITED", "PROHIBITION").when(mode == "PERMITTED", "RIGHT").when(breach, "REMEDY").when(F.col("_term").isNotNull(), "DEFINITION").when(none & F.col("_parameter").isNotNull(), "PARAMETER").otherwise("OBLIGATION")

    digits = F.col("_digits")
    c = c.withColumn("_money", F.when(digits & there("vnd", "usd", "eur", "đ"), F.size(F.regexp_extract_all("raw", F.lit(_F + _MONEY), F.lit(0)))).otherwise(0))
    c = c.withColumn("_shares", F.when(digits & raw.contains("%"), F.regexp_extract_all("raw", F.lit(r"(?U)(?<![\d.,])\b(\d+)%"), F.lit(1))).otherwise(none_found))
    one, bare = F.col("_money") == 1, (F.col("_money") == 0) & total
    numbers = F.when(bare & digits, F.regexp_extract_all(raw, F.lit(_F + _NUMBER), F.lit(1))).otherwise(none_found)
    share = (F.size("_shares") == 1) & (F.col("_money") == 0)
    c = c.withColumn("_numbers", numbers).withColumn("_labelled", F.when(F.size("_numbers") > 0, decimal_amount(F.element_at("_numbers", -1))))
    labelled = F.col("_labelled")
    c = c.withColumns({"_sum": F.when(one, F.nullif(F.regexp_extract(raw, _F + _MONEY, 1), F.lit(""))), "_sum_unit": F.when(one, F.nullif(F.regexp_extract(raw, _F + _MONEY, 2), F.lit("")))})
    c = c.withColumn("_amount", F.when(simple, F.when(share, F.get("_shares", F.lit(0))).when(one, decimal_amount(F.col("_sum"))).otherwise(labelled)))
    amount = F.col("_amount")
    money_unit = F.lower("_sum_unit")
    currency = F.when(simple & one, F.when(money_unit.isin("đ", "đồng"), "VND").otherwise(F.upper(money_unit)))
    unit = F.when(simple, F.when(share, "percent").when(one | labelled.isNotNull(), "money"))
    c = c.withColumn("_days", F.when(digits, take(_DEADLINE, "trong")))
    days = F.col("_days")
    c = c.withColumn("_span", F.when(days.isNotNull(), F.lower(F.regexp_replace(take(_DEADLINE, "trong", g=2), r"(?U)\s+", " "))))
    span = F.col("_span")
    c = c.withColumn("_deferred", days.isNull() & has(r"\bthời\s+hạn\b[^.;]*\b(?:quy\s+định\s+tại|theo)\b|\btheo\s+thời\s+hạn\b", "thời"))
    deferred = F.col("_deferred")
    period = F.when(span.contains("làm việc"), "business-day").otherwise(F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])[span])
    no_term = simple & days.isNull() & ~deferred & ~has(r"\btrong\b", "trong")
    # digits that are no quantity: the leading number, references, the deadline
    rest = F.when(days.isNull(), raw).otherwise(F.regexp_replace(raw, _F + _DEADLINE, ""))
    rest = F.regexp_replace(rest, r"(?U)^\s*\d+(?:\.\d+)*\.?\s*", "")
    rest = F.when(F.col("_refers"), F.regexp_replace(rest, _F + _REFERENCE, "")).otherwise(rest)
    c = c.withColumn("_no_amount", simple & amount.isNull() & (F.col("_money") == 0) & (F.size("_shares") == 0) & ~(digits & rest.rlike(r"\d")))
    no_amount = F.col("_no_amount")
    c = c.withColumn("_referred", days.isNull() & F.col("_refers") & raw.rlike(_F + _REFERENCE))
    referred = F.col("_referred")
    trigger = F
    for name, pattern in _TRIGGERS.items():
        trigger = trigger.when(simple & has(pattern, *_TRIGGER_WORDS[name]), name)
    since = F.lower(F.regexp_replace(take(_SINCE, "kể"), r"(?U)\s+", " "))
    trigger = trigger.otherwise(F.when(simple & since.isNotNull(), F.concat(F.lit("AFTER:"), since)))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    condition, exception = strip(take(r"\bnếu\s+([^,]+)", "nếu")), strip(take(r"\btrừ\s+khi\s+(.+)", "trừ"))
    values = {"condition": condition, "exception": exception, "object_scope": object_, "temporal_trigger": trigger, "currency": currency, "unit": unit}
    c = c.withColumns({f"_{k}": F.when(simple, v) if k in ("condition", "exception") else v for k, v in values.items()})

    nothing = F.lit(None).cast("string")
    slot = lambda value, absent=F.lit(False), reason=nothing: F.struct(value.cast("string").alias("value"), F.when(value.isNotNull(), "GROUNDED").when(F.coalesce(absent, F.lit(False)), "ABSENT").otherwise("UNKNOWN").alias("state"), F.coalesce(reason, F.when(value.isNull() & ~F.coalesce(absent, F.lit(False)), "not_assessed")).alias("reason"))
    later = lambda when: F.when(when, "deferred_by_reference")
    made = {
        "action": slot(action), "actor": slot(F.when(~passive, F.coalesce(party, F.when(both, "BOTH")))), "amount": slot(amount, no_amount & ~referred, later(no_amount & referred)),
        "beneficiary": slot(F.when(passive, party), ~passive & (party.isNotNull() | both)), "condition": slot(F.col("_condition"), simple), "currency": slot(F.when(~share, F.col("_currency")), simple & share),
        "deadline": slot(F.when(simple, days), no_term, later(simple & deferred)), "deadline_unit": slot(F.when(simple & days.isNotNull(), F.coalesce(period, F.lit("unknown"))), no_term, later(simple & deferred)),
        "definition": slot(F.when(F.col("_term").isNotNull(), F.regexp_extract(raw, quoted, 2))), "exception": slot(F.col("_exception"), simple),
        "modality_negation": slot(F.coalesce(mode, F.when(plain, "REQUIRED")), reason=F.when(mode.isNull() & plain, "declarative_obligation")), "object_scope": slot(F.col("_object_scope")),
        "parameter": slot(F.col("_parameter")), "qualifier": slot(F.when(breach & has(r"\bnếu\s+vi\s+phạm\b", "nếu"), "BREACH")), "temporal_trigger": slot(F.col("_temporal_trigger")), "unit": slot(F.col("_unit"), no_amount & ~referred, later(no_amount & referred)),
    }
    start = F.when(action.isNotNull(), F.char_length("_prefix")).otherwise(-1)
    return c.select(*keys, "at", start.alias("start"), family.alias("family"), F.map_from_arrays(F.array(*[F.lit(s) for s in SLOTS]), F.array(*[made[s] for s in SLOTS])).alias("slots"))


def review_reasons(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reason): what keeps a frame from being compared, a row for each slot that is UNKNOWN."""
    open_ = F.filter(F.map_entries("slots"), lambda e: e["value"]["state"] == "UNKNOWN")
    return frames.select(*keys, F.explode(F.transform(open_, lambda e: F.concat(F.lit("unresolved_slot:"), e["key"]))).alias("reason"))


# ---- periods ----------------------------------------------------------------------------------------------------------


def coverage(periods: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, from, to, n): the stretches of time between the first start and the last end of a key, each with the number of periods in force.

    Periods are half open, from `start` to before `end`; empty and backward ones count nothing. Starts and ends are
    events that are summed for each instant before they are put in order, so a million periods of one date are one row;
    a running sum then says how many are open. A null end is open for ever: its stretch has no `to`.
    """
    p = periods.where((F.col(end).isNull() | (F.col(start) < F.col(end))) & F.col(start).isNotNull())
    events = p.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.*").where("at IS NOT NULL")
    steps = events.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = W.partitionBy(*keys).orderBy("at")
    run = steps.withColumns({"n": F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)), "to": F.lead("at").over(w)})
    # instants at which as many begin as end change nothing: they don't part a stretch
    kept = run.withColumn("_new", F.coalesce(F.col("n") != F.lag("n").over(w), F.lit(True))).where("_new")
    out = kept.withColumn("to", F.lead("at").over(w)).select(*keys, F.col("at").alias("from"), "to", F.col("n").cast("long").alias("n"))
    return out.where(F.col("to").isNotNull() | (F.col("n") > 0))


def gaps(periods: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, from, to): stretches between periods in which none is in force."""
    return coverage(periods, keys, start, end).where("n = 0").drop("n")
