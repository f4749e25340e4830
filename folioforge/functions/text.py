"""Text columns: folding, headings, markers, masking, quality of Vietnamese readings. Every function maps columns to a column."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- folding ----------------------------------------------------------------------------------------------------------


def _letter_table() -> tuple[str, str]:
    """Accented Latin letters of two Unicode ranges and what they are without marks, by decomposition; d with stroke is d."""
    out = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(m) for m in base[1:]):
            out[chr(code)] = base[0]
    return "".join(out), "".join(out.values())


MARKED, PLAIN = _letter_table()
#: Combining marks of decomposed text: the general block.
_MARKS = r"[̀-ͯ]"
_SPACE = r"[\s ]+"


def strip_diacritics(text: Column) -> Column:
    """Composed letters by table, then loose combining marks; case stays."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), _MARKS, "")


def fold(text: Column) -> Column:
    """Lower case, no marks, đ as d, white space to one space, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(strip_diacritics(F.lower(text)), _SPACE, " "))


def skeleton(text: Column) -> Column:
    """What two readings that differ in accents alone have in common."""
    return fold(text)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def quote_digest(quote: Column) -> Column:
    """SHA-256 of the exact quote as hex."""
    return F.sha2(quote.cast("binary"), 256)


# ---- how a Vietnamese reading looks ----------------------------------------------------------------------------------

# Letters of the Vietnamese alphabet with marks, syllable shape, English function words, thresholds.
VN_MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
VN_SYLLABLE = r"^(ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|[bcdghklmnpqrstvx])?[aeiouy]{1,3}(ng|nh|ch|[cmnpt])?$"
ENGLISH_WORDS = ("the of and to in for is on with by as at from this that be are or an it not shall will any all such party parties agreement").split()
DENSITY_WORDS, LOW_DENSITY, BAD_SYLLABLES, BAD_SYLLABLE_SHARE, BARE_DIPHTHONGS, ENGLISH_SHARE = 8, 0.5, 2, 0.25, 2, 0.15
# Contract terms that real text never writes without marks.
UNMARKED_TERMS = (
    "hop dong", "dieu", "khoan", "ben a", "ben b", "cong ty", "trach nhiem", "nghia vu", "thanh toan", "gia tri", "hieu luc", "cham dut", "vi pham",
    "boi thuong", "thong bao", "chu ky", "ky ket", "quyen loi", "dieu khoan", "phap luat", "giai quyet", "tranh chap", "van de", "ky thuat", "du lieu",
    "rui ro", "anh huong", "ket qua", "kip thoi",
)
_BASIC = "bcdđghklmnpqrstvxaeiouy"
_LETTERS = VN_MARKED + VN_MARKED.upper() + _BASIC + _BASIC.upper()
_PUNCTUATION = r".,;:!?()\-/%\"'@"
_ALLOWED = rf"[{_LETTERS}0-9\s{_PUNCTUATION}]"


def _class(letters: str) -> str:
    """The letters as the inside of a class of a pattern, neighbours as ranges: Java tries single letters beyond Latin-1 one after the other."""
    codes, out = sorted({ord(c) for c in letters}), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in out)


# In lower-case text the capitals of a class stand nowhere, and make ranges of it.
_MARKED = f"[{_class(VN_MARKED + VN_MARKED.upper())}]"
# What one byte tells is asked first: Java has a bit for each such letter.
_FOREIGN = rf"(?![\x00-\x7f{''.join(c for c in VN_MARKED if ord(c) < 256)}])[\p{{L}}&&[^{_class(VN_MARKED + VN_MARKED.upper())}]]"
_GARBAGE = rf"(?![{''.join(c for c in _LETTERS if ord(c) < 256)}0-9\t\n\x0b\f\r {_PUNCTUATION}])[^{_class(_LETTERS)}]"
_BARE = r"(?:[iíìỉĩị][eéèẻẽẹ]|[yýỳỷỹỵ][eéèẻẽẹ]|[uúùủũụ][oóòỏõọ])\p{L}"


def alphabet_words(text: Column) -> Column:
    """Lower-case runs of two or more letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{2,})"), F.lit(1))


def _share(items: Column, test) -> Column:
    return F.size(F.filter(items, test)) / F.size(items)


def diacritic_density(text: Column) -> Column:
    """Share of well-formed syllables that carry a mark; null under eight syllables."""
    syllables = F.filter(alphabet_words(text), lambda w: fold(w).rlike(VN_SYLLABLE))
    return F.when(F.size(syllables) >= DENSITY_WORDS, _share(syllables, lambda w: w.rlike(f"[{VN_MARKED}]")))


def garbage_char_ratio(text: Column) -> Column:
    """Share of characters outside letters of the alphabet, digits, white space and punctuation; 0 for empty text."""
    n = F.char_length(text)
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(text, F.lit(_GARBAGE)) / n)


def valid_word_ratio(words: Column) -> Column:
    """Share of non-blank tokens that are made of the alphabet, digits and inner punctuation with a letter or digit; 0 without tokens."""
    tokens = F.filter(words, lambda w: F.trim(w) != "")
    good = F.filter(tokens, lambda w: w.rlike(rf"^[{_LETTERS}0-9{_PUNCTUATION}]+$") & w.rlike(rf"[{_LETTERS}0-9]"))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(good) / F.size(tokens))


def lost_diacritics(text: Column) -> Column:
    """Whether a contract term stands there in bare ASCII."""
    return text.rlike(r"(?i)\b(" + "|".join(UNMARKED_TERMS) + r")\b")


def line_issues(text: Column) -> Column:
    """Codes of what makes a line's reading suspect, in a fixed order; none is no proof of a good reading."""
    words = alphabet_words(text)
    marked = lambda w: w.rlike(f"[{VN_MARKED}]")
    english = ~F.exists(words, marked) & (F.size(words) > 0) & (_share(words, lambda w: w.isin(ENGLISH_WORDS)) >= ENGLISH_SHARE)
    plain = F.regexp_replace(text, r"\S+@\S+|https?://\S+|www\.\S+", " ")
    lower = F.filter(F.regexp_extract_all(plain, F.lit(r"(\p{L}{2,})"), F.lit(1)), lambda w: w == F.lower(w))
    bare = F.filter(lower, lambda w: F.translate(w, "íìỉĩịéèẻẽẹóòỏõọúùủũụýỳỷỹỵ", "iiiiieeeeeooooouuuuuyyyyy").rlike(r"(^|[^q])(ie|ye|uo)\p{L}"))
    odd = F.filter(lower, lambda w: ~fold(w).rlike(VN_SYLLABLE) & ((F.char_length(w) <= 3) | marked(w)))
    foreign = F.lower(text).rlike(rf"[\p{{L}}&&[^a-z{VN_MARKED}]]")
    sparse = diacritic_density(text) < LOW_DENSITY
    return F.array_compact(
        F.array(
            F.when(foreign, "FOREIGN_LETTERS"),
            F.when(~english & sparse, "LOW_DIACRITIC_DENSITY"),
            F.when(~english & (F.size(bare) >= BARE_DIPHTHONGS), "MISSING_VOWEL_MODIFIER"),
            F.when(~english & (F.size(odd) >= BAD_SYLLABLES) & (F.size(odd) / F.greatest(F.size(lower), F.lit(1)) >= BAD_SYLLABLE_SHARE), "INVALID_SYLLABLES"),
        )
    )


def line_quality(lines: DataFrame, text: str) -> DataFrame:
    """lines with issues (`line_issues`), density (`diacritic_density`) and garbage (`garbage_char_ratio`).

    Each part is a column that is computed once; letters are folded once for a line, and by the word only for the few
    words that this can still decide.
    """
    line, low, plain, words, folded, other, lower = (F.col(c) for c in (text, "_low", "_plain", "_words", "_folded", "_other", "_lower"))
    word = F.lit(r"(\p{L}{2,})")
    linked = line.contains("@") | line.contains("http") | line.contains("www.")
    d = lines.withColumns({"_low": F.lower(line), "_plain": F.when(linked, F.regexp_replace(line, r"\S+@\S+|https?://\S+|www\.\S+", " ")).otherwise(line)})
    d = d.withColumns({"_words": F.regexp_extract_all(low, word, F.lit(1)), "_folded": F.regexp_extract_all(F.translate(low, MARKED, PLAIN), word, F.lit(1))})
    d = d.withColumn("_n", F.size(F.filter(folded, lambda w: w.rlike(VN_SYLLABLE))))
    with_mark = F.when(low.rlike(_MARKED), F.size(F.filter(words, lambda w, i: w.rlike(_MARKED) & F.get(folded, i).rlike(VN_SYLLABLE)))).otherwise(0)
    marked = low.rlike(_MARKED) & F.exists(words, lambda w: w.rlike(_MARKED))
    english = F.when((F.size(words) > 0) & ~marked, _share(words, lambda w: w.isin(*ENGLISH_WORDS)) >= ENGLISH_SHARE).otherwise(False)
    d = d.withColumns({"density": F.when(F.col("_n") >= DENSITY_WORDS, with_mark / F.col("_n")), "_other": ~english})
    d = d.withColumn("_lower", F.when(other, F.filter(F.regexp_extract_all(plain, word, F.lit(1)), lambda w: w == F.lower(w))))
    bare = F.filter(lower, lambda w: w.rlike(_BARE) & F.translate(w, "íìỉĩịéèẻẽẹóòỏõọúùủũụýỳỷỹỵ", "iiiiieeeeeooooouuuuuyyyyy").rlike(r"(^|[^q])(ie|ye|uo)\p{L}"))
    odd = F.filter(lower, lambda w: ((F.char_length(w) <= 3) | w.rlike(_MARKED)) & ~F.when(w.rlike(r"[^\x00-\x7f]"), F.translate(w, MARKED, PLAIN)).otherwise(w).rlike(VN_SYLLABLE))
    d = d.withColumns({"_odd": F.size(odd), "_bare": F.when(other & plain.rlike(_BARE), F.size(bare)).otherwise(0)})
    codes = [
        F.when(low.rlike(_FOREIGN), "FOREIGN_LETTERS"),
        F.when(other & (F.col("density") < LOW_DENSITY), "LOW_DIACRITIC_DENSITY"),
        F.when(F.col("_bare") >= BARE_DIPHTHONGS, "MISSING_VOWEL_MODIFIER"),
        F.when(other & (F.col("_odd") >= BAD_SYLLABLES) & (F.col("_odd") / F.greatest(F.size(lower), F.lit(1)) >= BAD_SYLLABLE_SHARE), "INVALID_SYLLABLES"),
    ]
    return d.select(*lines.columns, F.array_compact(F.array(*codes)).alias("issues"), "density", garbage_char_ratio(line).alias("garbage"))


# ---- headings, markers, terms ----------------------------------------------------------------------------------------

ANNEX_HEADING = r"(?iu)^\s*(phụ\s*lục|biểu(\s+số)?|chương|mục|điều|article)(?![\p{L}\d])"


def is_annex_heading(text: Column) -> Column:
    return F.coalesce(text.rlike(ANNEX_HEADING), F.lit(False))


def is_structural_heading(label: Column) -> Column:
    """Annex or section titles, articles, and numbered clause labels."""
    return F.coalesce(is_annex_heading(label) | label.rlike(r"(?iu)^\s*(khoản|điểm|phần|section|clause)\s+[\p{L}\d]+") | label.rlike(r"^\s*\d+(\.\d+)+\.?(\s|$)"), F.lit(False))


def heading_level(label: Column, node_type: Column) -> Column:
    """ANNEX, SECTION, ARTICLE or SUBCLAUSE by the label's first words, then by the node's type, else BLOCK."""
    key = fold(label)
    return (
        F.when(key.rlike(r"^(phu luc|bieu)\b"), "ANNEX")
        .when(key.rlike(r"^(chuong|muc|phan|section)\b"), "SECTION")
        .when(key.rlike(r"^(dieu|article)\b"), "ARTICLE")
        .when(key.rlike(r"^(khoan|diem|clause)\b|^\d+(\.\d+)+"), "SUBCLAUSE")
        .when(node_type == "SECTION", "SECTION")
        .when(node_type == "CLAUSE", "ARTICLE")
        .otherwise("BLOCK")
    )


def parse_marker(text: Column) -> Column:
    """The numbering that opens a line: kind (decimal, roman, letter, bullet), value and depth; null without one."""
    decimal = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)[.)]?\s", 1)
    roman = F.regexp_extract(text, r"^\s*([IVXLC]+)[.)]\s", 1)
    letter = F.regexp_extract(text, r"^\s*([a-zđ])[.)]\s", 1)
    bullet = F.regexp_extract(text, r"^\s*([-•*+–])\s", 1)
    made = lambda kind, value, depth: F.struct(F.lit(kind).alias("kind"), value.alias("value"), depth.cast("int").alias("depth"))
    return (
        F.when(decimal != "", made("decimal", decimal, F.size(F.split(decimal, r"\."))))
        .when(roman != "", made("roman", roman, F.lit(1)))
        .when(letter != "", made("letter", letter, F.lit(1)))
        .when(bullet != "", made("bullet", bullet, F.lit(1)))
    )


def normalize_headings(text: Column) -> Column:
    """`ĐIỀU 1:` and its likes as `Điều 1.`, at the start of lines."""
    return F.regexp_replace(text, r"(?imu)^([ \t]*)điều[ \t]+(\d+\p{L}?)[ \t]*[.:][ \t]*", "$1Điều $2. ")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host without `www.`, path without a last slash, query kept, fragment dropped; what is no URL stays trimmed."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme, host = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path, query = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)$", 1)
    made = F.concat(scheme, F.lit("://"), F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), query)
    return F.when(scheme == "", bare).otherwise(made)


_ADDRESS = r"(điều|khoản|điểm|mục|phụ lục|dieu|khoan|diem|muc|phu luc)\s+[\p{L}\d_.]+"
_CHANGE = r"(sửa đổi(,\s*bổ sung)?|bổ sung|bãi bỏ|thay thế|thay cụm từ|bỏ cụm từ|điều chỉnh|sua doi|bo sung|bai bo|thay the)"


def has_amend_marker(text: Column) -> Column:
    """Whether a sentence states an operation on another provision: a verb near an address, or a fixed phrase; repairs and price indexing don't count."""
    rest = F.regexp_replace(text, r"(?iu)sửa chữa|điều chỉnh theo\s+(cpi|chỉ số|giá thị trường|tỷ giá)", " ")
    found = rest.rlike(
        rf"(?iu){_CHANGE}[^.;\n]{{0,40}}?(?<![\p{{L}}\d_]){_ADDRESS}|(?<![\p{{L}}\d_]){_ADDRESS}[^.;\n]{{0,60}}?{_CHANGE}"
        rf"|(sửa( đổi)?|điều chỉnh|thay đổi)\s+([^.;\n]{{1,40}}?\s+)?thành\s+\S|{_ADDRESS}[^.;\n]{{0,40}}?không còn hiệu lực"
        r"|\bamend(s|ed|ment)?\b[^.;\n]{0,40}?\b(article|clause|section|annex)\s+\w+"
    )
    return F.coalesce(found, F.lit(False))


def defined_term(text: Column) -> Column:
    """The quoted or bare term left of "means"; null without one."""
    means = r"(?:có nghĩa là|được hiểu là|nghĩa là|shall mean|means|co nghia la|duoc hieu la)"
    quoted = F.regexp_extract(text, rf"(?iu)[\"“”']([^\"“”']{{2,80}})[\"“”']\s*(?:\([^)]*\)\s*)?{means}", 1)
    bare = F.regexp_extract(text, rf"(?iu)(?:^|[.;:\n]\s*)(\p{{L}}[^,.;:\n\"“”]{{1,60}}?)\s+{means}", 1)
    return F.nullif(F.trim(F.when(quoted != "", quoted).otherwise(bare)), F.lit(""))


def clause_key(label: Column, text: Column) -> Column:
    """The clause number that opens the label, else that which opens the text."""
    number = lambda c: F.nullif(F.regexp_extract(fold(c), r"^(?:dieu|khoan|article|clause)?\s*(\d+(?:\.\d+)*)", 1), F.lit(""))
    return F.coalesce(number(label), number(text))


def classify_document(first_page: Column, keywords: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first keyword, in list order, that the folded, upper-cased page holds."""
    page = F.upper(fold(first_page))
    out = None
    for word, kind in keywords:
        hit = page.contains(word.upper())
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def tax_basis(text: Column) -> Column:
    """ex_vat is tested before incl_vat; null if neither stands there."""
    key = fold(text)
    return F.when(key.rlike(r"chua (bao gom )?(thue )?(gtgt|vat)|chua vat|excl"), "ex_vat").when(key.rlike(r"(da )?(bao )?gom (thue )?(gtgt|vat)|incl"), "incl_vat")


def scale_phrase(raw: Column) -> Column:
    """One, two or three with billion, million or thousand as digits; nothing else."""
    key = fold(raw)
    digit = F.when(key.rlike(r"\bmot (ty|trieu|nghin)"), "1").when(key.rlike(r"\bhai (ty|trieu|nghin)"), "2").when(key.rlike(r"\bba (ty|trieu|nghin)"), "3")
    zeros = F.when(key.rlike(r"(mot|hai|ba) ty"), "000000000").when(key.rlike(r"(mot|hai|ba) trieu"), "000000").when(key.rlike(r"(mot|hai|ba) nghin"), "000")
    return F.concat(digit, zeros)


def is_hyphenated_break(before: Column, after: Column) -> Column:
    """Whether a hyphen at a break only divides a word: it stands behind at least two characters with a letter, and a small letter follows."""
    left = F.regexp_replace(before, r"(?U)\s+$", "")
    word = F.regexp_extract(left, r"(?U)(\S+)\s*[-\u2010\u00AD]$", 1)
    # most texts end without a hyphen, which is the cheap thing to see
    ends = F.right(left, F.lit(1)).isin("-", "\u2010", "\u00ad")
    return F.coalesce(ends & (F.char_length(word) >= 2) & word.rlike(r"\p{L}") & F.regexp_replace(after, r"(?U)^\s+", "").rlike(r"^\p{Ll}"), F.lit(False))


def merge_texts(before: Column, after: Column) -> Column:
    """Two parts of a paragraph: a hyphen that divides a word goes with the break, else one space stands between."""
    left, right = F.regexp_replace(F.coalesce(before, F.lit("")), r"(?U)\s+$", ""), F.regexp_replace(F.coalesce(after, F.lit("")), r"(?U)^\s+", "")
    joined = F.concat(F.substring(left, F.lit(1), F.char_length(left) - 1), right)
    return F.when(is_hyphenated_break(left, right), joined).otherwise(F.concat_ws(" ", F.nullif(left, F.lit("")), F.nullif(right, F.lit(""))))


# ---- masking ----------------------------------------------------------------------------------------------------------


def mask_email(email: Column) -> Column:
    """First and last letter of the local part with stars between; at most two letters: the first and three stars; none: three stars."""
    local, rest = F.regexp_extract(email, r"^([^@]*)@", 1), F.regexp_extract(email, r"^[^@]*(@.*)$", 1)
    n = F.char_length(local)
    masked = F.when(n == 0, "***").when(n <= 2, F.concat(F.substring(local, 1, 1), F.lit("***"))).otherwise(F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2), F.expr("''"), F.right(local, F.lit(1))))
    return F.when(email.contains("@"), F.concat(masked, rest)).otherwise(email)


def mask_phone(phone: Column) -> Column:
    """Under seven characters unchanged; else the first three, stars, the last two."""
    n = F.char_length(phone)
    return F.when(n < 7, phone).otherwise(F.concat(F.left(phone, F.lit(3)), F.repeat(F.lit("*"), n - 5), F.right(phone, F.lit(2))))


def mask_keep_last4(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.left(F.sha2(value.cast("binary"), 256), F.lit(12)), F.lit(":"), F.right(value, F.lit(4)))


def redact_map(values: Column, sensitive: list[str], longest: int = 2000) -> Column:
    """A map with the values of sensitive keys hidden and long strings cut."""
    hidden = lambda k: F.lower(k).rlike("|".join(sensitive))
    return F.transform_values(values, lambda k, v: F.when(hidden(k), "[REDACTED]").when(F.char_length(v) > longest, F.concat(F.left(v, F.lit(longest)), F.lit("…"))).otherwise(v))


def classify_prompt_injection(text: Column) -> Column:
    """UNTRUSTED_INSTRUCTION for text that speaks to a model instead of a reader, else NONE."""
    key = fold(text)
    hit = key.rlike(r"ignore (all |any )?(the )?(previous|prior|above) (instructions|rules)|disregard (the )?(system|previous)|system prompt|you are now|bo qua (moi |cac )?(chi dan|huong dan|lenh)")
    return F.when(F.coalesce(hit, F.lit(False)), "UNTRUSTED_INSTRUCTION").otherwise("NONE")
