"""Scalar functions over columns: multi-value fields, dates, identifiers and clean-up. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delimiters of a multi-value field.
DELIMITERS = "、,，/;；·"
#: Words that stand for true and false.
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y", "t"), ("0", "false", "no", "n", "f")
#: Digits of Chinese numerals, and characters that a file name may not hold.
NUMERALS, NAME_FORBIDDEN = "零一二三四五六七八九", r'[\\/*?:"<>|]'

text_or_empty = lambda c: F.coalesce(c, F.lit(""))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, w: x | text_or_empty(c).contains(w), words, F.lit(False))


def split_multi(c: Column) -> Column:
    """Parts of a multi-value field, trimmed, without blanks; null gives no parts."""
    return F.filter(F.transform(F.split(text_or_empty(c), f"[{DELIMITERS}]"), lambda x: F.trim(x)), lambda x: x != "")


def ordered_unique(parts: Column) -> Column:
    """Trimmed values without blanks and repeats, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(text_or_empty(x))), lambda x: x != ""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value), where value stands once in the plan however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fill_blank(old: Column, new: Column) -> Column:
    """new where old is null or blank."""
    return F.when(F.trim(text_or_empty(old)) == "", new).otherwise(old)


def lenient_bool(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def clamp(c: Column, default: int = 15, low: int = 1, high: int = 40) -> Column:
    """A whole number held within bounds; what is no number becomes the default."""
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def clip(c: Column, n: int) -> Column:
    """White space collapsed; a longer text is cut to n - 1 characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def date_in(c: Column) -> Column:
    """The first date of the form Y-M-D that exists, else the first of the form Y年M月D日, else null."""
    forms = (r"(\d{4})\s*-\s*(\d{1,2})\s*-\s*(\d{1,2})", r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日")
    return F.coalesce(*[_date(*[F.regexp_extract(text_or_empty(c), form, g) for g in (1, 2, 3)]) for form in forms])


def strict_date(c: Column) -> Column:
    """Only an existing day written YYYY-MM-DD, as text, else null."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.trim(c).try_cast("date").isNotNull(), F.trim(c))


def numeral(c: Column) -> Column:
    """A Chinese numeral up to 99, or one of digits only, as a whole number, else null."""
    plain = F.translate(F.trim(c), "〇" + NUMERALS, "00123456789")
    tens = F.regexp_extract(plain, "^(\\d?)十(\\d?)$", 1)
    ones = F.regexp_extract(plain, "^(\\d?)十(\\d?)$", 2)
    number = lambda x, blank: F.coalesce(F.nullif(x, F.lit("")).try_cast("int"), F.lit(blank))
    return F.when(plain.rlike("^\\d?十\\d?$"), number(tens, 1) * 10 + number(ones, 0)).otherwise(plain.try_cast("int"))


def sign_off_date(c: Column, tail: int = 1500, margin: int = 200) -> Column:
    """The date furthest right that ends within `margin` characters of the end; empty where there is none.

    Dates are Y年M月D日, in Arabic or Chinese numerals, or Y-M-D, within the last `tail` characters.
    """
    text = text_or_empty(c)
    near = F.when(F.length(text) > tail, F.substring(text, -tail, tail)).otherwise(text)
    digits = "〇" + NUMERALS + "十"
    forms = [r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", r"\d{4}-\d{1,2}-\d{1,2}", rf"[{digits}]{{4}}\s*年\s*[{digits}]{{1,3}}\s*月\s*[{digits}]{{1,3}}\s*日"]
    found = F.regexp_extract_all(near, F.lit("(" + "|".join(forms) + ")"), 1)
    # Where a match ends is seen from what follows its last occurrence.
    placed = F.transform(found, lambda m: F.struct((F.length(near) - F.length(F.call_function("substring_index", near, m, F.lit(-1)))).alias("end"), m.alias("m")))

    def day(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m, rf"^([\d{digits}]+)\s*[年-]\s*([\d{digits}]+)\s*[月-]\s*([\d{digits}]+)", k)
        number = lambda k: numeral(part(k)).cast("string")
        return _date(number(1), number(2), number(3))

    good = F.filter(placed, lambda x: (F.length(near) - x["end"] <= margin) & day(x["m"]).isNotNull())
    last = F.try_element_at(F.sort_array(good), F.lit(-1))
    return text_or_empty(day(last["m"]).cast("string"))


def quarter_before(day: Column) -> Column:
    """The quarter before a day's, as a struct of label (2024Q3), first and last day."""
    first = F.trunc(F.add_months(day, -3), "quarter")
    return F.struct(F.concat(F.year(first), F.lit("Q"), F.quarter(first)).alias("label"), first.alias("first"), F.last_day(F.add_months(first, 2)).alias("last"))


def ordered_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """The bounds in order, swapped where both are given and inverted."""
    swap = F.coalesce(a > b, F.lit(False))
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def slug(url: Column) -> Column:
    return F.substring(F.regexp_replace(F.element_at(F.split(url, "/"), -1), "[^a-zA-Z0-9]", "_"), 1, 60)


#: The forms of detail pages' addresses.
def case_id_from_url(url: Column) -> Column:
    """Identifier of a detail page: a long P number, a t date_number, a month and name, a c number, else a slug."""
    month = F.regexp_replace(F.regexp_extract(url, r"/(\d{6}/[^/]+)$", 1), "[^a-zA-Z0-9]", "_")
    return first_filled(F.regexp_extract(url, r"(P\d{20,})", 1), F.regexp_extract(url, r"/t(\d+_\d+)", 1), month, F.regexp_extract(url, r"/(c\d+)/content\.shtml", 1), F.regexp_extract(url, r"(c\d{6,})", 1), slug(url))


def dated_case_id(day: Column, url: Column) -> Column:
    return F.concat_ws("_", F.regexp_replace(text_or_empty(day.cast("string")), "-", ""), case_id_from_url(url))


def is_list_url(url: Column, endings: tuple[str, ...] = ("index", "list", "default")) -> Column:
    """Whether an address is a list or a start page rather than a detail page: no path, a folder, or a page of a listed name, with a page number or not."""
    path = F.regexp_extract(text_or_empty(url), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return path.isin("", "/") | path.endswith("/") | path.rlike(rf"/(?:{'|'.join(endings)})(?:_\d+)?\.[a-z]+$")


def attachment_only(c: Column, suffixes: tuple[str, ...] = (".pdf", ".doc", ".docx", ".xls", ".xlsx"), longest: int = 300) -> Column:
    """Whether a short text does no more than name a file."""
    return (F.length(text_or_empty(c)) < longest) & contains_any(F.lower(c), suffixes)


def document_number(title: Column, body: Column) -> Column:
    """A document number 〔year〕number号 of the title, else of the first 2000 characters of the body; a prefix of place stays."""
    found = []
    for source in (text_or_empty(title), F.substring(text_or_empty(body), 1, 2000)):
        year, number = (F.regexp_extract(source, r"[〔［\[](\d{4})[〕］\]]\s*(\d{1,4})\s*号", g) for g in (1, 2))
        prefix = F.regexp_extract(source, r"([一-龥]{1,4})[〔［\[]\d{4}[〕］\]]\s*\d{1,4}\s*号", 1)
        found.append(F.when(year != "", F.concat(prefix, F.lit("〔"), year, F.lit("〕"), number, F.lit("号"))))
    return F.coalesce(*found, F.lit(""))


def file_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), NAME_FORBIDDEN, ""))


def safe_url(c: Column) -> Column:
    """The address if its scheme is http or https, else empty."""
    return F.when(F.lower(F.trim(c)).rlike(r"^https?://"), F.trim(c)).otherwise("")


def html_escape(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text_or_empty(c))


def mask_secret(c: Column, shown: int = 4) -> Column:
    """Stars but for the last characters; short values are all stars."""
    return F.when(F.length(c) <= 2 * shown, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - shown), F.substring(c, -shown, shown)))


def readable_share(c: Column, n: int = 4000) -> Column:
    """Share of readable characters (letters, digits, blanks, common marks) among the first n."""
    head = F.substring(text_or_empty(c), 1, n)
    return F.length(F.regexp_replace(head, r"[^\p{L}\p{N}\p{P}\s]", "")) / F.greatest(F.length(head), F.lit(1))


def is_garbage(c: Column, least: float = 0.5, n: int = 4000) -> Column:
    """Whether most of a text's beginning is unreadable; an empty text is not."""
    return (text_or_empty(c) != "") & (readable_share(c, n) < least)


#: Strict JSON as to quotes, while NaN and Infinity pass, as in most readers.
_JSON = {"allowSingleQuotes": "false", "allowBackslashEscapingAnyCharacter": "false"}


def _reads_as_object(c: Column) -> Column:
    """Whether a text begins with a JSON object; what follows the object doesn't count."""
    return F.from_json(c, "map<string,string>", _JSON).isNotNull()


def _balanced_length(c: Column) -> Column:
    """How many characters of a text that begins with a bracket reach to the one that closes it; brackets within strings don't count."""
    pieces = F.regexp_extract_all(c, F.lit(r'([\[\]{}"\\]|[^\[\]{}"\\]+)'), 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(False).alias("done"))

    def step(at: Column, piece: Column) -> Column:
        outside = ~at["quoted"]
        depth = at["depth"] + F.when(outside & piece.isin("{", "["), 1).when(outside & piece.isin("}", "]"), -1).otherwise(0)
        quoted = F.when((piece == '"') & ~at["escaped"], outside).otherwise(at["quoted"])
        escaped = at["quoted"] & (piece == "\\") & ~at["escaped"]
        after = F.struct((at["n"] + F.length(piece)).alias("n"), depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), (depth == 0).alias("done"))
        return F.when(at["done"], at).otherwise(after)

    return F.aggregate(pieces, start, step, lambda at: at["n"])


def json_object(c: Column) -> Column:
    """The first object in a model's answer that can be read, as JSON text; null where there is none.

    From every opening brace in turn the text is tried as it stands, then without commas before a closing bracket; what is read is
    cut where its brackets are balanced. So an object inside one that is broken is found, and what stands around it, a fence too, goes.
    All is built-in; a text is tried from its first brace in nearly all cases, and once for each brace before the object otherwise.
    """
    text = text_or_empty(c)

    def attempts(text: Column) -> Column:
        before = F.slice(F.split(text, r"\{"), F.lit(1), F.size(F.split(text, r"\{")) - 1)  # the text before each brace
        none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

        def step(acc: Column, gap: Column) -> Column:
            at = acc["at"] + F.length(gap) + 1
            rest = F.substring(text, at, F.length(text))
            mended = F.regexp_replace(rest, r"(?U),\s*([}\]])", "$1")
            found = F.when(_reads_as_object(rest), rest).when(_reads_as_object(mended), mended)
            return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct(at.alias("at"), found.alias("found")))

        return F.aggregate(before, none, step, lambda acc: acc["found"])

    return bound(attempts(text), lambda found: F.when(found.isNotNull(), F.substring(found, F.lit(1), _balanced_length(found))))


def percent(part: Column, total: Column) -> Column:
    return F.format_string("%.1f", F.when(total > 0, 100.0 * part / total).otherwise(0.0))


def entity_type(c: Column, org: str = "机构", person: str = "个人") -> Column:
    """Spellings of a mixed type in one order; other texts stay without blanks."""
    flat = F.regexp_replace(F.regexp_replace(text_or_empty(c), r"\s+", ""), r"[+／/]", "、")
    has = lambda w: flat.contains(w)
    return F.when(has(org) & has(person), f"{org}、{person}").when(has(org), org).when(has(person), person).otherwise(flat)
