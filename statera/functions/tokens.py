"""Scalar operators on report text as column expressions: numbers, cells, scales, currencies, periods, labels, headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statera.functions.vocabulary import CURRENCIES, IMPLIED, SCALES

#: The number grammar (ASCII digits only), what may stand before and after a number, dashes that
#: mean zero, years and spans of years, footnote marks and numbering of labels.
PREFIX = r"(?i)^(?:rs\.?|inr|usd|us\$|\$|₹|€|£)\s*"
SUFFIX = r"[*†‡§]+$"
GROUPED = r"^(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}|[0-9]+)(?:\.[0-9]+)?$"
DASHES = ["-", "–", "—", "Nil", "NIL", "nil"]
YEAR = r"(?:^|[^0-9])((?:19|20|21)[0-9]{2})(?![0-9])"
AMOUNT = r"^\(?[-+]?\d[\d,]*(?:\.\d+)?\)?-?$"
NUMERIC = r"\(?\d[\d,]*(?:\.\d+)?\)?"
BARE_YEAR = r"^(?:19|20|21)[0-9]{2}$"
MONEY = "decimal(38,4)"
SPAN = r"(?:^|[^0-9])((?:19|20|21)[0-9]{2})\s*[-–/]\s*((?:19|20|21)?[0-9]{2})(?![0-9])"
FOOTNOTES = r"[*†‡§¹²³]+|\(note [0-9]+[a-z]?\)|\(refer note [^)]*\)|(?:\([a-z]\))+$"
NUMBERING = r"^(?:\(?[0-9ivx]+[.)]|\(?[a-z][.)])\s+"
#: White space: ASCII with the separators U+001C to U+001F, then Unicode's.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


_WS = f"[{SPACES}]"
#: An amount between white space, in one pattern: read where cells are counted by the million.
_IS_AMOUNT = rf"^{_WS}*+(?!(?:19|20|21)[0-9]{{2}}{_WS}*$){AMOUNT[1:-1]}{_WS}*$"


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(x, F.lit(SPACES))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _bare(token: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(token), PREFIX, ""), SUFFIX, ""))


def parse_number(token: Column) -> Column:
    """Western, Indian or plain grouping with parentheses, minus at either end or plus; null for anything else.

    More than 34 digits before the point, or more than four after it, do not fit and are null too.
    """
    return once(_bare(token), _value)


def _value(s: Column) -> Column:
    round_ = s.startswith("(") & s.endswith(")") & (F.length(s) > 1)
    trailing, leading = s.endswith("-"), s.startswith("-")
    inner = F.when(round_, F.substring(s, F.lit(2), F.length(s) - 2)).when(trailing, F.substring(s, F.lit(1), F.length(s) - 1)).when(leading | s.startswith("+"), F.substring(s, F.lit(2), F.length(s))).otherwise(s)
    plain = lambda i: F.when(i.rlike(GROUPED), F.replace(i, F.lit(","), F.lit("")))
    fits = lambda x: F.when(~x.rlike(r"\.[0-9]{4}[0-9]*[1-9]"), x).try_cast(MONEY)
    value = once(once(strip(inner), plain), fits)
    return once(value, lambda v: F.when(round_ | trailing | leading, -v).otherwise(v))


def classify(token: Column, column_is_numeric: Column) -> Column:
    """number, dash_zero, missing, unparseable or text."""

    def kind(s: Column) -> Column:
        dash = s.isin(*DASHES)
        return (
            F.when(s == "", "missing")
            .when(dash & column_is_numeric, "dash_zero")
            .when(dash, "text")
            .when(parse_number(s).isNotNull(), "number")
            .when(~column_is_numeric, "text")
            .otherwise("unparseable")
        )

    return once(strip(F.regexp_replace(strip(F.coalesce(token, F.lit(""))), PREFIX, "")), kind)


def cell_value(token: Column, kind: Column) -> Column:
    return F.when(kind == "number", parse_number(token)).when(kind == "dash_zero", F.lit(0).cast(MONEY))


def detect_scale(x: Column) -> Column:
    return F.coalesce(*[F.when(x.rlike(f"(?i){pattern}"), F.lit(name)) for name, (pattern, _) in SCALES.items()])


def multiplier(scale: Column) -> Column:
    table = F.create_map(*[F.lit(v) for name, (_, n) in SCALES.items() for v in (name, n)], F.lit("unit"), F.lit(1))
    return F.try_element_at(table, scale).cast("decimal(10,0)")


def scaled(value: Column, scale: Column) -> Column:
    """Exact, or null if it does not fit."""
    return F.try_multiply(value.try_cast("decimal(28,4)"), multiplier(scale)).try_cast(MONEY)


def resolve_scale(cell: Column, table: Column, statement: Column, document: Column) -> Column:
    """struct of scale and where it was found: the first level that states one."""
    levels = [("cell", cell), ("table", table), ("statement", statement), ("document", document)]
    return F.coalesce(*[F.when(detect_scale(x).isNotNull(), F.struct(detect_scale(x).alias("scale"), F.lit(n).alias("source"))) for n, x in levels])


def detect_currency(x: Column) -> Column:
    return F.coalesce(*[F.when(x.rlike(f"(?i){pattern}"), F.lit(code)) for code, pattern in CURRENCIES.items()])


def resolve_currency(table: Column, statement: Column, document: Column) -> Column:
    """A code, "conflict" if table and statement name two, or "ambiguous" if no level states or implies one."""
    a, b = detect_currency(table), detect_currency(statement)
    implied = lambda x: F.coalesce(*[F.when(x.rlike(f"(?i){p}"), F.lit(c)) for c, p in IMPLIED.items()])
    return F.when(a != b, "conflict").otherwise(F.coalesce(a, b, detect_currency(document), implied(table), implied(statement), implied(document), F.lit("ambiguous")))


def parse_period(label: Column) -> Column:
    """The year in which a period ends: the end of a range such as 2023-24, else the first year; null if there is none."""
    first, last = F.regexp_extract(label, SPAN, 1), F.regexp_extract(label, SPAN, 2)
    short = (F.substring(first, 1, 2).try_cast("int") * 100 + last.try_cast("int"))
    ranged = F.when(F.length(last) == 4, last.try_cast("int")).when(short < first.try_cast("int"), short + 100).otherwise(short)
    single = F.regexp_extract(label, YEAR, 1)
    return F.when(first != "", ranged).when(single != "", single.try_cast("int"))


def normalise_label(label: Column) -> Column:
    """Lower case, without footnote marks, numbering, punctuation and repeated white space."""
    s = F.lower(strip(label))
    s = F.regexp_replace(s, FOOTNOTES, " ")
    s = F.regexp_replace(s, NUMBERING, "")
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def words(x: Column) -> Column:
    """Parts between white space, none for blank text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def evened(x: Column) -> Column:
    """The words of a text with one space between them; nothing for null."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def is_heading(line: Column) -> Column:
    return F.size(words(line)) <= 8


def is_amount(cell: Column) -> Column:
    """An amount that is no bare year, white space at its ends aside."""
    return cell.rlike(_IS_AMOUNT)


def is_header(cells: Column) -> Column:
    """Names periods and carries no amounts, the label cell and blank cells aside."""
    tail = F.filter(F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1))), lambda c: c.rlike(f"[^{SPACES}]"))
    return F.exists(tail, lambda c: c.rlike(YEAR)) & F.forall(tail, lambda c: ~is_amount(c))


def numeric_tokens(x: Column) -> Column:
    return F.size(F.filter(words(x), lambda w: w.rlike(f"^{NUMERIC}$")))


def is_dense(x: Column) -> Column:
    """Eight numeric tokens or more, and a quarter of all or more."""
    n = numeric_tokens(x)
    return (n >= 8) & (n * 4 >= F.size(words(x)))


def ref_id(page: Column, table: Column, row: Column) -> Column:
    return F.format_string("page_%d_table_%d_row_%d", page, table, row)


def display_name(name: Column) -> Column:
    """The last path component, or "upload.pdf" for none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(name, r"[/\\]+$", ""), r"([^/\\]*)$", 1), F.lit("")), F.lit("upload.pdf"))
