"""Text columns: search keys, dates, amounts, scripts, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search leaves out (fixed values).
COMMON_WORDS = ("the", "and", "with", "that", "says", "said", "photo", "picture", "image", "showing", "from", "for")
#: First and last letter of each script's block (fixed values).
SCRIPTS = {"hindi": ("ऀ", "ॿ"), "tamil": ("஀", "௿"), "telugu": ("ఀ", "౿"), "kannada": ("ಀ", "೿")}
#: Patterns of e-mails, links and ISO dates (fixed values).
EMAIL = r"(?i)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b"
LINK = r"(?i)\b(?:https?://|www\.)[^\s,;]+"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
#: Sizes and counts in item names (fixed value).
QUANTITY = r"(?i)\b(?:x\s?\d+|\d+(?:[.,]\d+)?\s?(?:kg|g|gm|gms|l|ltr|ml|pcs?|nos|pack)?|dozen|pack)\b"


def squeeze(c: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(c), r"""(?U)[\s\-_.,:;!?'"()/]+""", "")


def search_words(c: Column) -> Column:
    parts = F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda w: ~F.lower(w).isin(*COMMON_WORDS))
    return F.filter(F.transform(parts, squeeze), lambda w: F.length(w) >= 3)


def highlights(words: Column, search: Column) -> Column:
    """Boxes of the words that hold a search word or, at three letters or more, stand in one."""
    wanted = search_words(search)

    def hit(w: Column) -> Column:
        own = squeeze(w["text"])
        return F.exists(wanted, lambda q: F.contains(own, q) | ((F.length(own) >= 3) & F.contains(q, own)))

    return F.transform(F.filter(words, hit), lambda w: w["box"])


def extract_emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EMAIL), 0)


def extract_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK), 0)


def extract_iso_dates(c: Column) -> Column:
    """Real dates only."""
    return F.filter(F.regexp_extract_all(c, F.lit(ISO_DATE), 0), lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull())


def check_date(year: Column, month: Column, day: Column) -> Column:
    """ISO date; two-digit years turn at 50; null for impossible dates."""
    full = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", full.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd"), "yyyy-MM-dd")


def day_month_date(first: Column, second: Column, year: Column) -> Column:
    """Day first, else month first."""
    return F.coalesce(check_date(year, second, first), check_date(year, first, second))


def parse_amount(c: Column) -> Column:
    t = F.trim(c)
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    plain = F.when(~both & t.rlike(r"^\d+,\d{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return F.round(plain.try_cast("double"), 2)


def title(c: Column) -> Column:
    """Upper case at the start of each run of letters, lower case after it."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def item_name(c: Column) -> Column:
    """An item without sizes and counts, in title case; the name itself if nothing is left."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, QUANTITY, " "), r"(?U)\s+", " "), " .:-*|")
    return F.when(bare == "", c).otherwise(title(bare))


def text_of(words: Column, by_line: bool = False) -> Column:
    """Words in their lines: lines in order, joined by a space or a line feed."""
    lines = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.coalesce(w["line"], F.lit(0)))))
    joined = F.transform(lines, lambda k: F.array_join(F.transform(F.filter(words, lambda w: F.coalesce(w["line"], F.lit(0)) == k), lambda w: w["text"]), " "))
    return F.array_join(joined, "\n" if by_line else " ")


def in_script(c: Column, language: str) -> Column:
    """At least three distinct letters, four fifths of them in the language's block."""
    first, last = SCRIPTS[language]
    letters = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{L}"), 0))
    own = F.filter(letters, lambda x: (x >= first) & (x <= last))
    return F.coalesce((F.size(letters) >= 3) & (F.size(own) >= 0.8 * F.size(letters)), F.lit(False))


def logical_order(c: Column) -> Column:
    """The vowel sign U+093F after its consonant."""
    return F.regexp_replace(c, "ि([क-ह\\u0958-\\u095f]़?)", "$1ि")


def percent_floor(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(F.lit(0)).cast("long")


def format_bytes(n: Column) -> Column:
    """1 decimal below 10 units, none above; bytes whole."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1024**k)
        out = F.when(n >= 1024**k, F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v)), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_money(amount: Column, currency: str = "$") -> Column:
    """Two decimals; an amount above zero that would show as nothing is under 0.01."""
    small = (amount > 0) & (amount < 0.005)
    return F.when(small, F.lit(f"under {currency}0.01")).otherwise(F.concat(F.lit(currency), F.format_string("%.2f", amount.cast("double"))))


def to_inr(amount: Column, rate: float = 88.0) -> Column:
    return amount * F.lit(rate)
