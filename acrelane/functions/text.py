"""Text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Addresses that stand for none.  Fixed values.
PLACEHOLDERS = ("n/a", "na", "none", "unknown", "null", "-", "--")
#: Words that company names lose anywhere.  Fixed values.
COMPANY_SUFFIXES = (
    "inc", "inc.", "incorporated",
    "corp", "corp.", "corporation",
    "llc", "l.l.c", "l.l.c.", "ltd", "ltd.",
    "co", "co.", "company",
)
#: Spellings of a county road, letter case ignored, in the order in which they are replaced.  Fixed values.
COUNTY_ROADS = (r"\bC\.?\s*R\.?\b", r"\bCo\.?\s*Rd\.?\b", r"\bCty\.?\s*Rd\.?\b", r"\bCounty\s+Rd\b")
TRUE_WORDS, FALSE_WORDS = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")


def blank_null(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def norm_text(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def norm_join_key(c: Column) -> Column:
    """Upper case without white space, hyphens and underscores."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[\s\-_]+", "")


def clean_street(c: Column) -> Column:
    """Street with county-road spellings unified; '' for null, blank and placeholders.  The period of an abbreviation goes if a word follows it
    at once."""
    text = F.coalesce(norm_text(c), F.lit(""))
    clean = text
    for pattern in COUNTY_ROADS:
        clean = F.regexp_replace(clean, f"(?i){pattern}", "County Road")
    return F.when(F.lower(text).isin(*PLACEHOLDERS), "").otherwise(F.coalesce(norm_text(clean), F.lit("")))


def norm_company(c: Column) -> Column:
    """Lower case, only word characters, spaces, & and -, without company suffixes."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s&-]", "")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: ~w.isin(*COMPANY_SUFFIXES) & (w != ""))
    return F.array_join(words, " ")


def normalize_url(c: Column) -> Column:
    """A typed-in address as a URL: a scheme with a single slash becomes https://, which is also put before what has no scheme in small letters; null for
    blank."""
    fixed = F.regexp_replace(blank_null(c), r"^https?:/(?!/)", "https://")
    return F.when(fixed.rlike(r"^https?://"), fixed).otherwise(F.concat(F.lit("https://"), fixed))


def split_site(c: Column) -> Column:
    """struct(site, bid_page_path), null for blank: of a full URL https:// and the host, and what follows the host ('' if nothing does); of any other text
    the whole behind https://, and no path."""
    full = c.startswith("http://") | c.startswith("https://")
    site = F.when(full, F.regexp_replace(c, r"(?i)^https?://([^/]+).*$", "https://$1")).otherwise(F.concat(F.lit("https://"), c))
    path = F.when(full, F.regexp_replace(c, r"(?i)^https?://[^/]+(.*)$", "$1"))
    return F.when(blank_null(c).isNotNull(), F.struct(site.alias("site"), path.alias("bid_page_path")))


def usable_street(c: Column) -> Column:
    """Not a placeholder, and with a digit or six characters at least."""
    text = F.coalesce(F.trim(c), F.lit(""))
    return ~F.lower(text).isin(*PLACEHOLDERS) & (text != "") & (text.rlike("[0-9]") | (F.length(text) >= 6))


def text_fold(texts: Column) -> Column:
    """Texts of an array in order as one, with single spaces: blanks are skipped, of two where one contains the other (case ignored) the containing one
    is kept, the later if they differ in case only, else they are joined by a ruled line."""
    rule = "\n\n---\n\n"

    def step(held, x):
        low_held, low = F.lower(held), F.lower(x)
        return F.when(x.isNull() | (x == ""), held).when(held.isNull(), x).when(F.contains(low, low_held), x).when(F.contains(low_held, low), held).otherwise(F.concat(held, F.lit(rule), x))

    return F.aggregate(F.transform(texts, norm_text), F.lit(None).cast("string"), step)


def longest(texts: Column) -> Column:
    """The longest text of an array; of equal ones the first."""
    return F.aggregate(texts, F.lit(None).cast("string"), lambda held, x: F.when(held.isNull() | (F.length(x) > F.length(held)), x).otherwise(held))


#: Character references that page text is likely to hold.  Fixed values; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, references are read, white space is collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
