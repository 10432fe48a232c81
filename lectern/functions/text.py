"""Text, URL and HTML functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import CORE_TERMS, PROBE_PATHS

WIDE = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
SPACE = r"[ \t\r\n\f\x0b]+"


def words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def count_class(c: Column, chars: str) -> Column:
    """How many characters of a class stand in c."""
    return F.length(F.regexp_replace(c, f"[^{chars}]", ""))


def approx_tokens(c: Column, lang: Column) -> Column:
    """East Asian: wide characters and Latin words; others: words by 1.3, rounded down."""
    wide = count_class(c, WIDE) + F.regexp_count(c, F.lit("[A-Za-z]+"))
    return F.when(lang.startswith("zh") | lang.isin("ja", "ko"), wide).otherwise(F.floor(word_count(c) * F.lit(1.3)).cast("int"))


def detect_language(c: Column, fallback: str = "und") -> Column:
    """Language from the scripts and letters of the first 2000 characters."""
    s = F.trim(F.substring(c, 1, 2000))
    more = lambda chars: count_class(s, chars) > 30
    has = lambda chars: s.rlike(f"[{chars}]")
    return (
        F.when(F.coalesce(F.length(s), F.lit(0)) == 0, fallback)
        .when(more(r"\x{4E00}-\x{9FFF}"), "zh").when(more(r"\x{3040}-\x{30FF}"), "ja").when(more(r"\x{AC00}-\x{D7AF}"), "ko")
        .when(has("äöüÄÖÜß"), "de").when(has("ñáéíóúü¿¡"), "es").when(has("ãõçáéíóúâêô"), "pt").when(has("àâçéèêëîïôûùü"), "fr")
        .otherwise(fallback)
    )


def damage_score(c: Column) -> Column:
    """Share of replacement, control and private-use characters; 1 for empty text."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 1.0).otherwise(count_class(c, r"\x01-\x1F\x7F-\x{9F}\x{E000}-\x{F8FF}\x{FFFD}") / F.length(c))


def any_term(c: Column, terms=CORE_TERMS) -> Column:
    """Whether one of the terms stands in c, whatever its case."""
    low = F.lower(c)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms]), F.lit(False))


def distinct_terms(c: Column, terms: Column) -> Column:
    """How many of an array of terms stand in c, whatever the case."""
    low = F.lower(c)
    return F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))


def keyword_dense(c: Column, terms: Column, least: Column) -> Column:
    """Enough of the language's terms and a core term; false without terms."""
    return F.coalesce((F.size(terms) > 0) & (distinct_terms(c, terms) >= least) & any_term(c), F.lit(False))


def host(url: Column) -> Column:
    """Host of a URL in lower case, without port, user and a leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def probe_urls(base: Column) -> Column:
    """The paths under which a policy may stand, below a site."""
    root = F.regexp_replace(base, "/+$", "")
    return F.array(*[F.concat(root, F.lit(p)) for p in PROBE_PATHS])


def html_text(c: Column, furniture: bool = False) -> Column:
    """Text without scripts, styles and tags, white space collapsed; with ``furniture`` also without nav and footer."""
    blocks = ["script", "style"] + (["nav", "footer"] if furniture else [])
    for b in blocks:
        c = F.regexp_replace(c, f"(?is)<{b}[^>]*>.*?</{b}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]+>", " "), SPACE, " "))


def html_title(c: Column) -> Column:
    """The first title, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_charset(c: Column) -> Column:
    """The charset a page names in its first 4096 characters, utf-8 if none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.substring(c, 1, 4096), r"(?i)<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)", 1)), F.lit("")), F.lit("utf-8"))


ANCHOR = r"(?i)<a\s+[^>]*href=\"([^\"#?]+)\"[^>]*>([^<]{1,200})</a>"


def anchors(c: Column) -> Column:
    """Links of a page as structs ``href`` and ``label``."""
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(2)).alias("label"))


def absolute_links(c: Column) -> Column:
    """Absolute links in their order, each once, entities decoded."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"href=\"(https?://[^\"#?]+)\""), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def secondary_languages(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[+]"), lambda x: F.trim(x)), lambda x: x != "")


def query_tokens(c: Column) -> Column:
    """Words of a search query, split at white space and East Asian commas, of two letters or more."""
    return F.filter(F.split(F.lower(c), r"[\s,，、；]+"), lambda w: F.length(w) >= 2)


def hex_mod(digest: Column, n: int) -> Column:
    """A hexadecimal digest modulo n, digit by digit."""
    digits = F.transform(F.split(digest, ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda x: x.isNotNull()), F.lit(0), lambda acc, h: ((acc * 16 + h) % n).cast("int"))


def archive_id(sha: Column, fallback: Column, url: Column) -> Column:
    """The hash of a document, or what stands in for it; an empty string counts as missing."""
    return F.coalesce(F.nullif(sha, F.lit("")), F.nullif(fallback, F.lit("")), F.sha2(url, 256))


def chunk_id(institution: Column, sha: Column, seq: Column) -> Column:
    return F.format_string("%s_%s_%03d", institution, F.substring(sha, 1, 8), seq)


PARAGRAPH = r"\n[ \t\r\f\x0b]*\n[ \t\r\f\x0b\n]*"


def paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, PARAGRAPH), lambda p: F.regexp_replace(p, r"^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$", "")), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Sentences: cut after closing marks that white space follows, or after East Asian ones."""
    marked = F.regexp_replace(c, r"([.!?。！？])[ \t\r\n\f\x0b]+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")
