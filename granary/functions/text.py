"""Scalar text functions as column expressions: normalising, hashing, splitting, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations written out, in this order, wherever the letters stand.
ABBREVIATIONS = (("N°", "Numero"), ("n°", "numero"), ("N.", "Numero"), ("n.", "numero"), ("impostaz.", "impostazione"), ("config.", "configurazione"), ("parametr.", "parametro"))
#: Character references, in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
UI_PATHS = (r"(?i)Menu\s*>\s*(.+?)(?:\.|$)", r"(?i)Vai\s+a\s*:\s*(.+?)(?:\.|$)", r"(?i)Percorso\s*:\s*(.+?)(?:\.|$)", r'(?i)(?:Sezione|Menu)\s*"([^"]+)"')
ERROR_CODE = r"\b[A-Z]{2,4}-?\d{2,4}\b"
PRIVATE_HOST = r"^(localhost|127\..*|192\.168\..*|10\..*|172\.(1[6-9]|2[0-9]|3[01])\..*)$"
EDGES = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, EDGES, "")


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def normalize_text(text: Column) -> Column:
    """White space runs to one space, runs of dots to three, abbreviations written out."""
    return replaced(F.regexp_replace(F.regexp_replace(stripped(text), r"(?U)\s+", " "), r"\.{2,}", "..."), ABBREVIATIONS)


def content_hash(text: Column) -> Column:
    return F.sha1(F.encode(normalize_text(text), "UTF-8"))


def estimate_tokens(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(chars_per_token)).cast("int"))


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    """At most so many tokens' characters, back to the last space if that is past 80 %, and an ellipsis."""
    most = tokens * 4
    cut = F.substring(text, 1, most)
    last = F.when(F.instr(cut, " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(F.lit(-1))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(last > most * 0.8, F.left(cut, last)).otherwise(cut), F.lit("...")))


def split_sentences(text: Column) -> Column:
    """Sentences with their end marks, over ten characters long; an unended tail is left out.

    A sentence ends where a blank follows an end mark, which a cut finds in one pass over a text of any length.
    """
    ended = F.filter(F.split(text, r"(?<=[.!?])\s"), lambda s: s.rlike(r"[.!?]\z"))
    return F.filter(F.transform(ended, stripped), lambda s: F.length(s) > 10)


def split_paragraphs(text: Column, longer_than: int = 20) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), stripped), lambda p: F.length(p) > longer_than)


def error_codes(text: Column) -> Column:
    """Different codes in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(ERROR_CODE), F.lit(0)))


def clean_tags(html: Column) -> Column:
    return replaced(F.regexp_replace(html, "<[^>]+>", ""), ENTITIES)


def ui_path(text: Column) -> Column:
    """The first path that a pattern finds, its parts joined by `` > ``; null if there is none."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in UI_PATHS])
    return F.regexp_replace(stripped(found), r"\s*>\s*", " > ")


def title_case(text: Column) -> Column:
    """A capital after anything that is not a letter, small letters elsewhere (``O'neil`` gives ``O'Neil``)."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"\p{L}"), F.upper(c)).otherwise(F.lower(c))), "")


def breadcrumbs(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: title_case(F.translate(p, "_-", "  ")))


def anchor(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), "^-+|-+$", "")


def module_of(title: Column) -> Column:
    return F.regexp_extract(title, r"(?iU)(Contabilità|Fatturazione|Magazzino|HR|Desktop\w+)", 1)


def version_of(title: Column) -> Column:
    return F.regexp_extract(title, r"(?i)v?(\d+\.\d+(?:\.\d+)?)", 1)


def host_of(url: Column) -> Column:
    """Lower-case host without port and a leading ``www.``; null without a scheme."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def url_allowed(url: Column, domains: tuple[str, ...]) -> Column:
    host = host_of(url)
    listed = F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return F.coalesce(host.rlike(PRIVATE_HOST) | listed, F.lit(False))


def url_extension(url: Column, content_type: Column) -> Column:
    """The suffix of the path, else that of the content type."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    suffix = F.nullif(F.regexp_extract(path, r"(\.[^./]+)$", 1), F.lit(""))
    kind = F.lower(content_type)
    return F.coalesce(suffix, F.when(F.contains(kind, F.lit("pdf")), F.lit(".pdf")).when(F.contains(kind, F.lit("html")), F.lit(".html")).otherwise(F.lit(".txt")))


def url_hash(url: Column) -> Column:
    return F.left(F.md5(url), F.lit(12))


def image_file_stem(image_id: Column) -> Column:
    """``{hash}_p{page}_i{index}`` to ``page_{page + 1}_img_{index}``, ``{hash}_img_{index}`` to ``img_{index}``, else empty."""
    page, index, plain = (F.regexp_extract(image_id, p, 1) for p in (r"_p(\d+)_i\d+$", r"_p\d+_i(\d+)$", r"_img_(\d+)$"))
    return F.when(page != "", F.concat(F.lit("page_"), (page.try_cast("long") + 1).cast("string"), F.lit("_img_"), index)).when(plain != "", F.concat(F.lit("img_"), plain)).otherwise(F.lit(""))


def image_id(source_hash: Column, stem: Column) -> Column:
    page, index, plain = (F.regexp_extract(stem, p, 1) for p in (r"^page_(\d+)_img_\d+$", r"^page_\d+_img_(\d+)$", r"^img_(\d+)$"))
    return F.when(page != "", F.concat(source_hash, F.lit("_p"), (page.try_cast("long") - 1).cast("string"), F.lit("_i"), index)).when(plain != "", F.concat(source_hash, F.lit("_img_"), plain)).otherwise(F.lit(""))


def preprocess_html(html: Column, most_chars: int = 500_000) -> Column:
    """Cut first, then without comments, scripts, styles, drawings and frames."""
    out = F.regexp_replace(F.substring(html, 1, most_chars), r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "svg", "iframe"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return out


def html_title(html: Column) -> Column:
    return stripped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Characters that no text of a page document keeps, and its page numbers.
UNWANTED, PAGE_NUMBER = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF]", r"^\d+$"


def clean_pdf_text(text: Column) -> Column:
    """Without control and upper Latin-1 characters, page numbers and short lines without a letter; one line."""
    plain = F.regexp_replace(text, UNWANTED, "")
    lines = F.transform(F.split(plain, "\n"), stripped)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER) & ((F.length(x) >= 5) | x.rlike("[A-Za-z]")))
    return normalize_text(F.array_join(kept, "\n"))


def url_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), stripped), lambda u: u != "")
