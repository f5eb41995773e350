"""Codes, notices and warnings as columns.  Wording is ours, in English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of removed metadata.
METADATA = {
    "document_properties": "document properties",
    "authors": "authors of comments and changes",
    "revision_ids": "editing session ids",
    "thumbnail": "page thumbnail",
    "custom_properties": "custom properties",
    "file_paths": "file and template paths",
    "printer_settings": "printer settings",
    "pdf_info": "PDF information",
    "pdf_xmp": "XMP metadata",
    "pdf_history": "earlier versions in the file",
    "exif": "EXIF data",
    "gps": "GPS position",
    "xmp": "XMP metadata",
    "iptc": "IPTC data",
    "image_comments": "image descriptions",
    "trailing_data": "data behind the image",
    "stored_versions": "stored versions",
}
#: Codes of what happened to pictures.
PICTURES = {
    "pictures_redacted": "Personal data on pictures was painted over.",
    "pictures_replaced": "A picture that could not be cleaned was replaced.",
    "pictures_not_checked": "Some pictures are in a format that was not read; check them.",
}
UNREAD_SHOWN = 10
#: Our own tokens, and what an assistant makes of them: a blank or dash before the number, or any case.
TOKEN = r"\[[A-ZĄĆĘŁŃÓŚŹŻ]+(?:_[A-ZĄĆĘŁŃÓŚŹŻ]+)*_[0-9]+\]"
MANGLED = r"\[[A-ZĄĆĘŁŃÓŚŹŻ]{2,}(?:[ _-][A-ZĄĆĘŁŃÓŚŹŻ]+)*[ -][0-9]+\]"
ANY_CASE = r"\[[A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]+(?:[ _-][A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]+)*[ _-][0-9]+\]"


def split_codes(header: Column) -> Column:
    """Comma-separated codes without empty ones; null reads as none."""
    return F.filter(F.split(F.coalesce(header, F.lit("")), ","), lambda x: x != "")


def metadata_labels(codes: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in METADATA.items() for x in pair])
    return F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), c)))


def picture_notice(codes: Column) -> Column:
    """Known notices joined by blanks; counted ones carry their number; null if none is known."""
    table = F.create_map(*[F.lit(x) for pair in PICTURES.items() for x in pair])

    def one(code):
        faces, second = (F.regexp_extract(code, f"^{name}:([0-9]+)$", 1) for name in ("faces_masked", "second_engine_masks"))
        return F.when(faces != "", F.concat(F.lit("Faces painted over: "), faces, F.lit("."))).when(second != "", F.concat(F.lit("Values painted over after a second reading: "), second, F.lit("."))).otherwise(F.try_element_at(table, code))

    found = F.filter(F.transform(codes, one), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def unread_pages(pages: Column) -> Column:
    """The first ten pages and how many more; null without any."""
    shown = F.array_join(F.slice(pages, 1, UNREAD_SHOWN), ", ")
    more = F.size(pages) - UNREAD_SHOWN
    return F.when(F.size(pages) > 0, F.concat(F.lit("Pages without text that was read: "), shown, F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")))


def parse_warnings(header: Column) -> Column:
    """Percent-encoded JSON array to its strings; anything malformed gives none."""
    # a plus is a plus here, unlike in form encoding
    variant = F.try_parse_json(F.try_url_decode(F.replace(header, F.lit("+"), F.lit("%2B"))))
    items = F.try_variant_get(variant, "$", "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def warned_tokens(warnings: Column) -> Column:
    """Tokens that warnings name, one for each warning at most."""
    found = F.transform(warnings, lambda w: F.regexp_extract(w, r"token (\[[^\]]+\])", 1))
    return F.filter(found, lambda t: t != "")


def unrestorable(text: Column, known: Column) -> Column:
    """Token-like leftovers that the tokens ``known`` cannot restore, in the order of their kind, then text."""
    prefixes = F.transform(known, lambda t: F.upper(F.regexp_replace(t, r"^\[|[_ ]?[0-9]+\]$", "")))

    def prefix(token):
        plain = F.regexp_replace(F.regexp_replace(token, r"^\[|\]$", ""), r"[ _-][0-9]+$", "")
        return F.upper(F.translate(plain, " -", "__"))

    any_case = F.filter(F.regexp_extract_all(text, F.lit(ANY_CASE), F.lit(0)), lambda t: F.array_contains(prefixes, prefix(t)))
    found = F.concat(tokens_in(text), F.regexp_extract_all(text, F.lit(MANGLED), F.lit(0)), any_case)
    return F.array_except(F.array_distinct(found), known)


def token_warning(tokens: Column, subject: str = "file") -> Column:
    """One sentence about unknown tokens, the first ten by name; null without any."""
    n = F.size(tokens)
    noun = F.when(n == 1, F.lit("1 token is")).otherwise(F.concat(n.cast("string"), F.lit(" tokens are")))
    more = F.when(n > UNREAD_SHOWN, F.concat(F.lit(" and "), (n - UNREAD_SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n > 0, F.concat(noun, F.lit(f" left in the {subject} that the map does not know: "), F.array_join(F.slice(tokens, 1, UNREAD_SHOWN), ", "), more, F.lit(".")))


def plural_form(n: Column) -> Column:
    """Polish plural class of a number: one, few or many."""
    few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(n == 1, "one").when(few, "few").otherwise("many")


def render_prompt(body: Column, text: Column) -> Column:
    return F.replace(body, F.lit("{{DOKUMENT}}"), text)


def export_fallback(status: Column) -> Column:
    """Whether a refused export goes on in the simplified layout."""
    return F.coalesce(status.isin(400, 422) | (status >= 500), F.lit(False))


#: Kinds of failures by HTTP status, and the message for each.
ERRORS = {401: "not signed in", 403: "not allowed", 404: "not found", 413: "file too large", 415: "format not supported", 422: "content not accepted", 429: "too many requests"}


def error_message(status: Column) -> Column:
    out = F.when(status.isNull(), "engine not reachable").when(status >= 500, "engine failed")
    for code, message in ERRORS.items():
        out = out.when(status == code, message)
    return out.otherwise("request failed")


def next_status(accepted: Column) -> Column:
    return F.when(accepted > 0, "rejected").otherwise("accepted")
