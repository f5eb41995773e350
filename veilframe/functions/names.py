"""File names, paths and map names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted extensions and their MIME types.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "rtf": "application/rtf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "txt": "text/plain",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "heic": "image/heic",
    "heif": "image/heif",
}
OTHER_MIME = "application/octet-stream"
DOCUMENTS = tuple(MIME)
#: Extensions that each file action takes.
ACTIONS = {
    "anonymize": DOCUMENTS,
    "markdown": DOCUMENTS,
    "ocr": tuple(e for e in DOCUMENTS if e != "txt"),
    "restore": ("txt", "md", "docx", "pdf"),
    "metadata": ("pdf", "docx", "xlsx", "pptx", "odt", "ods", "odp", "png", "jpg", "jpeg", "jpe", "heic", "heif", "tif", "tiff"),
}
RESTORED, RESULT, MAP = "_restored", "_anon", "_anon_map"
FALLBACK_NAME = "dokument"


def extension(name: Column) -> Column:
    """Lower-case text behind the last dot of the last path part, empty without one."""
    return F.lower(F.regexp_extract(name, r"[^./\\]\.([^./\\]+)$", 1))


def is_supported(name: Column) -> Column:
    return extension(name).isin(*DOCUMENTS)


def mime_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit(OTHER_MIME))


def action_applies(action: Column, paths: Column) -> Column:
    """Every path has an extension that the action takes; false without paths and for unknown actions."""
    out = F.lit(False)
    for name, allowed in ACTIONS.items():
        out = F.when(action == name, (F.size(paths) > 0) & F.forall(paths, lambda p: extension(p).isin(*allowed))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def file_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def base_of(name: Column) -> Column:
    return F.regexp_replace(file_of(name), r"(?<=.)\.[^.]*$", "")


def restored_name(name: Column) -> Column:
    return F.concat(base_of(name), F.lit(f"{RESTORED}."), extension(name))


def safe_base_name(name: Column) -> Column:
    """Without extension, unsafe characters as ``_``, white space collapsed; a default if nothing is left."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^./\\]+$", "")
    plain = F.regexp_replace(plain, r'[<>:"/\\|?*\x00-\x1F]', "_")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.when(plain == "", FALLBACK_NAME).otherwise(plain)


def result_name(base: Column, ext: Column, kind: str = "result") -> Column:
    return F.concat(base, F.lit(f"{MAP if kind == 'map' else RESULT}."), ext)


def normalized_stem(name: Column) -> Column:
    """Lower-case base name without a copy number and without the endings of our own files."""
    stem = F.regexp_replace(file_of(name), r"\.[^.]+$", "")
    stem = F.regexp_replace(F.trim(F.lower(stem)), r" \([0-9]+\)$", "")
    for ending in (RESTORED, MAP, RESULT):
        stem = F.regexp_replace(stem, f"{ending}$", "")
    return stem


def link_strength(file: Column, names: list[Column]) -> Column:
    """0 without a link; equal stems beat any prefix, longer prefixes shorter ones."""
    stem = normalized_stem(file)
    out = F.lit(0)
    for name in names:
        linked = normalized_stem(F.coalesce(name, F.lit("")))
        size = F.length(linked)
        strength = F.when(size < 3, 0).when(stem == linked, size + 1_000_000).when(stem.startswith(F.concat(linked, F.lit("_"))) | stem.startswith(F.concat(linked, F.lit(" "))), size).otherwise(0)
        out = F.greatest(out, strength)
    return out.cast("long")


def preview_kind(kind: Column) -> Column:
    return (
        F.when(kind.isin("pdf", "docx"), kind).when(kind.isin("png", "jpg", "jpeg", "heic"), "image").when(kind.isin("xlsx", "ods", "pptx", "odp", "odt"), "office")
    )


def legacy_extension(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return F.when(ext.isin("doc", "rtf"), ext)


def own_export_kind(kind: Column) -> Column:
    return F.when(kind.isin("xlsx", "pptx", "odt", "ods", "odp"), kind).when(kind.isin("png", "jpg", "heic"), "image")
