"""Scalar functions as Column expressions: all stay in the JVM, but for NFKC, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schemas

#: Suffixes and what they hold.
CODE_SUFFIXES = {
    ".py": "python",
    ".java": "java",
    ".php": "php",
    ".cs": "csharp",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".go": "go",
    ".rs": "rust",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
    ".dart": "dart",
    ".sql": "sql",
    ".scala": "scala",
    ".ps1": "powershell",
    ".psm1": "powershell",
}
DOCUMENT_SUFFIXES = (".md", ".mdx", ".txt", ".rst")
PDF_SUFFIXES = (".pdf",)
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".gif")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".webm")
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".gif": "image/gif"}
NOISE_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".vscode", ".skein-out")
SENSITIVE_DIRS = ("secret", "secrets", "confidentiel", "confidential", "private", "credentials", "credential", "internal", "interne", "rh", "hr")
SECRET_PATTERNS = (r"-----BEGIN (RSA )?PRIVATE KEY-----", r"api[_-]?key\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}", r"password\s*[:=]\s*['\"][^'\"]{4,}")
SCANNED_SUFFIXES = (".md", ".txt", ".py", ".js", ".ts", ".json", ".yaml", ".yml")
SCANNED_CHARS = 200_000
CONFIDENCE_WEIGHTS = {schemas.EXTRACTED: 1.0, schemas.INFERRED: 0.6, schemas.AMBIGUOUS: 0.3}
OTHER_WEIGHT = 0.5
WORD = "[A-Za-z_][A-Za-z0-9_]*"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def slug(text: Column, ascii_only: bool = False) -> Column:
    """Lower-case letters and digits joined by single underscores; 'x' if none are left.

    ``ascii_only`` promises that compatibility forms don't occur, which keeps the expression in the JVM."""
    whole = text if ascii_only else nfkc(text)
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(whole), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("x"))


def make_id(*parts: Column, ascii_only: bool = False) -> Column:
    """Slugs of the parts that aren't empty, joined by underscores."""
    return F.concat_ws("_", *[F.when(p.isNotNull() & (p != ""), slug(p, ascii_only)) for p in parts])


def normalize_identifier(name: Column) -> Column:
    """camelCase, PascalCase, snake_case and kebab-case in one form."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")), "[^a-z0-9]+", "_"), F.lit("_"))


def simple_label(label: Column) -> Column:
    return F.btrim(label, F.lit("()."))


def last_component(module: Column) -> Column:
    return F.trim(F.element_at(F.split(F.replace(module, F.lit("\\"), F.lit(".")), r"\."), -1))


def module_path(path: Column) -> Column:
    """Dotted module name of a relative path: without its last suffix."""
    return F.translate(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""), "/\\", "..")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))


def headings(text: Column) -> Column:
    """Heading lines' (level, title), in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?md)^(#{1,6}\s+.+)$"), F.lit(1))
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(h, r"(?sd)^#+\s+(.*)$", 1)).alias("title")))


def backticks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"`({WORD})`"), F.lit(1))


def clock(seconds: Column) -> Column:
    """mm:ss"""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def confidence_weight(confidence: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in CONFIDENCE_WEIGHTS.items():
        out = F.when(confidence == name, F.lit(weight)).otherwise(out)
    return out


def media_type(path: Column) -> Column:
    out = F.lit("image/png")
    for s, kind in MEDIA_TYPES.items():
        out = F.when(F.lower(suffix(path)) == s, kind).otherwise(out)
    return out


def file_modality(path: Column) -> Column:
    s = F.lower(suffix(path))
    return (
        F.when(s.isin(*CODE_SUFFIXES), "code")
        .when(s.isin(*DOCUMENT_SUFFIXES), "document")
        .when(s.isin(*PDF_SUFFIXES), "pdf")
        .when(s.isin(*IMAGE_SUFFIXES), "image")
        .when(s.isin(*VIDEO_SUFFIXES), "video")
    )


def file_language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODE_SUFFIXES.items() for x in kv]), F.lower(suffix(path)))


def is_noise(path: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in (*NOISE_DIRS, *extra)]))


def dir_is_sensitive(path: Column, extra: tuple[str, ...] = ()) -> Column:
    keywords = F.array(*[F.lit(x) for x in (*SENSITIVE_DIRS, *(e.lower() for e in extra))])
    return F.arrays_overlap(F.transform(F.split(path, "/"), F.lower), keywords)


def content_looks_secret(text: Column) -> Column:
    return F.rlike(F.substring(text, 1, SCANNED_CHARS), F.lit("|".join(f"(?:{p})" for p in SECRET_PATTERNS)))


def security(path: Column, text: Column, extra: tuple[str, ...] = ()) -> Column:
    """struct(force_local, reason)"""
    both = lambda local, reason: F.struct(F.lit(local).alias("force_local"), F.lit(reason).alias("reason"))
    scanned = suffix(path).isin(*SCANNED_SUFFIXES) & F.coalesce(content_looks_secret(text), F.lit(False))
    return F.when(dir_is_sensitive(path, extra), both(True, "sensitive folder")).when(scanned, both(True, "secret in content")).otherwise(both(False, "no sign of sensitivity"))


def parse_reply(raw: Column) -> Column:
    """A provider's JSON reply, without code fences, as struct(entities, relations); anything else is an empty reply."""
    kind = "struct<entities:array<struct<name:string,type:string>>,relations:array<struct<source:string,target:string,relation:string>>>"
    bare = F.trim(raw)
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, "^`+[^\n]*\n?", ""), "`+$", "")).otherwise(bare)
    parsed = F.from_json(bare, kind)
    none = lambda of: F.from_json(F.lit("[]"), of)
    return F.struct(
        F.coalesce(parsed["entities"], none("array<struct<name:string,type:string>>")).alias("entities"),
        F.coalesce(parsed["relations"], none("array<struct<source:string,target:string,relation:string>>")).alias("relations"),
    )


def fallback_answer(context: Column, reason: str = "no provider") -> Column:
    """The answer without a provider: the context itself, cut at a line end after 800 characters."""
    text = F.trim(context)
    head = F.substring(text, 1, 800)
    cut = F.concat(F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, "\n[^\n]*\\z", "")).otherwise(head), F.lit("\n[...]"))
    shown = F.when(F.length(text) > 800, cut).otherwise(text)
    return F.when(text == "", F.lit("Nothing in the graph bears on this question.")).otherwise(F.concat(F.lit(f"From the graph ({reason}):\n\n"), shown))
