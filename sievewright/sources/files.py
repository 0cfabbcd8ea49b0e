"""File sources: directory scans, path safety, file types, decoding, CSV tables."""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 20 << 20
# Folders, names and suffixes that are never read.
EXCLUDED_DIRS = (".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", ".cache", ".pytest_cache", ".mypy_cache")
SECRET_NAMES = (".env", ".env.local", "credentials.json", "token.json", "secrets.json", "id_rsa", "id_ed25519")
KEY_SUFFIXES = "pem|key|p12|pfx|jks"
# File types by suffix, MIME type, explicit name and special file name; languages by suffix.
BY_SUFFIX = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "rst": "text", "py": "code", "js": "code", "jsx": "code", "ts": "code", "tsx": "code", "java": "code", "go": "code", "rs": "code",
    "c": "code", "h": "code", "cpp": "code", "hpp": "code", "sh": "code", "ps1": "code", "sql": "code", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "csv": "csv", "xlsx": "xlsx", "pdf": "pdf",
}
BY_MIME = {
    "text/markdown": "markdown", "text/plain": "text", "text/x-python": "code", "text/javascript": "code", "application/javascript": "code", "application/json": "json", "application/yaml": "yaml", "text/yaml": "yaml",
    "application/toml": "toml", "text/csv": "csv", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/pdf": "pdf",
}
BY_NAME = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "plain": "text", "text": "text", "source": "code", "source_code": "code", "code": "code", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "csv": "csv", "excel": "xlsx", "spreadsheet": "xlsx", "xlsx": "xlsx", "pdf": "pdf",
}
SPECIAL = {"dockerfile": "code", "makefile": "code"}
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "sh": "shell", "ps1": "powershell", "sql": "sql",
}


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside, outside excluded folders, and names no secret or key, whatever the case."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    bad_dir = F.arrays_overlap(parts, F.array(*map(F.lit, (*EXCLUDED_DIRS, "..")))) | low.startswith("/")
    return ~(bad_dir | name.isin(*SECRET_NAMES) | name.startswith(".env.") | name.rlike(rf"[^.]\.(?:{KEY_SUFFIXES})$"))


def _look(x: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in table.items()))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "#", 1), r"[^./\\]\.([A-Za-z0-9]+)$", 1))


def file_type(path: Column, mime: Column | None = None, given: Column | None = None) -> Column:
    """The given type by its names, else that of the MIME type, of a special file name, or of the suffix; binary otherwise."""
    said = _look(F.lower(F.trim(given)), BY_NAME) if given is not None else F.lit(None)
    by_mime = _look(F.lower(F.trim(F.substring_index(mime, ";", 1))), BY_MIME) if mime is not None else F.lit(None)
    return F.coalesce(said, by_mime, _look(F.lower(F.substring_index(path, "/", -1)), SPECIAL), _look(suffix_of(path), BY_SUFFIX), F.lit("binary"))


def language(path: Column) -> Column:
    """The programming language of a path's suffix, or null."""
    return _look(suffix_of(path), LANGUAGES)


def inferred_type(path: Column, media_type: Column, lang: Column) -> Column:
    """A document's file type where no parser said one: by its media type, suffix or language."""
    media, suffix = F.lower(media_type), suffix_of(path)
    return (
        F.when((media == "application/pdf") | (suffix == "pdf"), "pdf").when((media == "text/csv") | (suffix == "csv"), "csv").when(F.contains(media, F.lit("spreadsheetml")) | (suffix == "xlsx"), "xlsx")
        .when(F.contains(media, F.lit("markdown")) | suffix.isin("md", "markdown"), "markdown").when((media == "application/json") | (suffix == "json"), "json")
        .when(F.lower(lang).isin(*sorted({*LANGUAGES.values(), *SPECIAL})), "code").when(suffix.isin("yaml", "yml"), "yaml").when(suffix == "toml", "toml").otherwise("text")
    )


def content_format(media_type: Column) -> Column:
    media = F.lower(media_type)
    return F.when(F.contains(media, F.lit("markdown")), "markdown").when(media == "application/json", "json").when(media == "application/pdf", "pdf-text").otherwise("text")


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path matches an include glob and no exclude glob; a glob matches the whole path or its last parts."""

    def any_of(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            whole = fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$")
            out |= path.rlike("^" + whole) | path.rlike("^(?:.*/)?" + whole)
        return out

    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def decode(raw: bytes | None) -> str | None:
    """UTF-16 with a mark, else UTF-8, else GB 18030; null for binary content."""
    if raw is None:
        return None
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = raw.decode("utf-16", "strict")
    elif b"\0" in raw:
        return None
    else:
        try:
            text = raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            try:
                text = raw.decode("gb18030")
            except UnicodeDecodeError:
                return None
    return None if any(ord(c) < 32 and c not in "\t\n\r\f" for c in text) else text


def directory(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(relative_path, file_type, size, content, skipped): every safe file; too large or binary ones say why they are skipped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace(".", r"\."), "")

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(decode)

    kept = rows.select(path.alias("relative_path"), F.col("length").alias("size"), "content")
    kept = kept.where(safe_path(F.col("relative_path")) & included(F.col("relative_path"), include or [], exclude or []))
    large = F.col("size") > max_bytes
    read = kept.withColumn("content", text(F.when(~large, F.col("content"))))
    return read.select("relative_path", file_type(F.col("relative_path")).alias("file_type"), "size", "content", F.when(large, "large").when(F.col("content").isNull(), "binary").alias("skipped"))


def table_markdown(text: str) -> tuple[str, int]:
    """(Markdown table, rows with the header) of CSV text; ragged rows are padded, line ends in cells become <br>."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    width = max(map(len, rows), default=0)
    cell = lambda x: x.replace("\r\n", "\n").replace("\r", "\n").replace("|", r"\|").replace("\n", "<br>").strip()
    lines = ["| " + " | ".join(map(cell, r + [""] * (width - len(r)))) + " |" for r in rows]
    if lines:
        lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines), len(rows)


def csv_documents(files: DataFrame) -> DataFrame:
    """(relative_path, content, row_count) of CSV files as Markdown tables."""

    @F.pandas_udf("content string, row_count int")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([table_markdown(v or "") for v in values], columns=["content", "row_count"])

    return files.where("file_type = 'csv'").select("relative_path", run("content").alias("x")).select("relative_path", "x.*")
