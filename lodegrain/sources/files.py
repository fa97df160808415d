"""Project folders as DataFrames: walking, admission, reading and image records.

Paths are judged before contents are read: ``binaryFile`` prunes the content column and filters on size, so a
rejected file costs a listing entry.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrain.functions import text as T
from lodegrain.interface.settings import INDEX_DIR

LARGEST, LARGEST_IMAGE, SNIFFED = 1_000_000, 10 * 1024 * 1024, 1024
#: Extensions and whole names that are read, images, and folders and files that are not.
EXTENSIONS = (
    "py", "js", "jsx", "ts", "tsx", "go", "java", "cpp", "c", "cs", "rs", "rb", "php", "swift", "kt", "scala", "r", "m", "h", "hpp",
    "html", "htm", "css", "sh", "bash", "zsh", "fish", "md", "markdown", "rst", "txt", "adoc", "asciidoc",
    "json", "yaml", "yml", "toml", "ini", "xml", "con", "config", "conf", "cfg", "service", "nginx", "sql",
)
IMAGES = ("png", "jpg", "jpeg", "gif", "webp")
NAMES = ("README", "LICENSE", "CHANGELOG", "AUTHORS", "CONTRIBUTING", "TODO", "NOTES", "Dockerfile", "Makefile")
EXCLUDED = ("__pycache__", ".git", INDEX_DIR, ".venv", "node_modules", "venv", "env", "dist", "build", "target", ".idea", ".vscode", ".pytest_cache", "egg-info", ".DS_Store")
#: Signs of code or configuration in the first bytes of a file without extension.
CODE_SIGNS = ("#!/usr/bin/env python", "#!/usr/bin/python", "#!.*python", "import ", "from ", "def ", "class ", "if __name__", "function ", "var ", "const ", "let ", "package main", "public class", "private class", "public static void")
CONFIG_SIGNS = ("#!/bin/bash", "#!/bin/sh", "[", "version =", "name =", "description =", "author =", "<configuration>", "<?xml")


def _any(cond) -> Column:
    out = F.lit(False)
    for c in cond:
        out = out | c
    return out


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def excluded(path: Column) -> Column:
    """A path that holds an excluded text anywhere (so ``env`` rules out ``environment/`` too)."""
    return _any(F.contains(path, F.lit(p)) for p in EXCLUDED)


def named_in(path: Column) -> Column:
    return T.file_extension(path).isin(*(f".{e}" for e in EXTENSIONS)) | file_name(path).isin(*NAMES)


def is_image(path: Column) -> Column:
    return T.file_extension(path).isin(*(f".{e}" for e in IMAGES))


def sniffed(content: Column) -> Column:
    """The first bytes are UTF-8 and hold a sign of code or configuration."""
    head = F.substring(content, 1, SNIFFED).cast("string")
    low = F.lower(head)
    return F.is_valid_utf8(head) & _any(F.contains(low, F.lit(s)) for s in (*CODE_SIGNS, *CONFIG_SIGNS))


def admitted(path: Column, size: Column, content: Column) -> Column:
    """Size, then exclusion, then names, then a look into files without extension."""
    bare = (T.file_extension(path) == "") & ~F.startswith(file_name(path), F.lit("."))
    return (size <= LARGEST) & ~excluded(path) & (named_in(path) | (bare & sniffed(content)))


def decoded(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(file_path relative to ``root``, path, length, modificationTime, content) of all files below it.

    Excluded folders are left out of the listing, so nothing below them is listed or read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = store.makeQualified(at).toString().rstrip("/")

    def parts(folder) -> tuple[bool, list[str]]:
        """Whether nothing below is excluded; the largest folders of that kind, and the files beside excluded ones."""
        whole, found, files = True, [], []
        for s in store.listStatus(folder):
            path = s.getPath()
            if not s.isDirectory():
                files.append(path.toString())
            elif any(x in path.toString().removeprefix(top) for x in EXCLUDED):
                whole = False
            else:
                own, below = parts(path)
                whole, found = whole and own, found + below
        return whole, [folder.toString()] if whole else found + files

    _, paths = parts(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths or root)
    files = files if paths else files.where("false")
    base = F.lit(re.sub("^[a-z]+:/*", "/", top))
    return files.withColumn("file_path", F.regexp_replace(F.substr(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 1), "^/+", ""))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content, size, mtime, hash) of the text files below ``root`` that are admitted, as
    :func:`lodegrain.operators.index.index_files` takes them."""
    return admitted_files(scan(spark, root))


def admitted_files(files: DataFrame) -> DataFrame:
    """The same of (file_path, length, modificationTime, content) rows."""
    able = files.where(F.col("length") <= LARGEST).where(admitted(F.col("file_path"), F.col("length"), F.col("content")) & ~is_image(F.col("file_path")))
    return able.select("file_path", decoded(F.col("content")).alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))


def image_records(files: DataFrame) -> DataFrame:
    """One chunk per image of at most 10 MB, by its name and folder; (file_path, length) are read."""
    path, name = F.col("file_path"), file_name(F.col("file_path"))
    parent = F.regexp_extract(path, "([^/]*)/[^/]*$", 1)
    stem = T.file_stem(path)
    kb = F.format_string("%.0f", F.bround(F.col("length") / 1024, 0))
    return files.where(is_image(path) & (F.col("length") <= LARGEST_IMAGE) & ~excluded(path)).select(
        "file_path", F.concat(stem, F.lit("_img_0")).alias("chunk_id"), F.concat(F.lit("[Image: "), name, F.lit("] "), parent, F.lit("/"), name, F.lit(" ("), kb, F.lit("KB)")).alias("content"),
        F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("image").alias("chunk_type"), name.alias("name"), F.lit("image").alias("language"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"),
    )


def data_uri(path: Column, content: Column) -> Column:
    """An image as a data URI, as multimodal embedding services take it."""
    kind = F.regexp_replace(F.substr(T.file_extension(path), F.lit(2)), "^jpg$", "jpeg")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))


def watchable(path: Column, size: Column) -> Column:
    """Admission of a watcher: small, no hidden or temporary name, not excluded, of a known kind."""
    name = file_name(path)
    temporary = name.rlike(r"^[.~]|\.(tmp|swp|lock)$")
    return (size <= 1024 * 1024) & ~temporary & ~excluded(path) & named_in(path)
