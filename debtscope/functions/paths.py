"""Paths, repository addresses and file-name slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders left out when a local tree is walked.
TREE_SKIP = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build")

# Folders left out when repository blobs are listed.
BLOB_SKIP = (
    "node_modules",
    "venv",
    "env",
    "__pycache__",
    ".git",
    "build",
    "dist",
    "target",
    "vendor",
    ".github",
)


def below(path: Column, root: str) -> Column:
    """The part of a listed path that lies below a root folder."""
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    at = F.instr(path, F.lit(plain))
    return F.when(at > 0, F.substr(path, at + len(plain))).otherwise(path)


def in_skipped_tree(path: Column) -> Column:
    """A part of the path, the file name included, is a skipped folder."""
    return F.exists(F.split(path, "/"), lambda part: part.isin(*TREE_SKIP))


def in_skipped_blob_folder(path: Column) -> Column:
    """A parent folder of the path is hidden or skipped."""
    parts = F.split(path, "/")
    parents = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(parents, lambda part: part.startswith(".") | part.isin(*BLOB_SKIP))


def repository_address(url: Column, host: str = r"github\.com") -> Column:
    """Owner, repository, branch and path of an address; null when it fits neither form."""
    plain = rf"{host}/([^/]+)/([^/]+?)(?:\.git)?/?$"
    inner = rf"{host}/([^/]+)/([^/]+?)/tree/([^/]+)/([^/]+)"

    def piece(plain_group: int, inner_group: int) -> Column:
        return F.when(url.rlike(plain), F.regexp_extract(url, plain, plain_group)).otherwise(
            F.regexp_extract(url, inner, inner_group)
        )

    record = F.struct(
        piece(1, 1).alias("owner"),
        F.regexp_replace(piece(2, 2), r"\.git$", "").alias("repo"),
        F.when(url.rlike(plain), "main").otherwise(F.regexp_extract(url, inner, 3)).alias("branch"),
        F.when(url.rlike(plain), "").otherwise(F.regexp_extract(url, inner, 4)).alias("path"),
        url.alias("url"),
    )
    return F.when(url.rlike(plain) | url.rlike(inner), record)


def query_slug(query: Column) -> Column:
    """Search query as a file-name part: no quotes, colons or blanks, 50 characters and a hash of the whole query."""
    return F.concat_ws("-", F.substring(F.translate(query, ': "', "__"), 1, 50), F.substring(F.md5(query), 1, 8))
