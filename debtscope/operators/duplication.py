"""Repeated line blocks inside one file.

All work stays inside the row of a file until only repeated blocks are left,
so no source text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.functions.rows import let, round_to
from debtscope.functions.scores import duplication_score
from debtscope.functions.text import split_lines, strip

# A line that opens with one of these says nothing about cloning.
TRIVIAL_STARTS = ("#", "//", "import ", "from ")


def telling_line(line: Column) -> Column:
    """A stripped line that is neither empty, a comment nor an import."""
    telling = F.length(line) > 0
    for start in TRIVIAL_STARTS:
        telling = telling & ~line.startswith(start)
    return telling


def window_hashes(lines: Column, min_block: int = 4, window: int = 6) -> Column:
    """Start position and MD5 of every telling window of stripped lines."""
    needed = min_block // 2

    def windows(clean: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(clean) - window)
        return F.transform(starts, lambda i: F.struct(F.slice(clean, i + 1, window).alias("body"), i.alias("pos")))

    def hashed(item: Column) -> Column:
        return F.struct(F.md5(F.array_join(item["body"], "\n")).alias("hash"), item["pos"].alias("pos"))

    telling = let(
        F.transform(lines, strip),
        lambda clean: F.transform(
            F.filter(windows(clean), lambda w: F.size(F.filter(w["body"], telling_line)) >= needed), hashed
        ),
    )
    none = F.array().cast("array<struct<hash:string,pos:int>>")
    return F.when(F.size(lines) >= max(min_block, window), telling).otherwise(none)


def repeated(hashes: Column) -> Column:
    """Of a list of (hash, pos) keep those whose hash occurs twice or more, sorted."""
    return let(
        F.sort_array(hashes),
        lambda s: F.filter(
            s,
            lambda x, i: (x["hash"] == F.get(s, i - 1)["hash"]) | (x["hash"] == F.get(s, i + 1)["hash"]),
        ),
    )


def covered_lines(starts: Column, window: int) -> Column:
    """Lines covered by windows at the given starts, overlaps counted once."""
    first = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))
    return F.aggregate(
        F.sort_array(starts),
        first,
        lambda acc, pos: F.struct(
            (acc["covered"] + pos + window - F.greatest(acc["reach"], pos)).alias("covered"),
            (pos + window).alias("reach"),
        ),
        lambda acc: acc["covered"],
    )


def repeated_windows(files: DataFrame, min_block: int = 4, window: int = 6, content: str = "content") -> DataFrame:
    """Files with their lines and the windows that occur more than once."""
    lined = files.withColumn("lines", split_lines(F.col(content)))
    return lined.withColumn("repeats", repeated(window_hashes(F.col("lines"), min_block, window)))


def file_duplication(files: DataFrame, min_block: int = 4, window: int = 6, content: str = "content") -> DataFrame:
    """One row per file: lines, repeated lines, percent and score; other columns stay."""
    counted = repeated_windows(files, min_block, window, content).select(
        *[c for c in files.columns if c != content],
        F.size("lines").alias("total_lines"),
        covered_lines(F.transform("repeats", lambda x: x["pos"]), window).alias("duplicated_lines"),
    )
    lines, repeats = F.col("total_lines"), F.col("duplicated_lines")
    percent = F.when(lines > 0, round_to(repeats / lines * 100, 2)).otherwise(F.lit(0.0))
    return counted.withColumn("duplication_percent", percent).withColumn(
        "duplication_score", duplication_score(lines, F.col("duplication_percent"))
    )


def duplicate_blocks(
    files: DataFrame, key: str = "file_id", min_block: int = 4, window: int = 6, content: str = "content", sample_chars: int | None = None
) -> DataFrame:
    """One row per repeated block of a file: positions, count and its text, cut to ``sample_chars`` if given."""
    found = repeated_windows(files, min_block, window, content)

    def sample(pos: Column) -> Column:
        text = F.array_join(F.slice("lines", pos + 1, window), "\n")
        return text if sample_chars is None else F.substring(text, 1, sample_chars)

    rows = found.select(
        key,
        F.explode(
            F.transform(
                "repeats",
                lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"), sample(x["pos"]).alias("sample")),
            )
        ).alias("r"),
    ).select(key, "r.*")
    return rows.groupBy(key, "hash").agg(
        F.sort_array(F.collect_list("pos")).alias("positions"),
        F.count("*").alias("occurrences"),
        F.lit(window).alias("line_count"),
        F.min_by("sample", "pos").alias("sample_text"),
    )


SCOPES = {"file": ("file_id",), "repo": ("repo",), "corpus": ()}


def _placed_windows(files: DataFrame, scope: str, min_block: int, window: int, content: str) -> tuple[DataFrame, list[str]]:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}, use one of {sorted(SCOPES)}")
    within = list(SCOPES[scope])
    keys = list(dict.fromkeys(["file_id", *within]))
    hashes = window_hashes(split_lines(F.col(content)), min_block, window)
    return files.select(*keys, F.explode(hashes).alias("w")).select(*keys, "w.hash", "w.pos"), within


def shared_blocks(
    files: DataFrame, scope: str = "corpus", min_block: int = 4, window: int = 6, content: str = "content"
) -> DataFrame:
    """One row per block that a file, a repository or the corpus holds more than once: places and files.

    ``files`` needs ``file_id``, for scope "repo" also ``repo``. Only hashes
    are shuffled, counted per file first, and no list of places is made.
    """
    windows, within = _placed_windows(files, scope, min_block, window, content)
    in_file = windows.groupBy(*dict.fromkeys([*within, "file_id"]), "hash").agg(F.count("*").alias("n"))
    return (
        in_file.groupBy(*within, "hash")
        .agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"))
        .where("occurrences > 1")
    )


def scoped_duplication(
    files: DataFrame, scope: str = "corpus", min_block: int = 4, window: int = 6, content: str = "content"
) -> DataFrame:
    """``file_id, total_lines, duplicated_lines``: lines in blocks that also stand elsewhere within the scope.

    Windows meet their counts by hash, one row for each hash however many
    files share it; positions come back as one short list per file.
    """
    windows, within = _placed_windows(files, scope, min_block, window, content)
    often = windows.groupBy(*within, "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    covered = (
        windows.join(often, [*within, "hash"], "left_semi")
        .groupBy("file_id")
        .agg(covered_lines(F.collect_list("pos"), window).alias("duplicated_lines"))
    )
    lines = files.select("file_id", F.size(split_lines(F.col(content))).cast("long").alias("total_lines"))
    return lines.join(covered, "file_id", "left").withColumn("duplicated_lines", F.coalesce("duplicated_lines", F.lit(0)).cast("long"))
