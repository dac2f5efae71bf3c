"""Cyclomatic and cognitive complexity on the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.rows import round_to
from debtscope.functions.scores import complexity_score
from debtscope.operators.nodes import FUNCTION_TYPES, SCRIPT_LANGUAGES, functions_of

# Nodes that add a decision.
PYTHON_DECISIONS = (
    "if_statement",
    "elif_clause",
    "for_statement",
    "while_statement",
    "except_clause",
    "with_statement",
    "assert_statement",
    "conditional_expression",
)
SCRIPT_DECISIONS = (
    "if_statement",
    "for_statement",
    "for_in_statement",
    "while_statement",
    "do_statement",
    "switch_case",
    "catch_clause",
    "ternary_expression",
)

# Nodes that deepen the nesting.
PYTHON_NESTING = (
    "if_statement",
    "for_statement",
    "while_statement",
    "except_clause",
    "with_statement",
    "function_definition",
)
SCRIPT_NESTING = (
    "if_statement",
    "for_statement",
    "for_in_statement",
    "while_statement",
    "do_statement",
    "catch_clause",
    "function_declaration",
    "arrow_function",
)

# Nodes that add half a decision, whatever their operator.
OPERATOR_NODES = ("boolean_operator", "binary_expression")


def _typed(python: tuple[str, ...], script: tuple[str, ...]) -> Column:
    language, kind = F.col("language"), F.col("type")
    return ((language == "python") & kind.isin(*python)) | (language.isin(*SCRIPT_LANGUAGES) & kind.isin(*script))


def is_decision() -> Column:
    """Node adds one to the cyclomatic number."""
    return _typed(PYTHON_DECISIONS, SCRIPT_DECISIONS)


def is_nesting() -> Column:
    """Node deepens what lies below it."""
    return _typed(PYTHON_NESTING, SCRIPT_NESTING)


# Bits of an event.
_DECISION, _NESTING, _OPERATOR, _FUNCTION, _LEAVING = 1, 2, 4, 8, 16


def _bit(value: int) -> Column:
    return F.col("flags").bitwiseAND(value) != 0


def _entered(bit: int) -> Column:
    """1 where a node with that bit is entered."""
    return (F.col("flags").bitwiseAND(bit | _LEAVING) == bit).cast("int")


def _step() -> Column:
    """How an event changes the number of open nesting nodes."""
    return F.when(~_bit(_NESTING), 0).when(_bit(_LEAVING), -1).otherwise(1)


def _order() -> list[Column]:
    """A node is entered before one inside it and left after it."""
    return [F.col("at"), F.col("flags").bitwiseAND(_LEAVING), F.col("pre"), F.col("node_id")]


def _events(nodes: DataFrame, block: int) -> DataFrame:
    """Enter and leave events of the nodes that matter for complexity, with running figures of their block.

    ``_level`` is the number of nesting nodes opened less those closed, an
    entered one included; ``_decisions`` and ``_operators`` count the nodes
    entered so far, ``_depths`` sums the levels of these decisions. What an
    event is goes into one number, so all branches that read the events need
    the same columns and share one shuffle.
    """
    flag = lambda value, bit: F.when(value, bit).otherwise(0)
    flags = (
        flag(is_decision(), _DECISION) + flag(is_nesting(), _NESTING) + flag(F.col("type").isin(*OPERATOR_NODES), _OPERATOR) + flag(F.col("type").isin(*FUNCTION_TYPES), _FUNCTION)
    )
    flagged = nodes.select("file_id", "node_id", "pre", "post", flags.alias("flags")).where("flags > 0")
    enter = F.struct(F.col("pre").alias("at"), F.lit(0).alias("leaving"))
    leave = F.struct(F.col("post").alias("at"), F.lit(_LEAVING).alias("leaving"))
    events = flagged.withColumn("event", F.explode(F.when(_bit(_NESTING | _FUNCTION), F.array(enter, leave)).otherwise(F.array(enter))))
    dealt = events.select(
        "file_id", "node_id", "pre", "post", "event.at", (F.col("flags") + F.col("event.leaving")).alias("flags"), F.floor(F.col("event.at") / block).alias("_block")
    ).where("file_id is not null and _block is not null")
    inside = W.partitionBy("file_id", "_block").orderBy(*_order()).rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.withColumn("_level", F.sum(_step()).over(inside))
    return rows.withColumns(
        {
            "_decisions": F.sum(_entered(_DECISION)).over(inside),
            "_operators": F.sum(_entered(_OPERATOR)).over(inside),
            "_depths": F.sum(_entered(_DECISION) * F.col("_level")).over(inside),
        }
    )


def _bases(events: DataFrame) -> DataFrame:
    """What the blocks of a file before each block add up to; ``_first`` and ``_alone`` tell of a file's first and only block."""
    deep = F.sum(_entered(_DECISION) * F.col("_level")).alias("_depths")
    totals = events.withColumn("_step", _step()).groupBy("file_id", "_block").agg(
        F.sum("_step").alias("_level"), F.sum(_entered(_DECISION)).alias("_decisions"), F.sum(_entered(_OPERATOR)).alias("_operators"), deep
    )
    blocks = W.partitionBy("file_id").orderBy("_block")
    earlier = blocks.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = totals.select("*", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}0") for c in ("_level", "_decisions", "_operators")])
    below = F.coalesce(F.sum(F.col("_depths") + F.col("_level0") * F.col("_decisions")).over(earlier), zero)
    return sums.select(
        "file_id",
        "_block",
        "_level0",
        "_decisions0",
        "_operators0",
        below.alias("_depths0"),
        (F.row_number().over(blocks) == 1).alias("_first"),
        (F.count("*").over(W.partitionBy("file_id")) == 1).alias("_alone"),
    )


def _over_blocks(events: DataFrame, bases: DataFrame) -> DataFrame:
    """Events with figures counted from the start of their file; only later blocks have something to add."""
    later = bases.where("not _first").drop("_first", "_alone")
    base = lambda c: F.coalesce(F.col(f"{c}0"), F.lit(0))
    return events.join(later, ["file_id", "_block"], "left").select(
        *events.columns,
        (F.col("_level") + base("_level")).alias("level"),
        (F.col("_decisions") + base("_decisions")).alias("decisions"),
        (F.col("_operators") + base("_operators")).alias("operators"),
        (F.col("_depths") + base("_level") * F.col("_decisions") + base("_depths")).alias("depths"),
    )


def with_nesting_level(nodes: DataFrame, block: int = 4096) -> DataFrame:
    """Nodes that matter for complexity, with the number of open nesting nodes, own one included.

    Entering a nesting node counts +1 and leaving it -1; the level is a running
    sum over these events in document order. No tree is walked.
    """
    events = _events(nodes, block)
    leveled = _over_blocks(events, _bases(events)).where(~_bit(_LEAVING))
    return leveled.select(
        "file_id", "node_id", _bit(_DECISION).alias("decision"), _bit(_NESTING).alias("nesting"), _bit(_OPERATOR).alias("operator"), _bit(_FUNCTION).alias("function"), "pre", "post", "level"
    )


def _flat_decisions(events: DataFrame, bases: DataFrame) -> DataFrame:
    """Decisions that open no level, counted by the nesting node that was opened last at their level: ``file_id, function_id, flat``.

    Most stand in the block of that node. For the others, the last node that
    each block opens at each level is looked up over the file's blocks.
    """
    along = W.partitionBy("file_id", "_block", "_level").orderBy(*_order()).rowsBetween(W.unboundedPreceding, 0)
    opener = F.last(F.when(_bit(_NESTING), F.col("node_id")), ignorenulls=True).over(along)
    flat = _bit(_DECISION) & ~_bit(_NESTING)
    found = (
        events.where(~_bit(_LEAVING) & _bit(_NESTING | _DECISION))
        .withColumn("opener", opener)
        .withColumn("place", F.when(_bit(_NESTING), F.struct("at", "pre", "node_id")))
        .groupBy("file_id", "_block", "_level", "opener")
        .agg(F.count_if(flat).alias("flat"), F.max("place").alias("place"))
    )
    here = found.where("opener is not null and flat > 0").select("file_id", F.col("opener").alias("function_id"), "flat")
    seen = W.partitionBy("file_id", "level").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    earlier = (
        found.groupBy("file_id", "_block", "_level")
        .agg(F.max("place").alias("place"), F.sum(F.when(F.col("opener").isNull(), F.col("flat"))).alias("flat"))
        .join(bases.where("not _alone").select("file_id", "_block", "_level0"), ["file_id", "_block"])
        .withColumn("level", F.col("_level") + F.col("_level0"))
        .withColumn("function_id", F.last("place.node_id", ignorenulls=True).over(seen))
        .where("flat > 0 and function_id is not null")
        .select("file_id", "function_id", "flat")
    )
    return here.unionByName(earlier)


def function_complexity(nodes: DataFrame, block: int = 4096) -> DataFrame:
    """Cyclomatic and cognitive complexity of each function, nested functions included in outer ones.

    What a function holds is the difference of running sums between its end and
    its start, so no node is paired with a function. A decision adds its depth
    below the function; one that opens no level of its own and stands right in
    the function would add one too little, so these are counted by the nesting
    node that was opened last at their level.
    """
    events = _events(nodes, block)
    bases = _bases(events)
    summed = _over_blocks(events, bases).where(_bit(_FUNCTION))

    def gained(name: str) -> Column:
        at = lambda leaving: F.max(F.when(F.col("leaving") == leaving, F.col(name)))
        return at(True) - at(False)

    ends = summed.select("file_id", F.col("node_id").alias("function_id"), _bit(_LEAVING).alias("leaving"), "decisions", "operators", "depths", "level")
    functions = (
        ends.unionByName(_flat_decisions(events, bases), allowMissingColumns=True)
        .groupBy("file_id", "function_id")
        .agg(
            gained("decisions").alias("n"),
            gained("operators").alias("half"),
            gained("depths").alias("depths"),
            F.max(F.when(~F.col("leaving"), F.col("level"))).alias("level"),
            F.sum("flat").alias("flat"),
        )
    )
    return functions.where("level is not null").select(
        "file_id",
        "function_id",
        (1 + F.col("n") + 0.5 * F.col("half")).cast("double").alias("cyclomatic"),
        (F.col("depths") - F.col("n") * F.col("level") + F.coalesce("flat", F.lit(0))).cast("long").alias("cognitive"),
    )


def function_table(nodes: DataFrame) -> DataFrame:
    """Functions with name, lines and both complexities."""
    named = functions_of(nodes).withColumnRenamed("node_id", "function_id")
    return named.join(function_complexity(nodes), ["file_id", "function_id"]).select(
        "file_id", "function_id", "name", "start_line", "end_line", "line_count", "cyclomatic", "cognitive"
    )


def file_complexity(metrics: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Totals, means, maxima and score per file from a per-function table.

    With ``files`` given, files without functions appear too, scored 0.
    """
    totals = metrics.groupBy("file_id").agg(
        F.sum("cyclomatic").alias("total_cyclomatic"),
        F.sum("cognitive").alias("total_cognitive"),
        F.max("cyclomatic").alias("max_cyclomatic"),
        F.max("cognitive").alias("max_cognitive"),
        F.count("*").alias("function_count"),
    )
    if files is not None:
        totals = files.select("file_id").join(totals, "file_id", "left").na.fill(0)
    count = F.col("function_count")

    def mean(name: str) -> Column:
        return F.when(count > 0, round_to(F.col(name) / count, 2)).otherwise(F.lit(0.0))

    full = totals.withColumn("avg_cyclomatic", mean("total_cyclomatic")).withColumn(
        "avg_cognitive", mean("total_cognitive")
    )
    return full.withColumn(
        "complexity_score",
        complexity_score(count, F.col("avg_cyclomatic"), F.col("max_cyclomatic"), F.col("avg_cognitive")),
    )


def with_function_list(file_rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Add each file's functions as an array of records in line order."""
    record = F.struct("start_line", "name", "end_line", "line_count", "cyclomatic", "cognitive")
    lists = functions.groupBy("file_id").agg(F.sort_array(F.collect_list(record)).alias("functions"))
    return file_rows.join(lists, "file_id", "left")
