"""The package's tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.labels import severity
from debtscope.functions.rows import round_to
from debtscope.functions.scores import composite_score, documentation_score
from debtscope.operators.duplication import file_duplication
from debtscope.operators.nodes import comment_count
from debtscope.operators.running import running
from debtscope.session import landed, table


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as source files: the source is the repository."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repo"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("file_size"),
    )


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The score table below, landed as the study lands its file scores."""
    return landed(spark, folder, "scored-documents", lambda: document_scores(spark, folder))


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with dimension scores, composite and a confidence label from the labels table."""
    files = document_files(spark, folder).withColumn("comments", comment_count(F.col("content")))
    measured = file_duplication(files)
    lines = F.col("total_lines")
    coverage = round_to(F.when(lines > 0, F.col("comments") / lines).otherwise(F.lit(0.0)), 4)
    dims = (
        measured.withColumn("complexity_score", round_to(F.least(F.lit(0.8), lines / 1000), 4))
        .withColumn("documentation_score", documentation_score(coverage))
        .withColumn("error_handling_score", F.lit(0.5))
    )
    total = composite_score(*[F.col(f"{d}_score") for d in ("complexity", "duplication", "documentation", "error_handling")])
    scored = dims.withColumn("debt_score", total).withColumn("severity", severity(F.col("debt_score"), "dataset"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("file_id"), "quality", "toxic")
    confidence = (
        F.when(F.col("quality").isNull(), "None")
        .when(F.col("quality") == 0, "Low")
        .when((F.col("toxic") == 1) | (F.col("file_id") % 3 == 0), "High")
        .otherwise("Medium")
    )
    return scored.join(labels, "file_id", "left").withColumn("ai_confidence", confidence).drop("quality", "toxic", "comments")


def conversation_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as commits: a conversation is a repository, later turns are newer."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("repo"),
        F.concat_ws("-", "conv_id", "turn").alias("sha"),
        F.col("text").alias("message"),
        F.timestamp_seconds("turn").alias("committed_at"),
        "turn",
        "role",
    )


def newest_turn() -> list[Column]:
    """Order of commits from newest to oldest."""
    return [F.col("turn").desc()]


def syntax_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table below, landed as a parser would land it."""
    return landed(spark, folder, "syntax-nodes", lambda: order_nodes(spark, folder))


def placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the number of their lines and their first position in the customer's file."""
    sizes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("m"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    sized = orders.join(sizes, "o_orderkey", "left").na.fill(0, ["m"])
    # A block holds a million keys, so a customer's few orders stand in one or two.
    return running(
        sized,
        ["o_custkey"],
        F.floor(F.col("o_orderkey") / (1 << 20)),
        ["o_orderkey"],
        sums={"up_to": F.col("m") + 5, "ordinal": F.lit(1)},
    ).withColumn("base", F.col("up_to") - F.col("m") - 1)


def order_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Syntax nodes made of orders and their lines.

    A customer is a file, an order a function (urgent ones a class), a line a
    node of its body. Return flag and line status name the node type; lines
    that nest hold all later lines of their order.
    """
    lines = table(spark, folder, "lineitem")
    placed = landed(spark, folder, "placed-orders", lambda: placed_orders(spark, folder))

    def node(at: Column, parent: Column, ord_: Column, post: Column, kind: Column, text: Column, end: Column) -> Column:
        return F.struct(
            at.cast("long").alias("node_id"),
            parent.cast("long").alias("parent_id"),
            ord_.cast("int").alias("sibling_ord"),
            at.cast("long").alias("pre"),
            post.cast("long").alias("post"),
            kind.alias("type"),
            (at + 1).cast("long").alias("start_line"),
            (end + 1).cast("long").alias("end_line"),
            text.alias("text"),
        )

    base, last, zero = F.col("base"), F.col("base") + 4 + F.col("m"), F.lit(0)
    no_text = F.lit(None).cast("string")
    owner = F.when(F.col("o_orderpriority") == "1-URGENT", "class_definition").otherwise("function_definition")
    name = F.when(F.col("o_totalprice") >= 100000, F.concat(F.lit("fn_"), F.col("o_orderkey").cast("string")))
    opening = F.when(F.col("o_orderstatus") == "F", '"""text"""').when(F.col("o_orderstatus") == "O", "'text'")
    heads = F.array_compact(
        F.array(
            node(base, zero, F.col("ordinal") + 1, last, owner, no_text, last),
            F.when(name.isNotNull(), node(base + 1, base, zero, base + 1, F.lit("identifier"), name, base + 1)),
            node(base + 2, base, F.lit(1), last, F.lit("block"), no_text, last),
            F.when(opening.isNotNull(), node(base + 3, base + 2, zero, base + 4, F.lit("expression_statement"), no_text, base + 3)),
            F.when(opening.isNotNull(), node(base + 4, base + 3, zero, base + 4, F.lit("string"), opening, base + 4)),
        )
    )
    head_nodes = placed.select(F.col("o_custkey").alias("file_id"), F.explode(heads).alias("n")).select("file_id", "n.*")

    # Lines are counted in blocks of line numbers, and each block learns its order's place: lines are shuffled once.
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    numbered = lines.select("l_orderkey", *order, "l_discount", "l_tax", "l_returnflag", "l_linestatus").withColumn(
        "_block", F.coalesce(F.floor(F.col("l_linenumber") / 1024), F.lit(-(1 << 62)))
    )
    earlier = W.partitionBy("l_orderkey").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        numbered.groupBy("l_orderkey", "_block")
        .agg(F.count("*").alias("_lines"))
        .select("l_orderkey", "_block", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
        .join(placed.select("o_orderkey", "o_custkey", "base", "m"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    in_block = F.row_number().over(W.partitionBy("l_orderkey", "_block").orderBy(*order))
    body = numbered.withColumn("_nth", in_block).join(blocks, ["l_orderkey", "_block"]).withColumn("r", F.col("_before") + F.col("_nth"))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    even = F.col("l_linenumber") % 2 == 0
    kind = (
        F.when((flag == "R") & (status == "O"), "if_statement")
        .when(flag == "R", "assert_statement")
        .when((flag == "A") & (status == "O"), "try_statement")
        .when(flag == "A", F.when(even, "except_clause").otherwise("boolean_operator"))
        .when(status == "O", "for_statement")
        .otherwise("call")
    )
    part = F.col("l_partkey") % 3
    text = F.when(kind == "call", F.when(part == 0, "open(path)").when(part == 1, "link.get(key)").otherwise("print(x)")).when(
        kind == "except_clause", F.when(F.col("l_tax") < 0.02, "except:").otherwise("except ValueError:")
    )
    at = base + 4 + F.col("r")
    holds = kind.isin("if_statement", "for_statement", "try_statement")
    length = (
        F.when(kind == "call", F.floor(F.col("l_discount") * 50 + 0.5))
        .when(kind == "try_statement", F.floor(F.col("l_quantity") / 10))
        .otherwise(F.lit(0))
    )
    body_nodes = body.select(
        F.col("o_custkey").alias("file_id"),
        node(at, base + 2, F.col("r"), F.when(holds, last).otherwise(at), kind, text, at + length).alias("n"),
    ).select("file_id", "n.*")

    customers = table(spark, folder, "customer")
    files = customers.join(
        placed.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("up_to").alias("size")), "c_custkey", "left"
    )
    end = F.coalesce(F.col("size"), F.lit(0)) + 3
    note = F.when(F.col("c_nationkey") % 2 == 0, node(F.lit(1), zero, zero, F.lit(1), F.lit("comment"), F.lit("# note"), F.lit(1) + F.col("c_nationkey") % 4))
    intro = F.when(F.col("c_nationkey") % 3 == 0, '"""module"""').when(F.col("c_nationkey") % 3 == 1, '"short"')
    spot = F.when(F.col("c_nationkey") % 2 == 0, 1).otherwise(0)
    tops = F.array_compact(
        F.array(
            node(zero, F.lit(None), zero, end, F.lit("module"), no_text, end),
            note,
            F.when(intro.isNotNull(), node(F.lit(2), zero, spot, F.lit(3), F.lit("expression_statement"), no_text, F.lit(2))),
            F.when(intro.isNotNull(), node(F.lit(3), F.lit(2), zero, F.lit(3), F.lit("string"), intro, F.lit(3))),
        )
    )
    top_nodes = files.select(F.col("c_custkey").alias("file_id"), F.explode(tops).alias("n")).select("file_id", "n.*")
    return head_nodes.unionByName(body_nodes).unionByName(top_nodes).withColumn("language", F.lit("python"))


def node_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files behind ``syntax_nodes`` with their line counts."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    sizes = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("m"))
    totals = orders.join(sizes, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("file_id")).agg(
        F.sum(F.coalesce("m", F.lit(0)) + 5).alias("size")
    )
    return (
        table(spark, folder, "customer")
        .select(F.col("c_custkey").alias("file_id"))
        .join(totals, "file_id", "left")
        .select("file_id", (F.coalesce("size", F.lit(0)) + 4).alias("total_lines"))
    )
