"""Outline of raw text: node-like rows without a grammar parser.

Strings and comments are blanked first, line by line structure is read from
indentation (Python) or braces (scripts). Files are dealt over all shuffle
partitions first; then Python extents are found inside the row, and tokens of
scripts stay where their file is. Lines that brackets, backslashes or strings continue are one
statement on its first line, and what stands before a slash tells a regular
expression from a division. It is an approximation: scripts need braces for a
body to have an extent, brackets nest at most 16 deep within one statement, and
a regular expression right after a closing bracket is read as a division.

Positions follow the text. In Python they are eight times the line number plus
a place for each kind of node, and leaves of a line share one place; node ids
are unique however long a line is. In scripts every token has the next number
of its file, whatever line it stands on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.rows import let
from debtscope.functions.text import is_blank
from debtscope.operators.languages import nested, outline_languages
from debtscope.operators.nodes import SCRIPT_LANGUAGES

# Bytes of text that one task reads, about; its sorted tokens take some 80 times as much memory.
TEXT_PER_TASK = 8 << 20
LINE = 8
# Place of the leaves of a Python line, after its statement, name, block and docstring.
_LEAF = 5
# Ordinal of nodes whose order among siblings plays no part.
_LATER = 1 << 30
# A line that belongs to the statement before it, and the end of a string of several lines.
_CONTINUED = "\x01"

# Strings, comments and the text between them, in one left-to-right pass.
_PYTHON_TOKENS = (
    r'"""[\s\S]*?(?:"""|\z)' r"|'''[\s\S]*?(?:'''|\z)"
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"?' r"|'(?:[^'\\\n]++|\\[\s\S])*+'?"
    r"|#[^\n]*+" r"|[^\"'#]++"
)
_SCRIPT_TOKENS = (
    r"/\*[\s\S]*?(?:\*/|\z)" r"|//[^\n]*+"
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"?' r"|'(?:[^'\\\n]++|\\[\s\S])*+'?" r"|`(?:[^`\\]++|\\[\s\S])*+`?"
    r"|(?=/)(?<=(?:^|[=(,:;!&|?{}\[+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|do|else|throw|void|delete|await|yield))[ \t]{0,40})"
    r"/(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
    r"|[^\"'`/]++" r"|/"
)
# What a statement may hold: strings over several lines, escaped line ends and balanced brackets.
_INSIDE = nested(r"[(\[{]", r"[)\]}]", r"[^()\[\]{}]++", 16)
_STATEMENT = rf"(?:[\"']{{3}}\n*+\x01|[^\n()\[\]{{}}\\\"']++|[\"']|\\[\s\S]|{_INSIDE}|[()\[\]{{}}])*+(?:\n|\z)"

# Python statements that open a body, by keyword.
_PYTHON_BODIES = {
    "def": "function_definition",
    "class": "class_definition",
    "if": "if_statement",
    "elif": "elif_clause",
    "else": "else_clause",
    "for": "for_statement",
    "while": "while_statement",
    "try": "try_statement",
    "except": "except_clause",
    "finally": "finally_clause",
    "with": "with_statement",
}
_PYTHON_LINES = {"assert": "assert_statement", "import": "import_statement", "from": "import_from_statement"}
_NOT_CALLED = ("if", "elif", "while", "for", "in", "and", "or", "not", "return", "assert", "with", "except", "yield",
               "lambda", "def", "class", "switch", "catch", "function", "typeof", "await", "else", "is")

_NODE = (
    "struct<node_id:bigint,parent_id:bigint,sibling_ord:int,pre:bigint,post:bigint,type:string,"
    "start_line:bigint,end_line:bigint,text:string>"
)


def _node(
    at: Column, parent: Column, ord_: Column, post: Column, kind: Column, line: Column, end: Column, text: Column, pre: Column | None = None
) -> Column:
    return F.struct(
        at.cast("long").alias("node_id"),
        parent.cast("long").alias("parent_id"),
        ord_.cast("int").alias("sibling_ord"),
        (at if pre is None else pre).cast("long").alias("pre"),
        post.cast("long").alias("post"),
        kind.alias("type"),
        line.cast("long").alias("start_line"),
        end.cast("long").alias("end_line"),
        text.alias("text"),
    )


def _hits(body: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(body, F.lit(pattern), 0))


def _inner(line: Column, slot: int, texts: Column, kind: str) -> Column:
    """Leaf nodes within a Python line, one per array element, with ids below zero."""
    pre, own = line * LINE + _LEAF, -((line.cast("long") * 4 + slot) * (1 << 28))
    return F.transform(
        texts, lambda t, i: _node(own - i - 1, F.lit(0), F.lit(_LATER), pre, F.lit(kind), line, line, t, pre)
    )


def _repeat(count: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("string"), count)


def _calls(body: Column) -> Column:
    """Called names as ``name(``; one on a literal has its own name, one on the result of a call repeats the first name."""
    name = r"(?<![\w.$])([A-Za-z_$][\w.$]*)\s*"
    own = r"(?<!def )(?<!class )(?<!function )"
    direct = F.regexp_extract_all(body, F.lit(own + name + r"\("), 1)
    literal = F.regexp_extract_all(body, F.lit(r"(?<=[\"\]])\.([A-Za-z_$][\w$]*)\s*\("), 1)
    chained = F.regexp_extract_all(body, F.lit(own + name + r"(?=\((?:[^()]|\([^()]*\))*+\)\s*\.\s*\w+\()"), 1)
    called = F.filter(F.concat(direct, literal, chained), lambda n: ~n.isin(*_NOT_CALLED))
    return F.transform(called, lambda n: F.concat(n, F.lit("(")))


def _blanked(content: Column, tokens: str, shorten: list[tuple[Column, Column]]) -> Column:
    def short(token: Column) -> Column:
        cases = reduce(lambda c, case: c.when(case[0](token), case[1](token)), shorten, F.when(F.lit(False), token))
        return cases.otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(tokens), 0), short), "")


def _breaks(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\n]", "")


def blank_python(content: Column) -> Column:
    """Python text with string bodies and comments removed; the line count stays."""
    return _blanked(
        content,
        _PYTHON_TOKENS,
        [
            (lambda t: t.startswith('"""'), lambda t: F.concat(F.lit('"""'), _breaks(t), F.lit(_CONTINUED))),
            (lambda t: t.startswith("'''"), lambda t: F.concat(F.lit("'''"), _breaks(t), F.lit(_CONTINUED))),
            (lambda t: t.startswith('"') | t.startswith("'"), lambda t: F.concat(F.lit('"s"'), _breaks(t))),
            (lambda t: t.startswith("#"), lambda t: F.lit("#")),
        ],
    )


def blank_script(content: Column) -> Column:
    """Script text with string bodies and comments removed; the line count stays."""
    return _blanked(
        content,
        _SCRIPT_TOKENS,
        [
            (lambda t: t.startswith("/**"), lambda t: F.concat(F.lit("/**"), _breaks(t), F.lit("*/"))),
            (lambda t: t.startswith("/*"), lambda t: F.concat(F.lit("/*"), _breaks(t), F.lit("*/"))),
            (lambda t: t.startswith("//"), lambda t: F.lit("//")),
            (lambda t: t.startswith("/") & (F.length(t) > 1), lambda t: F.lit('"r"')),
            (lambda t: F.substring(t, 1, 1).isin('"', "'", "`"), lambda t: F.concat(F.lit('"s"'), _breaks(t))),
        ],
    )


def join_lines(blanked: Column) -> Column:
    """Blanked Python text with each statement on its first line; the line count stays."""

    def join(t: Column) -> Column:
        more = F.length(_breaks(t)) - t.endswith("\n").cast("int")
        flat = F.concat(F.translate(F.rtrim(t, F.lit("\n")), "\\\n", "  "), F.repeat(F.lit("\n" + _CONTINUED), more), F.when(t.endswith("\n"), "\n").otherwise(""))
        # Most statements are one line: their only line end, if any, is the last character.
        return F.when(F.instr(t, "\n").between(1, F.length(t) - 1), flat).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(blanked, F.lit(_STATEMENT), F.lit(0)), join), "")


def _python_lines(blanked: Column) -> Column:
    """Filled lines with number, indentation and stripped body."""
    rows = F.transform(
        F.split(F.translate(blanked, "\r", ""), "\n", -1),
        lambda line, i: F.struct(
            (i + 1).alias("no"),
            (F.length(line) - F.length(F.ltrim(line))).alias("indent"),
            F.trim(line).alias("body"),
        ),
    )
    return F.filter(rows, lambda x: F.length(x["body"]) > 0)


def _classified(lines: Column) -> Column:
    """Lines with their keyword, whether they open a body, and the closing order.

    ``rank`` is twice the indentation, plus one for a clause that continues a
    statement. A body ends before the next line whose rank is not above its own.
    """

    def classify(x: Column, i: Column) -> Column:
        body = x["body"]
        first = F.regexp_extract(body, r"^(?:async\s+)?(def|class|if|elif|else|for|while|try|except|finally|with|assert|import|from)\b", 1)
        opened = _hits(body, r"[(\[{]") > _hits(body, r"[)\]}]")
        # The costly comparison of brackets comes last and only for lines that may open a body.
        ends = F.when(body.contains(":") | body.endswith("\\"), True).otherwise(opened)
        return let(
            first,
            lambda word: F.struct(
                x["no"].alias("no"),
                x["indent"].alias("indent"),
                body.alias("body"),
                word.alias("word"),
                F.when(word.isin(*_PYTHON_BODIES), ends).otherwise(False).alias("opens"),
                (x["indent"] * 2 + F.when(word.isin("elif", "else", "except", "finally"), 1).otherwise(0)).alias("rank"),
                F.coalesce(F.get(lines, i - 1)["no"], F.lit(0)).alias("before"),
            ),
        )

    return F.transform(lines, classify)


def _python_nodes(lines: Column) -> Column:
    starts = lambda x: ~x["body"].rlike(r"^[)\]}#\x01]")
    last = F.coalesce(F.get(lines, F.size(lines) - 1)["no"], F.lit(0))
    none = F.lit(None).cast("string")
    top = F.lit(0)

    def bodies(statements: Column) -> Column:
        ranks = F.array_distinct(F.transform(F.filter(statements, lambda x: x["opens"]), lambda x: x["rank"]))

        def of_rank(rank: Column) -> Column:
            return let(
                F.filter(statements, lambda x: x["rank"] <= rank),
                lambda a: F.filter(
                    F.transform(
                        a,
                        lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(a, i + 1)["before"], last).alias("end")),
                    ),
                    lambda y: y["x"]["opens"] & (y["x"]["rank"] == rank),
                ),
            )

        return F.flatten(F.transform(ranks, of_rank))

    def body_nodes(y: Column) -> Column:
        x = y["x"]
        at, post = x["no"] * LINE, y["end"] * LINE + LINE - 1
        kind = reduce(lambda c, kv: c.when(x["word"] == kv[0], kv[1]), _PYTHON_BODIES.items(), F.when(F.lit(False), ""))
        name = F.regexp_extract(x["body"], r"^(?:async\s+)?(?:def|class)\s+(\w+)", 1)
        owner = x["word"].isin("def", "class")
        return F.array_compact(
            F.array(
                _node(at, top, F.lit(_LATER), post, kind, x["no"], y["end"], x["body"]),
                F.when(owner, _node(at + 1, at, top, at + 1, F.lit("identifier"), x["no"], x["no"], name)),
                F.when(owner, _node(at + 2, at, F.lit(1), post, F.lit("block"), x["no"], y["end"], none)),
            )
        )

    def docstrings(statements: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            owner = F.get(statements, i - 1)
            quote = F.substring(x["body"], 1, 3)
            nested = owner["word"].isin("def", "class") & owner["opens"] & (x["indent"] > owner["indent"])
            parent = F.when(i == 0, top).when(nested, owner["no"] * LINE + 2)
            at = x["no"] * LINE
            made = F.array(
                _node(at + 3, parent, top, at + 4, F.lit("expression_statement"), x["no"], x["no"], none),
                _node(at + 4, at + 3, top, at + 4, F.lit("string"), x["no"], x["no"], quote),
            )
            return F.when(quote.isin('"""', "'''") & parent.isNotNull(), made).otherwise(F.array().cast(f"array<{_NODE}>"))

        return F.flatten(F.transform(statements, of))

    def line_nodes(x: Column) -> Column:
        body, at = x["body"], x["no"] * LINE
        kind = reduce(lambda c, kv: c.when(x["word"] == kv[0], kv[1]), _PYTHON_LINES.items(), F.when(F.lit(False), ""))
        single = F.array(_node(at, top, F.lit(_LATER), at, kind, x["no"], x["no"], body))
        nothing = F.array().cast(f"array<{_NODE}>")
        # Most lines lack what a kind of leaf needs, and a search for text costs less than a pattern.
        return F.concat(
            F.when(x["word"].isin(*_PYTHON_LINES), single).otherwise(nothing),
            F.when(body.contains("and") | body.contains("or"), _inner(x["no"], 0, _repeat(_hits(body, r"\b(?:and|or)\b")), "boolean_operator")).otherwise(nothing),
            F.when(body.contains("else"), _inner(x["no"], 1, _repeat(_hits(body, r"\belse\b(?!\s*:)")), "conditional_expression")).otherwise(nothing),
            F.when(body.contains("("), _inner(x["no"], 2, _calls(body), "call")).otherwise(nothing),
            F.when(body.contains("#"), _inner(x["no"], 3, F.regexp_extract_all(body, F.lit("#"), 0), "comment")).otherwise(nothing),
        )

    leaves = lambda x: x["word"].isin(*_PYTHON_LINES) | x["body"].rlike(r"[(#]|\b(?:and|or|else)\b")
    module = F.array(_node(top, F.lit(None), top, (last + 1) * LINE, F.lit("module"), top, last, none))
    return F.concat(
        module,
        let(
            F.filter(lines, starts),
            lambda s: F.concat(F.flatten(F.transform(bodies(s), body_nodes)), docstrings(s)),
        ),
        F.flatten(F.transform(F.filter(lines, leaves), line_nodes)),
    )


def outline_python(files: DataFrame) -> DataFrame:
    """Nodes of Python files, found inside each row."""
    lines = files.withColumn("_lines", _python_lines(join_lines(blank_python(F.translate("content", _CONTINUED, "")))))
    # As a column of its own the array would be made twice: Spark first drops rows where it is empty.
    nodes = let(F.col("_lines"), lambda ls: let(_classified(ls), _python_nodes))
    return lines.select("file_id", "language", F.inline(nodes))


# Script constructs by the text that starts them. A head ends at the first brace outside of
# brackets; that brace opens the body. Anything else of a line is one piece of text.
_BRACKETS = nested(r"\(", r"\)", r"[^(){}]++", 8)
_SCRIPT_HEADS = r"(?:async\s+)?\bfunction\b|\b(?:class|if|for|while|switch|catch)\b"
_SCRIPT_WORDS = r"\bcase\b|\b(?:do|try|finally)\s*+\{|=>\s*+\{?|\belse\b"
_SCRIPT_PARTS = (
    rf"(?:{_SCRIPT_HEADS})(?:[^\n{{}}()]++|{_BRACKETS})*+\{{?"
    rf"|{_SCRIPT_WORDS}|[{{}}\n]"
    rf"|(?:(?!{_SCRIPT_HEADS}|{_SCRIPT_WORDS})[^{{}}\n])++"
)
_SCRIPT_OPERATORS = (
    r"===|!==|==|!=|<=|>=|&&|\|\||\?\?|\*\*|(?<![=<>])[<>](?![=<>/])|(?<![*/])[*%](?![*=/])"
    r"|(?<=[\w)\]\"] )[+\-](?=\s|$)"
)


def _script_kind(token: Column) -> Column:
    starts = lambda p: token.rlike(p)
    return (
        F.when(starts(r"^(?:async\s+)?function\s*\*?\s*[A-Za-z_$]"), "function_declaration")
        .when(starts(r"^(?:async\s+)?function"), "function_expression")
        .when(starts("^class"), "class_declaration")
        .when(starts("^if"), "if_statement")
        .when(starts(r"^for\b.*\b(?:of|in)\b"), "for_in_statement")
        .when(starts("^for"), "for_statement")
        .when(starts("^while"), "while_statement")
        .when(starts("^do"), "do_statement")
        .when(starts("^switch"), "switch_statement")
        .when(starts("^case"), "switch_case")
        .when(starts("^catch"), "catch_clause")
        .when(starts("^try"), "try_statement")
        .when(starts("^finally"), "finally_clause")
        .when(starts("^=>"), "arrow_function")
    )


def outline_script(files: DataFrame) -> DataFrame:
    """Nodes of JavaScript and TypeScript files from braces and keywords.

    One stream of tokens holds structure, operators, calls and comments in the
    order of the text, numbered without gaps in each file. A body ends at the
    next closing brace of the same depth; a ``try`` runs on to the end of its
    handlers. What is sorted are tokens.
    """
    blanked = files.withColumn("_text", blank_script(F.col("content")))
    pieces = blanked.select(
        "file_id", "language", F.posexplode(F.regexp_extract_all("_text", F.lit(_SCRIPT_PARTS), 0)).alias("at", "token")
    )
    token = F.col("token")
    opens, closes = token.endswith("{"), token == "}"
    goes_on = token.rlike("^(?:catch|finally|else)")
    owner = F.col("kind").isin("function_declaration", "class_declaration")
    name = F.regexp_extract("token", r"^(?:async\s+)?(?:function|class)\s*\*?\s*([\w$]+)", 1)
    leaf = lambda kind, texts: F.transform(texts, lambda t: F.struct(F.lit(kind).alias("type"), t.alias("text")))
    one = lambda kind, text: F.array(F.struct(kind.alias("type"), text.alias("text")))
    none = F.array().cast("array<struct<type:string,text:string>>")
    items = F.concat(
        F.when(F.col("kind").isNotNull(), one(F.col("kind"), token)).when(closes | goes_on, one(F.lit("}"), token)).otherwise(none),
        F.when(owner, one(F.lit("identifier"), name)).otherwise(none),
        leaf("binary_expression", _repeat(_hits(token, _SCRIPT_OPERATORS))),
        leaf("ternary_expression", _repeat(_hits(token, r"(?<!\?)\?(?![.?:])"))),
        leaf("call_expression", _calls(token)),
        leaf("comment", F.regexp_extract_all(token, F.lit("//"), 0)),
    )
    so_far = W.partitionBy("file_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    breaks = F.length(F.regexp_replace(token, r"[^\n]", ""))
    numbered = (
        pieces.withColumn("line", 1 + F.sum(breaks).over(so_far) - breaks)
        .withColumn("depth", F.sum(step).over(so_far) - F.when(opens, 1).otherwise(0))
        .withColumn("kind", _script_kind(token))
        .select("file_id", "language", "at", "token", "line", "depth", "kind", F.posexplode(items).alias("sub", "item"))
        .withColumn("pos", F.row_number().over(W.partitionBy("file_id").orderBy("at", "sub")).cast("long"))
        .select("*", "item.*")
    )

    leads = (F.col("sub") == 0) & (F.col("kind").isNotNull() | closes | goes_on)
    marks = numbered.where(leads)
    # Read backwards, the last brace seen is the next one, and the frame only grows.
    backwards = W.partitionBy("file_id", "depth").orderBy(F.col("at").desc())
    seen = backwards.rowsBetween(W.unboundedPreceding, -1)
    closing = F.last(F.when(closes, F.struct("pos", "line")), ignorenulls=True).over(seen)
    sized = marks.withColumn("close", F.when(opens, closing)).withColumn(
        "handler_end", F.lag(F.when(goes_on, F.col("close")), 2).over(backwards)
    )
    end = F.when((F.col("kind") == "try_statement") & F.col("handler_end").isNotNull(), F.col("handler_end")).otherwise(F.col("close"))
    ended = sized.where("kind is not null").withColumn("end", end)
    post = F.coalesce("end.pos", F.col("pos") + F.when(owner, 1).otherwise(0))
    zero, line = F.lit(0), F.col("line")
    structure = ended.select(
        "file_id", "language", _node(F.col("pos"), zero, line * 2 + 1, post, F.col("kind"), line, F.coalesce("end.line", "line"), token).alias("n")
    )
    small = numbered.where(~leads).withColumn("named", F.col("type") == "identifier")
    parent, ord_ = F.when(F.col("named"), F.col("pos") - 1).otherwise(zero), F.when(F.col("named"), zero).otherwise(F.lit(_LATER))
    inner = small.select(
        "file_id", "language", _node(F.col("pos"), parent, ord_, F.col("pos"), F.col("type"), line, line, F.col("text")).alias("n")
    )
    module = files.select(
        "file_id", "language", _node(zero, F.lit(None), zero, F.lit(1 << 50), F.lit("program"), zero, F.lit(1), F.lit(None).cast("string")).alias("n")
    )
    rows = module.unionByName(structure).unionByName(inner).select("file_id", "language", "n.*")
    return rows.unionByName(_block_comments(blanked))


def _block_comments(blanked: DataFrame) -> DataFrame:
    """Block comments; one that ends right above a line is the sibling before that line's node."""
    pieces = F.split("_text", r"(?=/\*)", -1)
    head = F.col("_text").rlike(r"^\s*/\*")
    rows = blanked.select("file_id", "language", head.alias("head"), F.posexplode(pieces).alias("i", "piece"))
    lines_in = _hits(F.col("piece"), "\n")
    before = W.partitionBy("file_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    started = rows.withColumn("start", 1 + F.coalesce(F.sum(lines_in).over(before), F.lit(0))).where("piece like '/*%'")
    end = F.col("start") + _hits(F.regexp_extract("piece", r"^/\*[\s\S]*?\*/", 0), "\n")
    gap = _hits(F.regexp_extract("piece", r"^/\*[\s\S]*?\*/(\s*)", 1), "\n")
    placed = started.withColumn("end", end).withColumn("next", F.col("end") + gap)
    first = F.col("head") & (F.row_number().over(W.partitionBy("file_id").orderBy("i")) == 1)
    ordered = placed.withColumn("ord", F.when(first, 0).otherwise(F.col("next") * 2))
    # Ids below zero; comments hold nothing, so their place does not matter.
    at = -(F.col("i") * 2 + 1)
    node = _node(at, F.lit(0), F.col("ord"), at, F.lit("comment"), F.col("start"), F.col("end"), F.substring("piece", 1, 3))
    # A comment that opens the file and also stands right above a node gets a
    # second entry without lines, so that both rules find it.
    below = at - 1
    anchor = _node(below, F.lit(0), F.col("next") * 2, below, F.lit("comment"), F.col("end") + 1, F.col("end"), F.substring("piece", 1, 3))
    both = F.array_compact(F.array(node, F.when(F.col("ord") == 0, anchor)))
    return ordered.select("file_id", "language", F.inline(both))


def _dealt(files: DataFrame) -> DataFrame:
    """Files spread over all shuffle partitions, or more where these would hold too much text.

    Reading a text costs far more than its bytes tell, so neither the splits of
    a scan nor partitions merged by their size make tasks of fair length. The
    number is given, so that partitions stay apart, and all pieces of a file are
    where the windows over files need them. A first pass adds up the bytes, so
    that time and memory of a task do not grow with the input.
    """
    size = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(parts, -(-size // TEXT_PER_TASK)), "file_id")


def outline(files: DataFrame) -> DataFrame:
    """Nodes of all non-blank files in a known language (``file_id``, ``language``, ``content``)."""
    readable = _dealt(files.where(~is_blank(F.col("content"))).select("file_id", "language", "content"))
    python = outline_python(readable.where("language = 'python'"))
    script = outline_script(readable.where(F.col("language").isin(*SCRIPT_LANGUAGES)))
    return python.unionByName(script).unionByName(outline_languages(readable))
