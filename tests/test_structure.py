"""Node operators on outlines of small programs with figures derived by hand."""

import random

import pytest
from pyspark.sql import functions as F

from debtscope.operators.annotations import documentation_gaps, file_records, function_notes
from debtscope.operators.complexity import file_complexity, function_complexity, function_table, with_function_list
from debtscope.operators.documentation import documented_entities, documented_modules, file_documentation
from debtscope.operators.duplication import duplicate_blocks, file_duplication, scoped_duplication, shared_blocks
from debtscope.operators.handling import file_handling, function_handling
from debtscope.operators.nodes import file_outline_metrics
from debtscope.operators.outline import blank_python, outline
from debtscope.operators.running import running
from debtscope.plans.scoring import score_files
from debtscope.schemas import SYNTAX_NODES

PYTHON = {
    "plain": 'def hello(who):\n    return f"Hi {who}"\n',
    "branch": "def sign(v):\n    if v > 0:\n        return 1\n    else:\n        return 0\n",
    "ladder": "def rank(v):\n    if v > 9:\n        r = 3\n    elif v > 6:\n        r = 2\n    elif v > 3:\n        r = 1\n    else:\n        r = 0\n    return r\n",
    "nested": "def total(grid):\n    s = 0\n    for row in grid:\n        for cell in row:\n            if cell:\n                s += cell\n    return s\n",
    "guarded": "def div(a, b):\n    try:\n        return a / b\n    except ZeroDivisionError:\n        return 0\n",
    "two": "def one(x):\n    if x:\n        return 1\n\n\ndef two(x, y):\n    for i in x:\n        if i and y:\n            return i\n",
    "ternary": "def pick(a):\n    assert a\n    return 1 if a else 2\n",
    "folded": "def call(\n    a,\n    b,\n) -> int:\n    if a:\n        return go(\n            b\n        )\n    return 0\n",
    "quoted": 'x = """\nif a:\n  def b(): pass\n"""\n\n\ndef c():\n    """Doc."""\n    return x\n',
    "reads": 'def load(p):\n    try:\n        with open(p) as f:\n            return f.read()\n    except OSError:\n        return None\n',
    "bare": 'def load():\n    try:\n        data = open("f").read()\n    except:\n        pass\n    finally:\n        done()\n',
    "mixed": 'def a():\n    try:\n        return open("x").read()\n    except OSError:\n        return ""\n\n\ndef b():\n    return open("x").read()\n',
    "inner": "def outer(a):\n    def inner(b):\n        if b:\n            return 1\n    if a:\n        return inner(a)\n",
    "documented": '"""Module."""\n\n\nclass Box:\n    """A box."""\n\n    def size(self):\n        # note\n        return 1\n',
}
SCRIPT = {
    "js_plain": "function hi(name) {\n    return `Hi ${name}`;\n}\n",
    "js_branch": 'function sign(x) {\n    if (x > 0) {\n        return "a";\n    } else {\n        return "b";\n    }\n}\n',
    "js_switch": "function day(n) {\n    switch (n) {\n        case 1: return 'a';\n        case 2: return 'b';\n        case 3: return 'c';\n        default: return 'd';\n    }\n}\n",
    "js_catch": "/** Doc. */\nfunction load(url) {\n    try {\n        const r = fetch(url);\n        return r;\n    } catch (error) {\n        return null;\n    }\n}\n",
    "js_open": "function load(url) {\n    return fetch(url);\n}\n",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, "python", v) for k, v in PYTHON.items()] + [(k, "javascript", v) for k, v in SCRIPT.items()]
    return spark.createDataFrame(rows, "file_id string, language string, content string")


@pytest.fixture(scope="module")
def nodes(spark, files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nodes") / "t")
    outline(files).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def functions(nodes):
    return {(r.file_id, r.name): r for r in function_table(nodes).collect()}


@pytest.mark.parametrize(
    ("file", "name", "cyclomatic", "cognitive"),
    [
        ("plain", "hello", 1, 0), ("branch", "sign", 2, 1), ("ladder", "rank", 4, 3), ("nested", "total", 4, 6),
        ("guarded", "div", 2, 1), ("two", "one", 2, 1), ("two", "two", 3.5, 3), ("ternary", "pick", 3, 2),
        ("folded", "call", 2, 1), ("quoted", "c", 1, 0), ("inner", "inner", 2, 1), ("inner", "outer", 3, 3),
        ("js_plain", "hi", 1, 0), ("js_branch", "sign", 2.5, 1), ("js_switch", "day", 4, 3), ("js_catch", "load", 2, 1),
    ],
)
def test_complexity_by_hand(functions, file, name, cyclomatic, cognitive):
    row = functions[(file, name)]
    assert (row.cyclomatic, row.cognitive) == (cyclomatic, cognitive)


def test_function_extents(functions):
    assert (functions[("two", "one")].start_line, functions[("two", "one")].end_line) == (1, 3)
    assert functions[("folded", "call")].line_count == 9


def test_blanking_keeps_lines(spark):
    df = spark.createDataFrame([(v,) for v in PYTHON.values()], "content string")
    for row in df.select("content", blank_python(F.col("content")).alias("b")).collect():
        assert row.content.count("\n") == row.b.count("\n")


def test_handling(nodes, files):
    got = {r.file_id: r for r in function_handling(nodes).collect() if r.file_id not in ("mixed", "two", "inner")}
    assert got["reads"].has_specific and not got["reads"].has_bare and got["reads"].has_try
    assert got["bare"].has_bare and got["bare"].has_finally
    assert (got["bare"].risky_calls, got["bare"].handled_calls) == (2, 2)
    assert got["js_catch"].has_specific and (got["js_catch"].risky_calls, got["js_catch"].handled_calls) == (1, 1)
    assert not got["js_open"].has_try and got["js_open"].handled_calls == 0
    per_file = {r.file_id: r for r in file_handling(function_handling(nodes), files).collect()}
    assert (per_file["mixed"].function_count, per_file["mixed"].functions_with_handling) == (2, 1)
    assert per_file["mixed"].error_handling_score == 0.5
    assert per_file["bare"].error_handling_score == 0.9


def test_documentation(nodes, files):
    flags = {(r.file_id, r.kind, r.name): r.has_docstring for r in documented_entities(nodes).collect()}
    assert flags[("quoted", "function", "c")] and flags[("documented", "class", "Box")]
    assert not flags[("documented", "function", "size")]
    assert flags[("js_catch", "function", "load")] and not flags[("js_open", "function", "load")]
    assert {r.file_id for r in documented_modules(nodes).collect()} == {"documented", "js_catch"}
    lined = files.withColumn("total_lines", F.size(F.split("content", "\n")) - 1)
    rows = {r.file_id: r for r in file_documentation(nodes, lined).collect()}
    assert rows["documented"].doc_coverage == 0.6667 and rows["documented"].comment_lines == 1
    assert rows["plain"].documentation_score == 1.0


def test_files_without_functions(spark, nodes, files):
    extra = files.select("file_id").union(spark.createDataFrame([("none",)], "file_id string"))
    row = file_complexity(function_complexity(nodes), extra).where("file_id = 'none'").first()
    assert (row.function_count, row.complexity_score) == (0, 0.0)
    empty = file_handling(function_handling(nodes), extra).where("file_id = 'none'").first()
    assert empty.error_handling_score == 0.5


def test_scores_in_range_and_errors_reported(spark, files, nodes):
    more = files.union(spark.createDataFrame([("blank", "python", " \n"), ("odd", None, "x"), ("no_tree", "go", "x")], files.schema))
    scores, errors = score_files(more, nodes)
    rows = scores.collect()
    assert len(rows) == files.count() and all(0 <= r.debt_score <= 1 for r in rows)
    assert {r.file_id: r.error for r in errors.collect()} == {
        "blank": "empty file", "odd": "unsupported language", "no_tree": "no syntax tree",
    }


def test_weights_change_the_score(files, nodes):
    def total(weights):
        scores, _ = score_files(files.where("file_id = 'nested'"), nodes.where("file_id = 'nested'"), weights)
        return scores.first().debt_score

    heavy = {"complexity": 0.7, "duplication": 0.1, "documentation": 0.1, "error_handling": 0.1}
    light = {"complexity": 0.1, "duplication": 0.3, "documentation": 0.3, "error_handling": 0.3}
    assert total(heavy) != total(light)


def test_records_and_notes(files, nodes):
    table, entities = function_table(nodes), documented_entities(nodes)
    scores, _ = score_files(files, nodes)
    record = file_records(scores, table, entities).where("file_id = 'ladder'").first()
    assert record.annotations.functions[0].name == "rank" and record.annotations.functions[0].start_line == 0
    assert [g.type for g in record.annotations.doc_gaps] == ["function"]
    assert set(record.dimensions.asDict()) == {"complexity", "duplication", "documentation", "error_handling"}
    assert function_notes(table, threshold="medium").count() == 0
    assert documentation_gaps(entities).where("name = 'c'").count() == 0
    listed = with_function_list(file_complexity(function_complexity(nodes)), table).where("file_id = 'two'").first()
    assert [f.name for f in listed.functions] == ["one", "two"]


def test_outline_metrics(files, nodes):
    row = {r.file_id: r for r in file_outline_metrics(nodes, files).collect()}["documented"]
    assert (row.line_count, row.function_count, row.class_count, row.comment_count) == (9, 1, 1, 1)


def test_complexity_on_random_trees_matches_a_walk(spark):
    rng = random.Random(3)
    kinds = ["if_statement", "assert_statement", "boolean_operator", "function_definition", "pass", "with_statement"]
    rows, expected = [], {}

    def grow(file, depth, clock):
        kind = rng.choice(kinds)
        pre = clock[0]
        clock[0] += 1
        children = [grow(file, depth + 1, clock) for _ in range(rng.randint(0, 3) if depth < 5 else 0)]
        node = {"kind": kind, "pre": pre, "children": children}
        rows.append((file, "python", pre, 0, 0, pre, clock[0] - 1, kind, pre, pre, None))
        return node

    decisions = {"if_statement", "assert_statement", "with_statement"}
    nesting = {"if_statement", "with_statement", "function_definition"}

    def measure(node):
        def count(n):
            own = (1 if n["kind"] in decisions else 0) + (0.5 if n["kind"] == "boolean_operator" else 0)
            return own + sum(count(c) for c in n["children"])

        def load(n, depth):
            score = 0
            for c in n["children"]:
                d = depth + (c["kind"] in nesting)
                score += (1 + max(d, 0) if c["kind"] in decisions else 0) + load(c, d)
            return score

        return 1 + count(node), load(node, -1)

    def visit(file, node):
        if node["kind"] == "function_definition":
            expected[(file, node["pre"])] = measure(node)
        for c in node["children"]:
            visit(file, c)

    for i in range(12):
        clock = [1]
        for _ in range(30):
            visit(f"f{i}", grow(f"f{i}", 0, clock))
    nodes = spark.createDataFrame(rows, SYNTAX_NODES)
    got = {(r.file_id, r.function_id): (r.cyclomatic, r.cognitive) for r in function_complexity(nodes).collect()}
    assert got == expected


def test_running_equals_one_long_window(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), i, rng.randint(-3, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    rows = running(df, ["k"], F.floor(F.col("i") / 16), ["i"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}).collect()
    for r in rows:
        upto = [v for k, i, v in data if k == r.k and i <= r.i]
        assert (r.s, r.m) == (sum(upto), max(upto))


def brute_duplication(content, min_block=4, window=6):
    import hashlib

    lines = content.splitlines()
    clean = [x.strip() for x in lines]
    found = {}
    if len(lines) >= min_block:
        for i in range(len(clean) - window + 1):
            block = clean[i : i + window]
            if sum(1 for x in block if x and not x.startswith(("#", "//", "import ", "from "))) >= min_block // 2:
                found.setdefault(hashlib.md5("\n".join(block).encode()).hexdigest(), []).append(i)
    repeats = {h: p for h, p in found.items() if len(p) > 1}
    covered = {x for p in repeats.values() for i in p for x in range(i, i + window)}
    return len(lines), len(covered), repeats


def test_duplication_against_brute_force(spark):
    rng = random.Random(11)
    texts = ["", "a\nb\n", "x = 1\n" * 20]
    texts += ["\n".join(rng.choice(["a = 1", "b = 2", "", "# c", "import x", "  a = 1 "]) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    for window in (4, 6):
        totals = {r.file_id: r for r in file_duplication(df, window=window).collect()}
        blocks = {}
        for r in duplicate_blocks(df, window=window).collect():
            blocks.setdefault(r.file_id, {})[r.hash] = list(r.positions)
        for i, content in enumerate(texts):
            n, covered, repeats = brute_duplication(content, window=window)
            assert (totals[i].total_lines, totals[i].duplicated_lines) == (n, covered)
            assert blocks.get(i, {}) == repeats


def test_scripts_of_one_line(spark):
    body = "function f%d(a,b){if(a>0&&call%d(b)){return a?b:a}for(var i=0;i<b;i++){a+=i}return a}"
    sources = [(str(n), "javascript", "".join(body % (i, i) for i in range(n))) for n in (1, 500, 3000)]
    nodes = outline(spark.createDataFrame(sources, "file_id string, language string, content string")).cache()
    alone = nodes.where("file_id = '1'").count() - 1
    for n in (500, 3000):
        mine = nodes.where(f"file_id = '{n}'")
        assert mine.count() == mine.select("node_id").distinct().count() == alone * n + 1
    values = function_complexity(nodes).groupBy("file_id").agg(F.count("*").alias("n"), F.min("cyclomatic").alias("low"), F.max("cyclomatic").alias("high"), F.max("cognitive").alias("load"))
    rows = {r.file_id: r for r in values.collect()}
    one = rows["1"]
    # if, for and the ternary; half each for >, && and <; the ternary opens no level of its own
    assert (one.n, one.low, one.load) == (1, 1 + 3 + 0.5 * 3, 1 + 1 + 1)
    for n in (500, 3000):
        assert (rows[str(n)].n, rows[str(n)].low, rows[str(n)].high, rows[str(n)].load) == (n, one.low, one.low, one.load)
    nodes.unpersist()


def test_a_long_python_line_keeps_every_node(spark):
    text = "def f(a):\n    return " + " or ".join(f"g{i}(a)" for i in range(3000)) + "\ndef h():\n    return 1\n"
    nodes = outline(spark.createDataFrame([("p", "python", text)], "file_id string, language string, content string"))
    rows = nodes.groupBy("type").count().collect()
    counts = {r["type"]: r["count"] for r in rows}
    assert (counts["boolean_operator"], counts["call"], counts["function_definition"]) == (2999, 3000, 2)
    assert nodes.count() == nodes.select("node_id").distinct().count()
    assert {r.cyclomatic for r in function_complexity(nodes).collect()} == {1 + 0.5 * 2999, 1.0}


def test_scopes_of_duplication(spark):
    block, other = "\n".join(f"v{i} = {i}" for i in range(6)), "\n".join(f"w{i} = {i}" for i in range(6))
    rows = [("a", "r1", block), ("b", "r1", block + "\nx"), ("c", "r2", block), ("d", "r2", other + "\n" + other), ("e", "r2", "")]
    rows += [(f"n{i}", "hot", block) for i in range(300)]
    df = spark.createDataFrame(rows, "file_id string, repo string, content string")
    lines = {s: {r.file_id: r.duplicated_lines for r in scoped_duplication(df, s).collect()} for s in ("file", "repo", "corpus")}
    assert [lines["file"][k] for k in "abcde"] == [0, 0, 0, 12, 0]
    assert [lines["repo"][k] for k in "abcde"] == [6, 6, 0, 12, 0] and lines["repo"]["n7"] == 6
    assert [lines["corpus"][k] for k in "abcde"] == [6, 6, 6, 12, 0]
    shared = sorted((r.occurrences, r.files) for r in shared_blocks(df).collect())
    assert shared == [(2, 1), (303, 303)]
