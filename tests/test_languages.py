"""Outlines of more languages, continued lines and regular expressions, on small programs read by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from debtscope.operators.complexity import function_complexity
from debtscope.operators.documentation import documented_entities, documented_modules
from debtscope.operators.handling import function_handling
from debtscope.operators.languages import GRAMMARS, outline_languages
from debtscope.operators.outline import join_lines, outline
from debtscope.plans.scoring import score_files

SOURCES = {
    "c": '/* top { */\n#include <stdio.h>\n#define F(x) { \\\n  x\n/** Doc. */\nstatic int add(int a,\n               int b)\n{\n  char c = \'{\'; // note }\n  if (a > 1 && b < 2) {\n    a = open(a, "}");\n  } else {\n    b = a * 2;\n  }\n  for (int i = 0; i < 3; i++) { a += i; }\n  switch (a) { case 1: break; default: break; }\n  return a ? b : a - 1;\n}\nstruct p { int x; };\nint z[] = {1, 2};\n',
    "cpp": 'namespace n {\nclass A : public B {\n public:\n  A(int x) : x_(x) { x_ = 1\'000; }\n  virtual int get(const std::vector<int>& v) const override {\n    try { return v.at(0); } catch (const E& e) { throw; }\n    auto s = R"x(" } ")x";\n    for (auto q : v) { q++; }\n    list_for_each(x) { y(); }\n  }\n  bool operator==(const A& o) const { return x_ == o.x_; }\n};\n}\n',
    "java": '/** Top. */\npackage a.b;\nimport java.util.*;\n/** Class. */\npublic class A extends B {\n  @Override\n  public int f(int a, int b) throws E {\n    String s = """\n      { text }\n      """;\n    if (a > b) { run(() -> { go(); }); }\n    try { open(a); } catch (X e) { } catch (Y e) { } finally { close(); }\n    return a;\n  }\n  A() { super(); }\n  Runnable r = new Runnable() { public void run() { x(); } };\n}\n',
    "go": 'package main\nimport "fmt"\n// note\n/** Doc */\nfunc add(a int, x interface{}) (int, error) {\n\ts := `raw { "`\n\tif v := f(a); v > 1 && a != 2 {\n\t\treturn v + 1, nil\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tgo func() { fmt.Println(i) }()\n\t}\n\tswitch x.(type) {\n\tcase int:\n\t\ta = 1\n\t}\n\tr := \'{\'\n\treturn a, nil\n}\nfunc (p *P) get() int { return p.x }\ntype P struct {\n\tx int\n}\n',
    "rust": "/* a /* nested { */ still */\nuse std::io;\n/// doc\nfn add<'a>(x: &'a str, c: char) -> i32 where i32: Copy {\n    let s = r#\"raw \" { \"#;\n    let q = '{';\n    if x.len() > 1 { foo(x); } else { bar!(x); }\n    for i in 0..3 { baz(i); }\n    while let Some(y) = it.next() { y; }\n    match c { 'a' => 1, _ => { 2 } };\n    let f = |z| { z + 1 };\n    1\n}\nimpl<T> Foo for Bar<T> { fn new() -> Self { Bar {} } }\nstruct S { a: i32 }\n",
    "php": "<html> { <?php\n/** Doc. */\nfunction add($a, $b = 2): int {\n    $s = <<<EOT\n { text \"\nEOT;\n    # note {\n    if ($a > 1 && $b < 2) { $a = open($a); } elseif ($b) { $x = \"{$a}\"; }\n    try { f($a); } catch (E $e) { g(); } finally { h(); }\n    foreach ($a as $k => $v) { echo $v; }\n    return $a . 'x}';\n}\nclass A extends B { public function m() { $f = function ($x) use ($y) { return $x; }; } }\n?> trailing { html\n",
    "ruby": '# note\nrequire "x"\n=begin\ndef no\n=end\nmodule M\n  class A < B\n    def add(a, b = 2)\n      x = if a > 1 then 2 else 3 end\n      return 1 if a && b\n      while a < 3 do\n        a += 1\n      end\n      [1].each do |v|\n        puts v\n      end\n      begin\n        open(a)\n      rescue E => e\n        raise\n      ensure\n        close\n      end\n      s = <<~EOT\n        def x\n      EOT\n      y = { if: 1, end: 2 }\n      z = a / b\n      r = /end "/\n    end\n    def self.short(x) = x + 1\n  end\nend\n',
}
# Nodes that matter, by language: type, first and last line.
WANTED = {
    "c": [("function_definition", 6, 18), ("if_statement", 10, 12), ("else_clause", 12, 14), ("for_statement", 15, 15), ("switch_statement", 16, 16), ("case_statement", 16, 16), ("case_statement", 16, 16), ("struct_specifier", 19, 19), ("preproc_include", 2, 2)],
    "cpp": [("namespace_definition", 1, 13), ("class_specifier", 2, 12), ("function_definition", 4, 4), ("function_definition", 5, 10), ("function_definition", 11, 11), ("try_statement", 6, 6), ("catch_clause", 6, 6), ("for_range_loop", 8, 8)],
    "java": [("import_declaration", 3, 3), ("class_declaration", 5, 17), ("method_declaration", 6, 14), ("if_statement", 11, 11), ("lambda_expression", 11, 11), ("try_statement", 12, 12), ("catch_clause", 12, 12), ("catch_clause", 12, 12), ("finally_clause", 12, 12), ("constructor_declaration", 15, 15), ("object_creation_expression", 16, 16), ("method_declaration", 16, 16)],
    "go": [("import_declaration", 2, 2), ("function_declaration", 5, 19), ("if_statement", 7, 9), ("for_statement", 10, 12), ("func_literal", 11, 11), ("type_switch_statement", 13, 16), ("expression_case", 14, 14), ("method_declaration", 20, 20), ("type_declaration", 21, 23)],
    "rust": [("use_declaration", 2, 2), ("function_item", 4, 13), ("if_expression", 7, 7), ("else_clause", 7, 7), ("for_expression", 8, 8), ("while_expression", 9, 9), ("match_expression", 10, 10), ("match_arm", 10, 10), ("match_arm", 10, 10), ("closure_expression", 11, 11), ("impl_item", 14, 14), ("function_item", 14, 14), ("struct_item", 15, 15)],
    "php": [("function_definition", 3, 12), ("if_statement", 8, 8), ("else_if_clause", 8, 8), ("try_statement", 9, 9), ("catch_clause", 9, 9), ("finally_clause", 9, 9), ("foreach_statement", 10, 10), ("class_declaration", 13, 13), ("method_declaration", 13, 13), ("anonymous_function", 13, 13)],
    "ruby": [("module", 6, 33), ("class", 7, 32), ("method", 8, 30), ("if", 9, 9), ("else", 9, 9), ("if_modifier", 10, 10), ("while", 11, 13), ("do_block", 14, 16), ("begin", 17, 23), ("rescue", 19, 19), ("ensure", 21, 21), ("singleton_method", 31, 31)],
}
LEAVES = {
    "c": {"binary_expression": 6, "conditional_expression": 1, "call_expression": 1, "comment": 3},
    "cpp": {"binary_expression": 1, "call_expression": 4},
    "java": {"binary_expression": 1, "method_invocation": 5, "block_comment": 2, "identifier": 4},
    "go": {"binary_expression": 5, "call_expression": 2, "comment": 2, "identifier": 2},
    "rust": {"binary_expression": 2, "call_expression": 6, "block_comment": 1, "line_comment": 1, "identifier": 2},
    "php": {"binary_expression": 3, "function_call_expression": 4, "comment": 2, "name": 3},
    "ruby": {"binary": 6, "call": 1, "comment": 2, "identifier": 4},
}


@pytest.fixture(scope="module")
def nodes(spark):
    files = spark.createDataFrame([(k, k, v) for k, v in SOURCES.items()], "file_id string, language string, content string")
    out = outline(files).cache()
    yield out
    out.unpersist()


@pytest.mark.parametrize("language", SOURCES)
def test_constructs_and_extents(nodes, language):
    rows = nodes.where(F.col("file_id") == language).collect()
    leaves = LEAVES[language]
    found = sorted((r.type, r.start_line, r.end_line) for r in rows if r.parent_id is not None and r.type not in {*leaves, "name", "identifier"})
    assert found == sorted(WANTED[language])
    counts = {kind: sum(r.type == kind for r in rows) for kind in leaves}
    assert counts == leaves
    assert len({r.node_id for r in rows}) == len(rows)
    spans = [(r.pre, r.post) for r in rows if r.post > r.pre]
    assert all(b < c or (a < c and d <= b) for a, b in spans for c, d in spans if a < c)


def test_languages_are_scored(spark, nodes):
    figures = {(r.file_id, r.cyclomatic, r.cognitive) for r in function_complexity(nodes).collect()}
    # Operators count a half each; only Python and scripts have decisions.
    assert figures == {("c", 1 + 0.5 * 6, 0), ("cpp", 1.0, 0), ("cpp", 1.5, 0), ("go", 1 + 0.5 * 5, 0), ("php", 1 + 0.5 * 3, 0)}
    tries = {(r.file_id, r.has_try, r.has_specific, r.has_finally) for r in function_handling(nodes).collect()}
    assert ("php", True, True, True) in tries and ("cpp", True, True, False) in tries and ("c", False, False, False) in tries
    notes = {(r.file_id, r.kind, r["name"], r.has_docstring) for r in documented_entities(nodes).collect()}
    assert {("c", "function", "<anonymous>", True), ("go", "function", "add", True), ("php", "function", "<anonymous>", True), ("java", "class", "A", False)} <= notes
    assert {r.file_id for r in documented_modules(nodes).collect()} == {"c"}
    files = spark.createDataFrame([(k, k, v) for k, v in SOURCES.items()], "file_id string, language string, content string")
    scores, errors = score_files(files, nodes)
    assert scores.count() == len(GRAMMARS) and errors.count() == 0


def test_odd_texts(spark):
    texts = ["", " \n", "{{{", "}}}", "/* open", '"open', "end end", "def", "\x02\x03\n\x06", "if", "<?php", "é { 日本 }", "'", "a" * 50_000, "(" * 3_000, "{" * 2_000 + "}" * 2_000, "/*" * 3_000, "* a\n" * 20_000 + "/* " + "* a\n" * 20_000]
    rows = [(f"{g}{i}", g, t) for g in GRAMMARS for i, t in enumerate(texts)] + [("n", "c", None)]
    found = outline(spark.createDataFrame(rows, "file_id string, language string, content string"))
    roots = found.where("parent_id is null")
    assert roots.count() == len(GRAMMARS) * sum(bool(t.strip()) for t in texts)
    assert found.count() >= roots.count() and found.where("post < pre or end_line < start_line").count() == 0
    assert outline(spark.createDataFrame([], "file_id string, language string, content string")).count() == 0


PYTHON = '''def f(a,
      b=(1,
         2)):
    """Doc
    of it."""
    if (a and
            open(b,
                 c)
            or d):
        return [
            g(x)
            for x in a
        ]
    total = a \\
        and b
    x = """
    if not code:
    """ + h(
        a)
    return {
        "if": 1,
    }
def k():
    return 1
'''


def test_continued_python_lines_are_one_statement(spark):
    nodes = outline(spark.createDataFrame([("p", "python", PYTHON)], "file_id string, language string, content string")).cache()
    rows = nodes.collect()
    kinds = [r.type for r in rows]
    assert [(r.start_line, r.end_line) for r in sorted(rows, key=lambda r: r.pre) if r.type == "function_definition"] == [(1, 22), (23, 24)]
    assert [(r.start_line, r.end_line) for r in rows if r.type == "if_statement"] == [(6, 13)]
    assert (kinds.count("boolean_operator"), kinds.count("call"), kinds.count("string"), kinds.count("for_statement")) == (3, 3, 1, 0)
    figures = sorted(r.cyclomatic for r in function_complexity(nodes).collect())
    assert figures == [1.0, 1 + 1 + 0.5 * 3]
    assert {r["name"]: r.has_docstring for r in documented_entities(nodes).collect()} == {"f": True, "k": False}


def test_joined_lines_keep_their_number(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["(", ")", "[", "]", "{", "}", "\n", "\n", "\\\n", "a", ' "s" ']) for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", join_lines(F.col("t")).alias("j")).collect()
    assert all(x.j.count("\n") == x.t.count("\n") for x in rows)
    deep = "f(" * 10 + "a,\nb" + ")" * 10 + "\nc"
    assert spark.createDataFrame([(deep,)], "t string").select(join_lines(F.col("t"))).first()[0] == "f(" * 10 + "a, b" + ")" * 10 + "\n\x01\nc"


SCRIPT = """function f(a, b) {
  if (a &&
      b) {
    return /a && b/.test(a);
  }
  const c = a / b / 2;
  const d = [/x{2}/, "y"].map(z => z.match(/[/"'}]/g));
  call(a,
       b);
  return a +
    b;
}
"""


def test_regular_expressions_and_continued_heads_of_scripts(spark):
    nodes = outline(spark.createDataFrame([("s", "javascript", SCRIPT)], "file_id string, language string, content string")).cache()
    rows = nodes.collect()
    assert [(r.start_line, r.end_line) for r in rows if r.type == "function_declaration"] == [(1, 12)]
    assert [(r.start_line, r.end_line) for r in rows if r.type == "if_statement"] == [(2, 5)]
    # && in the condition and + at the end of a line
    assert sum(r.type == "binary_expression" for r in rows) == 2
    assert sum(r.type == "call_expression" for r in rows) == 4


def test_pieces_are_described_outside_of_lambdas(spark):
    files = spark.createDataFrame([(1, "c", "int f(int a) {\nreturn a;\n}")], "file_id long, language string, content string")
    plan = outline_languages(files)._jdf.queryExecution().executedPlan().toString()
    # A lambda over a piece's token and depth has every kind interpreted for every piece.
    assert not re.search(r"struct\(language, \S+, token, \S+, depth, ", plan)


def test_words_are_taken_whole_and_white_space_is_cut(spark):
    text = "int iffy_if(int x_if) {\n \telsewhere = diffuse(x_if) + operator_(a);\x0b\n  forx(a); é_if(a) \n}\r\n"
    files = spark.createDataFrame([(1, "c", text)], "file_id long, language string, content string")
    rows = outline_languages(files).where("node_id > 0").orderBy("node_id").select("type", "start_line", "text").collect()
    assert [tuple(r) for r in rows] == [
        ("function_definition", 1, "int iffy_if(int x_if) {"),
        ("binary_expression", 2, "+"),
        ("call_expression", 2, "diffuse("),
        ("call_expression", 2, "operator_("),
        ("call_expression", 3, "forx("),
        ("call_expression", 3, "_if("),
    ]
