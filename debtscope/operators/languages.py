"""Outline of Java, C, C++, Go, Rust, PHP and Ruby: one pass that tables of patterns steer.

Comments, strings and preprocessor lines are blanked inside the row; what is
left is cut into heads of constructs, braces and plain text, and only these
pieces are sorted. Bodies run from an opening mark to the next closing one of
the same depth. Node types are those of public grammars, so some languages
have functions that the analyzers do not count as such, as there.

It is no parser. A construct without braces has no extent; macros are not
expanded; ``<``, ``>``, ``*`` and ``&`` are operators only between blanks; what
follows a here-document's tag on its line is blanked with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.functions.rows import let
from debtscope.functions.text import is_blank

# What blanked text has in place of a line comment, a block comment, a doc comment, a
# preprocessor line, and at the end of each but the first.
_NOTE, _BLOCK, _DOC, _LINE, _END = "\x02", "\x03", "\x04", "\x05", "\x06"
_MARKS = r"\x02|[\x03\x04]\n*+\x06|\x05[a-z]*+\n*+\x06"
_WHITE = " \t\n\x0b\f\r"
# Ordinal of nodes whose order among siblings plays no part.
_LATER = 1 << 30


def nested(opens: str, closes: str, inner: str, depth: int) -> str:
    """Balanced text down to ``depth`` levels; every loop is possessive, so long texts need no stack."""
    out = f"{opens}(?:{inner})*+{closes}"
    for _ in range(depth - 1):
        out = f"{opens}(?:{inner}|{out})*+{closes}"
    return out


_BRACKETS = nested(r"\(", r"\)", r"[^(){}]++", 8)
_SLASHES = r"//(?:[^\n\\]++|\\[\s\S])*+"
_STARS = r"/\*[\s\S]*?(?:\*/|\z)"
_NESTED_STARS = nested(r"/\*", r"(?:\*/|\z)", r"[^*/]++|\*(?!/)|/(?!\*)", 8)
_DOUBLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"?'
_DOUBLE_LONG = r'"(?:[^"\\]++|\\[\s\S])*+"?'
_SINGLE = r"'(?:[^'\\\n]++|\\[\s\S])*+'?"
_SINGLE_LONG = r"'(?:[^'\\]++|\\[\s\S])*+'?"
_DIRECTIVE = r"(?=#)(?<=(?:^|\n)[ \t]{0,80})#(?:[^\n\\]++|\\[\s\S])*+"
_HERE = r"(?<tag>[A-Za-z_]\w*)\k<quote>[^\n]*+\n(?:[^\n]*+\n)*?[ \t]*+\k<tag>\b"
_PATTERN = r"(?=/)(?<=(?:^|[=(,:;!&|?{}\[~\n]|\breturn|\bwhen|\bif|\bunless|\band|\bor|\bnot)[ \t]{0,8})/(?![/*= ])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])*+/[a-z]*+"

# The character that comes next rules out most places before anything else is looked at.
_OPERATORS = r"(?=[=!<>&|*/%^+\-])(?<!\boperator)(?:===|!==|<=>|==|!=|<=|>=|&&|\|\||(?<![<>])<<(?![<=])|(?<![>])>>(?![>=])|(?<=[\w)\]\"] )[<>*/%&|^+\-](?= )|(?<=[\w)\]\"])[+\-/%](?=[\w(])(?!=))"
_TERNARY = r"(?<=\s)\?(?=\s)"


# Patterns of kinds that are no more than words at the start.
_WORDS = re.compile(r"\^(?:\(\?:)?((?:\x05?[a-z_]+|=>)(?:\|[a-z]+)*)\)?")


@dataclass(frozen=True)
class Grammar:
    """Patterns of one language."""

    #: Comments, strings and the text between them, in one left-to-right pass.
    tokens: str
    #: Heads of constructs, first words first; a head may end with its opening brace.
    heads: tuple[tuple[str, str], ...]
    #: Words that stand alone.
    words: tuple[str, ...]
    #: Kinds of pieces: pattern and node type, the first that fits.
    kinds: tuple[tuple[str, str], ...]
    #: Pieces that open a body of members, and pieces that look like functions there or outside of all bodies.
    members: str = r"(?!)"
    function: tuple[tuple[str, str], ...] = ()
    #: The same inside of a body of members, where it differs.
    method: tuple[tuple[str, str], ...] = ()
    #: Patterns of names with one group each, and the type of a name's node.
    names: tuple[str, ...] = (r"(?!)()",)
    name: str = "identifier"
    binary: str = "binary_expression"
    ternary: str = "conditional_expression"
    call: str = "call_expression"
    line_comment: str = "comment"
    block_comment: str = "comment"
    root: str = "translation_unit"

    @property
    def first_words(self) -> dict[str, str]:
        """Kinds that the first word alone decides."""
        found = [(m[1], kind) for pattern, kind in self.kinds if (m := _WORDS.fullmatch(pattern))]
        return {word: kind for words, kind in reversed(found) for word in words.split("|")}

    @property
    def heads_as(self) -> tuple[tuple[str, str], ...]:
        """Kinds that more than the first word of a head decides; they go before it."""
        return tuple(k for k in self.kinds if k[0].startswith("^") and not _WORDS.fullmatch(k[0]))

    @property
    def holding(self) -> tuple[tuple[str, str], ...]:
        """Kinds of pieces that start with anything."""
        return tuple(k for k in self.kinds if not k[0].startswith("^"))

    def parts(self) -> str:
        starts = "|".join([first + rest for first, rest in self.heads] + list(self.words))
        firsts = "|".join([first for first, _ in self.heads] + list(self.words))
        # First words start with a small letter or an equals sign, and never inside of a word: the rest of a word is taken at once.
        return rf"(?:{starts})|[{{}};]|{_MARKS}|(?:(?!(?=[a-z=])(?:{firsts}))(?:\w++|[^{{}};\x02-\x06]))++\{{?"


def _head(words: str, rest: str) -> tuple[str, str]:
    """Words that start a head, and what else belongs to it; plain text ends before the words."""
    return rf"\b(?:{words})\b", rest


_PAREN = rf"\s*+(?:{_BRACKETS})?\s*+\{{?"
_OPEN = rf"(?:[^{{}}();\n]++|{_BRACKETS})*+\{{?"
_FAR = rf"(?:[^{{}}();]++|{_BRACKETS})*+\{{?"
_TEXT = r"(?:[^\"'/#\d]++|\d[\w.']*+)++"
_CALLED = r"^[^=(]*[\w>\])]\s*\((?s:.*)\)[^()=;]*\{$"
_OPERATOR = r"\boperator\b(?s:.*)\)[^()=;]*\{$"

_C = Grammar(
    tokens=rf"{_STARS}|{_SLASHES}|{_DIRECTIVE}|{_DOUBLE}|{_SINGLE}|{_TEXT}|[/#]",
    heads=(_head("if|for|while|switch", _PAREN), _head("else", r"\s*+\{?"), _head("do", r"\s*+\{")),
    words=(r"\bcase\b", r"\bdefault(?=\s*:)"),
    kinds=(
        ("^if", "if_statement"), ("^for", "for_statement"), ("^while", "while_statement"), ("^switch", "switch_statement"), ("^do", "do_statement"),
        ("^else", "else_clause"), ("^(?:case|default)", "case_statement"), ("^\x05include", "preproc_include"),
        (r"\bstruct\b[^()=]*\{$", "struct_specifier"), (r"\bunion\b[^()=]*\{$", "union_specifier"), (r"\benum\b[^()=]*\{$", "enum_specifier"),
    ),
    members=r"\b(?:struct|union)\b[^()=]*\{$|\bextern\s*\"s\"\s*\{$",
    function=((_CALLED, "function_definition"),),
)
_CPP = Grammar(
    tokens=rf"{_STARS}|{_SLASHES}|{_DIRECTIVE}|\bR\"(?<tag>[^()\\\s]{{0,16}})\([\s\S]*?\)\k<tag>\"|{_DOUBLE}|{_SINGLE}|(?:[^\"'/#\dR]++|R(?!\")|\d[\w.']*+)++|[/#R]",
    heads=(_head("if|for|while|switch|catch", _PAREN), _head("else|try", r"\s*+\{?"), _head("do", r"\s*+\{")),
    words=(*_C.words, r"\b(?:public|private|protected)\s*+:(?!:)"),
    kinds=(
        ("^if", "if_statement"), (r"^for\s*\([^;]*:", "for_range_loop"), ("^for", "for_statement"), ("^while", "while_statement"),
        ("^switch", "switch_statement"), ("^do", "do_statement"), ("^else", "else_clause"), ("^try", "try_statement"), ("^catch", "catch_clause"),
        ("^(?:case|default)", "case_statement"), ("^\x05include", "preproc_include"), (r"\benum\b[^()=]*\{$", "enum_specifier"),
        (r"\bclass\b[^()=]*\{$", "class_specifier"), (r"\bstruct\b[^()=]*\{$", "struct_specifier"), (r"\bnamespace\b[^()=]*\{$", "namespace_definition"),
    ),
    members=r"\b(?:class|struct|union|namespace)\b[^()=]*\{$|\bextern\s*\"s\"\s*\{$",
    function=((_CALLED, "function_definition"), (_OPERATOR, "function_definition")),
)
_JAVA = Grammar(
    tokens=rf'{_STARS}|{_SLASHES}|"""[\s\S]*?(?:"""|\z)|{_DOUBLE}|{_SINGLE}|[^"\'/]++|/',
    heads=(_head("if|for|while|switch|catch|synchronized", _PAREN), _head("else|finally", r"\s*+\{?"), _head("try", _PAREN), _head("do", r"\s*+\{")),
    words=_C.words,
    kinds=(
        ("^if", "if_statement"), (r"^for\s*\([^;]*:", "enhanced_for_statement"), ("^for", "for_statement"), ("^while", "while_statement"),
        ("^switch", "switch_expression"), ("^do", "do_statement"), (r"^try\s*\(", "try_with_resources_statement"), ("^try", "try_statement"),
        ("^catch", "catch_clause"), ("^finally", "finally_clause"), ("^(?:case|default)", "switch_label"), ("^synchronized", "synchronized_statement"),
        (r"\bimport\s+[\w.*\s]+$", "import_declaration"), (r"->\s*\{$", "lambda_expression"), (r"@interface\b[^()=]*\{$", "annotation_type_declaration"),
        (r"\bclass\b[^=]*\{$", "class_declaration"), (r"\binterface\b[^()=]*\{$", "interface_declaration"), (r"\benum\b[^()=]*\{$", "enum_declaration"),
        (r"\brecord\s+\w+\s*[<(][^=]*\{$", "record_declaration"), (r"\bnew\s+[\w.<>,\s]+\((?s:.*)\)\s*\{$", "object_creation_expression"),
    ),
    members=r"\b(?:class|interface|enum|record)\b[^=]*\{$|\bnew\s+[\w.<>,\s]+\((?s:.*)\)\s*\{$",
    function=((r"(?:^|\s)(?:(?:public|protected|private)\s+)?[A-Z]\w*\s*\((?s:.*)\)[^()=;]*\{$(?<!\w\s[A-Z])", "constructor_declaration"),),
    method=(
        (r"^\s*(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|protected|private)\s+)?[A-Z]\w*\s*\((?s:.*)\)[^()=;]*\{$", "constructor_declaration"),
        (r"\w\s*\((?s:.*)\)[^()=;]*\{$", "method_declaration"),
    ),
    names=(r"\b(?:class|interface|enum|record)\s+(\w+)[^=]*\{$", r"(\w+)\s*\((?s:.*)\)[^()=;]*\{$"),
    ternary="ternary_expression", call="method_invocation", line_comment="line_comment", block_comment="block_comment", root="program",
)
_GO = Grammar(
    tokens=rf"{_STARS}|{_SLASHES}|`[^`]*+`?|{_DOUBLE}|{_SINGLE}|[^\"'`/]++|/",
    heads=(_head("func", _OPEN), _head("if|for|switch|select", rf"(?:[^{{}}()\n]++|{_BRACKETS})*+\{{?"), _head("type", _OPEN), _head("import", r"\s*+\(?"), _head("else", r"\s*+\{?")),
    words=_C.words,
    kinds=(
        (r"^func\s*\([^()]*\)\s*\w+\s*[(\[]", "method_declaration"), (r"^func\s+\w+", "function_declaration"), ("^func", "func_literal"),
        ("^if", "if_statement"), ("^for", "for_statement"), (r"^switch\b.*:?=?.*\.\(type\)", "type_switch_statement"), ("^switch", "expression_switch_statement"),
        ("^select", "select_statement"), (r"^case", "expression_case"), ("^default", "default_case"), ("^import", "import_declaration"), ("^type", "type_declaration"),
    ),
    names=(r"^func\s*(?:\([^()]*\)\s*)?(\w+)",),
    ternary="", root="source_file",
)
_RUST = Grammar(
    tokens=rf"{_NESTED_STARS}|//[^\n]*+|\bb?r(?<tag>#*+)\"[\s\S]*?\"\k<tag>|{_DOUBLE_LONG}|'(?:[^'\\\n]|\\u\{{[^}}]*+\}}|\\x..|\\.)'|(?:[^\"'/rb]++|[rb](?!r?#*+\")|'(?=[A-Za-z_]\w*+(?!')))++|[/rb']",
    heads=(
        _head("fn", _FAR), _head("impl|trait|struct|enum|union|mod", _FAR),
        _head("if|for|while|match", rf"(?:[^{{}}();]++|{_BRACKETS})*+\{{?"), _head("loop|unsafe|else", r"\s*+\{?"), _head("use", r"[^;{}]*+"),
    ),
    words=("=>",),
    kinds=(
        ("^fn", "function_item"), ("^impl", "impl_item"), ("^trait", "trait_item"), ("^struct", "struct_item"), ("^enum", "enum_item"), ("^union", "union_item"),
        ("^mod", "mod_item"), ("^if", "if_expression"), ("^for", "for_expression"), ("^while", "while_expression"), ("^match", "match_expression"),
        ("^loop", "loop_expression"), ("^unsafe", "unsafe_block"), ("^else", "else_clause"), ("^use", "use_declaration"), ("^=>", "match_arm"),
        (r"\|[^|]*\|\s*\{$", "closure_expression"),
    ),
    names=(r"^fn\s+(\w+)",),
    ternary="", line_comment="line_comment", block_comment="block_comment", root="source_file",
)
_PHP = Grammar(
    tokens=(
        rf"(?:\A|\?>)[\s\S]*?(?:<\?php\b|<\?=|\z)|{_STARS}|//(?:(?!\?>)[^\n])*+|#(?!\[)(?:(?!\?>)[^\n])*+"
        rf"|<<<[ \t]*+(?<quote>[\"']?){_HERE}|{_DOUBLE_LONG}|{_SINGLE_LONG}|[^\"'/#<?]++|[/#<?]"
    ),
    heads=(
        _head("if|elseif|for|foreach|while|switch|match|catch", _PAREN), _head("else|try|finally", r"\s*+\{?"), _head("do", r"\s*+\{"),
        _head("function", rf"\s*+&?\s*+\w*+\s*+(?:{_BRACKETS})?(?:\s*+use\s*+{_BRACKETS})?(?:\s*+:\s*+[\w?|\\\\&\s]++)?\s*+\{{?"),
    ),
    words=_C.words,
    kinds=(
        ("^if", "if_statement"), ("^elseif", "else_if_clause"), ("^else", "else_clause"), ("^foreach", "foreach_statement"), ("^for", "for_statement"),
        ("^while", "while_statement"), ("^switch", "switch_statement"), ("^match", "match_expression"), ("^do", "do_statement"), ("^try", "try_statement"),
        ("^catch", "catch_clause"), ("^finally", "finally_clause"), ("^case", "case_statement"), ("^default", "default_statement"),
        (r"^function\s*&?\s*\(", "anonymous_function"), (r"\bnew\s+class\b[^=]*\{$", "object_creation_expression"),
        (r"\bclass\b[^=]*\{$", "class_declaration"), (r"\binterface\b[^=]*\{$", "interface_declaration"), (r"\btrait\b[^=]*\{$", "trait_declaration"),
        (r"\bnamespace\s+[\w\\]+\s*\{?$", "namespace_definition"), (r"^\s*use\s+[\w\\]+", "namespace_use_declaration"),
    ),
    members=r"\b(?:class|interface|trait|enum)\b[^=()]*\{$",
    function=((r"^function\s*&?\s*\w", "function_definition"),),
    method=((r"^function\s*&?\s*\w", "method_declaration"),),
    names=(r"^function\s*&?\s*(\w+)", r"\b(?:class|interface|trait)\s+(\w+)[^=]*\{$"),
    name="name",
    call="function_call_expression", root="program",
)
# Words of Ruby are words where nothing makes them a symbol, a method or a key.
_RB = r"(?<![\w.:@$])"
_RB_AHEAD = r"(?<=(?:^|[\n;=(,\[|&!]|\bdo|\bthen|\belse|\breturn)[ \t]{0,80})"
_RUBY = Grammar(
    tokens=(
        rf"(?==begin)(?<=(?:^|\n))=begin\b[\s\S]*?(?:\n=end\b[^\n]*+|\z)|(?<=\n)__END__\n[\s\S]*+|#[^\n]*+|<<[~\-]?(?<quote>[\"'`]?){_HERE}"
        rf"|%[wWiIqQ]?(?:\[[^\]]*+\]|\([^)]*+\)|\{{[^}}]*+\}})|{_PATTERN}|{_DOUBLE_LONG}|{_SINGLE_LONG}|`[^`]*+`|(?:[^\"'`/#<%=_]++|=(?!begin\b)|_(?!_END__\n))++|[/#<%=_]"
    ),
    heads=(
        (rf"{_RB}(?:def)\b", r"[^\n;=]*+(?:=(?![=~>])[^\n]*+)?"),
        (rf"{_RB}(?:class|module)\b(?![?!:])", r"[^\n;]*+"),
        (rf"(?=(?:while|until|for)\b){_RB}{_RB_AHEAD}(?:while|until|for)\b(?![?!:])", r"(?:(?!\bdo\b)[^\n;])*+(?:\bdo\b)?"),
        (rf"(?=(?:if|unless|case|begin)\b){_RB}{_RB_AHEAD}(?:if|unless|case|begin)\b(?![?!:])", r"(?:(?!\bthen\b)[^\n;])*+"),
        (rf"{_RB}(?:do)\b(?![?!:])", r"(?:\s*+\|[^|\n]*+\|)?"),
        (rf"{_RB}(?:if|unless|while|until|rescue)\b(?![?!:])", r""),
    ),
    words=tuple(rf"{_RB}{w}\b(?![?!:])" for w in ("elsif", "else", "when", "ensure", "end", "then")),
    kinds=(
        (r"^def\s+self\.", "singleton_method"), ("^def", "method"), (r"^class\s*<<", "singleton_class"), ("^class", "class"), ("^module", "module"),
        ("^if_modifier", "if_modifier"), ("^unless_modifier", "unless_modifier"), ("^while_modifier", "while_modifier"), ("^until_modifier", "until_modifier"),
        ("^if", "if"), ("^unless", "unless"), ("^while", "while"), ("^until", "until"), ("^for", "for"), ("^case", "case"), ("^begin", "begin"),
        ("^do", "do_block"), ("^rescue", "rescue"), ("^ensure", "ensure"), ("^elsif", "elsif"), ("^else", "else"), ("^when", "when"),
    ),
    names=(r"^(?:def\s+(?:self\.)?|class\s+|module\s+)(\w+)",),
    binary="binary", ternary="conditional", call="call", root="program",
)

#: What opens a body in Ruby beside a brace; a modifier is its word alone, and a method of one expression ends on its line.
_RUBY_OPENS = r"^do\b|^(?:class|module|while|until|for|if|unless|case|begin)\b(?!:)(?s:.)+|^begin$|^def\b(?!\s+[\w.?!]+\s*(?:\([^()]*\))?\s*=\s)"
#: Kinds of nodes that have a name of their own.
_NAMED = r"^(?:function_d|function_item|method|singleton_method|constructor|class|interface|enum_decl|record|module$|trait_d)"

GRAMMARS: dict[str, Grammar] = {"java": _JAVA, "c": _C, "cpp": _CPP, "go": _GO, "rust": _RUST, "php": _PHP, "ruby": _RUBY}
_NOT_CALLED = (
    "if", "for", "while", "switch", "catch", "return", "sizeof", "synchronized", "function", "fn", "func", "elseif", "foreach", "match", "and", "or", "not",
    "new", "super", "this", "else", "do", "try", "case", "unless", "until", "when", "throw", "def", "select", "array", "list", "isset", "unset", "elsif",
)


def _of(language: Column, value: Callable[[Grammar], object], build: Callable[[object], Column] = F.lit) -> Column:
    """A value by language; languages that share one share its expression."""
    shared: dict[object, list[str]] = {}
    for name, grammar in GRAMMARS.items():
        shared.setdefault(value(grammar), []).append(name)
    parts = list(shared.items())
    out = build(parts[-1][0])
    for part, names in reversed(parts[:-1]):
        out = F.when(language.isin(*names), build(part)).otherwise(out)
    return out


def _breaks(token: Column) -> Column:
    return F.repeat(F.lit("\n"), _n_breaks(token))


def _n_breaks(token: Column) -> Column:
    return F.octet_length(token) - F.octet_length(F.replace(token, F.lit("\n"), F.lit("")))


def _blanked(content: Column, language: Column) -> Column:
    """Text with marks for comments and preprocessor lines and without string bodies; the line count stays."""

    def short(t: Column) -> Column:
        first, two = F.substring(t, 1, 1), F.substring(t, 1, 2)
        slashes = language != "ruby"
        block = ((two == "/*") & slashes) | (t.startswith("=begin") & ~slashes)
        note = ((two == "//") & slashes) | ((first == "#") & language.isin("php", "ruby") & (F.length(t) > 1))
        directive = (first == "#") & language.isin("c", "cpp") & (F.length(t) > 1)
        outside = (language == "php") & (t.rlike(r"^\?>") | t.rlike(r"<\?(?:php|=)$"))
        text = first.isin('"', "'", "`") | t.rlike(r'^(?:b?r#*"|R"|<<<|<<[~\-]?["\'`]?[A-Za-z_]|%[wWiIqQ]?[\[({]|/.)')
        return (
            F.when(outside, F.concat(F.lit(";"), _breaks(t)))
            .when(block & t.startswith("/**"), F.concat(F.lit(_DOC), _breaks(t), F.lit(_END)))
            .when(block, F.concat(F.lit(_BLOCK), _breaks(t), F.lit(_END)))
            .when(note, F.concat(F.lit(_NOTE), _breaks(t)))
            .when(directive, F.concat(F.lit(_LINE), F.regexp_extract(t, r"^#\s*([a-z]*)", 1), _breaks(t), F.lit(_END)))
            .when(t.startswith("__END__"), F.lit("\n"))
            .when(text & (F.length(t) > 1), F.concat(F.lit('"s"'), _breaks(t)))
            .otherwise(t)
        )

    plain = F.translate(content, "\r" + _NOTE + _BLOCK + _DOC + _LINE + _END, "")
    # A pattern that is no literal is compiled anew for every other row.
    tokens = _of(language, lambda g: g.tokens, lambda p: F.regexp_extract_all(plain, F.lit(p), F.lit(0)))
    joined = F.array_join(F.transform(tokens, short), "")
    return F.when(language == "go", F.regexp_replace(joined, r"\b(interface|struct)\{\}", "$1  ")).otherwise(joined)


def _first_kind(token: Column, kinds: tuple[tuple[str, str], ...], braced: Column | None = None) -> Column:
    """Type of the first pattern that fits; where ``braced`` is false, those that ask for a brace at the end are not tried."""
    none = F.lit(None).cast("string")
    fits = lambda p: token.rlike(p) if braced is None or not p.endswith(r"\{$") else braced & token.rlike(p)
    return reduce(lambda c, kv: F.when(fits(kv[0]), F.lit(kv[1])).otherwise(c), reversed(kinds), none)


def _plain_kind(language: Column, token: Column) -> Column:
    """Kind of a piece by itself: what its head says, its first word, or what it holds."""
    braced = token.contains("{")
    modifier = (language == "ruby") & token.isin("if", "unless", "while", "until")
    key = F.when(modifier, F.concat(token, F.lit("_modifier"))).otherwise(F.regexp_extract(token, r"^(=>|\x05?[a-z]+)\b(?!:)|^(=>)", 0))
    words = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(
        _of(language, lambda g: g.heads_as, lambda kinds: _first_kind(token, kinds, braced)),
        _of(language, lambda g: tuple(g.first_words.items()), lambda pairs: F.try_element_at(words(pairs), key)),
        _of(language, lambda g: g.holding, lambda kinds: _first_kind(token, kinds, braced)),
    )


def _all(token: Column, pattern: str) -> Column:
    return F.regexp_extract_all(token, F.lit(pattern), F.lit(0))


def _leaves(kind: Column, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(kind.alias("type"), t.alias("text"), F.lit(2).alias("role")))


def _called(token: Column, defines: Column) -> Column:
    """Called names as ``name(``; the name that a definition gives itself is none."""
    names = F.regexp_extract_all(token, F.lit(r"(?=[A-Za-z_$])(?<![\w.$>:])(?<!\bnew )((?:[A-Za-z_$][\w$]*(?:\.|->|::))*[A-Za-z_$][\w$]*[?!]?)\s?\("), F.lit(1))
    kept = F.filter(names, lambda n: ~n.isin(*_NOT_CALLED))
    own = F.when(defines, F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    return F.transform(own, lambda n: F.concat(n, F.lit("(")))


def _apart(value: Column) -> Column:
    """``value``; a projection that holds a lambda is generated in many small methods, outside of its stage's long one.

    So many patterns in one method would be too long to be compiled, and in a
    lambda's body each step would be interpreted for every piece.
    """
    return let(value, lambda v: v)


def _described(pieces: DataFrame) -> DataFrame:
    """Pieces with their kind, name and items, a projection for each."""
    language, token, opens, note, kind, name = map(F.col, ("language", "token", "opens", "note", "kind", "name"))
    method = _of(language, lambda g: g.method or g.function, lambda kinds: _first_kind(token, kinds))
    function = _of(language, lambda g: g.function, lambda kinds: _first_kind(token, kinds))
    defined = F.when(opens & F.col("inside"), method).when(opens & (F.col("depth") == 0), function)
    names = [F.nullif(_of(language, lambda g, i=i: g.names[i] if i < len(g.names) else "(?!)()", lambda p: F.regexp_extract(token, p, 1)), F.lit("")) for i in (0, 1)]
    # Roles: 0 leads a piece, 1 is its name, 2 a leaf in it.
    single = lambda kind, text, role: F.array(F.struct(kind.alias("type"), text.alias("text"), F.lit(role).alias("role")))
    none = F.array().cast("array<struct<type:string,text:string,role:int>>")
    mark = F.when(language == "ruby", "#").when(token.startswith(_NOTE), "//").when(token.startswith(_DOC), "/**").otherwise("/*")
    comment = F.when(token.startswith(_NOTE), _of(language, lambda g: g.line_comment)).otherwise(_of(language, lambda g: g.block_comment))
    text = F.when(note | token.startswith(_LINE), F.lit("")).otherwise(token)
    # A search for one character is cheaper than a pattern that finds nothing.
    items = F.concat(
        F.when(note, single(comment, mark, 0)).when(kind.isNotNull(), single(kind, token, 0)).when(F.col("closes"), single(F.lit("}"), token, 0)).otherwise(none),
        F.when(name.isNotNull(), single(_of(language, lambda g: g.name), name, 1)).otherwise(none),
        F.when(text.rlike(r"[=!<>&|*/%^+\-]"), _leaves(_of(language, lambda g: g.binary), _all(text, _OPERATORS))).otherwise(none),
        F.when(text.contains("?") & (_of(language, lambda g: g.ternary) != ""), _leaves(_of(language, lambda g: g.ternary), _all(text, _TERNARY))).otherwise(none),
        F.when(text.contains("("), _leaves(_of(language, lambda g: g.call), _called(text, F.coalesce(kind.rlike("function|method|constructor|record|singleton"), F.lit(False))))).otherwise(none),
    )
    return (
        pieces.withColumn("kind", F.when(~_apart(note), F.coalesce(_plain_kind(language, token), defined)))
        .withColumn("name", F.when(_apart(kind.rlike(_NAMED) & (opens | (language == "ruby"))), F.coalesce(*names)))
        .withColumn("items", items)
    )


def _stripped(raw: Column) -> Column:
    """Text without white space at its ends; a pattern's end also stands before a separator of lines beyond ASCII."""
    ascii_only = F.octet_length(raw) == F.length(raw)
    return F.when(ascii_only, F.btrim(raw, F.lit(_WHITE))).otherwise(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")))


def outline_languages(files: DataFrame) -> DataFrame:
    """Nodes of the files in the languages of ``GRAMMARS`` (``file_id``, ``language``, ``content``).

    Positions are numbers without gaps per file, in the order of the text. A
    ``try`` runs on to the end of its last handler. All pieces of a file count
    as siblings in its order, so a comment right before a construct is the one
    before it, and comments at the top of a file are its first children.
    """
    language = F.col("language")
    blanked = files.where(language.isin(*GRAMMARS) & ~is_blank(F.col("content"))).select(
        "file_id", "language", _blanked(F.col("content"), language).alias("_text")
    )
    parts = _of(language, lambda g: g.parts(), lambda p: F.regexp_extract_all("_text", F.lit(p), F.lit(0)))
    token, raw = F.col("token"), F.col("raw")
    pieces = blanked.select("file_id", "language", F.posexplode(parts).alias("at", "raw")).withColumn("token", _stripped(raw))
    bare = ~F.ascii(token).between(2, 5)
    opens = bare & token.contains("{") & token.rlike("[{]$") | ((language == "ruby") & bare & token.rlike(_RUBY_OPENS) & ~token.isin("if", "unless", "while", "until"))
    closes = F.when(language == "ruby", token.isin("}", "end")).otherwise(token == "}")
    so_far = W.partitionBy("file_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    breaks, lead = _n_breaks(raw), _n_breaks(F.ltrim(raw, F.lit(_WHITE)))
    placed = (
        pieces.withColumn("opens", opens)
        .withColumn("closes", closes)
        .withColumn("breaks", breaks)
        .withColumn("lead", lead)
        .drop("raw")
        .withColumn("line", 1 + F.sum("breaks").over(so_far) - F.col("lead"))
        .withColumn("depth", F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(so_far) - F.col("opens").cast("int"))
        .where((token != "") & (token != ";"))
    )
    note = F.ascii(token).between(2, 4)
    along = W.partitionBy("file_id").orderBy("at")
    # Pieces stand for siblings; a tag stands before those of PHP.
    rank = F.row_number().over(along) - F.when(language == "php", 0).otherwise(1)
    noted = placed.withColumn("note", note).withColumn("rank", rank)

    # A body of members opens one level down; the last one opened at a level holds what stands there.
    members = let(F.struct("language", "token"), lambda x: _of(x["language"], lambda g: g.members, lambda p: x["token"].rlike(p)))
    holds = F.when(F.col("opens"), members).otherwise(F.lit(False))
    level = lambda n, own: F.struct((F.col("depth") + n).alias("level"), F.lit(own).alias("own"))
    levels = F.when(F.col("opens"), F.array(level(0, True), level(1, False))).otherwise(F.array(level(0, True)))
    holder = F.last(F.when(~F.col("own"), F.col("members")), ignorenulls=True).over(W.partitionBy("file_id", "level").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    held = noted.withColumn("members", holds).select("*", F.inline(levels)).withColumn("inside", F.coalesce(holder, F.lit(False)) & (F.col("depth") > 0)).where("own")
    # Items are numbered and bodies closed before the items become rows: sorts see pieces only.
    listed = _described(held).select(
        "file_id", "language", "at", "line", "depth", "kind", "name", "opens", "closes", "note", "rank", "items", _n_breaks(token).alias("breaks")
    )
    numbered = listed.withColumn("pos", F.sum(F.size("items")).over(so_far) - F.size("items") + 1).withColumn(
        "leads", ~F.col("note") & F.coalesce(F.get("items", F.lit(0))["role"] == 0, F.lit(False))
    )

    goes_on = F.coalesce(F.col("kind").isin("catch_clause", "finally_clause"), F.lit(False))
    # Read backwards, the last closing mark seen at a depth is the next one, and what a try leads has as many others after it.
    backwards = W.partitionBy("file_id", "depth").orderBy(F.col("at").desc()).rowsBetween(W.unboundedPreceding, -1)
    closing = F.last(F.when(F.col("leads") & F.col("closes"), F.struct("pos", "line")), ignorenulls=True).over(backwards)
    marks = (
        numbered.withColumn("close", closing)
        .withColumn("chain", F.sum(F.when(F.col("leads") & ~goes_on & ~F.col("closes"), 1).otherwise(0)).over(backwards))
        .withColumn("close", F.when(F.col("leads") & F.col("opens") & F.col("kind").isNotNull(), F.col("close")))
        .withColumn("chain", F.coalesce("chain", F.lit(0)))
        .withColumn("handled", F.max(F.when(F.col("leads") & goes_on, F.col("close"))).over(W.partitionBy("file_id", "depth", "chain")))
    )
    tries = F.col("kind").isin("try_statement", "try_with_resources_statement")
    end = F.when(F.col("leads"), F.when(tries, F.coalesce("handled", "close")).otherwise(F.col("close")))
    line, zero, pos = F.col("line"), F.lit(0), F.col("pos") + F.col("sub")
    rows = (
        marks.withColumn("end", end)
        .select("file_id", "language", "line", "kind", "name", "note", "rank", "breaks", "pos", "leads", "end", F.posexplode_outer("items").alias("sub", "item"))
        .where((F.col("item.role") > 0) | F.col("kind").isNotNull() | F.col("note"))
    )
    role = F.col("item.role")
    last = line + F.when(role == 0, F.col("breaks")).otherwise(0)
    leading = F.col("leads") & (role == 0)
    named_end = pos + F.when(leading & F.col("name").isNotNull(), 1).otherwise(0)
    nodes = rows.select(
        "file_id",
        "language",
        pos.cast("long").alias("node_id"),
        F.when(role == 1, pos - 1).otherwise(zero).cast("long").alias("parent_id"),
        F.when(role == 0, F.col("rank")).when(role == 1, zero).otherwise(F.lit(_LATER)).alias("sibling_ord"),
        pos.cast("long").alias("pre"),
        F.coalesce(F.when(leading, F.col("end.pos")), named_end).cast("long").alias("post"),
        "item.type",
        line.cast("long").alias("start_line"),
        F.coalesce(F.when(leading, F.col("end.line")), last).cast("long").alias("end_line"),
        "item.text",
    )
    known = files.where(language.isin(*GRAMMARS) & ~is_blank(F.col("content")))
    root = known.select(
        "file_id", "language", zero.cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), zero.alias("sibling_ord"), zero.cast("long").alias("pre"),
        F.lit(1 << 50).alias("post"), _of(language, lambda g: g.root).alias("type"), zero.cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"),
        F.lit(None).cast("string").alias("text"),
    )
    return root.unionByName(nodes)
