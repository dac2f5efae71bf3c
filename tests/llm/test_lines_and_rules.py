"""Shared lines and line-first cleaning."""

import random
from collections import Counter

from debtscope.llm.line_dedup import drop_shared_lines
from debtscope.llm.quality_rules import clean_lines

WHITE = " \t\n\x0b\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def kept_lines(rows, least):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    keys = Counter(k for _, ls in split for k in {x.strip(WHITE).translate(LOWER) for x in ls})
    bad = {k for k, n in keys.items() if n >= least and k}
    out = []
    for i, ls in split:
        stay = [x for x in ls if x.strip(WHITE).translate(LOWER) not in bad]
        out.append((i, "\n".join(stay), len(ls), len(ls) - len(stay)))
    return sorted(out, key=repr)


def test_shared_lines_against_brute_force(make):
    r = random.Random(1)
    pool = ["Home", " home ", "É", "é", "", "  ", "a b", "A B\t", "\x0bx", "long " * 300, "Ünï"]
    rows = [(i % 37, "\n".join(r.choice(pool) + (str(i) if r.random() < 0.2 else "") for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows += [(None, None), (None, "Home\nx"), (5, ""), (5, ""), (7, "\n\n"), (8, "same"), (8, "same")]
    got = drop_shared_lines(make(rows), min_docs=6).collect()
    assert sorted([(g.doc_id, g.text, g.n_lines, g.n_dropped) for g in got], key=repr) == kept_lines(rows, 6)


def test_shared_lines_keeps_extra_columns_and_empty_tables(make):
    docs = make([(1, "a\nb", 9, "s"), (2, "a", 9, None)], "doc_id long, text string, n_lines int, _pos string")
    out = drop_shared_lines(docs, min_docs=2)
    assert out.columns == ["doc_id", "text", "_pos", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "b", "s", 2, 1), (2, "", None, 1, 1)]
    assert drop_shared_lines(make([])).count() == 0


def test_a_line_counts_once_in_a_document(make):
    out = drop_shared_lines(make([(1, "x\nx\nx"), (2, "y")]), min_docs=2)
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {1: 0, 2: 0}


def repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


def test_measures_against_brute_force(make):
    r = random.Random(2)
    rows = [(0, None), (1, ""), (2, " \t\x0b\n"), (3, "a " * 50), (4, "x" * 100_000), (5, "one two three. " * 2_000)]
    rows += [(i, "".join(r.choice(["a ", "b ", "#", "c\n", "\n", "d|", "É "]) for _ in range(r.randint(0, 200)))) for i in range(6, 60)]
    for g in clean_lines(make(rows)).collect():
        text = dict(rows)[g.doc_id] or ""
        words = text.encode().split()
        words = [w.decode() for w in words]
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        assert (g.n_words, g.word_chars) == (len(words), sum(map(len, words)))
        assert g.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert g.n_dup_lines == len(lines) - len(set(lines))
        assert g.n_repeat_words == repeats(words)
        assert g.base_failed == (len(words) < 20 or 100 * repeats(words) > 30 * len(words))
        assert not (g.kept and g.base_failed)


def test_verdict_of_lines(make):
    kinds = [("cats", "sleep in"), ("dogs", "run over"), ("birds", "sing of"), ("cows", "walk to"), ("old men", "talk about"), ("young girls", "draw")]
    clean = "\n".join(f"Sentence {i} says that {who} {what} the {i * 7} gardens behind our house." for i, (who, what) in enumerate(kinds))
    junk = "Home | About | News | Contact | Help\n" + "BUY!! NOW!! ALL!! OF!! IT!! TODAY!! AT!! ONCE!! OR!! NEVER!! EVER!! AGAIN!!"
    rows = [(1, clean), (2, clean + "\nHome | About | News | Help"), (3, "A short start to it.\n" + junk * 2)]
    got = {r.doc_id: r for r in clean_lines(make(rows)).collect()}
    assert got[1].kept and got[1].clean_text == clean and got[1].n_bad_lines == 0
    assert got[2].kept and got[2].clean_text == clean and got[2].n_bad_lines == 1
    assert not got[3].kept and got[3].lost > 0.3


def test_rules_replace_clashing_names_and_run_in_the_row(make):
    docs = make([(1, "a b", 5, "z")], "doc_id long, text string, kept int, _w string")
    out = clean_lines(docs)
    assert out.columns.count("kept") == 1 and out.first().kept is False
    assert "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()
    assert clean_lines(make([])).count() == 0
