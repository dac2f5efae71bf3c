import re
from collections import Counter as Tally
from itertools import groupby

import numpy as np
import pytest

from debtscope.llm import phrases
from debtscope.llm.phrases import UNKNOWN, mine_phrases

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, shard string, slot string"


def brute(docs, max_words=3, least=10, absorb=50, most=2000):
    f = Tally()
    n = Tally()
    for text, lang in docs:
        lang = UNKNOWN if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    often = {k: a for k, a in f.items() if a >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) > 1 and not any(
            len(q) > len(p) and g == lang and 100 * b >= absorb * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in often.items()
        ):
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    got = []
    for _, rows in groupby(sorted(out, key=lambda r: r[0]), key=lambda r: r[0]):
        ranked = sorted(rows, key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        got += [(r[0], i, *r[1:]) for i, r in enumerate(ranked, 1)]
    return sorted(got)


def mined(spark, docs, **options):
    df = spark.createDataFrame([(i, t, g, 1, "p", "s", "q") for i, (t, g) in enumerate(docs)], SCHEMA).repartition(3)
    return sorted(map(tuple, mine_phrases(df, slots=options.pop("slots", 1 << 16), **options).collect()))


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "de", "la", "Éa", "éa", "x y", "st\x00r", "a", "b"]
    out = []
    for i in range(n):
        picked = rng.choice(words, size=rng.integers(1, 60), p=rng.dirichlet(np.ones(len(words))))
        marks = rng.choice([" ", "  ", "\t", ". ", "\n", ",", " \r\n"], size=len(picked), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        out.append(("".join(w + m for w, m in zip(picked, marks)), ["en", "fr", None][i % 3]))
    return out


@pytest.mark.parametrize("shards,slots", [(1, 1 << 16), (3, 1 << 16), (4, 8)])
def test_against_counting_everything(spark, shards, slots):
    docs = corpus(60, 1) + [(None, "en"), ("", "en"), (" . ,", "de"), ("New york " * 9, "de"), ("New york " * 9 + "b", "de")]
    assert mined(spark, docs, shards=shards, slots=slots) == brute(docs)


def test_longer_phrases_and_cuts(spark):
    docs = corpus(25, 2) + [("one two three four five. " * 12, "en"), ("three four. " * 40, "en")]
    assert mined(spark, docs, max_words=4, min_count=6, absorb_percent=40, most=20) == brute(docs, 4, 6, 40, 20)


def test_threshold_reached_by_the_last_row_only(spark):
    docs = [("p q r", "en")] * 10 + [("p q", "en")] * 9 + [("u v w", "fr")] * 9
    assert mined(spark, docs, shards=4) == brute(docs)


def test_empty_table(spark):
    assert mined(spark, []) == []


@pytest.mark.parametrize("words,text", [(7, 16), (1, 1), (1000, 3)])
def test_parts_of_a_text_count_like_the_whole(words, text, monkeypatch):
    """Phrases across the seams of what is split and looked at together are counted once."""
    monkeypatch.setattr(phrases, "_TEXT", text)
    said = "to be or not to be, that is to be or not to be. " * 5
    scanner, got, want = phrases.Scanner("en", 3, words), Tally(), Tally()
    for some in [*scanner.add(said.encode()), *scanner.add(b"to be"), scanner.flush()]:
        for part in some.phrases(3, 64):
            for batch in part.rows(part.fresh):
                for row in batch.to_pylist():
                    got[row["size"], row["phrase"]] += row["n"]
    for piece in re.split("[.,]", said) + ["to be"]:
        w = piece.split()
        want.update((size, " ".join(w[i : i + size])) for size in (1, 2, 3) for i in range(len(w) - size + 1))
    assert got == want


@pytest.mark.parametrize("words", [3, 1000])
def test_each_phrase_is_counted_for_one_cycle(words):
    """Words from the first step, longer phrases from the step after both subphrases got there."""

    def totals(reached, step):
        count, scanner = phrases.StepCount(reached, step, 2, 9), phrases.Scanner("en", 3, words)
        for some in [*scanner.add(b"a b c. a b"), scanner.flush()]:
            for part in some.phrases(3, 64):
                count.add(part)
        return [int(t.sum()) for t in count.tables]

    reached = [np.full(64, 1, np.uint8), np.full(64, 2, np.uint8), np.zeros(64, np.uint8)]
    assert [totals(reached, step) for step in range(1, 6)] == [[0, 0, 0], [0, 0, 0], [0, 0, 1], [0, 0, 1], [0, 0, 0]]
    assert [totals([np.zeros(64, np.uint8)] * 3, step) for step in (1, 2, 3)] == [[5, 0, 0], [5, 0, 0], [0, 0, 0]]
    words_only = [np.full(64, 1, np.uint8), np.zeros(64, np.uint8), np.zeros(64, np.uint8)]
    assert [totals(words_only, step) for step in (1, 2, 3, 4)] == [[0, 0, 0], [0, 3, 0], [0, 3, 0], [0, 0, 0]]


def test_a_long_text(spark):
    docs = [("alpha beta gamma " * 120_000, "en"), ("beta gamma " * 5 + "!", "en")]
    assert mined(spark, docs) == brute(docs)
