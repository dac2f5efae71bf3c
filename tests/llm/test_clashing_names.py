"""Input columns that are called like helper columns keep their values, and the others too."""

import numpy as np
import public_tokenizers as P
import pytest

from debtscope.llm.byte_bpe import encode_texts
from debtscope.llm.decontamination import decontaminate, find_leaks
from debtscope.llm.language_id import LanguageCode, identify
from debtscope.llm.line_dedup import drop_shared_lines
from debtscope.llm.mixing import mix_documents
from debtscope.llm.quality_model import QualityNet, score_quality, word_contexts, word_vectors
from debtscope.llm.quality_rules import clean_lines
from debtscope.llm.simhash import drop_near_copies
from debtscope.llm.suffix_dedup import drop_repeats

#: Names that operators use, or used, beside the input's columns.
NAMES = (
    "row id t lines line key pos salt h1 h2 did dt found gone _id _t _text _gone _lines _ranges _rid rid rt ranges kept_ _row _words _found _copies _size_of _copy "
    "_w _l w l text_ digest hit chosen as copies size mix_id mix_size copy _vector begin end n i of run at stop first last doc_ fp root fingerprint component_id rep _r known hashes"
).split()
TEXTS = ["one two three four five six seven", "", None, "a line\n" * 3 + "other words here", "the quick brown fox jumps over the lazy dog today and on", "x " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}", *[f"{name}-{i}" for name in NAMES]) for i, t in enumerate(TEXTS)]
    kinds = "doc_id long, text string, source string, " + ", ".join(f"`{name}` string" for name in NAMES)
    return spark.createDataFrame(rows, kinds).repartition(2).cache()


def leaks(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today")], "item_id long, text string")


def bpe(docs):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return encode_texts(docs, f.read(), P.PATTERN, chunk=40, overlap=10)


def quality(docs):
    return score_quality(docs, word_vectors(word_contexts(docs)), QualityNet(np.zeros((0, 64)), np.zeros(0)))


OPERATORS = {
    "lines": (lambda s, d: drop_shared_lines(d, min_docs=1), 6),
    "repeats": (lambda s, d: drop_repeats(d), 6),
    "leaks": (lambda s, d: find_leaks(d, leaks(s), clean=True), 6),
    "leaks in passes": (lambda s, d: find_leaks(d, leaks(s), width=3, set_windows=4), 6),
    "documents": (lambda s, d: decontaminate(d, leaks(s)), 5),
    "spans": (lambda s, d: decontaminate(d, leaks(s), "spans"), 6),
    "mix": (lambda s, d: mix_documents(d), None),
    "rules": (lambda s, d: clean_lines(d), 6),
    "copies": (lambda s, d: drop_near_copies(d), 5),
    "quality": (lambda s, d: quality(d), 6),
    "languages": (lambda s, d: identify(d, LanguageCode(["en"], np.ones((1, 8192)))), 6),
    "bpe": (lambda s, d: bpe(d), 6),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_helper_name_as_a_column(spark, docs, name):
    apply, rows = OPERATORS[name]
    out = apply(spark, docs)
    assert len(out.columns) == len(set(out.columns)) and set(NAMES) <= set(out.columns)
    got = out.select("doc_id", "source", *[f"`{n}`" for n in NAMES]).collect()
    assert (len(got) == rows) if rows is not None else got
    assert all(r.source == f"s{r.doc_id % 2}" and all(r[n] == f"{n}-{r.doc_id}" for n in NAMES) for r in got)
