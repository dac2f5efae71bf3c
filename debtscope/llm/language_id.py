"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from debtscope.llm.shared import in_arrow, with_columns

BUCKETS = 1 << 13
UNDETERMINED = "und"
#: Text bytes looked at together; n-grams across a seam are counted with the later part.
_CHUNK = 1 << 18
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ngram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Hash buckets of the trigrams of bytes of the whole text, in parts; anything but letters is a blank."""
    plain = b" " + text.translate(_PLAIN) + b" "
    for at in range(0, len(plain) - 2, _CHUNK):
        b = np.frombuffer(plain[at : at + _CHUNK + 2], np.uint8).astype(np.uint32)
        gram = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        yield (gram * np.uint32(2654435761)) >> np.uint32(32 - 13)


def has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or any(map(str.isalpha, text.decode("utf-8", "replace")))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per class; no two columns part the classes alike.

    Up to seven classes get the exhaustive code, a column for each way of
    parting them in two: any two rows differ in 2^(n-2) of 2^(n-1) - 1 places,
    which corrects one wrong bit of 7 for four classes, 3 of 15 for five. More
    classes get rows of a Hadamard matrix, which differ in half of its places.
    """
    if n < 2:
        return np.ones((n, 0), int)
    if n <= 7:
        return np.array([[1 if i == 0 or not column >> (i - 1) & 1 else -1 for column in range(1, 1 << (n - 1))] for i in range(n)])
    size = 1 << n.bit_length()
    rows = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(size)] for i in range(1, n + 1)])
    return _distinct(rows[:, rows.max(axis=0) != rows.min(axis=0)])


def _distinct(code: np.ndarray) -> np.ndarray:
    """Columns without those that part the classes as an earlier one does."""
    _, first = np.unique(code * code[0], axis=1, return_index=True)
    return code[:, np.sort(first)]


class LanguageCode:
    """Binary n-gram classifiers, one per place of the code, and the decoder."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.code = codewords(len(names))
        chance = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        weights = []
        for bit in self.code.T:
            weights.append(np.log(chance[bit > 0].mean(axis=0)) - np.log(chance[bit < 0].mean(axis=0)))
        self.weights = np.array(weights, np.float32).T.copy() if weights else np.zeros((BUCKETS, 0), np.float32)
        # A place weighs as much as it tells apart the two languages it separates worst.
        sure = (self.code * (chance @ self.weights)).min(axis=0) if len(weights) else np.zeros(0)
        self.trust = np.maximum(sure, 1e-6) / max(sure.max(initial=0), 1e-6)

    def decide(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether a second language is about as near."""
        if not self.names or not has_letter(text):
            return UNDETERMINED, 0.0, False
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        total, n = np.zeros(self.weights.shape[1]), 0
        for part in ngram_buckets(text):
            total += self.weights[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        margins = total / n * min(n, 64)
        loss = (np.logaddexp(0, -self.code * margins) * self.trust).sum(axis=1)
        fit = np.exp(loss.min() - loss)
        fit /= fit.sum()
        best, second = np.argsort(-fit, kind="stable")[:2]
        return self.names[best], float(fit[best]), bool(fit[second] > 0.25)


def ngram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, bucket, n`` over all documents whose language is known.

    Each task counts its own documents; the counts, one row per language and
    bucket, are summed after the shuffle.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                mine = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in ngram_buckets(text.as_py() or b""):
                    mine += np.bincount(part, minlength=BUCKETS)
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(mine[at])], ["lang", "bucket", "n"])

    return in_arrow(known, scan, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageCode:
    """A model from the n-gram counts of all given documents.

    The driver gets at most ``BUCKETS`` numbers per language.
    """
    table = ngram_counts(docs, text_col, lang_col).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS))
    rows = [place[x] for x in table.column("lang").to_pylist()]
    np.add.at(counts, (rows, table.column("bucket").to_numpy()), table.column("n").to_numpy())
    return LanguageCode(names, counts)


def identify(docs: DataFrame, model: LanguageCode, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` and ``ambiguous``.

    Texts that are null or have no letter are ``und`` with score 0. Whole
    texts are read. Input columns of the added names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    plain = with_columns(docs, [], drop=["lang_pred", "score", "ambiguous"])
    carried = [f for f in plain.schema if f.name != text_col]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [known.value.decide(x.as_py() or b"") for x in batch.column(text_col).cast(pa.binary())]
            columns = [pa.array([s[i] for s in said], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carried], *columns], [f.name for f in [*carried, *added]])

    return in_arrow(plain, scan, T.StructType([*carried, *added]))
