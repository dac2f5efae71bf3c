"""Phrase collocations, counted by dynamic itemset counting over cyclic scans of shards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.llm.shared import in_arrow, stored, text_of
from debtscope.session import work_path

UNKNOWN = "und"
#: A-Z become a-z, blanks stay, tabs become blanks, and everything that ends a piece becomes a full stop.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_BREAK = b"."
#: Text bytes split together and words counted together in a task.
_TEXT, _WORDS = 4 << 20, 4_000_000
#: Words whose hashes are kept in one row of a shard.
_SEGMENT = 1 << 18
#: Slots whose counts travel together.
_SLOTS = 1 << 16


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, with a full stop between pieces, a part of the text at a time."""
    at = 0
    while at < len(text):
        end = at + _TEXT
        while end < len(text) and text[end] not in b" .":
            end += 1
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def _mixed(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + more) * np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers of words from 1 on; a break is 0."""

    def __init__(self, seed: int):
        super().__init__({_BREAK: 0})
        self.words, self.hashes, self.seed = [_BREAK], [0], seed

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return self[word]


class Scanner:
    """Reads texts of one language and looks at all their phrases, some million words at a time."""

    def __init__(self, lang: str, max_words: int, most: int):
        self.lang, self.max_words, self.most = lang, max_words, most
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self._start([])

    def _start(self, tail: list[bytes]) -> None:
        """Begin anew behind ``tail``, whose words are context and have been looked at."""
        self.ids = _Ids(self.seed)
        self.parts = [np.fromiter(map(self.ids.__getitem__, tail), np.int64, len(tail))]
        self.tail, self.known, self.held = tail, len(tail), 0

    def add(self, text: bytes) -> Iterator[Words]:
        """Read a text; yields words whenever enough are held."""
        for tokens in _tokens(text.translate(_PLAIN)):
            self._read(tokens)
            if self.held >= self.most:
                yield self.flush()
        self._read([_BREAK])

    def _read(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens)))
        self.held += len(tokens)
        back = self.max_words - 1
        self.tail = [*self.tail, *tokens][-back:] if len(tokens) < back else tokens[-back:]

    def flush(self) -> Words:
        """What was read since the last flush, behind the words before it that may start its phrases."""
        at = np.concatenate(self.parts)
        hashes = (np.array(self.ids.hashes, np.uint64) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        hashes[0] = 0
        out = Words(self.lang, self.known, hashes[at], at, self.ids.words)
        self._start(self.tail)
        return out


@dataclass
class Words:
    """Words of a language in order, as 32-bit hashes with 0 between pieces; the first ``known`` have been looked at.

    Where the words themselves are at hand, ``at`` numbers them in ``words``.
    """

    lang: str
    known: int
    hashes: np.ndarray
    at: np.ndarray | None = None
    words: list[bytes] | None = None

    def phrases(self, max_words: int, slots: int) -> Iterator[Phrases]:
        """All phrases that end in new words, by length, shortest first."""
        shift, each = np.uint64(64 - (slots.bit_length() - 1)), self.hashes.astype(np.uint64)
        hashes, whole = _mixed(each, np.uint64(0)), each > 0
        for size in range(1, max_words + 1):
            if size > 1:
                hashes, whole = _mixed(hashes[:-1], each[size - 1 :]), whole[:-1] & (each[size - 1 :] > 0)
            if not len(hashes):
                break
            fresh = whole.copy()
            fresh[: max(self.known - size + 1, 0)] = False
            yield Phrases(self, size, (hashes >> shift).astype(np.int64), whole, fresh)


@dataclass
class Phrases:
    """Phrases of one length by the place they start at: their slots, whether no piece ends inside, and whether they are new."""

    of: Words
    size: int
    slots: np.ndarray
    whole: np.ndarray
    fresh: np.ndarray

    def rows(self, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of the distinct phrases among the wanted places."""
        begins = np.flatnonzero(wanted)
        if not len(begins):
            return
        at, words = self.of.at, self.of.words
        name, first, counts = at[begins], None, None
        for k in range(min(1, self.size - 1), self.size):
            key = name << 32 | at[begins + k] if self.size > 1 else name
            _, first, name, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        texts = [b" ".join([words[j] for j in at[i : i + self.size]]) for i in begins[first].tolist()]
        for a in range(0, len(texts), 1 << 18):
            part = texts[a : a + (1 << 18)]
            columns = [
                pa.array(np.full(len(part), self.size, np.int32)),
                pa.array([self.of.lang] * len(part), pa.string()),
                pa.array(part, pa.binary()).cast(pa.string()),
                pa.array(counts[a : a + (1 << 18)].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["size", "lang", "phrase", "n"])


class StepCount:
    """Counts, up to the threshold, of the slots of the phrases that are active in one step.

    ``reached`` has for each length a table of slots: the step at whose end the
    phrases that hash there had reached the threshold, or 0. Words start before
    the first step, a longer phrase after the later step of its two
    subphrases; each is counted for one cycle of ``shards`` steps. Slots are
    shared, so a phrase may start early, and a slot may reach the threshold for
    phrases that do not; when a phrase is counted is the same in every task.
    """

    def __init__(self, reached: list[np.ndarray], step: int, shards: int, least: int):
        self.reached, self.step, self.shards, self.least = reached, step, shards, least
        kind = np.uint8 if least <= 255 else np.uint32
        self.tables = [np.zeros(len(x), kind) for x in reached]
        self.since: np.ndarray | None = None

    def add(self, phrases: Phrases) -> None:
        mine = self.reached[phrases.size - 1][phrases.slots]
        if phrases.size == 1:
            active = phrases.fresh if self.step <= self.shards else np.zeros(len(mine), bool)
        else:
            start = np.maximum(self.since[:-1], self.since[1:]).astype(np.int64)
            both = (self.since[:-1] > 0) & (self.since[1:] > 0)
            active = phrases.fresh & both & (start < self.step) & (self.step <= start + self.shards)
        slots, counts = np.unique(phrases.slots[active & (mine == 0)], return_counts=True)
        table = self.tables[phrases.size - 1]
        table[slots] = np.minimum(table[slots].astype(np.int64) + counts, self.least)
        self.since = np.where(phrases.whole, mine, 0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for size, table in enumerate(self.tables, 1):
            yield _chunk_rows(size, {c: part for c, part in enumerate(_cut(table)) if part.any()})


def _cut(table: np.ndarray) -> list[np.ndarray]:
    return [table[a : a + _SLOTS] for a in range(0, len(table), _SLOTS)]


def _chunk_rows(size: int, parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    packed = pa.array([_pack(x) for x in parts.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([size] * len(parts), pa.int32()), pa.array(list(parts), pa.int32()), packed], ["size", "chunk", "counts"])


def _pack(counts: np.ndarray) -> bytes:
    """Few counts as their places and values, many as a compressed table."""
    places = np.flatnonzero(counts)
    if len(places) * 8 < len(counts):
        return b"few" + places.astype("<u2").tobytes() + counts[places].astype("<u4").tobytes()
    return b"all" + zlib.compress(counts.astype("<u4"), 1)


def _unpack(packed: bytes, total: np.ndarray) -> np.ndarray:
    """``total`` with the packed counts added."""
    if packed[:3] == b"all":
        return total + np.frombuffer(zlib.decompress(packed[3:]), "<u4")
    n = (len(packed) - 3) // 6
    total = total.copy()
    total[np.frombuffer(packed, "<u2", n, 3)] += np.frombuffer(packed, "<u4", n, 3 + 2 * n)
    return total


class Slots:
    """Tables of slots that travel compressed and are unpacked once in a worker."""

    def __init__(self, tables: list[np.ndarray]):
        self.packed, self.tables = [zlib.compress(x, 1) for x in tables], None

    def all(self) -> list[np.ndarray]:
        if self.tables is None:
            self.tables = [np.frombuffer(zlib.decompress(x), np.uint8) for x in self.packed]
        return self.tables


def _read(batches: Iterator[pa.RecordBatch], max_words: int, most: int) -> Iterator[Words]:
    """The words of all texts of a task, about ``most`` at a time."""
    scanners: dict[str, Scanner] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            if lang not in scanners:
                scanners[lang] = Scanner(lang, max_words, most)
            yield from scanners[lang].add(text.as_py())
            if sum(s.held for s in scanners.values()) >= most:
                yield from (s.flush() for s in scanners.values() if s.held)
    yield from (s.flush() for s in scanners.values() if s.held)


def _hashed(texts: DataFrame, max_words: int) -> DataFrame:
    """Texts as hashes of words, some hundred thousand in a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _read(batches, max_words, _SEGMENT):
            yield pa.RecordBatch.from_arrays([pa.array([words.known], pa.int32()), pa.array([words.hashes.tobytes()], pa.binary())], ["known", "hashes"])

    return in_arrow(texts, scan, "known int, hashes binary")


_CHUNKS = "size int, chunk int, counts binary"


def _step(shard: DataFrame, known, step: int, shards: int, least: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = StepCount(known.value.all(), step, shards, least)
        for batch in batches:
            for skip, hashes in zip(batch.column("known").to_pylist(), batch.column("hashes")):
                words = Words("", skip, np.frombuffer(hashes.as_buffer(), np.uint32))
                for phrases in words.phrases(len(count.tables), len(count.tables[0])):
                    count.add(phrases)
        yield from count.rows()

    return in_arrow(shard, scan, _CHUNKS)


def _summed(chunks: DataFrame, least: int, slots: int) -> DataFrame:
    """Sums of the counts of each chunk of slots, up to the threshold, and the slots that are there now."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def row() -> pa.RecordBatch:
            there = total >= least
            rest = _chunk_rows(key[0], {key[1]: np.where(there, 0, total)})
            return pa.RecordBatch.from_arrays([*rest.columns, pa.array([np.packbits(there).tobytes() if there.any() else None], pa.binary())], ["size", "chunk", "counts", "bits"])

        for batch in batches:
            for size, chunk, counts in zip(batch.column("size").to_pylist(), batch.column("chunk").to_pylist(), batch.column("counts")):
                if key != (size, chunk):
                    if key:
                        yield row()
                    key, total = (size, chunk), np.zeros(min(slots, _SLOTS), np.int64)
                total = np.minimum(_unpack(counts.as_py(), total), least)
        if key:
            yield row()

    return in_arrow(chunks.repartition("size", "chunk").sortWithinPartitions("size", "chunk"), scan, _CHUNKS + ", bits binary")


def count_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, shards: int = 4, slots: int = 1 << 24
) -> DataFrame:
    """``size, lang, phrase, n`` parts whose sums by phrase are whole counts.

    All words are counted, and all phrases up to ``max_words`` words that occur
    ``min_count`` times or more; others may be. Words become 32-bit hashes of
    word and language, dealt to ``shards`` shards in rows of some hundred
    thousand. Each step scans one shard for all lengths at once. Words are active
    from the first step; a longer phrase becomes active as soon as both its
    subphrases have reached the threshold, wherever the cycle stands, and is
    counted until each shard was read once since. It ends when no phrase is
    active, after at most ``max_words`` cycles.

    These counts are kept by hash slot and stop at the threshold: a byte for
    each of ``slots`` slots and length goes to all tasks, compressed, and bits
    of slots come back, whatever the corpus holds. A last scan of the texts
    counts the phrases themselves whose slot has reached the threshold. Phrases that share
    a slot may be counted without need, and more of them are the more phrases
    there are; counts are whole and exact all the same.
    """
    if slots & (slots - 1) or not 1 <= shards <= 255 // max_words:
        raise ValueError("slots must be a power of two, and steps must fit a byte")
    spark, path = docs.sparkSession, work_path(docs.sparkSession, "phrase-shards")
    given = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text_col).alias("text"))
    texts = given.where("text != ''")
    dealt = _hashed(texts, max_words).withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))
    dealt.write.partitionBy("shard").parquet(path, compression="zstd")
    held = spark.read.schema(dealt.schema).parquet(path)

    reached = [np.zeros(slots, np.uint8) for _ in range(max_words)]
    sums, step, last = None, 0, shards
    while step < last:
        step += 1
        known = spark.sparkContext.broadcast(Slots(reached))
        rows = _step(held.where(F.col("shard") == (step - 1) % shards).select("known", "hashes"), known, step, shards, min_count)
        sums = stored(_summed(rows if sums is None else rows.unionByName(sums.select("size", "chunk", "counts")), min_count, slots), "phrase-slots")
        # One job; as many bits at most as there are slots.
        for size, chunk, bits in sums.where("bits is not null").select("size", "chunk", "bits").collect():
            part = _cut(reached[size - 1])[chunk]
            part[np.unpackbits(np.frombuffer(bits, np.uint8))[: len(part)] > 0] = step
            if size < max_words:
                last = max(last, step + shards)
        known.destroy()

    found = spark.sparkContext.broadcast(Slots([x > 0 for x in reached]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = found.value.all()
        for words in _read(batches, max_words, _WORDS):
            for p in words.phrases(max_words, slots):
                yield from p.rows(p.fresh & (there[p.size - 1][p.slots] > 0) if p.size > 1 else p.fresh)

    return in_arrow(texts, scan, "size int, lang string, phrase string, n long")


def _part(words: Column, begin: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = 3,
    min_count: int = 10,
    absorb_percent: int = 50,
    most: int = 2000,
    **options: int,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` collocations of each language.

    A phrase of 2 to ``max_words`` words that occurs ``min_count`` times or more
    inside pieces of text is a candidate. Its score is floor(1000000 a a / (l r))
    at its weakest cut, with a, l and r the occurrences of the phrase, of the
    words before and of those after the cut. Candidates that lie in a longer
    one with ``absorb_percent`` of their occurrences or more are left out.

    Case of A-Z plays no part; null languages are ``und``. Null and empty texts
    have no words, an empty table gives no rows, every row counts with its
    repeats, and other columns are not read. Products are exact up to counts of
    10^15. Ties go by a, then by the bytes of the phrase.
    """
    parts = stored(count_phrases(docs, text_col, lang_col, max_words, min_count, **options).groupBy("size", "lang", "phrase").agg(F.sum("n").alias("a")), "phrase-counts")
    total = parts.where("size = 1").groupBy(F.col("lang").alias("_lang")).agg(F.sum("a").alias("n"))
    frequent = stored(parts.where(F.col("a") >= min_count), "phrases")
    words = F.split("phrase", " ")

    cut = (
        frequent.where("size > 1")
        .select("lang", "phrase", "a", "size", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    )
    heads = frequent.select(F.col("lang").alias("_hl"), F.col("phrase").alias("_h"), F.col("a").alias("l"))
    rests = frequent.select(F.col("lang").alias("_rl"), F.col("phrase").alias("_r"), F.col("a").alias("r"))
    scored = (
        cut.join(heads, (F.col("lang") == F.col("_hl")) & (F.col("head") == F.col("_h")))
        .join(rests, (F.col("lang") == F.col("_rl")) & (F.col("rest") == F.col("_r")))
        .withColumn("score", F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("weakest"))
    )

    places = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda b: _part(words, b, s)),
        )
    )
    longer = (
        frequent.where("size > 2")
        .select("lang", "a", F.explode(F.array_distinct(places)).alias("_in"))
        .groupBy(F.col("lang").alias("_al"), "_in")
        .agg(F.max("a").alias("_more"))
    )
    own = scored.join(longer, (F.col("lang") == F.col("_al")) & (F.col("phrase") == F.col("_in")), "left").where(
        F.coalesce(F.col("_more") * 100, F.lit(0)) < F.col("a") * absorb_percent
    )
    along = W.partitionBy("lang").orderBy(F.col("weakest.score").desc(), F.col("a").desc(), F.col("phrase"))
    first = own.withColumn("rank", F.row_number().over(along).cast("long")).where(F.col("rank") <= most)
    return first.join(total, F.col("lang") == F.col("_lang")).select(
        "lang", "rank", "phrase", "a", "weakest.l", "weakest.r", "n", "weakest.score"
    )
