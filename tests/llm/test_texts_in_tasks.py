"""Suffix dedup, token files, SimHash groups and decontamination against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from debtscope.llm import rans, suffix_dedup
from debtscope.llm.components import components
from debtscope.llm.decontamination import decontaminate, find_leaks
from debtscope.llm.queries import tokenizer_config
from debtscope.llm.simhash import drop_near_copies, fingerprint, links, near_copies
from debtscope.llm.suffix_dedup import drop_repeats, window_anchors
from debtscope.llm.suffix_sort import repeated_starts, suffix_order
from debtscope.llm.token_files import read_token_files, write_token_files
from debtscope.session import work_path

# --- suffix sorting and dedup ---


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order_and_repeats(seed):
    r, depth = random.Random(seed), 16
    letters = bytes(r.sample(range(256), r.choice([1, 2, 3, 6])))
    texts = [bytes(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(r.randint(1, 6))]
    texts.append(texts[0][3:60] + b"zz" + texts[0])
    whole = b"".join(texts)
    text = np.frombuffer(whole + bytes(depth + 16), np.uint8)
    wanted = np.arange(len(text)) < len(whole)
    order = suffix_order(text, wanted, depth).tolist()
    keys = [text.tobytes()[i : i + depth] for i in order]
    assert sorted(order) == list(range(len(whole))) and keys == sorted(keys)
    count = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - depth + 1) if count[t[i : i + depth]] > 1}
    assert {(int(k), i) for k, a, b in zip(*repeated_starts(texts, depth)) for i in range(a, b + 1)} == want


def test_equal_windows_choose_the_same_anchor():
    r = random.Random(5)
    shared = bytes(r.randrange(97, 101) for _ in range(230))
    texts = [bytes(r.randrange(97, 101) for _ in range(r.randint(0, 300))) + shared + b"a" * r.randint(0, 250) for _ in range(8)]
    sizes = np.array([len(t) for t in texts])
    first, last, place, h = window_anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes), sizes)
    seen, whole = {}, b"".join(texts)
    covered = 0
    for a, b, p, k in zip(first.tolist(), last.tolist(), place.tolist(), h.tolist()):
        for s in range(a, b + 1):
            assert s <= p <= s + 168
            assert seen.setdefault(whole[s : s + 200], (p - s, k)) == (p - s, k)
            covered += 1
    assert covered == sum(max(len(t) - 199, 0) for t in texts)


def cut_repeats(texts, width=200):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def repeat_texts():
    r = random.Random(6)
    line = "".join(r.choice("abcdeé ") for _ in range(260))
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 900, line, line[:199], line + line]
    texts += ["".join(r.choice("abcdeé ") for _ in range(r.randint(0, 400))) + line[r.randint(0, 30) : 260 - r.randint(0, 40)] + str(i) for i in range(60)]
    texts += [texts[20], texts[20], texts[21][50:300], "q" * 70_000]
    return texts


@pytest.mark.parametrize("hot", [4_000, 5])
def test_repeats_against_brute_force(make, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = repeat_texts()
    want = cut_repeats([(t or "").encode() for t in texts])
    got = {r.doc_id: r for r in drop_repeats(make(list(enumerate(texts)))).collect()}
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == w, i


def test_no_bucket_of_distinct_pieces_grows(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    texts = ["".join(r.choice("stuvwxyz") for _ in range(60)) + passage + "".join(r.choice("stuvwxyz") for _ in range(60)) for _ in range(40)]
    largest, sort = [], suffix_dedup._sorted_repeats

    def watched(contexts):
        largest.extend(x["count"] for x in contexts.groupBy("h").count().collect())
        return sort(contexts)

    monkeypatch.setattr(suffix_dedup, "_sorted_repeats", watched)
    got = {x.doc_id: x for x in drop_repeats(make(list(enumerate(texts)))).collect()}
    for i, w in enumerate(cut_repeats([t.encode() for t in texts])):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == w, i
    assert max(largest, default=0) <= 5


def test_repeats_of_equal_rows_and_other_columns(make):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    docs = make([(1, text, 5), (1, text, 5), (None, "short", 6)], "doc_id long, text string, n_bytes int")
    out = drop_repeats(docs)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted((r.n_bytes, r.n_removed) for r in out.collect()) == [(5, 0), (300, 300), (300, 300)]
    assert drop_repeats(make([])).count() == 0


def test_long_texts_come_in_overlapping_pieces(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BUFFER", 1_000)
    r = random.Random(8)
    base = "".join(r.choice("abcd ") for _ in range(5_000))
    texts = [base, base[900:1400] + "|" + base[3000:3300]]
    suffix_pieces = list(suffix_dedup._buffers(iter([t.encode() for t in texts])))
    assert sum(len(s) for *_, s in suffix_pieces) > 4
    runs = [window_anchors(np.frombuffer(d, np.uint8), np.cumsum(s), s) for d, _, _, s in suffix_pieces]
    assert sum(int((b - a + 1).sum()) for a, b, _, _ in runs) == sum(len(t) - 199 for t in texts)


# --- token files ---


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 16_383, 16_384, 16_385, 100_003])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) * rng.integers(1, 3000, n), 2**31 - 1).astype(np.uint32)
    payload = rans.encode(ids)
    assert (rans.decode(payload) == ids).all()
    if n > 40_000:
        assert (rans.decode(payload, 2, 4) == ids[2 * rans.BLOCK : 4 * rans.BLOCK]).all()
        broken = bytearray(payload)
        broken[-9] ^= 1
        with pytest.raises((ValueError, IndexError)):
            rans.decode(bytes(broken))


def test_coder_of_one_symbol_and_uniform_ids():
    for ids in (np.full(50_000, 7, np.uint32), np.arange(300_000, dtype=np.uint32)):
        assert (rans.decode(rans.encode(ids)) == ids).all()
    assert len(rans.encode(np.full(50_000, 7, np.uint32))) < 2_000


ODD = [
    None, "", " ", "\n\n", "Hello, World!", "it's we'll 'S", "É À ñandú straße ẞ İ K ſ", "é ñ̃", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "1234 12.5 x9", "日本語 テスト", "a b c\u0085d\x1ce", "TOINGESER!! a|b %%% ***", "\t tab\rx\x0bv\x0cf", "w" * 3000, "día, " * 4000, "🙂🙂 ok",
]


def test_token_files_against_the_tokenizer(spark, make):
    from tokenizers import Tokenizer

    rows = [*((i * 3 - 6, t) for i, t in enumerate(ODD)), (None, "null id"), (5, "again"), (5, "again")]
    path = work_path(spark, "tokens-test")
    write_token_files(make(rows), path, tokenizer_config(), segment_ids=500)
    whole = Tokenizer.from_str(tokenizer_config())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t in ordered:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, ids, zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = read_token_files(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids, r.ids_crc32) for r in got] == want


def test_a_tokenizer_that_keeps_blanks_gets_whole_texts(spark, make):
    import public_tokenizers
    from tokenizers import Tokenizer

    config = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    path = work_path(spark, "tokens-test")
    write_token_files(make([(1, "Two  words\n here"), (2, None)]), path, config, end_id=50256)
    got = {r.doc_id: r.ids for r in read_token_files(spark, path).collect()}
    assert got == {1: [*Tokenizer.from_str(config).encode("Two  words\n here").ids, 50256], 2: [50256]}


def test_token_files_of_an_empty_table(spark, make):
    path = work_path(spark, "tokens-test")
    write_token_files(make([]), path, tokenizer_config())
    assert read_token_files(spark, path).count() == 0


# --- SimHash ---


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


def test_fingerprints(spark):
    for t in [None, "", "a", "A b", "é É x Y", "a b c", "a b c a b c", "x " * 70_000, "\x0bt\x0c u\tv"]:
        assert fingerprint((t or "").encode()) & (2**64 - 1) == brute_print(t)
        assert fingerprint((t or "").encode(), 5) & (2**64 - 1) == brute_print(t, 5)
    row = spark.sql("select xxhash64('a b c') h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_find_every_near_pair(spark, bits):
    r = random.Random(bits)
    base = [0, 2**64 - 1, *(r.getrandbits(64) for _ in range(25))]
    prints = {x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for x in base for _ in range(12)} | set(base)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {frozenset((p.a, p.b)) for p in links(df, bits).collect()}
    assert got == {frozenset((signed(x), signed(y))) for x in prints for y in prints if x < y and (x ^ y).bit_count() <= bits}


def test_links_broadcast_no_copies_of_fingerprints(spark):
    met = links(spark.range(200).select(F.xxhash64("id").alias("fp")))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    top = {x: x for p in pairs for x in p}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    loose = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in top if x not in loose}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_choice(make):
    r = random.Random(10)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(400)) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 2 else base[i % 12] + " z") for i in range(60)] + [(90, None), (91, ""), (92, " \n"), (None, base[0]), (5, base[5])]
    docs = make([(*x, "s") for x in rows], "doc_id long, text string, fingerprint string")
    prints = [brute_print(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    least = {i: min(d for d in groups[root(i)] if d is not None) for i in range(len(rows))}
    got = Counter((g.doc_id, g.fingerprint & (2**64 - 1), g.component_id) for g in near_copies(docs).collect())
    assert got == Counter((d, prints[i], least[i]) for i, (d, _) in enumerate(rows))
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(k.doc_id for k in kept.collect()) == sorted(set(least.values()))
    assert near_copies(make([])).count() == 0 and drop_near_copies(make([])).count() == 0


# --- decontamination ---

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


@pytest.mark.parametrize("set_windows", [500_000, 15])
def test_leaks_against_brute_force(spark, make, set_windows):
    r = random.Random(11)
    vocabulary = ["Alpha", "beta,", "gamma-delta", "é", "ÉT", "42", "x_y", "z"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 4, 9, 10, 11, 30, 30])] + [(10, "one two three"), (11, None), (None, "null item here")]
    benchmark = spark.createDataFrame([(i, t) for i, t in items if i != 1], "item_id long, text string")
    rows = [(0, None), (1, ""), (2, "one TWO three"), (3, "one two"), (4, "NULL item, here!" * 3), (5, "q " * 30_000)]
    for i in range(6, 60):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            body[r.randint(0, len(body)) :] = [r.choice(items)[1] or "", *body[:9]]
        rows.append((i, " ".join(body)))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i != 1 and w:
            k = min(10, len(w))
            for a in range(len(w) - k + 1):
                windows[tuple(w[a : a + k])].add("" if i is None else str(i))
    got = {g.doc_id: g for g in find_leaks(make(rows), benchmark, set_windows=set_windows).collect()}
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if found := windows.get(tuple(w[a : a + k])):
                    names |= found
                    hit.update(range(a, a + k))
        g = got[i]
        assert (g.n_words, g.n_hit, g["items"], g.contaminated) == (len(w), len(hit), sorted(names), bool(hit)), i


def test_documents_or_spans_are_removed(spark, make):
    benchmark = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today")], "item_id long, text string")
    rows = [(1, "So: The quick, brown fox jumps over the lazy dog TODAY! End.", "a"), (2, "clean é text", "b"), (None, None, "c")]
    docs = make(rows, "doc_id long, text string, items string")
    dropped = decontaminate(docs, benchmark)
    assert dropped.columns == docs.columns and {r.doc_id for r in dropped.collect()} == {2, None}
    cut = {r.doc_id: tuple(r) for r in decontaminate(docs, benchmark, "spans").collect()}
    assert cut == {1: (1, "So: ! End.", "a"), 2: rows[1], None: rows[2]}
    assert find_leaks(make([]), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in find_leaks(docs, none).collect())


