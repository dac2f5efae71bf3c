"""Conversation windows and source mixing."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from debtscope.llm.chat import chat_digest, chat_windows, escape, read_windows, unescape
from debtscope.llm.mixing import apportion, mix_documents, plan_mix, source_targets

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_turns(n=12, seed=4):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be brief <|im_end|>"))
        for t in range(1, r.randint(2, 40)):
            text = " ".join(r.choice(["word", "&amp;", "<|", "<|im_start|>user\n", "é", "&lt;|", "\n"]) for _ in range(r.randint(0, 60)))
            rows.append((c, t, r.choice(["user", "assistant", "tool\nx", None]), text if r.random() > 0.1 else None))
    return rows


def test_escape_is_reversible(spark):
    texts = ["", "<|", "&", "&lt;|", "&amp;lt;|", "<<||>>", "a<|im_end|>\n", "&amp;&lt;"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", escape(F.col("x")).alias("e"))
    for r in df.select("x", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.x and "<|" not in r.e


def test_windows_hold_every_turn_once_within_the_budget(make):
    rows = some_turns()
    windows = chat_windows(make(rows, TURNS), budget=120, history=40)
    said = defaultdict(list)
    for w in windows.join(read_windows(windows).withColumnsRenamed({"turns": "read", "conv_id": "c", "window": "w"}), (F.col("c") == F.col("conv_id")) & (F.col("w") == F.col("window"))).collect():
        assert w.n_tokens <= 120 or sum(t.new for t in w.turns) <= 2
        assert len(w.read) == sum(t.new for t in w.turns)
        assert [t.nth for t in w.turns] == sorted(t.nth for t in w.turns)
        said[w.conv_id].append((w.window, w.read, w.loss))
        if w.conv_id % 3 == 0:
            assert w.formatted.startswith("<|im_start|>system\n")
    for c, parts in said.items():
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        parts.sort(key=lambda p: p[0])
        assert [(t.role, t.text) for _, read, _ in parts for t in read] == own
        assert [x for _, _, loss in parts for x in loss] == [t for r, t in own if r == "assistant"]


def test_digest_against_brute_force(make):
    rows = [*some_turns(), (None, None, "user", "x"), (50, 0, "system", "only"), (51, 3, "assistant", None), (51, 3, "assistant", None), (52, 1, "user", "w " * 5000)]
    got = {r.conv_id: r for r in chat_digest(chat_windows(make(rows, TURNS))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_history_is_repeated_without_loss(make):
    rows = [(1, t, "assistant" if t % 2 else "user", "w " * 20) for t in range(40)]
    windows = chat_windows(make(rows, TURNS), budget=120, history=50).collect()
    assert len(windows) > 3 and any(not t.new for w in windows for t in w.turns)
    assert sum(len(w.mask) for w in windows) == 20


def test_empty_conversations(make):
    assert chat_digest(chat_windows(make([], TURNS))).count() == 0


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_apportion_takes_the_highest_quotients(spark, seats):
    r = random.Random(seats)
    parts = [(g, p, r.choice([0, 1, 5, 5, 40, 333]), seats) for g in "ab" for p in range(r.randint(1, 9))]
    df = spark.createDataFrame(parts, "g string, p int, v long, s long")
    got = {(x.g, x.p): x.won for x in apportion(df, ["g"], "v", "s", [F.col("p")], "won").collect()}
    for g in "ab":
        mine = [(v, p) for x, p, v, _ in parts if x == g]
        ranked = sorted(((-v / (2 * k - 1), p) for v, p in mine for k in range(1, seats + 1) if v), key=lambda q: q)[:seats]
        assert {p: got[g, p] for _, p in mine} == {p: sum(q == p for _, q in ranked) for _, p in mine}


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def mixed_rows(seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([1, 5, 40, 900]))), r.choice(["a", "b", "big", "big", "big", "é", None, "tiny"]) if i else "tiny") for i in range(400)]
    return [x for x in rows if x[2] != "tiny" or x[0] < 3] + [(None, None, "void"), (900, "", "void"), (7, "a b c", "a"), (7, "a b c", "a")]


DOCS = "doc_id long, text string, source string"


def test_mix_comes_near_its_targets(make):
    rows = mixed_rows()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, got = brute_targets(sizes), plan_mix(make(rows, DOCS), shard_words=3000).collect()
    assert len(got) == len(rows)
    for s, target in want.items():
        mine = [g for g in got if g.source == s]
        assert all(abs(g.target - target) < 1e-6 and g.source_size == sizes[s] and 0 <= g.taken <= 3 * g.size for g in mine)
        shards = -(-sizes[s] // 3000)
        assert abs(sum(g.taken for g in mine) - target) <= 16 * (shards + 1)


def test_mix_is_the_same_again(make):
    rows = mixed_rows()
    a, b = (sorted(map(tuple, plan_mix(make(rows, DOCS, p)).collect()), key=repr) for p in (1, 7))
    assert a == b


def test_targets_of_empty_and_single_tables(spark, make):
    assert plan_mix(make([], DOCS)).count() == 0
    one = plan_mix(make([(1, "a b c", None)], DOCS)).first()
    assert (one.target, one.size) == (3.0, 3)
    assert source_targets(spark.createDataFrame([("a", 0)], "source string, size long")).first().target == 0.0


def test_documents_are_repeated_as_the_plan_says(make):
    rows = mixed_rows()
    docs = make([(*r, "x") for r in rows], DOCS + ", taken string")
    plan = {(p.doc_id, p.size): p.taken / p.size for p in plan_mix(docs).collect() if p.size and p.doc_id != 7}
    out = mix_documents(docs)
    assert out.columns == docs.columns
    counts = {(c.doc_id, len(c.text.split())): c["count"] for c in out.where("doc_id != 7").groupBy("doc_id", "text").count().collect()}
    assert all(int(share) <= counts.get(key, 0) <= int(share) + 1 for key, share in plan.items())
