"""Importance resampling, conversation repair and merge-type encoding against plain computations and the library."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from brindle.llm import dialogues, pieces, resample

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Resampling


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in plain_features(x)[1]), Counter(bucket(f) for x in target for f in plain_features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for d, x in docs:
        w, f = plain_features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def some_docs(n=120):
    rng = random.Random(3)
    vocab = ["The", "été", "ÉTÉ", "naïve", "x9", "foo", "Bar", "baz", "日本", "qux", "q-r", "a_b", "\x00z", "\U0001f600"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((0, 5, 19, 20, 40, 300))))) for i in range(n)]
    docs += [docs[5], docs[5], (None, docs[7][1]), (None, docs[7][1]), (n, None), (n + 1, ""), (n + 2, "..,, !"), (n + 3, "word " * 60_000), (n + 4, "x" * 300_000)]
    return docs, ["foo bar baz", "The été x9 x9", None, ""]


def test_resampling_equals_the_plain_draw(spark):
    docs, target = some_docs()
    # Columns of other kinds under the names that the operator uses inside.
    df = spark.createDataFrame([(d, x, 1, "b", 2.0) for d, x in docs], "doc_id long, text string, row int, bucket string, score double").repartition(5)
    of = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    out = resample.resample(df, of)
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == plain_resample(docs, target)
    drawn = sorted(r[4] for r in got if r[4])
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 10


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    few = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert resample.resample(none, few).collect() == []
    got = {r.doc_id: r for r in resample.resample(few, none, percent=100).collect()}
    assert got[1].rank == 1 and got[1].n_features == 59 and got[2].rank is None and got[2].weight == 0


def test_ranks_of_equal_rows_are_spread_and_whole(spark):
    same = spark.range(3000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("a b " * 15).alias("text"))
    out = resample.resample(same, same, percent=50)
    assert sorted(r.rank for r in out.where("rank is not null").collect()) == list(range(1, 1501))


# Conversations


def brute(signature, most_inserts=3):
    """Every string of edits, by trying all of them."""
    best = (10**9, "")

    def go(i, roles, audit, cost, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(signature) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        if inserts < most_inserts:
            for r in "ua":
                go(i, roles + r, audit + "I", cost + 5, inserts + 1)
        if i == len(signature):
            return
        c = signature[i]
        go(i + 1, roles, audit + "D", cost + 2, inserts)
        if c not in "_=":
            extra = 5 if c.isupper() else 0
            go(i + 1, roles + c.lower(), audit + "K", cost + extra, inserts)
            for r in "ua":
                go(i + 1, roles + r, audit + "R", cost + 1 + extra, inserts)

    go(0, "", "", 0, 0)
    return best


def test_audits_are_the_cheapest_and_least():
    for n in range(4):
        for s in itertools.product("suaxSUA_=", repeat=n):
            assert dialogues.solve("".join(s)) == brute("".join(s)), s
    rng = random.Random(1)
    for _ in range(150):
        s = "".join(rng.choice("suaxSUAX_=") for _ in range(rng.randint(4, 6)))
        assert dialogues.solve(s) == brute(s), s


def test_a_very_long_conversation_is_solved():
    cost, audit = dialogues.solve("s" + "ua" * 200_000 + "u")
    assert cost == 2 and audit == "K" * 400_001 + "D"


def plain_repair(rows):
    """One conversation at a time, by lists; audits from ``solve``."""
    space = lambda x: " " if x is None else x
    out, by = {}, {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        k = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        r, x = ("user" if k == 4 else space(r)), space(x)
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        by[c] += [(t, r, x)] * {0: 0, 3: 2}.get(k, 1)
    for c, own in by.items():
        own.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))
        seen, marks = set(), ""
        for t, r, x in own:
            said = re.sub(r"[\x20\x09-\x0D]+$", "", x)
            initial = r[:1] if r[:1] in ("s", "u", "a") else "x"
            marks += "_" if not said else "=" if (r, x) in seen else initial.upper() if said[-1] not in ".!?" else initial
            seen.add((r, x))
        cost, audit = dialogues.solve(marks)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        made, left, asked = [], iter(own), False
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            role, text = (row[1], row[2]) if e == "K" else ("assistant" if asked else "user", "" if e == "I" else row[2])
            asked = role[:1] == "u"
            made.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[c] = (gaps, marks.count("_"), marks.count("="), sum(m in "SUAX" for m in marks), illegal, cost, audit, sha)
    return out


def some_conversations():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "utility"], ["Hi.", "Yes!", "no", " \t", "", None, "ok?\n", "été.", "A. b", " "]
    rows = [(c, rng.choice((None, t, t, t, t + 3)), rng.choice(roles[:3] * 3 + roles), rng.choice(texts)) for c in range(80) for t in range(rng.randint(1, 9))]
    rows += [(None, t, r, x) for t, r, x in ((0, "user", "a."), (1, "assistant", "b."), (None, None, None), (5, "user", "c"))]
    rows += [(900, 1, "user", "Same."), (900, 1, "assistant", "Same."), (900, 1, "user", "Same."), (901, None, "user", "x."), (902, 0, "user", "long " * 200_000 + ".")]
    rows += [(c, 0, "user", "Gone.") for c in range(2000, 2100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]  # nothing of these is left
    rows += [(1000 + i, t, ("user", "assistant")[t % 2], "Common.") for i in range(400) for t in range(4)]
    return rows


def test_repair_equals_the_plain_one(spark):
    rows = some_conversations()
    df = spark.createDataFrame([(*r, "x", 1, "m") for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int, mark string").repartition(6)
    out = dialogues.repair(df)
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    want = plain_repair(rows)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert set(got) == set(want) and {c for c in got if got[c] != want[c]} == set()
    assert sum(v[6] == "" for v in got.values()) > 1 and any("R" in v[6] and "D" in v[6] for v in got.values())


def test_repair_of_an_empty_table_and_blocks_of_marks(spark, monkeypatch):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogues.repair(none).collect() == []
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(dialogues, "BLOCK", 7)
    monkeypatch.setattr(dialogues, "OUT_ROWS", 3)
    assert {r.conv_id: tuple(r)[1:] for r in dialogues.repair(df).collect()} == plain_repair(rows)


# Pieces


def odd_texts():
    rng = random.Random(2)
    signs = list(" ▁\n\t\x00abcThe é日́\U0001f600﻿　<0x41></s>.,")
    return ["", " ", "▁", "▁x", "  a  b ", "<s>hi</s><unk>", "x" * 5000, " " * 3000 + "a", "\n" * 500] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_pieces_equal_the_library(spark):
    texts = [None, *odd_texts(), "word é " * 150_000, odd_texts()[12], odd_texts()[12]]
    df = spark.createDataFrame([(i, x, b"z", 1) for i, x in enumerate(texts)] + [(None, "no id", b"", 2), (3, "twice", b"", 3)], "doc_id long, text string, ids binary, key int").repartition(3)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encoded(df, MODEL).collect()), key=str)
    want = sorted(((i, tuple(lib.encode(x or "")), lib.decode(lib.encode(x or ""))) for i, x in [*enumerate(texts), (None, "no id"), (3, "twice")]), key=str)
    assert got == want
    assert pieces.encoded(df.limit(0), MODEL).collect() == []


def test_forgetting_stretches_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "LONGEST", 4)
    vocab = pieces.Vocabulary(MODEL)
    for x in odd_texts():
        ids = list(memoryview(vocab.encode([x])[0]).cast("i"))
        assert ids == vocab.library.encode(x) and vocab.decode(np.array(ids, np.int32))[0][1:].decode() == vocab.library.decode(ids)


def test_a_difference_to_the_library_ends_the_job():
    vocab = pieces.Vocabulary(MODEL)
    vocab.cost = {k: -v for k, v in vocab.cost.items()}  # the wrong order of merges
    with pytest.raises(ValueError, match="library"):
        vocab.encode(["the quick brown fox jumps over"])
