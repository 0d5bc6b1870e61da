"""Operators over documents against brute force, and their defined results for odd inputs."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import alike, cotrain, decontam, graph, linear, mixing, secrets, simhash, substring, toxicity, words
from brindle.llm.shared import Stash, join_small

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=1, n=60, longest=150):
    """Texts with exact copies, near copies, shared passages, nulls, empties, ties and repeated rows."""
    rng = random.Random(seed)
    v = vocabulary(seed)
    passage = " ".join(rng.choice(v) for _ in range(70))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(v) for _ in range(rng.randint(1, longest)))
        if i % 5 == 1:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 5 == 2 and rows[-1][1]:
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif i % 5 == 3:
            text = f"{text}\n{passage}\t{text}"
        rows.append((i * 3 + 7, text, "en", f"s{i % 3}", len(text)))
    odd = [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \t\n", "en", "s0", 3), (None, rows[3][1], "en", "s1", 5), rows[4], rows[4], (1003, "one", "en", "s1", 3), (1004, "ONE", "en", "s1", 3), (1005, "é" * 3000, "fr", "s2", 3000)]
    return rows + odd


def clashing(df):
    """Extra columns named like those that operators use inside."""
    for c in ("row", "k1", "fp", "_id", "_key", "copy", "n", "hits", "spans", "_spans", "score", "text_key"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def linked(fps):
    """Smallest index reachable over links of two bits or fewer."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    rows = corpus()
    got = simhash.classes(clashing(spark.createDataFrame(rows, DOCS))).select("doc_id", "fp", "component_id").collect()
    fps = [fingerprint(r[1]) for r in rows]
    roots = linked(fps)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        want.append((r[0], fps[i] - (1 << 64) if fps[i] >> 63 else fps[i], min(ids)))
    assert sorted(map(str, ((g.doc_id, g.fp, g.component_id) for g in got))) == sorted(map(str, want))


def test_simhash_links_in_crowded_cells(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(df.withColumn("e", simhash.embed(F.col("fp"))), cell=8)
    near = [(a, b) for a, b in edges.collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in near)
    roots = {x.node: x.root for x in graph.components(edges, Stash(spark, "t")).collect()}
    mine = [roots.get(x[0], x[0]) for x in signed]
    other = linked(fps)
    assert len({*zip(mine, other)}) == len(set(mine)) == len(set(other))


def test_popcount_embedding_is_a_lower_bound(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long")
    far = df.select(F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b")))).alias("x"), "a", "b").collect()
    for r in far:
        manhattan = sum(abs(bin(r.a >> 2 * s & 3).count("1") - bin(r.b >> 2 * s & 3).count("1")) for s in range(32))
        assert r.x == manhattan <= bin(r.a ^ r.b).count("1")


def test_near_duplicates_drop_all_but_one(spark):
    rows = corpus(3)
    df = clashing(spark.createDataFrame(rows, DOCS))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    made = simhash.classes(df, 5, 0.8)
    assert kept.count() == made.select("component_id").distinct().count()
    assert set(r.doc_id for r in kept.collect()) == set(r.component_id for r in made.collect())


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_similar_texts_are_linked_as_brute_force_links_them(spark):
    rng = random.Random(8)
    v = vocabulary(8, 3000)
    rows, base = [], [rng.choice(v) for _ in range(120)]
    for _ in range(90):  # a crowd of near copies, most of them alike
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append(" ".join(w))
    for i in range(120):  # pairs at all similarities and lengths
        w = [rng.choice(v) for _ in range(rng.choice([3, 6, 9, 15, 28, 33, 60, 200, 900]))]
        rows.append(" ".join(w))
        for _ in range(rng.randint(1, 1 + len(w) // 30)):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append(" ".join(w).upper() if i % 9 == 0 else "  ".join(w))
    rows += [None, "", " \t", rows[0], rows[95]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((r or "").encode().lower().split() for r in rows)]
    fps = [simhash.text_fingerprint((r or "").encode(), 5) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 or bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.classes(df, 5, 0.8).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert simhash.drop_near_duplicates(df).count() == len({find(i) for i in range(len(rows))})


def roots_in_one_cell(spark, rows, block):
    """Components of texts (id, text) that all share one cell."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = F.struct(F.lit(36).alias("n"), F.array(F.lit(1).cast("long")).alias("cells")).alias("sketch")
    made = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("doc_id").alias("fp"), sketch)
    edges = alike.links(docs, made, spark.createDataFrame([], "a long, b long"), Stash(spark, "t"), 5, block=block)
    roots = {x.node: x.root for x in graph.components(edges, Stash(spark, "t")).collect()}
    return {i: roots.get(i, i) for i, _ in rows}


@pytest.mark.parametrize("block", [300, 1 << 19])
def test_a_crowded_cell_of_unlike_texts_is_worked_off(spark, block):
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(40)]
        for k in range(3):
            w = list(base)
            w[k] = f"x{g}{k}"
            rows.append((len(rows), " ".join(w)))
    assert roots_in_one_cell(spark, rows, block) == {i: i - i % 3 for i in range(len(rows))}


@pytest.mark.parametrize("block", [900, 1 << 19])
def test_chains_in_a_crowded_cell_hold_together(spark, block):
    rows = []
    for g in range(20):  # neighbours of a chain are similar, others are not
        for k in range(4):
            rows.append((len(rows), " ".join(f"g{g}w{i}" for i in range(5 * k, 5 * k + 54))))
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (r[1].split() for r in rows)]
    assert jaccard(sets[0], sets[1]) >= 0.8 > jaccard(sets[0], sets[2])
    assert roots_in_one_cell(spark, rows, block) == {i: i - i % 4 for i in range(len(rows))}


def test_one_original_with_many_edited_copies_in_a_crowded_cell(spark):
    rng = random.Random(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # two edits of one original, which is not there: most pairs are just below 0.8, those with close edits above
        w = list(base)
        for j in rng.sample(range(len(w)), 2):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (r[1].split() for r in rows)]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    want = {x.node: x.root for x in graph.components(spark.createDataFrame(near, "a long, b long"), Stash(spark, "t")).collect()}
    got = roots_in_one_cell(spark, rows, 2000)
    assert len(near) > 100 and len(set(want.values())) > 3 and got == {i: want.get(i, i) for i, _ in rows}


def test_parity_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(3)
    for n in (20, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 7 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        apart = alike.parity(a) ^ alike.parity(b)
        assert 0 < sum(bin(int(x) & (1 << 64) - 1).count("1") for x in apart) <= len(np.setxor1d(a, b))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges, Stash(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}


def brute_removed(rows, n):
    first = {}
    w = [WORD.findall(r[1] or "") for r in rows]
    for r, own in zip(rows, w):
        for p in range(len(own) - n + 1):
            if r[0] is not None:
                k = tuple(own[p : p + n])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r, own in zip(rows, w):
        gone = [False] * len(own)
        for p in range(len(own) - n + 1):
            if r[0] is not None and first[tuple(own[p : p + n])] < r[0]:
                gone[p : p + n] = [True] * n
        kept = " ".join(x for x, g in zip(own, gone) if not g)
        out.append((r[0], len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("n", [50, 9])
def test_window_removal_against_brute_force(spark, n):
    rows = corpus(4) + [(2000, "x " * 300, "en", "s0", 600), (2001, "x " * 200, "en", "s0", 400)]
    got = substring.deduplicated(clashing(spark.createDataFrame(rows, DOCS)), n)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_removed(rows, n)))


def test_levels_double_until_none_is_left(spark):
    v = vocabulary(8, 3000)
    rows = [(1, " ".join(v[:900])), (2, " ".join(v[900:1000] + v[:450])), (3, " ".join(v[1200:1300])), (4, " ".join(v[1200:1260]))]
    got = {r.doc_id: r.longest for r in substring.levels(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got == {1: 400, 2: 400, 3: 50, 4: 50}


def test_containment_against_brute_force(spark):
    v = vocabulary(9)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([1, 3, 5, 6, 20, 40])))) for i in range(30)] + [(90, None), (91, " "), (92, "")]
    rows = corpus(6)
    for i in range(40):
        own = [rng.choice(v) for _ in range(rng.randint(0, 200))]
        w = (items[i % 30][1] or "").split()
        if len(w) > 12 and i % 3 == 0:
            w[3] = "other"
        rows.append((5000 + i, " ".join(own) + ", " + " ".join(w).upper() + ". " + " ".join(own[:5]), "en", "s0", 1))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.contaminations(clashing(docs), bench).collect() if r.doc_id is not None)
    cut = re.compile(r"[\x20\x09-\x0d!-/:-@\[-`{-~]+")

    def shingles(t, n=None):
        w = [x for x in cut.split((t or "").lower()) if x]
        n = n or min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    want = []
    for d, t, *_ in rows:
        for i, x in items:
            own = shingles(x)
            if own and d is not None:
                c = len(own & shingles(t, len(next(iter(own)))))
                if c >= math.ceil(0.8 * len(own)):
                    want.append((d, i, c, len(own)))
    assert got == sorted(want) and len(want) > 20
    left = decontam.drop_contaminated(clashing(docs), bench)
    assert {r.doc_id for r in left.collect()} - {None} == {r[0] for r in rows} - {d for d, *_ in want} - {None}
    assert left.columns == clashing(docs).columns


def test_containment_in_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(6), DOCS)
    bench = docs.where("doc_id is not null and length(text) > 100").select(F.col("doc_id").alias("item_id"), "text").dropDuplicates(["item_id"])
    one = sorted(map(tuple, decontam.contaminations(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_HASHES", 100)
    assert sorted(map(tuple, decontam.contaminations(docs, bench).collect()), key=str) == one


def test_sketches_choose_few_candidates_and_miss_none():
    rng = random.Random(4)
    v = vocabulary(4, 3000)
    items = [[rng.choice(v) for _ in range(n)] for n in (9, 12, 30, 70, 70, 150, 400) for _ in range(6)]
    texts, held = [], []
    for i, item in enumerate(items):
        for cut in (0.0, 0.15, 0.4, 0.7, 0.9):  # an item without its tail, in the middle of other words
            part = item[: max(5, round(len(item) * (1 - cut)))]
            texts.append(" ".join([rng.choice(v) for _ in range(300)] + part + [rng.choice(v) for _ in range(300)]).encode())
            held.append((i, (len(part) - 4) / (len(item) - 4)))
    rows = [(len(h), n, h[: decontam.sketch_size(len(h))]) for h, n in (decontam.hashes(" ".join(x).encode(), 5) for x in items)]
    got = set(zip(*(x.tolist() for x in decontam.probe(texts, decontam.block(rows)))))
    want = {(d, i) for d, (i, share) in enumerate(held) if share >= 0.8}
    assert want <= got and len(got - want) < len(texts) / 4
    assert all(0 < len(s) <= n and len(s) < n / 2 for n, _, s in rows if n > 100)


def test_long_texts_and_repeated_items(spark):
    item = " ".join(f"i{k}" for k in range(40))
    long = " ".join(f"w{k}" for k in range(250_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, f"{long} {long}"), (1, f"{long} {item} {long}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "only in no text at all here")], "item_id long, text string")
    assert len(long) > words.PIECE
    assert [tuple(r) for r in decontam.contaminations(docs, bench).collect()] == [(1, 7, 36, 36, 1.0)] * 2
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [2]


def secret_texts():
    a, hx = "A" * 20, "0123456789abcdef" * 3
    return [None, "", f"password = '{a}' and PassWord:short token=abc{hx}", f"\x01é𝒳 api_key\": \"{a}=\x02 \x03AKIA{a} {hx} {hx[:31]}", "secret=token: abcdefghij", "token: -----BEGIN RSA PRIVATE KEY----- x", f"AKIA{'Z' * 11} AKIA{'Z' * 12} \nsecret : {hx[:8]}"]


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    s = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(s + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_spans_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(secret_texts())]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_all(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        s = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[2] == k for x in s) for k in ("assign", "access", "hex"))
        assert all(f"{k}:{a}:{b}" in got[i].spans.split(",") for a, _, k, b in s)


def test_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(secret_texts() * 2)], "doc_id long, text string")
    first = secrets.scan(docs.where("doc_id < 3"))
    ledger = spark.createDataFrame(first.collect(), first.schema)
    assert ledger.count() == 2  # null and empty text are one blob
    fresh = secrets.scan(docs, ledger)
    assert fresh.count() == 4 and fresh.join(ledger, "blob").count() == 0
    assert secrets.scan(docs, ledger, version="next").count() == 6
    paths = secrets.findings(docs, ledger.unionByName(fresh))
    assert paths.count() == docs.count() and paths.where("size(spans) > 0").count() == 2 * sum(bool(base_spans(t or "")) or "PRIVATE" in (t or "") for t in secret_texts())


def test_a_ledger_persists_and_grows(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(secret_texts())], "doc_id long, text string")
    ledger = secrets.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.rows().count() == 0
    once = secrets.scan_all(docs, ledger).collect()
    held = ledger.rows().count()
    scanned = []
    real = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda *a: scanned.append(real(*a)) or scanned[-1])
    again = secrets.Ledger(spark, f"{tmp_path}/ledger")  # another run: nothing is unseen
    assert sorted(secrets.scan_all(clashing(docs), again).collect()) == sorted(once) and scanned[-1].count() == 0 and again.rows().count() == held
    more = docs.unionByName(spark.createDataFrame([(99, "token: abcdefghij new")], docs.schema))
    secrets.scan_all(more, again)
    assert again.rows().count() == held + 1
    again.extend(docs, version="next")
    assert again.rows().where("rule_version = 'next'").count() == held


def test_thousands_of_matches_in_one_text(spark):
    text = "é " + " ".join(f"token{'=' if i % 3 else ': '}{'k' * (6 + i % 5)}{i}" for i in range(5000))
    got = secrets.digest(secrets.scan_all(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(text))
    assert got.n_assign > 3000 and got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_redaction_keeps_rows_and_columns(spark):
    df = clashing(spark.createDataFrame([(i, t, "en", "s", -1) for i, t in enumerate(secret_texts())], DOCS))
    out = secrets.redact_documents(df)
    assert out.columns == df.columns and out.count() == df.count()
    for r in out.collect():
        assert r.text is None or not base_spans(r.text)
        assert r.n_chars in (-1, len(r.text or ""))


def test_mixing_reaches_the_weights(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "a" if i % 10 else None, 1) for i in range(4000)] + [(None, "xx", "en", "b", 1)] * 3 + [(9999, None, "en", "c", 0)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    out = mixing.mix(df, {"a": 1.0, "b": 0.0}, total=120_000.0)
    assert [c for c in df.columns if c != "copy"] == out.columns[:-2]
    assert abs(out.agg(F.sum(F.length("text"))).first()[0] - 120_000) < 3_000
    assert [tuple(r) for r in out.select("doc_id", "copy").collect()] == [tuple(r) for r in mixing.mix(df.repartition(7), {"a": 1.0, "b": 0.0}, total=120_000.0).select("doc_id", "copy").collect()]
    assert mixing.mix(df.where("false")).count() == 0
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_poisson_counts_follow_the_distribution(spark):
    n = 20_000
    for mean in (0.3, 2.5, 700.0):
        table = spark.range(1).select(F.lit(mean).alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / mixing.PART), F.lit(1)).cast("int")).withColumn("cdf", mixing.cumulative(F.col("rate") / F.col("parts")))
        k = np.array([r[0] for r in spark.range(n).crossJoin(table).select(mixing.poisson(F.col("cdf"), F.col("parts"), 1, F.col("id").cast("string"))).collect()])
        assert abs(k.mean() - mean) < 5 * math.sqrt(mean / n) and abs(k.var() / mean - 1) < 0.06


def test_small_side_too_large_to_broadcast_is_salted(spark):
    big = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(50)], "id long, s string")
    small = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "s string, v int")
    one, two = (sorted(map(tuple, join_small(big, small, "s", rows=n).select("id", "v").collect())) for n in (10, 1))
    assert one == two and len(one) == 50


def labelled(seed=3, n=600):
    """Texts whose grade shows in marked words, and a label for most."""
    rng = random.Random(seed)
    v = vocabulary(seed)
    docs, labels = [], []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2, 3])
        w = [rng.choice(v) for _ in range(rng.randint(20, 120))] + [rng.choice([f"bad{k}" for k in range(6)]) for _ in range(1)] * (grade > 0) + ["worse"] * (grade > 1) + ["worst"] * (grade > 2)
        rng.shuffle(w)
        docs.append((i, " ".join(w), "en", "s", 1))
        if i % 4:
            labels.append((i, 1, grade))
    return docs, labels


def test_ordinal_grades_on_held_out_texts(spark):
    docs, labels = labelled()
    df = clashing(spark.createDataFrame(docs + [(None, None, None, None, None), (9000, "", None, None, 0)], DOCS))
    out = toxicity.severities(df, spark.createDataFrame(labels + [(None, 1, 2), (5, 1, None)], "doc_id long, quality int, grade int"), "grade").collect()
    assert len(out) == len(docs) + 2
    truth = {}
    for i, t, *_ in docs:
        truth[i] = ("bad" in t) + ("worse" in t) + ("worst" in t)
    held = [r for r in out if r.doc_id in truth and r.doc_id % 4 == 0]
    assert np.mean([abs(r.severity - truth[r.doc_id]) for r in held]) < 0.4
    assert np.mean([r.toxic == (truth[r.doc_id] > 0) for r in held]) > 0.97


def test_ordinal_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(300)]
    grade = np.array([min(2, int(0 in r) + int(1 in r or 2 in r)) for r in rows])
    x = linear.Rows(rows, np.arange(40))
    w, cuts = linear.ordinal_fit(x, grade, 3, 1e-3)
    assert np.all(np.diff(cuts) > 0) and w[0] > 0.5 and w[1] > 0.2 and abs(w[10:]).max() < w[0]


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in toxicity.severities(docs, none).collect()] == [False]
    assert toxicity.drop_toxic(docs.where("false"), none).count() == 0


def test_labels_of_one_grade_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(i, f"words of text {i} {'vile' if i % 2 else ''}", None, None, None) for i in range(40)] * 2, DOCS)
    only = spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in toxicity.severities(docs, only).collect()} == {True}
    assert {r.keep for r in cotrain.qualities(docs, only).collect()} == {True}
    mixed = [(i, 1 - i % 2, i % 2) for i in range(40)] * 2 + [(i, i % 2, 1 - i % 2) for i in range(40)]  # a minority says otherwise
    got = linear.labelled_sample(docs.dropDuplicates(["doc_id"]), spark.createDataFrame(mixed, "doc_id long, quality int, toxic int").select("doc_id", "toxic"), 100, 1, "toxic").collect()
    assert len(got) == 40 and all(r.toxic == r.doc_id % 2 for r in got)
    tied = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, toxic int")
    assert [r.toxic for r in linear.labelled_sample(docs.dropDuplicates(["doc_id"]), tied, 100, 1, "toxic").collect()] == [0]


def test_cotraining_on_held_out_texts(spark):
    rng = random.Random(4)
    v = vocabulary(4)
    docs = []
    for i in range(500):
        good = rng.random() < 0.7
        w = [rng.choice(v) for _ in range(rng.randint(10, 80))]
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        source = rng.choice(["a", "b"]) if good else rng.choice(["b", "c"])
        docs.append((i, text, "en", source, len(text)))
    labels = [(i, int("!!" not in t), 0) for i, t, *_ in docs if i % 3]
    df = clashing(spark.createDataFrame(docs + [(None, None, None, None, None), (9000, "", None, None, 0)], DOCS))
    out = cotrain.qualities(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 502
    held = [r for r in out if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 3 == 0]
    assert np.mean([r.keep == ("!!" not in docs[r.doc_id][1]) for r in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotrain.qualities(df, none).count() == 502 and cotrain.qualities(df.where("false"), none).count() == 0
    both = [r for r in out if r.p_meta > 0.8 or r.p_meta < 0.2]
    assert len(both) > 100 and np.mean([(r.p_meta > 0.5) == ("!!" not in docs[r.doc_id][1]) for r in both if r.doc_id is not None and r.doc_id < 500]) > 0.85  # a calibrated view


def test_statistics_come_from_the_other_views_surest_calls(spark):
    rng = random.Random(12)
    rows = [(f"{'fine' if i % 2 else 'foul'} {rng.choice('abcdef')} w{i}", "en", "good" if i % 2 else "bad") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    m = docs.select("text", cotrain.metadata(docs.columns).alias("m"))
    sure = m.where("text like 'fine%'").first().m
    meta = cotrain.Part(mix=np.array([-6.0, 1.0, 0.0]), weights=np.zeros(1 << linear.BITS, np.float32))
    meta.weights[[f for f in sure if f not in m.where("text like 'foul%'").first().m]] = 6.0  # the source decides
    text, back = cotrain.statistics(m, cotrain.Model(cotrain.Part(), meta, np.array([0.0, 1.0, 1.0])), (0.5, 0.5), Stash(spark, "test"), "a")
    told = {w: text[linear.present([w.encode()], linear.View())[1]] for w in ("fine", "foul", "a", "w7")}
    assert told["fine"] > 3 and told["foul"] < -3 and told["a"] == 0 and told["w7"] == 0
    assert not back.any()  # the text view is sure of nothing
    own = cotrain.Part(mix=np.array([0.0, 1.0, 0.0]), weights=np.zeros(1 << linear.BITS, np.float32))
    own.weights[linear.present([b"fine"], linear.View())[1]], own.weights[linear.present([b"foul"], linear.View())[1]] = 3.0, -3.0
    none, back = cotrain.statistics(m, cotrain.Model(own, cotrain.Part(), np.array([0.0, 1.0, 1.0])), (0.5, 0.5), Stash(spark, "test"), "b")
    assert not none.any() and back[[f for f in sure if f not in m.where("text like 'foul%'").first().m]].min() > 3


def test_the_surest_are_taken_by_rank():
    counts = np.array([0, 10, 0, 30, 40, 0, 20, 0])
    assert cotrain.surest(counts, (0.1, 0.2)) == (1, 6) and cotrain.surest(counts, (0.45, 0.6)) == (3, 4)
    assert cotrain.surest(counts, (0.01, 0.01)) == (1, 6)  # one bin at least
    assert cotrain.surest(np.array([0, 7, 0]), (0.5, 0.5)) == (-1, 3) and cotrain.surest(np.zeros(4), (0.5, 0.5)) == (-1, 4)


def taught(n=3000, seed=6):
    """Documents whose layout tells their quality nine times in ten and whose rare words tell it, each of few documents."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    good, bad, plain = ([word() for _ in range(k)] for k in (100, 100, 300))
    docs, truth = [], {}
    for i in range(n):
        y = rng.random() < 0.6
        w = [rng.choice(good if y else bad) for _ in range(4)] + [rng.choice(plain) for _ in range(20)]
        rng.shuffle(w)
        lines = rng.random() < (0.1 if y else 0.9)
        docs.append((i, ("\n" if lines else " ").join(w), "en", "s", 0))
        truth[i] = y
    return docs, truth


def test_the_exchange_teaches_the_text_view(spark):
    docs, truth = taught()
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(210)], "doc_id long, quality int")
    held = [i for i in truth if i >= 210]
    lists = [linear.present([d[1].encode()], cotrain.TEXT)[1] for d in docs]
    right = {}
    for rounds in (0, 2):
        m = cotrain.fit(df, labels, rounds=rounds)
        odds = m.text.odds(*cotrain._pairs([lists[i] for i in held]), len(held))
        right[rounds] = np.mean((odds >= 0) == np.array([truth[i] for i in held]))
        assert (rounds == 0) == (not m.text.counted.any())
    assert right[2] > right[0] + 0.05 and right[2] > 0.9


@pytest.mark.parametrize("n", [10, 20, 60])
def test_few_labels_calibrate_by_folds(spark, n):
    docs, truth = taught(400)
    rows = [(i, f"{'fine' if truth[i] else 'foul'} {t}", *rest) for i, t, *rest in docs]
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(n)], "doc_id long, quality int")
    out = cotrain.qualities(spark.createDataFrame(rows, DOCS), labels).collect()
    assert np.mean([r.keep == truth[r.doc_id] for r in out]) > 0.8 and len({r.quality for r in out}) > 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_both_views_learn_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for rounds in (1, 2):
        m = cotrain.fit(docs, labels.where("doc_id % 3 <> 0"), rounds=rounds)
        assert m.text.counted.any() and m.meta.counted.any()
    out = cotrain.qualities(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert len({round(r.p_meta, 6) for r in out}) > 10
    assert np.mean([r.keep == bool(r.y) for r in out]) > 0.95 and np.mean([(r.p_meta >= 0.5) == bool(r.y) for r in out]) > 0.9


def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    text = ("ab cd\t" * 50 + "é " + "x" * 500 + " end").encode()
    whole = words.word_hashes(text)
    monkeypatch.setattr(words, "PIECE", 64)
    assert (words.word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert len({*whole[:2].tolist()}) == 2 and (whole[0] == whole[2]) and len(words.word_hashes(b"")) == 0
    assert (words.windows(whole[:6], 2)[::2] == words.windows(whole[:6], 2)[0]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.classes(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    assert substring.deduplicated(none).count() == 0
    assert secrets.scan_all(none).count() == 0 and secrets.redact_documents(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminations(none, items).count() == 0
    assert decontam.drop_contaminated(spark.createDataFrame([(1, "a", "", "", 1)], DOCS), items).count() == 1


LONG = " ".join(f"w{i % 9973}x{i % 13}" for i in range(160_000))


def test_very_long_texts_are_read_whole(spark):
    """Texts of more than a piece, next to nulls and repeats: the same results as of their plain computation."""
    assert len(LONG) > words.PIECE
    rows = [(1, LONG, "en", "a", len(LONG)), (2, LONG + " tail", "en", "a", len(LONG) + 5), (3, None, None, None, None), (4, "", "en", "b", 0), (1, LONG, "en", "a", len(LONG))]
    docs = spark.createDataFrame(rows, DOCS)
    made = {r.doc_id: (r.fp, r.component_id) for r in simhash.classes(docs, 5, 0.8).collect()}
    assert made[1][1] == made[2][1] == 1 and made[3][1] == made[4][1] == 3 and made[1][0] == int(np.array([simhash.text_fingerprint(LONG.encode(), 5)], np.uint64).view(np.int64)[0])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3]
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicated(docs).collect()}
    assert removed[1] == (160_000, 0) and removed[2] == (160_001, 160_000) and removed[3] == (0, 0)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.severities(docs, labels), cotrain.qualities(docs, labels)):
        got = out.collect()
        assert len(got) == 5 and len({tuple(r) for r in got if r.doc_id == 1}) == 1  # repeated rows are scored alike
    mixed = mixing.mix(docs, total=3.0 * len(LONG))
    assert {(r.doc_id, r.n) for r in mixed.select("doc_id", F.length("text").alias("n")).distinct().collect()} <= {(1, len(LONG)), (2, len(LONG) + 5), (3, None), (4, 0)}


def test_scans_of_rows_with_clashing_columns(spark):
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(secret_texts())], DOCS))
    plain = secrets.digest(secrets.scan_all(spark.createDataFrame(list(enumerate(secret_texts())), "doc_id long, text string"))).collect()
    assert sorted(map(tuple, secrets.digest(secrets.scan_all(df)).collect())) == sorted(map(tuple, plain))


def test_redaction_of_thousands_of_matches_in_a_long_text(spark):
    """Overlapping spans, characters of several bytes, more spans than a fold takes."""
    parts = [f"é{'日' * (i % 7)} token=abcdefgh{i:05d} \U0001f600 {'0123456789abcdef' * 2} password: {'0123456789abcdef' * 2}" for i in range(2500)]
    text = " \n".join(parts)
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "none é", "en", "s", 6), (3, parts[0] + " end", "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in secrets.redact_documents(df).collect()}
    clean = lambda t: re.sub(r"token=abcdefgh\d+", "[secret:assign]", re.sub(r"password: [0-9a-f]{32}", "[secret:assign]", t))
    clean = lambda t, f=clean: re.sub(r"(?<!\S)(?:0123456789abcdef){2}", "[secret:hex]", f(t))
    assert got[1].text == clean(text) and got[1].n_chars == len(got[1].text) and got[2].text == "none é" and got[3].text == clean(parts[0]) + " end"
