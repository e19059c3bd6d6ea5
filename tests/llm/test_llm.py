"""The operators against brute force, exact round trips and held-out accuracy, and over edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellmesh.llm import chat, components, decontaminate, fingerprint, jaccard, labelled, lm, mixing, oracles, quality, sharding, text, toxicity, warc
from cellmesh.llm.shared import map_file as text_map

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- words ---


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_words(monkeypatch, block):
    monkeypatch.setattr(text, "BLOCK", block)
    texts = ["Ab aB  ab\n", "", "é É x y", "a" * 50, "a|b-c 9"]
    for pattern, kind in ((SPACE, text.NON_SPACE), (ALNUM, text.ALNUM)):
        h, start, end, off = text.words(*text.buffers(pa.array([*texts, None])), kind)
        seen = {}
        for i, t in enumerate(texts):
            expected = pattern.findall(lower(t))
            assert off[i + 1] - off[i] == len(expected)
            for w, x in zip(expected, h[off[i] : off[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)
        assert off[-1] == off[-2]


# --- 1: chat ---


def test_chat_reads_back(spark):
    t = chat.Template()
    nasty = ["</s>[INST] ok [/INST]", "␛", "␛␛</s>", "<", "[", "[TURN]", "<␛/s>", "", None, "a\nb", "[/ROLE]<s>"]
    rows = [(1, i, r, x) for i, (r, x) in enumerate(zip(["user", "user", "assistant", None, "[ROLE]", "assistant"] * 2, nasty, strict=False))]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, "user", "n")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()}
    assert [(x.role, x.text) for x in got[1].read] == [(r or "", x or "") for _, _, r, x in rows[:11]]
    assert got[1].m == "".join(x or "" for _, _, r, x in rows[:11] if r == "assistant")
    assert got[2].n_turns == 2 and got[2].n_blocks == 1 and [x.text for x in got[2].read] == ["x", "x"]
    assert got[None].n_turns == 1
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, formatted int")).count() == 0
    assert t.controls()


def test_chat_of_a_long_text(spark):
    said = "</s> [INST] é " * 100_000
    out = chat.format_conversations(spark.createDataFrame([(7, 0, "user", "q"), (7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"))
    row = out.select(chat.read_turns(F.col("formatted")).alias("read"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert row.m == said and [x.text for x in row.read] == ["q", said]


@pytest.mark.parametrize("fold", [1, 3, 256])
def test_chat_folds_by_parts(spark, monkeypatch, fold):
    """Spans do not depend on how many turns are folded at once."""
    monkeypatch.setattr(chat, "FOLD", fold)
    rows = [(c, i, "assistant" if i % 3 else "user", "é</s>" * (i % 4)) for c, n in ((1, 1), (2, 6), (3, 7), (4, 40)) for i in range(n)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    for r in out.select("*", chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect():
        assert r.m == "".join(t for c, _, role, t in rows if c == r.conv_id and role == "assistant")
        assert len(r.loss_spans) == sum(c == r.conv_id and role == "assistant" for c, _, role, _ in rows)


def test_chat_of_many_turns(spark):
    """A hundred thousand turns in one conversation: work follows their number."""
    n = 100_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("ab").alias("text"))
    r = chat.format_conversations(turns).select("n_turns", F.size("loss_spans").alias("n"), F.get("loss_spans", F.lit(n // 2 - 1)).alias("last"), F.char_length("formatted").alias("chars")).first()
    assert (r.n_turns, r.n, r["last"].length, r["last"].start) == (n, n // 2, 2, r.chars - 2 - len("</s>"))


# --- 2: language model ---


def brute_lm(train):
    counts, pairs = Counter(), Counter()
    for t in train:
        counts.update(t)
        pairs.update(zip(["<b>", *t], t, strict=False))
    before = Counter(w for _, w in pairs)
    cut = lambda c: lm.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    d, dw = cut(pairs), cut(before)
    rest = sum(dw[min(k, 3)] for k in before.values()) / len(pairs)
    total, by = Counter(), defaultdict(lambda: [0] * 4)
    for (h, _), k in pairs.items():
        total[h] += k
        by[h][min(k, 3)] += 1

    def p(h, w):
        q = max(before[w] - dw[min(before[w], 3)], 0) / len(pairs) + rest / (len(counts) + 1)
        k = pairs[h, w]
        return q if not total[h] else (max(k - d[min(k, 3)], 0) + sum(d[j] * by[h][j] for j in (1, 2, 3)) * q) / total[h]

    return p, counts


def test_lm_against_brute_force(spark):
    docs = read(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    tokens = {i: [*SPACE.findall(lower(t)), "</e>"] for i, t in rows}
    learned = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    p, counts = brute_lm(learned)
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    assert (model.tokens, model.known) == (counts.total(), len(counts))
    for r in lm.score(docs, model).collect():
        t = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<b>", *t], t, strict=False)), rel=1e-5)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (counts.total() + len(counts) + 1)) for w in t))
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in counts for w in t))
    assert sum(p("the", w) for w in [*counts, "unknown"]) == pytest.approx(1)


def test_lm_edges(spark, edges, nothing):
    model = lm.train(nothing)
    assert {(r.n_tokens, r.n_known, r.score) for r in lm.score(edges.where("doc_id <= 2"), model).collect()} == {(1, 0, 0.0)}
    model = lm.train(edges)
    assert lm.score(edges, model).count() == 8 and lm.score(nothing, model).count() == 0


# --- 3: fingerprints ---


def test_entropy_windows():
    data = np.random.default_rng(1).integers(90, 110, 3000).astype(np.uint8)
    data[500:700] = 7
    found = fingerprint.entropies(data)
    for i in range(0, len(found), 97):
        c = np.bincount(data[i : i + fingerprint.WINDOW])
        c = c[c > 0] / fingerprint.WINDOW
        assert abs(found[i] + (c * np.log2(c)).sum() / np.log2(fingerprint.WINDOW) * fingerprint.STEPS) <= 0.51


def test_fingerprints(spark):
    docs = read(spark, "documents").select("doc_id", "text", F.lit(1).alias("fingerprint"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs, parts=5).collect()}
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
        assert got[i].n_chars == len(t)
        by_text[t].add(got[i].fingerprint)
        assert got[i].near_edited == pytest.approx(fingerprint.likeness(fingerprint.decode(got[i].fingerprint), fingerprint.decode(got[i].edited_fingerprint)))
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r.near_edited > r.near_next for r in got.values()) / len(got) > 0.95


def test_fingerprint_edges(edges, nothing, documents):
    assert fingerprint.fingerprints(edges).count() == 8
    assert fingerprint.fingerprints(nothing).count() == 0
    one = fingerprint.fingerprints(documents([(1, "alone here")])).first()
    assert one.near_next == 1.0
    empty = np.zeros((0, 32), np.uint64)
    assert fingerprint.likeness(empty, empty) == 1.0 and fingerprint.likeness(empty, np.ones((1, 32), np.uint64)) == 0.0


def test_blocks_do_not_change_digests(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abcdefgh ijk", k=n)) for n in (5000, 10, 200, 40_000)]
    ranks = np.arange(fingerprint.STEPS + 1, dtype=np.int32)
    whole = fingerprint.digests(texts, ranks)
    monkeypatch.setattr(fingerprint, "CHUNK", 1000)
    for a, b, t in zip(whole, fingerprint.digests(texts, ranks), texts, strict=True):
        assert (a == b).all() and (fingerprint.digests([t], ranks)[0] == a).all()


def plain_digest(t, ranks):
    """Bits of each filter of a text, window by window and feature by feature."""
    word = (1 << 64) - 1
    whole, hashes, word = t.ljust(fingerprint.WINDOW, b"\0") if t else b"", [], (1 << 64) - 1
    steps = fingerprint.entropies(np.frombuffer(whole, np.uint8))
    won = Counter()
    better = lambda i: (ranks[steps[i]], i)
    run = next(r for r, least in ((32, 512), (16, 256), (8, 128), (4, 0)) if len(t) >= least)
    for a in range(len(steps)):
        won[min(range(a, min(a + run, len(steps))), key=better)] += 1
    chosen = sorted(i for i, n in won.items() if n >= min(max(len(t) // 128, 1), fingerprint.WINS))
    if t and not chosen:
        chosen = [min(range(len(steps)), key=better)]
    for i in chosen:
        h = sum((b + 1) * pow(text.BASE, j + 1, 1 << 64) for j, b in enumerate(whole[i : i + fingerprint.WINDOW])) & word
        h = (h ^ h >> 30) * text.MIX_A & word
        h = (h ^ h >> 27) * text.MIX_B & word
        hashes.append(h ^ h >> 31)
    hashes = list(dict.fromkeys(hashes))
    return [{h >> 11 * j & fingerprint.BITS - 1 for h in hashes[a : a + fingerprint.FEATURES] for j in range(fingerprint.HASHES)} for a in range(0, len(hashes), fingerprint.FEATURES)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    chance = lambda x, y: len(x) * len(y) / fingerprint.BITS
    best = [max((len(x & y) - chance(x, y)) / max(min(len(x), len(y)) - chance(x, y), 1e-9) for y in b) for x in a]
    return sum(len(x) * min(1, max(0, v)) for x, v in zip(a, best, strict=True)) / sum(map(len, a))


def test_digests_against_brute_force():
    rng = random.Random(11)
    base = bytes(rng.choices(b"abcdefgh ijk.\n", k=30_000))
    texts = [base, base[:700], base[:15_000] + bytes(rng.choices(b"xyz uvw", k=9000)), b"", b"a", b"short text here", b"x" * 400, base[100:228], base[100:227], base[:31], base[:33]]
    ranks = np.random.default_rng(4).permutation(fingerprint.STEPS + 1).astype(np.int32)
    plain = [plain_digest(t, ranks) for t in texts]
    for digest, bits in zip(fingerprint.digests(texts, ranks), plain, strict=True):
        assert [set(np.flatnonzero(np.unpackbits(f.view(np.uint8)))) for f in digest] == bits
    assert len(plain[0]) > 1
    for i, x in enumerate(fingerprint.digests(texts, ranks)):
        for j, y in enumerate(fingerprint.digests(texts, ranks)):
            if (len(x), i) <= (len(y), j) or len(x) != len(y):
                assert fingerprint.likeness(x, y) == pytest.approx(plain_likeness(plain[i], plain[j]))


def test_one_law_at_all_lengths():
    """Around the lengths where the wins needed change, texts that differ by a byte stay alike; short texts are told apart."""
    rng = random.Random(5)
    ranks = np.random.default_rng(4).permutation(fingerprint.STEPS + 1).astype(np.int32)
    base = bytes(rng.choices(b"abcdefgh ijk.\n", k=2000))
    for n in (2, 31, 32, 33, 127, 128, 129, 255, 256, 383, 384, 1023, 1024):
        x, y, other = fingerprint.digests([base[:n], base[: n + 1], bytes(rng.choices(b"lmnopqrs", k=n))], ranks)
        assert len(x) and fingerprint.likeness(x, y) >= (0.7 if n > 100 else 0.5 if n > 30 else 0)
        assert fingerprint.likeness(x, other) <= 0.3
    lonely = fingerprint.digests([b"a", b"b", b"a"], ranks)
    assert (lonely[0] == lonely[2]).all() and fingerprint.likeness(lonely[0], lonely[1]) < 0.5
    # A text's digest does not depend on what stands around it.
    for texts in ([base[:127], b"", base[:40]], [b"zz", base[:127]], [base[:127]]):
        assert (fingerprint.digests(texts, ranks)[texts.index(base[:127])] == fingerprint.digests([base[:127]], ranks)[0]).all()


@pytest.mark.parametrize("most", [20_000, 3])
def test_similarity_join_against_brute_force(spark, documents, most):
    """Every link between different sets, inside groups of near copies too, and each document's number of links."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, t) for i, t in read(spark, "documents").select("doc_id", "text").limit(60).collect()]
    rows += [(1000 + i, " ".join(w if r.random() > 0.02 else "x" for w in base)) for i in range(25)]
    rows += [(2000 + i, "short text of six words" + " here" * (i % 2)) for i in range(4)] + [(3000, None), (3001, " "), (3002, "one"), (3003, "one"), (1000, rows[60][1])]
    links, members = jaccard.similarity_join(documents([*rows, (None, "one")]), most=most)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := SPACE.findall(lower(t))) else set() for i, t in rows}
    alike = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)
    of = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    reps = sorted(set(of.values()))
    assert sorted((x.a, x.b) for x in links.collect()) == [(a, b) for a in reps for b in reps if a < b and alike(sets[a], sets[b])]
    got = [(x.doc_id, x.n_shingles, x.class_id, x.n_links) for x in members.collect()]
    expected = [(i, len(sets[i]), of.get(i), sum(j != i and alike(sets[i], sets[j]) for j in sets)) for i, _ in rows]
    assert sorted(got, key=repr) == sorted([*expected, (None, 1, None, 0)], key=repr)
    assert max(n for *_, n in expected) > 5


def test_ids_that_are_texts(spark):
    """Ids of text: the next document and the least id follow their order."""
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other"), (None, "one two three four five six"), ("aa", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r.doc_id: r for r in fingerprint.fingerprints(docs, parts=2).collect()}
    assert set(found) == {"a", "aa", "b", "c", None}
    assert found["b"].edited_sha256 == hashlib.sha256(fingerprint.edited("one two three four five six", "").encode()).hexdigest()  # then comes "aa"
    assert found["c"].edited_sha256 == hashlib.sha256(fingerprint.edited("other", "one two three four five six").encode()).hexdigest()
    same = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert same == {"a": "a", "b": "a", "c": "c", "aa": "aa", None: None}


def test_ranks_follow_rarity(documents):
    rows = [(i, t) for i, t in enumerate(["ab" * 300, "abcdefghijklmnopqrstuvwxyz0123456789" * 3, None, "abc" * 200])]
    seen = Counter(int(e) for _, t in rows if t for e in fingerprint.entropies(np.frombuffer(t.encode(), np.uint8)))
    ranks = np.frombuffer(text_map(fingerprint.rarity(documents(rows))), np.int32)
    common = [e for e in seen if e >= fingerprint.STEPS // 10]
    assert sorted(common, key=lambda e: (seen[e], e)) == sorted(common, key=lambda e: ranks[e]) and min(ranks[e] for e in range(fingerprint.STEPS + 1) if e not in common) == len(common)


# --- 4: toxicity ---


def small_net(kind):
    """A model of few filters with weights of the given kind, and the tokens of some texts."""
    model = toxicity.start_model()
    r = np.random.default_rng(8)
    model["table"] = r.standard_normal(model["table"].shape).astype(kind)
    model["table"][toxicity.PAD] = 0
    model["filters"] = [r.standard_normal(f.shape).astype(kind) for f in model["filters"]]
    model["bias"] = [r.standard_normal(b.shape).astype(kind) for b in model["bias"]]
    model["out"], model["out_bias"] = r.standard_normal(model["out"].shape).astype(kind), kind(0.3)
    return model, *toxicity.tokens(pa.array(["one two three two", "", "four", None, "five six seven eight nine ten one"]))


def test_forward_against_loops():
    model, rows, off = small_net(np.float64)
    pooled, _, _ = toxicity.forward(model, rows, off)
    x = [model["table"][a] + model["table"][b] for a, b in rows.tolist()]
    for t in range(5):
        here = range(off[t], off[t + 1] - max(toxicity.WIDTHS) + 1)
        for k, w in enumerate(toxicity.WIDTHS):
            kernel = model["filters"][k].reshape(w, toxicity.DIM, toxicity.FILTERS)
            for f in range(toxicity.FILTERS):
                values = [max(0.0, model["bias"][k][f] + sum(float(x[i + j] @ kernel[j][:, f]) for j in range(w))) for i in here]
                assert pooled[t, k * toxicity.FILTERS + f] == pytest.approx(max(values, default=0.0))


def test_gradients_against_differences():
    model, rows, off = small_net(np.float64)
    y, share = np.array([1.0, 0, 1, 0, 0]), np.array([0.5, 1, 2, 1, 0.7])

    def value():
        p = toxicity.sigmoid(toxicity.logits(model, toxicity.forward(model, rows, off)[0]))
        return -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 5

    g, hit, table = toxicity.gradients(model, rows, off, y, share)
    places = [(model["out"], (3,), g["out"][3]), (model["out"], (20,), g["out"][20])]
    places += [(model["filters"][k], (5, f), g[f"filters{k}"][5, f]) for k in range(3) for f in (0, 4)] + [(model["bias"][k], (f,), g[f"bias{k}"][f]) for k in range(3) for f in (1, 6)]
    places += [(model["table"], (int(hit[i]), j), table[i, j]) for i in (0, len(hit) // 2) for j in (0, 7)]
    for array, at, found in places:
        before, eps = array[at], 1e-6
        array[at] = before + eps
        up = value()
        array[at] = before - eps
        down = value()
        array[at] = before
        assert found == pytest.approx((up - down) / (2 * eps), abs=1e-7)


def test_scores_depend_on_the_text_alone(spark):
    """Rows in any order and in any batches get the same scores, to the last bit."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.limit(300).collect()]
    rows += [(1000 + i, t) for i, t in rows[:100]] + [(5000, None), (5001, ""), (5002, "word " * 50_000)]
    uri = toxicity.train(docs, labels, per_class=60)
    model, found = labelled.load(uri), []
    for seed, size in ((1, 1), (2, 7), (3, 64), (4, 1000)):
        mixed = random.Random(seed).sample(rows, len(rows))
        scores = {}
        for a in range(0, len(mixed), size):
            pooled, _, _ = toxicity.forward(model, *toxicity.tokens(pa.array([t for _, t in mixed[a : a + size]], pa.large_string())))
            scores |= dict(zip((i for i, _ in mixed[a : a + size]), toxicity.logits(model, pooled).tolist(), strict=True))
        found.append(scores)
    assert all(x == found[0] for x in found) and len(set(found[0].values())) > 200
    assert all(found[0][1000 + i] == found[0][i] for i, _ in rows[:100]) and found[0][5000] == found[0][5001]
    for parts in (1, 5):
        got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), uri).collect()}
        assert all(got[1000 + i] == got[i] for i, _ in rows[:100])
        assert parts == 1 or got == before
        before = got


def test_scores_of_empty_null_and_repeated_rows(spark, edges):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    tox = [(r.doc_id, r.score) for r in toxicity.score(edges, toxicity.train(edges, labels)).collect()]
    grade = [(r.doc_id, r.quality_score.tail_probability) for r in quality.score(edges.drop("quality_score"), quality.train(edges, labels)).collect()]
    for scores in (tox, grade):
        by = defaultdict(list)
        for i, x in scores:
            by[i].append(x)
        assert len(scores) == 8 and by[1] == by[2] == by[6] and by[4][0] == by[4][1] and len(by[4]) == 2


def test_samples_are_whole_where_they_can_be(spark, documents):
    """70 values, long texts and repeated ids: each value is there, ids are drawn among texts that qualify, bytes are bounded."""
    docs = documents([(i, "w " * (1 + i % 5) if i % 2 else "long " * 50) for i in range(280)] + [(1, "other")])
    labels = spark.createDataFrame([(i, i // 4) for i in range(280)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    rows = labelled.sample(docs, labels, "quality", 1, learn_bytes=100)
    assert sorted(r["label"] for r in rows) == list(range(70)) and all(r["doc_id"] % 2 and r["total"] == 4 for r in rows)
    few = labelled.sample(docs, labels, "quality", 4, sample_bytes=70 * 12)
    assert 0 < len(few) and all(sum(len(r["text"]) for r in few if r["label"] == v) <= 12 for v in range(70))
    with pytest.raises(ValueError):
        labelled.sample(docs, labels.withColumn("quality", F.col("doc_id")).unionByName(spark.range(1000, 2500).select(F.col("id").alias("doc_id"), F.col("id").alias("quality"))), "quality", 1)


def test_toxicity_learns(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(600):
        toxic = k % 6 == 0
        t = rng.choices(words, k=60) + ([rng.choice(["vile", "awful"]) for _ in range(2)] if toxic else [])
        rng.shuffle(t)
        rows.append({"label": int(toxic), "total": 100 if toxic else 500, "text": " ".join(t), "lang": "en"})
    model = toxicity.fit(rows[:450])
    pooled, _, _ = toxicity.forward(model, *toxicity.tokens(pa.array([r["text"] for r in rows[450:]] + ["", None])))
    p = toxicity.sigmoid(model["scale"][0] * toxicity.logits(model, pooled) + model["scale"][1])
    y = np.array([r["label"] for r in rows[450:]])
    assert ((p[:-2] >= 0.3) == y).mean() > 0.95
    assert p[-1] == p[-2] < 0.3


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1, 1), (None, 0, 0), (99, None, None)], "doc_id bigint, quality int, toxic int")
    uri = toxicity.train(edges, labels)
    out = toxicity.score(edges, uri)
    assert out.count() == 8 and out.where("score < 0 or score > 1").count() == 0
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0


def test_toxicity_thresholds_cover_all_rows(spark):
    # 2 % of the toxic labels are of a language that the sample of 60 rows of a label has once or twice.
    rows = [(i, f"w{i % 7} w{i % 11} {'vile' if i % 2 else 'nice'}", "xx" if i % 100 in (0, 1) else "en", i % 2) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    uri = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), per_class=60)
    found = {r.lang: r.threshold for r in toxicity.languages(spark, uri).collect()}
    scored = toxicity.score(docs, uri)
    for r in toxicity.flagged(scored, uri).collect():
        assert r.flagged == (r.score >= found.get(r.lang, toxicity.DEFAULT_THRESHOLD))
    assert set(found) == {"en", "xx"}


def test_toxicity_thresholds_weigh_labels():
    # F1 at 0.3 and at 0.35: 16/28 and 12/16 with labels as counted, 320/370 and 240/320 with 20 times the label 1.
    counts = [("en", 1, 6, 2), ("en", 1, 10, 6), ("en", 1, 0, 2), ("en", 0, 6, 10), ("en", 0, 0, 90), ("xx", 1, 19, 4), (None, 1, 19, 9)]
    assert toxicity.thresholds(counts, {0: 100, 1: 23})["en"] > 0.3
    assert toxicity.thresholds(counts, {0: 100, 1: 460}) == {"en": 0.3}


# --- 5: near duplicates ---


def brute_components(rows, k=5, percent=80):
    def shingles(t):
        w = SPACE.findall(lower(t))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return {i: (len(a), root(i)) for i, a in sets}


@pytest.mark.parametrize("most", [3, jaccard.LIST])
def test_near_duplicates(spark, documents, most):
    rng = random.Random(2)
    rows = []
    for n in (1, 4, 6, 8, 9, 10, 13, 30, 120):
        base = [f"v{rng.randrange(60)}" for _ in range(n + 4)]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(1000)}"
            cut = rng.randrange(3)
            rows.append(" ".join(t[cut:] if rng.random() < 0.5 else t + t[:cut]))
    rows = [(i, t) for i, t in enumerate(rows + ["", None, "a", "a"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(rows), most=most).collect()}
    assert got == brute_components(rows)


def test_subsets_meet():
    """Two light sets are similar exactly where they share a subset of the size that theirs ask for."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = text.keys(14, int(rng.integers(1 << 30)))
        a, b = (np.sort(rng.choice(pool, int(rng.integers(1, 12)), replace=False)) for _ in range(2))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 80 * (len(a) + len(b) - o):
            assert len(np.intersect1d(jaccard.subset_keys(a, 80), jaccard.subset_keys(b, 80)))


def test_boundary_follows_cost():
    assert jaccard.light_up_to(np.zeros(21), 80) == 0
    sizes = np.zeros(21)
    sizes[3:15] = 1000
    assert 5 <= jaccard.light_up_to(sizes, 80) <= 12


def test_near_duplicate_edges(edges, nothing):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(edges).collect())
    assert (4, 12, 4) in got and (1, 0, 1) in got and (0, 1, None) in got and len(got) == 8
    assert jaccard.near_duplicates(nothing).count() == 0
    kept = jaccard.one_of_each(edges)
    clash = jaccard.one_of_each(edges.withColumnsRenamed({"shard": "gone_id", "quality_score": "gone_id_"}))
    assert clash.count() == 7 and {"gone_id", "gone_id_"} <= set(clash.columns)
    assert kept.columns == edges.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id is null").count() == 1 and kept.count() == 7


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- 6: mixing ---


def test_targets_by_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("d", 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    left, weights, size = 2015.0, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 10, "b": 1000, "c": 1000, "d": 0, None: 5}
    capped = set()
    while True:
        open_ = [s for s in weights if s not in capped]
        share = {s: (left - sum(3 * size[c] for c in capped)) * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in weights:
        assert got[s] == pytest.approx(3 * size[s] if s in capped else share[s])


def test_mix(spark, edges, nothing):
    docs = read(spark, "documents")
    out = [tuple(r) for r in mixing.mix(docs).orderBy("doc_id").collect()]
    assert out == [tuple(r) for r in mixing.mix(docs.repartition(7)).orderBy("doc_id").collect()]
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for _, source, size, _, source_size, target, _, copies, taken in out:
        x = by[source]
        x[0], x[1], x[2], x[3] = x[0] + taken, source_size, target, max(x[3], size)
        assert taken == copies * size <= 3 * size
    assert all(abs(taken - target) <= most for taken, _, target, most in by.values())
    assert mixing.mix(edges).count() == 8 and mixing.mix(nothing).count() == 0
    again = mixing.repeat(edges, mixing.mix(edges))
    assert again.columns == edges.columns and again.count() == mixing.mix(edges).agg(F.sum("copies")).first()[0]


def test_targets_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.sql(oracles.MIXING).fetchall()
    got = sorted((r.doc_id, r.size, r.source_size, r.target) for r in mixing.mix(read(spark, "documents")).collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(expected)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(expected)])


def test_each_unit_keeps_its_expectation(spark):
    """500 times the same 24 units under other keys: each is rounded up as often as its fraction says."""
    fraction = lambda i: 0.05 + 0.9 * (i * 7 % 24) / 24
    rows = [(str(g), g * 100 + i, 1 + i % 5, fraction(i), 24) for g in range(500) for i in range(24)]
    out = mixing.pivotal_round(spark.createDataFrame(rows, "group string, key bigint, size bigint, p double, n bigint"), seed=3, block=8).collect()
    assert len(out) == len(rows)
    ups, words = Counter(), Counter()
    for r in out:
        ups[r.key % 100] += r.up
        words[r.group] += r.up * (1 + r.key % 100 % 5)
    assert all(abs(ups[i] / 500 - fraction(i)) <= 4 * math.sqrt(0.25 / 500) for i in range(24))
    total = sum(fraction(i) * (1 + i % 5) for i in range(24))
    assert all(abs(n - total) < 5 for n in words.values())


def test_rounding_keeps_expectation(spark):
    units = spark.createDataFrame([("g", i, 1 + i % 7, 0.3, 900) for i in range(900)], "group string, key bigint, size bigint, p double, n bigint")
    rows = mixing.pivotal_round(units, seed=1, block=32).join(units.drop("group", "n"), "key").collect()
    assert len(rows) == 900
    assert abs(sum(r.up * r["size"] for r in rows) - sum(0.3 * r["size"] for r in rows)) <= 7


# --- 7: decontamination ---


def brute_hits(words, items, window=10):
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        for a in range(len(item) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == item[a : a + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(hit), sorted(found)


def test_decontamination(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 40)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 7, 9, 10, 11, 14, 14, 25]) if n != 1]
    items += [(50, None), (51, items[-1][1]), (None, "q q q q")]
    rows = []
    for i in range(120):
        t = [word() for _ in range(rng.randrange(40))]
        item = rng.choice(items)[1] or ""
        rows.append((i, " ".join([*t, item.upper(), ".", *t[:3]])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    split = [(None if i is None else str(i), ALNUM.findall(lower(t))) for i, t in items]
    for r in decontaminate.scan(documents(rows), bench).collect():
        words = ALNUM.findall(lower(dict(rows)[r.doc_id]))
        n, found = brute_hits(words, [(k or "?", x) for k, x in split])
        assert (r.n_words, r.n_hit, r.item_ids) == (len(words), n, [x for x in found if x != "?"])
    clean = decontaminate.decontaminate(documents(rows), bench, max_coverage=1.0)
    assert decontaminate.scan(clean, bench).where("n_hit > 0").count() == 0
    assert clean.where("n_chars <> char_length(text)").count() == 0


def test_decontamination_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "zz yy xx ww vv uu tt ss rr qq")], "item_id bigint, text string")
    same = decontaminate.decontaminate(edges, bench)
    assert sorted(map(str, same.collect())) == sorted(map(str, edges.collect()))
    assert decontaminate.scan(edges, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(nothing, bench).count() == 0


# --- 8: WARC ---


def test_chunk_framing():
    for n in (0, 1, 4096, 4097, 20_000):
        data = bytes(i % 251 for i in range(n))
        assert warc.dechunked(warc.chunked(data)) == data
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_archives(spark):
    long = "é<p>" * 40_000
    rows = [(1, "http://a", "x" * 1000), (2, "http://b\r\nX: 1", "x" * 1000), (3, None, long), (4, "u", long + "!"), (5, "u", ""), (6, "u", None), (7, "u", "short"), (8, "u", "short"), (None, "u", "x" * 1000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    listing = warc.write_archives(warc.revisits(pages), segment_bytes=5000, archive_bytes=500)
    assert listing.count() > 3
    got = {r.page_id: r for r in warc.read_archives(listing).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].complete) == (len(raw), hashlib.sha1(raw).hexdigest(), True)
        assert got[i].payload == (None if i == 1 else raw)
    assert (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[8].record_type == got[7].record_type == "response"
    assert warc.through_archives(spark, pages.limit(0)).count() == 0


def test_archives_with_repeats_and_extra_columns(spark):
    long = "<p>é</p>" * 150_000
    rows = [(1, "a", "x" * 2000, 5), (3, "b", "x" * 2000, 6), (3, "c", "x" * 2000, 7), (9, "d", long, 8)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    listing = warc.write_archives(warc.revisits(pages))
    got = sorted((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(listing).collect())
    assert got == [(1, "a", "revisit", 3, 2000), (3, "b", "response", None, 2000), (3, "c", "response", None, 2000), (9, "d", "response", None, len(long.encode()))]
    headers = [warc.parse(m)[0] for r in listing.collect() for m in warc.members(r.uri)]
    one = next(h for h in headers if h["warc-type"] == "revisit")
    assert one["warc-refers-to"] in {h["warc-record-id"] for h in headers if h["warc-type"] == "response" and h["warc-target-uri"] == one["warc-refers-to-target-uri"]}


def test_missing_segment(spark):
    parts = spark.createDataFrame([(9, "u", "y" * 9000)], "page_id bigint, url string, html string")
    listing = warc.write_archives(warc.revisits(parts), segment_bytes=2000, archive_bytes=1)
    kept = listing.orderBy("uri").collect()[1:]
    rows = warc.read_archives(spark.createDataFrame(kept, listing.schema)).collect()
    assert len(rows) == 1 and rows[0].complete is False and rows[0].payload is None


def test_pages_above_an_archive(spark):
    """A page larger than an archive and than a batch: its segments lie in several archives and come together."""
    large = "".join(chr(97 + i % 26) for i in range(1000)) * 50_000
    pages = spark.createDataFrame([(1, "u1", large), (2, "u2", "small"), (3, "u3", None), (4, "u4", large)], "page_id bigint, url string, html string")
    listing = warc.write_archives(warc.revisits(pages), segment_bytes=4 << 20, archive_bytes=1 << 18)
    assert listing.count() > 3
    got = {r.page_id: r for r in warc.read_archives(listing, keep_payload=False).collect()}
    assert got[4].payload_bytes == 50_000_000 and got[4].complete and got[4].payload_digest == hashlib.sha1(large.encode()).hexdigest()
    assert (got[1].record_type, got[1].refers_to, got[3].payload_bytes) == ("revisit", 4, 0)


# --- 9: sharding ---


def jump(key, n):
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("first", [2, sharding.FIRST])
@pytest.mark.parametrize("n", [1, 2, 40, 41, 5000])
def test_jump(spark, monkeypatch, n, first):
    monkeypatch.setattr(sharding, "FIRST", first)
    keys = [0, 1, -1, 2**62, -(2**63), *range(-300, 300, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jumps(F.col("k"), n).alias("s"))
    assert {r.k: tuple(r.s) for r in df.collect()} == {k: (jump(k, n), jump(k, n + 1)) for k in keys}


def test_shards(spark, edges, nothing):
    docs = read(spark, "documents")
    slots = defaultdict(list)
    for r in sharding.shard(docs, 6, keep=True).collect():
        crc, size = zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16
        assert r.shard == jump(r.doc_id, 6) and r.grown_shard == jump(r.doc_id, 7) and (r.text_crc32, r["size"]) == (crc, size)
        slots[r.shard].append((hashlib.md5(f"{r.doc_id}:{crc}:{size}".encode()).hexdigest()[:3], r.doc_id, crc, size, r.slot))
    # One law: the order of digest, id, crc and size, whatever else the table holds.
    assert all([x[-1] for x in sorted(rows)] == list(range(len(rows))) for rows in slots.values())
    assert sharding.shard(edges, 3, keep=True).count() == 8 and sharding.shard(nothing, 3).count() == 0
    kept = sharding.shard(edges, 3, keep=True)
    assert kept.columns.count("shard") == 1 and {r.shard_in for r in kept.collect()} == {7}


# --- 10: quality ---


def test_quality_orders_grades():
    rng = random.Random(1)
    rows = []
    for k in range(600):
        grade = k % 3
        t = [rng.choice(["good", "fine", "plain"]) if rng.random() < 0.2 + 0.3 * grade else f"junk{rng.randrange(20)}!!" for _ in range(80)]
        rows.append({"label": grade, "total": 200, "text": " ".join(t)})
    model = quality.fit(rows[:450])
    assert model["grades"] == [0, 1, 2] and model["thresholds"][0] < model["thresholds"][1]
    s = quality.means(*quality.features(pa.array([r["text"] for r in rows[450:]])), model["weights"])
    grade = (s[:, None] > model["thresholds"][None, :]).sum(axis=1)
    assert (grade == [r["label"] for r in rows[450:]]).mean() > 0.9


def test_quality_selects(spark, edges, nothing):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    kept = quality.select(docs, labels)
    assert kept.columns == docs.columns
    both = labels.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    good = both.where("quality = 1")
    assert good.where("kept = 1").count() / good.count() > 0.97
    assert quality.select(edges, labels.limit(0)).columns == edges.columns and quality.select(edges, labels.limit(0)).count() == 8
    assert quality.select(nothing, labels).count() == 0


def test_quality_learns_from_3000_rows_of_a_grade(documents, spark):
    n = 2800
    texts = [(i, f"own{i} {'good' if i % 2 else 'junk'} text") for i in range(2 * n)]
    docs = documents(texts)
    model = labelled.load(quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))))
    whole = quality.fit([{"label": i % 2, "total": n, "text": t} for i, t in texts])
    assert np.allclose(model["weights"], whole["weights"], atol=1e-3) and np.allclose(model["thresholds"], whole["thresholds"], atol=1e-3)


def test_likelihood_against_loops_and_differences():
    """Three grades: the loss is that of the cumulative-link model, and its gradient its slope."""
    rng = np.random.default_rng(6)
    y, share = np.array([0, 1, 2, 1, 2, 0]), rng.random(6)
    doc, feature, value = np.repeat(np.arange(6), 3), rng.integers(0, 12, 18), rng.random(18)
    found = [(0, doc, feature, value)]
    x = np.zeros(quality.SIZE + 2)
    x[:12], x[quality.SIZE :] = rng.standard_normal(12), (-0.4, 0.2)
    got, g = quality.loss(x, found, y, share, 0.01)
    cut = quality.ordered(x)
    assert cut[0] < cut[1]
    over = lambda t, s: 1 / (1 + math.exp(t - s))
    expected = 0.005 * (x[:12] ** 2).sum()
    for i in range(6):
        s = sum(v * x[f] for d, f, v in zip(doc, feature, value, strict=True) if d == i)
        reach = [1.0, over(cut[0], s), over(cut[1], s), 0.0]
        expected -= share[i] * math.log(reach[y[i]] - reach[y[i] + 1])
    assert got == pytest.approx(expected)
    for at in (0, 3, 11, quality.SIZE, quality.SIZE + 1):
        up, down = x.copy(), x.copy()
        up[at], down[at] = x[at] + 1e-6, x[at] - 1e-6
        assert g[at] == pytest.approx((quality.loss(up, found, y, share, 0.01)[0] - quality.loss(down, found, y, share, 0.01)[0]) / 2e-6, abs=1e-7)


# --- the pipeline ---


def test_pipeline(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    names, rows = [n for n, _ in corpus_pipeline.STAGES], {}
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        rows[name] = now.collect()
        assert name == "sharding" or now.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in rows["quality"]]
    smallest = {c for _, c in brute_components(kept).values()}
    assert {r.doc_id for r in rows["near_duplicates"]} == smallest
    bench = [(str(r.item_id), ALNUM.findall(lower(r.text))) for r in read(spark, "benchmark").collect()]
    assert all(not brute_hits(ALNUM.findall(lower(r.text)), bench)[0] for r in rows["decontamination"])
    assert {r.doc_id for r in rows["mixing"]} <= {r.doc_id for r in rows["decontamination"]}
    assert len(rows["sharding"]) == len(rows["mixing"])
    assert all(r.shard == jump(r.doc_id, 40) for r in rows["sharding"])


def test_registered_queries():
    from cellmesh.llm import queries

    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
