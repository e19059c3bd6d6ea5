"""Divergence audit, compression bands and the Merkle manifest against brute force and over edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from cellmesh.llm import compression, divergence, merkle, queries

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(divergence.TERM)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- 11: divergence ---


def brute_audit(rows, least=3, top=200):
    """``rows``: (lang, source, text)."""
    rows = [(a or "", b or "", TERM.findall(lower(t))) for a, b, t in rows]
    docs, counts, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in rows:
        docs.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
        whole[lang].update(found)
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        gap = lambda a, b: (a - b) ** 2 // b
        p, q = share(own), share(whole[lang])
        found = [(-sum(gap(p[t], r[t]) for t in kept), other.encode()) for (x, other) in counts if x == lang and other != source for r in [share(counts[lang, other])]]
        out |= {(lang, source, "pair", name.decode(), -v, i) for i, (v, name) in enumerate(sorted(found), 1)}
        found = [(-gap(p[t], q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]]
        out |= {(lang, source, "term", name.decode(), -v, i) for i, (v, name) in enumerate(sorted(found)[:top], 1)}
    return out


def as_docs(spark, rows):
    full = [(i, t, lang, source, 0, "x") for i, (lang, source, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, rank int, term string")


@pytest.mark.parametrize("top", [2, 200])
def test_audit_against_brute_force(spark, top):
    r = random.Random(3)
    said = ["the", "The", "é", "É", "don't", "a1b", "ß", "x", "word", "rare", "日本"]
    rows = [(r.choice(["en", "fr", None, ""]), r.choice(["s", "t", None, "ü", "z"]), " ".join(r.choices(said, k=r.randint(0, 9)))) for _ in range(80)]
    rows += [("de", "only", "alone alone"), ("de", None, None), ("one", "s", "b b b"), ("one", "s", "b"), ("one", "s", "b"), ("en", "blank", ""), ("en", "blank", None)]
    got = [tuple(x) for x in divergence.audit(as_docs(spark, rows), top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, top=top)
    # a language without kept terms: pairs of value 0
    assert ("de", "only", "pair", "", 0, 1) in got


def test_counts_in_pieces(monkeypatch):
    """Small pieces and dictionaries give the counts of large ones; terms are not cut."""
    texts = ["Word word ÀÀ-ß a" * 20, None, "", "x" * 50 + " x", "word"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(["s"] * 5), pa.array(texts, pa.large_string())], ["lang", "source", "text"])
    found = []
    for held, piece in ((10**6, 10**6), (1, 3)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "PIECE", piece)
        total = defaultdict(lambda: [0, 0])
        for part in divergence.counted(iter([batch.slice(0, 2), batch.slice(2)])):
            for r in part.to_pylist():
                total[r["term"]][0] += r["n"]
                total[r["term"]][1] += r["docs"]
        found.append(dict(total))
    words = [TERM.findall(lower(t)) for t in texts]
    assert found[0] == found[1] == {t: [sum(w.count(t) for w in words), sum(t in w for w in words)] for w in words for t in w}


def test_audit_edges(spark, edges, nothing):
    assert divergence.audit(nothing).count() == 0
    rows = [(x.lang, x.source, x.text) for x in edges.collect()]
    assert {tuple(x) for x in divergence.audit(edges).collect()} == brute_audit(rows)


def test_shares_and_gaps_are_exact(spark):
    big = 10**15 + 7
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big), F.lit(10)).alias("p"), divergence.gap(F.lit(10**9), F.lit(1)).alias("g")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (3 * big + 10) and row.g == (10**9 - 1) ** 2


def test_common_terms_join_only_where_both_have_them(spark):
    """The postings' join makes a row for each two sources that share a term, and for no others."""
    rows = [("en", f"s{i}", f"own{'abcdefgh'[i]} shared") for i in range(8) for _ in range(3)]
    kept = divergence.postings(as_docs(spark, rows), 3)
    shared = kept.alias("a").join(kept.alias("b"), ["lang", "term"]).where("a.source < b.source")
    assert kept.count() == 16 and shared.count() == 8 * 7 // 2


# --- 12: compression ---


def brute_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)]


def brute_sides(text):
    data = (text or "").encode()
    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x) if x else 9.0
    band = lambda n: max(b for b in compression.BANDS if b[0] <= n)
    side = lambda x: -1 if size(x) < band(len(x))[1] else int(size(x) > band(len(x))[2])
    pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)] or [b""]
    if len(pieces) > 1 and len(pieces[-1]) < 4096:
        last = pieces.pop()
        pieces[-1] += last
    sides = [side(x) for x in pieces]
    return [len(data), side(data), len(pieces), sides.count(-1), sides.count(1)]


def check_judged(rows):
    for r in rows:
        assert [r[c] for c in compression.COUNTS] == brute_counts(r.text)
        n, whole, chunks, low, high = brute_sides(r.text)
        assert (r.n_bytes, r.whole_side, r.n_chunks, r.low_chunks, r.high_chunks) == (n, whole, chunks, low, high)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed
        assert r.kept == (not failed and whole == 0 and 4 * low <= chunks and 4 * high <= chunks)


def test_rules_against_brute_force(spark):
    r = random.Random(7)
    odd = ["a a a a a a", "A b c d e a b c d e", "x\n x\nx\n\n \n\t\nx", "é|ü <b> #1 *&%$", "one two\r\none two\r\n", "\x0b\x0c", "a b c", "\n".join(["l1 w"] * 3), "w " * 12]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = "".join(r.choices(letters, k=3000)) + " " + " ".join("".join(r.choices(letters, k=70)) for _ in range(60))
    prose = " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(4000))
    half = prose[:9000] + "spam and ham " * 1500
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame(list(enumerate([*odd, noise, prose, half, "ü" * 5000, None, ""], 10_000)), "doc_id bigint, text string")
    got = compression.judged(docs.unionByName(own)).collect()
    check_judged(got)
    by = {x.doc_id - 10_000 - len(odd): x for x in got}
    assert (by[0].verdict, by[1].verdict, by[2].verdict, by[3].verdict) == ("high", "ok", "low", "low")
    assert not by[4].kept and not by[5].kept and by[4].n_words == 0


def test_chunks_catch_what_the_whole_hides():
    """A long text whose second half repeats passes as a whole, not by chunks."""
    r = random.Random(1)
    prose = " ".join("".join(r.choices("etaoinshrdlucmfwyp", k=r.randint(2, 9))) for _ in range(8000))
    rules = compression.Rules()
    n, whole, side, chunks, low, high = rules.sizes((prose + "spam and ham " * 3000).encode())
    assert side == 0 and low > chunks / 4 and not high


def test_edges_of_bands():
    rules = compression.Rules(bands=((0, 0.0, 9.0), (100, 0.5, 0.9)))
    assert [rules.side(n, k) for n, k in ((99, 1), (100, 49), (100, 50), (100, 90), (100, 91))] == [0, -1, 0, 0, 1]
    text = b"0123456789abcdef" * 512
    assert [rules.sizes(text[:n])[3] for n in (0, 4095, 4096, 8191, 8192)] == [1, 1, 1, 1, 2]


def test_rules_of_a_long_text():
    text = ("word " * 200_000 + "end\n") * 2
    counts = compression.Rules().rows(pa.array([text, None]))
    assert counts[0][:5] == [400_002, 1_600_006, 0, 1, 400_002] and counts[1][:5] == [0] * 5


def test_rules_edges(spark, edges, nothing):
    check_judged(compression.judged(edges.withColumn("n_words", F.lit("mine"))).drop("n_words_in").collect())
    clashing = compression.judged(edges.withColumn("n_words", F.lit("mine"))).first()
    assert clashing.n_words_in == "mine"
    assert compression.judged(nothing).count() == 0
    kept = compression.select(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {4}
    assert kept.count() == 2


def test_clean_documents_stay(spark):
    """Of documents labelled good, hardly any that the base rules pass is lost; most of those that repeat themselves fall out by their ratios alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = compression.judged(docs.select("doc_id", "text")).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    repeats = [r for r in rows if r.n_words >= 50 and 2 * r.n_repeat_words > r.n_words]
    assert len(good) > 200 and all(r.kept for r in good)
    assert len(repeats) > 5 and sum(r.verdict == "low" for r in repeats) >= 0.9 * len(repeats)


# --- 13: Merkle ---


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(leaves, arity=2):
    """``(root, [siblings of each leaf])``."""
    proofs, nodes = [[] for _ in leaves], [(h, [i]) for i, h in enumerate(leaves)]
    while len(nodes) > 1:
        after = []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for j, (_, below) in enumerate(run):
                for i in below:
                    proofs[i] += [h for m, (h, _) in enumerate(run) if m != j]
            after.append((sha("".join(h for h, _ in run)), [i for _, below in run for i in below]))
        nodes = after
    return nodes[0][0], proofs


def brute_manifest(rows, arity=2):
    """``rows``: (key, group, leaf); returns sorted (key, group, leaf, position, subroot, root, siblings joined)."""
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((key is not None, key, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf for *_, leaf in sorted(groups[g])], arity) for g in names}
    root, above = brute_tree([trees[g][0] for g in names], arity)
    out = []
    for g, rest in zip(names, above, strict=True):
        for i, ((_, key, leaf), own) in enumerate(zip(sorted(groups[g]), trees[g][1], strict=True)):
            out.append((key, g, leaf, i, trees[g][0], root, "".join(own + rest)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("arity", "step"), [(2, 8), (2, 1), (2, 3), (3, 2)])
def test_manifest_against_brute_force(spark, monkeypatch, arity, step):
    monkeypatch.setattr(merkle, "ARITY", arity)
    monkeypatch.setattr(merkle, "STEP", step)
    sizes = {"en": 37, "fr": 1, None: 8, "": 2, "ü": 9, "z": 17}
    rows = [(i * 7 % 31 if i % 5 else None, g, sha(f"{g}{i % 13}"), "extra") for g, n in sizes.items() for i in range(n)]
    out = merkle.manifest(spark.createDataFrame(rows, "doc_id bigint, lang string, leaf string, path string").drop("path").withColumn("g", F.lit("mine")))
    got = out.withColumn("joined", merkle.proof(F.col("path"))).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r.folded == r.root and r.g == "mine" for r in got)
    assert sorted([(r.doc_id, r.lang, r.leaf, r.position, r.subroot, r.root, r.joined) for r in got], key=repr) == brute_manifest([r[:3] for r in rows], arity)


def test_manifest_of_one_row_and_of_none(spark):
    kind = "doc_id bigint, lang string, leaf string"
    row = merkle.manifest(spark.createDataFrame([(None, None, "ab")], kind)).first()
    assert (row.subroot, row.root, row.path, row.position) == ("ab", "ab", [], 0)
    assert merkle.manifest(spark.createDataFrame([], kind)).count() == 0
    two = merkle.manifest(spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], kind)).collect()
    assert {r.root for r in two} == {sha("xy")} and {merkle_side(r) for r in two} == {("x", "", "y"), ("y", "x", "")}


def merkle_side(r):
    return (r.leaf, r.path[0].left, r.path[0].right)


def test_leaves(spark, edges):
    rows = edges.select("*", merkle.leaf(*(F.col(c) for c in merkle.FIELDS)).alias("leaf")).collect()
    say = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    assert all(r.leaf == sha("".join(say(r[c]) for c in merkle.FIELDS)) for r in rows)
    # Fields do not run into each other.
    odd = spark.createDataFrame([("1:a", "b"), ("1", "a1:b"), ("-", None), (None, "-")], "x string, y string").select(merkle.leaf(F.col("x"), F.col("y")).alias("h"))
    assert odd.distinct().count() == 4


def test_tampered_rows_fold_elsewhere(spark):
    rows = queries.op13_merkle_manifest(spark, SF).collect()
    n_chars = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or n_chars[r.doc_id] is None)
    assert 0 < sum(not r.verified for r in rows) < len(rows)
