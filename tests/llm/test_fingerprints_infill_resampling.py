"""Fingerprints, infill and resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakescope.llm import byte_words, fingerprints, infill, resampling

TEXTS = st.text(st.sampled_from("aZé漢😀<>PSM0 \t\n-"), max_size=60)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- words -------------------------------------------------------------------
@settings(deadline=None, max_examples=200)
@given(TEXTS, st.integers(1, 9))
def test_words_in_pieces(text, piece):
    for table, pattern in ((byte_words.ALNUM_TABLE, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (byte_words.NONSPACE_TABLE, r"[^\x20\x09-\x0D]+")):
        got = [w for words in byte_words.word_lists(text.encode(), table, piece) for w in words]
        assert [w.decode() for w in got] == re.findall(pattern, fold(text))


# --- fingerprints --------------------------------------------------------------
def values(text, k=fingerprints.K):
    """All shingle hashes in Python integers."""
    words = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in re.findall(r"[^\x20\x09-\x0D]+", fold(text))]
    run, out = min(k, len(words)), set()
    for i in range(len(words) - run + 1) if words else ():
        halves = [0, 0]
        for w in words[i : i + run]:
            halves = [(h * b + w) % fingerprints.MODULUS for h, b in zip(halves, fingerprints.BASES, strict=True)]
        out.add((halves[0] << 31) | halves[1])
    return out


def plain_sketch(text):
    every = values(text)
    return sorted(v for v in every if v < fingerprints.LIMIT) or sorted(every)[:1]


def test_sketch_keeps_every_small_hash():
    rng = random.Random(1)
    for n in (0, 1, 3, 5, 6, 40, 700):
        text = " ".join(rng.choice(("the", "Of", "é", "w%d" % rng.randrange(90))) for _ in range(n))
        assert fingerprints.sketch(text.encode(), fingerprints.WordHashes()).tolist() == plain_sketch(text)


def test_small_cache_changes_nothing(monkeypatch):
    text = b" ".join(b"w%d" % i for i in range(300))
    whole = fingerprints.sketch(text, fingerprints.WordHashes()).tolist()
    monkeypatch.setattr(fingerprints, "CACHE", 3)
    assert fingerprints.sketch(text, fingerprints.WordHashes()).tolist() == whole


def test_merge_and_containment_of_unequal_groups(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    rows = [(1, "big", " ".join(long[:12_000])), (2, "big", " ".join(long[8_000:])), (3, "part", " ".join(long[3_000:5_000])), (4, "tiny", "one two three"), (5, "tiny", "one two"), (6, "none", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, g string, text string")
    sketched = fingerprints.sketches(docs).join(docs.select("doc_id", "g"), "doc_id")
    merged = fingerprints.merge(sketched, ["g"])
    got = {g: sorted(r["hash"] for r in merged.collect() if r["g"] == g) for g in ("big", "part", "tiny", "none")}
    every = {g: set().union(*[values(t) for _, h, t in rows if h == g]) for g in got}
    for g, hashes in got.items():
        assert hashes == (sorted(v for v in every[g] if v < fingerprints.LIMIT) or sorted(every[g])[:1])
    pairs = spark.createDataFrame([("part", "big"), ("big", "part"), ("tiny", "big")], "a_g string, b_g string")
    shares = {(r["a_g"], r["b_g"]): r["containment"] for r in fingerprints.group_containment(merged, pairs, ["g"]).collect()}
    assert shares["part", "big"] == 1 and shares["tiny", "big"] == 0
    assert shares["big", "part"] == pytest.approx(len(every["part"]) / len(every["big"]), abs=0.03)


def test_estimates_are_near_the_truth(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    off = []
    for r in fingerprints.with_neighbours(docs).withColumn("c", fingerprints.containment(F.col("hashes"), F.col("edited_hashes"))).collect():
        after = texts.get(r["doc_id"] - 1, texts[max(texts)])
        own, edited = values(texts[r["doc_id"]]), values(fingerprints.edit(texts[r["doc_id"]], after))
        assert r["edited_sha256"] == hashlib.sha256(fingerprints.edit(texts[r["doc_id"]], after).encode()).hexdigest()
        if len(own) >= 50:
            off.append(r["c"] - len(own & edited) / len(own))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.15


def test_neighbours_of_odd_ids(spark):
    rows = [(7, "seven a b c d e"), (None, "none one"), (3, None), (None, "none two"), (7, "other seven"), (9, ""), (1, "one"), (7, "seven a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprints.with_neighbours(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    ties = {t: docs.filter(F.coalesce("text", F.lit("")) == t).select(F.xxhash64(F.coalesce("text", F.lit("")))).first()[0] for t in {t or "" for _, t in rows}}
    order = sorted(((i is not None, i or 0, ties[t or ""], t or "") for i, t in rows), reverse=True)
    want = Counter()
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        edited = fingerprints.edit(here[3], after[3])
        want[(here[1] if here[0] else None, len(here[3]), hashlib.sha256(edited.encode()).hexdigest(), tuple(plain_sketch(here[3])), tuple(plain_sketch(edited)), tuple(plain_sketch(after[3])))] += 1
    assert Counter((r[0], r[1], r[2], *map(tuple, r[3:])) for r in got) == want


def test_only_document_follows_itself(spark):
    r = fingerprints.with_neighbours(spark.createDataFrame([(5, "ab cd ef")], "doc_id bigint, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"ab cab c").hexdigest() and r["hashes"] == r["next_hashes"]


# --- infill --------------------------------------------------------------------
@settings(deadline=None, max_examples=300)
@given(TEXTS, st.integers(0, 10**6))
def test_infill_forms_and_back(text, doc_id):
    n, form, prefix, middle, output = infill.transform(doc_id, text.encode())
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    assert n == len(text) and infill.restored(output, form).decode() == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        assert (form, prefix, middle, output.decode()) == ("plain", None, None, text)
        return
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    assert (form, prefix, middle) == ("spm" if h4 % 100 < 20 else "psm", a, b - a)
    assert output.decode() == (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [0, 1, 2, 7, 64, 1001])
def test_exchange_in_place(monkeypatch, size):
    monkeypatch.setattr(infill, "BLOCK", 16)
    data = bytes(random.Random(size).randrange(256) for _ in range(size))
    for m in {0, size // 3, size}:
        buffer = bytearray(data)
        infill.exchange(buffer, 0, m, size)
        assert buffer == data[m:] + data[:m]
    text = ("aé漢😀" * size)[:size]
    places = infill.byte_places(text.encode(), [0, size // 2, size])
    assert places == [len(text[:k].encode()) for k in (0, size // 2, size)] and infill.n_chars(text.encode()) == size


def test_infill_table(spark):
    long = "long é text " * 200_000
    rows = [(i, t) for i, t in enumerate(["", None, "a <S> b", "x", long, *[f"text {j} of its own" for j in range(200)]])] + [(None, "no id"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = infill.restore(infill.infill(docs)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t or "") for i, t in rows)
    forms = Counter(r["form"] for r in got)
    assert forms["psm"] > forms["spm"] > 0 and forms["plain"] > 3
    other = infill.Plan(b"[pre]", b"[suf]", b"[mid]", cut=100, suffix_first=100)
    again = infill.restore(infill.infill(docs, plan=other), other).collect()
    assert Counter((r["doc_id"], r["text"]) for r in again) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in again if r["text"]} == {"spm"}


# --- resampling ------------------------------------------------------------------
def plain_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) for r in runs)


@pytest.mark.parametrize("plan", [resampling.PLAN, resampling.Plan(n=3, buckets=257, least_words=5, percent=35, seed="x:")])
def test_resampling_against_a_plain_version(spark, sf, plan):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000, None), (10_001, ""), (None, "the " * 30), (10_002, "É " * 25)]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    s, t = Counter(), Counter()
    known = [(i, *plain_features(text, plan.n)) for i, text in docs]
    for _, _, found in known:
        for h, c in found.items():
            s[h % plan.buckets] += c
    for text in target:
        for h, c in plain_features(text, plan.n)[1].items():
            t[h % plan.buckets] += c
    total, wanted = s.total() + plan.buckets, t.total() + plan.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in range(plan.buckets)]
    rows = []
    for i, n_words, found in known:
        h = int(hashlib.sha256(f"{plan.seed}{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % plan.buckets] * c for x, c in found.items())
        rows.append((i, n_words, found.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= plan.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: plan.percent * len(able) // 100], 1)}
    got = resampling.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(x,) for x in target], "text string"), plan=plan)
    assert Counter(map(tuple, got.collect())) == Counter((*r, rank.get(id(r))) for r in rows)


def test_ranks_of_equal_scores(spark):
    rows = [(i, 30, 30, 5, 100 + i % 3) for i in range(1000)] + [(i, 3, 3, 5, 999) for i in range(50)]
    got = resampling.drawn(spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")).filter("rank IS NOT NULL").collect()
    want = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))[:100]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in want]
    assert sorted(r["rank"] for r in got) == list(range(1, 101))
