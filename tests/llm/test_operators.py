"""Small fixtures against brute force: nulls, empty and repeated texts, ties, clashing column names, empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from strictasof.llm import (decontaminate, histogram_sort, lm_scoring, near_dedup, packing, quality_rules, recur,
                            substring_dedup, suffix_dedup, url_filter, warc)

DOCS = "doc_id long, text string, row_id string, spans int"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def with_noise(texts):
    return [(i, t, f"r{i}", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["é", "Ünder", "x y"]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    shared, longer = fresh(45), fresh(160)
    texts = [None, "", "  \n\t ", "one", " ".join(longer), " ".join(longer), " ".join(longer)]
    texts += ["\n".join(fresh(20) + shared + fresh(rng.randrange(30))) for _ in range(6)]
    texts += [" ".join(longer[:80] + ["changed"] + longer[80:]), " ".join(longer[10:70]), "  ".join(fresh(5) + longer[60:130])]
    texts += ["ha " * 90, "ha " * 40, " ".join(shared + shared), " ".join(fresh(2000) + shared)]
    texts += [" ".join(fresh(rng.randrange(1, 120))) for _ in range(25)]
    return texts


def brute_words(texts, n):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def brute_bytes(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = True
        out.append((len(d), int(gone.sum()), len(recur.runs_of(gone)), bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_substring_dedup_matches_brute_force(spark, corpus, crowd, shard):
    got = substring_dedup.removed_passages(frame(spark, with_noise(corpus)), length=35, shard_bytes=shard, crowd=crowd).collect()
    want = brute_words(corpus, 35)
    assert {r.row_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == {f"r{i}": w for i, w in enumerate(want)}
    assert sum(w[1] for w in want) > 500


@pytest.mark.parametrize("crowd", [2000, 1])
@pytest.mark.parametrize("judged", [1 << 18, 300])
def test_suffix_dedup_matches_brute_force(spark, corpus, crowd, judged):
    rows = frame(spark, with_noise(corpus))
    got = suffix_dedup.removed_bytes(rows, length=200, judged_bytes=judged, crowd=crowd).collect()
    want = brute_bytes(corpus, 200)
    assert {r.row_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == {f"r{i}": w for i, w in enumerate(want)}
    assert sum(w[1] for w in want) > 2000


def test_substring_operators_on_empty_and_repeated_rows(spark):
    empty = frame(spark, [])
    assert substring_dedup.removed_passages(empty).count() == suffix_dedup.removed_bytes(empty).count() == 0
    text = " ".join(f"a{i}" for i in range(50))
    same = [(1, text, None, None)] * 3 + [(None, None, None, None)] * 2
    assert sorted((r.n_removed, r.kept_text) for r in substring_dedup.removed_passages(frame(spark, same)).collect()) == [(0, "")] * 2 + [(50, "")] * 3


def test_suffix_order_and_merge():
    rng = np.random.default_rng(3)
    for size in (1, 9, 40, 500):
        text = rng.integers(97, 99, size).astype(np.uint8)
        data = text.tobytes()
        assert suffix_dedup.suffix_order(text, 64).tolist() == sorted(range(size), key=lambda i: (data[i:i + 64], i if len(data) - i >= 64 else -1 - i + size))\
            or [data[i:i + 64] for i in suffix_dedup.suffix_order(text, 64)] == sorted(data[i:i + 64] for i in range(size))
    shards = [(rng.integers(97, 99, 90).astype(np.uint8), np.arange(74)) for _ in range(3)]
    found = suffix_dedup.merged_repeats(shards, 16)
    seen = Counter(t[i:i + 16].tobytes() for t, starts in shards for i in starts)
    for (t, starts), again in zip(shards, found):
        assert again.tolist() == [seen[t[i:i + 16].tobytes()] > 1 for i in starts]


def test_anchors_agree_for_equal_windows():
    rng = np.random.default_rng(5)
    units = rng.integers(1, 4, 4000).astype(np.uint64)
    offsets = np.array([0, 10, 10, 1500, 4000])
    h, document, first, count = recur.anchors(units, offsets, 35, 12)
    windows = defaultdict(set)
    total = 0
    for x, d, a, n in zip(h.tolist(), document.tolist(), first.tolist(), count.tolist()):
        for s in range(a, a + n):
            at = offsets[d] + s
            windows[units[at:at + 35].tobytes()].add(x)
            total += 1
    assert total == 1500 - 10 - 34 + 2500 - 34 and all(len(v) == 1 for v in windows.values())
    chunk, recur.CHUNK = recur.CHUNK, 100
    try:
        again = recur.anchors(units, offsets, 35, 12)
        assert set(again[0].tolist()) == set(h.tolist()) and again[3].sum() == total
    finally:
        recur.CHUNK = chunk


def brute_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, distance):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[j] > label[i]:
                    label[j], changed = label[i], True
    return [min((ids[j] for j in range(len(fps)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("block", [4096, 2])
def test_near_dedup_matches_brute_force(spark, corpus, block):
    texts = corpus + [" ".join(f"t{i}" for i in range(200) if i != skip) for skip in range(0, 200, 9)]
    rows = [(i if i % 5 else None, t, f"r{i}", 0) for i, t in enumerate(texts)]
    got = {r.row_id: (r.fp & (1 << 64) - 1, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), block=block).collect()}
    fps = [brute_fingerprint(t, 4) for t in texts]
    want = brute_components(fps, [r[0] for r in rows], 4)
    assert got == {f"r{i}": (f, c) for i, (f, c) in enumerate(zip(fps, want))}
    kept = near_dedup.one_of_each(frame(spark, rows), block=block)
    assert kept.columns == ["doc_id", "text", "row_id", "spans"] and kept.count() == len(set(zip(want, [c is None and f for f, c in zip(fps, want)])))
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_verified_near_dedup_matches_brute_force(spark, corpus):
    rng = random.Random(3)
    base = [f"v{rng.randrange(5000)}" for _ in range(300)]
    changed = [" ".join("new" if rng.random() < share else w for w in base) for share in (0, .005, .01, .01, .02, .02, .03, .05, .1, .3)]
    texts = corpus + changed
    rows = [(i, t, f"r{i}", 0) for i, t in enumerate(texts)]
    bits = [near_dedup.sketch(t or "", 5, 42, True) for t in texts]
    apart = lambda x, y: (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()
    label = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(bits):
            for j, y in enumerate(bits):
                if apart(x[:8], y[:8]) <= 8 and apart(x, y) <= 29:
                    label[i] = label[j] = min(label[i], label[j])
    got = near_dedup.near_duplicates(frame(spark, rows), words=5, distance=8, verify=29)
    assert {r.row_id: r.component_id for r in got.collect()} == {f"r{i}": c for i, c in enumerate(label)}
    assert 1 < len({c for c in label[len(corpus):]}) < len(changed)
    kept = near_dedup.one_of_each(frame(spark, rows), words=5, distance=8, verify=29)
    assert {r.doc_id for r in kept.collect()} == set(label)


def shingle_set(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)} or ({b" ".join(w)} if w else set())


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def pair_at(name, shared, own):
    """Two texts of one head: 400 five-word shingles each at most, ``shared`` of them common, so J = shared / (shared + 2 own)."""
    head = [f"{name}h{i}" for i in range(shared + 4)]
    return [" ".join(head + [f"{name}{side}{i}" for i in range(own)]) for side in "xy"]


@pytest.mark.parametrize("together", [1 << 21, 700])
def test_similar_decides_by_jaccard(spark, corpus, together):
    at = {0.75: (300, 50), 0.79: (316, 42), 0.80: (320, 40), 0.85: (340, 30)}
    texts, pairs = list(corpus), defaultdict(list)
    for j, (shared, own) in at.items():
        for k in range(40):
            pairs[j].append(len(texts))
            texts += pair_at(f"j{int(j * 100)}k{k}", shared, own)
    rows = [(i, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id long")
    got = {r.row_id: r.component for r in near_dedup.similar(docs, 0.8, words=5, distance=11, together=together).collect()}
    linked = {j: sum(got[i] == got[i + 1] for i in found) for j, found in pairs.items()}
    assert jaccard(*map(shingle_set, texts[pairs[0.8][0]:pairs[0.8][0] + 2])) == 0.8
    assert linked[0.75] == linked[0.79] == 0 and linked[0.80] >= 36 and linked[0.85] >= 39
    sets = [shingle_set(t) for t in texts]
    small = range(len(corpus))  # a component is never more than the Jaccard links allow
    label = list(small)
    for _ in small:
        for i in small:
            for j in small:
                if jaccard(sets[i], sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    assert all(label[i] == label[j] for i in small for j in small if got[i] == got[j])
    assert all(got[i] == got[j] for i in small for j in small if sets[i] == sets[j])


def test_jaccard_links_connect_what_is_similar():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14))).astype(np.uint64) for _ in range(120)]
    label = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if jaccard(set(x.tolist()), set(y.tolist())) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    a, b = (np.array(c) for c in zip(*near_dedup.jaccard_links(sets, 0.8)))
    node, low = near_dedup._connect(a, b)
    got = dict(zip(node.tolist(), low.tolist()))
    assert [got.get(i, i) for i in range(len(sets))] == label and len(set(label)) < len(sets)


def test_pipeline_keeps_one_of_near_copies_at_the_limit(spark):
    texts = [t for k in range(30) for t in pair_at(f"p{k}", 320, 40) + pair_at(f"q{k}", 300, 50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert {i for i in range(len(texts)) if i % 4 != 1} <= kept and len([i for i in kept if i % 4 == 1]) <= 3
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_flips_meet_within_the_threshold():
    for width, e in ((6, 0), (6, 1), (6, 2), (7, 3), (7, 4)):
        index, probe = near_dedup._shared(e)
        held, tried = near_dedup._flips(width, 0, index), near_dedup._flips(width, index + 1, probe)
        for x in range(1 << width):
            meet = sum(int(a) == int(b) ^ x for a in held for b in np.concatenate([held, tried]))
            assert bool(meet) == (x.bit_count() <= e) or (meet and x.bit_count() <= index + probe)
            assert meet == near_dedup._meetings(width, x.bit_count(), index, probe)


def test_thresholds_cover_every_distance():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < 0.5
    together = bits.T.astype(int) @ bits.astype(int)
    for n in (10, 10_000, 10**8):
        chosen = near_dedup.allocate(n, together * (n // 500 or 1), 4)
        assert sum(e + 1 for _, e in chosen) >= 5 and len({b for g, _ in chosen for b in g}) == sum(len(g) for g, _ in chosen)


def test_histogram_shards(spark):
    rng = random.Random(1)
    rows = [(rng.choice([5, 5, 5, None, rng.randrange(-2**62, 2**62)]), rng.choice([1, 10, 300])) for _ in range(900)]
    df = frame(spark, [(k, s, "x") for k, s in rows], "key long, bytes long, shard string")
    from pyspark.sql import functions as F
    got = histogram_sort.histogram_shards(df, [F.col("key")], F.col("bytes"), 16, piece_bytes=500).collect()
    total = sum(s for _, s in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    assert len(got) == 900 and sorted(shards) == list(range(16))
    last = None
    for s in range(16):
        inside = sorted(shards[s], key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside)))
        keys = [-(1 << 63) if r.key is None else r.key for r in inside]
        assert keys == sorted(keys) and (last is None or last <= keys[0])
        last = keys[-1]
        assert abs(sum(r.bytes for r in inside) - total / 16) <= 600
    assert histogram_sort.histogram_shards(df.limit(0), [F.col("key")], F.col("bytes"), 16).count() == 0


def test_decontamination_small(spark):
    item = " ".join(f"b{i}" for i in range(14))
    items = frame(spark, [(1, item), (2, "Tiny item"), (3, None), (4, "..."), (None, item + " more")], "item_id long, text string")
    texts = [None, "", item.upper() + "!", "b0 b1 b2 b3 b4 b5 b6 b7 b8", "x " + " ".join(f"b{i}" for i in range(3, 13)) + " y",
             "a tiny, item; tiny item", item + " more"]
    got = {r.row_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in decontaminate.contamination(frame(spark, with_noise(texts)), items).collect()}
    assert got == {"r0": (0, 0, [], False), "r1": (0, 0, [], False), "r2": (14, 14, ["", "1"], True), "r3": (9, 0, [], False),
                   "r4": (12, 10, ["", "1"], True), "r5": (5, 4, ["2"], True), "r6": (15, 15, ["", "1"], True)}
    joined = decontaminate.contamination(frame(spark, with_noise(texts)), items, broadcast_bytes=0)
    assert {r.row_id: r.n_hit for r in joined.collect()} == {k: v[1] for k, v in got.items()}
    none = decontaminate.contamination(frame(spark, with_noise(texts)), items.limit(0))
    assert not none.where("contaminated").count() and none.count() == len(texts)


def test_decontamination_splits_each_text_once(spark):
    from pyspark.sql import functions as F
    texts = [None, "", "one", "A-Z É É İI K2 ẞ ß plain", "PLAIN ascii, \x7f text 09", "日本 Ǆ x\x00Y", "-lead and trail-", "Ünder É"]
    docs = frame(spark, with_noise(texts))
    for r in docs.select("text", decontaminate.words_of(F.col("text")).alias("w"), decontaminate.word_count(F.col("text")).alias("n")).collect():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        assert r.w == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) and r.n == len(r.w)
    items = frame(spark, [(1, " ".join(f"b{i}" for i in range(14)))], "item_id long, text string")
    plan = decontaminate.find_windows(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_url_cascade_is_exact(spark):
    keys = [(f"k{i}", i % 7 == 0) for i in range(3000)] + [("k0", False)]
    universe = frame(spark, keys, "key string, listed boolean")
    rows = frame(spark, [(k, 1) for k, _ in keys] + [(None, 2)], "key string, word int")
    for most in (1 << 20, 300):
        got = url_filter.with_listed(rows, universe, "key", most_bytes=most).collect()
        assert len(got) == len(keys) + 1
        assert {r.key: r.listed for r in got} == {k: int(k[1:]) % 7 == 0 for k, _ in keys} | {None: False}
    nothing = url_filter.with_listed(rows, universe.withColumn("listed", universe.listed & False), "key")
    assert nothing.where("listed").count() == 0
    assert url_filter.with_listed(rows.limit(0), universe.limit(0), "key").count() == 0


def test_url_rules(spark):
    urls = [None, "nonsense", "http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "http://x.net/fr/1", "http://x.org", "ftp://spam.org/a#b",
            "http://notexample.com/en/", "http://e.com"]
    rows = frame(spark, [(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in sorted(url_filter.judge_urls(rows).collect(), key=lambda r: r.page_id)]
    assert got == [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"),
                   ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/fr/1", "net/fr/", "block"), ("x.org", "", None, "allow"),
                   ("spam.org", "/a", None, "block"), ("notexample.com", "/en/", "com/", "allow"), ("e.com", "", None, "allow")]


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://h/{i}", rng.choice(["", "same", None, "é" * 3000 + str(i), str(rng.random()) * 50])) for i in range(120)]
    pages += [(7, "http://h/7", "twice"), (7, "http://h/7", "twice"), (None, None, "same"), (200, "u\r\nv", "WARC/1.1\r\n\r\n" * 9)]
    df = frame(spark, pages, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_roles(df.repartition(3)), f"file://{tmp_path}/a", archive_bytes=4000)
    assert archives.count() > 3
    want = []
    by_payload = defaultdict(list)
    for p, _, h in pages:
        by_payload[h or ""].append(p)
    for h, ids in by_payload.items():
        ids = sorted(ids, key=lambda p: (p is None, p or 0))
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want += [(p, len(h.encode()), digest, "revisit" if i else "response", ids[0] if i else None) for i, p in enumerate(ids)]
    order = lambda rows: sorted(rows, key=str)
    for size in (333, 5000, 1 << 20):
        records = warc.read_archives(archives, range_bytes=size, block_bytes=256)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(records).collect()]
        assert order(got) == order(want)
    texts = {bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert texts == {(h or "").encode() for _, _, h in pages}
    assert warc.read_archives(warc.write_archives(warc.with_roles(df.limit(0)), f"file://{tmp_path}/b")).count() == 0


def test_base_counts():
    text = "a b c a b c\n\n x\n x\nx #<é>"
    assert quality_rules.base_counts(text) == (10, 13, 3, 1, 6, 4)
    assert quality_rules.base_counts("") == (0, 0, 0, 0, 0, 0)


def test_binomial_tail_and_cutoff():
    from math import comb
    for k, n, p in ((0, 50, 0.01), (3, 40, 0.1), (40, 40, 0.5)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)))
    good, bad = np.zeros(65, int), np.zeros(65, int)
    good[0], good[2], bad[30], bad[1] = 2000, 5, 50, 3
    assert quality_rules.certified_cutoff(good, bad, 0.01, 0.001) == 30
    assert quality_rules.certified_cutoff(good // 100, bad, 0.01, 0.001) is None


def test_quality_rules_end_to_end(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(3000):
        kind = i % 6
        words = [rng.choice(plain) for _ in range(60)]
        if kind == 4:
            words[rng.randrange(60)] = rng.choice(["vile,", "awful"])
        if kind == 5:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en" if i % 50 else None))
        if i % 3 != 2 or i < 1500:
            labels.append((i, int(kind != 5), int(kind == 4)))
    rows += [(None, None, None), (9000, "", "xx"), (9000, "", "xx")]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    marks = frame(spark, labels + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, marks).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 9000}
    clean = [k for k in kept if k % 6 < 4]
    assert sum(kept[k] for k in clean) / len(clean) > 0.98
    assert not any(kept[k] for k in kept if k % 6 == 5)
    assert sum(kept[k] for k in kept if k % 6 == 4) < 0.1 * len(kept) / 6
    bare = quality_rules.judged(docs, marks.limit(0))
    assert {r.doc_id for r in bare.where("kept").collect()} == {r[0] for r in rows if r[1] and len(r[1].split()) >= 50}


def test_unlabelled_language_takes_the_shared_cutoffs(spark):
    rng = random.Random(8)
    text = lambda bad: " ".join(f"word{rng.randrange(3000)}" + "%%%" * bad for _ in range(60))
    rows = [(i, text(i % 6 == 5), "en" if i % 7 > 1 else None) for i in range(4200)]
    labels = frame(spark, [(r[0], int(r[0] % 6 != 5), 0) for r in rows], "doc_id long, quality int, toxic int")
    rows += [(5000 + i, text(i % 2 == 1), "xx") for i in range(20)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected_by for r in quality_rules.judged(docs, labels).where("lang = 'xx'").collect()}
    assert len(got) == 20 and all(bool(why) == (i % 2 == 1) for i, why in got.items())
    alone = quality_rules.judged(docs.where("lang is not null"), labels)  # no language shares a stratum
    assert {(r.lang, bool(r.rejected_by)) for r in alone.collect()} == {("en", True), ("en", False), ("xx", False)}


def test_lm_scores(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        side = "ab"[i % 2]
        rows.append((i, " ".join(f"{side.upper() if j == 0 else side}{rng.randrange(40) + (200 * (rng.random() < 0.03))}{side}" for j in range(30))))
    rows += [(1000, None), (1001, ""), (None, "A0a never"), (5, "a1a b1b")]
    docs = frame(spark, rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.scored(docs, block_bytes=3000).collect()}
    held = {r[0]: zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 5 == 1 for r in rows}
    tokens = [(r[0], (r[1] or "").lower().split() + [""]) for r in rows]
    counts = Counter(w for d, t in tokens if not held[d] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for d, t in tokens:
        r = got[d, len(t)]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert (r.held_out, r.n_known, r.train_tokens) == (held[d], sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    out = [r for r in got.values() if r.held_out and r.n_tokens == 31]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    one = lm_scoring.scored(docs, rounds=1, block_bytes=1 << 20).collect()
    assert sum(r.base_score for r in one) == pytest.approx(sum(r.base_score for r in got.values()))
    assert lm_scoring.scored(docs.limit(0)).count() == 0


def test_rare_words_are_in_classes_by_their_own_bigrams(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(lm_scoring, "FREQUENT", 3)  # the end, p and q; the others share an ending and their counts
    rng = random.Random(4)
    rows = []
    for i in range(40):
        a, b = rng.sample(range(20), 20), rng.sample(range(20), 20)
        rows.append((i, " ".join(f"p a{x}xyz q b{y}xyz" for x, y in zip(a, b))))
    rows += [(1000, "p a7xyz"), (1001, "p b7xyz"), (1002, "q b7xyz"), (1003, "q a7xyz")]
    docs = frame(spark, rows, "doc_id long, text string")
    held = F.col("doc_id") >= 1000
    got = {r.doc_id: r for r in lm_scoring.scored(docs, held, rounds=2).collect()}
    assert len({round(got[i].base_score, 9) for i in range(1000, 1004)}) == 1
    assert got[1000].score > got[1001].score + 1 and got[1002].score > got[1003].score + 1
    monkeypatch.setattr(lm_scoring, "TOKENS_PER_ROW", 700)  # several rows, those of p and q spread over all
    again = {r.doc_id: r for r in lm_scoring.scored(docs, held, rounds=2, block_bytes=2000).collect()}
    assert {i: r.n_known for i, r in again.items()} == {i: r.n_known for i, r in got.items()}
    assert again[1000].score > again[1001].score + 1 and again[1002].score > again[1003].score + 1


def test_packed_bigrams_come_back():
    pairs = np.array([3 << 32 | 5, 3 << 32 | 9, 70000 << 32, (2**31 - 1) << 32 | (2**31 - 1)])
    unit, other, n = lm_scoring.unpacked(lm_scoring.packed(pairs, np.array([1, 2, 1 << 40, 7])))
    assert (unit << 32 | other == pairs).all() and n.tolist() == [1, 2, 1 << 40, 7]
    assert [len(x) for x in lm_scoring.unpacked(None)] == [0, 0, 0]


def test_best_moves_raise_the_likelihood():
    rng = np.random.default_rng(2)
    units, classes = 12, 4
    pairs = rng.integers(0, 30, (units, units)) * (rng.random((units, units)) < 0.6)
    assigned = np.array([0] + [1 + i % 3 for i in range(units - 1)])

    def table_of(a):
        t = np.zeros((classes, classes))
        np.add.at(t, (a[:, None].repeat(units, 1), a[None, :].repeat(units, 0)), pairs)
        return t

    def likelihood(t):
        f = lm_scoring._xlogx
        return f(t).sum() - f(t.sum(0)).sum() - f(t.sum(1)).sum()

    u, v = np.nonzero(pairs)
    n = pairs[u, v]
    args = np.concatenate([u, v]), np.concatenate([v, u]), np.repeat([0, 1], len(u)), np.concatenate([n, n])
    moves = dict(lm_scoring.best_moves(*args, assigned, table_of(assigned), 0))
    for w in range(1, units):
        values = []
        for b in range(1, classes):
            moved = assigned.copy()
            moved[w] = b
            values.append(likelihood(table_of(moved)))
        best = 1 + int(np.argmax(values))
        assert moves.get(w, assigned[w]) == best or values[best - 1] == pytest.approx(values[moves.get(w, assigned[w]) - 1])


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_library(bpe):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(bpe)
    encode = packing.Encoder(bpe)
    rng = random.Random(9)
    parts = ["Hello", "it's", " ", "  ", "\n", "\t", " ", "é", "日本", "123", "don't!", "<|endoftext|>", "\x1c", "a b", "-", "'ll", "😀"]
    texts = ["", " ", " a", "a ", "a  b", "a   b", "a \n b", "x\n y", "　 　z"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert np.frombuffer(encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]


def test_packing(spark, corpus, bpe):
    texts = corpus + ["word " * 700, "many words " * 3000]
    docs = frame(spark, with_noise(texts))
    cut = packing.pieces(docs.repartition(3), bpe, capacity=256)
    rows = packing.pack(cut, capacity=256).collect()
    encode = packing.Encoder(bpe)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.row_id].append(r)
    for i, t in enumerate(texts):
        ids = np.append(np.frombuffer(encode(t or ""), "<u4"), 0).astype("<u4")
        mine = sorted(by_doc[f"r{i}"], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and mine[0].start == 0
        assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
        assert all(r.length == 256 for r in mine[1:]) and all(a.start + a.length == b.start for a, b in zip(mine, mine[1:]))
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in mine)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= -(-tokens // 256) + 2


def test_plan_uses_each_piece_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
        chosen = packing.plan(histogram, 64)
        used = Counter()
        for lengths, n in chosen:
            assert sum(lengths) <= 64 and n > 0
            for length in lengths:
                used[length] += n
        assert used == Counter(histogram)
        tokens = sum(k * v for k, v in histogram.items())
        assert sum(n for _, n in chosen) <= 1.25 * max(-(-tokens // 64), sum(v for k, v in histogram.items() if k > 32)) + 1
    assert packing.plan({}) == [] and packing.plan({2048: 3}) == [((2048,), 3)]
