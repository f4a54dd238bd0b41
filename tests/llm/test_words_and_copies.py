"""Spelling variants, exact dedup and periodic runs against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strictasof.llm import exact_dedup, periodic_runs, spelling_variants

DOCS = "doc_id long, text string, row_id string, task int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(d, t, f"r{i}", i) for i, (d, t) in enumerate(zip(ids or range(len(texts)), texts))], DOCS)


@pytest.fixture()
def parquet(spark, tmp_path):
    """A folder with ``documents`` as the queries read them."""
    def write(texts, ids=None):
        frame(spark, texts, ids).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)
    return write


# ---- exact dedup ----------------------------------------------------------------------------------------------------

def ascii_lower(text):
    return (text or "").encode().lower()


def groups_of(texts, ids):
    members = defaultdict(list)
    for row, (d, t) in enumerate(zip(ids, texts)):
        members[ascii_lower(t)].append((d is not None, d if d is not None else 0, -row))
    out = {}
    for t, found in members.items():
        top = max(found)
        for known, d, row in found:
            out[f"r{-row}"] = (len(found), top[1] if top[0] else None, (known, d, row) == top)
    return out


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    texts = [None, "", "", " ", "A", "a", "É", "é", "ẞ", "ß", "İ", "x" * 400_000, "X" * 400_000, "x" * 399_999 + "y"]
    texts += ["Hot Text " * 20 if rng.random() < 0.4 else f"text {rng.randrange(60)}" for _ in range(400)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = ids[20] = None
    ids[30] = ids[31] = ids[32] = 10_000  # equal ids, some with equal texts
    texts[30] = texts[31] = "same id, same text"
    return texts, ids


def short(text):
    return hashlib.sha256(text).digest()[:1]


@pytest.mark.parametrize("options", [
    {}, {"digest": short}, {"owned": 50, "sent": 64}, {"spare_bits": 1, "owned": 100}, {"digest": lambda t: b"", "sent": 7}])
def test_exact_groups(spark, copies, options):
    texts, ids = copies
    got = exact_dedup.exact_groups(frame(spark, texts, ids).repartition(5), **options)
    assert got.columns[:4] == ["doc_id", "text", "row_id", "task"]
    rows = got.collect()
    assert len(rows) == len(texts)
    want = groups_of(texts, ids)
    for r in rows:
        size, keep, kept = want[r.row_id]
        assert (r.group_size, r.keep, r.text) == (size, keep, texts[int(r.row_id[1:])])
        assert r.task == int(r.row_id[1:])
    stays = Counter(ascii_lower(r.text) for r in rows if r.kept)
    assert stays == Counter(set(map(ascii_lower, texts)))  # one row of each text
    assert {r.row_id for r in rows if r.kept} - {"r30", "r31"} == {k for k, w in want.items() if w[2]} - {"r30", "r31"}


def test_exact_groups_of_an_empty_table_and_other_columns(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    named = frame(spark, ["a", "A", "b"]).selectExpr("doc_id as keep", "text as digest", "doc_id as words", "text as text", "doc_id as id")
    got = {r.id: (r.group_size, r.keep, r.kept, r.words) for r in exact_dedup.exact_groups(named, prefer="id").collect()}
    assert got == {0: (2, 1, False, 0), 1: (2, 1, True, 1), 2: (1, 2, True, 2)}


def test_golomb_round_trip():
    rng = np.random.default_rng(5)
    for n, low, high in ((0, 0, 8), (1, 0, 1), (1, 7, 9), (8, 0, 8), (300, 1 << 40, (1 << 40) + (1 << 20)), (5000, 0, 1 << 50)):
        values = np.sort(rng.choice(min(high - low, 1 << 40), n, replace=False) if high - low < 1 << 21 else np.unique(rng.integers(0, high - low, n))) + low
        code = exact_dedup.golomb(values.astype(np.int64), low, high)
        assert exact_dedup.golomb_values(code, low).tolist() == values.tolist()
    values = np.sort(rng.choice(1 << 20, 1 << 10, replace=False))
    assert len(exact_dedup.golomb(values, 0, 1 << 20)) < 12.5 * (1 << 10) / 8 + 32


# ---- periodic runs --------------------------------------------------------------------------------------------------

def brute_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, exponent * q):
                stretch = words[start:start + length]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    out.append((start, length, q))
            i += 1
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def periodic():
    rng = random.Random(11)
    texts = [None, "", " \n", "one", "ha " * 90, "ha  ha\tha\nha\x0bha\rha", "a\x1cb " * 8, "ab ab ab ab ab", "é Ü " * 5]
    for letters in (1, 2, 3, 5):
        texts += [" ".join(rng.choice("abcdefg"[:letters]) for _ in range(rng.randrange(1, 90))) for _ in range(25)]
    for _ in range(20):
        block = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))]
        texts.append(" ".join([f"u{i}" for i in range(rng.randrange(9))] + block * rng.randrange(3, 9) + block[:1] + ["end"] * rng.randrange(8)))
    nested = " ".join(["a b a b a b a b c"] * 6)
    return texts + [nested, nested, "z " + nested + " z"]


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 3), (2, 2), (8, 2)])
def test_periodic_runs(spark, periodic, least, exponent):
    docs = frame(spark, periodic).withColumnRenamed("task", "runs").repartition(3)
    rows = periodic_runs.with_periodic_runs(docs, least=least, exponent=exponent).collect()
    assert len(rows) == len(periodic)
    for r in rows:
        words = [w.decode() for w in (periodic[r.doc_id] or "").encode().split()]
        runs = brute_runs(words, least, exponent)
        assert [tuple(x) for x in r.runs] == runs
        assert (r.n_words, r.collapsed, r.row_id) == (len(words), collapsed(words, runs), f"r{r.doc_id}")


def test_lyndon_lengths():
    rng = random.Random(2)
    for _ in range(300):
        strings = [[rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        codes = [c for s in strings for c in [*s, -1]]
        want = []
        for s in strings:
            for i in range(len(s)):
                j = i + 1
                while j < len(s) and s[j:] > s[i:]:
                    j += 1
                want.append(j - i)
            want.append(0)
        assert periodic_runs.lyndon_lengths(np.array(codes)).tolist() == want


def test_a_very_long_text_of_runs(spark):
    words = ([f"w{i % 1000}" for i in range(60_000)] + ["x"] * 50_000 + [f"v{i}" for i in range(50_000)])
    (r,) = periodic_runs.with_periodic_runs(frame(spark, [" ".join(words)])).collect()
    assert [tuple(x) for x in r.runs] == [(0, 60_000, 1000), (60_000, 50_000, 1)]
    assert r.collapsed == " ".join(words[:1000] + ["x"] + words[110_000:])


def test_op13_on_whole_documents(spark, periodic, parquet):
    ids = [i * 7 for i in range(len(periodic))]
    ids[3] = None
    rows = periodic_runs.op13_periodic_runs(spark, parquet(periodic, ids)).collect()
    assert len(rows) == len(periodic)
    changed, want = 0, {}
    for d, t in zip(ids, periodic):
        words = [w.decode() for w in (t or "").encode().split()]
        tail = periodic_runs.repeated_tail(d, words)
        changed += tail != words
        runs = brute_runs(tail)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        shown = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[d] = (len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(tail, runs).encode()).hexdigest())
    assert changed > 3
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows} == want


def test_no_documents_no_runs(spark):
    assert periodic_runs.with_periodic_runs(frame(spark, [])).count() == 0


# ---- spelling variants ----------------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, times=10):
    forms, out = {}, {}
    for w in counts:
        near = [v for v in counts if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= times * counts[w] else None
        forms[w], out[w] = form, (form, counts[w], len(near), counts[form] if form else None)
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


@pytest.mark.parametrize("symbols, asked", [(200_000, 50_000), (300, 9), (1, 1000)])
@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_variant_groups(spark, symbols, asked, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 10))) for _ in range(150)}
    words |= {"aaaa" + w for w in list(words)[:40]}  # a hot first half
    words.add("ab" * 700)
    words.add("ab" * 350 + "b" * 700)
    counts = {w: rng.choice((1, 2, 3, 30, 35, 400, 400, 5000)) for w in sorted(words)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = spelling_variants.variant_groups(rows, symbols=symbols, asked=asked).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(counts)
    assert len(got) == len(counts)


def test_near_words_says_each_pair_once(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=1 + i % 8)) for i in range(200)})
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = Counter((r.word, r.near, r.near_n) for r in spelling_variants.near_words(rows, symbols=60, asked=5).collect())
    assert got == Counter((a, b, words.index(b)) for a in words for b in words if a != b and one_edit(a, b))


def test_no_words(spark):
    assert spelling_variants.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling_variants.vocabulary(frame(spark, [None, "", "short words only", "1234567 89"])).count() == 0


def test_alphabets_beyond_a_byte(spark):
    words = ["".join(chr(0x4e00 + (i * 37 + k) % 900) for k in range(4)) for i in range(400)]
    counts = {w: 1 + i for i, w in enumerate(dict.fromkeys(words))}
    got = spelling_variants.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"), times=2).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(counts, 2)


def test_op11_on_whole_documents(spark, parquet):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcÀéÿz") for _ in range(rng.randrange(6, 11))) for _ in range(40)]
    texts = [None, "", "7"] + [" ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randrange(300)))
                               + ("," + pool[0] + "×" + pool[1] + "3") for _ in range(60)]
    texts += [texts[-1], "x" + "ab" * 50_000 + " " + "ab" * 50_000 + " " + "ab" * 50_000, "ab" * 50_000]
    ids = [*range(len(texts) - 1), None]
    counts = Counter()
    import re
    for d, t in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.encode().lower().decode()
            counts[spelling_variants.slip(d, run)] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = spelling_variants.op11_spelling_variants(spark, parquet(texts, ids)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(counts)
    assert any(r.form for r in got) and max(len(r.word) for r in got) > 90_000


def test_lowered_touches_ascii_only():
    assert exact_dedup.lowered(pa.array(["AZ-É-İ"])).to_pylist() == ["az-É-İ"]
