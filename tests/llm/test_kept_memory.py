"""What a Python worker keeps from one task to the next."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from strictasof.llm import near_dedup, packing, recur
from strictasof.llm.common import Rolling


class Frame:
    """Stands for a DataFrame: gives the work function of a task."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def test_powers_of_a_long_sequence_are_not_kept():
    rolling, units = Rolling(), np.random.default_rng(1).integers(0, 9, 700_000).astype(np.uint64)
    starts = np.arange(0, 699_000, 1000)
    whole = rolling.spans_of(units, 50)
    assert (rolling.spans(units, starts, starts + 50) == whole[starts]).all()
    assert (Rolling().spans_of(units[:5000], 50) == whole[:4951]).all()
    assert all(len(v) <= 1 << 19 for x in vars(rolling).values() for v in (x if isinstance(x, tuple) else (x,)))


def test_anchors_of_a_batch_are_sought_in_small_parts(monkeypatch):
    rolling = Rolling()
    monkeypatch.setattr(recur, "_ROLLING", rolling)
    texts = [" ".join(f"w{(i * 7919 + j) % 5003}" for j in range(100)) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], ["row_id", "text"])
    found = pa.Table.from_batches(recur._anchor_rows(Frame(), recur.WORDS, 35, 12)([batch]))
    alone = pa.Table.from_batches(recur._anchor_rows(Frame(), recur.WORDS, 35, 12)(batch.slice(i, 1) for i in range(3000, 3010)))
    mine = found.filter(pa.compute.is_in(found["row_id"], pa.array(range(3000, 3010), pa.int64())))
    assert mine.sort_by([("row_id", "ascending"), ("first", "ascending")]) == alone.sort_by([("row_id", "ascending"), ("first", "ascending")])
    assert sum(v.nbytes for x in vars(rolling).values() for v in (x if isinstance(x, tuple) else (x,))) <= 8 << 20


def test_encoder_remembers_short_chunks_once():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["ab" * 5000, "plain words, and \"more\" words (it's 'so) " + "xy" * 400, "日本" * 300 + " words. words", "a  b , words 's ''s"]
    for t in texts * 2:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert max(len(c) for known in (encode.words, encode.first, encode.later) for c in known) <= 64
    assert "words" in encode.later and " words" not in encode.words


def test_encoder_keeps_frequent_chunks_and_seeks_no_pattern_in_plain_words(monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    letters = "abcdefghijklmnopqrstuvwxyzñéüßÅ"
    texts = ["Often, " + " ".join(f"{a}{b}{c}" for b in letters) + " often said (so\"). Often\noften's" for a in letters[::6] for c in ("x", "ó.", "z,'")]
    spelled, sought, ids, pieces = Counter(), [], encode._ids, encode.pieces
    encode._ids = lambda w: spelled.update([w]) or ids(w)
    encode.pieces = lambda t: sought.append(t) or pieces(t)
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
        assert sum(len(k) + len(k.older) for k in (encode.words, encode.first, encode.later)) <= 2 * (40 + len(t))
    assert spelled["\u0120often"] == 1 and set(sought) == {" (so\").", " (", " Often\noften's"}


def test_probes_are_made_some_at_a_time():
    n = 6000
    fp = np.random.default_rng(2).integers(0, 1 << 62, n)
    batch = pa.RecordBatch.from_arrays([pa.array(fp)], ["fp"])
    chosen = [(list(range(24)), 4), (list(range(24, 64)), 1)]
    made = list(near_dedup.probes(Frame(), chosen, ["fp"])([batch]))
    assert max(b.num_rows for b in made) <= 1 << 18
    assert sum(b.num_rows for b in made) == n * (1 + 24 + 276 + 1 + 40)
