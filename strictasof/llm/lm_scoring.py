"""Language-model scores from Brown classes.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class). Classes come from exchange
clustering: a word moves to the class in which the likelihood of the class bigrams rises most, with the counts of all
training bigrams. Every word of the training documents is a unit of its own and moves by its own bigrams, however rare; the
number of classes follows the vocabulary, and rounds go on until the likelihood no longer rises. A word that training never
saw takes the class that most training words of its ending are in. Emission probabilities use the exact training count of
every word.

Words and bigrams are counted per block of documents and then over the corpus; the counts come back to the blocks that have
the word. Bigrams lie in packed rows by their unit, those of the ``FREQUENT`` most frequent words also by the other word, so
no word's bigrams meet in one task. What tasks and driver hold of all words is the class of each, two bytes a word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import SHUFFLE_CLEANUP
from .common import release, stage
from .registry import query

#: words whose bigrams are spread over several rows; units of the endings of unseen words; least classes
FREQUENT, ENDINGS, CLASSES = 2048, 1024, 64
#: a round that raises the likelihood by less than this share is the last
LEAST_GAIN = 1e-4
#: bytes at the end of a word that choose its ending
ENDING_BYTES = 3
#: bytes of text in one block
BLOCK_BYTES = 16 << 20
#: added to every count of a transition
ADDED = 0.5
#: what ends a text; no word can be empty
END = b""
#: training tokens for each row of bigrams, about
TOKENS_PER_ROW = 2 << 20
#: parts of the units that move in turn; words numbered together
TURNS, NUMBERED = 4, 1 << 18
#: units and bigrams looked at together; counts whose effect on the likelihood is worked out once
UNITS_AT_ONCE, BIGRAMS_AT_ONCE, SMALL = 4096, 1 << 16, 16


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, then the end token."""
    return (text or "").encode().lower().split() + [END]


def held_out(doc_id: Column) -> Column:
    """Documents that training leaves out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Bigrams as bytes: ``pairs`` are (unit << 32 | other) in order, ``times`` their counts."""
    first = (pairs >> 32).astype(np.int32)
    parts = np.diff(first, prepend=np.int32(0)), (pairs & 0xFFFFFFFF).astype(np.int32), times.astype(np.int64)
    return len(pairs).to_bytes(8, "little") + pa.compress(b"".join(x.tobytes() for x in parts), codec="zstd", asbytes=True)


def unpacked(row: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, other, n) of :func:`packed` bigrams; none for a null."""
    n = int.from_bytes(row[:8], "little") if row else 0
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = pa.decompress(memoryview(row)[8:], 16 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int32, n), dtype=np.int64), np.frombuffer(raw, np.int32, n, 4 * n), np.frombuffer(raw, np.int64, n, 8 * n)


def _counted(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams in order, each once, with the sum of its counts."""
    place = np.argsort(pairs)
    pairs, times = pairs[place], times[place]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], (np.add.reduceat(times, first) if len(first) else times)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Staged rows of three kinds. 'doc': a document's tokens as numbers of its block's words. 'word': a word of a block
    with its number, its ending and its count in the block's training documents. 'pair': the block's training bigrams."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, block long, doc_id {id_type}, held boolean, ids binary, local int, word binary, ending int, n long"

    def work(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        names = [f.split()[0] for f in schema.split(", ")]
        known: dict[bytes, int] = {}
        counts, size, trained = np.zeros(0, np.int64), 0, []

        def block_rows(block):
            words = list(known)
            n = len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array(["word"] * n), pa.array(np.full(n, block)), pa.nulls(n, id_arrow), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
                pa.array(np.arange(n, dtype=np.int32)), pa.array(words, pa.binary()), pa.array([ending(w) for w in words], pa.int32()),
                pa.array(counts)], names)
            if trained:  # a text begins after an end token, and that is how the text before it ends
                tokens = np.concatenate([[known[END]], *trained]).astype(np.int64)
                pairs, times = np.unique(tokens[:-1] << 32 | tokens[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(["pair"]), pa.array([block]), pa.nulls(1, id_arrow), pa.nulls(1, pa.bool_()), pa.array([packed(pairs, times)], pa.binary()),
                    pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], names)

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            first, ids_out = 0, []
            for i, (text, held) in enumerate(zip(batch.column("text").to_pylist(), batch.column("held").to_pylist())):
                ids = np.fromiter([known.setdefault(w, len(known)) for w in words_of(text)], np.int32)
                if len(known) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(known) - len(counts), len(counts), 1024), np.int64)])
                if not held:
                    np.add.at(counts, ids, 1)
                    trained.append(ids)
                ids_out.append(ids.tobytes())
                size += len(text or "") + 1
                last = i + 1 == batch.num_rows
                if size >= block_bytes or last:
                    n = i + 1 - first
                    part = batch.slice(first, n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(["doc"] * n), pa.array(np.full(n, base + number)), part.column("doc_id"), part.column("held"),
                        pa.array(ids_out, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.int64())], names)
                    first, ids_out = i + 1, []
                if size >= block_bytes:
                    counts = counts[:len(known)]
                    yield from block_rows(base + number)
                    known, counts, size, number, trained = {}, np.zeros(0, np.int64), 0, number + 1, []
        if known:
            counts = counts[:len(known)]
            yield from block_rows(base + number)

    return stage(docs.select("doc_id", "held", "text").mapInArrow(work, schema), "blocks", partition_by="kind")


def classes_for(words: int) -> int:
    """How many classes a vocabulary gets: its size to the power 0.3, and no fewer than ``CLASSES``."""
    return max(CLASSES, round(words ** 0.3))


def _bigrams(blocks: DataFrame, lookups: DataFrame, words: int, tokens: int) -> tuple[DataFrame, bool]:
    """Staged rows of packed training bigrams by the turn of their unit, and whether frequent units are in several rows.

    ``after`` has the bigrams that the units begin, ``before`` those that they end, the other word in second place.
    """
    rows = -(-tokens // TOKENS_PER_ROW)
    width = max(1, -(-max(0, words - FREQUENT) // max(1, rows)))  # units that share rows
    spread = max(1, rows)  # rows of a frequent unit
    schema = "row long, after binary, before binary"

    def dealt(pairs, times):
        """Bigrams in order of their unit, by row."""
        frequent = int(np.searchsorted(pairs, FREQUENT << 32))
        found = {}
        of = (pairs[:frequent] & 0xFFFFFFFF) % spread
        place = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[place], np.arange(spread + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = place[cuts[k]:cuts[k + 1]]
            found[-1 - k] = packed(pairs[part], times[part])
        of = ((pairs[frequent:] >> 32) - FREQUENT) // width
        cuts = frequent + np.concatenate([np.flatnonzero(np.diff(of, prepend=-1)), [len(of)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            found[int(of[lo - frequent])] = packed(pairs[lo:hi], times[lo:hi])
        return found

    def numbered(_, pairs, found):
        first, second, times = unpacked(pairs.column("ids")[0].as_py() if pairs.num_rows else None)
        if not len(first):
            return pa.table({"row": pa.array([], pa.int64()), "after": pa.array([], pa.binary()), "before": pa.array([], pa.binary())})
        unit = np.frombuffer(found.column("unit")[0].as_py(), np.int64)
        u, v = unit[first], unit[second]
        after, before = dealt(*_counted(u << 32 | v, times)), dealt(*_counted(v << 32 | u, times))
        keys = sorted({*after, *before})
        return pa.table({"row": pa.array(keys, pa.int64()), "after": pa.array([after.get(k) for k in keys], pa.binary()),
                         "before": pa.array([before.get(k) for k in keys], pa.binary())})

    def merged(key, table):
        sides = []
        for column in ("after", "before"):
            found = [unpacked(x.as_py()) for x in table.column(column)]
            u, v, n = (np.concatenate([f[i] for f in found]) for i in range(3))
            sides.append(_counted(u.astype(np.int64) << 32 | v.astype(np.int64), n))
        out = []
        for turn in range(TURNS):
            mine = [(pairs[use], times[use]) for pairs, times in sides for use in [(pairs >> 32) % TURNS == turn]]
            if any(len(pairs) for pairs, _ in mine):
                out.append((turn, key[0].as_py() < 0, *[packed(*x) for x in mine]))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                        names=["turn", "frequent", "after", "before"])

    pairs = blocks.where("kind = 'pair'").select("block", "ids")
    dealt_out = pairs.groupBy("block").cogroup(lookups.select("block", "unit").groupBy("block")).applyInArrow(numbered, schema)
    rows_of = dealt_out.groupBy("row").applyInArrow(merged, "turn int, frequent boolean, after binary, before binary")
    files = min(2 * spread, 4 * blocks.sparkSession.sparkContext.defaultParallelism)  # every pass reads them, all tasks at once
    return stage(rows_of.repartition(files), "bigrams", partition_by="turn"), spread > 1


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def prices(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What 1 to ``SMALL`` counts add to the likelihood, by class of the neighbour and class of the unit, on either side."""
    added = np.arange(1, SMALL + 1, dtype=float)[:, None, None]
    return _xlogx(table.T + added) - _xlogx(table.T), _xlogx(table + added) - _xlogx(table)


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the true cells; faster than ``nonzero`` over two axes."""
    at = np.flatnonzero(hit.ravel())
    of = at // hit.shape[1]
    return of, at - of * hit.shape[1]


def _added(value: np.ndarray, x: np.ndarray, few: np.ndarray, of: np.ndarray, near: np.ndarray, cells: np.ndarray, price: np.ndarray) -> None:
    """Add what the counts ``x`` at (``of``, ``near``) would add to the cells of each class; ``few``: the counts up to ``SMALL`` + 1."""
    n = few[of, near]
    numbers = np.bincount(n, minlength=SMALL + 2)
    for k in range(1, SMALL + 1):
        if numbers[k] * 8 > len(value):
            value += (few == k).astype(float) @ price[k - 1]
        elif numbers[k]:
            use = n == k
            np.add.at(value, of[use], price[k - 1][near[use]])
    if numbers[SMALL + 1]:
        use = n > SMALL
        of, near = of[use], near[use]
        for lo in range(0, len(of), 1 << 14):
            some, at = of[lo:lo + (1 << 14)], near[lo:lo + (1 << 14)]
            more = _xlogx(cells[at] + x[some, at][:, None]) - _xlogx(cells)[at]
            first = np.flatnonzero(np.diff(some, prepend=-1))
            value[some[first]] += np.add.reduceat(more, first, axis=0)


def _chosen(around: np.ndarray, loops: np.ndarray, own: np.ndarray, table: np.ndarray, price: tuple, barred: int) -> tuple[np.ndarray, np.ndarray]:
    """The best class of each unit, and whether it is better than its ``own``.

    ``around[i, 0]`` has the counts of the classes after unit i, ``around[i, 1]`` of those before it; ``loops`` of itself.
    Values are those of the unit in a class over the unit nowhere; only cells that its neighbours touch are looked at.
    """
    units, _, size = around.shape
    each = np.arange(units)
    out, into = around[:, 0], around[:, 1]
    value, stay = np.zeros((units, size)), np.zeros(units)
    for x, cells, priced, total in ((out, table.T, price[0], table.sum(axis=1)), (into, table, price[1], table.sum(axis=0))):
        cells = np.ascontiguousarray(cells)
        few = np.minimum(x, SMALL + 1).astype(np.uint8)
        few[each, own] = 0  # neighbours of the unit's own class come below
        of, near = _places(few > 0)
        _added(value, x, few, of, near, cells, priced)
        cell = cells[near, own[of]]
        stay += np.bincount(of, _xlogx(cells)[near, own[of]] - _xlogx(cell - x[of, near]), minlength=units)
        sums, place = np.unique(x.sum(axis=1) + loops, return_inverse=True)
        value -= (_xlogx(total + sums[:, None]) - _xlogx(total))[place]
        stay -= _xlogx(total[own]) - _xlogx(total[own] - sums[place])
    for x, other, cells in ((out, into, table.T), (into, out, table)):
        some = np.flatnonzero(x[each, own])
        rest = cells[own[some]] - other[some]
        value[some] += _xlogx(rest + x[some, own[some]][:, None]) - _xlogx(rest)
    both = (out > 0) & (into > 0)
    both[loops > 0] = True
    of, at = _places(both)
    corner, o, i, l = table[at, at], out[of, at], into[of, at], loops[of]
    value[of, at] += _xlogx(corner + o + i + l) - _xlogx(corner + o) - _xlogx(corner + i) + _xlogx(corner)
    corner = table[own, own]
    stay += _xlogx(corner) - _xlogx(corner - out[each, own] - into[each, own] - loops)
    value[:, barred] = -np.inf
    value[each, own] = stay
    best = value.argmax(axis=1)
    return best, value[each, best] > stay + 1e-6


def neighbours(unit: np.ndarray, other: np.ndarray, side: np.ndarray, n: np.ndarray, classes: np.ndarray, size: int):
    """Yields (units, counts by side and class, loops) of bigrams in order of their unit, some units of like size at a time."""
    starts = np.flatnonzero(np.diff(unit, prepend=-1))
    sizes = np.diff(starts, append=len(unit))
    place = np.argsort(sizes, kind="stable")
    starts, sizes = starts[place], sizes[place]
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(starts):
        begun = ends[lo] - sizes[lo]
        hi = max(lo + 1, min(lo + UNITS_AT_ONCE, int(np.searchsorted(ends, begun + BIGRAMS_AT_ONCE, "right"))))
        part = np.arange(begun, ends[hi - 1]) + np.repeat(starts[lo:hi] - ends[lo:hi] + sizes[lo:hi], sizes[lo:hi])
        index = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        units, near, times, of = unit[starts[lo:hi]], other[part], n[part], side[part]
        self = units[index] == near
        flat = (index * 2 + of) * size + classes[near]
        around = np.bincount(flat, np.where(self, 0, times), minlength=(hi - lo) * 2 * size).reshape(hi - lo, 2, size)
        yield units, around, np.bincount(index, times * (self & (of == 0)), minlength=hi - lo)
        lo = hi


def best_moves(unit: np.ndarray, other: np.ndarray, side: np.ndarray, n: np.ndarray, classes: np.ndarray, table: np.ndarray,
               fixed: int, price: tuple | None = None) -> list[tuple[int, int]]:
    """(unit, class) for the units whose move to that class raises the likelihood of the class bigrams most.

    ``table`` counts class bigrams under ``classes``; all units but the one looked at stay where they are.
    """
    place = np.argsort(unit, kind="stable")
    price, moves = price or prices(table), []
    for units, around, loops in neighbours(unit[place], other[place], side[place], n[place], classes, len(table)):
        best, better = _chosen(around, loops, classes[units].astype(np.int64), table, price, int(classes[fixed]))
        better &= units != fixed
        moves += zip(units[better].tolist(), best[better].tolist())
    return moves


def _sides(after: bytes | None, before: bytes | None) -> tuple[np.ndarray, ...]:
    """(unit, other, side, n) of a row of bigrams, in order of the unit."""
    after, before = unpacked(after), unpacked(before)
    unit, other, n = (np.concatenate([a, b]) for a, b in zip(after, before))
    place = np.argsort(unit, kind="stable")
    side = np.repeat([0, 1], [len(after[0]), len(before[0])])
    return unit[place], other[place], side[place], n[place]


def exchange(bigrams: DataFrame, units: int, fixed: int, classes: int, rounds: int | None = None,
             spread: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The class of every unit and the counts of class bigrams. The ``fixed`` unit keeps class 0 to itself.

    A round lets each quarter of the units move in turn, so moves of one step meet few others. Rounds end when one no
    longer raises the likelihood, or after ``rounds``. With ``spread``, the bigrams of a frequent unit are in several rows:
    their sums by class meet before it moves. What reaches the driver is the class table and the moves.
    """
    context = bigrams.sparkSession.sparkContext
    assigned = (1 + np.arange(units) % (classes - 1)).astype(np.uint16)
    assigned[fixed] = 0

    def moved(units, into):
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(x, t).tobytes()], pa.binary()) for x, t in ((units, np.int32), (into, np.uint16))],
                                          ["unit", "into"])

    def table_of(current) -> np.ndarray:
        def work(batches):
            table = np.zeros(classes * classes)
            for batch in batches:
                for row in batch.column("after"):
                    unit, other, n = unpacked(row.as_py())
                    table += np.bincount(current.value[unit].astype(np.int64) * classes + current.value[other], n, minlength=classes * classes)
            cells = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells].astype(np.int64))], ["cell", "n"])

        table = np.zeros(classes * classes)
        for r in bigrams.select("after").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            table[r.cell] = r.n
        return table.reshape(classes, classes)

    def likelihood(table: np.ndarray) -> float:
        return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())

    def whole_units(current, table):
        def work(batches):
            price = prices(table)
            for batch in batches:
                for after, before in zip(batch.column("after"), batch.column("before")):
                    moves = best_moves(*_sides(after.as_py(), before.as_py()), current.value, table, fixed, price)
                    if moves:
                        yield moved(*zip(*moves))
        return work

    def sums_of_parts(current):
        def work(batches):
            for batch in batches:
                for after, before in zip(batch.column("after"), batch.column("before")):
                    for units, around, loops in neighbours(*_sides(after.as_py(), before.as_py()), current.value, classes):
                        sums = np.concatenate([around.reshape(len(units), -1), loops[:, None]], axis=1).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], ["unit", "sums"])
        return work

    def met(current, table):
        def work(_, parts):
            units, place = np.unique(parts.column("unit").to_numpy(), return_inverse=True)
            sums = np.zeros((len(units), 2 * classes + 1))
            for at, row in zip(place.tolist(), parts.column("sums")):
                sums[at] += np.frombuffer(row.as_py(), np.int64)
            own = current.value[units].astype(np.int64)
            best, better = _chosen(sums[:, :-1].reshape(len(units), 2, classes), sums[:, -1], own, table, prices(table), int(current.value[fixed]))
            better &= units != fixed
            return pa.Table.from_batches([moved(units[better], best[better])])
        return work

    sent = context.broadcast(assigned)
    table = table_of(sent)
    best, start = (likelihood(table), assigned.copy(), table), likelihood(table)
    step, schema = 0, "unit binary, into binary"
    while rounds is None or step < TURNS * rounds:
        rows = bigrams.where(F.col("turn") == step % TURNS)
        whole = rows.where("not frequent") if spread else rows
        found = whole.select("after", "before").mapInArrow(whole_units(sent, table), schema).collect()
        if spread:
            parts = rows.where("frequent").select("after", "before").mapInArrow(sums_of_parts(sent), "unit int, sums binary")
            some = F.floor(F.col("unit") / (TURNS * 16))
            found += parts.groupBy(some.alias("some")).applyInArrow(met(sent, table), schema).collect()
        if any(r.unit for r in found):
            for r in [r for r in found if r.unit]:
                assigned[np.frombuffer(r.unit, np.int32)] = np.frombuffer(r.into, np.uint16)
            sent.destroy()
            sent = context.broadcast(assigned.copy())
            table = table_of(sent)
            now = likelihood(table)
            if now > best[0]:
                best = now, assigned.copy(), table
        step += 1
        if step % TURNS == 0:
            if best[0] - start <= LEAST_GAIN * abs(start):
                break
            start = best[0]
    sent.destroy()
    return best[1], best[2]


def ending_classes(words: DataFrame, assigned, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How many training words each class has, and for each ending the class of most of its training words.

    An ending that no training word has takes the class of most words.
    """
    def work(batches):
        cells = np.zeros(ENDINGS * classes, np.int64)
        for batch in batches:
            unit, end = batch.column("unit").to_numpy(), batch.column("ending").to_numpy()
            cells += np.bincount(end * classes + assigned.value[unit], minlength=len(cells))
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["cell", "n"])

    counts = np.zeros((ENDINGS, classes))
    rows = words.where("c > 0").select("unit", F.col("ending").cast("long").alias("ending"))
    for r in rows.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell // classes, r.cell % classes] = r.n
    held = counts.sum(axis=0)
    counts[:, 0] = 0  # the end token's
    return held, np.where(counts.any(axis=1), counts.argmax(axis=1), counts.sum(axis=0).argmax())


def scored(docs: DataFrame, held: Column | None = None, text: str = "text", doc_id: str = "doc_id", rounds: int | None = None,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    ``held``: which documents training leaves out, by default a fifth by a checksum of the id. A null text is empty and
    has the end token only. Without training documents every count is 0 and all words are unknown. ``rounds`` ends the
    clustering early.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       (held_out(F.col(doc_id)) if held is None else held).alias("held"))
    conf = docs.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")  # every step writes what it leaves; nothing reads its shuffles again
    try:
        return _scored(docs, rounds, block_bytes)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


def _numbered(words: DataFrame) -> tuple[DataFrame, int, int]:
    """Staged (word, c, ending, unit), the number of units and of training tokens.

    The end token is unit 0, other frequent words follow, then all other training words; a word that training has not
    seen has -1 less its ending.
    """
    top = [bytes(r.word) for r in words.where("c > 0").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    top = [END, *[w for w in top if w != END][:FREQUENT - 1]]
    own = words.sparkSession.createDataFrame([(bytearray(w), i) for i, w in enumerate(top)], "word binary, own long")
    words = words.join(F.broadcast(own), "word", "left")
    seen, tokens = words.where("c > 0").agg(F.count_if(F.col("own").isNull()), F.coalesce(F.sum("c"), F.lit(0))).first()
    parts = -(-seen // NUMBERED) or 1
    words = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))
    rest = F.col("own").isNull() & (F.col("c") > 0)
    sizes = {r.part: r.n for r in words.where(rest).groupBy("part").agg(F.count("*").alias("n")).collect()}
    # frequent words have the first numbers, however few they are
    starts = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(parts)])])[:-1] + FREQUENT
    place = F.row_number().over(Window.partitionBy("part", rest).orderBy("word")) - 1
    start = F.element_at(F.lit(starts.tolist()), F.col("part") + 1)
    unit = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("c") > 0, start + place).otherwise(-1 - F.col("ending"))
    return stage(words.select("word", "c", "ending", unit.cast("long").alias("unit")), "units"), FREQUENT + seen, tokens


def _scored(docs: DataFrame, rounds: int | None, block_bytes: int) -> DataFrame:
    blocks = _blocks(docs, block_bytes)
    local = blocks.where("kind = 'word'")
    counted = stage(local.groupBy("word").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")), "words")
    words, units, total = _numbered(counted)
    release(counted)

    def gathered(key, found):
        place = np.argsort(found.column("local").to_numpy())
        c, unit = (np.ascontiguousarray(found.column(x).to_numpy()[place].astype(np.int64)).tobytes() for x in ("c", "unit"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([c], pa.binary()), "unit": pa.array([unit], pa.binary())})

    by_word = local.select("block", "local", "word").join(words.select("word", "c", "unit"), "word")
    lookups = stage(by_word.select("block", "local", "c", "unit").groupBy("block").applyInArrow(gathered, "block long, c binary, unit binary"), "lookups")
    classes = classes_for(units)
    bigrams, spread = _bigrams(blocks, lookups, units, total)
    assigned, table = exchange(bigrams, units, 0, classes, rounds, spread)
    release(bigrams)
    sent = docs.sparkSession.sparkContext.broadcast(assigned)
    v_class, of_ending = ending_classes(words, sent, classes)
    release(words)
    distinct = int(v_class.sum())
    n_class = table.sum(axis=0)  # a text's first word follows an end token, so every token is once in second place
    moves = np.log10((table + ADDED) / (table.sum(axis=1, keepdims=True) + ADDED * classes))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double")

    def score(_, texts, found):
        c, unit = (np.frombuffer(found.column(x)[0].as_py(), np.int64) for x in ("c", "unit"))
        kind = np.where(unit >= 0, sent.value[np.maximum(unit, 0)], of_ending[np.maximum(-1 - unit, 0)]).astype(np.int64)
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        emitted = np.log10((c + 0.5) / (n_class[kind] + 0.5 * (v_class[kind] + 1)))
        raw = [np.frombuffer(x, np.int32) for x in texts.column("ids").to_pylist()]
        sizes = np.array([len(x) for x in raw])
        out = np.zeros((3, len(raw)))
        for i, ids in enumerate(raw):
            classes_of = kind[ids]
            before = np.concatenate([[0], classes_of[:-1]])
            out[:, i] = (c[ids] > 0).sum(), base[ids].sum(), emitted[ids].sum() + moves[before, classes_of].sum()
        return pa.table([texts.column("doc_id"), texts.column("held"), pa.array(sizes), pa.array(out[0].astype(np.int64)),
                         pa.array(np.full(len(raw), total)), pa.array(out[1]), pa.array(out[2])],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = blocks.where("kind = 'doc'").select("block", "doc_id", "held", "ids")
    return texts.groupBy("block").cogroup(lookups.groupBy("block")).applyInArrow(score, schema)


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    """Every document's log10 probability under the class model and under counts of single words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs)
