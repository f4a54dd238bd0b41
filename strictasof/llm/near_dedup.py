"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``distance`` bits are linked. The 64 bits are divided into partitions that keep
correlated bits together, and each partition gets its own threshold; as long as the thresholds plus one add up to more
than ``distance``, any linked pair is within the threshold in some partition. Number of partitions and thresholds are
chosen by dynamic programming on the probes they cost and the candidates they are expected to bring, from the measured
bit statistics. The flips of a threshold are shared: a fingerprint is indexed under its bits of a partition with up to
half of them and probes with up to the other half, so two that are within the threshold meet under some value. Candidates
are verified on all bits and, where ``verify`` is given, on 128 further bits of independent hashes.

Similarity itself (:func:`similar`) is decided by the exact Jaccard index of the distinct shingles. The fingerprint and
the two halves of the further bits are probed as three independent fingerprints; their links only say which documents
are compared. Documents of one candidate component meet in a task, those of a large one block by block.

Equal fingerprints are one node from the start. A value under which very many fingerprints are indexed is cut into blocks
whose members meet in separate tasks; a task gives links enough to connect what it found, not all pairs. Components come
from label propagation with pointer jumping over staged tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bundle, numbered, parts_by_size, release, stage, unbundle, widened
from .registry import query

WORDS, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: index entries of one value that meet in one task; more are dealt out in blocks
BLOCK = 4096
#: pairs compared, and probes made, at a time
PAIRS = 1 << 18
#: cost of one probe against one verified candidate, in the choice of thresholds
PROBE_COST = 4.0
#: most of the 192 bits that candidates for a Jaccard index of 0.8 may differ in: their mean is 29, and 3 in 10 million
#: pairs at the limit differ in more
FAR = 56
#: distinct shingles of the documents that meet in one task
TOGETHER = 1 << 18
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _majority(digests: bytes, width: int) -> bytes:
    """The bits that over half of the hashes of ``width`` bytes have set."""
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, width)
    seen = np.bincount((hashes + np.arange(0, 256 * width, 256, dtype=np.int64)).ravel(), minlength=256 * width).reshape(width, 256)
    return np.packbits(2 * (seen @ _BYTE_BITS).ravel() > len(hashes)).tobytes()  # most significant bit first


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """A text's runs of ``words`` A-Z lower-cased words in order; a shorter text is one shingle, one without words has none."""
    found = text.encode().lower().split()
    if not found:
        return []
    whole = b" ".join(found)
    if len(found) < words:
        return [whole]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(found) - words + 1].tolist()
    return [whole[a:b] for a, b in zip(starts, ends[words - 1:].tolist())]


def _sketch(found: list[bytes], seed: int, further: bool) -> bytes:
    if not found:
        return bytes(24 if further else 8)
    hash_of, other = xxhash.xxh64_digest, xxhash.xxh3_128_digest
    first = _majority(b"".join([hash_of(s, seed) for s in found]), 8)
    return first + _majority(b"".join([other(s, seed) for s in found]), 16) if further else first


def sketch(text: str, words: int = WORDS, seed: int = SEED, further: bool = False) -> bytes:
    """The fingerprint of a text's shingles, 8 bytes, and if asked for 16 further bytes; zeros for a text without words."""
    return _sketch(shingles(text, words), seed, further)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bit by bit, whether over half of the shingle hashes have it; 0 for a text without words."""
    return int.from_bytes(sketch(text, words, seed), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, seed: int = SEED, further: bool = False) -> DataFrame:
    """The other columns of ``docs`` with ``fp`` and, if asked for, the further bits ``c1`` and ``c2``, as signed longs.

    Null counts as empty.
    """
    added = ["fp", "c1", "c2"] if further else ["fp"]
    kept = [c for c in docs.columns if c not in (text, *added)]
    schema = widened(docs.select(*kept), ", ".join(f"{c} long" for c in added))

    def work(batches):
        for batch in batches:
            bits = b"".join([sketch(v.as_py() or "", words, seed, further) for v in batch.column(text)])
            table = np.frombuffer(bits, ">i8").astype(np.int64).reshape(-1, len(added))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c) for c in table.T.copy()]], schema.names)

    return docs.select(*kept, text).mapInArrow(work, schema)


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have each two bits set: a 64 x 64 table summed over all tasks."""

    def count(batches):
        together, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for part in np.array_split(fp, max(1, len(fp) // 50_000)):
                bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                together += (bits.T @ bits).astype(np.int64)
                n += len(part)
        cells = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.append(together.ravel(), n))], ["cell", "n"])

    rows = distinct.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r.cell] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of near-equal size, each grown by the bit most correlated with those it has."""
    share = together / max(1, n)
    alone = np.diag(share)
    spread = np.sqrt(np.maximum(alone * (1 - alone), 1e-9))
    related = np.abs((share - np.outer(alone, alone)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = set(range(BITS)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (related[b, rest].max(), -b))]
        left.discard(group[0])
        while len(group) < size:
            rest = sorted(left)
            bit = rest[int(np.argmax(related[np.ix_(rest, group)].mean(axis=1)))]
            group.append(bit)
            left.discard(bit)
        groups.append(sorted(group))
    return groups


def _shared(e: int) -> tuple[int, int]:
    """Flips that the index and the probes of a threshold take."""
    return e // 2, e - e // 2


def _meetings(width: int, apart: int, index: int, probe: int) -> int:
    """Values within ``index`` flips of one and ``probe`` flips of another of two numbers that differ in ``apart`` bits."""
    return sum(math.comb(apart, s) * math.comb(width - apart, t) for s in range(apart + 1) for t in range(probe + 1)
               if s + t <= probe and apart - s + t <= index and t <= width - apart)


def _costs(n: int, alone: np.ndarray, group: list[int], distance: int) -> list[float]:
    """Cost of thresholds -1, 0, .. distance for one partition: rows to deal out plus meetings expected from the bits."""
    apart = np.zeros(len(group) + 1)  # distribution of the number of bits in which two fingerprints differ
    apart[0] = 1.0
    for b in group:
        q = 2 * alone[b] * (1 - alone[b])
        apart[1:] = apart[1:] * (1 - q) + apart[:-1] * q
        apart[0] *= 1 - q
    costs = [0.0]
    for e in range(distance + 1):
        index, probe = _shared(e)
        rows = sum(math.comb(len(group), k) for k in range(probe + 1))
        meet = sum(p * _meetings(len(group), d, index, probe) for d, p in enumerate(apart.tolist()) if d <= e)
        costs.append(PROBE_COST * n * rows + meet * n * n / 2)
    return costs


def allocate(n: int, together: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition used: the cheapest choice for which no linked pair can be missed."""
    alone, best = np.diag(together) / max(1, n), None
    for parts in range(1, distance + 2):
        groups = correlated_partitions(n, together, parts)
        tables = [_costs(n, alone, g, distance) for g in groups]
        # cheapest[k]: cost and choice so far whose thresholds plus one add up to k (more counts as distance + 1)
        cheapest = {0: (0.0, ())}
        for table in tables:
            grown: dict[int, tuple[float, tuple]] = {}
            for have, (cost, choice) in cheapest.items():
                for e, more in enumerate(table, -1):
                    k = min(distance + 1, have + e + 1)
                    if k not in grown or cost + more < grown[k][0]:
                        grown[k] = (cost + more, (*choice, e))
            cheapest = grown
        cost, choice = cheapest[distance + 1]
        if best is None or cost < best[0]:
            best = cost, [(g, e) for g, e in zip(groups, choice) if e >= 0]
    return best[1]


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits (0 is the most significant) packed into a number."""
    out = np.zeros(len(fp), np.uint64)
    for b in bits:
        out = out << np.uint64(1) | fp >> np.uint64(BITS - 1 - b) & np.uint64(1)
    return out


def _flips(width: int, least: int, most: int) -> np.ndarray:
    """Masks with ``least`` .. ``most`` bits set among ``width``."""
    level, out = np.zeros(1, np.uint64), []
    for n in range(most + 1):
        if n:
            level = np.unique((level[:, None] | (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]).ravel())
            level = level[np.bitwise_count(level) == n]
        if n >= least:
            out.append(level)
    return np.concatenate(out) if out else level[:0]


def probes(nodes: DataFrame, chosen: list[tuple[list[int], int]], carried: list[str]) -> DataFrame:
    """(part, value, role, carried): role 0 under the values a node is indexed under, role 1 where it only probes."""
    plan = []
    for p, (bits, e) in enumerate(chosen):
        index, probe = _shared(e)
        plan.append((p, bits, _flips(len(bits), 0, index), _flips(len(bits), index + 1, probe)))
    step = max(1, PAIRS // max([1, *(len(held) + len(tried) for _, _, held, tried in plan)]))

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                fp = part.column("fp").to_numpy().view(np.uint64)
                for p, bits, held, tried in plan:
                    own = _gather(fp, bits)
                    values = np.concatenate([(own[:, None] ^ m[None, :]).ravel() for m in (held, tried)]).view(np.int64)
                    whose = np.concatenate([np.repeat(np.arange(len(fp)), len(m)) for m in (held, tried)])
                    role = (np.arange(len(values)) >= len(fp) * len(held)).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), p, np.int8)), pa.array(values), pa.array(role),
                                                      *[pa.array(part.column(c).to_numpy()[whose]) for c in carried]],
                                                     ["part", "value", "role", *carried])

    return nodes.select(*carried).mapInArrow(work, "part byte, value long, role byte, " + ", ".join(f"{c} long" for c in carried))


def _connect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a - b: each node with the least node of its component, which connects as much with fewer links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(nodes: DataFrame, chosen: list[tuple[list[int], int]], distance: int = DISTANCE, verify: int | None = None,
          block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect every verified pair. Nodes are fingerprints, with ``verify`` those of column ``node``."""
    carried = ["fp"] if verify is None else ["node", "fp", "c1", "c2"]
    rows = probes(nodes, chosen, carried)
    owners = rows.where("role = 0").groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = stage(owners.select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot-values")
    rows = rows.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.pmod(F.xxhash64(*carried), F.col("blocks")).cast("int")
    rows = rows.select("part", "value", "role", *carried, home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("sub"))
    rows = rows.withColumn("role", F.when((F.col("role") == 0) & (F.col("home") == F.col("sub")), 0).otherwise(1).cast("byte"))
    keys = ["part", "value", "sub"]
    rows = rows.select(*keys, "role", *carried).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "role")

    def near(index: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the verified pairs of two tables of nodes (a column each; the first names the node)."""
        at = 0 if verify is None else 1
        apart = np.bitwise_count((index[at][:, None] ^ part[at][None, :]).view(np.uint64))
        i, j = np.nonzero((apart <= distance) & (index[0][:, None] != part[0][None, :]))
        if verify is not None and len(i):
            total = apart[i, j].astype(np.int64)
            for c in (2, 3):
                total += np.bitwise_count((index[c][i] ^ part[c][j]).view(np.uint64))
            i, j = i[total <= verify], j[total <= verify]
        return i, j

    def compare(batches):
        held = None  # the group that the last batch ended in, and what of its index was seen
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            found.clear()
            a, b = _connect(a, b) if len(a) else (a, b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
            table = np.stack([batch.column(c).to_numpy() for c in carried])
            role = batch.column("role").to_numpy()
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(role)]])
            indexed = np.add.reduceat((role == 0).astype(np.int64), first)
            carry = held[1] if held is not None and (held[0] == key[:, 0]).all() else table[:, :0]
            use = np.flatnonzero((indexed > 0) & (last - first > 1))
            use = np.union1d([0], use) if carry.shape[1] else use
            own = table[:, first[-1]:first[-1] + indexed[-1]]  # rows of the index come first in a group
            held = key[:, -1].copy(), np.concatenate([carry, own], axis=1) if len(first) == 1 else own
            for g in use.tolist():
                mine = table[:, first[g]:last[g]]
                index = mine[:, :indexed[g]]
                index = np.concatenate([carry, index], axis=1) if g == 0 else index
                pieces = max(1, math.ceil(mine.shape[1] * index.shape[1] / PAIRS))
                for part in np.array_split(mine, pieces, axis=1):
                    i, j = near(index, part)
                    if len(i):
                        pair = index[0][i], part[0][j]
                        found.append(_connect(*pair) if len(i) > 64 else pair)
                if sum(len(a) for a, _ in found) > 200_000:
                    yield flush()
        yield flush()

    found = rows.mapInArrow(compare, "a long, b long")
    return stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): component is the least node reachable."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "edges")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(
            F.min("component").alias("low"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = stage(labels.join(offered, "node").join(own, "component").select(
            "node", F.least("component", "low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved")), "labels")
        done = moved.where("moved").isEmpty()
        release(labels)
        labels = moved.drop("moved")
        if done:
            release(both)
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, words: int = WORDS,
                    seed: int = SEED, verify: int | None = None, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs`` without text, with fp, component (a number per component) and component_id.

    ``component_id`` is the smallest id reachable through links, the row's own included. ``verify``: most of the 192 bits
    of fingerprint and further hashes that may differ; without it the fingerprint alone decides. Texts without words have
    fingerprint 0 and are linked like any other. Null ids take part but name no component; one of null ids only has a null
    id. An empty table gives no rows.
    """
    key = ["fp"] if verify is None else ["fp", "c1", "c2"]
    rows = stage(fingerprints(docs.drop("component", "component_id"), text, words, seed, verify is not None), "fingerprints")
    nodes = rows.groupBy(*key).agg(F.min(doc_id).alias("first"))
    node = "fp" if verify is None else "node"
    nodes = stage(nodes if verify is None else nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, together = bit_statistics(nodes)
    if n:
        labels = components(links(nodes, allocate(n, together, distance), distance, verify, block)).withColumnRenamed("node", "_node")
        grouped = nodes.join(labels, F.col(node) == F.col("_node"), "left").select(
            *key, "first", F.coalesce("component", node).alias("component"))
        # stored first, so that the rows of a large component can be split in the join
        least = stage(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "least")
        named = grouped.join(least, "component").select(*key, "component", "component_id")
    else:
        named = nodes.select(*key, F.col(node).alias("component"), F.col("first").alias("component_id"))
    return rows.join(named, key).drop("c1", "c2")


def _hashes(text: str, words: int, seed: int) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, sorted."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in shingles(text, words)]), ">u8").astype(np.uint64))


def jaccard_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of positions that connect all sets whose Jaccard index is ``least`` or more. Values of a set are distinct.

    A set is compared with those that nothing has reached yet; what it reaches is compared in its turn.
    """
    sizes = np.array([len(x) for x in sets])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    mark, ends = np.zeros(len(distinct), bool), np.cumsum(sizes)
    open_, out, queue = np.ones(len(sets), bool), [], []
    left, whose = flat, owner
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first] = False
        queue.append(first)
        while queue:
            i = queue.pop()
            mine = flat[ends[i] - sizes[i]:ends[i]]
            keep = open_[whose]
            if 2 * keep.sum() < len(keep):  # those already reached need no further look
                left, whose = left[keep], whose[keep]
            mark[mine] = True
            both = np.bincount(whose[mark[left]], minlength=len(sets))
            mark[mine] = False
            near = open_ & (both > 0) & (both >= least * (sizes + sizes[i] - both) - 1e-9)
            for j in np.flatnonzero(near).tolist():
                out.append((i, j))
                queue.append(j)
            open_ &= ~near
    return out


def similar(docs: DataFrame, least: float, text: str = "text", distance: int = DISTANCE, words: int = WORDS, seed: int = SEED,
            verify: int = FAR, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """The columns of ``docs`` without text, with component: rows linked by a Jaccard index of ``least`` or more.

    ``row_id`` of ``docs`` is unique, and a component has that of one of its rows. The index is that of the distinct
    shingles by 64-bit hashes; equal sets are one node. Candidates are within ``distance`` bits in one of three
    fingerprints of the distinct shingles, and within ``verify`` of all 192 bits. Texts without words are alike.
    """
    kept = [c for c in docs.columns if c not in (text, "component")]
    bits, digest = ["fp", "c1", "c2"], ["d1", "d2"]
    schema = widened(docs.select(*kept), ", ".join(f"{c} long" for c in [*bits, *digest]) + ", size int")

    def describe(batches):
        for batch in batches:
            table, sizes = [], []
            for v in batch.column(text):
                found = sorted(set(shingles(v.as_py() or "", words)))
                table.append(_sketch(found, seed, True) + xxhash.xxh3_128_digest(b"".join(sorted(xxhash.xxh64_digest(s, seed) for s in found))))
                sizes.append(len(found))
            numbers = np.frombuffer(b"".join(table), ">i8").astype(np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c) for c in numbers.T.copy()],
                                              pa.array(sizes, pa.int32())], schema.names)

    rows = stage(docs.select(*kept, text).mapInArrow(describe, schema), "shingle-sets")
    nodes = stage(rows.groupBy(*digest, *bits, "size").agg(F.min("row_id").alias("node")), "nodes")
    # Each round knows the components of those before it: a pair inside one is no link any more, so a group of copies is
    # linked once and not again under every value it meets under. The first round asks for equal bits of a part only.
    known = stage(nodes.select("node", F.col("node").alias("component")), "known")
    for turn, exact in ((0, True), (0, False), (1, False), (2, False)):
        order = [bits[(turn + i) % 3] for i in range(3)]
        n, counts = bit_statistics(nodes.select(F.col(order[0]).alias("fp")))
        if not n:
            return rows.select(*kept, F.col("row_id").alias("component"))
        chosen = [(part, 0 if exact else e) for part, e in allocate(n, counts, distance)]
        turned = nodes.join(known, "node").select(F.col("component").alias("node"), *[F.col(b).alias(c) for b, c in zip(order, bits)])
        joined = components(links(turned, chosen, distance, verify, block)).toDF("component", "least")
        last, known = known, stage(known.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "known")
        release(last)
    sizes = stage(known.join(nodes.select("node", "size"), "node"), "candidates")
    blocks = stage(sizes.groupBy("component").agg(F.ceil(F.sum("size") / together).cast("int").alias("blocks"), F.count("*").alias("n"))
                   .where("n > 1").drop("n"), "blocks")
    dealt = sizes.join(blocks, "component").select(F.col("node").alias("row_id"), "component", F.greatest("blocks", F.lit(1)).alias("blocks"))
    texts = docs.select("row_id", text).join(dealt, "row_id")

    def hashed(batches):
        for batch in batches:
            for part in parts_by_size(batch, text, 8 << 20):
                found = [_hashes(v.as_py() or "", words, seed).tobytes() for v in part.column(text)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row_id", "component", "blocks")], pa.array(found, pa.binary())],
                                                 ["node", "component", "blocks", "hashes"])

    sets = texts.mapInArrow(hashed, "node long, component long, blocks int, hashes binary")
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("home")))
    sets = sets.withColumn("home", home).withColumn("other", F.explode(others)).select(
        "component", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), "node", "hashes")

    def compare(table):
        node = table.column("node").to_numpy()
        pairs = jaccard_links([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()], least)
        a, b = (node[[p[i] for p in pairs]] if pairs else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    same = sets.groupBy("component", "lo", "hi").applyInArrow(compare, "a long, b long")
    linked = components(stage(same.distinct(), "similar")).withColumnRenamed("node", "_node")
    named = nodes.join(linked, F.col("node") == F.col("_node"), "left").select(*digest, F.coalesce("component", "node").alias("component"))
    return rows.join(stage(named, "components"), digest).select(*kept, "component")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", jaccard: float | None = None, **settings) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, and of equal ids any one.

    Settings are those of :func:`near_duplicates`, or of :func:`similar` where ``jaccard``, the least index, is given.
    """
    rows = numbered(docs, bundle(docs, docs.columns), name="texts")
    ids = rows.select("row_id", *unbundle([doc_id, text]))
    found = near_duplicates(ids, text, doc_id, **settings) if jaccard is None else similar(ids, jaccard, text, **settings)
    first = found.groupBy("component").agg(F.min(F.struct(F.col(doc_id).isNull().alias("none"), doc_id, "row_id")).alias("f"))
    return rows.join(first.select(F.col("f.row_id").alias("row_id")), "row_id", "left_semi").select(*unbundle(docs.columns))


@query("op5_near_dedup")
def op5_near_dedup(spark, sf_dir):
    """Every document with its 4-word SimHash and its component at 4 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = near_duplicates(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
