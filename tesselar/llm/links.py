"""Links between documents that share a key: who shares is found on identifiers alone, payloads follow only for those.

`linked` is the candidate search of every near-copy operator here. It works on nodes: a node is a digest of what is
compared, so that documents with equal payloads are one node from the start (`collapse`), whatever their number, and
rows that repeat an identifier with different texts are different nodes. Keys (64 bits) are counted, each task's first,
and those that only one node has are dropped; the nodes of the others get their payloads, meet by key, and are connected
by `forest`; of keys that the same nodes have one is enough. A forest has the connected components of *all* pairs at or above the threshold, yet needs far fewer
comparisons than there are pairs: whatever is linked to a visited node is not compared with its further neighbours
again. So no group is capped, and a group of n alike costs n comparisons.

`all_links` has all pairs in place of a forest, for counts of links and best partners. The pairs never leave their task:
each group gives a row for each node that has links in it, and a forest of them, so that what is moved and kept grows
with the nodes of the groups and not with their pairs. For that two nodes are compared once only, in the group of the
first of the keys that both have; each node brings its earlier keys along.

A group holds two blocks of about `BLOCK` nodes at most: the nodes of a larger key are drawn into blocks by digest, and
every two blocks of the key meet in a group of their own. No task gets all nodes of a hot key, at any step.

Nodes are 64-bit numbers: two different payloads of n have the same one with a probability of n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, in_keys, keyed, release, without_keys

BLOCK = 1 << 14
#: compare(data, i, js) -> similarity of row i of the payloads with each of the rows js.
Compare = Callable[[object, int, np.ndarray], np.ndarray]


def forest(data, n: int, compare: Compare, at_least: float) -> list[tuple[int, int, float]]:
    """Edges (i, j, similarity) that span the components of the graph of all pairs with similarity >= at_least."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            s = compare(data, i, rest)
            near = s >= at_least
            for j, x in zip(rest[near].tolist(), s[near].tolist()):
                edges.append((i, j, x))
                queue.append(j)
            rest = rest[~near]
    return edges


def every(load: Callable[[], object], nodes: np.ndarray, reps: np.ndarray, first: np.ndarray, earlier: np.ndarray, mine: np.ndarray, home: np.ndarray, compare: Compare, at_least: float) -> list[tuple[int, int, int, float, int]]:
    """The rows (node, rep, n, score, other) of `all_links` of one group.

    earlier[first[i]:first[i + 1]] are the keys of node i before that of the group: pairs that have one in common are
    compared there. Pairs of one block `mine` count where it is at `home`, pairs of one rep don't count.
    """
    n = len(nodes)
    names, codes = np.unique(earlier[first[0] : first[-1]], return_inverse=True)
    first, held = first - first[0], np.zeros(len(names), bool)
    total, best, other, label = np.zeros(n, np.int64), np.full(n, -1.0), np.zeros(n, np.int64), np.arange(n)
    data = None
    for i in range(n - 1):
        ok = reps[i + 1 :] != reps[i]
        if not home[i]:
            ok &= mine[i + 1 :] != mine[i]
        own = codes[first[i] : first[i + 1]]
        if len(own):
            held[own] = True
            met = np.concatenate([[0], np.cumsum(held[codes[first[i + 1] :]])])[first[i + 1 :] - first[i + 1]]
            ok &= met[1:] == met[:-1]
            held[own] = False
        js = np.flatnonzero(ok) + i + 1
        if not len(js):
            continue
        if data is None:
            data = load()
        s = compare(data, i, js)
        js, s = js[s >= at_least], s[s >= at_least]
        if not len(js):
            continue
        total[js] += 1
        total[i] += len(js)
        better = (s > best[js]) | (s == best[js]) & (reps[i] < other[js])
        best[js[better]], other[js[better]] = s[better], reps[i]
        most = s.max()
        who = reps[js[s == most]].min()
        if most > best[i] or most == best[i] and who < other[i]:
            best[i], other[i] = most, who
        met = np.unique(label[js])
        if len(met) > 1 or met[0] != label[i]:
            label[np.isin(label, met)] = label[i]
    some = np.flatnonzero(total)
    out = list(zip(*(x[some].tolist() for x in (nodes, reps, total, best, other))))
    out.extend((nodes[i], reps[i], 0, 0.0, x) for i, x in zip(some.tolist(), smallest(label[some], reps[some]).tolist()) if x != reps[i])
    return out


def smallest(label: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """The smallest of the reps that have the same label, for each."""
    order = np.lexsort((reps, label))
    first = np.concatenate([[True], label[order][1:] != label[order][:-1]])[: len(label)]
    out = np.empty_like(reps)
    out[order] = reps[order][first][np.cumsum(first) - 1]
    return out


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows (key, doc_id, n) of keys (key, doc_id), both LONG, whose key n > 1 rows have.

    If keys has a boolean column `asks`, one of these rows at least must be true in it.
    """
    return with_counts(keys, counted(keys))


def counted(keys: DataFrame) -> DataFrame:
    """The keys (key, n) that `shared_keys` keeps, checkpointed."""
    asks = [F.bool_or("asks").alias("asked")] if "asks" in keys.columns else []
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), *asks).where("n > 1 AND asked" if asks else "n > 1")
    return checkpointed(counts.select("key", "n"))


def with_counts(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows (key, doc_id, n) of keys whose key is in counts (key, n)."""
    return keyed(keys.select("key", "doc_id"), counts, ["key"], row_bytes=32, few=False)


def distinct_groups(rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id, n) of one of those keys that the same nodes have: near copies share most of their keys.

    Sets of nodes are told by their size and two 64-bit digests.
    """
    digest = lambda k: F.bit_xor(F.xxhash64(F.lit(k), F.col("doc_id")))
    sets = rows.groupBy("key").agg(F.first("n").alias("n"), digest(1).alias("x"), digest(2).alias("y"))
    kept = checkpointed(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    return keyed(rows.select("key", "doc_id"), kept, ["key"], row_bytes=32, few=False)


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, node, low, high, mine, home, ..) of rows (key, doc_id, n, ..): the groups of two blocks in which nodes meet; 0, 0 if there's one.

    mine is a node's block. Two nodes of one block meet wherever it does, and it is at home in one of these groups.
    """
    blocks = F.ceil(F.col("n") / block).cast("long")
    mine = F.pmod(F.xxhash64("doc_id"), blocks)
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: (o != mine) | (blocks == 1)))
    more = [c for c in rows.columns if c not in ("key", "doc_id", "n")]
    placed = rows.select("key", F.col("doc_id").alias("node"), blocks.alias("blocks"), mine.alias("mine"), other.alias("other"), *more)
    home = F.col("other") == (F.col("mine") + 1) % F.col("blocks")
    return placed.select("key", "node", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", home.alias("home"), *more)


def collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (node, rep, ..), copies (doc_id, node), counts (node, rep, n)) of rows (doc_id, node, ..).

    rep is the smallest identifier of a node. copies are the rows of nodes that n > 1 rows have, counts these nodes.
    Payloads are moved only for nodes that repeat, and then once for each task that has them.
    """
    counts = checkpointed(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    again = counts.select("node")
    more = [c for c in rows.columns if c not in ("doc_id", "node")]
    once = without_keys(rows, F.col("node"), again).select("node", F.col("doc_id").alias("rep"), *more)
    repeated = in_keys(rows, F.col("node"), again)
    # Equal payloads are equal whichever is taken.
    merged = repeated.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in more])
    return once.unionByName(merged), repeated.select("doc_id", "node"), counts


def ties(rows: DataFrame, copies: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b): links between the representatives of nodes that share an identifier, of rows (doc_id, node)."""
    by = rows.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    mine = in_keys(copies, F.col("doc_id"), checkpointed(by.select("doc_id")))
    # A node that nothing else has is represented by the identifier itself.
    return keyed(mine, counts, ["node"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def linked(keys: DataFrame, payload: DataFrame, load: Callable[[pa.Array], object], compare: Compare, at_least: float, *, block: int = BLOCK) -> DataFrame:
    """(a, b, score): links between representatives, a < b, whose nodes share a key and whose payloads are so similar.

    keys is (key LONG, doc_id LONG), where doc_id is a node; payload (node LONG, rep LONG, data BINARY); load makes what
    compare takes of an array of payloads. Pairs that are linked through others may be left out, but every component
    is connected.
    """

    def connect(batches):
        # The parts of the group (key, low, high) that is being read: (representatives, payloads).
        held: list[tuple[np.ndarray, pa.Array]] = []
        group, found = None, []

        def close():
            d = np.concatenate([x[0] for x in held])
            if len(d) > 1:
                p = held[0][1] if len(held) == 1 else pa.concat_arrays([x[1] for x in held])
                found.extend((int(d[i]), int(d[j]), x) for i, j, x in forest(load(p), len(d), compare, at_least) if d[i] != d[j])
            held.clear()

        def out():
            a, b, s = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s, pa.float64())], ["a", "b", "score"])

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)], axis=1)
            d, p = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            cuts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1), [True]])).tolist() if len(k) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now = tuple(k[lo].tolist())
                if held and now != group:
                    close()
                group = now
                held.append((d[lo:hi], p.slice(lo, hi - lo)))
            if found:
                yield out()
        if held:
            close()
        if found:
            yield out()

    placed = in_blocks(distinct_groups(checkpointed(shared_keys(keys))), block).select("key", "node", "low", "high")
    with_data = placed.join(payload, "node").select("key", "low", "high", "rep", "data")
    return (
        with_data.repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "rep")
        .mapInArrow(connect, "a long, b long, score double")
        .groupBy("a", "b")
        .agg(F.max("score").alias("score"))
    )


def all_links(keys: DataFrame, payload: DataFrame, load: Callable[[pa.Array], object], compare: Compare, at_least: float, *, block: int = BLOCK) -> DataFrame:
    """(node, rep, n, score, other): in rows of n > 0 the links of a node, and in rows of n = 0 links (rep, other) that connect all.

    The rows of n > 0 of a node tell how many links it has in each group, which don't overlap, and the best of these
    with its partner's rep, the smallest of equal ones. The arguments are those of `linked`.
    """
    names = ["node", "rep", "n", "score", "other"]

    def connect(batches):
        # The parts of the group (key, low, high) that is being read: nodes, reps, blocks, at home, bounds of keys, keys, payloads.
        held: list[tuple] = []
        group = None

        def close():
            parts = list(zip(*held))
            nodes, reps, mine, home = (x[0] if len(held) == 1 else np.concatenate(x) for x in parts[:4])
            first, earlier, data = (x[0] for x in parts[4:])
            if len(held) > 1:
                counts, data = np.concatenate([np.diff(x) for x in parts[4]]), pa.concat_arrays(parts[6])
                first, earlier = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([v[f[0] : f[-1]] for f, v in zip(parts[4], parts[5])])
            held.clear()
            return every(lambda: load(data), nodes, reps, first, earlier, mine, home, compare, at_least) if len(nodes) > 1 else []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names)

        for batch in batches:
            found = []
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high")], axis=1)
            nodes, reps, mine, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "rep", "mine", "home"))
            first, earlier, data = batch.column("earlier").offsets.to_numpy().astype(np.int64), batch.column("earlier").values.to_numpy(), batch.column("data")
            cuts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1), [True]])).tolist() if len(k) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now = tuple(k[lo].tolist())
                if held and now != group:
                    found.extend(close())
                group = now
                held.append((nodes[lo:hi], reps[lo:hi], mine[lo:hi], home[lo:hi], first[lo : hi + 1], earlier, data.slice(lo, hi - lo)))
            if found:
                yield out(found)
        found = close() if held else []
        if found:
            yield out(found)

    spark = keys.sparkSession
    counts = counted(keys)
    release(spark)
    shared = checkpointed(with_counts(keys, counts))
    release(spark)
    by_node = distinct_groups(shared).groupBy(F.col("doc_id").alias("node")).agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("groups"))
    each = by_node.join(payload, "node").select("node", "rep", "data", "groups", F.posexplode("groups").alias("at", "group"))
    earlier = F.transform(F.slice("groups", F.lit(1), F.col("at")), lambda g: g["key"])
    rows = each.select(F.col("group.key").alias("key"), F.col("node").alias("doc_id"), F.col("group.n").alias("n"), "rep", earlier.alias("earlier"), "data")
    return (
        in_blocks(rows, block)
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "node")
        .mapInArrow(connect, "node long, rep long, n long, score double, other long")
    )
