"""Prefix trie of conversations from double arrays over shards of sorted conversations.

A conversation is its turns' keys one after another (`paths`). Paths are sorted
over all tasks, and a task packs each stretch of them, a shard, into a double
array: the child of node s by turn id c is at BASE[s] + c, and CHECK there holds
s. Walking the array gives the nodes and what is below them. Sorting keeps what
starts alike together, so a node can only be in several shards if it is a prefix
of a shard's first or last path; these upper nodes, two paths a shard at most,
are merged over all shards by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small, written

#: A path spells a turn as 16 bytes of the SHA-256 of its role and text, and its number of words.
DIGEST, STEP = 16, 20
#: A shard ends at the row with which it has so many turns, a row counting one more.
SHARD_TURNS = 100_000
#: Turns that a task sorts and packs, shard by shard.
TASK_TURNS = 2_000_000
#: Free cells tried for a node with several children before they go behind all others.
TRIES = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()

_TURN = np.dtype([("a", ">u8"), ("b", ">u8"), ("words", ">u4")])
_NODES = "shard long, ref int, above int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, tokens long, words long, own_words long, chain int, node_key string, parent_key string, ends_sha256 string, ends binary, first_end long"


def turn_key(role: Column, text: Column) -> Column:
    """The turn in a path, as hexadecimal digits; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    spelled = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(F.sha2(spelled.cast("binary"), 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(words)), 8, "0"))


def paths(turns: DataFrame, group: int = 20, spread: int = 4) -> DataFrame:
    """(conv_id, path) of every rebuilt conversation, one row each, from rows (conv_id, turn, role, text).

    Conversation c starts with the first h turns of conversation c - c % group, h being crc32(c) % spread,
    and goes on with its own turns behind its first h. Turns are in order of turn, null first; turns
    with equal numbers are in order of their keys, so that the order of rows never matters. Rows
    without conv_id belong to no conversation. Texts stay where they are read: only keys move, once.
    """
    conv = F.col("conv_id").cast("long")
    rows = turns.where("conv_id IS NOT NULL").select(conv.alias("conv"), (conv - conv % group).alias("head"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"))
    whole = rows.repartition("head").groupBy("head", "conv").agg(F.sort_array(F.collect_list(F.struct("turn", "key"))).alias("said"))
    whole = whole.withColumn("said", F.transform("said", lambda x: x["key"]))
    first = F.max(F.when(F.col("conv") == F.col("head"), F.slice("said", 1, spread - 1))).over(Window.partitionBy("head"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % spread
    own = F.slice("said", (h + 1).cast("int"), F.size("said"))
    both = F.concat(F.slice(F.coalesce(first, F.array().cast("array<string>")), F.lit(1), h.cast("int")), own)
    return whole.select(F.col("conv").alias("conv_id"), F.unhex(F.array_join(both, "")).alias("path"))


class DoubleArray:
    """BASE and CHECK over dense turn ids; node 0 is the root. A free cell has CHECK -1."""

    def __init__(self, cells: int):
        self.base = np.zeros(cells, np.int64)
        self.check = np.full(cells, -1, np.int64)
        self.check[0] = 0
        self.low, self.top = 1, 1

    def room(self, end: int) -> None:
        """Cells up to end exist."""
        if end > len(self.check):
            more = max(end, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def free(self, n: int) -> np.ndarray:
        """The n lowest free cells; low moves up to the first of them."""
        found, size = np.zeros(0, np.int64), n + 64
        while len(found) < n:
            self.room(self.low + size)
            found = np.flatnonzero(self.check[self.low : self.low + size] < 0)[:n] + self.low
            size *= 2
        self.low = int(found[0])
        return found

    def add(self, node: int, codes: np.ndarray) -> None:
        """Children of a node by ascending codes, at the first free place among those tried, or behind all others."""
        for cell in self.free(TRIES).tolist():
            at = cell - codes[0] + codes
            self.room(int(at[-1]) + 1)
            if (self.check[at] < 0).all():
                break
        else:
            at = self.top - codes[0] + codes
            self.room(int(at[-1]) + 1)
        self.base[node] = at[0] - codes[0]
        self.check[at] = node
        self.top = max(self.top, int(at[-1]) + 1)

    def add_single(self, nodes: np.ndarray, codes: np.ndarray) -> None:
        """One child for each of the nodes, in the lowest free cells."""
        at = self.free(len(nodes))
        self.base[nodes] = at - codes
        self.check[at] = nodes
        self.top = max(self.top, int(at[-1]) + 1)


def dense(turns: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Ids 0, 1, ... of the turns, in the order in which the levels of the trie first show them."""
    order = np.lexsort((turns["b"], turns["a"]))
    a, b = turns["a"][order], turns["b"][order]
    fresh = np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    same = np.empty(len(turns), np.int64)
    same[order] = np.cumsum(fresh)
    by_level = np.argsort(depth, kind="stable")
    _, first = np.unique(same[by_level], return_index=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    return place[same]


def pack(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, levels: list[np.ndarray]) -> DoubleArray:
    """The double array of sorted distinct paths (codes[start:start + size]); levels[d] are the paths longer than d."""
    out = DoubleArray(2 * len(codes) + 2)
    state = np.zeros(len(starts), np.int64)
    for d, rows in enumerate(levels):
        parent, code = state[rows], codes[starts[rows] + d]
        new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])))
        node, child = parent[new], code[new]
        heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        counts = np.diff(np.append(heads, len(node)))
        for i, n in zip(heads[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
            out.add(int(node[i]), np.sort(child[i : i + n]))
        if (counts == 1).any():
            out.add_single(node[heads[counts == 1]], child[heads[counts == 1]])
        state[rows] = out.base[parent] + code
    return out


def shard_nodes(shard: int, names: list[bytes], convs: list[int]) -> pa.RecordBatch:
    """The nodes of one shard from its sorted rows (path, conv_id). Prefixes of the first and the last path
    have a ref and a key and hold this shard's part only; the others are whole, but for a parent with a ref
    (above)."""
    runs = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    ends = [*runs[1:], len(names)]
    distinct = [names[i] for i in runs]
    sizes = np.array([len(x) // STEP for x in distinct], np.int64)
    starts = np.cumsum(sizes) - sizes
    turns = np.frombuffer(b"".join(distinct), _TURN)
    depth = np.arange(len(turns)) - np.repeat(starts, sizes)
    codes = dense(turns, depth) if len(turns) else np.zeros(0, np.int64)
    weight = np.array([b - a for a, b in zip(runs, ends, strict=True)], np.int64)
    smallest = np.array([convs[i] for i in runs], np.int64)
    by_size = np.argsort(sizes, kind="stable")
    cuts = np.searchsorted(sizes[by_size], np.arange(sizes.max(initial=0)), "right")
    levels = [np.sort(by_size[c:]) for c in cuts.tolist()]
    trie = pack(codes, starts, sizes, levels)

    # Down: walk all paths at once; every cell that is reached is a node.
    n = len(trie.check)
    members, least, words = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    level = np.full(n, -1, np.int64)
    state = np.zeros(len(distinct), np.int64)
    members[0], least[0], level[0] = weight.sum(), smallest.min(), 0
    for d, rows in enumerate(levels):
        at = starts[rows] + d
        step = trie.base[state[rows]] + codes[at]
        if (trie.check[step] != state[rows]).any():
            raise RuntimeError("a path leaves its double array")
        np.add.at(members, step, weight[rows])
        np.minimum.at(least, step, smallest[rows])
        words[step], level[step] = turns["words"][at], d + 1
        state[rows] = step
    edge = {0: (0, 0)}
    chains = [(0, 1), (len(distinct) - 1, 2)]
    keys = {0: hashlib.sha256(b"").hexdigest()[: 2 * DIGEST]}
    for row, chain in chains:
        spelled, at = hashlib.sha256(), 0
        for d in range(int(sizes[row])):
            spelled.update(distinct[row][d * STEP : (d + 1) * STEP])
            at = int(trie.base[at] + codes[starts[row] + d])
            if at in edge:
                edge[at] = (edge[at][0], 0)
            else:
                edge[at] = (len(edge), chain)
                keys[at] = spelled.copy().hexdigest()[: 2 * DIGEST]
    if len(distinct) == 1:
        edge = {k: (ref, 0) for k, (ref, _) in edge.items()}

    # Up: what is below a node, by levels.
    order = np.flatnonzero(level >= 0)
    order = order[np.argsort(level[order], kind="stable")]
    parent, upper = trie.check, np.zeros(n, bool)
    upper[list(edge)] = True
    inner = order[~upper[order]]
    children = np.bincount(parent[inner], minlength=n)
    tokens, own = members * words, np.where(upper, 0, words)
    leaves = np.zeros(n, np.int64)
    everyone = np.bincount(parent[order[1:]], minlength=n)
    leaves[inner] = everyone[inner] == 0
    bounds = np.searchsorted(level[order], np.arange(1, len(levels) + 2))
    for d in range(len(levels) - 1, -1, -1):
        nodes = order[bounds[d] : bounds[d + 1]]
        for sums in (tokens, own, leaves):
            np.add.at(sums, parent[nodes], sums[nodes])

    digest: dict[int, str] = {}
    pieces: dict[int, tuple[bytes, int]] = {}
    for at, a, b in zip(state.tolist(), runs, ends, strict=True):
        said = ",".join(map(str, convs[a:b])).encode()
        if at in edge:
            pieces[at] = (said, convs[a])
        else:
            digest[at] = hashlib.sha256(said).hexdigest()
    nodes, above = order.tolist(), parent[order].tolist()
    ref = [edge[x][0] if x in edge else None for x in nodes]
    known = [None if y in edge else z for y, z in zip(above, least[parent[order]].tolist(), strict=True)]
    columns = [
        [shard] * len(nodes), ref, [edge[y][0] if y in edge and x else None for x, y in zip(nodes, above, strict=True)],
        least[order], level[order], known, members[order], children[order], leaves[order], tokens[order], words[order], own[order],
        [edge[x][1] if x in edge else None for x in nodes], [keys.get(x) for x in nodes],
        [keys.get(y) if x in edge and x else None for x, y in zip(nodes, above, strict=True)],
        [None if x in edge else digest.get(x, NO_ENDS) for x in nodes], [pieces.get(x, (None,))[0] for x in nodes], [pieces.get(x, (0, None))[1] for x in nodes],
    ]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in _NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def packer(shard_turns: int):
    """Sorted rows (path, conv_id) to the nodes of their shards; a task holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, turns = TaskContext.get().partitionId() << 32, 0
        names: list[bytes] = []
        convs: list[int] = []
        for batch in batches:
            for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(path)
                convs.append(conv)
                turns += 1 + len(path) // STEP
                if turns >= shard_turns:
                    yield shard_nodes(shard, names, convs)
                    shard, turns, names, convs = shard + 1, 0, [], []
        if names:
            yield shard_nodes(shard, names, convs)

    return run


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, comma-joined, from rows sorted by node and first id; one piece is held at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if name == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = name, hashlib.sha256()
            state.update(piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["node_key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (key, state.hexdigest())], ["node_key", "ends_sha256"])


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, task_turns: int = TASK_TURNS) -> DataFrame:
    """Every node of the trie of rows (conv_id, path) with distinct ids, as `paths` makes them.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (each node's members but one, times its words, over the subtree), ends_sha256 (of the ids
    that end here, ascending, comma-joined). Copies of one path may fill many shards: each gives its part.
    No conversations give no nodes, not even a root.
    """
    spark = conversations.sparkSession
    stored = written(conversations.select("path", "conv_id"), "paths")
    turns = stored.agg(F.count("*") + F.coalesce(F.sum(F.octet_length("path") / STEP), F.lit(0)).cast("long")).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-turns // task_turns))
    dealt = stored.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = written(dealt.mapInArrow(packer(shard_turns), _NODES), "nodes")

    # Upper nodes: what the shards know of them is added up; what only whole nodes tell (which of them are
    # leaves, their words) is counted in one of their shards and added up along its first and last path.
    upper = nodes.where("ref IS NOT NULL")
    merged = upper.groupBy("node_key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"), F.sum("tokens").alias("tokens"),
        F.sum("own_words").alias("inner_words"), F.max("words").alias("words"), F.min("shard").alias("owner"),
    )
    merged = written(merged, "upper")
    kids = merged.groupBy(F.col("parent_key").alias("node_key")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "node_key", "left").withColumn("n_children", F.col("inner_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    merged = written(merged, "upper")
    places = upper.select("node_key", "shard", "ref", "chain", "depth").join(merged.drop("depth", "parent_key"), "node_key")
    mine = F.col("shard") == F.col("owner")
    below = Window.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    shard, branch = below.partitionBy("shard"), below.partitionBy("shard", "chain")
    added = lambda x: F.when(F.col("chain") == 0, F.sum(x).over(shard)).otherwise(F.sum(x).over(branch))
    places = places.withColumn("leaf", F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).withColumn("here", F.when(mine, F.col("words")).otherwise(0))
    along = places.select("node_key", added("leaf").alias("leaf"), added("here").alias("here")).groupBy("node_key").agg(F.sum("leaf").alias("leaf"), F.sum("here").alias("here"))
    pieces = upper.where("ends IS NOT NULL").select("node_key", "first_end", "ends").repartition("node_key").sortWithinPartitions("node_key", "first_end")
    ends = pieces.mapInArrow(digests, "node_key string, ends_sha256 string")
    parents = merged.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.join(along, "node_key").join(ends, "node_key", "left").join(parents, "parent_key", "left")
    top = top.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("inner_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("tokens") - F.col("inner_words") - F.col("here")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )

    inner = nodes.where("ref IS NULL").withColumn("saved_tokens", F.col("tokens") - F.col("own_words"))
    over = written(places.select("shard", F.col("ref").alias("above"), F.col("conv_id").alias("upper_conv")), "above")
    inner = inner.join(small(over, 64), ["shard", "above"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv"))
    return top.union(inner.select(*top.columns))


def conversation_trie(turns: DataFrame, group: int = 20, spread: int = 4) -> DataFrame:
    """The trie of the conversations rebuilt from rows (conv_id, turn, role, text); other columns are not read."""
    return trie_nodes(paths(turns, group, spread))
