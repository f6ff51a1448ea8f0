"""Prefix trie of conversations, as double arrays per prefix shard.

A conversation is rebuilt from the first turns of another one and its own later
ones, so many share prefixes. The trie's nodes are the distinct prefixes.

1. Turns get their place by exact distributed ranks, so a conversation of a third
   of all rows is spread over many tasks. A turn's content is 128 bits of a SHA-256;
   texts are never shuffled. Base turns are joined to the at most ``span - 1``
   conversations that copy them.
2. A prefix is named by its depth and 128 bits: the exclusive or of hashes of
   (content, depth). Conversations are cut into segments of ``SEGMENT`` turns; a
   segment row holds its turns and the name of the prefix before it, so no row
   grows with a conversation. Equal segments (same prefix at their end) are one
   row with the number and the least of their conversations, by partial aggregation.
3. Segments are range-partitioned and sorted by (prefix before, turns): a run of
   at most ``SHARD`` turns is a prefix shard. A hot first turn fills many shards.
   Each shard numbers its turn contents densely and packs a double array: the child
   of state s by turn t is slot BASE[s] + t, if CHECK there is s. Traversing it
   with all segments, level by level, gives the nodes and their counts; the levels
   in reverse give sums over subtrees.
4. Only nodes on a shard's first or last path, or above a segment that goes on, can
   have more elsewhere. These shared upper nodes are merged by name; their sums
   are added up their tree by pointer doubling, in log2(height) rounds over these
   few nodes. All other nodes leave their shard complete.
5. Ids of conversations that end at a node are joined to text in runs of
   ``ID_RUN`` consecutive ids, which are hashed in order as a stream; a node where
   one conversation ends, or none, needs no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm import textcols as T
from bourse.llm.lines import saved
from bourse.operators.ordering import ordered_rank

SEGMENT = 512
SHARD = 1 << 17
ID_RUN = 4096
SALTS = 16
EMPTY = hashlib.sha256(b"").hexdigest()
_BIG = np.iinfo(np.int64).max


def _copied(modulus: int) -> Column:
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus


# ---------------------------------------------------------------- rebuilt conversations
def rebuilt_turns(turns: DataFrame, span: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, key, bytes) of every rebuilt turn, d from 1, and (conv_id, length) of every conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.substring(F.sha2(framed.cast("binary"), 256), 1, 32)).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"))
    placed = ordered_rank(rows, [F.col("turn").asc_nulls_first(), "role", "key"], ["conv_id"], "pos").select(
        "conv_id", "pos", "key", "bytes")
    placed = saved(placed, "conversation-turns")
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % span
    convs = counts.select("conv_id", "n", base.alias("base"), _copied(modulus).alias("h"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = saved(convs.select("conv_id", "base", "h", taken.alias("taken"),
                               (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversation-lengths")
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "key", "bytes")
    heads = placed.where(F.col("pos") < modulus).where(F.col("conv_id") % span == 0).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("d"), "key", "bytes")
    copied = heads.join(convs.select("conv_id", "base", "taken"), "base").where("d <= taken").select(
        "conv_id", "d", "key", "bytes")
    return own.union(copied), convs.select("conv_id", "length")


def _xor(bits: str, before: bool = False) -> Column:
    w = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.bit_xor(bits).over(w), F.lit(0).cast("long")) if before else F.bit_xor(bits)


def segments(rebuilt: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """(s, ra, rb, a, b, depth, conv_id, last, path) per conversation and segment.

    r is the prefix before the segment, a and b name the one at its end, ``path``
    holds its turns. A conversation without turns has one empty segment.
    """
    named = rebuilt.select("conv_id", "d", "key", "bytes", F.floor((F.col("d") - 1) / segment).cast("int").alias("s"),
                           F.xxhash64("key", "d").alias("ga"), F.xxhash64("d", "key", F.lit("second")).alias("gb"))
    # bounded by the segment
    cut = named.groupBy("conv_id", "s").agg(
        F.sort_array(F.collect_list(F.struct("d", "key", "bytes", "ga", "gb"))).alias("path"),
        _xor("ga").alias("xa"), _xor("gb").alias("xb"))
    zero = F.lit(0).cast("long")
    none = convs.where("length = 0").select("conv_id", F.lit(0).alias("s"), F.slice(F.array(F.struct(
        zero.alias("d"), F.lit(b"").alias("key"), zero.alias("bytes"), zero.alias("ga"), zero.alias("gb"))), 1, 0).alias("path"),
        zero.alias("xa"), zero.alias("xb"))
    cut = cut.union(none).withColumn("ra", _xor("xa", True)).withColumn("rb", _xor("xb", True))
    depth = (F.col("s") * segment + F.size("path")).cast("long")
    return cut.join(convs, "conv_id").select(
        "s", "ra", "rb", F.col("ra").bitwiseXOR(F.col("xa")).alias("a"), F.col("rb").bitwiseXOR(F.col("xb")).alias("b"),
        depth.alias("depth"), "conv_id", (F.col("length") == depth).alias("last"), "path")


# ---------------------------------------------------------------- double arrays
class DoubleArray:
    """BASE and CHECK over dense symbols; state 0 is the top."""

    def __init__(self, symbols: int) -> None:
        self.base = np.zeros(max(64, 2 * symbols), np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.check[0] = 0
        self.free = 1                # no free slot below
        self.end = 1                 # all slots from here on are free

    def _room(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add_level(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Children for distinct (state, symbol) pairs, sorted by state then symbol; their slots."""
        slots = np.empty(len(states), np.int64)
        first = np.flatnonzero(np.append(True, states[1:] != states[:-1])) if len(states) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(states)))
        for i in np.flatnonzero(count > 1):                  # several children: first fit among the holes, else the end
            s, e = first[i], first[i] + count[i]
            self.base[states[s]] = base = self._fit(symbols[s:e])
            slots[s:e] = base + symbols[s:e]
            self._take(slots[s:e], states[s])
        one = first[count == 1]                              # one child: any free slot will do
        if len(one):
            self._room(self.end + len(one))
            holes = self.free + np.flatnonzero(self.check[self.free:self.end + len(one)] < 0)[:len(one)]
            slots[one] = holes
            self.base[states[one]] = holes - symbols[one]
            self.check[holes] = states[one]
            self.end = max(self.end, int(holes[-1]) + 1)
            self.free = int(holes[-1]) + 1
        return slots

    def _fit(self, symbols: np.ndarray) -> int:
        self._room(self.end + int(symbols[-1] - symbols[0]) + 2)
        holes = self.free + np.flatnonzero(self.check[self.free:self.end] < 0)[:32]
        for hole in holes.tolist():
            at = hole - symbols[0] + symbols
            if (self.check[at] < 0).all():
                return hole - int(symbols[0])
        return self.end - int(symbols[0])

    def _take(self, slots: np.ndarray, state: int) -> None:
        self.check[slots] = state
        self.end = max(self.end, int(slots[-1]) + 1)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child of each state by its symbol."""
        to = self.base[states] + symbols
        if (self.check[to] != states).any():
            raise ValueError("a path leaves the trie")
        return to


NODE_DDL = ("depth long, a long, b long, up_a long, up_b long, conv_id long, parent_conv_id long, n_convs long, bytes long, "
            "n_children long, n_leaves long, saved long, n_ends long, end_id long, shared boolean, hangs boolean")
NODE_COLUMNS = [c.split()[0] for c in NODE_DDL.split(", ")]


def shard_nodes(segment, s, ra, rb, counts, n, first, ends, end_id, keys, nbytes, ga, gb) -> dict[str, np.ndarray]:
    """Nodes of one shard. Segment i has counts[i] turns, of the flat keys, bytes and hashes; rows are sorted."""
    rows = len(s)
    start = np.cumsum(counts) - counts
    root_sym, root_of = np.unique(np.stack([s, ra, rb], 1), axis=0, return_inverse=True)
    turn_sym = np.unique(keys, return_inverse=True)[1] if len(keys) else np.zeros(0, np.int64)
    trie = DoubleArray(max(len(root_sym), int(turn_sym.max(initial=0)) + 1))
    state = np.zeros(rows, np.int64)
    levels = []
    for level in range(int(counts.max(initial=0)) + 1):       # level 0: the prefix before the segment
        on = np.flatnonzero(counts >= level)
        sym = root_of.reshape(-1)[on] if level == 0 else turn_sym[start[on] + level - 1]
        pairs, at = np.unique(np.stack([state[on], sym], 1), axis=0, return_index=True)
        slots = trie.add_level(pairs[:, 0], pairs[:, 1])
        state[on] = trie.step(state[on], sym)
        levels.append((slots, on[at]))                        # a segment that passes through each
    size = trie.end
    # traverse again with every segment, now for the counts
    zero = np.zeros(size, np.int64)
    conv, n_convs, n_bytes, a, b, depth = np.full(size, _BIG), zero.copy(), zero.copy(), zero.copy(), zero.copy(), zero.copy()
    shared = np.zeros(size, bool)
    marked = np.zeros(rows, bool)
    marked[[0, -1]] = True
    goes_on = n > ends
    marked |= goes_on
    state = np.zeros(rows, np.int64)
    for level, (slots, rep) in enumerate(levels):
        on = np.flatnonzero(counts >= level)
        sym = root_of.reshape(-1)[on] if level == 0 else turn_sym[start[on] + level - 1]
        state[on] = trie.step(state[on], sym)
        live = on if level else on[s[on] == 0]                # deeper segments' roots are counted where they end
        np.add.at(n_convs, state[live], n[live])
        np.minimum.at(conv, state[live], first[live])
        shared[state[on[marked[on]]]] = True
        up = trie.check[slots]
        depth[slots] = s[rep] * segment + level
        if level:
            item = start[rep] + level - 1
            n_bytes[slots] = nbytes[item]
            a[slots], b[slots] = a[up] ^ ga[item], b[up] ^ gb[item]
        else:
            a[slots], b[slots], shared[slots] = ra[rep], rb[rep], True
    n_ends, one = zero.copy(), np.full(size, _BIG)
    n_ends[state], one[state] = ends, np.where(ends > 0, end_id, _BIG)     # rows are distinct, so are their ends
    # sums from the leaves up; a shared node keeps what lies below it here, without itself
    children, leaves, saved_ = zero.copy(), zero.copy(), zero.copy()
    for level in range(len(levels) - 1, -1, -1):
        slots = levels[level][0]
        own = slots[~shared[slots]]
        leaves[own] += children[own] == 0
        saved_[own] += (n_convs[own] - 1) * n_bytes[own]
        if level:
            up = trie.check[own]
            np.add.at(children, up, 1)
            np.add.at(leaves, up, leaves[own])
            np.add.at(saved_, up, saved_[own])
    slots = np.concatenate([x for x, _ in levels])
    top = np.concatenate([np.full(len(x), k == 0) for k, (x, _) in enumerate(levels)])
    up = trie.check[slots]
    sh = shared[slots]
    return {"depth": depth[slots], "a": a[slots], "b": b[slots], "up_a": (a[up], ~top), "up_b": (b[up], ~top),
            "conv_id": (conv[slots], conv[slots] != _BIG), "parent_conv_id": (conv[up], ~top & ~shared[up]),
            "n_convs": n_convs[slots], "bytes": n_bytes[slots], "n_children": children[slots], "n_leaves": leaves[slots],
            "saved": saved_[slots], "n_ends": n_ends[slots], "end_id": (one[slots], one[slots] != _BIG), "shared": sh,
            "hangs": ~sh & shared[up]}


def _shards(segment: int, shard: int):
    """Sorted distinct segments to the nodes of their shards."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            out = shard_nodes(segment, *(np.concatenate(c) for c in zip(*held, strict=True)))
            arrays = [pa.array(v[0], mask=~v[1]) if isinstance(v, tuple) else pa.array(v) for v in (out[c] for c in NODE_COLUMNS)]
            return pa.RecordBatch.from_arrays(arrays, names=NODE_COLUMNS)

        for batch in it:
            if not batch.num_rows:
                continue
            path = batch.column(batch.schema.get_field_index("path"))
            counts = np.diff(np.asarray(path.offsets)).astype(np.int64)
            flat = path.flatten()
            data, off = _binary(flat.field("key"))
            keys = data[off[0]:off[-1]].copy().view("V16")
            items = [keys, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bytes", "ga", "gb"))]
            scalars = [c.to_numpy(zero_copy_only=False).astype(np.int64)
                       for c in T.keep_columns(batch, ["s", "ra", "rb"])]
            sums = [c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in T.keep_columns(batch, ["n", "first", "ends", "end_id"])]
            ends, a = np.cumsum(counts), 0
            weight = ends + np.arange(1, len(ends) + 1)          # an empty segment weighs too
            while a < len(counts):
                before = weight[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(weight, before + shard - size, "right")))
                x, y = int(ends[a] - counts[a]), int(ends[b - 1])
                held.append((*(c[a:b] for c in scalars), counts[a:b], *(c[a:b] for c in sums), *(c[x:y] for c in items)))
                size += int(weight[b - 1] - before)
                a = b
                if size >= shard:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def _binary(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return T.column(pa.RecordBatch.from_arrays([arr], names=["x"]), "x")


# ---------------------------------------------------------------- shared upper nodes
def _subtree_sums(upper: DataFrame) -> DataFrame:
    """``upper`` with n_leaves and saved summed over the nodes below, by pointer doubling.

    After k rounds a node has the sums of what lies less than 2^k below it, and
    its pointer leads 2^k up; adding the sums of the nodes that point at it
    doubles that. The rounds end when no pointer is left.
    """
    sums = upper.select("a", "b", "depth", "up_a", "up_b", F.when(F.col("up_a").isNotNull(), F.col("depth") - 1).alias("up"),
                        "n_leaves", "saved")
    sums = saved(sums, "trie-upper")
    while sums.where("up IS NOT NULL").limit(1).count():
        below = sums.where("up IS NOT NULL").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"), F.col("up").alias("depth")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        to = sums.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("depth").alias("up"),
                         F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"), F.col("up").alias("next"))
        sums = saved(sums.join(below, ["a", "b", "depth"], "left").join(to, ["up_a", "up_b", "up"], "left").select(
            "a", "b", "depth", F.col("next_a").alias("up_a"), F.col("next_b").alias("up_b"), F.col("next").alias("up"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "trie-upper")
    return sums.select("a", "b", "depth", "n_leaves", "saved")


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of id texts, sorted by node and run, to one digest a node."""
    name, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()),
                                           pa.array([name[2]], pa.int64()), pa.array([state.hexdigest()])],
                                          names=["a", "b", "depth", "digest"])

    for batch in it:
        for *now, text in zip(*(c.to_pylist() for c in T.keep_columns(batch, ["a", "b", "depth", "ids"])), strict=True):
            if now != name:
                if name is not None:
                    yield done()
                name, state = now, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if name is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, depth, digest) of the conversations (a, b, depth, conv_id) that end at each node."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    runs = ends.groupBy("a", "b", "depth", F.floor(F.col("conv_id") / ID_RUN).alias("run")).agg(ids.alias("ids"))
    # a digest is one sequence: its runs pass through one task as a stream, ID_RUN ids a row
    return runs.repartition("a", "b", "depth").sortWithinPartitions("a", "b", "depth", "run").mapInArrow(
        _digests, "a long, b long, depth long, digest string")


def prefix_trie(turns: DataFrame, *, span: int = 5, modulus: int = 9, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role and text. Conversation c starts with the
    first h turns of conversation c - c % span (h = crc32 of c, modulo ``modulus``)
    and goes on with its own turns after its first h.

    ``segment`` and ``shard`` bound the turns of a segment and of a shard; results do not depend on them.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), equal ones by role, then by the digest of
    their content; repeated rows each count. Null role or text is empty. Rows with a
    null conv_id belong to no conversation. An empty table has no members and so no
    nodes. Other columns are ignored.
    """
    rebuilt, convs = rebuilt_turns(turns, span, modulus)
    cut = saved(segments(rebuilt, convs, segment), "trie-segments")
    name = ["a", "b", "depth"]
    last = F.col("last").cast("long")
    distinct = cut.groupBy("s", "ra", "rb", *name).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first"), F.sum(last).alias("ends"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end_id"), F.first("path").alias("path"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["s", "ra", "rb", F.col("path.key")]
    nodes = saved(distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_shards(segment, shard), NODE_DDL), "trie-nodes")

    upper = nodes.where("shared").groupBy(*name).agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "n_ends")], F.max("bytes").alias("bytes"),
        F.min("end_id").alias("end_id"))
    kids = upper.where("up_a IS NOT NULL").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"),
                                                   (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    upper = upper.join(kids, name, "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    upper = saved(upper.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
                  .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).drop("kids"), "trie-shared")
    summed = upper.drop("n_leaves", "saved").join(_subtree_sums(upper), name)
    parent = upper.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"),
                          F.col("conv_id").alias("parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "n_ends", "end_id", "a", "b"]
    whole = nodes.where("NOT shared AND NOT hangs").select(*cols)
    # a node with very many children (the root) is met by them in SALTS tasks
    salt = F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int").alias("salt")
    salted = parent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    up = ["up_a", "up_b", "depth", "salt"]
    hung = nodes.where("hangs").drop("parent_conv_id").withColumn("salt", salt).join(salted, up, "left").select(*cols)
    merged = summed.withColumn("salt", salt).join(salted, up, "left").select(*cols)
    every = whole.unionByName(hung).unionByName(merged)

    several = every.where("n_ends > 1").select(*name)
    ends = cut.where("last").select(*name, "conv_id").join(several, name, "left_semi")
    out = [F.col(c).cast("long") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")]
    out.append(F.col("saved").cast("long").alias("saved_tokens"))
    single = F.when(F.col("n_ends") == 0, F.lit(EMPTY)).otherwise(F.sha2(F.col("end_id").cast("string").cast("binary"), 256))
    few = every.where("n_ends <= 1").select(*out, single.alias("ends_sha256"))
    many = every.where("n_ends > 1").join(end_digests(ends), name).select(*out, F.col("digest").alias("ends_sha256"))
    return few.unionByName(many)
