"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles (64-bit hashes; the whole
sequence as one when it has fewer words). Its MinHash signature has
``coordinates`` values; each (coordinate, value) pair is a posting key.

* Documents with equal sets are one class (grouped by a 128-bit digest with
  partial aggregation), so a text held by a third of all rows is one entry.
* Prefix: two documents with at least ``matches`` equal coordinates share a
  key among the ``coordinates - matches + 1`` rarest keys of each (one global
  order: frequency, then key). Keys held by one class only count as rarest and
  are never posted, so a document without relatives leaves here.
* Length: a link needs sizes within ``threshold``; each key is split into
  geometric size classes, posted in its own and the next one.
* Skip: the other, longer lists are never merged. For a pair met in a prefix
  list they are probed: equal coordinates of the two signatures are counted,
  pairs below ``matches`` go, the rest is confirmed on the full sets.

Pairs are not all written out. A round links each list's leader (the most
central member) with the members outside the leader's component; links are
contracted to components; further rounds take other leaders. What may still be open, pairs
of one list in two components, is searched exactly over the full sets' rarest
shingles (``_open_pairs``). Pairs inside one component need no test: they
cannot change it.

``matches`` is the largest count that a pair at the threshold misses with a
chance of at most 1e-6 (``least_matches``): 27 of 48 at 0.85, 24 at 0.8. A pair
that has met in a list goes only below the count that it misses with 1e-12.

What a step leaves is written and read again as files, so small tables are few
tasks in the next step, and a table that a newer one replaces is removed.

Edge cases: null, empty or wordless text has no set, n_shingles 0 and is its
own component; repeated rows and ties stay, each with its row; the smallest
doc_id names a component (null ids only if there is no other); other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm import bitmap
from bourse.llm import textcols as T
from bourse.llm.lines import discard, saved

SHINGLE = 5
LEADER_TURNS = 2   # more turns leave less to the last search; the result is the same
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, 256, dtype=np.uint64)


def shingle_sets(d: np.ndarray, o: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block (with repeats) and the number of each document."""
    low = T.LOWER[d]
    s, e = T.spans(T.NOT_SPACE[low], o)
    doc = T.owners(o, s)
    n = len(o) - 1
    h = T.span_hash(T.prefix_hash(low), s, e)
    g, at = T.gram_hash(h, doc, k)
    owner = doc[at]
    words = np.bincount(doc, minlength=n)
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        first = np.cumsum(words) - words
        extra = np.zeros(len(short), np.uint64)
        for i, x in enumerate(short):
            for w in h[first[x]:first[x] + words[x]]:
                extra[i] = T.mix((extra[i:i + 1] * T._P + w))[0]
        extra = T.mix(extra + words[short].astype(np.uint64))
        where = np.searchsorted(owner, short)
        g, owner = np.insert(g, where, extra), np.insert(owner, where, short)
    return g, np.bincount(owner, minlength=n)


SIG_DDL = "doc_id long, text_key long, n_shingles long, digest binary, sig array<int>"


def _signer(coordinates: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = T.column(batch, "text")
            ids, keys = T.keep_columns(batch, ["doc_id", "text_key"])
            for i, j, d, o in T.blocks(data, off):
                g, counts = shingle_sets(d, o)
                ends = np.cumsum(counts)
                full = np.flatnonzero(counts)
                sig = np.zeros((len(full), coordinates), np.uint32)
                if len(full):
                    starts = (ends - counts)[full]
                    for c in range(coordinates):
                        sig[:, c] = np.minimum.reduceat((g * _A[c] + _B[c]) >> np.uint64(32), starts)
                n, digest = np.zeros(j - i, np.int64), [None] * (j - i)
                for x in full:
                    u = np.unique(g[ends[x] - counts[x]:ends[x]])
                    n[x], digest[x] = len(u), hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), keys.slice(i, j - i), pa.array(n), pa.array(digest, pa.binary()),
                     T.ragged(sig.view(np.int32).reshape(-1), np.where(counts > 0, coordinates, 0), pa.int32())],
                    names=["doc_id", "text_key", "n_shingles", "digest", "sig"])
    return run


def _set_batches(bits):
    """Sets of the rows whose id may be a candidate's."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hashes = T.keep_columns(batch, ["id_hash"])[0].to_numpy()
            batch = batch.filter(pa.array(bitmap.test(bits.value, hashes)))
            data, off = T.column(batch, "text")
            for _, _, d, o in T.blocks(data, off):
                g, counts = shingle_sets(d, o)
                ends = np.cumsum(counts)
                sets = [np.unique(g[e - c:e]) for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in sets], pa.binary()),
                     T.ragged(np.concatenate(sets).view(np.int64), np.array([len(u) for u in sets]), pa.int64())],
                    names=["digest", "shingles"])
    return run


def signatures(docs: DataFrame, coordinates: int) -> DataFrame:
    """doc_id, hash of the text, set size, set digest (null without a word) and signature of each row."""
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.withColumn("text_key", F.xxhash64("text")).mapInArrow(T.released(_signer(coordinates)), SIG_DDL)


def least_matches(threshold: float, coordinates: int, miss: float = 1e-6) -> int:
    """Equal coordinates that a pair at ``threshold`` has but for a chance of ``miss``."""
    total = 0.0
    for m in range(coordinates + 1):
        total += math.comb(coordinates, m) * threshold ** m * (1 - threshold) ** (coordinates - m)
        if total > miss:
            return max(1, m)
    return coordinates


def components(links: DataFrame) -> DataFrame:
    """(node, comp): every node of links (a, b) with the smallest node it reaches.

    Alternating large-star and small-star steps; each is one aggregate and one
    join over the edges, checkpointed, until every edge leads to a root.
    """
    edges = links = links.select("a", "b").where("a != b")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # small star: every edge now points from the larger to the smaller node
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "m").where("x != m").select(
            F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
        was, edges = edges, saved(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "near-edges")
        if was is not links:
            discard(was)
        # done when every node points at one root and no root points on
        points = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("root")).union(
            edges.select("b", F.lit(0), F.lit(1)))
        open_ = points.groupBy("a").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where(
            "out > 1 OR (out = 1 AND root = 1)")
        if open_.limit(1).count() == 0:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _matches() -> Column:
    equal = F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda a, x: a + x)


def _tested(pairs: DataFrame, sets: DataFrame, probe: int, percent: int) -> DataFrame:
    """The pairs (a, b) with ``linked``: probed on signatures, confirmed on full sets."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("shingles").alias(f"shingles_{x}"))

    inter = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - inter
    linked = F.when(_matches() >= probe, 100 * inter >= percent * union).otherwise(F.lit(False))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", linked.alias("linked"))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _leader_pairs(lists: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """Each list's leader with the members outside its component.

    The leader is the most central member (its keys are held most often, as
    those of the text that a group was copied from), after the first turn the
    most central one outside the list's largest component.
    """
    member = lists.join(label, "node")
    sizes = member.groupBy("list", "comp").agg(
        F.count("*").alias("k"), F.max(F.struct("central", F.xxhash64("node", F.lit(turn)).alias("order"), "node")).alias("lead"))
    per_list = sizes.groupBy("list").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top")).where("comps > 1")
    if turn:
        sizes = sizes.join(per_list.select("list", F.col("top.comp").alias("top")), "list").where("comp != top")
    lead = sizes.join(per_list.select("list"), "list", "left_semi").groupBy("list").agg(
        F.max(F.struct("lead", "comp")).alias("l")).select("list", F.col("l.lead.node").alias("leader"), F.col("l.comp").alias("of"))
    pairs = member.join(lead, "list").where("comp != of")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))


def _rarest_first(rows: DataFrame, elements: Column, *cols: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``size``, and ``found``: the elements that other rows hold too, rarest first; and the table it reads."""
    flat = saved(rows.select(*cols, F.size(elements).alias("size"), F.explode(elements).alias("list")), "near-elements")
    held = flat.groupBy("list").agg(F.count("*").alias("held")).where("held > 1")
    return (flat.join(held, "list").groupBy(*cols, "size")
            .agg(F.array_sort(F.collect_list(F.struct("held", "list"))).alias("found"))
            .withColumn("known", F.size("found"))), flat


def _joined(found: DataFrame, flat: DataFrame, long: Column, short: Column, enough: Column) -> DataFrame:
    """Pairs in two components that share an element of the larger one's ``long`` and the smaller one's ``short`` prefix.

    Own elements come first in the order, so a prefix reaches that many less of
    the shared ones. ``enough`` tells from (n, size, known) of both, the
    larger's with s_, whether what they can share at most suffices.
    """
    own = F.col("size") - F.col("known")
    posted = saved(found.withColumn("take", F.greatest(F.greatest(long, short) - own, F.lit(0)))
              .withColumn("few", short - own).withColumn("many", long - own)
              .select("node", "comp", "ref", "n", "size", "known", "few", "many",
                      F.posexplode(F.slice("found", F.lit(1), F.col("take"))).alias("at", "f"))
              .select("f.list", "node", "comp", "ref", "n", "size", "known", (F.col("at") < F.col("few")).alias("few"),
                      (F.col("at") < F.col("many")).alias("many")), "near-posted")
    mixed = posted.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("list")
    every, posted = posted, saved(posted.join(mixed, "list", "left_semi"), "near-posted")
    for one in (flat, every):
        discard(one)
    large = posted.where("many").select("list", *[F.col(c).alias(f"s_{c}") for c in ("node", "comp", "ref", "n", "size", "known")])
    pairs = (posted.where("few").join(large, "list").where("comp != s_comp")
             .where(F.struct("size", "node") < F.struct("s_size", "s_node")).where(enough))
    return pairs.select(F.least("node", "s_node").alias("a"), F.greatest("node", "s_node").alias("b"))


def _open_pairs(lists: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair that may still join two components.

    Every document of a list with several components has a reference, the most
    central leader of its lists, with which it has been tested. Two documents
    of one reference are compared by their differences from it (shingles more
    or less than the reference): sets x and y of D(x) and D(y) differences
    differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles. In two components
    they are not both linked to the reference, so a link needs shared
    differences, and copies of one text with edits of their own share few. Two
    documents of different references are compared by their shingles. Both are
    prefix joins on the rarest elements.
    """
    member = lists.join(label, "node")
    mixed = member.groupBy("list").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.max(F.struct("central", F.xxhash64("node", F.lit(0)).alias("order"), "node")).alias("lead")).where("lo != hi")
    open_ = (member.join(mixed.select("list", "lead"), "list").groupBy("node", "comp")
             .agg(F.max("lead").alias("lead")).select("node", "comp", F.col("lead.node").alias("ref")))
    rows = saved(sets.join(open_, "node").withColumn("n", F.size("shingles")), "near-open")
    lost, both = 100 - percent, 100 + percent

    def up(x: Column) -> Column:
        return F.ceil(x).cast("int")

    # shingles, for pairs of different references
    n = F.col("size")
    most = F.least("known", "s_known")
    plain = _joined(*_rarest_first(rows, F.col("shingles"), "node", "comp", "ref", "n"),
                    n - up(percent * n / 100) + 1, n - up(2 * percent * n / both) + 1,
                    (F.col("ref") != F.col("s_ref")) & _sizes_fit("n", "s_n", percent)
                    & (100 * most >= percent * (F.col("n") + F.col("s_n") - most)))
    # differences, for pairs of one reference; ~x is a shingle that is missing
    base = sets.select(F.col("node").alias("ref"), F.col("shingles").alias("base"))
    change = F.concat(F.array_except("shingles", "base"),
                      F.transform(F.array_except("base", "shingles"), lambda x: F.bitwise_not(x)))
    change = F.transform(change, lambda x: F.xxhash64("ref", x))
    changes = rows.join(base, "ref").select("node", "comp", "ref", "n", change.alias("change")).where(F.size("change") > 0)
    room = F.floor(F.col("n") * lost / percent).cast("int")     # differences that a link leaves at most
    shared = F.greatest(up(n * (both - lost) / (2 * both) - 1e-9), n - F.floor(room / 2).cast("int"), F.lit(1))
    enough = 2 * most >= F.col("size") + F.col("s_size") - (F.col("n") + F.col("s_n")) * lost / both - 1e-9
    near = _joined(*_rarest_first(changes, F.col("change"), "node", "comp", "ref", "n"),
                   n - F.greatest(n - room, F.lit(1)) + 1, n - shared + 1, _sizes_fit("n", "s_n", percent) & enough)
    discard(rows)
    return plain.union(near)


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, coordinates: int = 48) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (hash of the text), n_shingles, component_id and kept."""
    percent = round(100 * threshold)
    matches = least_matches(threshold, coordinates)
    probe = least_matches(threshold, coordinates, 1e-12)        # loses no link that a list has brought
    rows = saved(signatures(docs, coordinates), "near-signatures")
    classes = saved(rows.where(F.col("digest").isNotNull()).groupBy("digest")
               .agg(F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"),
                    F.any_value("sig").alias("sig"))
               .withColumn("node", F.monotonically_increasing_id()), "near-classes")
    # keys held by two classes or more, and the prefix of each class
    keys = classes.select("node", "n_shingles", F.posexplode("sig").alias("c", "v")).select(
        "node", "n_shingles", (F.shiftleft(F.col("c").cast("long"), 32)
                               + F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    prefix = coordinates - matches + 1
    posted = (keys.join(shared, "key").groupBy("node", "n_shingles")
              .agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("found"))
              .where(F.size("found") >= matches)
              .withColumn("central", F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["held"]))
              .select("node", "n_shingles", "central",
                      F.explode(F.slice("found", 1, F.size("found") - F.lit(coordinates - prefix))).alias("f")))
    size_class = F.floor(F.log("n_shingles") / float(-np.log(threshold)) + 1e-9)
    lists = saved(posted.select("node", "central", F.explode(F.array(size_class, size_class + 1)).alias("size"), F.col("f.key"))
             .select("node", "central", F.xxhash64("key", "size").alias("list")).distinct(), "near-postings")
    every, lists = lists, saved(lists.join(lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "list").select(
        "list", "node", "central"), "near-lists")
    discard(every)
    wanted = lists.select("node").distinct()
    sigs = saved(classes.join(wanted, "node", "left_semi"), "near-candidates")
    # texts stay where they are: a row whose id may be a candidate's gives its set, and the digest decides
    bits = docs.sparkSession.sparkContext.broadcast(bitmap.build(sigs, F.xxhash64("first_id")))      # 2 MB at any size
    found = (docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("id_hash"), F.col("text").cast("string"))
             .mapInArrow(T.released(_set_batches(bits)), "digest binary, shingles array<bigint>"))
    sets = saved(found.dropDuplicates(["digest"]).join(sigs.select("digest", "node", "sig"), "digest")
                 .select("node", "sig", "shingles"), "near-sets")

    label = saved(sigs.select("node", F.col("node").alias("comp")), "near-labels")
    discard(sigs)
    tested, tables = None, []
    for turn in range(LEADER_TURNS + 1):
        pairs = (_leader_pairs(lists, label, turn) if turn < LEADER_TURNS else _open_pairs(lists, label, sets, percent)).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        now = saved(_tested(pairs, sets, probe, percent), "near-tested")
        tested = now if tested is None else tested.union(now)
        tables.append(now)
        # only this turn's links, between the components so far, which they merge
        a, b = (label.select(F.col("node").alias(x), F.col("comp").alias(f"of_{x}")) for x in "ab")
        links = now.where("linked").join(a, "a").join(b, "b").where("of_a != of_b").select(
            F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
        found = components(saved(links, "near-links")).select(F.col("node").alias("comp"), F.col("comp").alias("found"))
        was, label = label, saved(label.join(found, "comp", "left").select("node", F.coalesce("found", "comp").alias("comp")), "near-labels")
        discard(was)
    named = saved(classes.select("digest", "first_id", "node").join(label, "node", "left").select(
        "digest", "first_id", F.coalesce("comp", "node").alias("comp")), "near-named")
    for one in (lists, sets, label, classes, *tables):
        discard(one)
    first = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(first, "comp").select(F.col("digest").alias("of"), "component_id")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (rows.select("doc_id", "text_key", "n_shingles", "digest")
            .join(by_class, F.col("digest") == F.col("of"), "left")
            .select("doc_id", "text_key", "n_shingles", own.alias("component_id"),
                    F.col("doc_id").eqNullSafe(own).alias("kept")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: its smallest doc_id; columns stay.

    Rows without words are linked with nothing and all stay. Of rows with a
    null doc_id each different text stays, unless it belongs to a component
    with an id.
    """
    found = near_duplicates(docs, **options).where("kept").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = F.when(F.col("component_id").isNull(), F.col("text_key")).alias("alone")
    worded = found.where("n_shingles > 0").groupBy("component_id", alone).agg(F.min("text_key").alias("text_key"))
    stay = (worded.select(F.col("component_id").alias("__of"), F.col("text_key").alias("__key"), F.lit(True).alias("__once"))
            .union(found.where("n_shingles = 0").select("doc_id", "text_key", F.lit(False)).distinct()))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    kept = docs.join(stay, own)
    # a row that is repeated as a whole stays once; their number is that of the repeats, not of the copies
    once = kept.where("__once").dropDuplicates(["__of", "__key"])
    return once.unionByName(kept.where("NOT __once")).select(*[F.col(f"`{c}`") for c in docs.columns])
