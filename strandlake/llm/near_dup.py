"""Near-duplicates: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. One pass over the texts makes each one's shingle set, a digest of it and a
   SuperMinHash signature, kept as band keys.
2. Equal sets collapse to one representative.
3. In each band bucket every member is paired with the bucket's smallest member
   only, so a bucket makes as many candidates as it has members.
4. Candidates are verified on full sets; verified links form components.
5. Buckets that still span several components are compared in full, in blocks
   of bounded bytes and skipping pairs already in one component, so that no link
   is lost where the smallest member was not similar to all the others.

With 30 bands of 5 rows, two texts at a threshold of 0.85 share no bucket with
probability 2e-8, at 0.8 with 7e-6.

Null and empty texts have no shingles and are alone, as are texts of white
space. A null doc_id is in no group. Rows of one doc_id are one document, of
which one text is compared where they differ. An empty table gives an empty one. A very
long text is one row whose set must fit into a task. Other columns are not
looked at, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import give_back, join_checked, map_arrow, shared_folder, text_or_empty, written
from strandlake.llm.words import mix, shingle_sets

BANDS, ROWS = 30, 5
SLOTS = BANDS * ROWS
#: Bytes of shingle hashes in a block when a bucket is compared in full; a larger set is a block by itself or in company.
BLOCK_BYTES = 16 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def superminhash(hashes: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signature of each range of distinct hashes: texts x slots.

    Each element draws a random permutation of the slots and gives the slot at
    step j the value j plus a random fraction; a slot keeps its least value. So
    all steps of one element land in different slots, which lowers the
    variance. A text is done, and its elements stop, once all of its slots have
    a value, as later steps have greater ones. Values are 64-bit: the step in
    the top 8 bits, then the fraction.
    """
    n = len(at) - 1
    sizes = np.diff(at)
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    left = np.full(n, slots)
    text = np.repeat(np.arange(n), sizes)
    state = hashes
    swaps: list[np.ndarray] = []
    for j in range(slots):
        if not len(text):
            break
        draw = mix(state + _U(int(_STEP) * (j + 1) & (1 << 64) - 1))
        # a position from j on, and the slot that the swaps so far have put there
        pick = j + ((draw >> _U(40)) * _U(slots - j) >> _U(24)).astype(np.int16)
        slot = pick.copy()
        for i in range(j - 1, -1, -1):
            slot[slot == swaps[i]] = i
        swaps.append(pick)
        value = (_U(j) << _U(56)) | (mix(draw ^ _STEP) >> _U(8))
        cell = text * slots + slot
        free = out[cell] >> _U(56) >= _U(j)
        cell, value = cell[free], value[free]
        before = np.unique(cell[out[cell] == np.iinfo(np.uint64).max])
        np.minimum.at(out, cell, value)
        left -= np.bincount(before // slots, minlength=n)
        stay = left[text] > 0
        if not stay.all():
            text, state, swaps = text[stay], state[stay], [s[stay] for s in swaps]
    return out.reshape(n, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each text."""
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS)
    key = np.zeros((n, BANDS), np.uint64)
    for k in range(ROWS):
        key = mix(key * _STEP + parts[:, :, k] + _U(k + 1))
    return mix(key + np.arange(BANDS, dtype=np.uint64) * _STEP)


def set_digests(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128-bit digest of each sorted set."""
    import xxhash

    raw = hashes.tobytes()
    return [xxhash.xxh3_128_digest(raw[s * 8 : e * 8]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _longs(values: np.ndarray, per_row: int) -> pa.Array:
    flat = pa.array(values.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, per_row, dtype=np.int32)), flat)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_digest and bands of each text; texts without words have no digest."""

    def f(batch: pa.RecordBatch):
        hashes, at = shingle_sets(batch.column("text"))
        n = np.diff(at)
        full = n > 0
        bands = band_keys(superminhash(hashes, at))
        digests = pa.array(set_digests(hashes, at), pa.binary(), mask=~full)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), digests, _longs(bands, BANDS)], ["doc_id", "n_shingles", "set_digest", "bands"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), f, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    def f(batch: pa.RecordBatch):
        hashes, at = shingle_sets(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("rep"), _lists(hashes, at)], ["rep", "shingles"])

    return map_arrow(docs, f, "rep long, shingles array<long>")


def _local_forest(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars, by union-find."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[up]
            return x

        def out():
            own = [(x, r) for x in list(parent) if (r := root(x)) != x]
            if own:
                a, b = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 500_000:  # bounded memory; later rounds join what this cuts
                yield from out()
                parent.clear()
        yield from out()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node reachable, of edges a, b; nodes without edges are absent.

    Union-find within partitions, then rounds in which every node links its
    neighbours to the least of them (the greater ones, then the smaller ones)
    until nothing changes. Minima are aggregated before their shuffle and
    written before they are joined: the join then has two plain shuffles, and
    the partition of a node with very many neighbours can be split.
    """
    shared_folder(edges.sparkSession)
    links = _local_forest(edges.select("a", "b")).distinct().checkpoint()
    state = None
    while True:
        for greater in (True, False):
            both = links.unionAll(links.select("b", "a"))
            if greater:
                least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
                links = both.where("b > a").join(_plain(least), "a").select(F.col("m").alias("a"), "b")
            else:
                down = links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
                least = down.groupBy("b").agg(F.min("a").alias("m"))
                links = down.join(_plain(least), "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
            links = links.where("a <> b").distinct().checkpoint()
        now = links.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        state = now


def _plain(least: DataFrame) -> DataFrame:
    return written(least, "near-least", "lz4").hint("shuffle_merge")


def _similar(percent: int):
    """Column test on n_a, n_b and their common part."""
    return F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent


def near_dup_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Texts are linked where 100 times their common shingles are at least percent
    times all of theirs; component_id is the least doc_id reachable. Texts
    without words are alone. Rows of one doc_id are one document repeated; a
    null doc_id is in no group and its component_id is null, kept true.
    """
    sign = written(signatures(docs), "near-signatures")
    sized = sign.where("doc_id is not null and n_shingles > 0")
    reps = sized.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands"), "doc_id").alias("of"))
    reps = written(reps.select("set_digest", "rep", "of.*"), "near-representatives")

    # buckets with more than one representative; the least of each is its leader
    rows = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    least = F.min(F.struct("rep", "n"))
    buckets = written(rows.groupBy("key").agg(least.alias("l"), F.count("rep").alias("members")).where("members > 1").select("key", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n"), "members"), "near-bucket-leaders")
    members = written(rows.join(buckets.hint("shuffle_merge"), "key"), "near-buckets")
    possible = (F.least("n", "leader_n") * 100) >= (F.greatest("n", "leader_n") * percent)
    pairs = written(members.where("rep <> leader").where(possible).select("leader", "rep").distinct(), "near-pairs")
    open_ = members.where("members > 2").select("rep")  # may be compared once more
    needed = pairs.select("rep").unionAll(pairs.select("leader")).unionAll(open_).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().alias("text"))
    wanted = join_checked(texts, written(needed, "near-needed"), "rep", "left_semi")
    sets = written(_sets(wanted).dropDuplicates(["rep"]), "near-sets")

    a = sets.select(F.col("rep").alias("leader"), F.col("shingles").alias("s_a"))
    b = sets.select("rep", F.col("shingles").alias("s_b"))
    n_a, n_b = F.size("s_a").cast("long"), F.size("s_b").cast("long")
    tested = pairs.join(b, "rep").join(a, "leader").select("leader", "rep", n_a.alias("n_a"), n_b.alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))
    links = written(tested.where(_similar(percent)).select(F.col("leader").alias("a"), F.col("rep").alias("b")), "near-links")
    first = written(components(links), "near-components")

    more = _compare_open_buckets(members, first, sets, percent)
    if more is not None:
        first = written(components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b").unionAll(more)), "near-components")

    group = reps.select("set_digest", "rep").join(first, F.col("rep") == F.col("node"), "left").select("set_digest", F.coalesce("component", "rep").alias("component_id"))
    out = sign.select("doc_id", "n_shingles", "set_digest").join(group, "set_digest", "left")
    found = F.when(F.col("doc_id").isNull() | F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", found.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def _compare_open_buckets(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK_BYTES) -> DataFrame | None:
    """Links among members of buckets that span several components; None if there are no such buckets.

    A bucket of two is settled by its leader's test, and so are pairs with the
    leader. Equal buckets are compared once. Of a pair still to compare, one at
    least is outside of its bucket's largest component: those minor members are
    dealt in blocks of bounded bytes, all members in blocks too, and each pair
    of blocks meets in one task. With few minor members, as where a bucket is
    one large group and some strays, every member is sent once.
    """
    placed = written(members.where("members > 2").join(groups, F.col("rep") == F.col("node"), "left").select("key", "rep", F.col("n").alias("size"), F.coalesce("component", "rep").alias("c")), "near-placed")
    hashes = [F.sum(F.xxhash64(F.col("rep"), F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    whole = placed.groupBy("key").agg(F.count("rep").alias("n"), F.sum("size").alias("shingles"), F.min("c").alias("lo"), F.max("c").alias("hi"), *hashes)
    still = whole.where("lo < hi").groupBy("n", "shingles", "h1", "h2").agg(F.min("key").alias("key")).select("key", "shingles")
    still = written(still, "near-still")
    if still.isEmpty():
        return None
    rows = written(placed.join(still.hint("shuffle_merge"), "key"), "near-open-rows")  # each join on a bucket by itself, so that it can be split
    parts = rows.groupBy("key", "shingles", "c").agg(F.count("rep").alias("n"), F.sum("size").alias("own"))
    largest = parts.groupBy("key").agg(F.max(F.struct("own", "c")).alias("of"), F.max("shingles").alias("all"))
    blocks = lambda n: F.ceil(n * 8 / block).cast("int")
    largest = written(largest.select("key", F.col("of.c").alias("largest"), F.greatest(blocks(F.col("all")), F.lit(1)).alias("ny"), F.greatest(blocks(F.col("all") - F.col("of.own")), F.lit(1)).alias("nx")), "near-largest")
    rows = rows.join(largest.hint("shuffle_merge"), "key").withColumn("minor", F.col("c") != F.col("largest"))
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = rows.withColumn("y", own(F.col("ny"))).withColumn("x", upto("nx")).select("key", "x", "y", "rep", "c", F.lit(False).alias("minor"))
    minor = rows.where("minor").withColumn("x", own(F.col("nx"))).withColumn("y", upto("ny")).select("key", "x", "y", "rep", "c", "minor")
    meet = written(every.unionAll(minor), "near-open").join(sets, "rep")

    def compare(key, table):
        table = table.combine_chunks()
        rep, comp, minor = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "c", "minor"))
        lists = table.column("shingles").combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(at)
        every, parent = np.flatnonzero(~minor), {int(c): int(c) for c in comp}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        # where each hash stands among all members
        flat = np.concatenate([np.zeros(0, np.int64), *(values[at[k] : at[k + 1]] for k in every)])
        holder = np.repeat(np.arange(len(every)), size[every])
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], holder[order]
        found, left = [], len(parent)
        for i in np.flatnonzero(minor):
            mine = values[at[i] : at[i + 1]]
            lo, counts = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            counts -= lo
            upto, common = np.cumsum(counts), np.zeros(len(every), np.int64)
            for s in range(0, int(upto[-1]) if len(upto) else 0, 1 << 22):  # hits s to e, some at a time
                e = min(s + (1 << 22), int(upto[-1]))
                p, q = int(np.searchsorted(upto, s, "right")), int(np.searchsorted(upto, e, "left")) + 1
                step = np.arange(s, e) - np.repeat(upto[p:q] - counts[p:q], np.minimum(upto[p:q], e) - np.maximum(upto[p:q] - counts[p:q], s))
                common += np.bincount(holder[np.repeat(lo[p:q], np.minimum(upto[p:q], e) - np.maximum(upto[p:q] - counts[p:q], s)) + step], minlength=len(every))
            ok = common * 100 >= (size[every] + size[i] - common) * percent
            for k in every[ok]:
                p, q = root(int(comp[i])), root(int(comp[k]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((min(int(comp[i]), int(comp[k])), max(int(comp[i]), int(comp[k]))))
                    left -= 1
            if left == 1:
                break
        a, b = zip(*found, strict=True) if found else ((), ())
        if len(values) > 1 << 20:
            del table, lists, values, flat, holder, order
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(meet.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long"), "near-more")


def drop_near_dups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without those rows whose document is not the least of its group; columns as they were."""
    gone = near_dup_groups(docs, percent).where("not kept").select("doc_id").distinct()
    return join_checked(docs, written(gone, "near-gone"), "doc_id", "left_anti")
