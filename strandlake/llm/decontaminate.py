"""Benchmark passages in documents: MinHash containment by size classes, verified on full shingle sets.

A document's signature is a MinHash of one permutation: the hash space is cut
into bins, and each bin keeps the document's least shingle. An item inside a
document shares the bin's minimum wherever one of its shingles is that minimum,
so what an item needs is bins that are not much fewer than the document's
shingles, however long the document is. Documents are therefore partitioned by
size, their bins doubling from class to class, and items by theirs: one that
must share c shingles needs each to survive with a chance of no more than
2^-(32/c) against it, so that its class has 32/c - 1 more doublings. Long items
find a document by a coarse signature, an item of one shingle has bins so fine
that every shingle of the document is a minimum. An item that a document
contains is missed with probability below 2^-32, at any size of the two.

Signatures are looked up in two steps. A bit table of fixed bounded size, made
of the items' shingles, keeps out most minima where they are made; those that
pass are joined with the items' shingles. Candidates are verified: a document's
whole set against the item's whole set. Items, like documents, are tables of any
size; the documents are read twice, however many items there are.

Null and empty items, and those without words, match nothing; items of fewer
than five words are one shingle and only match texts of the same words. Rows of
one item_id with different texts are items of their own. Rows of one doc_id are
each looked at, as are those without one; null and empty texts contain nothing.
A very long text is one row whose set must fit into a task. Empty tables give
an empty one. Other columns are passed on by decontaminate and not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import join_checked, map_arrow, text_key, text_or_empty, written
from strandlake.llm.words import shingle_sets

#: Share of an item's shingles, in percent, that a document must have.
PERCENT = 80
#: Bits of a miss, and of the largest table that tells items' shingles from others.
MISS_BITS, TABLE_BITS = 32, 24
#: Parts of the bit tables that the driver puts together.
PARTS = 4

_U = np.uint64


def item_class(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Doublings beyond one bin for each of a document's shingles that items of so many shingles need."""
    must = np.maximum(-(-np.asarray(n) * percent // 100), 1)
    return -(-MISS_BITS // must) - 1


def bin_bits(n_doc: int, extra: int) -> int:
    """Bits of the bin number for a document of so many shingles and an item class."""
    return min(64, max(1, (max(n_doc, 1) - 1).bit_length()) + extra)


def bin_minima(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Marks those of sorted hashes that are the least in their bin, a bin being the top bits."""
    first = np.ones(len(hashes), bool)
    if bits < 64:
        top = hashes >> _U(64 - bits)
        first[1:] = top[1:] != top[:-1]
    return first


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a bit table, from other bits of the hash than a bin's."""
    return ((hashes * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)


def item_rows(items: DataFrame, percent: int) -> DataFrame:
    """item (a number for this run), item_id, n_item, extra (its class) and shingles of each item with words."""

    def f(batch: pa.RecordBatch):
        hashes, at = shingle_sets(batch.column("text"))
        n = np.diff(at)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
        out = pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(n), pa.array(item_class(n, percent).astype(np.int32)), lists], ["item_id", "n_item", "extra", "shingles"])
        return out.filter(pa.array(n > 0))

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    found = map_arrow(texts, f, "item_id long, n_item long, extra int, shingles array<long>")
    return written(found, "items").withColumn("item", F.xxhash64("item_id", "shingles"))


def bit_tables(items: DataFrame) -> dict[int, np.ndarray]:
    """For each class of items a table of bits that their shingles set, no larger than 2^TABLE_BITS bits."""
    sizes = {r.extra: r.n for r in items.groupBy("extra").agg(F.sum("n_item").alias("n")).collect()}  # no more than MISS_BITS rows
    bits = {k: int(min(TABLE_BITS, max(10, int(n).bit_length() + 9))) for k, n in sizes.items()}

    def run(batches):
        held = {}
        for b in batches:
            extra, lists = b.column("extra").to_numpy(), b.column("shingles")
            size = np.diff(lists.offsets.to_numpy())
            flat, of = lists.flatten().to_numpy().view(np.uint64), np.repeat(extra, size)
            for k in np.unique(extra).tolist():
                held.setdefault(k, np.zeros(1 << bits[k], bool))[_cells(flat[of == k], bits[k])] = True
        for k, t in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(t).tobytes()], pa.binary())], ["extra", "bits"])

    out = {k: np.zeros((1 << b) // 8, np.uint8) for k, b in bits.items()}
    for r in items.select("extra", "shingles").coalesce(PARTS).mapInArrow(run, "extra int, bits binary").toLocalIterator():  # PARTS rows a class, of bounded size
        out[r.extra] |= np.frombuffer(r.bits, np.uint8)
    return out


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    cells = _cells(hashes, len(table).bit_length() + 2)
    return table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1 > 0


def candidates(slim: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, key and item of pairs that share a minimum of the document's signature for the item's class.

    A minimum of coarse bins is one of finer bins too: each goes out once, with
    the coarsest class that has it.
    """
    tables = slim.sparkSession.sparkContext.broadcast(sorted(bit_tables(items).items()))  # at most 10 tables of 2 MB

    def f(batch: pa.RecordBatch):
        hashes, at = shingle_sets(batch.column("text"))
        least, live = np.full(len(hashes), 127, np.int32), np.zeros(len(hashes), bool)
        for extra, table in reversed(tables.value):
            minima = np.zeros(len(hashes), bool)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                minima[s:e] = bin_minima(hashes[s:e], bin_bits(e - s, extra))
            least[minima] = extra
            live[minima] |= _known(table, hashes[minima])
        of = pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at))[live])
        return pa.table([batch.column("doc_id").take(of), batch.column("key").take(of), pa.array(least[live]), pa.array(hashes[live].view(np.int64))], ["doc_id", "key", "least", "hash"])

    minima = written(map_arrow(slim, f, "doc_id long, key binary, least int, hash long"), "item-minima")
    index = written(items.select("extra", F.explode("shingles").alias("hash"), "item"), "item-index")
    return join_checked(minima, index, "hash", "inner").where("extra >= least").select("doc_id", "key", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, common, n_item and containment for each item that a document contains."""
    return _contaminated(docs, items, percent).drop("key")


def _contaminated(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Rows of contaminated, with the key of the text, as rows may share a doc_id."""
    schema = "doc_id long, key binary, item_id long, common long, n_item long, containment double"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_or_empty().alias("text"))
    items = item_rows(items, percent)
    found = written(candidates(slim, items), "item-candidates")
    of = join_checked(found, items.select("item", "item_id", "shingles"), "item", "inner")
    lists = of.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item_id", "shingles")).alias("items"))  # those that one text may contain
    held = join_checked(slim, written(lists, "item-lists"), ["doc_id", "key"], "inner")

    def f(batch: pa.RecordBatch):
        own, at = shingle_sets(batch.column("text"))
        rows = []
        for d, (s, e, wanted) in enumerate(zip(at[:-1], at[1:], batch.column("items"), strict=True)):
            doc = own[s:e]
            for x in wanted.values.to_pylist():
                want = np.array(x["shingles"], np.int64).view(np.uint64)
                common = int((doc[np.minimum(np.searchsorted(doc, want), len(doc) - 1)] == want).sum())
                if common * 100 >= len(want) * percent:
                    rows.append((d, x["item_id"], common, len(want), common / len(want)))
        c = list(zip(*rows, strict=True)) if rows else [()] * 5
        of = pa.array(c[0], pa.int32())
        return pa.table([batch.column("doc_id").take(of), batch.column("key").take(of), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64())], ["doc_id", "key", "item_id", "common", "n_item", "containment"])

    return map_arrow(held, f, schema)


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without those that contain an item; columns as they were. Of rows that share a doc_id, or have none, only those whose text does go."""
    gone = _contaminated(docs, items, percent).select(F.col("doc_id").alias("__doc__"), F.col("key").alias("__key__")).distinct()
    keyed = docs.withColumns({"__doc__": F.col("doc_id").cast("long"), "__key__": text_key()})
    return join_checked(keyed, written(gone, "contaminated"), ["__doc__", "__key__"], "left_anti").select(docs.columns)
