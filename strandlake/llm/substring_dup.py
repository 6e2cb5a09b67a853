"""Repeated lines and the sentences in them: hashes of normalised units, the earliest occurrence stays.

A unit is a line with a word in it, or a sentence of LEAST_WORDS words or more
in a line of several: copied passages need not begin and end with a line, so
that lines alone leave many of them whole; shorter sentences repeat by chance
within different lines. A unit is normalised (A-Z in lower case, runs of white
space as one space) and hashed to 128 bits; occurrences, be they lines or
sentences, are grouped by hash over all documents. The earliest in the order of
(doc_id, text digest, start) stays and all others go, also within one document.
A paragraph, whose lines then count as one unit, is the other choice of unit.

Spans are code points of the original text, the end exclusive. Rows of one
doc_id with equal texts are one document repeated, all of whose rows stay or
go; rows that share a doc_id, or have none, but differ in their texts are
documents of their own. A null doc_id ranks last. Null and empty texts have no
units, and an empty table gives an empty one. A text of any length is one row;
other columns, whatever their names, are passed on by cut_spans and not looked
at otherwise.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import join_checked, map_arrow, text_key, text_or_empty, written

#: Words of the shortest sentence that is looked up by itself.
LEAST_WORDS = 5

# A unit, and where a sentence ends within it.
UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"(?:[^\n]|\n(?!\s*\n))+")}
END = re.compile(r"[.!?]+(?=\s|$)|\n")


def spans_of(text: str, unit: str, sentences: bool, least_words: int):
    """Unit number, start, end, whether it is a sentence inside, and normalised words of all that is looked up in a text."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    for k, m in enumerate(UNITS[unit].finditer(low)):
        line, at = m[0], m.start()
        if words := line.split():
            yield k, at, m.end(), False, words
            if sentences and len(words) > least_words:
                s = 0
                for e in [x.end() for x in END.finditer(line)] + [len(line)]:
                    if least_words <= len(own := line[s:e].split()) < len(words):
                        yield k, at + s, at + e - (line[e - 1] == "\n"), True, own
                    s = e


def units(docs: DataFrame, unit: str = "line", sentences: bool = True, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, key (of the text), unit (its number), inner (a sentence), start, length (in code points) and the hash h1, h2."""

    def f(batch: pa.RecordBatch):
        of, number, inner, start, length, digests = [], [], [], [], [], []
        for d, text in enumerate(batch.column("text").to_pylist()):
            for k, s, e, inside, words in spans_of(text, unit, sentences, least_words):
                of.append(d)
                number.append(k)
                inner.append(inside)
                start.append(s)
                length.append(e - s)
                digests.append(xxhash.xxh3_128_digest(" ".join(words)))
        of, both = pa.array(of, pa.int32()), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(of), batch.column("key").take(of), pa.array(number, pa.int32()), pa.array(inner, pa.bool_()), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
            ["doc_id", "key", "unit", "inner", "start", "length", "h1", "h2"],
        )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), text_or_empty().alias("text"))
    return map_arrow(slim, f, "doc_id long, key long, unit int, inner boolean, start int, length int, h1 long, h2 long")


def _key():
    """The first eight bytes of the text's SHA-256, as a number in their order."""
    return F.conv(F.substring(F.hex(text_key()), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def repeated_units(docs: DataFrame, unit: str = "line", sentences: bool = True, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each removed occurrence: doc_id, start, end, keeper_doc_id, keeper_start, in original code points. Spans do not overlap."""
    return _repeated(docs, unit, sentences, least_words).drop("key")


def _repeated(docs: DataFrame, unit: str, sentences: bool, least_words: int) -> DataFrame:
    """Rows of repeated_units, with the key of the text.

    Either side of the join on a hash is a written table, so that one very
    common unit is a skewed partition that Spark splits. The earliest place of
    a sentence is never in a unit that goes, as the same unit stands earlier
    then: removed sentences need only be kept out of removed units.
    """
    found = written(units(docs, unit, sentences, least_words), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    keepers = found.groupBy("h1", "h2").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "keeper")
    again = found.join(written(keepers, "units-kept").hint("shuffle_merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("keeper")))
    gone = again.select("doc_id", "key", "unit", "inner", "start", (F.col("start") + F.col("length")).alias("end"), F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.start").alias("keeper_start"))
    if sentences:
        gone = written(gone, "units-gone")
        whole = written(gone.where("not inner").select("doc_id", "key", "unit").distinct(), "units-whole")
        gone = gone.where("not inner").unionByName(join_checked(gone.where("inner"), whole, ["doc_id", "key", "unit"], "left_anti"))
    return gone.drop("unit", "inner")


def cut_spans(docs: DataFrame, unit: str = "line", sentences: bool = True, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated units taken out of text; other columns as they were.

    A document that has nothing but white space left becomes an empty text.
    """
    gone = _repeated(docs, unit, sentences, least_words)
    lists = gone.groupBy(F.col("doc_id").alias("__doc__"), F.col("key").alias("__key__")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans__"))  # no more than a text has

    names = docs.columns

    def f(batch: pa.RecordBatch):
        spans, old, out = batch.column("__spans__").to_pylist(), batch.column("text"), []
        for text, own in zip(old.to_pylist(), spans, strict=True):
            if text is not None and own:
                kept, at = [], 0
                for s in own:
                    kept.append(text[at : s["start"]])
                    at = s["end"]
                text = "".join([*kept, text[at:]])
                text = text if text.strip() else ""
            out.append(text)
        new = pa.array(out, old.type)
        return pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in names], names)

    keyed = docs.withColumns({"__doc__": F.col("doc_id").cast("long"), "__key__": _key()})
    joined = join_checked(keyed, written(lists, "spans"), ["__doc__", "__key__"], "left").drop("__doc__", "__key__")
    return map_arrow(joined, f, docs.schema)
