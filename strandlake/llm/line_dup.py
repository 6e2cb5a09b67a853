"""Content-defined line chunks that repeat, compared byte by byte and taken out.

Each line is hashed; a rolling hash runs over the hashes of WINDOW lines. It
cuts a text at two scales. At the coarse one a chunk ends where the rolling
hash has COARSE_BITS zero bits, about one line in eight, so that its ends move
with the lines around them and not with their number. At the fine one every
place is an end: a chunk is the lines under the rolling hash, from each line on.

Chunks of two lines or more are grouped by digest over all texts. Each one that
occurs elsewhere is read again from its text and compared byte by byte with the
earliest, the one with the least (doc_id, text digest, start); it goes if equal.
Coarse chunks settle long copies in one piece: fine chunks inside of one that
goes are not compared again. A run of two lines or more stands in an earlier
place exactly if each fine chunk of it does, so that its edges, and runs that
hold no whole coarse chunk, are found whatever stands around them. The first
occurrence of a line always stays.

Only lines that are not blank are counted and hashed. Blank ones between the
lines of a chunk belong to it, those around it do not, and stay.

A row is known by doc_id and a digest of its text: rows with both alike are one
document, rows that share a doc_id, or have none, are not. A null doc_id ranks
last. Null and empty texts have no chunks, an empty table gives an empty one,
other columns are never looked at. A text of any length is cut and read in one
row of its own; what is held for it grows with its lines.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import join_checked, map_arrow, text_key, text_or_empty, written

#: Lines under the rolling hash, which is also the shortest chunk; zero bits of it where a coarse chunk ends.
WINDOW, COARSE_BITS = 2, 3

_FULL = re.compile(r"[^\x20\x09-\x0D]")
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _lines(data: bytes) -> tuple[list[bytes], list[int]]:
    """Lines without their ends, and where each begins with the text's end as the last."""
    lines = data.split(b"\n")
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    at[-1] = len(data)
    if not lines[-1]:
        lines.pop()
        at.pop()
        at[-1] = len(data)
    return lines, at


def boundaries(lines: list[bytes]) -> list[int]:
    """Line numbers at which coarse chunks end, each settled by the WINDOW lines before it; the last line's too."""
    own, out, roll = [xxhash.xxh3_64_intdigest(x) for x in lines], [], 0
    power = pow(_STEP, WINDOW, 1 << 64)
    for k, h in enumerate(own):
        roll = (roll * _STEP + h - (own[k - WINDOW] * power if k >= WINDOW else 0)) & _MASK
        mixed = (roll ^ roll >> 29) * _STEP & _MASK
        if k + 1 >= WINDOW and mixed >> (64 - COARSE_BITS) == 0:
            out.append(k + 1)
    return out if out and out[-1] == len(lines) else [*out, len(lines)]


def line_chunks(data: bytes) -> list[tuple[int, int]]:
    """Start byte and end byte (after the last line end) of each coarse and fine chunk, each once."""
    lines, at = _lines(data)
    full = [k for k, x in enumerate(lines) if x.strip()]
    ends = boundaries([lines[k] for k in full])
    spans = dict.fromkeys((s, e) for s, e in zip([0, *ends], ends, strict=False) if e - s > WINDOW)
    spans |= dict.fromkeys((k, k + WINDOW) for k in range(len(full) - WINDOW + 1))
    return [(at[full[s]], at[full[e - 1] + 1]) for s, e in spans]


def _content(text: bytes, start: int, end: int) -> bytes:
    """The lines of a chunk without the last line end, as a text's last line has none."""
    return text[start:end].removesuffix(b"\n")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key, start and end byte and digest d1, d2 of each chunk."""

    def f(batch: pa.RecordBatch):
        rows, spans, digests = [], [], []
        for k, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            for s, e in line_chunks(data):
                rows.append(k)
                spans.append((s, e))
                digests.append(xxhash.xxh3_128_digest(_content(data, s, e)))
        at = pa.array(rows, pa.int32())
        s, e = (pa.array(c, pa.int32()) for c in (zip(*spans, strict=True) if spans else ((), ())))
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), s, e, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "key", "start", "end", "d1", "d2"])

    return map_arrow(_slim(docs), f, "doc_id long, key binary, start int, end int, d1 long, d2 long")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_or_empty().alias("text"))


def _apart(own: list[dict]) -> list[dict]:
    """Chunks of a text to compare: those that stay for others, and those that go but are inside of no longer one that goes."""
    out, reach = [], 0
    for x in sorted(own, key=lambda x: (x["start"], -x["end"])):
        if not x["keeps"]:
            if x["end"] <= reach:
                continue
            reach = x["end"]
        out.append(x)
    return out


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, end (bytes of the UTF-8 text), keeper_doc_id, keeper_key and keeper_start of each chunk that goes.

    Joins on a digest have a written table on either side, so that one very
    common chunk is a skewed partition that Spark splits.
    """
    rows = written(chunk_rows(docs), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    known = rows.groupBy("d1", "d2").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "keeper")
    known = written(known, "chunks-known")
    again = written(rows.join(known.hint("shuffle_merge"), ["d1", "d2"]).withColumn("keeps", place.eqNullSafe(F.col("keeper"))).drop("keeper"), "chunks-again")

    # the bytes of these chunks only, from one more pass over their documents
    lists = again.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end", "d1", "d2", "keeps")).alias("spans"))  # no more than a text has
    held = join_checked(_slim(docs), written(lists, "chunk-spans"), ["doc_id", "key"], "inner")

    def take(batch: pa.RecordBatch):
        rows, cols, data = [], [], []
        for k, (text, own) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)):
            for x in _apart(own):
                rows.append(k)
                cols.append((x["start"], x["end"], x["d1"], x["d2"], x["keeps"]))
                data.append(_content(text, x["start"], x["end"]))
        at = pa.array(rows, pa.int32())
        c = list(zip(*cols, strict=True)) if cols else [()] * 5
        return pa.table({"doc_id": batch.column("doc_id").take(at), "key": batch.column("key").take(at), "start": pa.array(c[0], pa.int32()), "end": pa.array(c[1], pa.int32()), "d1": pa.array(c[2], pa.int64()), "d2": pa.array(c[3], pa.int64()), "keeps": pa.array(c[4], pa.bool_()), "data": pa.array(data, pa.binary())})

    data = written(map_arrow(held, take, "doc_id long, key binary, start int, end int, d1 long, d2 long, keeps boolean, data binary"), "chunk-bytes")
    first = data.where("keeps").dropDuplicates(["d1", "d2"]).select("d1", "d2", F.col("data").alias("kept_data"), F.col("doc_id").alias("keeper_doc_id"), F.col("key").alias("keeper_key"), F.col("start").alias("keeper_start"))
    first = written(first, "chunk-firsts")
    equal = data.where("not keeps").join(first.hint("shuffle_merge"), ["d1", "d2"]).where("data = kept_data")
    return equal.select("doc_id", "key", "start", "end", "keeper_doc_id", "keeper_key", "keeper_start")


def _runs(own, text: bytes) -> list[dict]:
    """Chunks as runs that do not overlap: one goes on as long as its lines and its keeper's do.

    Where a run ends a text that has no last line end, the line end before it goes too.
    """
    out: list[dict] = []
    for x in sorted(own, key=lambda x: (x["start"], -x["end"])):
        x, last = dict(x), out[-1] if out else None
        if last and x["end"] <= last["end"]:
            continue
        same = last and x["keeper_doc_id"] == last["keeper_doc_id"] and x["keeper_key"] == last["keeper_key"]
        if same and x["start"] <= last["end"] and x["keeper_start"] - x["start"] == last["keeper_start"] - last["start"]:
            last["end"] = x["end"]
            continue
        if last and x["start"] < last["end"]:
            x["keeper_start"] += last["end"] - x["start"]
            x["start"] = last["end"]
        out.append(x)
    if out and out[-1]["end"] == len(text) and not text.endswith(b"\n"):
        k = len(out) - 1
        while k and out[k - 1]["end"] == out[k]["start"]:
            k -= 1
        if text[: out[k]["start"]].endswith(b"\n"):
            out[k]["start"] -= 1
            out[k]["keeper_start"] -= 1
    return out


def _cut(text: bytes, own) -> bytes:
    """The text without the runs own."""
    kept, at = [], 0
    for x in own:
        kept.append(text[at : x["start"]])
        at = x["end"]
    return b"".join([*kept, text[at:]])


def with_removed(docs: DataFrame, name: str = "removed") -> DataFrame:
    """docs plus a column, an array of start, end, keeper_doc_id, keeper_key, keeper_start of chunks in bytes of the text; null where nothing repeats."""
    gone = repeated_chunks(docs)
    of = F.struct("start", "end", "keeper_doc_id", "keeper_key", "keeper_start")
    lists = gone.groupBy(F.col("doc_id").alias("__doc__"), F.col("key").alias("__key__")).agg(F.collect_set(of).alias(name))  # no more than a text has
    keyed = docs.withColumns({"__doc__": F.col("doc_id").cast("long"), "__key__": text_key()})
    return join_checked(keyed, written(lists, "chunk-lists"), ["__doc__", "__key__"], "left").drop("__doc__", "__key__")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated runs of lines; columns as they were, with n_chars, if there is one, of the text that remains.

    A document of which nothing remains is left out: earlier documents have
    all of its lines. Empty and null texts stay as they are.
    """
    names, gone = docs.columns, "__removed__"

    def f(batch: pa.RecordBatch):
        removed = batch.column(gone)
        if removed.null_count == len(removed):
            return batch.select(names)
        runs, old = removed.to_pylist(), batch.column("text")
        texts = [t if r is None else _cut(b := t.encode(), _runs(r, b)).decode("utf-8", "replace") for t, r in zip(old.to_pylist(), runs, strict=True)]
        new = {"text": pa.array(texts, old.type)}
        if "n_chars" in names:
            n = batch.column("n_chars")
            new["n_chars"] = pa.array([x if r is None else len(t) for x, t, r in zip(n.to_pylist(), texts, runs, strict=True)], n.type)
        out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)
        return out.filter(pa.array([r is None or _FULL.search(t) is not None for t, r in zip(texts, runs, strict=True)]))

    return map_arrow(with_removed(docs, gone), f, docs.schema)


def _ranges(own: list[dict]) -> list[tuple[int, int]]:
    """Start and end of what goes, runs that touch as one."""
    out: list[tuple[int, int]] = []
    for x in own:
        if out and out[-1][1] == x["start"]:
            out[-1] = out[-1][0], x["end"]
        else:
            out.append((x["start"], x["end"]))
    return out


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (byte ranges that go), removed_bytes, kept_bytes, kept_sha256 (of the text that remains) and spans (the ranges, as start:end) for each row of docs."""

    def f(batch: pa.RecordBatch):
        import hashlib

        texts = batch.column("text").cast(pa.binary()).to_pylist()
        removed = [_runs(r or (), t) for t, r in zip(texts, batch.column("removed").to_pylist(), strict=True)]
        kept, ranges = [_cut(t, r) for t, r in zip(texts, removed, strict=True)], [_ranges(r) for r in removed]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(r) for r in ranges], pa.int64()),
                pa.array([sum(e - s for s, e in r) for r in ranges], pa.int64()),
                pa.array([len(k) for k in kept], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                pa.array([",".join(f"{s}:{e}" for s, e in r) for r in ranges]),
            ],
            ["doc_id", "n_removed", "removed_bytes", "kept_bytes", "kept_sha256", "spans"],
        )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(with_removed(slim), f, "doc_id long, n_removed long, removed_bytes long, kept_bytes long, kept_sha256 string, spans string")
