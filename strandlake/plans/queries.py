"""The queries that the driver runs, each with SQL that gives the same rows."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import functions as fn
from strandlake.operators import lookup, metrics
from strandlake.operators.dedup import dedup_scan, file_order, first_match, last_wins
from strandlake.operators.store import SequenceStore, load_scan
from strandlake.sources import binary, sinks
from strandlake.sources.fasta import scan_fasta
from strandlake.sources.fastq import scan_fastq
from strandlake.sources.paths import file_size, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Residues and qualities that are a function of the part key, the same in both engines.
GEN = """
select cast(p_partkey as bigint) as k, concat('p', cast(p_partkey as varchar(20))) as id,
  case p_partkey % 3
    when 0 then translate(md5(cast(p_partkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT')
    when 1 then translate(md5(cast(p_partkey as varchar(20))), '0123456789abcdef', 'ACGUACGUACGUACGU')
    else translate(md5(cast(p_partkey as varchar(20))), '0123456789abcdef', 'ARNDCQEGHILKMFPS')
  end as sequence,
  translate(md5(concat('q', cast(p_partkey as varchar(20)))), '0123456789abcdef', '!#%+5:?@ABCDEFHI') as quality
from part"""
KIND = """case when contains(upper(sequence), 'U') then 'RNA'
  when length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 0
   and length(regexp_replace(sequence, '[^ATGCUNatgcun]', '', 'g'))::double / length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 0.8
  then 'DNA' else 'PROTEIN' end"""
DOCS = "select concat('doc', cast(doc_id as varchar)) as id, replace(text, chr(10), '') as sequence from documents"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN by the engine's own functions."""
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    from strandlake.functions.synth import PROTEIN, RNA

    dna, rna, protein = fn.synthetic_dna(key), fn.synthetic_dna(key, alphabet=RNA), fn.synthetic_dna(key, alphabet=PROTEIN)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), F.concat(F.lit("p"), key).alias("id"), F.when(kind == 0, dna).when(kind == 1, rna).otherwise(protein).alias("sequence"), fn.synthetic_quality(key).alias("quality"))


def doc_id(column: str = "doc_id"):
    return F.concat(F.lit("doc"), F.col(column).cast("string"))


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(doc_id().alias("id"), F.col("text").alias("sequence"), F.lit("").alias("quality"))


def pairs_of(frame: DataFrame, key, data) -> DataFrame:
    none = F.lit(None).cast("binary")
    return frame.select(key.alias("key"), F.lit("FASTA").alias("kind"), fn.encode_payload(data).alias("data"), none.alias("sequence"), none.alias("quality"))


# scans


@query(DOCS)
def fasta_scan(spark, sf_dir):
    """Documents written as FASTA with their own line breaks and read back."""
    docs, at = table(spark, sf_dir, "documents"), scratch(spark, "fasta")
    sinks.write_text(docs.select(sinks.fasta_text(doc_id(), F.col("text"), " a document").alias("r")), "r", at)
    return dedup_scan(scan_fasta(spark, at)).select("id", "sequence")


def _gen_fasta(spark, sf_dir, end="\n", gzip=False, wrap=10):
    at = scratch(spark, "fasta")
    sinks.write_text(gen(spark, sf_dir).select(sinks.fasta_text(F.col("id"), F.col("sequence"), " made", wrap, end).alias("r")), "r", at, gzip, end)
    return dedup_scan(scan_fasta(spark, at)).select("id", "sequence")


@query(f"select id, sequence from ({GEN})")
def fasta_multiline_scan(spark, sf_dir):
    return _gen_fasta(spark, sf_dir)


@query(f"select id, sequence from ({GEN})")
def fasta_crlf_scan(spark, sf_dir):
    return _gen_fasta(spark, sf_dir, end="\r\n")


@query(f"select id, sequence from ({GEN})")
def fasta_gzip_scan(spark, sf_dir):
    return _gen_fasta(spark, sf_dir, gzip=True)


def _gen_fastq(spark, sf_dir, mode="validated", **how):
    at = scratch(spark, "fastq")
    sinks.write_text(gen(spark, sf_dir).select(sinks.fastq_text(F.col("id"), F.col("sequence"), F.col("quality"), " made").alias("r")), "r", at, **how)
    return dedup_scan(scan_fastq(spark, at, mode, split_bytes=200_000)).select("id", "sequence", "quality")


@query(f"select id, sequence, quality from ({GEN})")
def fastq_scan(spark, sf_dir):
    """Many byte ranges over qualities that begin with either marker."""
    return _gen_fastq(spark, sf_dir)


@query(f"select id, sequence, quality from ({GEN})")
def fastq_gzip_lenient_scan(spark, sf_dir):
    return _gen_fastq(spark, sf_dir, "lenient", gzip=True)


@query(f"select id, sequence, quality from ({GEN}) where k <> (select max(p_partkey) from part)")
def fastq_truncated(spark, sf_dir):
    """A last record without its quality line is dropped."""
    at, rows = scratch(spark, "fastq"), gen(spark, sf_dir)
    last = rows.agg(F.max("k").alias("last"))
    whole = sinks.fastq_text(F.col("id"), F.col("sequence"), F.col("quality"))
    cut = F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("sequence"), F.lit("\n+"))
    text = rows.join(F.broadcast(last)).select(F.when(F.col("k") == F.col("last"), cut).otherwise(whole).alias("r"), (F.col("k") == F.col("last")).alias("at_end"))  # one row
    sinks.write_text(text.coalesce(1).sortWithinPartitions("at_end"), "r", at)
    return dedup_scan(scan_fastq(spark, at)).select("id", "sequence", "quality")


@query(f"select id, sequence from ({GEN})")
def sniffed_load(spark, sf_dir):
    """A single file whose first character tells the format."""
    at = scratch(spark, "sniff")
    sinks.write_text(gen(spark, sf_dir).coalesce(1).select(sinks.fasta_text(F.col("id"), F.col("sequence")).alias("r")), "r", at)
    one = next(f for f in spark.read.text(at).inputFiles())
    return dedup_scan(load_scan(spark, one)).select("id", "sequence")


@query(GEN)
def synth_sequences(spark, sf_dir):
    return gen(spark, sf_dir)


# functions


@query("select doc_id, split_part(text, ' ', 1) as id from documents")
def header_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.header_id(F.col("text")).alias("id"))


@query("select doc_id, rtrim(concat(text, chr(13), chr(10), chr(10)), chr(13) || chr(10)) as line from documents")
def strip_line_end(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.strip_line_end(F.concat("text", F.lit("\r\n\n"))).alias("line"))


@query(f"select id, {KIND} as kind from (select id, sequence from ({GEN}) union all {DOCS})")
def classify_sequences(spark, sf_dir):
    docs = doc_records(spark, sf_dir).select("id", F.replace("sequence", F.lit("\n"), F.lit("")).alias("sequence"))
    return gen(spark, sf_dir).select("id", "sequence").unionByName(docs).select("id", fn.residue_kind(F.col("sequence")).alias("kind"))


@query(f"""select id, cast(case when k % 2 = 0 then 3 else 0 end + case {KIND} when 'DNA' then 0 when 'RNA' then 1 else 2 end as integer) as code from ({GEN})""")
def format_code(spark, sf_dir):
    rows = gen(spark, sf_dir)
    return rows.select("id", fn.format_code(F.col("sequence"), F.when(F.col("k") % 2 == 0, F.col("quality")).otherwise("")).alias("code"))


@query("select page_id, url like '%.gz' and length(url) > 3 as gz, contains(url, '.fastq') or contains(url, '.fq') as fastq from (select page_id, concat(url, case page_id % 4 when 0 then '.fastq.gz' when 1 then '.fq' when 2 then '.GZ' else '' end) as url from pages)")
def file_names(spark, sf_dir):
    kind = F.col("page_id") % 4
    url = F.concat("url", F.when(kind == 0, ".fastq.gz").when(kind == 1, ".fq").when(kind == 2, ".GZ").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", fn.is_gzip_name(url).alias("gz"), fn.is_fastq_name(url).alias("fastq"))


@query("select doc_id, hex(encode(text)) as bytes, text as back from documents")
def payload_codec(spark, sf_dir):
    data = fn.encode_payload(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(data).alias("bytes"), fn.decode_payload(data).alias("back"))


# updates and lookups


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events group by user_id")
def upsert_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return last_wins(rows, "user_id", F.struct("ts", "event_id")).select("user_id", "event_type", "value")


@query("select o_orderkey, coalesce(text, '') as value from orders left join documents on o_orderkey = doc_id")
def batch_get(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("sequence"), F.lit("").alias("quality"))
    return lookup.batch_get(keys, records).select("o_orderkey", "value")


@query("""select d.doc_id, case when l.doc_id is not null and l.doc_id % 2 = 0 then concat('label', cast(quality as varchar)) else text end as value
from documents d left join labels l on d.doc_id = l.doc_id""")
def overlay_get(spark, sf_dir):
    """Entries of kind FASTA hide a file's row, those of kind FASTQ don't."""
    labels = table(spark, sf_dir, "labels")
    pairs = pairs_of(labels, doc_id(), F.concat(F.lit("label"), F.col("quality").cast("string"))).withColumn("kind", F.when(F.substring("key", -1, 1).cast("int") % 2 == 0, "FASTA").otherwise("FASTQ"))
    keys = table(spark, sf_dir, "documents").select("doc_id", doc_id().alias("key"))
    return lookup.batch_get(keys, doc_records(spark, sf_dir), pairs).select("doc_id", "value")


@query(f"select s_suppkey, sequence, quality from supplier left join ({GEN}) on s_suppkey * 7 = k")
def fastq_record_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("p"), (F.col("s_suppkey") * 7).cast("string")).alias("key"))
    return lookup.batch_get_record(keys, gen(spark, sf_dir)).select("s_suppkey", "record.sequence", "record.quality")


@query(f"select o_orderkey, coalesce(quality, '') as value from orders left join ({GEN}) on o_orderkey = k")
def get_quality(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("key"))
    return lookup.batch_project(keys, gen(spark, sf_dir), "quality").select("o_orderkey", "value")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def has_key(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("key"))
    return lookup.batch_has(keys, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))).select("doc_id")


@query("select id, min_by(value, n) as value from (select cast(user_id % 97 as varchar) as id, event_type as value, event_id as n from events) group by id")
def first_match_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 97).cast("string").alias("id"), F.col("event_type").alias("value"), "event_id")
    return first_match(rows, "id", "value", F.col("event_id"))


# sizes, formats, metrics


@query("select count(*) as total from (select doc_id from documents union all select doc_id from labels)")
def total_size(spark, sf_dir):
    return metrics.total_size(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("select count(distinct l_orderkey) as n from lineitem")
def distinct_size(spark, sf_dir):
    """Rows of a file snapshot, one for each id however often it is in the file."""
    store = SequenceStore(spark)
    store.load(_file(spark, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.lit("ACGT").alias("sequence"))))
    return spark.createDataFrame([(store.file_cache_size(),)], "n long")


@query("select o_orderkey, coalesce(cast(strlen(text) as bigint), 0) as stored_size from orders left join documents on o_orderkey = doc_id")
def stored_size(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey", doc_id("o_orderkey").alias("key"))
    return lookup.batch_stored_size(keys, pairs_of(table(spark, sf_dir, "documents"), doc_id(), F.col("text"))).select("o_orderkey", "stored_size")


@query("select 13 + cast(sum(12 + strlen(concat('doc', cast(doc_id as varchar))) + strlen(text)) as bigint) as total_bytes from documents")
def smrt_bytes(spark, sf_dir):
    return binary.smrt_size(doc_records(spark, sf_dir))


@query("select 13 + cast(sum(9 + strlen(concat('doc', cast(doc_id as varchar))) + strlen(text)) as bigint) as total_bytes from documents")
def trac_bytes(spark, sf_dir):
    return binary.trac_size(pairs_of(table(spark, sf_dir, "documents"), doc_id(), F.col("text")))


@query(f"select id, sequence, quality from ({GEN})")
def smrt_roundtrip(spark, sf_dir):
    at = scratch(spark, "smrt")
    binary.write_smrt(gen(spark, sf_dir), _in_new_folder(spark, at))
    return dedup_scan(binary.scan_smrt(spark, at)).select("id", "sequence", "quality")


@query(f"select id as key, case when k % 2 = 0 then 'FASTA' else 'FASTQ' end as kind, case when k % 2 = 0 then sequence end as data, case when k % 2 = 1 then sequence end as sequence, case when k % 2 = 1 then quality end as quality from ({GEN})")
def trac_roundtrip(spark, sf_dir):
    at, even = scratch(spark, "trac"), F.col("k") % 2 == 0
    pairs = gen(spark, sf_dir).select(F.col("id").alias("key"), F.when(even, "FASTA").otherwise("FASTQ").alias("kind"), F.when(even, fn.encode_payload(F.col("sequence"))).alias("data"), F.when(~even, fn.encode_payload(F.col("sequence"))).alias("sequence"), F.when(~even, fn.encode_payload(F.col("quality"))).alias("quality"))
    binary.write_trac(pairs, _in_new_folder(spark, at))
    back = binary.scan_trac(spark, at)
    return back.select("key", "kind", *(fn.decode_payload(F.col(c)).alias(c) for c in ("data", "sequence", "quality")))


def _in_new_folder(spark: SparkSession, at: str) -> str:
    from strandlake.sources.paths import open_store

    fs, inner = open_store(at)
    fs.create_dir(inner)
    return f"{at}/cache.bin"


@query("""select n_rows, total_bytes, total_bytes::double / n_rows as bytes_per_row, total_bytes::double / 1048576 as original_mb, (13 + total_bytes + 12 * n_rows)::double / 1048576 as stored_mb,
(total_bytes - (13 + total_bytes + 12 * n_rows))::double / total_bytes * 100 as reduction_pct, (13 + total_bytes + 12 * n_rows)::double / total_bytes as size_ratio
from (select count(*) as n_rows, cast(sum(strlen(concat('doc', cast(doc_id as varchar))) + strlen(text)) as bigint) as total_bytes from documents)""")
def cache_metrics(spark, sf_dir):
    stored = F.lit(13) + F.col("total_bytes") + 12 * F.col("n_rows")
    return metrics.payload_bytes(doc_records(spark, sf_dir)).select("n_rows", "total_bytes", "bytes_per_row", *metrics.size_report(F.col("total_bytes"), stored))


@query("select doc_id, concat(case when r > 50 then 'high' when r > 30 then 'medium' else 'low' end, ' reduction; ', case when s > 5 then 'fast' else 'slow' end, ' restore') as advice from (select doc_id, doc_id % 100 as r, doc_id % 11 as s from documents)")
def cache_advice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", metrics.recommendation(F.col("doc_id") % 100, F.col("doc_id") % 11).alias("advice"))


@query("select count(*) as n_before, count(*) as n_after, true as same, false as same_if_changed from part")
def integrity_check(spark, sf_dir):
    """A store's own format gives its rows back; one changed residue is found."""
    at, rows, store = scratch(spark, "native"), gen(spark, sf_dir).select("id", "sequence", "quality"), SequenceStore(spark)
    store.load(_file(spark, rows, "fastq"))
    store.save_native(at)
    back = SequenceStore(spark)
    back.restore_native(at)
    changed = back.files.withColumn("sequence", F.when(F.col("id") == "p7", F.concat(F.lit("A"), F.substring("sequence", 1, 31))).otherwise(F.col("sequence")))
    return metrics.integrity(rows, back.files).withColumn("same_if_changed", F.lit(metrics.integrity(rows, changed).first()["same"]))


@query("select id, sequence from (select id, arg_max(sequence, n) as sequence from (select cast(user_id as varchar) as id, event_type as sequence, event_id as n from events) group by id)")
def file_order_last_wins(spark, sf_dir):
    """Duplicate ids over several splits of one file: the last in the file stays."""
    at = scratch(spark, "order")
    rows = table(spark, sf_dir, "events").coalesce(1).sortWithinPartitions("event_id")
    sinks.write_text(rows.select(sinks.fasta_text(F.col("user_id").cast("string"), F.col("event_type")).alias("r")), "r", at)
    return last_wins(scan_fasta(spark, at), "id", file_order()).select("id", "sequence")


# the store, from files and back


def _file(spark: SparkSession, rows: DataFrame, form: str = "fasta") -> str:
    """Records as a folder with one file of a form; the file."""
    at = scratch(spark, form)
    text = sinks.fastq_text(F.col("id"), F.col("sequence"), F.col("quality")) if form == "fastq" else sinks.fasta_text(F.col("id"), F.col("sequence"))
    sinks.write_text(rows.coalesce(1).select(text.alias("r")), "r", at)
    return spark.read.text(at).inputFiles()[0]


def _mixed_pairs(rows: DataFrame) -> DataFrame:
    """Of every five keys one FASTA entry and one FASTQ entry, and an entry of each kind that no file has."""
    five, none = F.col("k") % 5, F.lit(None).cast("binary")
    text = lambda c: fn.encode_payload(F.concat(F.lit(c), F.col("k").cast("string")))
    held = rows.where(five < 2).select(F.col("id").alias("key"), F.when(five == 0, "FASTA").otherwise("FASTQ").alias("kind"), F.when(five == 0, text("X")).alias("data"), F.when(five == 1, text("S")).alias("sequence"), F.when(five == 1, text("Q")).alias("quality"))
    own = rows.where("k = 1").select(F.lit("only").alias("key"), F.lit("FASTA").alias("kind"), fn.encode_payload(F.lit("ACGT")).alias("data"), none.alias("sequence"), none.alias("quality"))
    return held.unionAll(own)


def _trac(spark: SparkSession, pairs: DataFrame) -> str:
    at = _in_new_folder(spark, scratch(spark, "trac"))
    binary.write_trac(pairs, at)
    return at


@query(f"select id, sequence from ({GEN})")
def store_save_restore(spark, sf_dir):
    """A loaded file saved as a cache and restored by another store."""
    one, two, at = SequenceStore(spark), SequenceStore(spark), _in_new_folder(spark, scratch(spark, "cache"))
    one.load(_file(spark, gen(spark, sf_dir)))
    one.save(at)
    two.restore(at)
    return two.files.select("id", "sequence")


PAIRS = f"""select id as key, k % 5 as five, concat(case k % 5 when 0 then 'X' else 'S' end, cast(k as varchar)) as s, concat('Q', cast(k as varchar)) as q from ({GEN}) where k % 5 < 2
union all select 'only', 0, 'ACGT', null"""


@query(f"""select key, coalesce(case when five = 0 then s end, sequence, '') as value, case when five = 1 then s else sequence end as record_sequence, case when five = 1 then q else quality end as record_quality
from (select id as key from ({GEN}) union all select 'only' union all select 'nowhere') left join ({PAIRS}) using (key) left join (select id as key, sequence, quality from ({GEN})) using (key)""")
def store_precedence(spark, sf_dir):
    """Restored updates over a loaded FASTQ file, by value and by record, for present and absent keys."""
    rows, store = gen(spark, sf_dir), SequenceStore(spark)
    store.load(_file(spark, rows, "fastq"))
    store.restore(_trac(spark, _mixed_pairs(rows)))
    keys = rows.select(F.col("id").alias("key")).unionAll(spark.createDataFrame([("only",), ("nowhere",)], "key string"))
    return store.get_all_records(store.get_all(keys)).select("key", "value", "record.*").withColumnsRenamed({"sequence": "record_sequence", "quality": "record_quality"})


@query(f"""with g as (select k from ({GEN})), a as (select count(*) as n from g where k % 2 = 0), b as (select count(*) as n from g where k % 3 = 0)
select 'loaded' as step, n as size, n as file_cache_size from a union all select 'set', n + 2, n from a union all select 'replaced', n + 2, n from b union all select 'cleared', 2, 0""")
def store_clear_replace(spark, sf_dir):
    """Sizes as a file is loaded, entries are set twice, another file replaces it and the file cache is cleared."""
    rows, store, seen = gen(spark, sf_dir), SequenceStore(spark), []
    note = lambda step: seen.append((step, store.size(), store.file_cache_size()))
    store.load(_file(spark, rows.where("k % 2 = 0")))
    note("loaded")
    for key, value in (("a", "AC"), ("b", "GT"), ("a", "GG")):
        store.set(key, value)
    note("set")
    store.load_smart_file(_file(spark, rows.where("k % 3 = 0"), "fastq"))
    note("replaced")
    store.clear_file_cache()
    note("cleared")
    return spark.createDataFrame(seen, "step string, size long, file_cache_size long")


@query(f"""select 'pairs' as store, key as id, case when five = 0 then s else concat(s, '/', q) end as content, 'TRAC' as form from ({PAIRS})
union all select 'files', id, concat(sequence, '/', quality), 'DNA_FASTQ' from ({GEN}) where k % 3 = 0""")
def restore_dispatch(spark, sf_dir):
    """Both cache formats into one store: the first bytes tell which snapshot they fill, and the other stays."""
    rows, one, two = gen(spark, sf_dir), SequenceStore(spark), SequenceStore(spark)
    one.load(_file(spark, rows.where("k % 3 = 0").orderBy("k"), "fastq"))
    smrt = _in_new_folder(spark, scratch(spark, "smrt"))
    one.save_smart_binary(smrt)
    one.restore(_trac(spark, _mixed_pairs(rows)))
    trac = _in_new_folder(spark, scratch(spark, "trac"))
    one.save(trac)
    for at in (smrt, trac):
        two.restore(at)
    text = fn.decode_payload
    pairs = two.pairs.select(F.lit("pairs").alias("store"), F.col("key").alias("id"), F.concat_ws("/", text(F.col("data")), text(F.col("sequence")), text(F.col("quality"))).alias("content"), F.lit("TRAC").alias("form"))
    return pairs.unionAll(two.files.select(F.lit("files"), "id", F.concat_ws("/", "sequence", "quality"), F.lit(two.detected_format())))


@query(f"""with g as (select * from ({GEN})), p as ({PAIRS})
select (select count(*) from g) as file_cache_size, (select count(*) from g) + (select count(*) from p) as size,
  (select 13 + cast(sum(12 + strlen(id) + strlen(sequence) + strlen(quality)) as bigint) from g) as smrt_bytes,
  (select 13 + cast(sum(strlen(key) + strlen(s) + case when five = 0 then 9 else 13 + strlen(q) end) as bigint) from p) as trac_bytes, 4 as stored_only, 0 as stored_none""")
def store_sizes(spark, sf_dir):
    """Sizes of a store and of the cache files that it writes, as found in storage."""
    rows, store = gen(spark, sf_dir), SequenceStore(spark)
    store.load(_file(spark, rows, "fastq"))
    store.restore(_trac(spark, _mixed_pairs(rows)))
    smrt, trac = (_in_new_folder(spark, scratch(spark, x)) for x in ("smrt", "trac"))
    store.save_smart_binary(smrt)
    store.save(trac)
    found = (store.file_cache_size(), store.size(), file_size(smrt), file_size(trac), store.get_stored_size("only"), store.get_stored_size("nowhere"))
    return spark.createDataFrame([found], "file_cache_size long, size long, smrt_bytes long, trac_bytes long, stored_only int, stored_none int")


LOOKED_UP = ("p1", "p5", "p6", "p77", "only", "nowhere")


@query(f"""select key, coalesce(case when five = 0 then s end, sequence, '') as value, coalesce(sequence, '') as sequence, coalesce(quality, '') as quality, id is not null as present,
  case when five = 1 then concat(s, '/', q) when id is not null then concat(sequence, '/', quality) end as record, coalesce(cast(strlen(s) + case when five = 1 then strlen(q) else 0 end as bigint), 0) as stored
from (select unnest({list(LOOKED_UP)}) as key) left join ({PAIRS}) using (key) left join ({GEN}) on key = id""")
def point_lookups(spark, sf_dir):
    """Each lookup of the store by single keys, against a table that was loaded once."""
    rows, store = gen(spark, sf_dir), SequenceStore(spark)
    store.load(_file(spark, rows, "fastq"))
    store.restore(_trac(spark, _mixed_pairs(rows)))
    found = [(k, store.get(k), store.get_sequence(k), store.get_quality(k), store.has_sequence(k), (r := store.get_fastq_record(k)) and "/".join(r), store.get_stored_size(k)) for k in LOOKED_UP]
    return spark.createDataFrame(found, "key string, value string, sequence string, quality string, present boolean, record string, stored long")


@query("select cast(user_id as varchar) as id, min_by(event_type, event_id) as sequence from events where user_id in (select min(user_id) from events union all select max(user_id) from events) group by 1")
def linear_lookup(spark, sf_dir):
    """The first record of an id in a file that has it many times, found by reading up to it."""
    events = table(spark, sf_dir, "events")
    path = _file(spark, events.coalesce(1).sortWithinPartitions("event_id").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("sequence")))
    ends = events.agg(F.min("user_id"), F.max("user_id")).first()
    found = [lookup.first_in_file(scan_fasta(spark, path), str(key)) for key in dict.fromkeys(ends)]
    return reduce(DataFrame.unionAll, found)


@query(f"""with g as (select id, sequence, quality from ({GEN})),
f as (select count(*) as n, cast(sum(strlen(id) + strlen(sequence) + strlen(quality)) as double) as b from g)
select action, n as rows, (b + extra * n + case action when 'loaded' then 0 else 13 end) / 1048576 as mb, true as timed
from f, (values ('loaded', 6), ('saved', 12), ('restored', 12)) as a(action, extra)""")
def load_summaries(spark, sf_dir):
    """What a load, a save and a restore say of themselves: rows, MiB of the file, and a rate."""
    store, at, seen = SequenceStore(spark), _in_new_folder(spark, scratch(spark, "cache")), []
    path = _file(spark, gen(spark, sf_dir), "fastq")
    for act, arg in ((store.load, path), (store.save, at), (store.restore, at)):
        act(arg)
        s = store.summary
        seen.append((s["action"], s["rows"], s["mb"], s["seconds"] > 0 and abs(s["mb_per_second"] * s["seconds"] - s["mb"]) < 1e-6))
    return spark.createDataFrame(seen, "action string, rows long, mb double, timed boolean")


@query(f"""select n as rows, (b + 3 * n) / 1048576 as original_mb, (b + 12 * n + 13) / 1048576 as stored_mb, (b + 12 * n + 13) / (b + 3 * n) as size_ratio, true as measured
from (select count(*) as n, cast(sum(strlen(id) + strlen(sequence)) as double) as b from ({GEN}))""")
def cache_report(spark, sf_dir):
    """A FASTA file against its cache: measured sizes and, as they differ from run to run, only that speedup and advice are there."""
    store, at, seen = SequenceStore(spark), _in_new_folder(spark, scratch(spark, "cache")), []
    path = _file(spark, gen(spark, sf_dir))
    for act, arg in ((store.load, path), (store.save, at), (store.restore, at)):
        act(arg)
        seen.append(store.summary)
    r = metrics.report(*seen)
    ok = r["restore_speedup"] > 0 and r["break_even_lookups"] >= 0 and r["load_mb_per_second"] > 0
    return spark.createDataFrame([(r["rows"], r["original_mb"], r["stored_mb"], r["size_ratio"], ok)], "rows long, original_mb double, stored_mb double, size_ratio double, measured boolean")


@query("select doc_id, doc_id * 37 // 100 as lookups from documents")
def break_even_lookups(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", metrics.break_even(F.col("doc_id") * 37).alias("lookups"))
