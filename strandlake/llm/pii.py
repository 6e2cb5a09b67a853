"""Personal data: patterns propose spans, checksums confirm them, context words set a score.

Column expressions only. A pattern's matches and the pieces between them have
the same order, so running lengths give offsets; each kind is two passes of a
pattern that cannot backtrack over long runs. An IBAN has its country's length, so
that it ends before a word that follows. Offsets count code points, the
end is exclusive. A null text is an empty one, which has no spans, a null
doc_id is kept; each row, repeated or not, has one of its own in the result. An
empty table gives an empty one, other columns are not looked at. The pieces of
a text are held beside it, so that a very long one takes about six times its
size in its task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import text_or_empty

# The five kinds, in the order of the results.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

# Lengths of IBANs in the registry, with the countries that have them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?<=(?:{c.replace(' ', '|')})[0-9]{{2}})(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_IBAN_ELSE = rf"(?<!(?:{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[0-9]{{2}})(?:\x20?[A-Z0-9]){{11,30}}+"

#: Same matches as the plain patterns, with possessive runs that start at a run's first character.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:%s|%s)(?![A-Za-z0-9])" % (_IBAN, _IBAN_ELSE),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# What a confirmed span scores by itself, and words nearby that raise or lower it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7}
RAISES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer|bic|swift)\b",
}
LOWERS = {
    "email": r"(?i)\b(?:example|noreply|no-reply)\b",
    "ip": r"(?i)\b(?:version|release|section|chapter)\b",
    "card": r"(?i)\b(?:isbn|serial|order|invoice|tracking)\b",
    "phone": r"(?i)\b(?:isbn|serial|order|invoice|tracking)\b",
    "iban": r"(?i)\b(?:serial|sku|product|part)\b",
}
NEAR = 40
#: Spans beyond the base kinds need this score.
LEAST = 0.5
_RUN = 256


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(F.rlike(c, F.lit("^[0-9]$")), a * 10 + F.ascii(c) - 48).when(c == "", a).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _barrier(frame: DataFrame, **columns: Column) -> DataFrame:
    """The columns computed once, whatever lambdas use them later: a generator is not folded into them."""
    return frame.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _spans(kind: str, z: Column) -> Column:
    """Offsets of the confirmed ones among pieces and matches z: sums within runs of entries, then over the runs."""
    start = F.lit(None).cast("array<struct<s:int,e:int>>")
    empty = F.filter(F.coalesce(start, F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")))), lambda _: F.lit(False))

    def one(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        new = F.when(x["m"].isNotNull() & _confirmed(kind, x["m"]), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["out"])
        return F.struct(e.alias("at"), new.alias("out"))

    def run(k: Column) -> Column:
        return F.aggregate(F.slice(z, k + 1, F.lit(_RUN)), F.struct(F.lit(0).alias("at"), empty.alias("out")), one)

    def join(acc: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e")))
        return F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(z) - 1, F.lit(0)), F.lit(_RUN)), run)
    none = F.filter(F.array(empty), lambda _: F.lit(False))
    return F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("out")), join)["out"])


def _score(kind: str, text: Column, x: Column) -> Column:
    begin = F.greatest(x["s"] - NEAR, F.lit(0))
    around = F.substring(text, begin + 1, x["e"] + NEAR - begin)
    up = F.when(F.rlike(around, F.lit(RAISES[kind])), 0.2).otherwise(0.0)
    down = F.when(F.rlike(around, F.lit(LOWERS[kind])), 0.3).otherwise(0.0)
    return F.round(F.lit(PRIOR[kind]) + up - down, 1)


def _scored(kind: str) -> Column:
    return F.transform(F.col(f"s_{kind}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _score(kind, F.col("text"), x).alias("score")))


def _written(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of start, end and score, for each row of docs.

    A span of a base kind stays whatever its score; others need LEAST.
    """
    out = docs.select("doc_id", text_or_empty().alias("text"))
    # a kind's match needs one of these characters, which a byte search finds faster than a pattern
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    pattern = {k: F.when(needs[k], F.arrays_zip(F.split("text", PATTERNS[k], -1).alias("p"), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias("m"))) if k in needs else F.arrays_zip(F.split("text", PATTERNS[k], -1).alias("p"), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias("m")) for k in KINDS}
    shape = "array<struct<p:string,m:string>>"
    out = _barrier(out, **{f"z_{k}": F.coalesce(z.cast(shape), F.array().cast(shape)) for k, z in pattern.items()})
    out = _barrier(out, **{f"s_{k}": F.when(F.size(f"z_{k}") > 1, _spans(k, F.col(f"z_{k}"))).otherwise(F.array().cast("array<struct<s:int,e:int>>")) for k in KINDS})
    scored = {k: _scored(k) for k in KINDS}
    scored["iban"] = F.filter(scored["iban"], lambda x: x["score"] >= LEAST)
    return _barrier(out.select("doc_id", "text", *(f"s_{k}" for k in KINDS)), **scored).select("doc_id", *KINDS)


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then n_iban and scores, in the spans' order."""
    found = find_pii(docs)
    written = {k: _written(k) for k in KINDS}
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.concat_ws(",", *(written[k] for k in BASE_KINDS)), 256).alias("base_sha256"),
        F.concat_ws(",", *(written[k] for k in KINDS)).alias("spans"),
        F.size("iban").cast("long").alias("n_iban"),
        F.concat_ws(",", *(F.transform(F.col(k), lambda x: x["score"].cast("string")) for k in KINDS)).alias("scores"),
    )
