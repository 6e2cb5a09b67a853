"""IBANs before capitalised words, codes and numbers."""

from strandlake.llm import oracles
from strandlake.llm.pii import IBAN_LENGTHS, pii_digest

DE, GB, NO = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
MT = "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
CASES = [
    (f"IBAN {DE} Please pay", [DE]), (f"IBAN {DE.replace(' ', '')} Bank", [DE.replace(" ", "")]), (f"IBAN {DE} BIC COBADEFF", [DE]),
    (f"IBAN {DE.replace(' ', '')} 2 days", [DE.replace(" ", "")]), (f"{DE} {GB} {NO} 12 {MT} A", [DE, GB, NO, MT]), (f"IBAN {DE}", [DE]), (f"IBAN {DE}, or {NO}.", [DE, NO]),
    (f"IBAN {DE}0 BIC", []), ("IBAN DE88 3704 0044 0532 0130 00 BIC", []), (f"X{DE} BIC", []), ("DE89 " * 20_000, []),
]


def test_what_follows_an_iban(spark):
    got = pii_digest(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")).collect()
    for r in got:
        text, want = CASES[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("iban")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == want == want[: r.n_iban], text[:80]


def test_lengths():
    codes = " ".join(IBAN_LENGTHS.values()).split()
    assert len(codes) == len(set(codes)) > 80


def test_countries_outside_of_the_registry(spark):
    """A code without a known length still has its run, if that passes the checksum."""
    body = "00012345678901234"
    for check in range(2, 99):
        text = f"XY{check:02d}{body}"
        if int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1:
            break
    assert pii_digest(spark.createDataFrame([(1, f"iban {text}, so")], "doc_id long, text string")).first().n_iban == 1


def test_sql(spark):
    """The SQL of the query, on IBANs and on personal data beside marks, letters and digits."""
    import duckdb

    more = ["a@b.c.d,x@y", "1.2.3.4.5 300.1.1.1 1.2.3.255", "4111-1111-1111-1111 4111111111111112 411111111111111111111", "+1 (555) 010-9999 call +12 +49.30.1234567.", "é Ä mail me: ü.o%p@q-r.st!", "", None, "order 4111 1111 1111 1111 invoice", "v. release 1.2.3.4"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([t for t, _ in CASES[:-1]] + more)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = pii_digest(docs)
    want = con.execute(f"select {', '.join(got.columns)} from ({oracles.PII})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect()) and all(sum(r[k] for r in want) > 0 for k in range(1, 5))
