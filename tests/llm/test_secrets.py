import random
import re

import duckdb

from ledgerloom.llm import queries
from ledgerloom.llm.secrets import BASE, KINDS, find_secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_against_patterns(spark):
    rng = random.Random(3)
    parts = ["token", "=", '"', " ", ":", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP0", "é", "😀", "secret", "api_key", "0123456789abcdef", "zz", "\n"]
    texts = [None, "", "f" * 150_000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(300))]
    docs = spark.createDataFrame([(i, t, None, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, row int")
    found, _ = find_secrets(docs)
    rows = {r["id"]: [(s["start"], s["rank"], s["end"]) for s in r["base"]] for r in found.collect()}
    assert rows == {i: brute(t) for i, t in enumerate(texts)}
    assert find_secrets(docs.limit(0))[0].collect() == []


def test_owners(spark):
    hub = lambda c: "ghp_" + c * 36
    rows = [(i, f"x {hub('A')} y", f"s{i}", "en") for i in range(4)] + [(9, f"{hub('B')} {hub('B')}", "s1", "en"), (9, hub("B"), "s1", "de"), (None, hub("C"), None, None), (10, f"token = {'d' * 30}", "s1", "en")]
    found, told = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    spans = {(r["id"], len(r["found"])) for r in found.collect()}
    # Copied by four owners: no span; by one owner, in two repositories: spans; base spans always.
    assert spans == {(0, 0), (1, 0), (2, 0), (3, 0), (9, 2), (9, 1), (None, 1), (10, 2)}
    owners = {r["value"]: (r["repositories"], r["owners"], r["verdict"]) for r in told.collect() if r["rank"] >= len(BASE)}
    assert owners == {hub("A"): (4, 4, "example"), hub("B"): (2, 1, "live"), hub("C"): (1, 1, "live")}
    assert len(KINDS) > len(BASE)


def test_two_owners_are_unclear_and_stay(spark):
    hub, url = "ghp_" + "D" * 36, "ftp://me:" + "p" * 9 + "@host"
    rows = [(1, f"x {hub}", "s1", "en"), (2, f"y {hub}", "s2", "en"), *((10 + i, f"{i} {url}", f"s{i}", "en") for i in range(3)), (20, "none", "s1", "en")]
    found, told = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    got = {r["id"]: (len(r["found"]), r["verdicts"], r["n_live"], r["n_example"]) for r in found.collect()}
    assert got[1] == got[2] == (1, "hub:2:42:unclear", 0, 0)
    assert got[10] == got[11] == got[12] == (0, "url:2:25:example", 0, 1)
    assert got[20] == (0, "", 0, 0)
    # Many owners in too few repositories are no widely copied example.
    one = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), repository_cols=("lang",))[0]
    assert {r["id"]: r["verdicts"] for r in one.collect()}[10] == "url:2:25:unclear"


def test_a_hundred_thousand_matches(spark):
    one = "AKIA" + "A" * 20 + " "
    docs = spark.createDataFrame([(1, one * 100_000, "s", "en")], "doc_id long, text string, source string, lang string")
    found, _ = find_secrets(docs)
    (row,) = found.selectExpr("size(found) as n", "found[99999].end as z", "n_live").collect()
    assert tuple(row) == (100_000, 100_000 * 25 - 1, 100_000)


def test_query_and_sql_agree_on_owners(spark, tmp_path):
    """Values of one, two and three owners, alone and in two repositories of one owner."""
    hub = lambda c: "ghp_" + c * 36
    url = "ftp://me:" + "p" * 9 + "@host"
    rows = [(i, f"x {url} {hub('A') if i < 2 else hub('B')}", f"s{i}", "en") for i in range(5)]
    rows += [(10, hub("C"), "s1", "en"), (11, hub("C"), "s1", "de"), (12, f"secret={'k' * 9} {hub('A')}", "s0", None), (13, None, None, None), (14, f"two {hub('D')}", "s1", "en"), (15, f"{hub('D')} two", "s2", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op5_secrets"])
    columns = sorted(want.columns)
    got = queries.op5_secrets(spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.select(*columns).fetchall())
    spans = {r["doc_id"]: r["verdicts"] for r in got}
    assert "unclear" in spans[14] and "live" in spans[10] and "example" in spans[2]
