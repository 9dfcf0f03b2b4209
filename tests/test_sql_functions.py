from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import sql, text, urls

URLS = [
    "https://www.A.com/x/?utm_source=1&b=2&a=", "http://u:p@b.org:80/", "HTTPS://c.com:8443/p/?q=a%20b*~&q=a+b#frag", "ftp://d.com", "not a url", "", None, "https://e.com//?&&=x&fbclid=3", "http://f.com/it's?x=%zz", "https://g.com/ü?ü=é",
]


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def test_canonical_url_is_evidence_url(session):
    rows = session.createDataFrame([(u,) for u in URLS], "u string")
    rows.createOrReplaceTempView("addresses")
    got = {r.u: r.c for r in session.sql("SELECT u, canonical_url(u) AS c FROM addresses").collect()}
    assert got == {r.u: r.c for r in rows.select("u", urls.evidence_url(F.col("u")).alias("c")).collect()} and got[URLS[0]] == "https://a.com/x?a=&b=2"
    assert "ArrowEvalPython" not in session.sql("SELECT canonical_url(u) FROM addresses")._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_the_terms_of_the_library(session):
    texts = ["The quick ＡＩ fox, the Fox!", "我需要工具 and a tool x2", "é́ ½ ﬁne", "", None, "長", "a_b c-d"]
    rows = session.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows.createOrReplaceTempView("texts")
    found = session.sql("SELECT id, collect_list(term) AS terms FROM texts, LATERAL evidence_tokens(t) GROUP BY id").collect()
    want = {r.id: set(r.terms) for r in rows.select("id", text.plain_terms(text.nfkc_casefold(F.coalesce("t", F.lit("")))).alias("terms")).collect()}
    assert {r.id: set(r.terms) for r in found} == {k: v for k, v in want.items() if v} and all(len(r.terms) == len(set(r.terms)) for r in found)
    counted = session.sql("SELECT term, n FROM texts, LATERAL evidence_tokens(t, true) WHERE id = 0").collect()
    assert {r.term: r.n for r in counted} == {"quick": 1, "ai": 1, "fox": 2}


def test_wrong_arguments_are_refused_when_planned(session):
    for call in ("evidence_tokens(7)", "evidence_tokens('a', rand() > 1)"):
        with pytest.raises(Exception, match="evidence_tokens takes"):
            session.sql(f"SELECT * FROM {call}")


def test_nfkc(session):
    assert session.sql("SELECT nfkc('ＡＢ①') AS a, nfkc(NULL) AS b").first() == ("AB1", None)
