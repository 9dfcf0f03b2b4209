"""Functions of this library for queries written in SQL alone."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.functions.text import CJK, STOP_WORDS
from lodestone.functions.urls import PARTS, TRACKING


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


PART = f"regexp_extract(trim(coalesce(url, '')), {_quoted(PARTS)}, {{}})"
SITE = f"lower(regexp_extract(regexp_replace({PART.format(2)}, '^.*@', ''), '^([^:]*)', 1))"
PORT = f"regexp_extract({PART.format(2)}, r':(\\d+)$', 1)"
ENCODED = "replace(replace(url_encode({}), '%7E', '~'), '*', '%2A')"
PAIRS = f"""transform(filter(split({PART.format(4)}, '&'), p -> p <> ''),
  p -> struct(coalesce(try_url_decode(substring_index(p, '=', 1)), substring_index(p, '=', 1)) AS k, coalesce(try_url_decode(regexp_extract(p, '=(.*)$', 1)), regexp_extract(p, '=(.*)$', 1)) AS v))"""
QUERY = f"array_join(transform(array_sort(filter({PAIRS}, p -> NOT p.k RLIKE {_quoted(TRACKING)})), p -> concat({ENCODED.format('p.k')}, '=', {ENCODED.format('p.v')})), '&')"
#: ``urls.evidence_url``, as SQL spells it.
CANONICAL_URL = f"""CASE WHEN lower({PART.format(1)}) IN ('http', 'https') AND {SITE} <> '' THEN concat('https://', regexp_replace({SITE}, r'^www\\.', ''),
  CASE WHEN {PORT} IN ('', '80', '443') THEN '' ELSE concat(':', {PORT}) END, regexp_replace({PART.format(3)}, '/+$', ''), CASE WHEN {QUERY} <> '' THEN concat('?', {QUERY}) ELSE '' END) ELSE '' END"""


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """The NFKC form of texts; null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


class Tokens:
    """The distinct terms of a text: words of letters, marks and digits, and bigrams of CJK runs, in the order in which they come.

    ``evidence_tokens(text)`` gives (position, term), ``evidence_tokens(text, true)`` also how often
    a term comes, ``n``; which, ``analyze`` says when the query is planned, and refuses other arguments.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, counted: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("evidence_tokens takes a text")
        if counted is not None and not (counted.isConstantExpression and isinstance(counted.value, bool)):
            raise ValueError("evidence_tokens takes true or false, as a constant, after the text")
        columns = StructType().add("position", IntegerType()).add("term", StringType())
        return AnalyzeResult(schema=columns.add("n", IntegerType()) if counted is not None and counted.value else columns)

    def eval(self, text: str | None, counted: bool = False) -> Iterator[tuple]:
        folded = unicodedata.normalize("NFKC", text or "").casefold()
        found: dict[str, int] = {}
        for run in re.findall(f"{CJK}+", folded):
            for k in range(max(1, len(run) - 1)):
                found[run[k : k + 2]] = found.get(run[k : k + 2], 0) + 1
        word: list[str] = []
        for c in re.sub(f"{CJK}+", " ", folded) + " ":
            if unicodedata.category(c)[0] in "LMN":
                word.append(c)
            elif word:
                term, word = "".join(word), []
                found[term] = found.get(term, 0) + 1
        shown = ((t, n) for t, n in found.items() if t not in STOP_WORDS)
        for k, (t, n) in enumerate(shown, 1):
            yield (k, t, n) if counted else (k, t)


def register(spark: SparkSession) -> None:
    """Adds ``canonical_url``, ``nfkc`` and the table function ``evidence_tokens`` to a session's SQL.

    ``canonical_url`` is a temporary SQL function that Catalyst inlines; ``nfkc`` runs in Arrow batches;
    ``evidence_tokens`` is for LATERAL joins, a text at a time.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION canonical_url(url STRING) RETURNS STRING RETURN {CANONICAL_URL}")
    spark.udf.register("nfkc", nfkc)
    spark.udtf.register("evidence_tokens", F.udtf(Tokens))
