"""Readers and writers of evidence documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (file, line_no within file, document, problem); nothing is dropped silently."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "text"))
    shown = rows.where(F.trim("text") != "")
    value = F.try_parse_json("text")
    return shown.select("file", (F.col("n") + 1).alias("line_no"), "text", F.when(value.isNull(), "not JSON").alias("problem"))


def documents(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Whole JSON files as (file, bytes, text); larger ones than ``most_bytes`` have a problem and no text."""
    files = spark.read.format("binaryFile").load(path)
    big = F.lit(False) if most_bytes is None else F.col("length") > most_bytes
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.when(~big, F.col("content").cast("string")).alias("text"), F.when(big, "too large").alias("problem"))


def records(texts: DataFrame, fields: tuple[str, ...] = ("evidence",), text: str = "text") -> DataFrame:
    """Records (as JSON text) of documents that are an array, an object, or an object that holds an
    array under one of ``fields``; with run_id and as_of of the enclosing object where a record has none.
    """
    v = F.try_parse_json(text)
    inner = F.coalesce(*[F.try_variant_get(v, f"$.{f}", "array<variant>") for f in fields])
    rows = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), inner, F.when(v.isNotNull(), F.array(v)))
    own = lambda name: F.coalesce(F.try_variant_get("r", f"$.{name}", "string"), F.col(f"_{name}"))
    outer = {f"_{n}": F.try_variant_get(v, f"$.{n}", "string") for n in ("run_id", "as_of")}
    found = texts.withColumns(outer).select(*texts.columns, "_run_id", "_as_of", F.posexplode(rows).alias("record_no", "r"))
    clash = F.col("_run_id").isNotNull() & F.try_variant_get("r", "$.run_id", "string").isNotNull() & (F.col("_run_id") != F.try_variant_get("r", "$.run_id", "string"))
    return found.select(
        *[c for c in texts.columns if c != text], "record_no", own("run_id").alias("run_id"), own("as_of").alias("as_of"), clash.alias("run_conflict"), F.to_json("r").alias("record")
    )


#: How a page must have been seen to count as verified (fixed values).
METHODS = ("opened_page", "authorized_browser")


def page_problems(page: DataFrame, roles: list[str]) -> Column:
    """What keeps an imported page from being evidence, in order of the checks."""
    blank = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.concat(F.lit("no "), F.lit(c))) for c in ("source", "url", "title", "original_text", "supporting_quote")]
    return F.array_compact(F.array(
        *blank,
        F.when(~F.col("evidence_role").isin(*roles), "unknown role"),
        F.when(~F.coalesce(F.col("original_text").contains(F.col("supporting_quote")), F.lit(False)), "quote not in text"),
        F.when(~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)), "not opened"),
        F.when(F.length("original_text") > 20000, "text too long"),
    ))


def imported_pages(pages: DataFrame, roles: list[str]) -> DataFrame:
    """Pages as evidence: id by address, content digest, problems, and duplicate of an earlier row."""
    address = F.coalesce(F.col("original_url"), F.col("url"))
    content = F.sha2(F.to_json(F.struct("evidence_role", "original_text", "supporting_quote")), 256)
    rows = pages.withColumns({
        "problems": page_problems(pages, roles), "content_sha256": content,
        "evidence_id": F.concat(F.lit("web:"), F.substring(F.sha2(address, 256), 1, 24)),
        "date_confidence": F.when(F.col("published_at").isNotNull(), "host_attested").otherwise("unknown"),
        "access_method": F.when(F.col("method") == "authorized_browser", "authorized-browser").otherwise("manual-verification"),
    })
    first = rows.groupBy("evidence_id", "content_sha256").agg(F.min("row_no").alias("_first"))
    joined = rows.join(first, ["evidence_id", "content_sha256"])
    return joined.withColumn("duplicate", F.col("row_no") > F.col("_first")).drop("_first")


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Appends to a Parquet log; a failed job leaves nothing behind."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def public_bundle(items: DataFrame, path: str, index: list[str], key: str = "id") -> None:
    """Three JSON views of a catalogue: full, index columns alone, and one folder per item."""
    items.write.mode("overwrite").json(f"{path}/full")
    items.select(*index).write.mode("overwrite").json(f"{path}/index")
    items.withColumn("_part", F.col(key)).write.mode("overwrite").partitionBy("_part").json(f"{path}/items")
