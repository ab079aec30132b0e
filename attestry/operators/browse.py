"""Searches and small maintenance steps over records, terms and the taxonomy tree."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_taxonomy(tree: DataFrame, text: str) -> DataFrame:
    """Flatten class groups to commodities and keep those whose code or any title
    contains the text."""
    needle = text.lower()
    flat = tree.select("class_code", "class_name", "family_name", "segment_name", F.inline("commodities"))
    hit = F.col("commodity_code").contains(needle)
    for c in ("commodity_name", "class_name", "family_name"):
        hit = hit | F.lower(c).contains(needle)
    return flat.where(hit).select("commodity_code", F.concat_ws(
        " → ", "segment_name", "family_name", "class_name", "commodity_name").alias("path"))


def search_records(records: DataFrame, text: str = "", code_prefix: str = "", state: str = "ALL") -> DataFrame:
    """Records whose part number, names, commodity or code contain the text, within a
    code prefix and a state."""
    hit = F.lit(not text.strip()) | F.col("code").contains(text)
    for c in ("mpn", "item_id", "classpath", "state"):
        hit = hit | F.lower(c).contains(text.lower())
    out = records.where(F.coalesce(hit, F.lit(False)))
    if code_prefix:
        out = out.where(F.col("code").startswith(code_prefix))
    return out if state == "ALL" else out.where(F.col("state") == state)


def search_terms(terms: DataFrame, category: str = "ALL", state: str = "ALL", text: str = "") -> DataFrame:
    """Vocabulary terms (with ARRAY synonyms) by category, state and substring."""
    needle = text.lower()
    hit = (F.lit(not text.strip()) | F.lower("canonical").contains(needle) | F.lower("category").contains(needle)
           | F.coalesce(F.exists("synonyms", lambda s: F.lower(s).contains(needle)), F.lit(False)))
    out = terms.where(hit)
    if category != "ALL":
        out = out.where(F.col("category") == category)
    return out if state == "ALL" else out.where(F.col("state") == state)


def promote(terms: DataFrame, approvals: DataFrame, key: str = "canonical") -> DataFrame:
    """Approved terms become MATCHED; the table is rewritten by the caller."""
    ok = approvals.select(key, F.lit(True).alias("__ok")).distinct()
    return terms.join(ok, key, "left").withColumn("state", F.when(F.col("__ok"), "MATCHED").otherwise(F.col("state"))).drop("__ok")
