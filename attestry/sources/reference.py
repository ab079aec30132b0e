"""Reference files: entity master, allowed values, taxonomy."""

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import text as tx
from attestry.functions import units as un
from attestry.sources.catalog import SourceError, _open_csv, file_headers, one_header, write_csv


def rename_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Select canonical columns by any of their accepted header spellings."""
    by_key = {c.lstrip("﻿").strip().casefold().replace(" ", "_"): c for c in df.columns}
    out = []
    for name, spellings in aliases.items():
        found = next((by_key[s] for s in spellings if s in by_key), None)
        if found is None and name not in optional:
            raise SourceError(f"a required column is missing; expected one of {spellings}")
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    extra = [c for c in ("row_no",) if c in df.columns]
    return df.select(*extra, *out)


def entity_master(df: DataFrame, row: str = "row_no") -> DataFrame:
    """(kind, key, value) rows: manufacturer and brand ids and the brand's owner.
    Rows need a manufacturer name and id; the last row wins."""
    m = rename_aliases(df, fv.MASTER_ALIASES, optional=("brand_id", "brand_name"))
    c = m.select(row, *[tx.clean_optional(F.col(x)).alias(x) for x in fv.MASTER_ALIASES])
    c = c.where(F.col("manufacturer_name").isNotNull() & F.col("manufacturer_id").isNotNull())
    has_brand = F.col("brand_name").isNotNull() & F.col("brand_id").isNotNull()
    entry = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), tx.entity_key(F.col(name)).alias("key"), F.col(value).alias("value"))
    rows = c.select(row, F.explode(F.array_compact(F.array(
        entry("manufacturer_id", "manufacturer_name", "manufacturer_id"),
        F.when(has_brand, entry("brand_id", "brand_name", "brand_id")),
        F.when(has_brand, entry("brand_owner", "brand_name", "manufacturer_name"))))).alias("e"))
    return rows.groupBy("e.kind", "e.key").agg(F.max_by("e.value", row).alias("value"))


def allowed_values(df: DataFrame, row: str = "row_no") -> DataFrame:
    """(classpath, label, value, uom, seq, valid): ordered distinct normalized values of
    closed sets; a label without values keeps one NULL row; an unsupported unit is
    marked, and `require_valid_units` refuses the file."""
    c = rename_aliases(df, fv.LOV_ALIASES, optional=("uom",))
    c = c.select(row, *[F.trim(F.coalesce(F.col(x), F.lit(""))).alias(x) for x in fv.LOV_ALIASES])
    c = c.where((F.col("classpath") != "") & (F.col("label") != ""))
    m = un.normalize_measure(F.col("label"), F.col("value"), F.nullif(F.col("uom"), F.lit("")))
    n = c.withColumn("m", F.when(F.col("value") != "", m))
    rows = n.groupBy("classpath", "label", F.col("m.value").alias("value"), F.col("m.uom").alias("uom"),
                     F.coalesce("m.valid", F.lit(True)).alias("valid")).agg(F.min(row).alias("seq"))
    filled = rows.where(F.col("value").isNotNull())
    bare = rows.where(F.col("value").isNull()).join(filled.select("classpath", "label").distinct(), ["classpath", "label"], "left_anti")
    return filled.unionByName(bare)


def require_valid_units(values: DataFrame) -> DataFrame:
    bad = values.where(~F.col("valid")).limit(1).collect()
    if bad:
        raise SourceError(f"allowed values contain an unsupported unit for {bad[0]['label']!r}")
    return values


def _windows_1252(c):
    """Text read as ISO 8859-1 as the Windows code page has it: only 0x80 to 0x9F differ."""
    codes = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return F.translate(c, "".join(map(chr, codes)), bytes(codes).decode("windows-1252"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Read a taxonomy file in the Windows-1252 code page, which Spark's readers do not offer by name."""
    header = one_header(spark, path, "ISO-8859-1")
    if tuple(header) != fv.TAXONOMY_COLUMNS:
        raise SourceError(f"taxonomy header must be {fv.TAXONOMY_COLUMNS}, found {tuple(header)}")
    raw = _open_csv(spark, path, "ISO-8859-1").csv(path)
    named = raw.select(*[F.trim(_windows_1252(F.col(f"`{c}`"))).alias(c.lower().replace(" ", "_")) for c in fv.TAXONOMY_COLUMNS])
    problems = taxonomy_problems(named, "commodity").limit(1).collect()
    if problems:
        raise SourceError(f"taxonomy code {problems[0]['code']!r} is {problems[0]['problem']}")
    return named


def taxonomy_problems(df: DataFrame, code: str) -> DataFrame:
    """Codes that are not eight digits, or occur more than once."""
    counted = df.groupBy(F.trim(F.col(code)).alias("code")).agg(F.count("*").alias("rows"))
    problem = F.when(~F.col("code").rlike("^[0-9]{8}$"), "invalid").when(F.col("rows") > 1, "duplicate")
    return counted.withColumn("problem", problem).where(F.col("problem").isNotNull())


DELIVERY_TRIPLE = ("ATTRIBUTE_LABEL {n}", "ATTRIBUTE_VALUE {n}", "ATTRIBUTE_UOM {n}")
#: all columns of the delivery table in their order: names, 20 features, 50 attribute slots, names
DELIVERY_COLUMNS = (*fv.DELIVERY_FIRST, *[f"ITEM_FEATURES_{n}" for n in range(1, 21)], *fv.DELIVERY_BEFORE_SLOTS,
                    *[c.format(n=n) for n in range(1, 51) for c in DELIVERY_TRIPLE], *fv.DELIVERY_LAST)


def check_delivery_header(header: list[str], sha256: str | None = None) -> list[int]:
    """Refuse a header that breaks the delivery contract: number of columns, repeats, required fields, whole slots, and, if given,
    the hash of names and order.  Returns the slots."""
    if len(header) != len(DELIVERY_COLUMNS):
        raise SourceError(f"delivery header must have {len(DELIVERY_COLUMNS)} columns, found {len(header)}")
    if len(set(header)) != len(header):
        raise SourceError(f"delivery header repeats {sorted({c for c in header if header.count(c) > 1})}")
    missing = sorted(set(fv.DELIVERY_REQUIRED) - set(header))
    if missing:
        raise SourceError(f"delivery header lacks required fields: {missing}")
    slots: dict[int, set[str]] = {}
    for m in filter(None, (re.match(r"ATTRIBUTE_(LABEL|VALUE|UOM) (\d+)$", c) for c in header)):
        slots.setdefault(int(m[2]), set()).add(m[1])
    torn = sorted(n for n, parts in slots.items() if len(parts) < 3)
    if torn:
        raise SourceError(f"delivery header has incomplete attribute slots: {torn}")
    found = hashlib.sha256(json.dumps(header, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    if sha256 and found != sha256:
        raise SourceError(f"delivery header must have hash {sha256}, found {found}")
    return sorted(slots)


def read_delivery_csv(spark: SparkSession, path: str, sha256: str | None = None, multi_line: bool = False) -> DataFrame:
    """Rows of a delivery table whose files all meet the header contract; a blank cell is ''."""
    for header, file in file_headers(spark, path):
        try:
            check_delivery_header(header, sha256)
        except SourceError as e:
            raise SourceError(f"{e} ({file})") from e
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in one_header(spark, path))
    return _open_csv(spark, path, multi_line=multi_line).schema(schema).option("mode", "FAILFAST").csv(path).na.fill("")


def write_delivery_csv(rows: DataFrame, path: str, sha256: str | None = None, compression: str | None = None) -> None:
    """Write delivery rows whose columns meet the contract; Spark's commit lets readers see all files or none.  `read_delivery_csv`
    reads compressed files as they are."""
    check_delivery_header(rows.columns, sha256)
    write_csv(rows, path, quote_all=True, compression=compression)


def delivery_rows(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The delivery table's columns in their order: `names` says which column of `rows` a field is taken from, fields without one
    are empty; nothing is NULL."""
    stray = sorted(set(names) - set(DELIVERY_COLUMNS))
    if stray:
        raise SourceError(f"no delivery fields: {stray}")
    return rows.select(*[(F.coalesce(F.col(f"`{names[c]}`").cast("string"), F.lit("")) if c in names else F.lit("")).alias(c) for c in DELIVERY_COLUMNS])


def delivery_triples(delivery: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, label, value, uom) of every slot that the header has, gaps between slot numbers included."""
    cells = F.array(*[F.struct(F.lit(n).alias("slot"), *[F.trim(F.coalesce(F.col(f"`{c.format(n=n)}`"), F.lit(""))).alias(a)
                                                         for c, a in zip(DELIVERY_TRIPLE, ("label", "value", "uom"))])
                      for n in check_delivery_header(delivery.columns)])
    return delivery.select(*[F.col(f"`{k}`") for k in keys], F.inline(cells))
