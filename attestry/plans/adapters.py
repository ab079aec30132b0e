"""Views that give the driver tables the shape of catalog data.

Each view is one SELECT in the SQL both engines share, with `{name}` for the
tables and views it reads, so a Spark query and its check read the same input.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from attestry.session import safe_unions, stored

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {}

# six-column distributor rows, with the usual dirt
VIEWS["catalog"] = """
SELECT p.p_partkey + 1 AS row_no,
  CASE WHEN p.p_partkey % 97 = 5 THEN '-- N/A --'
       ELSE '  PN-' || CAST(p.p_partkey AS STRING) || '/A ' END AS mfg_part_num,
  CASE WHEN p.p_partkey % 101 = 7 THEN ' unknown. ' ELSE
    CASE p.p_partkey % 8
      WHEN 0 THEN p.p_name || ' ' || lower(p.p_type) || ' – pn-' || CAST(p.p_partkey AS STRING) || '/a'
      WHEN 1 THEN p.p_name || ' ' || p.p_type || ' display  only'
      WHEN 2 THEN 'Cut N Grind Disc ' || p.p_name || ' ' || CAST(p.p_size AS STRING) || ' in'
      WHEN 3 THEN p.p_name || ' Patio  Dr Low-E ' || p.p_type
      WHEN 4 THEN 'SJTW cord ' || p.p_name
      WHEN 5 THEN p.p_name || '\x07 ' || CAST(p.p_size + 20 AS STRING) || ' in blade fan'
      WHEN 6 THEN 'ﬁne ' || p.p_name || ' — ' || p.p_type
                  || ' for general purpose maintenance and repair work with reinforced housing'
      ELSE 'Dish Washer ' || p.p_name || '_' END END AS part_desc,
  CASE WHEN p.p_partkey % 3 = 0 THEN '-- Unbranded --' WHEN p.p_partkey % 7 = 0 THEN NULL
       WHEN p.p_partkey % 19 = 4 THEN p.p_brand || ' Professional Series' WHEN p.p_partkey % 19 = 10 THEN p.p_brand || ' Profesional Series'
       ELSE p.p_brand END AS e1_brand,
  CASE WHEN p.p_partkey % 2 = 0 THEN 'No Unilog Brand' ELSE p.p_brand || '  Inc.' END AS unilog_brand,
  CASE WHEN p.p_partkey % 4 = 0 THEN ' - ' WHEN p.p_partkey % 4 = 1 THEN lower(p.p_brand) || ' LLC'
       WHEN p.p_partkey % 29 = 3 THEN 'Brand#' || CAST(p.p_partkey % 25 + 1 AS STRING) || ' Co'
       ELSE 'N/A' END AS dib_brand,
  CASE WHEN p.p_partkey % 31 = 0 THEN 'unknown' WHEN p.p_partkey % 37 = 0 THEN NULL
       WHEN p.p_partkey % 5 = 0 THEN upper(s.s_name) || ', INC.' WHEN p.p_partkey % 43 = 2 THEN replace(s.s_name, '#0', '#')
       ELSE s.s_name || ' Inc (' || CAST(s.s_suppkey AS STRING) || ')' END AS part_manuf
FROM {part} p
LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS suppkey FROM {lineitem} GROUP BY l_partkey) m
  ON m.l_partkey = p.p_partkey
LEFT JOIN {supplier} s ON s.s_suppkey = m.suppkey
"""

# wide truth rows: source, names, path, descriptions and six label/value/unit triples
VIEWS["truth"] = """
SELECT p.p_partkey + 1 AS row_no,
  CASE WHEN p.p_partkey % 50 = 49 THEN '' ELSE
    'Supplies>' || p.p_type || '>' || substr(p.p_name, length(p.p_name) - 4) || '>' || p.p_name END AS classpath,
  CASE WHEN p.p_partkey % 9 = 8 THEN '' WHEN p.p_partkey % 5 < 3 THEN upper(p.p_name)
       ELSE p.p_name || ' unit' END AS product_name,
  CASE WHEN p.p_partkey % 6 = 5 THEN '' ELSE 'Maker ' || p.p_brand || ' Inc' END AS manufacturer_name,
  p.p_brand || '®' AS brand_name,
  CASE WHEN p.p_partkey % 11 = 10 THEN '43211500' ELSE '' END AS unspsc,
  '' AS country_of_origin,
  'Mobile ' || p.p_name AS mobile_desc, upper(p.p_name) || ' ' || CAST(p.p_size AS STRING) AS invoice_desc,
  p.p_brand || ' ' || p.p_name || ', ' || lower(p.p_type) AS short_desc,
  CASE WHEN p.p_partkey % 4 = 0 THEN '' ELSE p.p_brand || ' ' || p.p_name || ', ' || CAST(p.p_size AS STRING)
       || ' in, ' || p.p_type END AS long_desc1,
  p.p_name || ', ' || p.p_type AS retail_desc, '' AS marketing_description,
  'Size' AS attribute_label_1, CAST(p.p_size AS STRING) || '.25' AS attribute_value_1,
  CASE p.p_partkey % 6 WHEN 0 THEN 'in' WHEN 1 THEN 'Inches' WHEN 2 THEN '"' WHEN 3 THEN 'ft'
       WHEN 4 THEN 'furlong' ELSE '' END AS attribute_uom_1,
  'Weight' AS attribute_label_2, CAST(p.p_size % 12 AS STRING) || CASE WHEN p.p_partkey % 3 = 0 THEN ' lb' ELSE '' END
    AS attribute_value_2,
  CASE p.p_partkey % 4 WHEN 0 THEN 'lb' WHEN 1 THEN 'pounds' WHEN 2 THEN 'V' ELSE '' END AS attribute_uom_2,
  CASE WHEN p.p_partkey % 10 = 0 THEN '' ELSE 'Color' END AS attribute_label_3,
  substr(p.p_name, 1, 3) AS attribute_value_3, '' AS attribute_uom_3,
  'Voltage Rating' AS attribute_label_4,
  CASE p.p_partkey % 5 WHEN 0 THEN '120 V' WHEN 1 THEN '240 volts' WHEN 2 THEN '' WHEN 3 THEN '12-24'
       ELSE '120' END AS attribute_value_4,
  CASE WHEN p.p_partkey % 5 >= 3 THEN 'V' ELSE '' END AS attribute_uom_4,
  'Series' AS attribute_label_5, p.p_brand AS attribute_value_5, '' AS attribute_uom_5,
  CASE WHEN p.p_partkey % 2 = 0 THEN 'Depth' ELSE 'Size' END AS attribute_label_6,
  CAST(p.p_size AS STRING) || '.5 x 10.125' AS attribute_value_6, 'inch' AS attribute_uom_6
FROM {part} p
"""

# measures with unit spellings, one per line item
VIEWS["measures"] = """
SELECT l_orderkey AS item_id, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
  CASE l_linenumber WHEN 1 THEN 'Size' WHEN 2 THEN 'Overall Length' WHEN 3 THEN 'Weight'
    WHEN 4 THEN 'Voltage Rating' WHEN 5 THEN 'Cut Depth' WHEN 6 THEN 'Power' ELSE 'Notes' END AS label,
  CASE l_partkey % 6
    WHEN 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)
    WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.375 in'
    WHEN 2 THEN ' ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.5  x 10.125 '
    WHEN 3 THEN '-' || CAST(CAST(l_quantity AS INT) AS STRING) || '.0078125'
    WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS STRING) || CASE l_linenumber WHEN 1 THEN '"' WHEN 2 THEN ' Volts'
       WHEN 3 THEN ' lbs' WHEN 4 THEN 'v' WHEN 5 THEN ' deg f' WHEN 6 THEN 'i' ELSE ' gallons per minute' END
    ELSE 'type ' || l_returnflag END AS value,
  CASE l_suppkey % 12 WHEN 0 THEN 'in' WHEN 1 THEN 'Inches' WHEN 2 THEN '"' WHEN 3 THEN ' FT '
    WHEN 4 THEN 'furlong' WHEN 5 THEN 'degrees  F' WHEN 6 THEN 'lbs' WHEN 7 THEN 'V' WHEN 8 THEN ''
    WHEN 9 THEN 'lb/in²' ELSE NULL END AS uom
FROM {lineitem}
"""

# extraction inputs: items with a description, and candidate values per item
VIEWS["items"] = """
SELECT p.p_partkey AS item_id, 'PN-' || CAST(p.p_partkey AS STRING) AS mpn,
  'Supplies>' || p.p_type || '>' || substr(p.p_name, length(p.p_name) - 4) || '>' || p.p_name AS classpath,
  p.p_brand || ' ' || p.p_name || ', Size ' || CAST(p.p_size AS STRING) || ' in, ' || p.p_type
    || ' grade, model: PN-' || CAST(p.p_partkey AS STRING)
    || CASE WHEN p.p_partkey % 3 = 0 THEN ' with a long list of further remarks and stated facts' ELSE '' END
    AS part_desc,
  CASE WHEN p.p_partkey % 7 = 0 THEN NULL
       ELSE 'brand' || substr(p.p_brand, 7) || '.example.com' END AS domain,
  CASE WHEN p.p_partkey % 5 = 0 THEN 0.65 ELSE 0.98 END AS manufacturer_confidence
FROM {part} p
"""
VIEWS["candidates"] = """
SELECT l.l_partkey AS item_id, (l.l_orderkey * 8 + l.l_linenumber) * 1048576 + l.l_suppkey AS pos,
  CASE l.l_linenumber WHEN 1 THEN 'Size' WHEN 2 THEN 'Color' WHEN 3 THEN 'Grade' WHEN 4 THEN 'Series'
    WHEN 5 THEN 'Model' WHEN 6 THEN 'Size' ELSE 'Warranty' END AS label,
  CASE l.l_linenumber WHEN 1 THEN CAST(p.p_size AS STRING) || ' in' WHEN 2 THEN substr(p.p_name, 1, 3)
    WHEN 3 THEN p.p_type WHEN 4 THEN p.p_brand WHEN 5 THEN ' pn-' || CAST(p.p_partkey AS STRING) || ' '
    WHEN 6 THEN CAST(p.p_size + l.l_suppkey % 2 AS STRING) || ' in' ELSE '1 year' END AS value,
  CASE WHEN l.l_quantity < 6 THEN 'quoted from nowhere' WHEN l.l_linenumber = 1 THEN 'SIZE ' || CAST(p.p_size AS STRING) || ' IN'
    WHEN l.l_linenumber = 5 AND l.l_suppkey % 2 = 0 THEN 'model: PN-' || CAST(p.p_partkey AS STRING)
    WHEN l.l_linenumber = 5 THEN 'PN-' || CAST(p.p_partkey AS STRING)
    WHEN l.l_linenumber = 6 THEN 'Size ' || CAST(p.p_size AS STRING) || ' in'
    ELSE p.p_brand || ' ' || p.p_name || ', Size ' || CAST(p.p_size AS STRING) || ' in, ' || p.p_type END AS source_excerpt,
  CASE WHEN l.l_returnflag = 'R' THEN 'manufacturer_site' ELSE 'description' END AS source_type
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
"""
# site pages claimed for an item, some of them on foreign hosts
VIEWS["evidence"] = """
SELECT p.p_partkey AS item_id, 1 AS rank,
  CASE WHEN p.p_partkey % 4 = 0 THEN 'https://brand' || substr(p.p_brand, 7) || '.example.com.evil.test/x'
       WHEN p.p_partkey % 4 = 1 THEN 'https://www.brand' || substr(p.p_brand, 7) || '.example.com/p?id=1'
       ELSE 'http://shop.BRAND' || substr(p.p_brand, 7) || '.example.com:8080/item' END AS url,
  p.p_brand || ' ' || p.p_name || ', size ' || CAST(p.p_size AS STRING) || ' in, ' || p.p_type || ' grade' AS text
FROM {part} p
"""

# one extracted value per (order, label, index), with its verdict and decision tables
VIEWS["extracted"] = """
SELECT item_id, label, row_number() OVER (PARTITION BY item_id, label ORDER BY partkey, suppkey) - 1 AS idx,
  value, uom, source_type, excerpt
FROM (SELECT l_orderkey AS item_id, l_partkey AS partkey, l_suppkey AS suppkey,
  CASE l_linenumber WHEN 1 THEN 'Size' WHEN 2 THEN 'Weight' WHEN 3 THEN 'Color' WHEN 4 THEN 'Voltage Rating'
    WHEN 5 THEN 'Depth' WHEN 6 THEN 'Series' ELSE 'Material' END AS label,
  CASE l_linenumber WHEN 3 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'blue' ELSE 'Navy Blue' END
    WHEN 6 THEN 'Series ' || l_returnflag WHEN 7 THEN CASE l_suppkey % 2 WHEN 0 THEN 'Stainless Steel' ELSE 'stainless-steel' END
    WHEN 4 THEN CASE l_suppkey % 3 WHEN 0 THEN '120 V' WHEN 1 THEN '120volts' ELSE '240' END
    ELSE CAST(CAST(l_quantity AS INT) AS STRING) || CASE l_suppkey % 3 WHEN 0 THEN '.25' WHEN 1 THEN '.5 in' ELSE '' END END AS value,
  CASE WHEN l_linenumber IN (1, 5) AND l_suppkey % 3 <> 1 THEN CASE l_partkey % 3 WHEN 0 THEN 'inch' WHEN 1 THEN 'IN' ELSE 'furlong' END
    WHEN l_linenumber = 2 AND l_suppkey % 3 <> 1 THEN 'pounds' WHEN l_linenumber = 4 AND l_suppkey % 3 = 2 THEN 'V' ELSE NULL END AS uom,
  CASE WHEN l_returnflag = 'R' THEN 'manufacturer_site' WHEN l_linestatus = 'F' AND l_partkey % 17 = 0 THEN NULL
       ELSE 'description' END AS source_type,
  'line ' || CAST(l_partkey AS STRING) AS excerpt
FROM {lineitem}) x
"""
VIEWS["item_paths"] = """
SELECT o_orderkey AS item_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Orders>' || o_orderpriority || '>' || o_orderstatus END AS classpath
FROM {orders}
"""
# controlled values: closed buckets for one status, open buckets elsewhere
VIEWS["allowed"] = """
SELECT classpath, label, value, uom, min(seq) AS seq FROM (
  SELECT 'Orders>' || o_orderpriority || '>' || o_orderstatus AS classpath, o_orderkey AS seq,
    CASE o_orderkey % 5 WHEN 0 THEN 'Size' WHEN 1 THEN 'Weight' WHEN 2 THEN 'Color' WHEN 3 THEN 'Material' ELSE 'Voltage Rating' END AS label,
    CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 40 AS STRING) || '-1/4' WHEN 1 THEN CAST(o_orderkey % 37 AS STRING)
      WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'RED' ELSE 'Blue' END WHEN 3 THEN 'Stainless Steel'
      ELSE CASE o_orderkey % 2 WHEN 0 THEN '120' ELSE '240' END END AS value,
    CASE o_orderkey % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'lb' WHEN 4 THEN 'V' ELSE NULL END AS uom
  FROM {orders} WHERE o_orderstatus <> 'P') x
GROUP BY classpath, label, value, uom
"""
VIEWS["closed"] = """
SELECT DISTINCT 'Orders>' || o_orderpriority || '>' || o_orderstatus AS classpath,
  CASE o_orderkey % 3 WHEN 0 THEN 'Size' WHEN 1 THEN 'Depth' ELSE 'Color' END AS label
FROM {orders} WHERE o_orderstatus = 'F'
"""
VIEWS["normalized"] = """
SELECT item_id, label, idx,
  CASE WHEN (item_id + idx) % 4 = 0 THEN NULL WHEN label = 'Color' THEN lower(value)
       WHEN uom = 'pounds' THEN value WHEN label = 'Material' THEN 'Stainless Steel' ELSE trim(value) END AS value,
  CASE WHEN (item_id + idx) % 4 = 0 THEN NULL WHEN uom = 'pounds' THEN 'lb' WHEN label = 'Voltage Rating' THEN 'V'
       WHEN uom IN ('inch', 'IN') THEN 'in' ELSE NULL END AS uom,
  source_type, excerpt
FROM {extracted}
"""
VIEWS["verdicts"] = """
SELECT l_orderkey AS item_id, (l_partkey * 64 + l_linenumber) * 1048576 + l_suppkey AS pos,
  CASE l_linenumber WHEN 1 THEN 'Size' WHEN 2 THEN 'Weight' WHEN 3 THEN 'Color' WHEN 4 THEN 'Voltage Rating'
    WHEN 5 THEN 'Finish' WHEN 6 THEN 'Series' ELSE 'Material' END AS label,
  CASE WHEN l_quantity <= 30 THEN 'supported' WHEN l_quantity <= 36 THEN 'partially_supported'
    WHEN l_quantity <= 44 THEN 'not_supported' ELSE 'ambiguous' END AS entailment,
  CAST(CAST(floor(l_discount * 100 + 0.5) AS INT) AS DOUBLE) / 10 AS confidence, 'checked line ' || CAST(l_partkey AS STRING) AS reasoning
FROM {lineitem} WHERE l_shipdate < TIMESTAMP '2000-07-01 00:00:00'
"""
VIEWS["failed_items"] = """
SELECT o_orderkey AS item_id FROM {orders} WHERE o_orderkey % 41 = 0
"""

# taxonomy from distinct part names, query texts, and class vectors
VIEWS["taxonomy"] = """
SELECT lpad(CAST(min(p_partkey) AS STRING), 8, '0') AS commodity_code, p_name AS commodity_name,
  'F-' || p_type AS family_code, p_type || ' goods' AS family_name, 'S-ALL' AS segment_code, 'All Goods' AS segment_name,
  'C-' || p_type || '-' || substr(p_name, length(p_name) - 3) AS class_code,
  p_type || ' ' || substr(p_name, length(p_name) - 3) || ' class' AS class_name
FROM {part} GROUP BY p_name, p_type
"""
VIEWS["queries"] = """
SELECT query, min(p_partkey) AS query_id FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN lower(p_type) || ' ' || p_name
    WHEN 2 THEN 'gearing and plated ' || p_name ELSE upper(p_name) || ' ' || p_brand END AS query FROM {part}) x
GROUP BY query
"""
VIEWS["class_labels"] = """
SELECT class_code, min(CAST(commodity_code AS INT)) % 10 AS label FROM {taxonomy} GROUP BY class_code
"""

# observed spellings of organizations, with suffix and punctuation variants
VIEWS["spellings"] = """
SELECT name AS value, row_no FROM (
  SELECT l.l_orderkey * 8 + l.l_linenumber AS row_no,
    CASE WHEN l.l_orderkey % 7 = 0 THEN upper(s.s_name) || ' CO.' WHEN l.l_orderkey % 7 = 1 THEN replace(s.s_name, '#', ' ') || ' Inc (' || CAST(s.s_nationkey AS STRING) || ')'
         WHEN l.l_orderkey % 7 = 2 THEN s.s_name || ', LLC' WHEN l.l_orderkey % 97 = 3 THEN replace(s.s_name, '#0', '#') ELSE s.s_name END AS name
  FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey) x
"""
VIEWS["pages_linked"] = """
SELECT page_id, url, replace(replace(html, '<a href="/The"', '<a class="result__a" rel="n" href="https://duck.example/l/?uddg=https%3A%2F%2Fwww.amazon.com%2Fx&amp;r=1"'),
  '<a href="/', '<a class="result__a" rel="n" href="https://www.site' || CAST(page_id % 17 AS STRING) || '.example.com/') AS html
FROM {pages}
"""
# finished records, one per event, for the evaluation and monitoring reports
VIEWS["records"] = """
SELECT event_id, 'item-' || CAST(user_id AS STRING) AS item_id, ts,
  'PN-' || CAST(event_id % 500 AS STRING) AS mpn,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(40180000 + user_id % 90 AS STRING) END AS code,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Goods>' || event_type || '>kind ' || CAST(user_id % 9 AS STRING) END AS classpath,
  CAST(CAST(floor(value * 100) AS INT) % 101 AS DOUBLE) / 100 AS confidence,
  event_type = 'click' OR event_type = 'view' AS lookup_attempted,
  CASE WHEN event_type = 'click' THEN event_id % 2 = 0 WHEN event_type = 'view' THEN event_id % 5 = 0 ELSE NULL END AS cache_hit,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'pending' ELSE 'completed' END AS state,
  CAST(event_id % 7 AS INT) AS produced, CAST(7 + event_id % 3 AS INT) AS expected,
  CAST(event_id % 5 AS INT) AS desc_ok, CAST(5 AS INT) AS desc_total,
  event_id % 4 <> 1 AS routed, event_id % 6 = 0 AS adjudicated,
  CASE WHEN event_id % 4 = 2 THEN NULL ELSE CAST((event_id % 9) AS INT) END AS vocab_total,
  event_id % 100 AS batch_no, props
FROM {events}
"""


def refs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def spread(df: DataFrame) -> DataFrame:
    """Give row-wise work all cores when the files come as fewer splits than that (a
    single small row group); a no-op for data of any size worth splitting."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Tables:
    """Lazy access to the driver tables and the views above, by attribute or key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.held = safe_unions(spark), folder, {}

    def given(self, **frames: DataFrame) -> "Tables":
        """The same tables with these in place of those named."""
        out = Tables(self.spark, self.folder)
        out.held = self.held | frames
        return out

    def by_order(self) -> "Tables":
        """The same tables with line items dealt by order: views number the lines of an order where they lie, and only the raw
        columns are shuffled, not the texts made of them."""
        return self.given(lineitem=self.lineitem.repartition("l_orderkey"))

    def hold(self, **columns: list[str]) -> "Tables":
        """The same tables with some columns of the views named written once, for views that are read often."""
        return self.given(**{name: stored(self[name].select(*wanted), f"view-{name}") for name, wanted in columns.items()})

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.held:
            return self.held[name]
        if name in VIEWS:
            sql = VIEWS[name]
            return self.spark.sql(sql, **{r: self[r] for r in refs(sql)})
        if name not in TABLES:
            raise KeyError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in ("lineitem", "orders", "documents", "pages") else df

    __getattr__ = __getitem__


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Check SQL: the named views a body reads, as CTEs in dependency order."""
    known = {**VIEWS, **(extra or {})}
    done: dict[str, str] = {}
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in seen and re.search(r"\b%s\b" % name, text):
                seen.add(name)
                visit(known[name])
                plain = re.sub(r"\{(\w+)\}", r"\1", known[name])
                done.setdefault(name, plain.replace("{{", "{").replace("}}", "}"))

    visit(body)
    if not done:
        return body
    used = lambda n: sum(len(re.findall(r"\b%s\b" % n, s)) for s in [body, *[v for k, v in done.items() if k != n]])
    ctes = "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if used(n) > 1 else ''}({s.strip()})" for n, s in done.items())
    own = re.match(r"\s*WITH\s", body)
    return ctes + (",\n" + body[own.end():] if own else "\n" + body)
