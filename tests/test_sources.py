"""Readers: row numbers over unequal files, refusals, code page, and workers that only have what is shipped."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import text as tx
from attestry.functions import web
from attestry.operators import delivery as dl
from attestry.operators.sampling import diverse_sample
from attestry.sources import catalog as src
from attestry.sources import reference as ref

HEADER = ",".join(fv.CATALOG_COLUMNS)


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    rows, at = [], 0
    for name, n in (("a.csv", 5), ("b.csv", 700), ("c.csv", 1), ("d.csv", 3000), ("e.csv", 40)):
        own = [f"P{i},{'long text ' * (i % 50)},,,," for i in range(at + 1, at + n + 1)]
        (tmp_path / name).write_text("\n".join([HEADER, *own]) + "\n")
        rows += own
        at += n
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")      # several splits in a file, several files in a task
    try:
        got = src.read_catalog_csv(spark, str(tmp_path)).select("source_row_number", "mfg_part_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r[0] for r in got) == list(range(1, at + 1)) and all(r[1] == f"P{r[0]}" for r in got)


def test_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '\nP1,"two\nlines",,,,\nP2,one,,,,\n')
    got = src.read_catalog_csv(spark, str(tmp_path), multi_line=True).orderBy("source_row_number").collect()
    assert [r["part_desc"] for r in got] == ["two\nlines", "one"]


def test_header_must_match(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(src.SourceError, match="header"):
        src.read_catalog_csv(spark, str(tmp_path))


REVERSED = ",".join(reversed(fv.CATALOG_COLUMNS))


@pytest.mark.parametrize("first, second", [(HEADER, REVERSED), (REVERSED, HEADER)])
def test_every_file_is_held_to_the_header(spark, tmp_path, first, second):
    """Whatever order the files have, a file with other columns is named and refused, by both readers."""
    for i, head in enumerate((first, second)):
        (tmp_path / f"{'ab'[i]}.csv").write_text(head + "\n1,2,3,4,5,6\n")
    for read in (src.read_catalog_csv, src.read_batch_csv):
        with pytest.raises(src.SourceError, match="differ in their headers: .*b.csv"):
            read(spark, str(tmp_path))
    (tmp_path / "c.csv").write_bytes(b"caf\xe9\n")
    with pytest.raises(src.SourceError, match="not UTF-8: .*c.csv"):
        src.read_batch_csv(spark, str(tmp_path))


def test_headers_may_be_quoted_and_marked(spark, tmp_path):
    quoted = ",".join(f'"{c}"' for c in fv.CATALOG_COLUMNS)
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + HEADER.encode() + b"\r\nP1,,,,,\r\n")
    (tmp_path / "b.csv").write_text(quoted + "\n" + "P2,,,,,\n" * 3)
    rows = src.read_catalog_csv(spark, str(tmp_path)).orderBy("source_row_number").collect()
    assert [(r["source_row_number"], r["mfg_part_num"]) for r in rows] == [(1, "P1"), (2, "P2"), (3, "P2"), (4, "P2")]


def delivery(spark, path, change=lambda names: names):
    names = change(list(ref.DELIVERY_COLUMNS))
    path.mkdir(exist_ok=True)
    text = ",".join(f'"{n}"' for n in names) + "\n" + ",".join(f"v{i}" for i in range(len(names))) + "\n"
    (path / f"{len(list(path.iterdir()))}.csv").write_text(text)
    return str(path)


def test_delivery_round_trip(spark, tmp_path):
    assert len(ref.DELIVERY_COLUMNS) == 252 and ref.check_delivery_header(list(ref.DELIVERY_COLUMNS)) == list(range(1, 51))
    rows = spark.createDataFrame([(1, "a\"b", None, " x "), (2, None, "5", "é")], "row int, label string, value string, brand string")
    wide = ref.delivery_rows(rows, {"PART_NUMBER": "row", "ATTRIBUTE_LABEL 50": "label", "ATTRIBUTE_VALUE 50": "value", "BRAND_NAME": "brand"})
    ref.write_delivery_csv(wide, str(tmp_path / "d"))
    back = ref.read_delivery_csv(spark, str(tmp_path / "d"))
    assert back.columns == list(ref.DELIVERY_COLUMNS) and sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))
    got = sorted(tuple(r) for r in ref.delivery_triples(back, ["PART_NUMBER"]).where("label <> '' or value <> ''").collect())
    assert got == [("1", 50, 'a"b', "", ""), ("2", 50, "", "5", "")]
    with pytest.raises(src.SourceError, match="no delivery fields"):
        ref.delivery_rows(rows, {"NOPE": "row"})
    with pytest.raises(src.SourceError, match="252 columns"):
        ref.write_delivery_csv(rows, str(tmp_path / "e"))


@pytest.mark.parametrize("change, message", [
    (lambda n: n[:-1], "252 columns, found 251"),
    (lambda n: [*n[:-1], n[0]], "repeats"),
    (lambda n: [c.replace("UNSPSC", "CODE") for c in n], "lacks required fields"),
    (lambda n: [c.replace("ATTRIBUTE_UOM 7", "ATTRIBUTE_UNIT 7") for c in n], "incomplete attribute slots"),
    (lambda n: [*n[1:2], *n[:1], *n[2:]], "differ in their headers")])
@pytest.mark.parametrize("wrong", [0, 1])
def test_delivery_files_that_are_refused(spark, tmp_path, change, message, wrong):
    """In a folder of two files, the wrong one first or second."""
    for i in range(2):
        path = delivery(spark, tmp_path / "d", change if i == wrong else lambda n: n)
    with pytest.raises(src.SourceError, match=message):
        ref.read_delivery_csv(spark, path)


def test_delivery_header_is_pinned_by_its_hash(spark, tmp_path):
    path = delivery(spark, tmp_path / "d", lambda n: [*n[1:2], *n[:1], *n[2:]])
    right = hashlib.sha256(json.dumps(list(ref.DELIVERY_COLUMNS), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert ref.read_delivery_csv(spark, path).count() == 1
    with pytest.raises(src.SourceError, match="hash"):
        ref.read_delivery_csv(spark, path, right)


def test_gaps_between_slots(spark, tmp_path):
    """A header that counts its slots from 2 to 51 is whole; every slot keeps its number."""
    shifted = [c.replace(" 1", " 51") if c.startswith("ATTRIBUTE") and c.endswith(" 1") else c for c in ref.DELIVERY_COLUMNS]
    back = ref.read_delivery_csv(spark, delivery(spark, tmp_path / "d", lambda n: shifted))
    assert sorted(r["slot"] for r in ref.delivery_triples(back, ["PART_NUMBER"]).collect()) == list(range(2, 52))


@pytest.mark.parametrize("body, message", [(b"P1,caf\xe9,,,,\n", "not UTF-8"), (b"", "no data rows"), (b" ,,,,,\n", "no data rows")])
def test_batches_that_are_refused(spark, tmp_path, body, message):
    (tmp_path / "a.csv").write_bytes(HEADER.encode() + b"\n" + body)
    with pytest.raises(src.SourceError, match=message):
        src.read_batch_csv(spark, str(tmp_path))


def test_batch_text_with_replacement_character_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + ",extra\nP1,caf� é,,,,,x\n", encoding="utf-8")
    assert src.read_batch_csv(spark, str(tmp_path)).first()["Part_Desc"] == "caf� é"


def taxonomy_file(path, *codes):
    lines = [",".join(fv.TAXONOMY_COLUMNS), *[f"1,Seg,2,Fam,3,“Class” – €,{c},Näme™" for c in codes]]
    path.write_bytes("\r\n".join(lines).encode("windows-1252"))
    return str(path)


def test_taxonomy_in_the_windows_code_page(spark, tmp_path):
    row = ref.read_taxonomy(spark, taxonomy_file(tmp_path / "t.csv", "10000001", "10000002")).orderBy("commodity").first()
    assert (row["class_name"], row["commodity_name"], row["commodity"]) == ("“Class” – €", "Näme™", "10000001")
    for codes, problem in ((("10000001", "10000001"), "duplicate"), (("1000",), "invalid")):
        with pytest.raises(src.SourceError, match=problem):
            ref.read_taxonomy(spark, taxonomy_file(tmp_path / f"{problem}.csv", *codes))


def test_unsupported_units_are_refused(spark):
    rows = [(1, "P", "Size", "1", "inch"), (2, "P", "Size", "2", "furlong")]
    values = ref.allowed_values(spark.createDataFrame(rows, "row_no int, Classpath string, Attribute string, Value string, UOM string"))
    with pytest.raises(src.SourceError, match="unit"):
        ref.require_valid_units(values)


def test_labels_past_the_last_slot_stop_the_job(spark):
    slots = spark.createDataFrame([(1, 50, "a", "v", None), (2, 51, "b", "v", None)], "item_id int, slot int, label string, value string, uom string")
    assert dl.wide_slots(slots.where("slot = 50")).first()["attribute_label_50"] == "a"
    with pytest.raises(Exception, match="more than 50 labels"):
        dl.wide_slots(slots).collect()


def test_case_folding(values):
    texts = ["STRASSE straße", "ΟΔΟΣ", "οδος", "ﬁne ﬄ", "ŉ", "İ", "µ", "Ǆ", "ẞ", None]
    assert values(tx.casefold, texts) == [t.casefold() if t else None for t in texts]


def test_page_text_says_what_it_leaves_out(spark):
    df = spark.createDataFrame([("<p>" + "ab " * 10 + "</p>",)], "h string")
    row = df.select(web.page_text(F.col("h"), 5).alias("short"), web.page_text(F.col("h"), None).alias("whole")).first()
    assert tuple(row["short"]) == ("ab ab", 29, True) and tuple(row["whole"]) == (" ".join(["ab"] * 10), 29, False)


def test_the_empty_maker_is_used_once(spark):
    rows = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}", None if i < 4 else f"m{i}") for i in range(8)]
    picks = [r["item_id"] for r in diverse_sample(spark.createDataFrame(rows, "item_id bigint, text string, maker string"), 5).orderBy("pick").collect()]
    assert len([p for p in picks if p < 4]) == 1


def test_workers_get_the_package(tmp_path):
    """From another folder, without the repository on the workers' path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from attestry.session import local_session
spark = local_session(2, 2)
print('ROWS', e.queries()['nrm_constrain'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
