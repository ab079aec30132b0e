"""The delivery table's header contract, and all of its slots."""

import hashlib
import json

import pytest
from attestry import fixed_values as fv
from attestry.sources.catalog import SourceError, write_csv
from attestry.sources.reference import DELIVERY_TRIPLE, check_delivery_header, delivery_triples, read_delivery_csv

SLOTS = [name.format(n=n) for n in range(1, 51) for name in DELIVERY_TRIPLE]
HEADER = [*fv.DELIVERY_REQUIRED, *SLOTS]
HEADER += [f"Other {i}" for i in range(252 - len(HEADER))]


def digest(header):
    return hashlib.sha256(json.dumps(header, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("header,said", [
    (HEADER[:-1], "252 columns"), ([*HEADER[:-1], HEADER[0]], "repeats"), (["Else", *HEADER[1:]], "required"),
    ([*HEADER[:-1], "ATTRIBUTE_LABEL 51"], "slots"), ([HEADER[1], HEADER[0], *HEADER[2:]], "hash")])
def test_bad_headers_are_refused(spark, tmp_path, header, said):
    (tmp_path / "d.csv").write_text(",".join(f'"{c}"' for c in header) + "\n" + ",".join("x" for _ in header) + "\n")
    with pytest.raises(SourceError, match=said):
        read_delivery_csv(spark, str(tmp_path / "d.csv"), digest(HEADER))


def test_all_slots_come_back(spark, tmp_path):
    rows = [tuple(f"{c} of {i}, \"q\"" for c in HEADER) for i in range(20)]
    write_csv(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in HEADER)).repartition(3), str(tmp_path / "d"), quote_all=True)
    back = read_delivery_csv(spark, str(tmp_path / "d"), digest(HEADER))
    assert back.columns == HEADER and sorted(map(tuple, back.collect())) == sorted(rows) and check_delivery_header(HEADER) == list(range(1, 51))
    long = delivery_triples(back, ["Mfg_Part_Num"])
    assert long.count() == 1000 and long.where("slot = 50").first()["label"].startswith("ATTRIBUTE_LABEL 50 of")
