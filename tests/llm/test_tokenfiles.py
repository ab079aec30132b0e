"""Token files against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from attestry.llm import queries, tokenfiles
from attestry.llm.tokenfiles import FileParams, WordEncoder
from attestry.llm.tokens import tokenizer_of
from attestry.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, path=FILE, end=1):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows in ascending order."""
    tokenizer, out, at = tokenizer_of(path), [], 0
    ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for i, t in rows]
    for i, data in sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        out.append((i, at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    return out


def written(spark, docs, p):
    target = scratch_path(spark, "token-files")
    tokenfiles.write(docs, target, p)
    return target, tokenfiles.read(spark, target, with_ids=True)


@pytest.mark.parametrize("rows,file_tokens", [(50_000, 16_000_000), (3, 16_000_000), (4, 10), (7, 1)])
def test_round_trip_of_odd_rows(spark, odd, rows, file_tokens):
    target, back = written(spark, odd, FileParams(FILE, rows=rows, file_tokens=file_tokens))
    back = back.orderBy("position").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back] == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert [r.position for r in back] == list(range(len(back))) and all(len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32 for r in back)
    files = spark.read.parquet(f"{target}/manifest").collect()
    assert {f["kind"] for f in files} == {"<u2"} and (rows > 1000 or len(files) > 1)
    assert sum(f["tokens"] for f in files) == sum(r.n_tokens for r in back)


def test_other_tokenizers_and_widths(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not WordEncoder(path).by_word and WordEncoder(FILE).by_word
    docs = odd.where("doc_id < 6 or doc_id > 11")
    _, back = written(spark, docs, FileParams(path, end_id=70_000 % 65_536))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in back.collect()) == sorted(
        (i, n, c) for i, _, n, c in expected([(r.doc_id, r.text) for r in docs.collect()], path, 70_000 % 65_536))


def test_words_side_by_side():
    """Every word of the vocabulary, and many made up of its parts or of any letters, as the library encodes them alone."""
    rng, encoder = random.Random(4), WordEncoder(FILE)
    vocab = sorted({t.removesuffix("</w>") for t in encoder.tokenizer.get_vocab() if t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha()})
    words = vocab + ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 5))) for _ in range(30_000)]
    words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(rng.randint(1, 14))) + rng.choice(("", "", ",", ".", "..", "'s", "|", "|x", "-", "1", "é", "\xa0", "<|endoftext|>"))
              for _ in range(30_000)] + [",", ".", "|", "||", "\x1c", "'", "İ", "ſs", "K", "a\u0301", "\u0301"]
    words = sorted(set(words))
    expect = [np.array(e.ids, "<u2").tobytes() for e in encoder.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert encoder.ids(words) == expect
    texts = [" ".join(rng.choice(words) for _ in range(50)) + rng.choice(("", " ", "\n\n")) for _ in range(500)]
    assert encoder.ids(texts) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_unreferenced_files_do_not_count(spark, odd):
    """A task that ran twice leaves files that the manifest does not name."""
    target, back = written(spark, odd, FileParams(FILE, rows=4))
    before = sorted(map(tuple, back.drop("ids").collect()), key=str)
    store, path = tokenfiles._folder(f"{target}/data")
    with store.open_output_stream(f"{path}/stray.ids") as f:
        f.write(b"1234")
    assert sorted(map(tuple, tokenfiles.read(spark, target).collect()), key=str) == before


def test_empty_and_refused(spark, odd, none):
    _, back = written(spark, none, FileParams(FILE))
    assert back.collect() == []
    with pytest.raises(ValueError):
        tokenfiles.write(odd.selectExpr("cast(doc_id as string) doc_id", "text"), "unused", FileParams(FILE))


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.QUERIES["op11_tokenfiles"](spark, FOLDER).orderBy("doc_id").collect()
    assert list(map(tuple, got)) == expected([(r.doc_id, r.text) for r in docs.collect()])
