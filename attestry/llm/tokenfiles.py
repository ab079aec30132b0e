"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are encoded, dealt into ranges of ascending id, and each range writes
one or more files:

    <name>.ids    little-endian unsigned ids, 16 bits wide if the vocabulary allows, else 32
    <name>.idx    documents + 1 little-endian 64-bit offsets into .ids, in ids, from 0
    <name>.doc    little-endian 64-bit document ids; null ids come first

A manifest (Parquet) names the files that count, with their documents, ids and
nulls, and the ids and documents of all files before: the prefix sums that turn
offsets inside a file into offsets of the whole.  A file written by a lost or
repeated task has a name of its own and is not in the manifest.  Readers map
files into memory where the folder is mounted, and fetch them whole (they are
of bounded size, except for a single longer document) where it is not.

Cases: null and empty texts are the end id alone; texts of any length are
encoded whole; rows that repeat an id follow each other, ordered by their ids;
null document ids come first; document ids must be integers; extra columns are
ignored; an empty table gives an empty manifest and no files.
"""

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.tokens import LONGEST, loaded, parts, slices, tokenizer_of

#: words kept by a worker; when full, the cache starts anew
WORDS = 500_000
#: stands between words that are encoded together
SEPARATOR = "|"


@dataclass(frozen=True)
class FileParams:
    tokenizer: str
    end_id: int = 1
    rows: int = 50_000              # documents that a range is meant to hold
    ranges: int = 20_000            # ranges at most; more documents make longer ranges
    file_tokens: int = 16_000_000   # a file is closed when it has so many ids


#: what a tokenizer must do before it merges for its texts to be encoded word by word
_NORMAL = ["NFC", {"Regex": "\\s+"}, "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class LatinWords:
    """Ids of words of the letters a to z, with or without a comma or stop behind them, many at a time.

    The vocabulary writes the last letter of a word with an end sign; here it is a capital, so that words stand side by side in
    one string, end where a capital stands, and a byte-pair encoder over the same ranks keeps them apart.
    """

    def __init__(self, spec: dict):
        import tiktoken

        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        ranks, self.ends = {}, np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            body, last = (token[:-len(suffix)], True) if token.endswith(suffix) else (token, False)
            if body.isascii() and body.isalpha() and body.islower():
                ranks[(body[:-1] + body[-1].upper() if last else body).encode()] = i
                self.ends[i] = last
        for sign in ".,":
            ranks[sign.encode()] = vocab[sign + suffix]
            self.ends[vocab[sign + suffix]] = True
        made = [vocab["".join(m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or len(set(made)) != len(made) or not all(c.encode() in ranks for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            raise ValueError("the vocabulary is not in the order of its merges")
        self.encoding = tiktoken.Encoding("latin", pat_str="[a-z]*[A-Z]|[.,]", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def written(word: str) -> str | None:
        """The word as it stands in the string; None if it is of another kind."""
        if not word.isascii():
            return None
        mark = word[-1] if word[-1] in ".," else ""
        body = word[:-1] if mark else word
        return body[:-1].lower() + body[-1].upper() + mark if body.isalpha() else None

    def ids(self, written: list[str], kind: np.dtype) -> list[bytes]:
        ids = np.array(self.encoding.encode_ordinary("".join(written)), kind)
        ends = np.nonzero(self.ends[ids])[0] + 1
        count = np.cumsum([2 if w[-1] in ".," else 1 for w in written])
        cut = (ends[count - 1] * kind.itemsize).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cut], cut)]


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them.  Where the file's tokenizer drops white space and splits at it,
    a worker remembers the ids of words; other tokenizers encode each text in one piece."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        spec = json.load(open(path, encoding="utf-8"))
        normal = [x.get("pattern", x["type"]) for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        plain = all(not a["lstrip"] and not a["rstrip"] and " " not in a["content"] for a in spec["added_tokens"])
        self.by_word = plain and normal == _NORMAL and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert")
        self.type = np.dtype("<u2" if max(self.tokenizer.get_vocab(True).values()) < 65536 else "<u4")
        self.cache: dict[str, bytes] = {"": b""}
        mark = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.latin = LatinWords(spec) if self.by_word and spec["model"].get("end_of_word_suffix") else None

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words without blanks: many in one text, told apart by a mark that is a word and an id of its own.  Words that
        hold the mark, as special tokens may, are encoded one by one."""
        out, width = {}, self.type.itemsize
        if self.latin:
            written = list(map(self.latin.written, words))
            known = [(w, x) for w, x in zip(words, written) if x]
            words = [w for w, x in zip(words, written) if not x]
            for i in range(0, len(known), 65536):
                some = known[i:i + 65536]
                out.update(zip([w for w, _ in some], self.latin.ids([x for _, x in some], self.type)))
        plain = [w for w in words if SEPARATOR not in w]
        apart = [w for w in words if SEPARATOR in w]
        out.update(zip(apart, self._encoded(apart)))
        for i in range(0, len(plain), 4096):
            some = plain[i:i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(some)], add_special_tokens=False)[0].ids, self.type)
            ends = [*(np.nonzero(ids == self.mark)[0] * width).tolist(), len(ids) * width]
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not keep the mark apart")
            data = ids.tobytes()
            out.update(zip(some, [data[a:b] for a, b in zip([0, *[e + width for e in ends]], ends)]))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of texts that together fit in memory; unknown words of all of them are encoded in one go."""
        if not self.by_word or self.mark is None:
            return self._encoded(texts)
        cache, words, ends = self.cache, [], [0]
        if len(cache) > WORDS:
            cache.clear()
            cache[""] = b""
        for t in texts:
            words += t.replace("\n", " ").split(" ")
            ends.append(len(words))
        missing = list(set(words).difference(cache))
        cache.update(self._words(missing))
        found = list(map(cache.__getitem__, words))
        for w in missing:
            if len(w) > LONGEST:
                del cache[w]
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]


def _folder(path: str):
    """The file system of a path that Spark's checkpoints may be in, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _mapped(path: str, kind: np.dtype, n: int) -> np.ndarray:
    """A flat file as an array: mapped if it is local, else read."""
    store, name = _folder(path)
    if not n:
        return np.zeros(0, kind)
    if store.type_name == "local":
        return np.memmap(name, dtype=kind, mode="r", shape=(n,))
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind, n)


class _Writer:
    """The three files of one name; nothing but the manifest row tells that they count."""

    def __init__(self, folder: str, kind: np.dtype):
        self.store, self.at = _folder(folder)
        self.name, self.kind = uuid.uuid4().hex, kind
        self.out = self.store.open_output_stream(f"{self.at}/{self.name}.ids")
        self.docs, self.ends, self.nulls, self.n = [], [0], 0, 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.out.write(data)
        self.n += len(data) // self.kind.itemsize
        self.ends.append(self.n)
        self.nulls += doc_id is None
        self.docs.append(doc_id or 0)

    def close(self) -> tuple:
        self.out.close()
        for kind, values in (("idx", self.ends), ("doc", self.docs)):
            with self.store.open_output_stream(f"{self.at}/{self.name}.{kind}") as f:
                f.write(np.array(values, "<i8").tobytes())
        return self.name, len(self.docs), self.n, self.nulls


def write(docs: DataFrame, folder: str, p: FileParams) -> None:
    """Encode all documents into `folder`, which all executors reach."""
    whole = docs.schema["doc_id"].dataType.simpleString()
    if whole not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("document ids must be integers")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = min(p.ranges, -(-docs.count() // p.rows))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    store, path = _folder(folder)
    store.create_dir(f"{path}/data")
    end, file_tokens = p.end_id, p.file_tokens

    def encode(batches):
        encoder = loaded(WordEncoder, p.tokenizer)
        last = np.array([end], encoder.type).tobytes()
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = batch.column(0)
            steps = np.searchsorted(cuts, rows.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            for a, b in slices(texts):
                data = [x + last for x in encoder.ids(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(steps[a:b], pa.int32()), rows.slice(a, b - a), pa.array(data, pa.binary())], ["step", "doc_id", "ids"])

    def save(batches):
        kind, held, step, number = loaded(WordEncoder, p.tokenizer).type, None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (step, number, *held.close())],
                                                 ["step", "number", "name", "documents", "tokens", "nulls"])
        for batch in parts(batches):
            for s, i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and (s != step or held.n >= file_tokens):
                    yield row()
                    number, held = number + 1 if s == step else 0, None
                if not held:
                    step, held = s, _Writer(f"{folder}/data", kind)
                held.add(i, data.as_py())
        if held:
            yield row()

    ranged = docs.mapInArrow(encode, "step int, doc_id long, ids binary").repartition("step").sortWithinPartitions("step", "doc_id", "ids")
    ranged.mapInArrow(save, "step long, number long, name string, documents long, tokens long, nulls long").write.parquet(f"{folder}/files")
    files, before = docs.sparkSession.read.parquet(f"{folder}/files"), "coalesce(sum({}) over (order by step, number rows between unbounded preceding and 1 preceding), 0) {}"
    kind = WordEncoder(p.tokenizer).type.str
    files.select("*", *[F.expr(before.format(c, f"{c}_before")) for c in ("documents", "tokens")], F.lit(kind).alias("kind")).write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, position, start, n_tokens, ids_crc32 and, if asked for, ids) of every document, from the files; position is its
    place among all documents, start the ids before it, ids are unsigned little-endian 32-bit numbers."""

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                kind, path, n = np.dtype(f["kind"]), f"{folder}/data/{f['name']}", f["documents"]
                ids, ends, docs = _mapped(f"{path}.ids", kind, f["tokens"]), _mapped(f"{path}.idx", np.dtype("<i8"), n + 1), _mapped(f"{path}.doc", np.dtype("<i8"), n)
                at = 0
                while at < n:                                       # a bounded number of ids at a time
                    to = min(n, at + 10_000, max(at + 1, int(np.searchsorted(ends, ends[at] + 4_000_000, "right")) - 1))
                    own = ids[ends[at]:ends[to]].astype("<u4").tobytes()
                    cut = (4 * (ends[at:to + 1] - ends[at])).tolist()
                    pieces = [own[a:b] for a, b in zip(cut, cut[1:])]
                    columns = [pa.array(docs[at:to], pa.int64(), mask=np.arange(at, to) < f["nulls"]), pa.array(f["documents_before"] + np.arange(at, to)),
                               pa.array(f["tokens_before"] + ends[at:to]), pa.array(ends[at + 1:to + 1] - ends[at:to]), pa.array(list(map(zlib.crc32, pieces)), pa.int64())]
                    names = ["doc_id", "position", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(pieces, pa.binary())); names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    at = to

    files = spark.read.parquet(f"{folder}/manifest").select("name", "documents", "tokens", "nulls", "kind", "documents_before", "tokens_before")
    return files.repartition("name").mapInArrow(run, "doc_id long, position long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
