"""Token ids and counts of whole texts, with a bounded cache of text chunks in each worker.

Both supported tokenizers split a text before they merge bytes, and never join
what a space followed by a non-space separates.  A text can therefore be cut in
front of such a space, and chunks seen before need not be encoded again.
`tests/llm/test_tokens.py` holds the results against the tokenizers library's
own encoding of whole texts.
"""

import functools
import json
import re
import struct

#: chunks kept by a worker; when full, the cache starts anew
CACHE = 300_000
#: longer chunks are encoded each time
LONGEST = 40
#: characters of text that are encoded together
SLICE = 2_000_000

_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")
_PLAIN_WORD = re.compile(r"([A-Za-z]+)([.,]?)")
_LATIN = re.compile(r"[ -ɏ]*")
_LOADED: dict = {}


@functools.lru_cache(maxsize=256)
def _IDS(n: int) -> struct.Struct:
    return struct.Struct(f"<{n}I")


def loaded(kind: type, path: str):
    """The worker's encoder for a file; workers outlive tasks, and so does the cache."""
    key = kind.__name__, path
    if key not in _LOADED:
        _LOADED[key] = kind(path)
    return _LOADED[key]


def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


class ChunkEncoder:
    """Ids of byte-level BPE, as the tokenizers library gives them for a whole text without added special tokens."""

    def __init__(self, path: str):
        self.path = path
        self.cache: dict[str, bytes] = {}
        self.quick = self._quick(path)

    @functools.cached_property
    def tokenizer(self):
        """Loaded when a chunk needs it."""
        return tokenizer_of(self.path)

    def _quick(self, path: str):
        """A faster encoder over the same vocabulary; only given chunks of Latin characters."""
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level BPE writes as themselves
        named = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
        ranks = {bytes(named[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("quick", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunk: str) -> bytes:
        if _LATIN.fullmatch(chunk) and "<|" not in chunk:
            ids = self.quick.encode_ordinary(chunk)
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return _IDS(len(ids)).pack(*ids)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        first, *rest = text.split(" ") if not _ODD_SPACE.search(text) else _CUT.split(text)
        values = list(map(self.cache.get, rest))
        if None in values:
            cache = self.cache
            if len(cache) > CACHE:
                cache.clear()
            for i, value in enumerate(values):
                if value is None:
                    chunk = rest[i]
                    value = cache.get(chunk)
                    if value is None:
                        value = self.encode(" " + chunk)
                        if len(chunk) <= LONGEST:
                            cache[chunk] = value
                    values[i] = value
        return self.encode(first) + b"".join(values)


class ChunkCounter:
    """Token counts for a tokenizer that folds case and drops white space: chunks lie between spaces or line feeds."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        self.cache: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of texts that together fit in memory; unknown chunks of all of them are encoded in one call."""
        cache, once = self.cache, {}
        if len(cache) > CACHE:
            cache.clear()
        chunks = [[c for c in t.replace("\n", " ").split(" ") if c] for t in texts]
        missing, plain = [], {}
        for chunk in {c for own in chunks for c in own if c not in cache}:
            word = _PLAIN_WORD.fullmatch(chunk)
            if word:                              # a word and its punctuation mark are split anyway
                parts = plain[chunk] = [x for x in (word[1].lower(), word[2]) if x]
                missing += [x for x in parts if x not in cache]
            else:
                missing.append(chunk)
        missing = list(dict.fromkeys(missing))
        for i in range(0, len(missing), 4096):
            part = missing[i:i + 4096]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                (cache if len(chunk) <= LONGEST else once)[chunk] = len(e)
        for chunk, parts in plain.items():
            n = sum(cache[x] if x in cache else once[x] for x in parts)
            (cache if len(chunk) <= LONGEST else once)[chunk] = n
        return [sum(map(cache.get, own)) if not once else sum(cache[c] if c in cache else once[c] for c in own) for own in chunks]


def parts(batches, rows: int = 1000):
    """Arrow batches in smaller pieces, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(texts: list[str]):
    """Index ranges of at most SLICE characters (or one text)."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)
