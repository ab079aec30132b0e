"""Personal data in whole texts: patterns propose spans, checksums confirm them, context words move the score.

Everything is a Spark expression.  The positions of the matches come from the
text's gaps: `split` by a pattern gives what lies between its leftmost,
non-overlapping matches, so the running lengths of gaps and matches are the
offsets (code points, end exclusive).

Cases: a null or empty text has no spans; any number of spans is kept; extra
columns are ignored; rows that repeat an id are treated row by row; an empty
table gives an empty table.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = ("email", "ip", "card", "phone")

# Possessive quantifiers and look-behinds only save retries that must fail, so that long runs stay linear:
# the matches are the leftmost non-overlapping ones of the plain pattern given in each comment.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ whose whole run has 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # no letter or digit may stand on either side, which is checked afterwards
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


@dataclass(frozen=True)
class PiiParams:
    window: int = 40            # code points before a span that are searched for context words
    raised: float = 0.2         # added when a context word of the kind is near
    lowered: float = 0.3        # taken off when a word of the opposite sense is near
    redact_from: float = 0.4    # spans scored below stay in the text


SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95}
NEAR = {
    "email": r"mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": r"card|karte|carte|tarjeta|visa|credit",
    "phone": r"phone|\btel|call|mobil|fax|ruf",
    "iban": r"iban|account|konto|compte|cuenta|bank",
}
AGAINST = {
    "email": r"(?!)",
    "ip": r"\b(?:versions?|releases?|sections?|chapters?)\b|\bv\.?\s*$",
    "card": r"\b(?:serials?|orders?(?!\s+to\b)|isbn|tracking)\b",
    "phone": r"\b(?:serials?|orders?(?!\s+to\b)|isbn|versions?)\b",
    "iban": r"\b(?:serials?|orders?(?!\s+to\b)|licen[cs]e keys?)\b",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _mod97(value: Column) -> Column:
    """An account number is right if, read with its first four characters last and letters as 10 to 35, it is 1 modulo 97."""
    plain = F.regexp_replace(value, r"\x20", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda rest, c: F.when(c.rlike("^[0-9]$"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return _mod97(value)


def _apart(kind: str, text: Column, start: Column, value: Column) -> Column:
    """Account numbers stand alone: no letter or digit touches them."""
    if kind != "iban":
        return F.lit(True)
    before = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise("")
    after = F.substr(text, start + F.length(value) + 1, F.lit(1))
    return ~F.concat(before, F.lit(" "), after).rlike("[A-Za-z0-9]")


def _starts(text: Column, found: Column, pattern: str) -> Column:
    """Start of each match: lengths of the gaps up to it and of the matches before it."""
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"),
                                   F.concat(acc["starts"], F.array(acc["at"] + x["g"])).alias("starts"))
    return F.aggregate(steps, begin, step)["starts"]


def _score(kind: str, text: Column, start: Column, p: PiiParams) -> Column:
    before = F.lower(F.substr(text, F.greatest(F.lit(1), start + 1 - p.window), F.least(F.lit(p.window), start)))
    moved = (F.lit(SCORES[kind]) + F.when(before.rlike(NEAR[kind]), p.raised).otherwise(0.0)
             - F.when(before.rlike(AGAINST[kind]), p.lowered).otherwise(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 3)


def _confirmed(kind: str, rank: int, text: Column, values: Column, p: PiiParams) -> Column:
    def span(pair: Column) -> Column:
        start, value = pair["start"], pair["value"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(value)).alias("end"), F.lit(kind).alias("kind"),
                        value.alias("value"), _score(kind, text, start, p).alias("score"))

    pairs = F.zip_with(_starts(text, values, PATTERNS[kind]), values, lambda s, v: F.struct(s.alias("start"), v.alias("value")))
    return F.transform(F.filter(pairs, lambda x: _valid(kind, x["value"]) & _apart(kind, text, x["start"], x["value"])), span)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", p: PiiParams = PiiParams()) -> DataFrame:
    """Add `out`: an array of (start, rank, end, kind, value, score), by start, then kind in KINDS order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumns({f"{out}_found_{k}": F.regexp_extract_all(text, F.lit(v), F.lit(0)) for k, v in PATTERNS.items()})
    parts = []
    for rank, kind in enumerate(KINDS):
        values = F.col(f"{out}_found_{kind}")

        parts.append(F.when(F.size(values) > 0, _confirmed(kind, rank, text, values, p)))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>")
    joined = F.array_sort(F.concat(*[F.coalesce(x, none) for x in parts]))
    return found.withColumn(out, joined).drop(*[f"{out}_found_{k}" for k in PATTERNS])


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """Score of each span in thousandths, comma-joined, in the order of `digest`."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 1000).cast("int").cast("string")), ",")


def redacted(text: Column, spans: Column, p: PiiParams = PiiParams()) -> Column:
    """The text with each span that scores enough replaced by its kind in brackets; spans inside an earlier one go with it."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    finish = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1))
    strong = F.filter(spans, lambda s: s["score"] >= p.redact_from)
    return F.when(F.size(strong) > 0, F.aggregate(strong, begin, step, finish)).otherwise(text)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: PiiParams = PiiParams()) -> DataFrame:
    """(id, spans) for each row."""
    return with_spans(docs.select(id_col, text_col), text_col, "spans", p).select(id_col, "spans")


def redact(docs: DataFrame, text_col: str = "text", p: PiiParams = PiiParams()) -> DataFrame:
    """The rows with personal data taken out of the text; other columns stay as they are."""
    marked = with_spans(docs, text_col, "__pii", p)
    return marked.withColumn(text_col, redacted(F.col(text_col), F.col("__pii"), p)).drop("__pii")


def _spans(text: Column, p: PiiParams) -> Column:
    found = [_confirmed(k, rank, text, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)), p) for rank, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _until_clean(text: Column, p: PiiParams) -> Column:
    """Redacted again until no span is left: a span taken out can free a match, as a card whose run went on into an address."""
    begin = F.struct(text.alias("text"), F.lit(True).alias("open"))

    def step(acc: Column, _: Column) -> Column:
        once = F.transform(F.array(_spans(acc["text"], p)), lambda s: F.struct(redacted(acc["text"], s, p).alias("text"), (F.size(s) > 0).alias("open")))
        return F.when(acc["open"], F.element_at(once, 1)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.length(text)), begin, step, lambda acc: acc["text"])


def redact_all(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Like `redact`, for every confirmed span whatever its score; the finder reports none in the result."""
    p = PiiParams(redact_from=0.0)
    marked = with_spans(docs, text_col, "__pii", p)
    once = marked.withColumn(text_col, redacted(F.col(text_col), F.col("__pii"), p))
    return once.withColumn(text_col, F.when(F.size("__pii") > 0, _until_clean(F.col(text_col), p)).otherwise(F.col(text_col))).drop("__pii")
