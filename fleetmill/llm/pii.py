"""Personal data in texts (operator 1): patterns propose, checksums confirm, context adjusts.

Made of DataFrame functions only. A pattern's matches and the pieces between them give the places of
the matches by running lengths. Patterns are written so that each text is passed over once: what
repeats takes all it can without going back, and a match may begin inside a run of its own first
characters only where the match before it ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span that are searched for context words.
CONTEXT_CHARS = 40
#: Added to a score for a valid checksum and for a context word nearby.
CHECKSUM_BONUS, CONTEXT_BONUS = 0.5, 0.3
#: Least score of a span of the kinds beyond the base ones.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``base`` kinds are kept whatever their score."""

    name: str
    pattern: str
    context: str
    prior: float
    base: bool = True
    #: A literal or pattern without which a text need not be searched.
    needs: str = ""
    #: If the pattern only finds the start: what the whole is, from there.
    whole: str = ""


#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_COUNTRIES = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: The length of its country, whatever comes after a space. Of other countries, all that follows.
_IBAN = "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}"
    for n, codes in IBAN_LENGTHS.items()
)
_IBAN = rf"(?:{_IBAN}|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "mail|contact|address|adresse|correo|kontakt",
        0.7,
        needs="@",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "ip|host|server|address|adresse|serveur",
        0.4,
        needs=r"[0-9]\.[0-9]",
    ),
    Kind(
        "card",
        # A whole run of 13 to 19 digits: shorter and longer runs are no cards.
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
        "card|visa|credit|carte|karte|tarjeta|payment",
        0.2,
        needs=r"[0-9][ -]?[0-9][ -]?[0-9]",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "phone|call|tel|mobile|fax",
        0.5,
        needs=r"\+[0-9]",
    ),
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?={_IBAN})[A-Z]{{2}}[0-9]{{2}}",
        "iban|account|bank|konto|compte|cuenta",
        0.1,
        base=False,
        needs="[A-Z]{2}[0-9]{2}",
        whole=_IBAN,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "ssn|social security|tax",
        0.3,
        base=False,
        needs="[0-9]{3}-[0-9]{2}-",
    ),
)



def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda c: c.cast("int"))
    doubled = F.transform(
        values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 by 97, its first four characters last."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    values = F.transform(
        F.split(turned, "(?<=.)(?=.)"),
        lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(
        values, F.lit(0), lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97
    )
    return rest == 1


def _confirmed(kind: str, match: Column) -> tuple[Column, Column | None]:
    """Whether a proposed match stands, and whether its checksum holds if it has one."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$"), None
    if kind == "card":
        return luhn(digits), luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15), None
    if kind == "iban":
        valid = mod_97(F.replace(match, F.lit(" "), F.lit("")))
        return valid, valid
    return F.lit(True), None


def _proposed(text: Column, kind: Kind) -> Column:
    """Array of (match, start, end) of a pattern's matches, places in code points."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))
    none = F.array().cast("array<struct<match:string,start:int,end:int>>")

    def step(found: Column, pair: Column) -> Column:
        start = F.when(F.size(found) > 0, F.element_at(found, -1)["end"]).otherwise(0) + pair["gap"]
        one = F.struct(
            pair["match"].alias("match"),
            start.cast("int").alias("start"),
            (start + F.length(pair["match"])).cast("int").alias("end"),
        )
        return F.concat(found, F.array(one))

    pairs = F.zip_with(
        matches,
        F.slice(gaps, 1, F.size(matches)),
        lambda m, g: F.struct(m.alias("match"), g.alias("gap")),
    )
    searched = text.contains(kind.needs) if kind.needs == "@" else text.rlike(kind.needs)
    found = F.aggregate(pairs, none, step)
    if kind.whole:
        found = F.transform(found, lambda x: _whole(text, kind, x["start"]))
    return F.when(searched, found).otherwise(none)


def _whole(text: Column, kind: Kind, start: Column) -> Column:
    # Twice the most characters of a number, as there may be spaces, and one after it.
    match = F.regexp_extract(F.substring(text, start + 1, F.lit(69)), f"^{kind.whole}", 0)
    return F.struct(
        match.alias("match"),
        start.alias("start"),
        (start + F.length(match)).cast("int").alias("end"),
    )


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind with their scores."""

    def scored(x: Column) -> Column:
        stands, checksum = _confirmed(kind.name, x["match"])
        around = F.substring(
            text,
            F.greatest(x["start"] - CONTEXT_CHARS + 1, F.lit(1)),
            x["end"] - x["start"] + 2 * CONTEXT_CHARS,
        )
        score = F.lit(kind.prior)
        score += F.when(F.lower(around).rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        if checksum is not None:
            score += F.when(checksum, CHECKSUM_BONUS).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.least(score, F.lit(1.0)).alias("score"),
            stands.alias("stands"),
        )

    spans = F.filter(F.transform(_proposed(text, kind), scored), lambda x: x["stands"])
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)
    return spans


def find(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with one array column ``pii_<kind>`` for each kind: kind, start, end, score.

    Kinds are found by themselves: spans of different kinds may overlap. Null and empty texts
    have empty arrays. Rows stay as they are, repeated ones, null ids and all other columns too; a
    column of the name of a new one is replaced.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.withColumns({f"pii_{k.name}": _spans(text, k) for k in KINDS})


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Replaces every span in the text by its kind in brackets; the columns stay the same.

    Where spans overlap, what they cover together is replaced once, by the kind that begins first.
    Null texts stay null.
    """
    found = find(docs.select(docs[text_col].alias("text"), F.struct("*").alias("row")))
    spans = F.array_sort(
        F.transform(
            F.concat(*(F.col(f"pii_{k.name}") for k in KINDS)),
            lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
        )
    )
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("text"))

    def step(done: Column, x: Column) -> Column:
        gap = F.col("text").substr(done["end"] + 1, x["start"] - done["end"])
        fresh = F.concat(done["text"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(done["end"], x["end"]).alias("end"),
            F.when(x["start"] >= done["end"], fresh).otherwise(done["text"]).alias("text"),
        )

    def finish(done: Column) -> Column:
        return F.concat(done["text"], F.col("text").substr(done["end"] + 1, F.length("text")))

    found = found.withColumn("spans", spans)
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(
        F.aggregate("spans", start, step, finish)
    )
    columns = [
        clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns
    ]
    return found.select(*columns)


def span_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as ``kind:start:end``."""
    own = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].alias("text"))
    found = find(own)

    def said(kinds: list[Kind]) -> Column:
        spans = F.concat(*(F.col(f"pii_{k.name}") for k in kinds))
        return F.concat_ws(
            ",",
            F.transform(
                spans,
                lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
            ),
        )

    base = [k for k in KINDS if k.base]
    return found.select(
        id_col,
        *(F.size(f"pii_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in base),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(list(KINDS)).alias("spans"),
    )
