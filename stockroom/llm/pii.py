"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

Only DataFrame functions.  A pattern's matches and the pieces of text between
them come from the same regular expression (``regexp_extract_all`` and
``split``), so match offsets are running sums of piece lengths in code points.
Each pattern is linear in the text: runs are entered at their start only and
taken possessively.

Kinds and evidence:

* ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits, Luhn) and
  ``phone`` (8 to 15 digits) are always kept once they pass their check;
* ``iban``: country, two check digits and 11 to 30 letters or digits, optionally
  grouped by single spaces, ending at a word border and confirmed by the mod-97
  checksum.  Capitals or digits may follow it: of the word borders the country's own
  length is tried first, then the longest; every border if the country is unknown;
* ``card_short``: 13 to 15 digits passing Luhn, kept only when a payment word
  stands nearby; ``ssn``: 3-2-4 digits, kept only beside an identity word.

Score: a base per kind, plus ``NEAR`` if one of the kind's context words stands
within ``CONTEXT`` code points before or after the span, less ``NEAR`` if a word
such as "example" does; kinds that need context are kept from ``KEEP`` on.

Defined cases: a null text counts as empty and has no spans; matches of one kind
never overlap, and matches that fail their check are dropped without another
try (``iban``: see above; the next word may start another); equal rows get equal spans; other columns are kept (result columns replace
equal names).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common

CONTEXT = 40
NEAR = 0.2
KEEP = 0.6
BLOCK = 256         # elements that one inner fold collects


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str            # a cheap pattern without which there is no match
    base: float
    near: str            # context words
    always: bool         # kept whatever its score
    group: int = 0       # the group that is checked; what the whole match takes is passed over


# A whole run of digits with single separators, entered at its first digit only.  Runs
# too short for the check are no match at all, so lists of small numbers cost nothing.
RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){{{more},}}+"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", 0.8, "mail|contact|write|reach", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6,
         "ip|server|address|host|login", True),
    Kind("card", RUN.format(more=15), r"[0-9](?:[\x20-]?[0-9]){15}", 0.8,
         "card|visa|credit|payment|account", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7,
         "phone|call|tel|mobile|fax", True),
    # takes the first four characters only, so that each word may start one; what may belong
    # to it, and one character more to see a word cut, is looked at ahead
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}",
         r"[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|transfer", True, 1),
    Kind("card_short", RUN.format(more=12), r"[0-9](?:[\x20-]?[0-9]){12}", 0.4,
         "card|visa|credit|amex|payment", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4,
         "ssn|social|security|insurance|identity", False),
)
BASE_KINDS = ("email", "ip", "card", "phone")
# ISO 13616: the whole length in each country
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,"
    "RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split())
    for c in cs.split(",")}
UNLIKELY = "example|sample|dummy|invalid"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    ds = F.reverse(F.filter(F.split(number, ""), lambda c: c != ""))
    total = F.aggregate(
        F.transform(ds, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35,
    the number is 1 modulo 97."""
    tight = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(tight, F.lit(5)), F.substring(tight, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(
        chars, F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(
            r"^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "card_short"):
        n = F.length(digits(found))
        lo, hi = (16, 19) if kind == "card" else (13, 15)
        return F.when(n.between(lo, hi), luhn(digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def iban_extent(ahead: Column) -> Column:
    """Length of the account number at the start of a text and whether it is its country's
    own, null where there is none."""
    country = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    own = F.element_at(country, F.substring(ahead, 1, 2))

    def borders(ws: Column) -> Column:
        tight = F.transform(F.sequence(F.lit(1), F.size(ws)), lambda j: F.struct(
            j.alias("j"), F.array_join(F.slice(ws, F.lit(1), j), "").alias("t")))
        return F.filter(tight, lambda x: x["t"].rlike("^[A-Z0-9]{15,34}$"))

    def best(bs: Column) -> Column:
        most = F.array_max(F.transform(bs, lambda x: F.length(x["t"])))
        tried = F.filter(bs, lambda x: (own.isNull() | (F.length(x["t"]) == own) | (F.length(x["t"]) == most))
                         & mod97(x["t"]))
        return F.array_max(F.transform(tried, lambda x: F.struct(
            F.coalesce(F.length(x["t"]) == own, F.lit(False)).alias("own"), F.length(x["t"]).alias("n"),
            (F.length(x["t"]) + x["j"] - 1).alias("length"))))
    return let(let(F.split(ahead, " "), borders), best)


def extent(kind: str, found: Column) -> Column:
    """Length of the span that starts a match (null where its check fails), and whether it is sure."""
    if kind == "iban":
        return let(iban_extent(found), lambda x: F.struct(x["length"].alias("n"), x["own"].alias("sure")))
    return F.struct(F.when(valid(kind, found), F.length(found)).alias("n"), F.lit(True).alias("sure"))


def apart(xs: Column) -> Column:
    """Spans without overlap: the first ones, but none that is unsure and meets a sure one."""
    upcoming = F.reverse(F.slice(running(F.reverse(xs), F.lit(2 ** 31 - 1), lambda n, x: F.when(
        x["sure"], x["s"]).otherwise(n)), 1, F.size(xs)))
    free = F.filter(F.zip_with(xs, upcoming, lambda x, n: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), (x["sure"] | (x["e"] <= n)).alias("ok"))), lambda x: x["ok"])

    def first(ys: Column) -> Column:
        ends = running(ys, F.lit(0), lambda e, y: F.when(y["s"] >= e, y["e"]).otherwise(e))
        return F.filter(F.zip_with(ys, F.slice(ends, 1, F.size(ys)), lambda y, e: F.struct(
            y["s"].alias("s"), y["e"].alias("e"), e.alias("past"))), lambda y: y["s"] >= y["past"])
    return let(free, first)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` elements; an empty one is one empty block."""
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, first: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The states of a fold: before each element, and after the last.

    An array grows by copying, so the fold runs over blocks: one over the blocks for
    the state each starts from, then one inside each.
    """
    def states(parts: Column, at: Column, move: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(parts, start, lambda a, x: F.struct(
            move(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def within(bs: Column) -> Column:
        return let(states(bs, first, lambda at, b: F.aggregate(b, at, step)), lambda outer: F.concat(
            F.flatten(F.zip_with(bs, outer["out"], lambda b, at: states(b, at, step)["out"])),
            F.array(outer["at"])))
    return let(blocks(values), within)


def pieces(text: Column, cuts: Column) -> Column:
    """The text between the places s and e of every cut, in order.  A place is found by
    walking the text, so each block of cuts walks a piece of its own."""
    def inside(b: Column) -> Column:
        first = b[0]["s"]
        held = F.struct(first.alias("s"), F.substr(
            text, first + 1, F.element_at(b, -1)["e"] - first).alias("t"))
        return let(held, lambda h: F.transform(b, lambda x: F.substr(
            h["t"], x["s"] - h["s"] + 1, x["e"] - x["s"])))
    return F.flatten(F.transform(blocks(cuts), inside))


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of struct<kind, rank, start, end, score> of one kind, in order of place."""
    rank = [k.name for k in KINDS].index(kind.name)
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,rank:int,start:int,end:int,score:double>>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, kind.pattern), 1, F.size(found)), lambda m, before: F.struct(
        m.alias("m"), F.length(before).alias("gap"), F.length(m).alias("taken")))
    if kind.group:
        pairs = F.zip_with(pairs, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)),
                           lambda p, m: F.struct(m.alias("m"), p["gap"].alias("gap"), p["taken"].alias("taken")))

    def judged(ps: Column) -> Column:
        past = running(ps, F.lit(0), lambda at, p: at + p["gap"] + p["taken"])
        return F.zip_with(ps, F.slice(past, 1, F.size(ps)), lambda p, at: let(
            extent(kind.name, p["m"]), lambda x: F.struct(
                (at + p["gap"]).alias("s"), (at + p["gap"] + x["n"]).alias("e"), x["sure"].alias("sure"))))

    def score(near_by: Column) -> Column:
        near = F.when(near_by.rlike(rf"\b(?:{kind.near})"), F.lit(NEAR)).otherwise(F.lit(0.0))
        far = F.when(near_by.rlike(rf"\b(?:{UNLIKELY})"), F.lit(NEAR)).otherwise(F.lit(0.0))
        return F.round(F.lit(kind.base) + near - far, 3)

    def scored(at: Column) -> Column:
        """Context: the code points before and after a span, whatever stands there."""
        left = pieces(text, F.transform(at, lambda x: F.struct(
            F.greatest(x["s"] - CONTEXT, F.lit(0)).alias("s"), x["s"].alias("e"))))
        right = pieces(text, F.transform(at, lambda x: F.struct(x["e"].alias("s"), (x["e"] + CONTEXT).alias("e"))))
        near = F.zip_with(left, right, lambda a, b: F.lower(F.concat(a, F.lit(" "), b)))
        return F.zip_with(at, near, lambda x, n: F.struct(
            F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), x["s"].alias("start"),
            x["e"].alias("end"), score(n).alias("score"))).cast(shape)
    shape = "array<struct<kind:string,rank:int,start:int,end:int,score:double>>"
    good = F.filter(let(pairs, judged), lambda x: x["e"].isNotNull())
    if kind.group:      # more is looked at than taken
        good = let(good, apart)
    plain = let(good, lambda at: F.when(F.size(at) > 0, scored(at)).otherwise(none))
    if not kind.always:
        plain = F.filter(plain, lambda x: x["score"] >= KEEP)
    return F.when(text.rlike(kind.gate), plain).otherwise(none)


def detect(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``docs`` with ``pii``: its spans by kind as listed, then by start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return common.put(docs, **{spans: F.concat(*[spans_of(whole, k) for k in KINDS])})


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span's code points replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first.
    """
    spans, at = common.free_name(docs, "spans"), common.free_name(docs, "cuts")
    found = detect(docs, text, spans)
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(
        s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))

    def merged(xs: Column) -> Column:
        """A span that starts where all before it have ended opens a cut; the cut ends
        where the spans before the next one have."""
        def cuts(reach: Column) -> Column:
            opened = F.filter(F.zip_with(xs, F.slice(reach, 1, F.size(xs)), lambda x, e: F.struct(
                x["s"].alias("s"), e.alias("before"), x["k"].alias("k"))), lambda o: o["s"] >= o["before"])
            return let(opened, lambda o: F.zip_with(
                o, F.concat(F.slice(F.transform(o, lambda x: x["before"]), F.lit(2), F.size(o)),
                            F.slice(reach, -1, 1)),
                lambda x, e: F.struct(x["s"].alias("s"), e.alias("e"), x["k"].alias("k"))))
        return let(running(xs, F.lit(0), lambda e, x: F.greatest(e, x["e"])), cuts)
    t = F.col(text)
    held = found.withColumn(at, F.when(F.size(spans) > 0, let(ordered, merged)))
    m = F.col(at)
    starts = F.concat(F.array(F.lit(0)), F.transform(m, lambda x: x["e"]))
    ends = F.concat(F.transform(m, lambda x: x["s"]), F.array(F.length(t)))
    between = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    masks = F.concat(F.transform(m, lambda x: F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))),
                     F.array(F.lit("")))
    clean = F.array_join(F.zip_with(let(between, lambda b: pieces(t, b)), masks, lambda p, k: F.concat(p, k)), "")
    return common.put(held, **{text: F.when(m.isNotNull(), clean).otherwise(t)}).drop(at, spans)
