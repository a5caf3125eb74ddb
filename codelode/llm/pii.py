"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust the score.

All of it is built-in functions: no Python runs on the executors. Patterns are written for linear time: a start that no match can
have (inside a run of characters that the first part takes) is skipped by a look-behind, or \\G after a match, and parts that
cannot give back are possessive. Matches are the leftmost non-overlapping ones of the plain patterns of PATTERNS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators.layout import spread

#: Kinds in order, the plain pattern of each, and the same for linear-time search.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9+/_=-]{32,}",
}
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"(?:(?<![A-Za-z0-9+/_=-])|\G)[A-Za-z0-9+/_=-]{32,}+",
}
#: Characters that a text must have for a kind, as a cheap first test.
NEEDS = {"email": "@", "phone": "+"}
BASE = ("email", "ip", "card", "phone")
#: Score without and with one of the context words within 40 characters before or 20 after.
SCORES = {"email": (0.9, 0.95), "ip": (0.6, 0.9), "card": (0.8, 0.95), "phone": (0.7, 0.9), "iban": (0.8, 0.95), "ssn": (0.3, 0.8), "secret": (0.3, 0.8)}
CONTEXT = {
    "email": r"(?i)mail|contact",
    "ip": r"(?i)\bip\b|address|server|host",
    "card": r"(?i)card|visa|credit|karte|tarjeta|carte",
    "phone": r"(?i)phone|call|tel|mobile|fax",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social security|tax id",
    "secret": r"(?i)token|secret|password|passwd|api.?key|bearer",
}
#: Spans of kinds outside BASE need this score.
THRESHOLD = 0.5
BEFORE, AFTER = 40, 20
#: Values a block of running sums; characters a piece of a text.
RUN, PIECE = 128, 256


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(number), "(?!^)(?!$)"), lambda c, i: (lambda v: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))(F.ascii(c) - 48))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), lambda a, c: (lambda v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97)(F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55))) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(digits(m))
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _match(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(LINEAR[kind]), F.lit(0))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>")) if kind in NEEDS else found


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """The inclusive running sums (or whatever op makes) of an array of ints.

    There is no built-in for those. Appending to an array copies it, so they are made in blocks of RUN values: a block's total, the
    totals before it, then its own running values, which take some RUN / 2 copied words a value however long the array is.
    """
    none = F.array().cast("array<int>")

    def append(items: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("t"), none.alias("a"))
        step = lambda s, v: let(op(s["t"], v).cast("int"), lambda t: F.struct(t.alias("t"), F.array_append(s["a"], t).alias("a")))
        return F.aggregate(items, first, step, lambda s: s["a"])

    own = lambda v, b: F.slice(v, b * RUN + 1, F.lit(RUN))
    block = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
    totals = lambda v: F.transform(block(v), lambda b: F.aggregate(own(v, b), F.lit(zero), lambda t, x: op(t, x).cast("int")))
    before = lambda v: let(totals(v), lambda t: append(t, F.lit(zero)))
    out = lambda v: let(before(v), lambda t: F.flatten(F.transform(block(v), lambda b: append(own(v, b), F.when(b > 0, F.get(t, b - 1)).otherwise(F.lit(zero))))))
    return F.when(F.size(values) > 0, let(values, out)).otherwise(none)


def between(pieces: Column, begin: Column, end: Column) -> Column:
    """The characters from begin to end (exclusive) of a text cut into pieces of PIECE; the cost is that of what is taken."""
    first = F.floor(begin / PIECE).cast("int")
    own = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(end > begin, F.substring(own, begin - first * PIECE + 1, end - begin)).otherwise(F.lit(""))


def _found(rows: DataFrame) -> DataFrame:
    """rows (row, text) with pieces of the text and spans, an array of (kind, start, end, score)."""
    text = F.col("text")
    out = rows.withColumns({f"m_{k}": _match(k, text) for k in PATTERNS})
    some = F.lit(False)
    for k in PATTERNS:
        some = some | (F.size(f"m_{k}") > 0)

    def steps(kind: str) -> Column:
        """From the start of one match to that of the next."""
        m = F.col(f"m_{kind}")
        step = lambda g: F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
        return F.when(F.size(m) > 0, let(F.split(text, LINEAR[kind], -1), step))

    out = out.withColumns({f"s_{k}": steps(k) for k in PATTERNS} | {"pieces": F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))), "size": F.length(text)})
    out = out.withColumns({f"s_{k}": F.when(F.size(f"m_{k}") > 0, running(F.col(f"s_{k}"), lambda t, x: t + x)) for k in PATTERNS})

    def spans(kind: str) -> Column:
        plain, raised = SCORES[kind]

        def one(start: Column, x: Column) -> Column:
            end = start + F.length(x)
            near = F.concat(between(F.col("pieces"), F.greatest(start - BEFORE, F.lit(0)), start), F.lit(" "), between(F.col("pieces"), end, F.least(end + AFTER, F.col("size"))))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.when(near.rlike(CONTEXT[kind]), raised).otherwise(plain).alias("score"), valid(kind, x).alias("ok"))

        found = F.zip_with(f"s_{kind}", f"m_{kind}", one)
        keep = lambda s: s["ok"] if kind in BASE else s["ok"] & (s["score"] >= THRESHOLD)
        return F.when(F.size(f"m_{kind}") > 0, F.transform(F.filter(found, keep), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))

    return out.select("row", "text", "pieces", "size", F.concat(*[spans(k) for k in PATTERNS]).alias("spans"))


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """docs as (row, text), so that their other columns may have any names; a null text is empty."""
    at = F.struct("*").alias("row")
    return docs.select(at, F.coalesce(_named(docs, text_col).cast("string"), F.lit("")).alias("text"))


def _named(docs: DataFrame, name: str) -> Column:
    return docs["`" + name.replace("`", "``") + "`"]


def find(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """docs with a column `name`, an array of (kind, start, end, score) in code points, end exclusive, by kind in order and start.

    The score is that of the kind, raised where a context word is near. Matches that fail their check are dropped, not tried again at
    another place. Spans of different kinds may overlap. A null or empty text has none; rows that repeat are searched each; an
    empty table gives an empty result; a column called `name` is replaced. Time is linear in the text and its matches.
    """
    found = _found(_rows(docs, text_col))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != name], F.col("spans").alias(name))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (all of them, as kind:start:end joined by commas) and their scores, likewise.

    A null text is empty; rows that repeat a doc_id are reported each; an empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = find(spread(base)).drop("text")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    own = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string")))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one, named by the first.

    A null text stays null; texts without spans stay as they are; other columns may have any names.
    """
    found = _found(_rows(docs, text_col))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    found = found.withColumn("spans", ordered)
    found = found.withColumn("upto", running(F.transform("spans", lambda s: -s["back"]), lambda t, x: F.greatest(t, x)))
    pieces = F.col("pieces")

    def part(s: Column, i: Column) -> Column:
        """What stands in place of the text between the spans before and the end of this one."""
        at = F.when(i > 0, F.get("upto", i - 1)).otherwise(0)
        return F.when(s["start"] >= at, F.concat(between(pieces, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

    whole = F.concat(F.array_join(F.transform("spans", part), ""), between(pieces, F.get("upto", F.size("upto") - 1), F.col("size")))
    masked = F.when(F.size("spans") > 0, whole).otherwise(F.col("row").getField(text_col))
    return found.select(*[(masked if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
