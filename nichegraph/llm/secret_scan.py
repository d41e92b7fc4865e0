"""Secret scans: three patterns, and sliding-window Shannon entropy over candidate strings. Native.

Spark's functions return a pattern's matches without their places. The pieces between the matches, from a
split by the same pattern, give them: a match starts after all pieces and matches before it. Running totals
are taken in pieces of about the root of their number, and text is cut from an array of short strips, so that
neither the number of matches nor a text's length makes a step dearer than the root of it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: The three kinds, in the order in which spans with one start are listed.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Patterns that find a kind's spans of enough characters alone: runs are maximal, so these are the same spans. Short assignments
#: may cover the start of others and have to be found to be left out.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
CANDIDATE, LEAST = r"[A-Za-z0-9+/=_-]{20,}", 20
WINDOW = 20
#: Alphabet of a candidate, its class: bits a character from which a window counts as random.
CLASSES = {"hexadecimal": (r"[0-9a-fA-F]+", 3.2), "base32": (r"[A-Z2-7=]+", 3.6), "base64": (r"[A-Za-z0-9+/=_-]+", 3.75)}
#: The signs of candidates; a window's counts of so many signs fit in one number of 64 bits, five for each.
SIGNS, PER_WORD, COUNT_BITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 12, 5
#: No secrets: UUIDs, strings without digits or without letters, and words joined by signs, as in paths.
#: A piece between signs that says it is an example is cut out; what stands beside it is judged by itself.
ALLOW = [r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[^0-9]*$", r"^[^A-Za-z]*$"]
SHOWN, PIECE = r"(?i)example|sample|dummy|placeholder|x{8}", r"(?i)(?<![A-Z0-9])[A-Z0-9]*?(?:example|sample|dummy|placeholder|x{8})[A-Z0-9]*"
JOINTS, WORD = r"[-/_=+]+", r"^[A-Z]?[a-z]*[0-9]{0,4}$"
#: Code points of the strips that text is cut from; what stands for a cut-out sign.
STRIP, BLANK = 1024, " "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body has it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Array of the running totals of an array of ints: join of all values up to each, from 0."""

    def totals(x: Column) -> Column:
        last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
        return F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(join(last(acc), v))))

    def parts(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda i: totals(F.slice(x, i * width + 1, width)))

    def joined(p: Column) -> Column:
        ends = totals(F.transform(p, lambda x: F.get(x, F.size(x) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: join(F.get(e, i - 1), v))))))

    return let(values, lambda x: F.when(F.size(x) > 0, let(parts(x), joined)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value): a pattern's leftmost matches, in code points, end exclusive; value: the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def placed(m: Column) -> Column:
        sizes = F.transform(m["whole"], lambda x, i: F.length(F.get(m["gaps"], i)) + F.length(x))
        rows = lambda ends: F.transform(ends, lambda end, i: F.struct((end - F.length(F.get(m["whole"], i))).alias("start"), end.alias("end"), F.get(m["value"], i).alias("value")))
        return let(running(sizes, lambda a, b: a + b), rows)

    return let(F.struct(whole.alias("whole"), value.alias("value"), F.split(text, pattern, -1).alias("gaps")), placed)


def without(text: Column, cuts: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with what spans, sorted by start, cover replaced by put(starts, size).

    A span that overlaps those before it has starts false and the size of what it covers beyond them.
    """

    def piece(strips: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / STRIP).cast("int")
        some = F.slice(strips, first + 1, F.floor((b - 1) / STRIP).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a % STRIP + 1, b - a)).otherwise(F.lit(""))

    def joined(s: Column) -> Column:
        before = lambda i: F.coalesce(F.get(s["ends"], i - 1), F.lit(0))
        one = lambda x, at: F.concat(piece(s["strips"], at, x["start"]), put(x["start"] >= at, F.greatest(x["end"] - F.greatest(x["start"], at), F.lit(0))))
        parts = F.transform(s["cuts"], lambda x, i: let(before(i), lambda at: one(x, at)))
        return F.concat(F.array_join(parts, ""), piece(s["strips"], before(F.size(s["ends"])), s["size"]))

    ends = running(F.transform(cuts, lambda x: x["end"]), F.greatest)
    strips = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))
    return let(F.struct(cuts.alias("cuts"), ends.alias("ends"), strips.alias("strips"), F.length(text).alias("size")), joined)


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of the windows of a string of SIGNS; shorter strings are one window.

    A window has a count for each sign. As it moves, the count of the sign that enters rises by one and that of
    the sign that leaves falls by one; the sum of n log2 n over the counts n follows these two alone.
    """
    if window >= 1 << COUNT_BITS:
        raise ValueError("a window has less than 32 signs, as counts have five bits")
    words = [f"w{k}" for k in range(-(-len(SIGNS) // PER_WORD))]
    f = lambda n: n * log2(n) if n > 1 else 0.0
    rise = F.array(*(F.lit(float(f(n) - f(n - 1))) for n in range(window + 1)))

    def move(sign: Column, enters: bool) -> Column:
        shift = (sign % PER_WORD * COUNT_BITS).cast("int")
        return F.struct(F.floor(sign / PER_WORD).cast("int").alias("word"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("bit"), F.lit(enters).alias("enters"))

    def step(acc: Column, m: Column) -> Column:
        held = acc[words[0]]
        for k, w in enumerate(words[1:], 1):
            held = F.when(m["word"] == k, acc[w]).otherwise(held)
        n = F.call_function("shiftrightunsigned", held, m["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")
        s = acc["s"] + F.when(m["enters"], F.get(rise, n + 1)).otherwise(-F.get(rise, n))
        by = F.when(m["enters"], m["bit"]).otherwise(-m["bit"])
        size = acc["size"] + F.when(m["enters"], 1).otherwise(-1)
        full = m["enters"] & (size == acc["full"])
        counts = [F.when(m["word"] == k, acc[w] + by).otherwise(acc[w]).alias(w) for k, w in enumerate(words)]
        return F.struct(*counts, s.alias("s"), size.alias("size"), acc["full"].alias("full"), F.when(full, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

    def peak(signs: Column) -> Column:
        full = F.least(F.size(signs), F.lit(window))
        moves = F.flatten(F.transform(signs, lambda x, i: F.when(i >= window, F.array(move(F.get(signs, i - window), False), move(x, True))).otherwise(F.array(move(x, True)))))
        start = F.struct(*(F.lit(0).cast("long").alias(w) for w in words), F.lit(0.0).alias("s"), F.lit(0).alias("size"), full.alias("full"), F.lit(float("inf")).alias("least"))
        return F.aggregate(moves, start, step, lambda acc: F.log2(acc["full"].cast("double")) - F.greatest(acc["least"], F.lit(0.0)) / acc["full"])

    signs = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(SIGNS), c) - 1)
    return let(signs, peak)


def random_strings(found: Column) -> Column:
    """Those of an array of (start, end, value) that have a random window and that the allow list doesn't cover."""
    whole = lambda p: f"^(?:{p})$"

    def keeps(x: Column) -> Column:
        v = x["value"]
        bar = F.lit(99.0)
        for pattern, bits in reversed(CLASSES.values()):
            bar = F.when(v.rlike(whole(pattern)), F.lit(bits)).otherwise(bar)
        allowed = F.forall(F.split(v, JOINTS, -1), lambda w: w.rlike(WORD))
        for p in ALLOW:
            allowed = v.rlike(p) | allowed
        return F.when(allowed, F.lit(False)).otherwise(peak_entropy(v) >= bar)

    return F.filter(found, keeps)


def _spans(found: Column, kind: int, least: int) -> Column:
    long = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs with spans, an array of (start, kind, end) in order: assign, access, hex, then entropy for each start.

    A kind's pattern is only taken apart in texts that it occurs in. Entropy spans are stretches of candidates
    that spans of the three patterns and pieces that say they are examples leave: candidates of the text with
    those blanked out. Null and empty texts have no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # an assignment needs a sign that most texts lack; runs are tried from their start alone
    has = {"assign": (text.contains(":") | text.contains("=")) & text.rlike(KINDS["assign"][0]), "access": text.rlike(LONG["access"]), "hex": text.rlike(r"(?<![0-9a-f])" + LONG["hex"])}
    found = [F.when(has[name], _spans(matches(text, LONG.get(name, pattern), group), k, least)).otherwise(none) for k, (name, (pattern, group, least)) in enumerate(KINDS.items())]
    shown = F.when(text.rlike(SHOWN), _spans(matches(text, PIECE), len(KINDS), 1)).otherwise(none)
    rows = docs.withColumn("base_spans", F.array_sort(F.concat(*found)))
    blank = lambda cuts: without(text, cuts, lambda _, n: F.repeat(F.lit(BLANK), n))
    left = let(F.array_sort(F.concat("base_spans", shown)), lambda cuts: F.when(F.size(cuts) > 0, blank(cuts)).otherwise(text))
    fresh = let(left, lambda t: _spans(random_strings(matches(t, CANDIDATE)), len(KINDS), LEAST))
    return rows.withColumn("spans", F.when(text.rlike(r"(?<![A-Za-z0-9+/=_-])" + CANDIDATE), F.array_sort(F.concat("base_spans", fresh))).otherwise(F.col("base_spans")))


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "entropy"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: how many spans of each pattern, their digest, and all spans."""
    rows = secret_spans(shared.texts(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == F.lit(k))).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)), F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base_spans")).cast("long").alias("n_entropy"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans replaced by the mark and n_chars set anew; other texts, null ones too, stay as they are."""
    rows = secret_spans(docs.select(F.struct("*").alias("_row"), "text"))
    clean = without(F.col("text"), F.col("spans"), lambda starts, _: F.when(starts, F.lit(mark)).otherwise(F.lit("")))
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    old = {c: F.col("_row").getField(c) for c in docs.columns}
    new = {"text": F.col("text"), "n_chars": F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(old.get("n_chars", F.lit(None)))}
    return rows.select(*(new.get(c, old[c]).alias(c) for c in docs.columns))
