"""Secret scans: fixed patterns, and windows of high Shannon entropy over candidate strings.

All of it is built-in expressions on the row of a document: nothing is shuffled. Positions come from splitting a
text at a pattern: the lengths of the gaps and of the matches, added up, give every match's start in code points.

The entropy of a window of W characters is log2(W) - S / W, where S is the sum of c * log2(c) over the counts c of
the window's characters. Sliding by one character changes two counts, so S is kept by two increments; each
candidate is a maximal run of characters of one class (hexadecimal; base 64 with a digit, a lower-case and an
upper-case letter; a digit and lower-case, or a digit and upper-case letters beyond hexadecimal, as base 32 has them;
letters alone, with capitals side by side in two places, as words joined by capitals have them hardly ever; groups of
capitals and digits parted by dashes, two groups of which have both), and a class has its own window and threshold. A
run may stand right after '=', as the value of NAME=value; a run that '=' and more follow is a name.

No window reaches into a word of the allow-list (examples, placeholders, stretches of the alphabet): such words cut a
run into pieces, and a piece that is still a run of its class is scored for itself, so that a listed word hides
nothing beside it. Spans of the fixed patterns are never suppressed. Letters of one case without a digit are no class:
by their entropy they can't be told from words.
"""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import let

#: Kind, pattern, group that must have at least so many characters, that number.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Class of candidates: kind, pattern of a maximal run, window, threshold in bits. Thresholds are no value that a window can have.
CLASSES = [
    ("entropy-hex", r"(?<![0-9A-Za-z+/_-])[0-9a-fA-F]{20,}(?![0-9A-Za-z+/_=-])", 20, 2.9),
    ("entropy-base64", r"(?<![0-9A-Za-z+/_-])(?=[0-9A-Za-z+/_-]*[0-9])(?=[0-9A-Za-z+/_-]*[a-z])(?=[0-9A-Za-z+/_-]*[A-Z])[0-9A-Za-z+/_-]{20,}={0,2}(?![0-9A-Za-z+/_=-])", 20, 3.65),
]
#: The same for runs of digits and letters of one case, which other characters may part from what is around them.
ALPHANUMERIC = [
    ("entropy-lower", r"(?<![0-9A-Za-z])(?=[a-z]*[0-9])(?=[0-9a-z]*[g-z])[0-9a-z]{20,}={0,6}(?![0-9A-Za-z=])", 20, 3.35),
    ("entropy-upper", r"(?<![0-9A-Za-z])(?=[A-Z]*[0-9])(?=[0-9A-Z]*[G-Z])[0-9A-Z]{20,}={0,6}(?![0-9A-Za-z=])", 20, 3.3),
]
#: The same for letters alone, and for keys of dashed groups.
SHAPED = [
    ("entropy-letters", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z]*[A-Z]{2}[a-z][A-Za-z]*[A-Z]{2})[A-Za-z]{32,}={0,2}(?![0-9A-Za-z+/_=-])", 32, 4.1),
    ("entropy-dashed", r"(?<![0-9A-Za-z-])(?=[0-9A-Z-]{0,24}(?:[0-9][A-Z]|[A-Z][0-9])[0-9A-Z]{0,6}-[0-9A-Z-]{0,20}(?:[0-9][A-Z]|[A-Z][0-9]))[0-9A-Z]{4,6}-[0-9A-Z]{4,6}-[0-9A-Z]{4,6}-[0-9A-Z]{4,6}[0-9A-Z-]*(?![0-9A-Za-z-])", 19, 3.35),
]
ENTROPY = [*CLASSES, *ALPHANUMERIC, *SHAPED]
#: What is no secret. Fixed values, and every stretch of eight letters of the alphabet.
_LISTED = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "example", "placeholder", "your[_-]", "changeme", "x{6,}", "0123456789", "qwerty", "asdfgh", "zxcvbn", "lorem"]
ALLOWED = "(?i)" + "|".join([*_LISTED, *[ascii_lowercase[i : i + 8] for i in range(19)]])


def running_sums(values: Column) -> Column:
    """Sums of an array's first 1, 2, ... elements (one at least). Blocks of about sqrt(n) elements are summed up each
    for itself, then raised by the totals of those before: no array of n elements is built anew n times."""

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))

    def over(a: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda k: fold(F.slice(a, k * width + 1, width)))

        def raised(parts: Column) -> Column:
            totals = fold(F.transform(parts, lambda x: F.try_element_at(x, F.lit(-1))))
            return let(totals, lambda t: F.flatten(F.transform(parts, lambda x, k: F.transform(x, lambda v: v + F.coalesce(F.get(t, k - 1), F.lit(0))))))

        return let(blocks, raised)

    return let(values, lambda a: let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda width: over(a, width)))


def located(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """array<struct<kind, start, stop, match>> of pattern's matches, leftmost and not overlapping, whose group has at least so many characters."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + (group > 0)))
    gaps = F.split(text, pattern, -1)

    def spans(rows: Column) -> Column:
        """rows: (gap before, match, its group); a match ends where all gaps and matches so far end."""
        stops = running_sums(F.transform(rows, lambda x: F.length(x["gap"]) + F.length(x["match"])))
        placed = F.zip_with(rows, stops, lambda x, stop: F.struct(F.lit(kind).alias("kind"), (stop - F.length(x["match"])).alias("start"), stop.alias("stop"), x["match"].alias("match"), x["part"].alias("part")))
        kept = F.filter(placed, lambda x: F.length(x["part"]) >= least)
        return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "stop", "match")]))

    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), part.alias("part"))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,match:string>>")
    return F.when(text.rlike(pattern), let(rows, spans)).otherwise(none)


def hot_window(candidate: Column, window: int, threshold: float) -> Column:
    """struct<first, last> of the starts of the windows above the threshold; first is null if there are none.

    Counts are kept for the distinct characters of the candidate over the whole slide. A step changes two of them, and
    S by what these two were and become; nothing is counted anew.
    """
    xlogx = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    least_s = F.lit(window).cast("double") * F.log2(F.lit(float(window))) - threshold * window

    def slide(letters: Column, at: Column) -> Column:
        start = F.struct(F.transform(letters, lambda _: F.lit(0)).alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(at, i), F.when(i >= window, F.get(at, i - window))
            n, moved = acc["n"], old.isNull() | (F.get(at, i) != F.get(at, i - window))
            gain = xlogx(F.get(n, new) + 1) - xlogx(F.get(n, new))
            loss = F.when(old.isNotNull(), xlogx(F.get(n, old)) - xlogx(F.get(n, old) - 1)).otherwise(0.0)
            counts = F.when(moved, F.transform(n, lambda x, j: x + F.when(j == new, 1).when(j == old, -1).otherwise(0))).otherwise(n)

            def judged(s: Column) -> Column:
                hot = F.when((i >= window - 1) & (s < least_s), i - window + 1)
                return F.struct(counts.alias("n"), s.alias("s"), F.coalesce(acc["first"], hot).alias("first"), F.coalesce(hot, acc["last"]).alias("last"))

            return let(acc["s"] + F.when(moved, gain - loss).otherwise(0.0), judged)

        folded = F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step)
        return F.struct(folded["first"].alias("first"), folded["last"].alias("last"))

    def of_codes(codes: Column) -> Column:
        return let(F.array_distinct(codes), lambda letters: let(F.transform(codes, lambda c: (F.array_position(letters, c) - 1).cast("int")), lambda at: slide(letters, at)))

    return let(F.transform(F.split(candidate, ""), lambda c: F.ascii(c)), of_codes)


def unlisted(run: Column) -> Column:
    """array<struct<at, part>>: what the words of the allow-list leave of a run, and where it begins; the run itself without any."""
    words = F.regexp_extract_all(run, F.lit(f"({ALLOWED})"), F.lit(0))

    def parts(rows: Column) -> Column:
        size = lambda x: F.coalesce(F.length(x["word"]), F.lit(0))
        stops = running_sums(F.transform(rows, lambda x: F.length(x["part"]) + size(x)))
        return F.zip_with(rows, stops, lambda x, stop: F.struct((stop - size(x) - F.length(x["part"])).alias("at"), x["part"].alias("part")))

    cut = let(F.arrays_zip(F.split(run, ALLOWED, -1).alias("part"), words.alias("word")), parts)
    return F.when(run.rlike(ALLOWED), cut).otherwise(F.array(F.struct(F.lit(0).alias("at"), run.alias("part"))))


def _spans_of_class(text: Column, kind: str, pattern: str, window: int, threshold: float) -> Column:
    def pieces(x: Column) -> Column:
        whole = F.filter(unlisted(x["match"]), lambda p: p["part"].rlike(f"^(?:{pattern})$"))
        return F.transform(whole, lambda p: F.struct((x["start"] + p["at"]).alias("start"), p["part"].alias("part")))

    runs = F.flatten(F.transform(located(text, pattern, 0, window, kind), pieces))
    scored = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), hot_window(x["part"], window, threshold).alias("h")))
    hot = F.filter(scored, lambda y: y["h"]["first"].isNotNull())
    return F.transform(hot, lambda y: F.struct(F.lit(kind).alias("kind"), (y["start"] + y["h"]["first"]).alias("start"), (y["start"] + y["h"]["last"] + window).alias("stop")))


def entropy_spans(text: Column) -> Column:
    return F.concat(*[_spans_of_class(text, *c) for c in ENTROPY])


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns base_spans and entropy_spans: array<struct<kind, start, stop>>, in code points, stop exclusive.

    Null texts count as empty and have no spans. Rows are scanned one by one; a column of docs with the name of a
    new one is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[located(whole, p, g, n, k) for k, p, g, n in PATTERNS])
    plain = F.transform(base, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return docs.withColumns({"base_spans": plain, "entropy_spans": entropy_spans(whole)})


def joined(spans: Column) -> Column:
    """kind:start:stop by start, then by kind as listed, then by stop; joined by commas."""
    order = {k: i for i, k in enumerate([*[p[0] for p in PATTERNS], *[c[0] for c in ENTROPY]])}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def spans_of(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *[count(k) for k, *_ in PATTERNS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.concat("base_spans", "entropy_spans")).alias("spans"))
