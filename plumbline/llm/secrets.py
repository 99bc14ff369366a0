"""Secret scans by a battery of randomness tests, in DataFrame functions only.

Fixed patterns find assignments, access keys and long hexadecimal runs; their spans always stay. The method
adds spans of kind `random`: runs of token characters, with digits and letters, whose encoding is inferred
(hexadecimal, base32, base64, URL-safe base64, mixed) and which pass three tests of randomness over that
encoding's alphabet: chi-squared uniformity, runs about the middle of the alphabet, and serial correlation.
A token's p-value is three times the least of the three. Short tokens pass such tests more easily than long
ones, so tokens of one encoding and length class (power of two) are judged together, over all documents:
there a Benjamini-Hochberg step-up at level `FDR` says which tokens are not random, with p-values rounded up
to `BINS` to the decade, and the others are reported. So of the tokens set aside as ordinary, at most that
share are expected to be random. The step-up needs one count for each class and bin; the thresholds are one
number for each class.

Spans are in code points with the end exclusive. Null and empty texts have none. An added span that meets a
base span is not reported again. Repeated rows each get their spans and count each. A table without rows gives
none. Further columns, of any name, stay as they are where a text is masked, and are not read otherwise. Places
are running sums by doubling, so a very long text takes time n log n in its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_of, written

# The base patterns and the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

#: An equals sign is padding only where no token follows it: NAME=value and ?name=value give value as a token.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}+(?![A-Za-z0-9+/_-]))?"
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Encodings in the order in which they are tried: the pattern of a token, and its alphabet.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    "base64": (r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": (r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    "mixed": (r"", UPPER + LOWER + DIGITS + "+/_-"),
}
FDR = 0.05
BINS = 20
LAST_BIN = 400


#: Steps of a running sum: it covers arrays of up to 2 ** STEPS elements, more than a text of 2 GB has spans.
STEPS = 27
#: Code points of the blocks that a text is cut into before pieces are taken from it: a piece is looked for in its blocks only.
PIECE = 4096


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """What join makes of each element and all before it: by doubling, so in n log n steps and not in n squared."""
    def step(wide: int):
        shifted = lambda x: F.zip_with(F.slice(x, F.lit(wide + 1), F.size(x)), F.slice(x, F.lit(1), F.size(x) - wide), join)
        return lambda x: F.when(F.size(x) > wide, F.concat(F.slice(x, F.lit(1), F.lit(wide)), shifted(x))).otherwise(x)

    for k in range(STEPS):
        values = let(values, step(1 << k))
    return values


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches: gaps and matches alternate."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(hits: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h)))
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    return F.when(text.rlike(pattern), let(hits, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _before(marks: Column, points: Column, at_point: bool) -> Column:
    """Of each point, how many marks lie before it (or at it, too); both are sorted, and so is the result."""
    first, second = (0, 1) if at_point else (1, 0)
    events = F.array_sort(F.concat(F.transform(marks, lambda m: F.struct(m.alias("at"), F.lit(first).alias("order"), F.lit(1).alias("mark"))), F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(second).alias("order"), F.lit(0).alias("mark")))))
    counted = let(events, lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["mark"])), lambda x, n: F.struct(x["mark"].alias("mark"), n.alias("n"))))
    return F.transform(F.filter(counted, lambda x: x["mark"] == 0), lambda x: x["n"])


def apart(found: Column, others: Column) -> Column:
    """The spans of found that meet none of the others; found has no overlaps and is in order.

    More others begin before a span's end than end at or before its start just if one of them meets it.
    """
    begun = _before(F.array_sort(F.transform(others, lambda o: o["start"])), F.transform(found, lambda c: c["end"]), False)
    ended = _before(F.array_sort(F.transform(others, lambda o: o["end"])), F.transform(found, lambda c: c["start"]), True)
    free = F.zip_with(begun, ended, lambda b, e: b == e)
    pairs = F.zip_with(found, free, lambda c, f: F.struct(c.alias("c"), f.alias("f")))
    kept = F.transform(F.filter(pairs, lambda p: p["f"]), lambda p: p["c"])
    return F.when((F.size(found) == 0) | (F.size(others) == 0), found).otherwise(kept)


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to before end of a text in blocks of `PIECE`."""
    own = F.slice(blocks, F.floor(start / PIECE).cast("int") + 1, (F.floor((end - 1) / PIECE) - F.floor(start / PIECE)).cast("int") + 1)
    base = lambda i: (F.floor(start / PIECE).cast("int") + i) * PIECE
    part = lambda b, i: F.substring(b, F.greatest(start - base(i), F.lit(0)) + 1, F.least(end, base(i) + PIECE) - F.greatest(start, base(i)))
    return F.when(end > start, F.array_join(F.transform(own, part), "")).otherwise("")


def _count(text: Column, part: Column | str) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation with an error below 1e-7."""
    x = F.abs(z) / F.lit(2.0) ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the approximation of the error function.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pick(encoding: Column, of: dict[str, object]) -> Column:
    names = list(of)
    out = F.lit(of[names[-1]])
    for name in reversed(names[:-1]):
        out = F.when(encoding == name, F.lit(of[name])).otherwise(out)
    return out


def _inferred(c: Column) -> Column:
    enc = F.lit("mixed")
    for name, (pattern, _) in reversed(list(ENCODINGS.items())[:-1]):
        enc = F.when(c["hit"].rlike(pattern), name).otherwise(enc)
    body = F.regexp_replace(c["hit"], "=+$", "")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), enc.alias("encoding"), F.when(enc == "hex", F.lower(body)).otherwise(body).alias("body"))


def _coded(c: Column) -> Column:
    e = c["encoding"]
    alphabet = _pick(e, {n: a for n, (_, a) in ENCODINGS.items()})
    halves = _pick(e, {n: "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for n, (_, a) in ENCODINGS.items()})
    places = F.transform(F.split(c["body"], ""), lambda x: F.instr(alphabet, x).cast("double"))
    places = F.filter(places, lambda x: x > 0)
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, x: s + F.when(x != "", F.pow(_count(c["body"], x), 2)).otherwise(0.0))
    return F.struct(
        c["start"].alias("start"), c["end"].alias("end"), e.alias("encoding"), F.length(c["body"]).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
        squares.alias("squares"), _translated(c["body"], alphabet, halves).alias("bits"), places.alias("places"),
    )


def _translated(body: Column, alphabet: Column, halves: Column) -> Column:
    return F.array_join(F.transform(F.split(body, ""), lambda x: F.when(x == "", "").otherwise(F.substring(halves, F.instr(alphabet, x), F.lit(1)))), "")


def _tested(c: Column) -> Column:
    n, k = c["n"], c["k"]
    chi = k / n * c["squares"] - n
    free = k - 1
    p_chi = normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    ones = _count(c["bits"], "1")
    zeros = n - ones
    runs = 1 + _count(c["bits"], "01") + _count(c["bits"], "10")
    mean = 2 * ones * zeros / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(spread > 0, 2 * normal_tail(F.abs(runs - mean) / F.sqrt(spread))).otherwise(0.0)
    total = F.aggregate(c["places"], F.lit(0.0), lambda s, x: s + x)
    center = total / n
    power = F.aggregate(c["places"], F.lit(0.0), lambda s, x: s + F.pow(x - center, F.lit(2.0)))
    pairs = F.zip_with(F.slice(c["places"], 1, F.size(c["places"]) - 1), F.slice(c["places"], 2, F.size(c["places"]) - 1), lambda a, b: (a - center) * (b - center))
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    p_serial = F.when(power > 0, 2 * normal_tail(F.abs(serial / power + 1 / n) * F.sqrt(n))).otherwise(0.0)
    p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
    level = F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS)).cast("int")
    stratum = F.concat_ws(":", c["encoding"], F.floor(F.log2(n)).cast("string"))
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), stratum.alias("stratum"), level.alias("bin"))


def _labelled(found: Column, kind: int) -> Column:
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end")))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base (kind, start, end) and __candidates (start, end, stratum, bin)."""
    t = text_of(text)
    assign = F.filter(spans(t, ASSIGN), lambda c: F.length(F.regexp_extract(c["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    found = [(0, assign), (1, spans(t, ACCESS)), (2, spans(t, HEX))]
    labelled = [_labelled(s, i) for i, s in found]
    tokens = F.filter(spans(t, TOKEN), lambda c: c["hit"].rlike("[0-9]") & c["hit"].rlike("[A-Za-z]"))
    docs = docs.withColumn("__base", F.array_sort(F.concat(*labelled))).withColumn("__candidates", F.transform(tokens, _inferred))
    docs = docs.withColumn("__candidates", apart(F.col("__candidates"), F.col("__base"))).withColumn("__candidates", F.transform("__candidates", _coded))
    return docs.withColumn("__candidates", F.transform("__candidates", _tested))


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """Of each class the least bin whose tokens are rejected as not random (LAST_BIN + 1: none).

    The counts that are summed have one row for each class and bin, the result one for each class.
    """
    counts = found.select(F.explode("__candidates").alias("c")).groupBy("c.stratum", "c.bin").count()
    by_class = Window.partitionBy("stratum")
    beyond = by_class.orderBy(F.desc("bin"))
    level = counts.select("stratum", "bin", F.sum("count").over(beyond).alias("tail"), F.sum("count").over(by_class).alias("m"))
    passed = (F.col("bin") > 0) & (F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / BINS) <= fdr * F.col("tail"))
    least = level.groupBy("stratum").agg(F.min(F.when(passed, F.col("bin"))).alias("bin"))
    return {r["stratum"]: LAST_BIN + 1 if r["bin"] is None else r["bin"] for r in least.collect()}


def all_spans(found: DataFrame, limits: dict[str, int]) -> DataFrame:
    """found with __spans: the base spans and the added ones, by start and kind."""
    limit = F.create_map(*[F.lit(x) for item in (limits or {"": 0}).items() for x in item])
    random = F.filter("__candidates", lambda c: c["bin"] < F.coalesce(limit[c["stratum"]], F.lit(LAST_BIN + 1)))
    return found.withColumn("__spans", F.array_sort(F.concat("__base", _labelled(random, KINDS.index("random")))))


def rendered(of: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """Per row of docs: doc_id, __base and __spans."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    found = checkpointed(scanned(rows, "__text").drop("__text"))
    return all_spans(found, thresholds(found, fdr))


def masked(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """docs with every secret span of the text replaced; spans that meet share one mask. Null texts stay null."""
    found = written(scanned(docs.select(F.struct(*docs.columns).alias("__row")), f"__row.`{text}`"), "scanned")
    hit = all_spans(found, thresholds(found, fdr)).withColumn("__text", F.col("__row")[text])

    def cleaned(blocks: Column) -> Column:
        reach = running(F.transform("__spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # where the spans so far end
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        parts = F.zip_with("__spans", before, lambda s, at: F.when(s["start"] >= at, F.concat(piece(blocks, at, s["start"]), F.lit(mask))).otherwise(""))
        last = F.array_max(F.transform("__spans", lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(blocks, last, F.length("__text")))

    blocks = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = F.when(F.size("__spans") > 0, let(blocks, cleaned)).otherwise(F.col("__text"))
    return hit.select(*[clean.alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns])
