"""Text, time and vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_terms(text: Column) -> Column:
    """Distinct words of letters, digits and underscores of two characters or more, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 2))


def or_query(terms: Column) -> Column:
    """Terms joined by ` | `; null without any."""
    return F.nullif(F.array_join(terms, " | "), F.lit(""))


def symbol_fragment(text: Column) -> Column:
    """The last name of a path or qualified symbol: before `#`, after the last slash, less `.java`, after the last dot."""
    t = F.trim(text)
    t = F.when(F.instr(t, "#") > 1, F.substring_index(t, "#", 1)).otherwise(t)
    t = F.element_at(F.split(F.translate(t, "\\", "/"), "/"), -1)
    t = F.regexp_replace(t, r"\.java$", "")
    return F.nullif(F.trim(F.element_at(F.split(t, r"\."), -1)), F.lit(""))


def key_suffix(key: Column) -> Column:
    """What follows the first colon; null if nothing does."""
    at = F.instr(key, ":")
    return F.when(at > 0, F.nullif(F.substring(key, at + 1, F.length(key)), F.lit("")))


def short_name(name: Column) -> Column:
    """`head: last segment` of a name such as head:path/to/it; other names stay."""
    tail = F.element_at(F.split(F.translate(key_suffix(name), "\\", "/"), "/"), -1)
    return F.when(key_suffix(name).isNull(), name).otherwise(F.concat(F.substring_index(name, ":", 1), F.lit(": "), tail))


def span_category(name: Column) -> Column:
    out = F.when(name == "task", "task")
    for prefix in ("llm", "sandbox", "node", "api"):
        out = out.when(name.startswith(prefix + ":"), prefix)
    return out.otherwise("other")


def owner_type(symbol: Column) -> Column:
    """What stands before `#`; null if nothing does."""
    return F.when(F.instr(symbol, "#") > 1, F.substring_index(symbol, "#", 1))


def chunk_key(path: Column, symbol: Column) -> Column:
    return F.concat(path, F.lit("::"), F.coalesce(symbol, F.lit("")))


def path_tail(path: Column, n: int) -> Column:
    """The last n segments of a path, with slashes only."""
    return F.array_join(F.slice(F.reverse(F.split(F.translate(path, "\\", "/"), "/")), 1, n), "/") if n == 1 else _tail(path, n)


def _tail(path: Column, n: int) -> Column:
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), n), "/")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def abbreviate(text: Column, n: int) -> Column:
    """Runs of white space become one space; longer texts are cut and end in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def head_and_tail(text: Column, limit: int) -> Column:
    """A third of the limit from the start and the rest from the end, with a note of what is left out."""
    head, n = limit // 3, F.length(text)
    note = F.concat(F.lit("\n... ["), (n - limit).cast("string"), F.lit(" characters left out] ...\n"))
    return F.when(n <= limit, text).otherwise(F.concat(F.substring(text, 1, head), note, F.substring(text, n - (limit - head) + 1, F.lit(limit - head))))


def last_lines(text: Column, n: int) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), n), "\n")


def html_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def lines(text: Column) -> Column:
    """Lines of a text with any line ends; empty ones at its end stay."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def java_major(version: Column) -> Column:
    """8 of 1.8 and of 8, 17 of 17.0.2; null for a placeholder or anything else."""
    plain = F.regexp_replace(F.trim(version), r"^1\.", "")
    return F.regexp_extract(plain, r"^([0-9]+)(?:\..*)?$", 1).try_cast("int")


def idempotency_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def duration_text(ms: Column) -> Column:
    """750 ms, 2.4 s, 1m 23s, 2h 33m."""
    s = F.floor(ms / 1000 + F.lit(0.5)).cast("long")
    minutes = F.floor(s / 60).cast("long")
    tenths = F.floor(ms / 100 + F.lit(0.5)).cast("long")
    return (
        F.when(ms.isNull(), None)
        .when(ms < 1000, F.concat(F.floor(ms).cast("string"), F.lit(" ms")))
        .when(tenths < 600, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine, in double; null if the lengths differ."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda u, v: F.aggregate(F.zip_with(wide(u), wide(v), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def diff_stat(diff: Column) -> tuple[Column, Column]:
    """Added and removed lines of a unified diff, without its file headers."""
    rows = F.split(diff, "\n", -1)
    count = lambda sign: F.size(F.filter(rows, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("long")
    return count("+"), count("-")


def diff_side(diff: Column, after: bool) -> Column:
    """The text before or after a unified diff: shared lines and those of its side, without their sign."""
    own = "+" if after else "-"
    rows = F.filter(F.split(diff, "\n", -1), lambda x: ~x.startswith("+++") & ~x.startswith("---") & ~x.startswith("@@") & (x.startswith(" ") | x.startswith(own)))
    return F.array_join(F.transform(rows, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def backoff_ms(attempt: Column, base: int = 1000, most: int = 30_000) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(4))), F.lit(most)).cast("long")


def duration_seconds(text: Column) -> Column:
    """Seconds of 24h, 5m or 30s; null for anything else."""
    pattern = r"^([0-9]+)([hms])$"
    unit = F.regexp_extract(F.trim(text), pattern, 2)
    size = F.when(unit == "h", 3600).when(unit == "m", 60).when(unit == "s", 1)
    return F.regexp_extract(F.trim(text), pattern, 1).try_cast("long") * size


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HHmmss")


def is_split_duration(wall_ms: Column, run_ms: Column) -> Column:
    """Whether the time on the wall is shown apart: the run's own is known and a second shorter at least."""
    return F.coalesce(wall_ms - run_ms >= 1000, F.lit(False))


def token_cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    """Prices are of a million tokens."""
    return prompt / 1e6 * F.lit(float(price_in)) + completion / 1e6 * F.lit(float(price_out))


def percent_text(share: Column) -> Column:
    return F.when(share.isNull(), "no sample").otherwise(F.format_string("%.1f%%", share * 100))


def over_budget(elapsed_ms: Column, last_ms: Column, budget_ms: int) -> Column:
    """Whether another attempt as long as the last one would pass the budget."""
    return elapsed_ms + last_ms > budget_ms


def xml_value(text: Column, tag: str) -> Column:
    """The text of the first element of this name without children; null if it has none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"<{tag}>([^<]*)</{tag}>", 1)), F.lit(""))
