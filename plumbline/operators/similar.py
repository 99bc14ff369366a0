"""Trigram similarity of strings: exact nearest ones without all pairs that share a common trigram, and containment.

The similarity of two sets is the size of their intersection over that of their union. For a similarity of at least t, a
set of n trigrams has to share one of its n - ceil(t n) + 1 rarest with a rarest one of the other, and the other has between
t n and n / t of them: so frequent trigrams, which would bring every pair together, are no keys as long as t is high. The
nearest strings of a query are searched at falling t; a query that has found enough at some t is done, since all that is at
least so near was found. Only those with few near ones come to the low values, where they meet more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scratch import checkpointed, small

#: The similarities at which nearest ones are searched; at 0 any common trigram will do.
STEPS = (0.8, 0.6, 0.45, 0.3, 0.15, 0.0)
PARTS = 16
#: Symbols whose runs of characters one task takes.
DEALT = 25_000
#: Among so few strings any common trigram will do at once: a query meets no more of them than that.
FEW = 1000


def gram_sets(strings: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """(s, grams, n) of distinct strings (s): their trigrams, the rarest among the first table's first. Strings without any are left out."""
    split = [x.select("s").distinct().select("s", F.explode(T.trigrams(F.col("s"))).alias("g")) for x in (strings, *others)]
    # 37 characters make 50,653 trigrams at most, so their counts may be broadcast.
    counts = F.broadcast(checkpointed(split[0].groupBy("g").agg(F.count("*").alias("often"))))
    out = []
    for x in split:
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")))
        out.append(checkpointed(x.join(counts, "g", "left").groupBy("s").agg(ordered.alias("o")).select("s", F.col("o.g").alias("grams"), F.size("o").alias("n"))))
    return out


def _prefix(t: float, n: str) -> Column:
    return F.col(n) if not t else F.col(n) - F.ceil(F.lit(t) * F.col(n) - 1e-9).cast("int") + 1


def candidates(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(s, other, both, n, m): pairs of sets with a similarity of at least t (over 0 at 0) and the size of their intersection.

    A pair meets at each trigram that both prefixes have, and is taken at the first. A trigram that many right sets have in
    their prefixes is dealt over `PARTS`, and the left sets that have it go to each part.
    """
    x = left.withColumn("head", F.slice("grams", F.lit(1), _prefix(t, "n"))).select("s", "grams", "n", "head", F.explode("head").alias("g"))
    y = right.select(F.col("s").alias("other"), F.col("grams").alias("others"), F.col("n").alias("m"))
    y = y.withColumn("tail", F.slice("others", F.lit(1), _prefix(t, "m"))).select("other", "others", "m", "tail", F.explode("tail").alias("h"))
    y = y.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(PARTS)))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    fits = (F.col("m") >= F.lit(t) * F.col("n") - 1e-9) & (F.lit(t) * F.col("m") <= F.col("n") + 1e-9)
    met = x.join(y, (F.col("g") == F.col("h")) & (x["part"] == y["part"]) & fits & (F.array_intersect("head", "tail")[0] == F.col("g")))
    both = F.size(F.array_intersect("grams", "others"))
    found = met.select("s", "other", both.alias("both"), "n", "m")
    return found.where(F.col("both") >= F.lit(t) * (F.col("n") + F.col("m") - F.col("both")) - 1e-9)


def similarity() -> Column:
    return F.col("both") / (F.col("n") + F.col("m") - F.col("both"))


def nearest(queries: DataFrame, strings: DataFrame, n: int, itself: bool = True, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """(s, other, both, n, m) of queries (s) and strings (s): at least the n most similar strings of each query, with all
    that are as near as the last of them; fewer if fewer have a trigram in common. Without `itself` equal strings don't count."""
    known, asked = gram_sets(strings, queries)
    out = None
    for t in steps if known.limit(FEW + 1).count() > FEW else steps[-1:]:
        pairs = candidates(asked, known, t)
        pairs = checkpointed(pairs if itself else pairs.where("s <> other"))
        if t:
            enough = pairs.groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") >= n).select("s")
            enough = small(enough)
            found, asked = pairs.join(enough, "s", "left_semi"), checkpointed(asked.join(enough, "s", "left_anti"))
        else:
            found = pairs
        out = found if out is None else out.union(found)
        if t and not asked.limit(1).count():
            break
    return out


def pattern(fragment: Column) -> Column:
    """The pattern of a fragment anywhere in a string; its wildcards stay wildcards."""
    return F.concat(F.lit("%"), F.lower(fragment), F.lit("%"))


def _pieces(s: Column, size: int) -> Column:
    """All runs of `size` characters of a lower-case string."""
    at = F.sequence(F.lit(1), F.greatest(F.length(s) - size + 1, F.lit(1)))
    return F.filter(F.transform(at, lambda i: F.substring(s, i, F.lit(size))), lambda g: F.length(g) == size)


def containing(symbols: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank): the n symbols (id, symbol) that contain a query's fragment (query_id, fragment) by ILIKE,
    the most similar by trigrams first, then by id. `%` and `_` in a fragment are wildcards, a backslash stands for itself.

    A fragment meets the symbols that have the rarest run of characters (of up to three) of what it says literally. One of
    wildcards only is contained in whatever is long enough: the n least ids of each length of symbols stand for all.
    """
    from .retrieval import ranked

    named = symbols.where("symbol is not null").select("id", "symbol", F.lower("symbol").alias("low"))
    own = checkpointed(named.repartition(max(PARTS, -(-named.count() // DEALT)), "id"))  # a small file is one partition, whose runs are many
    asked = queries.where("fragment is not null").select("fragment").distinct().withColumn("words", F.filter(F.split(F.lower("fragment"), "[%_]"), lambda w: F.length(w) > 0))
    longest = F.least(F.coalesce(F.array_max(F.transform("words", lambda w: F.length(w))), F.lit(0)), F.lit(3))
    asked = checkpointed(asked.withColumn("size", longest))
    runs = None
    for size in (1, 2, 3):
        x = own.select("id", F.lit(size).alias("size"), F.explode(F.array_distinct(_pieces(F.col("low"), size))).alias("run"))
        runs = x if runs is None else runs.union(x)
    wanted = asked.where("size > 0").select("fragment", "size", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.substring(w, i, F.col("size"))), lambda g: F.length(g) == F.col("size")))))).alias("run"))
    known = small(wanted.select("size", "run").distinct())
    runs = checkpointed(runs.join(known, ["size", "run"], "left_semi"))
    often = small(runs.groupBy("size", "run").agg(F.count("*").alias("often")))
    keys = wanted.join(often, ["size", "run"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    keys = keys.groupBy("fragment").agg(F.min(F.struct("often", "size", "run")).alias("k")).select("fragment", "k.size", "k.run")
    literal = runs.join(small(keys), ["size", "run"]).select("fragment", "id").join(own, "id")
    free = asked.where("size = 0").select("fragment", F.length(F.replace("fragment", F.lit("%"), F.lit(""))).alias("least"))
    first = ranked(own.withColumn("length", F.length("low")), ["length"], n, F.col("id")).drop("rank")
    anything = small(free).join(first, F.col("length") >= F.col("least")).select("fragment", "id", "symbol", "low")
    plain = F.replace(pattern(F.col("fragment")), F.lit("\\"), F.lit("\\\\"))
    met = literal.select("fragment", "id", "symbol", "low").union(anything).where(F.like("low", plain))
    a, b = T.trigrams(F.col("symbol")), T.trigrams(F.col("fragment"))
    both = F.size(F.array_intersect(a, b))
    score = F.round(F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)), 6)
    near = ranked(met.select("fragment", "id", score.alias("score")), ["fragment"], n, F.desc("score"), F.col("id"))
    return queries.select("query_id", "fragment").join(near, "fragment").select("query_id", "id", "score", "rank")
