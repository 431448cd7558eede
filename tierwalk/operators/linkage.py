"""Linking names: containment by a term's rarest gram, exact after normalization, fuzzy by rare characters and signatures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.functions.text import bare_name
from tierwalk.operators.order import numbered
from tierwalk.session import stored

#: Characters of a gram: terms of 12 characters and more are met by one of their grams of 12, shorter ones by one of 6, those under 6 by themselves.
SHORT_GRAM, LONG_GRAM = 6, 12


def _grams(text, k):
    """Distinct substrings of k characters (a number or a column)."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1)), lambda i: F.substr(text, i, k)))


def rarest_grams(whole: DataFrame, part: DataFrame, text: str, term: str) -> tuple[DataFrame, DataFrame]:
    """Texts by gram (text, _gram), and for each term (distinct, not empty) the gram of it that the fewest texts hold, the first of several: term, _gram, _gram_n texts.

    Only grams of terms are counted, so counts are as many as the terms' grams. A term with a gram that no text holds is in no text and is left out.
    """
    n = F.length(term)
    size = F.when(n >= LONG_GRAM, LONG_GRAM).when(n >= SHORT_GRAM, SHORT_GRAM).otherwise(n)
    terms = part.select(term).filter(n > 0).distinct()
    lengths = [r["k"] for r in terms.select(size.alias("k")).distinct().collect()]  # seven numbers at most
    of_terms = stored(terms.select(term, F.explode(_grams(F.col(term), size)).alias("_gram")), "term-grams")
    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *[_grams(F.col(text), k) for k in sorted(lengths)]))
    of_texts = whole.select(text).distinct().select(text, F.explode(every).alias("_gram")).join(of_terms.select("_gram").distinct(), "_gram", "left_semi")
    of_texts = stored(of_texts, "text-grams")
    counts = of_texts.groupBy("_gram").agg(F.count(F.lit(1)).alias("_gram_n"))
    known = of_terms.join(counts, "_gram", "left").withColumn("_gram_n", F.coalesce("_gram_n", F.lit(0)))
    rarest = known.groupBy(term).agg(F.min(F.struct("_gram_n", "_gram")).alias("_r")).filter("_r._gram_n > 0")
    return of_texts, rarest.select(term, "_r._gram", "_r._gram_n")


def holds(whole: DataFrame, part: DataFrame, text: str, term: str) -> DataFrame:
    """Rows of whole beside each row of part whose term their text holds; a term meets the texts that hold its rarest gram, so a common beginning doesn't bring all names of it together.

    Terms are compared as they are; empty terms are held by nothing.
    """
    of_texts, rarest = rarest_grams(whole, part, text, term)
    pairs = of_texts.join(rarest.select(term, "_gram"), "_gram").filter(F.contains(F.col(text), F.col(term))).select(F.col(text).alias("_w"), F.col(term).alias("_p"))
    met = whole.join(pairs, F.col(text) == F.col("_w")).drop("_w")
    return met.join(part, F.col("_p") == F.col(term)).drop("_p")


def searched(companies: DataFrame, terms: DataFrame, names: Sequence[str] = ("name", "ticker"), seq: str = "seq") -> DataFrame:
    """Companies found by any term (term, ord and more): one row for each pair, with terms in any case as parts of any of the names."""
    low = companies.withColumns({f"_{n}": F.lower(F.coalesce(F.col(n), F.lit(""))) for n in names})
    wanted = terms.withColumn("_t", F.lower("term"))
    found = None
    for n in names:
        part = holds(low, wanted, f"_{n}", "_t").drop(*[f"_{m}" for m in names], "_t")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def first_of_each(found: DataFrame, key: str = "cik", order: Sequence[str] = ("ord", "seq")) -> DataFrame:
    """The first find of every key."""
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def latest_with(sub: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """For each term (distinct) and registrant with a row whose name or former name holds it in any case, the latest such row, the first of several."""
    rows = sub.withColumns({"_name": F.lower("name"), "_former": F.lower(F.coalesce("former", F.lit("")))})
    wanted = terms.select(term).distinct().withColumn("_t", F.lower(term))
    found = holds(rows, wanted, "_name", "_t").unionByName(holds(rows, wanted, "_former", "_t")).drop("_name", "_former", "_t")
    rest = [c for c in sub.columns if c != "cik"]
    return found.groupBy(term, "cik").agg(F.max_by(F.struct(*rest), F.struct(F.col("filed"), -F.col("seq"))).alias("_r")).select(term, "cik", "_r.*")


def subsidiaries_in_index(entries: DataFrame, sub: DataFrame, name: str = "name") -> DataFrame:
    """entries with matched_cik: of the registrants whose latest row with the entry's name in it has exactly that name in any case, the first by name."""
    names = entries.select(F.col(name).alias("term")).distinct()
    # only registrants that have the name at all can be the answer; all their rows that hold it count for which is the latest
    same = names.join(sub.select("cik", F.upper("name").alias("_u")).distinct(), F.upper("term") == F.col("_u")).select("term", "cik").distinct()
    rows = sub.join(same, "cik").filter(F.contains(F.lower("name"), F.lower("term")) | F.contains(F.lower(F.coalesce("former", F.lit(""))), F.lower("term")))
    latest = rows.groupBy("term", "cik").agg(F.max_by("name", F.struct(F.col("filed"), -F.col("seq"))).alias("n"), F.min("seq").alias("s"))
    hit = latest.filter(F.upper("n") == F.upper("term")).groupBy("term").agg(F.min_by("cik", F.struct("n", "s")).alias("matched_cik"))
    return entries.join(hit.withColumnRenamed("term", name), name, "left")


def unique_in_index(names: DataFrame, sub: DataFrame, name: str = "name") -> DataFrame:
    """names with matched_cik: the registrant of the index that alone holds the name in its own or former name, if its name is the same in any case."""
    found = latest_with(sub, names.select(F.col(name).alias("term")))
    alone = found.groupBy("term").agg(F.count(F.lit(1)).alias("k"), F.min("cik").alias("cik"), F.min("name").alias("n")).filter("k = 1")
    hit = alone.filter(F.upper("n") == F.upper("term")).select(F.col("term").alias(name), F.col("cik").alias("matched_cik"))
    return names.join(hit, name, "left")


def exact(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """left with the columns of right where the names are the same without company suffixes."""
    a, b = left.withColumn("_k", bare_name(F.col(left_name))), right.withColumn("_k", bare_name(F.col(right_name)))
    return a.join(b, "_k", "left").drop("_k")


#: Of lengths that are compared the lesser is this share of the greater at least.
LEAST_LENGTH = 0.6
_SURE = 1e-9


#: Keys of a name's halves at most; longer names than have so many meet by rare characters.
MOST_KEYS = 1000


@cache
def _budget(n: int, m: int, t: float) -> tuple[int, int] | None:
    """Characters of names of n and m characters that are in no matching block at most, if their ratio is t or more; None if it can't be."""
    least = max(0, ceil(t * (n + m) / 2 - _SURE))
    return (n - least, m - least) if least <= min(n, m) else None


@cache
def _longest(t: float) -> int:
    """The greatest length up to which names as long as each other have MOST_KEYS keys at most."""
    k = 1
    while k < 64 and 2 * sum(comb(-(-(k + 1) // 2), d) for d in range((sum(_budget(k + 1, k + 1, t)) // 2) + 1)) <= MOST_KEYS:
        k += 1
    return k


def _cuts(length: int, others: Sequence[int], t: float, whole: bool) -> list[tuple[int, int, int]]:
    """Parts of a name of `length` characters and how many of their characters are left out: (half, characters, left out).

    Names of the right side (whole) are cut in the middle. Of a name of the left side those beginnings and ends count that such a half can match.
    """
    out = set()
    for o in others:
        n, m = (o, length) if whole else (length, o)
        free = _budget(n, m, t)
        if free is None:
            continue
        for half, size in ((0, m // 2), (1, m - m // 2)):
            for u in range(min(free[0], sum(free) // 2) + 1):
                for v in range(min(free[1], sum(free) // 2 - u) + 1):
                    if v <= size and size - v + u <= n:
                        out.add((half, size, v) if whole else (half, size - v + u, u))
    return sorted(out)


def _keys(names: pa.Array, others: Sequence[int], t: float, whole: bool) -> pa.Array:
    """For each name the hashes of its parts with characters left out, every choice of them."""
    values = names.to_pylist()
    lengths = np.array([len(x) for x in values], np.int64)
    made, sizes = [], np.zeros(len(values), np.int64)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        letters = np.frombuffer("".join(values[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n).astype(np.uint64) + np.uint64(1)
        found = []
        for half, size, out in _cuts(n, others, t, whole):
            kept = np.array(list(combinations(range(size), size - out)), np.int64).reshape(comb(size, out), size - out) + (n - size if half else 0)
            h = np.full((len(rows), len(kept)), 7 + 2 * half, np.uint64)
            for at in kept.T:
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += letters[:, at]
                h ^= h >> np.uint64(29)
            found.append(h)
        if found:
            made.append((rows, np.concatenate(found, axis=1)))
            sizes[rows] = made[-1][1].shape[1]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.empty(int(offsets[-1]), np.uint64)
    for rows, h in made:
        flat[offsets[rows][:, None] + np.arange(h.shape[1])] = h
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))


def near(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs _k, _o of names (both columns _k, distinct and not empty) that may have a ratio of matching blocks of `threshold` (over 0) or more, and have all that do.

    Matching blocks keep their order. So when the right name is cut in the middle, one half is a beginning or an end of the left name but for
    half of the characters that may match nothing: names meet by such parts with characters left out on both sides (by their hashes,
    which may only add pairs). Parts of long names have too many such choices; pairs with a name over that length meet by rare characters.
    """
    spark, top = left.sparkSession, _longest(threshold)
    sizes = [sorted(r["n"] for r in df.select(F.length("_k").alias("n")).distinct().collect()) for df in (left, right)]  # numbers up to the longest name
    short = [[n for n in s if n <= top] for s in sizes]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(df: DataFrame, others: list[int], whole: bool) -> DataFrame:
        @F.arrow_udf("array<long>")
        def keys(names: pa.Array) -> pa.Array:
            made = [_keys(names.slice(at, 256), others, threshold, whole) for at in range(0, len(names), 256)]
            return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int64()))

        # names are short and their keys many, so they are dealt to all tasks (by the name itself Spark would leave them as distinct has put them together)
        rows = df.select("_k").filter(F.length("_k") <= top).repartition(parts, F.xxhash64("_k"))
        return rows.select(F.xxhash64("_k").alias("_a" if not whole else "_b"), F.explode(keys("_k")).alias("_key"))

    # names of either side may be many and look few as files, so none of them is broadcast
    met = keyed(left, short[1], False).join(keyed(right, short[0], True).hint("merge"), "_key").select("_a", "_b").distinct()
    out = met.join(left.select("_k", F.xxhash64("_k").alias("_a")).hint("merge"), "_a").join(right.select(F.col("_k").alias("_o"), F.xxhash64("_k").alias("_b")).hint("merge"), "_b").select("_k", "_o")
    is_long = F.length("_k") > top
    if len(short[0]) < len(sizes[0]):
        out = out.unionByName(_by_rare_characters(left.filter(is_long), right, threshold))
    if len(short[1]) < len(sizes[1]):
        out = out.unionByName(_by_rare_characters(left.filter(~is_long), right.filter(is_long), threshold))
    return out.distinct()


def _by_rare_characters(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs as in `near`, for names of any length.

    Matching blocks match each character once, so names of n and m characters with a ratio of t have t (n + m) / 2 characters in
    common, as bags. A bag's tokens are (character, which of its kind); in the order of rising frequency two such bags share
    one of the first n - t (n + m) / 2 + 1 tokens, for the least m that can count: names meet in an index of these. Of
    those that meet, only pairs go on whose signatures (128 bits, each token flips one) differ in (1 - t) (n + m) bits at most.
    """
    t = threshold
    n = F.length("_k")
    names = left.select("_k", F.lit(0).alias("_side")).unionByName(right.select("_k", F.lit(1).alias("_side"))).distinct()
    chars = names.select("_k", "_side", F.explode(F.regexp_extract_all("_k", F.lit("(?s)."), F.lit(0))).alias("_c"))
    tokens = chars.groupBy("_k", "_side", "_c").agg(F.count(F.lit(1)).alias("_m")).select("_k", "_side", "_c", F.explode(F.sequence(F.lit(1).cast("long"), "_m")).alias("_i"))
    tokens = stored(tokens, "tokens")
    counts = tokens.groupBy("_c", "_i").agg(F.sum("_side").alias("_df"))
    ranks = numbered(counts, ["_df", "_c", "_i"], "_rank")
    flip = lambda half: F.bit_xor(F.when(F.pmod(F.col("_rank"), F.lit(128)) >= 64 if half else F.pmod(F.col("_rank"), F.lit(128)) < 64, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_rank"), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")))
    bags = tokens.join(ranks, ["_c", "_i"]).groupBy("_k", "_side").agg(F.sort_array(F.collect_list("_rank")).alias("_t"), flip(0).alias("_s0"), flip(1).alias("_s1"))
    least = F.ceil(F.greatest(n * (t / (2 - t)), n * LEAST_LENGTH) - _SURE)
    shared = F.greatest(F.lit(1), F.ceil((n + least) * (t / 2) - _SURE))
    bags = stored(bags.select("_side", "_k", n.alias("_n"), "_s0", "_s1", F.explode(F.slice("_t", F.lit(1), F.greatest(F.lit(0), n - shared + 1).cast("int"))).alias("_token")), "prefixes")
    a = bags.filter("_side = 0").drop("_side")
    b = bags.filter("_side = 1").select("_token", F.col("_k").alias("_o"), F.col("_n").alias("_m"), F.col("_s0").alias("_z0"), F.col("_s1").alias("_z1"))
    apart = F.bit_count(F.col("_s0").bitwiseXOR(F.col("_z0"))) + F.bit_count(F.col("_s1").bitwiseXOR(F.col("_z1")))
    lengths = F.least("_n", "_m") >= F.greatest("_n", "_m") * LEAST_LENGTH - _SURE
    return a.join(b.hint("merge"), (a["_token"] == b["_token"]) & lengths & (apart <= (F.col("_n") + F.col("_m")) * (1 - t) + _SURE)).select("_k", "_o").distinct()


def fuzzy(left: DataFrame, lookup: DataFrame, name: str, threshold: float = 0.8) -> DataFrame:
    """left with cik, sec_name, ticker, match_type (exact, fuzzy or none) and match_score from lookup (key, place, cik, ticker, title).

    Names are compared without company suffixes. Without an equal one the most similar counts, if the ratio of its matching
    blocks is `threshold` (over 0) or more, the first place of several; names whose lengths differ by more than two fifths are left out.

    The lookup and what comes of it grow with the registrants and look small as files, so they are merged and never broadcast.
    """
    names = left.select(F.col(name)).distinct().withColumn("_k", bare_name(F.col(name)))
    known = stored(lookup.select(F.col("key").alias("_k"), "place", "cik", F.col("title").alias("sec_name"), "ticker"), "known")
    same = names.join(known.drop("place").hint("merge"), "_k").select(name, "cik", "sec_name", "ticker", F.lit("exact").alias("match_type"), F.lit(1.0).alias("match_score"))
    rest = stored(names.join(known.select("_k").hint("merge"), "_k", "left_anti").filter("_k <> ''"), "unmatched")
    # of registrants with one name the first
    firsts = stored(known.filter("_k <> ''").groupBy(F.col("_k").alias("_o")).agg(F.min_by(F.struct("place", "cik", "sec_name", "ticker"), "place").alias("_f")), "firsts")
    pairs = near(rest.select("_k").distinct(), firsts.select(F.col("_o").alias("_k")), threshold)
    pairs = pairs.filter(F.abs(F.length("_o") - F.length("_k")) <= F.greatest(F.length("_o"), F.length("_k")) * 0.4)

    @F.pandas_udf("double")
    def ratio(a, b):
        from difflib import SequenceMatcher

        def one(x, y):
            m = SequenceMatcher(None, x, y)
            # an upper bound first
            return m.ratio() if m.quick_ratio() >= threshold else 0.0

        return a.combine(b, one)

    scored = pairs.withColumn("_s", ratio("_k", "_o")).filter(F.col("_s") >= threshold).join(firsts.hint("merge"), "_o")
    best = scored.groupBy("_k").agg(F.max_by(F.struct("_f", "_s"), F.struct(F.col("_s"), -F.col("_f.place"))).alias("_r"))
    best = rest.join(best.hint("merge"), "_k").select(name, "_r._f.cik", "_r._f.sec_name", "_r._f.ticker", F.lit("fuzzy").alias("match_type"), F.round("_r._s", 3).alias("match_score"))
    out = left.join(same.unionByName(best).hint("merge"), name, "left")
    return out.withColumns({"match_type": F.coalesce("match_type", F.lit("none")), "match_score": F.coalesce("match_score", F.lit(0.0)), **{c: F.coalesce(c, F.lit("")) for c in ("cik", "sec_name", "ticker")}})
