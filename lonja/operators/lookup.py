"""Exact and whole-word lookups under explicit policies for several matches."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import bind, blank, clean_key, phrase_key
from lonja.operators.align import rename_brought


class Several(Enum):
    """Which match counts when a row has several."""

    LONGEST = "longest"
    FIRST = "first"
    ALL = "all"


def _joined(value: str, order: str) -> Column:
    """All values in order, joined by line breaks, nulls as ''."""
    return F.expr(f"listagg(coalesce(`{value}`, ''), '\n') WITHIN GROUP (ORDER BY `{order}`)")


def _reduce(keyed: DataFrame, key: str, bring: Sequence[str], order: str, every: bool) -> DataFrame:
    if every:
        return keyed.groupBy(key).agg(F.min(order).alias("_rank"), *[_joined(c, order).alias(c) for c in bring])
    first = keyed.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(f"`{c}`") for c in bring])).alias("_f"))
    return first.select(key, F.col(f"_f.{order}").alias("_rank"), *[F.col(f"_f.`{c}`").alias(c) for c in bring])


def exact_table(table: DataFrame, key: str, bring: Sequence[str], order: str = "_ord", every: bool = False) -> DataFrame:
    """``(clave_limpia, brought columns)``: blank keys dropped, the first row of a key or all values of it joined."""
    keyed = table.select(clean_key(key).alias("clave_limpia"), F.col(order), *[F.col(f"`{c}`").cast("string").alias(c) for c in bring]).where("clave_limpia <> ''")
    return _reduce(keyed, "clave_limpia", bring, order, every).drop("_rank")


def exact_lookup(base: DataFrame, key: str, lookup: DataFrame, matched_only: bool = False) -> DataFrame:
    """Left join on the clean key. Brought columns come first, renamed where they clash; no match gives ''."""
    bring = [c for c in lookup.columns if c != "clave_limpia"]
    names = rename_brought(base.columns, bring)
    side = lookup.select("clave_limpia", *[F.col(f"`{c}`").alias(f"_b_{i}") for i, c in enumerate(bring)], F.lit(True).alias("_hit"))
    joined = base.withColumn("_k", clean_key(key)).join(side, F.col("_k") == F.col("clave_limpia"), "inner" if matched_only else "left")
    return joined.select(*[blank(f"_b_{i}").alias(names[c]) for i, c in enumerate(bring)], *[F.col(f"`{c}`") for c in base.columns])


def match_counts(base: DataFrame, key: str, lookup: DataFrame) -> DataFrame:
    """One row: matched rows and all rows."""
    joined = base.select(clean_key(key).alias("_k")).join(lookup.select("clave_limpia"), F.col("_k") == F.col("clave_limpia"), "left")
    return joined.agg(F.count("clave_limpia").alias("matched"), F.count("*").alias("rows"))


def phrase_table(table: DataFrame, key: str, bring: Sequence[str], order: str = "_ord", every: bool = False) -> DataFrame:
    """``(clave_norm, _rank, brought columns)``; the rank is the order value of a key's first row."""
    keyed = table.select(phrase_key(key).alias("clave_norm"), F.col(order), *[F.col(f"`{c}`").cast("string").alias(c) for c in bring]).where("clave_norm <> ''")
    return _reduce(keyed, "clave_norm", bring, order, every)


def _grams(text: str, lengths: Sequence[int]) -> Column:
    """The word n-grams of a normalised text, for some lengths; each length is the one below with a further word."""
    words = F.split(F.col(text), " ")

    def every(w: Column) -> Column:
        longer, found = w, [w] if 1 in lengths else []
        for n in range(2, max(lengths) + 1):
            # Beyond the last word the result is null, which equals no phrase.
            longer = F.zip_with(longer, F.slice(w, n, F.size(w)), lambda gram, word: F.concat(gram, F.lit(" "), word))
            found += [longer] if n in lengths else []
        return F.concat(*found)

    return bind(words, every)


def _with_every_phrase(keyed: DataFrame, lookup: DataFrame, bring: Sequence[str], several: Several) -> DataFrame:
    """``keyed`` with ``_hits``, the phrases found in order of choice. The whole lookup is one row, attached to each text."""
    first = [(-F.char_length("clave_norm")).alias("l")] if several is Several.LONGEST else []
    entry = F.struct(*first, F.col("_rank"), F.concat(F.lit(" "), "clave_norm", F.lit(" ")).alias("k"), *[blank(c).alias(f"_b_{i}") for i, c in enumerate(bring)])
    phrases = lookup.agg(F.array_sort(F.collect_list(entry)).alias("_phrases"))
    padded = keyed.withColumn("_t", F.concat(F.lit(" "), "_t", F.lit(" ")))
    return padded.crossJoin(F.broadcast(phrases)).withColumn("_hits", F.expr("filter(_phrases, p -> contains(_t, p.k))")).drop("_phrases")


def _with_gram_join(base: DataFrame, keyed: DataFrame, lookup: DataFrame, bring: Sequence[str], several: Several, order: str, sent: bool) -> DataFrame:
    """The same from an equality join with the n-grams of each text, for the lengths that phrases have."""
    lengths = [r[0] for r in lookup.select(F.size(F.split("clave_norm", " ")).alias("n")).distinct().orderBy("n").collect()]
    grams = keyed.select(F.col(order).alias("_at"), F.explode(_grams("_t", lengths or [1])).alias("_g"))
    first = [(-F.char_length("clave_norm")).alias("l")] if several is Several.LONGEST else []
    entry = F.struct(*first, F.col("_rank"), *[blank(c).alias(f"_b_{i}") for i, c in enumerate(bring)])
    hits = grams.join(F.broadcast(lookup) if sent else lookup, F.col("_g") == F.col("clave_norm")).groupBy("_at")
    # Only the policy that reports all hits gathers them; the others keep the least.
    hits = hits.agg((F.array_sort(F.collect_set(entry)) if several is Several.ALL else F.array(F.min(entry))).alias("_hits"))
    return base.join(hits, F.col(f"`{order}`") == F.col("_at"), "left")


def phrase_lookup(base: DataFrame, column: str, lookup: DataFrame, several: Several, order: str = "_ord", grams: bool = False, matched_only: bool = False, small_bytes: int = 1 << 20, sent_bytes: int = 32 << 20) -> DataFrame:
    """Rows with the brought columns of the phrases that their text holds as whole words.

    A lookup of at most ``small_bytes`` is sent to all tasks and tried on each text, without a shuffle. A larger one, or any
    with ``grams``, is joined with the texts' word n-grams, whose equality gives the same hits: up to ``sent_bytes`` as a
    broadcast, beyond that by a shuffle of both sides. ``order`` is unique.
    """
    bring = [c for c in lookup.columns if c not in ("clave_norm", "_rank")]
    keyed = base.withColumn("_t", phrase_key(column))
    size = lookup.agg(F.sum(sum((F.length(blank(c)) for c in ("clave_norm", *bring)), F.lit(32)))).first()[0] or 0
    if grams or size > small_bytes:
        found = _with_gram_join(base, keyed, lookup, bring, several, order, size <= sent_bytes)
    else:
        found = _with_every_phrase(keyed, lookup, bring, several)
    if matched_only:
        found = found.where("size(_hits) > 0")
    names = rename_brought(base.columns, bring)
    if several is Several.ALL:
        values = [F.array_join(F.col(f"_hits._b_{i}"), "\n") for i in range(len(bring))]
    else:
        values = [F.expr(f"get(_hits, 0)._b_{i}") for i in range(len(bring))]
    return found.select(*[blank(v).alias(names[c]) for c, v in zip(bring, values, strict=True)], *[F.col(f"`{c}`") for c in base.columns])


def word_table(words: DataFrame, column: str, order: str = "_ord") -> DataFrame:
    """Lookup of words to find: the first spelling of each normalised word, under ``Palabra_encontrada``."""
    named = words.select(F.col(f"`{column}`").alias("Palabra_encontrada"), F.col(order))
    return phrase_table(named, "Palabra_encontrada", ["Palabra_encontrada"], order)


def find_words(base: DataFrame, column: str, words: DataFrame, several: Several = Several.FIRST, order: str = "_ord") -> DataFrame:
    """``Palabra_encontrada`` first, then the row."""
    if several is Several.LONGEST:
        raise ValueError("finding words reports the first or all of them")
    return phrase_lookup(base, column, words, several, order)
