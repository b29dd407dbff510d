"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a policy is a set of rules (a mask) with a version,
so a new policy, or an ablation of one rule, needs only bitwise operations on
the ledger and no second look at the texts.

Edge cases: a null or empty text has no words and all measures are 0; equal
rows are judged alike and independently; a text of 2^24 words and more is
measured without the pre-selection of repeated windows, with the same result; an
empty table gives an empty ledger; other columns pass through unless they clash
with a ledger column, in which case the ledger's column wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Measures the rules use, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Low bits of a sort key that hold a window's position; longer documents skip the pre-selection.
_POS_BITS = 24


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; its bit is its place in RULES."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_ratio", "10 * n_symbols > 3 * word_chars"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines"),
    Rule("mean_word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule("no_text", "n_words = 0"),
)
#: Policies by version: the names of the rules that reject a document.
POLICIES = {
    "base-1": ("too_few_words", "repeated_phrases"),
    "web-1": ("too_few_words", "repeated_phrases", "symbol_ratio", "duplicate_lines", "mean_word_length", "no_text"),
}


def mask_of(names, rules=RULES) -> int:
    """The bits of the named rules; an unknown name is an error."""
    place = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << place[n] for n in set(names))


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more, from column ``_w``.

    A primitive sort of (hash | position) keys finds the windows whose hash has
    a neighbour of the same hash: all repeated ones, and by chance others.  Only
    those are then compared as strings, so the count is exact.
    """
    keep = F.lit(-(1 << _POS_BITS)).cast("long")
    n = F.size("_w")

    def key(i):
        h = F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
        return h.bitwiseAND(keep).bitwiseOR(i.cast("long"))

    keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))
    return F.when(n < 4, F.array().cast("array<bigint>")).when(
        n < (1 << _POS_BITS), keys).otherwise(F.array().cast("array<bigint>"))


def ledger(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` without its text, with MEASURES and ``fail_bits`` (long)."""
    keep = [c for c in docs.columns if c not in {text, "fail_bits", *MEASURES}]
    words = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^[{SPACES}]+|[{SPACES}]+$", ""), f"[{SPACES}]+")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(
        *keep,
        F.filter(words, lambda x: x != "").alias("_w"),
        lines.alias("_l"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    base = [*keep, "word_chars", "n_symbols"]
    b = a.select(
        *base, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("_k"),
    )
    base += ["n_words", "n_lines", "n_dup_lines"]
    # positions whose key has a neighbour with the same hash
    m, low = -(1 << _POS_BITS), (1 << _POS_BITS) - 1
    c = b.select(*base, "_w", F.expr(f"""
        case when n_words < 4 then cast(array() as array<int>)
             when n_words >= {1 << _POS_BITS} then sequence(0, cast(n_words as int) - 3)
             else transform(filter(sequence(0, size(_k) - 1), i ->
                    (i > 0 and (get(_k, i) & {m}L) = (get(_k, i - 1) & {m}L))
                    or (i + 1 < size(_k) and (get(_k, i) & {m}L) = (get(_k, i + 1) & {m}L))),
                  i -> cast(get(_k, i) & {low}L as int)) end""").alias("_c"))
    d = c.select(*base, F.expr("""
        case when size(_c) < 2 then cast(array() as array<struct<g:string,i:int>>)
             else sort_array(transform(_c, i -> struct(concat_ws(' ', get(_w, i), get(_w, i + 1), get(_w, i + 2)) as g, i as i))) end
        """).alias("_g"))
    e = d.select(*base, F.expr("""
        sort_array(transform(filter(sequence(0, size(_g) - 1), k -> size(_g) > 1 and (
            (k > 0 and get(_g, k).g = get(_g, k - 1).g)
            or (k + 1 < size(_g) and get(_g, k).g = get(_g, k + 1).g))), k -> get(_g, k).i))""").alias("_p"))
    f = e.select(*base, F.expr("""
        case when size(_p) = 0 then 0L else 3L + aggregate(sequence(1, size(_p) - 1), 0L,
            (acc, k) -> acc + case when k < 1 or k >= size(_p) then 0 else least(3, get(_p, k) - get(_p, k - 1)) end) end
        """).alias("n_repeat_words"))
    # a generator of one row: filters on the ledger stop here instead of copying all expressions below
    f = f.select(*keep, F.inline(F.array(F.struct(*MEASURES))))
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return f.select(*keep, *MEASURES, bits.alias("fail_bits"))


def apply_policy(led: DataFrame, names, rules=RULES, out: str = "kept") -> DataFrame:
    """Adds ``out``: true where no rule of the policy failed.  ``names``: a version of POLICIES or rule names."""
    names = POLICIES[names] if isinstance(names, str) else names
    mask = F.lit(mask_of(names, rules)).cast("long")
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(mask) == 0)


def ablation(led: DataFrame, names, rules=RULES) -> DataFrame:
    """One row per rule of the policy: how many documents fail it, fail it alone
    (dropping the rule would keep them), and how many the policy rejects.

    One aggregate over distinct bit patterns; at most 2^rules rows are gathered.
    """
    names = POLICIES[names] if isinstance(names, str) else tuple(names)
    mask = mask_of(names, rules)
    hit = led.select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    parts = []
    for name in names:
        bit = F.lit(mask_of([name], rules)).cast("long")
        parts.append(F.struct(
            F.lit(name).alias("rule"),
            F.when(F.col("b").bitwiseAND(bit) != 0, F.col("n")).otherwise(0).alias("failed"),
            F.when(F.col("b") == bit, F.col("n")).otherwise(0).alias("failed_alone"),
            F.when(F.col("b") != 0, F.col("n")).otherwise(0).alias("rejected"),
        ))
    return (hit.select(F.explode(F.array(*parts)).alias("r")).groupBy("r.rule")
            .agg(*[F.sum(f"r.{c}").alias(c) for c in ("failed", "failed_alone", "rejected")]))
