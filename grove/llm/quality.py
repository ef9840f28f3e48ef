"""Quality rules as a ledger of failure bits (SQL functions only).

Every rule is evaluated once for a document. The ledger keeps the measurements and one failure bit a rule; policies are
named masks over those bits, so that a new policy or an ablation reads the ledger and never the texts again.

Defined results: a null text counts as empty and has no words; an empty text fails the base rule on words; repeated
rows are rated each for itself; an empty table gives an empty ledger; other columns of the input are ignored, whatever
their names; doc_id may be null and is passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import let, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, SQL over the measurements, is true. Bits are fixed for good once published."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "capitals", "2 * n_upper > word_chars"),
    Rule(6, "exclamations", "10 * n_exclaims > 3 * n_words"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(r.name for r in RULES),
}


def mask(policy: str, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policies[policy])


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur at least twice in the array w, the first ones included."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.slice(w, i + 1, width)))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, other: F.coalesce(F.get(s, k)["h"] == F.get(s, other)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: F.get(s, k)["i"]))

        total = F.aggregate(
            let(by_hash, starts),
            F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total")),
            lambda a, s: F.struct(s.alias("last"), (a["total"] + F.least(F.lit(width), s - a["last"])).alias("total")),
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total["total"])

    return F.when(n < width, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements of each text, beside the columns in keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, " \t\r\x0b\x0c") != "")
    chars = _without(text, " \t\n\x0b\x0c\r")
    base = docs.select(*keep, text.alias("__text"), words(F.col("text")).alias("__words"), lines.alias("__lines"), chars.alias("__chars"))
    size = F.length("__chars")
    return base.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        size.cast("long").alias("word_chars"),
        (size - F.length(_without(F.col("__chars"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__chars", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (size - F.length(_without(F.col("__chars"), "!"))).cast("long").alias("n_exclaims"),
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and fail_bits of each document; each rule is evaluated once."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, keep).withColumn("fail_bits", bits)


def verdict(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rated: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that stay if it is dropped.

    Works on counts by distinct failure bits, of which there are at most 2 ** len(rules), and on those bitwise only.
    """
    whole = mask(policy)
    by_bits = rated.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    mine = [r for r in rules if whole >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in mine]))
    rows = by_bits.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(
        n(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        n(F.col("bits") == F.col("bit")).alias("n_fail_alone"),
        n(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        n(F.col("bits") == 0).alias("n_kept"),
    )


def keep_good(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """The documents that a policy keeps, with all their columns: those whose verdict is joined by no shuffle."""
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("text"))
    rated = ledger(boxed, ("__row",))
    # a generator stands between the ledger and the filter, else the filter would be evaluated with all measurements in line
    once = rated.select("__row", F.explode(F.array("fail_bits")).alias("fail_bits"))
    return once.where(verdict(policy)).select("__row.*")
