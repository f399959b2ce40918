"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each rule that
failed; a policy is a versioned mask over those bits, so that a change of policy, and the ablation of a policy,
read the ledger and never the texts. All of it is built-in column functions: one narrow pass, no shuffle.

Defined results: a null text counts as empty (0 words, fails the length rule); doc_id is carried as it is, null or
repeated; extra columns are ignored by ledger() and kept by filter_documents(); an empty table gives an empty ledger.
Words in repeated windows are found by a hash of each 3-word window: in texts of up to PACKED words with as many bits as
the text's length leaves of 64 (53 or more), in longer ones with 128 bits, so two different windows of a text are taken
for the same with a chance of less than 1e-9 at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the longest text whose windows' hashes and positions are packed in longs.
PACKED = 2047
SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Rule name -> (bit, failing condition on the measurements). Bits are never reused: old ledgers stay readable.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "4 * n_symbols > n_words"),
    "repeated_lines": (3, "2 * n_dup_lines > n_lines"),
    "word_length": (4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "exclamations": (5, "3 * n_exclaims > n_words"),
}
#: Policy version -> rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "exclamations"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: inside lambdas Catalyst shares no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort (hash, position) packed in a long, keep neighbours
    with equal hashes, then add up the words that each kept window adds to those before it."""
    n = F.size(w)
    bits = F.length(F.bin(n))  # enough for a position
    windows = F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0)))
    packed = F.transform(
        windows,
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    wide = F.transform(
        windows,
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.xxhash64(F.get(w, i + 2), F.lit(1), F.get(w, i + 1), x).alias("g"), i.cast("long").alias("i")),
    )
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(same, place):
        def of(s: Column) -> Column:
            hit = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
            return let(F.sort_array(F.transform(hit, place)), covered)

        return of

    short = repeated(lambda a, b: F.call_function("shiftrightunsigned", a.bitwiseXOR(b), bits) == 0, lambda x: x.bitwiseAND(mask))
    long = repeated(lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"]), lambda x: x["i"])
    return F.when(n < 4, F.lit(0).cast("long")).when(n <= PACKED, let(F.sort_array(packed), short)).otherwise(let(F.sort_array(wide), long))


def measures(text: Column) -> Column:
    """A struct of MEASURES for a text."""

    def of(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(BLANKS))
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        long = lambda c, name: c.cast("long").alias(name)
        return let(
            F.struct(words.alias("w"), lines.alias("l")),
            lambda s: F.struct(
                long(F.size(s["w"]), "n_words"),
                long(F.length(F.array_join(s["w"], "")), "word_chars"),
                long(F.regexp_count(t, F.lit("[#*$%&|<>]")), "n_symbols"),
                long(F.size(s["l"]) - F.size(F.array_distinct(s["l"])), "n_dup_lines"),
                long(let(s["w"], _repeat_words), "n_repeat_words"),
                long(F.size(s["l"]), "n_lines"),
                long(F.regexp_count(t, F.lit("!")), "n_exclaims"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def failed_bits(rules: dict[str, tuple[int, str]] = RULES) -> Column:
    """One bit for each rule whose condition holds for the measurements."""
    bits = F.lit(0).cast("long")
    for bit, condition in rules.values():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def mask(policy: str, rules=RULES, policies=POLICIES) -> int:
    return sum(1 << rules[name][0] for name in policies[policy])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules=RULES) -> DataFrame:
    """keep, the measurements and failed (bits of the rules that failed), a row for each row of docs."""
    # inline() is a barrier: filters and projections on its columns don't repeat the measuring
    return docs.select(*keep, F.inline(F.array(measures(F.col("text"))))).withColumn("failed", failed_bits(rules))


def passes(policy: str, rules=RULES, policies=POLICIES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules, policies)).cast("long")) == 0


def ablation(led: DataFrame, policy: str, rules=RULES, policies=POLICIES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (kept again without it), and that the
    policy without it keeps. One aggregation over the ledger; one row for each rule."""
    m = mask(policy, rules, policies)
    hit = F.col("failed").bitwiseAND(F.lit(m).cast("long"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    parts = [F.struct(F.lit(r).alias("rule"), one(hit.bitwiseAND(F.lit(1 << rules[r][0]).cast("long")) != 0).alias("fails"), one(hit == (1 << rules[r][0])).alias("fails_alone"), one((hit == 0) | (hit == (1 << rules[r][0]))).alias("kept_without")) for r in policies[policy]]
    cols = [p.alias(f"r{i}") for i, p in enumerate(parts)]
    return led.agg(*cols).select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(parts))])))


def filter_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns."""
    own = [c for c in docs.columns]
    packed = docs.select(F.struct(*[docs[c] for c in own]).alias("_doc"), docs["text"].alias("text"))
    return ledger(packed, keep=("_doc",)).filter(passes(policy)).select(*[F.col("_doc")[c].alias(c) for c in own])
