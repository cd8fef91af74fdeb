"""Quality rules as a bitmask ledger, in built-in functions only.

``ledger`` evaluates every rule once on the whole text and stores the measurements and one bit per failed rule.
A policy is a named mask over those bits: ``apply_policy`` rejects a text that fails any rule of the policy, so a
new policy needs no second look at the texts. ``ablation`` tells, for each rule of a policy, how many texts fail
it and how many are rejected by it alone, from the bits alone.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. Null text has
no words and all measurements 0. Repeated rows each give a row. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"

#: Rules in bit order, over the measurements. The first two are the base.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it, and stays in memory as it is (a column of a further projection would be copied)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, spare: int = 1) -> Column:
    """Words inside 3-word windows that occur twice or more, first occurrences included.

    Each window becomes one number, the high bits of its hash with its position in as many low bits as the text's
    length needs and ``spare`` more (48 bits of hash stay at 20,000 words). Sorted, equal windows are neighbours. Those
    with such a neighbour, usually few, are sorted again by all 64 bits, and the positions of those that still have an
    equal neighbour, in order, cover 3 words each, less what the next one covers too.
    """
    joined = lambda h: F.zip_with(h, F.slice(h, 2, F.size(h)), lambda x, y: F.xxhash64(x, y))
    windows = _let(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), joined), joined), lambda h: F.slice(h, 1, F.size(h) - 2))

    def covered(windows: Column, p: Column) -> Column:
        numbered = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(-p).bitwiseOR(i.cast("long"))))
        twice = _let(numbered, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x.bitwiseXOR(y).between(F.lit(0), p - 1), F.array(x.bitwiseAND(p - 1), y.bitwiseAND(p - 1)))))
        alike = F.flatten(F.filter(twice, lambda x: x.isNotNull()))
        whole = F.sort_array(F.transform(alike, lambda i: F.struct(F.get(windows, i.cast("int")).alias("h"), i.alias("i"))))
        equal = _let(whole, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when((x["h"] == y["h"]) & (x["i"] != y["i"]), F.array(x["i"], y["i"]))))
        at = F.sort_array(F.flatten(F.filter(equal, lambda x: x.isNotNull())))
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3).cast("long"), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(words).cast("double"))) + spare).cast("long")
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows, lambda h: _let(power, lambda p: covered(h, p))))


def measurements(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", *carry: Column) -> DataFrame:
    """doc_id, the measurements that the rules use, and what carry names."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    of_words = _let(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.struct(F.when(F.get(w, F.lit(0)) == "", 0).otherwise(F.size(w)).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    of_lines = _let(F.filter(F.split(t, "\n"), lambda x: _without(x, SPACE) != ""), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    return documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(_without(t, SPACE)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        F.struct(*carry, F.lit(0).alias("_")).alias("carried"),
    ).select(*([F.col("carried")] if carry else []), "doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.again").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"))


def ledger(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", *carry: Column) -> DataFrame:
    """The measurements and failed_rules, a bit per failed rule."""
    bits = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measurements(documents, doc_id, text, *carry).withColumn("failed_rules", bits)


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with base_failed and kept under a policy; the base always rejects."""
    fails = lambda p: F.col("failed_rules").bitwiseAND(F.lit(mask(p))) != 0
    return ledger.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))


def keep_good(documents: DataFrame, policy: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns, in one pass and without a join."""
    judged = apply_policy(ledger(documents, doc_id, text, F.struct("*").alias("row")), policy)
    return judged.where("kept").select("carried.row.*")


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of the policy: texts that fail it, and those that only it rejects. One aggregation of the bits."""
    hit = F.col("failed_rules").bitwiseAND(F.lit(mask(policy)))
    names = [name for name, _ in RULES if name in POLICIES[policy]]
    bit = {name: mask_of for name, mask_of in ((n, 1 << k) for k, (n, _) in enumerate(RULES))}
    sums = ledger.agg(*(F.count_if(hit.bitwiseAND(F.lit(bit[n])) != 0).alias(f"f_{n}") for n in names), *(F.count_if(hit == F.lit(bit[n])).alias(f"o_{n}") for n in names))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names))).alias("x")).select("x.*")


#: DuckDB SQL of the query over policy v1.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1
), reps AS (
  SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM rep GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN reps USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed_rules,
  (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept
FROM f
"""
