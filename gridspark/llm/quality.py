r"""Quality rules as a bitmask ledger, all in DataFrame functions.

Every rule is evaluated once a text; the ledger stores its measurements and one
failure bit a rule. A policy is a versioned mask over those bits, so a new
policy or an ablation is bit arithmetic on the ledger and reads no text again.

Words are ``[^\x20\x09-\x0D]+``. Windows of five words are compared by their
64-bit hash first: a text whose hashes all differ has no repeated window.
Where two hashes agree the words themselves are sorted and compared, so the
counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Rule bit → (name, failure test over the measurements). Integers only, so any engine agrees.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Versioned policies: the rules that reject.
POLICIES = {1: BASE, 2: BASE | BITS["symbols"] | BITS["duplicate_lines"], 3: sum(BITS.values())}
CURRENT = 3

BLANK = r"[\\x20\\x09-\\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each text, null as empty."""
    split = texts(df, id_col, text_col).selectExpr(
        "doc_id",
        "text",
        f"array_remove(split(text, '{BLANK}'), '') as words",
        r"filter(split(text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]') as lines",
    )
    counted = split.selectExpr(
        "doc_id",
        "words",
        "size(words) as n",
        "cast(char_length(array_join(words, '')) as long) as word_chars",
        "cast(regexp_count(text, '[#*$%&|<>]') as long) as n_symbols",
        "cast(size(lines) as long) as n_lines",
        "cast(size(lines) - size(array_distinct(lines)) as long) as n_dup_lines",
    )
    hashed = counted.withColumn("hashes", F.expr("case when n > 5 then transform(sequence(0, n - 5), i -> xxhash64(slice(words, i + 1, 5))) end"))
    alike = hashed.withColumn("alike", F.expr("n > 5 and size(hashes) > size(array_distinct(hashes))")).drop("hashes")
    windows = alike.withColumn("w", F.expr("case when alike then array_sort(transform(sequence(0, n - 5), i -> struct(slice(words, i + 1, 5) as x, i as p))) end")).drop("words")
    repeated = windows.withColumn("at", F.expr("array_sort(transform(filter(w, (v, k) -> v.x = get(w, k - 1).x or v.x = get(w, k + 1).x), v -> v.p))")).drop("w")
    covered = "coalesce(aggregate(at, struct(0 as c, -5 as last), (a, p) -> struct(a.c + least(5, p - a.last) as c, p as last), a -> a.c), 0)"
    return repeated.selectExpr("doc_id", "cast(n as long) as n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", f"cast({covered} as long) as n_repeat_words")


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits``, bit k for rule k of ``RULES``.

    A null or empty text has no words, so only ``few_words`` fails. Repeated
    rows each get their row; an empty table gives none; other columns are
    ignored.
    """
    bits = " + ".join(f"(case when {test} then {1 << k} else 0 end)" for k, (_, test) in enumerate(RULES))
    return measured(df, id_col, text_col).withColumn("fail_bits", F.expr(f"cast({bits} as long)"))


def with_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """``policy`` and ``kept`` from the stored bits alone."""
    mask = POLICIES[version]
    return book.withColumn("policy", F.lit(version)).withColumn("kept", F.expr(f"fail_bits & {mask} = 0"))


def ablation(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """One row a rule of the policy: rows that fail it, rows that only it rejects, rows kept without it.

    The ledger is first reduced to one count for each combination of bits, at
    most 2 to the number of rules.
    """
    mask = POLICIES[version]
    combos = book.groupBy(F.expr(f"fail_bits & {mask}").alias("bits")).agg(F.count("*").alias("n"))
    rules = ", ".join(f"struct('{name}' as rule, {bit}L as bit)" for name, bit in BITS.items() if bit & mask)
    return (
        combos.selectExpr("bits", "n", f"inline(array({rules}))")
        .groupBy("rule")
        .agg(
            F.expr("sum(case when bits & bit <> 0 then n else 0 end)").alias("n_failed"),
            F.expr("sum(case when bits = bit then n else 0 end)").alias("n_only"),
            F.expr("sum(case when bits & ~bit = 0 then n else 0 end)").alias("n_kept_without"),
            F.expr(f"bit_or(bits)").alias("seen_bits"),
        )
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
key AS (SELECT doc_id, p, words[p:p + 4] AS x FROM win),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS c FROM key) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, p - before)) AS r FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), p - 5) AS before FROM hit) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, CAST({" + ".join(f"(CASE WHEN {test} THEN {1 << k} ELSE 0 END)" for k, (_, test) in enumerate(RULES))} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits, {CURRENT} AS policy,
       fail_bits & {BASE} <> 0 AS base_failed, fail_bits & {POLICIES[CURRENT]} = 0 AS kept
FROM b
"""
