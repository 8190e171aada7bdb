"""Line-first cleaning (native: DataFrame functions only).

Each line of a text is judged by punctuation, navigation, symbol, shouting and boilerplate
rules; failing lines go, and a document that loses too large a share of its words is rejected.

Defined cases: a null text counts as empty; an empty text has no words, fails the base rule and
is rejected; repeated rows and repeated or null ids are judged row by row; other columns are
ignored by ``measure`` and ``clean`` keeps only what it is asked to keep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import SPACES, let, text_or_empty

# Phrases that mark a short line as page furniture.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie",
    "enable javascript",
    "log in",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "sign up",
    "subscribe",
    "terms of service",
    "terms of use",
)
# Characters after which a line counts as ended.
TERMINALS = ".!?…:;\"'”’»)]。！？"


@dataclass(frozen=True)
class LineRules:
    short_words: int = 4  # a line of at most so many words without an end mark is navigation
    boilerplate_words: int = 25  # boilerplate phrases count only in lines up to this length
    symbols_per_word: float = 0.3  # more of #*$%&|<> a word than this is junk
    shout_words: int = 5  # lines of at least so many words all in capitals are shouting
    min_kept_percent: int = 50  # a document must keep this share of its words
    min_words: int = 50
    max_repeat_percent: int = 50


def _covered(starts: Column) -> Column:
    """Words that the 3-word windows at these ascending starts cover."""
    gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)


def _twice(sorted_hashes: Column) -> Column:
    """The values that a sorted array holds more than once."""
    after = F.slice(sorted_hashes, F.lit(2), F.size(sorted_hashes))
    return F.array_distinct(F.array_compact(F.zip_with(sorted_hashes, after, lambda a, b: F.when(a == b, a))))


def _by_sorting(hashes: Column) -> Column:
    """Starts of repeated windows where many differ: sort (hash, start) and compare neighbours."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        return let(
            same,
            lambda e: F.zip_with(
                s,
                F.zip_with(e, F.concat(F.array(F.lit(False)), F.slice(e, F.lit(1), F.size(e) - 1)), lambda x, y: x | y),
                lambda w, t: F.when(t, w["i"]),
            ),
        )

    return F.sort_array(F.array_compact(let(pairs, starts)))


def _by_lookup(hashes: Column, twice: Column) -> Column:
    """The same where few windows repeat: look each hash up among them."""
    return F.array_compact(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)))


def _repeated(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the hashes of all windows in order."""

    def several(twice: Column) -> Column:
        return F.when(F.size(twice) <= 32, let(_by_lookup(hashes, twice), _covered)).otherwise(let(_by_sorting(hashes), _covered))

    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0)).otherwise(let(let(F.sort_array(hashes), _twice), several)).cast("long")


def _line_fails(line: Column, n: Column, symbols: Column, rules: LineRules) -> Column:
    """Whether a line of n > 0 words goes; cheap rules first, each only where it can apply."""
    navigation = (n <= rules.short_words) & ~F.lit(TERMINALS).contains(F.substring(F.rtrim(line), -1, 1))
    shouting = (n >= rules.shout_words) & (line == F.upper(line)) & (line != F.lower(line))
    phrase = let(F.lower(line), lambda low: F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: low.contains(p)))
    return (symbols > n * F.lit(rules.symbols_per_word)) | navigation | shouting | ((n <= rules.boilerplate_words) & phrase)


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs``: base figures, words kept by the line rules, and the verdict."""

    def judged(line: Column) -> Column:
        return let(
            F.struct(F.array_remove(F.split(line, SPACES), "").alias("words"), _symbols(line).alias("s")),
            lambda x: F.struct(
                line.alias("line"),
                x["words"].alias("words"),
                x["s"].alias("symbols"),
                ((F.size(x["words"]) > 0) & _line_fails(line, F.size(x["words"]), x["s"], rules)).alias("fails"),
            ),
        )

    lines = F.filter(F.transform(F.split(text_or_empty(text_col), "\n"), judged), lambda x: F.size(x["words"]) > 0)
    split = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    kept = F.aggregate(F.col("lines"), F.lit(0), lambda acc, x: acc + F.when(x["fails"], F.lit(0)).otherwise(F.size(x["words"])))
    wide = split.select(
        "doc_id",
        F.flatten(F.col("lines.words")).alias("words"),
        kept.cast("long").alias("kept_words"),
        F.aggregate(F.col("lines.symbols"), F.lit(0), lambda acc, s: acc + s).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.col("lines.line")))).cast("long").alias("n_dup_lines"),
    )
    third = F.transform(F.col("words"), lambda x, i: F.xxhash64(x, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    hashed = wide.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "kept_words",
        F.slice(third, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    verdict = 100 * F.col("kept_words") >= rules.min_kept_percent * F.col("n_words")
    return (
        hashed.withColumn("n_repeat_words", F.when(F.size("windows") > 1, let(F.col("windows"), _repeated)).otherwise(F.lit(0)).cast("long"))
        .drop("windows")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & verdict)
    )


def clean(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with failing lines removed from the text (blank lines stay); every row is returned."""
    ok = F.filter(
        F.split(text_or_empty(text_col), "\n"),
        lambda x: let(
            F.size(F.array_remove(F.split(x, SPACES), "")), lambda n: (n == 0) | ~_line_fails(x, n, _symbols(x), rules)
        ),
    )
    return docs.withColumn(text_col, F.array_join(ok, "\n"))


#: DuckDB form of ``measure``.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM p),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) t(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, line, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM l),
judged AS (
  SELECT r, line, n,
    (n <= 4 AND NOT contains('%(terminals)s', right(rtrim(line, ' '), 1)))
    OR length(line) - length(translate(line, '#*$%%&|<>', '')) > n * 0.3
    OR (n >= 5 AND line = upper(line) AND line <> lower(line))
    OR (n <= 25 AND (%(phrases)s)) AS fails
  FROM ln WHERE n > 0),
agg AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE n END) AS kept_words FROM judged GROUP BY r),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(kept_words, 0)::BIGINT AS kept_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN agg USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_words >= 50 * n_words) AS kept
FROM f
""" % {
    "terminals": TERMINALS.replace("'", "''"),
    "phrases": " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE),
}
