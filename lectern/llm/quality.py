"""Line-first quality rules (DataFrame functions only).

Each line is judged by punctuation, navigation and boilerplate rules; lines
that fail are taken out, and a document that loses too much text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE_RUN, split_words, text_of

SYMBOLS = "[#*$%&|<>]"
#: Phrases of page furniture.
BOILERPLATE = "(?i)lorem ipsum|javascript|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign up|log ?in to"
#: Window hashes keep their position in the low bits.
POS_BITS = 24


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column, max_symbols: float = 0.1, max_upper: float = 0.6) -> Column:
    """Whether a line breaks a rule. Lines without a word never fail.

    punctuation: symbols exceed ``max_symbols`` of the characters, or three
    exclamation marks per five words; navigation: three or more ``|`` or ``>``
    separators; shouting: over ``max_upper`` of at least 20 letters in upper
    case; boilerplate: a phrase of page furniture in a line of at most 200
    characters.
    """
    chars = F.length(F.regexp_replace(line, SPACE_RUN, ""))
    symbols = _count(line, SYMBOLS)
    upper, letters = _count(line, "\\p{Lu}"), _count(line, "\\p{L}")
    separators = _count(line, " [|>»] ") / 3
    words = F.length(line) - F.length(F.regexp_replace(line, "[\\x20\\x09-\\x0D]", "")) + 1
    punctuation = (symbols > max_symbols * chars) | (5 * _count(line, "!") > 3 * words) & (words >= 5)
    shouting = (letters >= 20) & (upper > max_upper * letters)
    furniture = (F.length(line) <= 200) & line.rlike(BOILERPLATE)
    return (chars > 0) & (punctuation | (separators >= 3) | shouting | furniture)


def score_documents(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """doc_id with counts, the base rules' verdict and whether the document is kept.

    ``clean_text`` holds the lines that pass; a document that loses more than
    ``max_lost`` of its non-space characters is rejected. ``n_repeat_words``
    counts words that lie in a 3-word window whose words are found twice or
    more in the text: windows are hashed with their position in the low bits,
    sorted, and neighbours of equal hash are compared word for word.

    Null and empty texts have no words and fail the base rules; every input row
    gives one output row (repeated rows repeat); other columns are not read.
    """
    text = F.col("_text")
    base = docs.select("doc_id", text_of("text").alias("_text")).select("doc_id", "_text", split_words(text).alias("_w"), F.split(text, "\n").alias("_lines"))
    w = F.col("_w")
    spots = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(spots, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POS_BITS).bitwiseOR(i.cast("long")))
    s = F.col("_s")
    same = lambda a, b: F.coalesce(F.shiftright(a, POS_BITS) == F.shiftright(b, POS_BITS), F.lit(False))
    hits = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    place = lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")
    triple = lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p"))
    t = F.col("_t")
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    found = F.filter(t, lambda x, i: equal(x, F.get(t, i - 1)) | equal(x, F.get(t, i + 1)))
    p = F.col("_p")
    covered = F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    worded = F.filter(F.col("_lines"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    good = F.filter(F.col("_lines"), lambda x: ~line_fails(x))
    bare = lambda c: F.length(F.regexp_replace(c, SPACE_RUN, ""))
    out = (
        base.withColumn("_s", F.sort_array(packed))
        .withColumn("_t", F.array_sort(F.transform(hits, lambda x: triple(place(x)))))
        .withColumn("_p", F.sort_array(F.transform(found, lambda x: x["p"])))
        .select(
            "doc_id",
            F.size("_w").cast("long").alias("n_words"),
            bare(text).cast("long").alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            F.size(worded).cast("long").alias("_n_worded"),
            F.size(F.array_distinct(worded)).cast("long").alias("_n_unlike"),
            covered.cast("long").alias("n_repeat_words"),
            F.array_join(good, "\n").alias("clean_text"),
        )
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (bare(F.col("clean_text")) >= (1 - max_lost) * F.col("word_chars"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", (F.col("_n_worded") - F.col("_n_unlike")).alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "clean_text")


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    return score_documents(docs).drop("clean_text")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{SPACE_RUN}'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d
), t AS (
  SELECT doc_id, pos, word, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), m AS (
  SELECT doc_id, pos, CASE WHEN w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w1, w2) > 1 THEN 1 ELSE 0 END AS twice FROM t
), r AS (
  SELECT doc_id, sum(c)::BIGINT AS n FROM (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM m) GROUP BY 1
), l AS (
  SELECT doc_id, line, length(line) AS n, length(regexp_replace(line, '{SPACE_RUN}', '', 'g')) AS chars, length(line) - length(regexp_replace(line, '{SYMBOLS}', '', 'g')) AS symbols,
         length(line) - length(regexp_replace(line, '\p{{Lu}}', '', 'g')) AS upper, length(line) - length(regexp_replace(line, '\p{{L}}', '', 'g')) AS letters,
         length(line) - length(regexp_replace(line, ' [|>»] ', '', 'g')) AS separators, length(line) - length(replace(line, '!', '')) AS shouts
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), j AS (
  SELECT doc_id, line, chars, chars > 0 AND (symbols > 0.1 * chars OR (5 * shouts > 3 * (n - chars + 1) AND n - chars + 1 >= 5) OR separators >= 9
         OR (letters >= 20 AND upper > 0.6 * letters) OR (n <= 200 AND regexp_matches(line, '{BOILERPLATE}'))) AS fails FROM l
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0) AS dup, coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS held FROM j GROUP BY 1
), a AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{SPACE_RUN}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
         g.dup AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, g.held AS held FROM d JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND held >= 0.5 * word_chars AS kept FROM a
"""
