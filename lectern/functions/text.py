"""Column functions on text: normalising, cutting, labelling and extracting.

All stay inside Spark's expressions. Patterns end in ``\\z`` rather than ``$``,
which in Spark also matches before a final line break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a raw type contains and the label it gets, tried in this order.
TYPE_LABELS = {
    "中心理解": "中心理解题",
    "语句填入": "语句填入类",
    "语句排序": "语句排序类",
    "下文推断": "下文推断类",
    "细节判断": "细节判断类",
    "标题": "标题拟定类",
    "词句理解": "词句理解题",
    "观点态度": "观点态度题",
    "上文推断": "上文推断类",
}
DEFAULT_TYPE = "片段阅读"


def normalize_space(col: Column) -> Column:
    """Ideographic, no-break and other blanks (carriage returns, tabs, form feeds) become spaces; runs collapse; no blanks
    around line breaks or at the ends."""
    plain = F.regexp_replace(col, "[ \\t\\r\\f\\x0B\\u3000\\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, " ?\\n ?", "\n"), "\\A[ \\n]+|[ \\n]+\\z", "")


def compact_text(col: Column) -> Column:
    """Blanks between two CJK characters or marks go, and those before and inside option words (``A 选项``)."""
    cjk = "[\\u3400-\\u9fff，。；：！？、（）《》“”‘’]"
    out = F.regexp_replace(normalize_space(col), f"(?<={cjk}) +(?={cjk})", "")
    out = F.regexp_replace(out, "(?<=[\\u3400-\\u9fff]) +(?=[A-D](?:选项|项))", "")
    return F.btrim(F.regexp_replace(out, "(?<=[A-D]) +(?=(?:选项|项))", ""))


def bare(col: Column) -> Column:
    """Only digits, ASCII letters and CJK characters."""
    return F.regexp_replace(col, "[^0-9A-Za-z\\u3400-\\u9fff]", "")


def match_key(col: Column) -> Column:
    """The same, lower-cased."""
    return F.lower(bare(col))


def label_spacing(col: Column) -> Column:
    """No blanks just inside square lenticular brackets."""
    return F.regexp_replace(F.regexp_replace(col, "【\\s+", "【"), "\\s+】", "】")


def cut_at(col: Column, pattern: str) -> Column:
    """What stands before the first match, without blanks at its ends."""
    return F.btrim(F.get(F.split(col, pattern, 2), 0))


def clean_type(col: Column) -> Column:
    """The clean label of a raw question type.

    Trailing circled and plain numbers go (the class spans U+2460 to U+32BF, so
    it takes ``。`` and brackets too); the first known label inside wins.
    """
    bare = F.btrim(F.regexp_replace(F.btrim(F.coalesce(col, F.lit(""))), "[\\u2460-\\u32bf0-9]+\\z", ""))
    out = F.when(bare == "", F.lit(DEFAULT_TYPE))
    for part, label in TYPE_LABELS.items():
        out = out.when(F.contains(bare, F.lit(part)), F.lit(label))
    return out.otherwise(bare)


def bucket_by_keyword(col: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first keyword that the text contains."""
    out = None
    for word, label in rules:
        hit = F.contains(col, F.lit(word))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def percent_in(col: Column) -> Column:
    """The first whole number of one to three digits before a percent sign, null if none."""
    return F.regexp_extract(col, "([0-9]{1,3})%", 1).try_cast("int")


def first_of(col: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col, p, 1), F.lit("")) for p in patterns])


def marker_number(col: Column) -> Column:
    """Circled numbers and digits as one number: the last digits of each, put together."""
    code = F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.when((c >= "①") & (c <= "⑳"), F.ascii(c) - 9311).when((c >= "㉑") & (c <= "㉟"), F.ascii(c) - 12860).when((c >= "㊱") & (c <= "㊿"), F.ascii(c) - 12941).otherwise(c.try_cast("int")))
    whole = F.filter(code, lambda x: x.isNotNull())
    single = F.when(F.size(whole) == 1, F.get(whole, 0))
    return F.coalesce(single, F.array_join(F.transform(whole, lambda x: (x % 10).cast("string")), "").try_cast("int"))


def mmss(seconds: Column) -> Column:
    """Minutes and seconds, two digits each at least; negative counts as zero."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    minutes = F.floor(s / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.concat(F.lit("0"), minutes)).otherwise(minutes), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def round_half_up(col: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(col + F.lit(0.5)).cast("long")


def round_half_even(col: Column, digits: int = 0) -> Column:
    """Rounded by the decimal digits of the double, halves to even."""
    return F.bround(col.cast("double"), digits)


def outcome(selected: Column, answer: Column) -> Column:
    """correct, unanswered or wrong."""
    return F.when(selected == answer, "correct").when(selected.isNull() | (selected == ""), "unanswered").otherwise("wrong")


def difficulty(accuracy: Column) -> Column:
    """Basic from 70 or unknown, advanced from 45, hard below."""
    return F.when(accuracy.isNull() | (accuracy >= 70), "基础").when(accuracy >= 45, "进阶").otherwise("挑战")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "middle").otherwise("low")


def added_parentheticals(original: Column, annotated: Column) -> Column:
    """Parentheses of up to 60 characters in the annotated text that the original lacks, blanks aside."""
    bare = F.regexp_replace(original, "\\s", "")
    found = F.regexp_extract_all(annotated, F.lit("[（(][^（）()]{1,60}[）)]"), F.lit(0))
    return F.filter(found, lambda x: F.instr(bare, F.regexp_replace(x, "\\s", "")) == 0)


def decode_ids(col: Column, most: int = 100) -> Column:
    """Numbers of a comma list: blanks, non-numbers and zero go, repeats go, at most ``most`` stay."""
    numbers = F.transform(F.split(col, ","), lambda x: F.btrim(x).try_cast("long"))
    return F.slice(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x != 0))), 1, most)


def or_else(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def json_put(doc: Column, values: dict[str, Column]) -> Column:
    """A JSON object with some keys set to JSON texts, in place where it has them; a null document counts as empty."""
    old = F.from_json(F.coalesce(doc, F.lit("{}")), "map<string,variant>")
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.parse_json(v))])
    replaced = F.transform_values(old, lambda k, v: F.coalesce(F.try_element_at(new, k), v))
    return F.to_json(F.map_concat(replaced, F.map_filter(new, lambda k, v: ~F.array_contains(F.map_keys(old), k))))
