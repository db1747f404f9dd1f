"""Column functions for imported question papers: labels, types, sources, answers, options, rich text."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import marker_number

#: Labels and headings of the papers.
ANSWER, PRACTICAL, NOTE = "【参考答案】", "【实战解析】", "花生批注"
PROMO = ("公考最新资料", "更新进度微信")
OPTION_LABEL = "(?:^|\\n)\\s*([A-D])(?:\\s*[.．、]|\\s+)|(?<![A-Za-z])([A-D])\\s*[.．、]"
WIDE_OPTION_LABEL = "(?:^|\\n|\\s{2,})([A-H])\\s*[.．、]"
QUESTION_START = "(?s)\\A\\s*(\\d{1,2})\\s*[.．]\\s*(.*)\\z"
ANALYSIS_START = "(?s)\\A\\s*(\\d{1,2})\\s*[.．]\\s*([（(].*)\\z"
CONTAMINATION = "花生批注|参考答案|题型分类|难度评价|实战解析|练习题\\s*\\d+\\s*套|题目整体评价|平均正确率|平均错题数|测试结果"
ARTIFACT = "(?i)(?:题目整体评价|练习题\\s*\\d(?:\\s*\\d){0,3}\\s*套|片段阅读\\s*[（(]?\\s*6\\s*0?\\s*0[^\\n]*)"
BRANDING = "(?i)四\\s*海\\s*公\\s*考|SIHAI\\s*GONG\\s*KAO|练习题\\s*\\d+\\s*套|数量关系\\s*600|资料分析\\s*600"
PLACEHOLDER = "（图形选项，见题目原图）"
CIRCLED = "[①-⑳㉑-㉟㊱-㊿]"
PAGE_NOISE = ("\\A\\s*\\z", "\\A练习题\\s*\\d+\\s*套\\s*\\z", "\\A练习题\\s*\\d+\\s*\\z", "\\A片段阅读\\s*6?0?0?\\s*[（(]?[上下]册[）)]?\\s*\\z", "\\A四海公考\\s*\\z", "(?i)\\ASIHAI\\s*GONG\\s*KAO\\s*\\z", "\\A\\d{1,3}\\s*\\z")
#: Prefixes of logic types, tried in this order, and their labels.
LOGIC_TYPES = (("一般质疑|有论据有结论的一般质疑", "一般质疑类"), ("一般支持|支持|分享类\\z", "支持类"), ("分析", "分析类"), (".*归因", "归因类"), ("前提假设|必要前提", "前提假设类"), ("解释|原因解释", "解释说明类"), ("推出", "推出类"))
#: Words in a data question's type, tried in this order, and their labels.
DATA_TYPES = (("基期", "基期"), ("增长量|增量", "增长量"), ("增长率|增速", "增长率"), ("比重", "比重"), ("平均", "平均数"), ("查找|比较|排序", "查找比较"), ("简单|计算", "简单计算"), ("倍数|比值", "比值倍数"))
#: Phrases of a stem, tried in this order, and the type they tell.
STEM_TYPES = (("重新排列", "语句排序类"), ("填入文中画横线|填入横线", "语句填入类"), ("接下来", "下文推断类"), ("说法正确|说法错误|相符的是|不相符的是", "细节判断类"))
#: Judgements that annotators put behind options.
JUDGEMENTS = "片面|无中生有|具体类|出处有误|表述有误|强加因果|区别比较联系类|中性表达"


def strip(col: Column) -> Column:
    """No white space at both ends."""
    return F.btrim(col, F.lit(" \t\r\n\u3000\u00a0"))


def _first_rule(col: Column, rules: tuple, prefix: str, otherwise: Column) -> Column:
    return reduce(lambda out, rule: out.when(col.rlike(f"{prefix}(?:{rule[0]})"), F.lit(rule[1])), rules[1:], F.when(col.rlike(f"{prefix}(?:{rules[0][0]})"), F.lit(rules[0][1]))).otherwise(otherwise)


def canonical_labels(col: Column) -> Column:
    """No blanks inside the brackets of answer, solution and type labels."""
    plain = F.regexp_replace(F.regexp_replace(col, "【\\s*参考答案\\s*】", ANSWER), "【\\s*实战解析\\s*】", PRACTICAL)
    tight = F.regexp_replace(F.regexp_replace(plain, "【\\s*(?=题型)", "【"), "(?<=【题型[^】]{0,60})\\s+】", "】")
    tight = F.regexp_replace(tight, "(?<=【题型)\\s+】", "】")
    tight = F.regexp_replace(tight, "(?<=【题[^】]{0,60}[\\u3400-\\u9fff]) +(?=[\\u3400-\\u9fff][^【】]*】)", "")
    # looking behind is dear, and most lines have no label
    return F.when(~F.contains(col, F.lit("【")), col).when(F.contains(col, F.lit("题")), tight).otherwise(plain)


def is_page_noise(line: Column) -> Column:
    """Blank lines, set and volume headings, brand lines and page numbers."""
    value = F.btrim(F.regexp_replace(F.translate(line, "\u3000\u00a0\t", "   "), " +", " "))
    return reduce(lambda a, b: a | b, [value.rlike(p) for p in PAGE_NOISE])


def cut_promotion(line: Column) -> Column:
    """What stands before the earliest promotion marker."""
    return F.get(F.split(line, "|".join(PROMO), 2), 0)


def trim_artifact(col: Column) -> Column:
    """What stands before the first page artifact."""
    return F.btrim(F.get(F.split(col, ARTIFACT, 2), 0))


def is_uncontaminated(col: Column) -> Column:
    """Not blank and without a word of the analysis."""
    return (F.trim(col) != "") & ~col.rlike(CONTAMINATION)


def logic_type(col: Column) -> Column:
    """One of seven labels by prefix, else the bare type."""
    value = F.regexp_replace(F.regexp_replace(col, "[①-㊿0-9]+", ""), "[\\s·]+", "")
    return _first_rule(value, LOGIC_TYPES, "\\A", F.when(value == "", "逻辑判断").otherwise(value))


def data_type(col: Column) -> Column:
    """The label of a data question's type by the words in it."""
    value = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "【难度评价】.*", ""), "[①-⑳]", ""), "\\s+", " "))
    return _first_rule(value, DATA_TYPES, "", F.lit("综合分析"))


def stem_type(stem: Column) -> Column:
    """The type that a stem's wording tells."""
    return _first_rule(stem, STEM_TYPES, "", F.lit("中心理解题"))


def main_type(col: Column) -> Column:
    """What stands before the first plus sign, else a default."""
    first = F.btrim(F.get(F.split(F.coalesce(col, F.lit("")), "[+＋]", 2), 0))
    return F.when(first == "", "片段阅读").otherwise(first)


def source_header(header: Column) -> Column:
    """(source, accuracy, label) of ``3．（2020国考 65%）``."""
    inner = F.coalesce(F.nullif(F.regexp_extract(header, ANALYSIS_START, 2), F.lit("")), header)
    label = F.regexp_replace(inner, "\\A[（）() ]+|[（）() ]+\\z", "")
    source = F.btrim(F.regexp_replace(label, "\\s*\\d{1,3}\\s*%\\s*\\z", ""))
    accuracy = F.regexp_extract(label, "(\\d{1,3})\\s*%", 1).try_cast("int")
    return F.struct(F.when(source == "", "片段阅读").otherwise(source).alias("source"), accuracy.alias("accuracy"), label.alias("label"))


def answer_of(text: Column, prose: Column) -> Column:
    """The answer after its label, else the one that the solution's wording tells; null if none."""
    found = [F.regexp_extract(text, f"{ANSWER}\\s*([A-Ha-h])", 1)]
    found += [F.regexp_extract(prose, p, 1) for p in ("(?:锁定|答案\\s*(?:只能)?为|对应|选择|故选)\\s*([A-H])\\s*选项", "([A-D])\\s*选项[^。；\\n]{0,40}当选")]
    return F.upper(F.coalesce(*[F.nullif(x, F.lit("")) for x in found]))


def sequence_limit(stem: Column) -> Column:
    """How many sentences a sorting stem asks to sort: the number it names, else its largest circled number."""
    named = F.regexp_extract(stem, "(?:以上|下列)\\s*(\\d+)\\s*个", 1).try_cast("int")
    return F.coalesce(named, F.array_max(F.transform(F.regexp_extract_all(stem, F.lit(f"({CIRCLED})"), F.lit(1)), marker_number)))


def clean_option(content: Column, limit: Column | None = None) -> Column:
    """Circled sequences stay (``limit`` of them at most); else trailing markers and judgements go."""
    value = F.btrim(content, F.lit(" \t\r\n"))
    marks = F.regexp_extract_all(value, F.lit(f"({CIRCLED})"), F.lit(1))
    if limit is not None:
        marks = F.slice(marks, 1, F.greatest(F.coalesce(limit, F.size(marks)), F.lit(0)))
    plain = F.btrim(F.regexp_replace(value, f"{CIRCLED}+\\z", ""))
    return F.when(value.rlike(f"\\A(?:{CIRCLED}|\\s)+\\z"), F.array_join(marks, "")).otherwise(F.regexp_replace(plain, f"\\s*[（(](?:{JUDGEMENTS})[^）)]*[）)]\\s*\\z", ""))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def option_spans(text: Column, labels: str = "ABCD", lenient: bool = False, pattern: str | None = None) -> Column:
    """(stem, options): options ``A`` then the next ``B`` and so on; labels out of order belong to the option before.

    Strict: none unless all of ``labels`` (of A to H: the first four) are found. Lenient: else the first of each label.
    Each text is searched once: what is found is named by lambda variables, since a lambda works out what it names anew.
    """
    pattern = pattern or OPTION_LABEL
    groups = 2 if pattern == OPTION_LABEL else 1
    order = F.array(*[F.lit(x) for x in labels])
    none = F.array().cast("array<int>")

    def searched(text: Column) -> Column:
        found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
        names = found[0] if groups == 1 else F.zip_with(*found, lambda a, b: F.when(a != "", a).otherwise(b))
        return F.struct(text.alias("text"), names.alias("names"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("raw"), F.split(text, pattern).alias("pieces"))

    def picked(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("want"), none.alias("picks"))

        def step(acc: Column, x: Column) -> Column:
            hit = x["name"] == F.get(order, acc["want"])
            return F.when(hit, F.struct((acc["want"] + 1).alias("want"), F.concat(acc["picks"], F.array(x["i"])).alias("picks"))).otherwise(acc)

        placed = F.transform(s["names"], lambda x, i: F.struct(x.alias("name"), i.alias("i")))
        walked = F.aggregate(placed, start, step)["picks"]
        # the first of each label, in the order of the text
        firsts = F.coalesce(F.array_sort(F.filter(F.transform(F.array_distinct(s["names"]), lambda x: F.array_position(s["names"], x).cast("int") - 1), lambda i: i >= 0)), none)
        return _with(walked, lambda w: F.when(F.size(w) >= min(4, len(labels)), w).otherwise(firsts if lenient else none))

    def spans(s: Column, picks: Column) -> Column:
        def body(low: Column, high: Column) -> Column:
            """The text from piece ``low`` up to label ``high``."""
            inner = F.zip_with(F.slice(s["raw"], low + 1, high - low), F.slice(s["pieces"], low + 2, high - low), lambda a, b: F.concat(a, b))
            return F.concat(F.get(s["pieces"], low), F.array_join(F.when(high > low, inner).otherwise(F.array().cast("array<string>")), ""))

        end = lambda k: F.coalesce(F.get(picks, k + 1), F.size(s["names"]))
        options = F.transform(picks, lambda i, k: F.struct(F.get(s["names"], i).alias("label"), strip(body(i + 1, end(k))).alias("content")))
        stem = F.when(F.size(picks) > 0, strip(body(F.lit(0), F.get(picks, 0)))).otherwise(strip(s["text"]))
        return F.struct(stem.alias("stem"), options.alias("options"))

    return _with(_with(text, searched), lambda s: _with(picked(s), lambda picks: spans(s, picks)))


def with_placeholders(options: Column, labels: str = "ABCD") -> Column:
    """(options, missing): every label, with a placeholder where it is missing or blank."""
    order = F.array(*[F.lit(x) for x in labels])

    def filled(known: Column) -> Column:
        content = lambda x: F.nullif(F.try_element_at(known, x), F.lit(""))
        full = F.transform(order, lambda x: F.struct(x.alias("label"), F.coalesce(content(x), F.lit(PLACEHOLDER)).alias("content")))
        return F.struct(full.alias("options"), F.filter(order, lambda x: content(x).isNull()).alias("missing"))

    return _with(_with(options, lambda o: F.map_from_arrays(F.transform(o, lambda x: x["label"]), F.transform(o, lambda x: x["content"]))), filled)


def section_after(text: Column, label: str, stop: str) -> Column:
    """What follows the first ``label``, up to the first match of ``stop``; empty without the label."""
    return strip(F.get(F.split(F.coalesce(F.get(F.split(text, label, 2), 1), F.lit("")), stop, 2), 0))


def added_ranges(original: Column, annotated: Column) -> Column:
    """(start, end) from 0 of the parentheses of up to 60 characters that the original lacks, blanks aside."""
    bare = F.regexp_replace(original, "\\s+", "")
    found = F.regexp_extract_all(annotated, F.lit("（[^（）\\n]{1,60}）|\\([^()\\n]{1,60}\\)"), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.call_function("locate", x, annotated, acc["at"])
        own = F.struct((at - 1).alias("start"), (at - 1 + F.length(x)).alias("end"))
        fresh = F.instr(bare, F.regexp_replace(x, "\\s+", "")) == 0
        return F.struct((at + F.length(x)).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, start, step)["out"]


def preview(col: Column, size: int) -> Column:
    """The first characters, with an ellipsis where more follows."""
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit("…"))).otherwise(col)


def user_name_error(col: Column) -> Column:
    """What is wrong with a user name, null if nothing: length 3 to 24 once trimmed, letters, digits and ``_``."""
    name = F.btrim(col)
    return F.when(name.isNull() | (F.length(name) < 3), "short").when(F.length(name) > 24, "long").when(~name.rlike("\\A[A-Za-z0-9_]+\\z"), "characters")


def same_name(a: Column, b: Column) -> Column:
    """Equal but for the case of ASCII letters."""
    fold = lambda x: F.translate(F.btrim(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(a) == fold(b)


def practice_title(names: Column, type_label: Column) -> Column:
    """The title of a practice: of one category its name and type, else a general one."""
    typed = F.when(F.coalesce(type_label, F.lit("")) != "", F.concat(F.lit(" · "), type_label)).otherwise("")
    return F.when(F.size(names) == 1, F.concat(F.get(names, 0), typed, F.lit("专项练习"))).otherwise("行测综合训练")


def image_shown(image: Column, category: Column, material: Column) -> Column:
    """An image is shown unless a data question (category 5) has its material as text."""
    return (F.coalesce(image, F.lit("")) != "") & ((category != 5) | (F.coalesce(material, F.lit("")) == ""))


# --- rich text: arrays of runs (text, bold, underline, italic)
#
# What cuts and joins runs looks them up by the offsets at which they begin and touches the text of the runs at the cut
# only; no function takes a run apart into characters. Missing flags count as false.

RUNS = "array<struct<text:string,bold:boolean,underline:boolean,italic:boolean>>"
STYLE = ("bold", "underline", "italic")
#: Characters between which blanks go, as in ``compact_text``.
CJK_MARK = "[\\u3400-\\u9fff，。；：！？、（）《》“”‘’]"


def _run(text: Column, like: Column | None = None) -> Column:
    return F.struct(text.alias("text"), *[(F.lit(False) if like is None else F.coalesce(like[c], F.lit(False))).alias(c) for c in STYLE])


def run_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def _solid(runs: Column) -> Column:
    return F.filter(runs, lambda r: F.length(r["text"]) > 0)


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)


def offsets(runs: Column, block: int = 64) -> Column:
    """The offset at which each run begins: of its block of runs, and within the block, so that few sizes are added up for each."""

    def placed(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int")), lambda b: _total(F.slice(sizes, b * block + 1, F.lit(block))))
        starts = _with(blocks, lambda x: F.transform(x, lambda _, b: _total(F.slice(x, F.lit(1), b))))
        return _with(starts, lambda x: F.transform(sizes, lambda _, i: F.get(x, F.floor(i / block).cast("int")) + _total(F.slice(sizes, i - i % block + 1, i % block))))

    return _with(F.transform(runs, lambda r: F.length(r["text"])), placed)


def merge_runs(runs: Column) -> Column:
    """Neighbours of one style become one run; empty runs go. Each run's text is copied once."""
    style = lambda r: F.struct(*[F.coalesce(r[c], F.lit(False)) for c in STYLE])

    def merged(own: Column) -> Column:
        heads = F.filter(F.transform(own, lambda r, i: F.when((i == 0) | (style(r) != style(F.get(own, i - 1))), i)), lambda i: i.isNotNull())
        part = lambda x, h, k: F.slice(own, h + 1, F.coalesce(F.get(x, k + 1), F.size(own)) - h)
        return _with(heads, lambda x: F.transform(x, lambda h, k: _run(run_text(part(x, h, k)), F.get(own, h))))

    return _with(_solid(runs), merged)


def _between(runs: Column, start: Column, end: Column) -> Column:
    """Of runs that are a lambda variable or a column, as they are named more than once."""
    def cut(at: Column) -> Column:
        last = lambda r, i: F.get(at, i) + F.length(r["text"])
        first = lambda i: F.greatest(start - F.get(at, i), F.lit(0))
        # of runs outside nothing is left
        left = lambda r, i: F.when((F.get(at, i) < end) & (last(r, i) > start), F.substring(r["text"], first(i) + 1, F.least(end, last(r, i)) - F.get(at, i) - first(i))).otherwise("")
        return F.transform(runs, lambda r, i: _run(left(r, i), r))

    return _with(offsets(runs), cut)


def slice_runs(runs: Column, start: Column, end: Column) -> Column:
    """The characters [start, end), counted from 0, with their styles."""
    return merge_runs(_with(runs, lambda own: _between(own, F.greatest(start, F.lit(0)), end)))


def insert_run(runs: Column, at: Column, new: Column) -> Column:
    """The runs with ``new`` before the character ``at`` (at the end where there are fewer)."""
    place = F.greatest(at, F.lit(0))
    return merge_runs(_with(runs, lambda own: F.concat(_between(own, F.lit(0), place), F.array(_run(new["text"], new)), _between(own, place, F.lit((1 << 31) - 1)))))


def cut_runs(runs: Column, pattern: str) -> Column:
    """The runs before the first match of a pattern, which may lie across runs; all where there is none."""
    return slice_runs(runs, F.lit(0), _with(run_text(runs), lambda t: F.length(F.get(F.split(t, pattern, 2), 0))))


def break_before_marks(runs: Column) -> Column:
    """A plain line break before each circled number that begins no line."""

    def broken(own: Column) -> Column:
        opens = lambda r, i, j: (j > 0) | ((i > 0) & r["text"].rlike(f"\\A{CIRCLED}") & (F.right(F.get(own, i - 1)["text"], F.lit(1)) != "\n"))
        parts = lambda r: F.split(r["text"], f"(?<=[^\\n])(?={CIRCLED})")
        return F.flatten(F.transform(own, lambda r, i: F.flatten(F.transform(parts(r), lambda x, j: F.when(opens(r, i, j), F.array(_run(F.lit("\n")), _run(x, r))).otherwise(F.array(_run(x, r)))))))

    return merge_runs(_with(_solid(runs), broken))


def normalize_runs(runs: Column) -> Column:
    """Blanks become spaces (no-break ones where underlined); runs of blanks and line breaks shrink to one; none between
    CJK characters or at the ends; neighbours of one style are merged."""
    lines = lambda r: F.translate(r["text"], "\r", "\n")
    blanks = lambda r, to: F.regexp_replace(lines(r), "[\\s\\u3000\\u00a0&&[^\\n]]", to)
    plain = lambda r: F.when(F.coalesce(r["underline"], F.lit(False)), blanks(r, "\u00a0")).otherwise(blanks(r, " "))
    one = _solid(F.transform(runs, lambda r: _run(F.regexp_replace(F.regexp_replace(plain(r), " +", " "), "\\n[ \\n]+", "\n"), r)))
    last = lambda x, i: F.when(i > 0, F.right(F.get(x, i - 1)["text"], F.lit(1))).otherwise("")
    first = lambda x, i: F.coalesce(F.left(F.get(x, i + 1)["text"], F.lit(1)), F.lit(""))

    def squeezed(own: Column) -> Column:
        """A run's first blanks go by what the text before ends in, which may be several runs of blanks."""
        ended = lambda acc, r: F.when(r["text"].rlike("[^ \\n]"), r["text"].rlike("\\n[ \\n]*\\z")).otherwise(acc["now"] | F.contains(r["text"], F.lit("\n")))
        start = F.struct(F.array().cast("array<boolean>").alias("before"), F.lit(False).alias("now"))
        broken = F.aggregate(own, start, lambda acc, r: F.struct(F.concat(acc["before"], F.array(acc["now"])).alias("before"), ended(acc, r).alias("now")))["before"]
        kept = lambda b, r, i: F.when(F.get(b, i), F.regexp_replace(r["text"], "\\A[ \\n]+", "")).when(last(own, i).isin(" ", "\n"), F.regexp_replace(r["text"], "\\A +", "")).otherwise(r["text"])
        return _solid(_with(broken, lambda b: F.transform(own, lambda r, i: _run(kept(b, r, i), r))))

    def closed(own: Column) -> Column:
        """Without blanks between CJK characters, told with the neighbours' characters beside each run's text."""
        seen = lambda r, i: F.regexp_replace(F.concat(last(own, i), r["text"], first(own, i)), f"(?<={CJK_MARK}) (?={CJK_MARK})", "")
        inner = lambda r, i: F.substring(seen(r, i), F.length(last(own, i)) + 1, F.length(seen(r, i)) - F.length(last(own, i)) - F.length(first(own, i)))
        return _solid(F.transform(own, lambda r, i: _run(inner(r, i), r)))

    def trimmed(own: Column) -> Column:
        solid = F.filter(F.transform(own, lambda r, i: F.when(r["text"].rlike("[^ \\n]"), i)), lambda i: i.isNotNull())
        ends = F.struct(F.array_min(solid).alias("low"), F.array_max(solid).alias("high"))
        head = lambda e, r, i: F.when(i == e["low"], F.regexp_replace(r["text"], "\\A[ \\n]+", "")).otherwise(r["text"])
        tail = lambda e, r, i: F.when(i == e["high"], F.regexp_replace(head(e, r, i), "[ \\n]+\\z", "")).otherwise(head(e, r, i))
        return _with(ends, lambda e: F.transform(own, lambda r, i: _run(F.when(i.between(e["low"], e["high"]), tail(e, r, i)).otherwise(""), r)))

    return merge_runs(_with(_with(_with(one, squeezed), closed), trimmed))


def fill_blanks(runs: Column) -> Column:
    """The stem's text, each underlined run of blanks as ten underscores."""
    return F.array_join(F.transform(runs, lambda r: F.when(r["underline"] & r["text"].rlike("\\A[\\s\\u00a0_]+\\z"), "__________").otherwise(F.replace(r["text"], F.lit("\u00a0"), F.lit(" ")))), "")


def json_text(col: Column) -> Column:
    """JSON text with escapes of control characters in lower case, as most writers have them.

    Escaped backslashes stand aside as a raw control character meanwhile, which JSON text never holds, so that each
    backslash left begins an escape: whole replacements then take one pass each, without looking behind.
    """
    aside, pair = F.lit("\x01"), F.lit("\\\\")
    out = F.replace(col, pair, aside)
    for high in "01":
        for c in "ABCDEF":
            out = F.replace(out, F.lit(f"\\u00{high}{c}"), F.lit(f"\\u00{high}{c.lower()}"))
    return F.replace(out, aside, pair)


def import_key(stem: Column, options: Column, source: Column) -> Column:
    """SHA-256 of the JSON list of stem, options and source."""
    parts = [F.to_json(F.array(stem)), F.to_json(options), F.to_json(F.array(source))]
    bare = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    return F.sha2(json_text(F.concat(F.lit("["), bare(parts[0]), F.lit(","), parts[1], F.lit(","), bare(parts[2]), F.lit("]"))), 256)
