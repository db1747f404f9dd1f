"""Question papers as ordered lines: chunks, sections, anchors, notes and how they find their question.

Lines come as (doc, pos, line). All windows are partitioned by document; what
needs a fold over a document's own list is a pass over its sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions import imported as im
from lectern.functions.text import bare, compact_text, marker_number
from lectern.operators.segment import long_running_id, running_id, within


def numbered_chunks(lines: DataFrame, doc: str = "doc", pattern: str = im.QUESTION_START, most: int = 20) -> DataFrame:
    """(doc, chunk, number, first_pos, n, body): a line that begins with a number of 1 to ``most`` opens a chunk; what
    stands before the first one goes. The body has the chunk's lines, noise left out, joined by line breaks."""
    number = F.regexp_extract("line", pattern, 1).try_cast("int")
    opened = lines.withColumn("number", F.when(number.between(1, most), number))
    chunks = running_id(opened, [doc], ["pos"], F.col("number").isNotNull(), "chunk").where("chunk > 0")
    kept = F.when(~im.is_page_noise(F.col("line")), F.struct("pos", im.cut_promotion(F.col("line")).alias("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n")
    return chunks.groupBy(doc, "chunk").agg(F.max("number").alias("number"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), body.alias("body"))


def sequence_report(chunks: DataFrame, doc: str = "doc", size: int = 20) -> DataFrame:
    """(doc, n, off, ragged): chunks whose number is not the next one of their set, and whether sets are incomplete."""
    expected = (F.col("chunk") - 1) % size + 1
    return chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("number") != expected).alias("off")).withColumn("ragged", F.col("n") % size != 0)


def titled_slots(titles: DataFrame, doc: str = "doc", size: int = 20, near: int = 2) -> DataFrame:
    """(doc, pos, number, section, slot): titles by (pos, number); one that repeats the number of the title kept before it
    within ``near`` lines goes; a number that does not rise opens a section of ``size`` slots."""
    titles = titles.select(doc, "pos", "number")
    schema = T.StructType([*titles.schema.fields, T.StructField("section", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the rows in order; what goes on from one to the next is the title kept last."""
        known, begun, last_pos, last, held = None, False, None, 0, 0
        for batch in batches:
            kept, sections = [], []
            for row, (name, pos, number) in enumerate(zip(*(batch[c].to_pylist() for c in (doc, "pos", "number")))):
                if not begun or name != known:
                    known, begun, last_pos, last, held = name, True, None, None, 0
                elif None not in (number, pos, last_pos) and number == last and pos - last_pos <= near:
                    continue
                section = None if number is None else held + (number <= (last or 0))
                last_pos, last, held = pos, number, section or 0
                kept.append(row)
                sections.append(section)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sections, pa.int32())], names=schema.names)

    ordered = titles.repartition(doc).sortWithinPartitions(doc, "pos", "number")
    return ordered.mapInArrow(run, schema).withColumn("slot", F.col("section") * size + F.col("number") - 1)


def _by_answer(lines: DataFrame, doc: str, answer: str, size: int) -> DataFrame:
    """Lines with the number (from 0) of the answer at or after them, and where its question begins and how that was found."""
    flagged = lines.withColumn("is_answer", F.contains("line", F.lit(answer)))
    # lines belong to the next answer at or after them
    ahead = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = flagged.withColumn("nth", F.coalesce(F.sum(F.col("is_answer").cast("int")).over(ahead), F.lit(0)))
    expected = (F.col("nth") % size + 1).cast("string")
    own = Window.partitionBy(doc, "nth")
    at = lambda hit: F.max(F.when(hit, F.col("pos"))).over(own)
    strict = F.regexp_extract("line", "\\A\\s*(\\d{1,3})\\s*[.．、]", 1) == expected
    loose = F.array_contains(F.regexp_extract_all("line", F.lit("(?<!\\d)(\\d{1,3})\\s*[.．、]"), F.lit(1)), expected)
    some = F.col("line").rlike("(?<!\\d)\\d{1,3}\\s*[.]")
    # the lines of one answer are in one partition already, so these maxima need no further shuffle
    found = numbered.withColumns({"answer_pos": at(F.col("is_answer")), "_a": at(strict), "_b": at(loose), "_c": at(some), "_d": F.min("pos").over(own)}).where("answer_pos is not null")
    how = F.when(F.col("_a").isNotNull(), "strict").when(F.col("_b").isNotNull(), "loose").when(F.col("_c").isNotNull(), "any").otherwise("after")
    return found.withColumns({"start": F.coalesce("_a", "_b", "_c", "_d"), "how": how}).drop("_a", "_b", "_c", "_d")


def question_starts(lines: DataFrame, doc: str = "doc", answer: str = im.ANSWER, size: int = 20) -> DataFrame:
    """(doc, nth, answer_pos, start, how) of every answer line: where its question begins, after the answer before.

    The last line with the expected number at its start (``strict``), else anywhere in it (``loose``), else with any
    number (``any``), else the line after the answer before (``after``).
    """
    return _by_answer(lines, doc, answer, size).where("is_answer").select(doc, "nth", "answer_pos", "start", "how")


def anchored_records(lines: DataFrame, doc: str = "doc", size: int = 20) -> DataFrame:
    """(doc, nth, how, stem, options, missing, answer) of every answer line, from the lines of its question.

    Each line knows its answer, so lines aren't joined with answers: those before the question's start just go.
    """
    own = _by_answer(lines, doc, im.ANSWER, size).where("pos >= start")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    text = own.groupBy(doc, "nth", "how").agg(body.alias("body"))
    question = F.regexp_replace(F.get(F.split("body", im.ANSWER, 2), 0), "\\A\\s*\\d{1,3}\\s*[.．、]\\s*", "")
    parsed = text.withColumn("parsed", im.option_spans(question)).withColumn("filled", im.with_placeholders(F.col("parsed.options")))
    return parsed.select(doc, "nth", "how", F.col("parsed.stem").alias("stem"), F.col("filled.options").alias("options"), F.col("filled.missing").alias("missing"), im.answer_of(F.col("body"), F.lit("")).alias("answer"))


def duplicate_answers(lines: DataFrame, doc: str = "doc", promo: str = "|".join(im.PROMO)) -> DataFrame:
    """Lines without repeats of their neighbour, promotion and blanks aside; of equal neighbours the first without promotion stays."""
    key = F.regexp_replace(F.regexp_replace("line", f"(?:{promo})\\S*", ""), "\\s+", "")
    w = Window.partitionBy(doc).orderBy("pos")
    keyed = lines.withColumn("_key", key).withColumn("_new", ~F.col("_key").eqNullSafe(F.lag("_key").over(w)) | (F.row_number().over(w) == 1))
    grouped = running_id(keyed, [doc], ["pos"], F.col("_new"), "_run")
    best = Window.partitionBy(doc, "_run").orderBy(F.col("line").rlike(promo), "pos")
    return grouped.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_key", "_new", "_run", "_rn")


def materials_before(lines: DataFrame, stop: str, border: str, doc: str = "doc", most: int = 80, least: int = 20) -> DataFrame:
    """(doc, stop_pos, material): up to ``most`` lines before a stop line, backwards to a border once something is found;
    repeated lines go; materials shorter than ``least`` characters go."""
    flagged = lines.withColumns({"_stop": F.col("line").rlike(stop), "_border": F.col("line").rlike(border) | F.col("line").rlike(stop)})
    stops = flagged.where("_stop").select(doc, F.col("pos").alias("stop_pos"), (F.col("pos") - most).alias("_low"), (F.col("pos") - 1).alias("_high"))
    below = within(flagged.where(F.trim("line") != ""), stops, doc, "_low", "_high", most)
    near = Window.partitionBy(doc, "stop_pos")
    last = below.withColumn("_last", F.max(F.when(~F.col("_border"), F.col("pos"))).over(near))
    border_at = F.max(F.when(F.col("_border") & (F.col("pos") < F.col("_last")), F.col("pos"))).over(near)
    parts = last.withColumn("_from", border_at).where("not _border and pos <= _last and (_from is null or pos > _from)")
    # of repeated lines the last stays: the walk goes backwards
    text = parts.groupBy(doc, "stop_pos", compact_text(F.col("line")).alias("line")).agg(F.max("pos").alias("pos"))
    joined = text.groupBy(doc, "stop_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("material"))
    return joined.where(F.length("material") >= least)


def lines_before_options(lines: DataFrame, by: list[str], first: str = "\\A\\s*A\\s*[.．、]") -> DataFrame:
    """The lines of each question before its first option line; all where there is none."""
    at = F.min(F.when(F.col("line").rlike(first), F.col("pos"))).over(Window.partitionBy(*by))
    return lines.withColumn("_first", at).where("_first is null or pos < _first").drop("_first")


def practical_after(lines: DataFrame, probes: DataFrame, key: str, doc: str = "doc", reach: int = 90, longest: int = 50, sizes: tuple[int, ...] = (32, 24, 18), least: int = 12) -> DataFrame:
    """(key, doc, explanation): for each probe (key, doc, stem) the solution after the line that holds its first characters.

    Of match keys the first 32, 24 or 18 characters (at least ``least``) must lie in a line; the solution is the first
    labelled line within ``reach`` lines, up to the next number, label or note and ``longest`` lines. The longest wins.
    Positions are unique in a document.
    """
    text = lines.withColumn("_k", bare(F.col("line")))
    stem = bare(F.col("stem"))
    tries = probes.select(key, doc, F.explode(F.array_distinct(F.array(*[F.substring(stem, 1, n) for n in sizes]))).alias("probe")).where(F.length("probe") >= least)
    # lines and probes of a document meet on the probe's first characters; shorter lines hold no probe. All joins here are
    # sorted: what is unfolded from a small file is many times what the planner takes it for, too much for a broadcast
    head = F.substring("probe", 1, least)
    grams = F.transform(F.sequence(F.lit(1), F.length("_k") - least + 1), lambda i: F.substring(F.col("_k"), i, F.lit(least)))
    spread = text.where(F.length("_k") >= least).select(doc, "pos", "_k", F.explode(F.array_distinct(grams)).alias("_g"))
    found = tries.withColumn("_g", head).join(spread.hint("merge"), [doc, "_g"]).where(F.contains("_k", F.col("probe"))).select(key, doc, F.col("pos").alias("at")).distinct()
    labelled = F.contains("line", F.lit(im.PRACTICAL))
    reached = within(lines.where(labelled).select(doc, F.col("pos").alias("solved")), found.withColumn("_until", F.col("at") + reach), doc, "at", "_until", reach, pos="solved")
    first = reached.groupBy(key, doc, "at").agg(F.min("solved").alias("solved"))
    # a solution is made once, however many probes reach it: it stays in the stretch from one stop to the next
    stop = F.col("line").rlike(f"\\A\\s*\\d{{1,2}}\\s*[.．、]|{im.ANSWER}|【题型|{im.NOTE}")
    parted = long_running_id(lines.select(doc, "pos", "line"), [doc], stop, "_part")
    opened = parted.where(labelled).select(doc, "_part", F.col("pos").alias("solved"), (F.col("pos") + longest - 1).alias("_until"))
    body = within(parted, opened, [doc, "_part"], "solved", "_until", longest)
    own = F.when(F.col("pos") == F.col("solved"), F.get(F.split("line", im.PRACTICAL, 2), 1)).otherwise(F.col("line"))
    solutions = body.groupBy(doc, "solved").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.btrim(own).alias("line")))), lambda x: x["line"]), "\n").alias("explanation"))
    return first.join(solutions.hint("merge"), [doc, "solved"]).groupBy(key, doc).agg(F.max_by("explanation", F.struct(F.length("explanation"), -F.col("at"))).alias("explanation"))


def notes_of(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, nth, marker, number, content): notes open at their label with the circled or plain number before it, and end
    at the next label of a question, an artifact or the next note."""
    label = F.instr("line", im.NOTE) > 0
    token = F.regexp_replace(F.regexp_extract("line", f"((?:{im.CIRCLED}|[0-9]|\\s)+){im.NOTE}", 1), "\\s+", "")
    border = F.col("line").rlike(im.ANALYSIS_START) | F.col("line").rlike(f"{im.ANSWER}|{im.PRACTICAL}|【题型") | F.col("line").rlike(im.ARTIFACT)
    state = F.last(F.when(label, F.col("pos")).when(border, F.lit(-1)), ignorenulls=True).over(Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    inside = lines.withColumns({"opened": state, "token": F.when(label, token)}).where("opened >= 0")
    suffix = F.when(label, F.regexp_replace(F.get(F.split("line", im.NOTE, 2), 1), "\\A[：: ]+", "")).otherwise(F.col("line"))
    kept = F.when((F.trim(suffix) != "") & ~im.is_page_noise(suffix), F.struct("pos", compact_text(suffix).alias("line")))
    notes = inside.groupBy(doc, "opened").agg(F.max("token").alias("marker"), F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n").alias("content")).where("marker <> ''")
    nth = F.row_number().over(Window.partitionBy(doc).orderBy("opened")) - 1
    return notes.select(doc, nth.alias("nth"), "marker", marker_number(F.col("marker")).alias("number"), "content")


def _cut_groups(sizes: list[list[int | None]], expected: int) -> list[list[int | None]]:
    """Cuts long groups where a large number is followed by a small one, near 35 notes a side, until there are enough."""
    groups = list(sizes)
    while len(groups) < expected:
        options = [
            (abs(cut - 35) + abs(len(g) - cut - 35), i, cut)
            for i, g in enumerate(groups) if len(g) >= 45
            for cut in range(15, len(g) - 14)
            if g[cut - 1] is not None and g[cut] is not None and g[cut - 1] >= 18 and g[cut] <= 6
        ]
        if not options:
            break
        _, i, cut = min(options)
        groups[i : i + 1] = [groups[i][:cut], groups[i][cut:]]
    return groups


def note_groups(notes: DataFrame, expected: DataFrame, doc: str = "doc") -> DataFrame:
    """``notes`` with ``grp``: groups begin at number 1; where a document has fewer than ``expected`` (doc, groups), its
    long groups are cut. One document's list of numbers is folded at a time."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("nth", "number"))), lambda x: x["number"])
    lists = notes.groupBy(doc).agg(order.alias("numbers")).join(expected, doc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, numbers, most in zip(batch[doc], batch["numbers"], batch["groups"]):
                numbers = [None if pd.isna(n) else int(n) for n in numbers]
                groups: list[list] = []
                for n in numbers:
                    if not groups or (n == 1 and groups[-1]):
                        groups.append([])
                    groups[-1].append(n)
                at = 0
                for g, values in enumerate(_cut_groups(groups, int(most))):
                    out += [(name, at + i, g) for i in range(len(values))]
                    at += len(values)
            yield pd.DataFrame(out, columns=[doc, "nth", "grp"])

    placed = lists.mapInPandas(run, f"{doc} {notes.schema[doc].dataType.simpleString()}, nth int, grp int")
    return notes.join(placed, [doc, "nth"])


def assign_notes(scored: DataFrame, note: list[str], question: str, tolerance: float | None = None, least: float | None = None) -> DataFrame:
    """The best question of each note, from rows (note, question, score, eligible).

    Eligible questions (whose markers include the note's number) come first, if there are any; with ``tolerance`` only
    if the best of them is no more than that below the best of all. With ``least``, notes without an eligible
    question and a lower score stay unbound. Ties go to the smaller question.
    """
    top = scored.groupBy(*note).agg(F.max("score").alias("_all"), F.max(F.when(F.col("eligible"), F.col("score"))).alias("_own"))
    marked = F.col("_own").isNotNull() if tolerance is None else F.coalesce(F.col("_own") >= F.col("_all") - tolerance, F.lit(False))
    pool = scored.join(top, note).withColumn("_marked", marked).where(F.col("eligible") | ~F.col("_marked"))
    rank = F.row_number().over(Window.partitionBy(*note).orderBy(F.desc("score"), question))
    best = pool.withColumn("_rn", rank).where("_rn = 1")
    if least is not None:
        best = best.where(F.col("_marked") | (F.col("score") >= least))
    return best.select(*note, question, "score", F.when(F.col("_marked"), "marker").otherwise("content").alias("mode"))


def clean_notes(notes: DataFrame, by: list[str], order: str, relevance: float = 0.04) -> DataFrame:
    """Notes (marker, content, score, relevance, distinctive, marked) worth keeping, one of each content.

    A note must be distinctive, and either its marker stands in the question or it is relevant; an option tail goes;
    the score is the larger of both.
    """
    kept = notes.where(F.col("distinctive") & (F.col("marked") | (F.col("relevance") >= relevance)))
    cut = kept.withColumn("content", F.btrim(F.get(F.split(F.regexp_replace("content", im.ARTIFACT, ""), "\\n[ \\t]*A[ \\t]*[.．、]", 2), 0))).where("content <> ''")
    twin = Window.partitionBy(*by, F.concat("marker", bare(F.col("content")))).orderBy(order)
    return cut.withColumn("_rn", F.row_number().over(twin)).where("_rn = 1").drop("_rn").withColumn("score", F.greatest("score", "relevance"))
