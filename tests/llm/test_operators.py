"""Operators on small fixtures against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, jaccard_join, license_scan, line_dedup, packing, quality, substring_dedup, topk_search, toxicity, warc

GAP = re.compile("[\x20\x09-\x0D]+")
SENTENCE = "the quick brown fox jumps over the lazy dog while seventeen small birds watch from an old stone wall and sing"


def words_of(text):
    return [w for w in GAP.split(text or "") if w]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    body = [" ".join(rng.choice(vocabulary, n)) for n in (5, 19, 20, 60, 200, 700)]
    shared = SENTENCE + " " + " ".join(vocabulary[:12])
    line = "This very long line of furniture is found again and again."
    return [
        None, "", " \n\t ", "one", *body, body[3], body[3], shared + " " + body[0], body[1] + " " + shared, "x " * 300, "Ea Ea Eb " * 40,
        f"a\n{line}\nb", f"{line.upper()}\n c", f" {line}\t\n{line}", line, f"{line}\n", "z" * 5000, "日本語 テスト 😀 " * 30, body[4].replace("w1 ", "w2 ", 1),
        "Intro. Released under the MIT License. More.", "licensed under the apache license version 2 0",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", "y", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, did string, w string, n long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def test_bpe_round_trip(docs, none, texts):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.op1_bpe(docs).collect()}
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.op1_bpe(none).count() == 0


def test_bpe_partitions_share_dictionaries(spark, texts):
    import public_tokenizers as P

    path, cores = P.path("byte_bpe_multi_50k.tiktoken"), spark.sparkContext.defaultParallelism
    some = [(i, texts[i % len(texts)]) for i in range(6 * cores)]
    encoded = {n: bpe.encode(spark.createDataFrame(some, "doc_id long, text string").repartition(n), path, P.PATTERN) for n in (2, 6 * cores, 9 * cores)}
    assert {n: df.rdd.getNumPartitions() for n, df in encoded.items()} == {2: 2, 6 * cores: 2 * cores, 9 * cores: 3 * cores}
    few, many = (sorted((r["doc_id"], r["ids"]) for r in encoded[n].collect()) for n in (2, 6 * cores))
    assert len(few) == len(some) and few == many


def test_line_dedup(docs, none, texts, spark):
    keys = {i: [x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for x in (t or "").split("\n")] for i, t in enumerate(texts)}
    found = Counter(k for own in keys.values() for k in set(own) if len(k) >= 40)
    keeper = {k: max(i for i, own in keys.items() if k in own) for k, n in found.items() if n >= 5}
    assert keeper
    got = {r["doc_id"]: r for r in line_dedup.op2_line_dedup(docs).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys[i]) if keeper.get(k, i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert got[i]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert line_dedup.op2_line_dedup(none).count() == 0


def test_packing(docs, none, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.op3_packing(docs).collect()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1]) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.op3_packing(none).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_holds_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter(np.minimum(rng.geometric(0.004, 3000), 1024).tolist())
    plan = packing.plan_sequences(dict(histogram), 1024)
    held = Counter()
    for config, copies in plan:
        assert sum(k * n for k, n in config) <= 1024
        for k, n in config:
            held[k] += n * copies
    assert held == histogram
    assert sum(n for _, n in plan) <= -(-sum(k * n for k, n in histogram.items()) // 1024) * 1.02 + 1


def test_toxicity_voters_do_not_depend_on_partitions(spark):
    rows = [(f"blargword {'plain' if i < 2 else 'other'} t{i}", 1) for i in range(20)] + [(f"{'plain' if i < 12 else 'calm'} c{i}", 0) for i in range(60)]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    whole = toxicity.mine_voters(sample.coalesce(1))
    assert "w:blargword" in whole and "w:plain" not in whole
    assert toxicity.mine_voters(sample.repartition(60)) == whole


def test_toxicity_learns_from_labels(spark):
    rng = np.random.default_rng(3)
    clean = [f"c{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = list(rng.choice(clean, 40)) + (["blargword", "zonkered"] if toxic else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(600, None), (601, ""), (None, "c1")]
    labels += [(5, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.op4_toxicity(docs, marks).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert toxicity.op4_toxicity(docs.where("doc_id < 0"), marks).count() == 0
    assert toxicity.op4_toxicity(docs, marks.where("doc_id < 0")).count() == 603


def toxicity_hits(rows):
    """Hits of (label or None, words, {voter: count}) rows, three voters wide."""
    label = np.array([np.nan if x is None else x for x, _, _ in rows], float)
    sizes = np.array([len(h) for _, _, h in rows])
    at = np.array([i for _, _, h in rows for i in h], int)
    counts = np.array([n for _, _, h in rows for n in h.values()], int)
    return toxicity.Hits(label, np.array([n for _, n, _ in rows], float), sizes, at, counts, 3)


def test_toxicity_label_model_is_the_plain_one():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        first = rng.random() < (0.7 if bad else 0.02)
        fires = [first, first if rng.random() < 0.95 else not first, rng.random() < (0.5 if bad else 0.05)]
        rows.append((None if i % 3 == 0 else int(bad), 20, {v: 1 for v in range(3) if fires[v]}))
    model, post = toxicity.fit_label_model(toxicity_hits(rows), rounds=4)
    # the same, a row and a voter at a time
    truth, counted = [row[0] if row[0] is not None else 0.0 for row in rows], [row[0] is not None for row in rows]
    for _ in range(4):
        n1 = sum(p for p, c in zip(truth, counted) if c)
        n0 = sum(1 - p for p, c in zip(truth, counted) if c)
        share = lambda voters, toxic: sum((p if toxic else 1 - p) for (_, _, h), p, c in zip(rows, truth, counted) if c and all(v in h for v in voters))
        q = [(share([v], True) + 0.5) / (n1 + 2) for v in range(3)]
        r = [(share([v], False) + 0.05) / (n0 + 1) for v in range(3)]
        tie = lambda v, u: (share([v, u], True) / n1 - q[v] * q[u]) / math.sqrt(q[v] * (1 - q[v]) * q[u] * (1 - q[u]))
        weight = [1 / (1 + sum(t for u in range(3) if u != v and (t := tie(v, u)) > 0.3)) for v in range(3)]
        prior = n1 / (n1 + n0)
        truth = []
        for label, _, h in rows:
            odds = math.log(prior / (1 - prior)) + (0 if label is None else math.log(499) * (1 if label else -1))
            odds += sum(weight[v] * (math.log(q[v] / r[v]) if v in h else math.log((1 - q[v]) / (1 - r[v]))) for v in range(3))
            truth.append(1 / (1 + math.exp(-odds)))
        counted = [True] * len(rows)
    assert np.allclose(post, truth) and np.allclose(model.weight, weight) and np.allclose(model.on_toxic, q)
    assert model.weight[0] < 0.7 and model.weight[2] == 1.0  # the first two share a vote


def test_toxicity_scores_are_calibrated():
    # posteriors that are all too low: the known labels put them right
    rows = [(1, 10, {0: 3}), (0, 10, {})] * 50 + [(None, 10, {0: 3})] * 50
    hits, yes = toxicity_hits(rows), np.array([2.0, 0.0, 0.0])
    weights, bias = toxicity.fit_logistic(hits, yes, np.array([0.3, 0.01] * 50 + [0.3] * 50))
    score = lambda w, b: 1 / (1 + np.exp(-(toxicity._inputs(np.array([[3.0, 0, 0], [0, 0, 0]]), np.array([10.0, 10.0]), yes, len(toxicity.LEXICON)) @ w + b)))
    assert score(weights, bias)[0] < 0.5
    toxic, clean = score(*toxicity.calibrate(hits, yes, weights, bias))
    assert toxic > 0.9 and clean < 0.1
    unknown = toxicity_hits([(None, 10, {0: 3}), (0, 10, {})])
    assert toxicity.calibrate(unknown, yes, weights, bias)[1] == bias


def test_license_scan(docs, none):
    got = {(r["doc_id"], r["license"]): r for r in license_scan.op5_license_scan(docs).collect()}
    names = {name for _, name in got}
    assert names == {"MIT", "Apache-2.0"}
    assert all(r["coverage"] >= 0.8 and r["end"] > r["start"] for r in got.values())
    assert license_scan.op5_license_scan(none).count() == 0
    assert license_scan.align("a b c d".split(), "x a b y c d z".split(), 1)[0] == 4


def local_alignment(template, words):
    """The best local score over all cells, without a band."""
    score, best = np.zeros((len(template) + 1, len(words) + 1), int), 0
    for i, a in enumerate(template, 1):
        for j, b in enumerate(words, 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if a == b else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
            best = max(best, score[i, j])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_banded_alignment_is_the_best_one(seed):
    rng = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(40)]
    words = list(template)
    for _ in range(4):
        at = int(rng.integers(0, len(words)))
        words[at : at + int(rng.integers(0, 2))] = ["other"] * int(rng.integers(0, 2))
    words = ["x"] * 7 + words + ["y"] * 5
    matched, first, last = license_scan.align(template, words, 7)
    span = words[first : last + 1]
    assert local_alignment(template, words) == local_alignment(template, span) and matched == len(set(span) & set(template))


def test_whole_licenses_and_neighbours(spark):
    mit, short = license_scan.TEMPLATES["MIT-text"], license_scan.TEMPLATES["MIT"]
    changed = mit.replace("sublicense", "relicense").replace("substantial portions", "large parts")
    nc = license_scan.TEMPLATES["CC-BY-NC-4.0"]
    texts = [f"Copyright me\n\n{changed}\nend", f"{short} {nc} {short}", short.replace("the", "this"), "x " * 50_000 + short, license_scan.TEMPLATES["BSD-3-Clause-text"], "", None]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, coverage int")
    got = [(r["doc_id"], r["license"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in license_scan.scan(rows.unionByName(rows.where("doc_id = 1"))).collect()]
    assert [x for x in got if x[0] == 0] == [(0, "MIT", changed[:-1])]
    assert sorted(x[1] for x in got if x[0] == 1) == sorted(["MIT", "CC-BY-NC-4.0", "MIT"] * 2)
    assert [x[1] for x in got if x[0] == 2] == ["MIT"] and [x[1] for x in got if x[0] == 3] == ["MIT"]
    assert [x[1] for x in got if x[0] == 4] == ["BSD-3-Clause"]


def test_each_template_tells_its_own_license(spark):
    names = list(license_scan.TEMPLATES)
    gpl, agpl = license_scan.TEMPLATES["GPL-3.0"], license_scan.TEMPLATES["AGPL-3.0-header"]
    # another version, a truncated header of a related license, letters beyond ASCII before it, two licenses side by side
    others = {gpl.replace("3", "2"): set(), agpl[:170]: set(), "İé_ǆ x_y ४२ " * 30 + gpl: {"GPL-3.0"}, f"{gpl} {license_scan.TEMPLATES['MIT']}": {"GPL-3.0", "MIT"}}
    texts = [f"Copyright me\n\n{license_scan.TEMPLATES[n]}\nthe end" for n in names] + list(others)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in license_scan.scan(rows).collect():
        got[r["doc_id"]].add(r["license"])
    assert {n: got[i] for i, n in enumerate(names)} == {n: {license_scan.identifier(n)} for n in names}
    assert [got[len(names) + i] for i in range(len(others))] == list(others.values())


def test_scan_finds_what_alignment_at_all_places_finds(spark):
    """Every template against every diagonal of the text, without fingerprints."""
    rng = np.random.default_rng(11)
    filler = "some plain words of the text to license use software by any person".split()
    texts = []
    for name in ("MIT", "GPL-3.0-notice", "CC-BY-4.0", "ISC-text", "MPL-2.0", "CC0-1.0"):
        words = license_scan.TEMPLATES[name].split()
        words[int(rng.integers(2, len(words) - 2))] = "changed"
        texts.append(" ".join([*rng.choice(filler, 25), *words, *rng.choice(filler, 25)]))
    plain = {k: license_scan.WORD.findall(v.lower()) for k, v in license_scan.TEMPLATES.items()}
    want = set()
    for i, text in enumerate(texts):
        n = len(license_scan.WORD.findall(text.lower()))
        near = [(name, d) for name, own in plain.items() for d in range(-len(own) // 5, n)]
        want |= {(i, *m[:4]) for m in license_scan._matches(text, near, plain, license_scan.MIN_COVERAGE)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["template"], r["coverage"], r["matched"]) for r in license_scan.scan(rows).collect()}
    assert got == want


FURNITURE = re.compile(quality.BOILERPLATE)


def fails(line):
    """The line rules once more, in plain Python."""
    chars, gaps = sum(map(len, words_of(line))), len(GAP.findall(line))
    blanks = len(line) - chars
    if not chars:
        return False
    symbols, upper, letters = (sum(map(test, line)) for test in (lambda c: c in "#*$%&|<>", str.isupper, str.isalpha))
    loud = 5 * line.count("!") > 3 * (blanks + 1) and blanks + 1 >= 5
    return symbols > 0.1 * chars or loud or len(re.findall(" [|>»] ", line)) >= 3 or (letters >= 20 and upper > 0.6 * letters) or bool(len(line) <= 200 and FURNITURE.search(line)) or gaps < 0


LINES = ["Home | News | Shop | About", "WIN A PRIZE TODAY AND TELL ALL YOUR FRIENDS", "plain words of a good line " * 6, "wow ! ! ! ! ! !", "a # b * c $ d", "All rights reserved", "", " \t"]


@pytest.mark.parametrize("line", LINES)
def test_line_rules(spark, line):
    assert spark.createDataFrame([(line,)], "x string").select(quality.line_fails(F.col("x")).alias("x")).first()["x"] == fails(line)


def test_quality(docs, none, texts):
    got = {r["doc_id"]: r for r in quality.op6_quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        w, r = words_of(t), got[i]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {q for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        held = sum(len("".join(words_of(x))) for x in (t or "").split("\n") if not fails(x))
        assert r["kept"] == (not r["base_failed"] and 2 * held >= sum(map(len, w)))
    assert quality.op6_quality_rules(none).count() == 0


def test_substring_dedup(docs, none, texts):
    got = {r["doc_id"]: r for r in substring_dedup.op7_substring_dedup(docs).collect()}
    seen = set()
    for i, t in enumerate(texts):
        w, gone = words_of(t), set()
        for p in range(len(w) - 19):
            window = tuple(w[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.add(window)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.op7_substring_dedup(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(120)]
    vectors += [(i, vectors[7][1]) for i in range(120, 130)] + [(150, None), (151, [1.0, None]), (152, [float("nan")] * 8), (153, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in vectors[:130]}
    got: dict[int, list] = {}
    for r in topk_search.op8_topk_search(frame).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100}
    for q, rows in got.items():
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        assert sorted(rows) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert topk_search.op8_topk_search(frame.where("vec_id = 0")).count() == 0
    assert topk_search.op8_topk_search(frame.where("vec_id < 0")).count() == 0


def test_near_duplicates(spark, none):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(2000)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:8]:
        for spot in (10, 60, 110):
            near = list(b)
            near[spot] = "changed"
            texts.append(" ".join(near))
    texts += [texts[0], texts[0], None, "", "a b", "a b"]
    got = {r["doc_id"]: r for r in jaccard_join.op9_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = {i: frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if (w := words_of(t)) else None for i, t in enumerate(texts)}
    for i, a in sets.items():
        near = [j for j, b in sets.items() if j != i and a and b and len(a & b) / len(a | b) >= 0.8]
        assert got[i]["n_links"] == len(near)
        assert got[i]["class_id"] == min((j for j, b in sets.items() if a and b == a), default=i)
        assert got[i]["group_id"] <= min([i, *near])
    assert jaccard_join.op9_jaccard_join(none).count() == 0


def test_near_duplicates_join_paths_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.choice([f"w{i}" for i in range(400)], 160)
    rows = [(i, " ".join(["x" + str(i) if j == i % 160 else w for j, w in enumerate(base)])) for i in range(300)]
    signed = jaccard_join.word_hashes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(0).cast("long")), "doc_id", "th")
    placed = signed.mapInArrow(jaccard_join._sign(5), "doc_id long, th long, n long, ckey binary, sig binary").selectExpr("doc_id AS cid", "sig", "CAST(NULL AS long) AS kin").cache()
    made, levels, join, buckets = [], [], type(placed).join, jaccard_join._buckets

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "key" and (n := out.count()):
            made.append(n)
        return out

    drawn = Counter(r["key"] for r in jaccard_join._drawn(placed, 5).collect())
    in_large = sum(n for n in drawn.values() if n > jaccard_join.BUCKET)
    monkeypatch.setattr(type(placed), "join", counted)
    monkeypatch.setattr(jaccard_join, "_buckets", lambda rows: levels.append(1) or buckets(rows))
    assert jaccard_join.families_of(placed.drop("kin"), 5).count() >= 250
    assert in_large and made == [in_large]  # rows of large buckets are joined once
    made.clear()
    assert jaccard_join.entries_of(placed, 5).count()
    assert 1 < len(levels) == len(made)  # and single classes meet their buckets once a level


def test_warc_round_trip_and_salvage(spark, tmp_path):
    page = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/ b", page), (2, None, page), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.op10_warc(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4)] == [("revisit", 2), ("response", None), ("response", None), ("response", None)]
    assert warc.op10_warc(pages.where("page_id < 0")).count() == 0

    records = [warc.record_bytes(i, "u", b"payload %d" % i, hashlib.sha1(b"payload %d" % i).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(4)]
    members = [gzip.compress(r) for r in records]
    broken = members[1][:20] + b"\xff\xff" + members[1][22:]
    out = list(warc.salvage(members[0] + broken + b"junk" + members[2] + b"\x00" + members[3]))
    assert [x["record_id"][-1] for x in out if x["kind"] == "record"] == ["0", "2", "3"]
    gap = next(x for x in out if x["kind"] == "gap")
    assert (gap["offset"], gap["length"]) == (len(members[0]), len(broken) + 4)
    plain = records[0] + records[1].replace(b"payload 1", b"payload X") + records[2]
    assert [x["kind"] for x in warc.salvage(plain)] == ["record", "gap", "record"]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + members[1][:30])
    kinds = [r["kind"] for r in warc.read_archives(spark, str(tmp_path)).collect()]
    assert sorted(kinds) == ["gap", "record"]


def test_warc_records_inside_damaged_members():
    records = [warc.record_bytes(i, "u", b"payload %d" % i, hashlib.sha1(b"payload %d" % i).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(4)]
    kinds = lambda data: [(x["kind"], (x.get("record_id") or "")[-1:]) for x in warc.salvage(data)]
    spoilt = records[1].replace(b"payload 1", b"payload X")
    assert kinds(gzip.compress(records[0] + spoilt + records[2]) + gzip.compress(records[3])) == [("record", "0"), ("record", "2"), ("gap", ""), ("record", "3")]
    big = gzip.compress(b"".join(records), 0)
    assert kinds(big[:-40]) == [("record", "0"), ("record", "1"), ("record", "2"), ("gap", "")]
    assert kinds(b"") == [] and kinds(b"junk") == [("gap", "")]


def test_warc_digests_by_their_algorithm():
    sha = hashlib.sha1(b"x")
    for told in ("sha1:" + sha.hexdigest(), "SHA1:" + sha.hexdigest().upper(), "sha1:" + base64.b32encode(sha.digest()).decode(), "md5:" + hashlib.md5(b"x").hexdigest(), "blake9:zz", "", None):
        assert warc.digest_holds(told, b"x")
    assert not warc.digest_holds("sha1:" + sha.hexdigest(), b"y") and not warc.digest_holds("md5:00", b"x")


def test_warc_files_are_bounded_by_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1_000_000), (2, None, None)], "page_id long, url string, html string")
    assert warc.records_per_file(pages, file_bytes=3_100_000) == 3
    assert warc.records_per_file(pages.where("page_id = 2")) == 4000
    extra = pages.unionByName(pages).withColumns({"payload": F.lit(1), "refers_to": F.lit("z")})
    assert sorted((r["page_id"], r["record_type"]) for r in warc.op10_warc(extra).collect()) == [(1, "response")] * 2 + [(2, "response")] * 2


def test_words_of_packing_have_the_ids_of_the_tokenizer():
    import public_tokenizers

    tokenizer, added, encode = packing._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    words, cut = packing._Words(encode), bpe.cutter(public_tokenizers.PATTERN)
    assert added == ["<|endoftext|>"]
    for text in ["", "It's  a plain\n\n text, 12 items.", "\u6f22\u5b57 \U0001f600\u00e9\u00a0 x\x00\x1f'll", "\ufb00\u00b2\u00bd \u2167\u0663 \u3000.", "a" * 3000]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert b"".join(map(words.__getitem__, cut(text))) == b"".join(i.to_bytes(4, "little") for i in ids)
