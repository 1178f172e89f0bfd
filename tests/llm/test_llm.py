"""The corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from suitestat.llm import common, embedding_cells, language_cnn, line_hash, line_join, mixing, prob_minhash, quality_rules, queries, sentencepiece_bpe, toxicity_ftrl, warc
from suitestat.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
CLASH = "id k h s t w l p salt rank quota epochs letters".split()
DOC = "doc_id bigint, text string, lang string, source string, size int, class_id string, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, rows that repeat, columns whose names clash."""
    long = "word " * 30_000 + "\n" + "x" * 5000
    rows = [(1, None, "en", "a", 1, "z"), (2, "", None, None, None, None), (3, long, "en", "a", 2, "z"), (4, "same words stand here in this row twice\nand once", "en", "b", 3, "z"), (4, "same words stand here in this row twice\nand once", "en", "b", 3, "z"), (None, "no key at all but some words here", "de", "b", 4, None), (5, " \t\n", "de", None, 5, "y"), (6, "é́ 　 ​ \0 \U0001f600", "fr", "c", 6, "y")]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# ---- shared


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(900 + i, 901 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_agree(spark, odd):
    mine = [common.split_words(r["text"]) for r in odd.select("text").collect()]
    theirs = [r["w"] for r in odd.select(common.words(F.col("text")).alias("w")).collect()]
    counts = [r["n"] for r in odd.select(common.n_words(F.col("text")).alias("n")).collect()]
    brute = [WORD.findall(r["text"] or "") for r in odd.select("text").collect()]
    assert mine == theirs == brute and counts == [len(w) for w in brute]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("add", [line_hash.dedup_substrings, line_join.dedup_lines, prob_minhash.near_duplicates, mixing.mix, language_cnn.identify, sentencepiece_bpe.encode_decode, quality_rules.statistics], ids=lambda f: f.__name__)
def test_columns_that_clash_stay(add, odd):
    out = add(odd)
    assert len(set(out.columns)) == len(out.columns)
    assert out.count() == odd.count() and all(tuple(r) == tuple(CLASH) for r in out.select(*CLASH).collect())


# ---- 1


def test_encoding_is_the_librarys():
    import sentencepiece

    path = sentencepiece_bpe.default_model()
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.codec(path)
    rng = random.Random(2)
    fixed = ["", " ", "   a", "\n", "a\n b", "▁", "▁a▁▁b", "\0", "日本語", "é́", "\U0001f600x", "a" * 300, "ab" * 200, "x" + " " * 50 + "y", "<s>", "</s><0x0A>", "�"]
    drawn = ["".join(rng.choice("ab th e\n▁éñ日\t.,<s>0x\U0001f600") for _ in range(rng.randrange(40))) for _ in range(1500)]
    for t in fixed + drawn:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        mine = np.frombuffer(c.encode(t), "<u4")
        assert mine.tolist() == ids, t
        assert c.decode(mine) == sp.decode(ids), t


def test_neighbours_meet_by_stored_orders_of_merges(monkeypatch):
    c, rng = sentencepiece_bpe.PieceCodec(sentencepiece_bpe.default_model()), random.Random(8)
    pieces = list(c.ids)
    near = [c.split(sentencepiece_bpe.MARK + "".join(rng.choices("aeinrstxé漢", k=12))) for _ in range(200)]
    pairs = [p for parts in near for p in zip(parts, parts[1:])] + [(p[:k], p[k:]) for p in rng.choices(pieces, k=2000) for k in range(1, len(p))] + [(rng.choice(pieces), rng.choice(pieces)) for _ in range(2000)] + [("", p) for p in pieces[:500]]
    want = [c.merge(left + right) == ([left, right] if left else [right]) for left, right in pairs]
    assert {True, False} == set(want)
    c.pairs.clear()
    # The text of two is never merged anew.
    monkeypatch.setattr(c, "merge", None)
    assert [c.compatible(*p) for p in pairs] == want


def test_encoding_query(spark, docs, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted(tuple(r) for r in sentencepiece_bpe.encode_decode(both, with_ids=False, with_text=False).na.fill(-1).collect())
    want = []
    for r in both.collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert sentencepiece_bpe.encode_decode(none).count() == 0


# ---- 2


def test_targets_stop_and_reshare():
    t = mixing.targets({"a": 10, "b": 1000, "c": 10, None: 5}, max_epochs=3)
    assert t["a"] == 30 and t["c"] == 30 and t[None] == 15 and t["b"] == 1025 - 75 and sum(t.values()) == 1025


def test_fit_is_exact_where_a_subset_is():
    rng = random.Random(3)
    for _ in range(60):
        counts = [(s, rng.randrange(1, 6)) for s in rng.sample(range(1, 60), 8)]
        total = sum(s * n for s, n in counts)
        budget = rng.randrange(total + 1)
        reach = {0}
        for s, n in counts:
            reach |= {x + s * k for x in reach for k in range(1, n + 1)}
        best = max(x for x in reach if x <= budget)
        take = mixing.fit(counts, budget)
        assert all(0 <= k <= dict(counts)[s] for s, k in take.items())
        assert best - sum(s * k for s, k in take.items()) <= max(1, best // 100)


def test_mix(spark, docs, odd, none):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        again = mixing.mix(df).collect()
        key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
        assert key(rows) == key(again) and len(rows) == df.count()
        assert all(r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 3 * r["size"] for r in rows if r["size"])
        by = collections.defaultdict(list)
        for r in rows:
            by[r["source"]].append(r)
        for rs in by.values():
            assert rs[0]["source_size"] == sum(r["size"] for r in rs)
            if df is docs:
                assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(2, 0.02 * rs[0]["target"])
    assert mixing.mix(none).count() == 0


# ---- 3


def brute_stats(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = quality_rules.quality_rules(both, labels).collect()
    stats = sorted(tuple(r[c] for c in quality_rules.STATS) for r in got)
    assert stats == sorted(brute_stats(r["text"]) for r in both.collect())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [(quality[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in quality and r["doc_id"] > 6]
    assert sum(k for q, k in known if q == 1) >= 0.9 * sum(q == 1 for q, _ in known)
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.quality_rules(odd, labels.limit(0)).filter("rule > 0").count() == 0


def test_learned_list_finds_a_planted_rule(spark):
    rng = random.Random(4)
    rows = [((x > 0.7 and y < 0.5) * 1, i % 3, x, y) for i in range(3000) for x, y in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(rows, "bad int, fold int, x double, y double")
    rules = quality_rules.learn(df, ["x", "y"])
    hit = df.withColumn("v", quality_rules.verdict(rules) > 0).filter("v = (bad = 1)").count()
    assert hit >= 0.97 * len(rows) and {c.feature for c in rules[0]} == {"x", "y"}


# ---- 4


def test_probes_lose_no_pair():
    rng = np.random.default_rng(5)
    x = embedding_cells.unit(rng.normal(size=(300, 6)))
    y = embedding_cells.unit(x + rng.normal(size=x.shape) * 0.12)
    c = embedding_cells.kmeans(x, 12)
    home, _ = embedding_cells.probes(y, c, 0.93)
    _, mask = embedding_cells.probes(x, c, 0.93)
    near = (x * y).sum(axis=1) >= 0.93
    assert near.sum() > 100 and mask[np.flatnonzero(near), home[near]].all()


def test_embeddings_small_blocks(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    bad = spark.createDataFrame([(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [1.0] * 64, None), (9005, [], 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (None, [1.0] * 64, 1), (9008, [1e-30] * 64, 2), (9009, [1e30] * 64, 2)], "vec_id bigint, embedding array<float>, label int")
    every = df.unionByName(bad).unionByName(df.limit(3))
    got = collections.Counter(tuple(r) for r in embedding_cells.link(every, per_cell=5, block=16).collect())
    assert got == collections.Counter(tuple(r) for r in embedding_cells.link(every).collect())
    by = {r[0]: r for r in got}
    assert by[9001][1:] == (0, 9001, True) and by[9004][1] == 0 and by[9006][1:] == (1, 9006, True) and by[9007][1:] == (1, 9006, False) and by[9009][1] >= 1
    assert embedding_cells.link(df.limit(0)).count() == 0 and embedding_cells.link(bad.limit(1)).collect()[0]["n_links"] == 0


# ---- 5


def test_lines_by_hand(spark, odd, none):
    line = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    near = line.replace("z", "zz")
    df = spark.createDataFrame([(1, f"short one\n{line}"), (2, f"{near}\n{line}\nshort one"), (3, f"{line}\n{line}"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in line_join.dedup_lines(df).collect()}
    assert got == {1: (f"short one\n{line}", []), 2: ("", [0, 1, 2]), 3: ("", [0, 1]), 4: (None, []), 5: ("", [])}
    assert line_join.dedup_lines(odd).count() == odd.count() and line_join.dedup_lines(none).count() == 0


def test_lines_and_index_come_from_one_reading(spark, docs):
    lines = line_join.line_rows(docs, "text", "doc_id", np.zeros(line_join.COUNTERS, np.int64), 0.8)
    assert lines.columns == ["k", "pos", "d1", "d2", "index"]
    assert line_join.memberships(lines.limit(0), 0.8).count() == 0
    assert line_join.lines_at("a\nb\n\nd", [0, 2, 3, 9]) == "a\n\nd" and line_join.lines_at(None, [1]) == ""


def test_lines_in_small_parts(spark, docs, monkeypatch):
    rows = lambda: sorted((r["k"], r["n_lines"], r["n_links"], r["removed"]) for r in line_join.removed_lines(docs).collect())
    whole = rows()
    monkeypatch.setattr(line_join, "PER_PART", 2)
    assert rows() == whole and any(r[3] for r in whole)
    twice = docs.unionByName(docs.limit(40))
    assert {r["k"]: r["removed"] for r in line_join.removed_lines(twice).collect()} == {r[0]: r[3] for r in whole}


def test_lines_of_a_large_group(spark, monkeypatch):
    """Many near copies of one line, some by chance in several groups, against all pairs."""
    rng = random.Random(55)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (60, 60, 25)]
    rows = []
    for i in range(90):
        ws = list(base[i % 3])
        for _ in range(rng.randrange(4)):
            ws[rng.choice([0, 1, 2, -1, -2, -3, len(ws) // 2])] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(ws) + ("\nsame" if i % 9 == 0 else "")))
    sets = [(i, pos, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)])) for i, t in rows for pos, w in enumerate(map(str.split, t.split("\n")))]
    distinct = {s for _, _, s in sets}
    links = {s: {x for x in distinct if x != s and 10 * len(s & x) >= 8 * len(s | x)} for s in distinct}
    first = {}
    for i, pos, s in sets:
        first.setdefault(s, (i, pos))
    want = {i: [0, []] for i, _ in rows}
    for i, pos, s in sets:
        want[i][0] += len(links[s])
        if min(first[x] for x in {s} | links[s]) != (i, pos):
            want[i][1].append(pos)
    assert max(map(len, links.values())) > line_join.SMALL
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for per_part in (1024, 9):
        monkeypatch.setattr(line_join, "PER_PART", per_part)
        got = {r["k"]: [r["n_links"], r["removed"]] for r in line_join.removed_lines(df).collect()}
        assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}


def test_words_of_a_block(texts):
    every = [t or "" for t in texts.values()][:60] + ["", " ", "é\u3000 \x0b\x1f x\n\ny"]
    h, start, line = common.block_words("\n".join(every).encode())
    want = [(w, i) for i, row in enumerate("\n".join(every).split("\n")) for w in WORD.findall(row)]
    assert line.tolist() == [i for _, i in want] and len(start) == len(want)
    seen = {}
    assert all(seen.setdefault(w, x) == x for (w, _), x in zip(want, h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


# ---- 6


def test_toxicity(spark, odd, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        y = i % 3 == 0
        ws = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30)]
        if y:
            ws[rng.randrange(30)] = "grumble"
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(y)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_ftrl.toxicity(df, lab).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r["predicted"], int(i % 3 == 0)) for i, r in got.items() if r["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    flipped = lab.withColumn("toxic", F.when(toxicity_ftrl.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity_ftrl.toxicity(df, flipped).collect()} == {i: r["score"] for i, r in got.items()}
    out = toxicity_ftrl.toxicity(odd, lab).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert [r["score"] for r in toxicity_ftrl.toxicity(odd, lab.limit(0)).collect()] == [0.5] * odd.count()
    assert toxicity_ftrl.toxicity(none, lab).count() == 0


# ---- 7


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(7)
    e = common.mix64(np.arange(1, 400, dtype=np.uint64))
    w = 1 + rng.random(len(e)) * 3
    v = w.copy()
    v[:120] = 0.001
    both = prob_minhash.signatures(np.concatenate([e, e]), np.concatenate([w, v]), np.repeat([0, 1], len(e)), 2, 2048)
    want = sum(1 / np.maximum(w / w[i], v / v[i]).sum() for i in range(len(e)))
    assert abs((both[0] == both[1]).mean() - want) < 0.04


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    shared, by = collections.Counter(), collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, odd, none):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(60):  # a group of near copies on both sides of the threshold
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{i}_{rng.randrange(99)}"
        texts[i] = " ".join(w)
    texts |= {100 + i: " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for i in range(40)} | {200: "", 201: None, 202: "one two", 203: "one two", 204: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(df).collect()}
    assert got == brute_classes(texts)
    out = prob_minhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and all(r["kept"] for r in out)
    assert prob_minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_the_table(spark, docs, texts):
    assert {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(docs).collect()} == brute_classes(texts)


def test_near_duplicates_of_repeated_words(spark):
    rng = random.Random(81)
    texts = {}
    for i in range(40):  # a text with half of its words 150 times, and it with some of those gone: set similarity 0.81
        ring, rest = ([f"{c}{i}_{rng.randrange(10**6)}" for _ in range(50)] for c in "ab")
        texts[2 * i] = " ".join(rest + ring * 150)
        texts[2 * i + 1] = " ".join(rest + ring[:35])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_classes(texts)
    assert len(set(want.values())) == 40
    assert {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(df).collect()} == want


# ---- 8


def brute_paragraphs(text, whole):
    """(start, end, folded words) of runs of lines with a word, or of each such line."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        ws = WORD.findall(line.lower())
        if ws:
            if whole and out and out[-1][3]:
                out[-1] = (out[-1][0], at + len(line), out[-1][2] + ws, True)
            else:
                out.append((at, at + len(line), ws, True))
        elif out:
            out[-1] = (*out[-1][:3], False)
        at += len(line) + 1
    return [(a, b, tuple(ws)) for a, b, ws, _ in out]


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_units_by_brute_force(unit, spark, docs, odd, texts):
    more = {10_001: "A b\n\n\nc\n \t\nA  B\nx", 10_002: "a B\n\nc", 10_003: "\u3000\na\u3000b\n\ny\r\n\r\nA b"}
    seen, want = set(), {}
    for i in sorted(texts | more):
        for a, b, ws in brute_paragraphs((texts | more)[i], unit == "paragraph"):
            if ws in seen:
                want.setdefault(i, []).append((a, b))
            seen.add(ws)
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))
    got = {r["k"]: [tuple(s) for s in r["spans"]] for r in line_hash.removals(every, unit=unit).collect()}
    assert got == want and got


def test_units_take_linear_time():
    import time

    for text in ("." * 1_000_000, " \n" * 500_000, "a \n" * 300_000, "\n" * 1_000_000):
        began = time.process_time()
        list(line_hash.units_of(text, "paragraph"))
        assert time.process_time() - began < 2


def test_passage_goes_and_the_rest_stays(spark, odd, none):
    passage = "This long passage stands in two documents word for word and so its second copy has to go away.\nIt goes on for a second line with many more words in it."
    df = spark.createDataFrame([(1, f"Own words first.\n\n{passage}\n\nOwn end."), (2, f"Other words.\n\n{passage}\n\nLast line."), (3, None), (4, "Own words, first.")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_hash.dedup_substrings(df).collect()}
    assert got[1]["removed_words"] == 0 and got[4]["removed_words"] == 0 and got[3]["text"] is None
    assert "passage" not in got[2]["text"] and got[2]["text"].startswith("Other words.") and got[2]["text"].endswith("Last line.")
    text = df.filter("doc_id = 2").first()["text"]
    assert [text[s["start"] : s["stop"]] for s in got[2]["removed_spans"]] == [passage]
    assert line_hash.dedup_substrings(odd).count() == odd.count() and line_hash.dedup_substrings(none).count() == 0


def test_passage_within_sentences_goes(spark):
    rng = random.Random(80)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    within, across = word(60), f"{word(25)}. {word(6)}. {word(25)}"
    parts = [(word(9), word(7)), (word(5), word(8))]
    rows = [(i, f"{a} {p} {b}. {word(12)}.") for i, (p, (a, b)) in enumerate((p, ab) for ab in parts for p in (within, across))]
    got = {r["doc_id"]: r for r in line_hash.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i]["removed_words"] for i in range(4)] == [0, 0, 60, 56]
    for i, p in ((2, within), (3, across)):
        assert [rows[i][1][s["start"] : s["stop"]].strip() for s in got[i]["removed_spans"]] == [p]


def covered_share(texts, spans, n=50):
    """Words in runs of n that an earlier document has, and how many of those are in no span; words that stand alone for a whole text are left out."""
    seen, all_, lost = set(), 0, 0
    for i in sorted(texts):
        ms = list(WORD.finditer((texts[i] or "").lower()))
        ws = [hash(m[0]) for m in ms]
        wins = [hash(tuple(ws[j : j + n])) for j in range(len(ws) - n + 1)]
        if len(set(ws)) > 1:
            need = {p for j, x in enumerate(wins) if x in seen for p in range(j, j + n)}
            gone = {p for p, m in enumerate(ms) for s in spans.get(i, ()) if s[0] <= m.start() < s[1]}
            all_, lost = all_ + len(need), lost + len(need - gone)
        seen.update(wins)
    return all_, lost


def test_long_passages_of_the_table_go(spark, docs, texts):
    got = {r["k"]: [tuple(s) for s in r["spans"]] for r in line_hash.removed_passages(docs).collect()}
    whole = {r["k"]: [tuple(s) for s in r["spans"]] for r in line_hash.removals(docs).collect()}
    n, lost = covered_share(texts, got)
    print("passages of 50 words:", n, "words; lost", lost, "whole units lost", covered_share(texts, whole)[1])
    assert n and lost <= 0.01 * n and lost < covered_share(texts, whole)[1]
    assert all(any(a <= s[0] and s[1] <= b for a, b in got[k]) for k, ss in whole.items() for s in ss)


# ---- 9


def test_language(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in language_cnn.identify(docs, train_docs=400).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    out = {r["doc_id"]: r for r in language_cnn.identify(odd).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[5]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in out.values())
    assert language_cnn.identify(none).count() == 0


# ---- 10


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/3", "<p>x</p>"), (1, "http://a/1", "<p>x</p>"), (2, None, None), (4, "http://a\r\n/4", ""), (5, "http://a/5", "é" * 3000), (None, "http://a/n", "<p>x</p>"), (6, "u", "y"), (6, "u", "y")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, sha int")
    for name in ("a", "b"):
        warc.write(pages, str(tmp_path / name), roll_bytes=600, partitions=3)
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir() if p.suffix == ".gz"}
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "b").iterdir() if p.suffix == ".gz"} and len(files) > 3
    assert all(gzip.decompress(b).startswith(b"WARC/1.1\r\n") for b in files.values())
    (tmp_path / "a" / ".part-999999-00000.warc.gz.7.tmp").write_bytes(b"left over")
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[3]["refers_to"], by[4]["refers_to"], by[None]["refers_to"]) == ("response", 1, 2, 1)
    assert by[2]["url"] is None and by[5]["payload"].decode() == "é" * 3000 and by[3]["payload_bytes"] == 8 and by[3]["payload"] is None
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_reruns_write_the_same_bytes(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hot = pages.withColumn("page_id", F.when(F.col("page_id") % 3 == 0, 7).when(F.col("page_id") % 7 == 0, None).when(F.col("page_id") % 11 == 0, F.col("page_id") + (1 << 61)).otherwise(F.col("page_id")))
    for df in (pages, hot):
        files = []
        for i, q in enumerate((df, df.repartition(7).orderBy(F.rand(9)))):
            name = tmp_path / f"{df is hot}{i}"
            warc.write(q, str(name), roll_bytes=40_000, partitions=5)
            files.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in name.iterdir() if p.suffix == ".gz"})
        assert files[0] == files[1] and len(files[0]) > 5
        ranges = warc.read(spark, str(name)).groupBy(F.substring("file", 1, 11).alias("f")).agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.count("*").alias("n")).orderBy("f").collect()
        assert sum(r["n"] for r in ranges) == df.count() and max(r["n"] for r in ranges) < 0.4 * df.count()
        assert all(x["b"] is None or y["a"] is None or x["b"] <= y["a"] for x, y in zip(ranges, ranges[1:]))


def test_records_name_what_they_refer_to():
    first, again = (warc.record(i, f"http://a/{i}", b"<p>", *more) for i, more in ((1, (None,)), (2, (1, "http://a/1"))))
    assert f"WARC-Refers-To: {warc.record_id(1, 'http://a/1')}\r\n".encode() in again and f"WARC-Record-ID: {warc.record_id(1, 'http://a/1')}\r\n".encode() in first
    assert first.partition(b"\r\n\r\n")[2] == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>\r\n\r\n"
    assert warc.parse(first)["payload"] == b"<p>" and warc.parse(again)["payload"] is None


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id bigint, url string, html string")
    warc.write(pages, str(tmp_path), min_bytes=4)
    assert {r["page_id"]: r["refers_to"] for r in warc.read(spark, str(tmp_path)).collect()} == {1: None, 2: None, 3: None, 4: 3}


# ---- the pipeline


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "minhash", "mixing", "sentencepiece"]
    now = docs
    for name, stage in P.STAGES[:-1]:
        before = now
        now = common.materialize(stage(spark, before, SMALL), f"test-{name}")
        assert now.columns == docs.columns
        assert now.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        if name == "minhash":
            left = {r["doc_id"]: r["text"] for r in before.collect()}
            classes = brute_classes(left)
            assert sorted(r["doc_id"] for r in now.collect()) == sorted(set(classes.values()))
    last = P.STAGES[-1][1](spark, now, SMALL)
    assert last.count() == now.count() and {"doc_id", "n_tokens", "ids"} <= set(last.columns)
    assert math.isclose(last.agg(F.sum("n_tokens")).first()[0], last.agg(F.sum(F.size("ids"))).first()[0])
