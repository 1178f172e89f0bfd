"""Periodic runs, whitening and chat formatting against brute force, dense eigenvectors and round trips, and on odd rows."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from suitestat.llm import basic_factors, chat_format, jacobi_davidson, queries

SMALL = "/root/testdata/sf0.001"


# ---- 11


def brute_runs(x):
    """Every maximal stretch of every period, kept where no smaller period holds."""
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                w = x[i : i + length]
                if not any(w[d:] == w[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(x, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return [w for i, w in enumerate(x) if i not in gone]


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            x = []
            for _ in range(rng.randrange(6)):
                x += ([rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 9))[: rng.randrange(1, 40)]
            texts.append(x)
        word, text = np.array([w for x in texts for w in x], np.int64), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        first = np.cumsum([0, *map(len, texts)])
        want = [(s + f, m, p) for x, f in zip(texts, first) for s, m, p in brute_runs(x)]
        assert list(zip(*(v.tolist() for v in basic_factors.find_runs(word, text)))) == want
    with pytest.raises(ValueError):
        basic_factors.find_runs(word, text, min_exponent=2)


def planted(key, ws):
    h = zlib.crc32(str(key).encode())
    n, g = len(ws), h // 10
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        ws = planted(d["doc_id"], (d["text"] or "").encode().split())
        r = got[d["doc_id"]]
        if len(ws) > 2500:  # the brute force is quadratic
            continue
        runs = brute_runs(ws)
        with_runs += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r["n_runs"], r["n_words"]) == (len(runs), len(ws))
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(collapse(ws, runs))).hexdigest()
    assert with_runs > 10


def test_runs_of_odd_rows(spark, monkeypatch):
    long = "a b c " * 40_000 + "é́ x" + " y" * 6
    texts = [None, "", " \t\n", "w", "w " * 5, "w " * 6, "a b " * 3, long, "a b a b a b a b ", "W " * 7, "W " * 7]
    rows = [(i if i != 3 else None, t, "n", "k", "r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Runs string, _key string, raw string")
    got = basic_factors.periodic_runs(df)
    assert got.columns == ["doc_id", "_key", "raw", "n_words", "n_runs", "runs", "collapsed"]
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()}
    assert found[0] == found[1] == found[2] == ([], "") and found[None] == ([], "w") and found[4] == ([], "w w w w w")
    assert found[5] == ([(0, 6, 1)], "w") and found[6] == ([], "a b a b a b")
    assert found[7] == ([(0, 120_000, 3), (120_002, 6, 1)], "a b c é́ x y")
    assert found[8][0] == [] and found[9] == found[10] == ([(0, 7, 1)], "W")
    assert basic_factors.periodic_runs(df.limit(0)).count() == 0


# ---- 12


@pytest.mark.parametrize("shape", [(1, 1), (5, 9), (30, 33), (60, 200), (50, 3)])
def test_pairs_are_those_of_a_dense_solver(shape):
    a = np.random.default_rng(sum(shape)).standard_normal(shape)
    v = a @ a.T
    sent = []
    e, u, r = jacobi_davidson.eigenpairs(lambda w: sent.append(w.shape[1]) or v @ w, len(v), 8)
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert np.abs(e - want).max() < 1e-12 * want[0] and np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13 and r.max() <= 100 * jacobi_davidson.EPS * want[0]


def test_pairs_with_a_small_subspace():
    v = np.diag(np.arange(120.0) ** 3)
    e, _, _ = jacobi_davidson.eigenpairs(lambda w: v @ w, 120, 5, most=16)
    assert np.allclose(e, np.arange(119.0, 114.0, -1) ** 3, rtol=1e-12)


def test_minres_solves():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((20, 20))
    v, b, shift = a + a.T, rng.standard_normal((20, 3)), np.array([0.3, -1.0, 5.0])
    x = jacobi_davidson.minres(lambda w: v @ w, shift, b, np.zeros((20, 0)), 60, 0.0)
    assert np.abs(v @ x - x * shift - b).max() < 1e-8


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return (n * x - s) ** 2, e[::-1], y @ u[:, ::-1]


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    squares, e, y = dense([r["embedding"] for r in rows])
    got = collections.defaultdict(dict)
    for r in queries.op12_whitening(spark, SMALL).collect():
        got[r["component"]][r["vec_id"]] = r
    assert sorted(got) == list(range(1, 9))
    for c, by_id in got.items():
        mine = np.array([by_id[r["vec_id"]]["whitened"] for r in rows])
        want = y[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        one = by_id[rows[0]["vec_id"]]
        assert one["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and one["identity_error"] < 1e-10 and one["n"] == len(rows)
        assert [by_id[r["vec_id"]]["deviation"] for r in rows] == squares.sum(axis=1).tolist()


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.0, 1.0]), (2, [-0.5, 0.25, 2.0]), (2, [-0.5, 0.25, 2.0]), (None, [9.0, 1.0, -1.0]), (4, [0.0, 0.0, 0.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [1.0, nan, 2.0]), (9, [inf, 1.0, 2.0]), (10, [1e300, 0.0, 0.0]), (11, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, component string")
    got = jacobi_davidson.whiten(df).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 3, 2: 6, None: 3, 4: 3}
    squares, e, y = dense([v for _, v in good])
    for c in (1, 2, 3):
        mine = sorted(abs(r["whitened"]) for r in got if r["component"] == c)
        assert np.allclose(mine, sorted(np.abs(y[:, c - 1] / np.sqrt(e[c - 1]))), atol=1e-9)
    assert {r["deviation"] for r in got if r["vec_id"] == 2} == {int(squares[1].sum())}
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    same = spark.createDataFrame([(i, [float(i), 1.0, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert jacobi_davidson.whiten(one).count() == 0 and jacobi_davidson.whiten(one.limit(0)).count() == 0
    assert jacobi_davidson.whiten(same).agg(F.max("component"), F.count("*")).first() == (1, 5)
    with pytest.raises(ValueError):
        jacobi_davidson.whiten(df.withColumnRenamed("vec_id", "N"), key="N")


def test_sums_stay_exact_where_64_bits_end():
    x = np.array([[1 << 52, 5], [-(1 << 52), 6]], np.int64)
    n, sums = 1 << 20, [3, 1 << 70]
    want = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    assert jacobi_davidson.apart(x, n, sums).tolist() == want and jacobi_davidson.deviations(x, n, sums) == [None, None]


# ---- 13

PIECES = ["\\", "#", "<", "/", "turn>", "</turn>", " </turn>\n", "###", "### User: ", " ", "é", "日", "\U0001f600", ":", "\n", "a"]
ROLE_PIECES = ["user", "assistant", "system", "", "Assistant", "a: b", "\\", ":", "a\\: ", "##</turn>", "=x", "user: "]


def test_assembly_is_plain_formatting():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(8)
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(n)]
        roles = [rng.choice(ROLE_PIECES) for _ in range(n)]
        raw = [t.encode() for t in texts]
        out, place, start, stop = chat_format.assemble(roles, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        whole = out.tobytes().decode()
        assert whole == "".join(chat_format.header(r).decode() + chat_format.quote(t) + chat_format.END for r, t in zip(roles, texts))
        assert list(chat_format.parse(whole)) == list(zip(roles, texts)) and place[-1] == len(out)
        assert [chat_format.unquote(out[a:b].tobytes().decode()) for a, b in zip(start, stop)] == texts
    for broken in ("x", "### User: a </turn>\nmore", "User: a </turn>\n"):
        with pytest.raises(ValueError):
            list(chat_format.parse(broken))


def chats(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))])
    rows = [(i, j, rng.choice([None, *ROLE_PIECES]), text()) for i in range(30) for j in rng.sample(range(-3, 1500), rng.randrange(1, 12))]
    rows += [(100, j % 1400, rng.choice(["user", "assistant"]), text()) for j in range(3000)] + [(None, 1, "user", "x"), (None, None, "assistant", "first"), (101, 5, "assistant", "y" * 300_000), (102, 0, "user", "twice"), (102, 0, "user", "twice")]
    rows += [(103, 0, "assistant", f"\\{j}") for j in range(9000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, part string")


def by_hand(rows):
    """turns of each conversation in order."""
    out = collections.defaultdict(list)
    for i, j, r, t in rows:
        out[i].append((j is not None, j or 0, (r or "").encode(), (t or "").encode()))
    return {i: [(r.decode(), t.decode()) for _, _, r, t in sorted(x)] for i, x in out.items()}


def test_conversations_come_back(spark, monkeypatch):
    rows, df = chats(spark)
    want = by_hand(rows)
    for buffer in (chat_format.BUFFER, 4000):
        monkeypatch.setattr(chat_format, "BUFFER", buffer)
        made = chat_format.format_chats(df)
        back = collections.defaultdict(list)
        for r in chat_format.read_turns(made).collect():
            back[r["conv_id"]].append((r["part"] is not None, r["part"] or 0, r["piece"], r["at"], r["role"], r["text"]))
        assert {i: [x[4:] for x in sorted(v, key=lambda x: x[:4])] for i, v in back.items()} == want
        whole = made.collect()
        assert sum(r["n_turns"] for r in whole) == len(rows)
        for r in whole:  # the mask covers the assistant's texts and nothing else
            assert [chat_format.unquote(r["formatted"][s["start"] : s["stop"]]) for s in r["loss"]] == [t for role, t in chat_format.parse(r["formatted"]) if role == "assistant"]
        for r in chat_format.read_digests(made).collect():
            turns = want[r["conv_id"]]
            said = "".join(t for role, t in turns if role == "assistant")
            assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(said))
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert r["formatted_chars"] == sum(len(chat_format.header(a).decode() + chat_format.quote(b) + chat_format.END) for a, b in turns)
    assert {r["conv_id"]: r["n"] for r in made.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}[100] >= 3
    assert chat_format.read_digests(chat_format.format_chats(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_format.format_chats(df.withColumnRenamed("conv_id", "Part2").withColumn("loss", F.lit(1)), key="loss")


def test_a_conversation_of_few_turns_is_one_row(spark):
    made = chat_format.format_chats(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    assert made.count() == made.select("conv_id").distinct().count()


# ---- mended corpus operators


def test_any_number_of_sources_is_planned_alike(spark):
    from suitestat.llm import mixing

    rng = random.Random(8)
    names = [None, "", "é", "z", "A", "\U0001f600"] + [f"s{i}" for i in range(40)]
    rows = [(i, " ".join("w" * rng.randrange(0, 40)), rng.choice(names)) for i in range(900)] + [(2000, "only one word here " * 200, "big"), (2001, None, "none"), (2002, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain, wide = ({r["doc_id"]: tuple(r) for r in mixing.mix(df, max_sources=m).collect()} for m in (1000, 3))
    assert plain == wide and len(plain) == len(rows)


def test_cut_keeps_what_stays():
    from suitestat.llm.line_hash import cut

    span = lambda a, b: {"start": a, "stop": b}
    text = "alpha\0beta  \nkeep me\ngone words"
    assert cut(text, [span(21, 31)]) == "alpha\0beta  \nkeep me"
    assert cut("  indented line tail", [span(15, 20)]) == "  indented line"
    assert cut("a\n\nb", [span(3, 4)]) == "a\n" and cut("one\ntwo\nthree", [span(0, 3), span(8, 13)]) == "two"
    assert cut("x yyy z", [span(2, 5)]) == "x  z" and cut("all", [span(0, 3)]) == "" and cut(None, [span(0, 1)]) is None and cut("a", []) == "a"


def test_names_that_differ_in_case_are_replaced(spark):
    from suitestat.llm import language_cnn, line_hash, line_join, mixing, prob_minhash, quality_rules, sentencepiece_bpe, toxicity_ftrl, warc  # noqa: F401

    df = spark.createDataFrame([(1, "some words stand here\nand some more", "en", "a", *"12345678"), (2, None, None, None, *"12345678")], "doc_id long, text string, lang string, source string, Score string, KEPT string, Taken string, N_Tokens string, Removed string, Removed_Spans string, _f_n_words string, Rule string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    made = [language_cnn.identify(df), line_hash.dedup_substrings(df), line_join.dedup_lines(df), mixing.mix(df), prob_minhash.near_duplicates(df), quality_rules.quality_rules(df, labels), sentencepiece_bpe.encode_decode(df), toxicity_ftrl.toxicity(df, labels)]
    for out in made:
        low = [c.lower() for c in out.columns]
        assert len(set(low)) == len(low) and "_f_n_words" in low and out.count() == 2


def test_other_models_are_refused():
    from suitestat.llm import sentencepiece_bpe as S

    number = lambda k, v: bytes([k << 3, v]) if k < 16 else bytes([(k << 3) & 127 | 128, k >> 4, v])
    part = lambda k, raw: bytes([k << 3 | 2, len(raw)]) + raw
    good = part(2, number(3, 2)) + part(3, number(3, 1) + number(4, 0))
    S.check_model(good)
    for bad in (part(2, number(3, 1)) + part(3, number(4, 0)), part(3, number(4, 0)), part(2, number(3, 2)) + part(3, part(2, b"map") + number(4, 0)), part(2, number(3, 2)), part(2, number(3, 2) + number(24, 1)) + part(3, number(4, 0))):
        with pytest.raises(ValueError):
            S.check_model(bad)


def test_word_counts_are_sums_over_all_tasks(spark):
    from suitestat.llm import line_join

    df = spark.createDataFrame([(f"a b c{i % 7}\na",) for i in range(500)] + [(None,), ("",)], "t string").repartition(9)
    counts = line_join.word_counts(df, "t")
    assert counts.sum() == 2000 and sorted(counts[counts > 0].tolist()) == sorted([1000, 500] + [72] * 3 + [71] * 4)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(None, "no id but words of some length here", "en", "a", 35), (900_001, None, None, None, None), (900_002, "", "en", "a", 0), (900_003, " \t\n", "de", None, 3), (900_004, "1234 5678 !!", "en", "b", 12), (900_005, "word " * 40_000, "en", "b", 200_000), (900_006, "twice the same row stands here", "en", None, 30), (900_006, "twice the same row stands here", "en", None, 30)]
    extra = spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    both = docs.unionByName(extra).withColumn("Score", F.lit("mine")).withColumn("times", F.lit("mine"))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    got = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert not got & {900_001, 900_002, 900_003, 900_004} and len(got) > 50 and set(out.columns) >= {"doc_id", "ids", "n_tokens"}
    now = P.language_id(spark, both, str(tmp_path))
    assert now.columns == both.columns and now.filter("Score <> 'mine' or times <> 'mine'").count() == 0
    both.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
