import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import confusables as C
from quillmill.llm import encoding as T
from quillmill.llm import joins as J
from quillmill.llm import packing as P
from quillmill.llm import repetition as R
from quillmill.llm import splitting as S


# --- encoding -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZER_DIR}/{T.TOKENIZER}.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encoding_is_exact(theirs):
    e = T.encoder()
    r = random.Random(4)
    alphabet = "abcdefghilmnorstuv  \n\t'0129é中文😀.,-_ß​́"
    cases = ["", " ", "a" * 3000, " " * 500, "abab" * 700, "<|endoftext|>", "don't we'll", "İß\x00", "=-" * 900]
    cases += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    for s in cases:
        ids = e.encode(s)
        assert ids == theirs(s), s
        assert T.decode_ids(ids) == s


def test_encoding_of_null_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hi there", 0), (3, "Hi there", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in T.encode_corpus(d).collect())
    assert got == [(1, []), (2, []), (3, T.encoder().encode("Hi there"))] + [(3, T.encoder().encode("Hi there"))]
    assert T.encode_corpus(d.limit(0)).count() == 0


# --- look-alikes ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["fiɡht", "dօcument", "Ｆull width", "zero​width", "soft­hyphen", "no break", "Café", "first‐order", "oﬃce", "pаypal", "Αlpha test word", "Устoйчивость", "thin space", "ΗΟW FΙΝE"])
def test_stand_ins(text):
    assert C.holds_stand_in(text)


@pytest.mark.parametrize("text", [None, "", "plain", "Café – “quoted” Øre", "On the β-cell of α", "Устойчивость и почва", "細胞の研究", "能，法：ふ　り", "line\nbreak\tand  spaces", "Größe", "x² ± 3 µm … ™"])
def test_ordinary(text):
    assert not C.holds_stand_in(text)


def test_skeletons():
    assert C.skeleton("Ｐａуpаl") == C.skeleton("Paypal") and C.skeleton("rnodern") == C.skeleton("modern") and C.skeleton(None) is None
    assert C.consistent("Ｆіеld‑sсаlе ﬁeld") == "Field-scale field" and C.consistent("Устoйчивость") == "Устойчивость" and C.consistent(None) is None


def test_public_table(spark):
    t = C.look_alikes(spark)
    assert len(t) > 5000 and t["а"] == "a" and t["m"] == "rn" and C.skeleton("Ｐауpаl ｍodern", t) == C.skeleton("Paypal modern", t)
    assert C.skeleton("ᏟᎪᏢ", t) == C.skeleton("CAP", t) and C.skeleton("", t) == ""


def test_stand_ins_by_groups(spark):
    long = "x" * 30_000 + "\u200b"
    rows = [("f", 1, "Cope"), ("f", 2, "Cope"), ("f", 3, "Cope"), ("f", 4, "Cope"), ("f", 5, "Соре"), ("f", 6, "Сорт"), ("f", 7, "Соре и почва"), ("f", 8, "Cafe\u0301"), ("f", 9, "Café"), ("f", 10, None), ("f", 11, ""), ("f", 12, long), ("f", 12, long), ("f", 13, "a\u00a0b"), ("f", 14, "a  b\tc\nd – “x”"), ("g", 1, "ｔest"), ("f", 15, "А study of sоil"), ("f", 16, "uniforrn 0f"), ("f", 17, "Part \u0399")]
    v = spark.createDataFrame([(*r, 0) for r in rows], "field string, row_id bigint, value string, n int")
    got = sorted((r.field, r.row_id) for r in C.stand_ins(v).collect())
    # 5: all in look-alikes, and its group's plain spelling is four times as common; in 7 the other words are Cyrillic too.
    assert got == [("f", 5), ("f", 8), ("f", 12), ("f", 13), ("f", 15), ("f", 17), ("g", 1)]
    assert C.stand_ins(v.limit(0)).count() == 0


def test_hot_and_many_keys(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS row_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k")
    keys = spark.createDataFrame([("hot",), ("k7",)], "k string")
    few = J.having(rows, keys, ["k"], "row_id").count()
    monkeypatch.setattr(J, "FEW_KEYS", 0)
    assert J.having(rows, keys, ["k"], "row_id").count() == few == rows.filter("k IN ('hot', 'k7')").count()


def test_misread_words(spark):
    rows = [("f", i, "thermal kernel particle study") for i in range(40)] + [("f", 100, "therrnal study"), ("f", 101, "kemel study"), ("f", 102, "partide study"), ("f", 103, "st0dy of kernel"), ("f", 104, "Fie1d"), ("f", 105, None), ("f", 106, ""), ("f", 107, "10th H2O 1st")]
    v = spark.createDataFrame(rows, "field string, row_id bigint, value string")
    assert {r.row_id for r in C.misread(v).collect()} == {100, 101, 102, 103, 104}
    assert C.misread(v.limit(0)).count() == 0


# --- splitting ------------------------------------------------------------------------------------------------------


def greedy(natural, n, limit, overlap):
    out, at = [0], 0
    while at < n:
        start = max(at - overlap, 0) if at else 0
        far = min(start + limit, n)
        fit = [b for b in natural if max(at, start + overlap) < b <= far] if far < n else [n]
        at = max(fit) if fit else far
        out.append(at)
    return out


def test_cuts_equal_the_greedy_walk():
    r = random.Random(2)
    for _ in range(400):
        n, limit = r.randrange(1, 300), r.randrange(2, 50)
        overlap = r.randrange(0, limit)
        natural = sorted(r.sample(range(1, n), min(n - 1, r.randrange(0, 20))))
        if n <= limit:
            continue
        assert S.cuts(np.array(natural, dtype=np.int64), n, limit, overlap).tolist() == greedy(natural, n, limit, overlap)


def test_pieces_cover_the_text(spark):
    text = " ".join(f"w{i}" + ("." if i % 37 == 0 else "") for i in range(1000)) + "\nlast line"
    got = S.pieces_of(text, 200, 40)
    assert got[0][0] == 0 and got[-1][1] == 1002 and all(b - a <= 200 for a, b, _, _ in got) and all(y[0] == x[1] - 40 for x, y in zip(got, got[1:], strict=False))
    assert S.pieces_of("", 5, 1) == [] and S.pieces_of(" 　\n", 5, 1) == [] and len(S.pieces_of("a b\x1cc d", 3, 0)) == 1
    d = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, 5), (3, "", 5), (4, "x " * 200, 5), (5, "x " * 201, 5)], "chunk_id bigint, text string, piece int")
    p = S.split_oversized(d, ["chunk_id"])
    assert {r.chunk_id for r in p.filter("piece = 1").collect()} == {1, 5} and p.filter("chunk_id = 4").count() == 1 and p.filter("chunk_id IN (2, 3)").count() == 0
    assert S.split_oversized(d.limit(0), ["chunk_id"]).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(d, ["chunk_id"], limit=10, overlap=10)


def test_huge_text_is_cut():
    assert len(S.pieces_of("word " * 300_000, 200, 40)) == 1 + -(-(300_000 - 200) // 160)


# --- packing --------------------------------------------------------------------------------------------------------


def test_plan_holds_everything_and_wastes_little():
    r = np.random.default_rng(1)
    for n in (1, 50, 5000):
        sizes = np.clip(r.lognormal(6, 0.8, n).astype(int), 1, 2048)
        u, c = np.unique(sizes, return_counts=True)
        h = dict(zip(u.tolist(), c.tolist(), strict=True))
        plan = P.configuration_plan(h, 2048)
        held: dict = {}
        for f, t in zip(plan.fillings, plan.times, strict=True):
            assert sum(l * k for l, k in f.items()) <= 2048
            for l, k in f.items():
                held[l] = held.get(l, 0) + k * t
        assert held == h
        if n == 5000:
            assert plan.containers * 2048 <= 1.01 * sizes.sum() + 2048
    assert P.configuration_plan({}, 10).containers == 0


def test_greatest_worth_is_exact():
    r = random.Random(5)
    for _ in range(40):
        worth = np.full(21, -np.inf)
        for l in r.sample(range(1, 21), 5):
            worth[l] = r.random()
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1]] + [worth[l] + best[c - l] for l in range(1, c + 1)])
        assert np.allclose(P.greatest_worth(worth, 20), best)


def test_program_is_near_its_bound_and_survives_rounding():
    # Many items over a third of the capacity: pairs that fit must be found, and some lengths stay alone.
    r = np.random.default_rng(3)
    h = {int(l): int(n) for l, n in zip(*np.unique(r.integers(35, 71, 4000), return_counts=True), strict=True)}
    s = P.linear_program(h, 100, runs=3)
    held = sum(l * n for l, n in h.items()) / 100
    assert s.bound >= held and sum(s.use.values()) <= 1.02 * s.bound
    plan, rest = P.rounded(s, h)
    assert plan.containers <= 1.02 * s.bound and sum(rest.values()) <= 0.01 * sum(h.values())
    got: dict = dict(rest)
    for f, t in zip(plan.fillings, plan.times, strict=True):
        assert sum(l * k for l, k in f.items()) <= 100
        for l, k in f.items():
            got[l] = got.get(l, 0) + k * t
    assert {l: n for l, n in got.items() if n} == h
    assert P.best_fit(rest, 100, plan).containers <= 1.02 * s.bound + 1


def test_pack(spark):
    sizes = [0, None, 5, 5, 5, 10, 10, 25, 3, 7]
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n int").repartition(3)
    rows = P.pack(d, "doc_id", "n", 10).collect()
    room: dict = {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r.size
    assert max(room.values()) <= 10 and len(room) == 7 and sorted(room) == list(range(7))
    parts = sorted((r.piece, r.start, r.size) for r in rows if r.doc_id == 7)
    assert parts == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and {r.doc_id for r in rows} == set(range(2, 10))
    assert P.pack(d.limit(0), "doc_id", "n", 10).count() == 0


# --- repetition -----------------------------------------------------------------------------------------------------


def brute(units, run):
    n, marked = len(units), set()
    for i in range(n - run + 1):
        if any(units[j : j + run] == units[i : i + run] for j in range(i)):
            marked.update(range(i, i + run))
    return len(marked) / n if n else 0.0


def test_share_equals_brute_force():
    r = random.Random(7)
    for _ in range(400):
        units = [r.choice("abcd") for _ in range(r.randrange(0, 60))]
        for run in (1, 3, 5, 10):
            assert abs(R.repeated_share(units, run) - brute(units, run)) < 1e-12


def test_repetition_rows(spark):
    d = spark.createDataFrame([(1, "one two three four five " * 6, "x"), (2, None, "x"), (3, "", "x"), (4, "12 34 ...", "x"), (5, "能海河源模风体海究系河" * 4, "x"), (6, "a b c d e f g", "x")], "doc_id bigint, text string, share string")
    got = {r.doc_id: r for r in R.repetition(d).collect()}
    assert got[1].share > 0.8 and got[5].by_letter and got[5].share > 0.7 and got[2].share == got[3].share == got[4].share == got[6].share == 0
    j = {r.doc_id: r for r in R.divergence(d.withColumn("lang", F.lit("en"))).collect()}
    assert j[2].js_words is None and 0 <= j[1].js_classes <= 1 and R.divergence(d.withColumn("lang", F.lit("en")).limit(0)).count() == 0


def test_long_text_repetition():
    units = [str(i) for i in range(100_000)] * 2
    assert abs(R.repeated_share(units, 5) - 0.5) < 1e-3
