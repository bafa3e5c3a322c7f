"""Operators 11 to 13 against brute force, round trips and held-out spans."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrain.llm import hard_negatives as H
from cuegrain.llm import personal_data as P
from cuegrain.llm import queries as Q
from cuegrain.llm.fill_middle import fill_in_middle, restore_text

DATA = Path("/root/testdata/sf0.001")


# ---------------------------------------------------------------- 11: personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def plain_base(text):
    n = lambda m: sum(c.isdigit() for c in m[0])
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= n(m) <= 19 and plain_luhn(m[0])]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= n(m) <= 15]


def test_base_spans_against_plain_patterns():
    rng = np.random.default_rng(3)
    pieces = ["a", "b.c", "@", "@@", ".", "..", "-", "+", "1", "25", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", " ", "(", ")", "é", "\n", "x@y.z", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "+1 (555) 010-0000", "+49", "@b.c.d.", "%", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, int(rng.integers(0, 14))))
        assert P.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 300_000, "+1" * 200_000, "a@" * 200_000, "+1" + "(" * 300_000, "a@b" + ".c" * 200_000])
def test_base_spans_take_linear_time(text):
    assert len(P.base_spans(text)) <= 100_000


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    model = P.Tagger(*[rng.normal(0, 0.3, s) for s in ((2, 4 * P.HIDDEN, P.CLASSES), (2, 4 * P.HIDDEN, P.HIDDEN), (P.TAGS, 2 * P.HIDDEN), (P.TAGS,), (P.TAGS, P.TAGS))])
    x, y = rng.integers(0, P.CLASSES, (9, 4)).astype(np.uint8), rng.integers(0, P.TAGS, (9, 4)).astype(np.uint8)
    _, slopes = P.gradients(model, x, y)
    for values, slope in zip(model.parts(), slopes, strict=True):
        i = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        values[i] += 0.01
        above = P.gradients(model, x, y)[0]
        values[i] -= 0.02
        below = P.gradients(model, x, y)[0]
        values[i] += 0.01
        assert abs((above - below) / 0.02 - slope[i]) < 1e-3


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    model = P.Tagger(*[rng.normal(0, 0.5, s).astype(np.float32) for s in ((2, 4 * P.HIDDEN, P.CLASSES), (2, 4 * P.HIDDEN, P.HIDDEN), (P.TAGS, 2 * P.HIDDEN), (P.TAGS,), (P.TAGS, P.TAGS))])
    x = rng.integers(0, P.CLASSES, (5, 3)).astype(np.uint8)
    scores = P.emissions(model, x)
    paths = np.stack(np.meshgrid(*[range(P.TAGS)] * 5, indexing="ij"), -1).reshape(-1, 5)
    for lane in range(3):
        total = sum(scores[t, paths[:, t], lane] for t in range(5)) + sum(model.moves[paths[:, t], paths[:, t + 1]] for t in range(4))
        assert P.decode(model, x)[:, lane].tolist() == paths[total.argmax()].tolist()


@pytest.fixture(scope="module")
def tagger():
    return P.default_model()


def test_held_out_spans(tagger):
    """Texts of another seed: of the spans in a valid form, nine in ten are found by the model alone, and what it finds is right."""
    held = P.labelled_texts(150, seed=77)
    found = [set(P.added_spans(tagger, [text], [[]])[0]) for text, _ in held]
    gold = [{s for s in spans if P.valid(s[0], text[s[1] : s[2]])} for text, spans in held]
    hits = sum(len(f & g) for f, g in zip(found, gold, strict=True))
    assert hits >= 0.85 * sum(map(len, gold))
    assert hits >= 0.95 * sum(map(len, found))


def test_skipped_windows_cannot_add(tagger):
    texts = [t for t, _ in P.labelled_texts(60, seed=8)] + ["write to anna at example dot org or to lee (AT) mail.example.net now", "x" * 1000 + " 192[.]0[.]2[.]7 " + "y" * 1000, ""]
    base = [P.base_spans(t) for t in texts]
    assert P.added_spans(tagger, texts, base) == P.added_spans(tagger, texts, base, every=True)


def test_reconciled_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        offered = {(int(rng.integers(4)), s := int(rng.integers(30)), s + int(rng.integers(1, 12))): int(rng.integers(1, 20)) for _ in range(7)}
        base = [(0, b := int(rng.integers(30)), b + 3)] if rng.random() < 0.5 else []
        apart = lambda x: all(p[2] <= q[1] or q[2] <= p[1] for i, p in enumerate(x) for q in x[:i])
        best = max(sum(offered[s] for s in some) for k in range(1 << len(offered)) if apart([*(some := [s for i, s in enumerate(offered) if k >> i & 1]), *base]))
        got = P.reconciled(offered, base)
        assert sum(offered[s] for s in got) == best and apart([*got, *base])


def test_personal_data_query(spark):
    found = {r.doc_id: r for r in Q.op11_personal_data(spark, str(DATA)).collect()}
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert len(found) == len(docs)
    for key, text in docs:
        base, r = plain_base(text or ""), found[key]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        joined = [f"{P.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


def test_personal_data_edge_cases(spark):
    spelt = "mail me: anna.berg (at) example [dot] org, please"
    rows = [(1, None), (2, ""), (3, "4111 1111 1111 1111"), (3, "4111 1111 1111 1111"), (None, "a@b.cd"), (4, "é" * 70_000 + " a@b.cd"), (5, spelt)]
    df = spark.createDataFrame([(i, t, "s", [1]) for i, t in rows], "doc_id long, text string, spans string, base array<int>")
    found = Counter((r.id, tuple(map(tuple, r.base)), tuple(map(tuple, r.spans))) for r in P.personal_data(df).collect())
    card, mail, late = (("card", 0, 19),), (("email", 0, 6),), (("email", 70_001, 70_007),)
    added = (("email", 9, 41),)
    assert spelt[9:41] == "anna.berg (at) example [dot] org"
    assert found == {(1, (), ()): 1, (2, (), ()): 1, (3, card, card): 2, (None, mail, mail): 1, (4, late, late): 1, (5, (), added): 1}
    assert P.personal_data(df.limit(0)).collect() == []


# ---------------------------------------------------------------- 12: fill in the middle

def plain_fill(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_slices(spark):
    texts = [None, "", "a", "abc", "a b", "<P>x", "x<", "é😀 yo\n\r\nzz $1 \\E\\  x", "<S ><M", "ab 1" * 150_000, "a" * 500_000, "<" * 300 + "P", "x\x00y"]
    rows = [(i, t) for i in range(-3, 30) for t in texts if t is None or len(t) < 10_000 or i % 10 == 0] + [(None, "no id"), (7, "a b"), (7, "a b")]
    df = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    got = fill_in_middle(df).withColumn("back", restore_text(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain_fill(*r) for r in rows)
    assert Counter((r.id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).collect() == []


# ---------------------------------------------------------------- 13: hard negatives

def plain_negatives(rows):
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, y, q) in enumerate(ok):
        if i is None or i % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, r[2], strict=False)), r[0] is None, r[0] or 0, m) for m, r in enumerate(ok) if m != n)
        for p in [x for x in scores if ok[x[3]][1] == y][:5]:
            near = [x for x in scores if ok[x[3]][1] != y and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:5]
            out += [(i, ok[p[3]][0], k, ok[x[3]][0], -p[0], -x[0]) for k, x in enumerate(near, 1)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 0.5, 3) for i, v, y in rows], "vec_id long, embedding array<double>, label int, norm double, row int")


@pytest.mark.parametrize("tiles", [None, (7, 50, 20, 3)])
@pytest.mark.parametrize("whole", [False, True])
def test_hard_negatives_against_brute_force(spark, monkeypatch, tiles, whole):
    if tiles:
        for name, value in zip(("ANCHOR_ROWS", "LANE_ROWS", "ROW_TILE", "ANCHOR_TILE"), tiles, strict=True):
            monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 4))
    x = np.round(x) / 4 if whole else x  # ties, and equal vectors
    rows = [(None if i % 37 == 36 else i * 25, x[i].tolist(), int(rng.integers(3)) if i % 3 else 0) for i in range(260)]
    rows[3:13] = [(300, None, 1), (100, [1.0, None], 1), (200, [float("nan")] * 3, 1), (400, [], 1), (500, [1.0], 2), (600, [3.0, 0.0, 0.0, 1.0, 5.0, 6.0], 0), (700, [0.0] * 4, None), (800, [0.0] * 4, 2), (900, [1e6] * 4, 1), (25, [1e6 - 0.5] * 4, 2)]
    rows += [(50, [1e6] * 4, 1), (75, [1e6 + 0.25, 1e6, 1e6, 1e6], 1), (1000, [float("inf"), 1.0], 0)] + rows[40:44] * 2
    got = Counter(tuple(r) for r in H.hard_negatives(vectors(spark, rows)).collect())
    assert got == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert H.hard_negatives(vectors(spark, [])).collect() == []
    assert H.hard_negatives(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []
    assert H.hard_negatives(vectors(spark, [(100, [1.0], 1)])).collect() == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 16))
    rows = np.floor(256 * (base[rng.integers(0, 3, 400)] + rng.normal(0, 0.05, (400, 16))))
    refs = H.reference_directions(rows[:50])
    angles, norms, scores = H.angles_to(rows, refs), np.linalg.norm(rows, axis=1), rows @ rows.T
    least, greatest = H.score_bounds(angles, norms, angles, norms)
    assert (least <= scores).all() and (scores <= greatest).all()
    assert (greatest[scores < 0.5 * norms[:, None] * norms] < 0.8 * np.outer(norms, norms)[scores < 0.5 * norms[:, None] * norms]).mean() > 0.9  # and they are tight in clusters


def test_scores_beyond_doubles_are_exact():
    a, r = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**62, 2.0**62]])
    assert H.integer_scores(a, r, 2.0**60).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, H.LONG_MAX]]


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_hard_negatives"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = Q.queries()[name](spark, str(DATA))
    found = con.execute(Q.oracle_sql()[name])
    assert [x[0] for x in found.description] == df.columns
    assert sorted(found.fetchall(), key=str) == sorted(map(tuple, df.collect()), key=str)
