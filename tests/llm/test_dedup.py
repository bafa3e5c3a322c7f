"""Operators 5 and 6 against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrain.llm import near_dedup as N
from cuegrain.llm.common import broadcast_below
from cuegrain.llm.components import components
from cuegrain.llm.exact_dedup import _with_file_keys, drop_exact_copies, exact_dedup, frequent_digests, text_digests

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, __x int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "d", 7, 0) for i, t in rows], DOCS)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10_000, n)]


def test_exact_against_brute_force(spark):
    texts = ["a b", "a\t b", "a  b ", None, "", " ", "x" * 300_000, "x" * 300_000 + " y", "é"]
    rows = [(i, texts[i % len(texts)] if i % 4 else "hot\ncopy") for i in range(400)]
    got = {r.id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(table(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t\n\v\f\r]+", " ", t or ""), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            assert got[i] == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())


def test_frequent_digests_are_found(spark):
    found = frequent_digests(text_digests(table(spark, [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)])))
    assert [r.digest for r in found.collect()] == [hashlib.sha256(b"hot").hexdigest()]


def test_exact_edge_cases(spark):
    empty = table(spark, [])
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    got = exact_dedup(table(spark, rows))
    assert got.count() == 6 and got.where("kept").count() == 3
    kept = drop_exact_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, "a"), (False, "c"), (True, "b")]


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    rows = [(1, "a  b", "en", f"s{k % 7}", k, "d", 7, 0) for k in range(40)]
    one = {tuple(r) for r in drop_exact_copies(spark.createDataFrame(rows, DOCS)).collect()}
    two = {tuple(r) for r in drop_exact_copies(spark.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()}
    assert one == two and len(one) == 1


def test_rows_of_files_are_told_apart_by_their_place(spark, tmp_path):
    rows = [(k % 9 if k % 5 else None, f"text {k % 4}", "en", f"s{k % 3}", k, "d", 7, 0) for k in range(90)]
    df = spark.createDataFrame(rows, DOCS)
    df.repartition(5).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    keyed = _with_file_keys(read)
    assert keyed.select("__cg_row").distinct().count() == 90 and _with_file_keys(df) is None
    kept = drop_exact_copies(read)
    assert kept.columns == read.columns and {tuple(r) for r in kept.collect()} == {tuple(r) for r in drop_exact_copies(df).collect()}
    assert kept.count() == 4


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(10)], "id long, host string")
    hinted = lambda *bounds: "broadcast" in broadcast_below(df, *bounds)._jdf.queryExecution().logical().toString().lower()
    assert hinted() and hinted(10, 1000) and not hinted(9, 1000) and not hinted(10, 999)
    assert "broadcast" in broadcast_below(df.where("false"))._jdf.queryExecution().logical().toString().lower()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows():
    rows, n = [], 0
    for seed in range(6):
        base = words(seed, 120)
        for k in range(12):  # copies at all distances, some chained
            w = base.copy()
            for j in range(k):
                w[(j * 9 + seed) % 120] = f"new{seed}-{k}-{j}"
            rows.append((n := n + 1, " ".join(w)))
    shared = words(99, 40)
    for k in range(40):  # a passage that many documents share
        rows.append((n := n + 1, " ".join(words(1000 + k, 60) + shared)))
    for t in ("", None, " \n", "a b", "A  b", "a b c", "one two three four five", "ONE two three four\tfive", "x " * 30_000, "x " * 30_001 + "y"):
        rows.append((n := n + 1, t))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    want = brute_components(rows)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(table(spark, rows)).collect()}
    assert got == want


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group of like but mostly unlinked texts is compared in blocks, and no link is lost."""
    monkeypatch.setattr(N, "DENSE", 2)
    monkeypatch.setattr(N, "BLOCK_ROWS", 5)
    base, rng, rows = words(5, 150), np.random.default_rng(3), []
    for i in range(60):
        w = base.copy()
        for j in rng.choice(150, 5, replace=False):
            w[j] = f"n{i}-{j}"
        rows.append((i, " ".join(w)))
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_edge_cases(spark):
    assert N.near_duplicates(table(spark, [])).count() == 0 and N.drop_near_copies(table(spark, [])).count() == 0
    text = " ".join(words(1, 50))
    rows = [(3, text), (3, text), (None, text), (None, "alone"), (5, None)]
    got = N.near_duplicates(table(spark, rows))
    assert got.count() == 5 and got.where("kept").count() == 3
    assert {r.component_id for r in got.where("n_shingles > 1").collect()} == {3}
    kept = N.drop_near_copies(table(spark, rows))
    assert kept.count() == 3 and kept.columns == table(spark, rows).columns


def test_pruning_keeps_pairs_at_the_threshold():
    least = N.least_matches(0.75)
    rng = np.random.default_rng(0)
    matches = (rng.random((20_000, N.VERIFY)) < 0.75).cumsum(axis=1)
    assert all((matches[:, n - 1] >= m).all() for n, m in least.items())
    assert (1 - 0.75**N.ROWS) ** N.BANDS < 1e-6


def test_counts_of_intersections():
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 300, 50).astype(np.uint64)) for _ in range(4)] for _ in range(2))
    assert N._counts(a, b, columns=37).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_components_of_a_path(spark):
    n = 40
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "low long, high long")
    assert {r.node: r.component for r in components(path).collect()} == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_crc_of_ids_is_what_spark_computes(spark):
    assert spark.range(3).select(F.crc32(F.col("id").cast("string"))).first()[0] == zlib.crc32(b"0")


@pytest.mark.parametrize("a,b", [("A b c d e", "a B c d e"), ("a b c", "a\nb\rc")])
def test_shingles_fold_case_and_space(a, b):
    assert N.shingles(a).tolist() == N.shingles(b).tolist()


def test_only_ascii_letters_are_folded():
    assert N.shingles("É").tolist() != N.shingles("é").tolist()
