"""Periodic runs, WARC archives and whitening."""

import glob
import gzip
import hashlib
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cases import ODD, SMALL, WORD, frame, odd, small_docs, texts_of
from shortlist.llm import periodic_runs, queries, warc, whitening


# -- periodic runs ---------------------------------------------------------

def brute_runs(words, least=12):
    """Every period and start tried."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            smaller = (r for r in range(1, q) if words[i:j + q - r] == words[i + r:j + q])
            if j > i and n >= max(least, 2 * q) and next(smaller, None) is None:
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 4])
def test_automaton_finds_the_runs_of_random_words(letters):
    rng = random.Random(letters)
    for _ in range(400):
        words = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.4:
            words += (words[:rng.randrange(1, 9)] or [0]) * rng.randrange(1, 9) + words[:5]
        assert periodic_runs.runs_of(words) == brute_runs(words)


def test_batches_of_texts_equal_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 8)):
            kinds = rng.choice([1, 2, 3, 30])
            words = [rng.choice("aAbé漢")[0] + str(rng.randrange(kinds)) for _ in range(rng.randrange(80))]
            if rng.random() < 0.5:
                words += words[:rng.randrange(1, 9)] * rng.randrange(1, 9) + ["z"] + words
            docs.append(words)
        got = periodic_runs.batch_runs(pa.array([" \n".join(w) for w in docs]), list(range(len(docs))))
        for words, (runs, text) in zip(docs, got):
            assert runs == brute_runs(words)
            assert text == collapsed(words, runs)


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digest(doc_id, words):
    words = looped(doc_id, words)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_periodic_query_equals_brute_force(spark):
    out = queries.op12_periodic_runs(spark, SMALL).collect()
    docs = [(i, t) for i, t in texts_of(small_docs(spark)) if len(t or "") < 6000]
    got = {r["doc_id"]: tuple(r)[1:] for r in out}
    assert len(out) == small_docs(spark).count() and sum(r["n_runs"] > 0 for r in out) > 10
    for i, t in docs:
        assert got[i] == digest(i, WORD.findall(t or "")), i


def test_periodic_runs_of_odd_rows(spark):
    out = periodic_runs.periodic_runs(odd(spark)).collect()
    assert len(out) == len(ODD)
    one = {r["doc_id"]: r for r in out}
    assert all(one[i]["runs"] == [] and one[i]["collapsed"] == "" for i in (3, 4, 5))
    assert [tuple(r) for r in one[8]["runs"]] == [(0, 4000, 1)] and one[8]["collapsed"] == "word end"
    assert [tuple(r) for r in one[10]["runs"]] == [(0, 120, 4)] and one[10]["collapsed"] == "é ß 漢字 😀"
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


# -- WARC ------------------------------------------------------------------

PAGE = "page_id bigint, url string, html string, payload string, archive string, `a.b` string"
LONG = "é漢😀" * 40
PAGES = [(5, "http://a/x y\r\nz", LONG, "p", "q", "r"), (2, "http://b", LONG, None, None, None),
         (None, None, LONG, "", "", ""), (9, None, LONG, "1", "2", "3"), (2, "http://b2", LONG, "1", "2", "3"),
         (3, "u", None, None, None, None), (4, "u", "", None, None, None), (6, "u", "short", None, None, None),
         (7, "u", "short", None, None, None), (8, "u", "body\r\n\r\nWARC/1.1\r\n\r\n" * 9 + "\r\n", None, None, None),
         (10, "u", "x" * 3_000_000, None, None, None), (11, "u", "y" * 99, None, None, None),
         (12, "u", "y" * 99, None, None, None), (13, "u", "z" * 100, None, None, None),
         (14, "u", "z" * 100, None, None, None)]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="shortlist-test-warc-")


def test_archives_round_trip(spark, folder):
    rows = warc.round_trip(frame(spark, PAGES, PAGE).repartition(3), folder, payloads=True).collect()
    assert len(rows) == len(PAGES)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    again = {5: 2, None: 2, 9: 2, 14: 13}
    assert kinds == sorted(((p[0], "revisit" if p[0] in again else "response", again.get(p[0])) for p in PAGES), key=str)
    for r in rows:
        text = next(p[2] or "" for p in PAGES if p[0] == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()),
                                                             hashlib.sha256(text.encode()).hexdigest())
        assert r["payload"] == (text if r["record_type"] == "response" else None)
    assert {r["url"] for r in rows if r["page_id"] == 5} == {"http://a/x%20y%0D%0Az"}


def test_monolithic_files_become_members_with_an_index(spark, folder):
    warc.write_archives(frame(spark, PAGES, PAGE).coalesce(1), f"{folder}/m")
    (path,) = glob.glob(f"{folder}/m/*.gz")
    raw = open(path, "rb").read()
    whole = gzip.decompress(raw)
    assert warc.member_size(memoryview(raw)) == len(raw) and whole.count(b"WARC-Record-ID") == len(PAGES)
    warc.normalise(spark, f"{folder}/m", f"{folder}/n")
    (path,) = glob.glob(f"{folder}/n/archive=*/part=records/part-*")
    packed = open(path, "rb").read()
    assert gzip.decompress(packed) == whole
    index = warc.read_index(spark, f"{folder}/n")
    for r in index.collect():
        one = gzip.decompress(packed[r["offset"]:r["offset"] + r["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and one in whole
    some = warc.fetch(spark, f"{folder}/n", index.filter("page in ('5', '6', '8')")).collect()
    assert {(r["page_id"], r["payload"]) for r in some} == {(5, None), (6, "short"), (8, PAGES[9][2])}


def test_members_are_normalised_again_to_the_same(spark, folder):
    warc.write_archives(frame(spark, PAGES, PAGE).coalesce(1), f"{folder}/m")
    raw = open(glob.glob(f"{folder}/m/*.gz")[0], "rb").read()
    found = [r for _, r in warc.records(raw)]
    assert [r for _, r in warc.records(b"".join(map(warc.member, found)))] == found
    for bad in (raw[:-9], raw[:len(raw) // 2], gzip.compress(gzip.decompress(raw)[:-4]),
                gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(bad))


def test_a_changed_payload_is_refused(spark, folder):
    warc.write_archives(frame(spark, PAGES[7:8], PAGE), f"{folder}/m")
    raw = gzip.decompress(open(glob.glob(f"{folder}/m/*.gz")[0], "rb").read())
    with pytest.raises(ValueError, match="differs from its digest"):
        warc.one_record(memoryview(gzip.compress(raw.replace(b"short", b"shirt"))))


def test_no_pages_give_no_records(spark, folder):
    assert warc.round_trip(frame(spark, [], PAGE), folder).collect() == []


def test_repeated_digests_beyond_the_broadcast(spark, monkeypatch):
    pages = frame(spark, PAGES * 2, PAGE)
    few = sorted(map(tuple, warc.with_verdicts(pages).select("page_id", "refers_to").collect()), key=str)
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, warc.with_verdicts(pages).select("page_id", "refers_to").collect()), key=str) == few
    monkeypatch.setattr(warc, "HOT_SHARE", 1)
    assert sorted(map(tuple, warc.with_verdicts(pages).select("page_id", "refers_to").collect()), key=str) == few


# -- whitening -------------------------------------------------------------

def moments(rows):
    x = np.floor(1024 * np.array(rows, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, s, centred, e[::-1], v[:, ::-1]


def test_whitening_query_equals_dense_decomposition(spark):
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    x, s, centred, e, v = moments(list(given.values()))
    n = len(x)
    out = queries.op11_whitening(spark, SMALL).collect()
    assert len(out) == 8 * n and {r["n"] for r in out} == {n}
    got = np.zeros((n, 8))
    place = {i: k for k, i in enumerate(given)}
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s)) for i, k in place.items()}
    for r in out:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == exact[r["vec_id"]]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-12)
    want = centred @ v[:, :8] / np.sqrt(e[:8])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-9
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-11


@pytest.mark.parametrize("seed", range(12))
def test_jacobi_davidson(seed):
    rng = np.random.default_rng(seed)
    dims, rank = int(rng.integers(2, 60)), int(rng.integers(1, 30))
    a = rng.standard_normal((dims, rank)) * 10.0 ** rng.integers(-3, 4, rank)
    if seed % 3 == 0:  # equal eigenvalues
        a = np.repeat(np.eye(dims), 2, axis=1)
    cov = a @ a.T
    values, vectors = whitening.jacobi_davidson(lambda t: cov @ t, dims, 8)
    want = np.linalg.eigvalsh(cov)[::-1][:8]
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(cov @ vectors - vectors * values, axis=0).max() <= 1e-13 * want[0]


VEC = "vec_id bigint, embedding array<float>, whitened string, n int, `a.b` string"


def vectors(spark, rows):
    return frame(spark, [(i, v, "w", 1, None) for i, v in rows], VEC).repartition(3)


def test_whitening_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    good += [(None, good[0][1]), (7, good[7][1]), (7, good[7][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5),
           (104, [float("inf")] + [0.0] * 4), (105, [1e30] * 5), (106, [1.0] * 4)]
    rows = whitening.whiten(vectors(spark, good + bad)).collect()
    assert sorted(str(r["vec_id"]) for r in rows) == sorted(str(i) for i, _ in good)
    assert {len(r["whitened"]) for r in rows} == {5} and {r["n"] for r in rows} == {43}
    x = np.array([r["whitened"] for r in rows])
    assert np.abs(x.T @ x / 43 - np.eye(5)).max() < 1e-12 and rows[0]["identity_error"] < 1e-12
    assert sum(rows[0]["explained"]) == pytest.approx(1)


@pytest.mark.parametrize("rows,components", [([], None), ([(1, None)], None), ([(1, [1.0, 2.0])], 0),
                                             ([(1, [1.0, 2.0])] * 5, 0), ([(1, [1.0, 2.0]), (2, [1.0, 3.0])], 1)])
def test_whitening_of_few_rows(spark, rows, components):
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == (0 if components is None else len(rows))
    assert all(len(r["whitened"]) == len(r["explained"]) == components for r in got)


def test_deviations_are_exact_beyond_longs(spark):
    rows = [(i, [1e9 * i, -1e9 * i]) for i in range(30)]
    x, s, *_ = moments([[np.float32(a) for a in v] for _, v in rows])
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got == {i: sum((30 * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)) for i in range(30)}
