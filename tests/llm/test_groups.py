"""Operators that compare documents, mixing, packing and the pipeline."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from cases import ODD, SMALL, WORD, components, frame, odd, small_docs, texts_of
from shortlist.llm import exact_dedup, minhash_dedup, mixing, packing, queries, suffix_dedup


def exact_brute(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (i, min(m)[1], len(m), i == min(m)[1], hashlib.sha256(n.encode()).hexdigest())
            for n, m in groups.items() for _, i in m}


@pytest.mark.parametrize("bound", [exact_dedup.BROADCAST_BYTES, 0])
def test_exact_dedup_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", bound)
    out = {r["doc_id"]: tuple(r) for r in queries.op2_exact_dedup(spark, SMALL).collect()}
    assert out == exact_brute(texts_of(small_docs(spark)))


def test_exact_dedup_odd_rows(spark):
    out = exact_dedup.duplicate_groups(odd(spark)).collect()
    assert len(out) == len(ODD)
    by = defaultdict(list)
    for r in out:
        by[r["text_sha256"]].append(r)
    assert all(sum(r["kept"] for r in m) == 1 and {r["group_size"] for r in m} == {len(m)} for m in by.values())
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and {r["keep_id"] for r in empty} == {5}
    alpha = next(m for m in by.values() if {r["doc_id"] for r in m} == {None, 1, 2})
    assert {r["keep_id"] for r in alpha} == {2}
    kept = exact_dedup.exact_dedup(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(
        (i, t) for i, t in {(2, ODD[1][1]), (5, " \t\n "), (6, "one two"), (7, "ONE two"), (8, ODD[10][1]),
                            (9, "x" * 30000), (10, ODD[12][1])})
    assert exact_dedup.duplicate_groups(frame(spark, [])).count() == 0
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def variants(n, seed, words=60, change=4):
    """Near copies of one text, some changed in a few places."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_near_dedup_equals_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash_dedup, "STAR_ROUNDS", rounds)
    texts = [t for s in range(6) for t in variants(25, s)]
    rows = [(i * 7 % 1000, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(2000, "a b", "en", "s", 0), (2001, "A  b", "en", "s", 0), (2002, "a b c", "en", "s", 0),
             (2003, "", "en", "s", 0), (2004, None, None, None, None), (2005, " \n", "en", "s", 0)]
    df = frame(spark, rows).repartition(4)
    want, sets = components([(r[0], r[1]) for r in rows])
    for i in (2003, 2004, 2005):
        want[i] = i
    out = {r["doc_id"]: r for r in minhash_dedup.near_groups(df).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in out.items())


def crowd(seed, n=110, words=70):
    """Copies around the threshold: few other words, deletions, insertions and
    a passage that unlike texts share."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(w))
            w[at:at + rng.choice([0, 1, 1, 1, 2])] = [f"x{rng.randint(0, 5)}"] * rng.choice([0, 1, 1, 1, 2])
        out.append(" ".join(w if k % 3 else [f"y{seed}{k}{i}" for i in range(rng.randint(5, 60))] + w[:rng.randint(20, 60)]))
    return out


@pytest.mark.parametrize("rounds,members", [(0, 1), (1, 10)])
def test_crowded_buckets_equal_brute_force(spark, monkeypatch, rounds, members):
    monkeypatch.setattr(minhash_dedup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(minhash_dedup, "CROWD", members)
    rows = [(i * 7 % 1000, t, "en", "s", 0) for i, t in enumerate(t for s in range(3) for t in crowd(s + 10 * rounds))]
    want, _ = components([(r[0], r[1]) for r in rows])
    assert 20 < len(set(want.values())) < len(rows) - 20
    out = minhash_dedup.near_groups(frame(spark, rows).repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_components_of_stars_take_no_round(spark, monkeypatch):
    from shortlist.llm import components as cc
    rounds = []
    monkeypatch.setattr(cc, "_large_star", lambda links, f=cc._large_star: rounds.append(1) or f(links))
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 3), (9, 3)], "a bigint, b bigint")
    assert sorted(map(tuple, cc.connected_components(stars).collect())) == [(5, 1), (7, 1), (9, 3)]
    assert not rounds
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "a bigint, b bigint")
    assert sorted(map(tuple, cc.connected_components(chain).collect())) == [(i, 0) for i in range(1, 10)]
    assert 0 < len(rounds) <= 6


def test_a_round_of_components_reads_its_links_once_a_step(spark):
    from shortlist.llm import components as cc
    links = spark.createDataFrame([(i + 1, i) for i in range(9)], "a bigint, b bigint")
    plan = cc._small_star(cc._large_star(links))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    assert sum(line.strip(" :+-").startswith("Aggregate") for line in plan.splitlines()) == 4


def test_crowded_and_other_buckets_are_compared_together(spark, monkeypatch):
    compared, confirm = [], minhash_dedup.Found.confirm
    monkeypatch.setattr(minhash_dedup.Found, "confirm", lambda self, pairs: compared.append(1) or confirm(self, pairs))
    monkeypatch.setattr(minhash_dedup, "CROWD", 12)
    texts = [t for s in range(2) for t in crowd(s + 20)] + [t for s in range(12) for t in crowd(s + 30, 9)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = minhash_dedup.near_groups(frame(spark, rows).repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == components([(r[0], r[1]) for r in rows])[0]
    assert len(compared) == 3  # with the first centres, then the crowds' centres and other buckets, then departures


def test_all_rows_of_the_first_id_are_kept(spark):
    rows = [(6, "a b c d e f", "en", "s", 0), (6, "a b c d e f", "en", "s", 0), (7, "a b c d e f", "en", "s", 0)]
    out = minhash_dedup.near_groups(frame(spark, rows)).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, out)) == [(6, 6, True), (6, 6, True), (7, 6, False)]
    assert minhash_dedup.near_dedup(frame(spark, rows)).count() == 1


def test_near_dedup_query_equals_brute_force(spark):
    docs = texts_of(small_docs(spark))
    want, sets = components(docs)
    out = queries.op4_minhash_dedup(spark, SMALL).collect()
    assert {tuple(r) for r in out} == {(i, len(sets[i]), want[i], want[i] == i) for i, _ in docs}


def test_near_dedup_chain_and_odd_rows(spark):
    """A chain whose ends are not similar is one component; repeated ids."""
    words = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(words[8 * i:8 * i + 100]), "en", "s", 0) for i in range(25)]
    out = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_groups(frame(spark, rows)).collect()}
    assert set(out.values()) == {0}
    kept = minhash_dedup.near_dedup(odd(spark))
    assert kept.columns == odd(spark).columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter({(1, ODD[0][1]): 1, (3, None): 1, (4, ""): 1, (5, " \t\n "): 1, (None, None): 1,
                           (6, "one two"): 1, (8, ODD[10][1]): 1, (9, ODD[11][1]): 1, (10, ODD[12][1]): 1})
    assert minhash_dedup.near_groups(frame(spark, [])).count() == 0
    assert minhash_dedup.near_dedup(frame(spark, [])).count() == 0


def test_estimate_corrects_for_chance(spark):
    """Signatures of unrelated sets agree by chance in a quarter of their
    minima, and the estimate is near 0; equal ones give 1."""
    rows = [(1, " ".join(f"a{i}" for i in range(300)), "en", "s", 0), (2, " ".join(f"b{i}" for i in range(300)), "en", "s", 0)]
    a, b = (r["sig"] for r in minhash_dedup.sketches(frame(spark, rows), "doc_id", "text").collect())
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    x, y = df.select(minhash_dedup.estimate(F.col("a"), F.col("b")), minhash_dedup.estimate(F.col("a"), F.col("a"))).first()
    assert abs(x) < 0.25 and y == 1.0


def targets(sizes):
    """source -> target by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        for s in over or free:
            out[s] = 2.0 * sizes[s] if over else level * w[s]
        if not over:
            break
        left -= sum(out[s] for s in over)
        free -= over
    return out


def check_mix(rows, docs, near):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = targets(sizes)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near


@pytest.mark.parametrize("shard,bound", [(mixing.SHARD_DOCS, mixing.BROADCAST_SOURCES), (8, 0)])
def test_mix_meets_targets(spark, monkeypatch, shard, bound):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 4)
    df = small_docs(spark)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    check_mix(rows, docs, 4 * (2 + len(docs) // shard))  # rounding of all shards


def test_mix_reruns_agree_and_odd_rows(spark):
    df = small_docs(spark)
    a, b = (sorted(tuple(r) for r in queries.op8_mixing(spark, SMALL).collect()) for _ in range(2))
    assert a == b == sorted(tuple(r) for r in mixing.mix(df.repartition(7)).collect())
    out = mixing.mix(odd(spark)).collect()
    assert len(out) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert {r["source_size"] for r in out if r["doc_id"] in (3, 5)} == {0}
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r["target"] for r in mixing.mix(frame(spark, [(1, None, "en", "a", 0), (2, " ", "en", "b", 0)])).collect()} == {0.0}
    mixed = mixing.mixed_documents(odd(spark))
    assert mixed.columns == odd(spark).columns and "" not in {r["text"] for r in mixed.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_apportion_equals_highest_quotients(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RANKED", 5)
    rng = random.Random(seed)
    votes = {f"u{i:03d}": rng.choice([0.0, 7.0, 7.0, rng.random() * 10 ** rng.randint(0, 4)]) for i in range(60)}
    seats = rng.choice([1, 17, 200, 3000])
    heap = [(-v, k, 0) for k, v in votes.items() if v > 0]
    heapq.heapify(heap)
    want = Counter()
    for _ in range(seats):
        q, k, j = heapq.heappop(heap)
        want[k] += 1
        heapq.heappush(heap, (-(votes[k] / (2 * j + 3)), k, j + 1))
    df = spark.createDataFrame(list(votes.items()), "k string, v double")
    got = {r["k"]: r["quota"] for r in mixing.apportion(df, ["k"], "v", seats).collect()}
    assert got == {k: want[k] for k in votes}


def naive_pack(sizes, clusters, sources, capacity, most):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for s, c, f in zip(sizes, clusters, sources):
        fits = [(capacity - sum(x for x, _, _ in b), i) for i, b in enumerate(bins)
                if sum(x for x, _, _ in b) + s <= capacity and all(y != c for _, y, _ in b)
                and sum(z == f for _, _, z in b) < most]
        if fits:
            free, i = min(fits)
        else:
            free, i = capacity, len(bins)
            bins.append([])
        out.append((i, capacity - free))
        bins[i].append((s, c, f))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_pack_shard_equals_naive_best_fit(seed):
    rng = random.Random(seed)
    n = 300
    sizes = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
    clusters = [rng.randint(0, 60) if rng.random() < 0.6 else 1000 + i for i in range(n)]
    sources = [0 if rng.random() < 0.4 else rng.randint(1, 9) for _ in range(n)]
    for most in (1, 2, 3):
        assert packing.pack_shard(sizes, clusters, sources, 100, most) == naive_pack(sizes, clusters, sources, 100, most)


def check_bins(rows, docs, capacity, most):
    size = defaultdict(list)
    for i, t, s in docs:
        size[i].append((len(WORD.findall(t or "")), re.sub(r"\s", "", t or ""), s))
    bins, words = defaultdict(list), Counter()
    for r in rows:
        words[r["doc_id"]] += r["size"]
        if r["size"]:
            bins[r["bin"]].append(r)
        else:
            assert r["bin"] is None
    assert words == Counter({i: sum(n for n, _, _ in v) for i, v in size.items()})
    for members in bins.values():
        members.sort(key=lambda r: r["position"])
        assert [r["position"] for r in members] == [sum(m["size"] for m in members[:k]) for k in range(len(members))]
        assert sum(r["size"] for r in members) <= capacity
        assert max(Counter(size[r["doc_id"]][0][2] for r in members).values()) <= most
        assert max(Counter(size[r["doc_id"]][0][1] for r in members).values()) == 1


def test_packing_covers_every_word_without_conflicts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    df = small_docs(spark)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    rows = packing.pack(df, capacity=700).collect()
    check_bins(rows, docs, 700, packing.MAX_PER_SOURCE)
    out = packing.pack(odd(spark), capacity=100).collect()
    check_bins(out, [(r[0], r[1], r[3]) for r in ODD], 100, packing.MAX_PER_SOURCE)
    assert packing.pack(frame(spark, [])).count() == 0
    assert queries.op9_packing(spark, SMALL).count() >= len(docs)


def suffix_brute(docs):
    """(doc_id, bytes, removed, spans, sha) of each row, in order."""
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            k = first[b[p:p + 50]]
            if k is not None and (i is None or k < i):
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    from pyspark.sql import functions as F
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return [tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("spans").cast("bigint"), F.sha2("kept", 256)).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("bound,part,piece", [(200_000, 4 << 20, 1 << 18), (0, 3000, 200)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, bound, part, piece):
    """Also with tiny parts and pieces, so that every border is crossed."""
    monkeypatch.setattr(suffix_dedup, "BROADCAST_RANGES", bound)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", bound)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef ") for _ in range(160))
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcdefghé ") for _ in range(rng.randint(0, 300)))
        if i % 3 == 0:
            a = rng.randint(0, 100)
            t = t[:80] + passage[a:a + rng.randint(40, 160)] + t[80:]
        rows.append(((i * 17) % 61, t * (2 if i % 7 == 0 else 1), "en", "s", 0))
    rows += [(100, "x" * 49, "en", "s", 0), (101, "x" * 49, "en", "s", 0), (102, "y" * 90, "en", "s", 0),
             (103, "y" * 70, "en", "s", 0), (106, rows[3][1], "en", "s", 0), (107, rows[3][1], "en", "s", 0), (104, "", "en", "s", 0), (105, None, None, None, None)]
    df = frame(spark, rows).repartition(5)
    assert order(digest(suffix_dedup.remove_repeats(df))) == order(suffix_brute([(r[0], r[1]) for r in rows]))


def test_suffix_dedup_odd_rows(spark):
    assert order(digest(suffix_dedup.remove_repeats(odd(spark)))) == order(suffix_brute([(r[0], r[1]) for r in ODD]))
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, against brute force."""
    docs = small_docs(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_copies", "near_copies", "mix", "packing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(texts_of(docs))
    assert {i for i, t in kept[1]} == {r[0] for r in exact_brute(kept[0]).values() if r[3]}
    assert {i for i, t in kept[2]} == {i for i, c in components(kept[1])[0].items() if i == c}
    assert max(Counter(i for i, _ in kept[3]).values()) <= 2 and set(kept[3]) <= set(kept[2])
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_bins(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], packing.CAPACITY, packing.MAX_PER_SOURCE)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()) == Counter(r["doc_id"] for r in rows)


def test_pipeline_of_odd_and_empty_tables(spark):
    for docs, n in ((frame(spark, ODD), len(ODD)), (frame(spark, []), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.count() <= max(n * 4, 100) if n else docs.count() == 0
