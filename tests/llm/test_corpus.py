import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import line_dedup, minhash, packing, quality, sharding

from .conftest import words


def test_bins_are_fullest():
    r = random.Random(1)
    for _ in range(200):
        room = r.randint(5, 30)
        lengths = np.array([r.randint(1, room) for _ in range(r.randint(1, 9))])
        bins, offs = packing.pack(lengths, room)
        left = list(range(len(lengths)))
        for k in range(bins.max() + 1):
            mine = [i for i in left if bins[i] == k]
            big = max(lengths[i] for i in left)
            others = list(left)
            others.remove(next(i for i in mine if lengths[i] == big))
            best = max(s for n in range(len(others) + 1) for c in itertools.combinations(others, n) if (s := sum(lengths[i] for i in c)) + big <= room)
            assert sum(lengths[mine]) == best + big
            at = 0
            for o, n in sorted(zip(offs[mine], lengths[mine])):
                assert o == at
                at += n
            left = [i for i in left if bins[i] != k]
        assert not left


def test_packing_rows(make, awkward):
    rows = [*awkward, ((1 << 60) + 1, " ".join(["w"] * 100), "en")]
    got = packing.packed(make(rows), capacity=64, per_shard=3).collect()
    want = {}
    for i, t, _ in rows:
        if t and t.split():
            want[i] = want.get(i, 0) + len(t.split())
    have = {}
    fill = {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["n_words"]
        fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["n_words"]
    assert have == want and max(fill.values()) <= 64
    assert packing.packed(make(rows).limit(0)).count() == 0


def test_differencing_against_its_definition():
    r = random.Random(2)
    for _ in range(60):
        k, n = r.randint(2, 4), r.randint(1, 12)
        weights = sorted((r.randint(0, 50) for _ in range(n)), reverse=True)
        sums, slot = sharding.single(np.array(weights), k)
        parts = [(sorted([w] + [0] * (k - 1), reverse=True), x) for x, w in enumerate(weights)]
        while len(parts) > 1:
            parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
            (a, x), (b, y) = parts[:2]
            parts = [*parts[2:], (sorted((p + q for p, q in zip(a, b[::-1])), reverse=True), min(x, y))]
        assert list(sums) == parts[0][0]
        assert sorted((sum(w for w, s in zip(weights, slot) if s == b) for b in range(k)), reverse=True) == list(sums)


def test_sharding_rows(make, awkward):
    rows = [*awkward, *((100 + i, " ".join(words(i, 5 + i)), "en") for i in range(300))]
    got = sharding.shards(make(rows), k=4, per_node=40).collect()
    assert len(got) == len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] in (6, 7)}) == 1  # copies stay together
    groups = {(r["group_key"], r["group_bytes"], r["shard"]) for r in got}
    assert len({g[0] for g in groups}) == len(groups)
    assert sum(w for _, w, _ in groups) == sum(len(t.encode()) for _, t, _ in rows if t)
    totals = [sum(w for _, w, s in groups if s == b) for b in range(4)]
    most = max(w for _, w, _ in groups)
    assert max(totals) <= max(most, 1.05 * sum(totals) / 4)
    assert sharding.shards(make(rows).limit(0)).count() == 0


def jaccard(a, b, k=minhash.WIDTH):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0


def near_rows():
    rows, r = [], random.Random(5)
    for g in range(12):
        base = words(100 + g, r.randint(30, 300))
        for c in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"new{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w), "en"))
    return rows


def test_near_duplicates_against_every_pair(make):
    rows = near_rows()
    top = {i: i for i, _, _ in rows}

    def find(i):
        return i if top[i] == i else find(top[i])

    for (i, a, _), (j, b, _) in itertools.combinations(rows, 2):
        if jaccard(a, b) >= minhash.THRESHOLD:
            x, y = sorted((find(i), find(j)))
            top[y] = x
    want = {i: find(i) for i in top if sum(find(j) == find(i) for j in top) > 1}
    for long in (minhash.LONG, 1):
        got = {r["doc_id"]: r["group_id"] for r in minhash.near_groups(make(rows), long=long).collect()}
        assert got == want
    kept = minhash.drop_near(make(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in top if find(i) == i)
    assert kept.columns == make(rows).columns


def test_long_lists_are_split_without_a_loss(spark):
    """Documents that share many values but lie in components of their own."""
    r = random.Random(9)
    least, threshold = 0.3, 0.5
    sketches = []
    for i in range(60):
        base = range(i % 3 * 100, i % 3 * 100 + 14)
        sketches.append((i, sorted({*base[: r.randint(4, 14)], *r.sample(range(1000, 1040), r.randint(2, 8))})))
    node = lambda i: (i, 0)
    need = lambda s: int(np.ceil(least * len(s)))
    cand = spark.createDataFrame([(node(i), len(s), need(s), s) for i, s in sketches], f"node {minhash.NODE}, size int, need int, sketch array<long>")
    rows = [(v, node(i), len(s), node(i % 50)) for i, s in sketches for v in s]
    lists = spark.createDataFrame(rows, f"v long, node {minhash.NODE}, n int, c {minhash.NODE}")
    got = {(x["a"]["i"], x["b"]["i"]) for x in minhash.crossing(lists, cand, threshold, long=3).collect()}
    for (i, s), (j, t) in itertools.combinations(sketches, 2):
        both = len({*s} & {*t})
        if i % 50 != j % 50 and both >= least * len({*s, *t}) and min(len(s), len(t)) >= threshold * max(len(s), len(t)):
            assert (i, j) in got
    every = sum(1 for (i, s), (j, t) in itertools.combinations(sketches, 2) if i % 50 != j % 50 and {*s} & {*t})
    assert len(got) < every


def test_values_are_counted_where_they_meet(spark):
    r = random.Random(17)
    rows = [((i, -i), r.sample(range(-300, 300), r.randint(1, 64))) for i in range(200)]
    many = Counter(v for _, s in rows for v in s)
    sketches = spark.createDataFrame([(n, len(s), 1 + len(s) // 4, sorted(s)) for n, s in rows], f"node {minhash.NODE}, size int, need int, sketch array<long>")
    want = sorted((*n, len(s), 1 + len(s) // 4, v, many[v]) for n, s in rows for v in s if many[v] > 1)
    for buckets in (1, 7, 1000):
        got = minhash.counted(sketches, buckets).select("node.*", "size", "need", "v", "df").collect()
        assert sorted(map(tuple, got)) == want
    assert minhash.counted(sketches.limit(0), 3).count() == 0


def test_near_duplicates_of_awkward_rows(make, awkward):
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in minhash.drop_near(make(awkward)).collect())
    gone = {"7", "8"}  # copies of 6; case doesn't count
    assert {i for i, _ in kept} == {str(i) for i, _, _ in awkward} - gone
    assert sum(i == "None" for i, _ in kept) == 2
    assert minhash.drop_near(make(awkward).limit(0)).count() == 0
    assert minhash.near_groups(make(awkward).limit(0)).count() == 0


def test_lines(make, awkward, spark):
    head = ["first shared line", "second shared line", "third shared line", "fourth shared line"]
    own = lambda k: [" ".join(words(200 + k * 10 + x, 6)) for x in range(3)]
    rows = [(1, "\n".join([*own(1), *head]), "en"), (2, "\n".join([*own(2), *head, *own(3)]), "en"), (3, "\n".join(own(4)), "en"), (4, "\n".join(head), "en")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert got == {1: rows[0][1], 2: "\n".join([*own(2), *own(3)]), 3: rows[2][1]}
    out = line_dedup.dedup_lines(make(awkward))
    assert out.columns == make(awkward).columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(None) == 2 and 7 not in kept and {1, 2, 3, 4, 5, 6, 8, 9} <= set(kept)
    assert line_dedup.dedup_lines(make(awkward).limit(0)).count() == 0


def test_every_run_of_two_lines_and_every_long_line_goes(make):
    r, rows = random.Random(6), []
    long = [" ".join(words(840 + k, 60)) for k in range(3)]
    for i in range(60):
        rows.append((i, "\n".join([*r.choices([f"line {x}" for x in range(40)], k=r.randint(1, 12)), *r.choices(long, k=i % 2)]), "en"))
    want, pairs, seen = {}, set(), set()
    for i, text, _ in rows:
        own, gone = text.split("\n"), set()
        for p, line in enumerate(own):
            pair = tuple(own[p : p + 2])
            if len(pair) == 2:
                gone |= {p, p + 1} if pair in pairs else set()
                pairs.add(pair)
            if line in long:
                gone |= {p} if line in seen else set()
                seen.add(line)
        if len(gone) < len(own):
            want[i] = "\n".join(x for p, x in enumerate(own) if p not in gone)
    assert {d["doc_id"]: d["text"] for d in line_dedup.dedup_lines(make(rows)).collect()} == want


class Brute:
    """Modified Kneser-Ney by its definition."""

    def __init__(self, texts, order=quality.ORDER):
        self.tables = {order: {}}
        for t in texts:
            b = bytes(order - 1) + t.encode()
            for i in range(order - 1, len(b)):
                g = b[i - order + 1 : i + 1]
                self.tables[order][g] = self.tables[order].get(g, 0) + 1
        for m in range(order - 1, 0, -1):
            self.tables[m] = {}
            for g in self.tables[m + 1]:
                self.tables[m][g[1:]] = self.tables[m].get(g[1:], 0) + 1

    def p(self, g):
        t = self.tables[len(g)]
        n = [sum(c == i for c in t.values()) for i in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(i, max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
        else:
            d = [0.5, 1.0, 1.5]
        follow = [c for k, c in t.items() if k[:-1] == g[:-1]]
        total = sum(follow)
        gamma = sum(d[min(c, 3) - 1] for c in follow) / total
        return (t[g] - d[min(t[g], 3) - 1]) / total + gamma * (1 / 257 if len(g) == 1 else self.p(g[1:]))


WAYS = [{}, {"per_file": 50}, {"files": False}]


@pytest.mark.parametrize("way", WAYS)
def test_perplexity_against_the_definition(make, way):
    rows = [(k, " ".join(words(300 + k, 8)), "en" if k % 2 else "de") for k in range(8)] + [(20, "", "en"), (21, None, "en"), (None, "abc abc", None)]
    got = {(r["doc_id"]): r for r in quality.report(make(rows), **way).collect()}
    for lang in ("en", "de"):
        own = [(i, t) for i, t, x in rows if x == lang and t]
        model = Brute([t for _, t in own])
        for i, t in own:
            b = bytes(quality.ORDER - 1) + t.encode()
            logs = [np.log(model.p(b[j - quality.ORDER + 1 : j + 1])) for j in range(quality.ORDER - 1, len(b))]
            assert got[i]["perplexity"] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-3)
    assert got[20]["perplexity"] is None and got[21]["reason"] is None and got[None]["perplexity"] is not None


def test_copies_count_alike_with_the_model_in_files_or_joined(make):
    one = [(k, " ".join(words(700 + k, 5 + 3 * k)), "en") for k in range(30)]
    docs = make([*one, *((100 + k, one[0][1], "en") for k in range(200))])
    judged = [sorted((r["_q_row"], r["reason"] or "", round(r["lo"], 6), round(r["hi"], 6)) for r in quality.judge(docs, 0.5, **way).collect()) for way in WAYS]
    assert len(judged[0]) == 230 and judged[0] == judged[1] == judged[2] and {x[1] for x in judged[0]} > {""}
    assert quality.report(docs).count() == 230


def test_bands_against_numpy(make):
    docs = make([(k, " ".join(words(k, 3 + k % 50)), "en" if k % 3 else "de") for k in range(300)])
    for r in quality.bands(scored := quality.score(docs)).collect():
        x, n = np.array([(s["logppl"], s["n"]) for s in scored.where(f"lang = '{r['lang']}'").collect()]).T
        q = lambda v, f: (np.sort(np.floor(v * quality.BINS))[int(np.ceil(f * len(v))) - 1] + 0.5) / quality.BINS
        long = np.log(n) >= q(np.log(n), 0.5)
        (vs, ms), (vl, ml) = (((q(x[h], 0.75) - q(x[h], 0.25) + 1 / quality.BINS) ** 2, np.exp(-q(np.log(n[h]), 0.5))) for h in (~long, long))
        b = max(0, (vs - vl) / (ms - ml))
        assert (r["med"], r["a"], r["b"]) == pytest.approx((q(x, 0.5), max(0, vl - b * ml), b))
        err = 3 * np.sqrt(0.25 * 0.75 / long.sum())
        assert r["v"] == pytest.approx((q(x[long], min(1, 0.75 + err)) - q(x[long], max(1e-9, 0.25 - err)) + 1 / quality.BINS) ** 2)


def test_quality_keeps_awkward_rows_but_junk(make, awkward):
    clean = [(100 + k, " ".join(words(k % 40, 60)), "en") for k in range(120)]
    junk = [(900, "%%% &&& ### " * 60, "en")]
    kept = quality.keep(make([*clean, *junk]))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in clean}
    assert quality.keep(make(awkward)).columns == make(awkward).columns
    assert quality.keep(make(awkward)).count() >= 8
    assert quality.keep(make(awkward).limit(0)).count() == 0
    assert quality.report(make(awkward)).count() == len(awkward)


def test_names_that_clash_with_those_used_inside(spark, make, tmp_path):
    names = ["_q_row", "_nd_i", "_nd_h", "_nd_salt", "_dc_id", "_ld_id", "_LD_H", "_ld_runs", "_ld_new", "a.b", "c`d", "i", "h", "node", "seed"]
    spark.createDataFrame([(1, " ".join(words(50, 30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(near_rows()).select("doc_id", "text", "lang")
    plain = docs
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(k))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert all(list(r)[3:] == [*range(len(names))] for r in rows)
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, plain, str(tmp_path)).collect()), name


def test_pipeline_stages(spark, make, awkward, tmp_path):
    bench = spark.createDataFrame([(1, " ".join(words(50, 30)))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [*awkward, *near_rows(), (500, " ".join([*words(60, 20), *words(50, 30)]), "en")]
    docs = make(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    ids = {r["doc_id"] for r in docs.collect()}
    assert 500 not in ids and {0, 5} <= ids
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "n_words", "bin_id", "first_word"] and out.count() > 0


def test_workers_of_the_pipeline_hold_no_freed_memory(spark, make, tmp_path, monkeypatch):
    """Every scan of its stages gives back at its end what it has freed."""
    item = " ".join(words(50, 30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen, back = make([(k, f"{item} {' '.join(words(k // 2, 60))}\n" * 2, "en") for k in range(20)]), [], []
    kind = type(docs)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **kw: seen.append(f) or whole(self, f, *a, **kw))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).count()
    monkeypatch.setattr("lodestrata.runtime.give_back", lambda: back.append(1))
    for f in seen:
        list(f(iter([])))
    assert len(seen) >= 10 and len(back) == len(seen)


def test_counts_are_passed_on_in_small_batches(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": [" ".join(words(k, 40)) for k in range(3)]})
    want = list(quality._count(iter([batch])))
    assert len(want) == 2  # one for each language
    monkeypatch.setattr(quality, "PASSED", 7)
    got = list(quality._count(iter([batch])))
    assert max(b.num_rows for b in got) == 7
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(want))
