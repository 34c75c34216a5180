import random
import subprocess
import sys
import tempfile
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chaining, suffix_dedup, suffix_sort
from lodestrata.llm.suffix_sort import sort
from lodestrata.llm.text import U, word_hash

from .conftest import words


def brute_suffixes(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        common.append(k)
    return order, common


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=60), st.integers(1, 40), st.integers(0, 40))
def test_suffix_array_and_common_prefixes(values, held, base):
    t = [*values, 0]
    sa, common = sort(np.array(t), None, held, base)
    assert (list(sa), list(common)) == brute_suffixes(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=60), st.integers(1, 40), st.integers(0, 40))
def test_the_same_from_files(values, held, base):
    t = [*values, *values[3:20], 0]
    with tempfile.TemporaryDirectory() as folder:
        sa, common = sort(np.array(t), folder, held, base)
        assert (list(sa), list(common)) == brute_suffixes(t)


def test_queues_on_disk(tmp_path):
    r = random.Random(1)
    t = [r.randint(1, 400) for _ in range(1500)]
    t = [*t, *t[200:700], *[9] * 60, *t[100:300], 0]
    note = {}
    sa, common = sort(np.array(t), str(tmp_path), held=100, base=0, note=note)
    assert (list(sa), list(common)) == brute_suffixes(t)
    assert note["files"] > 20 and note["levels"] > 2


def test_a_shard_beyond_memory_recurses_and_spills(tmp_path):
    """At the limits of production, with a text of several times what is held."""
    r = np.random.default_rng(4)
    t = r.integers(2, 40_000, 250_000)
    t = np.concatenate([t, t[30_000:230_000], r.permutation(t)[:150_000], t[:200_000], [0]])
    assert len(t) > 6 * suffix_sort.HELD
    note = {}
    sa, common = map(np.asarray, sort(t, str(tmp_path), note=note))
    assert note["levels"] >= 4 and note["files"] > 8
    assert np.array_equal(np.sort(sa), np.arange(len(t)))
    for x in r.integers(1, len(t), 3000):
        a, b, k = int(sa[x - 1]), int(sa[x]), int(common[x])
        assert np.array_equal(t[a : a + k], t[b : b + k]) and t[a + k] < t[b + k]


def test_a_hot_minimizer_is_parted_by_content():
    r = np.random.default_rng(5)
    for _ in range(50):
        g = r.integers(1, 99, 60, dtype=np.int64).astype(U)
        own = {}
        for key, a, n in suffix_dedup.parted(g, g.min(), 60 - 42, 50):
            for w in range(a, a + n):
                own[w] = key
        assert sorted(own) == list(range(18))
        # a window's part depends on its own seeds alone
        for w in range(18):
            (key, a, n), = suffix_dedup.parted(g[w : w + 43], g.min(), 1, 50)
            assert key == own[w]


def corpus():
    base = words(1, 400)
    r = random.Random(2)
    docs = [(1, base[:200]), (2, words(3, 150)), (3, [*words(4, 30), *base[20:90], *words(5, 30)]), (4, [*base[100:160], *words(6, 20), *base[30:80]])]
    fuzzy = list(base[:150])
    for k in range(10, 150, 15):
        fuzzy[k] = "changed" + str(r.randint(0, 99))
    docs += [(5, fuzzy), (6, words(3, 150)), (7, ["tick"] * 130), (8, base[:49]), (9, base[:50])]
    return [(i, " ".join(w), "en") for i, w in docs]


def repeated_words(rows, least):
    """Words of windows that occur earlier, by brute force."""
    seen, out = set(), {}
    for i, text, _ in rows:
        w = text.split()
        for p in range(len(w) - least + 1):
            key = tuple(w[p : p + least])
            if key in seen:
                out.setdefault(i, set()).update(range(p, p + least))
            seen.add(key)
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
    return out


def test_repeats_are_exact(make):
    rows = corpus()
    assert covered(suffix_dedup.repeats(make(rows)).collect()) == repeated_words(rows, 50)
    assert covered(suffix_dedup.repeats(make(rows), per_shard=100, held=64, base=8).collect()) == repeated_words(rows, 50)


def test_repeats_of_awkward_rows(make, awkward, spark):
    got = covered(suffix_dedup.repeats(make(awkward)).collect())
    assert set(got) == {7, 8, 9}  # later copies (case doesn't count) and the text that repeats itself
    assert suffix_dedup.repeats(make(awkward).limit(0)).count() == 0


def test_chaining_finds_exact_and_fuzzy_passages(make):
    rows = corpus()
    got = covered(chaining.passages(make(rows)).collect())
    for i, at in repeated_words(rows, 50).items():
        assert len(at & got.get(i, set())) >= 0.98 * len(at), i
    assert len(got[5]) >= 140  # changed words don't break the passage
    assert 1 not in got and 2 not in got and 8 not in got


def test_chaining_reports_the_source(make):
    r = [r for r in chaining.passages(make(corpus())).collect() if r["doc_id"] == 3]
    assert [(x["first_word"], x["end_word"], x["src_doc_id"], x["src_first_word"], x["src_end_word"], x["identity"]) for x in r] == [(30, 100, 1, 20, 90, 1.0)]


def test_chaining_of_awkward_rows(make, awkward):
    got = covered(chaining.passages(make(awkward)).collect())
    assert set(got) == {7, 8, 9}
    assert chaining.passages(make(awkward).limit(0)).count() == 0


def test_a_repeat_whose_parts_have_other_sources(make):
    """Documents with parts of a passage stand before, after and between its copies."""
    p1, p2 = words(21, 30), words(22, 30)
    own = lambda k: words(400 + k, 25)
    parts = [p1, p2, p1 + p2, p1, p2, p1 + p2, p2 + p1, p1, p1 + p2]
    rows = [(k, " ".join([*own(k), *part, *own(50 + k)]), "en") for k, part in enumerate(parts)]
    for together in (chaining.TOGETHER, 2):
        got = covered(chaining.passages(make(rows), together=together).collect())
        for i, at in repeated_words(rows, 50).items():
            assert at <= got.get(i, set()), (i, together)


def test_long_passages_are_extended_over_whole_texts(make):
    base = words(23, 3000)
    changed = [w if k % 9 else f"c{k}" for k, w in enumerate(base)]  # eight equal words in a row hold few seeds
    got = chaining.passages(make([(1, " ".join(base), "en"), (2, " ".join(changed), "en")]), around=8).collect()
    assert len(covered(got)[2]) >= 2900


@pytest.mark.parametrize(("edits", "recall"), [(0.0, 1.0), (0.05, 0.97), (0.1, 0.95), (0.15, 0.85), (0.2, 0.55)])
def test_recall_of_fuzzy_passages(make, edits, recall):
    """Passages of 60 words with words changed, put in or left out, against the
    identity by brute force (the longest common subsequence)."""
    r = random.Random(int(edits * 100))
    rows, want = [], set()
    for k in range(120):
        base = words(5000 + k, 60)
        copy = []
        for w in base:
            x = r.random()
            if x >= edits:
                copy.append(w)
            elif x >= edits / 4:
                copy.append(f"z{r.randint(0, 10**6)}")
            elif x >= edits / 8:
                copy += [w, f"z{r.randint(0, 10**6)}"]
        rows += [(2 * k, " ".join([*words(7000 + k, 40), *base, *words(8000 + k, 40)]), "en"), (2 * k + 1, " ".join([*words(9000 + k, 30), *copy, *words(6000 + k, 50)]), "en")]
        a, b = (word_hash(" ".join(x)) for x in (base, copy))
        if chaining.common_words(a, b) >= 0.8 * max(len(a), len(b)) and len(copy) >= 50:
            want.add(2 * k + 1)
    got = {i for i, at in covered(chaining.passages(make(rows), identity=0.78, least=44).collect()).items() if len(at) >= 44}
    assert len(want) >= 30 and len(got & want) >= recall * len(want), (len(got & want), len(want))


def test_every_two_variants_of_a_passage_are_linked(make):
    """Each changes words of its own, so that no two have long contexts in common
    and their seeds have other first and last occurrences."""
    base = words(31, 60)
    rows = []
    for k in range(8):
        own = [f"v{k}x{n}" if n % 10 == k else w for n, w in enumerate(base)]
        rows.append((k, " ".join([*words(900 + k, 30), *own, *words(950 + k, 30)]), "en"))
    got = {(r["doc_id"], r["src_doc_id"]) for r in chaining.passages(make(rows), identity=0.75).collect()}
    assert got >= {(j, i) for j in range(8) for i in range(j)}


def test_a_single_seed_is_enough(make):
    """Runs of equal words of which one alone holds a seed that both texts pick."""
    r = random.Random(11)
    found = 0
    for k in range(400):
        base = words(20_000 + k, 60)
        a, b = ([*words(30_000 + 2 * k + x, 20), *base, *words(31_000 + 2 * k + x, 20)] for x in (0, 1))
        for n in range(r.randrange(5), 60, 5):
            b[20 + n] = f"q{n}"
        own = [dict(zip(g.tolist(), at.tolist())) for _, g, at, _ in (chaining._picked(pa.record_batch({"text": [" ".join(t)]}), chaining.K, chaining.W) for t in (a, b))]
        if len(own[0].keys() & own[1].keys()) == 1:
            got = covered(chaining.passages(make([(1, " ".join(a), "en"), (2, " ".join(b), "en")])).collect())
            assert len(got.get(2, set())) >= 50
            found += 1
            if found == 2:
                break
    assert found == 2


def test_copies_give_their_whole_text(make):
    text = " ".join(words(33, 80))
    rows = [(3, text, "en"), (1, text, "en"), (2, text, "de"), (2, text, "de"), (4, " ".join(words(34, 20)), "en"), (5, " ".join(words(34, 20)), "en")]
    got = sorted(tuple(x) for x in chaining.passages(make(rows)).collect())
    assert got == [(2, 0, 80, 1, 0, 80, 1.0), (3, 0, 80, 1, 0, 80, 1.0)]


def test_shuffle_files_go_with_the_action_that_made_them(make, spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {p for d in dirs for p in Path(d).glob("*/shuffle_*")}

    before = files()
    got = chaining.passages(make(corpus()))
    assert not files() - before
    assert spark.conf.get(chaining.CLEANUP) == "false"
    assert got.collect() and sorted(got.collect()) == sorted(got.collect())


def test_common_words_of_long_gaps():
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (7, 70), (65, 64), (130, 129)):
        a, b = r.integers(0, 9, n), r.integers(0, 9, m)
        row = [0] * (m + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        assert chaining.common_words(a, b) == row[-1]
    a = np.arange(40_000)
    began = time.process_time()
    assert chaining.common_words(a, np.delete(a, slice(100, 40_000, 100))) == 40_000 - 399
    assert time.process_time() - began < 2  # a row of a table at a time it takes more


def test_whole_texts_are_sent_once_a_pair():
    run = pa.list_(pa.struct([("b", pa.int32()), ("n", pa.int32()), ("a", pa.int32())]))
    chains = [[[(n, 4, n)] for n in range(r)] for r in (3, 1, 2)]
    every = pa.array([[[dict(zip("bna", x)) for x in c] for c in row] for row in chains], pa.list_(run))
    batch = pa.record_batch({"id": [7, 8, 9], "runs": pa.array([None] * 3, run), "b": [b"x" * 8, b"y" * 8, b"z" * 8], "all": every})
    for size in (1, 16, 1000):
        got = pa.Table.from_batches(chaining.each_chain(batch, size)).to_pylist()
        assert [(r["id"], r["b"][:1], r["runs"][0]["b"]) for r in got] == [(7, b"x", 0), (7, b"x", 1), (7, b"x", 2), (8, b"y", 0), (9, b"z", 0), (9, b"z", 1)]


def judged(pairs):
    """Of (document, source, chain's word, source's word), each a chain of one seed: those
    that are let through, and those that alignment accepts."""
    run = pa.list_(pa.struct([(c, pa.int32()) for c in "bna"]))
    spot = pa.list_(pa.struct([("id", pa.int64()), ("side", pa.int32()), ("lo", pa.int32()), ("hi", pa.int64())]))

    def asked(kind, around):
        for side in (0, 1):
            w = [word_hash(" ".join(p[side])).astype(kind).tobytes() for p in pairs]
            spots = [[{"id": x, "side": side, "lo": p[2 + side] - around, "hi": p[2 + side] + chaining.K + around}] for x, p in enumerate(pairs)]
            yield pa.record_batch({"words": pa.array(w, pa.binary()), "spots": pa.array(spots, spot)})

    def rows(tables, *by):
        return pa.concat_tables(tables, promote_options="default").sort_by([(c, "ascending") for c in by]).combine_chunks().to_batches()

    windows = rows([pa.Table.from_batches(chaining._windows(asked(np.uint8, 0)))], "id", "what")
    n = len(pairs)
    own = pa.table({c: pa.array([0] * n, pa.int64()) for c in ("i", "h", "si", "sh")} | {"id": pa.array(range(n), pa.int64()), "side": pa.array([2] * n, pa.int32()), "runs": pa.array([[{"b": p[2], "n": chaining.K, "a": p[3]}] for p in pairs], run)})
    three = rows([pa.Table.from_batches(chaining._slices(np.uint32)(asked(np.uint32, chaining.AROUND))), own], "id", "side")
    judge, align = chaining._promising(chaining.LEAST, chaining.IDENTITY, chaining.AROUND), chaining._align(chaining.LEAST, chaining.IDENTITY)
    return ({x for b in f(iter(own)) for x in b.column("id").to_pylist()} for f, own in ((judge, windows), (align, three)))


def test_chains_that_go_no_further_are_no_passages():
    r, pairs = random.Random(4), []
    for k in range(600):
        base, copy, at = words(40_000 + k, r.randint(45, 130)), [], []
        edits = r.choice((0.0, 0.05, 0.1, 0.15, 0.2))
        for n, w in enumerate(base):
            x = r.random()
            at.append(len(copy) if x >= edits else -1)
            copy += [w] if x >= edits else [f"z{r.randint(0, 10**6)}"] if x >= edits / 4 else [w, "more"] if x >= edits / 8 else []
        a, b = (words(50_000 + 2 * k + x, r.choice((0, 10, 60))) for x in (0, 1))
        seeds = [n for n in range(len(at) - 3) if at[n] >= 0 and all(at[n + x] == at[n] + x for x in range(4))]
        for n in r.sample(seeds, min(2, len(seeds))):
            pairs.append(([*b, *copy, *b], [*a, *base, *a], len(b) + at[n], len(a) + n))
    through, accepted = judged(pairs)
    assert accepted <= through and len(accepted) >= 500, (len(accepted - through), len(accepted))


def test_common_words_beside_a_seed_are_not_enough():
    """Before, five of 16 words that the other side has as well let a chain through."""
    r = random.Random(5)
    few = words(60, 80)
    sides = [[[*r.choices(few, k=40), *few[:4], *r.choices(few, k=40)] for _ in range(2)] for _ in range(500)]
    through, accepted = judged([(b, a, 40, 40) for b, a in sides])
    assert len(through) <= 50 and not accepted


def test_long_ends_by_themselves_go_as_far(monkeypatch):
    r = np.random.default_rng(6)
    held, at, size, step = [], [[], []], [[], []], []
    for n in r.integers(0, 1500, 120).tolist():
        b = r.integers(0, 300, n).astype(np.uint32)
        a = np.where(r.random(n) < r.choice([0.02, 0.1, 0.3]), np.uint32(7), b)
        a = np.delete(a, slice(n // 2, n // 2 + int(r.integers(0, 4))))
        step.append(int(r.choice([-1, 1])))
        for side, w in enumerate((b, a)):
            at[side].append(sum(map(len, held)) + (len(w) - 1 if step[-1] < 0 else 0))
            size[side].append(len(w))
            held.append(w[:: step[-1]])
    got = []
    for alone in (1, 512, 1 << 40):
        monkeypatch.setattr(chaining, "ALONE", alone)
        ends = chaining.Ends(np.concatenate([*held, np.zeros(1, np.uint32)]), np.array(at), np.array(size), np.array(step))
        ends.extend()
        got.append((ends.to.tolist(), ends.same.tolist()))
    assert got[0] == got[1] == got[2] and sum(got[0][1]) > 10_000


def test_texts_of_one_id_stay_apart(make):
    """The hash of a text goes with its seeds only where others have its id."""
    passage = words(71, 70)
    rows = [(i, " ".join([*words(72 + k, 30), *passage[: 70 - k], *words(82 + k, 30)]), "en") for k, i in enumerate((4, 4, 4, 9))]
    texts = chaining.numbered(make(rows).selectExpr("doc_id i", "xxhash64(text) h", "text"))
    assert sorted((r["i"], r["h"] == 0) for r in texts.collect()) == [(4, False), (4, False), (4, False), (9, True)]
    got = chaining.passages(make([*rows, rows[0]])).collect()
    assert sorted({(r["doc_id"], r["src_doc_id"], r["identity"]) for r in got}) == [(4, 4, 1.0), (9, 4, 1.0)]
    assert len(got) == 6 and len(passage) - 3 == min(r["end_word"] - r["first_word"] for r in got)  # every two of four documents


def test_workers_give_back_what_they_freed():
    """In a process of its own: what a task leaves behind stays in its worker beside the
    executor's heap."""
    code = """
import numpy as np, pyarrow as pa, re
from lodestrata.llm import chaining
text = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 10**6, 250_000))
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
batch = pa.record_batch({"i": pa.array(range(8), pa.int64()), "h": pa.array(range(8), pa.int64()), "text": [text] * 8})
before = held()
for f in (chaining._common(4, 6), chaining._seeds(4, 6, 50, {}, 8), chaining._held(np.uint32)):
    for _ in chaining.lean(f)(iter([batch])):
        pass
print(held() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert float(got.stdout) < 60  # 32 of them are the tables of powers


def best_chain(runs, k, cost):
    """Score of the best chain by trying every predecessor."""
    best = []
    for x, (f, l, a) in enumerate(runs):
        value = l - f + k
        top = value
        for y in range(x):
            yf, yl, ya = runs[y]
            if yl < f and ya + yl - yf < a:
                gaps = f - yl - 1 + a - (ya + yl - yf) - 1
                if best[y] - cost * gaps > 0:
                    top = max(top, value + best[y] - cost * gaps)
        best.append(top)
    return max(best)


@pytest.mark.parametrize("seed", range(20))
def test_chains_against_every_predecessor(seed):
    r = np.random.default_rng(seed)
    p = np.sort(r.choice(400, 25, replace=False))
    q = np.sort(r.choice(400, 25, replace=False))
    if seed % 2:
        q[5:9] = r.permutation(400)[:4]
    runs = chaining.diagonals(p, q, 6, 16)
    chain = chaining.chains(p, q, 6)[0]
    score = sum(l - f + 6 for f, l, _ in chain)
    for (f, l, a), (g, _, b) in zip(chain, chain[1:]):
        score -= 0.25 * (g - l - 1 + b - (a + l - f) - 1)
        assert l < g and a + l - f < b
    assert score == pytest.approx(best_chain(runs, 6, 0.25))


def test_common_words():
    a, b = word_hash("a b c d e f"), word_hash("a x c d f")
    assert chaining.common_words(a, b) == 4
