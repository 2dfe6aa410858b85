import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rookery.llm import lm_scoring as op

SMALL = op.Shape(vocabulary=64, frequent=48, classes=8, width=6, side=2)


def network(seed=0, shape=SMALL):
    rng = np.random.default_rng(seed)
    state = op.start(shape, rng.integers(0, 50, shape.vocabulary))
    return op.Network(shape, op.State((state.flat + rng.normal(0, 0.3, shape.size())).astype(np.float32), state.seen))


def plain_log_p(net, slot, sides):
    """One word's log-probability with plain loops."""
    shape, w = net.shape, net.w
    h = []
    for x in range(shape.width):
        h.append(math.tanh(sum(float(w["vector"][s][x]) * float(w["scale"][k][x]) for k, s in enumerate(sides))))
    c, m = divmod(slot, shape.members)

    def log_softmax(weight, bias, n, chosen):
        scores = [sum(h[x] * float(weight[x][j]) for x in range(shape.width)) + float(bias[j]) for j in range(n)]
        top = max(scores)
        return scores[chosen] - top - math.log(sum(math.exp(s - top) for s in scores))

    return log_softmax(w["class_w"], w["class_b"], shape.classes, c) + log_softmax(w["slot_w"][c], w["slot_b"][c], shape.members, m)


def test_log_p_by_brute_force():
    net, rng = network(), np.random.default_rng(4)
    slots, sides = rng.integers(0, 64, 50), rng.integers(0, 65, (50, 4))
    want = [plain_log_p(net, int(s), [int(x) for x in xs]) for s, xs in zip(slots, sides, strict=True)]
    assert np.allclose(net.log_p(slots, sides), want, atol=1e-4)


def test_probabilities_sum_to_one():
    net = network()
    for row in np.random.default_rng(1).integers(0, 65, (3, 4)):
        assert abs(np.exp(net.log_p(np.arange(64), np.repeat(row[None], 64, axis=0))).sum() - 1) < 1e-5


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    slots, sides = rng.integers(0, 64, 40), rng.integers(0, 65, (40, 4))
    net = network(3)
    before = net.flat.copy()
    loss = lambda flat: -op.Network(SMALL, op.State(flat, net.seen)).log_p(slots, sides).astype(float).mean()
    net.seen[:] = 1e-20
    net.learn(slots, sides, 1e-3)  # a first step without history: rate times the gradient's sign
    moved, checked = net.flat - before, 0
    for i in rng.choice(np.flatnonzero(moved), 80, replace=False):
        up, down = before.copy(), before.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        if abs(slope) > 1e-4:
            checked += 1
            assert np.sign(slope) == -np.sign(moved[i])
    assert checked > 30


def test_windows():
    slots, sides = op.windows([np.array([1, 2, 3]), np.array([], dtype=np.int64), np.array([4])], SMALL)
    assert slots.tolist() == [1, 2, 3, 4]
    assert sides.tolist() == [[64, 64, 2, 3], [64, 1, 3, 64], [1, 2, 64, 64], [64, 64, 64, 64]]


def pieces(docs, shape, direct):
    counts = op.word_counts(docs, shape, "text")
    lexicon = op.lexicon_of(counts, shape, direct)
    return counts, lexicon, op.in_slots(docs, lexicon, "doc_id", "text")


ROWS = [(1, "a b c d e a b a"), (2, ""), (3, "b c " * 3000), (4, "z"), (5, "rare words appear rare " * 3 + "a"), (6, "a b c d e a b a"), (None, "b Ünï Ünï"), (7, None)]


@pytest.mark.parametrize("direct", [10**5, 4])
def test_scores_by_brute_force(spark, docs_of, monkeypatch, direct):
    """Both ways of the counts, against plain loops over whole texts and real word counts."""
    shape = op.Shape(vocabulary=32, frequent=4, classes=4, width=4, side=2)
    state = op.start(shape, np.ones(32))
    monkeypatch.setattr(op, "train", lambda *a: state)
    got = {str(r.doc_id): r for r in op.lm_scores(docs_of(ROWS), shape=shape, direct=direct).collect()}
    count = Counter(w for _, t in ROWS for w in (t or "").split())
    _, lexicon, _ = pieces(docs_of(ROWS), shape, direct)
    reader, of = op.Reader(lexicon), lexicon.slot_counts()
    slot = {w: int(reader.read([w])[1][0]) for w in count}
    total = Counter()
    for w, n in count.items():
        total[slot[w]] += n
    assert all(total[s] == of[s] for s in range(32)) and sum(of) == sum(count.values())
    net = op.Network(shape, state)
    for d, t in ROWS:
        w = (t or "").split()
        line = [32, 32, *[slot[x] for x in w], 32, 32]
        seen = {}
        want = 0.0
        for i, x in enumerate(w):
            key = tuple(line[i : i + 2] + line[i + 3 : i + 5] + [slot[x]])
            if key not in seen:
                seen[key] = plain_log_p(net, slot[x], key[:4])
            want += seen[key] + math.log(count[x] / total[slot[x]])
        r = got[str(d)]
        assert r.n_words == len(w) and abs(r.log_likelihood - want) < 1e-4 * max(1, len(w))
        assert (r.mean_log_likelihood is None) == (not w)


def test_words_in_a_bounded_table(spark, docs_of):
    docs = docs_of(ROWS)
    _, lexicon, _ = pieces(docs, SMALL, 4)
    small, large = op.Reader(lexicon, remembered=2), op.Reader(lexicon)
    for _, t in ROWS:
        for a, b in zip(small.read([t or ""]), large.read([t or ""]), strict=True):
            assert np.array_equal(a, b)


@pytest.mark.parametrize("partitions", [4, 64])
def test_held_out_words_are_learned(spark, partitions):
    """At default settings: better than word frequencies by a wide margin, and the order of words matters."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    plain, held = docs.where("doc_id % 10 <> 3").repartition(partitions), docs.where("doc_id % 10 = 3")
    shape = op.Shape()
    _, lexicon, words = pieces(plain, shape, op.DIRECT)
    lists = op._numbers(op.in_slots(held, lexicon, "doc_id", "text").select("slots").toArrow().column(0).combine_chunks())
    rng = np.random.default_rng(3)
    score = lambda state, texts: op.Network(shape, state).log_p(*op.windows(texts, shape)).astype(float).mean()
    before = score(op.start(shape, lexicon.slot_counts()), lists)
    state = op.train(words, shape, lexicon.slot_counts())
    after = score(state, lists)
    assert after > before + 0.8
    mixed = rng.permutation(np.concatenate(lists))
    shuffled = np.split(mixed, np.cumsum([len(x) for x in lists])[:-1])
    assert after > score(state, shuffled) + 0.3


def test_averages_by_words_seen(spark):
    n = -(-SMALL.size() // op.ROW)
    rows = [(r + part * n, float(seen), [v + part] * op.ROW) for seen, v in ((1, 4.0), (3, 8.0)) for part in (0, 1) for r in range(n)]
    got = op.averaged(spark.createDataFrame(rows, "row int, n double, w array<float>").repartition(3), SMALL)
    assert len(got.flat) == SMALL.size() and np.allclose(got.flat, 7.0) and np.allclose(got.seen, 8.0)


def test_awkward_rows(docs_of, awkward):
    names = ("row", "id", "slots", "n_words", "rest", "slice", "x", "h")
    docs = docs_of(awkward, {n: F.lit(1) for n in names})
    got = op.lm_scores(docs, shape=SMALL, direct=8).collect()
    assert len(got) == len(awkward)
    for r in got:
        assert (r.n_words == 0) == (r.mean_log_likelihood is None) and r.log_likelihood <= 1e-6 and np.isfinite(r.log_likelihood)
    assert sorted(r.n_words for r in got) == sorted(len((t[1] or "").split()) for t in awkward)
    alike = [r.log_likelihood for r in got if r.doc_id == 5]
    assert len(alike) == 2 and abs(alike[0] - alike[1]) < 1e-6
    assert op.lm_scores(docs_of([]), shape=SMALL).count() == 0


def test_query(spark, sf):
    got = op.op1_lm_scoring(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.mean_log_likelihood.dropna().lt(0).all()


def test_scores_of_a_step_are_held_in_blocks():
    """A step of scoring or training never holds the scores of all its words at once; blocks of any size tell the same."""
    shape = op.Shape()
    rng = np.random.default_rng(6)
    slots, sides = rng.integers(0, shape.vocabulary, op.SCORE_STEP), rng.integers(0, shape.vocabulary + 1, (op.SCORE_STEP, 2 * shape.side))
    net = op.Network(shape, op.start(shape, np.bincount(slots, minlength=shape.vocabulary)))
    tracemalloc.start()
    try:
        told = net.log_p(slots, sides)
        assert tracemalloc.get_traced_memory()[1] < op.SCORE_STEP * shape.classes * 4
    finally:
        tracemalloc.stop()
    one = np.concatenate([net.log_p(slots[a : a + 100], sides[a : a + 100]) for a in range(0, 2000, 100)])
    assert np.allclose(told[:2000], one, atol=1e-4)


def test_words_are_looked_up_in_bulk(monkeypatch):
    """A hash for each different word of a step and one for each different beginning (two a word before); the same numbers word by word."""
    shape, rng = SMALL, np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("abcdeÜñ日\u00a0\x1c"), rng.integers(1, 9))) for _ in range(3000)})
    hashed = lambda x: int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64))
    known, counts, shared = words[:1000], np.arange(1000, 0, -1) + 5, rng.integers(0, 9000, shape.vocabulary - shape.frequent)
    lexicon = op.Lexicon(shape, np.array([hashed(w) for w in known]), counts, shared)
    seen = []
    monkeypatch.setattr(op, "xxhash", SimpleNamespace(xxh64_intdigest=lambda x, seed: seen.append(x) or xxhash.xxh64_intdigest(x, seed)))
    mixed = rng.permutation(words + words)
    lengths, slots, logs, rest = op.Reader(lexicon).read([" \t" + " ".join(mixed[:4000]) + "\n", "", "\x0b", " ".join(mixed[4000:])])
    assert lengths == [4000, 0, 0, len(mixed) - 4000]
    assert len(seen) < len(words) + 200
    rank = {w: i for i, w in enumerate(known)}
    for w, slot, log, r in zip(mixed.tolist(), slots.tolist(), logs.tolist(), rest.tolist(), strict=True):
        i, k = rank.get(w, -1), hashed(w[:2]) % len(shared)
        assert slot == (shape.slot(i) if 0 <= i < shape.frequent else shape.slot(shape.frequent + k))
        assert r == (0 if i >= 0 else hashed(w))
        assert math.isclose(log, 0.0 if 0 <= i < shape.frequent else math.log((counts[i] if i >= 0 else 1) / max(1, shared[k])), abs_tol=1e-12)


def test_large_weights():
    """Scores that exp can't take in single precision are shifted first, in scoring and in training."""
    rng = np.random.default_rng(9)
    state = network(5)
    net = op.Network(SMALL, op.State(state.flat * 60, state.seen))
    assert not op._bounded(net._layers()[0]) and op._bounded(state._layers()[0])
    slots, sides = rng.integers(0, 64, 40), rng.integers(0, 65, (40, 4))
    want = [plain_log_p(net, int(s), [int(x) for x in xs]) for s, xs in zip(slots, sides, strict=True)]
    assert min(want) < -100 and np.allclose(net.log_p(slots, sides), want, rtol=1e-4, atol=1e-3)
    net.learn(slots, sides, 0.1)
    assert np.isfinite(net.flat).all()
