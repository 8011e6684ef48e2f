"""Gradients against finite differences, multipliers and paths against the output, training against a loop."""

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import numpy as np
import pytest

from strandweave.functions import sequences as fx
from strandweave.operators import layers as ly
from strandweave.plans import model_queries as mq


def network(seed=0, tasks=2):
    r = np.random.default_rng(seed)
    return [
        ly.Conv(r.normal(size=(5, 4, 4)), r.normal(size=5)), ly.Relu(), ly.Conv(r.normal(size=(6, 3, 5)), r.normal(size=6)), ly.Relu(), ly.Mean(),
        ly.Dense(r.normal(size=(7, 6)), r.normal(size=7)), ly.Relu(), ly.Dense(r.normal(size=(tasks, 7)), r.normal(size=tasks)),
    ]


def random_sequence(seed, n=40):
    return "".join(np.random.default_rng(seed).choice(list("ACGTN"), n))


def output(net, x):
    return ly.activations(net, x)[-1]


def test_gradients_equal_finite_differences():
    net, x = network(), ly.one_hot(random_sequence(1)) + 0.01 * np.random.default_rng(2).normal(size=(40, 4))
    seed = np.array([0.3, -1.2])
    found = ly.gradient(net, ly.activations(net, x), seed)
    for i, j in [(0, 0), (3, 1), (20, 2), (39, 3)]:
        step = np.zeros_like(x)
        step[i, j] = 1e-6
        assert found[i, j] == pytest.approx(seed @ (output(net, x + step) - output(net, x - step)) / 2e-6, abs=1e-6)


def test_parameter_gradients_equal_finite_differences(spark):
    net, loss = network(3), ly.Loss(positive=np.array([2.0, 0.5]), task=np.array([1.5, 0.7]))
    rows = [(random_sequence(i, 30 + i), float(i % 2), None if i == 3 else float(i % 3 == 0)) for i in range(8)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "seq string, y double, z double").repartition(3)
    total, n, g = ly.summed(df, net, ly.one_hot, "seq", ["y", "z"], loss)
    assert n == 8
    flat = ly.flattened(net)

    def whole(f):
        return sum(loss.of(output(ly.filled(net, f), ly.one_hot(s)), np.array([y, np.nan if z is None else z]))[0] for s, y, z in rows if s is not None)

    assert total == pytest.approx(whole(flat))
    for k in range(0, len(flat), 17):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        assert g[k] == pytest.approx((whole(flat + step) - whole(flat - step)) / 2e-6, rel=1e-4, abs=1e-5)


def test_multipliers_sum_to_the_difference():
    net, x = network(4), ly.one_hot(random_sequence(5))
    for k in range(5):
        reference = ly.one_hot(random_sequence(10 + k))
        value, found = ly.importances_of(net, x, 1, "multipliers", [reference], 0)
        assert found.sum() == pytest.approx(value - output(net, reference)[1])
    value, found = ly.importances_of(net, x, 0, "multipliers", [ly.one_hot(random_sequence(k)) for k in (20, 21)], 0)
    assert found.sum() == pytest.approx(value - np.mean([output(net, ly.one_hot(random_sequence(k)))[0] for k in (20, 21)]))
    _, same = ly.importances_of(net, x, 0, "multipliers", [x], 0)
    assert np.abs(same).max() == 0


def test_path_sums_to_the_difference():
    net, x = network(6), ly.one_hot(random_sequence(7))
    value, found = ly.importances_of(net, x, 0, "path", [], 2000)
    assert found.sum() == pytest.approx(value - output(net, np.zeros_like(x))[0], abs=0.01)
    with pytest.raises(ValueError, match="rule"):
        ly.importances_of(net, x, 0, "other", [], 1)


def test_importances_of_rows(spark):
    net = network(8)
    rows = [(i, random_sequence(i, n), [random_sequence(100 + i, n), random_sequence(200 + i, n)]) for i, n in enumerate([40, 90, 7, 3, 0])] + [(9, None, None)]
    df = spark.createDataFrame(rows, "id int, seq string, refs array<string>").repartition(3)
    for rule in ("gradient", "multipliers", "path"):
        got = {r.id: r for r in ly.with_importances(df, net, "seq", rule, 1, "refs", steps=4).collect()}
        for i, seq, refs in rows:
            value, found = ly.importances_of(net, ly.one_hot(seq or ""), 1, rule, [ly.one_hot(x) for x in refs or []], 4)
            assert got[i].logit == pytest.approx(value) and got[i].importances == pytest.approx(found.sum(axis=1)) and got[i].seq == seq


def flat_rows(n=200):
    r = np.random.default_rng(9)
    x = r.normal(size=(n, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 * r.normal(size=n) > 0.4).astype(float)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = flat_rows()
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y double").repartition(4)
    return df.where("id < 150"), df.where("id >= 150")


def numpy_loop(rounds, positive, task, rate=0.05, decay=0.9, patience=99, turned=False):
    x, y = flat_rows()
    if turned:
        y[150:] = 1 - y[150:]
    w, ms, best, losses = np.zeros(4), np.ones(4), (np.inf, None), []
    design = np.c_[x, np.ones(len(x))]
    for k in range(rounds):
        p = 1 / (1 + np.exp(-design[:150] @ w))
        g = task * (((1 - y[:150]) * p - positive * y[:150] * (1 - p)) @ design[:150]) / 150
        ms = decay * ms + (1 - decay) * g**2
        w = w - rate * g / np.sqrt(ms + 1e-10)
        z = design[150:] @ w
        losses.append(float(np.mean(task * (positive * y[150:] * np.logaddexp(0, -z) + (1 - y[150:]) * np.logaddexp(0, z)))))
        if losses[-1] < best[0]:
            best = losses[-1], w, k
        elif k - best[2] >= patience:
            break
    return losses, best[1]


def start():
    return [ly.Mean(), ly.Dense(np.zeros((1, 3)), np.zeros(1))]


def test_training_equals_a_loop(data):
    train, valid = data
    task, positive = ly.task_weights(train, ["y"])
    y = flat_rows()[1][:150]
    assert task[0] == pytest.approx(y.sum() / (150 - y.sum())) and positive[0] == pytest.approx(1 / task[0])
    net, state = ly.trained(train, valid, start(), ly.one_place, "x", ["y"], ly.Loss(positive=positive, task=task), rounds=5, rate=0.05, decay=0.9)
    losses, w = numpy_loop(5, positive[0], task[0])
    assert state.losses == pytest.approx(losses) and ly.flattened(net) == pytest.approx(w)


def test_training_goes_on_after_a_stop(data, spark, tmp_path):
    train, valid = data
    whole, _ = ly.trained(train, valid, start(), ly.one_place, "x", ["y"], rounds=5, rate=0.05)
    path = f"file://{tmp_path}/state"
    ly.trained(train, valid, start(), ly.one_place, "x", ["y"], rounds=2, rate=0.05, path=path)
    state = ly.State.load(spark, path)
    assert state.rounds == 2
    again, state = ly.trained(train, valid, start(), ly.one_place, "x", ["y"], rounds=5, rate=0.05, state=state)
    assert ly.flattened(again) == pytest.approx(ly.flattened(whole)) and len(state.losses) == 5


def test_training_stops_early(data):
    train, valid = data
    turned = valid.selectExpr("x", "1 - y AS y")  # what is learned makes these worse
    net, state = ly.trained(train, turned, start(), ly.one_place, "x", ["y"], rounds=30, patience=2, rate=0.05, decay=0.9)
    losses, w = numpy_loop(30, 1.0, 1.0, patience=2, turned=True)
    assert len(state.losses) == len(losses) == 3 and ly.flattened(net) == pytest.approx(w)


def test_squared_error():
    value, g = ly.Loss("squared").of(np.array([1.0, 2.0]), np.array([3.0, np.nan]))
    assert value == 4 and g.tolist() == [-4.0, 0.0]


def test_sequences_in_a_line_have_the_importances_of_each():
    r = np.random.default_rng(11)
    networks = [network(8), mq.SCORER, [ly.Mean()], [ly.Relu(), ly.Conv(r.normal(size=(3, 2, 4)), r.normal(size=3)), ly.Mean()], [ly.Conv(r.normal(size=(3, 5, 4)), r.normal(size=3)), ly.Mean()]]
    for lengths in ([40, 0, 7, 3, 1, 2, 0, 90], [0], [2, 2], [6]):
        texts = [random_sequence(20 + i, n) for i, n in enumerate(lengths)]
        references = [["".join(r.permutation(list(t))) for _ in range(i % 4)] for i, t in enumerate(texts)]
        for net in networks:
            rules = ["gradient", "path", "multipliers"]
            values, found = ly.importances_by_base(net, [ly.base_codes(t) for t in texts], 0, rules, [[ly.base_codes(x) for x in some] for some in references], 4)
            for rule, mine in zip(rules, found, strict=True):
                want = [ly.importances_of(net, ly.one_hot(t), 0, rule, [ly.one_hot(x) for x in some], 4) for t, some in zip(texts, references, strict=True)]
                assert values == pytest.approx([w[0] for w in want]) and mine == pytest.approx(np.concatenate([w[1].sum(axis=1) for w in want]), abs=1e-12)
    with pytest.raises(ValueError, match="as long"):
        ly.importances_by_base(mq.SCORER, [ly.base_codes("ACGT")], 0, ["multipliers"], [[ly.base_codes("ACG")]], 1)


def test_longer_lines_are_cut(monkeypatch):
    monkeypatch.setattr(ly, "TOGETHER", 10)
    assert list(ly.together([4, 6, 0, 11, 3, 3, 3, 1, 1])) == [(0, 2), (2, 1), (3, 1), (4, 4), (8, 1)] and list(ly.together([])) == []


def test_arrays_are_shuffled_as_texts(monkeypatch):
    for places in (1 << 16, 4):
        monkeypatch.setattr(fx, "PLACES", places)
        for lengths in ([5], [0, 0], [1, 2, 3, 0, 4, 101, 300], []):
            texts, keys = [random_sequence(i, n) for i, n in enumerate(lengths)], [f"{i}:shuffle" for i in range(len(lengths))]
            for size in (1, 2, 3):
                want = [fx.shuffled_blocks(t, k, size) for t, k in zip(texts, keys, strict=True)]
                assert [c.tolist() for c in fx.shuffled_codes([ly.base_codes(t) for t in texts], keys, size)] == [ly.base_codes(t).tolist() for t in want]


def half_up(x):
    return float((Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def exact(text):
    """The scorer's output and the sum of mean gradients times input, as fractions."""
    weights, windows = [[{b: Fraction(float(w)) for b, w in zip("ACGT", row, strict=True)} for row in f] for f in mq.FILTERS], max(len(text) - 2, 1)
    logit, along = Fraction(mq.OUT_SHIFT), Fraction(0)
    for shift, out, rows in zip(map(Fraction, mq.SHIFTS), map(Fraction, mq.OUT), weights, strict=True):
        for i in range(len(text) - 2):
            value = sum(row.get(text[i + j], Fraction(0)) for j, row in enumerate(rows))
            logit += out * max(value + shift, 0) / windows
            along += out * value * sum(value * k / 8 + shift > 0 for k in range(1, 9)) / 8 / windows
    return logit, along


def test_multiplier_importances_travel_once_and_are_exact(spark, tmp_path):
    """One pass through Python, no importances on the way back; null and empty texts; what lies between two roundings."""
    texts = [None, "", "a", "ab", "abc", *["".join(np.random.default_rng(i).choice(list("abcdefg h"), n)) for i, n in enumerate([34] * 60 + [66] * 40 + [82] * 60 + [3000])]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = mq.multiplier_importances(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "lambda" not in plan
    bases = str.maketrans("abcdefgh ", "ACGTACGTN")
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        whole = (text or "").translate(bases)
        logit, along = exact(whole)
        against = logit - sum(exact(fx.shuffled_blocks(whole, f"{i}:{k}:shuffle"))[0] for k in (1, 2)) / 2
        assert (rows[i].logit, rows[i].against, rows[i].along) == (half_up(logit), half_up(against), half_up(along))


def test_totals_of_rows(spark):
    net = network(8)
    rows = [(i, random_sequence(i, n), [f"{i}:{k}" for k in range(i)]) for i, n in enumerate([40, 90, 7, 3, 0])] + [(9, None, None)]
    df = spark.createDataFrame(rows, "id int, seq string, keys array<string>").repartition(3)
    totals = ly.importance_totals(df, net, "seq", {"a": "multipliers", "b": "path", "c": "gradient"}, 1, "keys", 4)
    assert totals.columns == ["id", "logit", "a", "b", "c"]
    for r in totals.collect():
        _, seq, keys = next(x for x in rows if x[0] == r.id)
        for rule, total in (("multipliers", r.a), ("path", r.b), ("gradient", r.c)):
            value, found = ly.importances_of(net, ly.one_hot(seq or ""), 1, rule, [ly.one_hot(fx.shuffled_blocks(seq, k)) for k in keys or []], 4)
            assert r.logit == pytest.approx(value) and total == pytest.approx(found.sum(), abs=1e-12)
