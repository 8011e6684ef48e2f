"""Running metrics by key: each batch says what a batch query says of all rows so far; keys end; a stop loses nothing."""

import datetime
import random

import pytest

from strandweave.streaming import state

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def rows_at(minute, n, seed, keys=("a", "b", None)):
    r = random.Random(seed)
    return [(r.choice(keys), START + datetime.timedelta(minutes=minute, seconds=i), r.choice([0.0, 1.0, 0.5, r.random(), None]), r.choice([0, 1, 1, None])) for i in range(n)]


SCHEMA = "k string, ts timestamp, score double, label int"


def run(spark, tmp_path, batches, name, gap="1 hour", late="10 minutes", stop_after=None):
    source = tmp_path / name
    source.mkdir()
    out, checkpoint = f"file://{tmp_path}/{name}-out", f"file://{tmp_path}/{name}-checkpoint"

    def stream():
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        return state.running_metrics(df, "k", gap, late)

    for i, rows in enumerate(batches):
        part = tmp_path / f"{name}-{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(part))
        file = next(part.glob("*.parquet"))
        file.rename(source / f"{i:03d}.parquet")
        if i + 1 == stop_after:
            state.replayed(stream(), out, checkpoint)
    state.replayed(stream(), out, checkpoint)
    return sorted(map(tuple, spark.read.parquet(out).select("batch", "k", "n", "mse", "pearson", "auroc", "ended").collect()), key=lambda r: (r[0], r[1] or "", r[6]))


def expected(spark, rows):
    return {r.k: (r.n, r.mse, r.pearson, r.auroc) for r in state.metrics_so_far(spark.createDataFrame(rows, SCHEMA), "k").collect()}


@pytest.mark.parametrize("stop_after", [None, 2])
def test_every_batch_equals_all_rows_so_far(spark, tmp_path, stop_after):
    batches = [rows_at(5 * i, 60, i, ("a", "b", None) if i != 1 else ("b",)) for i in range(4)]
    got = run(spark, tmp_path, batches, "s", stop_after=stop_after)
    seen = []
    for i, rows in enumerate(batches):
        seen += rows
        whole = expected(spark, seen)
        here = {r[1]: r[2:6] for r in got if r[2] and not r[6] and _order(got, r) == i}
        assert here.keys() == {r[0] for r in rows if None not in r[2:]}
        for key, values in here.items():
            assert values == pytest.approx(whole[key])


def _order(got, row):
    """Which of the batches with new rows a row is of: batches without any only move the watermark."""
    return sorted({r[0] for r in got if not r[6]}).index(row[0])


def test_keys_end_and_late_rows(spark, tmp_path):
    first, later = rows_at(0, 40, 1, ("a",)), rows_at(300, 40, 2, ("b",))
    late = rows_at(1, 30, 3, ("c",))  # hours behind the watermark by then
    again = rows_at(400, 20, 4, ("a",))
    got = run(spark, tmp_path, [first, later, late, again], "e", gap="30 minutes")
    ended = [r for r in got if r[6] and r[1] == "a"]
    assert len(ended) == 1 and ended[0][2:6] == pytest.approx(expected(spark, first)["a"])
    assert not [r for r in got if r[1] == "c"]
    assert [r for r in got if r[1] == "a" and not r[6]][-1][2:6] == pytest.approx(expected(spark, again)["a"])
