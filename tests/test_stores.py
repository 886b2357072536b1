"""Stores that grow by loads: activity, thresholds, user bitmaps."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.activity import merged_activity
from tidewatch.operators.quantile_store import QuantileStore, bracket
from tidewatch.sources import user_bitmaps
from tidewatch.sources.activity_store import ADDITIVE, ActivityStore
from tidewatch.sources.events import read_events, tag_events

from conftest import DATA


def _rows(df, *names):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def log(spark):
    return tag_events(read_events(spark, DATA), "raw")


@pytest.fixture(scope="module")
def whole(log):
    from tidewatch.functions.timestamps import truncate

    return _rows(merged_activity(log.withColumn("date", truncate(F.col("date"), "hour"))), "user", "date", *ADDITIVE)


def _between(log, a, b):
    return log.where((F.col("date") >= F.lit(datetime(2024, 1, a))) & (F.col("date") < F.lit(datetime(2024, 1, b)))) if b < 32 else log.where(
        F.col("date") >= F.lit(datetime(2024, 1, a))
    )


def test_loads_add_up_in_any_order(spark, log, whole, tmp_path):
    store = ActivityStore(spark, str(tmp_path))
    assert store.merged().count() == 0
    # Loads that share days: the rest of a day arrives with the next load.
    odd, even = log.where("hash(item, date) % 2 <> 0"), log.where("hash(item, date) % 2 = 0 or item is null or date is null")
    for name, part in (("late", odd), ("early", even), ("late", odd), ("none", log.limit(0))):
        store.add(name, part)
    assert _rows(store.merged(), "user", "date", *ADDITIVE) == whole
    assert store.merged().select("day").distinct().count() == len({w[1].date() for w in whole})


def test_replaced_load_loses_its_days(spark, log, tmp_path):
    store = ActivityStore(spark, str(tmp_path))
    store.add("a", _between(log, 1, 5))
    store.add("b", _between(log, 5, 9))
    store.add("a", _between(log, 2, 4))
    kept = store.merged().select("day").distinct().collect()
    assert {r.day for r in kept} == {date(2024, 1, d) for d in (2, 3, 5, 6, 7, 8)}


def test_lost_between_parts_and_merge(spark, log, whole, tmp_path, monkeypatch):
    """A crash after the parts are written: repeating the load heals the merged days."""
    store = ActivityStore(spark, str(tmp_path))
    store.add("a", _between(log, 1, 12))
    monkeypatch.setattr(ActivityStore, "_merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.add("a", _between(log, 3, 20))
    monkeypatch.undo()
    store.add("a", _between(log, 3, 20))
    store.add("b", _between(log, 1, 3))
    store.add("c", _between(log, 20, 40))
    assert _rows(store.merged(), "user", "date", *ADDITIVE) == whole


def test_only_touched_days_are_read(spark, log, tmp_path):
    store = ActivityStore(spark, str(tmp_path))
    store.add("a", log)
    before = {f for f in spark.read.parquet(f"{tmp_path}/merged").inputFiles()}
    store.add("b", _between(log, 7, 8))
    changed = before ^ set(spark.read.parquet(f"{tmp_path}/merged").inputFiles())
    assert changed and all("day=2024-01-07" in f for f in changed)


# --- thresholds ---


def _values(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value double")


@pytest.mark.parametrize("kind", ["spread", "ties", "signs", "one"])
def test_quantiles_of_loads(spark, tmp_path, kind):
    rng = random.Random(kind)
    make = {
        "spread": lambda: rng.lognormvariate(0, 3), "ties": lambda: float(rng.randrange(4)),
        "signs": lambda: rng.gauss(0, 1e-3) * 10 ** rng.randrange(6), "one": lambda: 7.25,
    }[kind]
    store, kept = QuantileStore(spark, str(tmp_path)), {}
    for name, n in (("a", 700), ("b", 1), ("c", 400), ("a", 650)):
        kept[name] = [make() for _ in range(n)]
        store.add(name, _values(spark, [*kept[name], None, float("nan")]))
    values = [v for part in kept.values() for v in part]
    probs = [0.0, 0.01, 0.5, 0.75, 0.95, 0.98, 1.0]
    found = store.quantiles(probs)
    assert found.values == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=1e-15) and found.rows == len(values)


def test_only_the_bracket_is_scanned(spark, tmp_path):
    store, rng = QuantileStore(spark, str(tmp_path)), random.Random(4)
    values = [[rng.expovariate(1) for _ in range(20_000)] for _ in range(2)]
    for i, part in enumerate(values):
        store.add(str(i), _values(spark, part))
    found = store.quantiles([0.75, 0.95, 0.98])
    assert found.values == pytest.approx(np.quantile(sum(values, []), [0.75, 0.95, 0.98]).tolist())
    assert found.scanned < 0.02 * found.rows
    assert QuantileStore(spark, f"{tmp_path}/0") is not None


def test_bracket_holds_every_rank():
    rng = random.Random(9)
    for _ in range(300):
        values = sorted(rng.choice([rng.randrange(8), rng.random() * 8]) for _ in range(rng.randrange(1, 30)))
        cut = sorted(rng.sample(range(len(values) + 1), min(4, len(values))))
        groups = [values[a:b] for a, b in zip([0, *cut], [*cut, len(values)], strict=True) if b > a]
        shuffled = values[:]
        rng.shuffle(shuffled)
        groups += [shuffled]  # one that overlaps all others
        every = sorted(values + shuffled)
        buckets = [(min(g), max(g), len(g)) for g in groups]
        for rank in range(len(every)):
            b = bracket(buckets, rank)
            assert b.low <= every[rank] <= b.high
            assert b.below == sum(v < b.low for v in every) and b.within == sum(b.low <= v <= b.high for v in every)


# --- bitmaps ---


def test_bitmaps_count_users(spark):
    rng = random.Random(6)
    people = [f"user {i}" for i in range(300)]
    day = lambda i: datetime(2024, 2, 1) + timedelta(days=i)
    rows = [(rng.choice(people), day(rng.randrange(20)), rng.choice(["Low", "High", None])) for _ in range(2000)]
    rows += [("hot", day(3), "High")] * 500 + [(None, day(1), "High"), ("undated", None, "Low")]
    risk = spark.createDataFrame(rows, "user string, date timestamp_ntz, risk_level string").repartition(5)
    first = user_bitmaps.number_users(risk.where("date < timestamp_ntz'2024-02-06'"))
    numbers = user_bitmaps.number_users(risk, first)
    assert sorted(r.number for r in numbers.collect()) == list(range(risk.where("user is not null").select("user").distinct().count()))
    assert first.join(numbers, ["user", "number"]).count() == first.count()
    ranges = [("all", None, None), ("some", date(2024, 2, 3), date(2024, 2, 5)), ("from", date(2024, 2, 18), None), ("none", date(2030, 1, 1), None)]
    bitmaps = user_bitmaps.daily_bitmaps(risk, numbers)
    got = {r.label: (r.total_unique_users, r.high_risk_users) for r in user_bitmaps.distinct_users(bitmaps, ranges).collect()}
    for label, start, end in ranges:
        kept = [r for r in rows if r[0] and (start is None or (r[1] and r[1].date() >= start)) and (end is None or (r[1] and r[1].date() <= end))]
        assert got[label] == (len({r[0] for r in kept}), len({r[0] for r in kept if r[2] == "High"}))
    nothing = user_bitmaps.daily_bitmaps(risk.limit(0), numbers)
    assert [tuple(r) for r in user_bitmaps.distinct_users(nothing, ranges[:1]).collect()] == [("all", 0, 0)]


def test_ranges_do_not_read_the_rows(spark, tmp_path):
    risk = spark.createDataFrame([(1, datetime(2024, 1, 1), "High")], "user bigint, date timestamp_ntz, risk_level string")
    bitmaps = user_bitmaps.daily_bitmaps(risk, user_bitmaps.number_users(risk))
    bitmaps.write.parquet(f"{tmp_path}/days")
    found = user_bitmaps.distinct_users(spark.read.parquet(f"{tmp_path}/days"), [("all", None, None)])
    assert [f.rsplit("/", 2)[-2] for f in found.inputFiles()] == ["days"] * len(found.inputFiles())
