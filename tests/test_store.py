"""Increments equal a full build, a build that dies is not seen, and the hub is not shuffled."""

import random
import re
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from conftest import streams_of

from tidemark import Params
from tidemark.operators import panel
from tidemark.sources.store import CLIENT, DATED, WHOLE, Store, build_in_steps
from tidemark.sources.streams import Streams

P = replace(
    Params(), grid_lead_days=4, grid_trail_days=3, grid_step_days=2, label_days=(2, 3), purchase_windows=(3, 6), activity_days=4
)
NAMES = [*CLIENT, *DATED, *WHOLE, "int_client_day"]


def log(spark, days=range(14), seed=5, clients=40):
    rng = random.Random(seed)
    rows = {k: [] for k in ("buy", "add", "remove", "visit", "search")}
    for d in days:
        for _ in range(60):
            at = datetime(2024, 1, 1) + timedelta(days=d, seconds=rng.choice((0, rng.randrange(86_400))))
            kind = rng.choice(("buy", "add", "remove", "visit", "visit", "search"))
            item = str(rng.randrange(9)) if kind == "search" else rng.randrange(9)
            rows[kind].append((rng.randrange(clients), at.isoformat(), item))
    rows["visit"].append((99, None, 1))
    return streams_of(spark, products=[(k, k % 3, 1, "[1]") for k in range(9)], **rows)


def joined(a: Streams, b: Streams) -> Streams:
    kinds = ("buy", "add", "remove", "visit", "search")
    return replace(a, **{k: getattr(a, k).unionByName(getattr(b, k)) for k in kinds})


def content(store):
    return {n: sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect()) for n in NAMES for df in [store.table(n)]}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("whole")), P, buckets=3)
    store.add(log(spark))
    return store


def test_a_day_more_equals_a_full_build(spark, whole, tmp_path):
    steps = build_in_steps(log(spark), P, str(tmp_path), [date(2024, 1, 12), date(2024, 1, 13)], buckets=3)
    want, got = content(whole), content(steps)
    for name in NAMES:
        assert got[name] == want[name], name
    assert want["mart_customer_snapshot"] and want["mart_purchase_propensity"]
    m = steps.manifest()
    assert m["version"] == 3 and len(set(m["days"].values())) == 3
    # dates out of reach of the new days were left where they were
    assert len(set(m["dates"]["mart_customer_snapshot"].values())) > 1
    fresh = panel.customer_snapshot(log(spark), P)
    assert want["mart_customer_snapshot"] == sorted(str([r[c] for c in sorted(fresh.columns)]) for r in fresh.collect())


def test_late_events_and_an_earlier_start(spark, tmp_path):
    base, late = log(spark, range(3, 14)), log(spark, (7, 9), seed=6, clients=50)
    early = log(spark, (1,), seed=7)
    store = Store(spark, str(tmp_path / "a"), P, buckets=3)
    full = Store(spark, str(tmp_path / "b"), P, buckets=3)
    for part in (base, late, early):
        store.add(part)
    full.add(joined(joined(base, late), early))
    want, got = content(full), content(store)
    for name in NAMES:
        assert got[name] == want[name], name


def test_a_killed_build_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), P, buckets=3)
    store.add(log(spark, range(10)))
    before, manifest = content(store), store.manifest()

    def dies(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            store.add(log(spark, (10,)))
    again = Store(spark, str(tmp_path), P)
    assert again.manifest() == manifest and content(again) == before and again.buckets == 3
    again.add(log(spark, (10,)))
    assert again.manifest()["version"] == 2 and content(again) != before
    now = content(again)
    assert again.vacuum() == 1 and content(again) == now  # what the dead build left


def test_rival_builds_and_empty_increments(spark, whole, tmp_path):
    with pytest.raises(RuntimeError, match="another build"):
        whole._publish(whole.manifest())
    assert whole.add(log(spark, ()).__class__(**{**log(spark, ()).__dict__, "visit": log(spark).visit.limit(0)})) == whole.manifest()
    with pytest.raises(ValueError, match="no events"):
        none = log(spark)
        Store(spark, str(tmp_path), P).add(replace(none, **{k: getattr(none, k).limit(0) for k in ("buy", "add", "remove", "visit", "search")}))


def test_the_hub_is_not_shuffled(spark, whole):
    m = whole.manifest()
    hub, starts = whole.hub(m), whole.table("int_category_start", m)
    s = replace(log(spark), day_table=hub, category_start_table=starts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = panel.customer_snapshot(s, P)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    # the branch of the hub: from its scan up to the root there is no exchange
    lines = plan.splitlines()
    scan = next(n for n, line in enumerate(lines) if re.search(r"FileScan parquet .*n_occasions.*Bucketed: true", line))
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    at, above = depth(lines[scan]), []
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            at = depth(line)
            above.append(line)
    assert not [x for x in above if "Exchange" in x], "\n".join(above)
    assert any("Window" in x for x in above) and any("HashAggregate" in x or "SortAggregate" in x for x in above)
