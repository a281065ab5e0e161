"""Steps that must not meet in one task: the same rows whether cut in many pieces or not."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The smallest events, three of each time: a table in which an order by time alone is not whole."""
    at = tmp_path_factory.mktemp("tied")
    duckdb.sql(f"COPY (SELECT event_id * 3 + k AS event_id, ts, user_id + k AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(3) t(k) ORDER BY event_id) TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


def same(spark, sf, name):
    got, c = queries.QUERIES[name](spark, sf), duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    names = sorted(got.columns)
    return sorted(map(tuple, got.select(*names).collect())) == sorted(c.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_csv_ingest_in_many_files(spark, tied, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "CSV_LINES", 250)
    monkeypatch.setattr(queries.lanes, "scratch", lambda spark, name: str(tmp_path / name))
    assert same(spark, tied, "csv_ingest")
    assert len(list((tmp_path / "csv").glob("*.gz"))) == 12


def test_shadow_book_is_folded_without_python(spark):
    """Odd streams: books seeded by either kind, empty and repeated levels, snapshots in a row, blocks without messages."""
    from random import Random

    from tidewheel.operators import shadow

    r, rows = Random(3), []
    for sym in range(4):
        recv = 0
        for i in range(300):
            recv += r.choice([0, 1, 7, 400])
            levels = [(r.randrange(2), r.randrange(6), r.choice([0, 0, 1, 2, 3])) for _ in range(r.choice([0, 1, 3, 9]))]
            rows.append((sym, recv * 10, recv, (sym % 2 == 0) if i == 0 else r.random() < 0.3, r.random() < 0.2, levels, i))
    m = spark.createDataFrame(rows, "sym int, ts long, recv long, snapshot boolean, gapped boolean, levels array<struct<side int, price_raw long, qty_raw long>>, m int")
    want = []
    for sym in range(4):
        book = shadow.ShadowBook()
        for s, ts, recv, snapshot, gapped, levels, _ in rows:
            if s == sym:
                want += [(sym, ts, recv, *change) for change in book.ingest(snapshot, gapped, levels)]
    for block in (50, 1 << 40):
        got = shadow.reconcile(m, block, ties=("m",))
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and got.dtypes == [(f.split()[0], {"long": "bigint"}.get(f.split()[1], f.split()[1])) for f in shadow.DELTA.split(", ")]


@pytest.mark.parametrize("step", [0, 7, 50, (1 << 63) - 1])
def test_weave_in_blocks(spark, step):
    """Order and steps are those of one sweep, for any block: runs that cross blocks, a null symbol, times that step back."""
    from random import Random

    from tidewheel.plans import weave

    r = Random(step)
    lane = lambda name, n: [(r.choice([0, 1, None]), name, i, 1000 + i // 2 + r.randrange(40)) for i in range(n)]
    rows = {n: lane(n, k) for n, k in (("trades", 200), ("deltas", 90), ("mc", 9))}
    woven = []
    for sym in (0, 1, None):
        all_ = []
        for ix, name in ((0, "trades"), (1, "deltas"), (4, "mc")):
            top = 0
            for s, _, seq, ts in rows[name]:
                if s == sym:
                    top = max(top, ts)
                    all_.append((top, ix, seq, name, ts))
        steps, last = 0, None
        for ord_, (arrival, ix, seq, name, ts) in enumerate(sorted(all_), 1):
            at = (ix, arrival if step == 0 else 0 if step == weave.ALL else arrival - arrival % step)
            steps, last = steps + (at != last), at
            woven.append((sym, name, ix, seq, ts, arrival, ord_, steps))
    lanes_ = [weave.arrivals(spark.createDataFrame(v, "sym int, lane string, seq long, ts long"), k, None) for k, v in rows.items()]
    for block in (10, 1 << 40):
        got = weave.weave(lanes_, step, block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(woven, key=str)
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(sym#" not in plan  # no symbol's rows meet in one task
    assert sum(x["n"] for x in weave.steps(got).collect()) == 299


def test_woven_steps_of_ties(spark, tied):
    assert all(same(spark, tied, n) for n in ("weave_steps_event", "weave_steps_1h", "step_census", "weave_order"))


@pytest.mark.parametrize("name", ["live_bars", "live_recorded", "live_trailing"])
def test_feed_in_bounded_files(spark, tied, monkeypatch, tmp_path, name):
    from itertools import count

    n = count()
    monkeypatch.setattr(queries, "FEED_ROWS", 500)
    monkeypatch.setattr(queries.lanes, "scratch", lambda spark, name: str(tmp_path / f"{name}-{next(n)}"))
    assert same(spark, tied, name)
    fed = sorted(next(tmp_path.glob("feed-*")).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    order = "monotonic_seq" if name == "live_recorded" else "seq"
    spans = [duckdb.sql(f"SELECT min({order}), max({order}), count(*) FROM '{f}'").fetchall()[0] for f in fed]
    assert len(fed) == 6 and sum(x[2] for x in spans) == 3000 and max(x[2] for x in spans) < 700
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_many_batches_in_one_write(spark, tmp_path, monkeypatch):
    """Batches written at once are those written one by one: replaced by name, refused as a whole, small files."""
    from tidewheel.sources.lanes import Catalog, CatalogError

    rows = lambda *spec: spark.createDataFrame([(b, s, t, None, None, i, 0, 5, 1) for b, s, ts in spec for i, t in enumerate(ts)], "batch string, sym int, ts_venue_exec long, ts_venue_send long, ts_local_recv long, monotonic_seq long, side int, price_raw int, qty_raw long")
    catalog = Catalog(spark, str(tmp_path / "cat"))
    assert catalog.write_batches("trades", rows(("a", 0, range(9)), ("b-1", 0, range(9, 30)), ("a", 1, [3])), max_bytes=200, apart=True) == 3
    read = lambda batch=None: sorted(r["ts_venue_exec"] for r in catalog.read("trades", "0", 0, 99, batch).collect())
    assert read() == list(range(30)) and read("b-1") == list(range(9, 30))
    assert len(list((tmp_path / "cat" / "trades" / "batch=a" / "sym=0").rglob("*.parquet"))) == 2 and not list((tmp_path / "cat" / "aside").iterdir())
    for bad in (rows(("c", 0, [29, 40])), rows(("c", 0, [50, 60]), ("d", 0, [55])), rows(("c", 1, [0, 70])), rows(("c", 0, [40]), ("d", 0, [12]))):
        with pytest.raises(CatalogError):
            catalog.write_batches("trades", bad, apart=True)
    assert read() == list(range(30))
    catalog.write_batch("trades", rows(("", 0, [50])).drop("batch"), "b-1")
    assert read() == [*range(9), 50] and [r["n"] for r in catalog.listing("trades", "0")] == [9, 1]


def test_catalog_listing_writes_once(spark, monkeypatch, tied):
    from tidewheel.sources.lanes import Catalog

    calls, write = [], Catalog.write_batches
    monkeypatch.setattr(Catalog, "write_batches", lambda self, *a, **k: calls.append(a[0]) or write(self, *a, **k))
    assert same(spark, tied, "catalog_listing") and calls == ["trades"]
