"""Pushes, the store, streams of files, and answers, on a small corpus of our own."""

import json
import random

import pytest

from logweir.api import LogEngine, tenant_of
from logweir.functions.stream_ids import wire_stream_id
from logweir.lang.errors import InvalidPush
from logweir.lang.parser import parse
from logweir.lang.tree import Both, Either, LogQuery, Predicate
from logweir.plans.compiler import matching_lines, to_df
from logweir.sources.push import check_push, refusal
from logweir.sources.store import LogStore
from logweir.streaming.ingest import start_ingest

NOW = 1_720_000_000_000_000_000
MINUTE = 60_000_000_000
LINES = [
    ({"zone": "eu", "app": "shop"}, 30, "cart opened", {"id": "1", "path": "/cart", "ms": "12"}),
    ({"zone": "eu", "app": "shop"}, 20, "cart failed", {"id": "2", "path": "/cart", "ms": "950", "level": "error"}),
    ({"zone": "eu", "app": "mailer"}, 15, "mail queued", {"id": "3", "queue": "out"}),
    ({"zone": "us", "app": "mailer"}, 10, "mail sent", {"id": "4", "queue": "out", "empty": ""}),
    ({"zone": "us", "app": "mailer"}, 10, "mail sent", {"id": "5", "queue": "in", "zone": "override"}),
    ({"zone": "eu", "app": "shop"}, 60 * 24 * 2, "older", {"id": "6"}),
    ({"zone": "eu", "app": "shop"}, 60 * 24 * 40, "too old", {"id": "7"}),
    ({"zone": "eu", "app": "shop"}, 5, "big", {"id": "8", "v": "x" * 16385}),
]
CASES = [
    ("[-1h,now] {zone=eu}", 5, ["3", "2", "1"]),
    ("[-3d,now] {zone=eu AND app=shop}", 5, ["2", "1", "6"]),
    ("[-1h,now] {app=mailer} queue=out", 5, ["4", "3"]),
    ("[-1h,now] {zone=eu OR zone=us} path!=/x", 5, ["2", "1"]),
    ("[-1h,now] queue!=out", 5, ["5"]),
    ("[-1h,now] zone=us", 5, ["4"]),
    ("[-1h,now] zone=override", 5, ["5"]),
    ("[-1h,now] _msg='cart failed'", 5, ["2"]),
    ("[-1h,now] (path=/cart or queue=in) id!=1", 5, ["5", "2"]),
    ("[-1h,now] empty=''", 5, []),
    ("[-1h,now] ms>100", 5, ["2"]),
    ("[-1h,now] {zone=eu}", 6, []),
    ("[-1h,now] id=1", 6, []),
    ("[-20m,now] {app=shop}", 5, ["2"]),
    ("[-1h,-20m] {app=shop}", 5, ["2", "1"]),
]


def body(lines, now=NOW):
    return json.dumps({"streams": [{"stream": t, "values": [[str(now - m * MINUTE), msg, f]]} for t, m, msg, f in lines]})


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = LogEngine(LogStore(spark, str(tmp_path_factory.mktemp("engine")), ("ms",)))
    assert e.ingest_push(body(LINES), 5) == len(LINES)
    assert e.query("[-1h,now] {zone=eu}", 5, NOW).count() == 0  # nothing was flushed
    e.flush(NOW)
    e.ingest_push(body([({"zone": "eu"}, 3, "other tenant", {"id": "9"})]), 8)
    e.flush(NOW)
    return e


@pytest.mark.parametrize(("text", "tenant", "ids"), CASES)
def test_golden(engine, text, tenant, ids):
    got = [r["fields"]["id"] for r in engine.query(text, tenant, NOW).collect()]
    assert sorted(got) == sorted(ids) and (got == ids or "mail sent" in text)


def test_answer(engine):
    answer = json.loads(engine.query_response("[-1h,now] {app=mailer zone=us} queue=out", 5, NOW))
    assert answer == {"lines": [{"_time": "2024-07-03T09:36:40.000Z", "_msg": "mail sent", "app": "mailer", "id": "4", "queue": "out", "zone": "us"}]}


def test_streams(engine):
    assert engine.stream_ids(5, NOW, since="1h").count() == 3
    assert engine.stream_ids(5, NOW, from_ns=1, to_ns=1).count() == 0
    one = engine.store.streams().where("tenant_id = 8").first()["stream_id"]
    assert engine.query_json({"start": 1, "end": NOW, "streamIDs": [one, one]}, 8).count() == 1
    assert engine.query_json({"start": 1, "end": NOW, "streamIDs": []}, 8).count() == 0
    assert engine.query_json({"start": 1, "end": NOW, "streamIDs": [one]}, 5).count() == 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, engine):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(engine.query("[-1h,now] {zone=eu} ms=12", 5, NOW))
    assert "PartitionFilters: [isnotnull(day" in p and "PushedFilters" in p
    assert "GreaterThanOrEqual(ts_ns" in p and "EqualTo(tenant_id,5)" in p and "EqualTo(f_ms,12)" in p
    assert "TakeOrderedAndProject" in p
    # Few streams are named to the scan, many are joined.
    assert "LeftSemi" not in p and "EqualTo(stream_id," in p or "In(stream_id," in p
    q = parse("[-1h,now] {zone=eu} ms=12", NOW)
    p = plan(to_df(engine.store.lines(), engine.store.streams(), 5, q, most_pushed=1))
    assert "LeftSemi" in p
    assert engine.run(q, 5).count() == to_df(engine.store.lines(), engine.store.streams(), 5, q).count()


def test_compaction_and_retention(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    e = LogEngine(store)
    for n in range(3):
        e.ingest_push(body([({"a": "b"}, n, f"line {n}", {"id": str(n)})]), 0)
        e.flush(NOW)
    day = str(store.lines().first()["day"])
    before = sorted(map(str, store.lines().collect()))
    assert len(list((tmp_path / "s/lines" / f"day={day}").glob("*.parquet"))) == 3 and store.streams().count() == 1
    store.compact(day)
    assert sorted(map(str, store.lines().collect())) == before
    assert len(list((tmp_path / "s/lines" / f"day={day}").glob("*.parquet"))) == 1 and store.disk_bytes() > 0
    assert store.drop_before("2025-01-01") == ["03072024"] and store.lines().count() == 0


def some_store(spark, path, n=3):
    store = LogStore(spark, str(path))
    e = LogEngine(store)
    for k in range(n):
        e.ingest_push(body([({"a": "b"}, k, f"line {k}", {"id": str(k)})]), 0)
        e.flush(NOW)
    return store, str(store.lines().first()["day"]), sorted(map(str, store.lines().collect()))


class Lost(Exception):
    pass


class LosingFs:
    """A file system whose driver is lost, or whose renames fail, at the nth step."""

    def __init__(self, fs, steps, refuse=False):
        self.fs, self.steps, self.refuse = fs, steps, refuse

    def __getattr__(self, name):
        f = getattr(self.fs, name)

        def call(*args):
            if name in ("rename", "delete", "mkdirs", "create"):
                self.steps -= 1
                if self.steps < 0:
                    if not self.refuse:
                        raise Lost
                    if name == "rename":
                        return False
            return f(*args)

        return call


@pytest.mark.parametrize("refuse", [False, True])
def test_compaction_survives_at_every_step(spark, tmp_path, monkeypatch, refuse):
    store, day, before = some_store(spark, tmp_path / "s")
    for steps in range(9):
        real = LogStore._fs
        losing = LosingFs(store._fs(), steps, refuse)
        monkeypatch.setattr(LogStore, "_fs", lambda self, losing=losing: losing)
        try:
            store.compact(day)
        except (Lost, OSError):
            pass
        monkeypatch.setattr(LogStore, "_fs", real)
        assert sorted(map(str, LogStore(spark, store.path).lines().collect())) == before, steps
    assert not list((tmp_path / "s/journal").glob("[!.]*"))


def test_lines_appended_during_compaction_stay(spark, tmp_path, monkeypatch):
    store, day, before = some_store(spark, tmp_path / "s")
    write = LogStore._write

    def and_append(self, lines, path, mode):
        write(self, lines, path, mode)
        if "staged/compact" in path:
            monkeypatch.setattr(LogStore, "_write", write)
            e = LogEngine(store)
            e.ingest_push(body([({"a": "b"}, 9, "meanwhile", {"id": "9"})]), 0)
            e.flush(NOW)

    monkeypatch.setattr(LogStore, "_write", and_append)
    store.compact(day)
    got = sorted(map(str, store.lines().collect()))
    assert len(got) == len(before) + 1 and set(before) < set(got)


def test_compaction_policy(spark, tmp_path, monkeypatch):
    from logweir.sources import store as module

    store, day, before = some_store(spark, tmp_path / "s", 4)
    assert store.due() == []
    monkeypatch.setattr(module, "LEAST_FILES", 4)
    assert [d for d, _ in store.due()] == [day] and store.compact_due() == [day]
    assert store.due() == [] and sorted(map(str, store.lines().collect())) == before
    assert store.ready()


def test_files_are_sorted(spark, tmp_path):
    import pyarrow.parquet as pq

    store = LogStore(spark, str(tmp_path / "s"))
    e = LogEngine(store)
    for n in range(60):
        e.ingest_push(body([({"a": str(n % 7)}, n * 17 % 50, f"line {n}", {"id": str(n)})]), n % 3)
    e.flush(NOW)
    store.compact(str(store.lines().first()["day"]))
    for p in (tmp_path / "s/lines").rglob("*.parquet"):
        t = pq.ParquetFile(p).read(columns=["tenant_id", "stream_id", "ts_ns"]).to_pylist()
        assert [tuple(r.values()) for r in t] == sorted(tuple(r.values()) for r in t)


def test_failed_flush_is_written_once(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "s"))
    e = LogEngine(store)
    for tenant in (1, 2):
        e.ingest_push(body([({"a": "b"}, tenant, f"of {tenant}", {"id": str(tenant)})]), tenant)
    carry_on = LogStore._carry_on
    for failing in ("_commit", "_carry_on"):
        monkeypatch.setattr(LogStore, failing, lambda *_, **__: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            e.flush(NOW)
        monkeypatch.undo()
    assert LogStore._carry_on is carry_on
    e.ingest_push(body([({"a": "b"}, 3, "of 3", {"id": "3"})]), 3)
    assert e.run(parse("[-1h,now] {a=b}", NOW), 2, waiting=False).count() == 1  # the journal was there
    assert e.run(parse("[-1h,now] {a=b}", NOW), 3, waiting=True, now_ns=NOW).count() == 1
    e.flush(NOW)
    e.flush(NOW)
    assert sorted((r["tenant_id"], r["msg"]) for r in store.lines().collect()) == [(1, "of 1"), (2, "of 2"), (3, "of 3")]


def test_pushes_are_counted_as_they_come(spark, tmp_path, monkeypatch):
    """Each push costs the same, however many wait: none goes through those before it."""

    class Unread(list):
        def __iter__(self):
            raise AssertionError("read for a push")

    one = json.dumps(json.loads(body(LINES[:1])))
    e = LogEngine(LogStore(spark, str(tmp_path / "s")), flush_bytes=3 * len(one))
    e.waiting = Unread()
    for _ in range(2):
        e.ingest_push(one, 5)
    assert len(e.waiting) == 2
    taken = []
    monkeypatch.setattr(LogEngine, "_lines", lambda *_: None)
    monkeypatch.setattr(LogStore, "append", lambda *a: taken.append(a))
    for _ in range(4):  # the third flushes, from the next on it is counted anew
        e.ingest_push(one, 5)
    assert len(taken) == 2 and not e.waiting
    e.ingest_push(one, 5)
    assert len(taken) == 2 and len(e.waiting) == 1


def test_tables_of_bodies_wait(spark, tmp_path):
    """They are seen beside bodies that came one by one, refused as a whole, and written once by a flush."""
    from pyspark.sql import functions as F

    from logweir.sources.push import as_bodies, flatten, parsed, to_lines

    table = lambda *rows: spark.createDataFrame(list(rows), "tenant int, body string")
    odd = ({"zone": 'e"u\\'}, 2, 'say "hi",\n\\ \u2603', {"id": "1", 'k"': "]}"})
    q, found = parse("[-1h,now] {zone!=x}", NOW), lambda df: [(r["fields"]["id"], r["msg"]) for r in df.collect()]
    e = LogEngine(LogStore(spark, str(tmp_path / "s")))
    lines = to_lines(flatten(table((5, body([odd]))).select(parsed(F.col("body")))), 5)
    e.ingest_table(as_bodies(lines))
    e.ingest_push(body([({"zone": "us"}, 3, "pushed", {"id": "2"})]), 5)
    e.ingest_table(table((6, body([({"zone": "eu"}, 1, "of another", {"id": "3"})])), (5, body([({"zone": "eu"}, 4, "last", {"id": "4"})]))))
    want = [("1", odd[2]), ("2", "pushed"), ("4", "last")]
    assert found(e.run(q, 5)) == [] and found(e.run(q, 5, waiting=True, now_ns=NOW)) == want
    for text, code, status in (("{", "INVALID_JSON", 400), (None, "INVALID_JSON", 400), (body([({}, 0, "x" * (4 << 20), {})]), "BODY_TOO_LARGE", 413)):
        with pytest.raises(InvalidPush) as refused:
            e.ingest_table(table((5, body(LINES[:1])), (5, text)))
        assert (refused.value.code, refused.value.status) == (code, status)
    for _ in range(2):
        e.flush(NOW)
        assert found(e.run(q, 5)) == found(e.run(q, 5, waiting=True, now_ns=NOW)) == want
    assert e.store.lines().count() == 4


def test_waiting_lines_stay_with_the_executors(spark, monkeypatch):
    """However many lines wait, none comes to the driver to be pushed from there."""
    from logweir import catalog

    monkeypatch.setattr(LogEngine, "ingest_push", lambda *_: (_ for _ in ()).throw(Lost()))
    assert catalog.QUERIES["union_mem_disk"](spark, "/root/testdata/sf0.001").count() > 0


def test_times_in_any_zone(spark):
    from pyspark.sql import functions as F

    from logweir.functions.columns import render_time

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", z)
            d = spark.createDataFrame([(1_234_567_890,), (1_709_164_799_999_999_999,), (0,)], "t long").select(render_time(F.col("t")).alias("s"))
            assert [r["s"] for r in d.collect()] == ["1970-01-01T00:00:01.234Z", "2024-02-28T23:59:59.999Z", "1970-01-01T00:00:00.000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_stream_of_files(spark, tmp_path):
    store, source = LogStore(spark, str(tmp_path / "s")), tmp_path / "in"
    source.mkdir()
    for n in range(2):
        (source / f"{n}.json").write_text(body(LINES))
        start_ingest(store, str(source), str(tmp_path / "c"), 5, NOW).awaitTermination()  # starts anew from its checkpoint
    assert store.lines().count() == 2 * 6 and store.streams().count() == 4


def test_stream_refuses_bodies_and_goes_on(spark, tmp_path):
    """Of four bodies two are malformed: none of their lines is taken, they are kept with their codes and counted."""
    from logweir.streaming.ingest import rejects
    from logweir.streaming.metrics import Metrics

    store, source, metrics = LogStore(spark, str(tmp_path / "s")), tmp_path / "in", Metrics()
    source.mkdir()
    bad = json.dumps({"streams": [{"stream": {"a": "b"}, "values": [[str(NOW), "fine"], ["soon", "not"]]}]})
    (source / "1.json").write_text("\n".join([body(LINES[:1]), "{", "", bad, body(LINES[1:2])]) + "\n")
    start_ingest(store, str(source), str(tmp_path / "c"), 5, NOW, bytes_per_batch=1 << 20, metrics=metrics).awaitTermination()
    assert sorted(r["msg"] for r in store.lines().collect()) == ["cart failed", "cart opened"]
    assert sorted((r["code"], r["body"]) for r in rejects(store).collect()) == [("INVALID_JSON", "{"), ("INVALID_TIMESTAMP", bad)]
    assert 'ingest_refused{code="INVALID_JSON"} 1' in metrics.exposition() and "ingest_bodies 2" in metrics.exposition()


REFUSED = pytest.mark.parametrize(
    ("text", "code"),
    [
        ("{", "INVALID_JSON"), ("{}", "INVALID_STREAMS"), ('{"streams":{}}', "INVALID_STREAMS"), ('{"streams":[{"stream":[],"values":[]}]}', "INVALID_STREAM"), ('{"streams":[{"stream":{"a":1},"values":[]}]}', "INVALID_STREAM"),
        ('{"streams":[{"stream":{}}]}', "INVALID_VALUES"), ('{"streams":[{"stream":{},"values":[["1"]]}]}', "INVALID_VALUES"), ('{"streams":[{"stream":{},"values":[["1","m",{},1]]}]}', "INVALID_VALUES"), ('{"streams":[{"stream":{},"values":[[1,"m"]]}]}', "INVALID_TIMESTAMP"),
        ('{"streams":[{"stream":{},"values":[["x","m"]]}]}', "INVALID_TIMESTAMP"), ('{"streams":[{"stream":{},"values":[["1","m",{"a":1}]]}]}', "INVALID_METADATA"), ('{"streams":[{"stream":{},"values":[["1",5]]}]}', "INVALID_VALUES"),
    ],
)


@REFUSED
def test_refused_pushes(spark, text, code):
    from pyspark.sql import functions as F

    with pytest.raises(InvalidPush) as e:
        check_push(text)
    assert e.value.code == code
    assert spark.createDataFrame([(text,)], "body string").select(refusal(F.col("body"))).first()[0] == code


def test_good_pushes_are_not_refused(spark):
    from pyspark.sql import functions as F

    texts = [body(LINES), '{"streams":[]}', '{"streams":[{"stream":{},"values":[]}]}', '{"streams":[{"stream":{"a":""},"values":[["1",""],["2","m",{}],["3","m",{"k":"v"}]]}],"more":1}']
    for t in texts:
        check_push(t)
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "body string").select(refusal(F.col("body"))).collect()] == [None] * len(texts)


def test_snappy_bodies(spark, tmp_path):
    import pyarrow as pa

    e = LogEngine(LogStore(spark, str(tmp_path / "s")))
    raw = body(LINES[:2] * 40).encode()
    e.ingest_push(pa.compress(raw, "snappy", asbytes=True), 5, "application/json", "snappy")
    assert json.loads(e.waiting[0][1]) == json.loads(raw)


def test_presets_are_ranges():
    from logweir.lang.times import PRESETS

    starts = [parse(f"[{bound},now] {{a=b}}", NOW).start for bound in PRESETS.values()]
    assert starts == sorted(starts, reverse=True) and starts[-1] == 0 and NOW - starts[3] == 60 * MINUTE


def test_small_parts():
    with pytest.raises(InvalidPush) as e:
        check_push("{}", "text/plain")
    assert e.value.status == 415
    assert tenant_of(None) == 0 and tenant_of("22") == 22
    with pytest.raises(ValueError, match="no tenant"):
        tenant_of("x")
    assert wire_stream_id({"b": "2", "a": "1"}) == wire_stream_id({"a": "1", "b": "2"}) < 1 << 128


def test_random_trees(spark):
    """Random boolean trees: Spark's rows are those of a direct evaluation."""
    rng = random.Random(4)
    data = [(0, "s", i, f"m{rng.randrange(3)}", {k: str(rng.randrange(3)) for k in "abc" if rng.random() < 0.7}) for i in range(60)]
    lines = spark.createDataFrame(data, "tenant_id long, stream_id string, ts_ns long, msg string, fields map<string,string>").selectExpr("*", "DATE'1970-01-01' AS day")

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return Predicate(rng.choice(["a", "b", "c", "_msg", "none"]), rng.choice(["=", "!="]), rng.choice(["0", "1", "m1"]))
        return rng.choice([Both, Either])(tree(depth - 1), tree(depth - 1))

    def holds(e, row):
        if isinstance(e, Predicate):
            value = row[3] if e.key == "_msg" else row[4].get(e.key)
            return value is not None and (value == e.value) == (e.op == "=")
        return (all if isinstance(e, Both) else any)(holds(x, row) for x in (e.left, e.right))

    for _ in range(12):
        e = tree(3)
        got = {r["ts_ns"] for r in matching_lines(lines, lines, 0, LogQuery(0, 100, None, e)).select("ts_ns").collect()}
        assert got == {r[2] for r in data if holds(e, r)}
    assert to_df(lines, lines, 0, LogQuery(0, 100), 7).count() == 7
