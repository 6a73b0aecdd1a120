"""Sessions, registry, adjudication, serving, stores, the live pipeline, landed pages and the command line."""

import json
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark.functions import prices as P
from tidemark.operators import adjudicate, book, divergence, matching, metrics, normalize, policies, replay, views
from tidemark.schema import REGISTRY, TICK
from tidemark.serving import snapshots, subscriptions
from tidemark.sources import discovery, frames, pages, sinks
from tidemark.streaming import pipeline, progress, store
from tidemark.streaming.divergence import consume, divergence_stream
from tidemark.tables import cut, numbered_rows

T0 = datetime(2030, 5, 6, 7, tzinfo=timezone.utc)


def made_ticks(spark, n=400, pairs=6, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        venue = rng.choice(["kalshi", "polymarket"])
        bid, ask = D(rng.randint(20, 60)) / 100, D(rng.randint(60, 80)) / 100
        rows.append((f"{venue}:{rng.randrange(pairs)}", venue, rng.choice([bid, None]), rng.choice([ask, ask, None]), None, None, T0 + timedelta(seconds=3 * k), k + rng.choice([0, 0, -9]), k))
    return spark.createDataFrame(rows, TICK)


def made_matches(spark, of):
    return spark.createDataFrame([(f"m{k}", [f"kalshi:{k}", f"polymarket:{k}"]) for k in of], "match_id string, legs array<string>")


def lines_of(*rows):
    return "\n".join(json.dumps({"recv_ts": (T0 + timedelta(seconds=n)).isoformat(), "venue": v, "raw_frame": json.dumps(f)}) for n, (v, f) in enumerate(rows)) + "\n"


SESSION = [
    ("kalshi", {"ticker": "A", "title": "Salt", "yes_bid_dollars": "0.40", "yes_ask": 44}),
    ("polymarket", {"conditionId": "0x1", "question": "Salt?", "outcomes": '["Yes","No"]', "clobTokenIds": '["5","6"]', "bestBid": "0.30", "bestAsk": "0.32"}),
    ("kalshi", {"ticker": "A", "title": "Salt again", "yes_bid_dollars": "0.41", "yes_ask": 44}),
    ("elsewhere", {"ticker": "A"}),
    ("polymarket", {"event_type": "book", "asset_id": "6", "bids": [{"price": "0.6", "size": "1"}], "asks": [{"price": "0.7", "size": "1"}]}),
]


def test_session_replay(spark, tmp_path):
    (tmp_path / "s.ndjson").write_text(lines_of(*SESSION))
    rows = frames.read_frames(spark, str(tmp_path / "s.ndjson"))
    session = replay.replay(rows)
    got = [(r.seq, r.instrument, r.yes_bid, r.yes_ask) for r in session.ticks.orderBy("seq").collect()]
    assert got == [(1, "kalshi:A", D("0.40"), D("0.44")), (2, "polymarket:0x1", D("0.30"), D("0.32")), (3, "kalshi:A", D("0.41"), D("0.44")), (4, "polymarket:0x1", D("0.30"), D("0.40"))]
    assert {(r.id, r.title) for r in session.instruments.collect()} == {("kalshi:A", "Salt"), ("polymarket:0x1", "Salt?")}
    assert [(r.status, r.reason) for r in session.statuses.collect()] == [("connected", None), ("disconnected", "session ended after 5 frames")]
    assert replay.session_venue(rows) == "kalshi" and replay.session_venue(rows.where("venue = 'x'")) == "kalshi"
    assert replay.invariants(session).first().asDict() == {"instruments": 2, "ticks": 4, "repeated": 0, "bare": 0, "unknown": 0}
    assert {r.title for r in replay.universe(normalize.kalshi(rows.where("venue = 'kalshi'"))[0]).collect()} == {"Salt again"}


def test_frames_over_files_and_ranges(spark, tmp_path):
    """Line numbers run through files cut into small byte ranges; a stream stops at a malformed line."""
    for k in range(3):
        (tmp_path / f"{k}.ndjson").write_text(lines_of(*[("kalshi", {"ticker": f"{k}-{n}"}) for n in range(200)]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r.frame_no, json.loads(r.raw_frame)["ticker"]) for r in frames.read_frames(spark, str(tmp_path)).orderBy("frame_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(201 * k + n + 1, f"{k}-{n}") for k in range(3) for n in range(200)]
    run = pages.polled(spark, str(tmp_path), 1).writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("landed").count() == 600
    (tmp_path / "9.ndjson").write_text("broken\n")
    run = frames.stream_frames(spark, str(tmp_path)).writeStream.format("noop").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="malformed"):
        run.awaitTermination(60)


def test_numbering_splits_one_key(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("k"), (F.lit(9999) - F.col("id")).alias("o"), F.lit("x").alias("_at")).repartition(9)
    got = numbered_rows(rows, ["k"], ["o"], "n").collect()
    for k in (0, 1):
        own = sorted((r.o, r.n) for r in got if r.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert numbered_rows(rows.limit(0), ["k"], ["o"], "n").count() == 0


def test_tradable_takes_literals_only(spark):
    said = ['{"enableOrderBook":true,"acceptingOrders":true}', '{"enableOrderBook":"true","acceptingOrders":true}', '{"enableOrderBook":1,"acceptingOrders":true}', '{"enableOrderBook":true}', "no json", None]
    assert [r.n for r in normalize.tradable(spark.createDataFrame(list(enumerate(said)), "n int, raw_frame string")).collect()] == [0]


def test_merge_keeps_every_entry(spark):
    """Three entries of one leg set in file order: the first answers, a manual active one stays, another set is untouched."""
    rows = [("late", ["b", "a"], "review", "embedding", "review", None, 1), ("z", ["a", "b"], "high", "manual", "active", "by hand", 2), ("a", ["b", "a"], "review", "rule", "review", None, 3), ("other", ["c", "d"], "review", "rule", "rejected", "no", 0)]
    registry = spark.createDataFrame(rows, REGISTRY + ", position long")
    found = spark.createDataFrame([("new-name", ["a", "b"], "exact", "rule", None), ("fresh", ["e", "f"], "review", "embedding", "n")], "match_id string, legs array<string>, confidence string, method string, note string")
    after = {r.match_id: r for r in matching.merged(registry, found).collect()}
    assert {m: (r.confidence, r.status, r.outcome, r.position) for m, r in after.items()} == {
        "late": ("exact", "active", "promoted", 1), "z": ("high", "active", None, 2), "a": ("review", "review", None, 3), "other": ("review", "rejected", None, 0), "fresh": ("review", "review", "new", None),
    }
    assert {r.match_id for r in matching.active_matches(matching.merged(registry, found)).collect()} == {"late", "z"}


def test_verdicts_and_fallback(spark):
    good = '[{"index":1,"same":true,"confidence":1.4,"reason":" r "},{"index":0,"same":false,"confidence":0.95,"reason":"s"}]'
    replies = [(f"So:\n{good}\ndone", 2), (good, 3), ("none", 2), (good.replace('"index":1', '"index":0'), 2), ("]x[", 2), ("[]", 0), (good.replace("true", '"yes"'), 2), (None, 1)]
    rows = spark.createDataFrame(replies, "reply string, n int").select(adjudicate.verdicts(F.col("reply"), F.col("n")).alias("v")).collect()
    assert [(v["index"], v.same, v.confidence) for v in rows[0].v] == [(0, False, 0.95), (1, True, 1.0)]
    assert [r.v for r in rows[1:]] == [None, None, None, None, [], None, None]
    names = [f"{k:03d}" for k in range(40)]
    inst = spark.createDataFrame([(f"{v}:{n}", v, f"Title {n} of {v}", "d" * 900 if n < "020" else None, None, [f"w{n}", "title"]) for n in names for v in ("kalshi", "polymarket")], "id string, venue string, title string, description string, close_time timestamp, combined array<string>")
    pairs = spark.createDataFrame([(f"kalshi:{n}", f"polymarket:{n}", 0.9 - k / 100) for k, n in enumerate(names)], "a_id string, b_id string, score double")
    asked = adjudicate.prompts(pairs, inst, 16).orderBy("batch").collect()
    assert [len(r.pairs) for r in asked] == [16, 16, 8] and asked[0].prompt.count("\nPair ") == 16 and "d" * 601 not in asked[0].prompt and asked[0].prompt.startswith(adjudicate.TASK)

    def judge(prompt):
        if "Pair 15" not in prompt:
            raise RuntimeError("out of reach")
        if "000" in prompt:
            return json.dumps([{"index": k, "same": k % 4 != 3, "confidence": (95, 70, 20, 99)[k % 4] / 100, "reason": f" why {k} "} for k in range(16)])
        return "I can't say"

    got = {r.legs[0]: (r.confidence, r.note) for r in adjudicate.adjudicated(pairs, inst, judge, lexical=0.6).collect()}
    assert got["kalshi:000"] == ("high", "judge 0.95: why 0") and got["kalshi:001"] == ("review", "judge 0.70: why 1")
    assert "kalshi:002" not in got and "kalshi:003" not in got
    assert got["kalshi:016"] == ("review", "lexical score 0.74") and got["kalshi:030"] == ("review", "lexical score 0.60") and "kalshi:031" not in got and "kalshi:035" not in got


def test_live_pipeline_equals_versions(spark):
    """Matches that join, leave and return between batches of ticks, against the batch form; the book, views and counts."""
    ticks = cut(made_ticks(spark))
    all_of, few = made_matches(spark, range(6)), made_matches(spark, [0, 1])
    live = pipeline.LivePipeline(all_of.where("match_id <> 'm5'"), "0.03", 600, 30, "0.02")
    out = []
    for low, high, change in ((0, 150, few), (150, 151, None), (151, 280, all_of), (280, 400, None)):
        out += [(r.match_id, r.arrival, r.spread) for r in live.apply(ticks.where((F.col("arrival") >= low) & (F.col("arrival") < high))).collect()]
        if change is not None:
            live.set_matches(change)
    versions = all_of.where("match_id in ('m0', 'm1')").selectExpr("*", "0L as valid_from", "cast(null as long) as valid_to")
    versions = versions.unionByName(all_of.where("match_id in ('m2', 'm3', 'm4')").selectExpr("*", "0L as valid_from", "150L as valid_to"))
    versions = versions.unionByName(all_of.where("match_id in ('m2', 'm3', 'm4', 'm5')").selectExpr("*", "280L as valid_from", "cast(null as long) as valid_to"))
    want = [(r.match_id, r.arrival, r.spread) for r in pipeline.versioned_divergences(versions, ticks, "0.03", 600, 30, "0.02").collect()]
    assert sorted(out) == sorted(want) and {m for m, _, _ in out} == {f"m{k}" for k in range(6)}
    assert live.tick_counts() == tuple(book.tick_counts(ticks).first())
    key = lambda r: (r.instrument, r.seq, r.mid)
    assert list(map(key, live.all_quotes().collect())) == sorted(map(key, book.quotes(ticks).collect()))
    assert [r.match_id for r in live.all_match_views().collect()] == [f"m{k}" for k in range(6)]
    assert live.match_view("m3").first().best_yes_bid == views.match_views(views.match_legs(all_of), ticks).where("match_id = 'm3'").first().best_yes_bid
    assert live.quote("kalshi:1").count() == 1 and live.match_view("none").count() == 0
    assert live.apply(ticks.limit(0)).count() == 0


def test_stream_of_odd_mids_equals_batch(spark, tmp_path):
    """Mids of odd sums at the ninth place, in batch, stream and pipeline."""
    rows = [("kalshi:0", "kalshi", D("0.400000001"), D("0.400000002"), None, None, T0, 1, 0), ("polymarket:0", "polymarket", D("0.430000001"), D("0.430000002"), None, None, T0 + timedelta(seconds=1), 1, 1)]
    ticks, matches = spark.createDataFrame(rows, TICK), made_matches(spark, [0])
    ticks.write.parquet(f"{tmp_path}/t")
    run = divergence_stream(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/t"), matches, "0.02").writeStream.format("memory").queryName("odd").trigger(availableNow=True).start()
    run.awaitTermination(60)
    live = [(x.instrument, x.mid_nano) for x in spark.table("odd").first().legs]
    batch = divergence.divergences(views.match_legs(matches), ticks, "0.02").first()
    assert live == [(x.instrument, int(x.mid * 10**9)) for x in batch.legs] == [("kalshi:0", 400000002), ("polymarket:0", 430000002)]


def test_snapshots_and_answers(spark):
    ticks, legs = made_ticks(spark, 60), views.match_legs(made_matches(spark, [0, 1]))
    assert [r.instrument for r in snapshots.instruments(ticks).collect()] == sorted({r.instrument for r in ticks.collect()})
    assert [r.match_id for r in snapshots.matches(legs, ticks).collect()] == ["m0", "m1"]
    status, body = snapshots.answer(book.quote(ticks, "kalshi:0"), "instrument")
    assert status == 200 and {"instrument", "yes_bid", "mid"} <= json.loads(body).keys()
    assert snapshots.answer(snapshots.match_view(legs, ticks, "m9"), "match") == (404, '{"error":"unknown match"}')
    assert snapshots.answer(snapshots.match_view(legs, ticks, "m1"), "match")[0] == 200


def test_subscription(spark):
    events = subscriptions.tick_events(made_ticks(spark, 50))
    reader = subscriptions.Subscription(capacity=20)
    assert json.loads(reader.operate('{"op":"subscribe","topics":["ticks:kalshi:*","ticks:polymarket:1"]}')) == {"type": "subscribed", "topics": ["ticks:kalshi:*", "ticks:polymarket:1"]}
    assert json.loads(reader.operate('{"op":"subscribe","topics":["odd"]}'))["topics"] == ["odd", "ticks:kalshi:*", "ticks:polymarket:1"]
    assert json.loads(reader.operate('{"op":"unsubscribe","topics":["ticks:kalshi:*","odd"]}'))["topics"] == ["ticks:polymarket:1"]
    assert all(json.loads(reader.operate(x))["type"] == "error" for x in ("nonsense", '{"op":"dance","topics":[]}', '{"op":"subscribe"}', '{"op":"subscribe","topics":[1]}', "[]"))
    lag, rows = reader.deliver(events)
    assert json.loads(lag) == {"type": "lagged", "missed": 29} and reader.missed == 29
    got = [json.loads(r.frame) for r in rows.collect()]
    assert got and all(f["type"] == "tick" and f["data"]["instrument"] == "polymarket:1" for f in got)
    lag, rows = reader.deliver(events)
    assert lag is None and rows.count() == 0
    assert policies.topics_after(["a"], ["b", "a"], ["a"]) == ["b"]


def test_store_retries_oldest_first_and_drops_oldest(spark, tmp_path):
    down, seen = [True], []

    def write(table, rows):
        if down[0]:
            raise OSError("down")
        seen.append((table, rows.count()))

    kept = store.Store(write, most=25)
    for n in (10, 12, 8):
        kept.batch("ticks")(spark.range(n), 0)
    assert (kept.counts.errors, kept.counts.dropped, seen) == (3, 10, [])
    down[0] = False
    kept.batch("divergences")(spark.range(2), 1)
    assert seen == [("ticks", 12), ("ticks", 8), ("divergences", 2)] and kept.counts.written == 22
    kept.put("ticks", spark.range(0))
    assert not kept.queue and kept.flush()
    disk = store.Store(store.parquet(str(tmp_path)), most=None)
    ticks = made_ticks(spark, 30)
    ticks.write.parquet(f"{tmp_path}/in")
    listener = progress.Progress()
    spark.streams.addListener(listener)
    run = consume(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"), disk.batch("ticks"), f"{tmp_path}/cp", 0.1)
    pipeline.shutdown([run], lambda: None, disk.flush)
    assert spark.read.parquet(f"{tmp_path}/ticks").count() == 30 and disk.counts.written == 30
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(listener)
    assert sum(listener.rows.values()) == 30 and any(x.startswith("rows_total{") for x in listener.lines())


def test_sinks(spark, tmp_path):
    ticks = made_ticks(spark, 40)
    sinks.write_ticks(ticks, f"{tmp_path}/ticks")
    back = spark.read.parquet(f"{tmp_path}/ticks")
    assert back.count() == 40 and {r.venue for r in back.collect()} == {"kalshi", "polymarket"} and back.where("day = date'2030-05-06'").count() == 40
    for _ in range(2):
        sinks.ensure_tables(spark)
    assert spark.table("ticks").columns[:2] == ["instrument", "yes_bid"] and spark.table("divergences").count() == 0
    spark.sql("drop table ticks")
    spark.sql("drop table divergences")
    (tmp_path / "s.ndjson").write_text(lines_of(*SESSION))
    sinks.record(frames.read_frames(spark, str(tmp_path / "s.ndjson")), f"{tmp_path}/rec")
    assert frames.read_frames(spark, f"{tmp_path}/rec/*").count() == 5 and frames.read_frames(spark, f"{tmp_path}/rec/v=kalshi").count() == 2
    run = pages.tapped(pages.polled(spark, f"{tmp_path}/rec/*"), f"{tmp_path}/tap", f"{tmp_path}/tapcp", 0.1)
    run.processAllAvailable()
    run.stop()
    assert frames.read_frames(spark, f"{tmp_path}/tap/v=polymarket").count() == 2
    value = sinks.mirror_values(book.quotes(ticks)).first()
    assert value.key.startswith("tm:quote:") and {"mid", "yes_bid", "seq"} <= json.loads(value.value).keys()
    assert sinks.session_name("kalshi", T0) == "kalshi-20300506T070000Z"
    assert metrics.throughput(ticks).first().ticks == 40
    assert metrics.exposition(spark.createDataFrame([("kalshi", 3)], "venue string, n long"), "frames_total", "venue", "n").first().line == 'frames_total{venue="kalshi"} 3'
    assert spark.range(1).select(P.native_id(F.lit("kalshi:A:B"))).first()[0] == "A:B"


def test_times_in_any_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("select timestamp_ntz'2030-07-06 07:08:09.123456' as t").select(F.unix_micros(P.utc(F.col("t"))).alias("us"), P.stored_time(P.utc(F.col("t"))).alias("s")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row.us == int(datetime(2030, 7, 6, 7, 8, 9, 123456, timezone.utc).timestamp() * 1_000_000) // 1 and row.s == "2030-07-06 07:08:09.123"


def test_discovery_budget(spark):
    ok = '{"enableOrderBook":true,"acceptingOrders":true}'
    rows = [("1", f"a{k}", float(k), ok) for k in range(5)] + [("2", "a4", 4.0, ok), ("2", "b1", 9.0, ok), ("2", "b2", 1.0, ok), ("2", "b3", 0.5, ok), ("2", "off", 99.0, "{}")]
    markets = spark.createDataFrame(rows, "tag_id string, condition string, volume double, raw_frame string")
    tags = spark.createDataFrame([("one", "1"), ("two", "2")], "slug string, tag_id string")
    got = [(r.slug, r.condition) for r in discovery.discover(["two", "?", "one"], tags, markets, 5).orderBy("slug", "rank").collect()]
    assert got == [("two", "b1"), ("two", "a4"), ("two", "b2"), ("two", "b3")]  # one slot was left, and a market of the other tag took it
    assert discovery.discover(["?"], tags, markets, 5).count() == 0


def test_landed_pages(spark, tmp_path):
    for series, counts in (("S", (2, 1)), ("T", (1,)), ("L", (1,) * 12)):
        (tmp_path / series).mkdir()
        for k, n in enumerate(counts):
            body = {"markets": [{"ticker": f"{series}{k}-{i}", "title": f"t{k}", "yes_bid": 40} for i in range(n)], "cursor": "" if k + 1 == len(counts) else "c"}
            (tmp_path / series / f"page-{k:03d}.json").write_text(json.dumps(body))
    assert pages.open_markets(spark, str(tmp_path), ["L", "none"]).count() == 10  # pages of a scan
    known = spark.createDataFrame([("kalshi:T0-0",)], "id string")
    first, ticks = pages.poll_pass(spark, str(tmp_path), ["T", "S"], known)
    assert sorted(r.id for r in first.collect()) == ["kalshi:S0-0", "kalshi:S0-1", "kalshi:S1-0"]
    assert [r.instrument for r in ticks.orderBy("seq").collect()] == ["kalshi:T0-0", "kalshi:S0-0", "kalshi:S0-1", "kalshi:S1-0"]
    tickers = spark.range(250).select(F.col("id").alias("place"), F.format_string("K%03d", "id").alias("ticker"))
    assert [(r.batch, len(r.tickers), r.tickers[0]) for r in pages.subscriptions(tickers).orderBy("batch").collect()] == [(0, 100, "K000"), (1, 100, "K100"), (2, 50, "K200")]
    assert spark.range(1).select(pages.frame_ticker(F.lit('{"ticker":"X"}'))).first()[0] == "X"
    tokens = spark.createDataFrame([(1, 0, "5", "0x1", True), (2, 0, "7", "0x1", True), (2, 0, "6", "0x1", False)], "frame_no long, part int, token string, condition string, yes_leg boolean")
    assert [(r.condition, r.token) for r in pages.yes_tokens(tokens).collect()] == [("0x1", "7")]


def test_backlog_and_matching_timer(spark):
    rows = spark.createDataFrame([("tick", "a", 1), ("control", "x", 2), ("tick", "b", 3), ("tick", "a", 4), ("control", "y", 5)], "kind string, key string, arrival long")
    assert [(r.key, r.arrival) for r in policies.backlog(rows).collect()] == [("x", 2), ("y", 5), ("a", 4), ("b", 3)]
    due = lambda *a: pipeline.matching_due(*a)
    assert [due(9, 0, None, 5), due(10, 0, None, 5), due(10, 0, None, 0), due(600, 0, 10, 5), due(610, 0, 10, 5)] == [False, True, False, False, True]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.ndjson").write_text(lines_of(*SESSION))
    sinks.save_registry([{"match_id": "salt", "legs": ["kalshi:A", "polymarket:0x1"], "confidence": "high", "method": "manual", "status": "active", "note": None}], str(tmp_path / "r"))
    source = ["--replay", str(tmp_path / "s.ndjson")]
    assert cli.main(["tap", "ticks", *source], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 4 and out[0].split()[:4] == ["kalshi", "A", "0.4000", "0.4400"] and "—" in out[0]
    assert cli.main(["tap", "ticks", "--venue", "polymarket", *source], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["tap", "divergence", "--registry", str(tmp_path / "r"), *source], spark) == 0
    assert capsys.readouterr().out.splitlines()[0].split()[:2] == ["salt", "0.1100"]
    assert cli.main(["run", "--registry", str(tmp_path / "r"), "--out", str(tmp_path / "out"), *source], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out/ticks").count() == 4 and spark.read.parquet(f"{tmp_path}/out/divergences").count() >= 1
    assert cli.main(["bench", str(tmp_path / "s.ndjson")], spark) == 0 and "4 ticks accepted" in capsys.readouterr().out
    ages = spark.createDataFrame([(5,), (2500,)], "ms long").select(cli.shown_age(F.col("ms"))).collect()
    assert [a[0] for a in ages] == ["5ms", "2.5s"]
