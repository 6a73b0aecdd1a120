"""The market engine against golden values."""

import json
import random
import time
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import prices as P
from tidemark.functions import titles as T
from tidemark.operators import book, divergence, matching, metrics, normalize, policies, views
from tidemark.schema import INSTRUMENT, REGISTRY, TICK
from tidemark.sources import sinks
from tidemark.sources.frames import read_frames, replay_speed

T0 = datetime(2026, 7, 18, 14, tzinfo=timezone.utc)
K, Q = "kalshi:RAIN-31OCT", "polymarket:0xbeef31"
SCRIPT = [(0, K, 4, "0.61", "0.67"), (2, Q, 7, "0.55", "0.59"), (4, Q, 8, "0.545", "0.585"), (7, Q, 9, "0.54", "0.58"), (7, K, 3, "0.02", "0.03"), (18, Q, 11, "0.54", "0.58"), (90, Q, 12, "0.54", "0.58")]


def ticks_of(spark, script):
    rows = [(i, i.split(":")[0], b and D(b), a and D(a), None, None, T0 + timedelta(seconds=s), q, n) for n, (s, i, q, b, a) in enumerate(script)]
    return spark.createDataFrame(rows, TICK)


def legs_of(spark, *legs, name="rain"):
    return views.match_legs(spark.createDataFrame([(name, list(legs))], "match_id string, legs array<string>"))


def test_scripted_pipeline(spark):
    ticks, legs = ticks_of(spark, SCRIPT), legs_of(spark, K, Q)
    out = divergence.divergences(legs, ticks).orderBy("arrival").collect()
    assert [(r.arrival, r.spread) for r in out] == [(1, D("0.07")), (3, D("0.08")), (5, D("0.08"))]
    assert [x.mid for x in out[0].legs] == [D("0.64"), D("0.57")]
    assert book.tick_counts(ticks).first() == (6, 1)
    view = views.match_views(legs, ticks).first()
    assert (view.best_yes_bid, view.best_yes_ask) == (D("0.61"), D("0.58"))
    assert metrics.health(ticks, legs).first().asDict() == {"accepted": 6, "rejected": 1, "instruments": 2, "matches": 1}


@pytest.mark.parametrize(("spreads", "emits"), [([(0, "0.05"), (5, "0.05"), (10, "0.05")], [0, 2]), ([(0, "0.05"), (2, "0.059"), (4, "0.06"), (6, "0.04")], [0, 2])])
def test_debounce(spark, spreads, emits):
    rows = [("m", n, T0 + timedelta(seconds=s), D(v)) for n, (s, v) in enumerate(spreads)]
    out = divergence.debounced(spark.createDataFrame(rows, "match_id string, arrival long, detected_at timestamp, spread decimal(18,9)"))
    assert sorted(r.arrival for r in out.collect()) == emits


def test_freshness_threshold_and_null_quotes(spark):
    legs = legs_of(spark, K, Q)
    at = lambda s, *script: divergence.candidates(legs, ticks_of(spark, script)).count()
    assert at(0, (0, K, 1, "0.50", "0.50"), (60, Q, 1, "0.53", "0.53")) == 0
    assert at(0, (0, K, 1, "0.50", "0.50"), (59, Q, 1, "0.53", "0.53")) == 1
    assert at(0, (0, K, 1, "0.50", "0.50"), (1, Q, 1, "0.521", "0.521")) == 0
    assert at(0, (0, K, 1, "0.50", "0.50"), (1, K, 2, None, None), (2, Q, 1, "0.60", "0.60")) == 0


def test_three_legs_and_missing_leg(spark):
    legs = legs_of(spark, "a:1", "b:1", "c:1")
    ticks = ticks_of(spark, [(0, "a:1", 1, "0.50", "0.52"), (1, "b:1", 1, "0.44", "0.46"), (2, "c:1", 1, "0.48", "0.49")])
    assert views.match_views(legs, ticks).select("best_yes_bid", "best_yes_ask").first() == (D("0.50"), D("0.46"))
    lone = views.match_views(legs_of(spark, "a:1", "z:9"), ticks).first()
    assert [x.mid for x in lone.legs] == [D("0.51"), None]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.divergence import divergence_stream

    rng = random.Random(4)
    script = [(s, rng.choice([K, Q]), s + rng.choice([0, 0, -5]), f"0.{rng.randint(30, 60)}", f"0.{rng.randint(60, 70)}") for s in range(1, 120)]
    ticks, path = ticks_of(spark, script), str(tmp_path / "ticks")
    ticks.repartition(1).sortWithinPartitions("arrival").write.parquet(path)
    matches = spark.createDataFrame([("rain", [K, Q])], "match_id string, legs array<string>")
    stream = divergence_stream(spark.readStream.schema(ticks.schema).parquet(path), matches)
    run = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    live = sorted((r.arrival, r.spread_nano) for r in spark.table("found").collect())
    batch = sorted((r.arrival, int(r.spread * 10**9)) for r in divergence.divergences(views.match_legs(matches), ticks).collect())
    assert live == batch and live


def test_prices(spark):
    rows = spark.createDataFrame([(x,) for x in [".48", "0.996", "1", "garbage", ".37", None, "1e-5"]], "x string")
    assert [r[0] for r in rows.select(P.price(F.col("x"))).collect()] == [D("0.48"), D("0.996"), D(1), None, D("0.37"), None, None]
    one = spark.range(1).select(P.cents(F.lit(37)), P.complement(F.lit("0.42").cast("decimal(18,9)")), P.stored(F.lit("0.4400005").cast("decimal(18,9)")), P.instant(F.lit("2026-06-01")), P.instant(F.lit("2031-10-09T06:20:00Z")))
    assert tuple(one.first()) == (D("0.37"), D("0.58"), D("0.440000"), None, datetime(2031, 10, 9, 6, 20))


def test_kalshi_frames(spark):
    market = {"ticker": "SNOW-32JAN-T7", "title": "Snow", "yes_bid_dollars": "0.6100", "yes_ask_dollars": "0.6400", "last_price": 63, "close_time": "2032-01-30T09:15:00Z"}
    message = {"type": "ticker", "msg": {"market_ticker": "WIND-29MAR-T12", "price_dollars": "0.190", "yes_bid": 17, "yes_ask_dollars": "0.220", "ts_ms": 1811111111000}}
    frames = [market, {"type": "ok"}, {"some": "thing"}, message, {"title": "no key"}, {"ticker": "ALONE"}]
    df = spark.createDataFrame([(n, T0, json.dumps(f)) for n, f in enumerate(frames)], "frame_no long, recv_ts timestamp, raw_frame string")
    sights, ticks = normalize.kalshi(df)
    got = [(r.instrument, r.yes_bid, r.yes_ask, r.last_price, r.seq) for r in ticks.orderBy("seq").collect()]
    assert got == [("kalshi:SNOW-32JAN-T7", D("0.61"), D("0.64"), D("0.63"), 1), ("kalshi:WIND-29MAR-T12", D("0.17"), D("0.22"), D("0.19"), 2), ("kalshi:ALONE", None, None, None, 3)]
    assert [r.title for r in sights.orderBy("arrival").collect()] == ["Snow", "ALONE"]


def test_polymarket_frames(spark):
    market = {"conditionId": "0xa1", "event_type": "book", "question": "Q?", "outcomes": '["Yes","No"]', "outcomePrices": '["0.215","0.785"]', "clobTokenIds": '["71","72"]', "bestBid": 0.21, "bestAsk": 0.22}
    level = lambda *ps: [{"price": p, "size": "3"} for p in ps]
    bookev = {"event_type": "book", "asset_id": "71", "timestamp": "1800000000000", "bids": level(".31", ".32", ".33"), "asks": level(".41", ".42", ".43")}
    change = {"event_type": "price_change", "timestamp": "1800000000000", "price_changes": [{"asset_id": "72", "best_bid": "0.802", "best_ask": "0.811"}, {"asset_id": "71", "best_bid": "0.189", "best_ask": "0.198"}]}
    early = {"event_type": "book", "asset_id": "71", "bids": level("0.7"), "asks": level("0.8")}
    frames = [early, [[market]], [bookev, [[change]]], {"event_type": "other"}, "PONG", {"event_type": "last_trade_price", "asset_id": "72", "price": "0.85", "timestamp": "1800000000000"}, {"conditionId": None, "event_type": "book", "asset_id": "71"}]
    df = spark.createDataFrame([(n, T0, json.dumps(f)) for n, f in enumerate(frames)], "frame_no long, recv_ts timestamp, raw_frame string")
    _, ticks, _ = normalize.polymarket(df)
    got = [(r.seq, r.yes_bid, r.yes_ask, r.last_price) for r in ticks.orderBy("seq").collect()]
    assert got == [(1, D("0.21"), D("0.22"), D("0.215")), (2, D("0.33"), D("0.43"), None), (3, D("0.189"), D("0.198"), None), (4, D("0.189"), D("0.198"), None), (5, None, None, D("0.15"))]
    deep = spark.createDataFrame([(0, T0, "[" * 9 + "1" + "]" * 9)], "frame_no long, recv_ts timestamp, raw_frame string")
    with pytest.raises(Exception, match="arrays within"):
        normalize.polymarket(deep)[1].collect()


TITLES = [("it rains in oct. 2031", "dates", "2031-10"), ("code 29MAR of it", "dates", "2029-03"), ("by 7th March 2030", "dates", "2030-03"), ("before September 9, 2028", "dates", "2028-09"), ("beyond 7.75%", "thresholds", "pct:7.75"), ("0.30%", "thresholds", "pct:0.3"), ("72k", "thresholds", "num:72000"), ("3.2m tons", "thresholds", "num:3200000"), ("12,500 units", "thresholds", "num:12500"), ("$9.20", "thresholds", "usd:9.2"), ("9 percent tax", "thresholds", "pct:9"), ("below 0.00%", "thresholds", "pct:0"), ("$4bn and 2b", "thresholds", "num:2000000000,usd:4000000000"), ("Is the Q&A-SHOW longer?!", "tokens", "longer,show")]


def test_titles(spark):
    rows = T.with_title(spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(TITLES)], "n int, t string"), "t").orderBy("n").collect()
    for (text, column, want), row in zip(TITLES, rows, strict=True):
        assert ",".join(row[column]) == want, text
    assert spark.range(1).select(T.short_hash(F.lit("kalshi:é|polymarket:b"))).first()[0] == f"{fnv('kalshi:é|polymarket:b') & 0xFFFFFFFF:08x}"


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


def contracts(spark, level="7.75"):
    rows = [
        ("kalshi:TAX-31OCT-T3", "kalshi", "Will the salt tax exceed 3.0% in October 2031?", datetime(2031, 11, 4, 12)),
        ("polymarket:0xsalt31", "polymarket", "Will the salt tax exceed 3% in Oct 2031", datetime(2031, 11, 4)),
        ("kalshi:RATE-30MAR-T7.75", "kalshi", "Will the lower edge of the harbour loan rate be beyond 7.75% following the council's Mar 14, 2030 session?", datetime(2030, 3, 14, 18)),
        ("polymarket:0xrate775", "polymarket", f"Will the council set the harbour loan rate beyond {level}% after its March 2030 session?", datetime(2030, 3, 14, 23, 59)),
    ]
    return spark.createDataFrame([(i, v, t, None, c, None, "{}") for i, v, t, c in rows], INSTRUMENT)


def test_matching_pass(spark):
    first = matching.cut(matching.run_pass(contracts(spark), spark.createDataFrame([], REGISTRY)))
    assert matching.report(first).first() == (2, 0, 0)
    got = {r.status: r for r in first.collect()}
    assert got["active"].confidence == "exact" and got["review"].note.startswith("lexical score 0.")
    again = matching.run_pass(contracts(spark), first.drop("outcome"))
    assert matching.report(again).first() == (0, 0, 1)
    other = matching.run_pass(contracts(spark, "8.25"), spark.createDataFrame([], REGISTRY))
    assert [r.confidence for r in other.collect()] == ["exact"]


@pytest.mark.parametrize(("status", "method", "want"), [("rejected", "rule", (0, 0, 1)), ("review", "manual", (0, 0, 1)), ("review", "embedding", (0, 1, 0))])
def test_registry_merge(spark, status, method, want):
    legs = ["kalshi:TAX-31OCT-T3", "polymarket:0xsalt31"]
    old = spark.createDataFrame([("kept", legs, "review", method, status, None)], REGISTRY)
    after = matching.cut(matching.run_pass(contracts(spark).where("id like '%salt%' or id like '%TAX%'"), old))
    assert matching.report(after).first() == want and after.first().match_id == "kept"


def test_greedy(spark):
    rng = random.Random(7)
    pairs = sorted({(f"a{rng.randint(0, 9)}", f"b{rng.randint(0, 9)}"): rng.choice([0.4, 0.5, 0.6]) for _ in range(60)}.items())
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs], "a_id string, b_id string, score double")
    taken, want = set(), set()
    for (a, b), s in sorted(pairs, key=lambda p: (-p[1], *p[0])):
        if not taken & {a, b}:
            taken |= {a, b}
            want.add((a, b, s))
    assert {tuple(r) for r in matching.greedy_pairs(df).collect()} == want


def test_greedy_matches_query(spark, tmp_path):
    """The registered query against scores and a sequential choice in plain Python, down to the shortlist's 0.35."""
    from tidemark.plans import queries

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(90).write.parquet(f"{tmp_path}/part.parquet")
    rows = matching.normalized(queries.instruments(spark, str(tmp_path)))
    exact = {i for r in matching.rule_pass(rows).collect() for i in r.legs}
    rest = sorted((r for r in rows.collect() if r.id not in exact), key=lambda r: r.id)
    share = lambda x, y: len(set(x or ()) & set(y or ())) / max(len(set(x or ()) | set(y or ())), 1)
    clash = lambda x, y: bool(x) and bool(y) and not set(x) & set(y)
    pairs = []
    for n, a in enumerate(rest):
        for b in rest[n + 1 :]:
            timed = a.close_time is not None and b.close_time is not None
            if a.venue == b.venue or clash(a.dates, b.dates) or clash(a.thresholds, b.thresholds) or timed and abs((a.close_time - b.close_time).total_seconds()) > 48 * 3600:
                continue
            score = share(a.combined, b.combined)
            if a.description is not None and b.description is not None:
                score = score * 0.7 + share(a.d_combined, b.d_combined) * 0.3
            pairs.append((-score * (1.0 if timed else 0.85), a.id, b.id))
    taken, want = set(), set()
    for s, a, b in sorted(p for p in pairs if p[0] <= -0.35):
        if not taken & {a, b}:
            taken |= {a, b}
            want.add((a, b, round(-s, 9)))
    got = {tuple(r) for r in queries.greedy_matches(spark, str(tmp_path)).collect()}
    assert got == want and min(s for *_, s in want) < 0.55 and any(0.55 <= s < 0.8 for *_, s in want)


def offers(spark, n, seed=5, venues=("kalshi", "polymarket")):
    """Instruments of few words, so that most titles and many whole rows are alike; some lack a description, a close time, a title's words."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        venue = rng.choice(venues)
        title = rng.choice(["Will the", f"Will {rng.choice(['salt', 'corn', 'tin'])} {rng.choice(['rise', 'fall'])} beyond {rng.choice([3, 4])}%{rng.choice(['', ' in Oct 2031', ' in Nov 2031'])}", f"Will {rng.choice(['salt', 'corn'])} rise {rng.choice(['again', 'soon', ''])}"])
        text = rng.choice([None, "of", "the dry harbour", "the wet harbour loan", f"{rng.choice(['corn', 'salt'])} at noon"])
        rows.append((f"{venue}:{rng.randint(0, 9)}{k}", venue, title, text, rng.choice([None, datetime(2031, 10, 1), datetime(2031, 10, 2), datetime(2031, 10, 9)]), None, "{}"))
    return spark.createDataFrame(rows, INSTRUMENT)


def all_pairs(titles, least):
    share = lambda x, y: len(set(x or ()) & set(y or ())) / max(len(set(x or ()) | set(y or ())), 1)
    clash = lambda x, y: bool(x) and bool(y) and not set(x) & set(y)
    rows, out = sorted(titles.collect(), key=lambda r: r.id), {}
    for n, a in enumerate(rows):
        for b in rows[n + 1 :]:
            timed = a.close_time is not None and b.close_time is not None
            if a.venue == b.venue or clash(a.dates, b.dates) or clash(a.thresholds, b.thresholds) or timed and abs((a.close_time - b.close_time).total_seconds()) > 48 * 3600:
                continue
            score = share(a.combined, b.combined)
            if a.description is not None and b.description is not None:
                score = score * 0.7 + share(a.d_combined, b.d_combined) * 0.3
            score *= 1.0 if timed else 0.85
            if score > 0 and score >= least:
                out[a.id, b.id] = score
    return out


@pytest.mark.parametrize("least", [0.0, 0.2, 0.35, 0.8])
def test_candidate_pairs(spark, least):
    """All pairs and each once, whether titles or descriptions bring them together."""
    titles = matching.cut(matching.normalized(offers(spark, 90, venues=("kalshi", "polymarket", "other"))))
    got = [tuple(r) for r in matching.candidate_pairs(titles, least=least).collect()]
    want = all_pairs(titles, least)
    assert len(got) == len(want) and {(a, b): round(s, 12) for a, b, s in got} == {p: round(s, 12) for p, s in want.items()}


def test_alike_titles_are_paired_in_time(spark, tmp_path):
    """4,000 titles of one template: pairs come from the different sets, not from all words of all rows."""
    from tidemark.plans import queries

    spark.read.parquet("/root/testdata/sf0.1/part.parquet").where("p_partkey < 4000").write.parquet(f"{tmp_path}/part.parquet")
    start = time.time()
    assert queries.candidate_pairs(spark, str(tmp_path)).count() > 300_000
    assert time.time() - start < 45


def one_by_one(pairs):
    taken, out = set(), set()
    for s, a, b in sorted((-s, a, b) for (a, b), s in pairs.items()):
        if not taken & {a, b}:
            taken |= {a, b}
            out.add((a, b, round(-s, 12)))
    return out


@pytest.mark.parametrize("venues", [("kalshi", "polymarket"), ("kalshi", "polymarket", "zeta")])
def test_greedy_choice(spark, venues):
    """Classes of equal instruments and steps of scores choose what a walk over all pairs chooses, in few writes."""
    titles = matching.cut(matching.normalized(offers(spark, 150, 8, venues)))
    got = [(a, b, round(s, 12)) for a, b, s in matching.greedy_choice(titles, few=20).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(all_pairs(titles, 0.35))


def test_greedy_of_equal_scores(spark, monkeypatch):
    """40 instruments a side, all pairs of one score: a chain of 40 choices takes no write for each."""
    writes, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: writes.append(1) or cut(df))
    pairs = spark.range(40).selectExpr("format_string('a%02d', id) as a_id").crossJoin(spark.range(40).selectExpr("format_string('b%02d', id) as b_id")).withColumn("score", F.lit(0.5))
    got = {tuple(r) for r in matching.greedy_pairs(pairs).collect()}
    assert got == {(f"a{n:02d}", f"b{n:02d}", 0.5) for n in range(40)} and len(writes) <= 4


def test_matching_pass_of_alike_titles(spark, monkeypatch):
    """A pass over 60 equal titles a venue, whose pairs all tie, writes as few tables as one over few titles."""
    writes, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: writes.append(1) or cut(df))
    rows = [(f"{v}:{n:02d}", v, "Will salt rise beyond 3%", None, None, None, "{}") for v in ("kalshi", "polymarket") for n in range(60)]
    after = matching.run_pass(spark.createDataFrame(rows, INSTRUMENT), spark.createDataFrame([], REGISTRY))
    assert {tuple(r.legs) for r in after.collect()} == {(f"kalshi:{n:02d}", f"polymarket:{n:02d}") for n in range(60)} and len(writes) < 60


def test_candidate_pairs_query_returns_all(spark, tmp_path):
    """All pairs with a score, also those below the shortlist's 0.35."""
    from tidemark.plans import queries

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(90).write.parquet(f"{tmp_path}/part.parquet")
    rows = matching.cut(matching.normalized(queries.instruments(spark, str(tmp_path))))
    rest = rows.join(matching.rule_pass(rows).select(F.explode("legs").alias("id")), "id", "left_anti")
    want = {(a, b, round(s, 9)) for (a, b), s in all_pairs(rest, 0.0).items()}
    got = [tuple(r) for r in queries.candidate_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and any(s < 0.35 for *_, s in want)


def test_equal_instruments_are_scored_once(spark, monkeypatch):
    """Copies are scored as one, in blocks, and written out as all their pairs."""
    met, apart = [], matching._apart
    monkeypatch.setattr(matching, "_apart", lambda df, *c: met.append(df.count()) or apart(df, *c))
    copies = offers(spark, 20).crossJoin(spark.range(15).select(F.col("id").alias("n"))).withColumn("id", F.concat("id", F.lit("-"), "n")).drop("n")
    titles = matching.cut(matching.normalized(copies))
    want = all_pairs(titles, 0.0)
    got = [tuple(r) for r in matching.candidate_pairs(titles, most=8).collect()]
    assert len(got) == len(want) and {(a, b): round(s, 12) for a, b, s in got} == {p: round(s, 12) for p, s in want.items()}
    assert sum(met) * 20 < len(want)


def test_equal_texts_are_read_once(spark, monkeypatch):
    read, with_title = [], matching.with_title
    monkeypatch.setattr(matching, "with_title", lambda df, *a: read.append(df.count()) or with_title(df, *a))
    rows = [(f"kalshi:{n}", "kalshi", ["Will salt rise beyond 3%", "Will tin fall", None][n % 3], ["in May 2031", None][n % 2], None, None, "{}") for n in range(60)]
    got = {r.id: (r.combined, r.d_combined) for r in matching.normalized(spark.createDataFrame(rows, INSTRUMENT)).collect()}
    assert len(got) == 60 and got["kalshi:0"] == (["beyond", "pct:3", "rise", "salt"], ["2031-05"]) and got["kalshi:5"] == (None, None)
    assert sum(read) <= 3


@pytest.mark.parametrize("few", [5, 45])
def test_greedy_choice_by_work(spark, few):
    """Steps that are counted and taken together, or all taken, choose what a walk over all pairs chooses."""
    titles = matching.cut(matching.normalized(offers(spark, 300, 9)))
    got = [(a, b, round(s, 12)) for a, b, s in matching.greedy_choice(titles, few=few).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(all_pairs(titles, 0.35))


def test_policies(spark):
    assert policies.lag(spark.createDataFrame([(20, 0)], "head long, cursor long"), 4).first().missed == 16
    kept = policies.retained(policies.batches(spark.createDataFrame([("t", n) for n in range(8)], "t string, n long"), "t", "n", 2), "t", 4)
    assert sorted((r.batch, r.kept) for r in kept.collect()) == [(0, False), (1, False), (2, True), (3, True)]
    event = spark.createDataFrame([("tick", "kalshi", "kalshi:RAIN-31OCT"), ("divergence", None, "rain-31oct")], "k string, v string, s string")
    hits = lambda *t: event.where(policies.topic_predicate(list(t), F.col("k"), F.col("v"), F.col("s"))).count()
    assert [hits("ticks:*"), hits("ticks:kalshi:*"), hits("ticks:kalshi:RAIN-31OCT"), hits("ticks:kalshi:OTHER"), hits("divergence:rain-31oct"), hits()] == [1, 1, 1, 0, 1, 0]
    assert [config.backoff(n) for n in range(8)] == [0.5, 1, 2, 4, 8, 16, 30, 30]
    assert replay_speed("MAX") is None and replay_speed("2") == 2
    with pytest.raises(ValueError):
        replay_speed("-1")


def test_frames_files(spark, tmp_path):
    good = json.dumps({"recv_ts": "2026-07-18T14:00:00Z", "venue": "kalshi", "raw_frame": "{}"})
    (tmp_path / "a.ndjson").write_text(f"{good}\n\n{good}\n")
    assert [r.frame_no for r in read_frames(spark, str(tmp_path / "a.ndjson")).orderBy("frame_no").collect()] == [1, 3]
    (tmp_path / "b.ndjson").write_text(f"{good}\nbroken\n")
    with pytest.raises(Exception, match="line 2"):
        read_frames(spark, str(tmp_path / "b.ndjson")).collect()


def test_stored_rows(spark, tmp_path):
    event = spark.createDataFrame([("m", D("0.05"), [("kalshi:F", D("0.40")), ("p:x", D("0.45"))], T0)], "match_id string, spread decimal(18,9), legs array<struct<instrument:string,mid:decimal(18,2)>>, detected_at timestamp")
    assert sinks.divergence_rows(event).first().legs == '[["kalshi:F","0.40"],["p:x","0.45"]]'
    sinks.save_registry([{"match_id": "m", "legs": ["a", "b"], "confidence": "high", "method": "manual", "status": "active", "note": None}], str(tmp_path / "r"))
    assert sinks.load_registry(spark, str(tmp_path / "r")).first().match_id == "m"
    assert sinks.load_registry(spark, str(tmp_path / "none")).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[divergence]\nthreshold = "0.05"\n')
    got = config.load(str(tmp_path / "c.toml"), {"TIDEMARK__DIVERGENCE__DEBOUNCE_S": "20"})
    assert (got.divergence.threshold, got.divergence.debounce_s) == ("0.05", 20)
    with pytest.raises(ValueError):
        config.load(None, {"TIDEMARK__DIVERGENCE__NOPE": "1"})
