"""Registered queries over the driver's tables, and the same in SQL. Prices leave as doubles of exact decimals, times as
microseconds, so that both engines' values compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import prices as P
from tidemark.functions import titles as T
from tidemark.operators import adjudicate, book, divergence, matching, metrics, normalize, policies, views
from tidemark.operators.replay import invariants, replay
from tidemark.serving import snapshots, subscriptions
from tidemark.sources import discovery
from tidemark.sources.frames import event_matches, event_ticks
from tidemark.streaming import pipeline, store

Query = Callable[[SparkSession, str], DataFrame]
DAY, WAIT = 24 * 3600, 6 * 3600  # freshness and debounce that suit events minutes apart

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(events(spark, sf_dir))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.match_legs(event_matches(events(spark, sf_dir)))


def dbl(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def us(c: str | Column) -> Column:
    return F.unix_micros(c)


TICKS = """
tick as (
  select event_id as arrival, case when user_id % 2 = 0 then 'kalshi' else 'polymarket' end as venue,
    case when user_id % 2 = 0 then 'kalshi' else 'polymarket' end || ':U' || user_id as instrument,
    'm' || (user_id // 2) as match_id, user_id, event_type, value,
    event_id - case when event_id % 7 = 0 then 500 else 0 end as seq, epoch_us(ts) as now,
    case when event_type in ('view', 'purchase', 'click') then ((round(value * 100)::bigint % 9000) * 0.0001::decimal(5,4))::decimal(18,9) end as yes_bid,
    case when event_type in ('view', 'purchase', 'signup') then ((round(value * 100)::bigint % 9000 + 200) * 0.0001::decimal(5,4))::decimal(18,9) end as yes_ask
  from events
), ordered as (
  select *, max(seq) over (partition by instrument order by arrival rows between unbounded preceding and 1 preceding) as top from tick
), counted as (
  select *, coalesce((yes_bid + yes_ask) * 0.5::decimal(2,1), yes_bid, yes_ask)::decimal(18,9) as mid from ordered where top is null or seq > top
)"""
QUOTES = TICKS + """, quote as (
  select * from counted qualify row_number() over (partition by instrument order by seq desc, arrival) = 1
), leg as (
  select distinct 'm' || (user_id // 2) as match_id, 0 as pos, 'kalshi:U' || (user_id // 2 * 2) as instrument from events
  union select distinct 'm' || (user_id // 2), 1, 'polymarket:U' || (user_id // 2 * 2 + 1) from events
)"""
STATES = QUOTES + """, hit as (
  select c.match_id, c.arrival, c.now, c.instrument as hit, l.pos, l.instrument as leg, struct_pack(mid := c.mid, at := c.now) as q
  from counted c join leg l on c.match_id = l.match_id
), state as (
  select *, last_value(case when hit = leg then q end ignore nulls) over (partition by match_id, pos order by arrival rows between unbounded preceding and current row) as s from hit
), candidate as (
  select match_id, arrival, any_value(now) as now, max(s.mid) - min(s.mid) as spread, count(*) as n
  from state where s is not null and s.mid is not null and now - s.at < 86400000000 group by match_id, arrival
  having count(*) >= 2 and max(s.mid) - min(s.mid) >= 0.03
)"""


@query("with recursive" + STATES + """, numbered as (
  select *, row_number() over (partition by match_id order by arrival) as k from candidate
), walk as (
  select match_id, k, arrival, now, spread, n, true as out, now as at, spread as last from numbered where k = 1
  union all
  select n.match_id, n.k, n.arrival, n.now, n.spread, n.n, n.now - w.at >= 21600000000 or n.spread - w.last >= 0.01,
    case when n.now - w.at >= 21600000000 or n.spread - w.last >= 0.01 then n.now else w.at end,
    case when n.now - w.at >= 21600000000 or n.spread - w.last >= 0.01 then n.spread else w.last end
  from walk w join numbered n on n.match_id = w.match_id and n.k = w.k + 1
)
select match_id, arrival, spread::double as spread, now as detected_us, n::bigint as legs from walk where out""")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05, JON-04, AGG-03, FLT-03/08/09."""
    found = divergence.divergences(legs(spark, sf_dir), ticks(spark, sf_dir), "0.03", DAY, WAIT, "0.01")
    return found.select("match_id", "arrival", dbl("spread").alias("spread"), us("detected_at").alias("detected_us"), F.size("legs").cast("long").alias("legs"))


@query("with" + STATES + " select match_id, arrival, spread::double as spread, n::bigint as fresh_legs from candidate")
def divergence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.candidates(legs(spark, sf_dir), ticks(spark, sf_dir), "0.03", DAY)
    return found.select("match_id", "arrival", dbl("spread").alias("spread"), F.size("legs").cast("long").alias("fresh_legs"))


@query("with" + TICKS + " select arrival, instrument, seq, (top is null or seq > top) as accepted from ordered")
def accepted_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.with_accepted(ticks(spark, sf_dir)).select("arrival", "instrument", "seq", "accepted")


@query("with" + TICKS + " select count(*) filter (where top is null or seq > top)::bigint as accepted, count(*) filter (where seq <= top)::bigint as rejected from ordered")
def tick_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.tick_counts(ticks(spark, sf_dir))


@query("with" + QUOTES + " select instrument, seq, arrival, yes_bid::double as yes_bid, yes_ask::double as yes_ask, mid::double as mid, now as recv_us from quote")
def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.quotes(ticks(spark, sf_dir)).select("instrument", "seq", "arrival", dbl("yes_bid").alias("yes_bid"), dbl("yes_ask").alias("yes_ask"), dbl("mid").alias("mid"), us("recv_ts").alias("recv_us"))


@query("with" + QUOTES + """ select l.match_id, max(q.yes_bid)::double as best_yes_bid, min(q.yes_ask)::double as best_yes_ask, (max(mid) - min(mid))::double as spread,
  count(q.instrument)::bigint as quoted, string_agg(l.instrument, '|' order by l.pos) as legs from leg l left join quote q on l.instrument = q.instrument group by l.match_id""")
def match_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02, AGG-02, AGG-03, API-04."""
    v = views.match_views(legs(spark, sf_dir), ticks(spark, sf_dir))
    mids = F.array_compact(F.transform("legs", lambda x: x["mid"]))
    return v.select("match_id", dbl("best_yes_bid").alias("best_yes_bid"), dbl("best_yes_ask").alias("best_yes_ask"), dbl(F.array_max(mids) - F.array_min(mids)).alias("spread"), F.size(F.filter("legs", lambda x: x["last_update"].isNotNull())).cast("long").alias("quoted"), F.array_join(F.transform("legs", lambda x: x["instrument"]), "|").alias("legs"))


@query("with" + QUOTES + " select l.match_id, count(*)::bigint as ticks, max(c.arrival) as last_arrival from counted c join leg l on c.instrument = l.instrument group by l.match_id")
def touched_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-03."""
    return views.touched(legs(spark, sf_dir), ticks(spark, sf_dir)).groupBy("match_id").agg(F.count(F.lit(1)).alias("ticks"), F.max("arrival").alias("last_arrival"))


@query("with" + STATES + " select match_id, arrival, leg, s.mid::double as mid, s.at as at_us from state")
def leg_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04."""
    return views.leg_states(legs(spark, sf_dir), ticks(spark, sf_dir)).select("match_id", "arrival", "leg", dbl("mid").alias("mid"), us("at").alias("at_us"))


@query("with" + QUOTES + """ select (select count(*) from counted)::bigint as accepted, (select count(*) from tick)::bigint - (select count(*) from counted)::bigint as rejected,
  (select count(*) from quote)::bigint as instruments, (select count(distinct match_id) from leg)::bigint as matches""")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, AGG-08, API-01."""
    return metrics.health(ticks(spark, sf_dir), legs(spark, sf_dir))


@query("with" + TICKS + """ select arrival, (1 - yes_bid)::double as no_ask, ((round(value * 100)::bigint % 100) * 0.01::decimal(3,2))::double as from_cents,
  case when user_id % 2 = 0 then yes_bid else 1 - yes_ask end::double as bid, case when user_id % 2 = 0 then yes_ask else 1 - yes_bid end::double as ask,
  coalesce((yes_bid + yes_ask) * 0.5::decimal(2,1), yes_bid, yes_ask)::double as mid from tick""")
def price_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-02, NRM-03, NRM-04, NRM-16."""
    rows = ticks(spark, sf_dir).join(events(spark, sf_dir).select(F.col("event_id").alias("arrival"), "user_id", "value"), "arrival")
    side = P.oriented(F.col("user_id") % 2 == 0, F.col("yes_bid"), F.col("yes_ask"))
    return rows.select("arrival", dbl(P.complement(F.col("yes_bid"))).alias("no_ask"), dbl(P.cents(F.round(F.col("value") * 100).cast("long") % 100)).alias("from_cents"), dbl(side["bid"]).alias("bid"), dbl(side["ask"]).alias("ask"), dbl(P.mid(F.col("yes_bid"), F.col("yes_ask"))).alias("mid"))


@query("""select event_id, case when event_type = 'click' then 1 else 0 end as yes_index, case when event_type = 'error' then null else value::decimal(18,9)::double end as price,
  case when event_type = 'view' then 2 else 1 end::bigint as names from events""")
def json_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-17, NRM-18, NRM-19 on JSON built from the events."""
    kind = F.col("event_type")
    raw = F.concat(F.lit('["'), F.when(kind == "click", "No").otherwise("yEs"), F.when(kind == "view", '",7,"No"]').when(kind == "click", '","YES"]').otherwise('"]'))
    raw = F.when(kind == "click", F.lit('["No", "YES"]')).otherwise(raw)
    rows = events(spark, sf_dir).withColumn("names", P.string_list(raw))
    text = F.when(kind == "error", F.lit("garbage")).otherwise(F.concat(F.lit(" "), F.col("value").cast("decimal(18,9)").cast("string")))
    return rows.select("event_id", P.yes_index(F.col("names")).alias("yes_index"), dbl(P.price(text)).alias("price"), F.when(kind == "click", 1).otherwise(F.size("names")).cast("long").alias("names"))


@query("with" + TICKS + """ select arrival, instrument, round_even(yes_bid + 0.0000005::decimal(8,7), 6)::double as yes_bid, round_even(yes_ask, 6)::double as yes_ask,
  strftime(make_timestamp(now), '%Y-%m-%d %H:%M:%S.') || lpad((now // 1000 % 1000)::varchar, 3, '0') as recv_ts, seq from tick""")
def stored_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, SCL-22, SCL-23."""
    rows = ticks(spark, sf_dir).withColumn("yes_bid", F.col("yes_bid") + F.lit("0.0000005").cast("decimal(8,7)"))
    kept = rows.select("arrival", "seq", "instrument", P.stored(F.col("yes_bid")).alias("b"), P.stored(F.col("yes_ask")).alias("a"), P.stored_time(F.col("recv_ts")).alias("recv_ts"))
    return kept.select("arrival", "instrument", dbl("b").alias("yes_bid"), dbl("a").alias("yes_ask"), "recv_ts", "seq")


@query("with" + TICKS + """ select venue, count(*)::bigint as frames, count(*) filter (where event_type = 'error')::bigint as reconnects, count(*) filter (where seq <= top)::bigint as gaps from ordered group by venue""")
def venue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12."""
    rows = book.with_accepted(ticks(spark, sf_dir)).join(events(spark, sf_dir).select(F.col("event_id").alias("arrival"), "event_type"), "arrival")
    return metrics.counters(rows, "venue", {"frames": "true", "reconnects": "event_type = 'error'", "gaps": "not accepted"})


@query("""with sorted as (select event_type, list_sort(list(value)) as v from events group by event_type)
select event_type, len(v)::bigint as n, round(list_avg(v), 6) as mean, v[floor((len(v) - 1) * 0.5 + 0.5)::bigint + 1] as p50, v[floor((len(v) - 1) * 0.95 + 0.5)::bigint + 1] as p95, v[floor((len(v) - 1) * 0.99 + 0.5)::bigint + 1] as p99, v[len(v)] as max from sorted""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09."""
    return metrics.latency_summary(events(spark, sf_dir), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("""select event_type, le, count(*) filter (where value <= le)::bigint as n from events, unnest([""" + ", ".join(f"{b}::double" for b in metrics.bounds(0.25)) + """, 'inf'::double]) as b(le) group by event_type, le""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, SCL-27."""
    return metrics.histogram(events(spark, sf_dir), "event_type", "value", metrics.bounds(0.25)).select("event_type", "le", "n")


@query("select epoch_us(ts) // 36000000000 * 36000000000 as start_us, count(*)::bigint as ticks, count(*) / 36000.0::double as per_second from events group by 1")
def ingest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, STR-14."""
    return metrics.ingest_rate(ticks(spark, sf_dir), 36_000).select(us("start").alias("start_us"), "ticks", "per_second")


@query("with" + TICKS + """ select now // 3600000000 * 3600000000 as bucket_us, instrument, max(arrival) as arrival, max_by(seq, arrival) as seq, (count(*) - 1)::bigint as superseded from tick group by 1, 2""")
def conflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, STR-01."""
    return policies.conflated(ticks(spark, sf_dir), "1 hour").select(us("bucket").alias("bucket_us"), "instrument", "arrival", "seq", "superseded")


@query("with" + TICKS + """ select 'tm:quote:' || instrument as key, max_by(seq, arrival) as seq, (count(*) - 1)::bigint as superseded, max_by(now, arrival) + 3600000000 as expires_us from tick group by now // 600000000, instrument""")
def mirror_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, SNK-09, SNK-10, STR-12."""
    return policies.mirrored(ticks(spark, sf_dir), "10 minutes").select("key", "seq", "superseded", us("expires_at").alias("expires_us"))


@query("with" + TICKS + " select instrument as id, min(arrival) as arrival, min_by(venue, arrival) as venue from tick group by instrument")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16."""
    return policies.first_seen(ticks(spark, sf_dir).withColumnRenamed("instrument", "id")).select("id", "arrival", "venue")


@query("with" + TICKS + " select arrival, venue, row_number() over (partition by venue order by arrival)::bigint as seq from tick where event_type <> 'error'")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03, FLT-02."""
    data = ticks(spark, sf_dir).where("yes_bid is not null or yes_ask is not null")
    return policies.numbered(data, "venue", "arrival").select("arrival", "venue", "seq")


@query("with" + TICKS + ", g as (select *, lag(seq) over (partition by venue order by arrival) + 1 as expected from tick) select arrival, venue, expected, seq as got from g where seq > expected")
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04."""
    return policies.gaps(ticks(spark, sf_dir)).select("arrival", "venue", "expected", "got")


@query("select user_id, event_id, greatest(round(value * 100)::bigint - lag(round(value * 100)::bigint, 1, 0) over (partition by user_id order by event_id), 0)::bigint as delta from events")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06."""
    rows = events(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return policies.counter_deltas(rows, "user_id", "event_id", "c").select("user_id", "event_id", "delta")


@query("with" + TICKS + ", g as (select *, lag(now) over (partition by instrument order by now, arrival) as before from tick) select instrument, arrival, before as since_us, now - before as quiet_us from g where now - before >= 86400000000")
def quiet_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07, STR-06."""
    return policies.quiet_spells(ticks(spark, sf_dir), "instrument", DAY)


@query("with" + TICKS + " select arrival, venue, ((now - first_value(now) over (partition by venue order by arrival)) // 2)::bigint as offset_us from tick")
def replay_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, SRC-13."""
    return policies.replay_offsets(ticks(spark, sf_dir), 2.0).select("arrival", "venue", "offset_us")


@query("with b as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 16 as batch from events) select user_id, batch, count(*)::bigint as rows, min(event_id) as first from b group by 1, 2")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05, STR-09."""
    return policies.batches(events(spark, sf_dir), "user_id", "event_id", 16).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first"))


@query("""with b as (select event_type, (row_number() over (partition by event_type order by event_id) - 1) // 50 as batch from events), s as (select event_type, batch, count(*)::bigint as rows from b group by 1, 2)
select event_type, batch, rows, sum(rows) over (partition by event_type order by batch desc) <= 500 as kept from s""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10, SNK-07."""
    return policies.retained(policies.batches(events(spark, sf_dir), "event_type", "event_id", 50), "event_type", 500)


@query("select event_id, greatest(event_id - user_id - 64, 0)::bigint as missed, user_id + greatest(event_id - user_id - 64, 0)::bigint as resume from events")
def ring_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11."""
    readers = events(spark, sf_dir).select("event_id", F.col("event_id").alias("head"), F.col("user_id").alias("cursor"))
    return policies.lag(readers, 64).select("event_id", "missed", "resume")


@query("with" + TICKS + " select arrival, instrument from tick where venue = 'kalshi' or instrument = 'polymarket:U7'")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, SNK-14, API-07."""
    return ticks(spark, sf_dir).where(policies.topic_predicate(["ticks:kalshi:*", "ticks:polymarket:U7", "divergence:*"], F.lit("tick"), F.col("venue"), F.col("instrument"))).select("arrival", "instrument")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 200")
def top_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03, SRC-08: the limit is the operator."""
    return policies.top_within_budget(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 200)


# Titles: parts as contracts of two venues. Each third part has no close time, each fifth no description.
_TITLE = "'Will ' || p_brand || ' ' || p_type || ' close above $' || (floor(p_retailprice / 100) * 100)::bigint || ' in ' || (case p_size % 4 when 0 then 'July' when 1 then 'Apr' when 2 then 'December' else 'sep.' end) || ' 2026?'"


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    venue = F.when(F.col("p_partkey") % 2 == 0, "kalshi").otherwise("polymarket")
    dollars = (F.floor(F.col("p_retailprice") / 100) * 100).cast("bigint").cast("string")
    name = F.when(F.col("p_size") % 4 == 0, "July").when(F.col("p_size") % 4 == 1, "Apr").when(F.col("p_size") % 4 == 2, "December").otherwise("sep.")
    title = F.concat(F.lit("Will "), "p_brand", F.lit(" "), "p_type", F.lit(" close above $"), dollars, F.lit(" in "), name, F.lit(" 2026?"))
    close = F.when(F.col("p_partkey") % 3 != 0, F.timestamp_seconds(F.lit(1_780_000_000) + F.col("p_size") * 36_000))
    return part.select(F.concat_ws(":", venue, F.col("p_partkey").cast("string")).alias("id"), venue.alias("venue"), title.alias("title"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("description"), close.alias("close_time"), F.lit(None).cast("string").alias("category"), F.lit("{}").alias("raw"))


def _number_sql(n: str, unit: str | None) -> str:
    times = f"(case {unit} when 'k' then 1000 when 'm' then 1000000 when 'b' then 1000000000 when 'bn' then 1000000000 else 1 end)" if unit else "1"
    text = f"(replace({n}, ',', '')::decimal(28,10) * {times})::decimal(38,10)::varchar"
    return f"regexp_replace(regexp_replace({text}, '0+$', ''), '\\.$', '')"


def _title_sql(source: str, text: str, name: str) -> str:
    """CTEs that end in ``name`` (id, dates, thresholds, tokens, combined)."""
    steps, last, rest = [], source, f"lower({text})"
    dates, thresholds = [], []
    steps.append(f"{name}_0 as (select id, {rest} as r, []::varchar[] as dd, []::varchar[] as tt from {source})")
    k = 0
    for kind, pattern, value, unit in (*T.DATES, *T.THRESHOLDS):
        p = pattern.replace("'", "''")
        a, b = f"regexp_extract_all(r, '{p}', {value})", f"regexp_extract_all(r, '{p}', {unit})"
        if kind in ("day_month_year", "month_year", "yy_mmm"):
            month = "lpad(((position(b[i][1:3] in 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3)::varchar, 2, '0')"
            one, target = f"'{'20' if kind == 'yy_mmm' else ''}' || a[i] || '-' || {month}", "dd"
        else:
            one, target = f"'{kind}:' || {_number_sql('a[i]', 'b[i]' if unit else None)}", "tt"
        other = "tt" if target == "dd" else "dd"
        steps.append(f"{name}_{k + 1} as (select id, regexp_replace(r, '{p}', ' ', 'g') as r, list_concat({target}, list_transform(range(1, len(a) + 1), lambda i: {one})) as {target}, {other} from (select *, {a} as a, {b} as b from {name}_{k}))")
        k += 1
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    sets = f"list_sort(list_distinct(dd)) as dates, list_sort(list_distinct(tt)) as thresholds, list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(r, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: strlen(w) >= 2 and w not in ({stop})))) as tokens"
    steps.append(f"{name} as (select *, list_sort(list_distinct(list_concat(tokens, list_concat(dates, thresholds)))) as combined from (select id, {sets} from {name}_{k}))")
    return ",\n".join(steps)


INSTRUMENTS = f"""
inst as (
  select case when p_partkey % 2 = 0 then 'kalshi' else 'polymarket' end || ':' || p_partkey as id, case when p_partkey % 2 = 0 then 'kalshi' else 'polymarket' end as venue,
    {_TITLE} as title, case when p_partkey % 5 <> 0 then p_name end as description, case when p_partkey % 3 <> 0 then 1780000000 + p_size * 36000 end as close from part
), {_title_sql("inst", "title", "nt")}, {_title_sql("(select id, description from inst where description is not null)", "description", "nd")},
full_inst as (
  select i.*, nt.dates, nt.thresholds, nt.tokens, nt.combined, nd.combined as d_combined,
    case when len(nt.tokens) >= 2 and (len(nt.dates) > 0 or len(nt.thresholds) > 0) then 'd:' || array_to_string(nt.dates, ',') || '|t:' || array_to_string(nt.thresholds, ',') || '|w:' || array_to_string(nt.tokens, ',') end as rule_key
  from inst i join nt on i.id = nt.id left join nd on i.id = nd.id
)"""
def _exact_sql(name: str, source: str) -> str:
    return f""", {name} as (
  select rule_key, list_sort(list(id)) as legs, any_value(combined) as combined from {source} where rule_key is not null group by rule_key
  having count(distinct venue) >= 2 and count(*) = count(distinct venue) and coalesce(max(close) - min(close) <= 259200, true)
)"""


def _pairs_sql(source: str) -> str:
    """Scored pairs of what the exact matches leave of ``source``."""
    return f""", rest as (select * from {source} where id not in (select unnest(legs) from exact)
), pair as (
  select a.id as a_id, b.id as b_id, a.combined as ca, b.combined as cb, a.description is not null and b.description is not null as described, a.d_combined as da, b.d_combined as db, a.close is null or b.close is null as open
  from rest a join rest b on a.id < b.id and a.venue <> b.venue
  where (a.close is null or b.close is null or abs(a.close - b.close) <= 172800)
    and not (len(a.thresholds) > 0 and len(b.thresholds) > 0 and not list_has_any(a.thresholds, b.thresholds)) and not (len(a.dates) > 0 and len(b.dates) > 0 and not list_has_any(a.dates, b.dates))
), part_score as (
  select a_id, b_id, ca, cb, open, described, len(list_intersect(ca, cb)) / (len(ca) + len(cb) - len(list_intersect(ca, cb)))::double as t,
    case when described then len(list_intersect(da, db)) / nullif(len(da) + len(db) - len(list_intersect(da, db)), 0)::double end as d from pair
), scored as (
  select a_id, b_id, ca, cb, (case when described then t * 0.7::double + coalesce(d, 0) * 0.3::double else t end) * (case when open then 0.85::double else 1.0::double end) as score from part_score
)"""


def _greedy_sql(rounds: int = 24) -> str:
    """``chosen``: in each round the pairs that come first for both their ends; fails if pairs are left after the last."""
    steps = [""", l0 as materialized (select *, row_number() over (order by score desc, a_id, b_id) as k from scored where score >= 0.35)"""]
    for r in range(rounds):
        steps.append(f""", t{r} as materialized (select * from l{r} qualify k = min(k) over (partition by a_id) and k = min(k) over (partition by b_id)
), l{r + 1} as materialized (select * from l{r} where a_id not in (select a_id from t{r}) and b_id not in (select b_id from t{r}))""")
    union = " union all ".join(f"select * from t{r}" for r in range(rounds))
    return "".join(steps) + f""", chosen as materialized (select *, case when (select count(*) from l{rounds}) > 0 then error('pairs are left') end as left_over from ({union}))"""


RULES = INSTRUMENTS + _exact_sql("exact", "full_inst")
PAIRS = RULES + _pairs_sql("full_inst")


@query("with" + INSTRUMENTS + " select id, array_to_string(dates, ',') as dates, array_to_string(thresholds, ',') as thresholds, array_to_string(tokens, ',') as tokens, rule_key from full_inst")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-01 to SCL-14, FLT-14, FLT-15."""
    return matching.normalized(instruments(spark, sf_dir)).select("id", *(F.array_join(c, ",").alias(c) for c in ("dates", "thresholds", "tokens")), "rule_key")


@query("with" + RULES + " select array_to_string(legs, '|') as legs, rule_key from exact")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, JON-06, FLT-11, SRT-07."""
    rows = matching.cut(matching.normalized(instruments(spark, sf_dir)))
    found = matching.rule_pass(rows).select("legs").withColumn("id", F.get("legs", F.lit(0)))
    return found.join(rows.select("id", "rule_key"), "id").select(T.legs_key(F.col("legs")).alias("legs"), "rule_key")


@query("with" + PAIRS + " select a_id, b_id, round(score, 9) as score from scored where score > 0")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-05, JON-07, FLT-10, FLT-12, SCL-17, SCL-18, SET-02 to SET-04: all pairs with a score; the shortlist is the choice's."""
    rows = matching.cut(matching.normalized(instruments(spark, sf_dir)))
    rest = rows.join(matching.rule_pass(rows).select(F.explode("legs").alias("id")), "id", "left_anti")
    return matching.candidate_pairs(rest).withColumn("score", F.round("score", 9))


@query("with" + PAIRS + _greedy_sql() + " select a_id, b_id, round(score, 9) as score from chosen where left_over is null")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11, FLT-13, SRT-02: one-to-one choice over all pairs of the shortlist."""
    rows = matching.cut(matching.normalized(instruments(spark, sf_dir)))
    rest = rows.join(matching.rule_pass(rows).select(F.explode("legs").alias("id")), "id", "left_anti")
    return matching.greedy_choice(rest, least=0.35).withColumn("score", F.round("score", 9))


# A registry before the pass: each 50th pair of neighbouring parts is active; of the exact matches, by the first leg's number,
# a third has a review entry and a manual one of the same legs reversed, a third is rejected, a third is unknown.
_REGISTRY_SQL = """, registry as (
  select p_partkey as position, 'pinned-' || p_partkey as match_id, ['kalshi:' || p_partkey, 'polymarket:' || (p_partkey + 1)] as legs, 'high' as confidence, 'manual' as method, 'active' as status, 'by hand' as note
  from part where p_partkey % 50 = 0 and p_partkey + 1 in (select p_partkey from part)
  union all select n + 1000000, 'known-' || n, legs, 'review', 'embedding', case when n % 3 = 0 then 'review' else 'rejected' end, null::varchar from (select split_part(legs[1], ':', 2)::bigint as n, legs from whole_exact) where n % 3 < 2
  union all select n + 2000000, 'again-' || n, [legs[2], legs[1]], 'review', 'manual', 'review', 'twice' from (select split_part(legs[1], ':', 2)::bigint as n, legs from whole_exact) where n % 3 = 0
), free_inst as (select * from full_inst where id not in (select unnest(legs) from registry where status = 'active'))"""
_PASS_SQL = (
    "with recursive" + INSTRUMENTS + _exact_sql("whole_exact", "full_inst") + _REGISTRY_SQL + _exact_sql("exact", "free_inst") + _pairs_sql("free_inst") + _greedy_sql() + """, found as (
  select legs, list_sort(combined)[1:4] as shared, 'exact' as confidence, 'rule' as method, null::varchar as note, 'active' as status from exact
  union all select [a_id, b_id], list_sort(list_intersect(ca, cb))[1:4], 'review', 'embedding', 'lexical score ' || printf('%d.%02d', round_even(score * 100, 0)::int // 100, round_even(score * 100, 0)::int % 100), 'review' from chosen where score >= 0.55 and left_over is null
), keyed as (select *, array_to_string(legs, '|') as key from found
), hashed(n, h, key) as (
  select 0, 2216829733::bigint, key from keyed union all select n + 1, (xor(h, ascii(key[n + 1])::bigint) * 435) & 4294967295, key from hashed where n < length(key)
), old as (select *, array_to_string(list_sort(legs), '|') as key from registry
), matched as (
  select o.*, o.position = min(o.position) over (partition by o.key) and k.key is not null as hit, k.confidence as new_confidence, k.method as new_method, k.note as new_note, k.status as new_status from old o left join keyed k on o.key = k.key
), judged as (select *, hit and status = 'review' and method <> 'manual' and new_confidence = 'exact' as up from matched)
select match_id, key as legs, case when up then new_confidence else confidence end as confidence, case when up then new_method else method end as method, case when up then new_status else status end as status,
  case when up then coalesce(new_note, note) else note end as note, case when up then 'promoted' when hit then 'skipped' end as outcome from judged
union all
select array_to_string(list_concat(list_transform(shared, lambda t: regexp_replace(t, '[^a-z0-9]', '-', 'g')), [lpad(lower(to_hex(h)), 8, '0')]), '-'), k.key, confidence, method, status, note, 'new'
from keyed k join hashed on hashed.key = k.key and n = length(k.key) where k.key not in (select key from old)""")


@query(_PASS_SQL)
def matching_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-09, JON-07, JON-08, AGG-06, AGG-07: a whole pass over a registry with entries of all kinds."""
    from tidemark.schema import REGISTRY

    rows = instruments(spark, sf_dir)
    exact = matching.cut(matching.rule_pass(matching.cut(matching.normalized(rows).select("id", "venue", "close_time", "combined", "rule_key"))).select("legs", F.split_part(F.get("legs", F.lit(0)), F.lit(":"), F.lit(2)).cast("long").alias("n")))
    text = lambda value: F.lit(value).cast("string")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"))
    pinned = part.where("k % 50 = 0").join(part.select((F.col("k") - 1).alias("k")), "k").select(F.concat(F.lit("pinned-"), "k"), F.array(F.concat(F.lit("kalshi:"), "k"), F.concat(F.lit("polymarket:"), F.col("k") + 1)), F.lit("high"), F.lit("manual"), F.lit("active"), F.lit("by hand"), "k")
    known = exact.where("n % 3 < 2").select(F.concat(F.lit("known-"), "n"), "legs", F.lit("review"), F.lit("embedding"), F.when(F.col("n") % 3 == 0, "review").otherwise("rejected"), text(None), F.col("n") + 1_000_000)
    again = exact.where("n % 3 = 0").select(F.concat(F.lit("again-"), "n"), F.reverse("legs"), F.lit("review"), F.lit("manual"), F.lit("review"), F.lit("twice"), F.col("n") + 2_000_000)
    names = [c.split()[0] for c in f"{REGISTRY}, position long".split(", ")]
    after = matching.run_pass(rows, matching.cut(pinned.union(known).union(again).toDF(*names)))
    return after.select("match_id", T.legs_key(F.col("legs")).alias("legs"), "confidence", "method", "status", "note", "outcome")


@query("""with recursive hashed(n, h, key) as (
  select 0, 2216829733::bigint, 'kalshi:' || p_partkey || '|polymarket:' || (p_partkey + 1) from part
  union all select n + 1, (xor(h, ascii(key[n + 1])::bigint) * 435) & 4294967295, key from hashed where n < length(key)
) select key, lpad(lower(to_hex(h)), 8, '0') as hash from hashed where n = length(key)""")
def short_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-15, SCL-16."""
    key = spark.read.parquet(f"{sf_dir}/part.parquet").select(T.legs_key(F.array(F.concat(F.lit("polymarket:"), (F.col("p_partkey") + 1).cast("string")), F.concat(F.lit("kalshi:"), F.col("p_partkey").cast("string")))).alias("key"))
    return key.select("key", T.short_hash(F.col("key")).alias("hash"))


# Frames: events as recorded frames of two venues. Kalshi (even users): views are market snapshots, errors carry no data, the
# others are ticker messages. Polymarket (odd users): views are markets that register two tokens, clicks are books, purchases
# are price changes of both tokens in an array within an array, signups are trades of the no leg, errors carry no data.
def session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long") % 97 + 1).withColumn("u", F.col("user_id").cast("string"))
    kind, c = F.col("event_type"), F.col("c")
    dollars = lambda n: F.concat(F.lit("0."), F.lpad(n.cast("string"), 2, "0"))
    js = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    name = F.concat(F.lit("K"), F.col("u"))
    market = js(ticker=name, title=F.concat(F.lit("Title "), F.col("u")), yes_bid_dollars=F.concat(dollars(c), F.lit("00")), yes_ask=c + 1, last_price=F.concat(F.lit("x"), F.col("u")), event_type=F.lit("ignored"))
    ticker = js(type=F.lit("ticker"), msg=F.struct(name.alias("market_ticker"), c.alias("yes_bid"), dollars(c + 2).alias("yes_ask_dollars"), dollars(c).alias("price_dollars")))
    condition, yes, no = (F.concat(F.lit(x), F.col("u")) for x in ("0x", "y", "n"))
    quoted = lambda *words: F.concat(F.lit('["'), F.concat_ws('","', *words), F.lit('"]'))
    listed = js(conditionId=condition, event_type=F.lit("book"), question=F.concat(F.lit("Question "), F.col("u")), outcomes=F.when(F.col("user_id") % 4 == 1, F.lit('["No","YES"]')).otherwise(F.lit('["Yes","No"]')), clobTokenIds=F.when(F.col("user_id") % 4 == 1, quoted(no, yes)).otherwise(quoted(yes, no)), outcomePrices=F.when(F.col("user_id") % 4 == 1, quoted(F.lit("0.5"), dollars(c))).otherwise(quoted(dollars(c), F.lit("0.5"))), bestBid=dollars(c), bestAsk=F.concat(F.lit(" "), dollars(c + 1)))
    side = lambda n: F.array(F.struct(F.lit(".01").alias("price"), F.lit("1").alias("size")), F.struct(dollars(n).alias("price"), F.lit("2").alias("size")))
    booked = js(event_type=F.lit("book"), asset_id=yes, bids=side(c), asks=side(c + 1), timestamp=F.lit("1700000000000"))
    change = F.concat(F.lit("[["), js(event_type=F.lit("price_change"), price_changes=F.array(F.struct(yes.alias("asset_id"), dollars(c).alias("best_bid"), dollars(c + 1).alias("best_ask")), F.struct(no.alias("asset_id"), dollars(c).alias("best_bid"), dollars(c + 1).alias("best_ask")))), F.lit("],7]"))
    trade = js(event_type=F.lit("last_trade_price"), asset_id=no, price=dollars(c))
    even = F.when(kind == "view", market).when(kind == "error", F.lit('{"type":"subscribed"}')).otherwise(ticker)
    odd = F.when(kind == "view", listed).when(kind == "click", booked).when(kind == "purchase", change).when(kind == "signup", trade).otherwise(F.lit('"PONG"'))
    is_even = F.col("user_id") % 2 == 0
    return matching.cut(e.select(F.col("event_id").alias("frame_no"), P.utc(F.col("ts")).alias("recv_ts"), F.when(is_even, "kalshi").otherwise("polymarket").alias("venue"), F.when(is_even, even).otherwise(odd).alias("raw_frame")))


SESSION = """
ev as (select event_id, user_id, event_type, (round(value * 100)::bigint % 97 + 1) as c, epoch_us(ts) as now from events
), known as (
  select *, count(*) filter (where event_type = 'view') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as seen from ev
), raw as (
  select event_id, 0 as elem, 'kalshi:K' || user_id as instrument, c / 100.0::double as bid, case when event_type = 'view' then (c + 1) / 100.0::double when c + 2 < 100 then (c + 2) / 100.0::double end as ask, case when event_type <> 'view' then c / 100.0::double end as last
  from ev where user_id % 2 = 0 and event_type <> 'error'
  union all select event_id, 0, 'polymarket:0x' || user_id, case when user_id % 4 <> 1 then c / 100.0::double end, case when user_id % 4 <> 1 then (c + 1) / 100.0::double end, c / 100.0::double from ev where user_id % 2 = 1 and event_type = 'view'
  union all select event_id, 0, 'polymarket:0x' || user_id, c / 100.0::double, (c + 1) / 100.0::double, null from known where user_id % 2 = 1 and event_type = 'click' and seen > 0
  union all select event_id, leg, 'polymarket:0x' || user_id, case leg when 0 then c / 100.0::double else (99 - c) / 100.0::double end, case leg when 0 then (c + 1) / 100.0::double else (100 - c) / 100.0::double end, null
    from known, unnest([0, 1]) as l(leg) where user_id % 2 = 1 and event_type = 'purchase' and seen > 0
  union all select event_id, 0, 'polymarket:0x' || user_id, null, null, (100 - c) / 100.0::double from known where user_id % 2 = 1 and event_type = 'signup' and seen > 0
)"""


@query("with" + SESSION + " select event_id as frame_no, instrument, row_number() over (order by event_id, elem) as seq, round(bid, 4) as bid, round(ask, 4) as ask, round(last, 4) as last from raw")
def replayed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-01, NRM-05 to NRM-08, NRM-11 to NRM-15, NRM-24, FLT-04, JON-01, SET-01, SRC-12."""
    ticks = replay(session_frames(spark, sf_dir)).ticks
    return ticks.select("frame_no", "instrument", "seq", *(F.round(dbl(c), 4).alias(n) for c, n in (("yes_bid", "bid"), ("yes_ask", "ask"), ("last_price", "last"))))


@query("with" + SESSION + """ select case when user_id % 2 = 0 then 'kalshi:K' else 'polymarket:0x' end || user_id as id, min(event_id) as frame_no, case when user_id % 2 = 0 then 'Title ' else 'Question ' end || user_id as title
from ev where event_type = 'view' group by user_id""")
def replayed_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12's instrument dedup, AGG-16."""
    return replay(session_frames(spark, sf_dir)).instruments.select("id", F.col("arrival").alias("frame_no"), "title")


@query("with" + SESSION + """ select (select count(distinct user_id) from ev where event_type = 'view') as instruments, (select count(*) from raw) as ticks, 0::bigint as repeated, 0::bigint as bare,
  (select count(*) from raw where instrument like 'kalshi%' and instrument not in (select 'kalshi:K' || user_id from ev where event_type = 'view')) as unknown""")
def session_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18."""
    return invariants(replay(session_frames(spark, sf_dir)))


@query("with" + SESSION + """ select 'connected' as status, null::varchar as reason, min(now) as at_us from ev
union all select 'disconnected', 'session ended after ' || count(*) || ' frames', max(now) from ev""")
def replayed_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12."""
    return replay(session_frames(spark, sf_dir)).statuses.select("status", "reason", us("at").alias("at_us"))


@query("select event_id as frame_no from events where user_id % 3 = 0 and event_type in ('view', 'click')")
def tradable_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01: only the literals true and true."""
    kind, u = F.col("event_type"), F.col("user_id") % 3
    flag = F.when(u == 0, "true").when(u == 1, '"true"').otherwise("1")
    other = F.when(kind.isin("view", "click"), "true").when(kind == "purchase", "false").when(kind == "signup", '"true"').otherwise("null")
    raw = F.concat(F.lit('{"enableOrderBook":'), flag, F.lit(',"acceptingOrders":'), other, F.lit("}"))
    return normalize.tradable(events(spark, sf_dir).select(F.col("event_id").alias("frame_no"), raw.alias("raw_frame"))).select("frame_no")


_VERDICT = "(round(value * 100)::bigint % 140) / 100.0::double - 0.2"


@query(f"""with v as (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id) - 1 as k, least(greatest({_VERDICT}, 0), 1) as conf, count(*) over (partition by user_id) as n from events)
select user_id, k::bigint as k, event_type <> 'error' as same, round(conf, 4) as confidence, case when event_type <> 'error' and round(conf, 4) >= 0.9 then 'high' when event_type <> 'error' and round(conf, 4) >= 0.6 then 'review' end as band
from v where user_id % 5 <> 3 and user_id % 5 <> 4""")
def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, SCL-21, SRT-04: replies of one verdict an event, out of order and fenced; some miss one, some aren't JSON."""
    e = events(spark, sf_dir).select("user_id", "event_id", "event_type", (F.round(F.col("value") * 100).cast("long") % 140 / 100.0 - 0.2).alias("conf"))
    rows = F.sort_array(F.collect_list(F.struct("event_id", "event_type", "conf")))
    by = e.groupBy("user_id").agg(rows.alias("r"))
    each = F.transform("r", lambda x, k: F.struct(k.alias("index"), (x["event_type"] != "error").alias("same"), F.round(x["conf"], 4).alias("confidence"), F.lit("because").alias("reason")))
    text = F.to_json(F.reverse(F.when(F.col("user_id") % 5 == 3, F.slice(each, 2, F.size("r"))).otherwise(each)))
    reply = F.when(F.col("user_id") % 5 == 4, F.lit("no array ] here [")).otherwise(F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```")))
    out = by.select("user_id", F.posexplode(adjudicate.verdicts(reply, F.size("r"))).alias("k", "v"))
    return out.select("user_id", F.col("k").cast("long").alias("k"), "v.same", F.round("v.confidence", 4).alias("confidence"), adjudicate.band(F.col("v.same"), F.round("v.confidence", 4)).alias("band"))


@query("""with p as (select *, row_number() over (order by p_partkey) - 1 as n from part where p_partkey % 2 = 0 and p_partkey + 1 in (select p_partkey from part)),
text as (select p.n, string_agg('  ' || s.label || ' [' || s.venue || '] ' || s.title || coalesce(chr(10) || '  ' || s.label || ' rules: ' || left(s.description, 600), ''), chr(10) order by s.label) as t from p, lateral (
  select 'A' as label, 'kalshi' as venue, 'Part ' || p.p_name as title, case when p.p_partkey % 5 <> 0 then repeat(p.p_type || ' ', 60) end as description
  union all select 'B', 'polymarket', 'Part ' || q.p_name, case when q.p_partkey % 5 <> 0 then repeat(q.p_type || ' ', 60) end from part q where q.p_partkey = p.p_partkey + 1) s group by p.n)
select n // 16 as batch, count(*)::bigint as pairs, sha256(string_agg(chr(10) || 'Pair ' || n % 16 || ':' || chr(10) || t || chr(10), '' order by n)) as text_sha256 from text group by 1""")
def adjudication_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-19, SCL-20, SRT-05: the pairs' part of each batch's prompt."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey").cast("long"))
    venue = F.when(F.col("k") % 2 == 0, "kalshi").otherwise("polymarket")
    rows = part.select(F.lpad("k", 12, "0").alias("id"), venue.alias("venue"), F.concat(F.lit("Part "), "p_name").alias("title"), F.when(F.col("k") % 5 != 0, F.repeat(F.concat("p_type", F.lit(" ")), 60)).alias("description"), F.lit(None).cast("timestamp").alias("close_time"))
    keys = part.select("k").where("k % 2 = 0").join(part.select((F.col("k") - 1).alias("k")), "k")
    pairs = keys.select(F.lpad("k", 12, "0").alias("a_id"), F.lpad((F.col("k") + 1).cast("string"), 12, "0").alias("b_id"), F.lit(0.5).alias("score"))
    asked = adjudicate.prompts(pairs, rows, 16)
    return asked.select("batch", F.size("pairs").cast("long").alias("pairs"), F.sha2(F.substring("prompt", len(adjudicate.TASK) + 1, 1 << 30), 256).alias("text_sha256"))


@query("with" + QUOTES + " select row_number() over (order by instrument) as place, instrument, mid::double as mid from quote")
def snapshot_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01, API-02, SNK-13, NRM-23: in the order in which the snapshot gives them."""
    rows = snapshots.instruments(ticks(spark, sf_dir)).select("instrument", dbl("mid").alias("mid")).coalesce(1)
    return rows.withColumn("place", F.monotonically_increasing_id() + 1)


@query("with" + QUOTES + """ select l.match_id, max(q.yes_bid)::double as best_yes_bid, min(q.yes_ask)::double as best_yes_ask from leg l left join quote q on l.instrument = q.instrument where l.match_id in ('m3', 'm12') group by l.match_id""")
def match_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-05: two matches asked for one by one, and one that isn't there."""
    own, all_ticks = legs(spark, sf_dir), ticks(spark, sf_dir)
    views_of = [snapshots.match_view(own, all_ticks, m).select("match_id", dbl("best_yes_bid").alias("best_yes_bid"), dbl("best_yes_ask").alias("best_yes_ask")) for m in ("m3", "m12", "nowhere")]
    return views_of[0].unionByName(views_of[1]).unionByName(views_of[2])


@query("with" + TICKS + " select arrival as at, instrument from tick where arrival > (select max(arrival) - 1024 from tick) and (venue = 'kalshi' or instrument = 'polymarket:U7')")
def subscription_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12, SNK-14, API-07, SET-05, STR-11: what a reader that never read before gets from a ring of 1,024 events."""
    reader = subscriptions.Subscription()
    reader.operate('{"op": "subscribe", "topics": ["ticks:kalshi:*", "ticks:polymarket:U7", "ticks:polymarket:U9"]}')
    reader.operate('{"op": "unsubscribe", "topics": ["ticks:polymarket:U9"]}')
    _, frames = reader.deliver(subscriptions.tick_events(ticks(spark, sf_dir)))
    return frames.select("at", F.get_json_object("frame", "$.data.instrument").alias("instrument"))


@query("""with m as (select *, o_orderkey::varchar as condition, o_orderkey % 4 as tag from orders where o_orderkey % 7 <> 0),
a as (select *, row_number() over (order by o_totalprice desc, condition) as rank from m where tag in (2, 3) and (tag = 2)),
first as (select condition, 'two' as slug, rank from a where rank <= 60),
b as (select condition, row_number() over (order by o_totalprice desc, condition) as rank from m where tag in (2, 1) qualify rank <= 90 - (select count(*) from first)),
second as (select condition, 'both' as slug, rank from b where condition not in (select condition from first))
select condition, slug, rank::int as rank from first union all select condition, slug, rank::int from second""")
def discovered_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08, SRC-09, SRT-03, WIN-08, JON-10: an unknown tag, one of few markets, one that overlaps it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_totalprice").cast("double").alias("volume"))
    raw = F.when(F.col("k") % 7 != 0, F.lit('{"enableOrderBook":true,"acceptingOrders":true}')).otherwise(F.lit('{"enableOrderBook":true,"acceptingOrders":"true"}'))
    rows = o.withColumns({"condition": F.col("k").cast("string"), "raw_frame": raw})
    few = rows.where("k % 4 = 2").orderBy(F.desc("volume"), "condition")
    few = few.where("k % 7 <> 0").limit(60).withColumn("tag_id", F.lit("t2"))
    both = rows.where("k % 4 in (1, 2)").withColumn("tag_id", F.lit("t12"))
    tags = spark.createDataFrame([("two", "t2"), ("both", "t12"), ("none", "t9")], "slug string, tag_id string")
    found = discovery.discover(["gone", "two", "both", "none"], tags, few.unionByName(both), 90)
    return found.select("condition", "slug", F.col("rank").cast("int").alias("rank"))


@query("""with b as (select event_type, epoch_ms(ts) // 86400000 as win, event_id, (row_number() over (partition by event_type, epoch_ms(ts) // 86400000 order by event_id) - 1) // 20 as part from events)
select event_type, win as window, part, count(*)::bigint as rows from b group by 1, 2, 3""")
def flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, STR-09: batches sealed by size or time."""
    rows = events(spark, sf_dir).select("event_type", "event_id", P.utc(F.col("ts")).alias("at"))
    return store.flushes(rows, "event_type", "at", "event_id", 20, 86_400_000).groupBy("event_type", "window", "part").agg(F.count(F.lit(1)).alias("rows"))


@query("with" + TICKS + """, u as (select instrument, min(arrival) as since, max(arrival) as arrival, max_by(seq, arrival) as seq from tick where event_type <> 'error' group by instrument),
w as (select 0 as turn, arrival as since, arrival, instrument, seq from tick where event_type = 'error' union all select 1, since, arrival, instrument, seq from u)
select row_number() over (order by turn, since) as place, instrument, arrival, seq from w""")
def backlog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08, STR-01: errors stand for control events."""
    kinds = events(spark, sf_dir).select(F.col("event_id").alias("arrival"), F.when(F.col("event_type") == "error", "control").otherwise("tick").alias("kind"))
    rows = policies.backlog(ticks(spark, sf_dir).join(kinds, "arrival").select("kind", F.col("instrument").alias("key"), "arrival", "seq")).coalesce(1)
    return rows.select((F.monotonically_increasing_id() + 1).alias("place"), F.col("key").alias("instrument"), "arrival", "seq")


_VERSIONS = """, version as (
  select match_id, 0::bigint as valid_from, case when match_id in ('m1', 'm2', 'm3', 'm4') then (select max(event_id) // 3 from events) end as valid_to from (select distinct match_id from leg) where match_id not in ('m5', 'm6', 'm7')
  union all select match_id, (select max(event_id) // 2 from events), null from (select distinct match_id from leg) where match_id in ('m1', 'm2', 'm5', 'm6', 'm7')
)"""


@query("with recursive" + STATES.replace("), candidate as (", "), unused as (").rsplit("), unused as (", 1)[0] + ")" + _VERSIONS + """, candidate as (
  select s.match_id, v.valid_from, arrival, any_value(now) as now, max(s.s.mid) - min(s.s.mid) as spread, count(*) as n
  from state s join version v on s.match_id = v.match_id and s.arrival >= v.valid_from and (v.valid_to is null or s.arrival < v.valid_to)
  where s.s is not null and s.s.mid is not null and s.now - s.s.at < 86400000000 group by s.match_id, v.valid_from, arrival having count(*) >= 2 and max(s.s.mid) - min(s.s.mid) >= 0.03
), numbered as (
  select *, row_number() over (partition by match_id, valid_from order by arrival) as k from candidate
), walk as (
  select match_id, valid_from, k, arrival, spread, true as out, now as at, spread as last from numbered where k = 1
  union all
  select n.match_id, n.valid_from, n.k, n.arrival, n.spread, n.now - w.at >= 21600000000 or n.spread - w.last >= 0.01,
    case when n.now - w.at >= 21600000000 or n.spread - w.last >= 0.01 then n.now else w.at end,
    case when n.now - w.at >= 21600000000 or n.spread - w.last >= 0.01 then n.spread else w.last end
  from walk w join numbered n on n.match_id = w.match_id and n.valid_from = w.valid_from and n.k = w.k + 1
)
select match_id, arrival, spread::double as spread from walk where out""")
def refreshed_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, JON-09: matches that leave, return or join while ticks come in."""
    last = events(spark, sf_dir).agg(F.max("event_id")).first()[0]
    own = event_matches(events(spark, sf_dir))
    first = own.where(~F.col("match_id").isin("m5", "m6", "m7")).select("match_id", "legs", F.lit(0).cast("long").alias("valid_from"), F.when(F.col("match_id").isin("m1", "m2", "m3", "m4"), F.lit(last // 3)).cast("long").alias("valid_to"))
    later = own.where(F.col("match_id").isin("m1", "m2", "m5", "m6", "m7")).select("match_id", "legs", F.lit(last // 2).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    found = pipeline.versioned_divergences(first.unionByName(later), ticks(spark, sf_dir), "0.03", DAY, WAIT, "0.01")
    return found.select("match_id", "arrival", dbl("spread").alias("spread"))


#: Titles of all forms, and what they hold, written out beside each other: {n} is a number, {y} a year of two digits.
_FORMS = (
    ("Will tax top {n}.50% by the 7th March 20{y}", "20{y}-03", "pct:{n}.5", "tax,top"),
    ("Output over 1,{n}0k tons on 9 Sept. 20{y}?", "20{y}-09", "num:1{n}0000", "output,over,tons"),
    ("A price of $ {n}.25m or $1bn in {y}OCT", "20{y}-10", "usd:1000000000,usd:{n}250000", "price"),
    ("Index-level above {n} percent, not 2.0, on December 31, 20{y}", "20{y}-12", "num:2,pct:{n}", "above,index,level,not"),
    ("No anchors here: rain & snow", "", "", "anchors,here,no,rain,snow"),
    ("{n}b barrels and ${n}", "", "num:{n}000000000,usd:{n}", "barrels"),
)


def _forms_sql() -> str:
    fill = lambda text: "'" + text.replace("'", "''").replace("{n}", "' || (p_partkey % 90 + 10) || '").replace("{y}", "' || (p_size % 60 + 30) || '") + "'"
    of = lambda k: "case p_partkey % 6 " + " ".join(f"when {i} then {fill(f[k])}" for i, f in enumerate(_FORMS)) + " end"
    keyed = "case when p_partkey % 6 not in (2, 4, 5) then 'd:' || dates || '|t:' || thresholds || '|w:' || tokens end"
    return f"select id, dates, thresholds, tokens, {keyed} as rule_key from (select p_partkey, p_partkey as id, {of(1)} as dates, array_to_string(list_sort(string_split({of(2)}, ',')), ',') as thresholds, {of(3)} as tokens from part)"


@query(_forms_sql())
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-02 to SCL-13, FLT-14, FLT-15: expected values are written out, no expression is shared with the engine."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n, y = (F.col("p_partkey") % 90 + 10).cast("string"), (F.col("p_size") % 60 + 30).cast("string")
    title = F.lit(None).cast("string")
    for k, form in enumerate(_FORMS):
        title = F.when(F.col("p_partkey") % 6 == k, F.replace(F.replace(F.lit(form[0]), F.lit("{n}"), n), F.lit("{y}"), y)).otherwise(title)
    rows = part.select(F.col("p_partkey").alias("id"), title.alias("title"), F.lit(None).cast("string").alias("description"))
    return matching.normalized(rows).select("id", *(F.array_join(c, ",").alias(c) for c in ("dates", "thresholds", "tokens")), "rule_key")
