"""All registered queries: a Spark function and, where SQL can say it, the DuckDB text it must agree with.

Results leave here rounded, because sums of doubles depend on the order of partitions in their last digits, and with
times as epoch microseconds, so that both engines return the same types.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from augury import schemas
from augury.functions import outcomes as O, trades as X
from augury.ml import additive, attribution, isotonic, models
from augury.functions.numbers import hash_draw, round_even, safe_div
from augury.operators import asof, clean as C, equity as Q, events as V, features as P, ingest as I, joins as J
from augury.operators import labels as L, metrics as M, reports as R, sketches as K
from augury.operators.quantiles import percent_ranks, percentiles
from augury.plans import sql as S, training
from augury.plans.preprocess import preprocess
from augury.plans.sql import money, r
from augury.session import dated_files, materialise, releases, scratch_path, scratch_table
from augury.sources import feed as A, sample_tables as D, tables as B
from augury.streaming import feed as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, times as epoch microseconds."""

    def one(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return F.round(column, digits).alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(column.cast("timestamp")).alias(field.name)
        return column

    return df.select(*[one(f) for f in df.schema.fields])


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean(D.trades(spark, sf), S.MIN_TRADES, S.MIN_VOLUME)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned trades as a written table, for analyses that read them several times."""
    return materialise(cleaned(spark, sf), "cleaned")


BUCKETS = 16


def by_market(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned trades in buckets by market."""
    name, path = scratch_table(spark, "by_market")
    return B.write_by_market(cleaned(spark, sf), name, path, BUCKETS)


# ---------------------------------------------------------------- sources


@query(
    "trades_scan",
    f"with {S.TRADES} select transaction_id, address, market_id, side, amount, price, epoch_us(timestamp) as timestamp from trades",
)
def trades_scan(spark, sf):
    return tidy(D.trades(spark, sf).drop("outcome"))


@query(
    "trades_csv",
    f"""with {S.TRADES} select transaction_id, address, market_id, side, amount, price, epoch_us(timestamp) as timestamp
    from trades where amount >= 1""",
)
def trades_csv(spark, sf):
    """The trades through a CSV file; times of trades under 1 are spoilt, so the reader must drop those rows."""
    path = scratch_path(spark, "csv")
    text = F.when(F.col("amount") >= 1, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("soon")
    B.write_table(D.trades(spark, sf).withColumn("timestamp", text), path, format="csv")
    return tidy(B.read_trades_csv(spark, path).drop("outcome"))


@query(
    "feed_trades",
    f"with {S.FEED} select arrival, transaction_id, address, market_id, side, outcome, amount, price, timestamp_us as timestamp from feed",
)
def feed_trades(spark, sf):
    raw = A.parse_feed_text(D.feed_text(spark, sf), "body")
    return tidy(A.normalize_feed(raw, keep=("arrival",)).drop("title", "slug", "event_slug"))


_MARKETS = """markets as (
  select 'p' || p_partkey as market_id, p_name as question, 'part-' || p_partkey as slug, p_partkey as k,
         round((p_partkey % 5) / 4.0::double, 2) as first, p_partkey % 3 <> 0 as closed, p_retailprice as volume
  from part)"""


@query(
    "market_winners",
    f"""with {_MARKETS}
    select market_id, question, slug,
           case when not closed then '__OPEN__' when first >= 0.5 then 'Yes' else 'No' end as resolution
    from markets where k % 17 <> 0 and k % 19 <> 0 and k % 23 <> 0""",
)
def market_winners(spark, sf):
    return A.parse_resolution(D.market_objects(spark, sf))


@query(
    "market_tokens",
    f"""with {_MARKETS} select market_id, k || unnest(['a', 'b']) as token_id from markets where k % 29 <> 0""",
)
def market_tokens(spark, sf):
    return A.parse_token_ids(D.market_objects(spark, sf))


@query(
    "top_market_tokens",
    f"""with {_MARKETS}, top as (select * from markets where closed order by volume desc, market_id limit 50)
    select market_id, k || unnest(['a', 'b']) as token_id from top where k % 29 <> 0""",
)
def top_market_tokens(spark, sf):
    return A.parse_token_ids(A.top_markets_by_volume(D.market_objects(spark, sf), 50, closed=True))


@query(
    "market_resolution_view",
    f"""with {_MARKETS} select market_id, closed as resolved,
    case when not closed then '__OPEN__' when first >= 0.5 then 'Yes' else 'No' end as resolution
    from markets where k % 17 <> 0 and k % 19 <> 0 and k % 23 <> 0""",
)
def market_resolution_view(spark, sf):
    objects = D.market_objects(spark, sf)
    known = A.parse_resolution(objects).join(
        objects.select(F.col("conditionId").alias("market_id"), F.col("closed").alias("resolved")), "market_id"
    )
    return A.market_resolution_view(known.withColumnRenamed("resolution", "resolution_outcome"))


@query(
    "market_snapshot",
    f"""with {_MARKETS} select market_id, question, slug, closed, volume from markets
    where market_id = (select 'p' || max(p_partkey) from part)""",
)
def market_snapshot(spark, sf):
    markets = D.market_objects(spark, sf).withColumnRenamed("conditionId", "market_id")
    newest = D.table(spark, sf, "part").agg(F.max("p_partkey")).first()[0]
    return A.market_snapshot(markets, f"p{newest}").select("market_id", "question", "slug", "closed", "volume")


@query(
    "active_wallets",
    """select distinct address from (
         select 's' || l_suppkey as address from lineitem where l_returnflag <> 'R'
         union all select 'c' || l_orderkey from lineitem)""",
)
def active_wallets(spark, sf):
    return A.active_wallets(D.fills(spark, sf))


@query(
    "top_market_wallets",
    """with top as (select p_partkey from part where p_partkey % 3 = 0 order by p_retailprice desc, 'p' || p_partkey limit 50)
    select distinct address from (
         select 's' || l_suppkey as address from lineitem where l_returnflag <> 'R' and l_partkey in (from top)
         union all select 'c' || l_orderkey from lineitem where l_partkey in (from top)) order by address limit 300""",
)
def top_market_wallets(spark, sf):
    return A.top_market_wallets(D.market_objects(spark, sf), D.fills(spark, sf), 50, target=300)


@query(
    "feed_outcomes",
    f"with {S.FEED} select arrival, transaction_id, coalesce(outcome, 'No') as outcome from feed",
)
def feed_outcomes(spark, sf):
    """Outcomes where the feed gives some under the other name only."""
    body = F.regexp_replace("body", '"title"', '"_outcome":"No","title"')
    raw = A.parse_feed_text(D.feed_text(spark, sf).withColumn("body", body), "body")
    return A.normalize_feed(raw, keep=("arrival",)).select("arrival", "transaction_id", "outcome")


_TEXTS = ["yes", " Up ", "TRUE", "1", "higher", "over", "win", "no", "Down", "false", "0", "lower", "under", "lose",
          "0.7", "0.5", "0.2", "1e3", "-4", "", "__OPEN__", "nan", "maybe", "1.0d", "inf", " draw"]


@query(
    "outcome_readings",
    f"""with texts as (select p_partkey, [{", ".join(f"'{t}'" for t in _TEXTS)}][p_partkey % {len(_TEXTS)} + 1] as t from part)
    select p_partkey as item,
      case when t in ('', '__OPEN__', 'nan') then 'OPEN'
           when trim(lower(t)) in ('yes', 'up', 'true', '1', 'higher', 'over', 'win', '0.7', '1e3', 'inf') then 'YES'
           when trim(lower(t)) in ('no', 'down', 'false', '0', 'lower', 'under', 'lose', '0.5', '0.2', '-4') then 'NO'
           else 'UNKNOWN' end as reading,
      case when lower(t) in ('yes', '1', 'true', 'up') then 'YES' when lower(t) in ('no', '0', 'false', 'down') then 'NO' else 'OPEN' end as strict_reading
    from texts""",
)
def outcome_readings(spark, sf):
    """Both readings over all kinds of texts."""
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS) + 1).cast("int"))
    items = D.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), text.alias("t"))
    return items.select("item", O.normalise_outcome(F.col("t")).alias("reading"), O.normalise_resolution_strict(F.col("t")).alias("strict_reading"))


@query(
    "replaced_table",
    f"with {S.TRADES} select transaction_id, address, amount, price from trades",
)
def replaced_table(spark, sf):
    """A table that held other rows, emptied and loaded again."""
    path = scratch_path(spark, "replaced")
    trades = D.trades(spark, sf)
    B.write_table(trades.where("amount < 10"), path)
    B.replace_all(trades, path)
    return tidy(spark.read.schema(schemas.TRADES).parquet(path).select("transaction_id", "address", "amount", "price"))


@query(
    "sample_export",
    f"""with {S.TRADES} select transaction_id, address, market_id, side, amount, price, epoch_us(timestamp) as timestamp
    from trades order by timestamp, transaction_id limit 1000""",
)
def sample_export(spark, sf):
    return tidy(B.sample_export(D.trades(spark, sf).drop("outcome")))


# ---------------------------------------------------------------- ingest


@query(
    "dedup_first",
    f"""with {S.FEED} select transaction_id, address, amount, arrival from feed
    qualify row_number() over (partition by transaction_id order by arrival) = 1""",
)
def dedup_first(spark, sf):
    feed = A.normalize_feed(A.parse_feed_text(D.feed_text(spark, sf), "body"), keep=("arrival",))
    return tidy(I.dedup_first(feed).select("transaction_id", "address", "amount", "arrival"))


def _old_and_new(spark, sf):
    # Both sides come from the same objects: they are parsed once.
    feed = materialise(A.normalize_feed(A.parse_feed_text(D.feed_text(spark, sf), "body"), keep=("arrival",)), "feed")
    return feed.where("side = 'BUY'"), feed


@query(
    "append_new",
    f"""with {S.FEED} select arrival, transaction_id, amount from feed
    where transaction_id not in (select transaction_id from feed where side = 'BUY')""",
)
def append_new(spark, sf):
    stored, batch = _old_and_new(spark, sf)
    return tidy(I.append_new(batch, stored).select("arrival", "transaction_id", "amount"))


@query(
    "append_counts",
    f"""with {S.FEED}, fresh as (select distinct transaction_id from feed
      where transaction_id not in (select transaction_id from feed where side = 'BUY'))
    select (select count(*) from fresh) as inserted, (select count(*) from feed) - (select count(*) from fresh) as skipped""",
)
def append_counts(spark, sf):
    stored, batch = _old_and_new(spark, sf)
    return I.append_counts(batch, stored)


@query(
    "load_counts",
    f"""with {S.FEED}, stored as (select * from feed where side = 'BUY'),
    fresh as (select * from feed where transaction_id not in (select transaction_id from stored)
      qualify row_number() over (partition by transaction_id order by arrival) = 1)
    select (select count(*) from stored) as total_before, count(*) as new_trades,
      count(distinct address) as new_wallets, count(distinct market_id) as new_markets,
      (select count(*) from stored) + count(*) as total_after from fresh""",
)
def load_counts(spark, sf):
    stored, batch = _old_and_new(spark, sf)
    return I.load_counts(stored, I.dedup_first(I.append_new(batch, stored)))


@query(
    "merge_keep_last",
    f"""with {S.FEED}, both_ as (select 0 as b, * from feed where side = 'BUY' union all select 1, * from feed)
    select transaction_id, address, amount, arrival from both_
    qualify row_number() over (partition by transaction_id order by b desc, arrival desc) = 1""",
)
def merge_keep_last(spark, sf):
    stored, batch = _old_and_new(spark, sf)
    merged = I.merge_keep_last(stored, batch)
    return tidy(merged.select("transaction_id", "address", "amount", "arrival"))


@query(
    "upsert_resolutions",
    f"""with {S.RESOLUTIONS}, fresh as (
      select market_id, case when k % 2 = 0 then 'New ' || k end as question, 'No' as resolution, '' as slug
      from (select market_id, substr(market_id, 2)::int as k from res) where k >= 50)
    select market_id, coalesce(f.question, o.question) as question,
           case when f.market_id is not null then f.resolution else o.resolution end as resolution, o.slug
    from res o left join fresh f using (market_id)""",
)
def upsert_resolutions(spark, sf):
    old = D.resolutions(spark, sf)
    k = F.substring("market_id", 2, 9).cast("int")
    new = old.where(k >= 50).select(
        "market_id",
        F.when(k % 2 == 0, F.concat(F.lit("New "), k)).alias("question"),
        F.lit("No").alias("resolution"),
        F.lit("").alias("slug"),
    )
    return I.upsert_resolutions(old, new)


@query(
    "described_markets",
    f"""with {S.FEED}, {S.RESOLUTIONS}
    select market_id, arg_min('Market ' || substr(market_id, 2), arrival) as question, any_value(resolution) as resolution,
           arg_min('market-' || substr(market_id, 2), arrival) as slug
    from res left join feed using (market_id) group by market_id""",
)
def described_markets(spark, sf):
    feed = A.normalize_feed(A.parse_feed_text(D.feed_text(spark, sf), "body"), keep=("arrival",))
    return I.describe_markets(D.resolutions(spark, sf), feed)


@query(
    "enriched_trades",
    f"""with {S.TRADES}, {S.RESOLUTIONS} select transaction_id, market_id, resolution as market_resolution
    from trades left join res using (market_id)""",
)
def enriched_trades(spark, sf):
    trades = D.trades(spark, sf).select("transaction_id", "market_id")
    return I.enrich_with_resolution(trades, D.resolutions(spark, sf)).select(
        "transaction_id", "market_id", "market_resolution"
    )


@query(
    "ingest_summary",
    f"""with {S.TRADES}, {S.RESOLUTIONS}
    select count(*) as trades, count(distinct address) as unique_wallets, count(distinct market_id) as unique_markets,
           (select count(*) from res where resolution <> '__OPEN__') as resolved_markets,
           case when count(*) >= 10000 then 'full' when count(*) >= 100 then 'partial' else 'insufficient' end as tier
    from trades""",
)
def ingest_summary(spark, sf):
    return I.ingest_summary(D.trades(spark, sf), D.resolutions(spark, sf))


# ---------------------------------------------------------------- reports


def _report(key: str, other: str, name: str, limit: str) -> str:
    return f"""with {S.TRADES} select {key}, count(*) as trade_count, {money('sum(amount * price)')} as total_volume,
    count(distinct {other}) as {name}, epoch_us(min(timestamp)) as first_trade, epoch_us(max(timestamp)) as last_trade
    from trades group by {key} order by total_volume desc, {key} {limit}"""


@query("wallet_stats", _report("address", "market_id", "markets_traded", "limit 20"))
def wallet_stats(spark, sf):
    return tidy(R.wallet_stats(D.trades(spark, sf)))


@query("wallet_stats_all", _report("address", "market_id", "markets_traded", ""))
def wallet_stats_all(spark, sf):
    return tidy(R.wallet_stats(D.trades(spark, sf), limit=None))


@query("market_overview", _report("market_id", "address", "unique_traders", "limit 20"))
def market_overview(spark, sf):
    return tidy(R.market_overview(D.trades(spark, sf)))


for _interval, _format in {"hour": "%Y-%m-%d %H:00:00", "day": "%Y-%m-%d", "month": "%Y-%m"}.items():

    @query(
        f"timeline_{_interval}",
        f"""with {S.TRADES} select strftime(timestamp, '{_format}') as period, count(*) as trade_count,
        {money('sum(amount * price)')} as volume, count(distinct address) as unique_wallets
        from trades group by 1""",
    )
    def timeline(spark, sf, interval=_interval):
        return R.trade_timeline(D.trades(spark, sf), interval)


@query(
    "dataset_stats",
    f"""with {S.TRADES} select count(*) as total_trades, count(distinct market_id) as unique_markets,
    count(distinct address) as unique_wallets, epoch_us(max(timestamp)) as latest_timestamp from trades""",
)
def dataset_stats(spark, sf):
    return tidy(R.dataset_stats(D.trades(spark, sf)))


_CLOSE_STATS = f"""with {S.TRADES} select count(*) as total_trades, true as markets_close, true as wallets_close, epoch_us(max(timestamp)) as latest_timestamp from trades"""


@query("dataset_stats_approximate", _CLOSE_STATS)
def dataset_stats_approximate(spark, sf):
    """Totals with approximate distinct counts, held against the exact ones: within three deviations of 5%."""
    trades = D.trades(spark, sf)
    exact = R.dataset_stats(trades).select(F.col("unique_markets").alias("m"), F.col("unique_wallets").alias("w"))
    both = J.cross_scalar(R.dataset_stats(trades, approximate=True), exact)
    close = lambda c, e: F.abs(F.col(c) - F.col(e)) <= 0.15 * F.col(e)
    return tidy(both.select("total_trades", close("unique_markets", "m").alias("markets_close"), close("unique_wallets", "w").alias("wallets_close"), "latest_timestamp"))


@query("stats_of_loads", _CLOSE_STATS)
def stats_of_loads(spark, sf):
    """Totals from the sketches of eight loads: distinct counts against the exact ones, within the stated error."""
    trades = D.trades(spark, sf)
    loads = None
    for k in range(8):
        load = K.load_sketch(trades.where(F.pmod(F.crc32("transaction_id"), F.lit(8)) == k))
        loads = load if loads is None else loads.union(load)
    exact = R.dataset_stats(trades).select(F.col("unique_markets").alias("m"), F.col("unique_wallets").alias("w"))
    both = J.cross_scalar(K.sketched_stats(loads), exact)
    close = lambda c, e: F.abs(F.col(c) - F.col(e)) <= K.count_error() * F.col(e)
    return tidy(both.select("total_trades", close("unique_markets", "m").alias("markets_close"), close("unique_wallets", "w").alias("wallets_close"), "latest_timestamp"))


@query(
    "new_wallets_of_load",
    f"""with {S.TRADES}, marked as (select *, timestamp >= timestamp '2024-01-28 00:00:00' as late from trades)
    select count(distinct address) filter (late and address not in (select address from marked where not late)) as new_wallets,
           count(distinct market_id) filter (late and market_id not in (select market_id from marked where not late and market_id is not null)) as new_markets
    from marked""",
)
def new_wallets_of_load(spark, sf):
    """Wallets and markets of a load that no trade before it has, by difference of sketches (exact below 16,384 values)."""
    trades = D.trades(spark, sf)
    late = F.col("timestamp") >= F.lit("2024-01-28 00:00:00").cast("timestamp")
    return K.new_in_load(K.load_sketch(trades.where(~late)), K.load_sketch(trades.where(late)))


@query(
    "percentiles_approximate",
    f"""with {S.TRADES} select c as name, p, true as within from (values ('amount'), ('price')) as cols(c), (values (0.01::double), (0.25), (0.5), (0.75), (0.99)) as probs(p)
    where exists (select 1 from trades)""",
)
def percentiles_approximate(spark, sf):
    """Quantiles from sketches: the share of rows below and up to each returned value spans the asked one within the error."""
    trades, probs = materialise(D.trades(spark, sf).select("amount", "price"), "amounts"), [0.01, 0.25, 0.5, 0.75, 0.99]
    found = percentiles(trades, ["amount", "price"], probs, approx=True).select(F.col("amount").alias("a"), F.col("price").alias("b"))
    rows = J.cross_scalar(trades, found)
    checks = []
    for name, q in (("amount", "a"), ("price", "b")):
        for i, p in enumerate(probs):
            below, upto = F.avg((F.col(name) < F.col(q)[i]).cast("double")), F.avg((F.col(name) <= F.col(q)[i]).cast("double"))
            checks.append(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), ((below <= p + K.RANK_ERROR) & (upto >= p - K.RANK_ERROR)).alias("within")))
    return rows.agg(F.array(*checks).alias("c")).select(F.inline("c"))


@query(
    "trader_concentration",
    f"""with {S.TRADES}, v as (select address, market_id, sum(amount * price) as v from trades group by all)
    select address, {r('coalesce(sum(v * v) / nullif(sum(v) * sum(v), 0), 0)')} as concentration_index
    from v group by address""",
)
def trader_concentration(spark, sf):
    return tidy(R.trader_concentration(D.trades(spark, sf)))


@query(
    "trade_calendar",
    f"""with {S.TRADES} select transaction_id, hour(timestamp)::int as hour_of_day,
    (isodow(timestamp) - 1)::int as day_of_week, lower(address) as address from trades""",
)
def trade_calendar(spark, sf):
    t = D.trades(spark, sf)
    return t.select(
        "transaction_id",
        X.hour_of_day(F.col("timestamp")).alias("hour_of_day"),
        X.day_of_week(F.col("timestamp")).alias("day_of_week"),
        X.normalize_address(F.upper("address")).alias("address"),
    )


# ---------------------------------------------------------------- cleaning


@query(
    "cleaned_trades",
    f"""{S.BASE} select transaction_id, address, market_id, side, amount, price, {r('volume')} as volume,
    epoch_us(timestamp) as timestamp from cleaned""",
)
def cleaned_trades(spark, sf):
    return tidy(cleaned(spark, sf).drop("outcome"))


# Raw rows that break the cleaning rules, taken from the sample by value ranges.
_DIRTY = f"""dirty as (
  select transaction_id, case when amount < 10 then null else address end as address, market_id, side,
         case when amount between 10 and 20 then null when amount > 300 then -amount else amount end as amount,
         case when amount between 20 and 25 then 1.01 when amount between 25 and 30 then null
              when amount between 30 and 31 then 1.0 else price end as price,
         case when amount between 40 and 45 then null else timestamp end as timestamp
  from trades)"""


def _dirty(spark, sf):
    a = F.col("amount")
    return D.trades(spark, sf).select(
        "transaction_id",
        F.when(a < 10, None).otherwise(F.col("address")).alias("address"),
        "market_id",
        "side",
        F.when(a.between(10, 20), None).when(a > 300, -a).otherwise(a).alias("amount"),
        F.when(a.between(20, 25), 1.01)
        .when(a.between(25, 30), None)
        .when(a.between(30, 31), 1.0)
        .otherwise(F.col("price"))
        .alias("price"),
        F.when(a.between(40, 45), None).otherwise(F.col("timestamp")).alias("timestamp"),
    )


@query(
    "row_rules",
    f"""with {S.TRADES}, {_DIRTY}, filled as (
      select transaction_id, address, coalesce(amount, 0.0) as amount, coalesce(price, 0.0) as price, timestamp
      from dirty where address is not null and market_id is not null and timestamp is not null)
    select transaction_id, address, amount, price, {r('amount * price')} as volume from filled
    where price between 0 and 1 and amount >= 0""",
)
def row_rules(spark, sf):
    return tidy(C.basic_clean(_dirty(spark, sf)).select("transaction_id", "address", "amount", "price", "volume"))


@query(
    "drop_report",
    f"""with {S.TRADES}, {_DIRTY}, marked as (
      select address is null or market_id is null or timestamp is null as missing,
             coalesce(price, 0) between 0 and 1 and coalesce(amount, 0) >= 0 as sound from dirty)
    select count(*) as rows, 0::bigint as dropped_unparsed_time, count(*) filter (missing) as dropped_missing,
           count(*) filter (not missing and not sound) as dropped_out_of_range,
           count(*) filter (not missing and sound) as kept from marked""",
)
def drop_report(spark, sf):
    return C.drop_report(_dirty(spark, sf))


@query(
    "validation_report",
    f"""with {S.TRADES}, {_DIRTY}, twice as (select * from dirty union all select * from dirty where side = 'BUY')
    select count(*) as rows, {", ".join(f"count(*) - count({c}) as missing_{c}" for c in (
        "transaction_id", "address", "market_id", "side", "amount", "price", "timestamp"))},
      count(transaction_id) - count(distinct transaction_id) as duplicate_transactions,
      min(amount) as min_amount, max(amount) as max_amount, min(price) as min_price, max(price) as max_price,
      epoch_us(min(timestamp)) as first_time, epoch_us(max(timestamp)) as last_time from twice""",
)
def validation_report(spark, sf):
    dirty = _dirty(spark, sf)
    return tidy(C.validation_report(dirty.unionByName(dirty.where("side = 'BUY'"))))


@query("side_counts", f"with {S.TRADES} select side, count(*) as trades from trades group by side")
def side_counts(spark, sf):
    return C.side_counts(D.trades(spark, sf))


_ACTIVE = f"""active as (select address, count(*) as trade_count, sum(amount * price) as total_volume from trades
  group by address having count(*) >= {S.MIN_TRADES} and sum(amount * price) >= {S.MIN_VOLUME})"""


@query(
    "active_traders",
    f"with {S.TRADES}, {_ACTIVE} select address, trade_count, {r('total_volume', 6)} as total_volume from active",
)
def active_traders(spark, sf):
    trades = C.basic_clean(D.trades(spark, sf))
    return tidy(C.active_traders(trades, S.MIN_TRADES, S.MIN_VOLUME), 6)


@query(
    "top_traders",
    f"""with {S.TRADES}, {_ACTIVE} select address, trade_count, {r('total_volume', 6)} as total_volume from active
    where total_volume >= (select quantile_cont(total_volume, 0.9) from active)""",
)
def top_traders(spark, sf):
    trades = C.basic_clean(D.trades(spark, sf))
    return tidy(C.active_traders(trades, S.MIN_TRADES, S.MIN_VOLUME, 0.1), 6)


# ---------------------------------------------------------------- readings of single rows


@query(
    "resolution_readings",
    f"""with {S.RESOLUTIONS} select market_id, {S.LABEL_RESULT} as label_result, {S.STRICT_RESULT} as strict_result,
    coalesce(resolution not in ('', '__OPEN__'), false) as is_resolved from res""",
)
def resolution_readings(spark, sf):
    raw = F.col("resolution")
    return D.resolutions(spark, sf).select(
        "market_id",
        O.normalise_outcome(raw).alias("label_result"),
        O.normalise_resolution_strict(raw).alias("strict_result"),
        O.is_resolved_raw(raw).alias("is_resolved"),
    )


@query(
    "trade_results",
    f"""with {S.TRADES} select transaction_id, side = 'BUY' as is_buy,
      case when event_id % 3 = 0 then 'YES' when event_id % 3 = 1 then 'NO'
           when (side = 'BUY') = (price >= 0.5) then 'YES' else 'NO' end as bet,
      case when price >= 0.5 then 'YES' else 'NO' end as price_bet,
      case when amount > 0 and price > 0 then {r("case when side = 'BUY' and price >= 0.5 then amount * (1 - price) when side = 'BUY' then -amount * price else amount * price end")} end as pnl,
      case when amount > 0 and price > 0 then {r("case when side = 'BUY' then amount * price else amount * (1 - price) end")} end as invested,
      case when amount > 0 and price > 0 then price >= 0.5 end as win
    from trades""",
)
def trade_results(spark, sf):
    side, amount, price = F.col("side"), F.col("amount"), F.col("price")
    rows = D.trades(spark, sf, with_outcome=True).withColumn("r", X.trade_result(side, amount, price))
    return tidy(
        rows.select(
            "transaction_id",
            O.is_buy(side).alias("is_buy"),
            O.predicted_outcome(side, F.col("outcome"), price).alias("bet"),
            O.expert_bet(price).alias("price_bet"),
            "r.pnl",
            "r.invested",
            "r.win",
        )
    )


# ---------------------------------------------------------------- joins


@query(
    "market_lifetimes",
    f"""{S.BASE} select market_id, epoch_us(min(timestamp)) as market_start, epoch_us(max(timestamp)) as market_end,
    count(*) as market_trades, {r("avg((side = 'BUY')::int)")} as mkt_buy_ratio from cleaned group by market_id""",
)
def market_lifetimes(spark, sf):
    return tidy(J.market_stats(cleaned(spark, sf)))


@query(
    "trades_with_market",
    f"""{S.BASE} select transaction_id, market_id, epoch_us(min(timestamp) over m) as market_start,
    epoch_us(max(timestamp) over m) as market_end, {r("avg((side = 'BUY')::int) over m")} as mkt_buy_ratio
    from cleaned window m as (partition by market_id)""",
)
def trades_with_market(spark, sf):
    joined = J.with_market_stats(cleaned(spark, sf))
    return tidy(joined.select("transaction_id", "market_id", "market_start", "market_end", "mkt_buy_ratio"))


@query("first_trades", f"{S.BASE} select address, epoch_us(min(timestamp)) as first_trade_date from cleaned group by 1")
def first_trades(spark, sf):
    return tidy(J.first_trades(cleaned(spark, sf)))


@query(
    "outer_blocks",
    f"""with {S.TRADES},
    a as (select address, count(*) as buys from trades where side = 'BUY' and price > 0.9 group by address),
    b as (select address, count(*) as sells from trades where side = 'SELL' and price < 0.1 group by address)
    select coalesce(a.address, b.address) as address, buys, sells from a full join b on a.address = b.address""",
)
def outer_blocks(spark, sf):
    t = D.trades(spark, sf)
    buys = t.where("side = 'BUY' and price > 0.9").groupBy("address").agg(F.count("*").alias("buys"))
    sells = t.where("side = 'SELL' and price < 0.1").groupBy("address").agg(F.count("*").alias("sells"))
    return J.outer_blocks([buys, sells])


@query(
    "resolution_lookup",
    f"""{S.BASE} select transaction_id, coalesce(resolution, 'OPEN') as resolution from cleaned left join res using (market_id)""",
)
def resolution_lookup(spark, sf):
    rows = J.lookup(cleaned(spark, sf), D.resolutions(spark, sf), "market_id", "resolution", "OPEN")
    return rows.select("transaction_id", "resolution")


@query(
    "volume_share",
    f"""{S.BASE} select transaction_id, {r('volume / (select sum(volume) from cleaned)', 10)} as share from cleaned""",
)
def volume_share(spark, sf):
    trades = cleaned(spark, sf)
    total = trades.agg(F.sum("volume").alias("total"))
    rows = J.cross_scalar(trades, total)
    return tidy(rows.select("transaction_id", safe_div(F.col("volume"), F.col("total")).alias("share")), 10)


@query(
    "asof_prices",
    f"""{S.BASE}, probes as (select transaction_id, market_id, price as entry_price, timestamp - interval 1 hour as at from cleaned)
    select p.transaction_id, coalesce(t.price, p.entry_price) as asof_price
    from probes p asof left join cleaned t on p.market_id = t.market_id and p.at >= t.timestamp""",
)
def asof_prices(spark, sf, limit=None):
    trades = cleaned(spark, sf)
    probes = trades.select(
        "transaction_id", "market_id", F.col("price").alias("entry_price"),
        (F.col("timestamp") - F.expr("interval 1 hour")).alias("at"),
    )
    ticks = trades.select("market_id", "timestamp", "transaction_id", "price")
    raw = D.trades(spark, sf).select("market_id")  # a probe and a tick per trade at most
    joined = asof.asof_join(probes, ticks, default="entry_price", limit=limit, sizes_from=raw.union(raw))
    return joined.select("transaction_id", "asof_price")


@query("asof_prices_cut", ORACLES["asof_prices"])
def asof_prices_cut(spark, sf):
    """The same with markets of over 20 rows cut into runs."""
    return asof_prices(spark, sf, limit=20)


@query("asof_prices_by_market", ORACLES["asof_prices"])
def asof_prices_by_market(spark, sf):
    """The same over trades in buckets by market: probes and ticks are read where they lie, nothing is moved."""
    trades = by_market(spark, sf)
    probes = trades.select(
        "transaction_id", "market_id", F.col("price").alias("entry_price"),
        (F.col("timestamp") - F.expr("interval 1 hour")).alias("at"),
    )
    ticks = trades.select("market_id", "timestamp", "transaction_id", "price")
    return asof.asof_join(probes, ticks, default="entry_price").select("transaction_id", "asof_price")


# ---------------------------------------------------------------- features


def pairs(spark, sf):
    return P.pair_table(cleaned(spark, sf), sizes_from=D.trades(spark, sf))


@query(
    "trader_returns",
    f"""{S.BASE}, {S.RETURNS} select address, {", ".join(f"{r(c)} as {c}" for c in (
        "total_roi", "max_drawdown", "win_rate", "profit_loss_ratio"))}, {r("total_pnl", 6)} as total_pnl from returns""",
)
def trader_returns(spark, sf):
    rows = P.return_features(pairs(spark, sf), D.resolutions(spark, sf))
    return tidy(rows.withColumn("total_pnl", F.round("total_pnl", 6)))


@query(
    "trader_behaviour",
    f"""{S.BASE}, {S.BEHAVIOUR}, {S.INFORMATION}, {S.ACTIVITY}
    select address, {", ".join(f"{r(c)} as {c}" for c in (
        "early_entry_score", "contrarian_score", "information_ratio", "cross_market_diversification",
        "avg_holding_period", "trading_frequency", "capital_flow_centrality"))}
    from behaviour join information using (address) join activity using (address) join flow using (address)""",
)
def trader_behaviour(spark, sf):
    return tidy(P.behaviour_features(pairs(spark, sf)))


_FEATURE_COLUMNS = [*schemas.FEATURES, "Risk_Adjusted_Return"]


@query(
    "feature_matrix",
    f"""{S.ALL_FEATURES} select address, {", ".join(f"{r(c)} as {c}" for c in _FEATURE_COLUMNS)} from features""",
)
def feature_matrix(spark, sf, limit=None):
    trades = D.trades(spark, sf)
    kept = C.clean(trades, S.MIN_TRADES, S.MIN_VOLUME)
    return tidy(P.build_features(kept, D.resolutions(spark, sf), limit=limit, sizes_from=trades))


@query("feature_matrix_cut", ORACLES["feature_matrix"])
def feature_matrix_cut(spark, sf):
    """The same with traders of over 20 trades cut into runs and quantiles by distributed counts."""
    return feature_matrix(spark, sf, limit=20)


@query(
    "feature_describe",
    f"""{S.ALL_FEATURES} {" union all ".join(
        f"select '{c}' as feature, count({c}) as count, {r(f'avg({c})', 7)} as mean, {r(f'stddev_samp({c})', 7)} as std, "
        f"{r(f'min({c})', 7)} as min, {r(f'quantile_cont({c}, 0.25)', 7)} as p25, {r(f'quantile_cont({c}, 0.5)', 7)} as p50, "
        f"{r(f'quantile_cont({c}, 0.75)', 7)} as p75, {r(f'max({c})', 7)} as max from features" for c in schemas.FEATURES)}""",
)
def feature_describe(spark, sf):
    features = materialise(P.build_features(cleaned(spark, sf), D.resolutions(spark, sf)), "matrix")
    return tidy(C.describe(features, schemas.FEATURES), 7)


@query(
    "drawdown_by_time",
    f"""{S.BASE}, {S.RETURNS.replace("order by market_id, timestamp", "order by timestamp")}
    select address, {r("max_drawdown")} as max_drawdown from returns""",
)
def drawdown_by_time(spark, sf):
    return tidy(P.drawdown_by_time(cleaned(spark, sf), D.resolutions(spark, sf)))


@query(
    "early_entry_pct",
    f"""with {S.TRADES} select transaction_id,
    {r("percent_rank() over (partition by market_id order by timestamp)")} as early_entry_pct from trades""",
)
def early_entry_pct(spark, sf, limit=None):
    return tidy(P.early_entry_pct(D.trades(spark, sf), limit).select("transaction_id", "early_entry_pct"))


@query("early_entry_cut", ORACLES["early_entry_pct"])
def early_entry_cut(spark, sf):
    """The same with markets of over 20 trades cut into runs."""
    return early_entry_pct(spark, sf, limit=20)


@query(
    "feature_block",
    f"""{S.ALL_FEATURES}, block as (select address, max(amount) as largest_trade from cleaned group by address)
    select address, {r("total_roi")} as total_roi, largest_trade from features full join block using (address)""",
)
def feature_block(spark, sf):
    trades = stored(spark, sf)
    largest = lambda t: t.groupBy("address").agg(F.max("amount").alias("largest_trade"))
    matrix = P.build_features(trades, D.resolutions(spark, sf), blocks=[largest])
    return tidy(matrix.select("address", "total_roi", "largest_trade"))


def streak_and_trend(batches) -> dict:
    """The longest streak of purchases in a row, and the smoothed price after the last trade (each trade weighs a tenth)."""
    longest = run = 0
    trend = None
    for batch in batches:
        for buys, price in zip((side == "BUY" for side in batch.column("side").to_pylist()), batch.column("price").to_pylist()):
            run = run + 1 if buys else 0
            longest = max(longest, run)
            trend = price if trend is None else 0.9 * trend + 0.1 * price
    return {"longest_streak": longest, "price_trend": trend}


@query(
    "trader_function",
    f"""{S.ALL_FEATURES}, seq as (select address, side, price, row_number() over o as rn, count(*) over (partition by address) as n,
      row_number() over o - row_number() over (partition by address, side order by timestamp, transaction_id) as island from cleaned
      window o as (partition by address order by timestamp, transaction_id)),
    streaks as (select address, max(n) as longest_streak from (select address, island, count(*) as n from seq where side = 'BUY' group by all) group by 1),
    trends as (select address, sum(price * case when rn = 1 then 0.9::double ** (n - 1) else 0.1::double * 0.9::double ** (n - rn) end) as price_trend from seq group by 1)
    select address, {r("total_roi")} as total_roi, coalesce(longest_streak, 0) as longest_streak, {r("price_trend")} as price_trend
    from features join trends using (address) left join streaks using (address)""",
)
def trader_function(spark, sf):
    """Per-trader columns by a function over the trader's rows in order, streamed."""
    trades = stored(spark, sf)
    features = P.build_features(trades, D.resolutions(spark, sf))
    matrix = P.with_trader_function(features, trades, ["side", "price"], "longest_streak bigint, price_trend double", streak_and_trend)
    return tidy(matrix.select("address", "total_roi", "longest_streak", "price_trend"))


# ---------------------------------------------------------------- splits and labels


@query(
    "resolution_labels",
    f"{S.BASE}, {S.labels()} select address, n_resolved, n_correct, accuracy, Trader_Success_Rate, label_source from labels",
)
def resolution_labels(spark, sf):
    return L.resolution_labels(cleaned(spark, sf), D.resolutions(spark, sf))


@query(
    "resolution_labels_strict",
    f"""{S.BASE}, {S.labels(45, 0.52)}
    select address, n_resolved, n_correct, accuracy, Trader_Success_Rate, label_source from labels""",
)
def resolution_labels_strict(spark, sf):
    return L.resolution_labels(cleaned(spark, sf), D.resolutions(spark, sf), 45, 0.52)


_SPLIT = """span as (select epoch_us(min(timestamp)) as lo, epoch_us(max(timestamp)) as hi from {t}),
firsts as (select address, epoch_us(min(timestamp)) as f from {t} group by address),
placed as (
  select address, f as first_trade_date,
         case when f < lo + round((hi - lo) * 0.7::double) then 'train'
              when f < lo + round((hi - lo) * (0.7::double + 0.15::double)) then 'val' else 'test' end as split
  from firsts, span)"""


@query(
    "temporal_split",
    f"""with {S.SPARSE}, {_SPLIT.format(t="sparse")}
    select address, first_trade_date, split, split = 'train' as is_train from placed""",
)
def temporal_split(spark, sf):
    trades = D.sparse_trades(spark, sf)
    return tidy(L.temporal_split(trades.select("address").distinct(), trades))


# Simple per-trader returns over the sparse trades; markets whose number is a multiple of 4 are open.
_SPARSE_RETURNS = """sparse_returns as (
  select address, coalesce(sum(case when live then pnl end) / nullif(sum(case when live then invested end), 0), 0) as total_roi,
         coalesce(avg(case when live then (price >= 0.5)::int end), 0) as win_rate,
         coalesce(count(*) filter (live and pnl > 0)::double / nullif(count(*) filter (live and pnl < 0), 0), 0) as profit_loss_ratio
  from (select *, (o_key % 4 <> 0) and price > 0 as live,
          case when side = 'BUY' and price >= 0.5 then amount * (1 - price) when side = 'BUY' then -amount * price else amount * price end as pnl,
          case when side = 'BUY' then amount * price else amount * (1 - price) end as invested
        from (select *, substr(market_id, 2)::int as o_key from sparse)) group by address)"""


def _sparse_features(spark, sf):
    trades = D.sparse_trades(spark, sf)
    side, amount, price = F.col("side"), F.col("amount"), F.col("price")
    live = (F.substring("market_id", 2, 9).cast("int") % 4 != 0) & (price > 0)
    pnl, invested = X.trade_pnl(side, amount, price), X.trade_invested(side, amount, price)
    features = trades.groupBy("address").agg(
        safe_div(F.sum(F.when(live, pnl)), F.sum(F.when(live, invested))).alias("total_roi"),
        F.coalesce(F.avg(F.when(live, (price >= 0.5).cast("int"))), F.lit(0.0)).alias("win_rate"),
        safe_div(F.count_if(live & (pnl > 0)), F.count_if(live & (pnl < 0))).alias("profit_loss_ratio"),
    )
    # Ranks compare values for equality: drop the float noise first, as the SQL side does.
    features = features.withColumn("total_roi", F.round("total_roi", 9))
    return materialise(L.temporal_split(features, trades), "split")


_COMPOSITE = f"""with {S.SPARSE}, {_SPLIT.format(t="sparse")}, {_SPARSE_RETURNS},
rows_ as (select address, split, {r('total_roi', 9)} as total_roi, win_rate, profit_loss_ratio from sparse_returns join placed using (address)),
active as (select * from rows_ where total_roi <> 0 or win_rate <> 0 or profit_loss_ratio <> 0),
ranked as (
  select address, split, ({" + ".join(
      f"((rank() over (partition by split order by {c}) + (count(*) over (partition by split, {c}) - 1) / 2.0::double) / count(*) over (partition by split))"
      for c in ("total_roi", "win_rate", "profit_loss_ratio"))}) / 3.0::double as score from active),
bars as (select split, quantile_cont(score, 0.8) as bar from ranked group by split),
composite as (
  select address, split, (score >= bar)::int as Trader_Success_Rate, score as composite_score, 'composite_rank' as label_source
  from ranked join bars using (split)
  union all select address, split, 0, 0.0, 'composite_inactive' from rows_
  where not (total_roi <> 0 or win_rate <> 0 or profit_loss_ratio <> 0))"""


@query(
    "composite_labels",
    f"""{_COMPOSITE} select address, split, Trader_Success_Rate, {r("composite_score")} as composite_score, label_source from composite""",
)
def composite_labels(spark, sf):
    labeled = L.composite_labels(_sparse_features(spark, sf))
    return tidy(labeled.select("address", "split", schemas.LABEL, "composite_score", "label_source"))


@query(
    "split_summary",
    f"""{_COMPOSITE} select split, label_source, count(*) as traders, sum(Trader_Success_Rate)::bigint as informed,
    {r("avg(Trader_Success_Rate)")} as informed_rate from composite group by rollup (split, label_source)""",
)
def split_summary(spark, sf):
    return tidy(L.split_summary(L.composite_labels(_sparse_features(spark, sf))))


@query(
    "percent_ranks",
    f"""with {S.SPARSE}, {_SPLIT.format(t="sparse")}, {_SPARSE_RETURNS}
    select address, {r('''(rank() over (partition by split order by win_rate)
      + (count(*) over (partition by split, win_rate) - 1) / 2.0::double) / count(*) over (partition by split)''')} as win_rank
    from sparse_returns join placed using (address)""",
)
def win_rate_ranks(spark, sf, limit=None):
    ranked = percent_ranks(_sparse_features(spark, sf), {"win_rate": "win_rank"}, ["split"], limit)
    return tidy(ranked.select("address", "win_rank"))


@query("percent_ranks_cut", ORACLES["percent_ranks"])
def win_rate_ranks_cut(spark, sf):
    """The same with splits of over 50 traders ranked by distributed counts."""
    return win_rate_ranks(spark, sf, limit=50)


@query(
    "percent_ranks_missing",
    f"""with {S.SPARSE}, {_SPLIT.format(t="sparse")}, {_SPARSE_RETURNS},
    t as (select address, nullif(split, 'val') as split, case when win_rate > 0.2 then win_rate end as win_rate
          from sparse_returns join placed using (address))
    select address, {r('''case when win_rate is not null then (rank() over (partition by split order by win_rate nulls last)
      + (count(*) over (partition by split, win_rate) - 1) / 2.0::double) / count(win_rate) over (partition by split) end''')} as win_rank
    from t""",
)
def win_rate_ranks_missing(spark, sf, limit=50):
    """Ranks with missing values and a missing split, by distributed counts."""
    some = _sparse_features(spark, sf).withColumns(
        {"split": F.nullif(F.col("split"), F.lit("val")), "win_rate": F.when(F.col("win_rate") > 0.2, F.col("win_rate"))}
    )
    return tidy(percent_ranks(some, {"win_rate": "win_rank"}, ["split"], limit).select("address", "win_rank"))


@query(
    "model_input",
    f"""{S.ALL_FEATURES}, {_SPLIT.format(t="cleaned")}, {S.labels()}
    select address, {", ".join(f"{r(c)} as {c}" for c in _FEATURE_COLUMNS)}, first_trade_date, split,
           split = 'train' as is_train, n_resolved, n_correct, accuracy, Trader_Success_Rate, label_source
    from features join placed using (address) join labels using (address) where Trader_Success_Rate <> -1""",
)
def model_input(spark, sf):
    trades, resolutions = stored(spark, sf), D.resolutions(spark, sf)
    split = L.temporal_split(P.build_features(trades, resolutions), trades)
    return tidy(L.label_traders(split, trades, resolutions, mode="auto"))


@query(
    "model_input_as_of",
    f"""{S.ALL_FEATURES.replace("from events)", "from events where ts < timestamp '2024-01-28 00:00:00')", 1)}, {_SPLIT.format(t="cleaned")}, {S.labels()}
    select address, {", ".join(f"{r(c)} as {c}" for c in _FEATURE_COLUMNS)}, first_trade_date, split,
           split = 'train' as is_train, n_resolved, n_correct, accuracy, Trader_Success_Rate, label_source
    from features join placed using (address) join labels using (address) where Trader_Success_Rate <> -1""",
)
def model_input_as_of(spark, sf):
    """The model input of a past day, out of a table that holds later trades too."""
    made = preprocess(
        D.trades(spark, sf), D.resolutions(spark, sf), scratch_path(spark, "as-of"), S.MIN_TRADES, S.MIN_VOLUME, as_of="2024-01-28 00:00:00"
    )
    return tidy(made)


@query(
    "model_input_composite",
    f"""{S.ALL_FEATURES}, {_SPLIT.format(t="cleaned")},
    rows_ as (select address, split, round(total_roi, 10) as total_roi, round(win_rate, 10) as win_rate, round(profit_loss_ratio, 10) as profit_loss_ratio from features join placed using (address)),
    ranked as (select address, split, ({" + ".join(
      f"((rank() over (partition by split order by {c}) + (count(*) over (partition by split, {c}) - 1) / 2.0::double) / count(*) over (partition by split))"
      for c in ("total_roi", "win_rate", "profit_loss_ratio"))}) / 3.0::double as score from rows_
      where total_roi <> 0 or win_rate <> 0 or profit_loss_ratio <> 0)
    select address, ranked.split, (score >= bar)::int as Trader_Success_Rate, {r("score")} as composite_score
    from ranked join (select split, quantile_cont(score, 0.8) as bar from ranked group by split) b on ranked.split = b.split""",
)
def model_input_composite(spark, sf):
    trades, resolutions = stored(spark, sf), D.resolutions(spark, sf)
    split = L.temporal_split(P.build_features(trades, resolutions), trades)
    exact = split.withColumns({c: F.round(c, 10) for c in L.RANKED})
    labeled = L.label_traders(exact, trades, resolutions, mode="composite")
    return tidy(
        labeled.where("label_source = 'composite_rank'").select("address", "split", schemas.LABEL, "composite_score")
    )


@query("model_input_automatic", ORACLES["model_input_composite"])
def model_input_automatic(spark, sf):
    """Automatic labels where no market is resolved: none come from resolutions, so the rank-based ones are taken."""
    trades, resolutions = stored(spark, sf), D.resolutions(spark, sf)
    split = L.temporal_split(P.build_features(trades, resolutions), trades)
    exact = split.withColumns({c: F.round(c, 10) for c in L.RANKED})
    labeled = L.label_traders(exact, trades, resolutions.withColumn("resolution", F.lit("__OPEN__")), mode="auto")
    return tidy(labeled.where("label_source = 'composite_rank'").select("address", "split", schemas.LABEL, "composite_score"))


@query(
    "rar_labels",
    f"""{S.ALL_FEATURES}, {_SPLIT.format(t="cleaned")}
    select address, (Risk_Adjusted_Return >= (select quantile_cont(Risk_Adjusted_Return, 0.8)
      from features join placed using (address) where split = 'train'))::int as Trader_Success_Rate from features""",
)
def rar_labels(spark, sf):
    trades = stored(spark, sf)
    split = L.temporal_split(P.build_features(trades, D.resolutions(spark, sf)), trades)
    return L.rar_labels(split).select("address", schemas.LABEL)


@query(
    "legacy_split",
    f"""with {S.SPARSE}, {_SPLIT.format(t="sparse")},
    t as (select *, row_number() over (order by first_trade_date, address) as rn, count(*) over () as n
          from placed where split = 'train')
    select address, case when rn <= floor(n * 0.8::double) then 'train' else 'val' end as split from t
    union all select address, 'test' from placed where split <> 'train'""",
)
def legacy_split(spark, sf):
    trades = D.sparse_trades(spark, sf)
    placed = L.temporal_split(trades.select("address").distinct(), trades).drop("split")
    return L.legacy_split(placed).select("address", "split")


@query(
    "volume_quintiles",
    f"""{S.BASE}, {S.labels()}, totals as (select address, sum(volume) as volume from cleaned group by address),
    q as (select *, ntile(5) over (order by volume, address) as quintile from totals)
    select quintile::int as quintile, count(*) as traders, {r("sum(volume)", 6)} as volume,
           {r("avg(accuracy)")} as mean_accuracy, {r("avg((Trader_Success_Rate = 1)::int)")} as informed_rate
    from q join labels using (address) group by 1""",
)
def volume_quintiles(spark, sf):
    trades = cleaned(spark, sf)
    rows = L.volume_quintiles(trades, L.resolution_labels(trades, D.resolutions(spark, sf)))
    return tidy(rows.withColumn("volume", F.round("volume", 6)))


# ---------------------------------------------------------------- events and copied trades


def informed(trades, spark, sf):
    rated = L.resolution_labels(trades, D.resolutions(spark, sf))
    return materialise(V.informed_set(rated.withColumnRenamed(schemas.LABEL, "predicted_label")), "informed")


@query("informed_set", f"{S.BASE}, {S.INFORMED} select address from informed")
def informed_set(spark, sf):
    return informed(cleaned(spark, sf), spark, sf)


def _study_sql(windows) -> str:
    one = lambda w: f"""p{w} as (
      select e.transaction_id, coalesce(t.price, e.price) as price_{w}m,
             (coalesce(t.price, e.price) - e.price) * case when e.side = 'SELL' then -1 else 1 end as delta_{w}m
      from (select *, timestamp + interval {w} minute as at from chosen) e
      asof left join cleaned t on e.market_id = t.market_id and e.at >= t.timestamp)"""
    joins = " ".join(f"join p{w} using (transaction_id)" for w in windows)
    cells = ", ".join(f"{r(f'delta_{w}m')} as delta_{w}m, price_{w}m" for w in windows)
    return f"""{S.BASE}, {S.INFORMED}, chosen as (select * from cleaned where address in (select address from informed)),
    {", ".join(one(w) for w in windows)},
    study as (select transaction_id, address, market_id, epoch_us(timestamp) as timestamp, side, price as entry_price,
      {r("volume")} as volume, {cells} from chosen {joins})"""


@query("event_study", f"{_study_sql(V.WINDOWS)} select * from study")
def event_study(spark, sf):
    trades = stored(spark, sf)
    return tidy(V.event_study(trades, informed(trades, spark, sf)))


@query("event_study_by_market", ORACLES["event_study"])
def event_study_by_market(spark, sf):
    """The same over trades in buckets by market: only the informed trades are moved."""
    trades = by_market(spark, sf)
    return tidy(V.event_study(trades, informed(trades, spark, sf), buckets=BUCKETS))


_STUDY_ROWS = " union all ".join(
    f"select {w} as horizon, delta_{w}m as delta, volume from study" for w in V.LONG_WINDOWS
)


@query(
    "event_study_summary",
    f"""{_study_sql(V.LONG_WINDOWS)}, long as ({_STUDY_ROWS})
    select horizon, count(*) as events, {r("avg(delta)")} as mean_delta, {r("avg((delta > 0)::int)")} as win_rate,
      {r("stddev_samp(delta)")} as std_delta, {r("stddev_samp(delta) / sqrt(count(*))")} as sem,
      {r("1.96 * stddev_samp(delta) / sqrt(count(*))")} as ci95 from long group by horizon""",
)
def event_study_summary(spark, sf):
    trades = stored(spark, sf)
    study = V.event_study(trades, informed(trades, spark, sf), V.LONG_WINDOWS)
    # The exact move of 0 must not become a tiny gain.
    exact = study.withColumns({c: F.round(c, 8) for c in study.columns if c.startswith("delta_")})
    return tidy(V.event_study_summary(exact))


@query(
    "whale_impact",
    f"""{_study_sql(V.LONG_WINDOWS)}, long as ({_STUDY_ROWS})
    select horizon, count(*) as events, {r("avg(delta)")} as mean_delta from long where volume >= 50 group by horizon""",
)
def whale_impact(spark, sf):
    trades = stored(spark, sf)
    study = V.event_study(trades, informed(trades, spark, sf), V.LONG_WINDOWS)
    return tidy(V.whale_impact(study, min_volume=50.0))


def copies(spark, sf):
    trades = stored(spark, sf)
    return materialise(V.copy_trades(trades, informed(trades, spark, sf), D.resolutions(spark, sf)), "copies")


for _order, _keys in {"time": S.TIME_ORDER, "market": S.MARKET_ORDER}.items():

    @query(
        f"copy_trades_{_order}",
        f"""{S.ALL_COPIES}, {S.curve(_keys)}
        select transaction_id, epoch_us(timestamp) as timestamp, market_id, expert_address, exec_price, expert_price,
          {r("slippage")} as slippage, {r("net_profit", 6)} as net_profit, undefined_profit, {r("balance", 6)} as balance,
          {r("peak", 6)} as peak, {r("case when peak > 0 then (peak - balance) / peak else 0 end", 6)} as drawdown from curve""",
    )
    def copy_trades(spark, sf, order=_order):
        return tidy(Q.equity_curve(copies(spark, sf), order=order), 6)


@query("copy_trades_by_market", ORACLES["copy_trades_time"])
def copy_trades_by_market(spark, sf):
    """The same over trades in buckets by market: only the copied trades are moved."""
    trades = by_market(spark, sf)
    made = V.copy_trades(trades, informed(trades, spark, sf), D.resolutions(spark, sf), buckets=BUCKETS)
    return tidy(Q.equity_curve(materialise(made, "copies")), 6)


@query(
    "copy_metrics",
    f"""{S.ALL_COPIES}, {S.curve(S.MARKET_ORDER)}
    select count(*) as total_trades, {r("avg((coalesce(net_profit > 0, false) or undefined_profit)::int)")} as win_rate, {r("sum(net_profit)", 6)} as total_net_profit,
      {r("sum(net_profit) / (avg(exec_price) * count(*) + 1e-5)", 6)} as roi_ref,
      {r("sum(net_profit) / (count(*) * 100.0)")} as roi_capital,
      {r("greatest(0.0, max((peak - balance) / peak))")} as max_drawdown, {r("avg(slippage)")} as average_slippage from curve""",
)
def copy_metrics(spark, sf):
    rows = V.copy_metrics(Q.equity_curve(copies(spark, sf), order="market"))
    return tidy(rows.withColumns({c: F.round(c, 6) for c in ("total_net_profit", "roi_ref")}))


@query(
    "daily_sharpe",
    f"""{S.ALL_COPIES}, days as (select timestamp::date as day, sum(net_profit) as net from copies group by 1)
    select count(*) as days, {r("avg(net) / stddev_samp(net) * sqrt(365)")} as sharpe_ratio from days""",
)
def daily_sharpe(spark, sf):
    return tidy(V.daily_sharpe(copies(spark, sf)))


_EQUITY = f"""{S.curve(S.TIME_ORDER)}, path as (
  select *, lag(balance) over (order by {S.TIME_ORDER}) as before,
         max(balance) over (order by {S.TIME_ORDER} rows between unbounded preceding and current row) as top from summed)"""


def _equity(spark, sf, rows=None):
    curve = Q.equity_curve(copies(spark, sf) if rows is None else rows)
    return curve.select("timestamp", "transaction_id", F.col("balance").alias("total_equity"))


@query(
    "equity_path",
    f"""{S.ALL_COPIES}, {_EQUITY} select transaction_id, {r("balance", 6)} as total_equity, {r("top", 6)} as peak,
    {r("(balance - top) / top")} as drawdown, {r("coalesce(balance / before - 1, 0)")} as returns from path""",
)
def equity_path(spark, sf):
    path = Q.equity_path(materialise(_equity(spark, sf), "equity"), ["timestamp", "transaction_id"])
    money_columns = {c: F.round(c, 6) for c in ("total_equity", "peak")}
    return tidy(path.drop("timestamp").withColumns(money_columns))


@query(
    "equity_metrics",
    f"""{S.ALL_COPIES}, {_EQUITY} select 10000.0::double as initial_capital,
      {r("arg_max(balance, (timestamp, transaction_id))", 6)} as final_equity,
      {r("(arg_max(balance, (timestamp, transaction_id)) - 10000) / 100", 6)} as total_return_pct,
      {r("min((balance - top) / top) * 100", 6)} as max_drawdown_pct,
      {r("avg(coalesce(balance / before - 1, 0)) / stddev_samp(coalesce(balance / before - 1, 0)) * sqrt(365)", 6)} as sharpe_ratio
    from path""",
)
def equity_metrics(spark, sf):
    equity = materialise(_equity(spark, sf), "equity")
    return tidy(Q.equity_metrics(equity, order=["timestamp", "transaction_id"]), 6)


_DRAW = "(('0x' || substr(md5('{salt}' || transaction_id), 1, 8))::bigint / 4294967296.0::double)"


@query(
    "coin_flips",
    f"""{S.ALL_COPIES} select transaction_id, case when {_DRAW.format(salt="coin")} < 0.5 then 100.0 else -100.0 end::double as net_profit from copies""",
)
def coin_flips(spark, sf):
    return V.coin_flips(copies(spark, sf)).drop("timestamp")


@query(
    "alpha_over_coin_flips",
    f"""{S.ALL_COPIES} select {r(f"(sum(coalesce(net_profit, 0)) - sum(case when {_DRAW.format(salt='coin')} < 0.5 then 100.0 else -100.0 end)) / 100", 6)} as alpha_pct from copies""",
)
def alpha_over_coin_flips(spark, sf):
    rows = copies(spark, sf)
    order = ["timestamp", "transaction_id"]
    ours = Q.equity_metrics(_equity(spark, sf, rows), order=order)
    flips = Q.equity_metrics(_equity(spark, sf, V.coin_flips(rows)), order=order)
    return tidy(Q.alpha(ours, flips), 6)


_ORDER_COLUMNS = "transaction_id, address, market_id, 'Yes' as outcome, 'BUY' as side"


@query(
    "copy_orders",
    f"""{S.BASE}, {S.INFORMED} select {_ORDER_COLUMNS}, {r("least(amount * 0.1, 20.0)")} as amount, price, epoch_us(timestamp) as timestamp
    from cleaned where address in (select address from informed) and side = 'BUY' and price > 0 and price < 1
      and least(amount * 0.1, 20.0) > 1.0""",
)
def copy_orders(spark, sf):
    trades = stored(spark, sf)
    return tidy(V.copy_orders(trades, informed(trades, spark, sf), fraction=0.1, cap=20.0))


@query(
    "random_orders",
    f"""with {S.TRADES} select {_ORDER_COLUMNS}, 50.0::double as amount, price, epoch_us(timestamp) as timestamp
    from trades where side = 'BUY' and price > 0 and price < 1 and {_DRAW.format(salt="")} < 0.03""",
)
def random_orders(spark, sf):
    return tidy(V.random_orders(D.trades(spark, sf), probability=0.03))


@query(
    "signal_orders",
    f"""with {S.TRADES} select {_ORDER_COLUMNS}, {r("least(amount, 100.0) * (1 - price)")} as amount, price, epoch_us(timestamp) as timestamp
    from trades where side = 'SELL' and price between 0.4 and 0.6""",
)
def signal_orders(spark, sf):
    """A user's rule: buy against sales near even odds, the more the cheaper."""
    near_even = (F.col("side") == "SELL") & F.col("price").between(0.4, 0.6)
    size = F.least(F.col("amount"), F.lit(100.0)) * (1 - F.col("price"))
    return tidy(V.signal_orders(D.trades(spark, sf), lambda t: (near_even, size)))


@query(
    "positions",
    f"""with {S.TRADES} select address, market_id, {r("sum(case when side = 'BUY' then amount else -amount end)", 6)} as token_balance,
    {r("sum(case when side = 'BUY' then amount * price end) / nullif(sum(case when side = 'BUY' then amount end), 0)", 6)} as avg_price,
    epoch_us(max(timestamp)) as last_updated from trades group by address, market_id""",
)
def positions(spark, sf):
    return tidy(V.positions(D.trades(spark, sf)), 6)


@query(
    "roi_histogram",
    f"""{S.BASE}, {S.RETURNS}, edges as (select min(total_roi) as lo, max(total_roi) as hi from returns),
    placed as (select least(14, floor((total_roi - lo) / (hi - lo) * 15))::int as bin, count(*) as n from returns, edges group by 1)
    select b.bin::int as bin, {r("lo + (hi - lo) * b.bin / 15")} as bin_start, {r("lo + (hi - lo) * (b.bin + 1) / 15")} as bin_end,
      coalesce(n, 0) as n from (select unnest(range(15)) as bin) b cross join edges left join placed on placed.bin = b.bin""",
)
def roi_histogram(spark, sf):
    return tidy(V.histogram(P.return_features(pairs(spark, sf), D.resolutions(spark, sf)), "total_roi"))


# ---------------------------------------------------------------- classifier metrics

_RANKED_SCORES = f"""with {S.SCORES}, steps as (
  select p as score, count(*) filter (actual_label = 1) as pos, count(*) filter (actual_label = 0) as neg from scores group by p),
cum as (
  select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
         sum(pos) over () as all_pos, sum(neg) over () as all_neg from steps)"""


@query(
    "classification_metrics",
    f"""{_RANKED_SCORES},
    pairs as (select avg(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0 end) as auc
              from scores a, scores b where a.actual_label = 1 and b.actual_label = 0),
    c as (select count(*) filter (actual_label = 1 and predicted_label = 1) as tp,
                 count(*) filter (actual_label = 0 and predicted_label = 1) as fp,
                 count(*) filter (actual_label = 1 and predicted_label = 0) as fn, count(*) as n,
                 avg(-ln(case when actual_label = 1 then least(greatest(p, {M.EPSILON}), 1 - {M.EPSILON})
                              else 1 - least(greatest(p, {M.EPSILON}), 1 - {M.EPSILON}) end)) as log_loss,
                 avg(pow(p - actual_label, 2)) as brier_score, avg((actual_label = predicted_label)::int) as accuracy from scores)
    select {r("accuracy")} as accuracy, {r("tp / (tp + fp)::double")} as precision, {r("tp / (tp + fn)::double")} as recall,
      {r("2 * tp / (2 * tp + fp + fn)::double")} as f1, {r("log_loss", 6)} as log_loss, {r("brier_score")} as brier_score,
      {r("(select auc from pairs)")} as auc_roc,
      {r("(select sum(pos / all_pos::double * tp / (tp + fp)) from cum)")} as avg_precision from c""",
)
def classification_metrics(spark, sf):
    return tidy(M.evaluate(D.scores(spark, sf)).withColumn("log_loss", F.round("log_loss", 6)))


@query(
    "class_report",
    f"""with {S.SCORES}, k as (select unnest([0, 1]) as k), c as (
      select k, count(*) filter (actual_label = k and predicted_label = k)::double as hit,
             count(*) filter (predicted_label = k) as named, count(*) filter (actual_label = k) as support from scores, k group by k)
    select case k when 0 then 'Noise' else 'Informed' end as class, {r("hit / named")} as precision, {r("hit / support")} as recall,
      {r("2 * hit / (named + support)")} as f1, support from c""",
)
def class_report(spark, sf):
    return tidy(M.class_report(D.scores(spark, sf)))


@query(
    "confusion_matrix",
    f"""with {S.SCORES} select actual_label as actual, predicted_label as predicted, count(*) as n from scores group by 1, 2""",
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(D.scores(spark, sf))


@query(
    "roc_points",
    f"""{_RANKED_SCORES} select score as threshold, {r("fp / all_neg::double")} as fpr, {r("tp / all_pos::double")} as tpr from cum""",
)
def roc_points(spark, sf):
    return tidy(M.roc_points(D.scores(spark, sf)).where("threshold <= 1"))


@query(
    "pr_points",
    f"""{_RANKED_SCORES} select score as threshold, {r("tp / (tp + fp)::double")} as precision, {r("tp / all_pos::double")} as recall from cum""",
)
def pr_points(spark, sf):
    return tidy(M.pr_points(D.scores(spark, sf)))


@query(
    "calibration_bins",
    f"""with {S.SCORES} select greatest(0, ceil(p * 8)::int - 1)::int as bin, count(*) as n, {r("avg(p)")} as mean_predicted,
    {r("avg(actual_label)")} as observed_rate from scores group by 1""",
)
def calibration_bins(spark, sf):
    return tidy(M.calibration_bins(D.scores(spark, sf)))


@query(
    "mcnemar",
    f"""with {S.SCORES}, c as (
      select count(*) filter (predicted_label = actual_label and other_label <> actual_label) as a_only,
             count(*) filter (predicted_label <> actual_label and other_label = actual_label) as b_only from scores),
    t as (select *, pow(abs(a_only - b_only) - 1, 2) / (a_only + b_only) as chi2 from c),
    -- The tail by Simpson's rule over the normal density.
    tail as (select 1 - 2 * sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end
               * exp(-pow(sqrt(chi2) * i / 4000, 2) / 2)) * any_value(sqrt(chi2)) / 4000 / 3 / sqrt(2 * pi()) as p
             from t, range(4001) as g(i))
    select a_only, b_only, {r("chi2", 6)} as chi2, {r("p", 6)} as p_value,
      case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end as significance from t, tail""",
)
def mcnemar(spark, sf):
    scores = D.scores(spark, sf)
    other = scores.select("address", "actual_label", F.col("other_label").alias("predicted_label"))
    return tidy(M.mcnemar(scores, other), 6)


@query(
    "overfit_flags",
    f"""with {S.SCORES}, parts as (select *, case when substr(address, 2)::int % 5 < 3 then 'train'
        when substr(address, 2)::int % 5 = 3 then 'val' else 'test' end as split from scores),
    a as (select x.split, avg(case when x.p > y.p then 1.0 when x.p = y.p then 0.5 else 0 end) as auc
          from parts x join parts y on x.split = y.split where x.actual_label = 1 and y.actual_label = 0 group by 1),
    w as (select max(auc) filter (split = 'train') as t, max(auc) filter (split = 'val') as v, max(auc) filter (split = 'test') as e from a)
    select {r("t")} as train_auc, {r("v")} as val_auc, {r("e")} as test_auc, t - v > 0.05 as overfit_warning_val,
      t - e > 0.05 as overfit_warning_test from w""",
)
def overfit_flags(spark, sf):
    k = F.substring("address", 2, 12).cast("bigint") % 5
    split = F.when(k < 3, "train").when(k == 3, "val").otherwise("test")
    return tidy(M.overfit_flags(D.scores(spark, sf).withColumn("split", split)))


# ---------------------------------------------------------------- models

_kept: dict[tuple, object] = {}


def once(spark, sf, name: str, make):
    """What ``make`` gives, once per session and data set until its tables are released."""
    key = (spark.sparkContext.applicationId, sf, releases(), name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


# Families without early stopping.
SUMMED = [name for name, c in models.CANDIDATES.items() if not c.early_stop]


def model_rows(spark, sf):
    def make():
        trades = D.sparse_trades(spark, sf)
        features = P.build_features(C.clean(trades, 1, 0.0), D.resolutions(spark, sf), sizes_from=trades)
        return materialise(L.composite_labels(L.temporal_split(features, trades)), "model_input")

    return once(spark, sf, "rows", make)


def prepared(spark, sf):
    return once(spark, sf, "prepared", lambda: training.prepare(model_rows(spark, sf)))


def searched(spark, sf, name):
    """Parameters of the full search of a family and their mean area over the folds."""
    ready, candidate = prepared(spark, sf), models.CANDIDATES[name]
    return once(spark, sf, f"search of {name}", lambda: training.search(candidate, ready.blocks, ready.val, ready.n))


def trained(spark, sf, names=tuple(models.CANDIDATES), folds=False):
    """Full search and training of the named families, of all unless told, with fold metrics if asked for; each is run once and shared."""
    position = {name: k for k, name in enumerate(models.CANDIDATES)}

    def family(name):
        candidate, ready, found = models.CANDIDATES[name], prepared(spark, sf), searched(spark, sf, name)
        run = once(spark, sf, name, lambda: training.train_family(ready, name, candidate, position[name], detailed_cv=False, found=found))
        if folds:
            cv = once(spark, sf, f"folds of {name}", lambda: training.fold_metrics(ready, name, candidate, run.parameters[name]))
            return replace(run, cv=cv)
        return run

    prepared(spark, sf)  # once, before the families side by side: one fills the cores while another waits for its small jobs
    with ThreadPoolExecutor(len(names)) as pool:
        return training.together(list(pool.map(family, names)))


@query("model_comparison")
def model_comparison(spark, sf):
    return training.model_comparison(trained(spark, sf)).drop("position", "train_time_sec")


@query("training_report")
def training_report(spark, sf):
    """Parameters and metrics of every model, through the written report."""
    run, path = trained(spark, sf, folds=True), scratch_path(spark, "report")
    training.write_report(run, path)
    shape = training.training_report(run)
    written = spark.read.schema(shape.schema).json(f"{path}/training_report")
    return written.drop("position", "train_time_sec")


@query("best_model")
def best_model(spark, sf):
    return training.select_best(training.model_comparison(trained(spark, sf))).select("model", "auc_roc")


@query("exported_predictions")
def exported_predictions(spark, sf):
    run = trained(spark, sf)
    best = training.select_best(training.model_comparison(run)).first()["model"]
    return training.export_predictions(run, best)


@query("saved_model_predictions")
def saved_model_predictions(spark, sf):
    """The exported predictions of the best model after it was saved and loaded."""
    run, path = trained(spark, sf), scratch_path(spark, "saved")
    training.save_best(run, path)
    tested = training.load_best(path).predict(prepared(spark, sf).rows.where("split = 'test'"))
    return tidy(tested.select("address", "predicted_label", "predicted_probability", schemas.LABEL))


@query("model_mcnemar")
def model_mcnemar(spark, sf):
    return training.mcnemar_tests(trained(spark, sf))


@query("model_overfit_flags")
def model_overfit_flags(spark, sf):
    return training.overfit_flags(trained(spark, sf))


@query("forest_search")
def forest_search(spark, sf):
    """The areas of all draws of the forest search on all folds."""
    candidate = models.CANDIDATES["Random Forest"]
    points = models.parameter_sets(candidate.space, candidate.draws)
    scores = training.search_scores(candidate, points, prepared(spark, sf).blocks, times="times")
    areas = M.rank_metrics(scores, ["point", "block"], times="times").select("point", F.col("block").alias("fold"), "auc_roc", "avg_precision")
    settings = "point int, n_estimators int, max_depth int, min_samples_leaf int, max_features string"
    drawn = spark.createDataFrame([(i, *(p[k] for k in candidate.space)) for i, p in enumerate(points)], settings)
    # One row a draw: tiny by construction.
    return tidy(areas.join(F.broadcast(drawn), "point"))


@query("cross_validation")
def cross_validation(spark, sf):
    return training.cv_results(trained(spark, sf, folds=True))


for _name in models.CANDIDATES:

    @query("attribution_" + _name.lower().replace(" ", "_"))
    def feature_attribution(spark, sf, name=_name):
        """Of the searched model where the family is searched here; of one with default settings for boosted trees."""
        rows = model_rows(spark, sf).where("split = 'test'")
        ready, candidate = prepared(spark, sf), models.CANDIDATES[name]
        if name in SUMMED:
            return attribution.feature_attribution(training.fit_searched(ready, candidate, searched(spark, sf, name)[0]), rows)
        return attribution.feature_attribution(models.fit_one(candidate, models.DEFAULTS[name], ready.n, ready.train, ready.val), rows)


# Three return features and the composite label of the sparse trades, in blocks by first trade.
_BLOCKS = f"""{_COMPOSITE},
blocks as (
  select address, label, total_roi, win_rate, profit_loss_ratio,
         case when rn - 1 < n - 5 * (n // 6) then 0 else (rn - 1 - (n - 5 * (n // 6))) // (n // 6) + 1 end::int as block
  from (select r.*, c.Trader_Success_Rate as label, row_number() over (order by first_trade_date, address) as rn, count(*) over () as n
        from rows_ r join composite c using (address) join placed using (address) where r.split = 'train')),
wide as (select block, label, unnest([{{'feature': 'total_roi', 'x': total_roi}}, {{'feature': 'win_rate', 'x': win_rate}}, {{'feature': 'profit_loss_ratio', 'x': profit_loss_ratio}}], recursive := true), address from blocks)"""
_RETURN_COLUMNS = ["total_roi", "win_rate", "profit_loss_ratio"]


def _blocks(spark, sf):
    def make():
        rows = L.composite_labels(_sparse_features(spark, sf)).where("split = 'train'")
        return materialise(models.expanding_blocks(rows.withColumn("label", F.col(schemas.LABEL).cast("double"))), "blocks")

    return once(spark, sf, "blocks", make)


@query(
    "block_moments",
    f"""{_BLOCKS} select block, label, feature, count(*) as n, {r("avg(x)")} as mean, {r("var_pop(x)")} as variance from wide group by all""",
)
def block_moments(spark, sf):
    """The sums that all fold fits of the additive models are merged from."""
    table = additive.moments(_blocks(spark, sf), "block", _RETURN_COLUMNS)
    names = F.array(*map(F.lit, _RETURN_COLUMNS))
    cells = table.select(F.col("group").alias("block"), "label", "n", F.inline(F.arrays_zip(names.alias("feature"), F.col("means").alias("mean"), F.col("squares").alias("_s"))))
    return tidy(cells.withColumn("variance", F.col("_s") / F.col("n")).drop("_s"))


@query(
    "nb_folds",
    f"""{_BLOCKS},
    folds as (select unnest(range(1, 6))::int as fold),
    sides as (select fold, feature, label, count(*) as n, avg(x) as m, var_pop(x) as v from wide, folds where block < fold group by all),
    added as (select fold, feature, 1e-9::double * var_pop(x) as e from wide, folds where block < fold group by all),
    terms as (
      select w.address, f.fold, ln(b.n::double / a.n) as prior,
             -0.5::double * ln((b.v + e) / (a.v + e)) - (x - b.m) ** 2 / (2 * (b.v + e)) + (x - a.m) ** 2 / (2 * (a.v + e)) as term
      from wide w join folds f on w.block = f.fold join added using (fold, feature)
      join sides a on a.fold = f.fold and a.feature = w.feature and a.label = 0 join sides b on b.fold = f.fold and b.feature = w.feature and b.label = 1),
    odds as (select address, fold, max(prior) + sum(term) as z from terms group by all)
    select address, fold, round(1 / (1 + exp(-least(600, greatest(-600, z)))), 6) as predicted_probability from odds""",
)
def nb_folds(spark, sf):
    """Naive Bayes of every expanding fold from merged block moments, on the rows it is tested on."""
    blocks = _blocks(spark, sf)
    fitted = additive.fit_naive_bayes(blocks, "block", _RETURN_COLUMNS, [({}, list(range(k))) for k in training.FOLDS])
    scored = additive.held_out(blocks, "block", {k: [m] for k, m in zip(training.FOLDS, fitted)}, keep=("address",))
    return scored.select("address", F.col("block").alias("fold"), F.round(F.col("scores")[0], 6).alias("predicted_probability"))


@query(
    "logistic_search",
    f"""{_BLOCKS} select fold::int as fold, c::double as c, feature, count(*) as n, 0.0::double as gradient
    from blocks, (select unnest(range(1, 6)) as fold), (values (0.001), (0.01), (0.1), (1), (10), (100)) as grid(c),
      (values ('intercept'), ('total_roi'), ('win_rate'), ('profit_loss_ratio')) as names(feature)
    where block < fold group by all""",
)
def logistic_search(spark, sf):
    """All settings and folds of the logistic search: the gradient at each fit's coefficients, zero to six digits."""
    blocks, points = _blocks(spark, sf), models.parameter_sets(models.LOGISTIC_GRID)
    fitted = training.search_models(models.CANDIDATES["Logistic Regression"], points, blocks, _RETURN_COLUMNS)
    by_fold = {tuple(range(k)): [(m, p["C"]) for m, p in zip(found, points)] for k, found in fitted.items()}
    found = additive.gradients(blocks, by_fold, "block")
    return found.select((F.col("groups") + 1).alias("fold"), "c", "feature", "n", (F.round("gradient", 6) + F.lit(0.0)).alias("gradient"))


_ISOTONIC = f"""with {S.SCORES}, single as (select p as x, avg(actual_label) as y, count(*) as w from scores group by 1),
    sums as (select x, sum(y * w) over (order by x) as s, sum(w) over (order by x) as c, y * w as own, w from single),
    spans as (select a.x as lo, b.x as hi, (b.s - a.s + a.own) / (b.c - a.c + a.w) as mean from sums a join sums b on a.x <= b.x),
    fitted as (select x, max(low) as level from (select i.x, lo, min(mean) as low from single i join spans on lo <= i.x and hi >= i.x group by i.x, lo) group by x)
    select {r("min(x)")} as low, {r("max(x)")} as high, {r("level")} as level, sum(w)::double as weight
    from (select x, round(level, 10) as level from fitted) join single using (x) group by level"""


@query("isotonic_fit", _ISOTONIC)
def isotonic_fit(spark, sf, limit=None):
    """The calibration curve of the score table, tied scores included."""
    return tidy(isotonic.levels(D.scores(spark, sf), "predicted_probability", "actual_label", limit=limit).drop("group"))


@query("isotonic_fit_cut", _ISOTONIC)
def isotonic_fit_cut(spark, sf):
    """The same from many short ranges."""
    return isotonic_fit(spark, sf, limit=4)


@query(
    "expanding_blocks",
    f"""with {S.SPARSE}, {_SPLIT.format(t="sparse")},
    t as (select address, row_number() over (order by first_trade_date, address) as rn, count(*) over () as n from placed)
    select address, case when rn - 1 < n - 5 * (n // 6) then 0 else (rn - 1 - (n - 5 * (n // 6))) // (n // 6) + 1 end::int as block from t""",
)
def expanding_blocks(spark, sf):
    trades = D.sparse_trades(spark, sf)
    placed = L.temporal_split(trades.select("address").distinct(), trades)
    return models.expanding_blocks(placed).select("address", "block")


@query(
    "class_weights",
    f"""with {S.SCORES} select address, {r("count(*) over () / (2.0::double * count(*) over (partition by actual_label))")} as balanced,
    {r("case when actual_label = 1 then (count(*) filter (actual_label = 0) over ()) / (count(*) filter (actual_label = 1) over ())::double else 1.0 end")} as pos_scaled
    from scores""",
)
def class_weights(spark, sf):
    return tidy(models.with_weights(D.scores(spark, sf), "actual_label").select("address", "balanced", "pos_scaled"))


# ---------------------------------------------------------------- streams


def _landed(spark, sf) -> tuple[str, str]:
    """The feed objects of the sample as files of JSON lines, and an empty work folder."""
    root = scratch_path(spark, "stream")
    D.feed_text(spark, sf).select("body").write.text(f"{root}/pages", lineSep="\n")
    return f"{root}/pages", root


PAGES, FILE_ROWS = 4, 100_000  # pages that land one after the other, and about the rows of one of a page's files


def _land(spark, sf, folder: str, page: int) -> int:
    """Lands a page of the sample's feed as files whose names and times follow the order of arrival, one task for each.

    Returns the number of files of a page. It grows with the feed, so no task does; a slot without objects may have no file.
    """
    events = D.table(spark, sf, "events")
    total, first, last = (x or 0 for x in events.agg(F.count("event_id"), F.min("event_id"), F.max("event_id")).first())
    files = max(1, -(-total // (PAGES * FILE_ROWS)))
    low, high = (first + (last - first + 1) * k // PAGES for k in (page, page + 1))
    slot = F.floor((F.col("event_id") - low) * files / max(1, high - low)).cast("int")
    part = events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).repartitionById(files, slot).sortWithinPartitions("event_id")
    known = dated_files(spark, folder)
    # The objects' texts are made where they are written: rows of a page may lie in one file of the table.
    D.feed_text(spark, sf, part).select("body").write.mode("append").text(folder, lineSep="\n")
    dated_files(spark, folder, known, page * files)
    return files


@query("stream_ingest", f"with {S.FEED} select distinct transaction_id from feed")
def stream_ingest(spark, sf):
    pages, root = _landed(spark, sf)
    for _ in range(2):  # the second run finds nothing new
        W.incremental_ingest(spark, pages, f"{root}/store", f"{root}/check", lines=True).awaitTermination()
    return W.read_store(spark, f"{root}/store").select("transaction_id")


def _drained(stream: DataFrame, root: str) -> DataFrame:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/check")
    writer.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query(
    "stream_ingest_batches",
    f"""with {S.FEED} select transaction_id, address, market_id, side, outcome, amount, price, timestamp_us as timestamp from feed
    qualify row_number() over (partition by transaction_id order by arrival) = 1""",
)
def stream_ingest_batches(spark, sf):
    """All columns of the kept rows after several micro-batches of one page each, with repeats across the pages."""
    root = scratch_path(spark, "stream")
    files = [_land(spark, sf, f"{root}/pages", k) for k in range(PAGES)]
    W.incremental_ingest(spark, f"{root}/pages", f"{root}/store", f"{root}/check", max_files=files[0], lines=True).awaitTermination()
    return tidy(W.read_store(spark, f"{root}/store").drop("title", "slug", "event_slug", "batch"))


def _by_state(spark, sf) -> tuple[str, str]:
    """Store and checkpoint after two runs over pages that landed one after the other, with repeats within and across them."""
    root = scratch_path(spark, "stream")
    for k in range(PAGES):
        files = _land(spark, sf, f"{root}/pages", k)
        if k in (1, 3):  # the second run starts from the first one's checkpoint
            W.incremental_ingest(spark, f"{root}/pages", f"{root}/store", f"{root}/check", max_files=files, lines=True, by_state=True).awaitTermination()
    return f"{root}/store", f"{root}/check"


@query("stream_first_arrivals", ORACLES["stream_ingest_batches"])
def stream_first_arrivals(spark, sf):
    """All columns of the first arrivals, found by state on disk over several batches and a restart."""
    return tidy(W.read_store(spark, _by_state(spark, sf)[0]).drop("title", "slug", "event_slug", "batch"))


@query("stream_state_rows", f"with {S.FEED} select count(distinct transaction_id) as hashes, count(distinct transaction_id) as state_rows from feed")
def stream_state_rows(spark, sf):
    """The state read back: one row for each hash that has come, however often."""
    state = W.stored_state(spark, _by_state(spark, sf)[1])
    return state.agg(F.countDistinct("transaction_id").alias("hashes"), F.count("*").alias("state_rows"))


@query(
    "stream_dedup",
    f"with {S.FEED} select distinct transaction_id from feed where timestamp_us is not null",
)
def stream_dedup(spark, sf):
    pages, root = _landed(spark, sf)
    rows = W.stream_dedup(W.stream_trades(spark, pages, lines=True), delay="60 days")
    return _drained(rows, root).select("transaction_id")


# The stream emits an hour once no row can reach it any more: all but the last two hours of the sample.
@query(
    "stream_timeline",
    f"""with {S.FEED}, closed as (select (max(timestamp_us) - 3600000000) // 3600000000 as h from feed)
    select timestamp_us // 3600000000 * 3600000000 as bucket, count(*) as trade_count, {money('sum(amount * price)')} as volume, count(distinct address) as unique_wallets
    from feed, closed where timestamp_us is not null and timestamp_us // 3600000000 < h group by 1""",
)
def stream_timeline(spark, sf):
    pages, root = _landed(spark, sf)
    rows = W.stream_timeline(W.stream_trades(spark, pages, lines=True), "hour", delay="1 hour")
    return tidy(_drained(rows, root))
