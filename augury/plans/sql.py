"""Shared parts of the DuckDB texts the registered queries are checked against.

They are written from the meaning of each analysis, row by row where the Spark side pre-aggregates, so that the two
sides share no shortcut.
"""

from __future__ import annotations

MIN_TRADES, MIN_VOLUME = 60, 1500.0


def r(expression: str, digits: int = 8) -> str:
    """Rounded, without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0::double)"


def money(expression: str) -> str:
    """Two digits, half away from zero, after dropping float noise."""
    return f"round(cast({expression} as decimal(38, 6)), 2)::double"


PRICE = "((cast(round(value * 100) as bigint) % 100) / 100.0::double)"

TRADES = f"""trades as (
  select 't' || event_id as transaction_id, 'w' || user_id as address,
         'm' || json_extract_string(props, '$.k') as market_id,
         case when event_type in ('purchase', 'signup', 'click') then 'BUY' else 'SELL' end as side,
         value as amount, {PRICE} as price, ts as timestamp, event_id
  from events)"""

RESOLUTIONS = """res as (
  select 'm' || k as market_id, 'Market ' || k as question,
         case k::int % 6 when 0 then 'Yes' when 1 then 'No' when 2 then ' UP ' when 3 then '0.7'
                         when 4 then '__OPEN__' end as resolution,
         'market-' || k as slug
  from (select distinct json_extract_string(props, '$.k') as k from events) where k is not null)"""

# Readings of the six kinds of resolution text.
LABEL_RESULT = """case trim(lower(resolution)) when 'yes' then 'YES' when 'no' then 'NO' when 'up' then 'YES'
                       when '0.7' then 'YES' else 'OPEN' end"""
STRICT_RESULT = "case lower(resolution) when 'yes' then 'YES' when 'no' then 'NO' else 'OPEN' end"

CLEANED = f"""cleaned as (
  select *, amount * price as volume from trades
  where price >= 0 and price <= 1 and amount >= 0 and address in (
    select address from trades where price >= 0 and price <= 1 and amount >= 0
    group by address having count(*) >= {MIN_TRADES} and sum(amount * price) >= {MIN_VOLUME}))"""

BASE = f"with {TRADES}, {RESOLUTIONS}, {CLEANED}"

RETURNS = """valid as (
  select c.*,
         case when side = 'BUY' and price >= 0.5 then amount * (1 - price)
              when side = 'BUY' then -(amount * price) else amount * price end as pnl,
         case when side = 'BUY' then amount * price else amount * (1 - price) end as invested
  from cleaned c join res using (market_id)
  where resolution is not null and resolution not in ('', '__OPEN__') and amount > 0 and price > 0),
cumulated as (
  select *, sum(pnl) over (partition by address order by market_id, timestamp, transaction_id
                           rows between unbounded preceding and current row) as cum from valid),
peaked as (
  select *, greatest(0.0, max(cum) over (partition by address order by market_id, timestamp, transaction_id
                           rows between unbounded preceding and current row)) as peak from cumulated),
folded as (
  select address, sum(pnl) as pnl, sum(invested) as invested, min(cum - peak) as fall,
         avg(case when price >= 0.5 then 1.0 else 0.0 end) as win_rate,
         avg(case when pnl > 0 then pnl end) as mean_gain, avg(case when pnl < 0 then -pnl end) as mean_loss
  from peaked group by address),
returns as (
  select address, case when invested > 0 then pnl / invested else 0 end as total_roi,
         least(0.0, fall / case when invested > 0 then invested else 1 end) as max_drawdown,
         win_rate, least(10.0, coalesce(mean_gain, 0) / (coalesce(mean_loss, 1e-6) + 1e-6)) as profit_loss_ratio,
         pnl as total_pnl
  from folded)"""

BEHAVIOUR = """markets as (
  select market_id, min(timestamp) as s, max(timestamp) as e,
         avg(case when side = 'BUY' then 1.0 else 0.0 end) as buy_ratio from cleaned group by market_id),
behaviour as (
  select address,
         1 - avg((epoch_us(timestamp) - epoch_us(s)) / 1e6 / greatest((epoch_us(e) - epoch_us(s)) / 1e6, 1.0))
           as early_entry_score,
         avg(abs(case when side = 'BUY' then 1.0 else 0.0 end - buy_ratio)) as contrarian_score,
         count(distinct market_id)::double / count(*) as cross_market_diversification
  from cleaned join markets using (market_id) group by address)"""

INFORMATION = """lagged as (
  select address, price, lag(price) over (partition by address order by timestamp, transaction_id) as prev
  from cleaned),
steps as (
  select address, case when prev > 0 then price / prev - 1 end as step,
         case when prev = 0 and price > 0 then 1 else 0 end as infinite from lagged),
information as (
  select address,
         case when count(*) < 2 then 0.0
              when sum(infinite) > 0 or count(step) < 2 then null
              when min(step) = max(step) then 0.0
              else avg(step) / stddev_samp(case when infinite = 0 then step end) end as information_ratio
  from steps group by address)"""

ACTIVITY = """gaps as (
  select address, timestamp, (epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 86400e6 as gap
  from cleaned window w as (partition by address order by timestamp)),
activity as (
  select address, coalesce(avg(gap), 0.0) as avg_holding_period,
         case when count(*) < 2 then 0.0 else count(*) / greatest(
           (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6, 1.0 / 24) end as trading_frequency
  from gaps group by address),
flow as (
  select address, sum(volume) / (select sum(volume) from cleaned) as capital_flow_centrality
  from cleaned group by address)"""

_CLIPPED = [
    "total_roi", "max_drawdown", "win_rate", "profit_loss_ratio", "information_ratio",
    "trading_frequency", "avg_holding_period", "capital_flow_centrality",
]
_PLAIN = ["early_entry_score", "contrarian_score", "cross_market_diversification"]


def _clip(c: str) -> str:
    lo, hi = f"(select quantile_cont({c}, 0.01) from raw)", f"(select quantile_cont({c}, 0.99) from raw)"
    return f"case when {c} < {lo} then {lo} when {c} > {hi} then {hi} else {c} end as {c}"


FEATURES = f"""raw as (
  select b.address, coalesce(total_roi, 0) as total_roi, coalesce(max_drawdown, 0) as max_drawdown,
         coalesce(win_rate, 0) as win_rate, coalesce(profit_loss_ratio, 0) as profit_loss_ratio,
         early_entry_score, contrarian_score, information_ratio, cross_market_diversification,
         avg_holding_period, trading_frequency, capital_flow_centrality
  from behaviour b join information using (address) join activity using (address) join flow using (address)
  left join returns using (address)),
clipped as (select address, {", ".join(_clip(c) for c in _CLIPPED)}, {", ".join(_PLAIN)} from raw),
features as (
  select address, total_roi, max_drawdown, win_rate, profit_loss_ratio, early_entry_score, contrarian_score,
         coalesce(information_ratio, 0) as information_ratio, cross_market_diversification, avg_holding_period,
         trading_frequency, capital_flow_centrality,
         least(100.0, greatest(-100.0, total_roi / greatest(abs(max_drawdown), 1e-4))) as Risk_Adjusted_Return
  from clipped)"""

ALL_FEATURES = f"{BASE}, {RETURNS}, {BEHAVIOUR}, {INFORMATION}, {ACTIVITY}, {FEATURES}"

# Traders rated on resolved markets; the bet follows the price rule.
RATED = f"""rated as (
  select address, count(*) filter (result in ('YES', 'NO')) as n_resolved,
         count(*) filter (result in ('YES', 'NO') and bet = result) as n_correct
  from (select address, market_id, case when (side = 'BUY') = (price >= 0.5) then 'YES' else 'NO' end as bet
        from cleaned)
  left join (select market_id, {LABEL_RESULT} as result from res) using (market_id)
  group by address)"""


def labels(min_resolved: int = 3, threshold: float = 0.6) -> str:
    return f"""{RATED},
labels as (
  select address, n_resolved, n_correct,
         round_even(case when n_resolved > 0 then n_correct::double / n_resolved else 0.0 end, 4) as accuracy,
         case when n_resolved >= {min_resolved}
                then case when n_correct::double / n_resolved >= {threshold} then 1 else 0 end
              when n_resolved > 0 then -1 else 0 end as Trader_Success_Rate,
         case when n_resolved >= {min_resolved} then 'resolution'
              when n_resolved > 0 then 'resolution_insufficient' else 'no_resolved_data' end as label_source
  from rated)"""


INFORMED = f"{labels()}, informed as (select address from labels where Trader_Success_Rate = 1)"

COPIES = f"""experts as (
  select transaction_id, market_id, address as expert_address, timestamp as entry_time, price as expert_price,
         timestamp + interval 5 minute as fill_at, result
  from cleaned join (select market_id, {STRICT_RESULT} as result from res) using (market_id)
  where side = 'BUY' and result in ('YES', 'NO') and address in (select address from informed)),
fills as (
  select e.*, coalesce(t.price, e.expert_price) as exec_price
  from experts e asof left join cleaned t on e.market_id = t.market_id and e.fill_at >= t.timestamp),
copies as (
  select transaction_id, fill_at as timestamp, market_id, expert_address, exec_price, expert_price,
         case when expert_price >= 0.5 then exec_price - expert_price else expert_price - exec_price end as slippage,
         case when (case when expert_price >= 0.5 then 'YES' else 'NO' end) <> result then -100.0
              when exec_price > 0 then (1 - exec_price) * (100.0 / exec_price) end - 100.0 * 0.001 as net_profit,
         (case when expert_price >= 0.5 then 'YES' else 'NO' end) = result and exec_price = 0 as undefined_profit
  from fills)"""


def curve(order: str) -> str:
    return f"""summed as (
  select *, 10000 + sum(coalesce(net_profit, 0)) over (
    order by {order} rows between unbounded preceding and current row) as balance from copies),
curve as (
  select *, greatest(10000, max(balance) over (
    order by {order} rows between unbounded preceding and current row)) as peak from summed)"""


TIME_ORDER = "timestamp, transaction_id"
MARKET_ORDER = "market_id, timestamp, transaction_id"
ALL_COPIES = f"{BASE}, {INFORMED}, {COPIES}"

SPARSE = """sparse as (
  select 'o' || o_orderkey as transaction_id, o_custkey || '-' || o_orderpriority as address,
         'm' || (o_orderkey % 100) as market_id, case when o_orderstatus = 'F' then 'BUY' else 'SELL' end as side,
         o_totalprice as amount, (o_orderkey % 100) / 100.0::double as price, o_orderdate as timestamp from orders)"""

SCORES = """scores as (
  select 'd' || l.doc_id as address, quality::int as actual_label, (n_chars % 101) / 100.0::double as p,
         ((n_chars % 101) / 100.0::double >= 0.5)::int as predicted_label, toxic::int as other_label
  from labels l join documents d on l.doc_id = d.doc_id)"""

FEED = f"""feed as (
  select event_id as arrival,
         't' || case when event_id % 7 = 0 then event_id + 1 else event_id end as transaction_id,
         'w' || user_id as address, 'm' || json_extract_string(props, '$.k') as market_id,
         case when event_type = 'purchase' then 'BUY' else 'SELL' end as side,
         case when event_id % 2 = 0 then 'Yes' end as outcome, value as amount, {PRICE} as price,
         case when event_id % 13 <> 0 then epoch_us(date_trunc('second', ts)) end as timestamp_us
  from events where event_id % 11 <> 0)"""
