"""The same results as SQL on the sample tables, for engines other than Spark.

Common table expressions are named once and put in front of each statement.
"""

from __future__ import annotations

from tickloom.operators.windows import NEWEST_FEATURES
from tickloom.plans.queries import (
    AS_OF,
    BARS_FROM,
    BARS_TO,
    COLUMN_DECIMALS,
    DECIMALS,
    HISTORY_UNTIL,
    HOUR,
    LATE_DAY,
    LIVE_REACH,
    LONG_WINDOW,
    RECENT_SECONDS,
    TIE_SHIFT,
)
from tickloom.schemas import CLEAN_FIELDS, CLEAN_TOPIC, FEATURES, RAW_FIELDS, SIGNAL_TOPIC

_RAW = """
raw as (
  select event_type as ticker_symbol, event_id, ts as "timestamp",
    format('{:,.2f}', value * 10) as regular_market_price,
    sign || (k - 50) || '.25' as regular_market_change,
    '(' || sign || (k - 50) || '.5%)' as regular_market_change_percent,
    format('{:,.2f}', value * 10 + 1) as regular_market_previous_close,
    format('{:,.2f}', value * 10 + 2) as regular_market_open,
    case when event_id % 17 = 0 then '--' else format('{:,.2f}', value * 10 + 1) || ' x ' || (k * 100) end as bid,
    case when event_id % 13 = 0 then '--' else format('{:,.2f}', value * 10 + 2) || ' x ' || (k * 200) end as ask,
    format('{:,}', user_id * 100003 + k) as regular_market_volume,
    format('{:,}', user_id * 100003 + k) as average_volume,
    case when event_id % 19 = 0 then '--'
      else k || '.5' || substr('KMBT', cast(event_id % 5 + 1 as int), 1) end as market_cap,
    case when event_id % 7 = 0 then '--' else '1.' || k end as beta,
    case when event_id % 5 = 0 then '--' else k || '.75' end as pe_ratio,
    (k - 30) || '.5' as eps,
    case when event_id % 11 = 0 then '--' else format('{:,.2f}', value * 10 + 2) end as "1y_target_est"
  from (select *, case when k >= 50 then '+' else '' end as sign
        from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))
)"""

_CLEAN = (
    _RAW
    + """,
clean as (
  select ticker_symbol, event_id, "timestamp",
    try_cast(replace(regular_market_price, ',', '') as double) as regular_market_price,
    try_cast(regular_market_change as double) as regular_market_change,
    try_cast(regexp_replace(regular_market_change_percent, '[%()]', '', 'g') as double) as regular_market_change_percent,
    try_cast(replace(regular_market_previous_close, ',', '') as double) as regular_market_previous_close,
    try_cast(replace(regular_market_open, ',', '') as double) as regular_market_open,
    try_cast(bid_parts[1] as double) as bid_price, try_cast(bid_parts[2] as int) as bid_size,
    try_cast(ask_parts[1] as double) as ask_price, try_cast(ask_parts[2] as int) as ask_size,
    try_cast(replace(regular_market_volume, ',', '') as bigint) as regular_market_volume,
    try_cast(replace(average_volume, ',', '') as bigint) as average_volume,
    try_cast(regexp_replace(market_cap, '[,KMBT]', '', 'g') as double) as market_cap,
    case right(market_cap, 1) when 'K' then 1 when 'M' then 2 when 'B' then 3 when 'T' then 4 else 0 end
      as market_cap_type,
    try_cast(replace(beta, '--', '0') as double) as beta,
    try_cast(replace(pe_ratio, '--', '0') as double) as pe_ratio,
    try_cast(replace(eps, '--', '0') as double) as eps,
    try_cast(case when "1y_target_est" = '--' then '0' else replace("1y_target_est", ',', '') end as double)
      as "1y_target_est"
  from (select *,
          case when bid = '--' then ['0', '0'] else string_split(replace(bid, ',', ''), ' x ') end as bid_parts,
          case when ask = '--' then ['0', '0'] else string_split(replace(ask, ',', ''), ' x ') end as ask_parts
        from raw)
)"""
)

_BARS = """
bars as (
  select o_orderpriority as ticker_symbol, cast(o_orderdate as date) as date,
    100000000.0 + avg(o_totalprice) as close
  from orders group by 1, 2
)"""

_RETURNS = (
    _BARS
    + """,
returned as (
  select *, cast(sign(returns) as int) as direction from (
    select *, ln(close / lag(close) over (partition by ticker_symbol order by date)) as returns from bars)
  where returns is not null
)"""
)

_FEATURES = (
    _RETURNS
    + """,
features as (
  select * from (
    select *, lag(returns, 1) over w as lag_1, lag(returns, 2) over w as lag_2
    from returned window w as (partition by ticker_symbol order by date))
  where lag_2 is not null
),
moments as (
  select ticker_symbol, avg(returns) as y1, avg(direction) as y2, avg(lag_1) as m1, avg(lag_2) as m2,
    var_pop(lag_1) as v1, var_pop(lag_2) as v2, covar_pop(lag_1, lag_2) as c12,
    covar_pop(lag_1, returns) as c11, covar_pop(lag_2, returns) as c21,
    covar_pop(lag_1, direction) as d1, covar_pop(lag_2, direction) as d2
  from features group by 1
),
slopes as (
  select *, (c11 * v2 - c21 * c12) / (v1 * v2 - c12 * c12) as b1_1, (c21 * v1 - c11 * c12) / (v1 * v2 - c12 * c12) as b2_1,
    (d1 * v2 - d2 * c12) / (v1 * v2 - c12 * c12) as b1_2, (d2 * v1 - d1 * c12) / (v1 * v2 - c12 * c12) as b2_2
  from moments
),
coefficients as (
  select ticker_symbol, y1 - b1_1 * m1 - b2_1 * m2 as intercept_1, b1_1, b2_1,
    y2 - b1_2 * m1 - b2_2 * m2 as intercept_2, b1_2, b2_2
  from slopes
)"""
)

_BACKTEST = (
    _FEATURES
    + """,
held as (
  select f.*, case when intercept_1 + b1_1 * lag_1 + b2_1 * lag_2 > 0 then 1 else -1 end as pos_ols_1,
    case when intercept_2 + b1_2 * lag_1 + b2_2 * lag_2 > 0 then 1 else -1 end as pos_ols_2
  from features f join coefficients using (ticker_symbol)
),
earned as (
  select *, pos_ols_1 * returns as strat_ols_1, pos_ols_2 * returns as strat_ols_2 from held
),
tested as (
  select *, pos_ols_1 - lag(pos_ols_1) over w as positions_ols_1, pos_ols_2 - lag(pos_ols_2) over w as positions_ols_2,
    exp(sum(returns) over w) as cum_returns, exp(sum(strat_ols_1) over w) as cum_strat_ols_1,
    exp(sum(strat_ols_2) over w) as cum_strat_ols_2
  from earned window w as (partition by ticker_symbol order by date)
)"""
)


def _signals(until: str, where: str = "true", price: str = "value", hours: int = 6) -> str:
    """Signals of all windows that end by ``until``, from the events that meet a condition."""
    return f"""
spread as (
  select event_type as ticker_symbol, {price} as p, ts, event_id, date_trunc('second', ts) as s,
    unnest(generate_series(0, {hours - 1})) as k
  from events where {where}
),
stats as (
  select ticker_symbol, date_trunc('hour', s) - k * interval 1 hour + interval {hours} hour as "end",
    max_by(p, row(ts, event_id)) as regular_market_price, avg(p) as moving_avg_price,
    max(p) as max_price, min(p) as min_price, max(s) as "timestamp"
  from spread group by 1, 2
),
scored as (
  select ticker_symbol, "end" as "timestamp", regular_market_price, moving_avg_price,
    100 - 100 / (1 + (regular_market_price - min_price) / nullif(max_price - regular_market_price, 0)) as rsi,
    (regular_market_price - moving_avg_price) / nullif(moving_avg_price, 0) as distance
  from stats where "end" <= {until}
),
signals as (
  select *, case when rsi > 70 then -1 when rsi < 30 then 1 else 0 end as rsi_signal,
    case when distance > 0.0005 then -1 when distance < -0.0005 then 1 else 0 end as mac_signal
  from scored
)"""


_UNTIL_AS_OF = f"timestamp '{AS_OF}'"
_ALL_WINDOWS = "timestamp '2100-01-01'"
_JSON_TIME = """strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"""


def _names(names: tuple[str, ...]) -> str:
    return ", ".join(f'"{name}"' for name in names)


def _round(value: str, decimals: int = DECIMALS) -> str:
    return f"round({value} + {TIE_SHIFT:.0e}, {decimals})"


def _rounded(*names: str) -> str:
    decimals = [COLUMN_DECIMALS.get(name, DECIMALS) for name in names]
    return ", ".join(f"""{_round(f'"{name}"', at)} as "{name}\"""" for name, at in zip(names, decimals))


def _with(tables: str, select: str) -> str:
    return f"with {tables.strip()}\n{select.strip()}"


def _clean_part(*names: str) -> str:
    return _with(_CLEAN, f'select ticker_symbol, event_id, "timestamp", {_names(names)} from clean')


_SIGNAL_COLUMNS = (
    f'ticker_symbol, "timestamp", {_rounded("regular_market_price", "moving_avg_price", "rsi")}, rsi_signal, mac_signal'
)


def _merged(label: str, quote: str, signal: str) -> str:
    return _with(
        _CLEAN + "," + _signals(_ALL_WINDOWS),
        f"""
select '{quote}' as {label}, ticker_symbol, {_JSON_TIME} as "timestamp", {_round('regular_market_price')} as regular_market_price,
  cast(null as double) as moving_avg_price, cast(null as int) as rsi_signal, cast(null as int) as mac_signal from clean
union all
select '{signal}', ticker_symbol, {_JSON_TIME}, null, {_round('moving_avg_price')}, rsi_signal, mac_signal from signals""",
    )


def _labelled(function: str) -> str:
    return _with(
        _CLEAN,
        f"""
select * from (
  select ticker_symbol, "timestamp", event_id, regular_market_price,
    {function}(regular_market_price, 10) over (partition by ticker_symbol order by "timestamp", event_id) as label
  from clean) where label is not null""",
    )


def _filled() -> str:
    """The labelled quotes that the model is fitted on."""
    columns = ", ".join(f'coalesce(cast("{name}" as double), 0.0) as "{name}"' for name in (*FEATURES, "label"))
    return (
        _CLEAN
        + f""",
training as materialized (
  select {columns} from (
    select *, lag(regular_market_price, 10) over (partition by ticker_symbol order by "timestamp", event_id) as label
    from clean) where label is not null)"""
    )


def _moments() -> str:
    names = (*FEATURES, "label")
    pairs = [(one, other) for at, one in enumerate(names) for other in names[at:]]
    rows = (
        f"""select '{one}' as feature, '{other}' as other, {_round(f'avg("{one}") / stddev_pop("{one}")')} as scaled_mean,
  {_round(f'corr("{one}", "{other}")')} as correlation from training"""
        for one, other in pairs
    )
    return _with(_filled(), " union all\n".join(rows))


def _stats(hours: int) -> str:
    return _with(
        _signals(_ALL_WINDOWS, hours=hours),
        f"""select ticker_symbol, "end", {_rounded("regular_market_price", "moving_avg_price", "max_price", "min_price")},
  "timestamp" from stats""",
    )



_INTERPOLATED = _with(
    _signals(_ALL_WINDOWS)
    + """,
prices as (select event_type as ticker_symbol, ts, value from events),
counted as (select ticker_symbol, count(*) as n from prices group by 1),
matched as (
  select s.ticker_symbol, s."timestamp", s.moving_avg_price, n, epoch_us(s."timestamp") as x,
    epoch_us(b.ts) as x1, b.value as y1, epoch_us(a.ts) as x2, a.value as y2
  from signals s join counted using (ticker_symbol)
  asof left join prices b on s.ticker_symbol = b.ticker_symbol and s."timestamp" >= b.ts
  asof left join prices a on s.ticker_symbol = a.ticker_symbol and s."timestamp" <= a.ts
)""",
    f"""
select ticker_symbol, "timestamp", {_rounded("moving_avg_price", "signal_value")} from (
  select *, case when n < 2 then moving_avg_price when x2 = x then y2
    when x1 is null or x2 is null then moving_avg_price
    else y1 + (y2 - y1) * (cast(x - x1 as double) / (x2 - x1)) end as signal_value
  from matched)""",
)

_INTERPOLATED_LIVE = _with(
    _signals(_ALL_WINDOWS)
    + f""",
prices as (select event_type as ticker_symbol, ts, event_id, value, epoch_us(ts) as micros from events),
near as (
  select s.ticker_symbol, s."timestamp", max(s.moving_avg_price) as moving_avg_price, epoch_us(s."timestamp") as x, count(p.ts) as n,
    max(row(micros, event_id, value)) filter (p.ts <= s."timestamp") as before, min(row(micros, event_id, value)) filter (p.ts >= s."timestamp") as after
  from signals s left join prices p on p.ticker_symbol = s.ticker_symbol
    and p.ts between s."timestamp" - interval {LIVE_REACH} second and s."timestamp" + interval {LIVE_REACH} second
  group by all
)""",
    f"""
select ticker_symbol, "timestamp", {_rounded("moving_avg_price", "signal_value")} from (
  select *, case when n < 2 then moving_avg_price when after[1] = x then after[3]
    when before is null or after is null then moving_avg_price
    else before[3] + (after[3] - before[3]) * (cast(x - before[1] as double) / (after[1] - before[1])) end as signal_value
  from near)""",
)

_RETAINED = f"""
select ticker_symbol, "timestamp", event_id, regular_market_price from (
  select event_type as ticker_symbol, ts as "timestamp", event_id, value as regular_market_price,
    row_number() over (partition by event_type order by ts desc, event_id desc) as n,
    max(ts) over (partition by event_type) as newest
  from events)
where n <= 180 and "timestamp" >= newest - interval {RECENT_SECONDS} second"""



def _snapshot_of(name: str) -> str:
    if name in NEWEST_FEATURES:
        return f"""max_by("{name}", row("timestamp", event_id))"""
    return f"""avg("{name}")"""


_SNAPSHOT = _with(
    _CLEAN,
    f"""
select ticker_symbol, {", ".join(f'{_round(_snapshot_of(name))} as "{name}"' for name in FEATURES)}
from clean group by 1""",
)

_LATEST = _with(
    _CLEAN,
    f"""
select ticker_symbol, event_id, "timestamp", {_names(CLEAN_FIELDS)} from (
  select *, row_number() over (partition by ticker_symbol order by "timestamp" desc, event_id desc) as n from clean)
where n = 1""",
)

# Rounds of descent after which the signs of all coefficients stand; the equations for these signs do the rest.
SWEEPS = 6000


def _fits(training: str) -> str:
    """Tables that end with ``weights`` (fit, i, weight) and ``fitted`` (fit, feature, coefficient), an elastic net for
    each ``fit`` of the training rows (fit, features, label), by coordinate descent and Gaussian elimination."""
    size = len(FEATURES)
    at = range(1, size + 1)
    names = [*FEATURES, "label"]
    pairs = [(i, j) for i in range(1, size + 2) for j in range(i + 1, size + 2)]
    numbers = ", ".join(f"""avg("{name}") as m{i}, stddev_pop("{name}") as d{i}""" for i, name in enumerate(names, 1))
    related = ", ".join(
        f"""coalesce(nullif(corr("{names[i - 1]}", "{names[j - 1]}"), 'nan'::double), 0) as c{i}_{j}""" for i, j in pairs
    )

    def c(i: int, j: int) -> str:
        return f"c{min(i, j)}_{max(i, j)}"

    level = f"(select cd.*, {', '.join(f'c{i}_{j}' for i, j in pairs)}, edge, ridge from cd join moments using (fit) where sweep < {SWEEPS})"
    for j in at:
        others = "".join(f" - {c(k, j)} * {'v' if k < j else 'w'}{k}" for k in at if k != j)
        level = f"(select *, {c(j, size + 1)}{others} as g{j} from {level})"
        level = f"(select *, sign(g{j}) * greatest(abs(g{j}) - edge, 0) / (1 + ridge) as v{j} from {level})"
    matrix = ", ".join("[" + ", ".join("1.0" if i == j else c(i, j) for j in range(1, size + 2)) + "]" for i in at)
    entry = f"""case when signs[i] = 0 then case when i = j then 1.0 else 0.0 end
      when j = {size + 1} then matrix[i][j] - edge * signs[i]
      when signs[j] = 0 then 0.0 when i = j then 1 + ridge else matrix[i][j] end"""
    spread = "[" + ", ".join(f"d{i}" for i in at) + "]"
    mean = "[" + ", ".join(f"m{i}" for i in at) + "]"
    label = size + 1
    return f"""{training},
moments as materialized (
  select *, 0.8 * 0.1 / d{label} as edge, 0.2 * 0.1 / d{label} as ridge
  from (select fit, {numbers}, {related} from training group by fit)
),
cd as (
  select fit, 0 as sweep, {", ".join(f"cast(0 as double) as w{j}" for j in at)} from moments
  union all
  select fit, sweep + 1, {", ".join(f"v{j}" for j in at)} from {level}
),
signed as materialized (
  select fit, edge, ridge, [{matrix}] as matrix, [{", ".join(f"sign(w{j})" for j in at)}] as signs
  from cd join moments using (fit) where sweep = {SWEEPS}
),
equations as (
  select 0 as k, fit, i, j, cast({entry} as double) as v
  from signed, (select unnest(range(1, {size + 1})) as i), (select unnest(range(1, {size + 2})) as j)
  union all
  select k + 1, fit, i, j, case when i = k + 1 then vkj / vkk else v - vik * vkj / vkk end from (
    select *, max(case when i = k + 1 then v end) over (partition by fit, j) as vkj,
      max(case when j = k + 1 then v end) over (partition by fit, i) as vik,
      max(case when i = k + 1 and j = k + 1 then v end) over (partition by fit) as vkk
    from equations where k < {size})
),
weights as materialized (
  select fit, i, v * d{label} / {spread}[i] as weight, {mean}[i] as mean, m{label} as label_mean
  from equations join moments using (fit) where k = {size} and j = {size + 1}
),
fitted as (
  select fit, [{", ".join(f"'{name}'" for name in FEATURES)}][i] as feature, weight as coefficient from weights
  union all
  select fit, 'intercept', max(label_mean) - sum(weight * mean) from weights group by fit
)"""


def _training(labelled: str) -> str:
    """The training rows of ``labelled`` (fit, features, label) with missing features filled in."""
    columns = ", ".join(f'coalesce(cast("{name}" as double), 0.0) as "{name}"' for name in (*FEATURES, "label"))
    return f"training as materialized (select fit, {columns} from {labelled} where label is not null)"


_LAG_LABEL = 'lag(regular_market_price, 10) over (partition by {by}ticker_symbol order by "timestamp", event_id) as label'

# One fit over all quotes.
_WHOLE_FIT = _CLEAN + "," + _fits(_training(f"(select *, 0 as fit, {_LAG_LABEL.format(by='')} from clean)"))


def _predicted(by: str = "") -> str:
    """Scores of a snapshot per ticker (and ``by``, the fit) by the fitted weights."""
    features = ", ".join(f'{_snapshot_of(name)} as "{name}"' for name in FEATURES)
    total = " + ".join(f"""coalesce("{name}", 0) * w[{i}]""" for i, name in enumerate(FEATURES, 1))
    return f""",
model as (
  select fit, list(weight order by i) as w, max(label_mean) - sum(weight * mean) as intercept from weights group by fit
),
scored_fits as (
  select fit, ticker_symbol, price as regular_market_price, intercept + {total} as prediction
  from (select {by}, ticker_symbol, {features}, max_by(regular_market_price, row("timestamp", event_id)) as price from {"clean" if by == "0 as fit" else "batched"} group by all)
    join model using (fit)
),
signalled as (
  select *, prediction / nullif(regular_market_price, 0) as ratio from scored_fits
)"""


_OLS = 'case when ratio > 1.0005 then 1 when ratio < 0.9995 then -1 else 0 end as ols_signal'


def _batches(steps: int) -> str:
    """Quotes with the number of the micro-batch that each comes in."""
    cuts = " + ".join(
        f"""case when epoch_us("timestamp") >= low + (high + 1 - low) * {i} // {steps} then 1 else 0 end""" for i in range(1, steps)
    )
    return f"""batched as materialized (
  select clean.*, cast({cuts} as int) as fit
  from clean, (select epoch_us(min("timestamp")) as low, epoch_us(max("timestamp")) as high from clean)
)"""


def _recursive(tables: str, select: str) -> str:
    return f"with recursive {tables.strip()}\n{select.strip()}"


_EXTRACTED = _with(
    _RAW,
    f"""
select ticker_symbol, event_id, {_names(RAW_FIELDS[:3])},
  {", ".join(f'case when event_id % 5 <> 0 then "{name}" end as "{name}"' for name in RAW_FIELDS[3:])}
from raw""",
)

_TESTED = _with(
    _BACKTEST,
    f"""
select ticker_symbol, date, {_rounded("close", "returns")}, direction, {_rounded("lag_1", "lag_2")}, pos_ols_1, pos_ols_2,
  {_rounded("strat_ols_1", "strat_ols_2")}, positions_ols_1, positions_ols_2,
  {_rounded("cum_returns", "cum_strat_ols_1", "cum_strat_ols_2")} from tested""",
)

_MARKED = _with(
    _BACKTEST,
    " union all ".join(
        f"""
select ticker_symbol, date, {i} as strategy, case when positions_ols_{i} > 0 then 'buy' else 'sell' end as marker,
  {_round(f'cum_strat_ols_{i}')} as cum_return
from tested where positions_ols_{i} <> 0"""
        for i in (1, 2)
    ),
)

_ON_TIME = f"not (ts >= timestamp '{LATE_DAY[0]}' and ts < timestamp '{LATE_DAY[1]}')"


def _closed(where: str = "true") -> str:
    """Windows that a stream over the events has closed: the watermark is a second behind the newest quote."""
    newest = f"(select max(date_trunc('second', ts)) - interval 1 second from events where {where})"
    price = "cast(format('{:.2f}', value * 10) as double)"
    return _with(_signals(newest, where, price), f"select {_SIGNAL_COLUMNS} from signals")


_CLEAN_ALL = _clean_part(*CLEAN_FIELDS)

ORACLES: dict[str, str] = {
    "decode_messages": _with(_RAW, f'select "timestamp", event_id, ticker_symbol, {_names(RAW_FIELDS)} from raw'),
    "extract_quote_fields": _EXTRACTED,
    "daily_close": _with(
        _BARS,
        f"""select ticker_symbol, date, {_rounded('close')} from bars
where date >= date '{BARS_FROM}' and date < date '{BARS_TO}'""",
    ),
    "clean_prices": _clean_part(*CLEAN_FIELDS[:5]),
    "clean_bid_ask": _clean_part("bid_price", "bid_size", "ask_price", "ask_size"),
    "clean_volumes": _clean_part("regular_market_volume", "average_volume"),
    "clean_market_cap": _clean_part("market_cap", "market_cap_type"),
    "clean_ratios": _clean_part("beta", "pe_ratio", "eps", "1y_target_est"),
    "clean_quotes": _CLEAN_ALL,
    "encode_quotes": _with(
        _CLEAN, f'select ticker_symbol, {_names(CLEAN_FIELDS)}, {_JSON_TIME} as "timestamp" from clean'
    ),
    "encode_signals": _with(
        _signals(_ALL_WINDOWS),
        f"""select ticker_symbol, {_JSON_TIME} as "timestamp", {_rounded("moving_avg_price", "rsi")},
  mac_signal, rsi_signal from signals""",
    ),
    "multiplex_messages": _merged("topic", CLEAN_TOPIC, SIGNAL_TOPIC),
    "dispatch_messages": _merged("kind", "quote", "signal"),
    "sliding_stats": _stats(6),
    "sliding_stats_panes": _stats(6),
    "sliding_stats_long": _stats(LONG_WINDOW // HOUR),
    "mac_signal": _with(
        _signals(_ALL_WINDOWS),
        f"""select ticker_symbol, "timestamp", {_rounded("regular_market_price", "moving_avg_price")}, mac_signal
from signals""",
    ),
    "rsi": _with(_signals(_ALL_WINDOWS), f'select ticker_symbol, "timestamp", {_rounded("rsi")} from signals'),
    "rsi_signal": _with(
        _signals(_ALL_WINDOWS), f'select ticker_symbol, "timestamp", {_rounded("rsi")}, rsi_signal from signals'
    ),
    "gen_signal": _with(_signals(_UNTIL_AS_OF), f"select {_SIGNAL_COLUMNS} from signals"),
    "consensus_signal": _with(
        _signals(_ALL_WINDOWS),
        """
select ticker_symbol, "timestamp", rsi_signal, mac_signal,
  case when rsi_signal = 1 and mac_signal = 1 then 'buy' when rsi_signal = -1 and mac_signal = -1 then 'sell'
    else 'none' end as consensus from signals""",
    ),
    "interpolate_signal": _INTERPOLATED,
    "interpolate_signal_segmented": _INTERPOLATED,
    "retain_recent": _RETAINED.strip(),
    "retain_recent_signals": _with(
        _signals(_ALL_WINDOWS),
        f"""
select ticker_symbol, "timestamp", {_rounded("regular_market_price", "moving_avg_price")} from (
  select *, row_number() over (partition by ticker_symbol order by "timestamp" desc) as n,
    max("timestamp") over (partition by ticker_symbol) as newest
  from signals)
where n <= 180 and "timestamp" >= newest - interval {RECENT_SECONDS} second""",
    ),
    "extract_from_pages": "select 'A' as ticker_symbol, page_id, "
    + ", ".join(f'cast(null as varchar) as "{name}"' for name in RAW_FIELDS)
    + " from pages where not contains(html, '<fin-streamer')",
    "latest_quote": _LATEST,
    "feature_snapshot": _SNAPSHOT,
    "training_set": _labelled("lag"),
    "training_set_lead": _labelled("lead"),
    "training_set_segmented": _labelled("lag"),
    "training_set_lead_segmented": _labelled("lead"),
    "training_moments": _moments(),
    "train_elastic_net": _recursive(_WHOLE_FIT, f"select feature, {_round('coefficient')} as coefficient from fitted"),
    "score_elastic_net": _recursive(
        _WHOLE_FIT + _predicted("0 as fit"), f"""select ticker_symbol, {_rounded("regular_market_price", "prediction", "ratio")} from signalled"""
    ),
    "ols_signal": _recursive(
        _WHOLE_FIT + _predicted("0 as fit"),
        f"""select ticker_symbol, {_UNTIL_AS_OF} as "timestamp", {_rounded("regular_market_price", "prediction", "ratio")}, {_OLS}
from signalled""",
    ),
    "encode_ols": _recursive(
        _WHOLE_FIT + _predicted("0 as fit") + f", stamped as (select *, {_UNTIL_AS_OF} as \"timestamp\" from signalled)",
        f"""select ticker_symbol, {_JSON_TIME} as "timestamp", {_rounded("regular_market_price", "prediction", "ratio")}, {_OLS}
from stamped""",
    ),
    "stream_ols_signal": _recursive(
        _CLEAN + "," + _batches(2) + "," + _fits(_training(f"(select *, {_LAG_LABEL.format(by='fit, ')} from batched)")) + _predicted("fit"),
        f"""select fit as batch_id, ticker_symbol, {_rounded("regular_market_price", "prediction", "ratio")}, {_OLS} from signalled""",
    ),
    "stream_multiplex": _merged("kind", "quote", "signal"),
    "stream_latest_quote": _LATEST,
    "stream_retain_recent": _with(
        _CLEAN,
        f"""
select ticker_symbol, "timestamp", event_id, regular_market_price from (
  select *, row_number() over (partition by ticker_symbol order by "timestamp" desc, event_id desc) as n,
    max("timestamp") over (partition by ticker_symbol) as newest
  from clean)
where n <= 180 and "timestamp" >= newest - interval {RECENT_SECONDS} second""",
    ),
    "stream_interpolate": _INTERPOLATED_LIVE,
    "stream_open_windows": """
select ticker_symbol, count(*) as open_windows, min("end") as first_end from (
  select distinct event_type as ticker_symbol, date_trunc('hour', ts) - k * interval 1 hour + interval 6 hour as "end"
  from events, (select unnest(generate_series(0, 5)) as k))
where "end" > (select max(date_trunc('second', ts)) - interval 1 second from events) group by 1""".strip(),
    "stream_late_rows": f"""
select 'late-rows' as query_name, count(*) as late_rows from (
  select distinct event_type, date_trunc('hour', ts) - k * interval 1 hour from events, (select unnest(generate_series(0, 5)) as k)
  where not ({_ON_TIME}))""".strip(),
    "stream_history": _CLEAN_ALL + f"""\nwhere "timestamp" < timestamp '{HISTORY_UNTIL}' + interval 1 day""",
    "stream_once": _CLEAN_ALL,
    "stream_quarantine": _with(
        _CLEAN,
        f"""
select event_id, problem, case when problem is null then {_round('regular_market_price')} end as regular_market_price from (
  select *, case when event_id % 23 = 0 then 'no value' when event_id % 11 = 0 then 'not JSON' when event_id % 7 = 0 then 'not an object'
    when event_id % 13 = 0 then 'no ticker' end as problem from clean)""",
    ),
    "stream_training_set": _labelled("lag"),
    "stream_training_set_lead": _labelled("lead"),
    "stream_elastic_net": _recursive(
        _CLEAN
        + ","
        + _batches(2)
        + """,
labelled as materialized (select *, """
        + _LAG_LABEL.format(by="")
        + """ from batched)"""
        + ","
        + _fits(_training("(select * from labelled where fit = 0 union all select * replace (1 as fit) from labelled)")),
        f"select fit as batch_id, feature, {_round('coefficient')} as coefficient from fitted",
    ),
    "elastic_net_optimality": _with(
        _filled(),
        "select unnest([" + ", ".join(f"'{name}'" for name in FEATURES) + "]) as feature, count(*) > 0 as optimal from training",
    ),
    "log_returns": _with(_RETURNS, f"select ticker_symbol, date, {_rounded('close', 'returns')} from returned"),
    "direction": _with(_RETURNS, f"select ticker_symbol, date, {_rounded('returns')}, direction from returned"),
    "lag_features": _with(
        _FEATURES, f"select ticker_symbol, date, {_rounded('returns', 'lag_1', 'lag_2')} from features"
    ),
    "grouped_ols": _with(
        _FEATURES,
        f"""select ticker_symbol, {_rounded('intercept_1', 'b1_1', 'b2_1', 'intercept_2', 'b1_2', 'b2_2')}
from coefficients""",
    ),
    "positions": _with(_BACKTEST, "select ticker_symbol, date, pos_ols_1, pos_ols_2 from tested"),
    "strategy_returns": _with(
        _BACKTEST, f"select ticker_symbol, date, {_rounded('strat_ols_1', 'strat_ols_2')} from tested"
    ),
    "position_changes": _with(_BACKTEST, "select ticker_symbol, date, positions_ols_1, positions_ols_2 from tested"),
    "cumulative_returns": _with(
        _BACKTEST,
        f"select ticker_symbol, date, {_rounded('cum_returns', 'cum_strat_ols_1', 'cum_strat_ols_2')} from tested",
    ),
    "trade_markers": _MARKED,
    "backtest": _TESTED,
    "backtest_segmented": _TESTED,
    "backtest_stored": _TESTED,
    "stream_clean_quotes": _CLEAN_ALL,
    "stream_restart": _CLEAN_ALL,
    "stream_gen_signal": _closed(),
    "stream_gen_signal_panes": _closed(),
    "stream_late_data": _closed(_ON_TIME),
    "stream_fanout": _with(
        _CLEAN,
        f"""
select sink, ticker_symbol, count(*) as n, {_round("sum(regular_market_price)")} as price_sum,
  cast(sum(average_volume) as bigint) as volume_sum
from clean, (values ('topic'), ('collection')) as sinks(sink) group by 1, 2""",
    ),
}
