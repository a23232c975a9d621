"""The registered queries in plain SQL, written apart from the Spark plans."""

from __future__ import annotations

from ..config import ATTRIBUTES, ModelConfig
from .inputs import RAW, REGULAR, REGULAR_START

#: Arrival numbers: an event is late by 400 places for every unit of its number modulo five.
ARRIVAL = "event_id + 400 * (event_id % 5)"
RAW_POINTS = """
raw as (select cast(user_id as integer) id, epoch_us(ts)//1000 "timestamp",
  -5 + value/100 longitude, 36 + cast(regexp_extract(props,'([0-9]+)',1) as double)/100 latitude,
  value/10 speed, cast(regexp_extract(props,'([0-9]+)',1) as double)*3.6 heading, event_id seq from events)"""

REGULAR_POINTS = (
    RAW_POINTS
    + f""",
reg as (select id, cast({REGULAR_START} + {REGULAR.sampling}
    * (row_number() over (partition by id order by "timestamp", seq) - 1) as bigint) "timestamp",
  longitude, latitude, speed, heading, seq from raw)"""
)


def points_sql(source: str) -> str:
    return RAW_POINTS if source == "raw" else REGULAR_POINTS


def order_sql(cfg: ModelConfig) -> str:
    return "seq" if cfg.order == "arrival" else '"timestamp", seq'


def events_sql(source: str, cfg: ModelConfig) -> str:
    """CTEs up to ``ev``: every point with segment, visible history (``lo`` to ``hi``) and step counter."""
    h, s, o = cfg.window, cfg.sampling, order_sql(cfg)
    along = f"(partition by id, segment order by {o})"
    seen = f"(partition by id, segment order by {o} rows between {h} preceding and current row)"
    gaps = f"(partition by id, segment order by {o} rows between {h - 1} preceding and current row)"
    arrived = ""
    if cfg.order == "arrival":
        arrived = f""",
arrived as (select * replace ({ARRIVAL.replace("event_id", "seq")} as seq) from {source})"""
        source = "arrived"
    return f"""{points_sql("raw" if source == "arrived" else source)}{arrived},
fr as (select *, coalesce(cast("timestamp" - lag("timestamp") over (partition by id order by {o})
    > {cfg.gap_threshold} as integer), 0) fresh from {source}),
sg as (select *, cast(sum(fresh) over (partition by id order by {o}) as bigint) segment from fr),
dt as (select *, row_number() over {along} pos, "timestamp" - lag("timestamp") over {along} dt from sg),
vis as (select *, least({h + 1}, pos) n_visible, first_value("timestamp") over {seen} first_ts,
    min("timestamp") over {seen} lo, max("timestamp") over {seen} hi,
    coalesce(bool_or(dt <> {s}) over {gaps}, false) irregular,
    len(list_distinct(list("timestamp") over {seen})) = least({h + 1}, pos) apart from dt),
zl as (select *, floor(("timestamp" - first_ts)/{s}::double) + 1 > {h} span_ok from vis),
zz as (select *, cast(case when not irregular then n_visible when span_ok and n_visible >= 3 and apart
    then floor((hi - lo)/{s}::double) + 1 else 0 end as bigint) z_len from zl),
ev as (select *, pos + cast(sum(case when irregular then z_len else 0 end) over {along} as bigint) i from zz)"""


def _unpivot(source: str, columns: dict[str, str], keep: str) -> str:
    return " union all ".join(
        f"select {keep}, '{a}' attr, {expr} val, {a} obs from {source}" for a, expr in columns.items()
    )


def batch_events_sql(cfg: ModelConfig, batch: int) -> str:
    """CTEs from ``ev`` to ``be``: the last point of every batch sees all points of the batch and the last ones before it.

    A resampled history sets the step counter to its length; any other batch raises it by one.
    """
    h, s = cfg.window, cfg.sampling
    along = "(partition by id order by pos)"
    return f""",
off as (select *, count(*) over (partition by id) n, coalesce(sum(cast(dt <> {s} as integer)) over {along}, 0) n_off,
    (pos + {batch - 1}) // {batch} batch, greatest(1, ((pos - 1) // {batch}) * {batch} + 1 - {h}) first_pos from ev),
seen as (select a.* exclude (n_visible, first_ts, lo, hi, irregular, span_ok, apart, z_len, i), a.pos - a.first_pos + 1 n_visible,
    b."timestamp" lo, a.n_off <> b.n_off irregular,
    floor((a."timestamp" - b."timestamp")/{s}::double) + 1 steps,
    (select count(distinct c."timestamp") from off c where c.id = a.id and c.pos between a.first_pos and a.pos) apart
  from off a join off b on a.id = b.id and b.pos = a.first_pos where a.pos % {batch} = 0 or a.pos = a.n),
zb as (select *, cast(case when not irregular then n_visible when steps > {h} and n_visible >= 3 and apart = n_visible
    then steps else 0 end as bigint) z_len from seen),
be as (select *, cast(case when irregular and z_len > 0 then z_len else batch
    + coalesce(last_value(case when irregular and z_len > 0 then z_len - batch end ignore nulls)
      over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0) end as bigint) i from zb)"""


def windows_sql(source: str, cfg: ModelConfig, batch: int = 0) -> str:
    """CTEs up to ``win``: per trainable event and attribute the series v1..vh, levels l1..lp and the observed value.

    With ``batch``, the points of a (regular) track come in batches of so many, and each batch is one event: its last point.
    """
    h, p, s = cfg.window, cfg.train, cfg.sampling
    if source == "reg":
        step = 'over (partition by id, segment order by "timestamp", seq)'
        if cfg.diff:
            series = {
                a: f"case when pos > 1 then {a} - lag({a}) {step} else {'0.0' if k < 2 else a} end"
                for k, a in enumerate(ATTRIBUTES)
            }
        else:
            series = {a: a for a in ATTRIBUTES}
        along = 'over (partition by id, segment, attr order by "timestamp", seq)'
        v = ", ".join(f"lag(val, {h - k}) {along} v{k}" for k in range(1, h + 1))
        lv = ", ".join(f"lag(obs, {p - k}) {along} l{k}" for k in range(1, p + 1))
        t, i, events = f"pos - {h - 1}", "i", f"z_len >= {h}"
        if batch:
            t = i = f"(pos + {batch - 1}) // {batch}"
            events = f"pos >= {h} and (pos % {batch} = 0 or pos = n)"
        return f"""{events_sql(source, cfg)},
ser as ({_unpivot("ev", series, 'id, segment, "timestamp", seq, pos, i, z_len')}),
lagged as (select *, {v}, {lv}, count(*) over (partition by id, segment, attr) n from ser),
win as (select id, segment, {t} t, "timestamp" origin, "timestamp" base_ts, {i} i, attr, obs,
    {", ".join(f"v{k}" for k in range(1, h + 1))}, {", ".join(f"l{k}" for k in range(1, p + 1))}
  from lagged where {events})"""
    key = "id, segment, pos"
    samples = range(h + 1)

    def zero_or(name: str, k: int) -> str:
        return f"max(case when k = {k} then {name} end)"

    def v_of(axis: str, k: int) -> str:
        return f"{axis}{k} - {axis}{k - 1}" if cfg.diff else f"{axis}{k}"

    def rows(attr: str) -> str:
        axis = {"longitude": "o", "latitude": "a"}.get(attr)
        v = [f"{v_of(axis, k)} v{k}" if axis else f"0.0 v{k}" for k in range(1, h + 1)]
        lv = [f"{axis}{h - p + k} l{k}" if axis else f"0.0 l{k}" for k in range(1, p + 1)]
        return (
            f"select id, segment, row_number() over (partition by id, segment order by pos) t, origin, base_ts, i, "
            f"'{attr}' attr, {attr} obs, {', '.join(v + lv)} from wide"
        )

    wide = ", ".join(f"{zero_or('lon', k)} o{k}, {zero_or('lat', k)} a{k}" for k in samples)
    ev = "be" if batch else "ev"
    return f"""{events_sql(source, cfg)}{batch_events_sql(cfg, batch) if batch else ""},
tr as (select * from {ev} where z_len >= {h} and irregular),
kn as (select a.id, a.segment, a.pos, row_number() over (partition by a.id, a.segment, a.pos order by b."timestamp") k,
    a.n_visible n, cast(b."timestamp" - a.lo as double) x, b.longitude lon, b.latitude lat
  from tr a join ev b on a.id = b.id and a.segment = b.segment and b.pos between a.pos - a.n_visible + 1 and a.pos),
{spline_sql("kn", key)},
grid as (select tr.id, tr.segment, tr.pos, g.k, cast((tr.z_len - 1 - {h} + g.k) * {s} as double) tau
  from tr, (select unnest(range(0, {h + 1})) k) g),
smp as (select grid.id, grid.segment, grid.pos, grid.k,
    case when grid.k = {h} then e.lon else pc.lon + (tau - pc.x) * (pc.lon_b + (tau - pc.x) * (pc.lon_c + (tau - pc.x) * pc.lon_d)) end lon,
    case when grid.k = {h} then e.lat else pc.lat + (tau - pc.x) * (pc.lat_b + (tau - pc.x) * (pc.lat_c + (tau - pc.x) * pc.lat_d)) end lat
  from grid join pc on pc.id = grid.id and pc.segment = grid.segment and pc.pos = grid.pos
    and pc.x <= tau and (tau < pc.x_next or pc.k = pc.n - 1)
  join kn e on e.id = grid.id and e.segment = grid.segment and e.pos = grid.pos and e.k = e.n),
wide as (select smp.id, smp.segment, smp.pos, any_value(tr."timestamp") origin,
    any_value(tr.lo + (tr.z_len - 1) * {s}) base_ts, any_value(tr.i) i, any_value(tr.longitude) longitude,
    any_value(tr.latitude) latitude, any_value(tr.speed) speed, any_value(tr.heading) heading, {wide}
  from smp join tr using (id, segment, pos) group by smp.id, smp.segment, smp.pos),
win as ({" union all ".join(rows(a) for a in ATTRIBUTES)})"""


def spline_sql(knots: str, key: str) -> str:
    """CTEs from knots (key, k of n, x, lon, lat) to ``pc``: cubic pieces; a forward and a backward recursion."""
    same = " and ".join(f"f.{c.strip()} = q.{c.strip()}" for c in key.split(","))
    over = f"over (partition by {key} order by k)"
    fk = ", ".join(f"q.{c.strip()}" for c in key.split(","))
    load = {
        a: f"3.0 * ((q.{a}_next - q.{a}) / (q.x_next - q.x) - (q.{a} - q.{a}_prev) / (q.x - q.x_prev))"
        for a in ("lon", "lat")
    }
    pivot = "(2.0 * (q.x_next - q.x_prev) - (q.x - q.x_prev) * f.u)"
    return f"""
q as (select *, lag(x) {over} x_prev, lead(x) {over} x_next, lag(lon) {over} lon_prev, lead(lon) {over} lon_next,
    lag(lat) {over} lat_prev, lead(lat) {over} lat_next from {knots}),
fw as (select {key}, k, 0.0::double u, 0.0::double r_lon, 0.0::double r_lat from q where k = 1
  union all select {fk}, q.k, (q.x_next - q.x) / {pivot},
    ({load["lon"]} - (q.x - q.x_prev) * f.r_lon) / {pivot}, ({load["lat"]} - (q.x - q.x_prev) * f.r_lat) / {pivot}
  from fw f join q on {same} and q.k = f.k + 1 where q.k < q.n),
bw as (select {key}, k, 0.0::double c_lon, 0.0::double c_lat from q where k = n
  union all select {fk}, q.k, q.r_lon - q.u * f.c_lon, q.r_lat - q.u * f.c_lat
  from bw f join fw q on {same} and q.k = f.k - 1),
pc as (select q.*, f.c_lon lon_c, f.c_lat lat_c,
    (lon_next - lon) / (x_next - x) - (x_next - x) * (g.c_lon + 2.0 * f.c_lon) / 3.0 lon_b,
    (lat_next - lat) / (x_next - x) - (x_next - x) * (g.c_lat + 2.0 * f.c_lat) / 3.0 lat_b,
    (g.c_lon - f.c_lon) / (3.0 * (x_next - x)) lon_d, (g.c_lat - f.c_lat) / (3.0 * (x_next - x)) lat_d
  from q join bw f on {same} and f.k = q.k join bw g on {same.replace("f.", "g.")} and g.k = q.k + 1)"""


def _dot(w: str, x: str, p: int) -> str:
    return " + ".join(f"{w}{j}*{x}{j}" for j in range(1, p + 1))


def weights_sql(source: str, cfg: ModelConfig, batch: int = 0) -> str:
    """CTEs up to ``wts``: per trainable event and attribute the weights (and matrix) and the mean residual."""
    h, p, lr = cfg.window, cfg.train, f"{cfg.lrate!r}::double"
    ones = range(1, p + 1)
    per = h - p
    pairs = " union all ".join(
        f"select id, segment, attr, i, t, (t - 1) * {per} + {k - p} q, v{k + 1} y, "
        + ", ".join(f"v{k + 1 - j} x{j}" for j in ones)
        + " from win"
        for k in range(p, h)
    )
    ws = ", ".join(f"w{j}" for j in ones)
    start = ["2.0::double w1", "-1.0::double w2"] + [f"0.0::double w{j}" for j in range(3, p + 1)]
    if not cfg.newton:
        body = f"""
rec as (select distinct id, segment, attr, cast(-1 as bigint) q, {", ".join(start)}, 0.0::double pred, 0.0::double y from pairs
  union all select id, segment, attr, q, {", ".join(f"w{j} - (x{j}*2*(pred - y)/sqrt(i - {p}))*{lr} w{j}" for j in ones)}, pred, y
  from (select pairs.id, pairs.segment, pairs.attr, pairs.q, pairs.i, {ws}, {", ".join(f"x{j}" for j in ones)},
      {_dot("w", "x", p)} pred, pairs.y y
    from rec join pairs on rec.id = pairs.id and rec.segment = pairs.segment and rec.attr = pairs.attr and pairs.q = rec.q + 1))"""
        matrix = ""
    else:
        cells = [(r, c) for r in ones for c in ones]
        a0 = ", ".join(f"{(cfg.epsilon if r == c else 0.0)!r}::double a{r}{c}" for r, c in cells)
        names = ", ".join(f"a{r}{c}" for r, c in cells)
        col = ", ".join(" + ".join(f"a{r}{k}*g{k}" for k in ones) + f" u{r}" for r in ones)
        row = ", ".join(" + ".join(f"g{k}*a{k}{c}" for k in ones) + f" s{c}" for c in ones)
        new = ", ".join(
            f"a{r}{c} - (" + " + ".join(f"(u{r}*g{k})*a{k}{c}" for k in ones) + f")/(({_dot('s', 'g', p)}) + 1) a{r}{c}"
            for r, c in cells
        )
        move = ", ".join(
            f"w{j} - (" + " + ".join(f"g{k}*a{k}{j}" for k in ones) + f")*{lr} w{j}" for j in ones
        )
        gs = ", ".join(f"g{j}" for j in ones)
        k0 = "id, segment, attr, q"
        body = f"""
rec as (select distinct id, segment, attr, cast(-1 as bigint) q, {", ".join(start)}, 0.0::double pred, 0.0::double y, {a0} from pairs
  union all select {k0}, {move}, pred, y, {names} from (
   select {k0}, {ws}, pred, y, {gs}, {new} from (
    select {k0}, {ws}, pred, y, {gs}, {names}, {col}, {row} from (
     select {k0}, {ws}, pred, y, {names}, {", ".join(f"2*x{j}*(pred - y) g{j}" for j in ones)} from (
      select pairs.id, pairs.segment, pairs.attr, pairs.q, {ws}, {names}, {", ".join(f"x{j}" for j in ones)},
        {_dot("w", "x", p)} pred, pairs.y y
      from rec join pairs on rec.id = pairs.id and rec.segment = pairs.segment and rec.attr = pairs.attr
        and pairs.q = rec.q + 1)))))"""
        matrix = ", " + ", ".join(f"max(a{r}{c}) filter (where q % {per} = {per - 1}) a{r}{c}" for r, c in cells)
    last = ", ".join(f"max(w{j}) filter (where q % {per} = {per - 1}) w{j}" for j in ones)
    return f"""{windows_sql(source, cfg, batch)},
pairs as ({pairs}),{body},
wts as (select id, segment, attr, q // {per} + 1 t, {last},
    max(pred) filter (where q % {per} = {per - 1}) pred, max(y) filter (where q % {per} = {per - 1}) y,
    sum(pred - y) / {per} mean{matrix} from rec where q >= 0 group by id, segment, attr, q // {per} + 1)"""


def forecast_cte(source: str, cfg: ModelConfig, batch: int = 0) -> str:
    """CTEs up to ``fc``: the forecast rows."""
    h, p, big = cfg.window, cfg.train, cfg.horizon
    ones = range(1, p + 1)
    buffer = "l" if cfg.from_observed else "v"
    size = p if cfg.from_observed else h
    recent = ", ".join(f"win.{buffer}{size + 1 - j} b{j}" for j in ones)
    ws = ", ".join(f"w{j}" for j in ones)
    bs = ", ".join(f"b{j}" for j in ones)
    ahead = f"({_dot('w', 'b', p)})"
    shifted = bs if cfg.from_observed else ", ".join(["f"] + [f"b{j}" for j in range(1, p)])
    value = f"{ahead} - abs(mean)" if cfg.corrected else ahead
    if cfg.diff and cfg.corrected:
        level = "val + f"
    elif cfg.diff and not cfg.from_observed:
        level = "case when attr in ('longitude', 'latitude') then val + f else f end"
    else:
        level = "f"
    cols = ", ".join(f"max(val) filter (where attr = '{a}') {a}" for a in ATTRIBUTES)
    first = 0 if cfg.from_observed else 1
    label = "step" if cfg.from_observed else "step - 1"
    if cfg.variant == "arma_gd" and not cfg.from_observed:
        first = 2
    return f"""{weights_sql(source, cfg, batch)},
fs as (select win.id, win.segment, win.t, win.attr, win.origin, win.base_ts, 0 step, obs val, {ws}, {recent}, mean
    from win join wts on win.id = wts.id and win.segment = wts.segment and win.t = wts.t and win.attr = wts.attr
  union all select id, segment, t, attr, origin, base_ts, step + 1, {level}, {ws}, {shifted}, mean
    from (select *, {value} f from fs where step < {big})),
wd as (select id, segment, t, step, any_value(origin) origin, any_value(base_ts) base_ts, {cols}
  from fs group by id, segment, t, step),
fc as (select id, case when step = 0 then origin else base_ts + step * {cfg.sampling} end "timestamp",
    longitude, latitude, speed, heading,
    step > 0 and (speed > {cfg.speed_threshold} or isnan(speed) or isinf(speed)) error,
    cast({label} as integer) horizon, cast(step as integer) step, origin origin_timestamp, segment
  from wd where step >= {first})"""


FORECAST_OUT = (
    'id, "timestamp", '
    + ", ".join(f"(round({a}, 6) + 0.0) {a}" for a in ATTRIBUTES)
    + ", error, horizon, step, origin_timestamp, segment"
)


def forecast_sql(source: str, cfg: ModelConfig) -> str:
    return f"with recursive {forecast_cte(source, cfg)} select {FORECAST_OUT} from fc"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    hav = (
        f"(sin(radians({lat2} - {lat1})/2)*sin(radians({lat2} - {lat1})/2) + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*sin(radians({lon2} - {lon1})/2)*sin(radians({lon2} - {lon1})/2))"
    )
    return f"2*6371000*atan2(sqrt({hav}), sqrt(1 - {hav}))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dl = f"(radians({lon2}) - radians({lon1}))"
    y = f"sin({dl})*cos(radians({lat2}))"
    x = f"cos(radians({lat1}))*sin(radians({lat2})) - sin(radians({lat1}))*cos(radians({lat2}))*cos({dl})"
    return f"degrees((atan2({y}, {x}) + 2*pi()) % (2*pi()))"


LEGS = f"""{RAW_POINTS},
pr as (select *, lag("timestamp") over w t0, lag(longitude) over w lon0, lag(latitude) over w lat0 from raw
  window w as (partition by id order by "timestamp", seq)),
legs as (select id, "timestamp", "timestamp" - t0 dt_ms, {haversine("lat0", "lon0", "latitude", "longitude")} distance_m,
    sqrt((lat0 - latitude)*(lat0 - latitude) + (lon0 - longitude)*(lon0 - longitude)) distance_units,
    {bearing("lat0", "lon0", "latitude", "longitude")} bearing_deg from pr where t0 is not null)"""


def derived_sql(cfg: ModelConfig, batch: int = 0, source: str = "reg") -> str:
    """Forecasts with speed and heading from consecutive forecast positions."""
    along = "over (partition by id, segment, origin_timestamp order by step)"
    lat0, lon0, t0 = (f"lag({c}) {along}" for c in ("latitude", "longitude", '"timestamp"'))
    return f"""with recursive {forecast_cte(source, cfg, batch)},
pv as (select *, {lat0} lat0, {lon0} lon0, {t0} t0 from fc),
mv as (select * exclude (speed, heading, error), case when step = 0 then speed else 3600000.0::double
      * {haversine("lat0", "lon0", "latitude", "longitude")} / (1852.0::double * ("timestamp" - t0)) end speed,
    case when step = 0 then heading else {bearing("lat0", "lon0", "latitude", "longitude")} end heading from pv),
fl as (select *, step > 0 and speed > {cfg.speed_threshold} error from mv)
select {FORECAST_OUT} from fl"""


def _actuals_join(score: str = "") -> str:
    return f"""
ac as (select id, "timestamp", longitude, latitude from reg),
sc as (select {score} fc.id, fc."timestamp" prediction_timestamp, horizon,
    {haversine("fc.latitude", "fc.longitude", "ac.latitude", "ac.longitude")} dist_lon_lat
  from fc join ac on fc.id = ac.id and fc."timestamp" = ac."timestamp" where not error)"""


def label(cfg: ModelConfig, rate: str) -> str:
    """Run label with the rate as text (1.0E-6 is stored without its point)."""
    stem = cfg.path.replace(".csv", "")
    return (
        f"{cfg.variant}_historical_positions{cfg.window}_predicted_locations{cfg.horizon}_sampling_{cfg.sampling}"
        f"_lrate_{rate}_train_{cfg.train}_{stem}"
    )


def sql() -> dict[str, str]:
    from ..operators.evaluate import EVALUATED_HORIZONS
    from .queries import ARRIVED, DERIVED, MICRO_BATCH_POINTS, MICRO_BATCHES, PUBLISHED, PUBLISHED_GRID, RATE_TEXT, SCORED, SWEEP_CONFIGS, forecast_config

    out: dict[str, str] = {}
    text = "concat_ws(',', user_id, epoch_us(ts)//1000, value, value + 1, value * 2, event_id % 360)"
    parts = f"(select string_split({text}, ',') f from events)"
    first4 = (
        'cast(f[1] as integer) id, cast(f[2] as bigint) "timestamp", cast(f[3] as double) longitude, '
        "cast(f[4] as double) latitude"
    )
    out["decode_points_6"] = (
        f"select {first4}, cast(f[5] as double) speed, cast(f[6] as double) heading from {parts}"
    )
    out["decode_points_4"] = f"select {first4}, 0.0::double speed, 0.0::double heading from {parts}"
    ev = events_sql("raw", RAW)
    out["track_segments"] = (
        f'with {ev} select id, "timestamp", longitude, latitude, speed, heading, seq, segment from ev'
    )
    out["history_bounds"] = f'with {ev} select id, "timestamp", segment, n_visible, first_ts from ev'
    out["sampling_regularity"] = f'with {ev} select id, "timestamp", segment, irregular from ev'
    out["span_guard"] = f'with {ev} select id, "timestamp", segment, span_ok, z_len from ev'
    out["step_counter"] = f'with {ev} select id, "timestamp", segment, i from ev'
    step = 'over (partition by id, segment order by "timestamp", seq)'
    diffs = ", ".join(
        f"(round(case when pos > 1 then {a} - lag({a}) {step} else {'0.0' if k < 2 else a} end, 9) + 0.0) {a}"
        for k, a in enumerate(ATTRIBUTES)
    )
    out["track_diff"] = f'with {ev} select id, "timestamp", segment, {diffs} from ev'
    for name, variant in (("level", "arma_gd"), ("diff", "arima_gd")):
        cfg = REGULAR.with_(variant=variant, window=6, train=4)
        rows = " union all ".join(
            f'select id, segment, origin "timestamp", {k} k, attr attribute, '
            + ", ".join(f"(round(v{k + 1 - j}, 9) + 0.0) x{j}" for j in range(1, 5))
            + f", (round(v{k + 1}, 9) + 0.0) target from win"
            for k in (4, 5)
        )
        out[f"training_pairs_{name}"] = f"with recursive {windows_sql('reg', cfg)} {rows}"
    out["track_legs"] = (
        f'with {LEGS} select id, "timestamp", dt_ms, (round(distance_m, 6) + 0.0) distance_m, '
        "(round(distance_units, 9) + 0.0) distance_units from legs"
    )
    out["leg_speed"] = (
        f'with {LEGS} select id, "timestamp", (round(case when dt_ms > 0 then 3600000.0::double * distance_m '
        "/ (1852.0::double * dt_ms) else -1.0 end, 6) + 0.0) speed_knots from legs"
    )
    out["leg_bearing"] = f'with {LEGS} select id, "timestamp", (round(bearing_deg, 6) + 0.0) bearing_deg from legs'
    s = RAW.sampling
    out["resample_spline"] = f"""with recursive {ev},
good as (select id, segment, min("timestamp") t0, max("timestamp") t1, count(*) n, max(pos) last from ev
  group by id, segment having count(*) >= 3 and min(coalesce(dt, 1)) > 0),
kn as (select ev.id, ev.segment, pos k, good.n, cast("timestamp" - t0 as double) x, longitude lon, latitude lat
  from ev join good using (id, segment)),
{spline_sql("kn", "id, segment")},
grid as (select id, segment, t0, n, unnest(range(0, (t1 - t0) // {s} + 1)) j, (t1 - t0) // {s} m from good),
smp as (select grid.id, grid.segment, t0 + j * {s} "timestamp", j * {s} - pc.x dx, j = m final, pc.*exclude(id, segment, n),
    e.lon lon1, e.lat lat1
  from grid join pc on pc.id = grid.id and pc.segment = grid.segment
    and pc.x <= j * {s} and (j * {s} < pc.x_next or pc.k = pc.n - 1)
  join kn e on e.id = grid.id and e.segment = grid.segment and e.k = e.n)
select id, segment, "timestamp",
  (round(case when final then lon1 else lon + dx * (lon_b + dx * (lon_c + dx * lon_d)) end, 6) + 0.0) longitude,
  (round(case when final then lat1 else lat + dx * (lat_b + dx * (lat_c + dx * lat_d)) end, 6) + 0.0) latitude,
  0.0::double speed, 0.0::double heading from smp"""
    attrs = ", ".join(f"'{a}'" for a in ATTRIBUTES)
    eps = REGULAR.epsilon
    tracks = f"with {ev}, tk as (select distinct id, segment from ev), att as (select unnest([{attrs}]) attribute)"
    out["init_linear"] = (
        f"{tracks} select id, segment, attribute, 2.0::double w1, -1.0::double w2, 0.0::double w3, "
        + ", ".join(f"{eps if r == c else 0.0}::double a{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3))
        + " from tk, att"
    )
    draw = ", ".join(
        f"(cast('0x' || substr(md5(concat_ws('|', '7', id, segment, attribute, {j})), 1, 8) as bigint) % 201 - 100)"
        f" / 100.0::double w{j + 1}"
        for j in range(3)
    )
    out["init_random"] = f"{tracks} select id, segment, attribute, {draw} from tk, att"
    for name, variant in (("backtest_gd", "arma_gd"), ("backtest_ns", "arma_ns")):
        cfg = REGULAR.with_(variant=variant, window=5, train=3)
        out[name] = (
            f"with recursive {weights_sql('reg', cfg)} select wts.id, wts.segment, origin \"timestamp\", "
            "wts.attr attribute, (round(pred, 6) + 0.0) predicted, (round(wts.y, 6) + 0.0) actual, (round(pred - wts.y, 6) + 0.0) residual, "
            "(round(mean, 6) + 0.0) mean_residual, (round(pred - abs(mean), 6) + 0.0) corrected "
            "from wts join win on wts.id = win.id and wts.segment = win.segment and wts.t = win.t and wts.attr = win.attr"
        )
    for variant, name in (
        ("arma_gd", "gd_level"), ("arma_ns", "ns_level"), ("arima_gd", "gd_diff"), ("arima_ns", "ns_diff"),
    ):
        cfg = REGULAR.with_(variant=variant)
        cells = [f"a{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)] if cfg.newton else []
        matrix = "".join(f", (round({c}, 9) + 0.0) {c}" for c in cells)
        out[f"weights_{name}"] = (
            f"with recursive {weights_sql('reg', cfg)} select wts.id, wts.segment, origin \"timestamp\", "
            f"wts.attr attribute, (round(w1, 9) + 0.0) w1, (round(w2, 9) + 0.0) w2, (round(w3, 9) + 0.0) w3{matrix} "
            "from wts join win on wts.id = win.id and wts.segment = win.segment and wts.t = win.t and wts.attr = win.attr"
        )
    for variant in (
        "arma_gd", "arma_ns", "arima_gd", "arima_ns", "corr_arma_gd", "corr_arma_ns", "corr_arima_gd", "corr_arima_ns",
    ):
        out[f"forecast_{variant}"] = out[f"forecast_{variant}_hot"] = forecast_sql("reg", forecast_config(variant))
        out[f"forecast_{variant}_irregular"] = forecast_sql("raw", forecast_config(variant, irregular=True))
    out["forecast_wide_window"] = forecast_sql("reg", forecast_config("arima_ns").with_(window=6, train=3))
    out["forecast_derived_motion"] = derived_sql(DERIVED)
    for name, cfg in MICRO_BATCHES.items():
        irregular = name.endswith("_irregular")
        out[name] = derived_sql(cfg, MICRO_BATCH_POINTS, "raw" if irregular else "reg")
    out["forecast_arrival"] = forecast_sql("raw", ARRIVED)
    scored = f"{forecast_cte('reg', SCORED)}, {_actuals_join()}"
    run = label(SCORED, RATE_TEXT)
    out["settings_label"] = (
        f"with recursive {forecast_cte('reg', SCORED)} select '{run}_Horizon_' || horizon settings, count(*) n_forecasts "
        "from fc group by horizon"
    )
    out["accuracy"] = (
        f"with recursive {scored} select '{run}_Horizon_' || horizon settings, prediction_timestamp, horizon, "
        "(round(dist_lon_lat, 4) + 0.0) dist_lon_lat, 0.0::double altitude from sc"
    )
    out["horizon_accuracy"] = f"{out['accuracy']} where horizon = 3"
    out["error_counts"] = (
        f"with recursive {forecast_cte('reg', SCORED)} select '{SCORED.variant}' variant, horizon, count(*) n_forecasts, "
        "count(*) filter (where error) n_errors from fc group by horizon"
    )
    stats = "count(*) n_scored, (round(avg(dist_lon_lat), 3) + 0.0) mean_m, (round(sqrt(avg(dist_lon_lat*dist_lon_lat)), 3) + 0.0) rms_m"
    out["accuracy_summary"] = (
        f"with recursive {scored} select '{run}_Horizon_' || horizon settings, horizon, {stats} from sc group by horizon"
    )
    horizons = ", ".join(map(str, EVALUATED_HORIZONS))
    out["accuracy_by_horizon"] = f"""with recursive {forecast_cte("reg", PUBLISHED)},
ac as (select id, "timestamp", longitude, latitude, 'clean' actuals from reg
  union all select id, "timestamp", longitude + 0.001, latitude, 'shifted' from reg),
sc as (select actuals, horizon, {haversine("fc.latitude", "fc.longitude", "ac.latitude", "ac.longitude")} dist_lon_lat
  from fc join ac on fc.id = ac.id and fc."timestamp" = ac."timestamp" where not error and horizon in ({horizons}))
select actuals, '{label(PUBLISHED, RATE_TEXT)}' settings, horizon, {stats} from sc group by actuals, horizon"""
    for name, configs in (("sweep_accuracy", SWEEP_CONFIGS), ("sweep_published", PUBLISHED_GRID)):
        cells = [
            f"c{k} as (with recursive {forecast_cte('reg', cfg)}, {_actuals_join()} "
            f"select '{cfg.config_id}' settings, horizon, {stats} from sc group by horizon)"
            for k, cfg in enumerate(configs)
        ]
        everything = " union all ".join(f"select * from c{k}" for k in range(len(cells)))
        out[name] = f"with {', '.join(cells)} {everything}"
    out["sink_roundtrip"] = forecast_sql("reg", forecast_config("corr_arma_gd"))
    out["stream_forecast"] = forecast_sql("reg", forecast_config("corr_arima_gd"))
    out["stream_forecast_batches"] = out["forecast_arma_ns"]
    out["stream_forecast_irregular"] = out["stream_forecast_reordered"] = out["forecast_arima_gd_irregular"]
    out["accuracy_stored"] = out["accuracy_bucketed"] = out["accuracy"]
    out["track_history_hot"] = (
        f'with {ev} select id, "timestamp", segment, n_visible, first_ts, irregular, span_ok, z_len, i from ev'
    )
    out["track_legs_hot"] = out["track_legs"]
    out["resample_spline_hot"] = out["resample_spline"]
    out["csv_roundtrip"] = (
        f'with {RAW_POINTS} select id, "timestamp", longitude, latitude, speed, heading from raw'
    )
    return out
