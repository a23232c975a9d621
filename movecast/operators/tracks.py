"""Tracks in event order: layout, gap-free segments and the bounded history of every event.

Layout. A track is all points of one ``id``. Most tracks fit a task, so they are hashed by ``id`` once and every window
below runs on that one exchange. Tracks above ``hot_rows`` points are range-partitioned by (id, order) instead, and cut
into chunks of at most ``chunk_rows`` consecutive points, keyed by (id, chunk). What a chunk needs from the points before
it (its last few points, its place in the open segment, a running count) comes from a one-row-per-chunk summary, so no
task ever holds a whole hot track.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ModelConfig

HOT_ROWS = 1_048_576
CHUNK_ROWS = 4_096  # a power of two, so chunks never straddle the partitions that number them
BROADCAST_IDS = 100_000
ENDLESS = 1 << 62  # a gap no track has

POINT_COLUMNS = ("timestamp", "longitude", "latitude", "speed", "heading")


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a local one is made only for local runs that have none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="movecast-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Part:
    """Points of cold tracks (keys: id) or of hot tracks (keys: id, chunk), with their order columns."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def chunked(self) -> bool:
        return "chunk" in self.keys

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> Part:
        return Part(df, self.keys, self.order)


def _order(points: DataFrame, order: str) -> tuple[str, ...]:
    if order == "arrival":
        if "seq" not in points.columns:
            raise ValueError("order='arrival' needs a `seq` column that numbers the arrivals")
        return ("seq",)
    return ("timestamp", "seq") if "seq" in points.columns else POINT_COLUMNS


def track_parts(
    points: DataFrame | list[Part], order: str = "event", hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS
) -> list[Part]:
    """Split points into cold tracks and chunked hot tracks; each id is in one of them.

    The operators take the returned list in place of points, so that several of them share one layout of one order.
    """
    if isinstance(points, list):
        return points
    if chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    by = _order(points, order)
    points = points.select(F.col("id").cast("int").alias("id"), *_point_columns(points)[1:])
    sizes = points.groupBy("id").count()
    is_hot = F.col("id").isNotNull() & (F.col("count") > hot_rows)
    n_hot, n_cold = sizes.agg(F.count_if(is_hot), F.count_if(~is_hot)).first()
    if not n_hot:
        return [Part(points, ("id",), by)]
    cold, heavy = points.where(F.lit(False)), points  # where all tracks are hot, points need not be told apart
    if n_cold:
        hot = durable(sizes.where(is_hot).select("id"))
        if n_hot <= BROADCAST_IDS:
            hot = F.broadcast(hot)
        cold = points.join(hot, "id", "left_anti")
        heavy = points.join(hot, "id", "left_semi")
    if "seq" not in points.columns:  # equal points stay apart in the range partitioning
        heavy = heavy.withColumn("seq", F.monotonically_increasing_id())
        by_heavy = (*by, "seq")
    else:
        by_heavy = by
    slots = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = (
        heavy.repartitionByRange(slots, "id", *by_heavy)
        .sortWithinPartitions("id", *by_heavy)
        .withColumn("chunk", F.expr(f"monotonically_increasing_id() div {chunk_rows}"))
    )
    return [Part(cold, ("id",), by), Part(durable(heavy), ("id", "chunk"), by_heavy)]


def _halos(part: Part, size: int, gap: int) -> DataFrame:
    """Per chunk: the last ``size`` points before it (``halo``, oldest first).

    ``halo_open`` counts how many of them belong to the segment that is still open when the chunk starts.
    """
    latest = Window.partitionBy(*part.keys).orderBy(*[F.col(c).desc() for c in part.order])
    point = F.struct(*POINT_COLUMNS)
    tails = (
        part.df.withColumn("back", F.row_number().over(latest))
        .where(F.col("back") <= size)
        .groupBy(*part.keys)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), point.alias("p")))).alias("tail"))
        .withColumn("tail", F.transform("tail", lambda t: t["p"]))
    )
    before = Window.partitionBy("id").orderBy("chunk").rowsBetween(-size, -1)
    halo = F.flatten(F.collect_list("tail").over(before))
    return (
        tails.withColumn("halo", halo)
        .withColumn("halo", F.when(F.size("halo") <= size, F.col("halo")).otherwise(F.slice("halo", -size, size)))
        .select("id", "chunk", "halo", _open_points(F.col("halo"), gap).alias("halo_open"))
    )


def _open_points(halo: Column, gap: int) -> Column:
    """Length of the last run of ``halo`` without a gap."""
    starts = F.transform(
        halo,
        lambda p, k: F.when(
            (k == 0) | (p["timestamp"] - F.get(halo, k - 1)["timestamp"] > gap), k
        ),
    )
    last = F.array_max(F.filter(starts, lambda k: k.isNotNull()))
    return F.coalesce(F.size(halo) - last, F.lit(0))


def sized(name: str, h: int, windows: tuple[int, ...]) -> str:
    """Column of window size ``h``; sizes are told apart only where there are several."""
    return name if len(windows) == 1 else f"{name}_{h}"


def chunk_links(part: Part, cfg: ModelConfig, windows: tuple[int, ...] | None = None) -> DataFrame:
    """What every chunk takes over from the earlier chunks of its track: one stored row per chunk."""
    windows = windows or (cfg.window,)
    halos = durable(_halos(part, max(windows), cfg.gap_threshold))
    rows = _within(part.with_df(part.df.join(halos, ["id", "chunk"])), cfg, windows)
    grown = [sized("grown", h, windows) for h in windows]
    last = F.max_by(F.struct("segment", "pos", *grown), "rn")
    ends = rows.groupBy("id", "chunk").agg(last.alias("end"), F.max("rn").alias("rows")).select("id", "chunk", "rows", "end.*")
    upto = Window.partitionBy("id").orderBy("chunk")
    ends = ends.withColumns({f"{c}_end": F.sum(c).over(upto) for c in ("segment", "rows")})
    same = Window.partitionBy("id", "segment_end").orderBy("chunk")
    ends = ends.withColumns({f"{c}_end": F.sum(c).over(same) for c in ("pos", *grown)})
    before = {
        f"{c}_before": F.coalesce(F.lag(f"{c}_end").over(upto), F.lit(0)) for c in ("segment", "rows", "pos", *grown)
    }
    return durable(halos.join(ends.select("id", "chunk", *[v.alias(k) for k, v in before.items()]), ["id", "chunk"]))


def events(
    part: Part,
    cfg: ModelConfig,
    links: DataFrame | None = None,
    windows: tuple[int, ...] | None = None,
    history: bool = False,
) -> Part:
    """Every point with its segment and, for each window size, what is visible and the step counter (see ``track_history``).

    ``windows``: sizes to look at in one go; the columns of several sizes end in the size. ``history`` adds the visible points of
    the largest size, oldest first as they came; only jobs that need them as an array ask for it. Chunked parts have the place of the
    point along its whole track, too (``nth``, from 1).
    """
    windows = windows or (cfg.window,)
    if not part.chunked:
        df = _within(part, cfg, windows, history)
    else:
        links = chunk_links(part, cfg, windows) if links is None else links
        df = _within(part.with_df(part.df.join(links, ["id", "chunk"])), cfg, windows, history)
        still_open = F.col("segment") == 0
        grown = [sized("grown", h, windows) for h in windows]
        df = df.withColumns(
            {c: F.col(c) + F.when(still_open, F.col(f"{c}_before")).otherwise(0) for c in ("pos", *grown)}
            | {"segment": F.col("segment") + F.col("segment_before"), "nth": F.col("rn") + F.col("rows_before")}
        )
    keep = [c for c in part.df.columns if c not in POINT_COLUMNS]
    looks = [
        column
        for h in windows
        for column in (
            *[sized(c, h, windows) for c in ("n_visible", "first_ts", "irregular", "span_ok", "z_len", "base_ts")],
            (F.col("pos") + F.col(sized("grown", h, windows))).alias(sized("i", h, windows)),
        )
    ]
    more = [*(["nth"] if part.chunked else []), *(["history"] if history else [])]
    return part.with_df(df.select(*keep, *POINT_COLUMNS, "segment", "pos", "prior", *looks, *more))


def _within(part: Part, cfg: ModelConfig, windows: tuple[int, ...], history: bool = False) -> DataFrame:
    """``events`` as far as one id or one chunk (with its ``halo``) can tell: counts start at the chunk."""
    most, step, gap = max(windows), cfg.sampling, cfg.gap_threshold
    w = part.window()
    ts, point = F.col("timestamp"), F.struct(*POINT_COLUMNS)
    df = part.df.withColumns(
        {
            "rn": F.row_number().over(w),
            "previous": F.lag("timestamp").over(w),
            "prior": F.lag(point).over(w),
            "times": F.array(*[F.lag("timestamp", k).over(w) for k in range(most, 0, -1)], ts),
        }
    )
    if history:
        df = df.withColumn("recent", F.array(*[F.lag(point, k).over(w) for k in range(most, 0, -1)], point))
    if part.chunked:  # only the first points of a chunk look back into its halo
        first, last = F.col("rn") == 1, F.get("halo", F.size("halo") - 1)
        near = F.col("rn") <= most
        earlier = F.transform("halo", lambda p: p["timestamp"])
        df = df.withColumns(
            {
                "previous": F.when(first, last["timestamp"]).otherwise(F.col("previous")),
                "prior": F.when(first, last).otherwise(F.col("prior")),
                "times": F.when(near, F.concat(earlier, F.slice("times", -F.col("rn"), F.col("rn")))).otherwise(F.col("times")),
            }
        )
        if history:
            df = df.withColumn("recent", F.when(near, F.concat("halo", F.slice("recent", -F.col("rn"), F.col("rn")))).otherwise(F.col("recent")))
        df = df.drop("halo")
    dt = ts - F.col("previous")
    df = df.withColumn("fresh", F.coalesce((dt > gap).cast("int"), F.lit(0)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)

    def latest(condition: Column) -> Column:
        """Number of the last row so far where ``condition`` holds."""
        return F.max(F.when(condition, F.col("rn"))).over(running)

    df = df.withColumns(
        {
            "segment": F.sum("fresh").over(running),
            "opened": F.coalesce(latest(F.col("fresh") == 1), F.lit(1)),
            "last_off": latest((F.col("fresh") == 0) & (dt != step)),
            "last_same": latest(dt == 0),
        }
    ).withColumn("pos", F.col("rn") - F.col("opened") + 1)
    known = F.col("pos")
    if part.chunked:
        known = known + F.when(F.col("segment") == 0, F.col("halo_open")).otherwise(0)
    df = df.withColumn("known", known).withColumn("prior", F.when(F.col("known") > 1, F.col("prior")))
    named = {h: (lambda c, h=h: sized(c, h, windows)) for h in windows}
    df = df.withColumns({named[h]("n_visible"): F.least(F.lit(h + 1), F.col("known")) for h in windows})
    for h in windows:
        df = _seen(df, h, named[h], cfg, part.chunked)
    extra = {h: F.when(F.col(named[h]("irregular")), F.col(named[h]("z_len"))).otherwise(0) for h in windows}
    df = df.withColumns({named[h]("extra"): v for h, v in extra.items()})
    df = df.withColumns({named[h]("total"): F.sum(named[h]("extra")).over(running) for h in windows})
    fresh = F.col("fresh") == 1
    spent = {
        h: F.max(F.when(fresh, F.col(named[h]("total")) - F.col(named[h]("extra")))).over(running) for h in windows
    }
    df = df.withColumns({named[h]("spent"): v for h, v in spent.items()})
    df = df.withColumns(
        {named[h]("grown"): F.col(named[h]("total")) - F.coalesce(named[h]("spent"), F.lit(0)) for h in windows}
    )
    if history:
        n = F.least(F.lit(most + 1), F.col("known"))
        df = df.withColumn("history", F.slice("recent", -n, n))
    return df


def _seen(df: DataFrame, h: int, named, cfg: ModelConfig, chunked: bool) -> DataFrame:
    """What a window of ``h`` points sees at each row."""
    ts, step = F.col("timestamp"), F.lit(float(cfg.sampling))
    n = F.col(named("n_visible"))
    oldest = F.col("rn") - n + 1
    irregular = F.coalesce(F.col("last_off") > oldest, F.lit(False))
    apart = ~F.coalesce(F.col("last_same") > oldest, F.lit(False))
    times = F.slice("times", -n, n)
    distinct = F.size(F.array_distinct(times)) == n
    if chunked:  # a history that starts in the halo is looked at point by point
        steps = F.zip_with(F.slice(times, 2, h), F.slice(times, 1, F.size(times) - 1), lambda b, a: b - a)
        irregular = F.when(oldest < 1, F.exists(steps, lambda d: d != cfg.sampling)).otherwise(irregular)
        apart = F.when(oldest < 1, distinct).otherwise(apart)
    df = df.withColumns(
        {named("first_ts"): F.get("times", F.size("times") - n), named("irregular"): irregular}
    ).withColumn(named("span_ok"), F.floor((ts - F.col(named("first_ts"))) / step) + 1 > h)
    start = F.col(named("first_ts"))
    if cfg.order == "arrival":
        start = F.array_min(times)
        span, apart = F.array_max(times) - start, distinct
    else:
        span = ts - start
    usable = F.col(named("span_ok")) & (n >= 3) & apart
    resampled = F.when(usable, F.floor(span / step) + 1).otherwise(0)
    df = df.withColumn(named("z_len"), F.when(F.col(named("irregular")), resampled).otherwise(n).cast("bigint"))
    last = start + (F.col(named("z_len")) - 1) * F.lit(cfg.sampling)  # time of the last sample
    return df.withColumn(named("base_ts"), F.when(F.col(named("irregular")), last).otherwise(ts))


def event_parts(points: DataFrame, cfg: ModelConfig, history: bool = False, **layout) -> list[Part]:
    return [events(p, cfg, history=history) for p in track_parts(points, cfg.order, **layout)]


def union_parts(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _point_columns(points: DataFrame) -> list[str]:
    return ["id", *POINT_COLUMNS, *(["seq"] if "seq" in points.columns else [])]


def track_segments(points: DataFrame, gap: int, order: str = "event", **layout) -> DataFrame:
    """Points with the number of their gap-free segment (0, 1, ...) within the track."""
    cfg = ModelConfig(gap_threshold=gap, order=order)
    keep = [*_point_columns(points), F.col("segment").cast("bigint").alias("segment")]
    return union_parts([p.df.select(*keep) for p in event_parts(points, cfg, **layout)])


def track_history(points: DataFrame, cfg: ModelConfig, **layout) -> DataFrame:
    """Points with what the model sees at each of them.

    ``n_visible`` points (up to window + 1) since ``first_ts``; ``irregular`` when they are off the grid; ``span_ok``
    when an irregular history spans enough steps; ``z_len`` sampled points; ``i`` the step counter of the gradient.
    """
    keep = [
        *_point_columns(points),
        F.col("segment").cast("bigint").alias("segment"),
        F.col("n_visible").cast("bigint").alias("n_visible"),
        "first_ts",
        "irregular",
        "span_ok",
        "z_len",
        F.col("i").cast("bigint").alias("i"),
    ]
    return union_parts([p.df.select(*keep) for p in event_parts(points, cfg, **layout)])


def track_diff(points: DataFrame, gap: int, order: str = "event", **layout) -> DataFrame:
    """First differences along each segment, stamped with the later time.

    The first point of a segment has no predecessor: its position difference is 0 and it keeps its raw speed/heading.
    """
    cfg = ModelConfig(gap_threshold=gap, order=order, window=3, train=2)
    before, first = F.col("prior"), F.col("prior").isNull()

    def change(name: str, start) -> Column:
        return F.when(first, start).otherwise(F.col(name) - before[name]).alias(name)

    keep = [
        "id",
        "timestamp",
        F.col("segment").cast("bigint").alias("segment"),
        change("longitude", F.lit(0.0)),
        change("latitude", F.lit(0.0)),
        change("speed", F.col("speed")),
        change("heading", F.col("heading")),
    ]
    return union_parts([p.df.select(*keep) for p in event_parts(points, cfg, **layout)])


def track_positions(points: DataFrame, order: str = "event", **layout) -> DataFrame:
    """Points with their running number (``pos``, from 1) along the whole track."""
    cfg = ModelConfig(gap_threshold=ENDLESS, order=order, window=3, train=2)
    keep = [*_point_columns(points), F.col("pos").cast("bigint").alias("pos")]
    return union_parts([p.df.select(*keep) for p in event_parts(points, cfg, **layout)])
