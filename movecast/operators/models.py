"""Runs the weight recurrences over tracks.

Every track is learnt in pieces of ``PIECE_ROWS`` events. A gradient step is an affine map of the weights, so where a track goes on
after a piece, the weights there come from the map of that piece, applied to the weights with which the piece began. That is the
rule for all tracks, so results do not depend, to the last bit, on how points are laid out:

* cold tracks - one pass, one exchange (by id); maps are folded along only for tracks longer than a piece;
* hot tracks - gradient jobs fold the maps of all pieces in parallel, run them in order (one small row per piece), and replay all
  pieces in parallel from the weights they start with;
* Newton jobs are not affine: they go round by round (as do the objects of gradient jobs whose maps grow too large),
  a bounded stretch of every hot track at a time, handing the stored weights on. Rows are stored by round, with no join.

Rows hold one point each. What a window sees besides it is found in the task, from the rows of the same track before it; only the first
row of a hot piece brings the points before the piece along.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import ATTRIBUTES, ModelConfig
from ..functions import wavefront as wf
from ..functions.recurrence import LARGEST_MAP
from .tracks import ENDLESS, Part, chunk_links, durable, events, scratch_path, sized, track_parts, union_parts

PIECE_ROWS = 4_096
ROUND_PIECES = 256
#: Events and true positions of a hot object meet in stretches of time, so many times as long as the longest forecast.
STRETCH_REACHES = 32

_POINT = ["id", "segment", "timestamp", *ATTRIBUTES]
_PIECE = ["id", "segment", "piece"]


def check_together(configs: list[ModelConfig]) -> None:
    """Configurations of one pass must see the same events, though not as many points back."""
    key = {(c.sampling, c.gap_threshold, c.order) for c in configs}
    if len(key) != 1:
        raise ValueError("configurations of one pass share sampling, gap_threshold and order")


def random_start(cfg: ModelConfig) -> Column:
    """Start weights from {-1.00 .. 1.00}, hashed from seed, id, segment, attribute and position."""
    values = []
    for name in ATTRIBUTES:
        for j in range(cfg.train):
            text = F.concat_ws("|", F.lit(str(cfg.seed)), "id", "segment", F.lit(name), F.lit(str(j)))
            draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
            values.append((draw % 201 - 100) / 100)
    return F.array(*values)


def run_models(points: DataFrame, configs: list[ModelConfig], want: str, actuals: DataFrame | None = None, **layout) -> DataFrame:
    """One row per (configuration, trainable event) with what ``model_task`` returns for ``want``.

    ``piece_rows`` is part of the rule for the weights of gradient jobs; the other settings of ``layout`` do not change results.
    With ``actuals`` a row has the true positions at the times of its forecasts too (``truth``, entry by entry).
    """
    check_together(configs)
    rule = layout.pop("piece_rows", PIECE_ROWS), layout.pop("round_pieces", ROUND_PIECES)
    parts = track_parts(points, configs[0].order, **layout)
    frames = []
    for part, true in zip(parts, _actuals_of(parts, actuals), strict=True):
        run = _Run(configs, want, *rule, true)
        frames.append(run.hot(part) if part.chunked else run.cold(part))
    return union_parts(frames)


def _actuals_of(parts: list[Part], actuals: DataFrame | None) -> list[DataFrame | None]:
    """True positions that the tracks of each part may be scored against: (id, at, position), none without id or time."""
    if actuals is None:
        return [None] * len(parts)
    at = F.col("timestamp").cast("bigint")
    place = F.struct(F.col("longitude").alias("true_longitude"), F.col("latitude").alias("true_latitude"))
    known = actuals.select(F.col("id").try_cast("int").alias("id"), at.alias("at"), place.alias("place"))
    known = known.where(F.col("id").isNotNull() & F.col("at").isNotNull())
    if len(parts) == 1:
        return [known]
    hot = durable(parts[1].df.select("id").distinct())  # so that what hot objects have does not come to the task of a cold one
    return [known.join(hot, "id", "left_anti"), known.join(hot, "id", "left_semi")]


class _Run:
    """A pass of some configurations over the parts of the points."""

    def __init__(self, configs: list[ModelConfig], want: str, piece: int, round_pieces: int, actuals: DataFrame | None = None):
        if piece < 2:
            raise ValueError("piece_rows must be at least 2")
        self.configs, self.want, self.piece, self.round_pieces, self.actuals = configs, want, piece, round_pieces, actuals
        self.stretch = piece * round_pieces
        self.windows = windows = tuple(sorted({c.window for c in configs}))
        self.named: Callable[[str, int], str] = lambda name, h: sized(name, h, windows)

    def _sights(self) -> list[Column]:
        """Columns of each window size: is this event on the grid, does it train, which step of the gradient is it."""
        out = []
        for h in self.windows:
            irregular, z, i, trains = (self.named(c, h) for c in ("irregular", "z_len", "i", "trains"))
            out += [F.col(irregular), (F.col(z) >= h).alias(trains), F.col(i).cast("bigint").alias(i)]
        return out

    def _anchors(self) -> Column:
        """Times from which an event is forecast step by step: those of the last samples of its windows, and its own where the observed
        point is scored too. On the grid that is one time."""
        trains = {h: F.col(self.named("z_len", h)) >= h for h in self.windows}
        times = [F.when(trains[h], F.col(self.named("base_ts", h))) for h in self.windows]
        times += [F.when(trains[c.window], F.col("timestamp")) for c in self.configs if c.from_observed]
        return F.array_sort(F.array_distinct(F.filter(F.array(*times), lambda t: t.isNotNull())))

    def _with_anchors(self, part: Part, df: DataFrame, begins: Column) -> DataFrame:
        """Events with what ``_with_truth`` needs. ``kept_from``: the event has the true positions from this time on that the event before it
        has (those from one time too, a whole number of steps earlier); ``ENDLESS``: it has none of them, as where a track begins."""
        df = df.withColumn("anchors", self._anchors())
        df = df.withColumn("alone", F.when(F.size("anchors") == 1, F.get("anchors", F.lit(0))))
        df = df.withColumn("former", F.lag("alone").over(part.window()))
        steps = F.col("alone") - F.col("former")
        follows = F.col("prior").isNotNull() & ~begins & (steps >= 0) & (steps % self.configs[0].sampling == 0)
        return df.withColumn("kept_from", F.when(follows, F.col("alone")).otherwise(F.lit(ENDLESS)))

    _FACTS = ("anchors", "former", "kept_from")

    def _with_truth(self, rows: DataFrame, whole_ids: bool) -> DataFrame:
        """Events with the true positions of their id at the times they are forecast for (``ahead``), less those that the event before has.

        Events and true positions meet by id and by their place between two steps: an event at an anchor sees exactly the positions a whole
        number of steps ahead, so neither side is multiplied by the steps, and along a track a true position comes but once. Rows of an id
        stay together with ``whole_ids``; else they are cut by time, too.
        """
        step = self.configs[0].sampling
        reach = step * max(c.horizon for c in self.configs)
        span = reach * STRETCH_REACHES

        def stretch(at: Column) -> Column:
            return F.floor(at / F.lit(float(span)))

        anchored = rows.select("*", F.posexplode_outer("anchors").alias("slot", "at"))
        anchored = anchored.withColumn("stretch", stretch(F.col("at")))
        # An event that is ``reach`` before a position may lie in an earlier stretch, which gets the position, too.
        known = self.actuals.withColumn("stretch", F.explode(F.sequence(stretch(F.col("at") - reach), stretch(F.col("at")))))
        both = anchored.withColumn("event", F.lit(True)).unionByName(known, allowMissingColumns=True)
        if whole_ids:
            both = both.repartition("id")
        first = 0 if any(c.from_observed for c in self.configs) else step
        meet = Window.partitionBy("id", "stretch", F.pmod("at", F.lit(step))).orderBy("at")
        seen = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("at", "place.*"))).over(meet.rangeBetween(first, reach))
        both = both.withColumn("ahead", seen).where("event")
        # Anchors of an event a whole number of steps apart see the same positions; the earliest one that does brings them.
        anchor = F.col("at")
        earlier = F.filter("anchors", lambda t: (t < anchor) & ((anchor - t) % step == 0))
        had = F.greatest(F.array_max(earlier), F.when(F.col("kept_from") < ENDLESS, F.col("former")))
        new = F.when(had.isNull(), F.col("ahead")).otherwise(F.filter("ahead", lambda p: p["at"] > had + reach))
        both = both.withColumn("ahead", new)
        one = Window.partitionBy("id", "segment", "pos")
        both = both.withColumn("ahead", F.flatten(F.collect_list("ahead").over(one)))
        return both.where("slot IS NULL OR slot = 0").select(*[c for c in rows.columns if c not in ("anchors", "former")], "ahead")

    def cold(self, part: Part) -> DataFrame:
        df, w = events(part, self.configs[0], windows=self.windows).df, part.window()
        segment = F.col("segment").cast("bigint").alias("segment")
        columns = [*[segment if c == "segment" else c for c in _POINT], *self._sights()]
        if self.actuals is not None:
            df = self._with_anchors(part, df, F.lit(False)).select(*columns, "pos", *self._FACTS)
            df = self._with_truth(df, whole_ids=True)
            columns = [c for c in df.columns if c != "pos"]
            w = Window.partitionBy("id").orderBy("segment", "pos")

        def goes_on(k: int) -> Column:
            return F.lead("segment", k).over(w).eqNullSafe(F.col("segment"))

        facts = {"more": goes_on(1)}
        if not all(c.newton for c in self.configs):
            facts["goes_on"] = F.when((F.col("pos") - 1) % self.piece == 0, goes_on(self.piece)).otherwise(False)
        rows = df.withColumns(facts).select(*columns, F.col("pos").alias("t"), *facts)
        return self._learn(rows, self.configs, ("id", "segment"))

    def _learn(self, rows: DataFrame, configs: list[ModelConfig], keys: tuple[str, ...], state: bool = False) -> DataFrame:
        """Run the model task over numbered rows, whose tracks are whole within their partitions."""
        starts, first = {}, F.col("t") == 1
        for k, cfg in enumerate(configs):
            w0 = [F.col(f"w0_{k}")] if f"w0_{k}" in rows.columns else []
            if cfg.vector_init == "random":
                w0.append(random_start(cfg))
            if w0:
                starts[f"w0_{k}"] = F.when(first, F.coalesce(*w0))
            if f"a0_{k}" in rows.columns:
                starts[f"a0_{k}"] = F.when(first, F.col(f"a0_{k}"))
        rows = rows.withColumns(starts) if starts else rows
        rows = rows.sortWithinPartitions("t", *keys)
        task = wf.model_task(configs, self.want, state, self.piece, self.named)
        return rows.mapInArrow(task, self._schema(state))

    def _schema(self, state: bool) -> str:
        return wf.model_schema(self.want, state, self.actuals is not None)

    def hot(self, part: Part) -> DataFrame:
        cfg = self.configs[0]
        links = chunk_links(part, cfg, self.windows)
        df = events(part, cfg, links, self.windows, history=True).df
        begins = ((F.col("pos") - 1) % self.piece == 0) | ((F.col("nth") - 1) % self.stretch == 0)
        before = F.when(begins & (F.size("history") > 1), F.slice("history", 1, F.size("history") - 1))
        if self.actuals is not None:
            df = self._with_anchors(part, df, begins)
        rows = df.select(
            "id", F.col("segment").cast("bigint").alias("segment"), *_POINT[2:], *self._sights(), "pos", "nth",
            F.expr(f"(pos - 1) div {self.piece}").alias("piece"), before.alias("before"), *(self._FACTS if self.actuals is not None else ()),
        )
        if self.actuals is not None:
            rows = self._with_truth(rows, whole_ids=False)
        if not all(c.newton for c in self.configs):
            rows = durable(rows)
            along = Window.partitionBy("id").orderBy("segment", "piece")
            pieces = rows.groupBy(*_PIECE).agg(F.count(F.lit(1)).alias("n"))
            facts = {"number": F.row_number().over(along), "goes_on": F.lead("segment").over(along).eqNullSafe(F.col("segment"))}
            pieces = durable(pieces.withColumns(facts))
        if any(c.newton for c in self.configs):
            staged = self._by_rows(rows)
        rows = rows.drop("nth")
        frames = [
            (self._relay(staged, c) if c.newton else self._in_parallel(rows, pieces, c)).withColumn("config", F.lit(k))
            for k, c in enumerate(self.configs)
        ]
        return union_parts(frames)

    def _whole_pieces(self, rows: DataFrame) -> DataFrame:
        """Rows with their place in the piece. The window makes each piece lie in one task: a repartition below an Arrow task may be left
        out after a join by the same keys, and the join may then be turned into one that does not keep pieces together."""
        t = F.col("pos") - F.col("piece") * self.piece
        n = F.count(F.lit(1)).over(Window.partitionBy(*_PIECE))
        return rows.withColumns({"t": t, "more": t < n}).drop("pos")

    def _in_parallel(self, rows: DataFrame, pieces: DataFrame, cfg: ModelConfig) -> DataFrame:
        """All pieces at once, from the weights that the maps of the pieces before them lead to."""
        on = rows.join(pieces.where("goes_on").select(*_PIECE), _PIECE)
        folded = self._whole_pieces(on).sortWithinPartitions("t", *_PIECE).mapInArrow(wf.map_task(cfg, self.named), wf.MAP_SCHEMA)
        maps = durable(folded)
        wild = durable(maps.where(~(F.col("size") <= LARGEST_MAP)).select("id").distinct())
        each, calm = rows, None
        if wild.isEmpty():
            wild = None
        else:
            maps, each, calm = maps.join(wild, "id", "left_anti"), each.join(wild, "id", "left_anti"), True
        along = Window.partitionBy("id", "segment").orderBy("piece")
        maps = maps.drop("size").withColumns({"t": F.row_number().over(along), "more": F.lead("piece").over(along).isNotNull()})
        if cfg.vector_init == "random":
            maps = maps.withColumn("w0_0", F.when(F.col("t") == 1, random_start(cfg)))
        starts = maps.sortWithinPartitions("t", "id", "segment").mapInArrow(wf.carry_task(cfg), wf.CARRY_SCHEMA)
        each = self._whole_pieces(each.join(durable(starts), _PIECE, "left")).withColumn("goes_on", F.lit(False))
        out = self._learn(each, [cfg], tuple(_PIECE))
        if calm:
            staged = self._by_pieces(rows.join(wild, "id", "left_semi"), pieces.join(wild, "id", "left_semi"))
            out = out.unionByName(self._relay(staged, cfg))
        return out

    def _by_pieces(self, rows: DataFrame, pieces: DataFrame) -> _Staged:
        """Rows by stretches of ``round_pieces`` pieces of a track."""
        stretch = F.expr(f"(number - 1) div {self.round_pieces}").cast("int")
        within = Window.partitionBy("id", "segment", "stretch")
        pieces = pieces.withColumn("stretch", stretch).withColumn("from", F.min("piece").over(within) * self.piece)
        each = rows.join(pieces.drop("n", "number"), _PIECE)
        return _Staged.write(each.withColumn("t", F.col("pos") - F.col("from")).drop("pos", "piece", "from"))

    def _by_rows(self, rows: DataFrame) -> _Staged:
        """Rows by stretches of as many rows of a track as ``round_pieces`` whole pieces have. Newton steps need no whole pieces, so a
        row's stretch and its place there follow from its place along the track, and nothing is joined."""
        place = F.col("nth").cast("bigint") - 1
        rows = rows.withColumns(
            {
                "stretch": F.expr(f"(nth - 1) div {self.stretch}").cast("int"),
                "t": F.least(F.col("pos").cast("bigint"), place % self.stretch + 1),
            }
        )
        return _Staged.write(rows.withColumn("before", F.when(F.col("t") == 1, F.col("before"))).drop("pos", "piece", "nth"))

    def _relay(self, staged: _Staged, cfg: ModelConfig) -> DataFrame:
        """Round by round over the stretches.

        Each round is stored before the next one starts, and hands on one row per track: the weights of its last segment. These rows
        come to the next round as row 0 of their tracks, so the weights lie in one row of a track and no other.
        """
        spark = staged.spark
        results, states = (scratch_path(spark, n) for n in ("rounds", "weights"))
        schema = self._schema(True)
        along = Window.partitionBy("id", "segment").orderBy("t")
        starts = ["w0_0", "a0_0"] if cfg.newton else ["w0_0"]
        for r in range(staged.rounds):
            batch = staged.read(r)
            if r > 0:
                known = spark.read.schema(_STATE).parquet(f"{states}/round={r - 1}")
                known = known.select("id", "segment", F.lit(0).cast("bigint").alias("t"), *[F.col(c[0]).alias(c) for c in starts])
                batch = batch.withColumn("t", F.col("t").cast("bigint")).unionByName(known, allowMissingColumns=True)
                batch = batch.withColumns({c: F.lag(c).over(along) for c in starts})
            ends = F.max("t").over(Window.partitionBy("id", "segment"))  # and tracks lie in one task each
            batch = batch.withColumn("more", F.col("t") < ends).where("t > 0")
            learnt = self._learn(batch, [cfg], ("id", "segment"), state=True)
            learnt.write.option("parquet.enable.dictionary", "false").parquet(f"{results}/round={r}")  # forecasts hardly repeat
            ended = spark.read.schema(schema).parquet(f"{results}/round={r}").where("last")
            newest = F.max_by(F.struct("segment", "w", "a"), "segment").alias("s")
            ended.groupBy("id").agg(newest).select("id", "s.*").write.parquet(f"{states}/round={r}")
        columns = [c.split()[0] for c in self._schema(False).split(", ")]
        if not staged.rounds:
            return spark.createDataFrame([], self._schema(False))
        return spark.read.schema(schema + ", round int").parquet(results).where("not last").select(*columns)


@dataclass(frozen=True)
class _Staged:
    """Rows of hot tracks, stored by the round that learns them."""

    spark: SparkSession
    path: str
    schema: StructType
    rounds: int

    @staticmethod
    def write(rows: DataFrame) -> _Staged:
        spark = rows.sparkSession
        path = scratch_path(spark, "stretches")
        rows.write.partitionBy("stretch").parquet(path)
        last = spark.read.schema(rows.schema).parquet(path).agg(F.max("stretch")).first()[0]
        return _Staged(spark, path, rows.drop("stretch").schema, 0 if last is None else last + 1)

    def read(self, r: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/stretch={r}")


_STATE = "id int, segment bigint, w array<double>, a array<double>"
