"""Searching rule grids and selecting parameters on held-out clips.

A grid of several hundred rules is factored: the samples are shuffled once by
(clip, piece) and tested for each predicate once, and every frame size reads
the same hits.  Scores come from fired rows alone, as a clip without an alarm
is a miss by definition, so no clip x rule table is materialised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from ..functions import signals as S
from ..plans.presets import DwellRule, EntryRule, FireRule, RunRule
from ..session import checkpoint
from .ordered import carry, chunked, piece_window, time_bucket
from .scoring import FALSE, HIT, f1_percent, verdict

def fire_predicate(rule: FireRule, base: str = "smoke_base") -> str:
    """The hit condition of a grid point as SQL text: a grid is one expression."""
    fire = f"fire >= {rule.fire}D"
    if rule.kind == "fire_only":
        return fire
    if rule.kind == "combined":
        return f"{fire} OR (fire >= {S.SMOKE_FLOOR}D AND smoke >= {rule.smoke}D)"
    if rule.kind == "either":
        return f"{fire} OR smoke >= {rule.fire}D"
    if rule.kind == "smoke_ok":
        return f"{fire} OR smoke >= {rule.smoke}D"
    if rule.kind == "smoke_rise":
        if rule.rise is None:
            return fire
        return f"{fire} OR (smoke >= {base} + {rule.rise}D AND smoke >= {S.SMOKE_FLOOR}D)"
    raise ValueError(rule.kind)


def rule_table(spark: SparkSession, rules: Sequence[tuple], fields: Sequence[str] | None = None) -> DataFrame:
    """The grid as a table: ``ordinal`` is the enumeration order.  Its size is fixed."""
    fields = fields or type(rules[0])._fields
    types = {bool: "boolean", int: "int", float: "double", str: "string"}
    ddl = ["ordinal int"]
    for i, name in enumerate(fields):
        kinds = {type(r[i]) for r in rules if r[i] is not None}
        kind = float if float in kinds else next(iter(kinds), float)
        ddl.append(f"{name} {types[kind]}")
    cast = lambda i, v: float(v) if v is not None and ddl[i + 1].endswith("double") else v
    data = [(n, *[cast(i, v) for i, v in enumerate(r)]) for n, r in enumerate(rules)]
    return spark.createDataFrame(data, ", ".join(ddl))


#: Names of the columns of a variant: position, fire, smoke and smoke of the head.
Variant = tuple[str, str, str, str]
PLAIN: Variant = ("idx", "fire", "smoke", "smoke_base")


def frame_reach(rules: Sequence[FireRule]) -> int:
    """How many samples before a sample its frames reach."""
    return max(r.win for r in rules) - 1


def clip_onsets(
    indexed: DataFrame,
    rules: Sequence[FireRule],
    variants: Sequence[Variant] | None = None,
    store: Callable[[DataFrame], DataFrame] = checkpoint,
    about: Sequence[str] = (),
) -> DataFrame:
    """All rules over all clips, packed: (clip, onsets), null at the ordinals of rules that do not fire.

    ``indexed`` has ``clip, idx, t, fire, smoke`` and, for rise rules,
    ``smoke_base``.  Spark deals and sorts the pieces; ``_frames`` looks for the
    frames in plain arrays, so a sample stays one row whatever the number of
    predicates.

    With ``variants``, ``indexed`` comes from ``index_samples`` with ``among``
    and this ``reach``, and a row holds the sample of every variant.  The clip
    of a result is a struct (variant, clip).  Frames inside a piece are found
    there, those across a border from the rims of the clip's pieces; ``store``
    keeps what was found until both are together.  ``about`` names columns that
    are the same in all rows of a clip and stay in the result.
    """
    kinds = {fire_predicate(r): r for r in rules}
    places = _places(kinds)
    cells = [(places[fire_predicate(r)], r.win, r.hits) for r in rules]
    reach = frame_reach(rules)
    if variants:
        return _variant_onsets(indexed, list(kinds.values()), cells, reach, variants, store, list(about))
    values = [c for c in ("t", "fire", "smoke", "smoke_base") if c in indexed.columns]
    samples = indexed.select("clip", "idx", *[F.col(c).cast("double").alias(c) for c in values])
    cut = chunked(samples, ["clip"], "idx", back=reach, expands=True).sortWithinPartitions("clip", "_piece", "idx")
    # a name and a type: a quoted name may hold anything
    schema = StructType([samples.schema["clip"], StructField("onsets", ArrayType(DoubleType()))])
    return _first_of_pieces(cut.mapInArrow(_frames(list(kinds.values()), cells, reach), schema))


def _first_of_pieces(found: DataFrame, about: Sequence[str] = ()) -> DataFrame:
    # one row per piece, seldom more: the first onset counts
    least = F.expr("aggregate(slice(_all, 2, size(_all)), _all[0], (a, b) -> zip_with(a, b, (x, y) -> least(x, y)))")
    return found.groupBy("clip", *about).agg(F.collect_list("onsets").alias("_all")).select(
        "clip", *about, F.when(F.size("_all") == 1, F.col("_all")[0]).otherwise(least).alias("onsets")
    )


def _variant_onsets(
    indexed: DataFrame, kinds: Sequence[FireRule], cells: Sequence[tuple[int, int, int]], reach: int,
    variants: Sequence[Variant], store: Callable[[DataFrame], DataFrame], about: list[str],
) -> DataFrame:
    """``clip_onsets`` with variants."""
    whole = dict.fromkeys(v[0] for v in variants)
    numbers = dict.fromkeys(c for v in variants for c in v[1:] if c in indexed.columns)
    columns = [F.col(c).cast("long").alias(c) for c in whole] + [F.col(c).cast("double").alias(c) for c in ("t", *numbers)]
    samples = indexed.select("clip", "_piece", "_many", "_rim", *about, *columns, F.lit(True).alias("_own")).sortWithinPartitions("clip", "_piece", "t")
    rim = StructType([StructField(c, samples.schema[c].dataType) for c in ("t", *whole, *numbers)])
    found_at = [
        samples.schema["clip"], StructField("variant", IntegerType()), StructField("_many", BooleanType()), *[StructField(c, samples.schema[c].dataType) for c in about],
        StructField("onsets", ArrayType(DoubleType())),
    ]
    frames = _frames(kinds, cells, reach, variants, about, [f.name for f in rim])
    found = store(samples.mapInArrow(frames, StructType([*found_at, StructField("_rim", rim)])))
    # the rims of a clip are one piece with gaps: a frame over a gap holds fewer hits than it has, so it fires no earlier
    rims = found.filter(F.col("_rim").isNotNull()).select("clip", *about, "_rim.*")
    rims = rims.repartition("clip").sortWithinPartitions("clip", "t").withColumns({"_piece": F.lit(0), "_own": F.lit(True), "_many": F.lit(True)})
    across = rims.mapInArrow(_frames(kinds, cells, reach, variants, about), StructType(found_at))
    named = lambda df: df.filter(F.col("onsets").isNotNull()).select(F.struct("variant", "clip").alias("clip"), *about, "onsets")
    single, many = found.filter(~F.col("_many")), found.filter("_many").drop("_rim").unionByName(across)
    return named(single).unionByName(_first_of_pieces(named(many), about))


def _new_key(column: pa.Array) -> np.ndarray:
    """Where the value differs from the one before; two nulls agree."""
    if pa.types.is_struct(column.type):
        fields = [_new_key(f) for f in column.flatten()]
        return reduce(np.logical_or, [*fields, _new_key(column.is_null())])
    null = column.is_null().to_numpy(zero_copy_only=False)
    differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return np.concatenate(([True], differs | (null[1:] != null[:-1])))


def _meets(rule: FireRule, fire: np.ndarray, smoke: np.ndarray, base: np.ndarray | None) -> np.ndarray:
    """``fire_predicate`` on arrays."""
    hit = fire >= rule.fire
    if rule.kind == "combined":
        return hit | ((fire >= S.SMOKE_FLOOR) & (smoke >= rule.smoke))
    if rule.kind in ("either", "smoke_ok"):
        return hit | (smoke >= (rule.fire if rule.kind == "either" else rule.smoke))
    if rule.kind == "smoke_rise" and rule.rise is not None:
        return hit | ((smoke >= base + rule.rise) & (smoke >= S.SMOKE_FLOOR))
    return hit


def _frames(
    kinds: Sequence[FireRule], cells: Sequence[tuple[int, int, int]], reach: int,
    variants: Sequence[Variant] | None = None, about: Sequence[str] = (), rim: Sequence[str] = (),
):
    """First onset of every (predicate, frame) in the sorted pieces of a partition.

    A piece that goes on in the next batch hands over the samples within reach.
    With ``rim``, the rows marked so come out as well, as a struct of these columns.
    """
    wanted: dict[int, dict[int, list[tuple[int, list[int]]]]] = {}
    for place, win, hits in dict.fromkeys(cells):
        at = [i for i, c in enumerate(cells) if c == (place, win, hits)]
        wanted.setdefault(place, {}).setdefault(hits, []).append((win, at))

    def onsets(pos, own, piece, t, levels, pieces: int) -> np.ndarray:
        out = np.full((len(cells), pieces), np.nan)
        for place, by_hits in wanted.items():
            hit = np.flatnonzero(_meets(kinds[place], *levels))
            hit_pos, hit_own, hit_piece, hit_t = pos[hit], own[hit], piece[hit], t[hit]
            for n, frames in by_hits.items():
                if len(hit) < n:
                    continue
                back = hit_pos[n - 1:] - hit_pos[:len(hit) - n + 1]
                for win, at in frames:
                    # the onset grows with the firing sample, so the first to fire holds the smallest
                    fired = np.flatnonzero((back < win) & hit_own[n - 1:])
                    where = hit_piece[fired]
                    lead = fired[np.flatnonzero(where[1:] != where[:-1]) + 1] if len(fired) > 1 else fired[:0]
                    lead = np.concatenate((fired[:1], lead))
                    for i in at:
                        out[i, hit_piece[lead]] = hit_t[lead]
        return out

    def first(batch: pa.RecordBatch) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        plain = lambda name: column(name).to_numpy(zero_copy_only=False)
        has = set(batch.schema.names)
        t, own = plain("t"), plain("_own")
        starts = np.flatnonzero(_new_key(column("clip")) | _new_key(column("_piece")))
        piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
        done, going_on = [], np.zeros(len(t), dtype=bool)
        if variants:
            # a piece that goes on in another batch has more onsets than one as well
            several = plain("_many")[starts] | ~own[starts]
            several[-1] = True
        sets: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name in dict.fromkeys(v[0] for v in variants or (PLAIN,)):
            # the samples of the set, and positions of different pieces farther apart than any frame
            rows = np.flatnonzero(column(name).is_valid().to_numpy(zero_copy_only=False))
            idx = pc.fill_null(column(name), 0).to_numpy(zero_copy_only=False)[rows]
            if len(idx):
                sets[name] = rows, idx - idx.min() + piece[rows] * (idx.max() - idx.min() + reach + 1)
                last = rows >= starts[-1]
                if last.any():
                    going_on[rows[last & (idx >= idx[-1] - reach)]] = True
        levels: dict[str, np.ndarray] = {}

        def level(name: str, base: bool) -> np.ndarray | None:
            if name not in has:
                return None
            if name not in levels:
                # as in Spark, nothing compares with null and NaN is above all numbers
                levels[name] = np.nan_to_num(
                    pc.fill_null(column(name), -np.inf).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf
                )
                if base:
                    levels[name][column(name).is_null().to_numpy(zero_copy_only=False)] = np.nan
            return levels[name]

        for number, (name, fire, smoke, base) in enumerate(variants or (PLAIN,)):
            if name not in sets:
                continue
            rows, pos = sets[name]
            used = [v if v is None else v[rows] for v in (level(fire, False), level(smoke, False), level(base, True))]
            out = onsets(pos, own[rows], piece[rows], t[rows], used, len(starts))
            kept = np.flatnonzero(~np.isnan(out).all(axis=0))
            if not len(kept):
                continue
            values = out[:, kept].T.ravel()
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(kept) + 1, dtype="int32") * len(cells)), pa.array(values, mask=np.isnan(values))
            )
            columns = {c: column(c).take(pa.array(starts[kept])) for c in ("clip", *about)} | {"onsets": lists}
            if variants:
                columns |= {"variant": pa.array(np.full(len(kept), number, dtype="int32")), "_many": pa.array(several[kept])}
            done.append(columns)
        if rim:
            marked = batch.filter(pc.and_(pc.fill_null(column("_rim"), False), column("_own")))
            if marked.num_rows:
                parts, own_rows = marked.select(list(rim)), lambda name: marked.column(marked.schema.get_field_index(name))
                done.append({c: own_rows(c) for c in ("clip", "_many", *about)} | {"_rim": pa.StructArray.from_arrays(parts.columns, fields=[f.with_nullable(True) for f in parts.schema])})
        context = batch.filter(pa.array(going_on))
        at = context.schema.get_field_index("_own")
        return done, context.set_column(at, context.schema.field(at), pa.array(np.zeros(context.num_rows, dtype=bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None:
                batch = pa.Table.from_batches([left, batch.cast(left.schema)]).combine_chunks().to_batches()[0]
            done, left = first(batch)
            fields = [batch.schema.field("clip")]
            if variants:
                fields += [pa.field("variant", pa.int32()), pa.field("_many", pa.bool_()), *[batch.schema.field(c).with_nullable(True) for c in about]]
            fields.append(pa.field("onsets", pa.list_(pa.float64())))
            if rim:
                fields.append(pa.field("_rim", pa.struct([batch.schema.field(c).with_nullable(True) for c in rim])))
            for columns in done:
                n = len(columns["clip"])
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in fields], schema=pa.schema(fields))

    return run


def sweep_onsets(indexed: DataFrame, rules: Sequence[FireRule]) -> DataFrame:
    """``clip_onsets`` as rows (clip, ordinal, onset) where the rule fires."""
    return by_rule(clip_onsets(indexed, rules))


def by_rule(packed: DataFrame, onsets: str = "onsets") -> DataFrame:
    """One row per fired rule (ordinal, onset) in place of the packed ``onsets``."""
    rest = [c for c in packed.columns if c != onsets]
    return packed.select(*rest, F.posexplode(onsets).alias("ordinal", "onset")).filter(F.col("onset").isNotNull())


def sweep_stays(
    samples: DataFrame,
    predicates: Sequence[str],
    needs: Sequence[int],
    gaps: Sequence[int] = (0,),
    keys: Sequence[str] = ("clip",),
    track: Sequence[str] = ("track",),
) -> DataFrame:
    """First stretch of every track for all predicates, lengths and pauses at once.

    ``samples`` has ``keys, *track, idx, t, prev_t``.  A stretch is ``need``
    qualified boxes with no pause over ``gap`` samples.  Returns ``_pred``,
    ``_stay`` (the place in needs x gaps), ``at`` (its last box), ``since`` (its
    first) and ``before`` (the sample before ``at``).
    """
    stays = list(product(needs, gaps))
    cases = ", ".join(f"CASE WHEN {p} THEN {i} END" for i, p in enumerate(predicates))
    met = samples.withColumn("_met", F.expr(f"array_compact(array({cases}))")).filter(F.size("_met") > 0)
    met = met.select(*keys, *[c for c in track if c not in keys], "idx", "t", "prev_t", "_met")
    reach = max((n - 1) * (g + 1) for n, g in stays)
    cut = chunked(met, keys, "idx", back=reach, expands=True).withColumn("_pred", F.explode("_met")).drop("_met")
    w = piece_window(keys, "idx", extra=[*[c for c in track if c not in keys], "_pred"])
    pause = F.col("idx") - F.lag("idx").over(w) - 1
    cut = cut.withColumns(
        {f"_since{n}": F.lag("t", n - 1).over(w) for n in needs} | {f"_broken{g}": F.when(pause > g, 1).otherwise(0) for g in gaps}
    )
    breaks = {
        f"_breaks{j}": F.sum(f"_broken{g}").over(w.rowsBetween(-(n - 2), 0)) if n > 1 else F.lit(0)
        for j, (n, g) in enumerate(stays)
    }
    cut = cut.withColumns(breaks)
    firsts = []
    for j, (n, _) in enumerate(stays):
        done = F.col("_own") & F.col(f"_since{n}").isNotNull() & (F.col(f"_breaks{j}") == 0)
        # all three times grow along the track, so the first stretch holds the minima
        firsts += [F.min(F.when(done, F.col(c))).alias(f"{out}{j}") for c, out in (("t", "at"), (f"_since{n}", "since"), ("prev_t", "before"))]
    names = [*keys, *[c for c in track if c not in keys], "_pred"]
    found = cut.groupBy(*names).agg(*firsts)
    rows = F.array(*[F.struct(*[F.col(f"{c}{j}").alias(c) for c in ("at", "since", "before")]) for j in range(len(stays))])
    return found.select(*names, F.posexplode(rows).alias("_stay", "_row")).select(*names, "_stay", "_row.*").filter("at IS NOT NULL")


def settle_all(
    found: DataFrame, settles: Sequence[float], value: str, keys: Sequence[str] = ("clip",), seconds: float = 1800.0
) -> DataFrame:
    """``rules.settle`` for several waits at once: (keys, _pred, _stay, _settle, onset).

    The sample before the next detection comes with that detection, so the
    samples are not read again.
    """
    group = [*keys, "_pred", "_stay"]
    times = checkpoint(found.groupBy(*group, "at").agg(F.max(value).alias("_value"), F.min("before").alias("before")))
    times = carry(times, group, ["at"], time_bucket("at", seconds), F.struct("at", "before"), "_next", ahead=True, inclusive=False)
    quiet = F.col("_next.before") - F.col("at")
    stops = times.groupBy(*group).agg(
        *[F.min(F.when(F.col("_next").isNull() | (quiet >= s), F.col("at"))).alias(f"_stop{i}") for i, s in enumerate(settles)]
    )
    alarms = times.join(stops, group).groupBy(*group).agg(
        *[F.max(F.when(F.col("at") <= F.col(f"_stop{i}"), F.col("_value"))).alias(f"_alarm{i}") for i in range(len(settles))]
    )
    return alarms.select(*group, F.posexplode(F.array(*[F.col(f"_alarm{i}") for i in range(len(settles))])).alias("_settle", "onset"))


def _places(values) -> dict:
    return {v: i for i, v in enumerate(dict.fromkeys(values))}


def _by_ordinal(fired: DataFrame, lookup: list[tuple], names: Sequence[str]) -> DataFrame:
    """Gives every grid point its row; the lookup has one row per grid point."""
    table = fired.sparkSession.createDataFrame(lookup, ", ".join(["ordinal int", "_delay double", *[f"{n} int" for n in names]]))
    return fired.join(F.broadcast(table), list(names)).select("clip", "ordinal", (F.col("onset") + F.col("_delay")).alias("onset"))


def _in_zone(kinds) -> list[str]:
    return [f"foot AND conf >= {conf}D AND corners >= {corners}" for conf, corners in kinds]


def sweep_entries(samples: DataFrame, grid: Sequence[EntryRule]) -> DataFrame:
    """Intrusion rules over ``clip, idx, t, prev_t, track, conf, foot, corners``."""
    kinds, holds, settles = (_places(v) for v in ([r[:2] for r in grid], [r.hold for r in grid], [r.settle for r in grid]))
    found = sweep_stays(samples.filter(F.col("conf") >= min(r.conf for r in grid)), _in_zone(kinds), list(holds))
    fired = settle_all(found, list(settles), "at")
    lookup = [(n, 0.0, kinds[r[:2]], holds[r.hold], settles[r.settle]) for n, r in enumerate(grid)]
    return _by_ordinal(fired, lookup, ["_pred", "_stay", "_settle"])


def sweep_dwells(samples: DataFrame, grid: Sequence[DwellRule], step_s: float = 0.5) -> DataFrame:
    """Loitering rules over the same columns; the delay is only added."""
    need = {r.dwell: max(1, -(-round(r.dwell * 1000) // round(step_s * 1000))) for r in grid}
    kinds, settles = _places(r[:2] for r in grid), _places(r.settle for r in grid)
    needs, gaps = list(dict.fromkeys(need.values())), list(dict.fromkeys(r.gap for r in grid))
    stays = {s: j for j, s in enumerate(product(needs, gaps))}
    found = sweep_stays(samples.filter(F.col("conf") >= min(r.conf for r in grid)), _in_zone(kinds), needs, gaps)
    fired = settle_all(found, list(settles), "since")
    lookup = [
        (n, float(r.delay), kinds[r[:2]], stays[need[r.dwell], r.gap], settles[r.settle]) for n, r in enumerate(grid)
    ]
    return _by_ordinal(fired, lookup, ["_pred", "_stay", "_settle"])


def sweep_runs(curves: DataFrame, grid: Sequence[RunRule]) -> DataFrame:
    """Run-length rules over ``clip, track, idx, t, z``: the first track to fire decides."""
    levels, needs = _places(r.threshold for r in grid), _places(r.need for r in grid)
    found = sweep_stays(
        curves.withColumn("prev_t", F.lit(None).cast("double")), [f"z >= {th}D" for th in levels], list(needs), keys=("clip", "track")
    )
    fired = found.groupBy("clip", "_pred", "_stay").agg(F.min("since").alias("onset"))
    return _by_ordinal(fired, [(n, 0.0, levels[r.threshold], needs[r.need]) for n, r in enumerate(grid)], ["_pred", "_stay"])


#: A rule family: (samples, grid) to rows (clip, ordinal, onset), one per clip and grid point that fires, or to them packed (clip, onsets).
RuleFamily = Callable[[DataFrame, Sequence[tuple]], DataFrame]


def evaluate(
    family: RuleFamily, samples: DataFrame, grid: Sequence[tuple], truth: DataFrame, delay: float = 0.0, digits: int | None = 2
) -> tuple[DataFrame, DataFrame]:
    """Verdicts of the fired grid points, written once, and the totals of every grid point."""
    fired = checkpoint(fired_verdicts(family(samples, grid), truth, delay))
    return fired, sweep_totals(fired, truth, rule_table(truth.sparkSession, grid), digits)


def held_out_report(held: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: best score on all clips and its setting, held-out score, the setting picked most often.

    Ties go to the first setting, and among equally frequent picks to the one of the smallest clip.
    """
    best = totals.agg(F.struct(
        F.max("f1").alias("f1_full"), F.min_by("ordinal", F.struct(-F.col("f1"), F.col("ordinal"))).alias("best_full")
    ).alias("b"))
    picks = held.groupBy("ordinal").agg(F.count(F.lit(1)).alias("picked"), F.min("clip").alias("_first"))
    most = picks.agg(F.struct(
        F.sum("picked").alias("clips"), F.max("picked").alias("picked"),
        F.min_by("ordinal", F.struct(-F.col("picked"), F.col("_first"))).alias("most_picked"),
    ).alias("m"))
    summary = hold_out_summary(held).withColumnRenamed("f1", "f1_held")
    return summary.withColumns({"_b": best.scalar(), "_m": most.scalar()}).select("_b.*", *summary.columns, "_m.*")


def fired_verdicts(fired: DataFrame, truth: DataFrame | None, delay: float = 0.0, alarm: str = "onset") -> DataFrame:
    """Verdict of every fired (clip, ordinal); clips without ground truth included.

    ``fired`` may be packed: ground truth then meets one row per clip.  Without
    ``truth``, ``fired`` has brought its ``start_s`` along.
    """
    joined = fired if truth is None else fired.join(truth, "clip")
    return (
        (by_rule(joined) if "onsets" in fired.columns else joined)
        .withColumn("alarm", F.col(alarm) + F.lit(float(delay)))
        .withColumn("verdict", verdict(F.col("alarm"), F.col("start_s")))
        .select("clip", "ordinal", "alarm", "start_s", "verdict")
    )


def sweep_totals(fired: DataFrame, truth: DataFrame, rules: DataFrame, digits: int | None = 2) -> DataFrame:
    """Counts and F1 per rule from fired rows: whatever did not hit is missed."""
    events = truth.agg(F.count("start_s").alias("_events"))
    counts = fired.groupBy("ordinal").agg(
        F.count(F.when(F.col("verdict") == HIT, 1)).alias("_tp"),
        F.count(F.when(F.col("verdict") == FALSE, 1)).alias("_fp"),
    )
    zero = F.lit(0).cast("long")
    return (
        rules.join(counts, "ordinal", "left")
        .withColumn("_events", events.scalar())
        .withColumn("tp", F.coalesce("_tp", zero))
        .withColumn("fn", F.col("_events") - F.col("tp"))
        .withColumn("fp", F.coalesce("_fp", zero))
        .withColumn("f1", f1_percent(F.col("tp"), F.col("fn"), F.col("fp"), digits))
        .drop("_tp", "_fp", "_events")
    )


def variant_counts(fired: DataFrame) -> DataFrame:
    """Hits and false alarms per variant and rule, for rows whose clip is a struct (variant, clip)."""
    return fired.groupBy(F.col("clip.variant").alias("variant"), "ordinal").agg(
        F.count(F.when(F.col("verdict") == HIT, 1)).alias("_tp"), F.count(F.when(F.col("verdict") == FALSE, 1)).alias("_fp")
    )


def variant_totals(counts: DataFrame, events: DataFrame, rules: DataFrame, variants: int) -> DataFrame:
    """``sweep_totals`` (two digits) of ``variant_counts``, which may come from several groups of clips.

    ``events`` is ground truth of plain clips, the same for every variant; a
    clip without samples in a variant is missed there.
    """
    total = events.agg(F.count("start_s").alias("_events"))
    counts = counts.groupBy("variant", "ordinal").agg(F.sum("_tp").alias("_tp"), F.sum("_fp").alias("_fp"))
    zero = F.lit(0).cast("long")
    tp, fp = F.coalesce("_tp", zero), F.coalesce("_fp", zero)
    # variants x grid: both are fixed
    cells = rules.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).join(counts, ["variant", "ordinal"], "left")
    cells = cells.withColumns({"tp": tp, "fp": fp}).withColumn("fn", total.scalar() - F.col("tp"))
    return cells.withColumn("f1", f1_percent(F.col("tp"), F.col("fn"), F.col("fp"))).drop("_tp", "_fp")


def best_of_variants(totals: DataFrame, margin: float = 0.01) -> DataFrame:
    """The best setting of every variant (F1, then fewest false alarms, then grid order) and how many come near it."""
    top = totals.groupBy("variant").agg(
        F.max("f1").alias("f1"), F.min_by("ordinal", F.struct(-F.col("f1"), F.col("fp"), F.col("ordinal"))).alias("ordinal")
    )
    near = totals.select("variant", F.col("f1").alias("_f1")).join(top.select("variant", F.col("f1").alias("_best")), "variant")
    stable = near.filter(F.col("_f1") >= F.col("_best") - margin).groupBy("variant").agg(F.count(F.lit(1)).alias("stable"))
    return top.join(totals.select("variant", "ordinal", "tp", "fn", "fp"), ["variant", "ordinal"]).join(stable, "variant")


def rank_rise(totals: DataFrame) -> DataFrame:
    """Best F1, then fewest false alarms, then the higher fire level."""
    return totals.orderBy(F.desc("f1"), F.asc("fp"), F.desc("fire"), F.asc("ordinal"))


def rank_f1_fp(totals: DataFrame) -> DataFrame:
    """Best F1, then fewest false alarms, first in the grid on ties."""
    return totals.orderBy(F.desc("f1"), F.asc("fp"), F.asc("ordinal"))


def stability(totals: DataFrame, level: str = "fire", margin: float = 0.01) -> DataFrame:
    """How many settings share the best score and how far their levels spread."""
    best = totals.agg(F.max("f1").alias("best"))
    top = totals.withColumn("best", best.scalar()).filter(F.col("f1") >= F.col("best") - margin)
    return top.groupBy("best").agg(
        F.count(F.lit(1)).alias("settings"),
        F.min(level).alias("lowest"),
        F.max(level).alias("highest"),
        F.count("rise").alias("with_smoke"),
    )


def hold_out(
    fired: DataFrame,
    truth: DataFrame,
    totals: DataFrame,
    digits: int | None = 2,
    group: str = "clip",
) -> DataFrame:
    """Leave-one-out: the best rule on all other clips, applied to the held one.

    The score of "all but this clip" is the total minus the clip's own share,
    so the search is linear in fired rows.  ``digits=2`` compares rounded F1
    (ties go to enumeration order), None compares the raw value.  With another
    ``group`` column in ``truth`` whole groups are held out together.

    Rules that do not fire in a group score the same for all groups with as many
    events: they are ranked once, and the first rank that no fired rule of the
    group takes is the best of them.
    """
    own_events = truth.groupBy(group).agg(F.count("start_s").alias("_events"))
    if group != "clip":
        fired = fired.join(truth.select("clip", group), "clip")
    share = fired.groupBy(group, "ordinal").agg(
        F.count(F.when(F.col("verdict") == HIT, 1)).alias("_tp"),
        F.count(F.when(F.col("verdict") == FALSE, 1)).alias("_fp"),
    )
    zero = F.lit(0).cast("long")

    def rest(tp: Column, fp: Column) -> Column:
        fn = F.col("_events") - tp
        score = f1_percent(F.col("_all.tp") - tp, F.col("_all.fn") - fn, F.col("_all.fp") - fp, digits)
        return F.struct(
            score.alias("f1"), (-F.col("ordinal")).alias("neg"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp")
        )

    # grid x different numbers of events
    silent = own_events.select("_events").distinct().crossJoin(
        totals.select("ordinal", F.struct("tp", "fn", "fp").alias("_all"))
    ).withColumn("_silent", rest(zero, zero))
    order = Window.partitionBy("_events").orderBy(F.desc("_silent"))
    silent = checkpoint(silent.withColumn("_rank", (F.row_number().over(order) - 1).cast("long")))
    loud = (
        share.join(own_events, group)
        .join(silent.select("_events", "ordinal", "_all", "_rank"), ["_events", "ordinal"])
        .withColumn("_loud", rest(F.col("_tp"), F.col("_fp")))
        # bounded by the grid, whatever the number of samples in the group
        .groupBy(group)
        .agg(F.max("_loud").alias("_loud"), F.array_sort(F.collect_list("_rank")).alias("_ranks"))
    )
    # ranks differ and begin with zero: the first one away from its place follows a gap
    gap = F.expr("array_position(transform(_ranks, (r, i) -> r > i), true) - 1")
    held = own_events.join(loud, group, "left").withColumn(
        "_rank", F.when(F.col("_ranks").isNull(), zero).when(gap >= 0, gap).otherwise(F.size("_ranks").cast("long"))
    )
    return (
        held.join(silent.select("_events", "_rank", "_silent"), ["_events", "_rank"], "left")
        .withColumn("_best", F.greatest("_loud", "_silent"))
        .select(
            group,
            (-F.col("_best.neg")).alias("ordinal"),
            F.col("_best.f1").alias("f1_rest"),
            F.col("_best.tp").alias("tp"),
            F.col("_best.fn").alias("fn"),
            F.col("_best.fp").alias("fp"),
        )
    )


def hold_out_summary(held: DataFrame, digits: int | None = 2) -> DataFrame:
    """Tally of the held-out verdicts."""
    c = held.agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    return c.withColumn("f1", f1_percent(F.col("tp"), F.col("fn"), F.col("fp"), digits))


def pick_frequency(held: DataFrame) -> DataFrame:
    """How often each setting was selected, most frequent first."""
    return held.groupBy("ordinal").agg(F.count(F.lit(1)).alias("picked")).orderBy(F.desc("picked"), "ordinal")


def fold_of(key: Column, folds: int) -> Column:
    """Fold number from a reproducible hash of the clip."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def fold_best(
    fired: DataFrame, truth: DataFrame, thresholds: DataFrame, folds: int, fold: Column
) -> DataFrame:
    """Best threshold on the training part of every fold, by raw F1, first wins."""
    truth = truth.withColumn("fold", fold)
    events = truth.groupBy("fold").agg(F.count("start_s").alias("events"))
    counts = (
        fired.join(truth.select("clip", "fold"), "clip")
        .groupBy("fold", "ordinal")
        .agg(
            F.count(F.when(F.col("verdict") == HIT, 1)).alias("tp"),
            F.count(F.when(F.col("verdict") == FALSE, 1)).alias("fp"),
        )
    )
    # folds x thresholds rows: both are small constants
    cell = (
        truth.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
        .withColumn("ordinal", F.explode(F.sequence(F.lit(0), thresholds.agg((F.max("ordinal")).alias("m")).scalar())))
        .join(counts, ["fold", "ordinal"], "left")
        .join(events, "fold", "left")
        .na.fill(0, ["tp", "fp", "events"])
    )
    total = cell.groupBy("ordinal").agg(
        F.sum("tp").alias("all_tp"), F.sum("fp").alias("all_fp"), F.sum("events").alias("all_events")
    )
    rest = cell.join(F.broadcast(total), "ordinal").withColumn(
        "f1",
        f1_percent(
            F.col("all_tp") - F.col("tp"),
            (F.col("all_events") - F.col("events")) - (F.col("all_tp") - F.col("tp")),
            F.col("all_fp") - F.col("fp"),
            None,
        ),
    )
    return (
        rest.groupBy("fold")
        .agg(F.max_by("ordinal", F.struct("f1", -F.col("ordinal"))).alias("ordinal"), F.max("f1").alias("f1"))
        .join(F.broadcast(thresholds), "ordinal")
    )


def adopt_median(best: DataFrame, level: str = "threshold") -> DataFrame:
    """The threshold adopted from the folds, with their spread."""
    return best.agg(
        F.median(level).alias("adopted"),
        F.avg("f1").alias("mean_f1"),
        F.stddev_pop("f1").alias("std_f1"),
        F.min("f1").alias("min_f1"),
        F.max("f1").alias("max_f1"),
    )
