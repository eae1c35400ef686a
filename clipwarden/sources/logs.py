"""Scores and progress out of experiment and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import top_per_group

# Fixed values of the log format.  A score line states
#   <score> (정검 <hits> 미검 <misses> 오검 <false alarms>) <rule>   or   <rule> → <score> (…),
# a clip line "클립 <clip>: <verdict>", a live line "[<item>] 정검 … → 점수 <score>".
HIT, MISS, FALSE_ALARM = "정검", "미검", "오검"
CLIP, POINTS, ARROW_SIGN = "클립", "점수", "→"
PER_SECOND, SECONDS_EACH = "it/s", "s/it"
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
SECTION = "##########"
NEW_RULE_PREFIX = "신규칙"
EXCERPT = "정검|→|fold|평균|표준편차"
EXCERPT_BANNER = "Ultralytics"


def lines(docs: DataFrame, keys: Sequence[str] = ("file",), newline: str = r"\r?\n") -> DataFrame:
    """Documents to numbered lines without colour codes; the whole text is read."""
    clean = F.regexp_replace("text", ANSI, "")
    return docs.select(*keys, F.posexplode(F.split(clean, newline)).alias("line_no", "line"))


def _behind(text: Column, token: str) -> Column:
    """What follows the first ``token``, without blanks around; null where there is none."""
    return F.when(F.contains(text, F.lit(token)), F.trim(F.substring(text, F.instr(text, token) + len(token), F.length(text))))


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _number(text: Column, kind: str) -> Column:
    """The digits (and, for doubles, the point) a text starts with."""
    allowed = r"^[0-9.]*" if kind == "double" else r"^[0-9]*"
    return F.regexp_extract(text, allowed, 0).try_cast(kind)


def _counts(text: Column) -> dict[str, Column]:
    """Numbers behind the three count words."""
    return {
        name: _number(_behind(text, token), "int") for name, token in (("tp", HIT), ("fn", MISS), ("fp", FALSE_ALARM))
    }


def _before_counts(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("(" + HIT)), F.substring_index(line, "(" + HIT, 1))


def _last_word(text: Column) -> Column:
    return F.element_at(_words(F.replace(text, F.lit(ARROW_SIGN), F.lit(" "))), -1)


def stated_score(line: Column) -> Column:
    """The score a score line states, null for other lines."""
    return _number(_last_word(_before_counts(line)), "double")


def _whole_rows(parts: DataFrame, keys: Sequence[str], names: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """Rows with all ``needed`` columns; unlike a filter, this doesn't make Spark compute them twice."""
    whole = F.lit(True)
    for name in needed:
        whole = whole & F.col(name).isNotNull()
    return parts.select(*keys, F.inline(F.array_compact(F.array(F.when(whole, F.struct(*names))))))


def score_lines(log: DataFrame, arrow: bool = False, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Lines that state a score: rule, F1 and counts.

    The line is cut at the bracket with the counts; the score is the last word
    before it, the rule what follows it or, with ``arrow``, what precedes the arrow.
    """
    # a column a step, so that each is computed once; other lines are left at the first
    open_ = "(" + HIT
    found = log.filter(F.contains("line", F.lit(open_))).select(
        *keys, "line_no", _before_counts(F.col("line")).alias("_head"), _behind(F.col("line"), open_).alias("_tail")
    )
    tail = F.col("_tail")
    if arrow:
        score, rule = _behind(F.col("_head"), ARROW_SIGN), F.substring_index("_head", ARROW_SIGN, 1)
    else:
        score, rule = _last_word(F.col("_head")), _behind(tail, ")")
    counts = _counts(F.substring_index(F.concat(F.lit(HIT), tail), ")", 1))
    parts = found.select(*keys, "line_no", F.trim(rule).alias("rule"), score.alias("_score"), *[c.alias(n) for n, c in counts.items()])
    stated = F.when(F.contains("_score", F.lit(".")), _number(F.col("_score"), "double"))
    names = ["line_no", "rule", "f1", *counts]
    parts = parts.select(*keys, "line_no", "rule", stated.alias("f1"), *counts)
    return _whole_rows(parts, keys, names, ["f1", *counts])


def best_lines(scores: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """The best score per file, the earliest line on ties."""
    rest = [c for c in scores.columns if c not in keys]
    best = scores.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("f1", -F.col("line_no"))).alias("_b"))
    return best.select(*keys, "_b.*")


def best_old_rule(scores: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Best score among the rules of the old kind only."""
    return scores.groupBy(*keys).agg(
        F.max(F.when(~F.col("rule").startswith(NEW_RULE_PREFIX), F.col("f1"))).alias("score_old")
    )


def sections(docs: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Lines with the section they belong to; lines before the first header are dropped.

    The text is cut at its headers first and into lines second, so the running
    header needs no ordering and no shuffle.
    """
    clean = F.regexp_replace("text", ANSI, "")
    parts = docs.select(*keys, F.posexplode(F.split(clean, rf"(?m)^(?={SECTION})")).alias("section_no", "_s"))
    parts = parts.filter(F.col("_s").startswith(SECTION)).withColumn(
        "_l", F.split(F.regexp_replace("_s", r"\r?\n$", ""), r"\r?\n")
    )
    name = F.trim(F.replace(F.get("_l", 0), F.lit("#"), F.lit("")))
    return parts.select(*keys, "section_no", name.alias("section"), F.posexplode("_l").alias("line_no", "line")).filter(
        F.col("line_no") > 0
    )


def clip_verdict_lines(log: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Per-clip verdict lines; the last one of a clip counts."""
    words = _words(F.col("line"))
    named = F.get(words, F.lit(1))
    found = log.filter((F.get(words, F.lit(0)) == CLIP) & named.endswith(":") & (F.size(words) > 2)).select(
        *keys, "line_no", F.rtrim(named, F.lit(":")).alias("clip"), F.get(words, F.lit(2)).alias("verdict")
    )
    return found.groupBy(*keys, "clip").agg(F.max_by("verdict", "line_no").alias("verdict"))


def live_scores(log: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """The last live scoring line of every log."""
    line = F.col("line")
    found = log.filter(line.startswith("[")).select(
        *keys, "line_no", F.substring_index(F.substring_index(line, "]", 1), "[", -1).alias("item"),
        _number(_behind(_behind(line, ARROW_SIGN), POINTS), "double").alias("f1"), *[c.alias(n) for n, c in _counts(line).items()],
    ).dropna(subset=["f1", "tp", "fn", "fp"])
    rest = ["item", "f1", "tp", "fn", "fp"]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "line_no").alias("_b")).select(*keys, "_b.*")


def excerpts(log: DataFrame, keys: Sequence[str] = ("file",), last: int = 25) -> DataFrame:
    """The last lines worth quoting from every log."""
    worth = log.filter(F.col("line").rlike(EXCERPT) & ~F.col("line").contains(EXCERPT_BANNER)).withColumn("line", F.rtrim("line"))
    return top_per_group(worth, keys, [F.desc("line_no")], last, "from_end")


def _clock(text: Column) -> Column:
    """``mm:ss`` or ``h:mm:ss`` to seconds, 0 when unreadable."""
    numbers = F.transform(F.split(text, ":"), lambda p: p.try_cast("long"))
    total = F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, v: acc * 60 + v)
    return F.coalesce(total, F.lit(0))


_PROGRESS = ("epoch", "epochs", "pct", "it", "its", "speed", "eta")
_VALIDATION = ("precision", "recall", "map50", "map5095")


def _progress_and_validation(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_no, p, v): what a line states as a progress or a validation line, null where it is none.

    A progress line is ``epoch/epochs memory losses… : pct% bar it/its speed
    elapsed<left``; the colon parts what concerns the epoch from what concerns
    its steps.  A validation line is the word ``all``, images, objects,
    precision, recall and two mean precisions.  Words, then fields, are columns
    of their own, so that each line is cut up once.
    """
    line, colon = F.col("line"), F.contains(F.col("line"), F.lit(": "))
    words = log.select(
        *keys, "line_no", F.when(colon, _words(F.substring_index(line, ": ", 1))).alias("_l"), F.when(colon, _words(_behind(line, ": "))).alias("_r"),
        F.when(F.contains(line, F.lit("all")), _words(line)).alias("_w"),
    )
    number = lambda pair, i: F.get(pair, F.lit(i)).try_cast("int")
    is_steps = lambda w: w.contains("/") & number(F.split(w, "/"), 0).isNotNull() & number(F.split(w, "/"), 1).isNotNull()
    parts = words.select(
        *keys, "line_no", "_w", F.split(F.get("_l", F.lit(0)), "/").alias("_epoch"), F.get("_l", F.lit(1)).alias("_memory"), F.get("_r", F.lit(0)).alias("_pct"),
        F.get(F.filter("_r", lambda w: w.endswith(PER_SECOND) | w.endswith(SECONDS_EACH)), F.lit(0)).alias("_rate"),
        F.get(F.filter("_r", lambda w: w.contains("<")), F.lit(0)).alias("_times"),
        F.split(F.get(F.filter("_r", is_steps), F.lit(0)), "/").alias("_steps"),
    )
    fields = parts.select(
        *keys, "line_no", "_memory", "_pct", number("_epoch", 0).alias("epoch"), number("_epoch", 1).alias("epochs"), _number(F.col("_pct"), "int").alias("pct"),
        number("_steps", 0).alias("it"), number("_steps", 1).alias("its"), _number(F.col("_rate"), "double").alias("speed"),
        F.right("_rate", F.lit(len(PER_SECOND))).alias("unit"), F.get(F.split("_times", "<"), F.lit(1)).alias("eta"),
        F.get("_w", F.lit(0)).alias("_first"), *[F.get("_w", F.lit(3 + i)).try_cast("double").alias(n) for i, n in enumerate(_VALIDATION)],
    )
    progress, validation = F.col("_memory").endswith("G") & F.contains("_pct", F.lit("%")), F.col("_first") == "all"
    for name in _PROGRESS:
        progress = progress & F.col(name).isNotNull()
    for name in _VALIDATION:
        validation = validation & F.col(name).isNotNull()
    return fields.select(
        *keys, "line_no", F.when(progress, F.struct(*_PROGRESS, "unit")).alias("p"), F.when(validation, F.struct(*_VALIDATION)).alias("v")
    )


def training_progress(docs: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Last progress line and last validation line of every training log."""
    log = lines(docs, keys, r"[\r\n]+")
    read = _progress_and_validation(log, keys)
    last = read.groupBy(*keys).agg(
        F.max_by("p", F.when(F.col("p").isNotNull(), F.col("line_no"))).alias("p"),
        F.max_by("v", F.when(F.col("v").isNotNull(), F.col("line_no"))).alias("v"),
    )
    speed = F.when(F.col("p.unit") == PER_SECOND, F.col("p.speed")).otherwise(F.try_divide(F.lit(1.0), F.col("p.speed")))
    out = last.filter(F.col("p").isNotNull()).select(
        *keys, "p.epoch", "p.epochs", "p.pct", "p.it", "p.its", speed.alias("_speed"), _clock(F.col("p.eta")).alias("_eta"),
        "v.precision", "v.recall", "v.map50", "v.map5095",
    )
    minutes = F.coalesce(F.try_divide(F.col("its"), F.col("_speed")) / 60, F.lit(0.0))
    remain = F.col("_eta") + (F.col("epochs") - F.col("epoch")) * minutes * 60
    return out.withColumn("it_s", F.bround("_speed", 2)).withColumn("epoch_min", F.bround(minutes, 1)).withColumn(
        "remain_h", F.bround(remain / 3600, 1)
    ).drop("_speed", "_eta")


def training_history(csv: DataFrame, keys: Sequence[str] = ("name",), epoch: str = "epoch", metric: str = "map50") -> DataFrame:
    """Epoch count and the metric of the last epoch."""
    return csv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("epochs"), F.bround(F.max_by(metric, epoch), 4).alias("map50")
    )
