"""Benchmark decontamination by winnowed fingerprints.

Of every run of ``span - gram + 1`` consecutive word grams the one with the
least hash is a fingerprint, in documents and in benchmark items alike, so two
texts that share ``span`` words share a fingerprint at the same place.  Only
these (about two in ten grams) are joined; each hit is then extended to the
full windows around it, which are compared by 128 bits of hash.  Items shorter
than ``span`` words are windows of their own length and are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import ascii_lower, keyed, let, letter_words, plain_id

SPAN = 13
GRAM = 5
_LOW = 20  # bits of a packed fingerprint that hold its position


def lower_words(text: Column) -> Column:
    return F.transform(letter_words(text), ascii_lower)


def word_hashes(text: Column) -> Column:
    return F.transform(letter_words(text), lambda w: F.xxhash64(ascii_lower(w)))


def _winnowed(hashes: Column, span: int, gram: int) -> Column:
    """At each window the packed (hash, position) of its least gram, null where it repeats the one before."""
    reach = span - gram
    high, low = F.lit(-1 << _LOW), F.lit((1 << _LOW) - 1)

    def grams(h: Column) -> Column:
        heads = F.slice(h, 1, F.greatest(F.size(h) - (gram - 1), F.lit(0)))
        return F.transform(
            heads,
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, gram)]).bitwiseAND(high).bitwiseOR(
                i.cast("long").bitwiseAND(low)
            ),
        )

    def least(g: Column) -> Column:
        heads = F.slice(g, 1, F.greatest(F.size(g) - reach, F.lit(0)))
        if not reach:
            return heads
        return F.transform(heads, lambda x, j: F.least(x, *[F.get(g, j + k) for k in range(1, reach + 1)]))

    def changes(m: Column) -> Column:
        return F.transform(m, lambda x, j: F.when((j == 0) | (F.get(m, j - 1) != x), x))

    return let(hashes, lambda h: let(grams(h), lambda g: let(least(g), changes)))


def fingerprints(df: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Rows (id, rk, at, fp) of the winnowed grams of ``df`` (id, rk, text)."""
    place, packed = F.col("_j").cast("long"), F.col("_packed")
    return (
        df.select("id", "rk", F.posexplode(_winnowed(word_hashes(F.col("text")), span, gram)).alias("_j", "_packed"))
        .filter(packed.isNotNull())
        .select(
            "id", "rk",
            (place + F.pmod(packed.bitwiseAND(F.lit((1 << _LOW) - 1)) - place, F.lit(1 << _LOW))).cast("int").alias("at"),
            F.shiftright(packed, _LOW).alias("fp"),
        )
    )


def _window_key(words: Column, start: Column, n: int) -> Column:
    """Two independent hashes of the words at ``start``."""
    return let(
        F.array_join(F.slice(words, start + 1, n), " "),
        lambda s: F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(n), s, F.lit(n)).alias("h2")),
    )


def _windows(df: DataFrame, n: int, starts=None) -> DataFrame:
    """Every window of ``n`` words of ``df`` (or those at ``starts``) as (…, at, h1, h2)."""
    others = [c for c in df.columns if c not in ("text", "_starts")]
    all_starts = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))))
    cells = let(
        lower_words(F.col("text")),
        lambda w: F.transform(
            starts if starts is not None else all_starts(w),
            lambda s: F.struct(s.alias("at"), _window_key(w, s, n).alias("key")),
        ),
    )
    return df.select(*others, F.explode(cells).alias("_c")).select(*others, "_c.at", "_c.key.h1", "_c.key.h2")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """Spans of each document that occur in an item: (id, rk, spans, items).

    Only documents with a hit have a row.  ``spans`` are sorted (start, end)
    pairs in words, one per matching window; ``items`` the sorted ids, as
    strings, of the items with a matching window.  Null and empty texts have no
    words; an item with a null id counts under the empty string; repeated rows
    of documents or items change nothing.
    """
    d = keyed(docs, id_col, text_col)
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    sized = named.withColumn("_n", F.size(letter_words(F.col("text"))))
    # at most span - 1 numbers
    short = sorted(r[0] for r in sized.filter((F.col("_n") > 0) & (F.col("_n") < span)).select("_n").distinct().collect())

    def known(n: int) -> DataFrame:
        rows = sized.filter(F.col("_n") == n if n < span else F.col("_n") >= span).select("item", "text")
        found = _windows(rows, n).groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("items"))
        return found.withColumn("of", F.xxhash64(F.array_join("items", "\n"), F.size("items")))

    marks = (
        fingerprints(sized.filter(F.col("_n") >= span).select(F.lit(0).alias("id"), F.lit(0).alias("rk"), "text"), span, gram)
        .select("fp").distinct()
    )
    hits = fingerprints(d, span, gram).join(marks, "fp", "left_semi")
    reach = span - gram
    around = hits.groupBy("id", "rk").agg(F.collect_set("at").alias("_at"))
    starts = F.array_distinct(
        F.flatten(F.transform("_at", lambda p: F.sequence(F.greatest(p - reach, F.lit(0)), p)))
    )
    long_known = known(span)
    # a start near the end of the text may leave fewer than span words: such a key matches no window of span words
    rows = [
        _windows(d.join(around, ["id", "rk"]).withColumn("_starts", starts).drop("_at"), span, F.col("_starts"))
        .join(long_known.select("h1", "h2", "of"), ["h1", "h2"])
        .select("id", "rk", "of", F.struct("at", (F.col("at") + span).alias("end")).alias("_span"))
    ]
    tables = [long_known.select("of", "items")]
    for n in short:
        whole = known(n)
        rows.append(
            _windows(d, n).join(whole.select("h1", "h2", "of"), ["h1", "h2"])
            .select("id", "rk", "of", F.struct("at", (F.col("at") + n).alias("end")).alias("_span"))
        )
        tables.append(whole.select("of", "items"))
    found, sets = rows[0], tables[0]
    for r, t in zip(rows[1:], tables[1:]):
        found, sets = found.unionByName(r), sets.unionByName(t)
    per_doc = found.groupBy("id", "rk").agg(F.array_sort(F.collect_set("_span")).alias("spans"), F.collect_set("of").alias("_of"))
    named_items = (
        per_doc.select("id", "rk", F.explode("_of").alias("of"))
        .join(sets.dropDuplicates(["of"]), "of")
        .groupBy("id", "rk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    return per_doc.select("id", "rk", "spans").join(named_items, ["id", "rk"])


def covered(spans: Column) -> Column:
    """Words covered by sorted (at, end) pairs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.coalesce(
        F.aggregate(
            spans, start,
            lambda a, s: F.struct(
                (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["at"]))).alias("n"),
                F.greatest(a["end"], s["end"]).alias("end"),
            ),
            lambda a: a["n"],
        ),
        F.lit(0).cast("long"),
    )


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least one word in twenty lies in a window
    of an item.  A document without words, or a null text, is clean.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = contamination(docs, items, **options).select(
        "id", "rk", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        keyed(docs, id_col, text_col)
        .select("id", "rk", F.size(letter_words(F.col("text"))).cast("long").alias("n_words"))
        .join(found, ["id", "rk"], "left")
        .select(
            plain_id().alias("doc_id"), "rk", "n_words", n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )
