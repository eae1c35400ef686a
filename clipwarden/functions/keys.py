"""Names, classes and reproducible splits derived from keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def location(stem: Column) -> Column:
    """First two underscore tokens: the site that owns the zone map."""
    return F.substring_index(stem, "_", 2)


def place_code(stem: Column) -> Column:
    return F.get(F.split(stem, "_"), 2)


def clip_place(stem: Column) -> Column:
    """Clip token and place token; the whole stem when it has fewer than three."""
    part = F.split(stem, "_")
    return F.when(F.size(part) >= 3, F.concat_ws("_", F.get(part, 0), F.get(part, 2))).otherwise(stem)


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


# fixed values: words in the names of experiments and of run folders, in order of precedence
EXPERIMENT_WORDS = (
    ("fall", "(?i)fall|posec3d"),
    ("loiter", "(?i)loiter|배회"),
    ("intrusion", "(?i)intru|person_v|침입"),
)
RUN_WORDS = (
    ("intrusion", "(?i)intrusion|침입"),
    ("loiter", "(?i)loiter|roam|배회"),
    ("fall", "(?i)fall|faint|collapse|쓰러"),
)
DEFAULT_ITEM = "fire"
# fixed values: words in the path of a scoring clip that decide its mode
FIRE_PATH, PERSON_PATH = "방화", "침입|배회|쓰러짐"


def _first_match(name: Column, words) -> Column:
    expr = F.lit(DEFAULT_ITEM)
    for item, pattern in reversed(words):
        expr = F.when(name.rlike(pattern), item).otherwise(expr)
    return expr


def item_of(name: Column) -> Column:
    """Event item of an experiment or file name; the first matching rule wins."""
    return _first_match(name, EXPERIMENT_WORDS)


def item_of_run(name: Column, stated: Column | None = None) -> Column:
    """Event item of a run folder: what its metadata state, else by its name, with words and precedence of its own."""
    found = _first_match(name, RUN_WORDS)
    return found if stated is None else F.coalesce(F.nullif(stated, F.lit("")), found)


def clip_mode(path: Column, fallback: Column) -> Column:
    """Mode of a scoring clip by the folders it lies in, else that of its category."""
    return F.when(path.contains(FIRE_PATH), "fire").when(path.rlike(PERSON_PATH), "person").otherwise(fallback)


def md5_fraction(key: Column) -> Column:
    """First 32 bits of md5 as a share of the largest value."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def md5_split(key: Column, val_share: float) -> Column:
    return F.when(md5_fraction(key) < val_share, "val").otherwise("train")


def md5_mod20(key: Column) -> Column:
    """The 128-bit md5 modulo 20 without big integers.

    Every power of 16 is 16 modulo 20, so all hex digits but the last count
    sixteen-fold.
    """
    digest = F.md5(key)
    digits = F.transform(
        F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(digest.substr(i, F.lit(1)), 16, 10).cast("int")
    )
    head = F.aggregate(F.slice(digits, 1, 31), F.lit(0), lambda acc, d: acc + d)
    return (head * 16 + F.element_at(digits, 32)) % 20


def safe_relative(path: Column) -> Column:
    """False for paths that could leave the data root."""
    return ~(path.contains("..") | path.startswith("/"))


# fixed values: words that name a class when the contract has no mapping
CLASS_WORDS = {
    "fire": (("fire", "flame", "화염", "불"), 0),
    "smoke": (("smoke", "연기"), 1),
    "person": (("person", "human", "pedestrian", "people", "사람"), 0),
}


def map_class(key: Column, name: Column, mode: Column, classes: Column) -> Column:
    """Source class to our class id, NULL to drop.

    ``classes`` (``map<string,string>``) decides first by id, then by name, then
    by lower-case name; its value ``drop`` drops.  Otherwise words in the name
    decide inside the mode.  A mapping without a matching key drops; without a
    mapping, person mode falls back to 0 and fire mode drops.
    """
    mapped = F.coalesce(
        F.element_at(classes, key.cast("string")), F.element_at(classes, name), F.element_at(classes, F.lower(name))
    )
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(key.cast("string"), F.lit("none"))))
    by_word = F.lit(None).cast("int")
    for group, (words, cls) in reversed(CLASS_WORDS.items()):
        in_mode = (mode == "person") if group == "person" else (mode == "fire")
        by_word = F.when(in_mode & text.rlike("|".join(words)), cls).otherwise(by_word)
    has_map = classes.isNotNull() & (F.size(classes) > 0)
    fallback = F.when(~has_map & (mode == "person"), 0)
    return F.when(mapped.isNotNull(), F.when(F.lower(mapped) != "drop", mapped.cast("int"))).otherwise(
        F.coalesce(by_word, fallback)
    )


def named_class(name: Column) -> Column:
    """Wildfire name rules: flames 0, clouds and fog dropped, smoke 1."""
    # fixed values: source class words
    return F.when(name.contains("화염"), 0).when(name.rlike("구름|안개"), None).when(name.contains("연기"), 1)
