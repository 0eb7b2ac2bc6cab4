"""Schema reconciliation: score raw names against a target schema, keep the best, rename in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A target schema is a short list of names; a longer one isn't broadcast.
BROADCAST_NAMES = 10_000


def pattern_score(target: Column, raw: Column) -> Column:
    """1.0 equal, 0.8 contained, 0.6 same first three and last two characters, 0.5 same vowels (two or more), else 0."""
    t, r = F.lower(target), F.lower(raw)
    ends = (F.length(t) >= 5) & (F.length(r) >= 5) & (F.left(t, F.lit(3)) == F.left(r, F.lit(3))) & (F.right(t, F.lit(2)) == F.right(r, F.lit(2)))
    vowels_t, vowels_r = (F.regexp_replace(x, "[^aeiou]", "") for x in (t, r))
    same_vowels = (vowels_t == vowels_r) & (F.length(vowels_t) >= 2)
    return F.when(t == r, 1.0).when(r.contains(t) | t.contains(r), 0.8).when(ends, 0.6).when(same_vowels, 0.5).otherwise(0.0)


def edit_score(target: Column, raw: Column) -> Column:
    """One minus edit distance over the longer length."""
    longest = F.greatest(F.length(target), F.length(raw), F.lit(1))
    return 1.0 - F.levenshtein(F.lower(target), F.lower(raw)) / longest


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def best_match(raw: DataFrame, targets: DataFrame, score: Callable[[Column, Column], Column], raw_col: str = "raw", target_col: str = "target", idx_col: str = "idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """The best target of each raw row; ties go to the target that stands first. One aggregation, no sort."""
    schema = targets.select(F.col(idx_col).alias("__idx"), F.col(target_col).alias("__target"), *[F.col(c) for c in targets.columns if c not in (idx_col, target_col)])
    names = [*keys, raw_col]
    pairs = raw.crossJoin(F.broadcast(schema) if targets.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else schema)
    scored = pairs.withColumn("__score", score(F.col("__target"), F.col(raw_col)))
    best = scored.groupBy(*names).agg(F.max_by(F.struct("__target", "__score"), F.struct("__score", -F.col("__idx"))).alias("__best"))
    return best.select(*names, F.col("__best.__target").alias("match"), F.col("__best.__score").alias("confidence"))


def accept(matches: DataFrame, threshold: float = 0.45, strict: bool = False) -> DataFrame:
    """The confidence is kept where the match is rejected."""
    ok = F.col("confidence") > threshold if strict else F.col("confidence") >= threshold
    return matches.withColumn("match", F.when(ok, F.col("match")))


def scorer(method: str) -> Callable[[Column, Column], Column]:
    """The scoring function of a method: pattern, edit or characters."""
    from ..functions import text

    known = {"pattern": pattern_score, "edit": edit_score, "characters": text.ratio}
    if method not in known:
        raise ValueError(f"unknown method: {method}; there are {', '.join(known)}")
    return known[method]


def _blocks(targets: DataFrame, most: int = BROADCAST_NAMES) -> DataFrame:
    """The rows of a target schema as arrays (__targets) of about most at most: one row, unless the schema is very long."""
    n = targets.limit(most + 1).count()
    if n > most:
        n = targets.count()
    block = F.pmod(F.xxhash64("target"), F.lit(-(-n // most) or 1))
    return targets.groupBy(block.alias("__block")).agg(F.collect_list(F.struct(*targets.columns)).alias("__targets"))


def best_vector(raw: DataFrame, targets: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The target (target, idx, g) of the greatest cosine to each raw vector, to six places; ties go to the smallest idx. Targets
    meet rows as arrays, so rows are scored in a projection and only met again where there are several blocks."""
    score = lambda t: F.struct(F.round(cosine(F.col(vector), t["g"]), 6).alias("score"), (-t["idx"]).alias("order"), t["target"].alias("target"))
    blocks = _blocks(targets.select("target", "idx", "g"))
    scored = raw.crossJoin(F.broadcast(blocks)).select(key, F.array_max(F.transform("__targets", score)).alias("__b"))
    best = scored.groupBy(key).agg(F.max("__b").alias("__b"))
    return best.select(key, F.col("__b.target").alias("match"), F.col("__b.score").alias("confidence"))


def best_by_name(raw: DataFrame, targets: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """The target name of the greatest score for each distinct raw name; ties go to the first name in the alphabet."""
    pick = lambda t: F.struct((-score(t["target"], F.col("raw"))).alias("score"), t["target"].alias("target"))
    scored = raw.crossJoin(F.broadcast(_blocks(targets.select("target")))).select("raw", F.array_min(F.transform("__targets", pick)).alias("__b"))
    best = scored.groupBy("raw").agg(F.min("__b").alias("__b"))
    return best.select("raw", F.col("__b.target").alias("match"), (-F.col("__b.score")).alias("confidence"))


def tiered(raw: DataFrame, learned: DataFrame, fallback: DataFrame) -> DataFrame:
    """raw (raw), learned (raw, target), fallback (raw, match, confidence): exact learned names first, then the fallback. Learned
    mappings grow with feedback, so the join is left to Spark, which broadcasts what is small."""
    out = raw.join(learned.withColumnRenamed("target", "__learned"), "raw", "left").join(fallback, "raw", "left")
    known = F.col("__learned").isNotNull()
    return out.select(
        "raw",
        F.coalesce("__learned", "match").alias("match"),
        F.when(known, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(known, "learned").when(F.col("match").isNotNull(), "scored").otherwise("none").alias("method"),
    )


def tiers(raw: DataFrame, exact: DataFrame, fuzzy: DataFrame, plain: DataFrame, key: str) -> DataFrame:
    """exact (key, learned), then fuzzy, then plain (key, match, confidence), each accepted already; with the method that decided."""
    out = raw.join(exact, key, "left")
    for name, tier in (("fuzzy", fuzzy), ("plain", plain)):
        out = out.join(tier.select(key, F.col("match").alias(name), F.col("confidence").alias(f"{name}_confidence")), key, "left")
    case = lambda *xs: F.when(F.col("learned").isNotNull(), xs[0]).when(F.col("fuzzy").isNotNull(), xs[1])
    return out.select(
        key,
        F.coalesce("learned", "fuzzy", "plain").alias("match"),
        case(F.lit(1.0), F.col("fuzzy_confidence")).otherwise(F.col("plain_confidence")).alias("confidence"),
        case(F.lit("learned"), F.lit("fuzzy")).when(F.col("plain").isNotNull(), "scored").otherwise("none").alias("method"),
    )


class Collision(ValueError):
    """Two raw columns resolve to one target."""


def resolve_columns(columns: list[str], targets: list[str], score: Callable[[str, str], float], threshold: float = 0.45) -> dict[str, tuple[str, float]]:
    """Driver-side: column names are metadata, so no data is touched. raw -> (target, confidence)."""
    found = {}
    for raw in columns:
        value, at = max(((score(t, raw), -i) for i, t in enumerate(targets)), default=(0.0, 0))
        if targets and value >= threshold:
            found[raw] = (targets[-at], round(value, 2))
    return found


def apply_mapping(df: DataFrame, mapping: dict[str, tuple[str, float]], collision: str = "error") -> DataFrame:
    """Rename in one select, which keeps column pruning. collision: error, coalesce or best_confidence."""
    if collision not in ("error", "coalesce", "best_confidence"):
        raise ValueError(f"unknown collision policy: {collision}")
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(mapping[c][0] if c in mapping else c, []).append(c)
    out = []
    for name, raws in groups.items():
        if len(raws) > 1 and collision == "error":
            raise Collision(f"{', '.join(raws)} all resolve to {name}")
        if len(raws) > 1 and collision == "best_confidence":
            raws = [max(raws, key=lambda c: mapping.get(c, (c, 1.0))[1])]
        cols = [F.col("`" + c.replace("`", "``") + "`") for c in raws]
        out.append((F.coalesce(*cols) if len(cols) > 1 else cols[0]).alias(name))
    return df.select(*out)


def python_pattern_score(target: str, raw: str) -> float:
    """pattern_score for names on the driver."""
    t, r = target.lower(), raw.lower()
    only = lambda s: "".join(c for c in s if c in "aeiou")
    checks = (
        (t == r, 1.0),
        (t in r or r in t, 0.8),
        (min(len(t), len(r)) >= 5 and (t[:3], t[-2:]) == (r[:3], r[-2:]), 0.6),
        (only(t) == only(r) and len(only(t)) > 1, 0.5),
    )
    return next((value for ok, value in checks if ok), 0.0)
