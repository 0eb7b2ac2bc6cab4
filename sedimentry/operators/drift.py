"""Deterministic name drift and matcher metrics. Choices come from integer arithmetic on an id, never from a generator,
so results don't depend on partitions and can be repeated in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Our own lexicon of stand-ins for the parts of names.
TOKENS = {"pressure": "bar", "engine": "powerplant", "brake": "retarder", "tyre": "rubber", "level": "gauge", "polished": "shiny"}
SUFFIXES = ("_s1", "_logged", "_b", "_alt")
PREFIXES = ("in_", "dev_", "k_")


def pick(choices: tuple[str, ...], seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(seed, F.lit(len(choices))) + 1).cast("int"))


def swap_tokens(name: Column, tokens: dict[str, str] = TOKENS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair])
    return F.array_join(F.transform(F.split(name, "_"), lambda t: F.coalesce(F.try_element_at(table, t), t)), "_")


def add_noise(name: Column, seed: Column) -> Column:
    return F.when(F.pmod(seed, F.lit(2)) == 0, F.concat(name, pick(SUFFIXES, seed))).otherwise(F.concat(pick(PREFIXES, seed), name))


def cut(name: Column, seed: Column, least: int = 3) -> Column:
    """A prefix of least characters or more; short names stay."""
    room = F.length(name) - least
    return F.when(room > 0, F.left(name, (F.lit(least) + F.pmod(seed, F.greatest(room, F.lit(1)))).cast("int"))).otherwise(name)


def drop_characters(name: Column, seed: Column) -> Column:
    """Without one to three characters at places spread by the seed; names up to three characters stay."""
    n = F.length(name)
    most = F.least(F.lit(3), n - 2)
    gone = F.pmod(seed, F.greatest(most, F.lit(1))) + 1
    place = lambda i: F.pmod(i.cast("bigint") * 7 + seed * 3, n.cast("bigint"))
    kept = F.filter(F.split(name, ""), lambda c, i: place(i) >= gone)
    return F.when(n > 3, F.array_join(kept, "")).otherwise(name)


def kind_of(seed: Column, shares=((40, "synonyms"), (75, "noise"))) -> Column:
    """Weighted choice of the kind of drift out of a hundred."""
    roll = F.pmod(seed * 37, F.lit(100))
    return F.when(roll < shares[0][0], shares[0][1]).when(roll < shares[1][0], shares[1][1]).otherwise("truncation")


def corrupt(name: Column, seed: Column) -> Column:
    kind = kind_of(seed)
    return F.when(kind == "synonyms", swap_tokens(name)).when(kind == "noise", add_noise(name, seed)).otherwise(drop_characters(name, seed))


def toggled(sample_id: Column, every: int = 50) -> Column:
    """A state that flips at every multiple of every, without keeping state."""
    return F.pmod(F.floor(sample_id / every), F.lit(2)) == 1


def unit(seed: Column, salt: int = 0) -> Column:
    """A value in 0..1 spread by a seed, by integer arithmetic that SQL can repeat."""
    return F.pmod(seed * 7919 + salt * 104_729, F.lit(1000)) / 1000.0


def contained_synonym(name: Column, seed: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """A stand-in for the first word of the lexicon that contains the name or that the name contains; else the name."""
    out = name
    for word, others in reversed(lexicon.items()):
        out = F.when(name.contains(word) | F.lit(word).contains(name), pick(others, seed)).otherwise(out)
    return out


def by_intensity(name: Column, seed: Column, intensity: float) -> Column:
    """Synonyms, then noise, then truncation, each with the odds of the intensity."""
    for salt, step in enumerate((swap_tokens, lambda x: add_noise(x, seed), lambda x: cut(x, seed))):
        name = F.when(unit(seed, salt + 1) < intensity, step(name)).otherwise(name)
    return name


def thinned(rows: DataFrame, seed: Column, frequency: float) -> DataFrame:
    """Each row with the odds of the frequency; works on static and streaming frames."""
    if not 0.0 <= frequency <= 1.0:
        raise ValueError("frequency must lie in 0..1")
    return rows.where(unit(seed, 9) < frequency)


def batch(fields: DataFrame, name: str, size: int, intensity: float, seed: int = 0) -> DataFrame:
    """size drifted names, going round the fields in the order of their names; the same seed gives the same batch."""
    spark = fields.sparkSession
    listed = [r[0] for r in fields.select(name).distinct().orderBy(name).collect()]  # a schema's names
    rows = spark.range(size).withColumn("name", pick(tuple(listed), F.col("id")))
    return rows.withColumn("drifted", by_intensity(F.col("name"), F.col("id") + seed, intensity))


def relabel_keys(packet: Column, active: Column, names: dict[str, str]) -> Column:
    """A packet's keys under other names while active; keys without another name stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(active, F.transform_keys(packet, lambda k, _: F.coalesce(F.try_element_at(table, k), k))).otherwise(packet)


def renamed_between(packet: Column, row: Column, first: int, last: int, names: dict[str, str]) -> Column:
    """Keys renamed in a span of rows of a replay."""
    return relabel_keys(packet, row.between(first, last), names)


def calibrated(weights: dict[str, float], accuracy: dict[str, float], target: float) -> dict[str, float]:
    """Shares of the kinds of drift under which the expected accuracy is the target: every weight is multiplied by a power of a
    base that grows with how well its kind is matched, and the base is found by halving; targets out of reach give the nearest."""
    low, high = min(accuracy.values()), max(accuracy.values())
    if high == low:
        return dict(weights)

    def shares(tilt: float) -> dict[str, float]:
        made = {k: w * 2.0 ** (tilt * (accuracy[k] - low) / (high - low)) for k, w in weights.items()}
        total = sum(made.values())
        return {k: x / total for k, x in made.items()}

    a, z = -60.0, 60.0
    for _ in range(80):
        middle = (a + z) / 2
        if sum(x * accuracy[k] for k, x in shares(middle).items()) < target:
            a = middle
        else:
            z = middle
    return shares((a + z) / 2)


def accuracy_curves(levels: DataFrame, level: str = "drift_level") -> DataFrame:
    """Modelled accuracy of three kinds of matcher as names drift: vectors lose little, edits much, patterns nearly all."""
    d = F.col(level)
    curves = {"vector": 0.97 - 0.12 * d * d, "edit": 0.94 * (1.0 - d) + 0.12 * d, "pattern": F.exp(d * -4.0)}
    return levels.select(level, *[F.round(c, 6).alias(n) for n, c in curves.items()])


def trials(curves: DataFrame, runs: int, level: str = "drift_level") -> DataFrame:
    """The share of successes in so many trials at every level, a trial's luck coming from its number."""
    rows = curves.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    luck = F.pmod(F.col("run") * 7919 + 104_729, F.lit(1000)) / 1000.0
    names = [c for c in curves.columns if c != level]
    return rows.groupBy(level).agg(*[F.round(F.avg((luck < F.col(c)).cast("double")), 6).alias(c) for c in names])


def match_metrics(results: DataFrame) -> DataFrame:
    """results: method, kind, correct, confidence. Accuracy per method, and per method and kind, in one pass."""
    cube = results.groupingSets([["method"], ["method", "kind"]], "method", "kind")
    return cube.agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"), F.count(F.lit(1)).alias("n"))
