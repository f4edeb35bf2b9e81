"""Column functions: parsing, condition states, travel time, fragility, repair effects, costs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Repair options with cost and labour multiples and condition steps; rates by structure type.
OPTIONS = ("none", "minor", "major", "replace")
COST_MULTIPLE = {"none": 0.0, "minor": 1.0, "major": 4.0, "replace": 12.0}
LABOUR_MULTIPLE = {"none": 0.0, "minor": 1.0, "major": 2.5, "replace": 6.0}
RESET = {"none": 0.0, "minor": 0.5, "major": 2.0, "replace": 4.0}
BASE_COST_CRORE = {"culvert": 0.02, "minor_bridge": 0.08, "major_bridge": 0.25, "road_segment": 0.03}
LABOUR_DAYS = {"culvert": 5.0, "minor_bridge": 20.0, "major_bridge": 60.0, "road_segment": 8.0}
OUTAGE_DAYS = {"culvert": 10.0, "minor_bridge": 30.0, "major_bridge": 120.0, "road_segment": 7.0}
OUTAGE_OTHER = 30.0
RELIEF = 0.35
CLASS_SPEEDS = {"rural": 30.0, "state": 50.0, "national": 70.0}
#: Speeds by highway tag, km/h; the default of other tags.
HIGHWAY_SPEEDS = {
    "motorway": 80.0, "trunk": 65.0, "primary": 55.0, "secondary": 50.0, "tertiary": 45.0, "unclassified": 35.0,
    "residential": 30.0, "living_street": 20.0, "service": 25.0, "track": 15.0, "path": 10.0,
}
HIGHWAY_OTHER = 30.0


def number(c: Column) -> Column:
    """A number from a text cell; N, NA, N/A, empty and unparsable cells are null, as is NaN."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def structure_key(state: Column, structure: Column) -> Column:
    return F.concat_ws("|", F.trim(state), F.trim(structure))


def rating_state(rating: Column) -> Column:
    """0 Good (7 and more), 1 Fair (5), 2 Poor (3), 3 Severe; null stays null."""
    return F.when(rating.isNull() | F.isnan(rating.cast("double")), F.lit(None).cast("int")).when(rating >= 7, 0).when(rating >= 5, 1).when(rating >= 3, 2).otherwise(3)


def condition_state(*ratings: Column) -> Column:
    """The state of the lowest rating that applies; null if none does."""
    return rating_state(F.least(*ratings))


def age_at(year: Column, built: Column) -> Column:
    return F.when(year - built >= 0, year - built)


def years_since(year: Column, rehab: Column) -> Column:
    return F.when(rehab > 0, year - rehab)


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)))


def travel_minutes(length_m: Column, speed_kph: Column) -> Column:
    return checked(length_m / 1000.0 / speed_kph * 60.0, (length_m >= 0) & (speed_kph > 0), "lengths are >= 0 and speeds > 0")


def lookup(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def class_speed(road_class: Column, speeds: dict[str, float] | None = None) -> Column:
    found = lookup(road_class, speeds or CLASS_SPEEDS)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown road class "), F.coalesce(road_class, F.lit("null")))))


def highway_speed(tag: Column, overrides: dict[str, float] | None = None) -> Column:
    return lookup(tag, HIGHWAY_SPEEDS | (overrides or {}), HIGHWAY_OTHER)


def first_of(tags: Column) -> Column:
    """The head of a tag that may be a list."""
    return F.try_element_at(tags, F.lit(1))


def is_yes(tag: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(tag, F.lit("")))).isin("", "no", "false", "none", "nan")


def population_of(text: Column) -> Column:
    return number(F.regexp_replace(text, ",", ""))


def centroid(points: Column) -> Column:
    """Mean of an array of struct(x, y); null for none."""
    n = F.size(points)
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[f])
    return F.when(n > 0, F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y")))


def condition_score(state: Column) -> Column:
    return state.cast("double")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def failure_probability(condition: Column, rain: Column, b0: float = -3.0, b1: float = 1.2, b2: float = 2.0, reference: float = 1.0) -> Column:
    """Logit in the condition and the log of the rain ratio."""
    x = b0 + b1 * condition_score(condition) + b2 * F.ln(rain / reference)
    return checked(sigmoid(x), rain > 0, "rain ratios are > 0")


def fragility_factor(option: str) -> float:
    return math.exp(-RELIEF * RESET[option])


def apply_reset(state: Column, reset: Column | float) -> Column:
    """The state after ``reset`` steps of repair: halves go to the even state, 0 to 3."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.bround(state.cast("double") - reset).cast("int")))


def default_option(state: Column) -> Column:
    """The option that suits a state, by position in ``OPTIONS``: the state itself."""
    return state.cast("int")


def cost_table(spark: SparkSession, base: dict[str, float] | None = None, labour: dict[str, float] | None = None) -> DataFrame:
    """``structure_type, opt_ord, opt, cost, labour, reset, factor``: a row a type and option."""
    base, labour = base or BASE_COST_CRORE, labour or LABOUR_DAYS
    rows = [(t, j, o, base[t] * COST_MULTIPLE[o], labour[t] * LABOUR_MULTIPLE[o], RESET[o], fragility_factor(o)) for t in base for j, o in enumerate(OPTIONS)]
    return spark.createDataFrame(rows, "structure_type string, opt_ord int, opt string, cost double, labour double, reset double, factor double")


def with_costs(assets: DataFrame) -> DataFrame:
    """Each asset with each option, its cost, labour and effect; an unknown type is an error."""
    table = F.broadcast(cost_table(assets.sparkSession))
    out = assets.join(table, "structure_type", "left")
    message = F.concat(F.lit("unknown structure type "), F.coalesce("structure_type", F.lit("null")))
    return out.withColumn("cost", F.when(F.col("opt").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("cost")))


def emergency_cost(cost: Column, premium: Column | float = 1.8) -> Column:
    return cost * premium


def lost_per_crore(person_days: Column, spend: Column) -> Column:
    return F.when(spend > 0, person_days / spend).otherwise(F.lit(float("inf")))


def travel_share(minutes: Column, cap: Column) -> Column:
    """0 next to the facility, 1 at the cap, beyond it or without a way."""
    return F.coalesce(F.least(minutes / cap, F.lit(1.0)), F.lit(1.0))


def outage_days(structure_type: Column, override: Column | None = None) -> Column:
    by_type = lookup(structure_type, OUTAGE_DAYS, OUTAGE_OTHER)
    return by_type if override is None else F.coalesce(override, by_type)


def stressed(value: Column, factor: float) -> Column:
    if factor <= 0:
        raise ValueError("stress factors are > 0")
    return value * factor


def stress_to_level(value: Column, target: float, base_level: float) -> Column:
    if target <= 0 or base_level <= 0:
        raise ValueError("return levels are > 0")
    return value * (target / base_level)


def return_level(period: float, c: Column, loc: Column, scale: Column) -> Column:
    """Quantile 1 - 1/period of the generalised extreme value law (c > 0: bounded above)."""
    if period <= 1:
        raise ValueError("return periods are over one year")
    y = -math.log(1 - 1 / period)
    return F.when(F.abs(c) < 1e-9, loc - scale * math.log(y)).otherwise(loc + scale / c * (1 - F.pow(F.lit(y), c)))


def gev_cdf(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    z = (x - loc) / scale
    t = 1 - c * z
    inside = F.exp(-F.pow(F.when(t > 0, t), 1 / c))
    return F.when(F.abs(c) < 1e-9, F.exp(-F.exp(-z))).when(t > 0, inside).otherwise(F.when(c > 0, 1.0).otherwise(0.0))


def one_hot(option: Column, n: int = len(OPTIONS)) -> Column:
    return F.array(*((option == j).cast("double") for j in range(n)))


def arg_max(values: Column) -> Column:
    """Position of the largest entry, the first of several."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def state_index(name: Column) -> Column:
    at = F.array_position(F.array(*(F.lit(s) for s in ("Good", "Fair", "Poor", "Severe"))), name).cast("int")
    return F.when(at > 0, at - 1)
