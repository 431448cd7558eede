"""Entities of state registers that federal filings don't show: who they are, scores, report; and where states' records are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.operators.linkage import holds

# What raises a score.
SHELL_WORDS = ("holdings", "properties", "investments", "ventures", "capital", "partners", "associates", "enterprises", "international", "global", "overseas", "pacific", "atlantic", "highland", "meadow", "ranch")
PRIVACY_STATES = ("DE", "NV", "WY", "SD")
VEHICLES = ("LP", "LLC", "LLP", "Trust")
AGENTS = ("ct corporation", "national registered agents", "registered agents inc", "cogency global", "corporation service company", "csc", "united agent group", "northwest registered agent")
#: Federal names of this length or less don't count as parts of others.
SHORT = 5


def federal_names(edges: DataFrame) -> DataFrame:
    """name (upper case) of every end of an edge, with type and relationship of the last edge (by seq) that it is the source of."""
    src = edges.filter("source <> ''").groupBy(F.upper("source").alias("name")).agg(F.max_by(F.struct(F.col("source_type").alias("type"), "relationship"), "seq").alias("_r"))
    tgt = edges.filter("target <> ''").select(F.upper("target").alias("name")).distinct()
    return tgt.join(src, "name", "full").select("name", "_r.type", "_r.relationship")


def known_names(names: DataFrame, federal: DataFrame) -> DataFrame:
    """_n: those of names (_n, upper case) that federal names (_f) show: equal ones, and those inside a name of more than SHORT characters or around one."""
    long = federal.filter(F.length("_f") > SHORT)
    inside = holds(names, long, "_n", "_f").select("_n").union(holds(long, names, "_f", "_n").select("_n"))
    return inside.union(names.join(federal, F.col("_n") == F.col("_f"), "left_semi").select("_n")).distinct()


def gaps(entities: DataFrame, federal: DataFrame) -> DataFrame:
    """State entities (name, state, entity_type, jurisdiction_of_formation, registered_agent, officers, formation_date, seq) without a federal name: none equal in any case, none of more than SHORT characters inside the other.

    With gap_type, risk_score (1 at most), risk_indicators in order, and notes.
    """
    known = federal.select(F.col("name").alias("_f")).distinct()
    shown = known_names(entities.select(F.upper("name").alias("_n")).distinct(), known)
    return scored(entities, shown, known.filter(F.length("_f") > SHORT))


def scored(entities: DataFrame, shown: DataFrame, long: DataFrame) -> DataFrame:
    """Entities whose upper-case name is not among those shown (_n), with scores. An empty name is inside any long federal name."""
    left = entities.withColumn("_n", F.upper("name")).join(shown, "_n", "left_anti")
    if not long.isEmpty():
        left = left.filter("_n <> ''")
    low = F.lower("name")
    shells = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in SHELL_WORDS]))
    formation = F.coalesce("jurisdiction_of_formation", F.lit(""))
    agent = F.lit(False)
    for a in AGENTS:
        agent = agent | F.contains(F.lower(F.coalesce("registered_agent", F.lit(""))), F.lit(a))
    vehicle = F.coalesce(F.col("entity_type").isin(*VEHICLES), F.lit(False))
    foreign = (formation != "") & (formation != F.col("state"))
    private = F.coalesce(F.col("state").isin(*PRIVACY_STATES), F.lit(False))
    score = 0.2 * F.size(shells) + F.when(private, 0.3).otherwise(0.0) + F.when(vehicle, 0.2).otherwise(0.0) + F.when(foreign, 0.3).otherwise(0.0) + F.when(agent, 0.1).otherwise(0.0)
    told = [
        F.when(F.size(shells) > 0, F.concat(F.lit("shell_name_pattern: "), F.array_join(shells, ", "))), F.when(private, F.concat(F.lit("privacy_state: "), "state")), F.when(vehicle, F.concat(F.lit("layering_vehicle: "), "entity_type")),
        F.when(foreign, F.concat(F.lit("foreign_formation: "), formation)), F.when(agent, F.lit("commercial_registered_agent")),
    ]
    notes = F.coalesce(F.concat(F.lit("Formation: "), F.nullif("formation_date", F.lit(""))), F.lit(""))
    return left.select(
        F.col("name").alias("entity_name"), "state", "entity_type", F.when(vehicle, "private_only").otherwise("no_sec_filing").alias("gap_type"), F.least(F.lit(1.0), score).alias("risk_score"), F.array_compact(F.array(*told)).alias("risk_indicators"),
        "registered_agent", "officers", notes.alias("notes"), "seq",
    )


def buckets(found: DataFrame) -> DataFrame:
    """One row: gaps with a high (0.6 or more), medium (0.3 or more) and low score."""
    s = F.col("risk_score")
    return found.agg(F.count_if(s >= 0.6).alias("high"), F.count_if((s >= 0.3) & (s < 0.6)).alias("medium"), F.count_if(s < 0.3).alias("low"))


def report(found: DataFrame, n_federal: int, n_state: int, states: list[str], most: int = 50) -> str:
    """The gap report as text; the highest scores first, ties in the order of seq."""
    n = buckets(found).first()
    rule = "=" * 70
    lines = [rule, "FEDERAL/STATE VISIBILITY GAP ANALYSIS", rule, f"SEC entities tracked: {n_federal}", f"State entities examined: {n_state}", f"States ingested: {', '.join(sorted(states)) or 'none'}"]
    lines += [f"Gaps identified: {sum(n)}", "", f"High risk (score >= 0.6): {n['high']}", f"Medium risk (0.3-0.6):   {n['medium']}", f"Low risk (< 0.3):        {n['low']}", ""]
    top = found.filter("risk_score >= 0.6").orderBy(F.desc("risk_score"), "seq").limit(most).collect()  # a report's top rows
    if top:
        lines += ["-" * 70, "HIGH RISK GAPS", "-" * 70]
    for g in top:
        lines += ["", f"  {g['entity_name']}", f"    State: {g['state']} | Type: {g['entity_type']} | Score: {g['risk_score']:.2f}", f"    Risk: {', '.join(g['risk_indicators'])}"]
        lines += [f"    Agent: {g['registered_agent']}"] if g["registered_agent"] else []
        lines += [f"    Officers: {', '.join(g['officers'][:5])}"] if g["officers"] else []
        lines += [f"    Notes: {g['notes']}"] if g["notes"] else []
    return "\n".join(lines)


# By which way each state's register can be read; a record costs nothing but where COSTS has it.
ACCESS = {
    "api": ("CA", "CO", "CT", "DE", "MA", "MI", "OR", "PA", "WA"),
    "bulk": ("AK", "FL", "GA", "IL", "IN", "IA", "KS", "MD", "MN", "MO", "NE", "NH", "NJ", "NC", "OH", "OK", "SC", "TN", "UT", "VA", "WI"),
    "web": ("AL", "AZ", "AR", "HI", "ID", "KY", "LA", "ME", "MS", "MT", "NV", "NM", "NY", "ND", "RI", "SD", "VT", "WV", "WY", "DC"),
    "paywall": ("TX",),
    "restricted": (),
}
COSTS = {"TX": 1.0}


def registers(spark, access: dict = ACCESS, costs: dict = COSTS) -> DataFrame:
    """state, tier, cost_per_record, ord."""
    rows = [(s, t, float(costs.get(s, 0.0)), i) for i, (t, s) in enumerate((t, s) for t, states in access.items() for s in states)]
    return spark.createDataFrame(rows, "state string, tier string, cost_per_record double, ord int")


def by_access(registers: DataFrame, *tiers: str) -> DataFrame:
    """Registers of these tiers, tier by tier; free ones are api and bulk."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    return registers.filter(F.col("tier").isin(*tiers)).orderBy(place, "ord")


def coverage(registers: DataFrame, tiers=tuple(ACCESS)) -> DataFrame:
    """tier, n: every tier, those without a state too."""
    every = registers.sparkSession.createDataFrame([(t,) for t in tiers], "tier string")
    return every.join(registers.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cost(requests: DataFrame, registers: DataFrame) -> DataFrame:
    """requests (state, n) with what they cost; unknown states cost nothing."""
    known = registers.select(F.upper("state").alias("_s"), "cost_per_record")
    return requests.join(known, F.upper("state") == F.col("_s"), "left").withColumn("cost", F.coalesce("cost_per_record", F.lit(0.0)) * F.col("n")).drop("_s", "cost_per_record")
