"""Drug use around an index date, doses, restart and switch, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralith.functions.kernels import islands
from eralith.functions.quantiles import beside
from eralith.functions.sweeps import overlap_totals
from eralith.sources.clinical import Clinical

METRICS = ("number_exposures", "number_eras", "days_exposed", "days_prescribed", "time_to_exposure", "initial_exposure_duration", "initial_quantity", "cumulative_quantity", "initial_daily_dose", "cumulative_dose")


def _codes(concepts: DataFrame, repeats: bool) -> DataFrame:
    codes = concepts.select(F.col("concept_id").alias("drug_concept_id"))
    return codes if repeats else codes.distinct()


def exposures(c: Clinical, concepts: DataFrame, repeats: bool = False) -> DataFrame:
    """(_p, s, e, quantity, days_supply) of the exposures to the concepts; a missing or earlier end is the start.

    repeats: an exposure comes as often as the concepts hold its code.
    """
    d = c["drug_exposure"].join(_codes(concepts, repeats), "drug_concept_id")
    return d.select(F.col("person_id").alias("_p"), F.col("drug_exposure_start_date").alias("s"), F.greatest(F.coalesce("drug_exposure_end_date", "drug_exposure_start_date"), "drug_exposure_start_date").alias("e"), "quantity", "days_supply")


def add_drug_use(c: Clinical, cohort: DataFrame, concepts: DataFrame, gap: int = 30, censor: str = "cohort_end_date", incident: bool = True, ingredient: int | None = None, repeats: bool = False) -> DataFrame:
    """METRICS of each cohort row; counts and doses are 0 and times null where there is no exposure.

    Doses are those of the ingredient by strength (add_dose); without one, quantity a day. repeats: as in exposures.

    Exposures start (or overlap, if not incident) from the index date to the censor date. One join and one aggregate by the
    row; eras and days exposed are a fold over its few exposures, in order.
    """
    index, stop = F.col("cohort_start_date"), F.col(censor)
    lo = F.col("s") >= index if incident else F.col("e") >= index
    x = cohort.join(exposures(c, concepts, repeats), (F.col("subject_id") == F.col("_p")) & lo & (F.col("s") <= stop), "left")
    days = lambda a, b: F.datediff(b, a) + 1
    inside = F.when(F.col("_p").isNotNull(), F.struct(F.greatest("s", index).alias("s"), F.least("e", stop).alias("e")))
    first = F.min(F.when(F.col("_p").isNotNull(), F.struct("s", "e", "quantity", "days_supply")))
    m = x.groupBy(cohort.columns).agg(
        F.count("_p").alias("number_exposures"), F.sum(days("s", "e")).cast("long").alias("days_prescribed"), first.alias("_f"), F.sum("quantity").alias("cumulative_quantity"),
        F.sum(F.col("quantity") / days("s", "e") * days(F.greatest("s", index), F.least("e", stop))).alias("cumulative_dose"), F.array_sort(F.collect_list(inside)).alias("_x"),
    )
    folded = F.aggregate(
        "_x", F.struct(F.lit(None).cast("date").alias("end"), F.lit(0).cast("long").alias("eras"), F.lit(0).cast("long").alias("days")),
        lambda a, v: F.struct(
            F.greatest(a["end"], v["e"]).alias("end"), (a["eras"] + F.when(a["end"].isNull() | (v["s"] > F.date_add(a["end"], gap)), 1).otherwise(0)).alias("eras"),
            (a["days"] + F.greatest(F.lit(0), F.datediff(v["e"], F.greatest(v["s"], F.date_add(a["end"], 1))) + 1)).alias("days"),
        ),
    )
    f = lambda n: F.col(f"_f.{n}")
    m = m.withColumn("_a", folded).withColumns({
        "number_eras": F.col("_a.eras"), "days_exposed": F.col("_a.days"), "time_to_exposure": F.datediff(f("s"), index), "initial_exposure_duration": days(f("s"), f("e")),
        "initial_quantity": f("quantity"), "initial_daily_dose": f("quantity") / days(f("s"), f("e")),
    })
    zero = [n for n in METRICS if n not in ("time_to_exposure", "initial_exposure_duration")]
    out = m.select(*cohort.columns, *METRICS).fillna(0, subset=zero)
    if ingredient is None:
        return out
    doses = add_dose(c, cohort, concepts, ingredient, censor, incident, repeats)
    return beside(out.drop("initial_daily_dose", "cumulative_dose"), doses, cohort.columns).select(*cohort.columns, *METRICS)


def add_dose(
    c: Clinical, cohort: DataFrame, concepts: DataFrame, ingredient: int, censor: str = "cohort_end_date", incident: bool = True, repeats: bool = False
) -> DataFrame:
    """initial_daily_dose and cumulative_dose of an ingredient by the strength of the products, for each cohort row; 0 without any.

    Exposures are those of add_drug_use, cut to the time between index and censor date, which is also what their quantity
    spreads over. Initial: the daily doses of the exposures that start first, added up; cumulative: daily dose times days of
    all. Exposures whose dose can't be told add nothing. Rows of the cohort that are alike come once.
    """
    from eralith.operators.dose import daily_dose

    index, stop = F.col("cohort_start_date"), F.col(censor)
    keys = {k: f"_c{i}" for i, k in enumerate(cohort.columns)}
    d = c["drug_exposure"].join(_codes(concepts, repeats), "drug_concept_id")
    d = d.select(
        F.col("person_id").alias("_p"), "drug_concept_id", "quantity", F.col("drug_exposure_start_date").alias("_s"),
        F.greatest(F.coalesce("drug_exposure_end_date", "drug_exposure_start_date"), "drug_exposure_start_date").alias("_e"),
    )
    rows = cohort.distinct()
    x = rows.join(d, (F.col("subject_id") == F.col("_p")) & ((F.col("_s") if incident else F.col("_e")) >= index) & (F.col("_s") <= stop))
    first, last = F.greatest("_s", index), F.least("_e", stop)
    x = x.select(*(F.col(k).alias(v) for k, v in keys.items()), "drug_concept_id", "quantity", "_s", first.alias("drug_exposure_start_date"), F.greatest(first, last).alias("drug_exposure_end_date"))
    x = daily_dose(c, x, ingredient).withColumn("_days", F.datediff("drug_exposure_end_date", "drug_exposure_start_date") + 1)
    by_day = x.groupBy(*keys.values(), "_s").agg(F.sum("daily_dose").alias("_dose"), F.sum(F.col("daily_dose") * F.col("_days")).alias("_all"))
    found = by_day.groupBy(*keys.values()).agg(F.min_by("_dose", "_s").alias("initial_daily_dose"), F.sum("_all").alias("cumulative_dose"))
    out = beside(rows, found.withColumnsRenamed({v: k for k, v in keys.items()}), list(keys))
    return out.fillna(0, subset=["initial_daily_dose", "cumulative_dose"])


def restart(cohort: DataFrame, switch: DataFrame, c: Clinical, follow_up: Sequence[int] = (180, 365)) -> DataFrame:
    """For each entry and follow-up: restart, switch, both ("restart and switch") or untreated after it ends."""
    w = Window.partitionBy("cohort_definition_id", "subject_id").orderBy("cohort_start_date", "cohort_end_date")
    s = switch.select(F.col("subject_id").alias("_p"), F.col("cohort_start_date").alias("_s"), F.col("cohort_end_date").alias("_e"))
    op = c["observation_period"].select(F.col("person_id").alias("subject_id"), F.col("observation_period_end_date").alias("_o"))
    d = cohort.withColumn("_again", F.datediff(F.lead("cohort_start_date").over(w), "cohort_end_date")).join(op, "subject_id", "left")
    keys = [*cohort.columns, "_again", "_o"]
    d = d.join(s, (F.col("subject_id") == F.col("_p")) & (F.col("_s") > F.col("cohort_end_date")), "left").groupBy(*keys).agg(F.min(F.datediff("_s", "cohort_end_date")).alias("_switch"))
    left = F.datediff("_o", "cohort_end_date")
    for n in follow_up:
        r, x = (F.coalesce((F.col(k) <= n) & (F.col(k) <= left), F.lit(False)) for k in ("_again", "_switch"))
        d = d.withColumn(f"drug_restart_{n}", F.when(r & x, "restart and switch").when(r, "restart").when(x, "switch").otherwise("untreated"))
    return d.drop("_again", "_switch", "_o")


def proportion_covered(cohort: DataFrame, c: Clinical, days: int) -> DataFrame:
    """(cohort_definition_id, day, n_covered, n_observed, ppc) for days 0..days after each subject's first entry.

    A subject adds to a day if observed then, and is covered if one of its entries holds it. Entries and observation are
    runs of days, so both counts are running sums of how many runs begin and end at a day: no row per subject and day.
    """
    first = cohort.groupBy("cohort_definition_id", "subject_id").agg(F.min("cohort_start_date").alias("_i"))
    op = c["observation_period"].select(F.col("person_id").alias("subject_id"), F.col("observation_period_end_date").alias("_o"))
    seen = first.join(op, "subject_id").select("cohort_definition_id", "subject_id", F.col("_i"), F.least(F.datediff("_o", "_i"), F.lit(days)).alias("_n"))
    merged = islands(cohort, ["cohort_definition_id", "subject_id"], "cohort_start_date", "cohort_end_date", 1)
    cover = merged.join(seen, ["cohort_definition_id", "subject_id"]).select("cohort_definition_id", F.datediff("cohort_start_date", "_i").alias("a"), F.least(F.datediff("cohort_end_date", "_i"), F.col("_n")).alias("b")).where("a <= b")
    change = lambda df, a, b, n: df.select("cohort_definition_id", F.explode(F.array(F.struct(a.alias("day"), F.lit(1).alias(n)), F.struct((b + 1).alias("day"), F.lit(-1).alias(n)))).alias("_x")).groupBy("cohort_definition_id", "_x.day").agg(F.sum(f"_x.{n}").alias(n))
    grid = cohort.select("cohort_definition_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days))))
    on = ["cohort_definition_id", "day"]
    d = grid.join(change(cover, F.col("a"), F.col("b"), "c"), on, "left").join(change(seen.where("_n >= 0"), F.lit(0), F.col("_n"), "o"), on, "left")
    w = Window.partitionBy("cohort_definition_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    n = {k: F.sum(F.coalesce(F.col(v), F.lit(0))).over(w) for k, v in (("n_covered", "c"), ("n_observed", "o"))}
    return d.select("cohort_definition_id", F.col("day").cast("long").alias("day"), *(v.alias(k) for k, v in n.items())).where("n_observed > 0").withColumn("ppc", F.col("n_covered") / F.col("n_observed"))


def ingredient_cohorts(c: Clinical, ingredients: DataFrame, gap: int = 1) -> DataFrame:
    """Eras of use of each ingredient (cohort_definition_id, ingredient_concept_id): exposures to its descendants."""
    a = c["concept_ancestor"].join(ingredients, F.col("ancestor_concept_id") == F.col("ingredient_concept_id"))
    return _eras(c, a.select("cohort_definition_id", F.col("descendant_concept_id").alias("drug_concept_id")), gap)


def atc_cohorts(c: Clinical, word: str | None = None, levels: Sequence[str] = ("ATC 1st",), gap: int = 1, within: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cohort, settings): eras of use of the drugs below each ATC concept; a cohort is numbered by its concept.

    within: a test of concepts that replaces vocabulary and levels.
    """
    from eralith.operators.vocabulary import atc_codes

    atc = atc_codes(c, word, levels) if within is None else c["concept"].where(within).select(F.lower("concept_name").alias("name"), F.col("concept_id").cast("long").alias("concept_id")).distinct()
    below = c["concept_ancestor"].join(atc, F.col("ancestor_concept_id") == F.col("concept_id"))
    cohort = _eras(c, below.select(F.col("concept_id").alias("cohort_definition_id"), F.col("descendant_concept_id").alias("drug_concept_id")), gap)
    return cohort, atc.select(F.col("concept_id").alias("cohort_definition_id"), F.col("name").alias("cohort_name"))


def _eras(c: Clinical, codes: DataFrame, gap: int) -> DataFrame:
    op = c["observation_period"].select("person_id", F.col("observation_period_start_date").alias("_s"), F.col("observation_period_end_date").alias("_e"))
    d = c["drug_exposure"].join(codes.distinct(), "drug_concept_id").join(op, "person_id")
    d = d.where("drug_exposure_start_date between _s and _e")
    end = F.least(F.coalesce("drug_exposure_end_date", "drug_exposure_start_date"), "_e")
    d = d.select(F.col("cohort_definition_id").cast("long").alias("cohort_definition_id"), F.col("person_id").alias("subject_id"), F.col("drug_exposure_start_date").alias("cohort_start_date"), end.alias("cohort_end_date"))
    return islands(d.where("cohort_start_date <= cohort_end_date"), ["cohort_definition_id", "subject_id"], "cohort_start_date", "cohort_end_date", gap)


def add_treatment(df: DataFrame, cohorts: DataFrame, names: Mapping[int, str], window: tuple[int | None, int | None]) -> DataFrame:
    """treatment: names of the treatment cohorts that meet the window, sorted and joined; "untreated" where none does."""
    d = indication(df, cohorts, dict(names), window).withColumnRenamed("indication", "treatment")
    return d.withColumn("treatment", F.when(F.col("treatment") == "unknown", "untreated").otherwise(F.col("treatment")))


def indication(df: DataFrame, cohorts: DataFrame, names: dict[int, str], window: tuple[int | None, int | None]) -> DataFrame:
    """indication: names of the indication cohorts that meet the window, sorted and joined; "unknown" where none does.

    An entry and a cohort are one question of the sweep over the person's time in that cohort; no entry meets a cohort's entry.
    """
    label = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
    pair = F.struct(F.col("subject_id").cast("long").alias("subject"), F.col("c").cast("int").alias("c")).alias("pair")
    ids = df.select("subject_id", "cohort_start_date").where("subject_id is not null").distinct()
    asked = ids.withColumn("c", F.explode(F.array(*(F.lit(int(k)) for k in names)))).select(pair, "cohort_start_date")
    o = cohorts.where(F.col("cohort_definition_id").isin(list(names)) & F.col("subject_id").isNotNull()).withColumn("c", F.col("cohort_definition_id"))
    found = overlap_totals(asked, o.select(pair, F.col("cohort_start_date").alias("start"), F.col("cohort_end_date").alias("end")), [window], "pair", "cohort_start_date")
    hit = found.where("n_0 > 0").select(F.col("pair.subject").cast(df.schema["subject_id"].dataType).alias("subject_id"), "cohort_start_date", label[F.col("pair.c")].alias("_n"))
    hit = hit.groupBy("subject_id", "cohort_start_date").agg(F.array_join(F.array_sort(F.collect_set("_n")), " and ").alias("indication"))
    return df.join(hit, ["subject_id", "cohort_start_date"], "left").fillna("unknown", subset=["indication"])
