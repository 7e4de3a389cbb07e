"""The long result table: 13 columns, settings by result_id, suppression, splitting and pivoting of name-level pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of a result, in order, and the separator of pairs.
COLUMNS = (
    "result_id", "cdm_name", "group_name", "group_level", "strata_name", "strata_level", "variable_name", "variable_level",
    "estimate_name", "estimate_type", "estimate_value", "additional_name", "additional_level",
)
SEPARATOR = " &&& "


def unite(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """{kind}_name and {kind}_level from columns; "overall" for none. Null levels leave their pair out."""
    if not columns:
        return df.withColumns({f"{kind}_name": F.lit("overall"), f"{kind}_level": F.lit("overall")})
    name = F.concat_ws(SEPARATOR, *(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns))
    level = F.concat_ws(SEPARATOR, *(F.col(c).cast("string") for c in columns))
    df = df.withColumns({f"{kind}_name": name, f"{kind}_level": level}).drop(*columns)
    return df.withColumns({f"{kind}_{x}": F.when(F.col(f"{kind}_{x}") == "", F.lit("overall")).otherwise(F.col(f"{kind}_{x}")) for x in ("name", "level")})


def split(df: DataFrame, kind: str, names: Sequence[str]) -> DataFrame:
    """One column per name of {kind}'s pairs; "overall" where a row lacks it."""
    keys, levels = F.split(F.col(f"{kind}_name"), SEPARATOR), F.split(F.col(f"{kind}_level"), SEPARATOR)
    pairs = F.map_from_arrays(keys, levels)
    return df.withColumns({n: F.coalesce(F.try_element_at(pairs, F.lit(n)), F.lit("overall")) for n in names}).drop(f"{kind}_name", f"{kind}_level")


def melt(
    df: DataFrame, group: Sequence[str], strata: Sequence[str], variable: str, estimates: Mapping[str, str], name: str = "clinical", result_id: int = 1,
    level: str | None = None, additional: Sequence[str] = (),
) -> DataFrame:
    """A wide summary as result rows: one per estimate. estimates: column -> type; variable: a column or a fixed name."""
    value = lambda c, ty: F.format_string("%.6f", F.col(c).cast("double")) if ty == "numeric" else F.col(c).cast("string")
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("estimate_name"), F.lit(ty).alias("estimate_type"), value(c, ty).alias("estimate_value")) for c, ty in estimates.items())))
    named = F.lit(variable) if variable not in df.columns else F.col(variable)
    at = F.col(level).cast("string") if level else F.lit(None).cast("string")
    d = df.select(*group, *strata, *additional, named.alias("variable_name"), at.alias("variable_level"), rows.alias("_e")).select("*", "_e.*").drop("_e")
    d = unite(unite(unite(d, group, "group"), strata, "strata"), additional, "additional")
    d = d.withColumns({"result_id": F.lit(result_id).cast("long"), "cdm_name": F.lit(name)})
    return d.select(*COLUMNS)


def suppress(df: DataFrame, minimum: int = 5) -> DataFrame:
    """Estimates of a group and strata become "-" where one of its counts lies between 0 and minimum."""
    keys = ["result_id", "cdm_name", "group_name", "group_level", "strata_name", "strata_level", "additional_name", "additional_level"]
    count = F.when(F.lower("variable_name").isin("number records", "number subjects") | (F.col("estimate_name") == "count"), F.col("estimate_value").try_cast("double"))
    small = df.withColumn("_c", count).where((F.col("_c") > 0) & (F.col("_c") < minimum)).select(*keys).distinct().withColumn("_small", F.lit(1))
    small = small.withColumnsRenamed({k: f"_{k}" for k in keys})
    d = df.join(small, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*df.columns, "_small")
    return d.withColumn("estimate_value", F.when(F.col("_small").isNull(), F.col("estimate_value")).otherwise("-")).drop("_small")


def pivot_estimates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per estimate."""
    keys = [c for c in df.columns if not c.startswith("estimate_")]
    return df.groupBy(*keys).pivot("estimate_name", list(names)).agg(F.first("estimate_value"))


def add_settings(df: DataFrame, settings: DataFrame) -> DataFrame:
    return df.join(settings, "result_id", "left")


def tidy(df: DataFrame, group: Sequence[str], strata: Sequence[str], settings: DataFrame | None = None) -> DataFrame:
    d = split(split(df, "group", group), "strata", strata)
    return add_settings(d, settings) if settings is not None else d


def bind(*results: DataFrame) -> DataFrame:
    """Results one below the other, with result ids that stay apart: the n-th has 1,000 n added."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [r.withColumn("result_id", F.col("result_id") + 1000 * n) for n, r in enumerate(results)])


def filter_pairs(df: DataFrame, kind: str, **levels: str) -> DataFrame:
    """Rows whose {kind} pairs hold exactly these levels."""
    pairs = F.map_from_arrays(F.split(F.col(f"{kind}_name"), SEPARATOR), F.split(F.col(f"{kind}_level"), SEPARATOR))
    for name, level in levels.items():
        df = df.where(F.try_element_at(pairs, F.lit(name)).eqNullSafe(F.lit(level)))
    return df


def filter_settings(df: DataFrame, settings: DataFrame, **values: str) -> DataFrame:
    """Rows of the results whose settings have these values."""
    for name, value in values.items():
        settings = settings.where(F.col(name).eqNullSafe(F.lit(value)))
    return df.join(settings.select("result_id"), "result_id", "left_semi").select(df.columns)


def tidy_columns(df: DataFrame, group: Sequence[str], strata: Sequence[str], settings: DataFrame | None = None) -> list[str]:
    return tidy(df, group, strata, settings).columns


#: Decimals of each type of estimate.
DECIMALS = {"integer": 0, "numeric": 2, "percentage": 1, "proportion": 3}


def format_estimate_value(df: DataFrame, decimals: Mapping[str, int] | None = None, decimal_mark: str = ".", big_mark: str = ",") -> DataFrame:
    """Values rounded by their type, with marks; texts, dates, suppressed and unreadable values stay."""
    by, value = DECIMALS | dict(decimals or {}), F.col("estimate_value").try_cast("double")
    out = F.col("estimate_value")
    for kind, n in by.items():
        text = F.translate(F.format_number(value, n), ",.", "\1\2")
        text = F.replace(F.replace(text, F.lit("\1"), F.lit(big_mark)), F.lit("\2"), F.lit(decimal_mark))
        out = F.when((F.col("estimate_type") == kind) & value.isNotNull(), text).otherwise(out)
    return df.withColumn("estimate_value", out)


def format_estimate_name(df: DataFrame, names: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """Estimates put together: names maps a new name to a template such as "<count> (<percentage>%)".

    keys tell the rows of one template apart; estimates that no template uses stay as they are. A template applies where
    all its estimates are there.
    """
    import re

    used = sorted({x for t in names.values() for x in re.findall(r"<(\w+)>", t)})
    rest = df.where(~F.col("estimate_name").isin(used))
    held = F.map_from_entries(F.collect_list(F.when(F.col("estimate_name").isin(used), F.struct("estimate_name", "estimate_value"))))
    wide = df.where(F.col("estimate_name").isin(used)).groupBy(*keys).agg(held.alias("_v"))
    made = []
    for name, template in names.items():
        parts = [F.try_element_at("_v", F.lit(p)) if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"<(\w+)>", template))]
        made.append(F.struct(F.lit(name).alias("estimate_name"), F.concat(*parts).alias("estimate_value")))
    rows = wide.select(*keys, F.explode(F.array(*made)).alias("_e")).select(*keys, "_e.*", F.lit("character").alias("estimate_type")).where("estimate_value is not null")
    columns = [*keys, "estimate_name", "estimate_type", "estimate_value"]
    return rest.select(*columns).unionByName(rows.select(*columns))


def format_min_cell_count(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Suppressed values as "<n", n from the settings' min_cell_count, 5 where they have none."""
    least = F.col("min_cell_count").try_cast("int") if "min_cell_count" in settings.columns else F.lit(None).cast("int")
    d = df.join(settings.select("result_id", least.alias("_n")), "result_id", "left")
    return d.withColumn("estimate_value", F.when(F.col("estimate_value") == "-", F.concat(F.lit("<"), F.coalesce("_n", F.lit(5)))).otherwise(F.col("estimate_value"))).select(df.columns)


def format_header(df: DataFrame, header: Sequence[str], levels: Sequence[Sequence[str]], value: str = "estimate_value") -> DataFrame:
    """value spread over one column for each combination of levels of the header columns; names: levels joined by " | "."""
    keys = [x for x in df.columns if x not in (*header, value)]
    names = [" | ".join(x) for x in levels]
    return df.withColumn("_h", F.concat_ws(" | ", *header)).groupBy(*keys).pivot("_h", names).agg(F.first(value))


def export(df: DataFrame, path: str) -> None:
    """CSV files with a header; nulls as NA."""
    df.select(*COLUMNS).write.mode("overwrite").options(header="true", nullValue="NA", escape='"').csv(path)


def read_export(spark, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'long' if c == 'result_id' else 'string'}" for c in COLUMNS)
    return spark.read.options(header="true", nullValue="NA", escape='"').schema(schema).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; one of more rows than most is an error and not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
